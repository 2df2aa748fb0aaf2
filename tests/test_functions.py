import struct

import pytest
from pyspark.sql import functions as F

from gramloom.config import BuildConfig, ModelConfig, check_order, parse_discounts, parse_prune_thresholds
from gramloom.errors import ConfigError
from gramloom.functions import bits, hashing
from gramloom.functions import text as T


def one(spark, column, value="x", schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "column, value, want",
    [
        (lambda: T.words("v"), " a\u00a0b\tc\u2003 d ", ["a", "b", "c", "d"]),
        (lambda: T.words("v"), "", []),
        (lambda: T.words("v"), None, None),
        (lambda: T.sentence("v"), "a b", ["<s>", "a", "b", "</s>"]),
        (lambda: T.sentence("v", bos=False), "a", ["a", "</s>"]),
        (lambda: T.lines("v"), "a\r\n\nb", ["a", "", "b"]),
        (lambda: T.prefix("v"), "a b c", "a b"),
        (lambda: T.prefix("v"), "a", ""),
        (lambda: T.suffix("v"), "a b c", "b c"),
        (lambda: T.suffix("v"), "a", ""),
        (lambda: T.first_word("v"), "a b c", "a"),
        (lambda: T.last_word("v"), "a b c", "c"),
        (lambda: T.word_at("v", 1), "a b c", "b"),
        (lambda: T.word_at("v", 3), "a b c", None),
        (lambda: T.order_of("v"), "a b c", 3),
        (lambda: T.phrase_ngrams("v"), "a b ||| x", ["a", "a b", "b"]),
        (lambda: T.phrase_ngrams("v"), " ||| x", []),
        (lambda: T.phrase_ngrams("v"), "a a", ["a", "a a"]),
        (lambda: T.split_on("v", "||"), "a||b||||c", ["a", "b", "c"]),
        (lambda: T.split_on("v", "||", skip_empty=False), "a||||c", ["a", "", "c"]),
        (lambda: T.split_on("v", ".;", "any"), "a.b;c", ["a", "b", "c"]),
        (lambda: T.split_on("v", "./", "last"), "a.b/c.d", ["a.b/c", "d"]),
        (lambda: T.trim_of("v", " -"), " - a-b - ", "a-b"),
        (lambda: T.is_blank("v"), " \t\u00a0", True),
        (lambda: T.is_blank("v"), " x ", False),
        (lambda: T.is_arpa_text("v"), "\n \\data\\\nngram 1=1", True),
        (lambda: T.is_arpa_text("v"), "data", False),
        (lambda: T.number("v"), "  -1.5e2\tx", -150.0),
        (lambda: T.number("v", "long"), "42 7", 42),
        (lambda: T.number("v"), "   ", None),
        (lambda: T.nul_strings("v"), "a\x00\x00b\x00", ["a", "b"]),
        (lambda: T.find("v", F.lit("b")), "abcb", 1),
        (lambda: T.find("v", F.lit("z")), "abcb", None),
        (lambda: T.rfind("v", "b"), "abcb", 3),
        (lambda: T.rfind("v", "z"), "abcb", None),
        (lambda: T.find_first_of("v", "cb"), "abcb", 1),
        (lambda: T.find_last_of("v", "ac"), "abcb", 2),
        (lambda: T.find_first_not_of("v", "ab"), "abcb", 2),
        (lambda: T.find_last_not_of("v", "b"), "abcb", 2),
        (lambda: T.compare("v", F.lit("b")), "a", -1),
    ],
)
def test_text(spark, column, value, want):
    assert one(spark, column(), value) == want


def test_nul_round_trip(spark):
    joined = one(spark, T.joined_by_nul("v"), ["a", "b"], "v array<string>")
    assert joined == "a\x00b\x00"


def test_ngrams(spark):
    got = one(spark, T.ngrams("v", 2), ["a", "b", "c"], "v array<string>")
    assert [(g.n, g.ngram) for g in got] == [(1, "a"), (1, "b"), (1, "c"), (2, "a b"), (2, "b c")]
    assert one(spark, T.ngrams("v", 3, 3), ["a"], "v array<string>") == []


def murmur(data: bytes, seed: int = 0) -> int:
    """Written out for one string, as a check of the vectorised one."""
    m, full = 0xC6A4A7935BD1E995, 2**64 - 1
    h = seed ^ (len(data) * m & full)
    for i in range(0, len(data) - 7, 8):
        k = struct.unpack("<Q", data[i : i + 8])[0] * m & full
        k = (k ^ k >> 47) * m & full
        h = (h ^ k) * m & full
    if tail := data[len(data) // 8 * 8 :]:
        h = (h ^ int.from_bytes(tail, "little")) * m & full
    h = (h ^ h >> 47) * m & full
    return h ^ h >> 47


def test_hashes(spark):
    words = ["", "a", "<unk>", "<UNK>", "12345678", "123456789", "ü" * 20, "word " * 9]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r.w: r.u for r in rows.select("w", hashing.unsigned(hashing.murmur64("w")).alias("u")).collect()}
    assert {w: int(got[w]) for w in words} == {w: murmur(w.encode()) for w in words}
    assert got[None] is None and got[""] == 0
    assert (int(got["<unk>"]), int(got["<UNK>"])) == (hashing.UNK_HASH, hashing.UNK_CAPITAL_HASH)
    assert int(hashing.fnv1a_many([[1, 2, 3]])[0]) == 18239313798490686357
    h = 7
    for w in (5, 9):
        h = h * 8978948897894561157 & 2**64 - 1 ^ (w + 1) * 17894857484156487943 & 2**64 - 1
    assert int(hashing.chain_many([[7, 5, 9]])[0]) == h
    left = spark.createDataFrame([([3, 9], True), ([], False)], "p array<long>, f boolean").select(hashing.state_hash(F.col("p"), F.col("f")).alias("h"))
    assert [r.h % 2**64 for r in left.collect()] == [murmur(b"\x02\x01", 9), murmur(b"\x00\x00", 0)]


def test_bits(spark):
    assert [one(spark, bits.required_bits(F.col("v")), v, "v long") for v in (0, 1, 255, 256)] == [0, 1, 8, 9]
    rows = spark.createDataFrame([(5, 9)], "a long, b long").select(bits.pack(F.col("a"), F.col("b"), 8).alias("p"))
    high, low = bits.unpack(F.col("p"), 8)
    assert tuple(rows.select(high, low).first()) == (5, 9)
    field = bits.BitField(32)
    field.write(3, 57, 2**56 + 12345)
    field.write(60, 25, 99)
    field.write_float(90, -1.5)
    field.write_negative(130, -0.25)
    assert (field.read(3, 57), field.read(60, 25), field.read_float(90), field.read_negative(130)) == (2**56 + 12345, 99, -1.5, -0.25)


def test_settings():
    assert parse_discounts("0.5,0.75,1.0") == [0.5, 0.75, 1.0, 0.0]
    assert parse_discounts("9, x, -1") == [1.0, 0.0, 0.0, 0.0]
    assert parse_prune_thresholds("0 0 1", 5) == [0, 0, 1, 0, 0]
    assert parse_prune_thresholds("1 2 3", 2) == [1, 2]
    for bad in (lambda: check_order(7), lambda: BuildConfig(order=0), lambda: ModelConfig(semantics="odd"), lambda: ModelConfig(prob_bits=26), lambda: BuildConfig(prune_thresholds=(2, 1))):
        with pytest.raises(ConfigError):
            bad()


def test_sort_text_orders_as_lists_of_words(spark):
    import random

    r = random.Random(2)
    words = ["a", "aa", "b", "\x00", "\x01", "\x01\x00", "a\x00", "a\x01", "\x02", "é", "\x00a"]
    grams = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(300)})
    rows = spark.createDataFrame([(g,) for g in grams], "g string")
    got = [x.g for x in rows.orderBy(T.sort_text("g")).collect()]
    assert got == sorted(grams, key=lambda g: [w.encode() for w in g.split(" ")])


def test_exploded_ngrams_are_the_lists_ones(spark):
    rows = spark.createDataFrame([(1, list("abcde")), (2, ["x"]), (3, []), (4, None)], "k int, t array<string>")
    for order, least in ((3, 1), (2, 2), (1, 1), (4, 2)):
        got = sorted((x.k, x.n, x.ngram) for x in T.exploded_ngrams(rows, "t", order, least).collect())
        want = sorted((k, n, " ".join(t[i : i + n])) for k, t in ((1, list("abcde")), (2, ["x"])) for n in range(least, order + 1) for i in range(len(t) - n + 1))
        assert got == want


def test_characters_by_place(spark):
    got = spark.createDataFrame([("aé𝄞",), ("",), (None,)], "t string").select(*[T.char_at("t", k) for k in (0, 2, 3)], T.at_end("t", 3), T.at_end("t", F.lit(0))).collect()
    assert [tuple(r) for r in got] == [("a", "𝄞", None, True, False), (None, None, None, True, True), (None, None, None, None, None)]


def test_chart_hash(spark):
    rows = spark.createDataFrame([([5, 7], True, [1, 2]), ([], False, [])], "p array<long>, full boolean, w array<long>")
    got = rows.select(hashing.state_hash(F.col("p"), F.col("full")).alias("l"), hashing.chart_hash(F.col("p"), F.col("full"), F.col("w")).alias("c")).collect()
    for r, w in zip(got, ([1, 2], []), strict=True):
        assert r.c == int(hashing.murmur64_many([struct.pack(f"<{len(w)}I", *w)], r.l % 2**64).view("int64")[0])


def test_chopped_numbers():
    import random

    import numpy as np

    r = random.Random(9)
    for n, most in ((0, 1), (1, 1), (50, 10), (400, 100_000), (300, 2**40)):
        values = sorted(r.randrange(most) for _ in range(n))
        for low_bits in (None, 0, 3, 7) if most <= 100_000 else (None, 36):
            c = bits.Chopped(values, low_bits)
            assert len(c) == n and c[np.arange(n)].tolist() == values
            assert all(values[c.find(v)] == v and (c.find(v) == 0 or values[c.find(v) - 1] < v) for v in values)
            assert all(c.find(v) == -1 for v in range(-2, min(most, 300) + 3) if v not in values)
        if n > 1:
            assert bits.Chopped(values).bits <= n * values[-1].bit_length()
    with pytest.raises(ValueError):
        bits.Chopped([2, 1])
