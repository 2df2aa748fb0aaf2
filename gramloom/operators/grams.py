"""N-grams of up to three words as numbers, in numpy over Arrow batches, so that no row of text passes a shuffle.

Tables of n-grams go from task to task as blobs: a few thousand rows, coded by a list of the words that they hold. A pair of
words has a bucket, by its hash. Trigrams meet once in the bucket of their first two words, where their counts add up and
contexts are summed, and once in that of their last two, where continuations are counted. What a bucket has to know of
single words it asks of the words' own buckets, by their places in its list, and is answered in the same way. A task holds one
bucket at a time; their number grows with the input. Words decide equality, never their hashes.
"""

from __future__ import annotations

import dataclasses
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramloom.config import BOS, EOS, UNK

#: Words of the longest n-grams that are coded.
MOST = 3
#: Bytes of input for each bucket, the most of them, tokens that a task codes at once, and rows of text in a batch.
BUCKET_BYTES, BUCKETS, TOKENS, ROWS = 6_000_000, 4096, 2_000_000, 100_000
#: Unicode white space, as functions.text.WHITE has it.
WHITE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
BLOBS = "kind int, bucket int, source int, rows long, total long, blob binary"


def buckets_of(df: DataFrame) -> int:
    """Buckets for n-grams of df's texts, by the bytes of what it reads; as many as shuffles have where these aren't known."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    least = spark.sparkContext.defaultParallelism
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 60 else min(-(-size // BUCKET_BYTES), BUCKETS))


# --- words and blobs --------------------------------------------------------------------------------------------------


def _least(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0)))) if a.dtype.kind in "iu" else a


def packed(words: pa.Array, columns: list[np.ndarray]) -> bytes:
    flat = pa.concat_arrays([words])  # without an offset
    ends = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    letters = flat.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if len(flat) and flat.buffers()[2] else b""
    raw = pickle.dumps((letters, _least(np.diff(ends)), [_least(c) for c in columns]), protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    letters, sizes, columns = pickle.loads(raw)
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters)), columns


def hashes(words: pa.Array) -> np.ndarray:
    """A number for each word, by which it's dealt out: its bytes times powers of a number, summed up modulo 2 ** 64."""
    if not len(words):
        return np.zeros(0, np.uint64)
    flat = pa.concat_arrays([words])
    ends = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1].astype(np.int64)
    sizes = np.diff(ends)
    letters = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    power = np.full(int(sizes.max()), 0x100000001B3, np.uint64).cumprod(dtype=np.uint64)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * power[np.arange(len(letters)) - np.repeat(ends[:-1] - ends[0], sizes)], out=sums[1:], dtype=np.uint64)
    at = ends - ends[0]
    return sums[at[1:]] - sums[at[:-1]]


def pair_bucket(h: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    x = (h[a] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[b] >> np.uint64(7)) ^ (h[b] << np.uint64(21))
    return word_bucket(x, buckets)


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def merged(parts: list[tuple[pa.Array, list[np.ndarray]]], coded: int) -> tuple[pa.Array, list[np.ndarray]]:
    """One list of words, and the columns of all parts one after the other; the first `coded` ones hold numbers of words."""
    if not parts:
        return pa.array([], pa.string()), []
    met = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    codes, at = met.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *[len(w) for w, _ in parts]])
    columns = []
    for k in range(len(parts[0][1])):
        columns.append(np.concatenate([codes[at[i] : at[i + 1]][c[k]] if k < coded else c[k].astype(np.int64) for i, (_, c) in enumerate(parts)]))
    return met.dictionary, columns


def cut(words: pa.Array, columns: list[np.ndarray], coded: int) -> bytes:
    """A blob of some rows with the words that these hold only."""
    codes, n = np.concatenate(columns[:coded]), len(columns[0])
    if 8 * len(codes) > len(words):
        there = np.zeros(len(words), bool)
        there[codes] = True
        used, inverse = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[codes]
    else:
        used, inverse = np.unique(codes, return_inverse=True)
    return packed(words.take(pa.array(used)), [*(inverse[k * n : (k + 1) * n] for k in range(coded)), *columns[coded:]])


def dealt(kind: int, source: int, bucket: np.ndarray, words: pa.Array, columns: list[np.ndarray], coded: int) -> Iterator[tuple]:
    """Rows of BLOBS: one for each bucket that gets some rows of the columns."""
    by = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket, columns = bucket[by], [c[by] for c in columns]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for i, j in zip(starts, [*starts[1:], len(bucket)], strict=True):
        yield kind, int(bucket[i]), source, int(j - i), int(columns[-1][i:j].sum() if len(columns) > coded else 0), cut(words, [c[i:j] for c in columns], coded)


def blob_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    names, kinds = ["kind", "bucket", "source", "rows", "total", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 16_000_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, bytes]]]]]:
    """The blobs of one bucket after the other: by kind, each with its source."""
    now, held = None, {}
    for batch in batches:
        kind, bucket, source, _, _, blobs = batch.columns
        for k, b, s, x in zip(kind.to_pylist(), bucket.to_pylist(), source.to_pylist(), blobs, strict=True):
            if b != now:
                if now is not None:
                    yield now, held
                now, held = b, {}
            held.setdefault(k, []).append((s, x.as_py()))
    if now is not None:
        yield now, held


def summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys in order, and the sums of each one's values."""
    if not len(keys):
        return keys, [v.astype(np.int64) for v in values]
    by = np.argsort(keys)
    keys = keys[by]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], [np.add.reduceat(v[by].astype(np.int64), starts) for v in values]


def triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, words: int) -> tuple[np.ndarray, Callable]:
    """Keys that order as (a, b, c) do, and what gives these back."""
    if words < 1 << 21:
        low = np.int64((1 << 21) - 1)
        return a.astype(np.int64) << 42 | b.astype(np.int64) << 21 | c, lambda k: (k >> 42, k >> 21 & low, k & low)
    pairs, place = np.unique(a.astype(np.int64) * words + b, return_inverse=True)
    return place.astype(np.int64) * words + c, lambda k: (pairs[k // words] // words, pairs[k // words] % words, k % words)


def ngram_text(words: pa.Array, *codes: np.ndarray) -> pa.Array:
    parts = [words.take(pa.array(c)) for c in codes]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")


def text_batches(n: int, words: pa.Array, codes: list[np.ndarray], columns: list[pa.Array | np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of n, ngram and other columns."""
    for i in range(0, len(codes[0]), ROWS):
        at = slice(i, i + ROWS)
        texts = ngram_text(words, *(c[at] for c in codes))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), n, np.int32)), texts, *(pa.array(c[at]) if isinstance(c, np.ndarray) else c[at] for c in columns)], names)


# --- from texts to tables ---------------------------------------------------------------------------------------------


def worded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts' lines, or of lists of words, one after the other, how many each sentence has, its row and its line there (from 0). A line without words is none."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        row = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        column = column.drop_null()
        return pc.cast(column.flatten(), pa.string()), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), row, np.zeros(len(row), np.int64)
    texts = pc.split_pattern(pc.cast(column.fill_null(""), pa.string()), "\n")
    many = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, of = texts.flatten(), np.repeat(np.arange(len(texts)), many)
    line = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    lists = pc.split_pattern_regex(lines, WHITE)
    found, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.not_equal(found, "")
    keep = there.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)[keep]
    sizes = np.bincount(row, minlength=len(sizes))
    return found.filter(there), sizes[sizes > 0], of[sizes > 0], line[sizes > 0]


@dataclasses.dataclass
class Coded:
    """Sentences between their markers: the words that occur, all tokens' numbers, and how many tokens follow each in its sentence."""

    words: pa.Array
    ids: np.ndarray
    after: np.ndarray
    sizes: np.ndarray


def coded(found: pa.Array, sizes: np.ndarray) -> Coded:
    met = pa.concat_arrays([pa.array([BOS, EOS]), found]).dictionary_encode()
    codes = met.indices.to_numpy(zero_copy_only=False).astype(np.int64)[2:]
    full = sizes + 2
    first = np.cumsum(full) - full
    ids = np.zeros(int(full.sum()), np.int64)
    ends = first + full - 1
    inner = np.ones(len(ids), bool)
    inner[first] = inner[ends] = False
    ids[inner], ids[ends] = codes, 1
    return Coded(met.dictionary, ids, np.repeat(ends, full) - np.arange(len(ids)), full)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Words, sizes and rows of sentences, of about TOKENS tokens at once, and the rows; the batches' last column is coded."""
    held, n, at = [], 0, 0

    def whole() -> tuple:
        rows = pa.Table.from_batches([x[3] for x in held]).combine_chunks().to_batches()
        return pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), rows[0] if rows else held[0][3]

    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            found, sizes, row, _ = worded(part.columns[-1])
            held.append((found, sizes, row + at, part.select(part.schema.names[:-1])))
            n, at = n + len(found) + 2 * len(sizes), at + part.num_rows
            if n >= TOKENS:
                yield whole()
                held, n, at = [], 0, 0
    if n:
        yield whole()


#: Kinds of blobs: trigrams by their first two words, pairs, single words; trigrams by their last two, pairs with their sums; asked and answered words.
TRI, PAIR, WORD, LATE, SUMS, ASK, STORE, REPLY = range(8)


def first_tables(order: int, buckets: int) -> Callable:
    """Counts of each chunk: trigrams (or pairs), for trigrams also the pairs at sentences' ends, and single words."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for found, sizes, *_ in chunks(batches):
            t = coded(found, sizes)
            h = hashes(t.words)
            count = np.bincount(t.ids, minlength=len(t.words))
            there = np.flatnonzero(count)
            yield from dealt(WORD, 0, word_bucket(h[there], buckets), t.words, [there, count[there]], 1)
            ends = np.flatnonzero(t.after == 1) if order == 3 else np.flatnonzero(t.after >= 1) if order == 2 else np.zeros(0, np.int64)
            if len(ends):
                keys, [c] = summed(t.ids[ends] * len(t.words) + t.ids[ends + 1], [np.ones(len(ends), np.int64)])
                a, b = keys // len(t.words), keys % len(t.words)
                yield from dealt(PAIR, 0, pair_bucket(h, a, b, buckets), t.words, [a, b, c], 2)
            if order == 3:
                at = np.flatnonzero(t.after >= 2)
                keys, back = triples(t.ids[at], t.ids[at + 1], t.ids[at + 2], len(t.words))
                keys.sort()
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                a, b, c = back(keys[starts])
                yield from dealt(TRI, 0, pair_bucket(h, a, b, buckets), t.words, [a, b, c, np.diff(np.r_[starts, len(keys)])], 3)

    return lambda batches: blob_batches(tables(batches))


def met(rows: DataFrame, buckets: int) -> DataFrame:
    """Blobs in the tasks of their buckets, bucket after bucket."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")


@dataclasses.dataclass
class Bucket:
    """words; pairs: a, b, count, contexts' sum and followers; tri: a, b, c, count, place of the pair (a, b)."""

    words: pa.Array
    pairs: list[np.ndarray]
    tri: list[np.ndarray]


def first_bucket(held: dict[int, list[tuple[int, bytes]]], order: int) -> Bucket:
    """Trigrams and pairs of a bucket, with their counts, in the order of their numbers."""
    parts = [unpacked(x) for k in (TRI, PAIR) for _, x in held.get(k, [])]
    n_tri = len(held.get(TRI, []))
    words, codes = _codes(parts)
    column = lambda k, which: np.concatenate([codes[i][c[k]] if k < (3 if which else 2) else c[k].astype(np.int64) for i, (_, c) in enumerate(parts) if (i < n_tri) == which] or [np.zeros(0, np.int64)])
    v = max(1, len(words))
    keys, back = triples(column(0, True), column(1, True), column(2, True), v)
    keys, [c3] = summed(keys, [column(3, True)])
    a, b, c = back(keys)
    pair = a * v + b
    ends = column(0, False) * v + column(1, False)
    pairs, [c2, total, followers] = summed(np.r_[pair, ends], [np.r_[c3, column(2, False)], np.r_[c3, np.zeros(len(ends), np.int64)], np.r_[np.ones(len(pair), np.int64), np.zeros(len(ends), np.int64)]])
    return Bucket(words, [pairs // v, pairs % v, c2, total, followers], [a, b, c, c3, np.searchsorted(pairs, pair)])


def _codes(parts: list[tuple[pa.Array, list]]) -> tuple[pa.Array, list[np.ndarray]]:
    """The list of all parts' words, and for each part its words' numbers there."""
    if not parts:
        return pa.array([], pa.string()), []
    found = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    return found.dictionary, np.split(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(w) for w, _ in parts])[:-1])


def word_counts(held: dict[int, list[tuple[int, bytes]]]) -> tuple[pa.Array, np.ndarray]:
    words, columns = merged([unpacked(x) for _, x in held.get(WORD, [])], 1)
    if not columns:
        return words, np.zeros(0, np.int64)
    return words, np.bincount(columns[0], columns[1], len(words)).astype(np.int64)


def counted(rows: DataFrame, order: int, least: int = 1) -> DataFrame:
    """n, ngram, c of the n-grams of `least` to `order` (3 at most) words in rows' first column: texts, or lists of words."""
    buckets = buckets_of(rows)
    blobs = rows.mapInArrow(first_tables(order, buckets), BLOBS)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "ngram", "c"]
        for _, held in by_bucket(batches):
            if least == 1:
                words, c = word_counts(held)
                yield from text_batches(1, words, [np.arange(len(words))], [c], names)
            if order > 1:
                x = first_bucket(held, order)
                if least <= 2:
                    yield from text_batches(2, x.words, x.pairs[:2], [x.pairs[2]], names)
                if order == 3:
                    yield from text_batches(3, x.words, x.tri[:3], [x.tri[3]], names)

    return met(blobs, buckets).mapInArrow(reduce, "n int, ngram string, c long")


# --- tables with what an estimator reads off them ---------------------------------------------------------------------

STORED = BLOBS + ", store binary"


def _late(order: int, buckets: int) -> Callable:
    """Of each bucket of first pairs: its single words' counts, its pairs with their sums, and its trigrams for the buckets of their last two words."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, held in by_bucket(batches):
            words, c = word_counts(held)
            if len(words):
                yield WORD, bucket, 0, len(words), int(c.sum()), packed(words, [np.arange(len(words)), c])
            x = first_bucket(held, order)
            if len(x.pairs[0]):
                yield SUMS, bucket, 0, len(x.pairs[0]), 0, cut(x.words, x.pairs, 2)
            if len(x.tri[0]):
                a, b, c, c3, place = x.tri
                yield from dealt(LATE, bucket, pair_bucket(hashes(x.words), b, c, buckets), x.words, [a, b, c, c3, x.pairs[3][place], x.pairs[4][place]], 3)

    return lambda batches: blob_batches(tables(batches))


@dataclasses.dataclass
class Stored:
    """A bucket of last pairs. pairs: a, b, count, continuations, and as contexts their sum and followers; tri: first word, place of the last pair, count, its context's sum and followers."""

    words: pa.Array
    pairs: list[np.ndarray]
    tri: list[np.ndarray]

    @staticmethod
    def of(blob: bytes) -> Stored:
        words, columns = unpacked(blob)
        columns = [c.astype(np.int64) for c in columns]
        return Stored(words, columns[:6], columns[6:])

    def effective(self, order: int) -> np.ndarray:
        return self.pairs[3] if order == 3 else self.pairs[2]


def _stored(held: dict[int, list[tuple[int, bytes]]], order: int) -> Stored:
    if order == 2:
        x = first_bucket(held, 2)
        none = np.zeros(len(x.pairs[0]), np.int64)
        return Stored(x.words, [*x.pairs[:3], none, none, none], [none[:0]] * 5)
    parts = [unpacked(x) for k in (LATE, SUMS) for _, x in held.get(k, [])]
    late, (words, codes) = len(held.get(LATE, [])), _codes(parts)
    column = lambda k, coded, i, j: np.concatenate([codes[p][parts[p][1][k]] if k < coded else parts[p][1][k].astype(np.int64) for p in range(i, j)] or [np.zeros(0, np.int64)])
    w1, b, c, c3, xt, xf = (column(k, 3, 0, late) for k in range(6))
    a2, b2, c2, total, followers = (column(k, 2, late, len(parts)) for k in range(5))
    v = max(1, len(words))
    keys = a2 * v + b2  # all different; each last pair of a trigram is a pair of the same bucket
    by = np.argsort(keys)
    keys = keys[by]
    place = np.searchsorted(keys, b * v + c)
    cc = np.bincount(place, minlength=len(keys)).astype(np.int64)
    return Stored(words, [keys // v, keys % v, c2[by], cc, total[by], followers[by]], [w1, place, c3, xt, xf])


def _store(order: int, buckets: int) -> Callable:
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, held in by_bucket(batches):
            words, c = word_counts(held)
            if len(words):
                yield WORD, bucket, 0, len(words), int(c.sum()), packed(words, [np.arange(len(words)), c]), None
            x = _stored(held, order)
            if not len(x.pairs[0]):
                continue
            yield STORE, bucket, 0, len(x.pairs[0]) + len(x.tri[0]), 0, None, packed(x.words, [*x.pairs, *x.tri])
            a, b, e, n = x.pairs[0], x.pairs[1], x.effective(order), len(x.words)
            total, followers, opens, closes = (np.bincount(k, w, n).astype(np.int64) for k, w in ((a, e), (a, e > 0), (a, None), (b, None)))
            asked = np.flatnonzero(opens + closes)
            for row in dealt(ASK, bucket, word_bucket(hashes(x.words.take(pa.array(asked))), buckets), x.words, [asked, asked, total[asked], followers[asked], opens[asked], closes[asked]], 1):
                yield *row, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "bucket", "source", "rows", "total", "blob", "store"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        held, size = [], 0
        for row in tables(batches):
            held.append(row)
            size += len(row[5] or row[6])
            if size > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


@dataclasses.dataclass
class Words:
    """Single words of a bucket: count, and of the pairs that they open the effective counts' sum, how many have one, how many there are, and how many pairs they close."""

    words: pa.Array
    count: np.ndarray
    total: np.ndarray
    followers: np.ndarray
    opens: np.ndarray
    closes: np.ndarray


def _words(held: dict[int, list[tuple[int, bytes]]]) -> tuple[Words, list[tuple[int, np.ndarray, np.ndarray]]]:
    """What a bucket knows of its words, and who asked: source, the places in its list, and the words' numbers here."""
    words, count = word_counts(held)
    asks = held.get(ASK, [])
    parts = [(words, []), *(unpacked(x) for _, x in asks)]
    _, codes = _codes(parts)  # of `words` themselves: 0, 1, ...; all others are among them
    sums = [np.zeros(len(words), np.int64) for _ in range(4)]
    found = []
    for (source, _), (_, c), code in zip(asks, parts[1:], codes[1:], strict=True):
        at = code[c[0]]
        for k in range(4):
            sums[k][at] += c[2 + k].astype(np.int64)  # a word stands once in a blob
        found.append((source, c[1].astype(np.int64), at))
    return Words(words, count, *sums), found


@dataclasses.dataclass
class Statistics:
    """Tables of all n-grams of a corpus, up to `order` (2 or 3) words, in scratch storage."""

    rows: DataFrame
    order: int
    buckets: int

    def size(self) -> tuple[int, int]:
        """Tokens and different words, markers included."""
        found = self.rows.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        return found[0], found[1]

    def singles(self, f: Callable[[pa.Array, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Rows of single words and their counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    words, [_, c] = unpacked(blob.as_py())
                    yield from f(words, c.astype(np.int64))

        return self.rows.where(F.col("kind") == WORD).select("blob").mapInArrow(run, schema)

    def words(self, f: Callable[[Words], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Rows of single words, with the sums over the pairs that they open or close."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, held in by_bucket(batches):
                yield from f(_words(held)[0])

        return met(self.rows.where(F.col("kind").isin(WORD, ASK)).drop("store"), self.buckets).mapInArrow(run, schema)

    def longer(self, f: Callable[[Stored], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Rows of pairs and trigrams."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    yield from f(Stored.of(blob.as_py()))

        return self.rows.where(F.col("kind") == STORE).select("store").mapInArrow(run, schema)

    def answered(self, f: Callable[[Stored, list[np.ndarray], dict], Iterator[pa.RecordBatch]], schema: str, more: DataFrame | None = None) -> DataFrame:
        """Rows of pairs and trigrams, with count, sum and followers of the single words. more: further blobs for their buckets, which f gets too."""

        def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for bucket, held in by_bucket(batches):
                w, asked = _words(held)
                for source, place, at in asked:
                    yield REPLY, source, bucket, len(place), 0, packed(pa.array([], pa.string()), [place, w.count[at], w.total[at], w.followers[at]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, held in by_bucket(batches):
                x = Stored.of(held[STORE][0][1]) if STORE in held else Stored(pa.array([], pa.string()), [np.zeros(0, np.int64)] * 6, [np.zeros(0, np.int64)] * 5)
                known = [np.zeros(len(x.words), np.int64) for _ in range(3)]
                for _, blob in held.get(REPLY, []):
                    place, *columns = (c.astype(np.int64) for c in unpacked(blob)[1])
                    for whole, c in zip(known, columns, strict=True):
                        whole[place] = c
                yield from f(x, known, held)

        answers = met(self.rows.where(F.col("kind").isin(WORD, ASK)).drop("store"), self.buckets).mapInArrow(lambda batches: blob_batches(replies(batches)), BLOBS)
        stores = self.rows.where(F.col("kind") == STORE).select("kind", "bucket", "source", "rows", "total", F.col("store").alias("blob"))
        rows = stores.unionByName(answers)
        return met(rows.unionByName(more) if more is not None else rows, self.buckets).mapInArrow(run, schema)


def statistics(rows: DataFrame, order: int, keep: Callable[[DataFrame, str], DataFrame]) -> Statistics:
    """Of the n-grams in rows' first column: texts, or lists of words. keep: stores a table."""
    buckets = buckets_of(rows)
    blobs = rows.mapInArrow(first_tables(order, buckets), BLOBS)
    if order == 3:
        blobs = met(blobs, buckets).mapInArrow(_late(order, buckets), BLOBS)
    return Statistics(keep(met(blobs, buckets).mapInArrow(_store(order, buckets), STORED), "ngrams"), order, buckets)


def effective_counts(s: Statistics) -> DataFrame:
    """As counts.effective_counts(), where all single words have their counts."""
    schema, names = "n int, ngram string, c long, e long", ["n", "ngram", "c", "e"]
    order = s.order

    def longer(x: Stored) -> Iterator[pa.RecordBatch]:
        a, b = x.pairs[:2]
        yield from text_batches(2, x.words, [a, b], [x.pairs[2], x.effective(order)], names)
        yield from text_batches(3, x.words, [x.tri[0], a[x.tri[1]], b[x.tri[1]]], [x.tri[2], x.tri[2]], names)

    return s.longer(longer, schema).unionByName(s.singles(lambda words, c: text_batches(1, words, [np.arange(len(words))], [c, c], names), schema))


def continuation_counts(s: Statistics) -> DataFrame:
    """As counts.continuation_counts(), of three orders."""
    schema, names = "n int, ngram string, cc long", ["n", "ngram", "cc"]

    def longer(x: Stored) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(x.pairs[3])
        yield from text_batches(2, x.words, [x.pairs[0][at], x.pairs[1][at]], [x.pairs[3][at]], names)

    def single(w: Words) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(w.closes)
        yield from text_batches(1, w.words, [at], [w.closes[at]], names)

    return s.longer(longer, schema).unionByName(s.words(single, schema))


def context_stats(s: Statistics) -> DataFrame:
    """As counts.context_stats()."""
    schema, names = "n int, context string, total long, followers long", ["n", "context", "total", "followers"]

    def longer(x: Stored) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(x.pairs[5])
        yield from text_batches(3, x.words, [x.pairs[0][at], x.pairs[1][at]], [x.pairs[4][at], x.pairs[5][at]], names)

    def single(w: Words) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(w.opens)
        yield from text_batches(2, w.words, [at], [w.total[at], w.followers[at]], names)

    return s.longer(longer, schema).unionByName(s.words(single, schema))


def marked_count_of_counts(s: Statistics) -> DataFrame:
    """As counts.count_of_counts() of effective counts where n-grams that begin with <s> keep their count, and all below the highest order have continuation counts."""
    schema = "n int, types long, n0 long, n1 long, n2 long, n3 long, n4 long"
    order = s.order

    def row(n: int, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(e):
            few = np.bincount(np.minimum(e, 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([int(x)]) for x in (len(e), *few[:5]))], ["n", "types", "n0", "n1", "n2", "n3", "n4"])

    def longer(x: Stored) -> Iterator[pa.RecordBatch]:
        opens = pc.equal(x.words, BOS).to_numpy(zero_copy_only=False)[x.pairs[0]]
        yield from row(2, np.where(opens, x.pairs[2], x.effective(order)))
        yield from row(3, x.tri[2])

    def single(w: Words) -> Iterator[pa.RecordBatch]:
        yield from row(1, np.where(pc.equal(w.words, BOS).to_numpy(zero_copy_only=False), w.count, w.closes))

    rows = s.longer(longer, schema).unionByName(s.words(single, schema))
    return rows.groupBy("n").agg(F.sum("types").alias("types"), F.sum("types").alias("unpruned"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(5)])


@dataclasses.dataclass
class Estimator:
    """Log probabilities of "reference" semantics, from the sums over all single words."""

    order: int
    tokens: int
    types: int
    discount: float
    least: float

    def _log(self, p: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(p, self.least)).astype(np.float32)

    def single(self, c: np.ndarray) -> np.ndarray:
        total, bound = float(max(self.tokens, 1)), float(max(self.types + 1, 3))
        return self._log(np.maximum(c - self.discount, 0.0) / total + self.discount * float(self.types) / total / bound)

    def _share(self, e: np.ndarray, total: np.ndarray, followers: np.ndarray, below: np.ndarray) -> np.ndarray:
        t = np.maximum(total, 1).astype(np.float64)
        p = np.maximum(e - self.discount, 0.0) / t + self.discount * followers / t * np.power(10.0, below.astype(np.float64))
        return self._log(np.where(total == 0, self.least, p))  # a context that only <s> opens has no continuation: its probabilities are the floor

    def longer(self, x: Stored, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of a bucket's pairs and trigrams."""
        a, b = x.pairs[:2]
        p2 = self._share(x.effective(self.order), known[1][a], known[2][a], self.single(known[0][b]))
        _, place, c, xt, xf = x.tri
        return p2, self._share(c, xt, xf, p2[place])


def reference_model(s: Statistics, discount: float, least: float) -> DataFrame:
    """n, ngram, prob, backoff, has_backoff: as estimate.estimate() of "reference" semantics."""
    schema, names = "n int, ngram string, prob float, backoff float, has_backoff boolean", ["n", "ngram", "prob", "backoff", "has_backoff"]
    order, e = s.order, Estimator(s.order, *s.size(), discount, least)

    def out(n: int, words: pa.Array, codes: list[np.ndarray], prob: np.ndarray) -> Iterator[pa.RecordBatch]:
        inner = n < order or n == 1
        backoff = pa.array(np.zeros(len(prob), np.float32)) if inner else pa.nulls(len(prob), pa.float32())
        yield from text_batches(n, words, codes, [prob, backoff, np.full(len(prob), inner)], names)

    def longer(x: Stored, known: list[np.ndarray], _: dict) -> Iterator[pa.RecordBatch]:
        a, b = x.pairs[:2]
        p2, p3 = e.longer(x, known)
        yield from out(2, x.words, [a, b], p2)
        yield from out(3, x.words, [x.tri[0], a[x.tri[1]], b[x.tri[1]]], p3)

    return s.singles(lambda words, c: out(1, words, [np.arange(len(words))], e.single(c)), schema).unionByName(s.answered(longer, schema))


# --- scores of texts --------------------------------------------------------------------------------------------------


def _asked(order: int, buckets: int) -> Callable:
    """Of each chunk of texts: a table of its sentences' tokens, and the n-grams that it asks for, by their last two words or their word."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for k, (found, sizes, row, rows) in enumerate(chunks(batches)):
            t, source = coded(found, sizes), part << 12 | k
            h, v = hashes(t.words), len(t.words)
            opens = np.zeros(len(t.ids), bool)
            opens[np.cumsum(t.sizes) - t.sizes] = True
            second = np.r_[False, opens[:-1]]
            at = np.flatnonzero(~opens)  # tokens that are scored
            long = ~second[at] if order == 3 else np.zeros(len(at), bool)
            place = np.zeros(len(at), np.int64)  # of each token's longest n-gram among those asked for: trigrams, then pairs
            three, two = at[long], at[~long]
            keys, back = triples(t.ids[three - 2], t.ids[three - 1], t.ids[three], v)
            keys, place[long] = np.unique(keys, return_inverse=True)
            a, b, c = back(keys)
            if len(keys):
                yield from dealt(TRI, source, pair_bucket(h, b, c, buckets), t.words, [a, b, c, np.arange(len(keys))], 3)
            pairs, place2 = np.unique(t.ids[two - 1] * v + t.ids[two], return_inverse=True)
            place[~long] = place2 + len(keys)
            if len(pairs):
                yield from dealt(PAIR, source, pair_bucket(h, pairs // v, pairs % v, buckets), t.words, [pairs // v, pairs % v, np.arange(len(pairs)) + len(keys)], 2)
            yield from dealt(WORD, source, word_bucket(h, buckets), t.words, [np.arange(v), np.arange(v)], 1)
            lines = np.repeat(np.arange(len(sizes)), sizes + 1)
            unk = pc.index(t.words, UNK).as_py()
            used, small = np.unique(row, return_inverse=True)
            numbers = packed(pa.array([], pa.string()), [np.bincount(small[lines], minlength=len(used)), place, np.r_[c, pairs % v]])  # rows are in order
            yield STORE, source, source, len(used), len(at), pickle.dumps((rows.take(pa.array(used)), numbers, unk, v), protocol=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blob_batches(tables(batches)):
            store = pc.equal(batch.column(0), STORE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pc.if_else(store, None, batch.column(5)), pc.if_else(store, batch.column(5), None)], [*batch.schema.names, "store"])

    return run


def _entries(buckets: int) -> Callable:
    """The entries (n, ngram, prob) of a model, for the buckets of their last two words or their word."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > TOKENS:
                yield from entries(held)
                held, size = [], 0
        yield from entries(held)

    def entries(held: list[pa.RecordBatch]) -> Iterator[tuple]:
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        for n, kind in ((1, WORD), (2, PAIR), (3, TRI)):
            part = whole.filter(pc.equal(whole["n"], n))
            if not part.num_rows:
                continue
            met = pc.split_pattern(pc.cast(part["ngram"], pa.string()), " ").combine_chunks().flatten().dictionary_encode()
            codes = met.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)
            h, prob = hashes(met.dictionary), part["prob"].to_numpy().astype(np.float32).view(np.uint32)
            bucket = word_bucket(h[codes[:, 0]], buckets) if n == 1 else pair_bucket(h, codes[:, n - 2], codes[:, n - 1], buckets)
            yield from dealt(kind + FOUND, -1, bucket, met.dictionary, [*codes.T, prob], n)

    return lambda batches: blob_batches(tables(batches))


#: Added to the kinds of a model's entries.
FOUND = 10


def _answer(held: dict, words: pa.Array, twos: list[np.ndarray], p2: np.ndarray, threes: list[np.ndarray], p3: np.ndarray, bucket: int) -> Iterator[tuple]:
    """For each chunk that asked a bucket: the places of its n-grams, and the log probabilities of their longest entries here; not a number where there's no entry."""
    asks = [(kind, source, unpacked(x)) for kind in (PAIR, TRI) for source, x in held.get(kind, [])]
    if not asks:
        return
    met, codes = _codes([(words, []), *(x for _, _, x in asks)])
    v = max(1, len(met))  # the entries' words keep their numbers
    k2, k3 = twos[0] * v + twos[1], threes[1] * v + threes[2]
    by = np.argsort(k2)
    k2, p2 = k2[by], p2[by]
    last = np.unique(k3)
    k3 = np.searchsorted(last, k3) * v + threes[0]  # a trigram's key: its last pair's place among those of its like, then its first word
    by = np.argsort(k3)
    k3, p3 = k3[by], p3[by]

    def at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return place, keys[place] == wanted

    for (kind, source, (_, c)), code in zip(asks, codes[1:], strict=True):
        pair = code[c[-3]] * v + code[c[-2]]
        place, hit = at(k2, pair)
        out = np.full(len(pair), np.nan, np.float32)
        out[hit] = p2[place[hit]]
        if kind == TRI:
            place, there = at(last, pair)
            place, hit = at(k3, place * v + code[c[0]])
            hit &= there
            out[hit] = p3[place[hit]]
        yield kind, source, bucket, len(out), 0, packed(pa.array([], pa.string()), [c[-1], out.view(np.uint32)])


def _single_answers(held: dict, words: pa.Array, p1: np.ndarray, kind: int, bucket: int) -> Iterator[tuple]:
    """As _answer(), of single words, which blobs of a kind ask for."""
    asks = [(source, unpacked(x)) for source, x in held.get(kind, [])]
    _, codes = _codes([(words, []), *(x for _, x in asks)])
    for (source, (_, c)), code in zip(asks, codes[1:], strict=True):
        at, out = code[c[0]], np.full(len(c[0]), np.nan, np.float32)
        hit = at < len(words)
        out[hit] = p1[at[hit]]
        yield WORD, source, bucket, len(out), 0, packed(pa.array([], pa.string()), [c[-1], out.view(np.uint32)])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a model's entries and of what is asked, bucket by bucket."""

    def tables() -> Iterator[tuple]:
        for bucket, held in by_bucket(batches):
            found = {}
            for n, kind in ((1, WORD), (2, PAIR), (3, TRI)):
                words, columns = merged([unpacked(x) for _, x in held.get(kind + FOUND, [])], n)
                columns = columns or [np.zeros(0, np.int64)] * (n + 1)
                found[n] = words, columns[:n], columns[n].astype(np.uint32).view(np.float32)
            words, [k1], p1 = found[1]
            prob = np.zeros(len(words), np.float32)
            prob[k1] = p1
            yield from _single_answers(held, words, prob, WORD, bucket)
            both, (two, three) = _codes([(found[2][0], []), (found[3][0], [])])
            yield from _answer(held, both, [two[c] for c in found[2][1]], found[2][2], [three[c] for c in found[3][1]], found[3][2], bucket)

    return blob_batches(tables())


def _summed_scores(docs: DataFrame, asked: DataFrame, answers: DataFrame, unknown: float, buckets: int) -> DataFrame:
    key = docs.schema.fields[0]
    stores = asked.where(F.col("kind") == STORE).select("kind", "bucket", "source", "rows", "total", F.col("store").alias("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            keys, numbers, unk, v = pickle.loads(held[STORE][0][1])
            tokens, place, last = (c.astype(np.int64) for c in unpacked(numbers)[1])
            longest, single = np.full(len(last), np.nan, np.float32), np.full(v, np.nan, np.float32)
            for kind in (TRI, PAIR, WORD):
                for _, blob in held.get(kind, []):
                    at, prob = unpacked(blob)[1]
                    (single if kind == WORD else longest)[at] = prob.astype(np.uint32).view(np.float32)
            oov = np.isnan(single)[last]
            prob = np.where(oov, np.float32(unknown), np.where(np.isnan(longest), single[last], longest)).astype(np.float64)
            if unk >= 0:
                oov = oov | (last == unk)
            row = np.repeat(np.arange(len(tokens)), tokens)
            sums = [np.bincount(row, prob[place], len(tokens)), np.bincount(row, oov[place], len(tokens)).astype(np.int64), tokens]
            yield pa.RecordBatch.from_arrays([keys.column(0), *map(pa.array, sums)], [key.name, "total", "oov", "tokens"])

    schema = T.StructType([key]).add("total", "double").add("oov", "long").add("tokens", "long")
    found = stores.unionByName(answers).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
    return found.groupBy(key.name).agg(*[F.sum(c).alias(c) for c in ("total", "oov", "tokens")])


def document_scores(docs: DataFrame, model: DataFrame, order: int, unknown: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The key, total, oov, tokens of docs(key, text) by the entries model(n, ngram, prob) of a gapless model without backoffs: as score_tokens() and sentence_scores().

    Chunks of texts ask buckets for their n-grams by place, and are answered by place.
    """
    buckets = max(buckets_of(docs), buckets_of(model))
    asked = keep(docs.mapInArrow(_asked(order, buckets), STORED), "asked")
    rows = model.select("n", "ngram", "prob").mapInArrow(_entries(buckets), BLOBS).unionByName(asked.where(F.col("kind") != STORE).drop("store"))
    return _summed_scores(docs, asked, met(rows, buckets).mapInArrow(_answers, BLOBS), unknown, buckets)


def estimated_scores(docs: DataFrame, s: Statistics, discount: float, least: float, unknown: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """As document_scores(), by the reference model of these statistics, whose entries are estimated where they are asked for and never written."""
    e = Estimator(s.order, *s.size(), discount, least)

    def unk(words: pa.Array, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (k := pc.index(words, UNK).as_py()) >= 0:
            yield pa.RecordBatch.from_arrays([pa.array(e.single(c[k : k + 1]))], ["prob"])

    found = s.singles(unk, "prob float").first()  # a corpus may hold the word itself
    unknown = found[0] if found else unknown
    asked = keep(docs.mapInArrow(_asked(s.order, s.buckets), STORED), "asked")
    asks = asked.where(F.col("kind") != STORE).drop("store")

    def longer(x: Stored, known: list[np.ndarray], held: dict) -> Iterator[pa.RecordBatch]:
        a, b = x.pairs[:2]
        p2, p3 = e.longer(x, known)
        yield from blob_batches(_answer(held, x.words, [a, b], p2, [x.tri[0], a[x.tri[1]], b[x.tri[1]]], p3, 0))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[tuple]:
            for bucket, held in by_bucket(batches):
                words, c = word_counts(held)
                yield from _single_answers(held, words, e.single(c), ASK, bucket)

        return blob_batches(tables())

    ones = s.rows.where(F.col("kind") == WORD).drop("store").unionByName(asks.where(F.col("kind") == WORD).withColumn("kind", F.lit(ASK)))
    answers = s.answered(longer, BLOBS, asks.where(F.col("kind") != WORD)).unionByName(met(ones, s.buckets).mapInArrow(single, BLOBS))
    return _summed_scores(docs, asked, answers, unknown, s.buckets)


# --- orders -----------------------------------------------------------------------------------------------------------

#: For each order, the places of an n-gram's words in its key, by n: words compare one after the other.
ORDERS = {
    "prefix": {1: (0,), 2: (0, 1), 3: (0, 1, 2)},
    "suffix": {1: (0,), 2: (1, 0), 3: (2, 1, 0)},
    "context": {1: (0,), 2: (0, 1), 3: (1, 0, 2)},
}
#: Tokens of each part of the input, and n-grams of each length there, that ranges are drawn from; that changes their sizes only.
DRAWN_TOKENS, DRAWN = 100_000, 1_000


def _distinct(t: Coded, n: int) -> list[np.ndarray]:
    """The different n-grams of a chunk, word by word."""
    v = len(t.words)
    at = np.flatnonzero(t.after >= n - 1)
    if n == 1:
        return [np.unique(t.ids)]
    if n == 2:
        keys = np.unique(t.ids[at] * v + t.ids[at + 1])
        return [keys // v, keys % v]
    keys, back = triples(t.ids[at], t.ids[at + 1], t.ids[at + 2], v)
    return list(back(np.unique(keys)))


def _drawn(rows: DataFrame, orders: dict[int, tuple[int, ...]], buckets: int) -> dict[int, list[tuple[bytes, ...]]]:
    """For each length the keys, in order, at which its ranges begin (the first range has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:  # all are read, a few are coded
            for i in range(0, batch.num_rows, 100):
                if size < DRAWN_TOKENS:
                    held.append(worded(batch.columns[-1].slice(i, 100)))
                    size += len(held[-1][0])
        if size:
            t = coded(pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            for n, order in orders.items():
                codes = _distinct(t, n)
                some = np.random.default_rng(7).choice(len(codes[0]), min(DRAWN, len(codes[0])), replace=False)
                words = [pc.cast(t.words.take(pa.array(codes[k][some])), pa.binary()) for k in order]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), *words, *[pa.nulls(len(some), pa.binary())] * (3 - n)], ["n", "a", "b", "c"])

    keys: dict[int, list[tuple[bytes, ...]]] = {n: [] for n in orders}
    for r in rows.mapInArrow(run, "n int, a binary, b binary, c binary").collect():  # DRAWN for each length and part of the input at most
        keys[r["n"]].append(tuple(bytes(x) for x in (r["a"], r["b"], r["c"])[: r["n"]]))
    out = {}
    for n, found in keys.items():
        found.sort()
        out[n] = sorted({found[len(found) * k // buckets] for k in range(1, buckets)}) if found else []
    return out


class _Ranges:
    """The range of each key: words are placed among the words of the ranges' first keys, so that numbers compare as keys do."""

    def __init__(self, starts: list[tuple[bytes, ...]], n: int):
        self.names = sorted({w for key in starts for w in key})
        self.size = 2 * len(self.names) + 2
        place = {w: 2 * k + 1 for k, w in enumerate(self.names)}
        self.starts = self._joined([np.array([place[key[k]] for key in starts], np.int64) for k in range(n)])

    def _joined(self, columns: list[np.ndarray]) -> np.ndarray:
        out = columns[0]
        for c in columns[1:]:
            out = out * self.size + c
        return out

    def places(self, words: list[bytes]) -> np.ndarray:
        names, words = np.array([*self.names, None], object)[:-1], np.array([*words, None], object)[:-1]
        left, right = np.searchsorted(names, words, "left"), np.searchsorted(names, words, "right")
        return np.where(right > left, 2 * left + 1, 2 * left)

    def of(self, places: list[np.ndarray]) -> np.ndarray:
        return np.searchsorted(self.starts, self._joined(places), "right")


def ranked(rows: DataFrame, order: str, keep: Callable[[DataFrame, str], DataFrame], most: int = MOST) -> DataFrame:
    """n, ngram, rank: the different n-grams of texts (or lists of words), each with its place (from 1) among those of its length.

    Ranges of keys are drawn from a few n-grams; each is sorted and stored by one task, and their sizes are summed up on the driver.
    """
    orders = {n: x for n, x in ORDERS[order].items() if n <= most}
    buckets = buckets_of(rows)
    starts = _drawn(rows, orders, buckets)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ranges = {n: _Ranges(starts[n], n) for n in orders}
        for found, sizes, *_ in chunks(batches):
            t = coded(found, sizes)
            names = pc.cast(t.words, pa.binary()).to_pylist()
            for n, by in orders.items():
                found = _distinct(t, n)
                codes = [found[k] for k in by]
                place = ranges[n].places(names)
                yield from dealt(n, 0, ranges[n].of([place[c] for c in codes]) + (n - 1) * buckets, t.words, codes, n)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[tuple]:
            for bucket, held in by_bucket(batches):
                for n, blobs in held.items():
                    words, columns = merged([unpacked(x) for _, x in blobs], n)
                    by = pc.sort_indices(words)
                    place = np.empty(len(words), np.int64)
                    place[by.to_numpy()] = np.arange(len(words))
                    v, columns = len(words), [place[c] for c in columns]
                    keys, back = (columns[0], lambda k: [k]) if n == 1 else (columns[0] * v + columns[1], lambda k, v=v: [k // v, k % v]) if n == 2 else triples(*columns, v)
                    columns = back(np.unique(keys))
                    yield n, bucket, 0, len(columns[0]), 0, packed(words.take(by), list(columns))

        return blob_batches(done())

    stored = keep(met(rows.mapInArrow(lambda batches: blob_batches(tables(batches)), BLOBS), most * buckets).mapInArrow(sort, BLOBS), "sorted")
    before, last = {}, {}
    for n, bucket, size in sorted((r["kind"], r["bucket"], r["rows"]) for r in stored.select("kind", "bucket", "rows").collect()):  # a row for each range
        before[bucket] = last.get(n, 0)
        last[n] = before[bucket] + size

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, columns = unpacked(blob.as_py())
                codes: list = [None] * n
                for k, c in zip(orders[n], columns, strict=True):
                    codes[k] = c.astype(np.int64)
                yield from text_batches(n, words, codes, [np.arange(len(columns[0]), dtype=np.int64) + before[bucket] + 1], ["n", "ngram", "rank"])

    return stored.select("kind", "bucket", "blob").mapInArrow(named, "n int, ngram string, rank long")


# --- numbers of words -------------------------------------------------------------------------------------------------


def first_places(docs: DataFrame) -> DataFrame:
    """word, place (key, line_no, pos) of the first occurrence of each word of docs(key, text), by whole-number keys."""
    key = docs.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, row, line = worded(batch.column(1))
            if not len(found):
                continue
            met = found.dictionary_encode()
            codes = met.indices.to_numpy(zero_copy_only=False)
            keys = batch.column(0).take(pa.array(row))
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at, line = np.repeat(np.arange(len(row)), sizes), np.repeat(line, sizes)
            # Nulls come first, as in a sort of Spark's.
            order = np.lexsort((pos, line, np.repeat(keys.fill_null(0).to_numpy(), sizes), np.repeat(keys.is_valid().to_numpy(zero_copy_only=False), sizes)))
            words, first = np.unique(codes[order], return_index=True)
            first = order[first]
            yield pa.RecordBatch.from_arrays([met.dictionary.take(pa.array(words)), keys.take(pa.array(at[first])), pa.array(line[first].astype(np.int32)), pa.array(pos[first].astype(np.int32))], ["word", key.name, "line_no", "pos"])

    schema = T.StructType().add("word", "string").add(key).add("line_no", "integer").add("pos", "integer")
    return docs.mapInArrow(run, schema).groupBy("word").agg(F.min(F.struct(key.name, "line_no", "pos")).alias("place"))


def numbered(rows: DataFrame, order: int, vocab: DataFrame, f: Callable[[int, pa.Array, list[np.ndarray], list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], schema: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What f makes of the n-grams of each bucket: of n, words, numbers in that list, ids of vocab(word, word_id; 0 for words that it lacks), and counts."""
    buckets = buckets_of(rows)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, held in by_bucket(batches):
            ones, c1 = word_counts(held)
            x = first_bucket(held, order) if order > 1 else Bucket(pa.array([], pa.string()), [np.zeros(0, np.int64)] * 5, [np.zeros(0, np.int64)] * 5)
            words, (one, both) = _codes([(ones, []), (x.words, [])])
            if len(words):
                yield STORE, bucket, 0, len(words), 0, packed(words, [one, c1, *(both[c] for c in x.pairs[:2]), x.pairs[2], *(both[c] for c in x.tri[:3]), x.tri[3]])
                yield from dealt(ASK, bucket, word_bucket(hashes(words), buckets), words, [np.arange(len(words)), np.arange(len(words))], 1)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            words = pc.cast(batch.column(0), pa.string())
            yield from dealt(WORD, 0, word_bucket(hashes(words), buckets), words, [np.arange(len(words)), batch.column(1).to_numpy().astype(np.int64)], 1)

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, held in by_bucket(batches):
            words, [at, numbers] = merged([unpacked(x) for _, x in held[WORD]], 1) if WORD in held else (pa.array([], pa.string()), [np.zeros(0, np.int64)] * 2)
            asks = [(source, unpacked(x)) for source, x in held.get(ASK, [])]
            known, codes = _codes([(words, []), *(x for _, x in asks)])
            found = np.zeros(len(known), np.int64)
            found[at] = numbers
            for (source, (_, c)), code in zip(asks, codes[1:], strict=True):
                yield REPLY, source, bucket, len(code), 0, packed(pa.array([], pa.string()), [c[1], found[code[c[0]]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            words, columns = unpacked(held[STORE][0][1])
            one, c1, a2, b2, c2, a3, b3, d3, c3 = (c.astype(np.int64) for c in columns)
            number = np.zeros(len(words), np.int64)
            for _, blob in held[REPLY]:
                at, found = unpacked(blob)[1]
                number[at] = found
            for n, codes, c in ((1, [one], c1), (2, [a2, b2], c2), (3, [a3, b3, d3], c3)):
                if len(c):
                    yield from f(n, words, codes, [number[k] for k in codes], c)

    first = met(rows.mapInArrow(first_tables(order, buckets), BLOBS), buckets)
    stored = keep(first.mapInArrow(lambda batches: blob_batches(tables(batches)), BLOBS), "coded")
    known = vocab.select("word", "word_id").mapInArrow(lambda batches: blob_batches(ids(batches)), BLOBS)
    answers = met(known.unionByName(stored.where(F.col("kind") == ASK)), buckets).mapInArrow(lambda batches: blob_batches(replies(batches)), BLOBS)
    return met(stored.where(F.col("kind") == STORE).unionByName(answers), buckets).mapInArrow(run, schema)
