"""SQL (of DuckDB) for the catalogue's queries, put together from common table expressions."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def sents(table: str = "documents", by: str = "doc_id", name: str = "s", keep: str = "") -> str:
    """name(by, line_no, words) of a table's text lines that hold words."""
    ids = "".join(f"{c}, " for c in by.split())
    return f"""{name}_l AS (SELECT {ids}unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS line_no FROM (SELECT {ids}string_split(text, chr(10)) AS l FROM {table} {keep})),
{name} AS (SELECT {ids}line_no, {_WORDS.format('line')} AS words FROM {name}_l WHERE len({_WORDS.format('line')}) > 0)"""


def counts(order: int, least: int = 1, source: str = "s", name: str = "c") -> str:
    """name(n, ngram, c)."""
    return f"""{name}_m AS (SELECT list_concat(['<s>'], words, ['</s>']) AS m FROM {source}),
{name} AS MATERIALIZED (SELECT n, ngram, count(*) AS c FROM (SELECT CAST(k.n AS INTEGER) AS n, array_to_string(m[u.i:u.i + k.n - 1], ' ') AS ngram FROM {name}_m, (SELECT unnest(range({least}, {order + 1})) AS n) k, LATERAL (SELECT unnest(range(1, len(m) - k.n + 2)) AS i) u) GROUP BY n, ngram)"""


def prefix(x: str = "ngram") -> str:
    return f"CASE WHEN contains({x}, ' ') THEN regexp_extract({x}, '^(.*) [^ ]+$', 1) ELSE '' END"


def suffix(x: str = "ngram") -> str:
    return f"CASE WHEN contains({x}, ' ') THEN substr({x}, strpos({x}, ' ') + 1) ELSE '' END"


def effective(order: int, source: str = "c", name: str = "e", raw: str = "") -> str:
    keep = raw or f"c.n = {order} OR c.n = 1"
    return f"""{name}_cc AS (SELECT n - 1 AS n, {suffix()} AS ngram, count(*) AS cc FROM {source} WHERE n > 1 GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT c.n, c.ngram, c.c, CASE WHEN {keep} THEN c.c ELSE coalesce(x.cc, 0) END AS e FROM {source} c LEFT JOIN {name}_cc x ON x.n = c.n AND x.ngram = c.ngram)"""


def contexts(source: str = "e", name: str = "x") -> str:
    return f"{name} AS MATERIALIZED (SELECT n, {prefix()} AS context, CAST(sum(e) AS BIGINT) AS total, count(*) FILTER (e > 0) AS followers FROM {source} WHERE n > 1 GROUP BY 1, 2)"


def unigrams(source: str = "c", name: str = "p1") -> str:
    return f"""{name}_t AS (SELECT greatest(sum(c), 1)::DOUBLE AS t, count(*)::DOUBLE AS u FROM {source} WHERE n = 1),
{name} AS (SELECT n, ngram, CAST(log10(greatest(greatest(c - 0.75e0, 0e0) / t + 0.75e0 * u / t / greatest(u + 1, 3), 1e-300)) AS FLOAT) AS prob FROM {source}, {name}_t WHERE n = 1)"""


def model(order: int) -> str:
    """p(n, ngram, prob): the built model, from c(n, ngram, c)."""
    parts = [effective(order), contexts(), unigrams()]
    for n in range(2, order + 1):
        parts.append(f"""p{n} AS MATERIALIZED (SELECT e.n, e.ngram, CAST(log10(greatest(CASE WHEN x.total = 0 THEN 1e-300 ELSE greatest(e.e - 0.75e0, 0e0) / x.total + 0.75e0 * x.followers / x.total * pow(10e0, CAST(l.prob AS DOUBLE)) END, 1e-300)) AS FLOAT) AS prob
FROM e JOIN x ON x.n = {n} AND x.context = {prefix('e.ngram')} JOIN p{n - 1} l ON l.ngram = {suffix('e.ngram')} WHERE e.n = {n})""")
    parts.append("p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(1, order + 1)) + ")")
    return ",\n".join(parts)


def scores(order: int, by: str, source: str, bos: bool = True, name: str = "t") -> str:
    """name(by, line_no, pos, word, prob, ngram_length, oov) of a model without backoffs."""
    ids = "".join(f"{c}, " for c in by.split())
    front, base = ("['<s>'], ", 1) if bos else ("", 0)
    return f"""{name}_m AS (SELECT {ids}line_no, list_concat({front}words, ['</s>']) AS m FROM {source}),
{name}_c AS (SELECT {ids}line_no, u.i, m[u.i] AS word, k.n, array_to_string(m[u.i - k.n + 1:u.i], ' ') AS ngram FROM {name}_m, LATERAL (SELECT unnest(range({base + 1}, len(m) + 1)) AS i) u, (SELECT unnest(range(1, {order + 1})) AS n) k WHERE k.n <= u.i),
{name} AS (SELECT {ids}line_no, CAST(i {'- 1' if bos else ''} AS INTEGER) AS pos, any_value(word) AS word, coalesce(arg_max(p.prob, y.n) FILTER (p.prob IS NOT NULL), CAST(0 AS FLOAT)) AS prob,
  CAST(coalesce(max(y.n) FILTER (p.prob IS NOT NULL), 1) AS INTEGER) AS ngram_length, (count(p.prob) FILTER (y.n = 1) = 0 OR any_value(word) = '<unk>') AS oov FROM {name}_c y LEFT JOIN p ON p.ngram = y.ngram GROUP BY {ids}line_no, i)"""


def vocab(source: str = "s", by: str = "doc_id") -> str:
    """v(word, word_id)."""
    return f"""v_t AS (SELECT {by}, line_no, unnest(words) AS word, unnest(range(len(words))) AS pos FROM {source}),
v_f AS (SELECT word, min(struct_pack(a := {by}, b := line_no, c := pos)) AS place FROM v_t WHERE word NOT IN ('<unk>', '<s>', '</s>') GROUP BY word),
v AS (SELECT word, CAST(2 + row_number() OVER (ORDER BY place) AS INTEGER) AS word_id FROM v_f UNION ALL SELECT '<unk>', 0 UNION ALL SELECT '<s>', 1 UNION ALL SELECT '</s>', 2)"""


_M = "(18446744073709551616::UHUGEINT)"
SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN CAST({0} AS HUGEINT) - 18446744073709551616 ELSE CAST({0} AS HUGEINT) END AS BIGINT)"


def mulmod(a: str, b: str) -> str:
    """a * b modulo 2 ** 64 of whole numbers below 2 ** 64, in two halves."""
    return f"((({a}) * ({b} // 4294967296::UHUGEINT) % {_M} * 4294967296::UHUGEINT + ({a}) * ({b} % 4294967296::UHUGEINT)) % {_M})"


def fnv(ids: str) -> str:
    """FNV-1a of a list of ids, as a long."""
    octets = f"flatten(list_transform({ids}, lambda w: [CAST(w AS UHUGEINT) % 256, CAST(w AS UHUGEINT) // 256 % 256, CAST(w AS UHUGEINT) // 65536 % 256, CAST(w AS UHUGEINT) // 16777216 % 256]))"
    h = f"list_reduce({octets}, lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT) % {_M}, 14695981039346656037::UHUGEINT)"
    return h


def chain(ids: str) -> str:
    """The chained hash of a list of ids of one or more, from 0."""
    step = f"CAST(xor(CAST({mulmod('CAST(h AS UHUGEINT)', '8978948897894561157::UHUGEINT')} AS UBIGINT), CAST({mulmod('(CAST(b AS UHUGEINT) + 1)', '17894857484156487943::UHUGEINT')} AS UBIGINT)) AS UHUGEINT)"
    return f"list_reduce(list_transform({ids}[2:], lambda w: CAST(w AS UHUGEINT)), lambda h, b: {step}, CAST({ids}[1] AS UHUGEINT))"


def murmur(word: str, source: str, name: str = "mu") -> str:
    """name(word, h): MurmurHash64A (seed 0) of the UTF-8 bytes of source's words, as a long."""
    by_m = lambda x: f"CAST((CAST({x} AS UHUGEINT) * 14313749767032793493::UHUGEINT) % {_M} AS UBIGINT)"
    folded = lambda x: f"xor({x}, {x} // 140737488355328::UBIGINT)"
    value = lambda i, n: f"CAST(list_reduce(list_transform(range(0, {n}), lambda j: CAST('0x' || substr(x, 1 + 2 * (8 * ({i}) + j), 2) AS UHUGEINT) * CAST(pow(256, j) AS UHUGEINT)), lambda a, b: a + b, 0::UHUGEINT) AS UBIGINT)"
    return f"""{name}_b AS (SELECT {word} AS word, hex(encode({word})) AS x, octet_length(encode({word})) AS n FROM {source}),
{name}_k AS (SELECT word, n, list_transform(range(0, n // 8), lambda i: {value('i', '8')}) AS blocks, CASE WHEN n % 8 > 0 THEN {value('n // 8', 'n % 8')} END AS tail FROM {name}_b),
{name}_h AS (SELECT word, tail, list_reduce(blocks, lambda h, k: {by_m('xor(h, ' + by_m(folded(by_m('k'))) + ')')}, {by_m('n')}) AS h FROM {name}_k),
{name}_t AS (SELECT word, CASE WHEN tail IS NOT NULL THEN {by_m('xor(h, tail)')} ELSE h END AS h FROM {name}_h),
{name}_f AS (SELECT word, {by_m(folded('h'))} AS h FROM {name}_t),
{name} AS (SELECT word, {SIGNED.format('g')} AS h FROM (SELECT word, {folded('h')} AS g FROM {name}_f))"""
