"""Near-duplicates by ProbMinHash: weighted shingles, banded signatures, verified links, connected classes.

A document's shingles are its runs of five words (lower case); a shingle that stands there f times weighs 1 + ln f. Each
shingle is a Poisson process with its weight as rate, whose arrivals fall on random registers; a register keeps the
shingle that arrives first, and a process ends when its next arrival is later than every register's. Two documents agree
in a register with a chance that is their probability Jaccard. A text that repeats shingles has registers of its set as
well (all weights 1), which agree by the plain Jaccard; without repeats they're the same. Both are banded alike; documents
that share a band are candidates and are verified exactly: they're linked if the probability Jaccard of their weights or
the Jaccard of their shingle sets is at least the threshold.

Documents of equal words are one text from the start, so copies meet no band. Verification makes no row for a pair:

1. Stars. In each bucket all texts are compared with the bucket's first one. A text goes to the tasks of its buckets' first
   texts (stars of over STAR texts to several), and only links come out; connected ones are classes.
2. Blocks. What is left are buckets that still hold several classes. Their texts are gathered to units that share buckets
   (beyond UNIT texts, a unit is one bucket), a unit is cut into blocks of bounded size, and a task compares two blocks by
   counting shared shingles in matrix products. Texts of one unit's largest class aren't compared with each other. Of the
   links only those come out that join two classes.

So no link among candidates is lost. 46 bands of 7 registers miss a pair at the threshold of 0.8, in either Jaccard, with
a chance of 2e-5.

Defined cases: a null text is an empty one; texts without words are one class; a text of under five words has one
shingle, all of it; a class's id is its smallest doc_id (null ids don't count, unless there are no others) and that row
stays; of rows that repeat this id with equal words one stays; an empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, chunks, maybe_broadcast, release, released, scratch, slices, text_or_empty
from gramloom.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 46, 7
#: Characters that are cut into shingles at once (about 60 bytes each).
CHARS = 400_000
#: Texts of a star that go to one task, texts of a unit, and the texts and bytes of a block.
STAR, UNIT, BLOCK_TEXTS, BLOCK_BYTES = 500, 20_000, 1024, 4_000_000
#: Bits of the map of buckets (4 MB), texts up to which a shingle's pairs are counted, shingles in one product.
MAP_BITS, FEW, WIDE = 25, 8, 2048
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(1, n), _P, np.uint64))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each text's distinct shingles, by text and hash. Words of the texts are parted by blanks."""
    none = np.zeros(0, np.int64)
    raw = np.frombuffer(b" ".join(t.encode("utf-8", "replace") for t in texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t.encode("utf-8", "replace")) + 1 for t in texts), np.int64, len(texts))
    inside = raw != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return none, np.zeros(0, np.uint64), none
    place = np.cumsum(inside) - 1
    letters = raw[inside].astype(np.uint64) + np.uint64(1)
    long = ends - starts
    first = place[starts]
    at = np.arange(len(letters)) - np.repeat(first, long)
    word = _mix(np.add.reduceat(letters * _powers(int(long.max()))[at], first))
    text_of = np.searchsorted(np.cumsum(sizes), starts, "right")
    counts = np.bincount(text_of, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    mixed = np.zeros(len(word), np.uint64)
    left = counts[text_of] - (np.arange(len(word)) - begin[text_of])  # words from here to the text's end
    for k in range(words):  # a shingle that runs beyond the end stands only for a whole short text
        near = np.zeros(len(word), np.uint64)
        near[: max(0, len(word) - k)] = word[k:]
        near[left <= k] = np.uint64(k)
        mixed = _mix(mixed * _P + near)
    real = (left >= words) | ((counts[text_of] < words) & (left == counts[text_of]))
    text_of, mixed = text_of[real], mixed[real]
    by = np.lexsort((mixed, text_of))
    text_of, mixed = text_of[by], mixed[by]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(mixed) != 0) | (np.diff(text_of) != 0)]))
    return text_of[new], mixed[new], np.diff(np.append(new, len(mixed)))


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def prob_minhash(text_of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """The shingle in each register of each text, 0 where a text has no shingles. text_of is sorted.

    Texts of like size go together, and draw several arrivals of a shingle at once where they have few.
    """
    out = np.zeros((n_texts, registers), np.uint64)
    counts = np.bincount(text_of, minlength=n_texts)
    begin = np.cumsum(counts) - counts
    needed = registers * (np.log(registers) + 1)
    by = np.argsort(counts, kind="stable")
    by = by[counts[by] > 0]
    draws = np.maximum(1, np.ceil(needed / 2 / counts[by])).astype(np.int64)
    work = np.cumsum(np.maximum(draws * counts[by], registers))
    for part in np.split(by, np.searchsorted(work, np.arange(300_000, work[-1] if len(work) else 0, 300_000), "right")):
        if not len(part):
            continue
        n = counts[part]
        ahead = int(max(1, np.ceil(needed / 2 / n.mean())))
        own = np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, h, w = np.repeat(np.arange(len(part)), n), hashes[own], weights[own]
        when = np.zeros(len(own))
        soonest = np.full(len(part) * registers, np.inf)
        kept = np.zeros(len(part) * registers, np.uint64)
        step = 0
        while len(h):
            draw = _mix(h[:, None] + _P * np.arange(step + 1, step + ahead + 1, dtype=np.uint64))
            gap = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / w[:, None]
            times = when[:, None] + np.cumsum(gap, 1)
            cell = (row[:, None] * registers + (_mix(draw ^ _P) % np.uint64(registers)).astype(np.int64)).ravel()
            flat = times.ravel()
            sooner = np.flatnonzero(flat < soonest[cell])
            sooner = sooner[np.argsort(-flat[sooner], kind="stable")]  # of several for a cell the soonest is written last
            soonest[cell[sooner]] = flat[sooner]
            kept[cell[sooner]] = h[sooner // ahead]
            when = times[:, -1]
            latest = soonest.reshape(-1, registers).max(1)
            more = when < latest[row]
            row, h, w, when = row[more], h[more], w[more], when[more]
            step += ahead
        out[part] = kept.reshape(-1, registers)
    return out


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(registers), bands), np.uint64)
    keys += np.arange(1, bands + 1, dtype=np.uint64) * _P
    for k in range(rows):
        keys = _mix(keys * _P + registers[:, k::rows])
    return keys.view(np.int64)


def similarity(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> float:
    """The larger of two texts' probability Jaccard (of weights) and set Jaccard. a, b: sorted shingles; n_a, n_b: counts.

    J_P = sum over shared i of 1 / sum over j of max(p_j / p_i, q_j / q_i); in the order of q_i / p_i, each inner sum is a
    suffix sum of p over p_i and a prefix sum of q over q_i.
    """
    if not len(a) and not len(b):
        return 1.0
    shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    plain = len(shared) / (len(a) + len(b) - len(shared))
    p, q = weights_of(n_a), weights_of(n_b)
    x, y = p[i], q[j]
    by = np.argsort(y / x, kind="stable")
    x, y = x[by], y[by]
    # max(p_j / p_i, q_j / q_i) is q's where q_j / p_j > q_i / p_i
    p_part = np.cumsum(x) + (p.sum() - x.sum())
    q_part = y.sum() - np.cumsum(y) + (q.sum() - y.sum())
    return float(max(plain, (1 / (p_part / x + q_part / y)).sum()))


def highest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A bound of J_P, given the shares p and q of two texts' weights that lie on shared shingles.

    Shingle i adds at most 1 / (1 / p_i + (1 - q) / q_i); that is concave and homogeneous in (p_i, q_i), so the sum is at most
    the same expression of the sums; it holds with p and q exchanged, too. For sets of one size it's their Jaccard.
    """
    both = p * q
    return np.where(both > 0, both / np.maximum(np.maximum(q + (1 - q) * p, p + (1 - p) * q), 1e-30), 0)


@dataclasses.dataclass
class Texts:
    """The shingles of some texts, each text's sorted and side by side, and what verification needs of them."""

    at: np.ndarray  # where each text's shingles start, and the end
    hashes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Texts:
        sizes, hashes, counts = [], [], []
        for a, b in chunks(texts, CHARS):
            text_of, h, c = shingles(texts[a:b])
            sizes.append(np.bincount(text_of, minlength=b - a))
            hashes.append(h)
            counts.append(c)
        return Texts(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64), np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *counts]))

    def __post_init__(self):
        self.sizes = np.diff(self.at)
        self.text_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        weights = weights_of(self.counts)
        self.shares = weights / np.bincount(self.text_of, weights, len(self.sizes))[self.text_of]
        self.repeats = np.bincount(self.text_of, self.counts > 1, len(self.sizes)) > 0

    def some(self, a: int, b: int) -> Texts:
        """Those from a to b."""
        inside = slice(self.at[a], self.at[b])
        return Texts(self.at[a : b + 1] - self.at[a], self.hashes[inside], self.counts[inside])

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes[self.at[k] : self.at[k + 1]], self.counts[self.at[k] : self.at[k + 1]]

    def like(self, other: Texts, k: int, threshold: float) -> np.ndarray:
        """Which of these texts are linked to the k-th of other."""
        lead, counts = other.part(k)
        place = np.minimum(np.searchsorted(lead, self.hashes), max(0, len(lead) - 1))
        shared = lead[place] == self.hashes if len(lead) else np.zeros(len(self.hashes), bool)
        n = len(self.sizes)
        inter = np.bincount(self.text_of[shared], minlength=n)
        out = inter / np.maximum(self.sizes + len(lead) - inter, 1) >= threshold
        maybe = ~out & (self.repeats | other.repeats[k])
        if maybe.any():
            own = np.bincount(self.text_of[shared], self.shares[shared], n)
            theirs = np.bincount(self.text_of[shared], other.shares[other.at[k] : other.at[k + 1]][place[shared]], n)
            for t in np.flatnonzero(maybe & (highest(own, theirs) >= threshold - 1e-6)):
                out[t] = similarity(*self.part(t), lead, counts) >= threshold
        return out

    def joins(self, rows: np.ndarray, cols: np.ndarray, label: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Linked pairs of a text of rows and one of cols, as many as join the classes that links between them join."""
        n_r, n_c, n = len(rows), len(cols), len(self.sizes)
        row_at, col_at = np.full(n, -1), np.full(n, -1)
        row_at[rows], col_at[cols] = np.arange(n_r), np.arange(n_c)
        weighted = bool(self.repeats[rows].any() or self.repeats[cols].any())
        by = np.argsort(self.hashes, kind="stable")
        new = np.concatenate([[True], np.diff(self.hashes[by]) != 0])[: len(by)]
        word = np.cumsum(new) - 1
        often = np.bincount(word)[word] if len(by) else word
        inter = np.zeros((n_r, n_c), np.float32)
        p, q = (np.zeros((n_r, n_c), np.float32), np.zeros((n_r, n_c), np.float32)) if weighted else (inter, inter)
        # Shingles of a few texts: their pairs are counted.
        few = (often > 1) & (often <= FEW)
        entry, words = by[few], word[few]
        for step in range(1, FEW):
            same = np.flatnonzero(words[step:] == words[:-step])
            for x, y in ((entry[same], entry[same + step]), (entry[same + step], entry[same])):
                r, c = row_at[self.text_of[x]], col_at[self.text_of[y]]
                ok = (r >= 0) & (c >= 0)
                cell = r[ok] * n_c + c[ok]
                inter += np.bincount(cell, minlength=n_r * n_c).reshape(n_r, n_c)
                if weighted:
                    p += np.bincount(cell, self.shares[x[ok]], n_r * n_c).reshape(n_r, n_c)
                    q += np.bincount(cell, self.shares[y[ok]], n_r * n_c).reshape(n_r, n_c)
        # Shingles of many: products of matrices, WIDE shingles at a time.
        many = often > FEW
        entry, words = by[many], np.cumsum(new & many)[many] - 1
        for a in range(0, int(words[-1]) + 1 if len(words) else 0, WIDE):
            some = slice(*np.searchsorted(words, [a, a + WIDE]))
            text, w = self.text_of[entry[some]], words[some] - a
            left, right = np.zeros((n_r, WIDE), np.float32), np.zeros((n_c, WIDE), np.float32)
            r, c = row_at[text], col_at[text]
            left[r[r >= 0], w[r >= 0]] = 1
            right[c[c >= 0], w[c >= 0]] = 1
            inter += left @ right.T
            if weighted:
                heavy = np.zeros_like(left)
                heavy[r[r >= 0], w[r >= 0]] = self.shares[entry[some]][r >= 0]
                p += heavy @ right.T
                heavy = np.zeros_like(right)
                heavy[c[c >= 0], w[c >= 0]] = self.shares[entry[some]][c >= 0]
                q += left @ heavy.T
        unlike = label[rows][:, None] != label[cols]
        shared = inter.astype(np.float64)
        linked = unlike & (shared / np.maximum(self.sizes[rows][:, None] + self.sizes[cols] - shared, 1) >= threshold)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        out: list[tuple[int, int]] = []
        r, c = np.nonzero(linked)
        _, first = np.unique(np.stack([label[rows[r]], label[cols[c]]]), axis=1, return_index=True)
        for i, j in zip(rows[r[first]].tolist(), cols[c[first]].tolist(), strict=True):
            if (x := find(int(label[i]))) != (y := find(int(label[j]))):
                root[x] = y
                out.append((i, j))
        if weighted:
            maybe = unlike & ~linked & (self.repeats[rows][:, None] | self.repeats[cols]) & (highest(p, q) >= threshold - 1e-3)
            for i, j in zip(*(side.tolist() for side in (lambda r, c: (rows[r], cols[c]))(*np.nonzero(maybe))), strict=True):
                if (x := find(int(label[i]))) != (y := find(int(label[j]))) and similarity(*self.part(i), *self.part(j)) >= threshold:
                    root[x] = y
                    out.append((i, j))
        return out


def _words() -> Column:
    return F.lower(F.trim(F.regexp_replace(text_or_empty(), "[\\x20\\x09-\\x0D]+", " ")))


def _key() -> Column:
    return F.unhex(F.md5(_words()))


def _normal(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words().alias("norm")).withColumn("key", F.unhex(F.md5("norm")))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """uid, doc_id, key (of the words), size (their bytes), bands (of the weights and of the set, each once): none without words."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "norm", CHARS, 500):
                text_of, hashes, counts = shingles(part.column("norm").to_pylist())
                keys = band_keys(prob_minhash(text_of, hashes, weights_of(counts), part.num_rows, bands * rows), bands, rows)
                some = np.bincount(text_of, minlength=part.num_rows) > 0
                repeats = np.bincount(text_of[counts > 1], minlength=part.num_rows) > 0
                own = repeats[text_of]
                of_set = band_keys(prob_minhash(text_of[own], hashes[own], np.ones(own.sum()), part.num_rows, bands * rows), bands, rows)
                there = np.concatenate([np.repeat(some[:, None], bands, 1), repeats[:, None] & (of_set != keys)], 1)
                ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([keys, of_set], 1)[there]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "doc_id", "key", "size")), lists], schema=schema)

    rows_in = _normal(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "key", F.octet_length("norm").cast("long").alias("size"), "norm")
    return rows_in.mapInArrow(released(sign), "uid long, doc_id long, key binary, size long, bands array<long>")


def _held_buckets(signed: DataFrame, buckets: DataFrame) -> DataFrame:
    """bucket, lead, node of the buckets(bucket, lead). A bitmap of bounded size drops most band rows before the join."""
    slots = buckets.select(F.shiftrightunsigned("bucket", 64 - MAP_BITS).alias("slot"))
    marks = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    words[marks["word"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    sent = signed.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = flat.view(np.uint64) >> np.uint64(64 - MAP_BITS)
            there = (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            node = np.repeat(batch.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(flat[there]), pa.array(node[there])], schema=schema)

    rows = signed.select("node", "bands").mapInArrow(released(run), "bucket long, node long")
    return rows.join(maybe_broadcast(buckets), "bucket").select("bucket", "lead", "node").distinct()


def _star_links(stars: DataFrame, threshold: float) -> DataFrame:
    """a, b: the links in stars(lead, salt, member, node, norm), where a lead (member 0) comes with each salted part of its star."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            for part in slices(batch, "norm", CHARS):
                leads, salts, members, nodes = (part.column(c).to_numpy() for c in ("lead", "salt", "member", "node"))
                texts = Texts.of(part.column("norm").to_pylist())
                cuts = np.flatnonzero((np.diff(leads) != 0) | (np.diff(salts) != 0)) + 1
                for x, y in zip([0, *cuts], [*cuts, part.num_rows], strict=True):
                    if members[x] == 0:  # else this goes on with the star of the part before
                        lead = texts.some(x, x + 1)
                        x += 1
                    if x < y:
                        hits = np.flatnonzero(texts.some(x, y).like(lead, 0, threshold)) + x
                        yield pa.RecordBatch.from_arrays([pa.array(leads[hits]), pa.array(nodes[hits])], schema=schema)

    dealt = stars.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")
    return dealt.select("lead", "salt", "member", "node", "norm").mapInArrow(released(run), "a long, b long")


def _block_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that join classes, in groups (unit, kind, i, j) of texts (side, node, label, norm).

    Texts of side 0 are compared with all (kind 0) or with those of side 1. A group is bounded by its blocks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ("unit", "kind", "i", "j")

    def links(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(group)
        side, node, label = (rows[c].to_numpy() for c in ("side", "node", "label"))
        first = np.flatnonzero(side == 0)
        other = np.arange(len(side)) if rows["kind"][0].as_py() == 0 else np.flatnonzero(side == 1)
        found = Texts.of(rows["norm"].to_pylist()).joins(first, other, label, threshold) if len(first) and len(other) else []
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]]), pa.array(node[ends[:, 1]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            for x, y in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and key != tuple(c[x] for c in columns):
                    yield links(held)
                    held = []
                key = tuple(c[x] for c in columns)
                held.append(batch.slice(x, y - x))
        if held:
            yield links(held)

    sorted_ = dealt.repartition(*names).sortWithinPartitions(*names)
    return sorted_.select(*names, "side", "node", "label", "norm").mapInArrow(released(run), "a long, b long")


def _blocks(here: DataFrame, sizes: DataFrame, unit_texts: int, block_texts: int, block_bytes: int) -> DataFrame:
    """unit, kind, i, j, side, node, label: the groups in which the texts of mixed buckets here(bucket, lead, node, label) are compared."""
    near = components(here.select(F.col("lead").alias("a"), F.col("node").alias("b")))
    near = near.withColumnRenamed("label", "unit")
    large = near.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit_texts).select("unit", F.lit(True).alias("large"))
    rows = here.join(maybe_broadcast(near), "node").join(maybe_broadcast(large), "unit", "left")
    rows = rows.select(F.when(F.col("large"), F.col("bucket")).otherwise(F.col("unit")).alias("unit"), "node", "label").distinct()
    rows = scratch(rows.join(maybe_broadcast(sizes), "node"), "near-units")
    main = rows.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rows = rows.join(maybe_broadcast(main), "unit").withColumn("side", (F.col("label") == F.col("main")).cast("int"))
    of = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0))
    rows = rows.withColumn("one", F.lit(1))
    need = lambda s: F.ceil(F.greatest(of("one", s) / block_texts, of("size", s) / block_bytes)).cast("int")
    whole = (F.count(F.lit(1)) <= block_texts) & (F.sum("size") <= block_bytes)
    rows = rows.join(maybe_broadcast(scratch(rows.groupBy("unit").agg(whole.alias("whole"), need(0).alias("n0"), need(1).alias("n1")), "near-blocks")), "unit")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.lit(1))).cast("int"))
    group = lambda kind, i, j, side: F.struct(*[x.cast("int").alias(n) for x, n in ((kind, "kind"), (i, "i"), (j, "j"), (side, "side"))])
    none, one = F.lit(0), F.lit(1)
    b = F.col("block")
    each = lambda n, f: F.transform(F.when(n > 0, F.sequence(none, n - 1)).otherwise(F.array().cast("array<int>")), f)
    others = F.concat(
        each(F.col("n0"), lambda k: group((k != b).cast("int"), F.least(k, b), F.greatest(k, b), (k < b).cast("int"))),
        each(F.col("n1"), lambda k: group(F.lit(2), b, k, none)),
    )
    mains = each(F.col("n0"), lambda k: group(F.lit(2), k, b, one))
    groups = F.when(F.col("whole"), F.array(group(none, none, none, F.col("side")))).when(F.col("side") == 0, others).otherwise(mains)
    return rows.select("unit", F.explode(groups).alias("g"), "node", "label").select("unit", "g.*", "node", "label")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept, n_links (of the row's text, among those that make the classes)."""
    return _classes(docs, threshold, bands, rows).drop("key")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class, all columns kept."""
    found = scratch(_classes(docs, **how).select("doc_id", "key", "kept"), "near-found")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
    ids = scratch(ids.where("stay < n or doc_id is null").select(F.col("doc_id").alias("__id"), (F.col("stay") == 0).alias("gone")), "near-ids")
    same = lambda d: docs["doc_id"].cast("long").eqNullSafe(d["__id"])
    all_ids = maybe_broadcast(ids)
    left = docs.join(all_ids, same(all_ids), "left_anti")
    mixed = ids.where("__id is null or not gone").select("__id")
    if mixed.isEmpty():
        return left
    # Ids that stand on rows of which some stay, or on none: these rows are told apart by their words.
    wanted = found.where("kept").join(maybe_broadcast(mixed), found["doc_id"].eqNullSafe(F.col("__id")), "left_semi").select(F.col("doc_id").alias("__w_id"), F.col("key").alias("__w_key"))
    small = maybe_broadcast(mixed)
    some = docs.join(small, same(small), "left_semi").withColumn("__key", _key()).withColumn("__long", F.col("doc_id").cast("long"))
    some = some.join(maybe_broadcast(wanted), some["__key"].eqNullSafe(F.col("__w_key")) & some["__long"].eqNullSafe(F.col("__w_id")), "left_semi")
    return left.unionByName(some.dropDuplicates(["__long", "__key"]).select(*[F.col(f"`{c}`") for c in docs.columns]))


def _classes(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS, star: int = STAR, unit_texts: int = UNIT, block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    bounded_batches(docs.sparkSession)
    signed = scratch(signatures(docs, bands, rows), "near-signed")
    # A text's node is a hash of its key; where two keys share one, all but one get another.
    texts = signed.groupBy("key", F.xxhash64("key").alias("node")).agg(F.coalesce(F.min_by("uid", "doc_id"), F.min("uid")).alias("rep"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    texts = scratch(texts, "near-texts")
    shared = scratch(texts.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("first")).where("k > 1").select("node", "first"), "near-shared")
    signed = signed.withColumn("node", F.xxhash64("key"))
    if not shared.isEmpty():
        other = F.when(F.col("key") != F.col("first"), F.xxhash64("key", F.lit(1))).otherwise(F.col("node"))
        texts, signed = (x.join(F.broadcast(shared), "node", "left").withColumn("node", other).drop("first") for x in (texts, signed))
    banded = signed.select("node", F.explode("bands").alias("bucket"))
    buckets = scratch(banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("bucket", "lead"), "near-buckets")
    members = scratch(_held_buckets(signed, buckets), "near-members")
    # The texts that met others, once each.
    met = texts.join(maybe_broadcast(members.select("node").distinct()), "node", "left_semi")
    met = maybe_broadcast(met.select("node", F.col("rep_id").alias("met_id"), F.col("key").alias("met_key")))
    found = _normal(docs)
    found = found.join(met, (found["key"] == met["met_key"]) & found["doc_id"].eqNullSafe(met["met_id"])).groupBy("node").agg(F.first("norm").alias("norm"))
    found = scratch(found, "near-found-texts")
    pairs = members.where("node <> lead").select("lead", "node").distinct()
    parts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / star).cast("int").alias("parts"))
    pairs, parts = scratch(pairs, "near-pairs"), scratch(parts, "near-stars")
    stars = pairs.join(maybe_broadcast(parts), "lead").select("lead", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("salt"), F.lit(1).alias("member"), "node")
    stars = stars.unionByName(parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("lead").alias("node")))
    links = scratch(_star_links(stars.join(found, "node"), threshold), "near-links")
    release(buckets, pairs, parts)
    label = components(links)
    # What is left: buckets whose texts aren't all of one class.
    placed = members.join(maybe_broadcast(label), "node", "left").select("bucket", "lead", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    here = scratch(placed.join(maybe_broadcast(scratch(mixed, "near-mixed")), "bucket"), "near-here")
    if not here.isEmpty():
        dealt = _blocks(here, texts.select("node", "size"), unit_texts, block_texts, block_bytes)
        links = scratch(links.unionByName(_block_links(dealt.join(found, "node"), threshold)), "near-links")
        label = components(links)
    release(members, here, found)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    # Only texts that have copies or links need a row here.
    some = texts.join(maybe_broadcast(label), "node", "left").join(maybe_broadcast(ends), "node", "left").where("n > 1 or label is not null")
    some = scratch(some.select("key", "rep", "rep_id", "n", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-some")
    groups = some.groupBy("label").agg(F.coalesce(F.min_by("rep", "rep_id"), F.min("rep")).alias("keep"), F.min("rep_id").alias("class_id"), F.sum("n").alias("class_size"))
    groups = scratch(groups, "near-groups")
    some = scratch(some.join(groups, "label").select("key", "keep", "class_id", "class_size", "n_links"), "near-classes")
    out = signed.select("uid", "doc_id", "key").join(some, "key", "left")
    alone = F.col("keep").isNull()
    return out.select(
        "doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("uid") == F.col("keep"))).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
