"""Quality classifier by co-training: two views of a document teach each other.

One classifier sees what the text holds (kinds of characters, repetition, words), the other only what is said about the page
(source, language, the length given with it). Both are logistic regressions fitted to a bounded sample of labelled
documents; in each round either looks through all unlabelled documents for those that it's surest about, and they become
labels for the other. Their scores are calibrated on labelled documents held out of the fit, combined by a third regression
there, and applied to every document in one pass.

A document is rejected below the threshold that best parts the held-out labels: the share of bad documents below it, less
LOSS_WEIGHT times the share of good ones. So a few wrong labels don't move it, and clean documents stay.

Defined cases: a null text is empty; null language, source, length or doc_id are values of their own; labels without a
quality or document are left out, several labels of a document count by their mean; if no label of one class exists,
everything is kept; rows with equal ids are scored on their own; an empty table gives an empty result; further columns are
passed on by keep_good() alone.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, maybe_broadcast, release, released, scratch, slices, text_or_empty

#: Labelled documents that are fitted to, rounds, and documents that a view labels in a round.
LABELLED, ROUNDS, A_ROUND = 6_000, 4, 400
#: What a lost good document weighs against a bad one that is found, each as a share of its class; and the highest threshold.
LOSS_WEIGHT, HIGHEST = 20.0, 0.5
#: Bytes of texts whose features are taken at once.
CHARS = 2_000_000

_SMALL, _BIG, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _BANG, _BAR, _HASH, _QUOTE, _WIDE, _ELSE = range(13)
_CLASS = np.full(256, _ELSE, np.uint8)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", _SMALL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _BIG), ("0123456789", _DIGIT), (" \t\r\f\v", _SPACE), ("\n", _LINE), (".", _STOP), (",;:", _COMMA), ("!?", _BANG), ("|<>{}[]\\/=_", _BAR), ("#$%&*^~@+", _HASH), ("\"'`()-", _QUOTE)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128:] = _WIDE
#: Sources and languages go to buckets by hash; lengths to classes by these bounds.
N_TEXT, SOURCES, LANGS, LENGTHS = 13 + 9, 64, 16, (1, 40, 200, 1000, 5000, 20_000)
N_META = SOURCES + LANGS + len(LENGTHS) + 2 + 2


def text_features(texts: list[str]) -> np.ndarray:
    """Of each text: shares of character kinds, word lengths, capitals, and how much of its words and lines repeats."""
    out = np.zeros((len(texts), N_TEXT), np.float32)
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        if not raw:
            continue
        counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=13)
        words = raw.split()
        n = max(1, len(words))
        kinds = set(words)
        lines = [x for x in raw.split(b"\n") if x]
        out[k, :13] = counts / len(raw)
        out[k, 13] = np.log1p(len(words)) / 10
        out[k, 14] = min(len(raw) / n, 40) / 10
        out[k, 15] = len(kinds) / n
        out[k, 16] = len(kinds) / n**0.8 / 3
        out[k, 17] = 1 - len(set(lines)) / max(1, len(lines))
        out[k, 18] = counts[_BIG] / max(1, counts[_BIG] + counts[_SMALL])
        out[k, 19] = (counts[_HASH] + counts[_BAR] + counts[_BANG]) / n
        out[k, 20] = counts[_STOP] / n
        out[k, 21] = sum(map(len, kinds)) / max(1, len(kinds)) / 10
    return out


def page_codes(sources: list, langs: list) -> np.ndarray:
    """Of each page: the buckets of its source and of its language."""
    return np.array([(zlib.crc32(repr(a).encode()) % SOURCES, zlib.crc32(repr(b).encode()) % LANGS) for a, b in zip(sources, langs, strict=True)], np.int32).reshape(-1, 2)


def meta_features(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each page: its source, its language, and its length (not a number: none is given) by class and as such."""
    out = np.zeros((len(codes), N_META), np.float32)
    row = np.arange(len(codes))
    given = np.maximum(np.nan_to_num(lengths), 0)
    out[row, codes[:, 0]] = out[row, SOURCES + codes[:, 1]] = 1
    out[row, SOURCES + LANGS + np.where(np.isnan(lengths), len(LENGTHS) + 1, np.searchsorted(LENGTHS, given, "right"))] = 1
    out[:, -2], out[:, -1] = np.log1p(given) / 10, (np.log1p(given) / 10) ** 2
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression with an intercept, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclasses.dataclass
class Model:
    """Weights of both views (on scaled features), of their calibrations and of the combination; None: keep everything."""

    centre: np.ndarray
    spread: np.ndarray
    text: np.ndarray | None
    meta: np.ndarray | None
    text_scale: np.ndarray | None = None
    meta_scale: np.ndarray | None = None
    both: np.ndarray | None = None
    threshold: float = 0.0

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            one = np.ones(len(text))
            return one, one, one
        a = _logit(_logit((text - self.centre) / self.spread, self.text)[:, None], self.text_scale)
        b = _logit(_logit(meta, self.meta)[:, None], self.meta_scale)
        return _chance(a), _chance(b), _chance(_logit(np.stack([a, b], 1), self.both))


#: What a view is sure of: of each row its key, its features in both views, and its label.
Taught = dict[int, tuple[np.ndarray, np.ndarray, float]]
#: (weights of the teaching view by name, keys that its pupil has, good rows, bad rows) -> what is taught.
Teacher = Callable[[str, np.ndarray, "Scale", Taught, int, int], Taught]


@dataclasses.dataclass
class Scale:
    """Means and spreads of the text features."""

    centre: np.ndarray
    spread: np.ndarray

    def __call__(self, text: np.ndarray) -> np.ndarray:
        return (text - self.centre) / self.spread


def threshold_of(p: np.ndarray, good: np.ndarray, weight: float = LOSS_WEIGHT, highest: float = HIGHEST) -> float:
    """The lowest threshold that (nearly) best parts good from bad rows by their chances p."""
    at = np.unique(np.concatenate([[0.0], p[p < highest], [highest]]))
    at = np.concatenate([[0.0], (at[1:] + at[:-1]) / 2])  # between two rows
    below = lambda x: np.searchsorted(np.sort(x), at, "left") / max(1, len(x))
    gain = below(p[good == 0]) - weight * below(p[good == 1])
    return float(at[np.flatnonzero(gain >= gain.max() - 1e-3)[0]])


def co_train(text: np.ndarray, meta: np.ndarray, good: np.ndarray, more_text: np.ndarray, more_meta: np.ndarray, rounds: int = ROUNDS, a_round: int = A_ROUND) -> Model:
    """As taught_rounds(), with the unlabelled rows' views at hand."""

    def surest(view: str, w: np.ndarray, scale: Scale, known: Taught, n_good: int, n_bad: int) -> Taught:
        p = _chance(_logit(scale(more_text) if view == "text" else more_meta, w))
        free = np.array([r for r in range(len(p)) if r not in known], int)
        by = free[np.argsort(p[free], kind="stable")]
        rows = [(int(r), 1.0) for r in by[-n_good:] if p[r] > 0.95] + [(int(r), 0.0) for r in by[:n_bad] if p[r] < 0.05]
        return {r: (more_text[r], more_meta[r], label) for r, label in rows}

    return taught_rounds(text, meta, good, surest, rounds if len(more_text) else 0, a_round)


def taught_rounds(text: np.ndarray, meta: np.ndarray, good: np.ndarray, surest: Teacher, rounds: int = ROUNDS, a_round: int = A_ROUND) -> Model:
    """good: 0 or 1 of each labelled row. Every fourth labelled row is held out of the rounds."""
    scale = Scale(text.mean(0), text.std(0) + 1e-3) if len(text) else Scale(np.zeros(N_TEXT), np.ones(N_TEXT))
    if len(good) < 8 or good.min() == good.max():
        return Model(scale.centre, scale.spread, None, None)
    held = np.arange(len(good)) % 4 == 3
    if len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        held = np.zeros(len(good), bool)
    base = ~held
    views = {"text": scale(text), "meta": meta}
    taught: dict[str, Taught] = {"text": {}, "meta": {}}  # pseudo-labels that a view has been given

    def fitted(view: str) -> np.ndarray:
        given = [*taught[view].values()]
        x, y = [views[view][base]], [good[base]]
        if given:
            x.append(scale(np.stack([g[0] for g in given])) if view == "text" else np.stack([g[1] for g in given]))
            y.append(np.array([g[2] for g in given]))
        return _fit(np.concatenate(x), np.concatenate(y), np.concatenate([np.ones(base.sum()), np.full(len(given), 0.5)]))

    weights = {view: fitted(view) for view in views}
    n_good = max(1, round(a_round * good[base].mean()))
    for _ in range(rounds):
        # The surest of either class, in the classes' proportion; only where the view is sure at all.
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            taught[pupil] |= surest(teacher, weights[teacher], scale, taught[pupil], n_good, max(1, a_round - n_good))
        weights = {view: fitted(view) for view in views}
    judge = held if held.any() else base
    a, b = (_logit(views[view][judge], weights[view]) for view in ("text", "meta"))
    text_scale, meta_scale = _fit(a[:, None], good[judge], l2=1e-3), _fit(b[:, None], good[judge], l2=1e-3)
    a, b = _logit(a[:, None], text_scale), _logit(b[:, None], meta_scale)
    both = _fit(np.stack([a, b], 1), good[judge], l2=1e-2)
    p = _chance(_logit(np.stack([a, b], 1), both))
    return Model(scale.centre, scale.spread, weights["text"], weights["meta"], text_scale, meta_scale, both, threshold_of(p, good[judge]))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text features, page codes and lengths of a batch's rows."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    lengths = batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    return text_features(texts), page_codes(batch.column("source").to_pylist(), batch.column("lang").to_pylist()), lengths


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))


_FEATURES = "uid long, doc_id long, text array<float>, source int, lang int, length double"
_FEATURES_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.list_(pa.float32())), ("source", pa.int32()), ("lang", pa.int32()), ("length", pa.float64())])


def features(docs: DataFrame) -> DataFrame:
    """Both views of each row of docs, in little space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHARS):
                text, codes, lengths = _views(part)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, text.size + 1, N_TEXT), pa.int32()), pa.array(text.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), flat, pa.array(codes[:, 0]), pa.array(codes[:, 1]), pa.array(lengths)], schema=_FEATURES_ARROW)

    return _input(docs).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(released(run), _FEATURES)


def _unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of both views of rows of features()."""
    text = np.array(rows["text"].to_pylist(), np.float32).reshape(-1, N_TEXT)
    codes = np.stack([rows["source"].to_numpy(), rows["lang"].to_numpy()], 1)
    return text, meta_features(codes, rows["length"].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows["length"].to_numpy())


def surest_of(pool: DataFrame) -> Teacher:
    """A teacher that looks through all of pool, rows of features(). Each task finds its own surest rows; as many come to the driver as are taught."""

    def surest(view: str, w: np.ndarray, scale: Scale, known: Taught, n_good: int, n_bad: int) -> Taught:
        sent = pool.sparkSession.sparkContext.broadcast((w, scale, np.array(sorted(known), np.int64)))
        schema = _FEATURES_ARROW.append(pa.field("p", pa.float64()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, scale, taken = sent.value
            best: pa.Table | None = None
            for batch in batches:
                text, meta = _unpacked(batch)
                p = _chance(_logit(scale(text) if view == "text" else meta, w))
                rows = pa.Table.from_arrays([*batch.columns, pa.array(p)], schema=schema)
                rows = rows.filter(pa.array(((p > 0.95) | (p < 0.05)) & ~np.isin(batch.column("uid").to_numpy(), taken)))
                rows = (pa.concat_tables([best, rows]) if best is not None else rows).sort_by([("p", "ascending"), ("doc_id", "ascending"), ("uid", "ascending")])
                p = rows["p"].to_numpy()
                keep = np.zeros(len(p), bool)
                keep[:n_bad], keep[max(0, len(p) - n_good) :] = True, True
                best = rows.filter(pa.array(keep)).combine_chunks()
            if best is not None:
                yield from best.to_batches()

        # Ranks are limited in each partition before the shuffle.
        found = pool.mapInArrow(released(run), _FEATURES + ", p double").withColumn("label", (F.col("p") > 0.5).cast("double"))
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.abs(F.col("p") - F.col("label")), "doc_id", "uid"))
        found = found.withColumn("place", place).where(F.col("place") <= max(n_good, n_bad))
        got = found.where(F.col("place") <= F.when(F.col("label") == 1, n_good).otherwise(n_bad)).toArrow()
        sent.destroy()
        text, meta = _unpacked(got)
        return {int(u): (text[k], meta[k], label) for k, (u, label) in enumerate(zip(got["uid"].to_pylist(), got["label"].to_pylist(), strict=True))}

    return surest


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, **how) -> Model:
    """Fits to at most `labelled` labelled documents, those whose hashes come first, and to what the views teach each other of all others."""
    bounded_batches(docs.sparkSession)
    rows = scratch(features(docs), "quality-features")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    marks = scratch(marks, "quality-marks")
    got = rows.join(maybe_broadcast(marks), rows["doc_id"] == marks["id"]).orderBy(F.xxhash64("id"), "id", "uid").limit(labelled).select(*rows.columns, "good").toArrow()
    pool = rows.join(maybe_broadcast(marks.select("id")), rows["doc_id"] == marks["id"], "left_anti")
    text, meta = _unpacked(got)
    out = taught_rounds(text, meta, got["good"].to_numpy().astype(int), surest_of(pool), **how)
    release(rows, marks)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, text_score, meta_score, score, keep."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHARS):
                text, codes, lengths = _views(part)
                a, b, p = model.score(text, meta_features(codes, lengths))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a), pa.array(b), pa.array(p), pa.array(p >= model.threshold)], schema=schema)

    bounded_batches(docs.sparkSession)
    return _input(docs).mapInArrow(released(run), "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rejected rows; one pass in which rows pass through whole."""
    read = ("text", "source", "lang", "n_chars")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHARS):
                text, codes, lengths = _views(pa.RecordBatch.from_arrays([part.column(names.index(c)) for c in read], list(read)))
                yield part.filter(pa.array(model.score(text, meta_features(codes, lengths))[2] >= model.threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), docs.schema)
