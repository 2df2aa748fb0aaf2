"""Language-model scoring by a gated recurrent network with a class-factored output.

Words are bytes between white space, A-Z in lower case; each text closes with an end. Training documents are those whose
crc32 of the id's text isn't 1 modulo 5. What is counted covers all of them: every word's count, by one shuffle of
counts that each task has summed up before.

The texts are read once: each becomes the network's symbols, its counted figures and its rarer words, in a scratch table.
The network reads a word (of the HEAD most frequent ones, or else the class of its shape), and gives a chance to each
class: bins of frequent words, whose words have a softmax of their own, or a shape of rarer words, whose words have the
chance (count + 0.5) / (counts + 0.5 (words + 1)) of their shape, one share being left for what was never seen. It's
trained by truncated backpropagation through time, first on a bounded sample on the driver, then by every task in one pass
over all training documents of its part of the corpus, and the tasks' weights are averaged in a tree. Slopes end at a
window's start; the state goes on through a whole text, in training as in scoring.

The counts of the KNOWN most frequent words are sent to the tasks; rarer words of a text are joined to the table of counts.

Defined cases: a null or empty text is its end alone; a null id counts as empty text (crc32 0: training); rows with equal
ids are trained on and scored on their own; without training documents every word is unknown; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, released, scratch, slices, text_or_empty

#: Words with an embedding and an output weight of their own, and most words whose counts every task gets (about 25 bytes each).
HEAD, KNOWN = 4096, 300_000
HIDDEN, BINS = 16, 40
#: Steps of a window, and lanes of texts that go through the network side by side.
WINDOW, LANES = 32, 256
#: Rows whose logits are computed at once, and words that go through the network together (so that a long text goes beside
#: many short ones, not alone).
ROWS, TOGETHER = 1024, 6_000_000
#: Documents of the sample that the driver starts from, and the passes over it.
SAMPLE_DOCS, SAMPLE_PASSES = 400, 4
#: Characters of texts that are read together.
CHARS = 2_000_000
RATE = 0.08
END = b"\n"

# --- words ----------------------------------------------------------------------------------------------------------

_STRIPPED = ".!?,;:#$%&*|"
_FINAL, _LAST = np.zeros(256, np.int64), np.zeros(256, np.int64)
_FINAL[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
for _group, _marks in enumerate((b".!?", b",;:", b"0123456789"), 1):
    _FINAL[list(_marks)] = _group
for _group, _letters in enumerate((b"e", b"aiouy", b"ns", b"rltd", b"bcfghjkmpqvwxz"), 1):
    _LAST[list(_letters)] = _group
SHAPES = 5 * 2 * 6


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The last byte of each of some strings (0: of an empty one), and their lengths."""
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(places)
    last = np.zeros(len(words), np.uint8)
    if data is not None:
        last[sizes > 0] = np.frombuffer(data, np.uint8)[places[1:][sizes > 0] - 1]
    return last, sizes


def shapes(words: pa.Array) -> np.ndarray:
    """How each word ends, whether it has letters beyond ASCII, and what its last letter is."""
    if not len(words):
        return np.zeros(0, np.int64)
    odd = ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    return (_FINAL[_ends(words)[0]] * 2 + odd) * 6 + _LAST[_ends(pc.ascii_rtrim(words, _STRIPPED))[0]]


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text (without its end), and all words."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    parts = pc.ascii_split_whitespace(texts)
    numbers, words = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
    empty = _ends(texts)[1] == 0
    if empty.any():  # one empty word each
        numbers[empty] = 0
        words = words.filter(pc.not_equal(words, ""))
    return numbers, words


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def count_words(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """word, shape, c over all rows of docs(text).

    A task adds up the counts of its batches when they have 2 `most` rows, and sends them on if they are of `most` words then.
    """
    schema = pa.schema([("word", pa.binary()), ("shape", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(words: pa.Array, counts: pa.Array) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(words), 50_000):
                some = words.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([some.cast(pa.binary()), pa.array(shapes(some).astype(np.int32)), counts.slice(at, 50_000)], schema=schema)

        def merged(held: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

        held, n, ends = [], 0, 0
        for batch in batches:
            counted = split(batch.column(0))[1].value_counts()
            held.append(pa.table([counted.field(0), counted.field(1)], ["word", "c"]))
            n += len(counted)
            ends += batch.num_rows
            if n >= 2 * most:
                held = [merged(held)]
                n = held[0].num_rows
                if n >= most:
                    yield from sent(*(held[0][c].chunk(0) for c in ("word", "c")))
                    held, n = [], 0
        if n:
            yield from sent(*(merged(held)[c].chunk(0) for c in ("word", "c")))
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], schema=schema)

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(released(run), "word binary, shape int, c long")
    return rows.groupBy("word", "shape").agg(F.sum("c").alias("c"))


@dataclasses.dataclass
class Vocabulary:
    """The most frequent words in order; the first `head` of them are the network's own. total, types: of all words; by_shape: of the rarer ones."""

    words: list[bytes]
    counts: np.ndarray
    shapes: np.ndarray
    head: int
    total: int
    types: int
    by_shape: np.ndarray  # (SHAPES, 2): counts and types of words outside the head

    def __post_init__(self):
        c = np.maximum(self.counts[: self.head].astype(float), 0.5)
        mass = np.cumsum(np.sqrt(c))
        bins = np.minimum((mass - np.sqrt(c)) / mass[-1] * BINS, BINS - 1).astype(np.int64)
        _, self.bin_of = np.unique(bins, return_inverse=True)  # bins of consecutive words, frequent ones alone
        self.n_bins = int(self.bin_of.max()) + 1
        self.bin_start = np.searchsorted(self.bin_of, np.arange(self.n_bins + 1))
        self.classes = self.n_bins + SHAPES
        self.shape_log = np.log10(self.by_shape[:, 0] + 0.5 * (self.by_shape[:, 1] + 1))
        self.base_log = math.log10(self.total + 0.5 * (self.types + 1))


def vocabulary(counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """The words above the lowest count that leaves at most `known` of them, and the end. These, and one row per shape, come to the driver."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # One row for each count there is; words of equal counts are in or out together, so nothing of the size of the table is sorted.
    ahead = F.sum("n").over(Window.orderBy(F.col("c").desc()))
    cut = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", ahead).where(F.col("ahead") > known).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    top = counts.where((F.col("c") > cut) | (F.col("word") == F.lit(END))).toArrow()
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    words, c, shapes = top["word"].to_pylist(), top["c"].to_numpy(), top["shape"].to_numpy()
    if END not in words[:head]:  # only in corpora of almost no text
        at = words.index(END) if END in words else -1
        keep = [k for k in range(len(words)) if k != at]
        words, c, shapes = [END, *(words[k] for k in keep)], np.append(c[at] if at >= 0 else 0, c[keep]), np.append(-1, shapes[keep])
    head = min(head, len(words))
    sums = np.zeros((SHAPES, 2), np.int64)
    for s, n, v in counts.groupBy("shape").agg(F.sum("c"), F.count(F.lit(1))).collect():
        if s >= 0:
            sums[s] = n, v
    own = shapes[:head] >= 0
    np.subtract.at(sums, (shapes[:head][own], 0), c[:head][own])
    np.subtract.at(sums, (shapes[:head][own], 1), 1)
    return Vocabulary(words, c.astype(np.int64), shapes.astype(np.int64), head, int(total), int(types), sums)


class Reader:
    """Turns texts into the network's symbols: a head word's place, or head + shape; and sums what is known of their words.

    What holds of the known words lies in arrays by place; the place -1, of rarer words, is the arrays' last one.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.words, self.end = v, pa.array(v.words, pa.binary()), v.words.index(END)
        own, logs = np.arange(len(v.words)) < v.head, np.log10(v.counts + 0.5)
        self.symbols = np.append(np.where(own, np.arange(len(v.words)), v.head + v.shapes), 0).astype(np.int32)
        self.known, self.logs = np.append(v.counts > 0, 0).astype(np.int64), np.append(logs, 0)
        self.tail = np.append(np.where(own, 0, logs - v.shape_log[np.where(own, 0, v.shapes)]), 0)

    def read(self, parts: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], tuple[pa.Array, np.ndarray, np.ndarray]]]:
        """For each part, of one text at least: the texts' numbers of tokens, and all their symbols; of each text's known words their number, base and tail

        (see read()); and the rarer words, each once for a text: words, their numbers, and where each text's begin and end.
        """
        cut = [split(texts) for texts in parts]
        places = pc.index_in(pa.chunked_array([words for _, words in cut], pa.string()).cast(pa.binary()), value_set=self.words)  # the set is hashed at each call
        at = 0
        for sizes, words in cut:
            yield self._read(sizes + 1, words, pc.fill_null(places.slice(at, len(words)), -1).to_numpy())
            at += len(words)

    def _read(self, sizes: np.ndarray, words: pa.Array, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], tuple[pa.Array, np.ndarray, np.ndarray]]:
        v = self.v
        ends = np.cumsum(sizes)
        places, is_word = np.full(ends[-1], self.end), np.ones(ends[-1], bool)
        is_word[ends - 1] = False
        places[is_word] = found
        symbols, tail = self.symbols.take(places), self.tail.take(places)
        odd = np.flatnonzero(places < 0)
        rare = words.filter(pa.array(found < 0)).dictionary_encode()
        kinds, which = shapes(rare.dictionary), rare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        symbols[odd], tail[odd] = v.head + kinds[which], -v.shape_log[kinds[which]]
        sums = [np.add.reduceat(x, ends - sizes) for x in (self.known.take(places), self.logs.take(places), tail)]
        sums[1] -= v.base_log * sizes
        types = max(len(kinds), 1)
        each, numbers = np.unique(np.searchsorted(ends, odd, "right") * types + which, return_counts=True)
        return sizes, symbols, sums, (rare.dictionary.take(pa.array(each % types)), numbers, np.searchsorted(each // types, np.arange(len(sizes) + 1)))


# --- the network ----------------------------------------------------------------------------------------------------


def start_weights(v: Vocabulary, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the output's biases are the classes' and words' own frequencies."""
    r = np.random.default_rng(seed)
    small = lambda *n: (r.standard_normal(n) * 0.1).astype(np.float32)
    c = v.counts[: v.head] + 0.5
    per = np.concatenate([np.add.reduceat(c, v.bin_start[:-1]), v.by_shape[:, 0] + 0.5 * (v.by_shape[:, 1] + 1)])
    return {
        "embed": small(v.head + SHAPES, 3 * hidden), "state": small(hidden, 3 * hidden) * 2, "class": small(hidden, v.classes), "class_bias": np.log(per / per.sum()).astype(np.float32),
        "word": small(v.head, hidden), "word_bias": np.log(c).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lanes(docs: list[np.ndarray], lanes: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts dealt to lanes, longest lane first. Inputs, targets, text of each cell (-1: none), whether it opens a text, and how many lanes are going at each step."""
    heads = [0] * min(lanes, len(docs))
    dealt: list[list[int]] = [[] for _ in heads]
    import heapq

    heap = [(0, k) for k in range(len(heads))]
    for d in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        n, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (n + len(docs[d]), k))
    dealt.sort(key=lambda own: -sum(len(docs[d]) for d in own))
    lengths = np.array([sum(len(docs[d]) for d in own) for own in dealt])
    steps = int(lengths[0])
    inputs, targets = np.zeros((steps, len(dealt)), np.int32), np.zeros((steps, len(dealt)), np.int32)
    text, opens = np.full((steps, len(dealt)), -1, np.int32), np.zeros((steps, len(dealt)), bool)
    for k, own in enumerate(dealt):
        at = 0
        for d in own:
            n = len(docs[d])
            targets[at : at + n, k], text[at : at + n, k] = docs[d], d
            inputs[at, k], opens[at, k] = end, True
            inputs[at + 1 : at + n, k] = docs[d][:-1]
            at += n
    return inputs, targets, text, opens, np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")


def _cell(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step, written plainly. Keep, reset, the new value, the state's part of it, and the state after."""
    n = h.shape[1]
    hu = h @ w["state"]
    gates = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
    keep, reset = gates[:, :n], gates[:, n:]
    new = np.tanh(x[:, 2 * n :] + reset * hu[:, 2 * n :])
    return keep, reset, new, hu[:, 2 * n :], new + keep * (h - new)


def _forward(w: dict[str, np.ndarray], inputs: np.ndarray, opens: np.ndarray, h: np.ndarray, all_parts: bool = True) -> tuple[np.ndarray, ...]:
    """As _cell(), for all steps of lanes (steps, lanes). Whether the state goes on, keep and reset, new values, the state's part

    of them, states before (those of the last step only, if not all_parts) and after. Parts lie apart, so that each operation
    runs through memory in one go.
    """
    (steps, n), hidden, kind = inputs.shape, h.shape[1], w["state"].dtype
    goes = (~opens).astype(kind)[..., None]
    x = w["embed"].reshape(-1, hidden).take(3 * inputs + np.arange(3)[:, None, None], 0)
    state = w["state"].reshape(hidden, 3, hidden).swapaxes(0, 1).copy()
    held = steps if all_parts else 1
    gates, got, after = np.empty((2, held, n, hidden), kind), np.empty((3, n, hidden), kind), np.empty((steps, n, hidden), kind)
    new, hu, before = np.empty((3, held, n, hidden), kind)
    for t in range(steps):
        k = t % held
        np.multiply(h, goes[t], out=before[k])
        np.matmul(before[k], state, out=got)
        gate = np.add(x[:2, t], got[:2], out=gates[:, k])
        gate *= 0.5
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        hu[k] = got[2]
        value = np.multiply(gate[1], got[2], out=new[k])
        value += x[2, t]
        np.tanh(value, out=value)
        h = np.subtract(before[k], value, out=after[t])
        h *= gate[0]
        h += value
    return goes, gates, new, hu, before, after


def _class_of(v: Vocabulary, targets: np.ndarray) -> np.ndarray:
    return np.where(targets < v.head, v.bin_of[np.minimum(targets, v.head - 1)], v.n_bins + targets - v.head)


def _narrow(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exp of no logit of a state, whose values lie within -1 and 1, can overflow or vanish."""
    return float(np.abs(weights).sum(0).max() + np.abs(bias).max()) < 60


def _raised(x: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row of x, in place of x, and the rows' sums. Rows are shifted unless their values are known to be small."""
    if not narrow and x.size:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _chance_of(x: np.ndarray, at: np.ndarray, narrow: bool) -> np.ndarray:
    """Natural log of the softmax of each row of x (which is overwritten) at one place."""
    if not narrow and x.size:
        x -= x.max(1, keepdims=True)
    picked = x[np.arange(len(x)), at]
    return picked - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def _with_bias(x: np.ndarray, bias: np.ndarray | float) -> np.ndarray:
    """x and one more column: a bias for each row of weights, 1 for states."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x, bias
    return out


def _slopes(own: np.ndarray, weights: np.ndarray, at: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the loss by states, weights and biases, where each state should give the choice `at`. Both have their biases' column.

    A state's share of each choice is e, exp of the logits, over its sum, less one at the right one; states are divided, not e.
    """
    e, total = _raised(own @ weights.T, narrow)
    e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + at] -= total
    share = 1 / total
    by_state = e @ weights[:, :-1]
    by_state *= share[:, None]
    return by_state, e.T @ (own[:, :-1] * share[:, None]), share @ e


def log_chances(v: Vocabulary, w: dict[str, np.ndarray], h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of the chance of each target symbol: its class's, and for a head word its own within its bin."""
    kind = _class_of(v, targets)
    out = np.empty(len(h))
    narrow = _narrow(w["class"], w["class_bias"]) and _narrow(w["word"].T, w["word_bias"]) and bool(len(h)) and float(np.abs(h).max()) <= 1
    h, classes, words = _with_bias(h, 1), _with_bias(w["class"].T, w["class_bias"]), _with_bias(w["word"], w["word_bias"])
    for at in range(0, len(h), ROWS):  # a slice's logits stay in the processor's cache
        out[at : at + ROWS] = _chance_of(h[at : at + ROWS] @ classes.T, kind[at : at + ROWS], narrow)
    by = np.argsort(kind.astype(np.int16), kind="stable")
    cuts = np.searchsorted(kind[by], np.arange(v.n_bins + 1))
    h, targets, of_word = h.take(by, 0), targets[by], np.zeros(len(h))
    for b in range(v.n_bins):
        rows, (a, z) = slice(cuts[b], cuts[b + 1]), v.bin_start[b : b + 2]
        if cuts[b] < cuts[b + 1] and z - a > 1:
            of_word[rows] = _chance_of(h[rows] @ words[a:z].T, targets[rows] - a, narrow)
    out[by] += of_word
    return out


def text_log_chances(v: Vocabulary, w: dict[str, np.ndarray], docs: list[np.ndarray], end: int, lanes: int = LANES) -> np.ndarray:
    """Natural log of the chance of each text's symbols; the state goes on from window to window."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    inputs, targets, text, opens, going = _lanes(docs, lanes, end)
    h = np.zeros((inputs.shape[1], w["state"].shape[0]), w["state"].dtype)
    for at in range(0, len(inputs), 4 * WINDOW):
        end_at, states, n = min(at + 4 * WINDOW, len(inputs)), [], going[at]
        for k in range(at, end_at, WINDOW):
            part = slice(k, min(k + WINDOW, end_at))
            states.append(_forward(w, inputs[part, :n], opens[part, :n], h[:n], False)[-1])
            h = states[-1][-1]
        # A lane that has ended goes on, but nothing of that is scored.
        there = np.arange(n) < going[at:end_at, None]
        logs = log_chances(v, w, np.concatenate(states)[there], targets[at:end_at, :n][there])
        total += np.bincount(text[at:end_at, :n][there], logs, minlength=len(docs))
    return total


class Trainer:
    """Adagrad over windows; sums of squares go along with the weights, so that a task's steps are no larger than the driver's last ones."""

    def __init__(self, v: Vocabulary, w: dict[str, np.ndarray], squares: dict[str, np.ndarray] | None = None):
        self.v, self.w = v, {k: x.copy() for k, x in w.items()}
        self.squares = {k: x.copy() for k, x in squares.items()} if squares else {k: np.full(x.shape, 0.1, np.float32) for k, x in w.items()}

    def _step(self, name: str, slope: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        slope = np.clip(slope, -5, 5)
        squares = self.squares[name][rows] + slope * slope
        self.squares[name][rows] = squares
        slope *= RATE
        slope /= np.sqrt(squares, out=squares)
        self.w[name][rows] -= slope

    def texts(self, docs: list[np.ndarray], end: int, lanes: int = LANES) -> None:
        if not docs:
            return
        inputs, targets, _, opens, going = _lanes(docs, lanes, end)
        h = np.zeros((inputs.shape[1], self.w["state"].shape[0]), np.float32)
        for at in range(0, len(inputs), WINDOW):
            h = self.window(inputs[at : at + WINDOW], targets[at : at + WINDOW], opens[at : at + WINDOW], going[at : at + WINDOW], h)

    def window(self, inputs: np.ndarray, targets: np.ndarray, opens: np.ndarray, going: np.ndarray, h: np.ndarray) -> np.ndarray:
        v, w = self.v, self.w
        steps, n, hidden = len(inputs), int(going[0]), w["state"].shape[0]
        inputs, kind_of = inputs[:, :n], w["state"].dtype
        # A lane that has ended goes on, but nothing of that is learnt.
        goes, (keep, reset), new, hu, before, after = _forward(w, inputs, opens[:, :n], h[:n])
        there = None if going[-1] == n else np.flatnonzero((np.arange(n) < going[:, None]).ravel())
        states, goal = after.reshape(-1, hidden), targets[:, :n].ravel()
        if there is not None:
            states, goal = states.take(there, 0), goal[there]
        kind = _class_of(v, goal).astype(np.int16)
        narrow = _narrow(w["class"], w["class_bias"]) and _narrow(w["word"].T, w["word_bias"])
        states, slope = _with_bias(states, 1), np.empty_like(states)
        classes, words = _with_bias(w["class"].T, w["class_bias"]), _with_bias(w["word"], w["word_bias"])
        to = {k: np.zeros_like(w[k].T if k == "class" else w[k]) for k in ("class", "class_bias", "word", "word_bias")}
        for at in range(0, len(states), ROWS):  # a slice's logits stay in the processor's cache
            some = slice(at, at + ROWS)
            slope[some], by_class, by_bias = _slopes(states[some], classes, kind[some], narrow)
            to["class"] += by_class
            to["class_bias"] += by_bias
        by = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[by], np.arange(v.n_bins + 1))
        states, goal, of_word = states.take(by, 0), goal[by], np.zeros_like(slope)
        for b in range(v.n_bins):
            rows, (a, z) = slice(cuts[b], cuts[b + 1]), v.bin_start[b : b + 2]
            if cuts[b] < cuts[b + 1] and z - a > 1:
                of_word[rows], to["word"][a:z], to["word_bias"][a:z] = _slopes(states[rows], words[a:z], goal[rows] - a, narrow)
        slope += of_word.take(np.argsort(by), 0)
        found = [(k, x.T if k == "class" else x, slice(None)) for k, x in to.items()]
        if there is not None:
            whole = np.zeros((steps * n, hidden), slope.dtype)
            whole[there] = slope
            slope = whole
        slope = slope.reshape(steps, n, hidden)
        # Back through the window; what lies before it is left as it is.
        to_new = (1 - keep) * (1 - new * new)
        to_keep = (before - new) * keep
        to_keep *= 1 - keep
        to_reset = hu * reset
        to_reset *= 1 - reset
        back = w["state"].T.reshape(3, hidden, hidden)
        to_state, to_input, got = np.empty((3, steps, n, hidden), kind_of), np.empty((steps, n, hidden), kind_of), np.empty((3, n, hidden), kind_of)
        later = np.zeros((n, hidden), kind_of)
        for t in range(steps - 1, -1, -1):
            d = np.add(slope[t], later, out=later)
            d_new = np.multiply(d, to_new[t], out=to_input[t])
            np.multiply(d, to_keep[t], out=to_state[0, t])
            np.multiply(d_new, to_reset[t], out=to_state[1, t])
            np.multiply(d_new, reset[t], out=to_state[2, t])
            d *= keep[t]
            for x in np.matmul(to_state[:, t], back, out=got):
                d += x
            d *= goes[t]
        to_state = to_state.reshape(3, -1, hidden)
        found.append(("state", np.concatenate(before.reshape(-1, hidden).T @ to_state, 1), slice(None)))
        ids = inputs.ravel()
        by = np.argsort(ids.astype(np.uint16) if v.head + SHAPES < 65536 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[by], prepend=-1))
        slopes = [np.add.reduceat(x.take(by, 0), first) for x in (to_state[0], to_state[1], to_input.reshape(-1, hidden))]
        found.append(("embed", np.concatenate(slopes, 1), ids[by][first]))
        for name, x, rows in found:
            self._step(name, x, rows)
        return after[-1]


def _groups(docs: Iterable[np.ndarray], most: int = TOGETHER) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


BLOCK = 65_536


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _averaged(rows: DataFrame, tasks: int, fan_in: int = 32) -> np.ndarray | None:
    """Mean of the tasks' weights (task, block, n, x) by their numbers of words, in a tree of groups of fan_in."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        x = np.average(np.stack(pdf["x"].to_list()).astype(float), axis=0, weights=n)
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // fan_in], "block": [int(pdf["block"].iloc[0])], "n": [int(n.sum())], "x": [x.astype(np.float32)]})

    while True:
        rows = rows.withColumn("group", F.floor(F.col("task") / fan_in)).groupBy("group", "block").applyInPandas(mean, "task int, block int, n long, x array<float>")
        tasks = math.ceil(tasks / fan_in)
        if tasks <= 1:
            break
    got = rows.orderBy("block").toArrow()  # one row per block
    return np.concatenate([np.array(x, np.float32) for x in got["x"].to_pylist()]) if got.num_rows else None


_READ = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, rare array<struct<word: binary, k: long>>, symbols array<int>"


def read(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """What is known of each row of docs(doc_id, text): uid, doc_id, held_out, n_tokens, and of its known words n_known and

    base (sum of the logs of c + 0.5, less all words' share of the denominator), tail (the same within shapes), rare (its
    other words with their numbers), symbols (the network's).
    """
    sent = docs.sparkSession.sparkContext.broadcast(v)
    rare_of = pa.struct([("word", pa.binary()), ("k", pa.int64())])
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("tail", pa.float64()), ("rare", pa.list_(rare_of)), ("symbols", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            parts = list(slices(batch, "text", CHARS))
            for part, (sizes, symbols, sums, (words, numbers, cuts)) in zip(parts, reader.read([p.column("text") for p in parts]), strict=True):
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([words.cast(pa.binary()), pa.array(numbers, pa.int64())], fields=list(rare_of)))
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(symbols))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "doc_id", "held_out")), pa.array(sizes), *map(pa.array, sums), lists, flat], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(released(run), _READ)


def _symbols(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def train(docs: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """docs: the training rows. Weights of the network, first fitted to a sample on the driver, then by all tasks to all rows."""
    return fit(scratch(read(docs, v), "lm-read"), v)


def fit(rows: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """As train(), of rows of read()."""
    spark, end = rows.sparkSession, v.words.index(END)
    first = rows.orderBy(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "n_tokens", "base", "tail").limit(SAMPLE_DOCS).select("symbols").toArrow()["symbols"]
    start = Trainer(v, start_weights(v))
    sample = [d for part in first.chunks for d in _symbols(part)]
    for _ in range(SAMPLE_PASSES):
        start.texts(sample, end, lanes=32)
    sent = spark.sparkContext.broadcast((v, start.w, start.squares))
    schema = pa.schema([("task", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, squares = sent.value
        trainer, n = Trainer(v, w, squares), 0
        for part in _groups(d for batch in batches for d in _symbols(batch.column(0))):
            trainer.texts(part, end)
            n += sum(map(len, part))
        if n:
            flat = _flat(trainer.w)
            for b, at in enumerate(range(0, len(flat), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[at : at + BLOCK]], pa.list_(pa.float32()))], schema=schema)

    fitted = scratch(rows.select("symbols").mapInArrow(released(run), "task int, block int, n long, x array<float>"), "lm-weights")
    tasks = fitted.agg(F.max("task")).first()[0]
    flat = None if tasks is None else _averaged(fitted, tasks + 1)
    return start.w if flat is None else _unflat(flat, start.w)


# --- scores ---------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, head: int = HEAD, known: int = KNOWN) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = scratch(count_words(docs.select("doc_id", "text").where(~held_out())), "lm-counts")
    v = vocabulary(counts, head, known)
    rows = scratch(read(docs, v), "lm-read")
    sent = spark.sparkContext.broadcast((v, fit(rows.where("not held_out"), v)))
    end = v.words.index(END)
    plain = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base"]
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value

        def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            symbols = [s for chunk in part["symbols"].chunks for s in _symbols(chunk)]
            total = text_log_chances(v, w, symbols, end) / math.log(10) + part["tail"].to_numpy()
            return pa.Table.from_arrays([*(part[c] for c in plain), pa.array(total)], schema=schema).combine_chunks().to_batches()[0]

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("symbols").values)
            if n >= TOGETHER:
                yield scored(held)
                held, n = [], 0
        if held:
            yield scored(held)

    scored_rows = scratch(rows.select(*plain, "tail", "symbols").mapInArrow(released(run), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"), "lm-scored")
    # Words outside the known ones: their counts are looked up by a join, once for each text that has them, and summed by text.
    rare = rows.select("uid", F.explode("rare").alias("x")).select("uid", "x.word", "x.k").join(counts.select("word", "c"), "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("found"))
    out = scored_rows.join(rare, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
