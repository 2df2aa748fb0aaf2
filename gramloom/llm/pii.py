"""Personal data: four kinds by pattern, and more by a linear-chain conditional random field over word shapes.

The field's tags are O (neither), S (a secret: a password, token or key) and N (a private number that no pattern finds,
such as a phone number without "+", a social security number or an account number). Its features are shapes of a word and
of its neighbours: which kinds of characters it holds, begins and ends with, how long it is, how often the kind changes,
how much of it is digits. It's trained on the driver from a small labelled table (labelled_table() is the one of the
query), and decoded by Viterbi over many texts at once. Its spans are added where they touch none found by pattern.

Defined cases: a null or empty text has no spans; rows with equal or null ids are scanned on their own; texts of any
length are scanned whole (the patterns' work grows with the length alone); an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, released, slices, text_or_empty

#: Bytes of texts that go through the field together (about 45 for each of them); a longer text goes alone.
CHARS = 1_500_000
KINDS = ("email", "ip", "card", "phone", "secret", "number")
TAGS = "OSN"
_TAG_KIND = {1: "secret", 2: "number"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can't start inside a run of digits, so only their starts are tried: long runs cost no more than their length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the patterns find, in this order."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- shapes ---------------------------------------------------------------------------------------------------------

_SMALL, _BIG, _DIGIT, _WIDE, _OPEN, _JOIN, _SIGN, _MARK, _ODD, _BLANK = range(10)
_CLASS = np.full(128, _ODD, np.uint8)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", _SMALL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _BIG), ("0123456789", _DIGIT), ("(\"'[{<", _OPEN), ("-_./\\", _JOIN), ("=:+@", _SIGN), (".,;!?)]}>", _MARK), (" \t\n\r\f\v", _BLANK)):
    _CLASS[[ord(c) for c in _chars]] = _kind
#: Sizes of the feature families of a word: what it holds, first and last kind, length, changes, digits, all of these together,
#: and its outline: the kinds and lengths of its runs, of up to _RUNS runs and up to a length of the kind.
_WHOLE, _OUTLINE = 4096, 8192
FAMILIES = (1024, 10, 10, 8, 6, 6, _WHOLE, _OUTLINE)
_RUNS = 9
_RUN = np.full(10, 2)
_RUN[[_SMALL, _BIG, _DIGIT]] = 3, 3, 12
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))
OFFSETS = (-2, -1, 0, 1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words within the joined texts, each word's text, and the words' features by family."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(points < 128, _CLASS[np.minimum(points, 127)], _WIDE).astype(np.uint8)
    word = kind != _BLANK
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_of = np.searchsorted(np.cumsum(sizes), starts, "right")
    if not len(starts):
        return starts, ends, text_of, np.zeros((len(FAMILIES), 0), np.int32)
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange((ends - starts).sum())
    kinds = kind[inside]
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    holds = np.bitwise_or.reduceat(np.uint16(1) << kinds.astype(np.uint16), first).astype(np.int32)
    change = np.concatenate([[0], (kinds[1:] != kinds[:-1]).astype(np.int32)])
    change[first] = 0
    changes = np.add.reduceat(change, first)
    length = ends - starts
    digits = np.add.reduceat((kinds == _DIGIT).astype(np.int32), first)
    features = np.empty((len(FAMILIES), len(starts)), np.int32)
    features[0] = holds & 1023
    features[1], features[2] = kind[starts], kind[ends - 1]
    features[3] = np.searchsorted([2, 3, 5, 8, 12, 20, 32], length, "right")
    features[4] = np.searchsorted([1, 2, 4, 7, 11], changes, "right")
    features[5] = np.where(digits == 0, 0, np.minimum(1 + digits * 4 // length, 5))
    code = features[0].astype(np.int64)
    for k in range(1, 6):
        code = code * 11 + features[k]
    features[6] = (code * 2654435761 >> 7) % _WHOLE
    change[first] = 1  # from here on: where runs start
    run = np.flatnonzero(change)
    runs = kinds[run] * 16 + np.minimum(np.diff(np.append(run, len(kinds))), _RUN[kinds[run]])
    inner = np.cumsum(change) - 1
    opens = inner[first]  # each word's first run
    place = np.arange(len(run)) - np.repeat(opens, np.diff(np.append(opens, len(run))))
    mixed = (runs.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, len(_POWERS) - 1)]
    mixed = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), opens)
    mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)).astype(np.int32) % _OUTLINE
    features[7] = np.where(np.diff(np.append(opens, len(run))) > _RUNS, 0, mixed)  # words of many runs have one outline
    return starts, ends, text_of, features


# --- the field ------------------------------------------------------------------------------------------------------


def emissions(features: np.ndarray, text_of: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Scores of each word's tags; a neighbour in another text counts as none."""
    out = np.zeros((features.shape[1], len(TAGS)), np.float32)
    for offset, families in zip(OFFSETS, tables, strict=True):
        own = np.zeros_like(out)
        for f, t in zip(features, families, strict=True):
            own += t[f]
        if offset < 0:
            near = text_of[-offset:] == text_of[:offset]
            out[-offset:][near] += own[:offset][near]
        elif offset > 0:
            near = text_of[offset:] == text_of[:-offset]
            out[:-offset][near] += own[offset:][near]
        else:
            out += own
    return out


def _grids(text_of: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of like length, together: (first words, counts) of at most so many cells of a grid, one text at least."""
    first = np.flatnonzero(np.diff(text_of, prepend=-1))
    counts = np.diff(np.append(first, len(text_of)))
    by = np.argsort(-counts, kind="stable")
    at = 0
    while at < len(by):
        n = max(1, most // int(counts[by[at]]))
        yield first[by[at : at + n]], counts[by[at : at + n]]
        at += n


def viterbi(scores: np.ndarray, text_of: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each text's words. Longer texts come first in a grid, so that at each step the ones still going are its top rows."""
    tags = np.zeros(len(scores), np.int8)
    for first, counts in _grids(text_of):
        steps = int(counts[0])
        going = np.searchsorted(-counts, -np.arange(1, steps + 1), "right")
        back = np.zeros((steps, len(first), len(TAGS)), np.int8)
        best = scores[first].copy()
        for t in range(1, steps):
            n = going[t]
            ways = best[:n, :, None] + moves
            back[t, :n] = ways.argmax(1)
            best[:n] = ways.max(1) + scores[first[:n] + t]
        tag = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = going[t]
            tags[first[:n] + t] = tag[:n]
            if t:
                tag[:n] = back[t, np.arange(n), tag[:n]]
    return tags


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, rate: float = 0.15, l2: float = 0.001) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Tables and moves fitted to labelled texts (text, [(tag, start, end)]) by Adam on the mean log-likelihood, by forward-backward."""
    texts = [t for t, _ in rows]
    starts, ends, text_of, features = words_of(texts)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    gold = np.zeros(len(starts), np.int64)
    for k, (_, spans) in enumerate(rows):
        for tag, a, b in spans:
            gold[(text_of == k) & (starts < begin[k] + b) & (ends > begin[k] + a)] = TAGS.index(tag)
    n_tags = len(TAGS)
    first = np.flatnonzero(np.diff(text_of, prepend=-1))
    counts = np.diff(np.append(first, len(text_of)))
    steps = int(counts.max())
    place = first[:, None] + np.minimum(np.arange(steps), counts[:, None] - 1)
    there = np.arange(steps) < counts[:, None]
    tables = [[np.zeros((n, n_tags)) for n in FAMILIES] for _ in OFFSETS]
    moves = np.zeros((n_tags, n_tags))
    flat = [moves, *(t for families in tables for t in families)]
    mean, square = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    for step in range(1, rounds + 1):
        scores = emissions(features, text_of, [[t.astype(np.float32) for t in families] for families in tables]).astype(float)[place]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, steps):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(there[:, t + 1, None], new, behind[:, t + 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        wrong = np.zeros((len(starts), n_tags))
        wrong[place[there]] = chance[there]
        wrong[np.arange(len(gold)), gold] -= 1
        pair = np.exp(ahead[:, :-1, :, None] + moves + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        move = pair.sum((0, 1))
        same = text_of[1:] == text_of[:-1]
        np.subtract.at(move, (gold[:-1][same], gold[1:][same]), 1)
        slopes = [move]
        for offset in OFFSETS:
            near = np.zeros(len(gold), bool)
            at = np.arange(len(gold)) + offset
            ok = (at >= 0) & (at < len(gold))
            near[ok] = text_of[at[ok]] == text_of[ok]
            for f, n in zip(features, FAMILIES, strict=True):
                slope = np.zeros((n, n_tags))
                np.add.at(slope, f[at[near]], wrong[near])
                slopes.append(slope)
        for p, g, m, v in zip(flat, slopes, mean, square, strict=True):
            g = g / len(rows) + l2 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return [[t.astype(np.float32) for t in families] for families in tables], moves.astype(np.float32)


def labelled_table(n: int = 2400, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small table of invented sentences, made from a seed: secrets, private numbers, and what only looks like them."""
    r = random.Random(seed)
    syllables = "an the er re on ing st ti ed ou ha es wh nt eau oui ment le ver sch ung ción osa do que".split()
    letters = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda a, b=None: letters("0123456789", a, b or a)
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def prose() -> str:
        kind = r.random()
        if kind < 0.55:
            w = word()
        elif kind < 0.65:
            w = word().capitalize()
        elif kind < 0.7:
            w = word().upper() + r.choice(["", "!!", "!"])
        elif kind < 0.76:
            w = word() + r.choice(["###", "$$$", "%%%", "***", "&&&"])
        elif kind < 0.8:
            w = r.choice(["|", "-", "*", "=", "(a)", "==>", "#", "\"" + word() + "\"", "(" + word() + ")", word() + "-" + word(), word() + "/" + word()])
        elif kind < 0.9:
            w = r.choice([digits(1, 4), f"{r.randint(1900, 2030)}", f"{digits(1)}.{digits(1)}", f"{digits(1, 3)}%", f"${digits(1, 4)}", f"{digits(2)}:{digits(2)}", f"{digits(1, 3)},{digits(3)}", f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"no. {digits(1, 3)}", "CC BY-NC 4.0.", "Version 2.0."])
        elif kind < 0.95:
            w = r.choice([f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", f"{digits(2, 3)}.{digits(1, 3)}.{digits(1, 2)}.{digits(2, 3)}", digits(16), f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}", f"https://{word()}.com/{word()}?{word()}={word()}"])
        else:
            w = f"{word()} {word()}"
        return w + r.choice(["", "", "", ",", ".", "."])

    def secret() -> str:
        value = r.choice([letters(hexes, 16, 48), letters(mixed, 20, 44), letters(mixed, 12, 20) + digits(2), "AKIA" + letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), "sk_" + letters(mixed, 24, 32), "ghp_" + letters(mixed, 30, 36)])
        if len(set(c.isdigit() for c in value)) < 2:
            value += digits(3)
        key = r.choice(["token", "password", "api_key", "secret", "key", "passwd", "auth"])
        return r.choice([f"{key}={value}", f'{key} = "{value}"', f"{key}: {value}", f'{key}="{value}"', f"{value}", f"{key} = '{value}'"])

    def number() -> str:
        return r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{r.choice(['DE', 'FR', 'GB', 'ES'])}{digits(18, 20)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])

    rows = []
    for k in range(n):
        parts, spans, at = [], [], 0
        marked = r.randint(0, 1) if k % 3 else 0
        total = r.randint(1, 12)
        where = r.randrange(total) if marked else -1
        for j in range(total):
            if j == where:
                tag, piece = r.choice([("S", secret()), ("N", number())])
                value = piece
                if tag == "S" and " " in piece:
                    value = piece.rsplit(" ", 1)[1]
                spans.append((tag, at + len(piece) - len(value), at + len(piece)))
                piece += r.choice(["", "", ".", ","])
            else:
                piece = prose()
            parts.append(piece)
            at += len(piece) + 1
        rows.append((" ".join(parts), spans))
    return rows


@functools.cache
def default_model() -> tuple[list[list[np.ndarray]], np.ndarray]:
    return train(labelled_table())


def field_spans(texts: list[str], tables: list[list[np.ndarray]], moves: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind's number, end) of what the field finds in each text."""
    starts, ends, text_of, features = words_of(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(starts):
        return found
    tags = viterbi(emissions(features, text_of, tables), text_of, moves)
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    hits = np.flatnonzero(tags)
    if not len(hits):
        return found
    breaks = (np.diff(hits) > 1) | (np.diff(tags[hits]) != 0) | (np.diff(text_of[hits]) != 0)
    for run in np.split(hits, np.flatnonzero(breaks) + 1):
        k = int(text_of[run[0]])
        text, a, b = texts[k], int(starts[run[0]] - begin[k]), int(ends[run[-1]] - begin[k])
        kind = _TAG_KIND[int(tags[run[0]])]
        if kind == "secret" and (cut := max(text.rfind(c, a, b) for c in "=:")) >= 0 and b - cut > 8:
            a = cut + 1
        while b > a and text[b - 1] in ".,;:!?\"'":
            b -= 1
        while a < b and text[a] in "\"'":
            a += 1
        if b > a:
            found[k].append((a, KINDS.index(kind), b))
    return found


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find(docs: DataFrame, model: tuple[list[list[np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (found by pattern), base_sha256, spans, n_added."""
    bounded_batches(docs.sparkSession)
    tables, moves = model or default_model()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHARS):
                texts = part.column(1).to_pylist()
                columns: list[list] = [[] for _ in _OUT]
                for doc, text, more in zip(part.column(0).to_pylist(), texts, field_spans(texts, tables, moves), strict=True):
                    base = base_spans(text)
                    added = [s for s in more if not any(a < s[2] and s[0] < b for a, _, b in base)]
                    counts = [sum(k == n for _, k, _ in base) for n in range(4)]
                    row = [doc, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted(base + added)), len(added)]
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(released(scan), out)
