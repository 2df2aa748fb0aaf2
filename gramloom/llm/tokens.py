"""Token ids of whole texts by a public tokenizer file, many texts at once.

Texts of ASCII and the Latin letters of western Europe are cut into the tokenizer's pieces by numpy over their bytes, each
distinct piece of a chunk is merged once by the file's own merges, and the ids are dealt back. Pieces are found again by a
64-bit hash, and their bytes are compared. All other texts (other scripts, contractions, pieces of over 256 bytes, texts
that hold an added token such as <|endoftext|>, pieces that share a hash with another) go to the tokenizers library as
they are. The library alone takes 1,900
to 2,600 CPU seconds a GB of these texts; tests hold both against each other.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from gramloom.llm.common import chunks

#: Characters of a chunk: more find more pieces that are the same, and take more memory (about 60 bytes each).
CHUNK_CHARS = 800_000
#: Bytes of the longest piece that numpy merges; the library's time doesn't grow with the square of a piece.
LONGEST = 256

#: Pieces whose ids a worker keeps, about 60 bytes each; beyond that it starts anew.
KNOWN_PIECES = 600_000

_CONTRACTION = re.compile(r"'(?:[stmdSTMD]|re|ve|ll|[Rr][Ee]|[Vv][Ee]|[Ll][Ll])")
_LETTER, _DIGIT, _OTHER, _WHITE, _BAD = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[32, *range(9, 14)]] = _WHITE
_KIND[[*range(0x1C, 0x20), *(b for b in range(0xC0, 256) if b != 0xC3)]] = _BAD
_NEVER = np.int32(2**31 - 1)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) if b in own else chr(256 + sum(x not in own for x in range(b))) for b in range(256)}


class Merges:
    """The merges of a tokenizer file applied to many words at once: in each round every word merges its best pair.

    A merge's result takes part only in later merges, so a round may merge all places of a word's best pair together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", _byte_letters()
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(letters[b] + suffix, -1) for b in range(256)], np.int32)
        self.n = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[by], by.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # A table by hashed key answers most lookups at once; where keys share a slot, the sorted keys decide.
        slots = self._slot(self.keys)
        self.slot_key, self.slot_rank = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int32)
        self.slot_key[slots], self.slot_rank[slots] = self.keys, self.ranks
        self.shared = np.bincount(slots, minlength=1 << 18) > 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        rank = np.where(self.slot_key[slots] == keys, self.slot_rank[slots], _NEVER)
        odd = np.flatnonzero((rank == _NEVER) & self.shared[slots])
        if len(odd):
            at = np.minimum(np.searchsorted(self.keys, keys[odd]), len(self.keys) - 1)
            rank[odd] = np.where(self.keys[at] == keys[odd], self.ranks[at], _NEVER)
        return rank

    def words(self, flat: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """flat: the bytes of all words, of at least one byte each. Their ids, one word after the other, and the ids' counts."""
        raw = np.frombuffer(flat, np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(symbols), _NEVER, np.int32)  # of the pair that starts here
        changed = np.arange(len(symbols))
        done_words, done_symbols = [], []
        while len(symbols):
            changed = changed[changed < len(symbols) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self._rank(symbols[changed].astype(np.int64) * self.n + symbols[changed + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            going = best != _NEVER
            done_words.append(word[~going])
            done_symbols.append(symbols[~going])
            hit = (rank == best) & going
            if (hit[:-1] & hit[1:]).any():  # a pair of equal symbols in a row of three or more: every other place
                place = np.arange(len(hit))
                hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            rank[at] = _NEVER
            going[at + 1] = False
            symbols, word, rank = symbols[going], word[going], rank[going]
            changed = np.flatnonzero(hit[going])
            before = changed[changed > 0] - 1
            rank[before] = _NEVER
            changed = np.concatenate([changed, before])
        words, symbols = np.concatenate([*done_words, word]), np.concatenate([*done_symbols, symbols])
        by = np.argsort(words, kind="stable")
        return symbols[by].astype(np.uint32), np.bincount(words, minlength=len(sizes))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all elements of runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _equal(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether runs of bytes of a and of b, of one byte at least, are equal."""
    out = a_sizes == b_sizes
    look = np.flatnonzero(out & ((a_starts != b_starts) | (a is not b)))
    if len(look):
        sizes = a_sizes[look]
        differ = a[_spread(a_starts[look], sizes)] != b[_spread(b_starts[look], sizes)]
        out[look] = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
    return out


class TokenIds:
    """ids(texts): the uint32 ids of each text, as the library gives them with add_special_tokens=False."""

    mask = np.uint64(2**64 - 1)  # of the hash; tests let pieces collide

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.n = 1 + max(self.library.get_vocab(with_added_tokens=True).values())  # ids are below
        self.lower = "Lowercase" in str(self.library.normalizer or "")
        added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(added)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.spaced = not self.lower  # white space is part of the ids
        self._forget()

    def _has_added(self, text: str) -> bool:
        return self.sign in text and bool(self.added.search(text))

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Places of pieces met before; -1 for others."""
        at = np.minimum(np.searchsorted(self.met, keys), len(self.met) - 1)
        return np.where(self.met[at] == keys, at, -1)

    def _forget(self) -> None:
        self.met, self.starts, self.sizes, self.flat = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.byte_starts, self.byte_sizes, self.bytes = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _learn(self, keys: np.ndarray, letters: np.ndarray, n_letters: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        join = lambda name, new: setattr(self, name, np.concatenate([getattr(self, name), new]))
        join("starts", np.cumsum(sizes) - sizes + len(self.flat))
        join("byte_starts", np.cumsum(n_letters) - n_letters + len(self.bytes))
        for name, new in (("met", keys), ("sizes", sizes), ("byte_sizes", n_letters), ("flat", ids), ("bytes", letters)):
            join(name, new)
        by = np.argsort(self.met, kind="stable")
        for name in ("met", "starts", "sizes", "byte_starts", "byte_sizes"):
            setattr(self, name, getattr(self, name)[by])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and which bytes belong to none. begins: the texts' first bytes."""
        kind = _KIND[raw]
        start = np.concatenate([[True], kind[1:] != kind[:-1]])
        start[begins] = True
        white = kind == _WHITE
        if not self.spaced:
            start |= kind == _DIGIT
            return start, white
        last = np.concatenate([white[:-1] & ~white[1:], [False]])  # white space before something else
        last[begins[1:] - 1] = False  # of the same text
        start |= last
        after = np.flatnonzero(last)
        start[after[raw[after] == 32] + 1] = False
        return start, np.zeros(0, bool)

    def _many(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of texts none of which is empty; None for those that only the library can do."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        c3 = np.flatnonzero(raw == 0xC3)
        bad = _KIND[raw] == _BAD
        bad |= (raw >= 0x80) & (raw < 0xC0) & np.concatenate([[True], raw[:-1] != 0xC3])
        bad[c3[np.isin(raw[c3 + 1], (0x97, 0xB7))]] = True
        if self.lower:
            raw = raw.copy()
            raw[(raw >= 65) & (raw <= 90)] += 32
            big = c3[raw[c3 + 1] < 0x9F] + 1
            raw[big] += 32
        start, dropped = self._pieces(raw, begins)
        place = np.flatnonzero(start)
        long = np.diff(np.append(place, len(raw)))
        text_of = np.searchsorted(begins, place, "right") - 1
        alone = np.logical_or.reduceat(bad, begins)
        alone[text_of[long > LONGEST]] = True
        keep = ~alone[text_of]
        if len(dropped):
            keep &= ~dropped[place]
        inside = np.arange(len(raw)) - np.repeat(place, long)
        power = np.cumprod(np.full(min(int(long.max()), len(raw)), 0x9E3779B97F4A7C15, np.uint64)) if len(raw) else np.zeros(0, np.uint64)
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * power[inside]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        keys = np.add.reduceat(mixed, place)[keep] & self.mask
        place, long, text_of = place[keep], long[keep], text_of[keep]
        order = np.argsort(keys)
        new = np.concatenate([[True], np.diff(keys[order]) != 0])[: len(keys)]
        first, same = order[new], np.empty(len(keys), np.int64)
        same[order] = np.cumsum(new) - 1
        keys = keys[first]
        # A piece that only shares another's hash is left to the library, with its text.
        odd = ~_equal(raw, place, long, raw, place[first][same], long[first][same])
        known = self._known(keys)
        old = np.flatnonzero(known >= 0)
        clash = old[~_equal(raw, place[first[old]], long[first[old]], self.bytes, self.byte_starts[known[old]], self.byte_sizes[known[old]])]
        odd |= np.isin(same, clash)
        alone[text_of[odd]] = True
        fresh = first[known < 0]
        n = long[fresh]
        letters = raw[_spread(place[fresh], n)]
        self._learn(keys[known < 0], letters, n, *self.merges.words(letters.tobytes(), n))
        known = self._known(keys)[same]
        take = self.sizes[known]
        total = np.cumsum(take)
        out = self.flat[np.repeat(self.starts[known] - (total - take), take) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.concatenate([[0], total])[np.searchsorted(text_of, np.arange(len(texts) + 1))]
        return [None if alone[k] else out[cuts[k] : cuts[k + 1]] for k in range(len(texts))]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        for a, b in chunks(texts, CHUNK_CHARS):
            if len(self.met) > KNOWN_PIECES:
                self._forget()
            fit = [k for k in range(a, b) if texts[k] and not _CONTRACTION.search(texts[k]) and not self._has_added(texts[k].lower())]
            if fit:
                for k, got in zip(fit, self._many([texts[k].encode() for k in fit]), strict=True):
                    out[k] = got
        return [self._whole(t) if got is None else got for t, got in zip(texts, out, strict=True)]


_LOADED: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """The worker's own, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]
