"""64-bit hashes that wrap around, vectorised by numpy over Arrow batches (SQL arithmetic would overflow).

Results are longs with the hash's bits; unsigned() shows them as whole numbers from 0.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash functions.
MURMUR_M, MURMUR_R = 0xC6A4A7935BD1E995, 47
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CHAIN_LEFT, CHAIN_RIGHT = 8978948897894561157, 17894857484156487943
UNK_HASH, UNK_CAPITAL_HASH = 0xEA91E7561F5B392B, 0x7E163219007D2F54


def murmur64_many(data: list[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """MurmurHash64A of each string; all strings that have an i-th block of 8 bytes mix it at once."""
    m, r = np.uint64(MURMUR_M), np.uint64(MURMUR_R)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    blocks = sizes // 8
    starts = np.cumsum(blocks * 8 + 8) - (blocks * 8 + 8)
    flat = np.frombuffer(b"".join(d + bytes(8 - len(d) % 8) for d in data), "<u8") if data else np.zeros(0, "<u8")
    at = starts // 8
    h = (np.zeros(len(data), np.uint64) + np.asarray(seeds).astype(np.uint64)) ^ (sizes.astype(np.uint64) * m)
    for i in range(int(blocks.max(initial=0))):
        k = np.flatnonzero(blocks > i)
        x = flat[at[k] + i] * m
        x = (x ^ (x >> r)) * m
        h[k] = (h[k] ^ x) * m
    k = np.flatnonzero(sizes % 8 > 0)
    h[k] = (h[k] ^ flat[at[k] + blocks[k]]) * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def fnv1a_many(ids: list) -> np.ndarray:
    """FNV-1a over the little-endian 4-byte ids of each list."""
    out = np.full(len(ids), FNV_OFFSET, np.uint64)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    for i in range(int(sizes.max(initial=0))):
        k = np.flatnonzero(sizes > i)
        word = np.fromiter((ids[j][i] for j in k), np.uint64, len(k))
        for byte in range(4):
            out[k] = (out[k] ^ ((word >> np.uint64(8 * byte)) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return out


def chain_many(ids: list) -> np.ndarray:
    """The chained word hash: the first id, then each further one mixed in."""
    out = np.fromiter((x[0] if len(x) else 0 for x in ids), np.uint64, len(ids))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    for i in range(1, int(sizes.max(initial=0))):
        k = np.flatnonzero(sizes > i)
        word = np.fromiter((ids[j][i] for j in k), np.uint64, len(k))
        out[k] = (out[k] * np.uint64(CHAIN_LEFT)) ^ ((word + np.uint64(1)) * np.uint64(CHAIN_RIGHT))
    return out


def fnv1a_columns(ids: list[np.ndarray]) -> np.ndarray:
    """fnv1a_many() of lists of one length, given place by place."""
    out = np.full(len(ids[0]), FNV_OFFSET, np.uint64)
    for word in ids:
        for byte in range(4):
            out = (out ^ ((word.astype(np.uint64) >> np.uint64(8 * byte)) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return out


def chain_columns(ids: list[np.ndarray]) -> np.ndarray:
    """chain_many() of lists of one length, given place by place."""
    out = ids[0].astype(np.uint64)
    for word in ids[1:]:
        out = (out * np.uint64(CHAIN_LEFT)) ^ ((word.astype(np.uint64) + np.uint64(1)) * np.uint64(CHAIN_RIGHT))
    return out


def _over(values: pd.Series, run) -> pd.Series:
    there = values.notna().to_numpy()
    out = np.zeros(len(values), np.int64)
    out[there] = run(list(values[there])).view(np.int64)
    return pd.Series(pd.arrays.IntegerArray(out, ~there))


def murmur64(column: Column | str, seed: int = 0) -> Column:
    """MurmurHash64A of a string's UTF-8 bytes."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return _over(values, lambda x: murmur64_many([v.encode() for v in x], seed))

    return run(column)


def fnv1a(ids: Column | str) -> Column:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return _over(values, fnv1a_many)

    return run(ids)


def chain(ids: Column | str) -> Column:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return _over(values, chain_many)

    return run(ids)


def vocab_hash(word: Column | str) -> Column:
    """The hash by which a sorted vocabulary finds a word; both spellings of the unknown word have the id 0."""
    return murmur64(word)


def state_hash(pointers: Column, full: Column) -> Column:
    """The hash of a left state: its length and fullness as two bytes, seeded by its last pointer."""

    @F.pandas_udf("long")
    def run(seeds: pd.Series, sizes: pd.Series, whole: pd.Series) -> pd.Series:
        data = [bytes([int(n), int(f)]) for n, f in zip(sizes, whole, strict=True)]
        return pd.Series(murmur64_many(data, seeds.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return run(F.coalesce(F.try_element_at(pointers, F.lit(-1)), F.lit(0)).cast("long"), F.size(pointers), full)


def chart_hash(pointers: Column, full: Column, right: Column) -> Column:
    """The hash of a chart state: its right state's word ids, 4 little-endian bytes each, seeded by the hash of its left state."""

    @F.pandas_udf("long")
    def run(seeds: pd.Series, words: pd.Series) -> pd.Series:
        data = [np.asarray(w, "<u4").tobytes() for w in words]
        return pd.Series(murmur64_many(data, seeds.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return run(state_hash(pointers, full), right)


def unsigned(h: Column | str) -> Column:
    """A long's bits as a whole number from 0, for output and for ordering."""
    c = (F.col(h) if isinstance(h, str) else h).cast("decimal(20,0)")
    return F.when(c < 0, c + F.lit(Decimal(2**64))).otherwise(c).cast("decimal(20,0)")
