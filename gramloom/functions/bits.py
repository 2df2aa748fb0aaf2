"""Bit fields in longs, as stored models use them. Parquet packs our tables itself; these show and take apart such fields."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def required_bits(value: Column) -> Column:
    """Bits that hold the whole number: 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("int")


def mask(bits: int) -> int:
    return (1 << bits) - 1


def pack(high: Column, low: Column, low_bits: int) -> Column:
    """high above low in one long; up to 57 bits together."""
    return F.shiftleft(high.cast("long"), low_bits).bitwiseOR(low.cast("long"))


def unpack(packed: Column, low_bits: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, low_bits), packed.bitwiseAND(F.lit(mask(low_bits)).cast("long"))


class BitField:
    """A row of bit fields in memory, little-endian; fields may cross bytes."""

    def __init__(self, n_bytes: int):
        self.data = bytearray(n_bytes + 8)

    def write(self, at: int, bits: int, value: int) -> None:
        if not 0 <= value <= mask(bits):
            raise ValueError(f"{value} doesn't fit {bits} bits")
        held = int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little")
        self.data[at >> 3 : (at >> 3) + 8] = (held | value << (at & 7)).to_bytes(8, "little")

    def read(self, at: int, bits: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & mask(bits)

    def write_float(self, at: int, value: float) -> None:
        self.write(at, 32, struct.unpack("<I", struct.pack("<f", value))[0])

    def read_float(self, at: int) -> float:
        return struct.unpack("<f", struct.pack("<I", self.read(at, 32)))[0]

    def write_negative(self, at: int, value: float) -> None:
        """A number of at most 0 without its sign, in 31 bits."""
        self.write(at, 31, struct.unpack("<I", struct.pack("<f", value))[0] & mask(31))

    def read_negative(self, at: int) -> float:
        return struct.unpack("<f", struct.pack("<I", self.read(at, 31) | 1 << 31))[0]


class Chopped:
    """A rising list of whole numbers without their high parts, which are told by where each of them sets in.

    Of a number only low_bits are held, and one place for each high part up to the last; fewest_bits() weighs both.
    """

    def __init__(self, values: np.ndarray, low_bits: int | None = None):
        values = np.asarray(values, np.int64)
        if len(values) and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the numbers must rise from 0")
        self.low_bits = self.fewest_bits(values) if low_bits is None else low_bits
        self.low = values & mask(self.low_bits)
        highest = int(values[-1]) >> self.low_bits if len(values) else 0
        self.starts = np.searchsorted(values >> self.low_bits, np.arange(1, highest + 1))

    @staticmethod
    def fewest_bits(values: np.ndarray) -> int:
        most = int(values[-1]) if len(values) else 0
        return min(range(most.bit_length() + 1), key=lambda b: len(values) * b + (most >> b) * 64)

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, place: int | np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts, place, "right")
        return self.low[place] | (high << self.low_bits)

    def find(self, value: int) -> int:
        """The first place of a number; -1 if it's not there."""
        high = value >> self.low_bits
        a = self.starts[high - 1] if 0 < high <= len(self.starts) else 0 if high <= 0 else len(self.low)
        z = self.starts[high] if 0 <= high < len(self.starts) else len(self.low)
        at = a + int(np.searchsorted(self.low[a:z], value & mask(self.low_bits)))
        return at if at < len(self.low) and self[at] == value else -1

    @property
    def bits(self) -> int:
        return len(self.low) * self.low_bits + 64 * len(self.starts)
