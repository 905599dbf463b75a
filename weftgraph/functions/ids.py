"""Balanced ids: a permutation of the id space that spreads neighbours over equal intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class IdMap:
    """``intervals`` intervals of ``length`` ids; ``length`` 0 is the identity."""

    def __init__(self, length: int, intervals: int):
        self.length, self.intervals = length, intervals

    def forward(self, original: Column) -> Column:
        if not self.length:
            return original
        return (original % self.intervals) * self.length + _div(original, self.intervals)

    def backward(self, internal: Column) -> Column:
        if not self.length:
            return internal
        return (internal % self.length) * self.intervals + _div(internal, self.length)

    def to_string(self) -> str:
        return f"{self.length} {self.intervals}"

    @classmethod
    def from_string(cls, text: str) -> IdMap:
        length, intervals = text.split()
        return cls(int(length), int(intervals))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def interval_of(vertex: Column, length: int) -> Column:
    """The interval an id lies in, for tables partitioned by ranges of ids."""
    return _div(vertex, length)


def intervals(last: int, count: int) -> list[tuple[int, int]]:
    """Equal inclusive intervals that cover ids 0 to ``last``."""
    width = last // count + 1
    return [(i * width, min(last, (i + 1) * width - 1)) for i in range(count) if i * width <= last]
