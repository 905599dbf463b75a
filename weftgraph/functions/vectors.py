"""Arrays as vectors and as saturating counters, and sorted arrays as sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def random_vector(size: int, seed: int) -> Column:
    """Uniform values in [0, 1)."""
    return F.array(*[F.rand(seed + i) for i in range(size)])


def encode(value: Column, domain: tuple[str, ...]) -> Column:
    """Code of a categorical value, from 0; -1 for a value outside the domain, null for null."""
    return (F.array_position(F.array(*map(F.lit, domain)), value) - 1).cast("int")


def decode(code: Column, domain: tuple[str, ...]) -> Column:
    """Value of a categorical code; null outside the domain."""
    return F.get(F.array(*map(F.lit, domain)), code.cast("int"))


def _most(bits: int) -> int:
    return (1 << bits) - 1


def saturate(counters: Column, bits: int) -> Column:
    return F.transform(counters, lambda x: F.least(x.cast("int"), F.lit(_most(bits))))


def set_counter(counters: Column, i: int, value: Column, bits: int) -> Column:
    return F.transform(counters, lambda x, k: F.when(k == i, F.least(value.cast("int"), F.lit(_most(bits)))).otherwise(x.cast("int")))


def increment(counters: Column, i: int, bits: int) -> Column:
    return set_counter(counters, i, F.get(counters, F.lit(i)).cast("int") + 1, bits)


def increment_all(counters: Column, bits: int) -> Column:
    return F.transform(counters, lambda x: F.least(x.cast("int") + 1, F.lit(_most(bits))))


def increment_nonzero(counters: Column, bits: int) -> Column:
    return F.transform(counters, lambda x: F.when(x != 0, F.least(x.cast("int") + 1, F.lit(_most(bits)))).otherwise(0))


def closer(own: Column, other: Column, bits: int) -> Column:
    """Pointwise least of a counter and the other's plus one, where 0 means not reached."""

    def one(x: Column, y: Column) -> Column:
        step = F.when(y != 0, F.least(y.cast("int") + 1, F.lit(_most(bits))))
        return F.coalesce(F.least(F.when(x != 0, x.cast("int")), step), F.lit(0))

    return F.zip_with(own, other, one)


def gaps(sequence: Column) -> Column:
    """An increasing sequence as its first value and the gaps that follow."""
    return F.transform(sequence, lambda x, i: x - F.when(i > 0, F.get(sequence, i - 1)).otherwise(F.lit(0)))


def from_gaps(gap: Column) -> Column:
    """The increasing sequence of ``gaps``."""
    grow = F.aggregate(
        gap, F.array().cast("array<bigint>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x))
    )
    return grow


def lower_bound(sequence: Column, value: Column, most: int = 1 << 31) -> Column:
    """Index of the last entry of a sorted array that is at most ``value``, -1 if none: a binary search within the row."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(sequence, at + s - 1) <= value, at + s).otherwise(at)) - 1


def index_of(sequence: Column, value: Column) -> Column:
    """Index of ``value`` in a sorted array, -1 if it is not there."""
    at = lower_bound(sequence, value)
    return F.when(F.get(sequence, at) == value, at).otherwise(F.lit(-1))
