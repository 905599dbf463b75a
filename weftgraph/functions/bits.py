"""Bit fields, packed ids and pointers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the packed formats: bits of an id, of the auxiliary field and of the type.
ID_BITS, AUX_BITS, TYPE_BITS = 34, 26, 4
DELETED_TYPE = 15
FIRST_BUFFER = 1 << 24


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("bigint")


def low32(x: Column) -> Column:
    """The low half of a long, as a signed integer."""
    return _signed32(x.bitwiseAND(_mask(32)))


def high32(x: Column) -> Column:
    """The high half of a long, as a signed integer."""
    return F.shiftright(x, 32)


def _signed32(x: Column) -> Column:
    return F.when(x >= F.lit(1 << 31), x - F.lit(1 << 32)).otherwise(x)


def pack32(high: Column, low: Column) -> Column:
    """A long of two halves."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint").bitwiseAND(_mask(32)))


def set_low32(x: Column, low: Column) -> Column:
    return pack32(high32(x), low)


def set_high32(x: Column, high: Column) -> Column:
    return pack32(high, low32(x))


def set_bit(x: Column, i: int) -> Column:
    return x.bitwiseOR(F.shiftleft(F.lit(1).cast("bigint"), i))


def get_bit(x: Column, i: int) -> Column:
    return F.getbit(x.cast("bigint"), F.lit(i)) == 1


def int_to_bytes(x: Column) -> Column:
    """Four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint").bitwiseAND(_mask(32))), 8, "0"))


def bytes_to_int(x: Column) -> Column:
    return _signed32(F.conv(F.hex(x), 16, 10).cast("bigint")).cast("int")


def pack_vertex(vertex: Column, aux: Column, etype: Column) -> Column:
    """A vertex packet: id in the highest bits, then the auxiliary field, then the type."""
    high = F.shiftleft(vertex.cast("bigint").bitwiseAND(_mask(ID_BITS)), AUX_BITS + TYPE_BITS)
    middle = F.shiftleft(aux.cast("bigint").bitwiseAND(_mask(AUX_BITS)), TYPE_BITS)
    return high.bitwiseOR(middle).bitwiseOR(etype.cast("bigint").bitwiseAND(_mask(TYPE_BITS)))


def packet_vertex(p: Column) -> Column:
    return F.shiftright(p, AUX_BITS + TYPE_BITS).bitwiseAND(_mask(ID_BITS))


def packet_aux(p: Column) -> Column:
    return F.shiftright(p, TYPE_BITS).bitwiseAND(_mask(AUX_BITS))


def packet_type(p: Column) -> Column:
    return p.bitwiseAND(_mask(TYPE_BITS))


def packet_deleted(p: Column) -> Column:
    return packet_type(p) == DELETED_TYPE


def mark_deleted(p: Column) -> Column:
    return p.bitwiseOR(F.lit(DELETED_TYPE).cast("bigint"))


def pack_pointer(shard: Column, position: Column) -> Column:
    """An edge pointer into a shard."""
    return pack32(shard, position)


def pack_buffer_pointer(buffer: Column, position: Column) -> Column:
    """An edge pointer into an in-memory buffer."""
    return pack32(buffer.cast("bigint") + FIRST_BUFFER, position)


def pointer_is_buffer(p: Column) -> Column:
    return high32(p) >= FIRST_BUFFER


def pointer_shard(p: Column) -> Column:
    """The shard, or for a pointer into a buffer the buffer."""
    return F.when(pointer_is_buffer(p), high32(p) - FIRST_BUFFER).otherwise(high32(p))


def pointer_position(p: Column) -> Column:
    return low32(p)
