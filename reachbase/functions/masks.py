"""Access masks as Column expressions: unsigned 32-bit sets held in longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-system rights and what generic rights stand for.
GENERIC_READ, GENERIC_WRITE, GENERIC_EXECUTE, GENERIC_ALL = 0x80000000, 0x40000000, 0x20000000, 0x10000000
GENERIC = GENERIC_READ | GENERIC_WRITE | GENERIC_EXECUTE | GENERIC_ALL
FILE_READ, FILE_WRITE, FILE_EXECUTE, FILE_ALL = 0x00120089, 0x00120116, 0x001200A0, 0x001F01FF
MAXIMUM_ALLOWED, SYNCHRONIZE = 0x02000000, 0x00100000
READ_CONTROL, WRITE_DAC, WRITE_OWNER = 0x00020000, 0x00040000, 0x00080000
OWNER_IMPLICIT, ESCALATION = READ_CONTROL | WRITE_DAC, WRITE_DAC | WRITE_OWNER
KNOWN = 0x001F01FF | GENERIC | 0x01000000 | MAXIMUM_ALLOWED
SHARE_LEVELS = {"read": 0x001200A9, "change": 0x001301BF, "full": 0x001F01FF}
#: From the broadest on: the bits that a mask must hold.
CATEGORIES = {"full_control": 0x000F01FF, "modify": 0x000301BF, "read_execute": 0x000200A9, "write": 0x00000116, "read": 0x00020089, "traverse": 0x00000020}
OBJECT_INHERIT, CONTAINER_INHERIT, NO_PROPAGATE, INHERIT_ONLY, INHERITED = 1, 2, 4, 8, 16
FULL_32 = 0xFFFFFFFF


def _long(x: Column | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def union(a: Column, b: Column | int) -> Column:
    return a.bitwiseOR(_long(b))


def meet(a: Column, b: Column | int) -> Column:
    return a.bitwiseAND(_long(b))


def minus(a: Column, b: Column | int) -> Column:
    """The bits of a that are not in b."""
    return a.bitwiseAND(F.bitwise_not(_long(b))).bitwiseAND(_long(FULL_32))


def holds(a: Column, bits: Column | int) -> Column:
    return meet(a, bits) == _long(bits)


def has(a: Column, bits: int) -> Column:
    return meet(a, bits) != 0


def expand_generic(mask: Column) -> Column:
    """Generic rights replaced by the file rights that they stand for; expanding twice changes nothing."""
    out = minus(mask, GENERIC)
    for bit, stands_for in ((GENERIC_READ, FILE_READ), (GENERIC_WRITE, FILE_WRITE), (GENERIC_EXECUTE, FILE_EXECUTE), (GENERIC_ALL, FILE_ALL)):
        out = union(out, F.when(has(mask, bit), _long(stands_for)).otherwise(_long(0)))
    return out


def normalised(mask: Column) -> dict[str, Column]:
    """What a raw mask means, and what is noted about it."""
    full = expand_generic(mask)
    return {"mask": full, "was_generic": has(mask, GENERIC), "unknown_bits": minus(full, KNOWN), "indeterminate": has(mask, MAXIMUM_ALLOWED)}


def share_mask(level: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, mask in SHARE_LEVELS.items():
        out = F.when(level == name, _long(mask)).otherwise(out)
    return out


def share_level(mask: Column) -> Column:
    """The level that a share mask is exactly, else 'custom'."""
    out = F.lit("custom")
    for name, bits in SHARE_LEVELS.items():
        out = F.when(mask == bits, F.lit(name)).otherwise(out)
    return out


def category(mask: Column) -> Column:
    """The broadest category that the mask holds; 'special' if it holds none, 'none' if empty."""
    out = F.when(minus(mask, SYNCHRONIZE) == 0, F.lit("none")).otherwise(F.lit("special"))
    for name, bits in reversed(CATEGORIES.items()):
        out = F.when(holds(mask, bits), F.lit(name)).otherwise(out)
    return out


def categories(mask: Column) -> Column:
    """The categories held that no broader one held covers, broadest first."""
    names = list(CATEGORIES)
    found = []
    for i, name in enumerate(names):
        covered = F.lit(False)
        for broader in names[:i]:
            if CATEGORIES[broader] & CATEGORIES[name] == CATEGORIES[name]:
                covered = covered | holds(mask, CATEGORIES[broader])
        found.append(F.when(holds(mask, CATEGORIES[name]) & ~covered, F.lit(name)))
    return F.array_compact(F.array(*found))


def extra_bits(mask: Column) -> Column:
    """Rights that none of the categories held accounts for, the wait right aside."""
    covered = _long(SYNCHRONIZE)
    for bits in CATEGORIES.values():
        covered = union(covered, F.when(holds(mask, bits), _long(bits)).otherwise(_long(0)))
    return minus(mask, covered)


def hex_mask(mask: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(mask)), digits, "0"))
