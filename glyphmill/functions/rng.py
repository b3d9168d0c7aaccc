"""Random numbers from keys: the same for a row wherever and however often it is computed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seed that operators use unless told otherwise.
SEED = 114514


def _part(x: Column | str | int) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def digest(*parts: Column | str | int) -> Column:
    """SHA-1, in hexadecimal digits, of the parts joined by colons."""
    return F.sha1(F.concat_ws(":", *map(_part, parts)).cast("binary"))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the parts: the first 32 bits of their digest."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def prefix(*parts: Column | str | int) -> Column:
    """What the digests of the parts and one more begin with, for under()."""
    return F.concat(F.concat_ws(":", *map(_part, parts)), F.lit(":")).cast("binary")


def under(p: float, before: Column, i: Column) -> Column:
    """Whether uniform(*parts, i) < p, where before is prefix(*parts): by the digits themselves, which need not become a number first."""
    limit = math.ceil(p * 4294967296)
    return F.lit(limit > 0) if limit <= 0 or limit > 0xFFFFFFFF else F.sha1(F.concat(before, i.cast("string").cast("binary"))) < F.lit(f"{limit:08x}")


def below(n: Column | int, *parts: Column | str | int) -> Column:
    """A whole number in [0, n)."""
    return F.floor(uniform(*parts) * n).cast("int")
