"""Order by hash: the same in any engine, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int | str | Column, *ids: Column) -> Column:
    """md5 of seed:id:..., as hexadecimal text."""
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head, *(i.cast("string") for i in ids)))


def seeded_int(seed: int | str | Column, *ids: Column) -> Column:
    """The first 32 bits of that, as a bigint."""
    return F.conv(F.substring(seeded(seed, *ids), 1, 8), 16, 10).cast("bigint")
