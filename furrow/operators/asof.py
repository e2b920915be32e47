"""The as-of join: for each (keys, time) that is asked for, the greatest known time of these keys strictly before it.

Times are whole numbers, cut into digits of ``BITS`` bits.  On each level a window goes over the siblings of one
block: the greatest known times of the blocks before, or on the lowest level the times themselves.  What a block
doesn't know its parent does, which is joined to it on (keys, block).  So a window never holds more than the
``1 << BITS`` children of one block, however many rows a key has, and no join key more than that either.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Children of a block, in bits, and levels of blocks: together they cover times from -2**23 to 2**23, which is any day.
BITS, LEVELS = 12, 2


def last_before(probes: DataFrame, known: DataFrame, keys: list[str], at: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Each different (keys, at) of ``probes`` with ``last``: the greatest ``at`` of ``known`` that is less, or null.

    Times must lie within ``bits * levels`` bits around 0.  Nulls in keys match nothing; null times are before nothing.
    """
    shift = 1 << (bits * levels - 1)
    whole = reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])
    asks = [probes.select(*keys, (F.col(at).cast("long") + shift).alias("at")).distinct()]
    haves = [known.where(whole).select(*keys, (F.col(at).cast("long") + shift).alias("at")).distinct().withColumn("last", F.col("at"))]
    up = F.shiftright("at", bits)
    for _ in range(levels - 1):
        asks.append(asks[-1].select(*keys, up.alias("at")).distinct())
        haves.append(haves[-1].select(*keys, up.alias("at"), "last").groupBy(*keys, "at").agg(F.max("last").alias("last")))
    siblings = Window.partitionBy(*keys, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    above: DataFrame | None = None
    for ask, have in zip(reversed(asks), reversed(haves), strict=True):
        both = ask.select(*keys, "at", F.lit(None).cast("long").alias("last"), F.lit(True).alias("asked")).unionByName(have.withColumn("asked", F.lit(False)))
        found = both.withColumn("block", up).withColumn("before", F.max("last").over(siblings)).where("asked")
        if above is not None:
            found = found.join(above, [*keys, "block"], "left").withColumn("before", F.coalesce("before", "earlier"))
        above = found.select(*keys, F.col("at").alias("block"), F.col("before").alias("earlier"))
    return above.select(*keys, (F.col("block") - shift).alias(at), (F.col("earlier") - shift).alias("last"))
