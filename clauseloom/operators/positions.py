"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom.session import cut

#: ``monotonically_increasing_id`` counts rows in the lower 33 bits, partitions above them.
_LOW = 33


def numbered(frame: DataFrame, by: list[str], order: list[Column | str], name: str,
             size: str | None = None) -> DataFrame:
    """Add ``name``, the row's place from 0 in its group, and on demand the group's ``size``.

    Rows are ordered by range, so one group spreads over as many tasks as its rows need
    and no window holds it.  They are written in that order with their place in the
    partition; the rows of the group in earlier partitions, a table of a row per group
    and partition, give the offset.  That table is written too: Spark then knows how small it is, and
    leaves the rows where they lie instead of shuffling them to it.  A null key is a group.  The order should be total;
    rows alike in it are numbered as they come.
    """
    width = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(frame.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
                 .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOW).cast("int")
    place = F.col("_at").bitwiseAND(F.lit((1 << _LOW) - 1))
    stretches = cut(placed.groupBy(*by, part.alias("_part")).agg(
        F.min(place).alias("_first"), F.count("*").alias("_rows")))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
        F.sum("_rows").over(group).alias("_size"))
    same = part == F.col("_in")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    found = placed.join(offsets, same)
    added = [(place + F.col("_offset")).cast("long").alias(name)]
    if size:
        added.append(F.col("_size").cast("long").alias(size))
    return found.select(*[F.col(c) for c in frame.columns if c not in (name, size)], *added)
