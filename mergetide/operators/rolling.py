"""Averages over a trailing range of time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.functions.dates import order_key
from mergetide.operators.keys import join_null_safe

# Up to this many distinct instants of a key may meet in one task.
INSTANTS_PER_TASK = 4_000_000


def _mean(total: Column, count: Column) -> Column:
    """One division at the end: a decimal sum stays exact, whatever the order it was taken in."""
    return F.when(count > 0, total.cast("double") / count)


def _floor_div(value: str, size: int) -> Column:
    return F.expr(f"({value} - pmod({value}, {size}L)) div {size}L")


def _slices(width: int) -> tuple[int, int]:
    """A slice of about the root of ``width``, and what whole slices leave of it: nothing, or 2 at least."""
    root = math.isqrt(width)
    for size in range(root, max(root // 2, 1), -1):
        if width % size == 0:
            return size, 0
    size = max(root, 2)
    return size, width % size + (size if width % size == 1 else 0)


def _self_asked(facts: DataFrame, by: Sequence[str], width: int, shift: int = 0) -> DataFrame:
    """Facts together with the two ends of a frame at each fact's time, moved by ``shift``."""
    at = F.col("_t") + shift
    none = F.lit(None)
    no_sum, no_n = none.cast(facts.schema["_sum"].dataType).alias("_sum"), none.cast("long").alias("_n")
    fact = F.struct("_t", none.cast("boolean").alias("_head"), none.cast("long").alias("_at"), "_sum", "_n")
    head = F.struct(at.alias("_t"), F.lit(True).alias("_head"), at.alias("_at"), no_sum, no_n)
    tail = F.struct((at - width).alias("_t"), F.lit(False).alias("_head"), at.alias("_at"), no_sum, no_n)
    return facts.select(*by, F.inline(F.when(at.isNull(), F.array(fact, head)).otherwise(F.array(fact, head, tail))))


def _asked_by(facts: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """Facts together with the two ends of a frame at each probe's ``_at``."""
    at = F.col("_at")
    head = F.struct(at.alias("_t"), F.lit(True).alias("_head"))
    tail = F.struct((at - width).alias("_t"), F.lit(False).alias("_head"))
    # Without a time there is no frame: such probes see the facts without a time.
    ends = F.when(at.isNull(), F.array(head)).otherwise(F.array(head, tail))
    return facts.unionByName(probes.select("*", F.inline(ends)), allowMissingColumns=True)


def _end_sums(rows: DataFrame, by: Sequence[str], bucket: int, opening: DataFrame | None = None) -> DataFrame:
    """The ends of frames, each with the ``_sum`` and ``_n`` of the facts it covers of its bucket.

    A head covers the facts from the start of the bucket up to it, a tail those
    from it to the end of the bucket. With buckets as wide as the frame, head and
    tail lie in neighbouring buckets and make up the whole frame. Both are running
    sums, so the work is linear (Spark computes a sliding frame anew for every
    row), and sums are only ever added, never subtracted. ``opening`` adds facts
    that every head of a bucket covers.
    """
    rows = rows.withColumn("_bucket", _floor_div("_t", bucket))
    if opening is not None:
        rows = rows.unionByName(opening, allowMissingColumns=True)
    group = Window.partitionBy(*by, "_bucket")
    running = Window.unboundedPreceding, Window.currentRow
    # Openings have no time: first from the front, last and so out of reach from the back.
    front = group.orderBy(F.asc_nulls_first("_t")).rangeBetween(*running)
    back = group.orderBy(F.desc_nulls_last("_t")).rangeBetween(*running)

    def covered(column: str) -> Column:
        return F.when(F.col("_head"), F.sum(column).over(front)).otherwise(F.sum(column).over(back))

    sums = rows.withColumns({"_covered": covered("_sum"), "_covered_n": covered("_n")})
    return (
        sums.where(F.col("_head").isNotNull())
        .drop("_sum", "_n", "_t", "_head", "_bucket")
        .withColumnsRenamed({"_covered": "_sum", "_covered_n": "_n"})
    )


def _frame_sums(
    instants: DataFrame, probes: DataFrame | None, by: Sequence[str], width: int, grain: int
) -> DataFrame:
    """``probes`` (by default the instants themselves) with parts that add up to the facts of their frames."""
    if width // grain <= INSTANTS_PER_TASK or math.isqrt(width) < 3:
        rows = _self_asked(instants, by, width) if probes is None else _asked_by(instants, probes, width)
        return _end_sums(rows, by, width)
    slice_width, rest = _slices(width)
    if rest:
        # [at - width, at] is [at - main, at] and, before it, a short frame that ends where that begins.
        main = width - rest
        asked = instants.select(*by, F.col("_t").alias("_at")) if probes is None else probes
        ended = asked.where(F.col("_at").isNotNull()).withColumn("_at", F.col("_at") - (main + 1))
        older = _end_sums(_asked_by(instants, ended, rest - 1), by, rest - 1).withColumn("_at", F.col("_at") + (main + 1))
        return _sliced_sums(instants, probes, by, main, slice_width).unionByName(older)
    return _sliced_sums(instants, probes, by, width, slice_width)


def _sliced_sums(
    instants: DataFrame, probes: DataFrame | None, by: Sequence[str], width: int, slice_width: int
) -> DataFrame:
    """``_frame_sums`` of a width that is a whole number of slices, three at least."""
    rows = _self_asked(instants, by, width) if probes is None else _asked_by(instants, probes, width)
    slices = width // slice_width
    # The ends reach into a slice each. The whole slices between are a frame over one sum per slice,
    # from the one after the tail's to the one before the head's, and open the head's slice.
    per_slice = (
        instants.where(F.col("_t").isNotNull())
        .groupBy(*by, _floor_div("_t", slice_width).alias("_t"))
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    )
    between = slices - 2
    if probes is None:
        slice_rows = _self_asked(per_slice, by, between, shift=-1)
    else:
        before = (_floor_div("_at", slice_width) - 1).alias("_at")
        slice_rows = _asked_by(per_slice, probes.where(F.col("_at").isNotNull()).select(*by, before).distinct(), between)
    opening = _end_sums(slice_rows, by, between).select(
        *by, (F.col("_at") + 1).alias("_bucket"), F.lit(None).cast("long").alias("_t"), "_sum", "_n"
    )
    return _end_sums(rows, by, slice_width, opening)


def _instants(facts: DataFrame, by: Sequence[str], on: str, value: str, weight: str | None = None) -> DataFrame:
    t = order_key(facts, on).alias("_t")
    if weight is None:
        return facts.groupBy(*by, t).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    counted = F.when(F.col(value).isNotNull(), F.col(weight).cast("long"))
    return facts.groupBy(*by, t).agg(F.sum(F.col(value) * F.col(weight)).alias("_sum"), F.coalesce(F.sum(counted), F.lit(0)).alias("_n"))


def rolling_sums_at(
    facts: DataFrame,
    probes: DataFrame,
    by: Sequence[str],
    on: str,
    value: str,
    width: int,
    grain: int = 1,
    weight: str | None = None,
) -> DataFrame:
    """The distinct ``probes`` plus ``total`` and ``n``: sum and number of what ``rolling_avg_at`` averages.

    A fact counts ``weight`` times: with -1 it is taken away, as sums that are kept need it.
    """
    asked = probes.distinct().withColumn("_at", order_key(probes, on))
    parts = _frame_sums(_instants(facts, by, on, value, weight), asked, by, width, grain)
    return parts.groupBy(*probes.columns).agg(F.sum("_sum").alias("total"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def rolling_avg_at(
    facts: DataFrame,
    probes: DataFrame,
    by: Sequence[str],
    on: str,
    value: str,
    width: int,
    out: str,
    grain: int = 1,
) -> DataFrame:
    """The distinct ``probes`` plus the average ``value`` of the facts of their key in ``[on - width, on]``.

    ``width`` and ``grain`` are in microseconds for times; ``grain`` is the
    resolution the times are known to have. Both ends are inclusive and all facts
    of one instant count alike; a NULL ``on`` sees the facts without one.

    A key's history never meets in one task. Facts add up per (key, instant)
    map-side, so a hot key or instant shrinks before it is shuffled. Keys are then
    cut into buckets of ``width``. If a bucket may still hold too many instants,
    frames are put together from slices of about the root of ``width``: their two
    ends from instants, the whole slices between from one sum per slice, and what a
    width leaves over whole slices as a short frame of its own. That holds a task to a
    few million small rows of a key whatever the data and the width are like.
    """
    asked = probes.distinct().withColumn("_at", order_key(probes, on))
    parts = _frame_sums(_instants(facts, by, on, value), asked, by, width, grain)
    return parts.groupBy(*probes.columns).agg(_mean(F.sum("_sum"), F.sum("_n")).alias(out))


def rolling_range_avg(
    df: DataFrame,
    by: Sequence[str],
    on: str,
    value: str,
    width: int,
    out: str,
    method: str = "bucketed",
    grain: int = 1,
) -> DataFrame:
    """Each row plus its average over ``[on - width, on]`` within its key.

    ``"plain"`` is one window per key: one shuffle, for keys with little in a
    frame. ``"bucketed"`` holds for any key: instants are averaged as in
    ``rolling_avg_at`` and joined back, where Spark may split hot partitions.
    """
    if method == "plain":
        frame = Window.partitionBy(*by).orderBy(order_key(df, on)).rangeBetween(-width, 0)
        return df.withColumn(out, _mean(F.sum(value).over(frame), F.count(value).over(frame)))
    if method != "bucketed":
        raise ValueError("method is 'plain' or 'bucketed'")
    parts = _frame_sums(_instants(df, by, on, value), None, by, width, grain)
    averages = parts.groupBy(*by, "_at").agg(_mean(F.sum("_sum"), F.sum("_n")).alias(out))
    return join_null_safe(df.withColumn("_at", order_key(df, on)), averages, [*by, "_at"]).drop("_at")
