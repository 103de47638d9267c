"""As-of join: for each left row the nearest earlier (or later) right row of its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergetide.functions.dates import order_key
from mergetide.session import shared_dir

HOUR_US = 3_600_000_000
HOT_ROWS = 4_000_000  # of one key, more than which are not sorted in one task


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    tie_break: Sequence[str] = (),
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance: int | None = None,
    how: str = "left",
    method: str = "measured",
    buckets: Sequence[int] | None = None,
    unique_right: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` plus ``payload`` of at most one right row per left row.

    ``backward`` takes the greatest ``right_on <= left_on`` (``<`` without
    ``allow_exact``), ``forward`` the least ``>=``. Of right rows with equal key
    and time the greatest in ``tie_break`` counts (then in ``payload``), so the
    result does not depend on input order. ``tolerance`` bounds the distance, in
    microseconds for times. A NULL key or time never matches. ``how`` is ``left``
    or ``inner``. ``unique_right`` promises that no right key and time repeats,
    which saves a shuffle.

    Right rows are carried forward over the union of both sides with a window;
    no pair that fails to match is ever formed.

    ``method="window"`` does so once per key, for keys that fit a task: one shuffle.
    ``"bucketed"`` cuts each key into stretches of ``buckets[0]``, these into
    groups of ``buckets[1]`` and so on, and hands the last right row of a stretch
    on to the next one that needs it. Distinct left times are matched and joined
    back, so neither a hot key nor a hot instant ends up in one task: unless told
    otherwise, a stretch is an hour (a million for numbers), and a key has some
    ten thousand hours. Where an hour of one key is too much for a task, let
    ``buckets`` be ``(1_000_000, 86_400)``: seconds and days, at three more shuffles.

    ``"measured"`` counts the rows of each key first, one job that runs when this is
    called and shuffles a number per key and task. Keys of up to ``hot_rows`` go by the
    window; only hotter ones are cut, into seconds if one of their hours is too hot.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    if method not in ("measured", "window", "bucketed"):
        raise ValueError("method is 'measured', 'window' or 'bucketed'")
    if method == "measured":
        hot = _hot_keys(left, right, by, hot_rows)
        options = dict(
            by=by, left_on=left_on, right_on=right_on, payload=payload, tie_break=tie_break, direction=direction,
            allow_exact=allow_exact, tolerance=tolerance, how=how, unique_right=unique_right,
        )
        if hot is None:
            return asof_join(left, right, method="window", **options)
        # A key that is NULL is not hot: it matches nothing.
        cold = asof_join(*(_by_keys(df, hot, by, "left_anti") for df in (left, right)), method="window", **options)
        left, right = (_by_keys(df, hot, by, "left_semi") for df in (left, right))
        if buckets is None:
            buckets = _buckets_for(left, right, by, left_on, right_on, hot_rows)
        return cold.unionByName(asof_join(left, right, method="bucketed", buckets=buckets, **options))

    sign = 1 if direction == "backward" else -1
    if buckets is None:
        buckets = _default_buckets(left, left_on)

    # Right rows of one key and time are told apart by this, the greatest counts; the payload is in it.
    ties = [F.col(c).alias(f"t{i}") for i, c in enumerate(tie_break)]
    offered = right.select(
        *by,
        (order_key(right, right_on) * sign).alias("_t"),
        F.struct(*ties, *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)]).alias("_row"),
    )
    # Before the union: a NULL key or time would group with its like there and match by accident.
    for column in [*by, "_t"]:
        offered = offered.where(F.col(column).isNotNull())

    asked = left.withColumn("_t", order_key(left, left_on) * sign)
    if method == "window":
        offered = offered.select(*by, "_t", F.struct("_t", "_row").alias("_hit"))
        row = F.struct(*[F.col(c) for c in left.columns])
        asked = asked.select(*by, "_t", row.alias("_left"))
        matched = _carry(offered, asked, by, allow_exact, ties=not unique_right).select("_left.*", "_t", "_hit")
        null_key = F.lit(False)
        for column in by:
            null_key = null_key | F.col(column).isNull()
        hit = F.when(~null_key & F.col("_t").isNotNull(), F.col("_hit"))
        matched = matched.withColumn("_hit", hit)
    else:
        if not unique_right:  # one right row per key and time, reduced map-side
            offered = offered.groupBy(*by, "_t").agg(F.max("_row").alias("_row"))
        offered = offered.select(*by, "_t", F.struct("_t", "_row").alias("_hit"))
        times = asked.select(*by, "_t").distinct()
        for column in [*by, "_t"]:
            times = times.where(F.col(column).isNotNull())
        found = _carry_sliced(offered, times, by, allow_exact, buckets).where(F.col("_hit").isNotNull())
        matched = asked.join(found.select(*by, "_t", "_hit"), [*by, "_t"], "left").select(*left.columns, "_t", "_hit")

    if tolerance is not None:
        near = F.col("_t") - F.col("_hit._t") <= tolerance
        matched = matched.withColumn("_hit", F.when(near, F.col("_hit")))
    if how == "inner":
        matched = matched.where(F.col("_hit").isNotNull())
    return matched.select(*left.columns, *[F.col(f"_hit._row.p{i}").alias(c) for i, c in enumerate(payload)])


def _by_keys(df: DataFrame, keys: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    return df.join(keys, list(by), kind).select(*df.columns)


def _default_buckets(left: DataFrame, left_on: str) -> tuple[int, ...]:
    return (HOUR_US if _is_time(left, left_on) else 1_000_000,)


def _is_time(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName().startswith(("timestamp", "date"))


def _hot_keys(left: DataFrame, right: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more rows on both sides together than a task should hold, written out; None if there are none."""
    keys = left.select(*by).unionByName(right.select(*by))
    for column in by:
        keys = keys.where(F.col(column).isNotNull())
    hot = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*by)
    if hot.isEmpty():
        return None
    path = f"{shared_dir(left.sparkSession)}/hot_keys"
    hot.write.parquet(path)
    return left.sparkSession.read.schema(hot.schema).parquet(path)


def _buckets_for(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, hot_rows: int
) -> tuple[int, ...]:
    """Hours, or seconds and days if some hour of a hot key is too much for a task as well."""
    coarse = _default_buckets(left, left_on)
    if not _is_time(left, left_on):
        return coarse
    stretch = F.expr(f"(_t - pmod(_t, {coarse[0]}L)) div {coarse[0]}L").alias("_stretch")
    sides = [df.select(*by, order_key(df, on).alias("_t")).select(*by, stretch) for df, on in ((left, left_on), (right, right_on))]
    counted = sides[0].unionByName(sides[1]).groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    return coarse if counted.where(F.col("_n") > hot_rows).isEmpty() else (1_000_000, 86_400)


def _carry(offered: DataFrame, asked: DataFrame, by: Sequence[str], allow_exact: bool, ties: bool = False) -> DataFrame:
    """Rows of ``asked`` with the last ``_hit`` offered up to their time."""
    # NULL times sort first. At equal times an offer must come first to be seen, last not to be; of several the greatest is last.
    offer, ask = (0, 1) if allow_exact else (1, 0)
    both = offered.withColumn("_side", F.lit(offer)).unionByName(
        asked.withColumn("_side", F.lit(ask)), allowMissingColumns=True
    )
    order = ["_t", "_side", "_hit._row"] if ties else ["_t", "_side"]
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(upto)).where(F.col("_side") == ask)


def _carry_sliced(
    offered: DataFrame, asked: DataFrame, by: Sequence[str], allow_exact: bool, buckets: Sequence[int]
) -> DataFrame:
    """``_carry`` on stretches of ``buckets[0]``; what precedes a stretch reaches it as one extra offer.

    Finding that offer is the same question again, asked of one row per stretch.
    """
    if not buckets:
        return _carry(offered, asked, by, allow_exact)
    stretch = F.expr(f"(_t - pmod(_t, {buckets[0]}L)) div {buckets[0]}L")
    offered, asked = offered.withColumn("_stretch", stretch), asked.withColumn("_stretch", stretch)
    closing = offered.groupBy(*by, F.col("_stretch").alias("_t")).agg(
        F.max_by("_hit", F.col("_hit._t")).alias("_hit")
    )
    wanted = asked.select(*by, F.col("_stretch").alias("_t")).distinct()
    opening = _carry_sliced(closing, wanted, by, False, buckets[1:]).where(F.col("_hit").isNotNull())
    # Without a time of its own it comes before everything in the stretch.
    opening = opening.select(*by, F.lit(None).cast("long").alias("_t"), "_hit", F.col("_t").alias("_stretch"))
    return _carry(offered.unionByName(opening), asked, [*by, "_stretch"], allow_exact)
