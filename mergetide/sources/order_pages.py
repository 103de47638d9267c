"""Pull-request pages derived from an ``orders`` table, for demos, tests and benchmarks.

Each order is a pull request: opened on its date, closed some weeks later unless
its status is O, merged if F. Closed ones appear in two versions, as opened and
as closed. Pages hold the versions of up to 100 neighbouring orders of one of 21
repositories, so page building never gathers more than 200 items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.functions.dates import iso_utc

PAGE_KEY = ["owner", "name", "page_no"]
# Orders that a task makes pages of: about 60 MB of text. Fewer if cores would be idle, down to the lower number.
PER_TASK, LEAST_PER_TASK = 100_000, 10_000


def _dealt(orders: DataFrame) -> DataFrame:
    """Orders with their pages, those of a page in one partition: columns of a few bytes are shuffled, not the text made of them."""
    placed = orders.select(
        "o_orderkey",
        "o_orderdate",
        "o_orderstatus",
        F.concat(F.lit("org"), (F.col("o_custkey") % 3).cast("string")).alias("owner"),
        F.concat(F.lit("repo"), (F.col("o_custkey") % 7).cast("string")).alias("name"),
        F.expr("o_orderkey div 100").cast("int").alias("page_no"),
    )
    # By rows, as their bytes say little about the text.
    n = orders.count()
    tasks = max(n // PER_TASK, min(orders.sparkSession.sparkContext.defaultParallelism, n // LEAST_PER_TASK), 1)
    return placed.repartition(tasks, *PAGE_KEY)


def pull_versions(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    created = F.col("o_orderdate") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    gap = F.make_dt_interval(days=(key * 37 % 90).cast("int"), secs=(key * 7919 % 86400).cast("decimal(18,6)"))
    never = F.lit(None).cast("timestamp_ntz")
    base = _dealt(orders).select(
        "o_orderkey",
        "owner",
        "name",
        created.cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("o_orderstatus") != "O", (created + gap).cast("timestamp_ntz")).alias("_closed"),
        (F.col("o_orderstatus") == "F").alias("_merged"),
        "page_no",
    )

    def version(number: int, closed, merged, updated, state) -> Column:
        return F.struct(
            F.lit(number).alias("version"),
            closed.alias("closed_at"),
            merged.alias("merged_at"),
            updated.alias("updated_at"),
            state.alias("state"),
        )

    opened = version(0, never, never, F.col("created_at"), F.lit("open"))
    final = version(1, F.col("_closed"), F.when(F.col("_merged"), F.col("_closed")), F.col("_closed"), F.lit("closed"))
    both = F.when(F.col("_closed").isNull(), F.array(opened)).otherwise(F.array(opened, final))
    return base.select("*", F.inline(both)).drop("_closed", "_merged")


def order_pages(orders: DataFrame) -> DataFrame:
    """Landed pages (one run) with JSON text as the API returns it, surplus keys included.

    The text is made last, so that a filter on anything else comes before it.
    """

    def quoted(text: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))

    def item(i: Column) -> Column:
        # Put together as text: names and times made here hold nothing that JSON escapes.
        url = F.concat(F.lit("https://x/repos/"), F.col("owner"), F.lit("/"), F.col("name"), F.lit("/pulls/"), i["o_orderkey"].cast("string"))
        number, user = (F.coalesce(n.cast("string"), F.lit("null")) for n in (i["o_orderkey"], i["o_orderkey"] % 997))
        parts = [
            ('{"url":', quoted(url)),
            (',"number":', number),
            (',"base":{"repo":{"name":', quoted(F.col("name"))),
            (',"owner":{"login":', quoted(F.col("owner"))),
            ('}}},"state":', quoted(i["state"])),
            *[(f',"{time}":', quoted(iso_utc(i[time]))) for time in ("created_at", "updated_at", "closed_at", "merged_at")],
            (',"draft":false,"user":{"id":', user),
        ]
        text = F.concat(*[x for key, value in parts for x in (F.lit(key), value)], F.lit("}}"))
        return F.struct(i["o_orderkey"].alias("o_orderkey"), i["version"].alias("version"), text.alias("text"))

    told = ["o_orderkey", "version", "state", "created_at", "updated_at", "closed_at", "merged_at"]
    pages = (
        pull_versions(orders)
        .groupBy(*PAGE_KEY)
        .agg(F.collect_list(F.struct(*told)).alias("items"), F.max("updated_at").alias("newest"))
    )
    items = F.sort_array(F.transform("items", item))
    return pages.select(
        F.lit("run-0").alias("run_id"),
        "owner",
        F.col("name").alias("repo"),
        "page_no",
        F.concat(F.lit("etag-"), F.col("page_no").cast("string")).alias("etag"),
        iso_utc("newest").alias("fetched_at"),
        F.concat(F.lit("["), F.array_join(F.transform(items, lambda i: i["text"]), ","), F.lit("]")).alias("body"),
    )
