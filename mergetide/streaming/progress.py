"""Page admission with each repository's progress as state of the stream.

The alternative to marks in the store (``streaming.ingest``), for when only the admitted
pages are wanted, or many streams share no store: the state holds one number per
repository, lives in Spark's state store, and comes back from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mergetide.functions.dates import order_key
from mergetide.session import require_utc
from mergetide.sources.landing import envelopes, named_pages

ADMITTED = "run_id string, owner string, repo string, page_no int"
# Keyed state of this kind needs the state store that keeps it on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_newest(body: Column) -> Column:
    """Latest update among a page's items; NULL if it has none, or cannot be read."""
    return F.array_max(
        F.transform(
            F.from_json(body, "array<struct<updated_at: string>>"),
            lambda item: item["updated_at"].try_cast("timestamp").cast("timestamp_ntz"),
        )
    )


class Progress(StatefulProcessor):
    """Keeps the high-water mark of one repository, in microseconds, and lets its pages with news pass.

    All pages of a repository in a micro-batch come together here: a few numbers each, no text.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = self.mark.get()[0] if self.mark.exists() else 0
        runs: dict[str, list[Row]] = {}
        for row in rows:
            runs.setdefault(row.run_id, []).append(row)

        def began(run: str) -> tuple:
            times = [r.fetched for r in runs[run] if r.fetched is not None]
            return (bool(times), min(times, default=0), len(run), run)

        for run in sorted(runs, key=began):
            reached = mark
            for page in sorted(runs[run], key=lambda r: r.page_no):
                if page.newest is None or page.newest < mark:
                    break
                reached = max(reached, page.newest)
                yield Row(run_id=run, owner=key[0], repo=key[1], page_no=page.page_no)
            mark = reached
        self.mark.update((mark,))

    def close(self) -> None:
        pass


def admitted_pages(landed: DataFrame) -> DataFrame:
    """``ADMITTED`` rows of a stream of landed pages: of each run the pages before the first without news.

    Runs of a micro-batch follow their fetch times, like those of a batch ingest.
    """
    require_utc(landed.sparkSession)
    slim = named_pages(landed).select(
        "run_id", "owner", "repo", "page_no", page_newest(F.col("body")).alias("at"), F.col("fetched_at").try_cast("timestamp_ntz").alias("began")
    )
    slim = slim.select(
        "run_id", "owner", "repo", "page_no", order_key(slim, "at").alias("newest"), order_key(slim, "began").alias("fetched")
    )
    keyed = slim.groupBy("owner", "repo")
    return keyed.transformWithState(Progress(), ADMITTED, "append", "none")


def start_progress(
    spark: SparkSession, landing: str, out: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Writes the admitted pages of a landing folder to ``out``, Parquet files of which each page is in one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    pages = admitted_pages(envelopes(spark.readStream, landing, "keep"))
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    writer = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start()
