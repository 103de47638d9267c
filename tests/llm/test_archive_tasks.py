"""Archives are read by as many tasks as their bytes ask for."""

from __future__ import annotations

from mergetide.llm import warc


def test_tasks_follow_the_pages_not_the_settings(spark, monkeypatch):
    pages = spark.range(64).selectExpr("id as page_id", "concat('http://a/', id) as url", "repeat(cast(id as string), 500) as html")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        archive = warc.write_archives(pages)
        assert archive.directory.count() == 1  # one block, not one for each of 37 tasks
        assert warc.read_archives(archive).rdd.getNumPartitions() == 1
        size = archive.directory.first()["bytes"]
        monkeypatch.setattr(warc, "TASK_BYTES", size // 5)
        read = warc.read_archives(archive)
        assert read.rdd.getNumPartitions() >= 5
        assert sorted((r.page_id, r.payload_bytes) for r in read.collect()) == [(i, 500 * len(str(i))) for i in range(64)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
