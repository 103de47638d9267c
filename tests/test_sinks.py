import pytest

from mergetide.sources.sinks import export, small_arrow, small_pandas
from tests.helpers import rows, ts

SCHEMA = "k string, t timestamp_ntz, v double"


@pytest.fixture
def result(spark):
    return spark.createDataFrame([("a", ts("2024-01-01"), 1.5), ("b", None, None), (None, ts("2024-01-02"), 0.0)], SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_export(spark, result, tmp_path, fmt):
    export(result, str(tmp_path / "out"), fmt)
    back = spark.read.schema(SCHEMA).option("header", True).format(fmt).load(str(tmp_path / "out"))
    assert rows(back) == rows(result)
    with pytest.raises(Exception):  # never overwrites unasked
        export(result, str(tmp_path / "out"), fmt)
    export(result, str(tmp_path / "parts"), fmt, partition_by=["k"])
    assert spark.read.schema(SCHEMA).option("header", True).format(fmt).load(str(tmp_path / "parts")).count() == 3


def test_unknown_format(result, tmp_path):
    with pytest.raises(ValueError):
        export(result, str(tmp_path / "out"), "xlsx")


def test_small_results(result):
    assert small_arrow(result).num_rows == 3
    for k in ("k", "v"):  # in the order of the result
        order = result.orderBy(k).repartition(3).orderBy(k)
        assert small_arrow(order)[k].to_pylist() == [r[k] for r in order.collect()]
    assert small_arrow(result.where("v > 100")).schema.names == ["k", "t", "v"]  # empty, with a schema
    assert len(small_pandas(result, max_rows=3)) == 3
    with pytest.raises(ValueError):
        small_arrow(result, max_rows=2)
