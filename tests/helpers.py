import json
from datetime import datetime

EPOCH = datetime(1970, 1, 1)


def ts(text):
    return None if text is None else datetime.fromisoformat(text)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def pr(number, created, updated=None, closed=None, merged=None, owner="o", name="r", **more):
    """A pull request as the API has it; ``more`` may override or add keys."""
    item = {
        "url": f"https://x/{owner}/{name}/pulls/{number}",
        "base": {"repo": {"name": name, "owner": {"login": owner}}},
        "state": "closed" if closed else "open",
        "created_at": created,
        "closed_at": closed,
        "merged_at": merged,
        "updated_at": updated or closed or created,
        "draft": False,
    }
    return {**item, **more}


def raw_table(spark, *pages):
    data = [(i, "o", "r", f"e{i}", json.dumps(page)) for i, page in enumerate(pages)]
    raw = spark.createDataFrame(data, "id long, owner string, repo string, etag string, data string")
    return raw.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as created_at")


PULLS = (
    "url string, repo string, created_at timestamp_ntz, merged_at timestamp_ntz, "
    "closed_at timestamp_ntz, updated_at timestamp_ntz, raw_id long, item_pos int"
)


def pull_table(spark, *versions):
    """Versions as (url, repo, created, merged, closed, updated)."""
    data = [(u, r, ts(c), ts(m), ts(x), ts(d), i, 0) for i, (u, r, c, m, x, d) in enumerate(versions)]
    return spark.createDataFrame(data, PULLS)
