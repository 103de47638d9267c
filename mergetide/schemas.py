"""Table layouts and the JSON fields each query reads."""

from __future__ import annotations

from mergetide.functions.json_shred import JsonField

# How the rows of the raw table are labelled.
PULLS_SOURCE = "github_rest_api"
PULLS_TYPE = "pulls"

# One row per fetched page. owner, repo and etag are also kept inside `metadata`;
# as columns of their own they can be pruned by Parquet statistics.
RAW_PAYLOAD = """
    id bigint, created_at timestamp_ntz, loaded_at timestamp_ntz,
    owner string, repo string, etag string, run_id string, page_no int, metadata string, data string,
    data_source string, data_type string, batch_id bigint
"""

# One row per landed page, as a fetcher leaves it: newest page first within a run.
LANDED_PAGE = "run_id string, owner string, repo string, page_no int, etag string, fetched_at string, body string"

# One row per version of a pull request.
PULLS = """
    url string, repo string, state string, created_at timestamp_ntz, closed_at timestamp_ntz,
    merged_at timestamp_ntz, updated_at timestamp_ntz, draft boolean,
    raw_id bigint, item_pos int, page_owner string, page_repo string, etag string,
    raw_created_at timestamp_ntz, batch_id bigint
"""

# High-water mark advances, one row per repository and batch that moved it.
MARKS = """
    owner string, repo string, etag string, updated_at timestamp_ntz,
    raw_created_at timestamp_ntz, raw_id bigint, batch_id bigint
"""

QUARANTINE = LANDED_PAGE + ", error string, batch_id bigint"

# All pages of runs that failed. Tried again, they are judged by the marks from before batch ``marks_before``.
FAILED = LANDED_PAGE + ", error string, batch_id bigint, marks_before bigint, attempt int"

# Which failed batches another batch has tried again.
RETRIES = "failed_batch bigint, batch_id bigint"

# The newest version of each pull request per repository; ``shared`` if several repositories carry its url.
LATEST = PULLS + ", shared boolean"

REPO_FIELDS = (
    JsonField("name", "base.repo.name", "string"),
    JsonField("login", "base.repo.owner.login", "string"),
)
MARK_FIELDS = (JsonField("updated_at", "updated_at", "timestamp_ntz"),)
PULL_FIELDS = (
    JsonField("url", "url", "string"),
    *REPO_FIELDS,
    JsonField("state", "state", "string"),
    JsonField("created_at", "created_at", "timestamp_ntz"),
    JsonField("closed_at", "closed_at", "timestamp_ntz"),
    JsonField("merged_at", "merged_at", "timestamp_ntz"),
    JsonField("updated_at", "updated_at", "timestamp_ntz"),
    JsonField("draft", "draft", "boolean"),
)
