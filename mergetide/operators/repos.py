"""Which repositories a query covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lists up to this long become a pushed-down IN filter; longer ones a semi join.
IN_LIST_MAX = 1_000

Repos = Sequence[str] | DataFrame


def repo_frame(df: DataFrame, repos: Repos) -> DataFrame:
    """The repositories as a one-column DataFrame without repetitions or NULL."""
    if not isinstance(repos, DataFrame):
        repos = df.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(repos)], "repo string")
    return repos.select("repo").where(F.col("repo").isNotNull()).distinct()


def _named(repos: Sequence[str]) -> list[str]:
    """The list without repetitions or NULL, which IN would treat differently than a join."""
    return [r for r in dict.fromkeys(repos) if r is not None]


def keep_repos(df: DataFrame, repos: Repos | None = None) -> DataFrame:
    """Rows of the listed repositories. No or an empty list means all. A NULL repo never matches."""
    if repos is None or (not isinstance(repos, DataFrame) and not repos):
        return df.where(F.col("repo").isNotNull())
    if not isinstance(repos, DataFrame) and len(repos) <= IN_LIST_MAX:
        return df.where(F.col("repo").isin(_named(repos)))
    # No broadcast hint: Spark broadcasts the list only if it measures below its threshold.
    return df.join(repo_frame(df, repos), "repo", "left_semi")


def drop_repos(df: DataFrame, excluded: Repos) -> DataFrame:
    """All repositories but the excluded ones, so new ones appear by themselves.

    Excluding every repository leaves nothing. A NULL in the list excludes nothing.
    """
    known = df.where(F.col("repo").isNotNull())
    if not isinstance(excluded, DataFrame) and len(excluded) <= IN_LIST_MAX:
        return known.where(~F.col("repo").isin(named)) if (named := _named(excluded)) else known
    return known.join(repo_frame(df, excluded), "repo", "left_anti")


def select_repos(df: DataFrame, repos: Repos | None = None, excluded: Repos | None = None) -> DataFrame:
    df = keep_repos(df, repos)
    return df if excluded is None else drop_repos(df, excluded)


def distinct_repos(df: DataFrame) -> DataFrame:
    """Every repository name seen; unreadable (NULL) ones are left out."""
    return df.select("repo").where(F.col("repo").isNotNull()).distinct()
