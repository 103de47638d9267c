"""Strict JSON: text of an array of objects -> one typed row per object.

Strict means: unknown keys are ignored and an explicit null is NULL at any
level, but a missing key, a repeated key, a value that does not cast, an object
where the array belongs, or malformed text is an error.

The record is built inside a generator. Spark may prune unread columns and move
filters, but never a generator's input, so the checks hold under ``count()`` and
under any filter on the result, and every declared field is cast.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON_SPACE = " \t\r\n"


@dataclass(frozen=True)
class JsonField:
    """Output column ``name`` read from the dotted ``path`` and cast to ``type``."""

    name: str
    path: str
    type: str

    def __post_init__(self) -> None:
        if re.search(r"""['"\\\[\]]""", self.path):
            raise ValueError(f"quotes, brackets and backslashes are not supported in a path: {self.path}")

    def text(self, item: str) -> str:
        return f"variant_get({item}, {_path(self.path)}, 'string')"

    def missing(self, item: str) -> str:
        """True where the key is absent. Below an explicit null nothing is absent."""
        keys = self.path.split(".")
        above = [f"variant_get({item}, {_path('.'.join(keys[:depth]))})" for depth in range(1, len(keys))]
        nulls = [f"is_variant_null({parent})" for parent in [item, *above]]
        explained = " or ".join(f"coalesce({null}, false)" for null in nulls)
        return f"variant_get({item}, {_path(self.path)}) is null and not ({explained})"


def _path(path: str) -> str:
    """SQL literal of a variant path."""
    return "'$" + "".join(f'["{key}"]' for key in path.split(".")) + "'"


def _members(item: str, fields: Sequence[JsonField], read: str) -> tuple[Column, dict[str, str]]:
    """The texts at all paths as one struct, found in a single pass over an item, and where each is in the column ``read``.

    A path that ends inside another one, or differs from one by case only, has no place of its
    own in a struct: its text is looked up in the item.
    """
    tree: dict = {}
    paths = {f.path for f in fields}
    folded = {f.path: [k.lower() for k in f.path.split(".")] for f in fields}

    def apart(path: str) -> bool:
        mine, own = folded[path], path.split(".")
        for other in paths - {path}:
            shared = [a == b for a, b in zip(mine, folded[other])]
            depth = shared.index(False) if False in shared else len(shared)
            if depth == min(len(mine), len(folded[other])) or own[:depth] != other.split(".")[:depth]:
                return False
        return True

    def quoted(key: str) -> str:
        return "`" + key.replace("`", "``") + "`"

    def ddl(node: dict) -> str:
        inner = ", ".join(f"{quoted(k)}: {ddl(v) if v else 'string'}" for k, v in node.items())
        return f"struct<{inner}>"

    places = {f.path: f.text(item) for f in fields}
    for path in [f.path for f in fields if apart(f.path)]:
        keys, node = path.split("."), tree
        for key in keys:
            node = node.setdefault(key, {})
        places[path] = ".".join(quoted(k) for k in [read, *keys])
    if not tree:
        return F.lit(None).alias(read), places
    return F.try_variant_get(F.col(item), "$", ddl(tree)).alias(read), places


def _fault(item: str, fields: Sequence[JsonField], texts: dict[str, str], casts: bool) -> Column:
    """Why an item is unusable, or NULL. ``casts`` also reports values that do not cast.

    The empty row of a page without items has nothing to check. What has a text is not missing.
    """
    cases = [f"when {item} is null then null"]
    cases += [f"when {texts[f.path]} is null and {f.missing(item)} then 'missing key {f.path}'" for f in fields]
    if casts:
        for f in fields:
            text = texts[f.path]
            unfit = f"{text} is not null and try_cast({text} as {f.type}) is null"
            cases.append(f"when {unfit} then concat('bad {f.type} at {f.path}: ', {text})")
    return F.expr(f"case {' '.join(cases)} end")


def _is_array_text(text: Column) -> Column:
    """NULL, a JSON null, or text that opens an array."""
    return (
        text.isNull()
        | F.ltrim(text, F.lit(_JSON_SPACE)).startswith("[")
        | (F.trim(text, F.lit(_JSON_SPACE)) == "null")
    )


def shred(
    df: DataFrame,
    data: str,
    fields: Sequence[JsonField],
    keep: Sequence[str] = (),
    pos: str = "item_pos",
    on_error: str = "raise",
    keep_empty: bool = False,
) -> DataFrame:
    """One row per item of the JSON array in ``data``: ``keep`` columns, position, fields.

    ``on_error="raise"`` fails the job on the first bad page. ``"report"`` adds an
    ``error`` column instead: a bad item has NULL fields and its reason there, and
    a page that is no readable array becomes one such row.
    ``keep_empty`` keeps a page without items as one row of NULL fields.

    A repeated key is an error wherever it stands on the page.
    """
    if on_error not in ("raise", "report"):
        raise ValueError("on_error is 'raise' or 'report'")
    report = on_error == "report"
    text = F.col(data).outer()
    if report:
        parsed = F.try_parse_json(F.when(_is_array_text(text), text))
    else:
        not_array = F.raise_error(F.lit("a page must be a JSON array of objects"))
        parsed = F.parse_json(F.when(_is_array_text(text), text).otherwise(not_array))

    pages = df.select(*dict.fromkeys([*keep, data]))
    if report:
        # Decided on the page, so that items need not carry its text along.
        pages = pages.withColumn("_no_items", F.col(data).isNull() | F.col(data).rlike(r"^\s*(\[\s*\]|null)\s*$"))
    tvf = df.sparkSession.tvf
    # The outer variant, as a LEFT lateral join over a generator loses its unmatched rows in Spark 4.1.
    explode = tvf.variant_explode_outer if keep_empty or report else tvf.variant_explode
    items = pages.lateralJoin(explode(parsed).select(F.col("pos").alias("_pos"), F.col("value").alias("_item")))
    place = F.col("_pos").alias(pos)  # in the record, so that a filter on it does not skip checks either
    item, read = "_item", "_read"
    members, texts = _members(item, fields, read)
    items = items.select(*keep, "_pos", item, *(["_no_items"] if report else []), members)
    if not report:
        record = F.struct(place, *[F.expr(f"cast({texts[f.path]} as {f.type})").alias(f.name) for f in fields])
        fault = _fault(item, fields, texts, casts=False)
        checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(record)
        return items.select(*keep, F.inline(F.array(checked)))

    # The page itself is at fault if it yields no item although its text is no empty array.
    unreadable = F.col(item).isNull() & ~F.col("_no_items")
    fault = F.when(unreadable, F.lit("not a readable JSON array")).otherwise(_fault(item, fields, texts, casts=True))
    # A generator of its own: the fault is found once, not again inside every field that depends on it.
    judged = F.inline(F.array(F.struct("_pos", item, read, fault.alias("_fault"))))
    sound = F.col("_fault").isNull()
    rows = items.select(*keep, judged).select(
        *keep,
        place,
        *[F.when(sound, F.expr(f"try_cast({texts[f.path]} as {f.type})")).alias(f.name) for f in fields],
        F.col("_fault").alias("error"),
    )
    return rows if keep_empty else rows.where(F.col(pos).isNotNull() | F.col("error").isNotNull())


def json_text(column: str | Column, path: str) -> Column:
    """Text at a JSON path, NULL where absent: ``json_text("metadata", "$.etag")``."""
    return F.get_json_object(F.col(column) if isinstance(column, str) else column, path)


def json_object(**members: str | Column) -> Column:
    """JSON text of an object; null members are kept."""
    parts = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in members.items()]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def repo_id(owner: str | Column, name: str | Column) -> Column:
    """``owner/name``, NULL if either part is NULL."""
    owner = F.col(owner) if isinstance(owner, str) else owner
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(owner, F.lit("/"), name)


