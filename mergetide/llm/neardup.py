"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find groups.

1. Every text becomes the set of its 5-word shingles. Equal sets are one node, named by
   their least id; copies go no further.
2. A node's SuperMinHash signature: each element ranks the slots by a random permutation
   of its own and offers rank + fraction to each; a slot keeps the least offer. Ranks
   of one element are all different, which lowers the variance, and no rank beyond the
   largest kept can matter, so the ranks stop there. Bands of slots are the buckets.
3. A bucket's members are compared with its leader, the member whose buckets are fullest,
   as the source of a family of copies is: n comparisons, not n^2. Verified links are grouped.
4. What a leader did not settle is settled exactly: pairs of members in a bucket that
   still are in different groups are all compared, in blocks of bounded size; the
   largest group of a bucket is never compared with itself.

Bands find a pair at the limit of 0.75 with a chance of 1 - (1 - 0.75^4)^28 = 0.99998.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergetide.llm.common import staged
from mergetide.llm.components import connected_components
from mergetide.llm.token_counts import by_bytes

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 28, 4
BLOCK = 256
_ELEMENTS = 1 << 16
_PRIME, _GOLDEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : len(words) - width + 1 + j]) * _PRIME
        out ^= out >> np.uint64(32)
    return np.unique(_mix(out))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (sets x slots) of non-empty sets: rank in the upper, fraction in the lower 32 bits."""
    best = np.full((len(sets), slots), np.iinfo(np.int64).max, np.int64)
    group: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, values in enumerate(sets):
        for first in range(0, len(values), _ELEMENTS):
            part = values[first : first + _ELEMENTS]
            if held + len(part) > _ELEMENTS:
                _offer(best, group)
                group, held = [], 0
            group.append((i, part))
            held += len(part)
    _offer(best, group)
    return best


def _offer(best: np.ndarray, group: list[tuple[int, np.ndarray]]) -> None:
    if not group:
        return
    slots = best.shape[1]
    elements = np.concatenate([v for _, v in group])
    owner = np.repeat([i for i, _ in group], [len(v) for _, v in group])
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    flat = best.reshape(-1)
    at = np.arange(len(elements))
    for rank in range(slots):
        # A set is done once all its slots hold an offer of a lower rank.
        open_sets = best.max(axis=1) >= rank << 32
        at = at[open_sets[owner[at]]]
        if not len(at):
            return
        random = _mix(elements[at] + np.uint64((rank + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        other = rank + (random & np.uint64(0xFFFFFFFF)).astype(np.int64) % (slots - rank)
        slot = order[at, other]
        order[at, other] = order[at, rank]
        offers = (rank << 32) + (random >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, owner[at] * slots + slot, offers)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, parts.shape[:2])
    for r in range(rows):
        out = _mix(out * _PRIME + parts[:, :, r])
    return out.view(np.int64)


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                filled = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if filled:
                    found = band_keys(super_minhash([sets[i] for i in filled], bands * rows), bands, rows)
                    for i, k in zip(filled, found, strict=True):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "class", "bands"],
                )

    return run


def _verify(percent: int):
    """Rows (a, b, text of a, text of b), sorted by b mostly, to the pairs whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for x, y, text, other in zip(*columns, strict=True):
                if other != last:
                    last, leader = other, shingle_set(other)
                own = shingle_set(text)
                shared = len(np.intersect1d(own, leader, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(leader) - shared) and shared:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compare_blocks(percent: int):
    """Rows (group, side, node, component, text) sorted by group to links between different components of a group.

    Sides: 0 the bucket's largest component, 1 and 2 blocks of its other members; 1 is
    compared with 0, with 2, and, where there is no other side, with itself.
    """

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [shingle_set(r[4]) for r in rows]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(rows)), sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        component = np.array([r[3] for r in rows])
        side = np.array([r[1] for r in rows])
        alone = len(set(side.tolist())) == 1
        for i, own in enumerate(sets):
            if not len(own) or not alone and side[i] != 1:
                continue
            begins, ends = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = ends - begins
            stops = np.cumsum(n)
            shared = np.bincount(owner[np.arange(stops[-1]) + np.repeat(begins - (stops - n), n)], minlength=len(rows))
            alike = 100 * shared >= percent * (sizes + sizes[i] - shared)
            alike &= component != component[i]
            if not alone:
                alike &= side != 1
            for j in np.flatnonzero(alike):
                yield rows[i][2], rows[j][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if group and group[0][0] != row[0]:
                    found += links(group)
                    group = []
                group.append(row)
            yield _links(found)
        if group:
            yield _links(list(links(group)))

    return run


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"]
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of ``docs``.

    Texts are linked if their shingle sets have a Jaccard similarity of ``percent`` or
    more; component_id is the least id reachable, and kept says that it is the row's own.
    A text of fewer than five words is one shingle; one without words, or null, has none
    and is linked with nothing. Rows with the same id count as linked with one another.
    A row without id is never linked and kept. An empty table gives an empty one.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    sketched = staged(
        named.mapInArrow(_sketch(bands, rows), "doc_id long, n_shingles long, class binary, bands array<long>")
    )
    classes = sketched.where("doc_id is not null and class is not null").groupBy("class").agg(F.min("doc_id").alias("node"))
    buckets = _buckets(sketched, classes)
    leading = _leaders(buckets)

    pairs = leading.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = staged(pairs)
    involved = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # A share of all documents, so it is never to be broadcast: the same plan at every size.
    texts = staged(named.where("text is not null").join(involved.hint("merge"), "doc_id", "left_semi").distinct())
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = staged(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long"))

    # An id that stands for several texts links their classes: it is a node of its own, linked with all of theirs.
    ids = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("class")).alias("x"), F.max(F.xxhash64("class")).alias("y"))
    several = sketched.join(staged(ids.where("x <> y").select("doc_id")), "doc_id", "left_semi").join(classes, "class")
    links = links.unionAll(several.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    groups = staged(connected_components(links))
    more = _unsettled(leading, groups, texts, percent)
    if more.limit(1).count():
        found = more.select(F.col("a"), F.col("b")).unionAll(
            groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        )
        groups = staged(connected_components(found))

    named_rows = sketched.select("doc_id", "n_shingles", "class").join(classes, "class", "left")
    # A text without words stands with the other texts of its id.
    out = named_rows.withColumn("node", F.coalesce("node", "doc_id")).join(groups, "node", "left")
    component = F.coalesce("component", "node")
    least = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def _buckets(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, n): the buckets of two nodes or more, with their sizes."""
    names = classes.select(F.col("node").alias("doc_id"), "class")
    nodes = sketched.select("doc_id", "class", "bands").join(names, ["doc_id", "class"])
    rows = nodes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node")).distinct()
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return staged(rows.join(sizes, "key"))


def _leaders(buckets: DataFrame) -> DataFrame:
    """(key, node, n, leader): a bucket's leader is the node whose buckets hold most, of equals the least."""
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("minus")))
    leaders = buckets.join(weight, "node").groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.minus")).alias("leader"))
    return staged(buckets.join(leaders, "key"))


def _unsettled(leading: DataFrame, groups: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members of a bucket that no leader has brought together."""
    rest = leading.where("node <> leader and n > 2").join(groups, "node", "left")
    rest = rest.select("key", "node", F.coalesce("component", "node").alias("component"))
    shares = rest.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"))
    keys = shares.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("of").alias("of")
    )
    # Bands often hold the same members; one of them is enough.
    keys = keys.where("parts > 1").groupBy("of", "n", "parts").agg(F.min(F.struct("key", "most")).alias("k"), )
    keys = keys.select(
        "k.key",
        F.col("k.most.component").alias("largest"),
        F.ceil(F.col("k.most.n") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("n") - F.col("k.most.n")) / BLOCK).cast("int").alias("other_blocks"),
    )
    rows = staged(rest.join(keys, "key"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("component") == F.col("largest"), F.col("main_blocks")).otherwise(F.col("other_blocks")))
    rows = rows.withColumn("block", block.cast("int"))

    def places(kind: int, own: str, blocks: str) -> DataFrame:
        return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda i: F.struct(F.lit(kind).alias("kind"), *(
            (F.col("block").alias("i"), i.alias("j")) if own == "i" else (i.alias("i"), F.col("block").alias("j"))
        ), F.lit(0 if own == "i" else 1).alias("side")))

    # The largest component's blocks i meet the other members' blocks j; those meet each other once (i <= j).
    main = places(0, "i", "other_blocks")
    across = places(0, "j", "main_blocks")
    among = F.transform(
        F.sequence(F.lit(0), F.col("other_blocks") - 1),
        lambda i: F.struct(
            F.lit(1).alias("kind"),
            F.least(i, F.col("block")).alias("i"),
            F.greatest(i, F.col("block")).alias("j"),
            F.when(i < F.col("block"), 2).otherwise(1).alias("side"),
        ),
    )
    spread = rows.withColumn("at", F.explode(F.when(F.col("component") == F.col("largest"), main).otherwise(F.concat(across, among))))
    group = F.xxhash64("key", "at.kind", "at.i", "at.j").alias("group")
    spread = spread.select(group, "at.side", "node", "component")
    dealt = spread.join(texts.withColumnRenamed("doc_id", "node"), "node").select("group", "side", "node", "component", "text")
    dealt = dealt.repartition("group").sortWithinPartitions("group")
    return staged(dealt.mapInArrow(_compare_blocks(percent), "a long, b long"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the least id; of repeated rows of it, one.

    Of rows with one id the first by their whole content counts. Rows without an id are all
    kept. Columns may have any name and type.
    """
    kept_id, place = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names no column has
    kept = near_duplicates(docs, doc_id, text).where("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct()
    own = docs.join(kept, F.col(doc_id) == F.col(kept_id), "left_semi")
    unordered = {f.name for f in docs.schema if "map<" in f.dataType.simpleString()}
    content = [F.to_json(F.struct(c)) if c in unordered else F.col(c) for c in docs.columns]
    order = Window.partitionBy(doc_id).orderBy(*content)
    one = own.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
    return one.unionAll(docs.where(F.col(doc_id).isNull()))
