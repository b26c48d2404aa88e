"""Near-duplicate groups by an LSH forest over MinHash signatures, links confirmed on full sets.

Equal shingle sets are one node from the start, so copies cost one row each. Every node stands
in ``TREES`` sorted orders of its signature; each order begins with other hash functions and goes
on through all of them. Nodes that share the first ``DEPTH`` values in an order form a region,
and a node's candidates are its neighbours there, that is those with the longest common prefix:
the denser a region, the deeper the prefix that neighbours share. A region's size never matters
to one task, since the orders are range partitioned with the node as the last key.

Only links between different components need confirming: first every node's best candidate, then
what still crosses components.

Neighbours are not all of a dense region, so what then still stands in a region with other
components is searched exactly, in one step, by a prefix-filter join: shingles are ordered from rare to common,
two sets that are similar enough share one of the first few, and places and sizes tell most pairs
apart before sets are compared. Nothing that shares a region is left out. A pair at similarity 0.75
shares a region with probability 1 - (1 - 0.75**3)**20, a miss of 2 in 100,000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.llm.components import connected_components
from paytally.llm.hashing import chunks, mix, shingle_sets, sliced
from paytally.storage import write_once

TREES = 20
DEPTH = 3
#: Values of an order that rows carry beyond the region's own, two bytes each.
ORDER_VALUES = 12
SHINGLE_WORDS = 5
PERCENT = 75

_SEEDS = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over each (nonempty) set, as rows of 32-bit values."""
    functions = TREES * DEPTH
    out = np.empty((len(sets), functions), dtype=np.uint32)
    for lo, hi in chunks(sets, 1 << 17):
        flat = np.concatenate(sets[lo:hi])
        offsets = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for j in range(functions):
            hashed = (flat ^ _SEEDS[j]) * (_SEEDS[functions + j] | np.uint64(1))
            out[lo:hi, j] = np.minimum.reduceat(hashed, offsets) >> np.uint64(32)
    return out


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _profile(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_digest, n_shingles, node, signature) of each text; the last two are null without shingles."""
    for batch in sliced(batches, 128):
        texts = batch.column(1).to_pylist()
        sets = shingle_sets(texts, words)
        full = [i for i, s in enumerate(sets) if len(s)]
        nodes: list[bytes | None] = [None] * len(sets)
        signed: list[bytes | None] = [None] * len(sets)
        rows = signatures([sets[i] for i in full]) if full else []
        for i, row in zip(full, rows, strict=True):
            nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            signed[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([hashlib.md5(t or b"").hexdigest() for t in texts], pa.string()),
                pa.array([len(s) for s in sets], pa.int64()),
                _binary(nodes),
                _binary(signed),
            ],
            ["doc_id", "text_digest", "n_shingles", "node", "signature"],
        )


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node and order: (region, order, node)."""
    functions = TREES * DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = np.array(batch.column(0).to_pylist(), dtype=object)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, functions)
        for tree in range(TREES):
            columns = (np.arange(DEPTH + ORDER_VALUES) + tree * DEPTH) % functions
            region = np.full(len(sig), tree + 1, dtype=np.uint64)
            for c in columns[:DEPTH]:
                region = mix(region * np.uint64(0x9E3779B97F4A7C15) + sig[:, c].astype(np.uint64))
            order = (sig[:, columns[DEPTH:]] >> np.uint32(16)).astype(">u2").tobytes()
            step = 2 * ORDER_VALUES
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(region.view(np.int64)),
                    _binary([order[k : k + step] for k in range(0, len(order), step)]),
                    _binary(nodes.tolist()),
                ],
                ["region", "order", "node"],
            )


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as Arrow binary values."""
    width = rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]
    ).cast(pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b, depth) of rows (region, order, node, component) that come sorted by the first three.

    A row is paired with the nearest rows before and after it in its region that belong to
    another component. The last row of a batch is carried into the next.
    """
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column(0).to_numpy(zero_copy_only=False)
        parts = [_matrix(batch.column(k), w) for k, w in ((1, 2 * ORDER_VALUES), (2, 16), (3, 16))]
        if carried is not None:
            region = np.concatenate((carried[0], region))
            parts = [np.concatenate((a, b)) for a, b in zip(carried[1], parts, strict=True)]
        carried = region[-1:], [x[-1:] for x in parts]
        order, node, component = parts
        component = np.ascontiguousarray(component).view(np.uint64)
        n = len(region)
        starts = np.ones(n, dtype=bool)
        starts[1:] = (region[1:] != region[:-1]) | (component[1:] != component[:-1]).any(axis=1)
        index = np.arange(n)
        before = np.maximum.accumulate(np.where(starts, index, 0)) - 1
        after = np.minimum.accumulate(np.where(np.append(starts[1:], True), index, n)[::-1])[::-1] + 1
        x, y = np.concatenate((index, index)), np.concatenate((before, after))
        inside = (y >= 0) & (y < n)
        x, y = x[inside], y[inside]
        same = region[x] == region[y]
        x, y = x[same], y[same]
        order = np.ascontiguousarray(order).view(np.uint16)
        depth = np.cumprod(order[x] == order[y], axis=1).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [_fixed(node[x]), _fixed(node[y]), pa.array(depth, pa.int32())], ["a", "b", "depth"]
        )


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, trees, depth) of neighbours in ``rows(region, order, node, component)``."""
    ordered = rows.repartitionByRange("region", "order", "node").sortWithinPartitions("region", "order", "node")
    ordered = write_once(ordered.withColumn("task", F.spark_partition_id()), "orders")
    pairs = ordered.drop("task").mapInArrow(_neighbours, "a binary, b binary, depth int")
    # The last row of a task and the first of the next one: two rows for each task.
    row = F.struct("region", "order", "node", "component")
    ends = ordered.groupBy("task").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    border = (
        ends.alias("x")
        .join(ends.alias("y"), F.col("y.task") == F.col("x.task") + 1)
        .where("x.last.region = y.first.region and x.last.component <> y.first.component")
        .select(F.col("x.last.node").alias("a"), F.col("y.first.node").alias("b"), F.lit(0).alias("depth"))
    )
    return (
        pairs.union(border)
        .where("a <> b")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count("*").alias("trees"), F.max("depth").alias("depth"))
    )


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of the texts whose set is the one their row names."""
    for batch in sliced(batches, 128):
        wanted = batch.column(0).to_pylist()
        nodes, packed = [], []
        for node, s in zip(wanted, shingle_sets(batch.column(1).to_pylist(), words), strict=True):
            data = s.tobytes()
            if hashlib.blake2b(data, digest_size=16).digest() == node:
                nodes.append(node)
                packed.append(data)
        yield pa.RecordBatch.from_arrays([_binary(nodes), _binary(packed)], ["node", "shingles"])


def _confirmed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose full sets are similar enough."""
    for batch in sliced(batches, 128):
        a, b, left, right = (c.to_pylist() for c in batch.columns)
        keep = []
        for x, y in zip(left, right, strict=True):
            one, two = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                keep.append(False)
                continue
            at = np.searchsorted(two, one)
            at[at == len(two)] = 0
            both = int((two[at] == one).sum())
            keep.append(100 * both >= percent * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays(
            [_binary([x for x, k in zip(a, keep, strict=True) if k]), _binary([x for x, k in zip(b, keep, strict=True) if k])],
            ["u", "v"],
        )


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The links (u, v) among ``pairs(a, b)``, by the exact similarity of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(partial(_confirmed, percent), "u binary, v binary")


def _crossing(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def _merged(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links: the links are contracted to components, so only those are walked."""
    if components is None:
        return write_once(connected_components(links), "components")
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    ends = ends.select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    joined = connected_components(ends).select("node", F.col("component").alias("top"))
    moved = components.join(joined, components.component == joined.node, "left").select(
        components.node, F.coalesce("top", "component").alias("component")
    )
    new = joined.join(components, "node", "left_anti").select("node", F.col("top").alias("component"))
    return write_once(moved.union(new), "components")


def _best(pairs: DataFrame) -> DataFrame:
    """The pairs that are the most promising of one of their ends."""
    score = F.struct("trees", "depth", "a", "b")
    ends = pairs.select(F.col("a").alias("end"), score.alias("s")).union(pairs.select(F.col("b").alias("end"), score.alias("s")))
    return ends.groupBy("end").agg(F.max("s").alias("s")).select("s.a", "s.b").distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, id), one row for each shingle of the sets (id, shingles)."""
    for batch in sliced(batches, 64):
        packed = batch.column(1).to_pylist()
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) // 8 for p in packed])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(b"".join(packed), dtype=np.int64)), pa.array(ids)], ["shingle", "id"]
        )


def _prefixes(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, id, component, size, rest, short) of the sets (id, component, size, common).

    ``common`` are the shingles that other sets have too, from rare to common; those of one set
    only come before them. ``rest`` is how many of a set's shingles stand from this one on, itself
    included. A set shares one of these rows with any that is similar enough, and where that one is
    not smaller, one that is ``short``.
    """
    for batch in sliced(batches, 64):
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        sizes = batch.column(2).to_pylist()
        for k, (size, common) in enumerate(zip(sizes, batch.column(3).to_pylist(), strict=True)):
            rest = np.arange(len(common), 0, -1, dtype=np.int64)
            rest = rest[100 * rest >= percent * size]
            short = (100 + percent) * rest >= 2 * percent * size
            for column, values in zip(columns, (np.array(common[: len(rest)], dtype=np.int64), np.full(len(rest), k), np.full(len(rest), size), rest, short), strict=True):
                column.append(values)
        shingle, row, size, rest, short = map(np.concatenate, columns)
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(shingle), batch.column(0).take(row), batch.column(1).take(row), pa.array(size), pa.array(rest), pa.array(short)],
            ["shingle", "id", "component", "size", "rest", "short"],
        )


def _alike(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members(id, node, component, shingles)`` with all that are similar enough and not in one component."""
    parts = members.select("id", "shingles").mapInArrow(_shingles, "shingle long, id long")
    often = parts.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = parts.join(often, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    sized = members.select("id", "component", (F.length("shingles") / 8).cast("long").alias("size"))
    rows = write_once(
        sized.join(common, "id").select("id", "component", "size", "common.shingle").mapInArrow(
            partial(_prefixes, percent), "shingle long, id long, component binary, size long, rest long, short boolean"
        ),
        "prefixes",
    )
    x, y = rows.where("short").alias("x"), rows.alias("y")
    pairs = x.join(
        y,
        F.expr(
            f"""x.shingle = y.shingle and x.component <> y.component and (x.size < y.size or x.size = y.size and x.id < y.id)
            and 100 * x.size >= {percent} * y.size and {100 + percent} * least(x.rest, y.rest) >= {percent} * (x.size + y.size)"""
        ),
    ).select(F.col("x.id").alias("p"), F.col("y.id").alias("q")).distinct()
    of = lambda end, name: members.select(F.col("id").alias(end), F.col("node").alias(name))
    named = pairs.join(of("p", "u"), "p").join(of("q", "v"), "q")
    return named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _mixed(dense: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows (region, order, node, component) of regions that hold several components."""
    if groups is None:
        return dense.withColumn("component", F.col("node"))
    labelled = dense.join(groups, "node", "left").select("region", "order", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return labelled.join(mixed.select("region"), "region").select("region", "order", "node", "component")


def _finished(dense: DataFrame, groups: DataFrame | None, sets: DataFrame, tested: DataFrame, percent: int) -> DataFrame | None:
    """``groups`` with every link between nodes that stand in regions of several components."""
    members = _mixed(dense, groups).select("node", "component").distinct().join(sets, "node")
    members = write_once(members.withColumn("id", F.monotonically_increasing_id()), "members")
    rest = _alike(members, percent).join(tested, ["a", "b"], "left_anti")
    links = write_once(confirm(rest, sets, percent), "links")
    return groups if links.isEmpty() else _merged(groups, links)


def components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` profiled as (doc_id, text_digest, n_shingles, node), and (node, component) of the nodes that have links."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    profile = write_once(
        texts.mapInArrow(partial(_profile, words), f"doc_id {kind}, text_digest string, n_shingles long, node binary, signature binary"), "profiles"
    )
    # One signature for each distinct set; its first document lends the text for confirming.
    nodes = profile.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_digest", "signature")).alias("first")
    ).select("node", "first.doc_id", "first.text_digest", "first.signature")
    rows = nodes.select("node", "signature").mapInArrow(_tree_rows, "region long, order binary, node binary")
    shared = rows.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("region")
    dense = write_once(rows.join(shared, "region").select("region", "order", "node"), "regions")
    wanted = dense.select("node").distinct().join(nodes.select("node", "doc_id", "text_digest"), "node")
    # By id and text: many texts may share an id or have none, but a text has one node.
    digest = F.md5(F.coalesce("text", F.lit("").cast("binary")))
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_digest") == F.col("w.text_digest"))
    source = texts.withColumn("text_digest", digest).alias("t").join(wanted.alias("w"), same).select("w.node", "t.text")
    sets = write_once(source.mapInArrow(partial(_sets, words), "node binary, shingles binary").dropDuplicates(["node"]), "sets")

    found = write_once(candidates(dense.withColumn("component", F.col("node"))), "candidates")
    best = write_once(_best(found), "best")
    links = write_once(confirm(best, sets, percent), "links")
    groups = None if links.isEmpty() else _merged(None, links)
    others = found.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = write_once(others if groups is None else _crossing(others, groups), "crossing")
    links = write_once(confirm(rest, sets, percent), "links")
    if not links.isEmpty():
        groups = _merged(groups, links)
    return profile.drop("signature"), _finished(dense, groups, sets, best.union(rest), percent)


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_digest, n_shingles, component) of every row; the component of a text without words is null."""
    profile, groups = components(docs, words, percent)
    if groups is None:
        return profile.withColumn("component", F.col("node"))
    return profile.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_digest) of one document of each component, and of each text without words.

    It is the component's smallest by (doc_id, text_digest), null ids last, so also components
    whose ids are all null or stand on several texts have exactly one.
    """
    labelled = _labelled(docs, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_digest")
    first = labelled.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    alone = labelled.where("component is null").select("doc_id", "text_digest").distinct()
    return first.select("first.doc_id", "first.text_digest").union(alone)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs(doc_id, text)``; other columns are not looked at.

    Documents are linked when ``100 * common >= percent * union`` of their distinct word
    shingles; a text of fewer words is one shingle, and one without words or null is linked with
    nothing. ``component_id`` is the smallest doc_id that links lead to. Rows with the same set
    are in one component, also when they repeat a doc_id (both are then kept, as both carry the
    smallest id). A null doc_id is never the smallest while the component has another; a
    component of nulls only has the component_id null, and its rows are kept. An empty table
    gives no rows. ``text_digest`` is the MD5 of the text, to tell rows of one id apart.
    """
    labelled = _labelled(docs, words, percent)
    least = labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = labelled.join(least, "component", "left")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component_id.alias("component_id"), "text_digest").withColumn("kept", kept)
