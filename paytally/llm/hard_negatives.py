"""Hard negatives by exact search in a multiway hyperplane tree (GNAT).

A node of the tree has several split points; a row goes to the subtree of the nearest one. For every split point and
every subtree of the node the index holds the least and the greatest distance between that point and the subtree's
rows. A search with the distances of an anchor to the split points bounds its distance to all rows of a subtree from
both sides, by the triangle inequality, and leaves the subtree out if that range misses the annulus that the anchor's
window of scores is. Leaves are searched exactly, so results are exact whatever the tree looks like.

Scores are inner products. With a further coordinate sqrt(R^2 - |x|^2) that brings all rows to the norm R of the
longest, and 0 for the anchor, |a - x|^2 = |a|^2 + R^2 - 2 a.x: a window of scores is an annulus of distances.

On Spark the tree is fitted on the driver from at most ``SAMPLE`` rows, which bounds its size; every row is indexed.
Rows are dealt out by range over (leaf, hash), so that a large leaf is many blocks of at most ``BLOCK`` rows, and blocks
of anchors meet the blocks of the leaves they could not leave out, once for the positives and once for the negatives.
Rows of equal vector and label are one class: all members score alike, so of a class only the first few ids can ever be
among the first few, and anchors of one class share one search. Classes are cut before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paytally.storage import write_once

#: Rows that the tree is fitted on at most, by order of a hash.
SAMPLE = 4_096
#: Split points of a node, and sample rows of which a node is a leaf.
WAYS, LEAF = 8, 64
#: Rows and anchors that are compared in one step.
BLOCK, ANCHORS = 2_048, 256
_LONG = 2**63 - 1
#: Whole numbers up to here are exact as doubles.
_EXACT = 2.0**53


# --- rows and classes ----------------------------------------------------------------------------------------------


def _whole_vectors(step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, embedding) with floor(step * x) of each component, as the bytes of small or wide numbers."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        flat = vectors.flatten()
        numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        sizes = vectors.value_lengths().fill_null(0).to_numpy()
        good = np.isfinite(numbers) & ~flat.is_null().to_numpy(zero_copy_only=False)
        whole = np.floor(step * np.where(good, numbers, 0.0)) + 0.0  # no negative zero
        ends = np.cumsum(sizes)
        bad = np.concatenate(([0], np.cumsum(~good | ~np.isfinite(whole))))
        keep = (bad[ends] == bad[ends - sizes]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(keep)
        narrow = np.abs(whole).max(initial=0.0) < 2**15
        packed = [_packed(whole[ends[k] - sizes[k] : ends[k]], narrow) for k in rows]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), labels.take(pa.array(rows)), pa.array(packed, pa.binary())], ["vec_id", "label", "vector"]
        )


def _packed(vector: np.ndarray, narrow: bool) -> bytes:
    """A first byte tells the kind of number. Equal vectors give equal bytes."""
    if narrow or np.abs(vector).max(initial=0.0) < 2**15:
        return b"n" + vector.astype("<i2").tobytes()
    return b"w" + vector.astype("<f8").tobytes()


def _unpacked(packed: list[bytes], width: int = 0) -> np.ndarray:
    """A row for each vector, zeros where one is shorter than the others or than ``width``."""
    vectors = [np.frombuffer(p, "<i2" if p[:1] == b"n" else "<f8", offset=1) for p in packed]
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def whole_vectors(rows: DataFrame, step: int = 256) -> DataFrame:
    """(vec_id, label, vector, key) of ``rows(vec_id, label, embedding)``; the key stands for label and vector.

    Rows with a null label or vector, or a null or non-finite component, are left out.
    """
    narrow = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    packed = narrow.mapInArrow(partial(_whole_vectors, step), f"vec_id {id_type}, label long, vector binary")
    return packed.withColumn("key", F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("vector")), 256))


def classes(rows: DataFrame, members: int) -> DataFrame:
    """(key, label, vector, ids): rows of equal label and vector together, with their first ``members`` ids (null last).

    Spark cuts each group to its first rows before the shuffle, so a very common vector is no hot group.
    """
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= members)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("k", "vec_id"))), lambda x: x["vec_id"])
    return first.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), ordered.alias("ids"))


# --- the tree ----------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """Split points with their place among the lifted vectors; ``below`` are nodes, or None where a leaf is."""

    name: int
    points: np.ndarray
    lifts: np.ndarray
    below: list[Node | None]
    leaves: list[int]
    #: least[i, j], most[i, j]: the distances between split point i and the rows of subtree j.
    least: np.ndarray | None = None
    most: np.ndarray | None = None


def _lift(vectors: np.ndarray, radius: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, radius**2 - np.einsum("ij,ij->i", vectors, vectors)))


def _distances(vectors: np.ndarray, lifts: np.ndarray, points: np.ndarray, point_lifts: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * vectors @ points.T
    return np.sqrt(np.maximum(0.0, square + (lifts[:, None] - point_lifts[None]) ** 2))


def _far_apart(vectors: np.ndarray, lifts: np.ndarray, ways: int) -> list[int]:
    """Rows far from each other, the first row first; fewer where rows are alike."""
    chosen = [0]
    nearest = _distances(vectors, lifts, vectors[:1], lifts[:1])[:, 0]
    while len(chosen) < ways and nearest.max() > 0:
        k = int(nearest.argmax())
        chosen.append(k)
        nearest = np.minimum(nearest, _distances(vectors, lifts, vectors[k : k + 1], lifts[k : k + 1])[:, 0])
    return chosen


class Tree:
    """The split points of all nodes; ``root`` is None where there is only one leaf."""

    def __init__(self, sample: np.ndarray, radius: float, ways: int = WAYS, leaf: int = LEAF):
        self.radius, self.width = radius, sample.shape[1]
        self.nodes: list[Node] = []
        self.n_leaves = 0
        self.root = self._grown(sample, _lift(sample, radius), ways, leaf)
        if self.root is None:
            self.n_leaves = 1

    def _grown(self, vectors: np.ndarray, lifts: np.ndarray, ways: int, leaf: int) -> Node | None:
        chosen = _far_apart(vectors, lifts, ways) if len(vectors) > leaf else []
        if len(chosen) < 2:
            return None
        node = Node(len(self.nodes), vectors[chosen], lifts[chosen], [], [])
        self.nodes.append(node)
        nearest = _distances(vectors, lifts, node.points, node.lifts).argmin(1)
        for j in range(len(chosen)):
            mine = nearest == j
            node.below.append(self._grown(vectors[mine], lifts[mine], ways, leaf))
            node.leaves.append(-1 if node.below[-1] else self.n_leaves)
            self.n_leaves += node.below[-1] is None
        return node

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        lifts, out = _lift(vectors, self.radius), np.zeros(len(vectors), dtype=np.int64)
        open_ = [(self.root, np.arange(len(vectors)))] if self.root else []
        while open_:
            node, rows = open_.pop()
            nearest = _distances(vectors[rows], lifts[rows], node.points, node.lifts).argmin(1)
            for j, (below, leaf) in enumerate(zip(node.below, node.leaves, strict=True)):
                mine = rows[nearest == j]
                if len(mine):
                    out[mine] = leaf
                    if below:
                        open_.append((below, mine))
        return out

    def ranges_of(self, vectors: np.ndarray, leaf: int) -> list[tuple[int, int, int, float, float]]:
        """(node, split point, subtree, least, most) for rows of one leaf, at every node above it."""
        lifts, out = _lift(vectors, self.radius), []
        for node, j in self._way_to(leaf):
            far = _distances(vectors, lifts, node.points, node.lifts)
            out += [(node.name, i, j, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(far.min(0), far.max(0), strict=True))]
        return out

    def _way_to(self, leaf: int) -> list[tuple[Node, int]]:
        if not hasattr(self, "_ways"):
            self._ways: dict[int, list[tuple[Node, int]]] = {0: []} if self.root is None else {}
            open_ = [(self.root, [])] if self.root else []
            while open_:
                node, way = open_.pop()
                for j, below in enumerate(node.below):
                    step = [*way, (node, j)]
                    if below:
                        open_.append((below, step))
                    else:
                        self._ways[node.leaves[j]] = step
        return self._ways[leaf]

    def measured(self, ranges: list) -> Tree:
        """With the ranges of all rows; a subtree without rows keeps an empty range."""
        for node in self.nodes:
            shape = (len(node.points), len(node.points))
            node.least, node.most = np.full(shape, np.inf), np.full(shape, -np.inf)
        for name, i, j, lo, hi in ranges:
            self.nodes[name].least[i, j], self.nodes[name].most[i, j] = lo, hi
        return self

    def visits(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> dict[int, np.ndarray]:
        """For each leaf the anchors that cannot leave it out.

        ``least`` and ``most`` (anchors, windows) are scores; a window from inf to -inf is none.
        """
        square = np.einsum("ij,ij->i", anchors, anchors) + self.radius**2
        slack = 1e-9 * square + 1.0  # scores are whole numbers; far more than rounding moves a distance
        with np.errstate(invalid="ignore"):
            inner = np.sqrt(np.maximum(0.0, square[:, None] - 2 * most - slack[:, None]))
            outer = np.sqrt(np.maximum(0.0, square[:, None] - 2 * least + slack[:, None]))
        exists = least <= most
        everyone = np.flatnonzero(exists.any(1))
        if self.root is None:
            return {0: everyone} if len(everyone) else {}
        zero, found = np.zeros(len(anchors)), {}
        open_ = [(self.root, everyone, zero[everyone], np.full(len(everyone), np.inf))]
        while open_:
            node, rows, near, far = open_.pop()
            away = _distances(anchors[rows], zero[rows], node.points, node.lifts)
            for j, (below, leaf) in enumerate(zip(node.below, node.leaves, strict=True)):
                if not np.isfinite(node.least[0, j]):
                    continue  # no rows
                low = np.maximum(near, np.maximum(away - node.most[:, j], node.least[:, j] - away).max(1))
                high = np.minimum(far, (away + node.most[:, j]).min(1))
                reached = (exists[rows] & (inner[rows] <= high[:, None] * (1 + 1e-9)) & (outer[rows] >= low[:, None] * (1 - 1e-9))).any(1)
                if not reached.any():
                    continue
                if below:
                    open_.append((below, rows[reached], low[reached], high[reached]))
                else:
                    found[leaf] = rows[reached]
        return found


def fit(classed: DataFrame, sample: int = SAMPLE, ways: int = WAYS, leaf: int = LEAF) -> tuple[Tree, dict]:
    """The tree of ``classed``, and its sample rows by label, which are first bounds for searches.

    The sample is the rows of the least hashes, at most ``sample``; equal tables give equal trees.
    """
    norm = classed.mapInArrow(_norms, "norm double, width int").agg(F.max("norm"), F.max("width")).first()
    chosen = classed.orderBy(F.xxhash64("key"), "key").limit(sample).select("label", "vector", F.size("ids").alias("n")).collect()
    vectors = _unpacked([bytes(r["vector"]) for r in chosen], norm[1] or 0)
    return Tree(vectors, (norm[0] or 0.0) * (1 + 1e-9), ways, leaf), {"vectors": vectors, "labels": np.array([r["label"] for r in chosen]), "counts": np.array([r["n"] for r in chosen])}


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _unpacked(batch.column(batch.schema.get_field_index("vector")).to_pylist())
        if len(vectors):
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            yield pa.RecordBatch.from_arrays([pa.array([norms.max()]), pa.array([vectors.shape[1]], pa.int32())], ["norm", "width"])


# --- the index ---------------------------------------------------------------------------------------------------------


def _assigned(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _unpacked(batch.column(batch.schema.get_field_index("vector")).to_pylist(), tree.width)
        yield batch.append_column("leaf", pa.array(tree.leaves_of(vectors), pa.int64()))


def _blocks(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, label, vector, ids, leaf) in the order of leaves, as blocks of one leaf with their ranges."""
    ranges_type = pa.list_(pa.struct([("node", pa.int32()), ("point", pa.int32()), ("subtree", pa.int32()), ("least", pa.float64()), ("most", pa.float64())]))

    def block(leaf: int, held: pa.Table) -> pa.RecordBatch:
        vectors = _unpacked(held["vector"].to_pylist(), tree.width)
        ranges = [dict(zip(("node", "point", "subtree", "least", "most"), r, strict=True)) for r in tree.ranges_of(vectors, leaf)]
        lists = [pa.array([held[c].to_pylist()], pa.list_(held.schema.field(c).type)) for c in ("key", "label", "vector", "ids")]
        return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), *lists, pa.array([ranges], ranges_type)], ["leaf", "keys", "labels", "vectors", "ids", "ranges"])

    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        leaves = table["leaf"].to_numpy()
        for start, end in zip([0, *(np.flatnonzero(np.diff(leaves)) + 1)], [*(np.flatnonzero(np.diff(leaves)) + 1), len(leaves)], strict=True):
            while start < end:
                if held and (held[0]["leaf"][0].as_py() != leaves[start] or sum(map(len, held)) >= BLOCK):
                    yield block(held[0]["leaf"][0].as_py(), pa.concat_tables(held))
                    held = []
                size = min(end - start, BLOCK - sum(map(len, held)))
                held.append(table.slice(start, size))
                start += size
    if held:
        yield block(held[0]["leaf"][0].as_py(), pa.concat_tables(held))


def index(classed: DataFrame, tree: Tree) -> tuple[DataFrame, Tree]:
    """Every class in a block of its leaf, and the tree with the ranges of all of them."""
    id_type = classed.schema["ids"].dataType.simpleString()
    row = f"key string, label long, vector binary, ids {id_type}"
    assigned = classed.select("key", "label", "vector", "ids").mapInArrow(partial(_assigned, tree), f"{row}, leaf long")
    ordered = assigned.repartitionByRange("leaf", "key").sortWithinPartitions("leaf")
    blocks = ordered.mapInArrow(
        partial(_blocks, tree),
        f"leaf long, keys array<string>, labels array<long>, vectors array<binary>, ids array<{id_type}>, "
        "ranges array<struct<node: int, point: int, subtree: int, least: double, most: double>>",
    )
    blocks = write_once(blocks, "negatives-index")
    each = blocks.select(F.explode("ranges").alias("r")).groupBy("r.node", "r.point", "r.subtree").agg(F.min("r.least"), F.max("r.most"))
    return blocks.drop("ranges"), tree.measured([tuple(r) for r in each.collect()])  # as many as the tree has


# --- searches ------------------------------------------------------------------------------------------------------------


def _scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: with Python's integers where doubles might round.

    A product beyond a long counts as the end of the longs.
    """
    bound = np.sqrt((anchors**2).sum(1).max(initial=0.0)) * np.sqrt((vectors**2).sum(1).max(initial=0.0))
    if bound < _EXACT / 128:
        return (anchors @ vectors.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m.tolist()] for m in (anchors, vectors)]
    products = [[max(-_LONG, min(_LONG, sum(map(mul, a, v)))) for v in whole[1]] for a in whole[0]]
    return np.array(products, dtype=np.int64).reshape(len(anchors), len(vectors))


def _least(top: int, percent: int) -> int:
    """The least whole number of which a hundred is at least ``percent`` of the top."""
    return -(-percent * top // 100)


def _first(scores: np.ndarray, rows: np.ndarray, ids: list[list], keys: list[str], own: str, count: int) -> list[tuple]:
    """The first ``count`` members (score, id, own class) of the classes at ``rows``."""
    if len(rows) > count:
        rows = rows[scores[rows] >= np.partition(scores[rows], -count)[-count]]
    members = [(int(scores[k]), i, keys[k] == own) for k in rows.tolist() for i in ids[k]]
    return sorted(members, key=lambda m: (-m[0], m[1] is None, m[1]))[:count]


def _reached(scores: np.ndarray, counts: np.ndarray, count: int) -> float:
    """What the ``count`` best of rows with these scores reach; -inf where there are fewer."""
    best = np.argsort(-scores, kind="stable")
    enough = int(np.searchsorted(np.cumsum(counts[best]), count))
    return float(scores[best[enough]]) if enough < len(best) else -np.inf


def _call(tree: Tree, sample: dict, count: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (key, label, vector, tops) as blocks (leaf, keys, labels, vectors, tops), one for each leaf they visit.

    ``tops`` are the scores that windows of negatives hang from; null where positives are searched. What the rows of
    the sample reach in a window bounds it from below.
    """
    types = {"leaf": pa.int64(), "a_keys": pa.list_(pa.string()), "a_labels": pa.list_(pa.int64()), "a_vectors": pa.list_(pa.binary()), "tops": pa.list_(pa.list_(pa.int64()))}
    for whole in batches:
        for start in range(0, whole.num_rows, ANCHORS):
            keys, labels, packed, tops = (c.to_pylist() for c in whole.slice(start, ANCHORS).columns)
            anchors = _unpacked(packed, tree.width)
            scores = _scores(anchors, sample["vectors"])
            windows = max(1, max(len(x or ()) for x in tops))
            least, most = np.full((len(keys), windows), np.inf), np.full((len(keys), windows), -np.inf)
            for k, (label, of) in enumerate(zip(labels, tops, strict=True)):
                same = sample["labels"] == label
                if of is None:
                    least[k, 0], most[k, 0] = _reached(scores[k][same], sample["counts"][same], count), np.inf
                for j, top in enumerate(of or ()):
                    inside = ~same & (scores[k] <= top) & (scores[k] >= _least(top, percent))
                    least[k, j], most[k, j] = max(float(_least(top, percent)), _reached(scores[k][inside], sample["counts"][inside], count)), top
            most[most >= _LONG], least[least <= -_LONG] = np.inf, -np.inf  # ends of the longs stand for all beyond
            out = {name: [] for name in types}
            for leaf, rows in tree.visits(anchors, least, most).items():
                for name, values in zip(types, (None, keys, labels, packed, tops), strict=True):
                    out[name].append(leaf if values is None else [values[k] for k in rows])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in types.items()], list(types))


def _search(count: int, percent: int, id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors beside blocks of rows: the first members (key, top, score, vec_id, own) of each anchor and window."""
    types = {"key": pa.string(), "top": pa.int64(), "score": pa.int64(), "vec_id": id_type, "own": pa.bool_()}
    for batch in batches:
        for k in range(batch.num_rows):
            pair = batch.slice(k, 1).to_pylist()[0]
            vectors = _unpacked(pair["vectors"])
            anchors = _unpacked(pair["a_vectors"], vectors.shape[1])
            all_scores, labels = _scores(anchors, _unpacked(pair["vectors"], anchors.shape[1])), np.array(pair["labels"])
            found: list[tuple] = []
            for key, label, tops, scores in zip(pair["a_keys"], pair["a_labels"], pair["tops"], all_scores, strict=True):
                same = labels == label
                if tops is None:
                    found += [(key, None, *m) for m in _first(scores, np.flatnonzero(same), pair["ids"], pair["keys"], key, count)]
                for top in tops or ():
                    rows = np.flatnonzero(~same & (scores <= top) & (scores >= _least(top, percent)))
                    found += [(key, top, *m) for m in _first(scores, rows, pair["ids"], pair["keys"], key, count)]
            columns = list(zip(*found, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _searched(asked: DataFrame, blocks: DataFrame, tree: Tree, sample: dict, count: int, percent: int) -> DataFrame:
    """The first ``count`` (key, top, place, vec_id, score, own) of each anchor and window among all ``blocks``."""
    calls = asked.mapInArrow(
        partial(_call, tree, sample, count, percent), "leaf long, a_keys array<string>, a_labels array<long>, a_vectors array<binary>, tops array<array<long>>"
    )
    # Calls are a few rows of anchors by their estimate, and anchors times leaves in fact: never broadcast.
    pairs = calls.hint("merge").join(blocks, "leaf").select("a_keys", "a_labels", "a_vectors", "tops", "keys", "labels", "vectors", "ids")
    id_type = blocks.schema["ids"].dataType.elementType.elementType
    found = pairs.mapInArrow(
        partial(_search, count, percent, to_arrow_type(id_type)), f"key string, top long, score long, vec_id {id_type.simpleString()}, own boolean"
    )
    order = Window.partitionBy("key", "top").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, step: int = 256, sample: int = SAMPLE) -> DataFrame:
    """The hardest negatives of every anchor and positive of ``rows(vec_id, label, embedding)``.

    Components count as floor(``step`` * x), scores are their inner products. The first rows are those of the highest
    score, of the smallest vec_id where scores are equal, null ids last. An anchor is a row for which ``is_anchor`` (on
    vec_id) holds; its positives are its first ``positives`` other rows of the same label, and the negatives of each are
    the first ``negatives`` rows of other labels with ``percent`` % to 100 % of the positive's score. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score; a positive without negatives gives no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Rows that repeat are rows of
    their own, also where their ids are equal. Where vectors differ in length the shorter ends in zeros; an empty
    one is all zeros. Scores beyond a long count as its end. An empty table gives no rows; other columns are not looked at.
    """
    whole = write_once(whole_vectors(rows, step), "negatives-rows")
    anchors = whole.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "key", "label", "vector")
    classed = write_once(classes(whole, max(positives + 1, negatives)), "negatives-classes")
    tree, sampled = fit(classed, sample)
    blocks, tree = index(classed, tree)
    none = F.lit(None).cast("array<long>")
    asked = write_once(anchors.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector")), "negatives-anchors")

    best = _searched(asked.withColumn("tops", none), blocks, tree, sampled, positives + 1, percent)
    entry = F.struct("place", "vec_id", "score", "own")  # no more than positives + 1 of an anchor
    best = write_once(best.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("best")), "negatives-positives")
    windows = asked.join(best.select("key", F.array_distinct("best.score").alias("tops")), "key")
    hard = _searched(windows, blocks, tree, sampled, negatives, percent)
    hard = hard.groupBy("key", "top").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("rank"), "vec_id", "score"))).alias("hard"))
    hard = hard.groupBy("key").agg(F.collect_list(F.struct("top", "hard")).alias("windows"))
    answers = write_once(best.join(hard, "key"), "negatives-answers")

    def is_itself(x: Column) -> Column:
        return x["own"] & x["vec_id"].eqNullSafe(F.col("anchor_id"))

    itself = F.array_position(F.transform("best", is_itself), F.lit(True))
    others = F.slice(F.filter("best", lambda x, k: k + 1 != itself), 1, positives)
    paired = anchors.select("anchor_id", "key").join(answers, "key").select("anchor_id", "windows", F.explode(others).alias("positive"))
    each = F.flatten(F.transform(F.filter("windows", lambda w: w["top"] == F.col("positive.score")), lambda w: w["hard"]))
    return paired.select("anchor_id", "positive", F.explode(each).alias("negative")).select(
        "anchor_id",
        F.col("positive.vec_id").alias("positive_id"),
        F.col("negative.rank").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )
