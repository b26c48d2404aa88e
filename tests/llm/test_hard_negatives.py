"""Hard negatives against a plain search."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paytally.llm import hard_negatives as hn
from paytally.storage import write_once

LONG = 2**63 - 1
SCHEMA = "vec_id long, embedding array<float>, label int, key string, leaf int, vector string, ids int"


def plain(rows, positives=5, negatives=5, percent=80, every=10) -> Counter:
    whole = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out: Counter = Counter()
    place = lambda i: (i is None, i)
    for a, (anchor, v, label) in enumerate(whole):
        if anchor is None or anchor % every:
            continue
        scored = []
        for b, (other, w, of) in enumerate(whole):
            if a != b:
                scored.append((max(-LONG, min(LONG, sum(x * y for x, y in zip(v, w, strict=False)))), other, of))
        scored.sort(key=lambda s: (-s[0], *place(s[1])))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and percent * score <= 100 * s[0] <= 100 * score][:negatives]
            out.update((anchor, positive, k + 1, n[1], score, n[0]) for k, n in enumerate(found))
    return out


def clustered(n: int, seed: int = 1, clusters: int = 12, spread: float = 0.05) -> list[tuple]:
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(8)] for _ in range(clusters)]
    return [(k, [x + pick.gauss(0, spread) for x in pick.choice(centres)], pick.randrange(3)) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "v", 2) for r in rows], SCHEMA)


def mined(spark, rows, **kw):
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("sample", [90, 4096])
def test_search_equals_plain_search(spark, sample):
    rows = clustered(500)
    rows += [(1000 + k, rows[3][1], 1) for k in range(60)] + [(2000 + k, rows[3][1], 2) for k in range(60)]  # one very common vector
    rows += [(20, rows[7][1], 0), (20, rows[7][1], 0), (21, rows[7][1], 0), (None, rows[3][1], 2), (None, rows[5][1], None)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [], 2), (3003, [0.1, None], 1), (3004, [float("nan")] * 8, 1), (3005, [float("inf")] * 8, 0)]
    rows += [(3010, [1.0, 2.0], 1), (3020, [0.0] * 8, 2), (3030, [-0.0001] * 8, 1)]
    assert mined(spark, rows, sample=sample) == plain(rows)


def test_ties_and_other_parameters(spark):
    pick = random.Random(5)
    rows = [(k, [pick.randint(-2, 2) / 256 for _ in range(3)], pick.randrange(2)) for k in range(300)]
    assert mined(spark, rows, positives=3, negatives=9, percent=50) == plain(rows, 3, 9, 50)


def test_large_components_are_exact(spark):
    pick = random.Random(6)
    rows = [(k, [pick.uniform(-1, 1) * 10.0 ** pick.choice([0, 3, 9, 30]) for _ in range(4)], pick.randrange(2)) for k in range(60)]
    rows += [(100 + k, [1e6 + pick.random(), 1e6, 3.0, -5.0], k % 2) for k in range(40)]
    assert mined(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(0, [0.5], 1)])
    assert not mined(spark, [(0, None, 1), (10, [0.5], None)])
    assert mined(spark, [(0, [0.5], 1), (1, [0.5], 1), (2, [0.5], 0)]) == Counter([(0, 1, 1, 2, 16384, 16384)])


def test_ranges_leave_subtrees_out():
    rows = np.floor(256 * np.array([v for _, v, _ in clustered(3000, clusters=40, spread=0.01)]))
    radius = float(np.sqrt((rows**2).sum(1)).max())
    tree = hn.Tree(rows[::4], radius, leaf=32)
    leaves = tree.leaves_of(rows)
    ranges: dict = {}
    for leaf in set(leaves.tolist()):
        for n, i, j, lo, hi in tree.ranges_of(rows[leaves == leaf], leaf):
            old = ranges.get((n, i, j), (np.inf, -np.inf))
            ranges[n, i, j] = (min(lo, old[0]), max(hi, old[1]))
    tree.measured([(*k, *v) for k, v in ranges.items()])
    anchors = rows[:50]
    scores = anchors @ rows.T
    top = np.sort(scores, 1)[:, -5]
    visited = tree.visits(anchors, 0.97 * top[:, None], top[:, None])
    needed = [(k, leaf) for k in range(50) for leaf in set(leaves[(scores[k] <= top[k]) & (scores[k] >= 0.97 * top[k])].tolist())]
    assert all(k in visited[leaf] for k, leaf in needed)
    assert sum(map(len, visited.values())) < 0.3 * 50 * tree.n_leaves


def test_calls_of_anchors_are_not_broadcast(spark):
    """Their estimate is that of the anchors, however many leaves each of these visits."""
    rows = spark.createDataFrame(clustered(200), "vec_id long, embedding array<float>, label int")
    classed = write_once(hn.classes(hn.whole_vectors(rows), 6), "classed")
    tree, sampled = hn.fit(classed, ways=3, leaf=10)
    blocks, tree = hn.index(classed, tree)
    asked = classed.select("key", "label", "vector", F.lit(None).cast("array<long>").alias("tops"))
    found = hn._searched(asked, blocks, tree, sampled, 6, 80)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select("key").distinct().count() == classed.count()
