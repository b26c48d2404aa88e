"""Mixing against a plain version of the targets and the laws of the rounding."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from paytally.llm import mixing
from tests.llm import cases

WEIGHTS = (1, 2, 3)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows) -> dict:
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    targets, free, rest = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return targets | {s: weight[s] * level for s in free}
        for s in over:
            targets[s] = Fraction(3 * sizes[s])
            rest -= targets[s]
        free -= over
    return targets


def mixed_rows() -> list[tuple]:
    pick = random.Random(4)
    rows = []
    for k in range(900):
        source = pick.choice(["a", "a", "a", "b", "c", "Zed", "é", "𝒳", None, "tiny"]) if k % 3 else "hot"
        if source == "tiny" and pick.random() < 0.8:
            source = "a"
        rows.append((k, " ".join("w" * pick.randint(1, 3) for _ in range(int(pick.paretovariate(0.7)) % 3000)), source))
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, " \t\n", "empty"), (None, "one two", "b"), (None, None, None)]
    rows += [(1003, "the same words", "b")] * 70 + [(None, "again and again", None)] * 40 + [(5, "another text with id five", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3, "u") for r in rows], "doc_id long, text string, source string, size int, target double, n_rows int, digest string")


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_mix(spark, group_rows):
    rows = mixed_rows()
    got = mixing.mix(frame(spark, rows), WEIGHTS, group_rows=group_rows).collect()
    targets = plain_targets(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    taken, longest, shortest = Counter(), Counter(), {}
    for r in got:
        s, ratio = r["source"], targets[r["source"]] / max(1, sizes[r["source"]])
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(targets[s]), abs=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert abs(r["copies"] - float(ratio)) < 1
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
        shortest[s] = min(shortest.get(s, 10**9), r["size"] or 10**9)
    for s, target in targets.items():
        assert abs(taken[s] - float(target)) <= longest[s]
    for s in ("hot", "a", "b") if group_rows > 3 else ():  # many documents meet: what is left is a short one
        assert abs(taken[s] - float(targets[s])) <= 20


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = frame(spark, mixed_rows())
    one = mixing.mix(docs.repartition(1), WEIGHTS, group_rows=16).collect()
    two = mixing.mix(docs.repartition(13, "text"), WEIGHTS, group_rows=16).collect()
    assert Counter(one) == Counter(two)
    other = mixing.mix(docs, WEIGHTS, seed=1, group_rows=16).collect()
    assert Counter(one) != Counter(other)


def test_the_mixture_holds_what_was_planned(spark):
    docs = frame(spark, mixed_rows())
    planned = Counter()
    for r in mixing.mix(docs, WEIGHTS).collect():
        planned[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = mixing.mixture(docs, WEIGHTS)
    assert got.columns == docs.columns
    assert Counter((r[0], r[2], size(r[1])) for r in got.collect()) == +planned


def test_many_copies_of_a_row_are_multiplied_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_AT_ONCE", 7)
    rows = [(1, "a b c", "s")] * 50 + [(2, "d e", "t")] * 20
    got = mixing.mix(frame(spark, rows), WEIGHTS)
    assert Counter(r["doc_id"] for r in got.collect()) == {1: 50, 2: 20}


def test_settling_keeps_words_and_leaves_one_at_most():
    pick = random.Random(8)
    for _ in range(500):
        sizes = sorted((int(pick.paretovariate(0.8)) for _ in range(pick.randint(1, 30))), reverse=True)
        fractions = [pick.uniform(0.01, 0.99)] * len(sizes) if pick.random() < 0.5 else [pick.uniform(0.01, 0.99) for _ in sizes]
        after = mixing.settle(sizes, fractions, pick.random)
        assert sum(f not in (0, 1) for f in after) <= 1 and all(0 <= f <= 1 for f in after)
        assert sum(s * f for s, f in zip(sizes, after, strict=True)) == pytest.approx(sum(s * f for s, f in zip(sizes, fractions, strict=True)))


def test_settling_keeps_the_mean_of_every_document():
    pick = random.Random(2)
    sizes, fractions = [90, 40, 40, 7, 3, 2, 1], [0.3, 0.3, 0.6, 0.3, 0.9, 0.3, 0.3]
    runs = [mixing.settle(sizes, fractions, pick.random) for _ in range(20_000)]
    for k, f in enumerate(fractions):
        assert sum(r[k] for r in runs) / len(runs) == pytest.approx(f, abs=0.015)


def test_nothing_from_nothing(spark):
    assert mixing.mix(cases.none(spark), WEIGHTS).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "s")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank, WEIGHTS).collect()] == [0, 0]
