"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words; target / size is the number of copies, a fraction, that each of its
documents should have. The whole part is certain. The rest is a probability, and pivotal rounding makes it 0 or 1: two
partners meet and words move at random from one to the other, without a change in the mean of either, until one of the
two is whole; the other goes on to the next meeting. Every meeting keeps the sum of the words, so a source misses its
target by what its last document has left alone. The partners are the longest document that is not yet whole and all
shorter ones together, therefore that last document is a short one wherever that is possible.

On Spark this is a reduction tree: a source's documents are dealt by hash into groups of about ``group_rows``, however
many that takes, each group leaves at most one document that is not whole, and these meet again a level higher until
one group is left. A task holds one group at a time. Rows alike in id, source and text are one unit with a number of
rows, so repeats make no hot group either. All chance comes from the seed, the source and the group, so reruns agree
whatever the partitions are.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.storage import write_once

#: Documents that meet in one group before what is left goes a level higher.
GROUP_ROWS = 4_096
WORD = r"[^\x20\x09-\x0D]+"
#: Rows or copies that one row is multiplied to at a time.
_AT_ONCE = 10_000
_NEARLY = 1e-12
_UNIT = ("source", "doc_id", "digest")


def units(docs: DataFrame) -> DataFrame:
    """(source, doc_id, digest, size, n_rows): ``docs(doc_id, text, source)`` with equal rows counted.

    The size is the number of words (0 for a null text); the digest that of the text, null for a null text.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.col("source").cast("string").alias("source"), "doc_id", F.md5(text.cast("binary")).alias("digest"), size.alias("size"))
    return keyed.groupBy(*_UNIT, "size").agg(F.count("*").alias("n_rows"))


def _ranked(sources: DataFrame) -> DataFrame:
    """With ``place``, from 0 in the code-point order of the source, null last, by prefix sums over range partitions."""
    parted = write_once(
        sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    totals = parted.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("none", "source")) - 1
    return parted.join(totals.select("part", before.alias("before")), "part").select("source", "source_size", "n_units", (F.col("before") + inside).alias("place"))


def source_targets(counted: DataFrame, weights: Sequence[float], most_copies: int) -> DataFrame:
    """(source, source_size, n_units, target) of the units ``counted``.

    Sources in code-point order, null last, have the ``weights`` in turn. All words are shared out by weight; a target
    stops at ``most_copies`` times the source's size and the others share what is over, until none is above. What is
    left for each unit of weight only grows from round to round, and two numbers decide a round.
    """
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_units"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = write_once(_ranked(sizes).select("source", "source_size", "n_units", weight.alias("weight")), "mix-weights")
    most = most_copies * F.col("source_size")
    level, seen = 0.0, None
    while True:
        stopped = most < F.col("weight") * level
        words, held, free = sources.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(stopped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))
        ).first()
        if (held, free) == seen or not free:
            break
        seen, level = (held, free), ((words or 0) - held) / free
    target = F.least(most.cast("double"), F.col("weight") * level)
    return sources.select("source", "source_size", "n_units", target.alias("target"))


def settle(sizes: list[int], fractions: list[float], chance: Callable[[], float]) -> list[float]:
    """The fractions of a group's documents, long ones first, made 0 or 1 for all but at most one.

    The longest document that is not whole meets the others after it, taken as one partner whose fractions all move by
    the same step: words go from these to it or from it to these until it or one of them is whole. The chances of the
    two ways are such that every mean stays, and the words of the group stay the same. As the partners' fractions
    keep their order, the least and the greatest tell how far a step can go.
    """
    after = list(fractions)
    rising = sorted(range(len(sizes)), key=lambda k: (fractions[k], k))
    least, greatest = 0, len(rising) - 1  # places in that order of the first and last document still open
    open_ = [True] * len(sizes)
    shift, words = 0.0, sum(sizes)
    first, own = 0, fractions[0] if fractions else 0.0

    def close(k: int, value: float) -> None:
        nonlocal words
        open_[k], after[k] = False, value
        words -= sizes[k]

    while first < len(sizes):
        others = words - sizes[first]
        if not others:
            after[first] = own
            break
        while not open_[rising[least]] or rising[least] == first:
            least += 1
        while not open_[rising[greatest]] or rising[greatest] == first:
            greatest -= 1
        low = max(0.0, fractions[rising[least]] + shift)
        high = min(1.0, fractions[rising[greatest]] + shift)
        to_one, to_none = (1 - own) * sizes[first], own * sizes[first]
        up, down = min(to_one, low * others), min(to_none, (1 - high) * others)
        if chance() * (up + down) < down:
            whole, value, partner, own, shift = to_one <= low * others, 1.0, rising[least], own + up / sizes[first], shift - up / others
        else:
            whole, value, partner, own, shift = to_none <= (1 - high) * others, 0.0, rising[greatest], own - down / sizes[first], shift + down / others
        if whole:
            close(first, value)
            while first < len(sizes) and not open_[first]:
                first += 1
            own = fractions[first] + shift if first < len(sizes) else 0.0
        else:
            close(partner, 1 - value)
    return [0.0 if f < _NEARLY else 1.0 if f > 1 - _NEARLY else f for f in after]


def _meet(seed: int, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle rows (source, bucket, buckets, size, fraction, unit) that come group by group, long ones first.

    Returns (unit, fraction): 0 or 1 for all but at most one unit of a group, and for that too if its source has one group.
    """
    group, last, unit_type = None, False, None
    sizes: list[int] = []
    fractions: list[float] = []
    held: list = []

    def settled() -> pa.RecordBatch:
        source, bucket = group
        chance = random.Random(f"{seed}:{level}:{bucket}:{source is None}:{source}").random
        after = settle(sizes, fractions, chance)
        if last:
            after = [f if f in (0.0, 1.0) else float(chance() < f) for f in after]
        made = pa.RecordBatch.from_arrays([pa.array(held, unit_type), pa.array(after, pa.float64())], ["unit", "fraction"])
        for x in (sizes, fractions, held):
            x.clear()
        return made

    for batch in batches:
        unit_type = batch.schema.field(5).type
        for source, bucket, buckets, size, fraction, unit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (source, bucket) != group:
                if held:
                    yield settled()
                group, last = (source, bucket), buckets == 1
            sizes.append(size)
            fractions.append(fraction)
            held.append(unit)
    if held:
        yield settled()


def plan_mix(docs: DataFrame, weights: Sequence[float], most_copies: int = 3, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """How often each unit of ``docs(doc_id, text, source)`` is taken.

    Returns source, doc_id, digest, size, n_rows, source_size, target, copies and more: every row of the unit is taken
    ``copies`` times, and ``more`` of its rows once more. No row is taken more than ``most_copies`` times.

    Documents without words take no part in the rounding and take the whole part. A source without words has the
    target 0. Null sources are one source, the last; null ids and repeated rows are as good as others. An empty
    table gives no rows. Other columns are not looked at.
    """
    counted = write_once(units(docs), "mix-units")
    targets = write_once(source_targets(counted, weights, most_copies), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    same = counted["source"].eqNullSafe(targets["source"])
    shared = counted.join(targets, same, "left").select(counted["*"], "n_units", "source_size", "target", ratio.alias("ratio"))
    copies = F.floor(F.col("ratio") + _NEARLY)
    expected = F.greatest(F.lit(0.0), F.col("ratio") - copies) * F.col("n_rows")
    whole = F.floor(expected + _NEARLY)
    fraction = F.when((F.col("size") > 0) & (expected - whole > _NEARLY), expected - whole).otherwise(0.0)
    planned = write_once(
        shared.select(*_UNIT, "size", "n_rows", "source_size", "target", "n_units", copies.alias("copies"), whole.alias("more"), fraction.alias("fraction")), "mix-plan"
    )
    largest = targets.agg(F.max("n_units")).first()[0] or 0
    kept = ["size", "n_rows", "source_size", "target", "n_units", "copies", "more"]
    done, open_, level, span = [planned.where("fraction = 0")], planned.where("fraction > 0"), 0, group_rows
    while True:
        buckets = F.ceil(F.col("n_units") / span)
        bucket = F.pmod(F.xxhash64("doc_id", "digest", F.lit(f"{seed}:{level}")), buckets)
        unit = F.struct(*_UNIT, *kept)
        dealt = open_.select("source", bucket.alias("bucket"), buckets.alias("buckets"), "size", "fraction", unit.alias("unit"), "doc_id", "digest")
        order = ["source", "bucket", F.desc("size"), "doc_id", "digest"]
        dealt = dealt.repartition("source", "bucket").sortWithinPartitions(*order).select("source", "bucket", "buckets", "size", "fraction", "unit")
        met = dealt.mapInArrow(partial(_meet, seed, level), f"unit {dealt.schema['unit'].dataType.simpleString()}, fraction double")
        met = write_once(met.select("unit.*", "fraction"), "mix-meeting")
        done.append(met.where("fraction in (0, 1)"))
        if span >= largest:
            break
        open_, level, span = met.where("fraction not in (0, 1)"), level + 1, span * group_rows
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(*_UNIT, "size", "n_rows", "source_size", "target", "copies", (F.col("more") + F.col("fraction")).cast("long").alias("more"))


def _times(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 as ``name``; what one row becomes is dealt out where it is much."""
    rows = rows.withColumn(name, times).where(F.col(name) > 0)
    few, many = rows.where(F.col(name) <= _AT_ONCE), rows.where(F.col(name) > _AT_ONCE)
    others = [c for c in rows.columns if c != name]
    blocks = many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1, F.lit(_AT_ONCE).cast("long"))))
    blocks = blocks.repartition("_block").withColumn(name, F.explode(F.sequence("_block", F.least(F.col(name), F.col("_block") + _AT_ONCE) - 1)))
    return few.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))).select(*others, name).unionByName(blocks.select(*others, name))


def mix(docs: DataFrame, weights: Sequence[float], most_copies: int = 3, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, copies and taken (words). See ``plan_mix``."""
    planned = plan_mix(docs, weights, most_copies, seed, group_rows)
    rows = _times(planned, F.col("n_rows"), "k")
    copies = F.col("copies") + (F.col("k") < F.col("more")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[float], most_copies: int = 3, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The mixed documents themselves: rows of ``docs`` with all their columns, each as often as it is taken.

    Of rows alike in id, source and text one stands for all and comes as often as they are taken together.
    """
    planned = plan_mix(docs, weights, most_copies, seed, group_rows)
    total = planned.select(*[F.col(c).alias(f"_{c}") for c in _UNIT], (F.col("copies") * F.col("n_rows") + F.col("more")).alias("_total"))
    text = F.col("row.text").cast("string")
    keyed = docs.select(F.struct("*").alias("row")).withColumns(
        {"source": F.col("row.source").cast("string"), "doc_id": F.col("row.doc_id"), "digest": F.md5(text.cast("binary"))}
    ).dropDuplicates(list(_UNIT))
    same = F.lit(True)
    for c in _UNIT:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return _times(keyed.join(total, same).select("row", "_total"), F.col("_total"), "_k").select("row.*")
