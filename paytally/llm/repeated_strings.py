"""Removal of bytes covered by repeated strings, by a sparse hash-compared suffix sort.

Every string of ``length`` bytes holds the smallest hash of its ``GRAM``-byte substrings, and
equal strings hold it at the same place. So only the suffixes (and, backwards, the prefixes) at
those anchors need sorting, one byte in some sixty. Anchors with a gram of their own repeat
nothing. Anchors whose whole neighbourhood (all strings of ``length`` bytes around the gram)
occurs again are covered whole. The distinct neighbourhoods of a gram that has several are
sorted by what follows the anchor and by what precedes it: a mergesort whose comparisons find
the common extension by binary search over prefix polynomial hashes, and whose neighbours are
then compared byte by byte. Strings that start ``d`` before the anchor are equal where the
neighbourhoods fall into one class of the first order at depth ``length - d`` and one class of
the second at depth ``d``; both classes are read off the common extensions of neighbours.

Texts are known by a 64-bit hash and their length, so copies are searched once. A gram with more
neighbourhoods than a task should sort is split by what equal strings have in common: those that
start ``lo`` to ``hi`` bytes before the anchor share the bytes from ``lo`` before it to ``length - hi``
after it. Halving the range lengthens what is shared, so parts get smaller until they can be sorted
as above, or the range is one start and the whole string is shared; there the bytes themselves are
grouped, with partial counts in the map tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.llm.hashing import BYTE_VALUES, PrefixHashes, mix, powers, sliced
from paytally.storage import fresh_path, remove, write_at, write_once

LENGTH = 200
GRAM = 64
#: Neighbourhoods of one part of a gram that are sorted in one task, and those sorted together.
SORTED_AT_MOST = 20_000
SORTED_TOGETHER = 6_000


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window, by doubling."""
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, neighbourhood hashes) of a text of at least ``length`` bytes."""
    buffer = np.frombuffer(text, dtype=np.uint8)
    hashes = PrefixHashes(buffer)
    starts = np.arange(len(buffer) - gram + 1)
    grams = mix(hashes.of(starts, starts + gram))
    width = length - gram + 1
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == grams)
    lo, hi = np.maximum(chosen - (width - 1), 0), np.minimum(chosen + length, len(buffer))
    shape = ((chosen - lo) * (length + 1) + hi - chosen).astype(np.uint64)
    return chosen, grams[chosen], mix(hashes.of(lo, hi) + mix(shape))


def _anchor_rows(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, size, at, gram, around) of every anchor; ``text`` is the hash of the text."""
    for batch in sliced(batches):
        names, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        parts = []
        for name, text in zip(names, texts, strict=True):
            if text is None or len(text) < length:
                continue
            at, grams, around = anchors(text, length, gram)
            parts.append((np.full(len(at), name, np.int64), np.full(len(at), len(text), np.int32), at.astype(np.int32), grams, around))
            if sum(len(p[2]) for p in parts) > 200_000:
                yield _columns(parts)
                parts = []
        if parts:
            yield _columns(parts)


def _columns(parts: list[tuple]) -> pa.RecordBatch:
    name, size, at, grams, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(name), pa.array(size), pa.array(at), pa.array(grams.view(np.int64)), pa.array(around.view(np.int64))],
        ["text", "size", "at", "gram", "around"],
    )


def _neighbourhoods(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, around, n, before, data, many) of texts with their wanted anchors."""
    reach = length - gram
    for batch in sliced(batches):
        out: list[list] = [[] for _ in range(6)]
        size = 0
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in wanted:
                lo = max(0, w["at"] - reach)
                data = text[lo : w["at"] + length]
                for column, value in zip(out, (w["gram"], w["around"], w["n"], w["at"] - lo, data, w["many"]), strict=True):
                    column.append(value)
                size += len(data)
            if size > 8 << 20:
                yield _packed(out)
                out, size = [[] for _ in range(6)], 0
        yield _packed(out)


_NEIGHBOURHOOD = ("gram", "around", "n", "before", "data")


def _packed(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [*_NEIGHBOURHOOD, "many"])


class Neighbourhoods:
    """Rows of bytes with the anchor in one column, sorted both ways from there."""

    def __init__(self, groups: np.ndarray, before: np.ndarray, data: list[bytes], length: int, gram: int, starts: np.ndarray | None = None):
        """``starts`` has the first and the last ``d`` wanted of each row; all without it."""
        self.groups, self.length, self.reach = groups, length, length - gram
        self.starts = np.array([[0, self.reach]]) if starts is None else starts
        n, width = len(data), length - gram + length
        self.rows = np.zeros((n, width), dtype=np.uint8)
        for k, (d, b) in enumerate(zip(data, before.tolist(), strict=True)):
            self.rows[k, self.reach - b : self.reach - b + len(d)] = np.frombuffer(d, dtype=np.uint8)
        self.sizes = {1: np.array([len(d) for d in data]) - before, -1: before}
        self.prefix = np.zeros((n, width + 1), dtype=np.uint64)
        np.cumsum(BYTE_VALUES[self.rows] * powers(width)[0], axis=1, out=self.prefix[:, 1:])

    def _hash(self, i: np.ndarray, size: np.ndarray, way: int) -> np.ndarray:
        """Of ``size`` bytes after (way 1) or before (way -1) the anchor; all rows have the same columns."""
        return self.prefix[i, self.reach + way * size] - self.prefix[i, self.reach]

    def common(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Length of the common extension of rows ``i`` and ``j`` by binary search over hashes."""
        low = np.zeros(len(i), dtype=np.int64)
        high = np.minimum(self.sizes[way][i], self.sizes[way][j]).astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self._hash(i, middle, way) == self._hash(j, middle, way)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _before(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Whether row ``i`` sorts before row ``j``; equal rows do not."""
        common = self.common(i, j, way)
        left, right = common < self.sizes[way][i], common < self.sizes[way][j]
        column = lambda k, inside: self.rows[k, np.where(inside, self.reach + (common if way == 1 else -1 - common), 0)]
        return np.where(left & right, column(i, left) < column(j, right), ~left & right)

    def order(self, way: int) -> tuple[np.ndarray, np.ndarray]:
        """(row order within each group, common extension with the row before; -1 at a group's start)."""
        n = len(self.groups)
        starts = np.flatnonzero(np.append(True, self.groups[1:] != self.groups[:-1]))
        counts = np.diff(np.append(starts, n))
        start, end = np.repeat(starts, counts), np.repeat(starts + counts, counts)
        order = np.arange(n)
        run = 1
        while run < counts.max():
            place = np.arange(n) - start
            own = start + place // run * run
            first = start + (place // run ^ 1) * run
            merged = np.flatnonzero(first < end)
            low, high = first[merged], np.minimum(first[merged] + run, end[merged])
            is_left = own[merged] < low
            base = np.minimum(own[merged], low)
            item = order[merged]
            begin = low
            while (low < high).any():
                open_ = low < high
                middle = np.where(open_, (low + high) // 2, begin)
                other = order[middle]
                # A left item passes what is smaller, a right one also what is equal.
                passes = np.where(is_left, self._before(other, item, way), ~self._before(item, other, way)) & open_
                low, high = np.where(passes, middle + 1, low), np.where(passes | ~open_, high, middle)
            target = base + (merged - own[merged]) + (low - begin)
            new = order.copy()
            new[target] = item
            order = new
            run *= 2
        common = self._verified(order, way, start)
        if common is None:  # a collision of hashes: the bytes decide
            order = self._by_bytes(way)
            common = self._verified(order, way, start)
        return order, common

    def _side(self, way: int) -> np.ndarray:
        """The bytes on one side as numbers from 1, read away from the anchor; 0 where a row has none."""
        side = self.rows[:, self.reach :] if way == 1 else self.rows[:, self.reach - 1 :: -1] if self.reach else self.rows[:, :0]
        inside = np.arange(side.shape[1]) < self.sizes[way][:, None]
        return np.where(inside, side.astype(np.int16) + 1, 0)

    def _verified(self, order: np.ndarray, way: int, start: np.ndarray) -> np.ndarray | None:
        """The common extensions of neighbours, compared byte by byte; None if the order is wrong."""
        out = np.full(len(order), -1, dtype=np.int64)
        side = self._side(way)
        pairs = np.flatnonzero(start != np.arange(len(order)))
        for lo in range(0, len(pairs), 4096):
            p = pairs[lo : lo + 4096]
            a, b = side[order[p - 1]], side[order[p]]
            differs = np.concatenate((a != b, np.ones((len(p), 1), dtype=bool)), axis=1)
            at = differs.argmax(axis=1)
            inner = np.minimum(at, side.shape[1] - 1)
            rows = np.arange(len(p))
            if side.shape[1] and ((at < side.shape[1]) & (a[rows, inner] > b[rows, inner])).any():
                return None
            out[p] = np.minimum(at, np.minimum(self.sizes[way][order[p - 1]], self.sizes[way][order[p]]))
        return out

    def _by_bytes(self, way: int) -> np.ndarray:
        return np.lexsort((*self._side(way).T[::-1], self.groups))

    def repeated(self) -> np.ndarray:
        """For each row and ``d``: whether the string that starts ``d`` before the anchor is in another row of its group."""
        n = len(self.groups)
        (right, follows), (left, precedes) = self.order(1), self.order(-1)
        flags = np.zeros((n, self.reach + 1), dtype=bool)
        index = np.arange(n)
        class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(self.reach + 1):
            wanted = (self.starts[:, 0] <= d) & (d <= self.starts[:, 1])
            usable = np.flatnonzero((self.sizes[-1] >= d) & (self.sizes[1] >= self.length - d) & wanted)
            if len(usable) < 2:
                continue
            class_right[right] = np.maximum.accumulate(np.where(follows < self.length - d, index, 0))
            class_left[left] = np.maximum.accumulate(np.where(precedes < d, index, 0))
            key = class_right[usable] * n + class_left[usable]
            order = np.argsort(key)
            key = key[order]
            twin = np.zeros(len(key), dtype=bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:].copy()
            flags[usable[order[twin]], d] = True
        return flags


def _runs(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): the byte ranges from the anchor that flagged strings cover."""
    starts = flags[:, ::-1]  # by start, from the farthest before the anchor
    padded = np.zeros((len(flags), starts.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = starts
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    _, stop = np.nonzero(change == -1)
    reach = starts.shape[1] - 1
    return row, first - reach, stop - 1 - reach + length


_COVER = "gram long, around long, lo int, hi int"


def _covers(gram: np.ndarray, around: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(gram), pa.array(around), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["gram", "around", "lo", "hi"]
    )


def _sorted_out(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered ranges of neighbourhoods (key, gram, around, before, data, lo, hi) that come sorted by key; groups are never cut."""
    pending: list[tuple] = []

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        keys, grams, around, before = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        starts = np.array([r[5:] for r in rows], dtype=np.int64)
        flags = Neighbourhoods(keys, before, [r[4] for r in rows], length, gram, starts).repeated()
        row, lo, hi = _runs(flags, length)
        return _covers(grams[row], around[row], lo, hi)

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if len(pending) >= SORTED_TOGETHER and row[0] != pending[-1][0]:
                yield resolve(pending)
                pending = []
            pending.append(row)
    if pending:
        yield resolve(pending)


_PART = "key long, gram long, around long, before int, data binary, lo int, hi int"


def _halved(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbourhoods once for each half of their starts, cut to its bytes; the key is a hash of those all its strings share."""
    for batch in sliced(batches, 4096):
        out: list[list] = [[] for _ in range(7)]
        for _, gram, around, before, data, first, last in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            middle = (first + last) // 2
            for lo, hi in ((first, middle), (middle + 1, last)):
                after = len(data) - before
                if before < lo or after < length - hi:
                    continue  # too near the end of its text for any of these strings
                shared = data[before - lo : before + length - hi]
                key = hashlib.blake2b(pack("<qii", gram, lo, hi) + shared, digest_size=8).digest()
                kept = data[max(0, before - hi) : before + length - lo]
                row = (int.from_bytes(key, "little", signed=True), gram, around, min(before, hi), kept, lo, hi)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["key", "gram", "around", "before", "data", "lo", "hi"])


def _sorted_covers(parts: DataFrame, length: int, gram: int) -> DataFrame:
    return write_once(parts.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_sorted_out, length, gram), _COVER), "covers")


def _split_covers(parts: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Covered ranges of parts too large to be sorted: halved until they are not, or the starts are one."""
    covers = []
    while not parts.isEmpty():
        halves = write_once(parts.mapInArrow(partial(_halved, length), _PART), "halves")
        sizes = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        halves = write_once(halves.join(sizes, "key"), "parts")
        large = halves.where(F.col("n") > SORTED_AT_MOST).drop("n")
        covers.append(_sorted_covers(halves.where(F.col("n") <= SORTED_AT_MOST).drop("n"), length, gram))
        single = large.where("lo = hi")
        twice = single.groupBy("key", "data").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        same = single.join(twice, ["key", "data"])
        covers.append(same.select("gram", "around", (-F.col("lo")).alias("lo"), (F.lit(length) - F.col("lo")).alias("hi")))
        parts = large.where("lo < hi").select(*[name.split()[0] for name in _PART.split(", ")])
    return covers


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now rather than at some later collection."""
    spark.sparkContext._jvm.System.gc()


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(text, size, spans) of the texts with repeats: ``spans`` are (lo, hi) byte ranges, overlapping and unordered.

    ``text`` is xxhash64 of the UTF-8 bytes, ``size`` their number.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.xxhash64(data).alias("text"), F.octet_length(data).alias("size"), data.alias("data")).where(F.col("size") >= length)
    path = fresh_path(spark, "anchors")
    every = write_at(
        texts.select("text", "data").mapInArrow(partial(_anchor_rows, length, gram), "text long, size int, at int, gram long, around long"), path
    )
    kinds = every.groupBy("gram").agg(F.min("around").alias("x"), F.max("around").alias("y"), F.count("*").alias("m")).where("m > 1")
    kinds = write_once(kinds.select("gram", (F.col("x") != F.col("y")).alias("several")), "grams")
    found = write_once(every.join(kinds.select("gram"), "gram", "left_semi"), "shared")
    remove(spark, path)
    _release(spark)
    around = found.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("text", "size", "at")).alias("place"))
    known = write_once(around.join(kinds, "gram"), "neighbourhoods")
    _release(spark)
    several = known.where("several")
    sizes = several.groupBy("gram").agg(F.count("*").alias("kinds"))
    wanted = several.join(sizes, "gram").select(
        "place.text",
        "place.size",
        F.struct(F.col("place.at").alias("at"), "gram", "around", "n", (F.col("kinds") > SORTED_AT_MOST).alias("many")).alias("w"),
    )
    own = wanted.groupBy("text", "size").agg(F.collect_list("w").alias("wanted"))
    once = texts.groupBy("text", "size").agg(F.first("data").alias("data"))  # copies meet in the map tasks
    # Written before it is dealt out by gram: texts move once, and their shuffle files can go.
    around_all = write_once(
        once.join(own, ["text", "size"]).select("data", "wanted").mapInArrow(
            partial(_neighbourhoods, length, gram), "gram long, around long, n long, before int, data binary, many boolean"
        ),
        "surroundings",
    )
    _release(spark)
    reach = length - gram
    parts = [F.col("gram").alias("key"), "gram", "around", "before", "data", F.lit(0).alias("lo"), F.lit(reach).alias("hi")]
    covers = _sorted_covers(around_all.where("not many").select(*parts), length, gram)
    _release(spark)
    # Whole neighbourhoods that occur again need no sorting.
    whole = known.where("n > 1").select(
        "gram", "around", (-F.least("place.at", F.lit(reach))).cast("int").alias("lo"),
        F.least(F.col("place.size") - F.col("place.at"), F.lit(length)).cast("int").alias("hi"),
    ).where(F.col("hi") - F.col("lo") >= length)
    covers = covers.union(whole)
    for more in _split_covers(around_all.where("many").select(*parts), length, gram):
        covers = covers.union(more)
    spans = found.join(covers, ["gram", "around"]).select("text", "size", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("span"))
    ranges = write_once(spans.groupBy("text", "size").agg(F.collect_set("span").alias("spans")), "ranges")
    _release(spark)
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of rows (doc_id, data, spans)."""
    for batch in sliced(batches):
        out: list[list] = [[], [], [], [], []]
        for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            kept, at = hashlib.sha256(), 0
            for lo, hi in merged:
                kept.update(data[at:lo])
                at = hi
            kept.update(data[at:])
            row = (len(data), sum(hi - lo for lo, hi in merged), len(merged), kept.hexdigest(), merged)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What is left of ``docs(doc_id, text)`` without the bytes that repeated strings cover.

    A byte goes when a string of ``length`` bytes over it also starts elsewhere, in this or
    another row; all strings are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans
    (runs of removed bytes), kept_sha256 and ``removed`` (the runs). Null texts are empty; texts
    shorter than ``length`` keep everything; rows that repeat count as repeats of each other,
    whatever their doc_id; other columns are not looked at; an empty table gives no rows.
    """
    ranges = repeated_ranges(docs, length, gram)
    kind = docs.schema["doc_id"].dataType.simpleString()
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", data.alias("data"), F.xxhash64(data).alias("text"), F.octet_length(data).alias("size"))
    joined = rows.join(ranges, ["text", "size"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<bigint>>"
    )
