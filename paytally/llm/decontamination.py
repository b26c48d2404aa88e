"""Benchmark passages in documents, found by Wu-Manber search over words.

The patterns are all windows of ``WINDOW`` words of the benchmark items. Text and patterns are
numbers of benchmark words (0: any other word), so a block is two words and a shift skips up to
``WINDOW - 1`` of them: the block that ends a window is looked up in the shift table, which
tells how far the window can move until that block could stand in a pattern. At shift 0 the
bucket of that block names the patterns that end so, and direct comparison decides. Many places
of a batch are searched at once, each by its own cursor.

The benchmark goes to the tasks in blocks of bounded size, however many it takes; documents pass
through all of them in one scan, a few blocks at a time, with no shuffle and no join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally.llm.hashing import chunks, sliced
from paytally.storage import write_once

WINDOW = 13
#: Bytes of benchmark text that go to the tasks as one block, and blocks searched in one pass.
BLOCK_BYTES = 4 << 20
BLOCKS_IN_PASS = 4

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z; all else becomes a space.
FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))

_SLOTS = 1 << 18


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first.astype(np.uint32) * np.uint32(0x9E3779B1) + second.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(
        np.int64
    )


class Patterns:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, rows: np.ndarray, items: list[list[str | None]]):
        self.rows, self.items, self.size = rows, items, rows.shape[1]
        self.block = min(2, self.size)
        last = self._slots(rows, self.size)
        by_slot = np.argsort(last, kind="stable")
        self.rows = rows[by_slot]
        self.items = [items[i] for i in by_slot]
        self.bucket = np.searchsorted(last[by_slot], np.arange(_SLOTS + 1))
        self.shift = np.full(_SLOTS, self.size - self.block + 1, dtype=np.int64)
        for end in range(self.block, self.size + 1):
            np.minimum.at(self.shift, self._slots(rows, end), self.size - end)

    def _slots(self, rows: np.ndarray, end: int) -> np.ndarray:
        """The table slot of the block that ends before word ``end`` of each row."""
        return _slot(rows[:, end - 2] if self.block == 2 else rows[:, end - 1] * 0, rows[:, end - 1])

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, patterns) of all occurrences in ``text``."""
        places = len(text) - self.size + 1
        if places <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(64, min(1024, places // 256))
        at = np.arange(0, places, step)
        stop = np.minimum(at + step, places)
        suspects = []
        while len(at):
            end = at + self.size
            shift = self.shift[_slot(text[end - 2] if self.block == 2 else text[end - 1] * 0, text[end - 1])]
            suspects.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return self._confirm(text, np.sort(np.concatenate(suspects)))

    def _confirm(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = at + self.size
        slot = _slot(text[end - 2] if self.block == 2 else text[end - 1] * 0, text[end - 1])
        first, count = self.bucket[slot], self.bucket[slot + 1] - self.bucket[slot]
        where = np.repeat(np.arange(len(at)), count)
        pattern = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count) + first[where]
        for k in (0, *range(self.size - 1, 0, -1)):
            same = text[at[where] + k] == self.rows[pattern, k]
            where, pattern = where[same], pattern[same]
        return at[where], pattern


class Block:
    """The patterns of some benchmark items, one table for each length."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        of_length: dict[int, dict[tuple[int, ...], list[str | None]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                of_length.setdefault(size, {}).setdefault(ids[k : k + size], []).append(item_id)
        self.patterns = [
            Patterns(np.array(list(rows), dtype=np.int64), list(rows.values())) for _, rows in sorted(of_length.items())
        ]

    def search(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each text: intervals of hit words as rows (start, end), and the items hit."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        get = self.vocabulary.get
        flat = np.zeros(int(lengths.sum()) + len(texts) + 1, dtype=np.int64)  # a 0 ends each text
        for start, words in zip(starts.tolist(), texts, strict=True):
            flat[start : start + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        found: list[tuple[list, set[str]]] = [([], set()) for _ in texts]
        for patterns in self.patterns:
            at, which = patterns.search(flat)
            owner = np.searchsorted(starts, at, side="right") - 1
            for a, p, o in zip(at.tolist(), which.tolist(), owner.tolist(), strict=True):
                local = a - int(starts[o])
                found[o][0].append((local, local + patterns.size))
                found[o][1].update(x for x in patterns.items[p] if x is not None)
        return [(np.array(spans, dtype=np.int64).reshape(-1, 2), items) for spans, items in found]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Intervals joined where they touch."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack((spans[new, 0], reach[np.append(new[1:] - 1, len(spans) - 1)]), axis=1)


def _searched(tables: list[Block], texts: list, old_hits: list, old_items: list) -> tuple[list[int], list[np.ndarray], list[set]]:
    """Words, hits and items of each text, those of earlier passes included."""
    sizes, all_hits, all_items = [], [], []
    raw = [t or b"" for t in texts]
    for lo, hi in chunks(raw, 4 << 20):
        split = [words_of(t) for t in raw[lo:hi]]
        hits = [np.frombuffer(h or b"", dtype=np.int64).reshape(-1, 2) for h in old_hits[lo:hi]]
        items = [set(x or ()) for x in old_items[lo:hi]]
        for table in tables:
            for k, (spans, names) in enumerate(table.search(split)):
                if len(spans):
                    hits[k] = _merged(np.concatenate((hits[k], spans)))
                    items[k] |= names
        sizes += map(len, split)
        all_hits += hits
        all_items += items
    return sizes, all_hits, all_items


def _contaminated(words: int, hits: np.ndarray) -> bool:
    n_hit = int((hits[:, 1] - hits[:, 0]).sum())
    return n_hit > 0 and 20 * n_hit >= words


def _clean(blocks: list[list], window: int, last: bool, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, hits): with these blocks' hits added, or after the last blocks the clean ones' first column."""
    tables = [Block(items, window) for items in blocks]
    for batch in sliced(batches):
        texts = batch.column(0).field(at).cast(pa.binary()).to_pylist()
        sizes, hits, _ = _searched(tables, texts, batch.column(1).to_pylist(), [None] * len(texts))
        if last:
            keep = [not _contaminated(*found) for found in zip(sizes, hits, strict=True)]
            yield batch.select([0]).filter(pa.array(keep, pa.bool_()))
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in hits], pa.binary())], ["row", "hits"])


def _pass(blocks: list[list], window: int, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add what these blocks find to each row's hits and items."""
    tables = [Block(items, window) for items in blocks]
    for batch in sliced(batches):
        ids, texts, old_hits, old_items = batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))
        sizes, all_hits, all_items = _searched(tables, texts, old_hits, old_items)
        if not last:
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array([h.tobytes() for h in all_hits], pa.binary()), pa.array([sorted(x) for x in all_items], pa.list_(pa.string()))],
                ["doc_id", "text", "hits", "items"],
            )
            continue
        n_hit = [int((h[:, 1] - h[:, 0]).sum()) for h in all_hits]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(sizes, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in all_items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in all_items], pa.string()),
                pa.array([_contaminated(*found) for found in zip(sizes, all_hits, strict=True)], pa.bool_()),
                pa.array([sorted(x) for x in all_items], pa.list_(pa.string())),
                pa.array([h.tolist() for h in all_hits], pa.list_(pa.list_(pa.int64()))),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"],
        )


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in blocks of bounded size; the driver holds a few at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text"))
    for item_id, text in rows.toLocalIterator():
        text = bytes(text) if text is not None else b""
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    yield block


def _passes(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[list], bool]]:
    """The blocks of each pass over the documents, and whether it is the last."""
    pending: list[list] = []
    for block in _blocks(benchmark, block_bytes):
        if len(pending) == BLOCKS_IN_PASS:
            yield pending, False
            pending = []
        pending.append(block)
    yield pending, True


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: words, words hit by benchmark windows, items found, and the verdict.

    ``hits`` has the intervals of hit words and ``items`` the item ids. A window is ``window``
    consecutive words of an item, or the whole of a shorter one. A document is contaminated when
    at least a twentieth of its words is hit. Null and empty texts have no words, and items
    without words no windows; windows of an item whose id is null hit, but name no item. Rows
    that repeat are judged each; other columns are not looked at. Empty tables are fine.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = f"doc_id {kind}, text binary, hits binary, items array<string>"
    result = (
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "items array<string>, hits array<array<bigint>>"
    )
    rows = docs.select(
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        F.lit(None).cast("binary").alias("hits"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for pending, last in _passes(benchmark, block_bytes):
        rows = rows.mapInArrow(partial(_pass, pending, window, last), result if last else carried)
        rows = rows if last else write_once(rows, "contamination")
    return rows


def reject(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with all their columns that ``find_contamination`` does not call contaminated.

    ``text`` is a string. Rows go through the search whole, so nothing is shuffled or joined.
    """
    whole = T.StructType([T.StructField("row", docs.schema, False)])
    carried = T.StructType([*whole.fields, T.StructField("hits", T.BinaryType())])
    at = docs.columns.index("text")
    rows = docs.select(F.struct("*").alias("row"), F.lit(None).cast("binary").alias("hits"))
    for pending, last in _passes(benchmark, block_bytes):
        rows = rows.mapInArrow(partial(_clean, pending, window, last, at), whole if last else carried)
        rows = rows if last else write_once(rows, "contamination")
    return rows.select("row.*")
