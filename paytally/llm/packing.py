"""Pack tokenised documents into as few sequences as possible.

Lengths are whole numbers up to the capacity, so the whole packing problem is a histogram of at
most ``capacity`` counts, whatever the number of documents. The driver solves that histogram:
first dominance reduction after Martello and Toth fixes, for good, sets that provably are part
of some best packing, then best fit in decreasing order packs what is left. The solution is a
list of runs "the pieces of this length from this rank on go to these sequences, at this
offset", whose number depends on the capacity only. Tasks number the pieces of each length
(their own count, plus the sum over earlier tasks) and look their run up.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytally.llm.hashing import chunks, sliced
from paytally.storage import write_once

CAPACITY = 1024
END_ID = 2
#: Bytes of text that are cut into words at a time; the more, the fewer of the words are distinct.
CUT_BYTES = 1 << 22
#: Words after which a worker process starts to forget: those not met again while as many others come.
CACHED_WORDS = 500_000
#: Words that are encoded as one text.
TOGETHER = 512

_OTHER_SPACE = re.compile(r"[^\S \n]")


def _odd_space(text: str) -> bool:
    """Whether there is white space other than lone spaces and line feeds between other characters."""
    runs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
    return runs or text.startswith((" ", "\n")) or text.endswith((" ", "\n")) or _OTHER_SPACE.search(text) is not None


class Words:
    """The ids of words met lately, from one task to the next. Those of ``now`` become ``before`` when they are
    many; a word of ``before`` that is met again is taken over, so common words are never encoded twice."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def unknown(self, words: set[str]) -> list[str]:
        """The words to learn; all others are in ``now``."""
        if len(self.now) > CACHED_WORDS:
            self.now, self.before = {}, self.now
        missing = words.difference(self.now)
        again = missing.intersection(self.before)
        self.now.update({w: self.before[w] for w in again})
        return list(missing.difference(again))


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's pattern never joins what stands before a lone space or line feed to what
    follows, so texts are cut there and the ids of words are remembered. Texts with other white
    space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.first, self.after_space = Words(), Words()
        self.feed = self._whole(["\n"])[0]
        self.feed_id = int.from_bytes(self.feed, "little")

    def _whole(self, texts: list[str]) -> list[bytes]:
        packed = self.packed.__getitem__
        return [b"".join(map(packed, e.ids)) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str], prefix: str) -> list[bytes]:
        """The ids of each word, many encoded as the lines of one text: a line feed is an id of its own there."""
        out: list[bytes] = []
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        texts = ["\n".join([prefix + w for w in group]) for group in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            feeds = np.flatnonzero(ids == self.feed_id)
            if len(feeds) != len(group) - 1:  # something of a word takes in the line feed beside it
                out += self._whole([prefix + w for w in group])
                continue
            packed = ids.tobytes()
            begins, ends = [0, *(4 * feeds + 4).tolist()], [*(4 * feeds).tolist(), len(packed)]
            out += [packed[a:b] for a, b in zip(begins, ends, strict=True)]
        return out

    def _learn(self, known: Words, words: set[str], prefix: str) -> None:
        new = known.unknown(words)
        if new:
            known.now.update(zip(new, self._each(new, prefix), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [_odd_space(t) for t in texts]
        whole = iter(self._whole([t for t, o in zip(texts, odd, strict=True) if o]) if any(odd) else ())
        cut = iter(self._by_words([t for t, o in zip(texts, odd, strict=True) if t and not o]))
        return [next(whole) if o else next(cut) if t else b"" for t, o in zip(texts, odd, strict=True)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without odd space, put together from those of each distinct word.

        Texts are cut, and equal words found, without a Python object for each word. A word keeps the line
        feed in front of it; the space in front of the others is known, and a text's first word has none.
        """
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts]), " ")
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # No word holds a space, and one text cut is far quicker than as many texts taken over.
        together = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        distinct = pc.binary_join(together, " ")[0].as_py().split(" ")
        begins = [distinct[k] for k in codes[ends[:-1]].tolist()]
        self._learn(self.first, {w[1:] for w in distinct if w.startswith("\n")}.union(begins), "")
        self._learn(self.after_space, {w for w in distinct if not w.startswith("\n")}, " ")
        first, after = self.first.now, self.after_space.now
        known = [self.feed + first[w[1:]] if w.startswith("\n") else after[w] for w in distinct]
        known += [first[w] for w in begins]
        codes[ends[:-1]] = np.arange(len(distinct), len(known))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(known), "<u4")
        size = sizes[codes]
        up_to = np.cumsum(size)
        # The ids of a word stand one after another, so each place is the one before it plus one, but at a word's begin.
        places = np.repeat(starts[codes] - up_to + size, size) + np.arange(up_to[-1])
        joined, stops = ids[places], np.concatenate(([0], up_to[ends[1:] - 1]))
        return [joined[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


@cache
def _encoder(path: str) -> Encoder:
    """One for each worker process: words met in one task help the next."""
    return Encoder(path)


def _pieces(
    path: str, capacity: int, end_id: int, with_ids: bool, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Cut documents, and number the pieces of each length within the task."""
    encoder = _encoder(path)
    part = TaskContext.get().partitionId()
    seen = [0] * (capacity + 1)
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in sliced(batches, 4096):
        doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in chunks(texts, CUT_BYTES):
            rows: list[tuple] = []
            for i, ids in enumerate(encoder.encode(texts[lo:hi]), lo):
                ids += end
                n = len(ids) // 4
                start, piece, size = 0, 0, (n - 1) % capacity + 1
                while start < n:
                    own = ids[4 * start : 4 * (start + size)]
                    rows.append((i, piece, start, size, zlib.crc32(own), seen[size], own if with_ids else None))
                    seen[size] += 1
                    start, piece, size = start + size, piece + 1, capacity
            index, piece, start, size, crc, rank, own = zip(*rows, strict=True)
            columns = [
                doc_ids.take(pa.array(index, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, size, crc)),
                pa.array([part] * len(rows), pa.int32()),
                pa.array(rank, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                columns.append(pa.array(own, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


class Solver:
    """Packs a histogram of lengths; ``runs`` says which ranks of a length go where."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in histogram.items():
            self.left[length] = n
        self.placed = [0] * (capacity + 1)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.sequences = 0
        self.fixed = 0

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        if n:
            self.runs.append((length, self.placed[length], n, sequence, offset))
            self.placed[length] += n
            self.left[length] -= n

    def _smallest(self, besides: int, n: int) -> list[int]:
        """The ``n`` smallest lengths left when one item of ``besides`` is taken away."""
        out: list[int] = []
        for length, count in enumerate(self.left):
            out += [length] * min(count - (length == besides), n - len(out))
            if len(out) == n:
                break
        return out

    def _best_pair(self, besides: int, room: int) -> int:
        """The largest sum of two other items that fits the room, or 0."""
        have = [count - (length == besides) for length, count in enumerate(self.left)]
        best, high = 0, min(room, self.capacity)
        for low in range(1, room // 2 + 1):
            if have[low] <= 0:
                continue
            high = min(high, room - low)
            while high > low and have[high] <= 0:
                high -= 1
            if high > low or have[low] > 1:
                best = max(best, low + max(high, low))
            if high < low:
                break
        return best

    def _dominant(self, length: int) -> tuple[bool, int]:
        """Whether a set with this length surely belongs to a best packing; its other member, or 0."""
        room = self.capacity - length
        partner = next((x for x in range(room, 0, -1) if self.left[x] > (x == length)), 0)
        if not partner:
            return True, 0
        if partner == room:
            return True, partner  # it stands for anything else that could share the sequence
        small = self._smallest(length, 3)
        if len(small) < 2 or small[0] + small[1] > room:
            return True, partner  # at most one more fits, and none is larger
        if (len(small) < 3 or sum(small) > room) and self._best_pair(length, room) <= partner:
            return True, partner
        return False, 0

    def reduce(self) -> None:
        """Fix dominant sets until a whole pass over the lengths finds none."""
        changed = True
        while changed:
            changed = False
            for length in range(self.capacity, 0, -1):
                while self.left[length]:
                    fixed, partner = self._dominant(length)
                    if not fixed:
                        break
                    n = self.left[length]
                    if partner == length:
                        n //= 2
                    elif partner:
                        n = min(n, self.left[partner])
                    first = self._open(n)
                    self._put(length, n, first, 0)
                    if partner:
                        self._put(partner, n, first, length)
                    self.fixed += n
                    changed = True

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence it fits, for all sequences alike at once."""
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]  # by room: (first sequence, count)
        for length in range(self.capacity, 0, -1):
            room = length
            while self.left[length]:
                while room <= self.capacity and not groups[room]:
                    room += 1
                if room > self.capacity:
                    room = self.capacity
                    n = -(-self.left[length] // (self.capacity // length))
                    groups[room].append((self._open(n), n))
                first, count = groups[room].pop()
                each = room // length
                full = min(count, self.left[length] // each)
                for k in range(each):
                    self._put(length, full, first, self.capacity - room + k * length)
                if full:
                    groups[room - each * length].append((first, full))
                if full < count:
                    some = self.left[length]
                    for k in range(some):
                        self._put(length, 1, first + full, self.capacity - room + k * length)
                    groups[room - some * length].append((first + full, 1))
                    if count - full > 1:
                        groups[room].append((first + full + 1, count - full - 1))

    def solve(self) -> np.ndarray:
        self.reduce()
        self.best_fit()
        return np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)


def _placed(runs: np.ndarray, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = (runs[:, 0] << 44) + runs[:, 1]
    for batch in batches:
        length, rank = (batch.column(names.index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
        at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        sequence = runs[at, 3] + rank - runs[at, 1]
        columns = [batch.column(k) for k, x in enumerate(names) if x != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sequence), pa.array(runs[at, 4])], [*(x for x in names if x != "rank"), "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with their sequence and place in it.

    ``tokenizer`` is the path of a vocabulary file for the ``tokenizers`` library that every
    worker can open. Each document's ids end with ``end_id``; only documents longer than
    ``capacity`` are cut, the first piece taking what does not fill a sequence. Returns doc_id,
    piece, start, length, ids_crc32, sequence_id and offset, and with ``with_ids`` also the ids
    as little-endian 32-bit bytes. A null or empty text is the end id alone. Rows that repeat,
    or share a doc_id or have none, are packed each. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    numbers = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = write_once(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
            partial(_pieces, tokenizer, capacity, end_id, with_ids), f"{numbers}, part int, rank long{ids}"
        ),
        "pieces",
    )
    counts = pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = write_once(counts.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "ranks")
    # At most one row for each length up to the capacity.
    histogram = {int(r[0]): int(r[1]) for r in before.groupBy("length").agg(F.sum("n")).collect()}
    runs = Solver(histogram, capacity).solve()
    ranked = pieces.join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])]
    return ranked.select(*names).mapInArrow(
        partial(_placed, runs, names), f"{numbers}{ids}, sequence_id long, offset long"
    )
