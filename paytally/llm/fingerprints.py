"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words, each with its count times the square of its length
(short words are mostly the common ones). For every sample each term draws, from a hash of the
term alone, two gamma variables and a uniform one; they turn the term's weight into a quantised
level and a race value, and the smallest value wins (improved consistent weighted sampling). The
probability that two texts draw the same term and level is their generalised Jaccard similarity,
so the share of equal samples estimates it.

Texts move once: rows are range partitioned and sorted by id, and each task walks its rows with
the next one at hand. Only the first and last row of a task wait for their neighbour task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytally.llm.hashing import chunks, mix, sliced
from paytally.storage import write_once

SAMPLES = 64
_CHUNK = 2 << 20


@cache
def _seeds(samples: int) -> np.ndarray:
    return mix(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, samples)


def _uniforms(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) of each 64-bit value."""
    scale = np.float32(2.0**-32)
    high, low = (bits >> np.uint64(32)).astype(np.float32), (bits & np.uint64(0xFFFFFFFF)).astype(np.float32)
    return (high + np.float32(0.5)) * scale, (low + np.float32(0.5)) * scale


class Draws:
    """The variables of each of some terms for each sample, drawn from the terms' hashes alone."""

    def __init__(self, terms: list[str], samples: int):
        self.index = {t: k for k, t in enumerate(terms)}
        self.hashes = np.frombuffer(
            b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in terms), dtype=np.uint64
        )
        self.squares = np.array([len(t) ** 2 for t in terms], dtype=np.float32)
        seeds = _seeds(samples)
        shape = (len(terms), samples)
        self.r, self.log_c, self.beta = (np.empty(shape, dtype=np.float32) for _ in range(3))
        for lo in range(0, len(terms), 1024):
            rows = slice(lo, lo + 1024)
            own = self.hashes[rows, None]
            u1, u2 = _uniforms(mix(own ^ seeds[0]))
            self.r[rows] = -np.log(u1 * u2)
            u1, u2 = _uniforms(mix(own ^ seeds[1]))
            self.log_c[rows] = np.log(-np.log(u1 * u2))
            self.beta[rows] = _uniforms(mix(own ^ seeds[2]))[0]

    def fingerprint(self, counts: Counter) -> np.ndarray | None:
        """16 bits of each sample, or None of a text without words."""
        if not counts:
            return None
        at = np.fromiter(map(self.index.__getitem__, counts), np.int64, len(counts))
        logs = np.log(np.fromiter(counts.values(), np.float32, len(counts)) * self.squares[at])[:, None]
        r, beta = self.r[at], self.beta[at]
        level = np.floor(logs / r + beta)
        race = self.log_c[at] - r * (level - beta + 1)
        winner = np.argmin(race, axis=0)
        level = level[winner, np.arange(race.shape[1])]
        drawn = mix(self.hashes[at[winner]] + mix(level.astype(np.int64).view(np.uint64)))
        return (drawn >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples; texts without words are like each other only."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def _bytes_of(print_: np.ndarray | None) -> bytes:
    return b"" if print_ is None else print_.tobytes()


def _words(text: str) -> Counter:
    return Counter(text.lower().split())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _described(rows: list[tuple], samples: int) -> list[tuple]:
    """The fields of all (doc_id, text) but the last, which only serves as a neighbour."""
    own = [_words(t) for _, t in rows]
    changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:])]
    other = [_words(t) for t in changed]
    terms = list(set().union(*own, *other))
    draws = Draws(terms, samples)
    prints = [draws.fingerprint(c) for c in own]
    out = []
    for k, (doc_id, text) in enumerate(rows[:-1]):
        new = draws.fingerprint(other[k])
        out.append(
            (
                doc_id, len(text), hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(),
                _bytes_of(prints[k]), _bytes_of(new), likeness(prints[k], new), likeness(prints[k], prints[k + 1]),
            )
        )
    return out


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _batch(rows: list[tuple], edges: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """Finished rows, and the first or last row of a task as (side, part, doc_id, text)."""
    part = TaskContext.get().partitionId()
    n, m = len(rows), len(edges)
    types = (id_type, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    ends: list = [[e[1] for e in edges], *([[None] * m] * 6)]
    columns = [
        pa.array([r[k] for r in rows] + ends[k], t) for k, t in enumerate(types)
    ]
    return pa.RecordBatch.from_arrays(
        [
            *columns,
            pa.array([None] * n + [e[0] for e in edges], pa.string()),
            pa.array([part] * (n + m), pa.int32()),
            pa.array([None] * n + [e[2] for e in edges], pa.string()),
        ],
        [*FIELDS, "side", "part", "text"],
    )


def _walk(samples: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describe sorted rows (doc_id, text), each with the row after it."""
    carried: tuple | None = None
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field(0).type
        rows = list(zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()), strict=True))
        for lo, hi in chunks([r[1] for r in rows], _CHUNK):
            part = rows[lo:hi]
            edges = [("first", *part[0])] if carried is None else []
            part = part if carried is None else [carried, *part]
            carried = part[-1]
            yield _batch(_described(part, samples), edges, id_type)
    if carried is not None:
        yield _batch([], [("last", *carried)], id_type)


def _pairs(samples: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describe rows (doc_id, text, following text)."""
    for batch in sliced(batches):
        ids, texts, following = (c.to_pylist() for c in batch.columns)
        rows = [_described([(i, t), (None, f)], samples)[0] for i, t, f in zip(ids, texts, following, strict=True)]
        yield pa.RecordBatch.from_arrays(_batch(rows, [], batch.schema.field(0).type).columns[: len(FIELDS)], list(FIELDS))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts, with their likeness.

    The next document is the one with the next larger doc_id (null the smallest; rows of equal
    ids by the digest of their text), and the first after the last. A fingerprint is the hex of
    16 bits for each sample, and empty for a text without words; a null text is an empty one. A
    table of one row is its own next. Other columns are not looked at; an empty table gives no
    rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double"
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = ("doc_id", "digest", "row")
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = write_once(
        ordered.mapInArrow(partial(_walk, samples), f"{described}, side string, part int, text string"), "prints"
    )
    first = walked.where("side = 'first'").select("part", F.col("text").alias("following"))
    last = walked.where("side = 'last'").select("part", "doc_id", "text")
    # One narrow row for each task: which task comes after it.
    tasks = last.select("part")
    after = Window.orderBy("part")
    chain = tasks.select("part", F.coalesce(F.lead("part").over(after), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = last.join(chain, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    both = walked.where("side is null").select(*FIELDS).union(pairs.mapInArrow(partial(_pairs, samples), described))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
