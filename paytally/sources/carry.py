"""Carrying header marks forward over the pieces of a split, a batch at a time."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers get these functions by value and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE = "source_file"
# Each mark comes with the place of its header inside its piece.
MARKS = {"group": "group_pos", "block": "block_pos"}
# An opening or closing tag that only lacks its name.
TAG_BEGUN = re.compile(r"</?(?:[\w.-]+:)?\Z")
EMPTY_ELEMENT = re.compile(r"[^<>]*/>")
# What ends a comment, a CDATA section, and the state "the tag's name is only text".
COMMENT, SECTION, TEXT = "-->", "]]>", "text"


def _before(marked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row, the last marked row strictly before it in its run, or -1."""
    place = np.arange(len(marked))
    last = np.maximum.accumulate(np.where(marked, place, -1))
    previous = np.concatenate(([-1], last[:-1]))
    run = np.maximum.accumulate(np.where(starts, place, 0))
    return np.where(previous >= run, previous, -1)


def _run_starts(file: pa.Array, split: pa.Array, at: tuple | None) -> np.ndarray:
    """Where a new split begins, ``at`` being the split of the row before the batch."""
    starts = np.empty(len(file), dtype=bool)
    starts[0] = (file[0].as_py(), split[0].as_py()) != at
    changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(split[1:], split[:-1]))
    starts[1:] = changed.to_numpy(zero_copy_only=False)
    return starts


def carry_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each mark and its place by the last before it in the split, and number the pieces.

    Beside a mark stands the number of the piece it comes from (``group_seq``, ``block_seq``). Pieces
    reach a task in file order, so a running value is all it takes. A window over (file, split)
    would give the same, but would shuffle and sort every transaction.
    """
    at: tuple | None = None
    seq = 0
    names = [n for pair in MARKS.items() for n in pair]
    running: dict[str, object] = dict.fromkeys([*names, *(f"{mark}_seq" for mark in MARKS)])
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        file, split = batch.column(FILE), batch.column("split_start")
        starts = _run_starts(file, split, at)
        continued = np.cumsum(starts) == 0
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["seq"] = pa.array(np.arange(seq, seq + n))
        for mark, pos in MARKS.items():
            marked = columns[mark].is_valid().to_numpy(zero_copy_only=False)
            previous = _before(marked, starts)
            where = pa.array(previous + 1, mask=(previous < 0) & ~continued)
            latest = n - 1 if marked[n - 1] else None
            for name, of in ((mark, columns[mark]), (pos, columns[pos]), (f"{mark}_seq", columns["seq"])):
                # Row 0 of the pool is the value carried in from the batch before.
                carried = pa.concat_arrays([pa.array([running[name]], of.type), of]).take(where)
                running[name] = (carried[n - 1] if latest is None else of[latest]).as_py()
                columns[name] = carried
        at = (file[n - 1].as_py(), split[n - 1].as_py())
        seq += n
        yield pa.RecordBatch.from_pydict(columns)


# ---- sections that hold the transaction tag --------------------------------------------------


def _open_after(text: str, kind: str | None) -> str | None:
    """Which of a comment or CDATA section is open after ``text``, by its end mark."""
    at = 0
    while True:
        if kind:
            at = text.find(kind, at)
            if at < 0:
                return kind
            at, kind = at + 3, None
        comment, section = text.find("<!--", at), text.find("<![CDATA[", at)
        if comment < 0 and section < 0:
            return None
        if section < 0 or 0 <= comment < section:
            at, kind = comment + 4, COMMENT
        else:
            at, kind = section + 9, SECTION


def _whole_after(piece: str, kind: str | None) -> str | None:
    """What keeps a piece from ending where it was cut: an open section, or a tag name that is text."""
    kind = _open_after(piece, None if kind == TEXT else kind)
    return kind or (None if TAG_BEGUN.search(piece, max(0, len(piece) - 200)) else TEXT)


def split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split of (value, file, split) rows in file order: what is open at its end, if a comment,
    a CDATA section or neither is open at its start. Three answers, as the start is not known here."""
    at: tuple | None = None
    open_: dict[str | None, str | None] = {}
    done: list[tuple] = []
    for batch in batches:
        for value, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != at:
                if at:
                    done.append((*at, *open_.values()))
                at, open_ = (file, split), {None: None, COMMENT: COMMENT, SECTION: SECTION}
            after = {kind: _whole_after(value, kind) for kind in set(open_.values())}
            open_ = {start: after[kind] for start, kind in open_.items()}
    if at:
        done.append((*at, *open_.values()))
    columns = list(zip(*done, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [FILE, "split_start", "plain", "comment", "section"])


def split_starts(ends: pd.DataFrame) -> pd.DataFrame:
    """What is open at the start of each split of a file; a row for each split."""
    ends = ends.sort_values("split_start")
    kind, kinds = None, []
    for plain, comment, section in zip(*(ends[c] for c in ("plain", "comment", "section")), strict=True):
        kinds.append(kind)
        kind = {COMMENT: comment, SECTION: section}.get(kind, plain)
    return pd.DataFrame({FILE: ends[FILE], "split_start": ends["split_start"], "kind": kinds})


def rejoin_open(tag: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put pieces (value, file, split, kind) together that were cut inside a comment or CDATA section.

    Pieces come in file order; ``kind`` is what is open where their split starts. Returns them as
    (value, file, split, at, begun, goes_on): the first goes on with what an earlier split has begun, the
    last is begun here and goes on in the next split. ``at`` numbers the pieces of a split.
    """
    at: tuple | None = None
    kind: str | None = None
    held: list[str] = []
    begun, number = False, 0
    for batch in batches:
        rows = []
        for value, file, split, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != at:
                if held:
                    rows.append((tag.join(held), *at, number, begun, True))
                at, kind, held, begun, number = (file, split), start, [], start is not None, 0
            held.append(value)
            # The tag itself is inside the section when the piece before it left one open.
            kind = _whole_after(value, kind)
            if kind is None:
                rows.append((tag.join(held), file, split, number, begun, False))
                held, begun, number = [], False, number + 1
        if rows:
            yield _rows(rows)
    if held and at:
        yield _rows([(tag.join(held), *at, number, begun, True)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["value", FILE, "split_start", "at", "begun", "goes_on"])


def write_out_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (value, file, split) with an empty transaction element, <Tag/>, as if written <Tag></Tag>."""
    last: tuple | None = None
    for batch in batches:
        rows = []
        for value, *of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = EMPTY_ELEMENT.match(value)
            if found and not (last and last[1:] == tuple(of) and re.search(r"</(?:[\w.-]+:)?\Z", last[0])):
                rows.append((f"{found[0][:-2]}></", *of))
                value = f">{value[found.end():]}"
            last = (value, *of)
            rows.append(last)
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), batch.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
