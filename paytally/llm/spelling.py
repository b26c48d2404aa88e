"""Spelling variants: words one edit apart, found by composing acceptors with a one-edit transducer.

The method is the finite-state composition V o E o V: V accepts the vocabulary, minimised, and E rewrites a
word with exactly one letter inserted, deleted or replaced. Accepted pairs are enumerated for one initial state at a
time, so no task ever holds the whole vocabulary: a partition is the words that leave one state of V (they share
what was read before, the prefix) or, read backwards, one state of the acceptor of reversed words (they share a
suffix). With c the length of the shorter word of a pair and p the place of the edit, 0 <= p <= c, a pair lies in
the partition (c, lo, hi, first lo letters, last c - hi letters) for which lo <= p < hi; an edit that could stand at
several places (a double letter) counts as the last of them, so each pair is accepted once, in one partition.
Places are first halved, which is one partition by prefix and one by suffix; a partition of more than
``partition_words`` words is halved again, until one place is left: there only one or two letters are free and the
number of words is bounded by the alphabet. So hot prefixes are split, exactly and at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.storage import write_once

#: Words that a partition may hold before it is split further.
PARTITION_WORDS = 4_000
#: What counts as a run of letters.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the vocabulary ---------------------------------------------------------------------------------------------


def letter_runs(docs: DataFrame, misspell_one_in: int | None = None) -> DataFrame:
    """``word``: every maximal run of letters of ``docs(doc_id, text)``, A-Z in lower case.

    With ``misspell_one_in`` set, a run loses a letter where that number divides the crc32 of ``<doc_id>:<run>``
    (h): the one at h modulo its length. Null texts have no runs; a null doc_id counts as an empty one.
    """
    run = F.translate("run", UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"),
    ).select("id", run.alias("run"))
    if misspell_one_in is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % misspell_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) for the words of ``runs(word)`` long and frequent enough."""
    counted = runs.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- acceptors and their composition ------------------------------------------------------------------------------


class Acceptors:
    """Minimal acyclic acceptors that share their states: equal state numbers, equal right languages."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._meets: dict[tuple[int, int], bool] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        form = (final, *arcs.items())
        state = self._known.get(form)
        if state is None:
            state = self._known[form] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def start(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted distinct ``words``."""
        path: list[tuple[str, list]] = []  # letters of the last word with [final, arcs] of the state each leads to
        root: list = [False, {}]

        def close(depth: int) -> None:
            while len(path) > depth:
                letter, (final, arcs) = path.pop()
                above = path[-1][1] if path else root
                above[1][letter] = self._state(final, arcs)

        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same)
            path.extend((letter, [False, {}]) for letter in word[same:])
            (path[-1][1] if path else root)[0] = True
            last = word
        close(0)
        return self._state(*root)

    def meets(self, s: int, t: int) -> bool:
        """Whether some word leads from both states to final ones."""
        if s == t:
            return True
        known, first = self._meets, (min(s, t), max(s, t))
        open_ = [first]
        while open_:
            pair = open_[-1]
            a, b = self.arcs[pair[0]], self.arcs[pair[1]]
            found: bool | None = self.final[pair[0]] and self.final[pair[1]]
            for letter in a if not found else ():
                if letter not in b:
                    continue
                below = (min(a[letter], b[letter]), max(a[letter], b[letter]))
                found = True if below[0] == below[1] else known.get(below)
                if found is None:
                    open_.append(below)
                if found is not False:
                    break
            if found is not None:
                known[pair] = found
                open_.pop()
        return known[first]

    def _together(self, s: int, t: int, not_first: str = "") -> Iterator[tuple[int, int, list[str]]]:
        """The pairs of states that equal words lead to, with the letters read; such words need not be accepted."""
        path: list[str] = []
        open_ = [(s, t, 0, "")]
        while open_:
            s, t, depth, letter = open_.pop()
            if depth:
                path[depth - 1 :] = [letter]
            yield s, t, path
            b = self.arcs[t]
            for letter, after in self.arcs[s].items():
                if letter in b and (depth or letter != not_first):
                    open_.append((after, b[letter], depth + 1, letter))

    def common(self, s: int, t: int, not_first: str = "") -> Iterator[str]:
        """The words that both states accept, but those that begin with ``not_first``."""
        path: list[str] = []
        open_ = [(s, t, 0, "")] if self.meets(s, t) else []
        while open_:
            s, t, depth, letter = open_.pop()
            if depth:
                path[depth - 1 :] = [letter]
            if self.final[s] and self.final[t]:
                yield "".join(path)
            b = self.arcs[t]
            for letter, after in self.arcs[s].items():
                if letter in b and (depth or letter != not_first) and self.meets(after, b[letter]):
                    open_.append((after, b[letter], depth + 1, letter))

    def replaced(self, s: int) -> Iterator[tuple[str, str]]:
        """Pairs of one acceptor's words that differ by one replaced letter."""
        for state, _, path in self._together(s, s):
            arcs = list(self.arcs[state].items())
            for k, (x, after) in enumerate(arcs):
                for y, other in arcs[k + 1 :]:
                    for rest in self.common(after, other):
                        read = "".join(path)
                        yield read + x + rest, read + y + rest

    def inserted(self, s: int, t: int) -> Iterator[tuple[str, str, str]]:
        """(u, letter, v): ``u`` from ``s``, ``v`` from ``t``, which is ``u`` with that letter put in at the last place it can be."""
        for left, right, path in self._together(s, t):
            for letter, after in self.arcs[right].items():
                for rest in self.common(left, after, not_first=letter):
                    read = "".join(path)
                    yield read + rest, letter, read + letter + rest


def _shared(words: list[str]) -> int:
    """How many first letters all ``words`` share; the least and the greatest tell."""
    a, b = min(words), max(words)
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))


def accepted(c: int, hi: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of a partition's words (of c and c + 1 letters) one edit apart at a place before ``hi``.

    What all words share at either end is read once; the acceptors hold what is between. No place of an edit lies
    in a shared beginning. One that ends the part between goes on into the shared end over equal letters.
    """
    if len(words) < 2 or min(map(len, words)) > c:
        return
    begin = _shared(words)
    end = min(_shared([w[::-1] for w in words]), c - begin)
    prefix, suffix = words[0][:begin], words[0][len(words[0]) - end :]
    between = sorted(w[begin : len(w) - end] for w in words)
    machine = Acceptors()
    s = machine.start([w for w in between if len(w) == c - begin - end])
    t = machine.start([w for w in between if len(w) > c - begin - end])
    for u, v in machine.replaced(s):
        yield prefix + u + suffix, prefix + v + suffix
    for u, letter, v in machine.inserted(s, t):
        if v != u + letter or c - len(suffix.lstrip(letter)) < hi:
            yield prefix + u + suffix, prefix + v + suffix


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every partition in rows (c, lo, hi, place, word, n) that come partition by partition."""
    names, types = ("word", "near", "near_n"), (pa.string(), pa.string(), pa.int64())
    out: tuple[list, list, list] = ([], [], [])
    group, counts = None, {}

    def pairs() -> None:
        for u, v in accepted(group[0], group[2], list(counts)):
            for a, b in ((u, v), (v, u)):
                out[0].append(a)
                out[1].append(b)
                out[2].append(counts[b])

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], list(names))
        for x in out:
            x.clear()
        return made

    for rows in batches:
        *keys, words, ns = (x.to_pylist() for x in rows.columns)
        for key, word, n in zip(zip(*keys, strict=True), words, ns, strict=True):
            if key != group:
                if len(counts) > 1:
                    pairs()
                    if len(out[0]) > 20_000:
                        yield batch()
                group, counts = key, {}
            counts[word] = n
    if len(counts) > 1:
        pairs()
    yield batch()


# --- partitions -----------------------------------------------------------------------------------------------------


def _halves(words: DataFrame, mid: Column) -> DataFrame:
    """Each row (c, lo, hi, word, n) for both halves of its places."""
    return words.select(
        "c",
        F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))).alias("half"),
        "word",
        "n",
    ).select("c", "half.lo", "half.hi", "word", "n")


def _placed(words: DataFrame) -> DataFrame:
    """With the shared letters that, beside c, lo and hi, name a row's partition."""
    kept = F.greatest(F.lit(0), F.col("c") - F.col("hi"))
    shared = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("|"), F.when(kept > 0, F.substring(F.col("word"), F.length("word") - kept + 1, kept)).otherwise(""))
    return words.withColumn("place", shared)


_PARTITION = ("c", "lo", "hi", "place")


def partitions(words: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """Rows (c, lo, hi, place, word, n): every word in all partitions that its pairs can lie in."""
    length = F.length("word")
    shorter_or_longer = words.select(F.explode(F.array(length, length - 1)).alias("c"), "word", "n").where("c > 0")
    rows = _placed(
        _halves(
            shorter_or_longer.select("c", F.lit(0).alias("lo"), (F.col("c") + 1).alias("hi"), "word", "n"),
            F.expr("c div 2").cast("int"),
        ).where("lo < hi")
    )
    done: list[DataFrame] = []
    while True:
        rows = write_once(rows, "spelling-partitions")
        large = rows.groupBy(*_PARTITION).count().where((F.col("count") > partition_words) & (F.col("hi") - F.col("lo") > 1))
        large = write_once(large.select(*_PARTITION), "spelling-large")
        if large.isEmpty():
            break
        done.append(rows.join(large, list(_PARTITION), "left_anti"))
        again = rows.join(large, list(_PARTITION), "left_semi")
        rows = _placed(_halves(again, F.expr("(lo + hi) div 2").cast("int")))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def near_pairs(words: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """(word, near, near_n): both directions of every pair of ``words(word, n)`` one edit apart."""
    rows = partitions(words, partition_words).select(*_PARTITION, "word", "n")
    dealt = rows.repartition(*_PARTITION).sortWithinPartitions(*_PARTITION)
    return dealt.mapInArrow(_compose, "word string, near string, near_n long")


# --- forms and roots --------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: where the chain of forms ends.

    Pointer jumping: a round halves what is left of every chain. Counts at least double from a word to its form, so
    there is no ring and a chain is no longer than the logarithm of the largest count.
    """
    steps = write_once(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(onward, "root", "left_semi").isEmpty():
            return steps
        steps = write_once(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def group_variants(words: DataFrame, ratio: int = 2, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """The vocabulary ``words(word, n)`` with each word's usual form and the root of its group.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its
    near word of largest n (of several, the smallest in code-point order) if that n is at least ``ratio`` times its
    own, else null; ``ratio`` is at least 2, so that forms make no ring. The root is the last of the chain of forms,
    the word itself if it has none. Returns word, form, root, n, n_near (number of near words) and form_n.

    Repeated words, null words and other columns: ``words`` has each word once, as ``vocabulary`` makes them; null
    words must not occur. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, else forms could make a ring")
    words = write_once(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    stats = near_pairs(words, partition_words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(stats, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    usual = F.col("near_n") >= ratio * F.col("n")
    formed = write_once(
        joined.select("word", "n", "n_near", F.when(usual, F.col("near")).alias("form"), F.when(usual, F.col("near_n")).alias("form_n")), "spelling-forms"
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, misspell_one_in: int | None = None, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """Spelling variants among the words of ``docs(doc_id, text)``; see the functions it is made of.

    Texts that are null, empty or without letters give nothing, long texts are read whole, rows that repeat count
    again, and columns beyond the two are not looked at.
    """
    return group_variants(vocabulary(letter_runs(docs, misspell_one_in), least_letters, least_count))
