"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding drops hidden characters and accents, turns look-alike letters into plain Latin ones and
digits or signs beside letters into the letters they stand for. As a sign at the edge of a word may
also be just that ("idiot!", "@idiot"), runs of letters and signs are matched in each reading, the rest of a text in one. Entries
are whole words or beginnings of words. Their weights are log odds from labelled documents, each at the lower end of its confidence interval,
so that chance finds weigh little; a few common insults have a weight even unseen. A phrase around an entry that only clean documents have is an exception and cancels the
hit inside it, whichever reading shows it. The sum of the hits' weights, alone and against the length of the text, and the
largest weight go through a logistic curve fitted on labelled documents that the lexicon has not seen.

What is fitted comes from at most ``SAMPLE`` labelled documents of each class, chosen by a hash
of their ids; of labels that contradict each other on equal texts the toxic one counts. Entries and
exceptions are chosen by support and weight alone. The model does not depend on how rows are
partitioned, and scoring is one scan with no shuffle.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.hashing import sliced
from paytally.storage import write_once

#: Labelled documents of each class that a model is fitted on.
SAMPLE = 6_000
#: Documents whose id has this remainder are never learned from.
FOLDS = 5

PREFIXES = range(4, 9)
LEAST_WEIGHT = 2.0
Z = 1.64
SEED_WEIGHT = 4.0
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "imbecile", "filthy", "vermin")

# Letters that look alike, and signs that stand for letters.
_CYRILLIC = dict(zip("асеорхуіјѕкмнтвАСЕОРХУІЈЅКМНТВ", "aceopxyijskmhtbaceopxyijskmhtb", strict=True))
_GREEK = dict(zip("αεικνορτυχΑΕΙΚΝΟΡΤΥΧΒΗΜΖ", "aeiknoptuxaeiknoptuxbhmz", strict=True))
_FULLWIDTH = {chr(0xFF21 + k): chr(97 + k) for k in range(26)} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
ALIKE = str.maketrans(_CYRILLIC | _GREEK | _FULLWIDTH)
SIGNS = str.maketrans("013457@$!", "oieastasi")

_FOREIGN = frozenset(map(chr, ALIKE))
_HIDDEN = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf") | frozenset("\u034f\u115f\u1160\u3164")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f]")
#: Signs before, between and after letters, in a run that has a letter.
_BEFORE = re.compile(r"(?<![^\W_])[013457@$!]+(?=[^\W\d_])")
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])")
_AFTER = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?![^\W_])")
#: A mention and an exclamation are read as such where only one reading is taken.
_BEFORE_PLAIN = re.compile(r"(?<![^\W_@])[013457$!][013457@$!]*(?=[^\W\d_])")
_AFTER_PLAIN = re.compile(r"(?<=[^\W\d_])[013457@$!]*[013457@$](?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
_AFTER_SPACE = re.compile(r" [^\W\d_]+")
_SIGN_RUN = re.compile("[013457@$!]+")
_RUN = re.compile(r"(?:[^\W_]|[@$!])+")


def _plain(text: str) -> str:
    """Lower case, look-alikes replaced, hidden characters and accents dropped; signs as they are."""
    if not text.isascii():
        for hidden in _HIDDEN.intersection(text):
            text = text.replace(hidden, "")
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFC", text)
        if not _FOREIGN.isdisjoint(text):
            text = text.translate(ALIKE)
    return text.lower()


def _signs(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: m[0].translate(SIGNS), text)


def _signed(plain: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of letters, digits and signs where a sign stands beside a letter."""
    out, reach = [], 0
    for m in _SIGN_RUN.finditer(plain):
        at, end = m.span()
        if at < reach or not (_WORD.match(plain, end) or (at and _WORD.match(plain, at - 1))):
            continue
        while at > reach and (plain[at - 1].isalnum() or plain[at - 1] in "@$!"):
            at -= 1
        reach = _RUN.match(plain, at).end()
        out.append((at, reach))
    return out


def _read(run: str) -> tuple[str, ...]:
    """The readings of a run, of its length: signs replaced as in ``fold``, between letters only, also
    before them, also after them, and everywhere."""
    inside = _signs(_INSIDE, run)
    before = _signs(_BEFORE, inside)
    likely = _signs(_AFTER_PLAIN, _signs(_BEFORE_PLAIN, inside))
    return likely, inside, before, _signs(_AFTER, inside), _signs(_AFTER, before)


#: Of short runs, so that a worker's memory does not grow with what it has read.
_read_again = lru_cache(4096)(_read)


def _replaced(run: str) -> tuple[str, ...]:
    return _read_again(run) if len(run) <= 32 else _read(run)


def _spelled(plain: str, runs: list[tuple[int, int]], replaced: list[str]) -> str:
    pieces, at = [], 0
    for (start, end), run in zip(runs, replaced, strict=True):
        pieces += plain[at:start], run
        at = end
    return "".join((*pieces, plain[at:]))


def fold(text: str) -> str:
    """The likeliest reading: signs in a run with letters replaced, but for a leading ``@`` and closing ``!``."""
    plain = _plain(text)
    runs = _signed(plain)
    return _spelled(plain, runs, [_replaced(plain[a:b])[0] for a, b in runs])


def readings(text: str) -> tuple[str, list[tuple[int, int]], list[str]]:
    """A text with its signs as they are, its runs with signs, and its other distinct readings, all of one length."""
    plain = _plain(text)
    runs = _signed(plain)
    own = [plain[a:b] for a, b in runs]
    each = dict.fromkeys(zip(*map(_replaced, own), strict=True))
    each.pop(tuple(own), None)
    return plain, runs, [_spelled(plain, runs, list(replaced)) for replaced in each]


@dataclass
class Model:
    """Weights of words and word beginnings, exceptions, and the logistic curve."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-4.0, 0.3, 0.3, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry in {*self.words, *self.prefixes}:
            found.add_word(entry, (len(entry), False))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), True))
        if len(found):
            found.make_automaton()
        return found

    def _found(self, automaton, text: str, lo: int, hi: int) -> tuple[list[tuple[int, int, float]], list[tuple[int, int]]]:
        """(start, end, weight) of the weightiest entry at each place of a part of folded text, and (start, end) of the exceptions."""
        found: dict[int, tuple[int, float]] = {}
        excused = []
        for last, (size, exception) in automaton.iter(text, lo, hi):
            start, end = last - size + 1, last + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end == len(text) or not text[end].isalpha()
            if exception:
                if closed:
                    excused.append((start, end))
                continue
            entry = text[start:end]
            weight = max(self.words.get(entry, 0.0) if closed else 0.0, self.prefixes.get(entry, 0.0))
            if weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end, weight)
        return [(start, *rest) for start, rest in found.items()], excused

    def hits(self, automaton, text: str) -> list[tuple[int, int, float]]:
        """(start, end of word, weight) of the entries in folded text, exceptions taken out."""
        return _without(*self._found(automaton, text, 0, len(text))) if len(automaton) else []

    def hits_of(self, automaton, text: str) -> list[tuple[int, int, float]]:
        """The hits of all readings of a text that no reading excuses; of those that overlap the weightiest.

        Other readings differ from the plain one in runs with signs only, so they are searched
        there and as far around as an exception reaches.
        """
        if not len(automaton):
            return []
        plain, runs, others = readings(text)
        hits, excused = self._found(automaton, plain, 0, len(plain))
        if not others:
            return _without(hits, excused)
        around = max(map(len, self.exceptions), default=0)
        parts: list[list[int]] = []
        for start, end in runs:
            if parts and start - around <= parts[-1][1]:
                parts[-1][1] = min(len(plain), end + around)
            else:
                parts.append([max(0, start - around), min(len(plain), end + around)])
        for other in others:
            for lo, hi in parts:
                more = self._found(automaton, other, lo, hi)
                hits += more[0]
                excused += more[1]
        out: list[tuple[int, int, float]] = []
        for hit in _without(list(set(hits)), excused):
            if out and hit[0] < out[-1][1]:
                if hit[2] > out[-1][2]:
                    out[-1] = hit
            else:
                out.append(hit)
        return out

    def score(self, total: float, most: float, words: int) -> float:
        level = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], terms(total, most, words), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, level))))


def _without(hits: list[tuple[int, int, float]], excused: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """The hits in order of place that lie in no exception."""
    spans = sorted(excused)
    out, k, reach = [], 0, -1
    for hit in sorted(hits):
        while k < len(spans) and spans[k][0] <= hit[0]:
            reach = max(reach, spans[k][1])
            k += 1
        if hit[1] > reach:
            out.append(hit)
    return out


def terms(total: float, most: float, words: int) -> tuple[float, float, float]:
    return math.log1p(total), math.log1p(100.0 * total / (words + 20)), most


def weight_of(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Smoothed log odds less ``Z`` standard errors."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds - Z * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _counted(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many documents of a batch each feature stands."""
    for batch in sliced(batches):
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[label].update(count(fold(text or "")))
        names = list(sums[0] | sums[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([sums[k][n] for n in names], pa.int64()) for k in (1, 0))],
            ["feature", "toxic", "clean"],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (marked by a final ``$``) and their beginnings."""

    def count(text: str) -> set[str]:
        words = set(_WORD.findall(text))
        return {w + "$" for w in words} | {w[:k] for w in words for k in PREFIXES if k < len(w)}

    yield from _counted(batches, count)


def _word_before(text: str, end: int) -> str:
    """The word that ends at a space at ``end``; empty where there is none."""
    if end < 1 or text[end] != " ":
        return ""
    at = end
    while at and _WORD.match(text, at - 1, at):
        at -= 1
    return text[at:end]


def _phrases(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hit's word with the word before or after it, where one space stands between."""
    automaton = model.automaton()

    def count(text: str) -> set[str]:
        out = set()
        for start, end, _ in model.hits(automaton, text):
            word = _WORD.match(text, start)[0]
            if before := _word_before(text, start - 1):
                out.add(f"{before} {word}")
            if after := _AFTER_SPACE.match(text, start + len(word)):
                out.add(word + after[0])
        return out

    yield from _counted(batches, count)


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column as it is, then hits, their weight, words and score of the text in the second."""
    automaton = model.automaton()
    for batch in sliced(batches):
        totals, most, words, counts = [], [], [], []
        for text in batch.column(1).to_pylist():
            hits = model.hits_of(automaton, text) if text else []
            counts.append(len(hits))
            totals.append(sum(h[2] for h in hits))
            most.append(max((h[2] for h in hits), default=0.0))
            words.append(len(text.split()) if text else 0)
        scores = [model.score(*row) for row in zip(totals, most, words, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(totals, pa.float64()), pa.array(most, pa.float64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())],
            ["key", "n_hits", "weight", "largest", "n_words", "score"],
        )


def _chosen(features: list, toxic: int, clean: int) -> Model:
    """The entries that speak for toxicity, strongest first.

    Of beginnings found in the same documents the longest counts. What an accepted entry explains
    is taken off the counts of its own beginnings, and entries under an accepted one are left out.
    """
    model = Model(words=dict.fromkeys(SEEDS, SEED_WEIGHT))
    explained: dict[str, list[int]] = {}
    weighed = [(weight_of(t, c, toxic, clean), f, t, c) for f, t, c in features]
    for _, feature, in_toxic, in_clean in sorted(weighed, key=lambda x: (-x[0], -len(x[1]), x[1])):
        plain = feature.rstrip("$")
        if any(plain[:k] in model.prefixes for k in PREFIXES if k <= len(plain)):
            continue
        gone = explained.get(feature, [0, 0])
        rest = max(0, in_toxic - gone[0]), max(0, in_clean - gone[1])
        weight = weight_of(*rest, toxic, clean)
        if rest[0] < 3 or weight < LEAST_WEIGHT:
            continue
        (model.prefixes if feature == plain else model.words)[plain] = weight
        for k in PREFIXES:
            if k < len(feature):
                taken = explained.setdefault(plain[:k], [0, 0])
                taken[0] += rest[0]
                taken[1] += rest[1]
    return model


def _curve(rows: list) -> tuple[float, ...]:
    """Logistic regression of (weight, largest weight, words, label), lightly regularised, by Newton steps."""
    x = np.array([(1.0, *terms(*row[:3])) for row in rows])
    y = np.array([float(row[3]) for row in rows])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - 0.5 * beta * (0, 1, 1, 1)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag((1e-3, 0.5, 0.5, 0.5))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels(doc_id, toxic)`` over ``docs(doc_id, text)``.

    Null labels and ids are passed over; of contradicting labels of an id the toxic one counts.
    Without documents of both classes the model is the common insults with a standard curve.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = (F.xxhash64(F.col("doc_id")), F.col("doc_id"))
    both = [known.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    # At most 2 * sample ids, so they may be sent to every task.
    chosen = F.broadcast(both[0].union(both[1]))
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    train = train.groupBy("text").agg(F.max("label").alias("label"))
    train = write_once(train.withColumn("for_curve", F.abs(F.xxhash64("text", F.lit("curve"))) % 10 < 3), "labelled")
    sizes = {r[0]: r[1] for r in train.where("not for_curve").groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(words=dict.fromkeys(SEEDS, SEED_WEIGHT))
    learn = train.where("not for_curve").select("label", "text")
    counted = "feature string, toxic long, clean long"
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    support = max(3, round(0.002 * sizes[1]))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    weight = odds - Z * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = (
        learn.mapInArrow(_entries, counted).groupBy("feature").agg(*sums)
        .where((F.col("toxic") >= support) & (weight >= LEAST_WEIGHT))
    )
    model = _chosen([tuple(r) for r in strong.collect()], sizes[1], sizes[0])
    phrases = learn.mapInArrow(partial(_phrases, model), counted).groupBy("feature").agg(*sums).where("clean >= 2 and toxic = 0")
    model.exceptions = frozenset(r[0] for r in phrases.collect())
    curve = train.where("for_curve").select(F.col("label").alias("key"), "text")
    rows = curve.mapInArrow(partial(_scored, model), "key int, n_hits long, weight double, largest double, n_words long, score double")
    cases = sorted(tuple(r) for r in rows.select("weight", "largest", "n_words", "key").collect())  # 2 * sample rows at most
    if len({c[3] for c in cases}) == 2:
        model.curve = _curve(cases)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits and n_words for every row of ``docs(doc_id, text)``.

    Null and empty texts have no hits and the score of a text without any. Rows that repeat are
    scored each; a null id is not held out; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_scored, model), f"key {kind}, n_hits long, weight double, largest double, n_words long, score double"
    )
    return scored.select(
        F.col("key").alias("doc_id"),
        F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits",
        "n_words",
    )


def _clean(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = model.automaton()
    for batch in sliced(batches):
        keep = []
        for text in batch.column(at).to_pylist():
            hits = [h[2] for h in model.hits_of(automaton, text)] if text else []
            keep.append(model.score(sum(hits), max(hits, default=0.0), len(text.split()) if text else 0) < 0.5)
        yield batch.filter(pa.array(keep, pa.bool_()))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text scores below 0.5."""
    return docs.mapInArrow(partial(_clean, model, docs.columns.index("text")), docs.schema)
