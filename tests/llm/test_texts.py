"""Operators on documents against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paytally.llm import decontamination, fingerprints, near_duplicates, packing, personal_data, repeated_strings, sharding, toxicity
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    kept = cases.documents(spark).cache()
    yield kept
    kept.unpersist()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicates(docs, rows):
    sets = {t: shingles(t) for _, t in rows}
    group = {t: t for t in sets}

    def top(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    least = {}
    for i, t in rows:
        if sets[t] and i is not None:
            least[top(t)] = min(least.get(top(t), i), i)
    expected = Counter(
        (i, len(sets[t]), c, i == c) for i, t in rows for c in [least.get(top(t)) if sets[t] else i]
    )
    got = near_duplicates.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == expected


def test_large_group_of_near_copies(spark):
    """A chain of small changes, all in one component, and a group of equal texts."""
    base = [f"w{k}" for k in range(120)]
    chain = []
    for k in range(60):
        base[2 * k] = f"new{k}"
        chain.append((k, " ".join(base)))
    chain += [(100 + k, "the same few words in every row") for k in range(50)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 100} == {0}
    assert {r.component_id for r in got if r.doc_id >= 100} == {100}
    assert sum(r.kept for r in got) == 2


def on_one_template(n, planted, seed):
    """``n`` texts of 240 words at similarity 0.66 to 0.70, of which 2 * ``planted`` are pairs at 0.75 or a little more."""
    pick = np.random.default_rng(seed)
    template = [f"t{k}" for k in range(240)]
    rows = []
    for k in range(n):
        words = list(template)
        for at in range(5, 235, 28):
            words[at] = f"x{k}y{at}"
        if k < 2 * planted:  # one place less is their own, the rest is shared
            for at in range(5, 235, 28)[: 3]:
                words[at] = f"p{k // 2}y{at}"
        rows.append((k, " ".join(words)))
    return [rows[k] for k in pick.permutation(n)]


def test_links_in_a_dense_region(spark):
    """Pairs among many texts on one template, which are hardly ever next to each other in an order."""
    rows = on_one_template(1500, 60, 4)
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(2 * k, 2 * k + 1) >= 0.75 for k in range(60)) and 0.6 < alike(0, 2) < 0.75 and 0.6 < alike(500, 501) < 0.75
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 if k < 120 else k for k in range(1500)}


def test_one_document_of_each_group_stays(spark):
    """Groups without ids, and groups whose smallest id stands on several texts."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(100)]
    near = [" ".join([*words[:-1], f"end{k}"]) for k in range(3)]
    other = [" ".join([f"o{k}" for k in range(99)] + [f"end{k}"]) for k in range(3)]
    rows = [(None, t) for t in near] + [(7, t) for t in other] + [(None, "on its own"), (None, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()]
    assert len(left) == 5 and {(None, "on its own"), (None, ""), (8, None)} <= set(left)
    assert sum(t in near for _, t in left) == 1 and sum(t in other for _, t in left) == 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, rows, block_bytes):
    texts = cases.texts()
    items = [(1, texts[2][:300]), (2, "one two"), (3, None), (4, ""), (None, texts[9]), (10, texts[9]), (10, "w5 W6, w7"), (11, "not there")]
    windows: dict[tuple, set] = {}
    for i, t in items:
        words = WORD.findall(lower(t))
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(i)
    expected = []
    for i, t in rows:
        words, hit, found = WORD.findall(lower(t)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (names := windows.get(tuple(words[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= names
        names = sorted(str(x) for x in found if x is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        expected.append((i, len(words), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(docs, benchmark, block_bytes=block_bytes).drop("items", "hits").collect()
    assert Counter(map(tuple, got)) == Counter(expected)
    assert decontamination.find_contamination(docs, benchmark.limit(0)).where("n_hit > 0").isEmpty()
    kept = decontamination.reject(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    dirty = Counter(e[0] for e in expected if e[5])
    assert dirty and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, _ in rows) - dirty


@pytest.mark.parametrize("most", [20_000, 9, 2])
def test_repeated_strings(docs, rows, most, monkeypatch):
    monkeypatch.setattr(repeated_strings, "SORTED_AT_MOST", most)
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    expected = []
    for i, d in data:
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        expected.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = repeated_strings.remove_repeats(docs).drop("removed").collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def test_suffix_order_survives_colliding_hashes(monkeypatch):
    """With hashes that tell nothing apart the bytes decide."""
    pick = np.random.default_rng(3)
    data = [bytes(pick.integers(97, 99, 40, dtype=np.uint8)) for _ in range(60)]
    make = lambda: repeated_strings.Neighbourhoods(np.zeros(60, np.int64), np.full(60, 10), data, 30, 20)
    expected = make().repeated()
    monkeypatch.setattr(repeated_strings.Neighbourhoods, "_hash", lambda self, i, size, way: np.zeros(len(i), np.uint64))
    assert (make().repeated() == expected).all()
    counts = Counter((d, row[10 - d : 40 - d]) for row in data for d in range(11))
    assert all(expected[k, d] == (counts[d, row[10 - d : 40 - d]] > 1) for k, row in enumerate(data) for d in range(11))


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    extra = [(2000, "tab\tand  two spaces \n\n lines"), (2001, "x<|endoftext|>y it's 12 €uro 😀"), (2002, " lead\ntrail ")]
    both = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    got = packing.pack(both, path, capacity=64, with_ids=True).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) * 1.1 + 1
    expected = Counter()
    for i, t in [*rows, *extra]:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        start, size, piece = 0, (len(ids) - 1) % 64 + 1, 0
        while start < len(ids):
            own = np.array(ids[start : start + size], dtype="<u4").tobytes()
            expected[(i, piece, start, size, zlib.crc32(own), own)] += 1
            start, size, piece = start + size, 64, piece + 1
    fields = zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, got.ids, strict=True)
    assert Counter((None if i != i else int(i), int(a), int(b), int(c), int(d), bytes(e)) for i, a, b, c, d, e in fields) == expected


@pytest.mark.parametrize("seed", range(6))
def test_packing_solver(seed):
    """Every item is placed once, nothing overlaps, and few sequences are used."""
    pick = np.random.default_rng(seed)
    lengths = pick.integers(1, 33, 300) if seed % 2 else np.minimum(32, pick.geometric(0.12, 300))
    counts = Counter(lengths.tolist())
    solver = packing.Solver(dict(counts), 32)
    used: dict[int, list] = {}
    placed = Counter()
    for length, _, n, sequence, offset in solver.solve().tolist():
        placed[length] += n
        for k in range(n):
            used.setdefault(sequence + k, []).append((offset, offset + length))
    assert placed == counts and len(used) == solver.sequences
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 32 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert solver.sequences <= -(-int(lengths.sum()) // 32) * 1.06 + 1


def test_small_packings_are_best():
    """Reduction and best fit against an exhaustive search on tiny instances."""
    pick = np.random.default_rng(9)

    def best(items, bins):
        if not items:
            return len(bins)
        low = len(items) + len(bins)
        for k in range(len(bins) + 1):
            room = bins[k] if k < len(bins) else 10
            if items[0] <= room:
                new = [*bins[:k], room - items[0], *bins[k + 1 :]]
                low = min(low, best(items[1:], new))
        return low

    for _ in range(40):
        items = sorted(pick.integers(1, 11, 7).tolist(), reverse=True)
        solver = packing.Solver(dict(Counter(items)), 10)
        solver.reduce()
        fixed = solver.sequences
        rest = [x for x, n in enumerate(solver.left) for _ in range(n)][::-1]
        assert fixed + best(rest, []) == best(items, [])  # what is fixed loses nothing


def test_sharding(docs, rows):
    got = sharding.shards(docs, 5).toPandas()
    assert len(got) == len(rows)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    totals = got.groupby("shard")["size"].sum()
    assert set(totals.index) <= set(range(5)) and totals.max() - totals.sum() / 5 <= got["size"].max()
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))


def test_shards_of_small_rows_are_nearly_equal(spark):
    many = spark.createDataFrame([(k, f"text {k % 300}") for k in range(3000)], "doc_id long, text string")
    totals = sharding.shards(many, 7).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(totals) == 7 and totals.max() - totals.min() <= 2 * (len("text 299") + 8)


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprints(docs).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    expected = []
    for k, (i, t) in enumerate(order):
        changed = fingerprints.edited(t or "", order[(k + 1) % len(order)][1] or "")
        expected.append((i, len(t or ""), hashlib.sha256(changed.encode()).hexdigest()))
    fields = zip(got.doc_id, got.n_chars, got.edited_sha256, strict=True)
    assert Counter((None if i != i else int(i), int(n), s) for i, n, s in fields) == Counter(expected)
    of = {(None if i != i else int(i), int(n)): f for i, n, f in zip(got.doc_id, got.n_chars, got.fingerprint, strict=True)}
    assert of[(1003, 7)] == of[(1004, 7)] != of[(None, 15)]
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_fingerprints_estimate_weighted_jaccard():
    texts = [t for t in cases.texts() if t]
    counts = [fingerprints._words(t) for t in texts]
    draws = fingerprints.Draws(list(set().union(*counts)), 512)
    prints = [draws.fingerprint(c) for c in counts]
    errors = []
    for a in range(len(texts)):
        for b in range(a):
            words = counts[a] | counts[b]
            weight = lambda c, w: c[w] * len(w) ** 2
            real = sum(min(weight(counts[a], w), weight(counts[b], w)) for w in words) / sum(
                max(weight(counts[a], w), weight(counts[b], w)) for w in words
            )
            errors.append(fingerprints.likeness(prints[a], prints[b]) - real)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def accepted(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    weighed = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return 12 <= len(digits) <= 19 and sum(w - 9 * (w > 9) for w in weighed) % 10 == 0


PRIVATE = [
    (3000, "a@b.c.d@e.f x@y.com+z@w.org 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.004 +49 (171) 123-4567- 4111 1111 1111 1111 é"),
    (3001, "1-" * 4000 + "1"),
    (3002, "😀 jo@x.de 😀 4111-1111-1111-1111, 4111111111111112 +1 437 555-0689"),
    (3003, "%" * 5000 + "@" + "x" * 50),
    (3004, "+1 (437) 555-0689\n+1 (437) 555-0689 and 10.0.0.1@host.example"),
]


def test_personal_data(spark):
    docs = cases.documents(spark, PRIVATE)
    expected = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        spans = sorted(
            (m.start(), rank, m.end(), kind)
            for rank, (kind, pattern) in enumerate(BASE)
            for m in re.finditer(pattern, t or "")
            if accepted(kind, m[0])
        )
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        expected[(i, *(sum(s[3] == k for s in spans) for k, _ in BASE), hashlib.sha256(joined.encode()).hexdigest())] += 1
    got = personal_data.report(docs).collect()
    assert Counter(tuple(r)[:-1] for r in got) == expected
    assert all(r.spans == "" or re.fullmatch(r"(email|ip|card|phone):\d+:\d+(,(email|ip|card|phone):\d+:\d+)*", r.spans) for r in got)


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "at jo@x.de, 10.0.0.1!", "k", 1), (2, None, "k", 2), (3, "plain", "k", 3)], "doc_id long, text string, digest string, cuts int")
    got = {r.doc_id: tuple(r) for r in personal_data.redact(docs).collect()}
    assert got == {1: (1, "at [EMAIL], [IP]!", "k", 1), 2: (2, None, "k", 2), 3: (3, "plain", "k", 3)}


def test_copies_do_not_fill_the_sample(spark):
    """A thousand copies of each of a few texts leave the other cases in a small sample."""
    few = [("email", f"a{k}@x.de", "mail ", " now", True) for k in range(40)] + [("ip", f"{k}.1.1.999", "v ", " .", False) for k in range(40)]
    names = "kind string, match string, before string, after string, accepted boolean"
    once = spark.createDataFrame(few, names)
    many = once.unionAll(once.join(spark.range(1000)).drop("id"))
    plain, copied = (personal_data._fit(d, 60) for d in (once, many))
    assert plain is not None and copied is not None
    trees = lambda model: model.toDebugString.partition("\n")[2]
    assert copied[2] == plain[2] and trees(copied[0]) == trees(plain[0])


def test_every_case_is_learned_from(spark):
    """More cases than any bound: each counts, those with equal features by their number."""
    many = spark.range(30_000).selectExpr(
        "if(id % 2 = 0, 'email', 'ip') kind", "if(id % 2 = 0, concat('a', id, '@x.de'), concat(id, '.1.1.999')) match",
        "'mail ' before", "' now' after", "id % 2 = 0 accepted",
    )
    model, assembler, threshold = personal_data._fit(many)
    # 15,000 mails, each also written around, broken ones that are all alike, 15,000 refused addresses; a quarter held out.
    root = model._java_obj.trees()[0].rootNode().impurityStats().count()
    assert threshold < 1 and 33_000 < root < 34_500


def test_written_around_data_is_found(spark):
    """The trees add spans that the base patterns miss."""
    pick = np.random.default_rng(1)
    number = lambda: f"({pick.integers(200, 999)}) 555-{pick.integers(1000, 9999)}"
    rows = [(k, f"some words ring +1 {number()} and more words") for k in range(80)]
    rows += [(100 + k, f"order 2024-{pick.integers(10, 12)}-{pick.integers(10, 28)} of {pick.integers(10**15, 10**16)} things") for k in range(40)]
    rows += [(200, "some words ring (437) 555-0689 and more words")]
    got = {r.doc_id: r for r in personal_data.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].n_phone == 0 and got[200].spans == "phone:16:30"


def test_toxicity(spark):
    pick = np.random.default_rng(2)
    words = ["".join(pick.choice(list("abdefgilmnoprst"), 5)) for _ in range(200)]
    rows, labels = [], []
    for k in range(600):
        text = [str(w) for w in pick.choice(words, 40)]
        if k % 5 == 0:
            for at in pick.integers(0, 40, 3):
                text[at] = str(pick.choice(["zorgling", "zorgba", "zorgot"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 5 == 0)))
    rows += [(None, None), (1000, ""), (1001, "Z0rgling zоrgba ZORGOT " + rows[1][1]), (1001, rows[1][1]), (1002, cases.LONG)]
    labels += [(None, 1), (1, None), (5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 600}
    held = [i for i in by_id if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in by_id if by_id[i].held_out} == set(held)
    assert sum(by_id[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert sorted(r.predicted for r in got if r.doc_id == 1001) == [0, 1]  # look-alikes are seen through
    assert toxicity.reject(docs, toxicity.Model()).count() == len(rows)


@pytest.mark.parametrize(
    "word",
    [
        "1diot", "1d10t", "idi0t", "!diot", "idiot!", "@idiot", "idiot1", "1diot!", "@1d10t!!", "id\u200biot", "i\u00addiot",
        "\ufeffidiot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\u00edd\u00ef\u00f3t", "i\u0336d\u0336iot", "\uff49diot", "idiоt",
    ],
)
def test_every_disguise_is_a_hit(word):
    model = toxicity.Model(words={"idiot": 4.0})
    automaton = model.automaton()
    assert [h[2] for h in model.hits_of(automaton, f"such an {word} he is, and 1 more for $100")] == [4.0]


def test_signs_at_the_edges():
    folded = [toxicity.fold(t) for t in ("1diot", "$tupid", "5cum", "7rash", "1d10t", "trash!", "@scum", "$100 1 5")]
    assert folded == ["idiot", "stupid", "scum", "trash", "idiot", "trash!", "@scum", "$100 1 5"]


def test_exceptions_cancel_hits():
    model = toxicity.Model(words={"trash": 4.0}, exceptions=frozenset({"trash can"}))
    automaton = model.automaton()
    assert [h[0] for h in model.hits(automaton, "the trash can is trash, trashy")] == [17]


@pytest.mark.parametrize("text", ["the trash can!", "trash can$", "@trash can", "7rash c4n", "a tra5h can", "!trash can! 0k"])
def test_exceptions_beside_signs(text):
    model = toxicity.Model(words={"trash": 4.0}, prefixes={"idio": 3.0}, exceptions=frozenset({"trash can"}))
    automaton = model.automaton()
    assert model.hits_of(automaton, text) == []
    assert [h[2] for h in model.hits_of(automaton, text + "; 1d1ots, trash c4nned")] == [3.0, 4.0]


def test_hits_equal_a_plain_search():
    """Whole texts in every reading, entries found by looking at every place."""
    model = toxicity.Model(words={"sot": 2.0, "tat": 3.0, "so": 1.5, "i": 1.0}, prefixes={"sota": 2.5, "oi": 1.25}, exceptions=frozenset({"so tat", "a sot", "i i"}))
    automaton = model.automaton()

    def plainly(text):
        inside = toxicity._signs(toxicity._INSIDE, text)
        before = toxicity._signs(toxicity._BEFORE, inside)
        likely = toxicity._signs(toxicity._AFTER_PLAIN, toxicity._signs(toxicity._BEFORE_PLAIN, inside))
        found, excused = set(), []
        for r in (text, inside, likely, before, toxicity._signs(toxicity._AFTER, inside), toxicity._signs(toxicity._AFTER, before)):
            for at in range(len(r)):
                if at and r[at - 1].isalpha():
                    continue
                closed = lambda e: not r[at + len(e) : at + len(e) + 1].isalpha()  # noqa: B023, E731
                excused += [(at, at + len(e)) for e in model.exceptions if r.startswith(e, at) and closed(e)]
                best = [(w, len(e)) for e, w in model.words.items() if r.startswith(e, at) and closed(e)]
                best += [(w, len(e)) for e, w in model.prefixes.items() if r.startswith(e, at)]
                if best:
                    found.add((at, at + max(best)[1], max(best)[0]))
        out = []
        for hit in sorted(h for h in found if not any(a <= h[0] and h[1] <= b for a, b in excused)):
            if out and hit[0] < out[-1][1]:
                out[-1] = max(out[-1], hit, key=lambda h: (h[2], -h[0]))
            else:
                out.append(hit)
        return out

    pick = np.random.default_rng(11)
    texts = ["".join(pick.choice(list("ssooottaai   1057$@!.29_"), 60)) for _ in range(3000)]
    got = [model.hits_of(automaton, t) for t in texts]
    assert got == [plainly(t) for t in texts] and sum(map(len, got)) > 3000


def test_toxicity_model_does_not_depend_on_partitions(spark):
    """Equal texts with contradicting labels, words of two and of 45 letters among the learned ones."""
    long = "zorg" * 11 + "x"
    rows = [(k, f"plain words {k} here" + (f" qx {long}" if k % 3 == 0 else "")) for k in range(1200)]
    labels = [(k, int(k % 3 == 0)) for k in range(1200)]
    rows += [(1200 + k, f"other words {k % 40} here") for k in range(160)]
    labels += [(1200 + k, k % 3 % 2) for k in range(160)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, seven = (toxicity.fit(docs.repartition(n), known.repartition(n)) for n in (1, 7))
    assert one == seven and "qx" in one.words
    assert long in one.words or any(long.startswith(p) for p in one.prefixes)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: near_duplicates.near_duplicates(d),
        lambda d: repeated_strings.remove_repeats(d),
        lambda d: sharding.shards(d, 3),
        lambda d: fingerprints.fingerprints(d),
        lambda d: personal_data.report(d),
        lambda d: personal_data.redact(d),
        lambda d: decontamination.find_contamination(d, d.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")),
        lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "size as toxic"))),
    ],
)
def test_no_rows(spark, run):
    assert run(cases.none(spark)).count() == 0


def test_packing_no_rows(spark):
    import public_tokenizers

    assert packing.pack(cases.none(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_words_are_forgotten_only_when_they_are_not_met_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    words, learned = packing.Words(), []
    for met in ("ab", "abcde", "af", "agh", "aij", "b"):
        new = words.unknown(set(met))
        learned += new
        words.now.update({w: w.encode() for w in new})
        assert set(met) <= set(words.now)
    assert learned.count("a") == 1 and learned.count("b") == 2


def test_words_encoded_together_are_as_alone(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a", "", "don't", "'s", "...", "1,000.50", "<|endoftext|>", "x<|endoftext|>y", "é", "日本語", "́x", "🙂", "\x00", "!?", "", "_"]
    words += [f"w{n * n}{'xyz'[n % 3]}q" for n in range(700)]
    monkeypatch.setattr(packing, "TOGETHER", 7)
    calls = []
    alone = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: calls.append(len(texts)) or alone(texts))
    for prefix in ("", " "):
        assert encoder._each(words, prefix) == alone([prefix + w for w in words])
    # Only groups in which a line feed is taken in are encoded word by word.
    assert sum(calls) <= 4 * 7
