"""Spelling variants against a plain version of the contract."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from paytally.llm import spelling
from tests.llm import cases


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_groups(counts: dict[str, int]) -> set[tuple]:
    forms, out = {}, set()
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[word] = best if best and counts[best] >= 2 * n else None
        out.add((word, n, len(others)))
    rows = set()
    for word, n, n_near in out:
        root = word
        while forms[root]:
            root = forms[root]
        rows.add((word, forms[word], root, n, n_near, counts.get(forms[word])))
    return rows


def expected(rows) -> set[tuple]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return expected_groups({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})


def misspelt_rows() -> list[tuple]:
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdeéÿß") for _ in range(pick.randint(4, 9))) for _ in range(60)]
    words += ["aabbaa", "aabbaaa", "aaabbaa", "aabba", "abbaa", "Straße", "straÄe", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    rows = []
    for k in range(150):
        own = []
        for _ in range(pick.randint(0, 60)):
            w = pick.choice(words)
            if pick.random() < 0.2:
                i = pick.randrange(len(w))
                w = w[:i] + pick.choice(["", "a", "e", w[i] + "b"]) + w[i + 1 :]
            own.append(w.upper() if pick.random() < 0.1 else w)
        rows.append((k, pick.choice([" ", "-", "7", "\n"]).join(own)))
    return [*rows, (None, rows[1][1]), (None, rows[1][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "12 34 … 漢字")]


def test_variants_equal_the_plain_contract(spark):
    rows = misspelt_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, "q", 2) for i, t in rows], "doc_id long, text string, word string, n int, near string, c int")
    got = spelling.spelling_variants(docs, misspell_one_in=97)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)


def test_text_ids(spark):
    rows = [(f"id{i}", t) for i, t in misspelt_rows()[:40]]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id string, text string"), misspell_one_in=97).collect()
    assert {tuple(r) for r in got} == expected(rows)


@pytest.mark.parametrize("partition_words", [1, 7])
def test_hot_partitions_are_split_without_loss(spark, partition_words):
    pick = random.Random(9)
    counts = {"prefix" + "".join(pick.choice("ab") for _ in range(pick.randint(1, 6))) + pick.choice(["", "ending"]): pick.randint(3, 500) for _ in range(160)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(words, partition_words=partition_words).collect()
    assert {tuple(r) for r in got} == expected_groups(counts) and len(got) == len(counts)


def test_chains_end_at_their_root(spark):
    counts = {"aaaaa" + "b" * k: 3 * 2**k for k in range(12)}  # each is the form of the one before
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaa" + "b" * 11}


def test_acceptor_is_minimal():
    machine = spelling.Acceptors()
    start = machine.start(["aing", "bing", "cing", "cings"])
    assert sorted(machine.common(start, start)) == ["aing", "bing", "cing", "cings"]
    assert len(machine.arcs) == 9  # a and b lead to one state; the ends are shared


def test_nothing_from_nothing(spark):
    assert spelling.spelling_variants(cases.none(spark)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), 97).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)
