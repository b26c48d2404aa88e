"""Operators on pages, and the pipeline."""

from __future__ import annotations

import glob
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paytally.llm import catalog, components, url_filters, warc
from paytally.storage import fresh_path
from tests.llm import cases

PAGES = "page_id long, url string, html string, node string, component string, header string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGES)


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    expected = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)


def test_url_filters(spark):
    rows = [
        (1, "http://a.net/x", "<link rel='canonical' href='https://example.org/es/q'>"),
        (2, "https://example.org/es/q/", None),
        (3, "http://a.net/y?utm_source=3", '<META http-equiv="refresh" content="0; url=/x">'),
        (4, None, "x"),
        (5, "nohost", ""),
        (6, "http://SUB.Example.ORG/en/17#x", ""),
        (7, "http://b.net/1", '<link href="//wiki.example.org/about" rel=canonical>'),
        (8, "http://b.net/1", ""),
        (9, "ftp://u:p@Host.de:21", "x" * 100_000),
        (None, "http://notexample.org.com/de/1", ""),
    ]
    got = {r.page_id: r for r in url_filters.filter_pages(pages(spark, rows), catalog.RULES).collect()}
    assert len(got) == len(rows)
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: (None, "block"),
        2: ("example.org/es/", "block"),
        3: (None, "block"),
        4: (None, "allow"),
        5: (None, "allow"),
        6: ("example.org/en/1", "block"),
        7: (None, "allow"),
        8: (None, "allow"),
        9: (None, "allow"),
        None: ("com/de/", "block"),
    }
    assert (got[9].host, got[9].path) == ("u:p@host.de:21", "") and (got[4].host, got[4].path) == ("", "")
    assert (got[6].host, got[6].path) == ("sub.example.org", "/en/17")


def test_canonical_and_refresh_are_both_links(spark):
    both = "<link rel=canonical href='{}'><meta http-equiv=refresh content='0; url={}'>"
    rows = [
        (1, "http://a.net/x", both.format("http://a.net/x", "https://example.org/es/q")),
        (2, "http://b.net/d/e/y", "<link rel=canonical href='../z'>"),
        (3, "http://b.net/d/z", "<link rel=canonical href='https://example.org/es/r'>"),
        (4, "http://c.net/d/y", "<link rel=canonical href='./../../w/./v'>"),
        (5, "http://c.net/w/v", "<link rel=canonical href='https://example.org/es/s'>"),
        (6, "http://d.net/p?a=1", "<link rel=canonical href='?b=2'>"),
        (7, "http://d.net/p?b=2", "<link rel=canonical href='https://example.org/es/t'>"),
        (8, "http://e.net/p?b=2", "<link rel=canonical href='#top'>"),
        (9, "http://f.net/p", "<link rel=canonical href='mailto:x@f.net'>"),
    ]
    got = {r.page_id: (r.verdict, r.aliases) for r in url_filters.filter_pages(pages(spark, rows), catalog.RULES).collect()}
    assert {i: v for i, (v, _) in got.items()} == {**dict.fromkeys(range(1, 8), "block"), 8: "allow", 9: "allow"}
    assert got[8][1] == 2 and got[9][1] == 1


def test_verdicts_come_from_real_urls_only(spark):
    """The form of a blocked URL without its closing slash or index page would fit another rule; nobody names it."""
    rows = [(k, f"http://p{k}.net/x", f"<link rel=canonical href='https://example.org/{end}'>") for k, end in enumerate(("es/", "es/index.html", "es/q", "es"))]
    got = {r.page_id: (r.verdict, r.aliases) for r in url_filters.filter_pages(pages(spark, rows[:1]), catalog.RULES).collect()}
    assert got == {0: ("block", 2)}
    got = {r.page_id: r.verdict for r in url_filters.filter_pages(pages(spark, rows[:3]), catalog.RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block"}
    got = {r.page_id: r.verdict for r in url_filters.filter_pages(pages(spark, rows), catalog.RULES).collect()}
    assert got == {0: "allow", 1: "allow", 2: "block", 3: "allow"}  # now a page does name https://example.org/es


def test_verdicts_over_random_links(spark):
    """Against a plain walk over pages, links and forms."""
    pick = random.Random(7)
    hosts = ("a.net", "www.example.org", "x.com", "b.net")
    ends = ("", "/", "/index.html", ".html", "?utm_x=1", "#top", "?q=1")
    urls = [f"http{pick.choice(['', 's'])}://{pick.choice(hosts)}/{pick.choice(['es/', 'fr/', 'de/', 'en/1', ''])}{k % 40}{pick.choice(ends)}" for k in range(260)]
    rows = []
    for k in range(220):
        links = pick.sample(urls, pick.choice([0, 0, 1, 2]))
        html = "".join(f"<link rel=canonical href='{u}'>" if n == 0 else f"<meta http-equiv=refresh content='0;url={u}'>" for n, u in enumerate(links))
        rows.append((k, pick.choice(urls), html, links))

    def form(url):
        rest = url.split("://")[1]
        rest, _, _ = rest.partition("#")
        rest, _, query = rest.partition("?")
        host, _, path = rest.partition("/")
        path = re.sub(r"(?:/index)?\.html?$", "", "/" + path)
        kept = "&".join(sorted(p for p in query.split("&") if p and not re.match("utm_[a-z]+(=|$)", p)))
        return f"{host}{path.rstrip('/')}" + (f"?{kept}" if kept else "")

    def rule(url):
        host, _, path = re.split("[?#]", url.split("://")[1])[0].partition("/")
        fits = [r for r in catalog.RULES if (host == r[1] or host.endswith("." + r[1])) and ("/" + path).startswith(r[2])]
        return max(fits, key=lambda r: len(r[1] + r[2]))[0] if fits else None

    named = {u for _, url, _, links in rows for u in (url, *links)}
    near: dict = {u: {form(u)} for u in named}
    for _, url, _, links in rows:
        for link in links:
            near[url].add(link)
            near[link].add(url)
    for u in named:
        near.setdefault(form(u), set()).add(u)

    def verdict(url):
        if rule(url):
            return rule(url)
        seen, open_ = {url}, [url]
        while open_:
            for n in near[open_.pop()] - seen:
                seen.add(n)
                open_.append(n)
        found = {rule(u) for u in seen if "://" in u}
        return "allow" if "allow" in found else "block" if "block" in found else "allow"

    got = {r.page_id: r.verdict for r in url_filters.filter_pages(pages(spark, [r[:3] for r in rows]), catalog.RULES).collect()}
    assert got == {k: verdict(url) for k, url, _, _ in rows}
    assert "block" in {v for k, v in got.items() if rule(rows[k][1]) is None}


def test_an_allowed_alias_comes_first(spark):
    rows = [
        (1, "http://a.net/x", "<link rel='canonical' href='https://example.org/es/q'>"),
        (2, "http://b.net/y", "<link rel='canonical' href='http://a.net/x'>"),
        (3, "http://fine.com/fr/1", "<link rel='canonical' href='http://b.net/y'>"),
    ]
    got = {r.page_id: r.verdict for r in url_filters.filter_pages(pages(spark, rows), catalog.RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow"}


ARCHIVED = [
    (3, "u\r\nX: 1", "a" * 200),
    (1, "u", "a" * 200),
    (9, "v", "a" * 200),
    (9, "v", "a" * 200),
    (2, None, "short"),
    (5, "u", "short"),
    (6, "u", None),
    (None, "u", "a" * 200),
    (7, "w", "é\r\nWARC/1.1\r\n\r\n" * 9000),
    (8, "w", ""),
]


def test_archive(spark):
    folder = fresh_path(spark, "warc")
    warc.write_archive(pages(spark, ARCHIVED), folder)
    records = warc.read_archive(spark, folder)
    got = sorted(records.collect(), key=lambda r: (r.page_id is None, r.page_id, r.payload_bytes))
    least: dict[str, int] = {}
    for i, _, html in ARCHIVED:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    expected = []
    for i, _, html in ARCHIVED:
        data = (html or "").encode()
        first = least[html or ""]
        again = len(data) >= 100 and i != first
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    expected.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got] == expected
    assert spark.read.parquet(f"{folder}/payloads").count() == 4  # each once
    # Plain WARC files hold the same records, to be read by their lengths.
    warc.write_warc_files(records, f"{folder}/files")
    found = 0
    for name in glob.glob(f"{folder.removeprefix('file:')}/files/part-*"):
        data = open(name, "rb").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            digest = re.search(rb"Digest: sha256:(\w+)", head)[1].decode()
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            assert b"revisit" in head or hashlib.sha256(rest[:size]).hexdigest() == digest
            data, found = rest[size + 4 :], found + 1
    assert found == len(ARCHIVED)


def test_a_damaged_archive_is_an_error(spark):
    folder = fresh_path(spark, "warc")
    warc.write_archive(pages(spark, ARCHIVED[:2]), folder)
    damaged = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit("b").cast("binary"))
    damaged.write.parquet(f"{folder}/other")
    spark.read.parquet(f"{folder}/other").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="no valid payload"):
        warc.read_archive(spark, folder).collect()


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    folder = fresh_path(spark, "warc")
    warc.write_archive(none, folder)
    assert warc.read_archive(spark, folder).isEmpty()
    assert url_filters.filter_pages(none, catalog.RULES).isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = cases.texts()
    item = " ".join(texts[30].split(" ")[:40])
    docs = cases.documents(spark, [(4000, f"{item} and little else"), (4001, "mail jo@x.de about the one thing that is here now")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        path = fresh_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left = docs.select("doc_id", "text").toPandas()
        if name == "minhash":
            assert len(left) < before.count() and set(left.text.dropna()) <= set(before.toPandas().text.dropna())
            assert {1001, 1003} <= set(left.doc_id) and 1004 not in set(left.doc_id)
        if name == "decontamination":
            assert 4000 not in set(left.doc_id) and 4001 in set(left.doc_id)
        if name == "personal_data":
            row = docs.where("doc_id = 4001").first()
            assert row.text == "mail [EMAIL] about the one thing that is here now" and row.n_chars == len(row.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed[packed.piece == 0].shape[0] == docs.count()
