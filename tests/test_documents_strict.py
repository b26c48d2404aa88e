"""Malformed, wrongly encoded and irregular documents; several documents with the same block ids."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import replace
from decimal import Decimal
from pathlib import Path

import pytest

from paytally.operators import lookups, reconcile
from paytally.plans import suite
from paytally.sources import ingest, pain_xml, pain_xml_writer
from tests.test_documents import block, document, folder, group, read, rows, tx

SOUND = document(group("M1"), block("P1", tx("a"), tx("b")), block("P2", tx("c")))

DAMAGED = {
    "stray": SOUND.replace("</GrpHdr>", "</GrpHdr><Bad>"),
    "between": SOUND.replace("</CdtTrfTxInf><CdtTrfTxInf>", "</CdtTrfTxInf>&bad;<oops></CdtrX><CdtTrfTxInf>"),
    "entity": SOUND.replace("</CdtTrfTxInf><CdtTrfTxInf>", "</CdtTrfTxInf>&undefined;<CdtTrfTxInf>"),
    "header": SOUND.replace("<InitgPty><Nm>", "<InitgPty><Nm><Nm>"),
    "open": SOUND.replace("</CdtTrfTxInf></PmtInf>", "</CdtTrfTxInf><!-- never closed </PmtInf>", 1),
    "after": SOUND.replace("</Document>", "</Oops></Document>"),
}


def test_malformed_documents_give_no_rows(spark):
    fine = document(
        group("M2", extra="<SplmtryData><Envlp><x a='1'/></Envlp></SplmtryData>"),
        "\n <?note ok?> <!-- fine -->\n",
        block("P9", tx("x"), "\n\t", tx("y"), "<!-- between -->", tx("z")),
        "<SplmtryData><PlcAndNm>other</PlcAndNm></SplmtryData>",
    )
    files = read(spark, sound=SOUND, fine=fine, bom="﻿" + SOUND.replace("M1", "M3"), **DAMAGED)
    names = {Path(r.source_file).stem: r.reason for r in files.rejects.collect()}
    assert set(names) == set(DAMAGED), names
    assert names["open"].startswith("malformed: a comment")
    assert rows(files.tables.message, "msg_id") == [("M1",), ("M2",), ("M3",)]
    assert files.tables.transactions.count() == 9


def test_other_encodings_are_rejected(spark):
    path = folder()
    text = SOUND.replace("Initiator", "Müller")
    Path(path, "good.xml").write_text(text, encoding="utf-8")
    Path(path, "latin.xml").write_bytes(text.replace("UTF-8", "ISO-8859-1").encode("latin-1"))
    Path(path, "wide.xml").write_bytes(text.replace("UTF-8", "UTF-16").encode("utf-16"))
    Path(path, "body.xml").write_bytes(SOUND.replace("<EndToEndId>b", "<EndToEndId>ü").encode("latin-1"))
    files = pain_xml.read(spark, path)
    assert {Path(r.source_file).stem for r in files.rejects.collect()} == {"latin", "wide", "body"}
    assert rows(files.tables.message, "msg_initg_pty_nm") == [("Müller",)]


def irregular(k: int) -> str:
    hidden = "<!-- " + tx(f"hidden{k}") + " and CdtTrfTxInf -->"
    raw = "<RmtInf><Ustrd><![CDATA[</CdtTrfTxInf> --> <!-- ]]></Ustrd></RmtInf>"
    return document(group(f"M{k}"), block("P1", tx("a", raw), hidden, tx("b")), hidden, block("P2", hidden, tx("c")))


def test_many_irregular_files(spark):
    files = read(spark, plain=SOUND, **{f"f{k}": irregular(k + 5) for k in range(12)})
    assert files.rejects.isEmpty()
    assert files.tables.transactions.count() == 3 * 13
    scoped = files.tables.transactions.groupBy("source_file", "pmt_inf_id").count()
    assert set(rows(scoped, "pmt_inf_id", "count")) == {("P1", 2), ("P2", 1)}


def test_sections_over_the_end_of_a_split(spark):
    """Small splits: some sections end in a later split than they start in."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        text = document(
            group("M1"),
            *(block(f"P{k}", tx("a"), "<!-- " + tx("x") * (k % 5) + " -->", tx("b")) for k in range(30)),
        )
        files = read(spark, a=text)
        assert files.rejects.isEmpty()
        assert rows(files.tables.transactions, "pmt_inf_id", "end_to_end_id") == sorted(
            (f"P{k}", e) for k in range(30) for e in "ab"
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_what_goes_on_over_several_splits(spark, small_splits):
    """Comments longer than splits, CDATA, the tag's name as text and empty elements, wherever splits end."""
    texts, expected = {}, []
    for d in range(6):
        blocks = []
        for k in range(12):
            n = (d + k) % 6
            words = " CdtTrfTxInf and" * (n * 3)
            raw = "<RmtInf><Ustrd><![CDATA[" + "</CdtTrfTxInf> <CdtTrfTxInf> " * n + "]]></Ustrd></RmtInf>"
            text = f"<Cdtr><Nm>a{words}</Nm></Cdtr>"
            blocks.append(block(f"P{k}", tx("a", text), "<!-- " + tx("x") * (3 * n) + " -->", tx("b", raw), "<CdtTrfTxInf/>" * (n % 3), tx("c")))
            expected += [(f"M{d}", f"P{k}", "a", "a" + words.rstrip()), (f"M{d}", f"P{k}", "b", None), (f"M{d}", f"P{k}", "c", None)]
            expected += [(f"M{d}", f"P{k}", None, None)] * (n % 3)
        texts[f"d{d}"] = document(group(f"M{d}"), *blocks)
    files = read(spark, **texts)
    assert files.rejects.isEmpty()
    tables = files.scoped().tables
    got = tables.transactions.join(tables.remittance.select("source_file", "pmt_inf_id", "msg_id"), ["source_file", "pmt_inf_id"])
    assert rows(got, "msg_id", "pmt_inf_id", "end_to_end_id", "cdtr_nm") == sorted(expected, key=str)


def late_block(pmt, *txs, late, between=""):
    return f"<PmtInf><PmtInfId>{pmt}</PmtInfId><PmtMtd>TRF</PmtMtd><ChrgBr>DEBT</ChrgBr>{between.join(txs)}{late}</PmtInf>"


def test_block_fields_after_transactions(spark, small_splits):
    """They belong to the block whose transactions stand before them, in whatever split that began; the last one counts."""
    late = "<ChrgBr>SLEV</ChrgBr><UltmtDbtr><Nm>A &amp; B</Nm></UltmtDbtr><CtrlSum>9.005</CtrlSum>"
    many = [tx(f"t{i}") for i in range(15)]
    text = document(
        group("M1"), late_block("P1", *many, late=late), late_block("P2", tx("x"), late=""), late_block("P1", tx("y"), late="<BtchBookg>true</BtchBookg>"),
        late_block("P3", tx("u"), tx("v"), late="<Dbtr><Nm>last</Nm></Dbtr>", between="<Dbtr><Nm>first</Nm></Dbtr><PmtMtd>CHK</PmtMtd>"),
    )
    files = read(spark, a=text, b=document(group("M2"), late_block("P1", tx("z"), late="\n <!-- c --> <ChrgBr>CRED</ChrgBr> ")))
    assert files.rejects.isEmpty()
    assert rows(files.tables.remittance, "msg_id", "pmt_inf_id", "pmt_mtd", "chrg_br", "ultmt_dbtr_nm", "ctrl_sum", "btch_bookg", "dbtr_nm") == sorted(
        [
            ("M1", "P1", "TRF", "SLEV", "A & B", Decimal("9.01"), None, None), ("M1", "P2", "TRF", "DEBT", None, None, None, None),
            ("M1", "P1", "TRF", "DEBT", None, None, "true", None), ("M1", "P3", "CHK", "DEBT", None, None, None, "last"),
            ("M2", "P1", "TRF", "CRED", None, None, None, None),
        ],
        key=str,
    )
    assert files.tables.transactions.count() == 20
    bad = read(spark, a=document(group(), late_block("P", tx("x"), late="<ReqdExctnDt><Dt>2026-1-1</Dt></ReqdExctnDt>")))
    assert [r.reason for r in bad.rejects.collect()] == ["bad ReqdExctnDt: 2026-1-1"]


@pytest.mark.parametrize("layout", pain_xml_writer.LAYOUTS)
def test_block_ids_that_repeat_inside_a_document(spark, layout):
    """Two blocks of one id in one document: each keeps its transactions, and the document stays sound."""
    head = "<PmtMtd>{}</PmtMtd>"
    text = document(
        group("M1"), block("P", tx("a"), tx("b"), head=head.format("TRF")), block("P", tx("c"), head=head.format("CHK")), block("P", head=head.format("TRA")),
    )
    files = read(spark, one=text, two=text.replace("M1", "M2"))
    path = f"{folder()}/out"
    pain_xml_writer.write(files.tables, path, layout=layout)
    back = pain_xml.read(spark, f"{path}/*" if layout == "documents" else path)
    assert back.rejects.isEmpty()
    assert back.tables.remittance.count() == 6 and back.tables.transactions.count() == 6
    tables = back.tables
    joined = tables.transactions.join(tables.remittance.withColumnRenamed("parent", "of").withColumnRenamed("position", "parent"), ["source_file", "parent"])
    assert rows(joined, "msg_id", "pmt_mtd", "end_to_end_id") == sorted(
        (m, p, e) for m in ("M1", "M2") for p, e in (("TRF", "a"), ("TRF", "b"), ("CHK", "c"))
    )
    if layout == "documents":
        assert all(ET.parse(f) for f in Path(path).glob("*/*.txt"))
    # Tables that know no places: an id's transactions are written once, with its first block.
    bare = replace(files.tables, located=False).map(lambda _, df: df.drop("position", "parent"))
    again = f"{folder()}/out"
    pain_xml_writer.write(replace(bare, scope=("source_file",)), again, layout="packed")
    assert tuple(pain_xml.read(spark, again).stats().first()) == (2, 6, 6)


@pytest.mark.parametrize("splits", ["300", "1g"])
def test_the_last_declaration_in_document_order_wins(spark, splits):
    """Files of different size, so that Spark takes them up in another order than that of their names."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    try:
        head = "<PmtMtd>TRF</PmtMtd><NbOfTxs>{}</NbOfTxs><CtrlSum>{}</CtrlSum>"
        filler = [tx(f"f{i}") for i in range(30)]
        files = read(
            spark,
            a=document(group("M", "1.00"), block("P", *filler, head=head.format(30, "1.00")), block("Q", head=head.format(1, "5.00"))),
            b=document(group("M", "2.00"), block("P", tx("x"), head=head.format(31, "2.00")), block("P", head="<PmtMtd>TRF</PmtMtd>")),
        )
        assert rows(reconcile.declared_by_messages(files.tables), "msg_id", "ctrl_sum") == [("M", Decimal("2.00"))]
        assert rows(reconcile.declared_by_blocks(files.tables), "pmt_inf_id", "ctrl_sum", "nb_of_txs") == [("P", Decimal("2.00"), 31), ("Q", Decimal("5.00"), 1)]
        found = suite.standard_suite("exact").run(files.tables).issues
        assert rows(found.where("rule like 'ctrl%'"), "rule", "id", "declared") == [
            ("ctrl_sum_message", "M", Decimal("2.00000")), ("ctrl_sum_remittance", "P", Decimal("2.00000")), ("ctrl_sum_remittance", "Q", Decimal("5.00000")),
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture(scope="module")
def ingested(spark):
    """Three files, each with a block P1 of two transactions."""
    path = folder()
    for k in range(3):
        Path(path, f"f{k}.xml").write_text(document(group(f"M{k}"), block("P1", tx("a"), tx("b"))))
    return ingest.ingest(spark, path, f"{folder()}/in").tables


@pytest.mark.parametrize("layout", pain_xml_writer.LAYOUTS)
def test_equal_block_ids_survive_a_round_trip(spark, ingested, layout):
    path = f"{folder()}/out"
    pain_xml_writer.write(ingested, path, layout=layout)
    back = pain_xml.read(spark, f"{path}/*" if layout == "documents" else path)
    assert back.rejects.isEmpty() and back.tables.transactions.count() == ingested.transactions.count() == 6
    if layout == "documents":
        files = list(Path(path).glob("*/*.txt"))
        assert len(files) == 3
        assert {ET.parse(f).getroot().tag.rpartition("}")[2] for f in files} == {"Document"}


def test_lookups_keep_to_a_document(spark, ingested):
    one = ingested.message.where("msg_id = 'M1'").first()["source_file"]
    assert lookups.transactions_of(ingested, "P1", source_file=one).count() == 2
    assert [r.total for r in lookups.sum_of_remittance(ingested, "P1", source_file=one).collect()] == [3]
    assert sorted(r.total for r in lookups.sum_of_remittance(ingested, "P1").collect()) == [3, 3, 3]


def test_orphans_are_listed(spark, ingested):
    message = ingested.message.where("msg_id <> 'M2'")
    lost = pain_xml_writer.orphans(ingested.map(lambda name, df: message if name == "message" else df))
    assert rows(lost, "table", "id") == [("remittance", "P1"), ("transactions", "a"), ("transactions", "b")]


def test_any_failure_of_a_check_is_a_finding(spark, ingested):
    def broken(tables):
        raise KeyError("no such column")

    found = suite.Suite(suite.Check("Broken", broken), *suite.standard_suite().checks).run(ingested)
    assert [r.validator for r in found.issues.where("rule = 'check_failed'").collect()] == ["Broken"]
    assert found.issues.where("rule <> 'check_failed'").count() > 0
    with pytest.raises(KeyError):
        suite.Suite(suite.Check("Broken", broken)).run(ingested, isolate=False)
