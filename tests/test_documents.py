"""Reading and writing documents, including the awkward ones."""

from __future__ import annotations

import shutil
import tempfile
import xml.etree.ElementTree as ET
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paytally import generate, schemas
from paytally.operators import lookups
from paytally.plans import suite
from paytally.sources import arrow_ipc, ingest, pain_xml, pain_xml_writer
from paytally.streaming import arrivals
from paytally.tables import PaymentTables


def folder() -> str:
    return tempfile.mkdtemp(prefix="paytally-test-", dir="/tmp")


def group(msg="M1", total="3.00", extra=""):
    return (
        f"<GrpHdr><MsgId>{msg}</MsgId><CreDtTm>2026-01-01T00:00:00</CreDtTm><NbOfTxs>2</NbOfTxs>"
        f"<CtrlSum>{total}</CtrlSum><InitgPty><Nm>Initiator</Nm></InitgPty>{extra}</GrpHdr>"
    )


def block(pmt, *txs, head="<PmtMtd>TRF</PmtMtd>"):
    return f"<PmtInf><PmtInfId>{pmt}</PmtInfId>{head}{''.join(txs)}</PmtInf>"


def tx(e2e, rest="", amount='<Amt><InstdAmt Ccy="EUR">1.5</InstdAmt></Amt>'):
    return f"<CdtTrfTxInf><PmtId><EndToEndId>{e2e}</EndToEndId></PmtId>{amount}{rest}</CdtTrfTxInf>"


def document(*parts):
    return (
        '<?xml version="1.0" encoding="UTF-8"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:pain.001.001.09">'
        f"<CstmrCdtTrfInitn>{''.join(parts)}</CstmrCdtTrfInitn></Document>"
    )


def read(spark, **files):
    path = folder()
    for name, text in files.items():
        Path(path, f"{name}.xml").write_text(text, encoding="utf-8")
    return pain_xml.read(spark, path)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_awkward_elements(spark):
    rest = (
        "<CdtrAgt><FinInstnId><BICFI> COBADEFF </BICFI><Nm>Bank</Nm></FinInstnId></CdtrAgt>"
        "<PmtTpInf><SvcLvl><Cd>URGP</Cd></SvcLvl></PmtTpInf>"
        "<Cdtr><Nm>A &amp; B</Nm><PstlAdr><Ctry>DE</Ctry></PstlAdr></Cdtr>"
        "<RmtInf><Ustrd> one </Ustrd><Ustrd>  </Ustrd><Ustrd><![CDATA[<two>]]></Ustrd>"
        "<Strd><CdtrRefInf><Tp><CdOrPrtry><Cd>SCOR</Cd></CdOrPrtry></Tp><Ref>R1</Ref></CdtrRefInf></Strd>"
        "<Strd><CdtrRefInf><Ref>R2</Ref></CdtrRefInf></Strd></RmtInf>"
        "<RgltryRptg><Dtls><Cd>X</Cd></Dtls><Dtls><Cd> </Cd></Dtls></RgltryRptg>"
        "<RgltryRptg><Dtls><Cd>Y</Cd></Dtls></RgltryRptg>"
    )
    files = read(
        spark,
        a=document(
            group(extra="<!-- <PmtInf> -->"),
            block("P&amp;1", tx("plain"), tx("rich", rest), tx("empty", amount='<Amt><InstdAmt Ccy="EUR"></InstdAmt></Amt>')),
            block("none"),
            block("P2", tx("last")),
        ),
    )
    assert files.rejects.count() == 0
    assert rows(files.tables.remittance, "msg_id", "pmt_inf_id", "svc_lvl_cd") == [
        ("M1", "P&1", None), ("M1", "P2", None), ("M1", "none", None),
    ]
    got = {r.end_to_end_id: r for r in files.tables.transactions.collect()}
    assert {k: r.pmt_inf_id for k, r in got.items()} == {"plain": "P&1", "rich": "P&1", "empty": "P&1", "last": "P2"}
    rich = got["rich"]
    assert (rich.cdtr_agt_bicfi, rich.cdtr_nm, rich.cdtr_ctry) == ("COBADEFF", "A & B", "DE")
    assert (rich.rmt_inf_ustrd, rich.rglty_rptg_cd) == ("one\n<two>", "X\nY")
    assert (rich.rmt_inf_strd_ref, rich.rmt_inf_strd_ref_tp) == ("R2", "SCOR")
    assert (str(rich.instd_amt), got["empty"].instd_amt, got["empty"].ccy) == ("1.50000", None, "EUR")
    assert (got["plain"].rmt_inf_ustrd, got["plain"].cdtr_nm) == (None, None)


def test_two_documents_prefixes_and_indentation(spark):
    prefixed = document(group("M2"), block("P1", tx("e3"), tx("e4"))).replace("</", "</p:").replace("<C", "<p:C")
    for tag in ("Document", "GrpHdr", "MsgId", "NbOfTxs", "InitgPty", "Nm", "PmtInf>", "PmtInfId", "PmtMtd", "PmtId",
                "EndToEndId", "Amt", "InstdAmt"):
        prefixed = prefixed.replace(f"<{tag}", f"<p:{tag}")
    prefixed = prefixed.replace("xmlns=", "xmlns:p=")
    ET.fromstring(prefixed.encode())
    pretty = ET.fromstring(document(group("M1"), block("P1", tx("e1"), tx("e2"))).encode())
    ET.indent(pretty)
    ET.register_namespace("", "urn:iso:std:iso:20022:tech:xsd:pain.001.001.09")
    files = read(spark, a=ET.tostring(pretty, encoding="unicode"), b=prefixed)
    assert files.rejects.count() == 0
    assert rows(files.tables.message, "msg_id", "msg_initg_pty_nm") == [("M1", "Initiator"), ("M2", "Initiator")]
    assert rows(files.tables.remittance, "msg_id", "pmt_inf_id", "pmt_mtd") == [("M1", "P1", "TRF"), ("M2", "P1", "TRF")]
    assert rows(files.tables.transactions, "end_to_end_id", "pmt_inf_id", "ccy") == [
        (f"e{i}", "P1", "EUR") for i in (1, 2, 3, 4)
    ]


def test_bad_files_are_listed_and_give_no_rows(spark):
    good = document(group(), block("P", tx("ok")))
    files = read(
        spark,
        good=good,
        truncated=good[:-40],
        cut_in_transaction=good[: good.index("ok")],
        bad_sum=document(group(total="many"), block("P", tx("x"))),
        no_sum=document(group(total=""), block("P", tx("x"))),
        bad_date=document(group(), block("P", tx("x"), head="<ReqdExctnDt><Dt>2026-1-1</Dt></ReqdExctnDt>")),
        bad_amount=document(group(), block("P", tx("x", amount='<Amt><InstdAmt Ccy="EUR">1,5</InstdAmt></Amt>'))),
        mismatched=document(group(), block("P", tx("x", "<Cdtr><Nm>a</Cdtr>"))),
        empty_text="no markup at all",
    )
    reasons = {Path(r.source_file).stem: r.reason.split(":")[0] for r in files.rejects.collect()}
    assert reasons == {
        "truncated": "truncated",
        "cut_in_transaction": "truncated",
        "bad_sum": "bad CtrlSum",
        "no_sum": "bad CtrlSum",
        "bad_date": "bad ReqdExctnDt",
        "bad_amount": "bad InstdAmt",
        "mismatched": "malformed transaction",
        "empty_text": "truncated",
    }
    assert tuple(files.stats().first()) == (1, 1, 1)


def test_fail_fast(spark):
    path = folder()
    Path(path, "a.xml").write_text(document(group(total="many")))
    with pytest.raises(ValueError, match="bad CtrlSum: many"):
        pain_xml.read(spark, path, mode="FAILFAST")


def test_tags_that_are_only_text(spark):
    """A closing tag inside CDATA, a commented-out transaction, an empty transaction element."""
    files = read(
        spark,
        cdata=document(group("M1"), block("P1", tx("a", "<RmtInf><Ustrd><![CDATA[</CdtTrfTxInf>]]></Ustrd></RmtInf>"), tx("b"))),
        comment=document(group("M2"), block("P2", tx("c"), "<!-- " + tx("hidden") + " -->", tx("d"))),
        empty=document(group("M3"), block("P3", tx("e"), "<CdtTrfTxInf/>", tx("f"))),
        word=document(group("M4"), block("P4", tx("g", "<RmtInf><Ustrd>see CdtTrfTxInf above</Ustrd></RmtInf>"))),
    )
    assert files.rejects.count() == 0
    assert rows(files.tables.message, "msg_id") == [("M1",), ("M2",), ("M3",), ("M4",)]
    assert rows(files.tables.transactions, "pmt_inf_id", "end_to_end_id", "rmt_inf_ustrd") == sorted(
        [
            ("P1", "a", "</CdtTrfTxInf>"), ("P1", "b", None), ("P2", "c", None), ("P2", "d", None),
            ("P3", "e", None), ("P3", None, None), ("P3", "f", None), ("P4", "g", "see CdtTrfTxInf above"),
        ],
        key=str,
    )


FULL = (
    "<CdtrAgt><FinInstnId><BICFI>COBADEFF</BICFI></FinInstnId></CdtrAgt>"
    "<Cdtr><Nm> padded name </Nm><PstlAdr><Ctry>DE</Ctry><AdrLine>x</AdrLine></PstlAdr></Cdtr>"
    "<CdtrAcct><Id><IBAN>DE89370400440532013000</IBAN></Id></CdtrAcct>"
    "<UltmtCdtr><Nm></Nm></UltmtCdtr><Purp><Cd>SUPP</Cd></Purp>"
    "<RgltryRptg><DbtCdtRptgInd>CRED</DbtCdtRptgInd><Dtls><Cd>A</Cd></Dtls><Dtls><Cd>  </Cd></Dtls></RgltryRptg>"
    "<RgltryRptg><Dtls><Cd> B </Cd></Dtls></RgltryRptg>"
    "<RmtInf><Ustrd> one  1 </Ustrd><Ustrd></Ustrd><Ustrd>two\nlines</Ustrd>"
    "<Strd><CdtrRefInf><Tp><CdOrPrtry><Cd>SCOR</Cd></CdOrPrtry><Issr>I</Issr></Tp><Ref>R1</Ref></CdtrRefInf></Strd>"
    "<Strd><CdtrRefInf><Ref>R2</Ref></CdtrRefInf></Strd></RmtInf>"
)
HEAD = (
    "<PmtMtd>TRF</PmtMtd><BtchBookg>true</BtchBookg><NbOfTxs>1</NbOfTxs><CtrlSum>1.005</CtrlSum>"
    "<PmtTpInf><InstrPrty>HIGH</InstrPrty><SvcLvl><Cd>SEPA</Cd></SvcLvl><LclInstrm><Cd>CORE</Cd></LclInstrm>"
    "<CtgyPurp><Cd>SALA</Cd></CtgyPurp></PmtTpInf><ReqdExctnDt><Dt>2026-01-02</Dt></ReqdExctnDt>"
    "<Dbtr><Nm>Debtor</Nm></Dbtr><DbtrAcct><Id><IBAN>X</IBAN></Id></DbtrAcct>"
    "<DbtrAgt><FinInstnId><BICFI>Y</BICFI></FinInstnId></DbtrAgt><UltmtDbtr><Nm>Z</Nm></UltmtDbtr><ChrgBr>SLEV</ChrgBr>"
)


@pytest.mark.parametrize("indented", [False, True])
def test_plain_and_parsed_reading_agree(spark, indented):
    """A comment in every header and transaction sends the same content through ``from_xml``."""
    text = document(group(), block("P", tx("a", FULL), tx("b"), head=HEAD), block("Q", tx("c", FULL)))
    if indented:
        ET.register_namespace("", "urn:iso:std:iso:20022:tech:xsd:pain.001.001.09")
        tree = ET.fromstring(text.encode())
        ET.indent(tree)
        text = ET.tostring(tree, encoding="unicode")
    commented = text
    for tag in ("<GrpHdr>", "</PmtMtd>", "<CdtTrfTxInf>"):
        commented = commented.replace(tag, f"{tag}<!-- note -->")
    plain, parsed = read(spark, a=text), read(spark, a=commented)
    for name, schema in schemas.TABLES.items():
        got = rows(getattr(plain.tables, name), *schema.names)
        assert got == rows(getattr(parsed.tables, name), *schema.names)
        assert got
    full = plain.tables.transactions.where("end_to_end_id = 'a'").first()
    assert (full.rmt_inf_ustrd, full.rglty_rptg_cd) == ("one  1\ntwo\nlines", "A\nB")
    assert (full.cdtr_nm, full.ultmt_cdtr_nm, full.rmt_inf_strd_ref, full.rmt_inf_strd_ref_tp) == (
        "padded name", "", "R2", "SCOR",
    )
    head = plain.tables.remittance.where("pmt_inf_id = 'P'").first()
    assert (str(head.ctrl_sum), head.ctgy_purp_cd, head.chrg_br, str(head.reqd_exctn_dt)) == ("1.01", "SALA", "SLEV", "2026-01-02")


def brute_force(text: str):
    """Parents of all transactions by a plain tree walk."""
    ns = "{urn:iso:std:iso:20022:tech:xsd:pain.001.001.09}"
    root = ET.fromstring(text.encode())[0]
    msg = root.find(f"{ns}GrpHdr/{ns}MsgId").text
    out = []
    for b in root.findall(f"{ns}PmtInf"):
        pmt = b.find(f"{ns}PmtInfId").text
        out += [(msg, pmt, t.find(f"{ns}PmtId/{ns}EndToEndId").text) for t in b.findall(f"{ns}CdtTrfTxInf")]
    return out


def test_parents_across_many_splits(spark):
    """Documents cut into splits far smaller than their blocks, next to a walk over the tree."""
    texts = {}
    for d in range(3):
        blocks = [
            block(f"P{d}-{b}", *(tx(f"{d}-{b}-{i}", "<Cdtr><Nm>x &amp; y</Nm></Cdtr>" if i % 5 == 0 else "") for i in range(n)))
            for b, n in enumerate([40, 0, 1, 0, 0, 70, 3])
        ]
        texts[f"d{d}"] = document(group(f"M{d}"), *blocks)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = read(spark, **texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    joined = files.tables.transactions.join(files.tables.remittance, "pmt_inf_id")
    expected = [row for text in texts.values() for row in brute_force(text)]
    assert rows(joined, "msg_id", "pmt_inf_id", "end_to_end_id") == sorted(expected, key=str)
    assert files.tables.remittance.count() == 21


@pytest.mark.parametrize("letter, errors", [("D", 0), ("E", 3), ("H", 0), ("J", 0)])
def test_generated_documents(spark, letter, errors):
    spec = generate.SPECS[letter]
    path = folder()
    pain_xml_writer.write(generate.from_spec(spark, spec), f"{path}/xml")
    result = ingest.ingest(spark, f"{path}/xml", f"{path}/out")
    assert tuple(result.stats().first()) == (1, spec.blocks, spec.blocks * spec.per_block)
    for semantics in ("sql", "exact"):
        report = suite.standard_suite(semantics).run(result.tables)
        assert report.totals().first().errors == errors
        assert {r.validator for r in report.errors().collect()} <= {"ControlSumValidator"}


def test_one_document_over_many_part_files(spark):
    path = folder()
    pain_xml_writer.write(generate.from_spec(spark, generate.Spec(3, 50)), path, layout="spread", mode="append")
    text = "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))
    assert len(brute_force(text)) == 150


def test_arrow_exchange(spark):
    arrow_ipc.register(spark)
    t = generate.from_spec(spark, generate.Spec(3, 50))
    path = folder()
    for name, df in t.items():
        df.write.format("arrow_ipc").mode("append").save(f"{path}/{name}")
    back = PaymentTables.load(spark, path, "arrow_ipc")
    for name, df in t.items():
        assert getattr(back, name).exceptAll(df).isEmpty() and df.exceptAll(getattr(back, name)).isEmpty()
    inferred = spark.read.format("arrow_ipc").load(f"{path}/remittance")
    assert inferred.schema.names == schemas.REMITTANCE.names
    t.message.write.format("arrow_ipc").mode("overwrite").save(f"{path}/message")
    assert PaymentTables.load(spark, path, "arrow_ipc").message.count() == 1
    t.message.where("1 = 0").write.format("arrow_ipc").mode("append").save(f"{path}/empty")
    assert not list(Path(path, "empty").glob("**/*.arrow"))
    one = next(Path(path, "transactions").glob("*/*.arrow"))
    assert spark.read.format("arrow_ipc").load(str(one)).count() > 0


def test_a_stream_is_read_by_batches(spark):
    """One file of ten batches, with and without a dictionary, read by several tasks and by one."""
    path = folder()
    values = pa.table({"n": pa.array(range(1000), pa.int64()), "text": pa.array([f"word {k % 7}" for k in range(1000)])})
    for name, table in {"plain": values, "coded": values.set_column(1, "text", values["text"].dictionary_encode())}.items():
        with pa.ipc.new_stream(f"{path}/{name}.arrow", table.schema) as writer:
            for batch in table.to_batches(max_chunksize=100):
                writer.write_batch(batch)
        with pa.OSFile(f"{path}/{name}.arrow") as file:
            kinds = [kind for kind, _, _ in arrow_ipc.messages(file)]
            assert kinds.count(arrow_ipc.RECORDS) == 10 and kinds[0] == arrow_ipc.SCHEMA
            parts = [[b.num_rows for b in arrow_ipc.batches_within(file, k, k + 3000)] for k in range(0, file.size(), 3000)]
            assert sum(map(sum, parts)) == 1000 and sum(map(bool, parts)) > 2
    arrow_ipc.register(spark)
    reader = spark.read.format("arrow_ipc").schema("text string, n long").option("splitBytes", "3000")
    back = reader.load(f"{path}/plain.arrow")
    assert back.rdd.getNumPartitions() > 2
    assert rows(back, "n", "text") == sorted(((k, f"word {k % 7}") for k in range(1000)), key=str)
    assert len({r[0] for r in back.select(F.spark_partition_id()).distinct().collect()}) > 2
    Path(path, "cut.arrow").write_bytes(Path(path, "plain.arrow").read_bytes()[:-900])
    with pa.OSFile(f"{path}/cut.arrow") as file, pytest.raises(ValueError, match="cut off"):
        list(arrow_ipc.messages(file))


def test_only_finished_writes_count(spark):
    path = folder()
    arrow_ipc.write(spark.range(10).coalesce(1), path)
    arrow_ipc.write(spark.range(10, 15), path)
    lost = Path(path, "run-lost")
    shutil.copytree(next(Path(path).glob("run-*")), lost)
    (lost / arrow_ipc.MANIFEST).unlink()
    assert arrow_ipc.read(spark, path, spark.range(1).schema).count() == 15
    with pytest.raises(Exception, match="division|zero|DIVIDE"):
        arrow_ipc.write(spark.range(100).select((F.lit(1) / F.when(F.col("id") < 99, 1).otherwise(0)).alias("id")), path)
    assert arrow_ipc.read(spark, path, spark.range(1).schema).count() == 15
    arrow_ipc.write(spark.range(3), path, "overwrite")
    assert arrow_ipc.read(spark, path, spark.range(1).schema).count() == 3
    assert len(list(Path(path).glob("run-*"))) == 1


def test_names_of_file_systems(spark):
    assert arrow_ipc.store_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and arrow_ipc.store_uri("gs://x/y") == "gs://x/y"
    assert arrow_ipc.qualified(spark, "/a/b") == "file:/a/b" and arrow_ipc.qualified(spark, "s3a://x/y") == "s3a://x/y"


def test_a_failed_ingest_leaves_nothing(spark, monkeypatch):
    path = folder()
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    Path(path, "in.xml").write_text(document(group(), block("P", tx("a"), tx("b"))))
    before = {p.name for p in shared.iterdir() if p.name.startswith("staged")}
    publish = ingest.move

    def broken(spark, source, target):
        if target.endswith("message"):
            raise OSError("no more room")
        publish(spark, source, target)

    monkeypatch.setattr(ingest, "move", broken)
    for mode in ("errorifexists", "append"):
        with pytest.raises(OSError, match="no more room"):
            ingest.ingest(spark, f"{path}/in.xml", f"{path}/out", mode=mode)
        assert not list(Path(path).glob("out/**/*.parquet"))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="bad CtrlSum"):
        Path(path, "bad.xml").write_text(document(group(total="many")))
        ingest.ingest(spark, f"{path}/bad.xml", f"{path}/out", fail_fast=True)
    assert {p.name for p in shared.iterdir() if p.name.startswith("staged")} == before
    result = ingest.ingest(spark, f"{path}/in.xml", f"{path}/out")
    with pytest.raises(Exception, match="exists"):
        ingest.ingest(spark, f"{path}/in.xml", f"{path}/out")
    assert tuple(result.stats().first()) == (1, 1, 2) and result.tables.transactions.count() == 2
    again = ingest.ingest(spark, f"{path}/in.xml", f"{path}/out", mode="append")
    assert tuple(again.stats().first()) == (1, 1, 2) and again.tables.transactions.count() == 4
    assert ingest.ingest(spark, f"{path}/in.xml", f"{path}/out", mode="overwrite").tables.transactions.count() == 2
    assert sorted(p.name for p in Path(path, "out").iterdir()) == ["message", "remittance", "transactions"]


@pytest.mark.parametrize("fmt", ["parquet", "arrow_ipc"])
def test_datasets_are_named_after_their_document(spark, fmt):
    path = folder()
    Path(path, "Batch.7.XML").write_text(document(group(), block("P", tx("a"))))
    result = ingest.ingest(spark, f"{path}/Batch.7.XML", f"{path}/out", fmt=fmt, base=ingest.dataset_name(f"{path}/Batch.7.XML"))
    assert sorted(p.name for p in Path(path, "out").iterdir()) == [f"Batch.7_{name}" for name in sorted(schemas.TABLES)]
    assert result.paths["message"].endswith(f"{path}/out/Batch.7_message") and result.tables.transactions.count() == 1
    assert PaymentTables.load(spark, f"{path}/out", fmt, base="Batch.7").message.count() == 1


def scanned_rows(df) -> int:
    """Rows that the scan of a finished query gave, after row groups were left out."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node) -> None:
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())

    walk(plan)
    assert rows and len(found) == 1
    return found[0]


@pytest.mark.parametrize("clustered", [True, False])
def test_lookups_leave_row_groups_out(spark, clustered):
    """By sorted keys, or by the Bloom filters of tables whose rows are in any order."""
    path = folder()
    n = 40_000
    key = F.format_string("PMT-%010d", F.xxhash64("id") % 10_000 if clustered else F.pmod(F.xxhash64(F.floor(F.col("id") / 4)), F.lit(10**9)))
    made = spark.range(n).repartition(4).withColumn("key", key)

    def table(name):
        named = {"msg_id": "key", "pmt_inf_id": "key", "end_to_end_id": "cast(id as string)"}
        fields = schemas.TABLES[name].fields
        return made.select(*(F.expr(named.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in fields))

    tables = PaymentTables(*(table(name) for name in schemas.TABLES))
    options = {"parquet.block.size": "20000", "parquet.page.row.count.limit": "500", "parquet.block.size.row.check.min": "100"}
    stored = (tables.clustered() if clustered else tables).save(path, options={**options, "parquet.enable.dictionary": "false"})
    one = made.select("key").first()["key"]
    for df, whole in ((lookups.transactions_of(stored, one), n), (lookups.remittances_of(stored, one), n)):
        assert scanned_rows(df) < whole / 10
    assert [r.total for r in lookups.sum_of_remittance(stored, one).collect()] == [0]


def test_report_and_catalog_tables(spark):
    path = folder()
    t = generate.from_spec(spark, generate.Spec(2, 5))
    pain_xml_writer.write(t, f"{path}/xml")
    result = ingest.ingest(spark, f"{path}/xml", f"{path}/out")
    report = {r.metric: r.value for r in result.report().collect()}
    assert report["transaction_rows"] == 10 and report["source_bytes"] > 0 and report["mb_per_second"] > 0
    spark.sql(f"CREATE DATABASE IF NOT EXISTS payments_test LOCATION '{path}/db'")
    names = ingest.create_tables(spark, "payments_test")
    assert ingest.create_tables(spark, "payments_test") == names
    ingest.insert_into(t, names)
    ingest.insert_into(t, names)
    assert spark.table(names["transactions"]).count() == 20
    kept = t.persist()
    assert kept.transactions.is_cached
    kept.unpersist()
    t.register("pay_")
    assert spark.sql("select count(*) from pay_remittance").first()[0] == 2


def test_arrivals(spark):
    path = folder()
    inbox = Path(path, "in")
    inbox.mkdir()
    Path(inbox, "a.xml").write_text(document(group("M1", "3.00"), block("P", tx("a"), tx("b"))))
    Path(inbox, "b.xml").write_text(document(group("M2", "9.00"), block("P", tx("c"))))
    tagged = []

    def run():
        query = arrivals.start(
            spark, str(inbox), f"{path}/t", f"{path}/c", suite.standard_suite(), max_files=1,
            on_table=lambda name, df, batch: tagged.append((name, batch)),
        )
        query.awaitTermination()

    run()
    assert tuple(arrivals.stored_tables(spark, f"{path}/t").counts().first()) == (2, 2, 3)
    Path(inbox, "c.xml").write_text(document(group("M3"), block("P", tx("d")))[:-5])
    run()
    assert tuple(arrivals.stored_tables(spark, f"{path}/t").counts().first()) == (2, 2, 3)
    assert arrivals.stored_rejects(spark, f"{path}/t").count() == 1
    sums = arrivals.stored_issues(spark, f"{path}/t").where("rule = 'ctrl_sum_message'")
    assert rows(sums, "id", "batch_id") == [("M2", 1)] or rows(sums, "id") == [("M2",)]
    assert {name for name, _ in tagged} == {"message", "remittance", "transactions"}
