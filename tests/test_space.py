from __future__ import annotations

import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paytally import catalog, fixtures, oracle, schemas, storage, tables as tables_
from paytally.sources import arrow_ipc, pain_xml, pain_xml_writer
from tests.compare import compare, oracle_connection

SMALL = "/root/testdata/sf0.001"


def _bytes(path) -> int:
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_documents_of_queries_take_a_fraction_of_their_markup(spark, tmp_path):
    plain = f"{tmp_path}/plain"
    pain_xml_writer.write(fixtures.payments(spark, SMALL), plain, layout="packed")
    packed = catalog._documents(spark, SMALL)
    parts = [f for f in Path(packed).iterdir() if f.name.startswith("part-")]
    assert parts and all(f.name.endswith(".gz") for f in parts)
    assert _bytes(packed) * 5 < _bytes(plain)
    read, same = (pain_xml.read(spark, path).tables for path in (packed, plain))
    names = schemas.TRANSACTIONS.names
    left, right = read.transactions.select(*names), same.transactions.select(*names)
    assert left.count() == right.count() > 0
    assert left.exceptAll(right).isEmpty()


def test_arrow_streams_are_compressed_unless_asked_not_to(spark, tmp_path):
    transactions = fixtures.payments(spark, SMALL).transactions
    for compression in ("zstd", "lz4", "none"):
        arrow_ipc.write(transactions, f"{tmp_path}/{compression}", compression=compression)
        back = arrow_ipc.read(spark, f"{tmp_path}/{compression}", schemas.TRANSACTIONS)
        assert transactions.exceptAll(back).isEmpty() and back.count() == transactions.count()
    arrow_ipc.write(transactions, f"{tmp_path}/usual")
    assert _bytes(f"{tmp_path}/usual") * 3 < _bytes(f"{tmp_path}/none")
    with pytest.raises(Exception, match="compression must be"):
        arrow_ipc.write(transactions, f"{tmp_path}/other", compression="brotli")


def test_writes_leave_no_shuffle_files_and_no_headers(spark, tmp_path):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n for n in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles())) if n.startswith("shuffle_")}

    def headers():
        return set(storage.children(spark, storage.shared_folder(spark)))

    tables = fixtures.payments(spark, SMALL)
    before, kept = shuffles(), headers()
    pain_xml_writer.write(tables, f"{tmp_path}/documents", layout="packed")
    storage.write_once(tables.transactions.repartition("ccy"), "dealt")
    tables.clustered().save(f"{tmp_path}/tables")
    deadline = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert not {n for n in headers() - kept if not n.startswith("dealt")}
    assert storage.SHUFFLE_CLEANUP not in spark.conf.getAll or spark.conf.get(storage.SHUFFLE_CLEANUP) == "false"


def test_documents_are_written_a_slice_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pain_xml_writer, "SLICE_ROWS", 2_500)
    tables = fixtures.payments(spark, SMALL)
    before = set(storage.children(spark, storage.shared_folder(spark)))
    seen = []
    for pieces in pain_xml_writer.slices(tables):
        waiting = set(storage.children(spark, storage.shared_folder(spark))) - before
        seen.append((pieces.count(), {r[0] for r in pieces.select("msg_id").distinct().collect()}, len(waiting)))
    assert len(seen) == 3 and all(n and left == 1 for n, _, left in seen)
    assert sum(len(ids) for _, ids, _ in seen) == len(set.union(*(ids for _, ids, _ in seen))) == tables.message.count()
    assert sum(n for n, _, _ in seen) == pain_xml_writer.fragments(tables).count()
    # Of the shared folder only what fragments() has written itself is left.
    assert len(set(storage.children(spark, storage.shared_folder(spark))) - before) == 1


IN_TURN = (
    "xml_quarantine xml_late_fields xml_last_values repeated_blocks_roundtrip xml_roundtrip_message parse_stats ingest_report "
    "batch_callbacks stream_checks stream_irregular scoped_roundtrip"
).split()


@pytest.mark.parametrize("name", IN_TURN)
def test_queries_are_the_same_in_slices(spark, monkeypatch, name):
    monkeypatch.setattr(pain_xml_writer, "SLICE_ROWS", 2_500)
    before = set(storage.children(spark, storage.shared_folder(spark)))
    assert compare(spark, oracle_connection(SMALL), catalog.queries()[name], oracle.queries()[name], SMALL)[0] == ""
    left = set(storage.children(spark, storage.shared_folder(spark))) - before
    assert not [n for n in left if n.startswith(("documents", "headers"))]


def test_a_packed_write_that_fails_leaves_no_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pain_xml_writer, "SLICE_ROWS", 2_500)
    tables, path = fixtures.payments(spark, SMALL), f"{tmp_path}/documents"
    pieces = pain_xml_writer._pieces
    calls = []

    def second_fails(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("no more room")
        return pieces(*args)

    monkeypatch.setattr(pain_xml_writer, "_pieces", second_fails)
    with pytest.raises(OSError, match="no more room"):
        pain_xml_writer.write(tables, path, layout="packed")
    assert not [n for n in storage.children(spark, path) if n[0] not in "_."]
    monkeypatch.setattr(pain_xml_writer, "_pieces", pieces)
    with pytest.raises(OSError, match="exists"):
        (tmp_path / "there").mkdir()
        pain_xml_writer.write(tables, f"{tmp_path}/there", layout="packed")


def test_stored_tables_are_zstd(spark, tmp_path):
    fixtures.payments(spark, SMALL).append(f"{tmp_path}/stored")
    parts = [f.name for f in Path(tmp_path).rglob("part-*.parquet")]
    assert parts and all(".zstd." in name for name in parts)


def test_clustered_tables_are_stored_a_range_of_ids_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables_, "RANGE_ROWS", 2_500)
    tables = fixtures.payments(spark, SMALL)
    none = tables.transactions.limit(1).withColumn("pmt_inf_id", F.lit(None).cast("string"))
    tables = replace(tables, transactions=tables.transactions.unionByName(none))
    stored = tables.save_clustered(f"{tmp_path}/stored")
    for name, df in stored.items():
        own = getattr(tables, name)
        assert df.count() == own.count() and df.exceptAll(own).isEmpty()
    writes = {f.name.split("-")[2] for f in Path(f"{tmp_path}/stored/transactions").glob("part-*")}
    assert len(writes) == 3
    files = stored.transactions.groupBy(F.input_file_name().alias("f")).agg(F.min("pmt_inf_id").alias("low"), F.max("pmt_inf_id").alias("high"))
    spans = sorted((r["low"], r["high"]) for r in files.collect() if r["low"])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_kept_tables_are_compressed_and_go_after_use(spark):
    tables = fixtures.payments(spark, SMALL)
    before = set(storage.children(spark, storage.shared_folder(spark)))
    with pytest.raises(OSError, match="stop"):
        with tables.kept() as kept:
            (folder,) = set(storage.children(spark, storage.shared_folder(spark))) - before
            parts = [f.name for f in Path(storage.shared_folder(spark), folder).rglob("part-*.parquet")]
            assert parts and all(".zstd." in name for name in parts)
            for name, df in kept.items():
                own = getattr(tables, name)
                assert df.count() == own.count() and df.exceptAll(own).isEmpty()
            raise OSError("stop")
    assert set(storage.children(spark, storage.shared_folder(spark))) == before
    assert compare(spark, oracle_connection(SMALL), catalog.queries()["kept_tables"], oracle.queries()["kept_tables"], SMALL)[0] == ""
    assert set(storage.children(spark, storage.shared_folder(spark))) == before
    assert spark._jsc.sc().getPersistentRDDs().isEmpty()


def test_slices_read_the_transactions_once(spark, tmp_path):
    """In however many parts transactions wait for their headers, they are read once; the parts hold every row of a block."""
    tables = fixtures.payments(spark, SMALL)
    reads = spark.sparkContext.accumulator(0)
    seen = tables.transactions.rdd.map(lambda row: reads.add(1) or row)
    counted = replace(tables, transactions=spark.createDataFrame(seen, tables.transactions.schema))
    _, blocks = pain_xml_writer._headers(counted, f"{tmp_path}/headers")
    rows = [part.count() for part in pain_xml_writer._placed_in_parts(counted, blocks, 3, f"{tmp_path}/parts")]
    assert all(rows) and sum(rows) == tables.transactions.join(tables.remittance, "pmt_inf_id", "left_semi").count()
    assert reads.value == tables.transactions.count()


def test_files_of_few_tasks_are_parsed_by_more(spark, tmp_path):
    """A compressed file is one task until its headers' ids are known; then its blocks are parsed by several, with equal rows."""
    pain_xml_writer.write(fixtures.payments(spark, SMALL), f"{tmp_path}/documents", layout="packed", compression="gzip")
    raw = pain_xml.scan(spark.read, f"{tmp_path}/documents").coalesce(1)
    assert pain_xml._few_tasks(raw) and not pain_xml._few_tasks(raw.repartition(8))
    one, more = (storage.write_at(pain_xml.parse_pieces(raw, dealt_out), f"{tmp_path}/staged-{dealt_out}") for dealt_out in (False, True))
    plan = pain_xml.parse_pieces(raw, dealt_out=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(source_file" in plan
    text = F.to_json(F.struct("*"))
    assert one.select(text).exceptAll(more.select(text)).isEmpty() and one.count() == more.count()
