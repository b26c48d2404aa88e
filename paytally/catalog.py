"""Every query by name: a function of the session and a folder of benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from paytally import fixtures, generate, schemas
from paytally.functions import scalars as S
from paytally.operators import domain, field_checks, lookups, reconcile
from paytally.operators.issues import find
from paytally.plans import callbacks, report, suite
from paytally.sources import arrow_ipc, ingest, pain_xml, pain_xml_writer
from paytally.storage import fresh_path, remove
from paytally.streaming import arrivals
from paytally.tables import PaymentTables

Query = Callable[[SparkSession, str], DataFrame]

FIELD = ("validator", "severity", "rule", "id", "message")
COMPARED = ("id", "declared", "actual")
SUITE = ("validator", "severity", "rule", "id", "declared", "actual")
ONE_MESSAGE = "MSG-0000000001"
ONE_BLOCK = "PMT-0000000001"


def _over(build: Callable[[PaymentTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fixtures.payments(spark, sf_dir))


def _rule(table: str, validator: str, rule) -> Query:
    return _over(lambda t: find(getattr(t, table), validator, [rule()]).select(*FIELD))


def _findings(build, *columns: str) -> Query:
    return _over(lambda t: build(t).select(*columns))


def field_queries() -> dict[str, Query]:
    m, r, t = (field_checks.MESSAGE_VALIDATOR, field_checks.REMITTANCE_VALIDATOR, field_checks.TRANSACTION_VALIDATOR)
    return {
        "msg_id_too_long": _rule("message", m, field_checks.message_id_too_long),
        "initiating_party_missing": _rule("message", m, field_checks.initiating_party_missing),
        "creation_time_missing": _rule("message", m, field_checks.creation_time_missing),
        "iban_format_invalid": _rule("remittance", r, field_checks.iban_format_invalid),
        "payment_method_missing": _rule("remittance", r, field_checks.payment_method_missing),
        "payment_method_unknown": _findings(field_checks.payment_methods, *FIELD),
        "amount_not_positive": _rule("transactions", t, field_checks.amount_not_positive),
        "amount_not_positive_strict": _findings(field_checks.every_transaction, *FIELD),
        "creditor_missing": _rule("transactions", t, field_checks.creditor_missing),
        "field_checks": _findings(
            (suite.message_check() + suite.remittance_check() + suite.transaction_check()).findings, *FIELD
        ),
        "parallel_transaction_check": _findings(suite.parallel_transaction_check().findings, *FIELD),
        "invalid_iban_list": _over(field_checks.invalid_ibans),
        "row_check_counts": _over(field_checks.every_transaction_counts),
    }


def lookup_queries() -> dict[str, Query]:
    return {
        "remittances_of_message": _over(
            lambda t: lookups.remittances_of(t, ONE_MESSAGE).withColumn(
                "reqd_exctn_dt", F.col("reqd_exctn_dt").cast("string")
            )
        ),
        "transactions_of_remittance": _over(lambda t: lookups.transactions_of(t, ONE_BLOCK)),
        "sum_of_remittance": _over(lambda t: lookups.sum_of_remittance(t, ONE_BLOCK)),
        "remittance_count": _over(lambda t: lookups.row_count(t.remittance)),
        "transaction_count": _over(lambda t: lookups.row_count(t.transactions)),
        "total_amount": _over(lookups.total_amount),
        "message_summary": _over(lookups.message_summary),
        "table_counts": _over(lambda t: t.counts()),
        "amount_by_currency": _over(lookups.amount_by_currency),
        "mixed_currency_blocks": _over(lookups.mixed_currency_blocks),
    }


def reconcile_queries() -> dict[str, Query]:
    return {
        "ctrl_sum_remittance": _findings(reconcile.control_sum_remittance, *COMPARED),
        "ctrl_sum_message": _findings(reconcile.control_sum_message, *COMPARED),
        "nb_txs_remittance": _findings(reconcile.count_remittance, *COMPARED),
        "nb_txs_message": _findings(reconcile.count_message, *COMPARED),
        "ctrl_sum_remittance_exact": _findings(reconcile.control_sum_remittance_exact, *COMPARED),
        "ctrl_sum_message_exact": _findings(reconcile.control_sum_message_exact, *COMPARED),
        "nb_txs_remittance_exact": _findings(reconcile.count_remittance_exact, *COMPARED),
        "nb_txs_message_exact": _findings(reconcile.count_message_exact, *COMPARED),
    }


def domain_queries() -> dict[str, Query]:
    def validity(table: str, column: str, test) -> Query:
        return _over(
            lambda t: getattr(t, table)
            .groupBy(column)
            .agg(F.count("*").alias("n"))
            .select(column, test(F.col(column)).alias("valid"), "n")
        )

    def each(table: str, id: str, column: str, test) -> Query:
        return _over(lambda t: getattr(t, table).select(id, test(F.col(column)).alias("valid")))

    return {
        "iban_mod97": each("remittance", "pmt_inf_id", "dbtr_acct_iban", S.iban_valid),
        "bic_valid": validity("transactions", "cdtr_agt_bicfi", S.bic_valid),
        "currency_valid": validity("transactions", "ccy", S.currency_valid),
        "offset_datetime_valid": each("message", "msg_id", "msg_cre_dt_tm", S.offset_date_time_valid),
        "domain_message": _findings(domain.message_domain, *FIELD),
        "domain_remittance": _findings(domain.remittance_domain, *FIELD),
        "domain_transaction": _findings(domain.transaction_domain, *FIELD),
        "domain_control_sum": _findings(domain.domain_control_sums, "rule", *COMPARED),
    }


def suite_queries() -> dict[str, Query]:
    standard = suite.standard_suite()
    chained = suite.remittance_check() + suite.transaction_check()
    return {
        "standard_suite": _over(lambda t: standard.run(t).issues.select(*SUITE)),
        "standard_suite_exact": _over(lambda t: suite.standard_suite("exact").run(t).issues.select(*SUITE)),
        "standard_suite_summary": _over(lambda t: standard.run(t).by_validator()),
        "standard_suite_totals": _over(lambda t: standard.run(t).totals()),
        "standard_suite_lazy": _findings(standard.findings, *SUITE),
        "first_errors": _over(lambda t: standard.run(t).first_errors()),
        "chained_checks": _findings(chained.findings, *FIELD),
        "domain_suite_summary": _over(lambda t: report.by_validator(suite.domain_suite().findings(t))),
    }


# ---- documents, exchange and streams ---------------------------------------------------------

_DOCUMENTS: dict[tuple[str, str], str] = {}
#: Documents of queries are markup for one reading: a tenth of the space.
PACKED = {"layout": "packed", "compression": "gzip"}


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """The fixture tables as documents, written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DOCUMENTS:
        path = fresh_path(spark, "documents")
        pain_xml_writer.write(fixtures.payments(spark, sf_dir), path, **PACKED)
        _DOCUMENTS[key] = path
    return _DOCUMENTS[key]


def _in_turn(spark: SparkSession, tables: PaymentTables, store: Callable[[DataFrame], DataFrameWriter], *of) -> Iterator[str]:
    """A folder of documents, a slice of the messages at a time; what it held goes when the next slice is asked for."""
    folder = fresh_path(spark, "documents")
    for pieces in pain_xml_writer.slices(tables, *of):
        store(pieces).mode("append").text(folder, compression="gzip")
        yield folder
        remove(spark, folder)


def _whole_messages(pieces: DataFrame) -> DataFrameWriter:
    return pieces.repartition("msg_id").sortWithinPartitions(*pain_xml_writer.ORDER).select("value").write


def _documents_in_turn(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """The same documents a slice at a time, if there are several: documents and what is read from them need not both be whole."""
    tables = fixtures.payments(spark, sf_dir)
    if pain_xml_writer.slice_count(tables) == 1:
        yield _documents(spark, sf_dir)
    else:
        yield from _in_turn(spark, tables, _whole_messages)


def _read_in_turn(spark: SparkSession, folders: Iterator[str], within: str = "") -> pain_xml.PaymentFiles:
    return pain_xml.together([pain_xml.read(spark, folder + within) for folder in folders])


def _from_xml(build: Callable[[pain_xml.PaymentFiles], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_read_in_turn(spark, _documents_in_turn(spark, sf_dir)))


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.typeName() == "date"})


def _columns(table: str, df: DataFrame) -> DataFrame:
    return _dates_as_text(df.select(*schemas.TABLES[table].names))


def _line_counts(files: pain_xml.PaymentFiles) -> DataFrame:
    def lines(name: str):
        return F.coalesce(F.size(F.split(F.col(name), "\n")), F.lit(0))

    return (
        files.tables.transactions.groupBy(
            lines("rmt_inf_ustrd").alias("ustrd_lines"), lines("rglty_rptg_cd").alias("code_lines")
        ).agg(F.count("*").alias("n"))
    )


# Messages to a file of the quarantine query, so that files grow in number with the data.
FILE_MESSAGES = 24


def _damaged_documents(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """Documents in files of a few messages each, by the number of the message; most files are damaged in some way."""
    tables = fixtures.payments(spark, sf_dir)
    value, bucket = F.col("value"), F.col("bucket")
    closing = value == pain_xml_writer.DOCUMENT_CLOSE
    damages = {
        2: F.regexp_replace(value, "<CtrlSum>[^<]*<", "<CtrlSum>many<"),
        3: F.regexp_replace(value, '(<InstdAmt Ccy="[^"]*">)[^<]+<', "$1much<"),
        4: F.regexp_replace(value, "<Dt>[^<]*<", "<Dt>2026-1-1<"),
        5: F.replace(value, F.lit("</MsgId>"), F.lit("</MsgId><InitgPty><Nm></InitgPty>")),
        6: F.replace(value, F.lit("<Amt>"), F.lit("<Amt><Bad>")),
        7: F.when(closing, F.concat(F.lit("</Oops>"), value)).otherwise(value),
        8: F.when(closing, F.concat(F.lit("<!-- <CdtTrfTxInf> "), value)).otherwise(value),
    }
    damaged = value
    for kind, text in damages.items():
        damaged = F.when(bucket % 10 == kind, text).otherwise(damaged)
    of_message = F.expr(f"cast(substring(msg_id, -10, 10) as bigint) div {FILE_MESSAGES}")

    def store(pieces: DataFrame) -> DataFrameWriter:
        return (
            pieces.withColumn("bucket", of_message)
            .where((bucket % 10 != 1) | (F.col("section") < 2))
            .repartition("bucket")
            .sortWithinPartitions("bucket", *pain_xml_writer.ORDER)
            .select("bucket", damaged.alias("value"))
            .write.partitionBy("bucket")
        )

    return _in_turn(spark, tables, store, [of_message])


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read_in_turn(spark, _damaged_documents(spark, sf_dir), "/*/*.txt.gz")
    bucket = F.regexp_extract("source_file", r"bucket=(\d+)", 1).cast("bigint")
    kept = files.tables.message.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("messages"))
    reason = F.substring_index("reason", ":", 1)
    lost = files.rejects.select(bucket.alias("bucket"), reason.alias("reason"))
    return kept.join(lost, "bucket", "full")


def _rewritten(spark: SparkSession, tables: PaymentTables, value: Column, trailing: tuple[str, ...] = ()) -> Iterator[str]:
    """Documents in turn, with ``value`` for the text of each piece."""
    return _in_turn(spark, tables, lambda pieces: _whole_messages(pieces.withColumn("value", value)), ["msg_id"], trailing)


def _late_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that have some of their fields after their transactions."""
    tables = fixtures.payments(spark, sf_dir)
    files = _read_in_turn(spark, _rewritten(spark, tables, F.col("value"), tuple(pain_xml_writer.TRAILING)))
    return _columns("remittance", files.tables.remittance)


def _last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with an earlier reference before their own: the last value of an element counts."""
    tables = fixtures.payments(spark, sf_dir)
    earlier = "<Strd><CdtrRefInf><Tp><CdOrPrtry><Cd>EARLIER</Cd></CdOrPrtry></Tp><Ref>EARLIER</Ref></CdtrRefInf></Strd>"
    folders = _rewritten(spark, tables, F.replace(F.col("value"), F.lit("<Strd>"), F.lit(f"{earlier}<Strd>")))
    return _read_in_turn(spark, folders).tables.transactions.select("pmt_inf_id", "instr_id", "rmt_inf_strd_ref", "rmt_inf_strd_ref_tp")


def _reread(spark: SparkSession, tables: PaymentTables) -> pain_xml.PaymentFiles:
    """What is read from documents of ``tables``, which are deleted once they are parsed."""

    def store(pieces: DataFrame) -> DataFrameWriter:
        key = [c for c in (*tables.scope, "source_file") if c in pieces.columns]
        return pieces.repartition(*key, "message_at").sortWithinPartitions(*key, *pain_xml_writer.ORDER).select("value").write

    return _read_in_turn(spark, _in_turn(spark, tables, store))


def _repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose blocks share two ids, written and read twice: every transaction stays in its block.

    The fixture has no document to take places from; keys stand for them. A block is told by its debtor account.
    """
    tables = fixtures.payments(spark, sf_dir)

    def place(name: str) -> Column:
        return F.struct(F.lit(0).cast("long").alias("split"), F.substring(name, 5, 40).cast("long").alias("seq"), F.lit(0).alias("pos"))

    shared = F.concat(F.lit("BLOCK-"), F.substring("pmt_inf_id", -10, 10).cast("long") % 2)
    one = F.lit("one").alias("source_file")
    here = PaymentTables(
        tables.message.select(one, place("msg_id").alias("position"), "*"),
        tables.remittance.select(one, place("pmt_inf_id").alias("position"), place("msg_id").alias("parent"), "*").withColumn("pmt_inf_id", shared),
        tables.transactions.select(one, place("pmt_inf_id").alias("parent"), "*").withColumn("pmt_inf_id", shared),
        located=True,
    )
    first = _reread(spark, here)
    second = _reread(spark, first.tables)
    first.discard()
    here = second.tables
    key = ["source_file", "parent"]
    blocks = here.remittance.drop("parent").withColumnRenamed("position", "parent").select(*key, "msg_id", "dbtr_acct_iban", "pmt_inf_id")
    amounts = here.transactions.select(*key, "instd_amt", F.lit(1).alias("n"))
    return blocks.join(amounts, key, "left").groupBy("msg_id", "dbtr_acct_iban", "pmt_inf_id").agg(
        F.count("n").alias("n"), F.sum("instd_amt").cast(schemas.TOTAL).alias("total")
    )


def _last_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages declared in one file and again in the next, some without a sum; file k holds 2k + 1 messages."""
    tables = fixtures.payments(spark, sf_dir)
    number = F.substring("msg_id", -10, 10).cast("bigint")
    file = F.floor(F.sqrt(number))
    again = tables.message.where(number % 3 > 0).select(
        (file + 1).alias("file"), "msg_id", "msg_cre_dt_tm", "msg_nb_of_txs",
        F.when(number % 3 == 1, (F.col("msg_ctrl_sum") + 1).cast(schemas.CONTROL_SUM)).alias("msg_ctrl_sum"), "msg_initg_pty_nm",
    )
    both = tables.message.select(file.alias("file"), "*").unionByName(again).withColumn("file", F.lpad(F.col("file").cast("string"), 12, "0"))
    none = tables.map(lambda _, df: df.withColumn("file", F.lit("")).where("1 = 0"))
    declared = PaymentTables(both, none.remittance, none.transactions, scope=("file",))
    path = fresh_path(spark, "declared")
    with pain_xml_writer.written_from(declared) as pieces:
        pieces = pieces.repartition("file").sortWithinPartitions("file", *pain_xml_writer.ORDER)
        pieces.select("file", "value").write.partitionBy("file").text(path, compression="gzip")
    found = reconcile.declared_by_messages(pain_xml.read(spark, f"{path}/*/*.txt.gz").tables)
    return found.select("msg_id", "ctrl_sum", "nb_of_txs")


def _clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of tables stored in the order of their ids."""
    tables = fixtures.payments(spark, sf_dir)
    return lookups.transactions_of(tables.save_clustered(fresh_path(spark, "clustered")), ONE_BLOCK)


def _kept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of tables that are kept while they are counted."""
    with fixtures.payments(spark, sf_dir).kept() as kept:
        counts = kept.counts().collect()
    return spark.createDataFrame(counts)


def _arrow_round_trip(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, "exchange")
        tables = fixtures.payments(spark, sf_dir)
        arrow_ipc.write(getattr(tables, table), f"{path}/{table}")
        return _columns(table, arrow_ipc.read(spark, f"{path}/{table}", schemas.TABLES[table]))

    return run


def _appended_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixtures.payments(spark, sf_dir)
    path = fresh_path(spark, "appended")
    tables.append(path)
    twice = tables.append(path)
    return twice.transactions.groupBy("ccy").agg(
        F.count("*").alias("n"), F.sum("instd_amt").cast(schemas.TOTAL).alias("total")
    )


def _ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = ("message_rows", "remittance_rows", "transaction_rows", "rejected_files")
    target, base, values = fresh_path(spark, "ingested"), ingest.dataset_name("payments.XML"), dict.fromkeys(fixed, 0)
    for documents in _documents_in_turn(spark, sf_dir):
        result = ingest.ingest(spark, documents, target, mode="append", base=base)
        for metric, value in result.report().where(F.col("metric").isin(*fixed)).collect():
            values[metric] += int(value)
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(v).cast("bigint").alias("value")) for n, v in values.items()))
    return spark.range(1).select(F.explode(pairs).alias("m")).select("m.*")


def _arrived(spark: SparkSession, folders: Iterator[str], **how) -> str:
    """Where a stream has stored what arrives in a folder, a slice at a time."""
    target = fresh_path(spark, "arrivals")
    for folder in folders:
        arrivals.start(spark, folder, f"{target}/tables", f"{target}/checkpoint", max_files=4, **how).awaitTermination()
    return f"{target}/tables"


def _stream(spark: SparkSession, sf_dir: str, checks: suite.Suite | None = None) -> str:
    return _arrived(spark, _documents_in_turn(spark, sf_dir), suite=checks)


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns("transactions", arrivals.stored_tables(spark, _stream(spark, sf_dir)).transactions)


def _stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _stream(spark, sf_dir, suite.standard_suite())
    return arrivals.stored_issues(spark, target).select(*SUITE)


# What a tag inside a comment or CDATA section looks like, put in front of every block's end.
HIDDEN = "<!-- <CdtTrfTxInf> --><!-- </CdtTrfTxInf> -->"


def _stream_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over files that all hold transaction tags in comments: not a row is lost."""
    tables = fixtures.payments(spark, sf_dir)
    ending = F.col("value") == pain_xml_writer.BLOCK_CLOSE
    folders = _rewritten(spark, tables, F.when(ending, F.concat(F.lit(HIDDEN), F.col("value"))).otherwise(F.col("value")))
    return _columns("transactions", arrivals.stored_tables(spark, _arrived(spark, folders)).transactions)


def _scoped_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment in three documents that share all block ids, written, read back and counted."""
    tables = fixtures.payments(spark, sf_dir)
    copies = spark.range(3).select(F.concat(F.lit("copy"), F.col("id").cast("string")).alias("copy"))
    many = replace(tables.map(lambda _, df: df.join(F.broadcast(copies))), scope=("copy",))
    named = F.concat_ws("/", "copy", "msg_id")
    many = many.map(lambda name, df: df if name == "transactions" else df.withColumn("msg_id", named))
    # Copies of a document are whole messages; the number of a transaction's copies is its own check.
    back = _reread(spark, many).tables.transactions
    return back.groupBy("end_to_end_id").agg(F.count("*").alias("n"), F.sum("instd_amt").cast(schemas.TOTAL).alias("total"))


def _failing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check that raises becomes a finding; the standard checks still report."""

    def broken(tables: PaymentTables) -> DataFrame:
        raise KeyError("no such column")

    report_ = suite.Suite(suite.Check("Broken", broken), *suite.standard_suite().checks).run(fixtures.payments(spark, sf_dir))
    return report_.by_validator()


def _prefix() -> str:
    return f"t_{uuid.uuid4().hex[:12]}_"


def _created_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed tables created empty, filled by name, read by name."""
    names = ingest.create_tables(spark, prefix=_prefix())
    ingest.insert_into(fixtures.payments(spark, sf_dir), names)
    return spark.table(names["transactions"]).groupBy("ccy").agg(
        F.count("*").alias("n"), F.sum("instd_amt").cast(schemas.TOTAL).alias("total")
    )


def _saved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ingest.save_as_tables(fixtures.payments(spark, sf_dir), _prefix())
    return PaymentTables(*(spark.table(names[name]) for name in schemas.TABLES)).counts()


def _batch_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table as the handler of a stream sees them, batch by batch."""
    seen = dict.fromkeys(schemas.TABLES, 0)

    def on_table(name: str, df: DataFrame, batch_id: int) -> None:
        seen[name] += df.count()

    _arrived(spark, _documents_in_turn(spark, sf_dir), on_table=on_table)
    counts = [F.lit(seen[name]).cast("bigint").alias(f"{name.removesuffix('s')}_rows") for name in schemas.TABLES]
    return spark.range(1).select(*counts)


def _row_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a row handler was called on, counted where they are."""
    calls = spark.sparkContext.accumulator(0)
    callbacks.for_each_row(fixtures.payments(spark, sf_dir).transactions, lambda row: calls.add(1))
    return spark.range(1).select(F.lit(calls.value).cast("bigint").alias("n"))


def _dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", ingest.dataset_name(F.concat("url", F.lit(".XML"))).alias("dataset"))


def document_queries() -> dict[str, Query]:
    return {
        "xml_roundtrip_message": _from_xml(lambda f: _columns("message", f.tables.message)),
        "xml_roundtrip_remittance": _from_xml(lambda f: _columns("remittance", f.tables.remittance)),
        "xml_roundtrip_transaction": _from_xml(lambda f: _columns("transactions", f.tables.transactions)),
        "xml_repeated_elements": _from_xml(_line_counts),
        "xml_quarantine": _quarantine,
        "xml_late_fields": _late_fields,
        "xml_last_values": _last_values,
        "repeated_blocks_roundtrip": _repeated_blocks,
        "last_declaration": _last_declaration,
        "kept_tables": _kept_tables,
        "clustered_lookup": _clustered_lookup,
        "parse_stats": _from_xml(lambda f: f.stats()),
        "ingest_report": _ingest_report,
        "arrow_roundtrip_message": _arrow_round_trip("message"),
        "arrow_roundtrip_remittance": _arrow_round_trip("remittance"),
        "arrow_roundtrip_transaction": _arrow_round_trip("transactions"),
        "table_append": _appended_twice,
        "projected_scan": _over(lambda t: t.project("transactions", "end_to_end_id", "instd_amt", "cdtr_nm")),
        "stream_ingest": _stream_ingest,
        "stream_checks": _stream_checks,
        "stream_irregular": _stream_irregular,
        "scoped_roundtrip": _scoped_round_trip,
        "failing_check": _failing_check,
        "created_tables": _created_tables,
        "saved_tables": _saved_tables,
        "batch_callbacks": _batch_callbacks,
        "row_callbacks": _row_callbacks,
        "dataset_names": _dataset_names,
    }


def _index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and transaction numbers for generated payments, one pair per line item."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").cast("bigint").alias("tx"))


def generated_queries() -> dict[str, Query]:
    def tables(spark: SparkSession, sf_dir: str, wrong: bool = False) -> PaymentTables:
        return generate.from_pairs(_index_pairs(spark, sf_dir), wrong)

    return {
        "generated_transactions": lambda s, d: tables(s, d).transactions,
        "generated_blocks": lambda s, d: _dates_as_text(tables(s, d).remittance),
        "generated_wrong_sums": lambda s, d: report.by_validator(
            suite.standard_suite().findings(tables(s, d, wrong=True))
        ),
        "generated_right_sums": lambda s, d: report.totals(suite.standard_suite().findings(tables(s, d))),
    }


def queries() -> dict[str, Query]:
    return {
        **field_queries(),
        **lookup_queries(),
        **reconcile_queries(),
        **domain_queries(),
        **suite_queries(),
        **document_queries(),
        **generated_queries(),
    }
