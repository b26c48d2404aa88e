"""Small hand-made tables: duplicates, orphans, missing keys and values, unreadable counts."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paytally import fixtures, schemas
from paytally.operators import domain, field_checks, lookups, reconcile
from paytally.plans import callbacks, suite
from paytally.storage import write_once
from paytally.tables import PaymentTables


def frame(spark, schema, rows):
    names = schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1)


def tables(spark, messages=(), remittances=(), transactions=()):
    def number(row, *names):
        return {k: Decimal(str(v)) if k in names and v is not None else v for k, v in row.items()}

    return PaymentTables(
        frame(spark, schemas.MESSAGE, [number(r, "msg_ctrl_sum") for r in messages]),
        frame(spark, schemas.REMITTANCE, [number(r, "ctrl_sum") for r in remittances]),
        frame(spark, schemas.TRANSACTIONS, [number(r, "instd_amt") for r in transactions]),
    )


def block(pmt, msg="M", total=None, n=None, **more):
    return {"msg_id": msg, "pmt_inf_id": pmt, "ctrl_sum": total, "nb_of_txs": n, **more}


def tx(pmt, amount, e2e="e", ccy="EUR", **more):
    return {"pmt_inf_id": pmt, "instd_amt": amount, "end_to_end_id": e2e, "ccy": ccy, **more}


def found(df):
    return sorted(
        ((r.rule, r.id, None if r.declared is None else float(r.declared), None if r.actual is None else float(r.actual))
         for r in df.collect()),
        key=str,
    )


def test_sql_sums_fan_out_over_duplicated_blocks(spark):
    t = tables(
        spark,
        [{"msg_id": "M", "msg_ctrl_sum": 30}],
        [block("P", total=30), block("P", total=30), block("P", total=7), block("Q", total=5)],
        [tx("P", 10), tx("P", 20), tx("X", 99), tx(None, 1)],
    )
    assert found(reconcile.control_sum_remittance(t)) == [
        ("ctrl_sum_remittance", "P", 30.0, 60.0),
        ("ctrl_sum_remittance", "P", 7.0, 30.0),
    ]
    assert found(reconcile.control_sum_message(t)) == [("ctrl_sum_message", "M", 30.0, 90.0)]


def test_exact_sums_take_the_last_declaration_and_report_childless_blocks(spark):
    t = tables(
        spark,
        [{"msg_id": "M", "msg_ctrl_sum": 31}],
        [block("P", total=7), block("P", total=30), block("P", msg=None), block("Q", total=5), block("Z", total=0)],
        [tx("P", 10), tx("P", 20), tx("P", None), tx("X", 99)],
    )
    assert found(reconcile.control_sum_remittance_exact(t)) == [("ctrl_sum_remittance", "Q", 5.0, 0.0)]
    assert found(reconcile.control_sum_message_exact(t)) == [("ctrl_sum_message", "M", 31.0, 30.0)]


def test_tolerance_is_strict(spark):
    t = tables(spark, [], [block("P", total=1), block("Q", total=1)], [tx("P", "1.001"), tx("Q", "1.00101")])
    assert [r[1] for r in found(reconcile.control_sum_remittance_exact(t))] == ["Q"]


def test_counts_of_both_forms(spark):
    t = tables(
        spark,
        [{"msg_id": "M", "msg_nb_of_txs": "2"}, {"msg_id": "N", "msg_nb_of_txs": "0"}, {"msg_id": "E", "msg_nb_of_txs": "1"}],
        [block("P", n="2"), block("Q", n="1"), block(None, n="3")],
        [tx("P", 1), tx("P", 1, e2e=None)],
    )
    assert found(reconcile.count_remittance(t)) == [
        ("nb_txs_remittance", "P", 2.0, 1.0),
        ("nb_txs_remittance", "Q", 1.0, 0.0),
        ("nb_txs_remittance", None, 3.0, 0.0),
    ]
    assert found(reconcile.count_message(t)) == [
        ("nb_txs_message", "E", 1.0, 0.0),
        ("nb_txs_message", "M", 2.0, 1.0),
    ]
    assert found(reconcile.count_remittance_exact(t)) == [("nb_txs_remittance", "Q", 1.0, 0.0)]
    assert found(reconcile.count_message_exact(t)) == [("nb_txs_message", "E", 1.0, 0.0)]


def test_unreadable_count_fails_the_sql_check_and_is_skipped_by_the_exact_one(spark):
    t = tables(spark, [], [block("P", n="many"), block("Q", n="5")], [tx("P", 1)])
    (row,) = reconcile.transaction_counts(t).collect()
    assert (row.validator, row.message, row.id) == ("NumberOfTransactionsValidator", "SQL validation failed", None)
    assert found(reconcile.transaction_counts_exact(t)) == [("nb_txs_remittance", "Q", 5.0, 0.0)]


def test_amount_check_differs_on_missing_amounts(spark):
    t = tables(spark, [], [], [tx("P", None, "a", cdtr_nm="x"), tx("P", 0, "b", cdtr_nm="x"), tx("P", 1, "c", cdtr_nm="x")])
    assert [r.id for r in field_checks.transaction_fields(t).collect()] == ["b"]
    assert sorted(r.id for r in field_checks.transaction_fields(t, exact=True).collect()) == ["a", "b"]
    assert sorted(r.id for r in field_checks.every_transaction(t).collect()) == ["a", "b"]
    assert tuple(field_checks.every_transaction_counts(t).first()) == (3, 2)


def test_finding_texts(spark):
    t = tables(
        spark,
        [{"msg_id": "M" * 36, "msg_initg_pty_nm": "", "msg_ctrl_sum": 12345678.5}],
        [block("P", msg="M" * 36, total=99999.99, n="3", dbtr_acct_iban="bad")],
        [tx("P", 0, "E1"), tx("P", 10000000, "E2", cdtr_nm="x")],
    )
    texts = {r.rule: (r.severity, r.message) for r in suite.standard_suite().findings(t).collect()}
    assert texts == {
        "msg_id_too_long": ("ERROR", "MsgId exceeds maximum length of 35 characters"),
        "initiating_party_missing": ("WARNING", "Initiating party (InitgPty) is missing"),
        "creation_time_missing": ("ERROR", "Creation date/time (CreDtTm) is required but missing"),
        "iban_format_invalid": ("ERROR", "Invalid IBAN format: bad"),
        "payment_method_missing": ("ERROR", "Payment method is required"),
        "amount_not_positive": ("ERROR", "Amount must be positive: PmtInfId=P, Amount=0.00000"),
        "creditor_missing": ("ERROR", "Creditor name is required: PmtInfId=P"),
        "ctrl_sum_remittance": ("ERROR", "Remittance CtrlSum mismatch: declared=99999.99, actual=1.0E7"),
        "ctrl_sum_message": ("ERROR", "Message CtrlSum mismatch: declared=1.23456785E7, actual=1.0E7"),
        "nb_txs_remittance": ("ERROR", "Remittance NbOfTxs mismatch: declared=3, actual=2"),
    }


def test_domain_walk_follows_parents(spark):
    good = "DE89370400440532013000"
    t = tables(
        spark,
        [{"msg_id": "M", "msg_ctrl_sum": 10}, {"msg_id": "M", "msg_ctrl_sum": 10}, {"msg_id": "B", "msg_ctrl_sum": -1}],
        [
            block("P", total=10, dbtr_acct_iban=good, dbtr_agt_bicfi="COBADEFF"),
            block("N", total=None, dbtr_acct_iban="x", dbtr_agt_bicfi="COBADEFF"),
            block("U", msg="B", total=1, dbtr_acct_iban=good, dbtr_agt_bicfi="COBADEFF"),
            block("O", msg="gone", total=1, dbtr_acct_iban="x"),
        ],
        [
            tx("P", "9.996", "a", cdtr_agt_bicfi="COBADEFF", cdtr_acct_iban=good, cdtr_nm="n"),
            tx("P", 5, "b", ccy="eur", cdtr_agt_bicfi="COBADEFF", cdtr_acct_iban=good, cdtr_nm="n"),
            tx("P", -1, "c", cdtr_agt_bicfi=None, cdtr_acct_iban=good, cdtr_nm=" "),
            tx("N", 7, "d", cdtr_agt_bicfi="COBADEFF", cdtr_acct_iban=good, cdtr_nm="n"),
            tx("O", -7, "orphan"),
        ],
    )
    rules = sorted((r.rule, r.id) for r in domain.remittance_domain(t).collect())
    assert rules.count(("debtor_iban_invalid", "N")) == 2  # once per message row
    assert not [r for r in rules if r[1] == "O"]
    rules = sorted((r.rule, r.id) for r in domain.transaction_domain(t).collect())
    assert rules == sorted(
        2 * [("currency_invalid", "b"), ("amount_invalid", "c"), ("creditor_bic_invalid", "c"), ("creditor_blank", "c")]
    )
    # 9.996 rounds to 10.00; the invalid block N adds nothing; under the invalid message nothing is looked at.
    assert found(domain.domain_control_sums(t)) == sorted(
        [
            ("ctrl_sum_remittance_invalid", "N", None, None),
            ("ctrl_sum_remittance_invalid", "N", None, None),
            ("ctrl_sum_message_invalid", "B", -1.0, None),
        ],
        key=str,
    )


def test_lookups_on_empty_tables(spark):
    t = tables(spark)
    assert lookups.message_summary(t).first()[0] == ""
    assert lookups.sum_of_remittance(t, "P").first()[0] == 0
    assert lookups.total_amount(t).first()[0] == 0
    assert tuple(t.counts().first()) == (0, 0, 0)


def test_message_summary_shows_missing_values(spark):
    t = tables(spark, [{"msg_id": "B"}, {"msg_id": "A", "msg_ctrl_sum": 1}])
    assert lookups.message_summary(t).first()[0] == (
        "msg_id=A, cre_dt_tm=null, nb_of_txs=null, ctrl_sum=1.00, initg_pty_nm=null"
    )


def test_mixed_currencies(spark):
    t = tables(spark, [], [], [tx("P", 1), tx("P", 2, ccy="USD"), tx("Q", 1), tx("Q", -1, ccy="USD")])
    assert [r.pmt_inf_id for r in lookups.mixed_currency_blocks(t).collect()] == ["P"]
    assert lookups.amount_by_currency(t).count() == 3


def test_scope_keeps_documents_apart(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    one = tables(spark, [{"msg_id": "M", "msg_ctrl_sum": 1, "msg_nb_of_txs": "1"}], [block("P", total=1, n="1")], [tx("P", 1)])
    two = tables(spark, [{"msg_id": "M", "msg_ctrl_sum": 2, "msg_nb_of_txs": "x"}], [block("P", total=2, n="1")], [tx("P", 2)])
    both = PaymentTables(
        *(
            a.withColumn("source_file", F.lit("1")).unionByName(b.withColumn("source_file", F.lit("2")))
            for (_, a), (_, b) in zip(one.items(), two.items())
        )
    )
    assert reconcile.control_sums(both).count() > 0
    scoped = replace(both, scope=("source_file",))
    assert reconcile.control_sums(scoped).count() == 0
    assert [(r.source_file, r.rule) for r in reconcile.transaction_counts(scoped).collect()] == [("2", "nb_txs_unreadable")]


def test_suite_composition(spark):
    t = tables(spark, [{"msg_id": "M"}], [block("P")], [tx("P", -1)])
    both = suite.message_check() + suite.transaction_check()
    assert both.name == "MessageValidator → TransactionValidator"
    built = suite.Suite.create().add(suite.message_check()).add_parallel(suite.transaction_check())
    assert sorted(map(tuple, built.findings(t).collect()), key=str) == sorted(map(tuple, both.findings(t).collect()), key=str)
    assert suite.Suite.start_with(both).run(t).totals().first().errors == 3
    assert suite.Suite.create().findings(t).count() == 0
    names = [c.name for c in suite.standard_suite().checks]
    assert names == [
        "MessageValidator", "RemittanceValidator", "TransactionValidator", "ControlSumValidator",
        "NumberOfTransactionsValidator",
    ]
    assert {r.validator for r in suite.parallel_transaction_check().findings(t).collect()} == {"ParallelTransactionValidator"}
    with pytest.raises(ValueError):
        suite.standard_suite("loose")


def test_failing_check_becomes_a_finding(spark):
    t = tables(spark, [{"msg_id": "M"}], [], [])
    failing = suite.Check("Broken", lambda tables: tables.message.selectExpr("raise_error('no service') as validator"))
    report = suite.Suite(failing, suite.message_check()).run(t, isolate=True)
    rows = {(r.validator, r.rule) for r in report.issues.collect()}
    assert ("Broken", "check_failed") in rows and ("MessageValidator", "creation_time_missing") in rows
    assert report.has_errors()
    assert report.warnings().count() == 1


def test_function_check_and_callbacks(spark):
    t = tables(spark, [], [], [tx("P", 1, "a"), tx("P", 2, "b")])

    def flag(frame: pd.DataFrame) -> pd.DataFrame:
        bad = frame[frame.end_to_end_id == "b"]
        out = pd.DataFrame({"id": bad.end_to_end_id})
        for name, value in (("validator", "Service"), ("severity", "ERROR"), ("rule", "refused"), ("message", "refused")):
            out[name] = value
        for name in ("detail", "declared", "actual"):
            out[name] = None
        return out[["validator", "severity", "rule", "id", "message", "detail", "declared", "actual"]]

    check = callbacks.function_check("Service", "transactions", flag, ["end_to_end_id"])
    assert [r.id for r in check.findings(t).collect()] == ["b"]
    assert [r.end_to_end_id for r in callbacks.local_rows(t.transactions)] == ["a", "b"]
    seen = spark.sparkContext.accumulator(0)
    callbacks.for_each_row(t.transactions, lambda row: seen.add(1))
    assert seen.value == 2


def test_a_hot_block_id_is_split(spark):
    """A third of all blocks and transactions under one id: AQE splits the join of both."""
    from pyspark.sql import functions as F

    n = 60_000
    id = F.col("id")
    key = F.when(id % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("P"), id.cast("string")))
    numbers = spark.range(n).repartition(4)
    remittance = numbers.select(F.lit("M").alias("msg_id"), key.alias("pmt_inf_id"), id.cast("decimal(18,2)").alias("ctrl_sum"))
    transactions = numbers.select(
        key.alias("pmt_inf_id"), F.lit(1).cast("decimal(18,5)").alias("instd_amt"), F.lit("e").alias("end_to_end_id")
    )
    t = PaymentTables(tables(spark).message, remittance, transactions)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = reconcile.control_sum_remittance(t)
        # Only id 1 is declared with what it holds; the hot id holds n / 3 and is declared so once at most.
        expected = sum(1 for i in range(n) if i != (n // 3 if i % 3 == 0 else 1))
        assert len(df.collect()) == expected
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


AWKWARD = {
    "message": [("M1", "4", "10.00"), ("M1", "5", "11.00"), ("M2", "1", None), ("M2", "1", None), ("M3", "2", "0.00"), (None, "1", "5.00"), ("M4", None, "3.00")],
    "remittance": [
        ("M1", "A", "2", "3.00"), ("M1", "A", "2", "3.00"), ("M1", "A", "3", "4.00"), ("M2", "B", "1", "1.00"), ("M2", "C", "7", None), ("M3", "D", "0", "0.00"),
        ("M3", "E", None, "9.99"), (None, "F", "1", "1.00"), ("M1", None, "0", "1.00"), ("M1", None, "0", "1.00"), ("M2", "A", "+2", "3.00"), ("lost", "G", "5", "2.00"),
    ],
    "transactions": [
        ("A", "a1", "1.50"), ("A", "a2", "1.50"), ("B", "b", "1.00"), ("C", None, "2.00"), ("E", "e", None), ("F", "f", "1.00"), (None, "n", "4.00"), ("lost", "l", "1.00"),
    ],
}


def awkward_tables(spark, scope: tuple = (), unreadable: bool = False) -> PaymentTables:
    """Repeated ids with equal and different declarations, null ids, childless blocks, rows without parents."""
    rows = {name: [*given] for name, given in AWKWARD.items()}
    if unreadable:
        rows["message"].append(("M9", "many", "1.00"))
    frames = {
        "message": spark.createDataFrame(rows["message"], "msg_id string, msg_nb_of_txs string, msg_ctrl_sum string"),
        "remittance": spark.createDataFrame(rows["remittance"], "msg_id string, pmt_inf_id string, nb_of_txs string, ctrl_sum string"),
        "transactions": spark.createDataFrame(rows["transactions"], "pmt_inf_id string, end_to_end_id string, instd_amt string"),
    }

    def typed(name, df, copy=""):
        fields = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name].fields]
        return df.select(*[F.lit(f"file{copy}").alias(c) for c in scope], *fields)

    def both(name, df):
        return typed(name, df).coalesce(1).unionByName(typed(name, df, "2").coalesce(1)) if scope else typed(name, df).coalesce(1)

    return PaymentTables(*(both(name, df) for name, df in frames.items()), scope=scope)


@pytest.mark.parametrize(
    "semantics, scope, unreadable", [("sql", (), True), ("sql", ("source_file",), True), ("sql", (), False), ("exact", (), False), ("exact", ("source_file",), False)]
)
def test_one_frame_finds_what_the_checks_find_by_themselves(spark, semantics, scope, unreadable):
    tables = awkward_tables(spark, scope, unreadable)
    standard = suite.standard_suite(semantics)
    apart = Counter(map(tuple, standard.findings(tables).collect()))
    together = Counter(map(tuple, standard.run(tables).issues.collect()))
    assert together == apart and apart
    if unreadable and not scope:
        twice = suite.Suite(*standard.checks, *standard.checks).run(tables).issues
        assert Counter(map(tuple, twice.collect())) == apart + apart


def test_checks_beside_a_broken_one_run_as_one_plan(spark, monkeypatch):
    def broken(tables):
        raise KeyError("no such column")

    tables = fixtures.payments(spark, "/root/testdata/sf0.001")
    written = []
    monkeypatch.setattr(suite, "write_once", lambda df, label: (written.append(label), write_once(df, label))[1])
    found = suite.Suite(suite.Check("Broken", broken), *suite.standard_suite().checks).run(tables).issues
    assert written == ["findings"]
    alone = suite.standard_suite().run(tables).issues
    assert found.where("rule = 'check_failed'").count() == 1
    rest = found.where("rule != 'check_failed'")
    assert rest.exceptAll(alone).isEmpty() and rest.count() == alone.count() > 0


def test_equal_block_totals_of_fixture_and_check_are_shuffled_once(spark):
    found = reconcile.control_sum_remittance(fixtures.payments(spark, "/root/testdata/sf0.001"))
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
