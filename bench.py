"""Headline timings as one JSON line.

The tables seen as payments are stored once, as an ingest would leave them, and the checks run
on the stored tables. The document stages run on a generated document, read cold, as large as
the scale of the tables asks for (one transaction per line item).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("paytally-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "32m")
        # Call-site capture on every column call doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    from paytally import fixtures, generate
    from paytally.operators import domain, field_checks, lookups, reconcile
    from paytally.plans import suite
    from paytally.sources import arrow_ipc, ingest, pain_xml_writer
    from paytally.tables import PaymentTables

    base = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    arrow_ipc.register(spark)
    times: dict[str, float] = {}

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(name: str, action, repeats: int = REPEATS) -> None:
        """Best of ``repeats``."""
        best = None
        for i in range(repeats):
            started = time.perf_counter()
            action(i)
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)

    timed("fixture_load", lambda i: fixtures.payments(spark, SF_DIR).map(lambda _, df: df.repartition(int(CPUS))).save(f"{base}/tables-{i}"), 1)
    setup = times.pop("fixture_load")
    t = PaymentTables.load(spark, f"{base}/tables-0")

    timed("standard_suite", lambda i: suite.standard_suite().run(t))
    timed("standard_suite_exact", lambda i: suite.standard_suite("exact").run(t))
    timed("domain_suite", lambda i: suite.domain_suite().run(t))
    timed("row_check", lambda i: run(field_checks.every_transaction(t)))
    for name, check in {
        "ctrl_sum_remittance": reconcile.control_sum_remittance,
        "ctrl_sum_message": reconcile.control_sum_message,
        "nb_txs_remittance": reconcile.count_remittance,
        "nb_txs_message": reconcile.count_message,
        "ctrl_sum_remittance_exact": reconcile.control_sum_remittance_exact,
        "ctrl_sum_message_exact": reconcile.control_sum_message_exact,
        "message_fields": field_checks.message_fields,
        "remittance_fields": field_checks.remittance_fields,
        "transaction_fields": field_checks.transaction_fields,
        "domain_transaction": domain.transaction_domain,
        "domain_control_sum": domain.domain_control_sums,
        "total_amount": lookups.total_amount,
        "amount_by_currency": lookups.amount_by_currency,
    }.items():
        timed(name, lambda i, check=check: run(check(t)))

    def export(i: int) -> None:
        for name, df in t.items():
            df.write.format(arrow_ipc.FORMAT).mode("overwrite").save(f"{base}/arrow/{name}")

    timed("arrow_export", export)
    timed(
        "arrow_load",
        lambda i: [run(df) for _, df in PaymentTables.load(spark, f"{base}/arrow", arrow_ipc.FORMAT).items()],
    )

    # The 1 x n document (one huge block) and the n x 1 document (one transaction per block).
    n = lookups.row_count(t.transactions).first()[0]
    rows = {}
    for label, spec in {"1xn": generate.Spec(1, n), "nx1": generate.Spec(n, 1)}.items():
        document = f"{base}/xml-{label}"
        pain_xml_writer.write(generate.from_spec(spark, spec), document, layout="packed")
        size = ingest.source_bytes(spark, document).agg({"length": "sum"}).first()[0]
        rows[label] = {"transactions": n, "mb": round(size / 1048576, 1)}
        timed(f"ingest_{label}", lambda i: ingest.ingest(spark, document, f"{base}/in-{label}-{i}"))
        stored = PaymentTables.load(spark, f"{base}/in-{label}-0")
        timed(f"suite_{label}", lambda i: suite.standard_suite().run(stored))
        timed(f"row_check_{label}", lambda i: run(field_checks.every_transaction(stored)))

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "documents": rows,
                "setup_seconds": setup,
            }
        )
    )


if __name__ == "__main__":
    main()
