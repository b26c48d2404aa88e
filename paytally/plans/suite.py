"""Named checks and suites of them.

A suite is one logical plan: the union of its checks, run by a single action. How its parts
are scheduled is Spark's business.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally import schemas
from paytally.operators import domain, field_checks, reconcile
from paytally.operators.issues import ERROR, union_all
from paytally.plans.report import Report
from paytally.storage import write_once
from paytally.tables import PaymentTables

PARALLEL_TRANSACTION_VALIDATOR = "ParallelTransactionValidator"


@dataclass(frozen=True)
class Check:
    """A name and a function from the tables to findings, with the columns of ``schemas.ISSUES``
    after the scope columns. The function only builds a plan. ``reconciles`` tells that it works
    on block totals, which a run then computes once for all checks; ``measure`` and ``exact`` that it is
    one of the standard reconciliations, all of which a run finds in one pass."""

    name: str
    build: Callable[[PaymentTables], DataFrame]
    reconciles: bool = False
    measure: str | None = None
    exact: bool = False

    def findings(self, tables: PaymentTables) -> DataFrame:
        return self.build(tables).select(*tables.scope, *schemas.ISSUES.names)

    def and_then(self, other: Check) -> Check:
        """Both checks as one, first this one's findings, then the other's."""
        return Check(
            f"{self.name} → {other.name}",
            lambda tables: union_all([self.findings(tables), other.findings(tables)]),
            self.reconciles or other.reconciles,
        )

    __add__ = and_then


class Suite:
    """An ordered set of checks, built fluently."""

    def __init__(self, *checks: Check):
        self.checks = checks

    @staticmethod
    def create() -> Suite:
        return Suite()

    @staticmethod
    def start_with(check: Check) -> Suite:
        return Suite(check)

    def add(self, *checks: Check) -> Suite:
        return Suite(*self.checks, *checks)

    # Checks are always independent branches of one plan.
    add_parallel = add

    def findings(self, tables: PaymentTables) -> DataFrame:
        """The findings of all checks, lazily."""
        if not self.checks:
            schema = schemas.T.StructType(
                [*(schemas.T.StructField(c, schemas.T.StringType()) for c in tables.scope), *schemas.ISSUES.fields]
            )
            return tables.spark.createDataFrame([], schema)
        return union_all([check.findings(tables) for check in self.checks])

    def shared_findings(self, tables: PaymentTables) -> DataFrame:
        """The findings of all checks, what several of them need written first.

        Standard reconciliations are found together in one frame of blocks and messages beside their
        totals; of other checks that work on block totals, these are written for all.
        """
        if sum(check.reconciles for check in self.checks) < 2:
            return self.findings(tables)
        # Of a check that is there twice, the second finds by itself.
        measured = {(c.exact, c.measure): k for k, c in reversed(list(enumerate(self.checks))) if c.measure}
        rest = [c for k, c in enumerate(self.checks) if k not in measured.values()]
        # Plans first, so that a check that cannot build its own raises before anything runs.
        parts = [check.findings(tables) for check in rest if not check.reconciles]
        for exact in sorted({exact for exact, _ in measured}):
            measures = [measure for of, measure in measured if of == exact]
            parts.append(reconcile.frame_findings(reconcile.frame(tables, exact), measures))
        if any(check.reconciles for check in rest):
            shared = reconcile.share_totals(tables)
            parts += [check.findings(shared) for check in rest if check.reconciles]
        return union_all([part.select(*tables.scope, *schemas.ISSUES.names) for part in parts])

    def run(self, tables: PaymentTables, isolate: bool = True) -> Report:
        """Evaluate once and keep the findings in the shared folder.

        All checks run as one plan. If that fails, checks whose plan cannot be built become findings and the
        others run as one plan; if that fails too, each runs by itself, and one that fails becomes a finding
        while the others still report. Without ``isolate`` the failure is raised.
        """
        started = time.monotonic()
        try:
            found = write_once(self.shared_findings(tables), "findings")
        except Exception:
            if not isolate or not self.checks:
                raise
            found = self._isolated(tables)
        return Report(found, elapsed_ms=int((time.monotonic() - started) * 1000))


    def _isolated(self, tables: PaymentTables) -> DataFrame:
        """The findings of a run in which some check fails."""
        sound, failed = [], []
        for check in self.checks:
            try:
                check.findings(tables)
                sound.append(check)
            except Exception as error:  # whatever a check of the user's raises is a finding
                failed.append(_failure(check, error, tables))
        if failed and sound:
            try:
                return union_all([*failed, write_once(Suite(*sound).shared_findings(tables), "findings")])
            except Exception:  # a check fails while it runs
                pass
        return union_all([*failed, *(_guarded(check, tables) for check in sound)])


def _guarded(check: Check, tables: PaymentTables) -> DataFrame:
    try:
        return write_once(check.findings(tables), "findings")
    except Exception as error:
        return _failure(check, error, tables)


def _failure(check: Check, error: Exception, tables: PaymentTables) -> DataFrame:
    text = str(error).splitlines()[0] if str(error) else type(error).__name__
    row = {
        "validator": check.name,
        "severity": ERROR,
        "rule": "check_failed",
        "id": None,
        "message": "Validation failed with exception",
        "detail": text,
        "declared": None,
        "actual": None,
    }
    columns = [F.lit(None).cast("string").alias(c) for c in tables.scope]
    columns += [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schemas.ISSUES.fields]
    return tables.spark.range(1).select(*columns)


def message_check(exact: bool = False) -> Check:
    return Check(field_checks.MESSAGE_VALIDATOR, partial(field_checks.message_fields, exact=exact))


def remittance_check() -> Check:
    return Check(field_checks.REMITTANCE_VALIDATOR, field_checks.remittance_fields)


def transaction_check(exact: bool = False) -> Check:
    return Check(field_checks.TRANSACTION_VALIDATOR, partial(field_checks.transaction_fields, exact=exact))


def parallel_transaction_check(exact: bool = False) -> Check:
    """The transaction check under its second name."""
    build = partial(
        field_checks.transaction_fields, exact=exact, validator=PARALLEL_TRANSACTION_VALIDATOR
    )
    return Check(PARALLEL_TRANSACTION_VALIDATOR, build)


def row_check() -> Check:
    return Check(field_checks.ROW_VALIDATOR, field_checks.every_transaction)


def control_sum_check(exact: bool = False) -> Check:
    build = reconcile.control_sums_exact if exact else reconcile.control_sums
    return Check(reconcile.CONTROL_SUM_VALIDATOR, build, reconciles=True, measure=reconcile.SUMS, exact=exact)


def count_check(exact: bool = False) -> Check:
    build = reconcile.transaction_counts_exact if exact else reconcile.transaction_counts
    return Check(reconcile.COUNT_VALIDATOR, build, reconciles=True, measure=reconcile.COUNTS, exact=exact)


def standard_suite(semantics: str = "sql") -> Suite:
    """The five standard checks.

    ``sql`` compares sums as doubles, leaves childless blocks out of the sum check, ignores
    missing amounts and counts end-to-end ids. ``exact`` compares decimals, takes a missing
    actual as zero, flags missing amounts, counts rows, and lets the last of several
    declarations win.
    """
    if semantics not in ("sql", "exact"):
        raise ValueError(f"semantics must be 'sql' or 'exact', not {semantics!r}")
    exact = semantics == "exact"
    return Suite(
        message_check(exact),
        remittance_check(),
        transaction_check(exact),
        control_sum_check(exact),
        count_check(exact),
    )


def domain_suite() -> Suite:
    return Suite(
        Check(domain.MESSAGE_DOMAIN, domain.message_domain),
        Check(domain.REMITTANCE_DOMAIN, domain.remittance_domain),
        Check(domain.TRANSACTION_DOMAIN, domain.transaction_domain),
        Check(domain.CONTROL_SUM_DOMAIN, domain.domain_control_sums),
    )
