"""Declared against actual: control sums and transaction counts.

Transactions are reduced to one row per payment block before any join, so that a block with
a third of all transactions costs each map task one row. The SQL form of the checks joins
first and lets duplicated keys fan out; here equal declarations are counted as ``copies``
and the actual value is multiplied, which gives the same sums without the fan-out.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions import scalars as S
from paytally.operators.issues import Rule, find, union_all
from paytally.storage import write_once
from paytally.tables import PaymentTables

CONTROL_SUM_VALIDATOR = "ControlSumValidator"
COUNT_VALIDATOR = "NumberOfTransactionsValidator"

col = F.col


def block_totals(tables: PaymentTables) -> DataFrame:
    """Per payment block: sum of amounts, counted ids, rows."""
    if tables.totals is not None:
        return tables.totals
    return (
        tables.transactions.where(col("pmt_inf_id").isNotNull())
        .groupBy(*tables.keys("pmt_inf_id"))
        .agg(
            F.sum("instd_amt").alias("amount"),
            F.count("end_to_end_id").alias("ids"),
            F.count("*").alias("rows"),
        )
    )


def share_totals(tables: PaymentTables) -> PaymentTables:
    """The same tables with their block totals written to the shared folder.

    For reconciliations that are not part of a ``Frame``: each needs other columns of the totals, so Spark
    would scan and shuffle the transactions once for each.
    """
    return replace(tables, totals=write_once(block_totals(tables), "totals"))


def splittable(totals: DataFrame, key: str = "pmt_inf_id") -> DataFrame:
    """Totals for a join whose other side may hold very many rows of one key.

    AQE splits a skewed join only where both sides are shuffled for it. Totals would join
    straight from the partitioning their aggregation left, so the key is computed anew, which
    makes Spark shuffle the totals (one narrow row per key) once more. The keys of totals are never
    NULL, and the new key cannot be: a join then has no test of its own to push below the aggregation, which
    so stays equal to others of the same rows, and Spark shuffles these once.
    """
    return totals.withColumn(key, F.coalesce(F.concat(col(key), F.lit("")), F.lit("")))


def _declared_with_totals(declared: DataFrame, tables: PaymentTables, how: str) -> DataFrame:
    totals = tables.totals if tables.totals is not None else splittable(block_totals(tables))
    return declared.join(totals, tables.keys("pmt_inf_id"), how)


def _times(value: Column, copies: Column) -> Column:
    return (value * copies).cast(schemas.TOTAL)


def _message_totals(tables: PaymentTables) -> DataFrame:
    """Block totals carried up to the message, in the SQL form (duplicated blocks count again)."""
    blocks = (
        tables.remittance.where(col("pmt_inf_id").isNotNull() & col("msg_id").isNotNull())
        .groupBy(*tables.keys("msg_id", "pmt_inf_id"))
        .agg(F.count("*").alias("copies"))
    )
    return (
        _declared_with_totals(blocks, tables, "inner")
        .groupBy(*tables.keys("msg_id"))
        .agg(
            F.sum(_times(col("amount"), col("copies"))).alias("amount"),
            F.sum(col("ids") * col("copies")).alias("ids"),
        )
    )


def _sum_rule(level: str, id: str, declared: Column, actual: Column, exact: bool) -> Rule:
    text = F.concat(
        F.lit(f"{level} CtrlSum mismatch: declared="), S.double_text(declared), F.lit(", actual="), S.double_text(actual)
    )
    differ = S.sums_differ(declared, actual, exact)
    return Rule(f"ctrl_sum_{level.lower()}", differ, col(id), text, None, declared, actual, CONTROL_SUM_VALIDATOR)


def _count_rule(level: str, id: str, declared: Column, actual: Column) -> Rule:
    text = F.concat(F.lit(f"{level} NbOfTxs mismatch: declared="), S.shown(declared), F.lit(", actual="), S.shown(actual))
    return Rule(f"nb_txs_{level.lower()}", declared != actual, col(id), text, None, declared, actual, COUNT_VALIDATOR)


def _sum_findings(compared: DataFrame, tables: PaymentTables, level: str, id: str, exact: bool) -> DataFrame:
    rule = _sum_rule(level, id, col("declared"), col("actual"), exact)
    return find(compared, CONTROL_SUM_VALIDATOR, [rule], tables.scope)


def _count_findings(compared: DataFrame, tables: PaymentTables, level: str, id: str) -> DataFrame:
    rule = _count_rule(level, id, col("declared"), col("actual"))
    return find(compared, COUNT_VALIDATOR, [rule], tables.scope)


# ---- SQL form ------------------------------------------------------------------------------


def control_sum_remittance(tables: PaymentTables) -> DataFrame:
    """Blocks whose declared sum differs from their transactions; childless blocks are left out."""
    declared = (
        tables.remittance.where(col("ctrl_sum").isNotNull() & col("pmt_inf_id").isNotNull())
        .groupBy(*tables.keys("pmt_inf_id", "ctrl_sum"))
        .agg(F.count("*").alias("copies"))
    )
    compared = _declared_with_totals(declared, tables, "inner").select(
        *tables.keys("pmt_inf_id"),
        col("ctrl_sum").alias("declared"),
        _times(col("amount"), col("copies")).alias("actual"),
    )
    return _sum_findings(compared, tables, "Remittance", "pmt_inf_id", exact=False)


def control_sum_message(tables: PaymentTables, totals: DataFrame | None = None) -> DataFrame:
    declared = (
        tables.message.where(col("msg_ctrl_sum").isNotNull() & col("msg_id").isNotNull())
        .groupBy(*tables.keys("msg_id", "msg_ctrl_sum"))
        .agg(F.count("*").alias("copies"))
    )
    totals = _message_totals(tables) if totals is None else totals
    compared = declared.join(totals, tables.keys("msg_id")).select(
        *tables.keys("msg_id"),
        col("msg_ctrl_sum").alias("declared"),
        _times(col("amount"), col("copies")).alias("actual"),
    )
    return _sum_findings(compared, tables, "Message", "msg_id", exact=False)


def count_remittance(tables: PaymentTables) -> DataFrame:
    """Blocks whose declared count differs from their transactions with an end-to-end id."""
    declared = (
        tables.remittance.where(col("nb_of_txs").isNotNull())
        .groupBy(*tables.keys("pmt_inf_id", "nb_of_txs"))
        .agg(F.count("*").alias("copies"))
    )
    compared = _declared_with_totals(declared, tables, "left").select(
        *tables.keys("pmt_inf_id"),
        S.count_sql(col("nb_of_txs")).alias("declared"),
        (F.coalesce(col("ids"), F.lit(0)) * col("copies")).alias("actual"),
    )
    return _count_findings(compared, tables, "Remittance", "pmt_inf_id")


def count_message(tables: PaymentTables, totals: DataFrame | None = None) -> DataFrame:
    declared = (
        tables.message.where(col("msg_nb_of_txs").isNotNull())
        .groupBy(*tables.keys("msg_id", "msg_nb_of_txs"))
        .agg(F.count("*").alias("copies"))
    )
    totals = _message_totals(tables) if totals is None else totals
    compared = declared.join(totals, tables.keys("msg_id"), "left").select(
        *tables.keys("msg_id"),
        S.count_sql(col("msg_nb_of_txs")).alias("declared"),
        (F.coalesce(col("ids"), F.lit(0)) * col("copies")).alias("actual"),
    )
    return _count_findings(compared, tables, "Message", "msg_id")


def control_sums(tables: PaymentTables) -> DataFrame:
    return union_all([control_sum_remittance(tables), control_sum_message(tables)])


def _unreadable_counts(tables: PaymentTables) -> DataFrame:
    """Per scope, how many declared counts no SQL cast can read; scopes without any are absent."""
    parts = [
        df.where(S.count_sql_bad(col(name))).select(*tables.scope, F.lit(1).alias("one"))
        for df, name in ((tables.remittance, "nb_of_txs"), (tables.message, "msg_nb_of_txs"))
    ]
    return union_all(parts).groupBy(*tables.scope).agg(F.count("one").alias("unreadable"))


def _failed_counts(unreadable: DataFrame, tables: PaymentTables) -> DataFrame:
    failed = Rule(
        "nb_txs_unreadable",
        col("unreadable") > 0,
        F.lit(None),
        "SQL validation failed",
        detail=F.concat(col("unreadable").cast("string"), F.lit(" declared counts are not numbers")),
    )
    return find(unreadable, COUNT_VALIDATOR, [failed], tables.scope)


def _unless_unreadable(counted: DataFrame, unreadable: DataFrame, tables: PaymentTables) -> DataFrame:
    """Findings of count checks, but where a declared count of the scope is no number."""
    if tables.scope:
        return counted.join(unreadable.select(*tables.scope), list(tables.scope), "left_anti")
    return counted.where(unreadable.select("unreadable").scalar() == 0)


def transaction_counts(tables: PaymentTables) -> DataFrame:
    """Both count checks. An unreadable declared count fails the check of its scope as a whole:
    its findings give way to a single one that says so."""
    counted = union_all([count_remittance(tables), count_message(tables)])
    unreadable = _unreadable_counts(tables)
    return union_all([_unless_unreadable(counted, unreadable, tables), _failed_counts(unreadable, tables)])


# ---- exact form ----------------------------------------------------------------------------


def _order(tables: PaymentTables, df: DataFrame) -> Column:
    """What orders declarations: their place in the documents, files by name; else the row order of the scan."""
    if not tables.located:
        return F.monotonically_increasing_id()
    return F.struct(*(c for c in ("source_file",) if c in df.columns), "position")


def _latest(df: DataFrame, key: list[str], values: dict[str, Column], order: Column) -> DataFrame:
    """Per key, the last non-NULL value of each column in that order."""
    placed = df.where(col(key[-1]).isNotNull()).select(
        *key,
        *(value.alias(name) for name, value in values.items()),
        order.alias("_place"),
    )
    picks = [
        F.max_by(col(name), F.when(col(name).isNotNull(), col("_place"))).alias(name)
        for name in values
    ]
    return placed.groupBy(*key).agg(*picks)


def declared_by_messages(tables: PaymentTables) -> DataFrame:
    """What each message declares: of several declarations the last in document order, for each field."""
    values = {"ctrl_sum": col("msg_ctrl_sum"), "nb_of_txs": S.count_exact(col("msg_nb_of_txs"))}
    return _latest(tables.message, tables.keys("msg_id"), values, _order(tables, tables.message))


def declared_by_blocks(tables: PaymentTables) -> DataFrame:
    """What each block declares, and the message it belongs to; the last declaration counts, for each field."""
    values = {"parent_id": col("msg_id"), "ctrl_sum": col("ctrl_sum"), "nb_of_txs": S.count_exact(col("nb_of_txs"))}
    return _latest(tables.remittance, tables.keys("pmt_inf_id"), values, _order(tables, tables.remittance))


def _exact_message_totals(tables: PaymentTables, blocks: DataFrame) -> DataFrame:
    """Two-level roll-up: the per-block totals again, summed to the block's last known message."""
    return (
        blocks.where(col("parent_id").isNotNull())
        .select(*tables.keys("pmt_inf_id"), col("parent_id").alias("msg_id"))
        .join(block_totals(tables), tables.keys("pmt_inf_id"))
        .groupBy(*tables.keys("msg_id"))
        .agg(F.sum("amount").alias("amount"), F.sum("rows").alias("rows"))
    )


def _exact_compare(declared: DataFrame, value: str, totals: DataFrame, key: list[str], actual: str) -> DataFrame:
    return (
        declared.where(col(value).isNotNull())
        .select(*key, col(value).alias("declared"))
        .join(totals, key, "left")
        .select(*key, "declared", F.coalesce(col(actual), F.lit(0)).alias("actual"))
    )


def control_sum_remittance_exact(tables: PaymentTables) -> DataFrame:
    """Decimal comparison; a block without transactions counts as zero and is reported."""
    compared = _exact_compare(declared_by_blocks(tables), "ctrl_sum", block_totals(tables), tables.keys("pmt_inf_id"), "amount")
    return _sum_findings(compared, tables, "Remittance", "pmt_inf_id", exact=True)


def control_sum_message_exact(tables: PaymentTables, totals: DataFrame | None = None) -> DataFrame:
    totals = _exact_message_totals(tables, declared_by_blocks(tables)) if totals is None else totals
    compared = _exact_compare(declared_by_messages(tables), "ctrl_sum", totals, tables.keys("msg_id"), "amount")
    return _sum_findings(compared, tables, "Message", "msg_id", exact=True)


def count_remittance_exact(tables: PaymentTables) -> DataFrame:
    """Counts every row of a block; declared counts that are no integers are skipped."""
    compared = _exact_compare(declared_by_blocks(tables), "nb_of_txs", block_totals(tables), tables.keys("pmt_inf_id"), "rows")
    return _count_findings(compared, tables, "Remittance", "pmt_inf_id")


def count_message_exact(tables: PaymentTables, totals: DataFrame | None = None) -> DataFrame:
    totals = _exact_message_totals(tables, declared_by_blocks(tables)) if totals is None else totals
    compared = _exact_compare(declared_by_messages(tables), "nb_of_txs", totals, tables.keys("msg_id"), "rows")
    return _count_findings(compared, tables, "Message", "msg_id")


def control_sums_exact(tables: PaymentTables) -> DataFrame:
    return union_all([control_sum_remittance_exact(tables), control_sum_message_exact(tables)])


def transaction_counts_exact(tables: PaymentTables) -> DataFrame:
    return union_all([count_remittance_exact(tables), count_message_exact(tables)])


# ---- all measures in one pass ----------------------------------------------------------------

SUMS, COUNTS = "sums", "counts"


@dataclass(frozen=True)
class Frame:
    """Every block and message beside what its transactions add up to, written once for all checks.

    ``same`` is how many headers share a row's id. Rows whose id stands alone are compared as they are; only
    the others, if ``repeated_blocks`` or ``repeated_messages`` tells that there are any, go through the
    grouping that the checks above do. ``unreadable`` tells whether any declared count is no number.
    """

    tables: PaymentTables
    blocks: DataFrame
    messages: DataFrame
    exact: bool
    repeated_blocks: bool
    repeated_messages: bool
    unreadable: bool


def _beside_totals(headers: DataFrame, parts: DataFrame, key: list[str], kept: list[Column]) -> DataFrame:
    """Header rows beside the sums of ``parts`` (key, amount, ids, rows) and the number of headers of their id.

    Parts and headers are reduced together, so that one shuffle gives both.
    """
    id = key[-1]
    nothing = F.lit(0).cast("long")
    none = F.lit(None).cast(parts.schema["amount"].dataType)
    both = parts.select(*key, "amount", "ids", "rows", nothing.alias("same")).unionAll(
        headers.where(col(id).isNotNull()).select(*key, none, nothing, nothing, F.lit(1).cast("long"))
    )
    totals = both.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("amount", "ids", "rows", "same")))
    return headers.select(*key, *kept).join(splittable(totals.where("same > 0"), id), key, "left")


def _alone() -> Column:
    """Whether a header's id is its own; null ids are grouped like repeated ones."""
    return F.coalesce(col("same") == 1, F.lit(False))


def frame(tables: PaymentTables, exact: bool = False) -> Frame:
    """Write the blocks and messages of ``tables`` beside their totals.

    What has to be known of them to choose a plan is observed while they are written.
    """
    # The order of declarations only matters to the exact form.
    order, message_order = ([_order(tables, df).alias("position")] if exact else [] for df in (tables.remittance, tables.message))
    unreadable = F.coalesce(S.count_sql_bad(col("nb_of_txs")), F.lit(False))
    transactions = tables.transactions.where(col("pmt_inf_id").isNotNull()).select(
        *tables.keys("pmt_inf_id"), col("instd_amt").alias("amount"), col("end_to_end_id").isNotNull().cast("long").alias("ids"), F.lit(1).cast("long").alias("rows")
    )
    blocks, seen = _observed(
        _beside_totals(tables.remittance, transactions, tables.keys("pmt_inf_id"), [col("msg_id"), col("ctrl_sum"), col("nb_of_txs"), *order]), unreadable
    )
    repeated = blocks.where(~_alone()) if seen["repeated"] else None
    if repeated is not None and exact:
        rest = replace(tables, remittance=repeated, totals=None, located=True)
        latest = declared_by_blocks(rest).select(*tables.keys("pmt_inf_id"), col("parent_id").alias("msg_id"))
        sums = repeated.groupBy(*tables.keys("pmt_inf_id")).agg(*(F.max(c).alias(c) for c in ("amount", "ids", "rows")))
        of = ("msg_id", "amount", "ids", "rows")
        children = blocks.where(_alone()).select(*tables.scope, *of).unionAll(latest.join(sums, tables.keys("pmt_inf_id")).select(*tables.scope, *of))
    else:
        children = blocks
    children = children.where(col("msg_id").isNotNull() & (col("rows") > 0)).select(*tables.keys("msg_id"), "amount", "ids", "rows")
    headers = tables.message.withColumnsRenamed({"msg_ctrl_sum": "ctrl_sum", "msg_nb_of_txs": "nb_of_txs"})
    messages, seen_messages = _observed(
        _beside_totals(headers, children, tables.keys("msg_id"), [col("ctrl_sum"), col("nb_of_txs"), *message_order]), unreadable
    )
    return Frame(
        tables, blocks, messages, exact, bool(seen["repeated"]), bool(seen_messages["repeated"]), bool(seen["unreadable"] or seen_messages["unreadable"])
    )


def _observed(df: DataFrame, unreadable: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    watched = df.observe(seen, F.count_if(~_alone()).alias("repeated"), F.count_if(unreadable).alias("unreadable"))
    return write_once(watched, "frame"), seen.get


def _frame_rules(level: str, id: str, measures: Collection[str], exact: bool) -> list[Rule]:
    known = col(id).isNotNull()
    amount = F.coalesce(col("amount").cast(schemas.TOTAL), F.lit(0).cast(schemas.TOTAL)) if exact else F.when(col("rows") > 0, col("amount"))
    declared = S.count_exact(col("nb_of_txs")) if exact else S.count_sql(col("nb_of_txs"))
    actual = F.coalesce("rows" if exact else "ids", F.lit(0).cast("long"))
    rules = {
        SUMS: _sum_rule(level, id, F.when(known, col("ctrl_sum")), amount, exact),
        COUNTS: _count_rule(level, id, declared, actual),
    }
    return [rule for measure, rule in rules.items() if measure in measures]


def frame_findings(of: Frame, measures: Collection[str]) -> DataFrame:
    """What the checks of ``measures`` find in a frame: its rows once, all measures at the same time."""
    tables, exact = of.tables, of.exact
    parts = [
        find(of.blocks.where(_alone()), CONTROL_SUM_VALIDATOR, _frame_rules("Remittance", "pmt_inf_id", measures, exact), tables.scope),
        find(of.messages.where(_alone()), CONTROL_SUM_VALIDATOR, _frame_rules("Message", "msg_id", measures, exact), tables.scope),
    ]
    if of.repeated_blocks:
        rest = of.blocks.where(~_alone())
        sums = rest.where(col("pmt_inf_id").isNotNull() & (col("rows") > 0)).groupBy(*tables.keys("pmt_inf_id"))
        again = replace(tables, remittance=rest, located=True, totals=sums.agg(*(F.max(c).alias(c) for c in ("amount", "ids", "rows"))))
        checks = {SUMS: control_sum_remittance_exact, COUNTS: count_remittance_exact} if exact else {SUMS: control_sum_remittance, COUNTS: count_remittance}
        parts += [check(again) for measure, check in checks.items() if measure in measures]
    if of.repeated_messages:
        rest = of.messages.where(~_alone())
        sums = rest.where(col("msg_id").isNotNull() & (col("rows") > 0)).groupBy(*tables.keys("msg_id"))
        totals = sums.agg(*(F.max(c).alias(c) for c in ("amount", "ids", "rows")))
        named = rest.select(*tables.keys("msg_id"), col("ctrl_sum").alias("msg_ctrl_sum"), col("nb_of_txs").alias("msg_nb_of_txs"), *(["position"] if exact else []))
        again = replace(tables, message=named, located=True)
        checks = {SUMS: control_sum_message_exact, COUNTS: count_message_exact} if exact else {SUMS: control_sum_message, COUNTS: count_message}
        parts += [check(again, totals) for measure, check in checks.items() if measure in measures]
    found = union_all(parts)
    if exact or COUNTS not in measures or not of.unreadable:
        return found
    headers = replace(tables, remittance=of.blocks, message=of.messages.withColumnRenamed("nb_of_txs", "msg_nb_of_txs"))
    unreadable = _unreadable_counts(headers)
    is_count = col("validator") == COUNT_VALIDATOR
    return union_all(
        [found.where(~is_count), _unless_unreadable(found.where(is_count), unreadable, tables), _failed_counts(unreadable, tables)]
    )
