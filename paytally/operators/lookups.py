"""Row lookups and small aggregates over one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions import scalars as S
from paytally.tables import PaymentTables

ZERO = "decimal(38,5)"


def _within(df: DataFrame, key: str, value: str, scope: dict[str, str]) -> DataFrame:
    for name, of in {key: value, **scope}.items():
        df = df.where(F.col(name) == F.lit(of))
    return df


def remittances_of(tables: PaymentTables, msg_id: str, **scope: str) -> DataFrame:
    """The blocks of a message. ``scope`` (say ``source_file=...``) keeps to one document."""
    return _within(tables.remittance, "msg_id", msg_id, scope)


def transactions_of(tables: PaymentTables, pmt_inf_id: str, **scope: str) -> DataFrame:
    """The transactions of a block. ``scope`` keeps to one document."""
    return _within(tables.transactions, "pmt_inf_id", pmt_inf_id, scope)


def sum_of_remittance(tables: PaymentTables, pmt_inf_id: str, **scope: str) -> DataFrame:
    """One row, zero when the block has no transactions.

    Blocks of several documents are never added up: for scope columns of the tables that
    ``scope`` does not fix there is one row for each document that has the block.
    """
    found = transactions_of(tables, pmt_inf_id, **scope)
    total = F.coalesce(F.sum("instd_amt"), F.lit(0)).cast(ZERO).alias("total")
    left = [c for c in tables.scope if c not in scope]
    return found.groupBy(*left).agg(total) if left else found.agg(total)


def total_amount(tables: PaymentTables) -> DataFrame:
    return tables.transactions.agg(
        F.coalesce(F.sum("instd_amt"), F.lit(0)).cast(ZERO).alias("total")
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def message_summary(tables: PaymentTables) -> DataFrame:
    """One line on the first message by id; a single empty line when there is none."""
    parts = [
        F.concat(F.lit(f"{label}="), S.shown(F.col(name)))
        for label, name in (
            ("msg_id", "msg_id"),
            ("cre_dt_tm", "msg_cre_dt_tm"),
            ("nb_of_txs", "msg_nb_of_txs"),
            ("ctrl_sum", "msg_ctrl_sum"),
            ("initg_pty_nm", "msg_initg_pty_nm"),
        )
    ]
    # min_by rather than a sort: each task keeps one row.
    line = F.min_by(F.concat_ws(", ", *parts), F.struct("msg_id", "msg_cre_dt_tm", "msg_nb_of_txs"))
    return tables.message.agg(F.coalesce(line, F.lit("")).alias("summary"))


def amount_by_currency(tables: PaymentTables) -> DataFrame:
    """Sum and count of valid amounts per block and currency; currencies are never mixed."""
    valid = S.currency_valid(F.col("ccy")) & S.amount_valid(F.col("instd_amt"))
    return (
        tables.transactions.where(valid)
        .groupBy(*tables.keys("pmt_inf_id", "ccy"))
        .agg(F.sum("instd_amt").cast(ZERO).alias("total"), F.count("*").alias("n"))
    )


def mixed_currency_blocks(tables: PaymentTables) -> DataFrame:
    """Blocks whose valid amounts cannot be added up because their currencies differ.

    Smallest and largest code are enough to tell, and combine before the shuffle, which a
    distinct count would not.
    """
    valid = S.currency_valid(F.col("ccy")) & S.amount_valid(F.col("instd_amt"))
    return (
        tables.transactions.where(valid)
        .groupBy(*tables.keys("pmt_inf_id"))
        .agg(F.min("ccy").alias("first_ccy"), F.max("ccy").alias("last_ccy"))
        .where(F.col("first_ccy") != F.col("last_ccy"))
    )
