"""Checks of single rows: presence, format and sign of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions import scalars as S
from paytally.operators.issues import Rule, find
from paytally.tables import PaymentTables

MESSAGE_VALIDATOR = "MessageValidator"
REMITTANCE_VALIDATOR = "RemittanceValidator"
TRANSACTION_VALIDATOR = "TransactionValidator"
ROW_VALIDATOR = "StreamingTransactionIteratorValidator"

col = F.col


# ---- rules ---------------------------------------------------------------------------------


def message_id_too_long(exact: bool = False) -> Rule:
    size = S.utf16_length(col("msg_id")) if exact else F.length("msg_id")
    return Rule(
        "msg_id_too_long",
        size > S.MAX_MESSAGE_ID,
        col("msg_id"),
        "MsgId exceeds maximum length of 35 characters",
    )


def initiating_party_missing() -> Rule:
    return Rule(
        "initiating_party_missing",
        S.null_or_empty(col("msg_initg_pty_nm")),
        col("msg_id"),
        "WARN:Initiating party (InitgPty) is missing",
    )


def creation_time_missing() -> Rule:
    return Rule(
        "creation_time_missing",
        S.null_or_empty(col("msg_cre_dt_tm")),
        col("msg_id"),
        "Creation date/time (CreDtTm) is required but missing",
    )


def iban_format_invalid() -> Rule:
    return Rule(
        "iban_format_invalid",
        S.iban_format_bad(col("dbtr_acct_iban")),
        col("pmt_inf_id"),
        F.concat(F.lit("Invalid IBAN format: "), col("dbtr_acct_iban")),
        detail=col("dbtr_acct_iban"),
    )


def payment_method_missing() -> Rule:
    return Rule(
        "payment_method_missing",
        S.null_or_empty(col("pmt_mtd")),
        col("pmt_inf_id"),
        "Payment method is required",
    )


def payment_method_unknown() -> Rule:
    return Rule(
        "payment_method_unknown",
        S.payment_method_unknown(col("pmt_mtd")),
        col("pmt_inf_id"),
        "Payment method is not one of TRF, CHK",
        detail=col("pmt_mtd"),
    )


def amount_not_positive(exact: bool = False) -> Rule:
    return Rule(
        "amount_not_positive",
        S.amount_not_positive(col("instd_amt"), strict=exact),
        col("end_to_end_id"),
        F.concat(
            F.lit("Amount must be positive: PmtInfId="),
            S.shown(col("pmt_inf_id")),
            F.lit(", Amount="),
            S.shown(col("instd_amt")),
        ),
        actual=col("instd_amt"),
    )


def creditor_missing() -> Rule:
    return Rule(
        "creditor_missing",
        S.null_or_empty(col("cdtr_nm")),
        col("end_to_end_id"),
        F.concat(F.lit("Creditor name is required: PmtInfId="), S.shown(col("pmt_inf_id"))),
    )


# ---- checks: all rules of a table in one pass -----------------------------------------------


def message_fields(tables: PaymentTables, exact: bool = False) -> DataFrame:
    rules = [message_id_too_long(exact), initiating_party_missing(), creation_time_missing()]
    return find(tables.message, MESSAGE_VALIDATOR, rules, tables.scope)


def remittance_fields(tables: PaymentTables) -> DataFrame:
    rules = [iban_format_invalid(), payment_method_missing()]
    return find(tables.remittance, REMITTANCE_VALIDATOR, rules, tables.scope)


def transaction_fields(
    tables: PaymentTables, exact: bool = False, validator: str = TRANSACTION_VALIDATOR
) -> DataFrame:
    rules = [amount_not_positive(exact), creditor_missing()]
    return find(tables.transactions, validator, rules, tables.scope)


def payment_methods(tables: PaymentTables) -> DataFrame:
    """Opt-in: the payment method is one of the declared codes."""
    return find(tables.remittance, REMITTANCE_VALIDATOR, [payment_method_unknown()], tables.scope)


def every_transaction(tables: PaymentTables) -> DataFrame:
    """The row check of each transaction: an amount that is missing or not above zero."""
    rule = Rule(
        "amount_not_positive_strict",
        S.amount_not_positive(col("instd_amt"), strict=True),
        col("end_to_end_id"),
        "Transaction amount must be greater than 0",
        actual=col("instd_amt"),
    )
    return find(tables.transactions, ROW_VALIDATOR, [rule], tables.scope)


def every_transaction_counts(tables: PaymentTables) -> DataFrame:
    """Rows inspected and errors found by ``every_transaction``, in one scan."""
    bad = S.amount_not_positive(col("instd_amt"), strict=True)
    return tables.transactions.agg(
        F.count("*").alias("rows_inspected"), F.count_if(bad).alias("errors")
    )


def invalid_ibans(tables: PaymentTables) -> DataFrame:
    """The badly formatted debtor IBANs, value only, duplicates kept."""
    return tables.remittance.where(S.iban_format_bad(col("dbtr_acct_iban"))).select("dbtr_acct_iban")
