"""Domain rules: checksums, codes and dates, walked from message to block to transaction.

Children count only under an existing parent, once per parent row. Rows are tested first and
only the findings travel to the joins, so a clean table is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions import scalars as S
from paytally.operators.issues import Rule, find, union_all
from paytally.operators.reconcile import splittable
from paytally.tables import PaymentTables

MESSAGE_DOMAIN = "MessageDomainValidator"
REMITTANCE_DOMAIN = "RemittanceDomainValidator"
TRANSACTION_DOMAIN = "TransactionDomainValidator"
CONTROL_SUM_DOMAIN = "ControlSumDomainService"

col = F.col


def message_domain(tables: PaymentTables) -> DataFrame:
    id, party, created = col("msg_id"), col("msg_initg_pty_nm"), col("msg_cre_dt_tm")
    blank_id = S.null_or_blank(id)
    blank_time = S.null_or_blank(created)
    rules = [
        Rule("msg_id_blank", blank_id, id, "messageId must not be blank"),
        Rule(
            "msg_id_too_long",
            ~blank_id & (S.utf16_length(id) > S.MAX_MESSAGE_ID),
            id,
            "messageId exceeds max length 35",
        ),
        Rule("initiating_party_blank", S.null_or_blank(party), id, "initiatingParty must not be blank"),
        Rule("creation_time_blank", blank_time, id, "creationDateTime must not be blank"),
        Rule(
            "creation_time_invalid",
            ~blank_time & ~S.offset_date_time_valid(created),
            id,
            "creationDateTime is not a valid ISO 8601 offset datetime",
            detail=created,
        ),
    ]
    return find(tables.message, MESSAGE_DOMAIN, rules, tables.scope)


def _under_message(findings: DataFrame, tables: PaymentTables) -> DataFrame:
    """Findings whose message exists, once per message row."""
    parents = tables.message.select(*tables.keys("msg_id")).where(col("msg_id").isNotNull())
    return findings.join(parents, tables.keys("msg_id")).drop("msg_id")


def remittance_domain(tables: PaymentTables) -> DataFrame:
    id = col("pmt_inf_id")
    rules = [
        Rule(
            "debtor_iban_invalid",
            ~S.iban_valid(col("dbtr_acct_iban")),
            id,
            "Invalid debtor IBAN",
            detail=col("dbtr_acct_iban"),
        ),
        Rule(
            "debtor_bic_invalid",
            ~S.bic_valid(col("dbtr_agt_bicfi")),
            id,
            "Invalid debtor agent BIC",
            detail=col("dbtr_agt_bicfi"),
        ),
        Rule(
            "execution_date_missing",
            col("reqd_exctn_dt").isNull(),
            id,
            "requestedExecutionDate must not be null",
        ),
    ]
    return _under_message(find(tables.remittance, REMITTANCE_DOMAIN, rules, tables.keys("msg_id")), tables)


def transaction_domain(tables: PaymentTables) -> DataFrame:
    id, amount, ccy = col("end_to_end_id"), col("instd_amt"), col("ccy")
    good_currency = S.currency_valid(ccy)
    rules = [
        Rule("currency_invalid", ~good_currency, id, "Invalid currency code", detail=ccy),
        Rule(
            "amount_invalid",
            good_currency & ~S.amount_valid(amount),
            id,
            "Instructed amount must be > 0",
            actual=amount,
        ),
        Rule(
            "creditor_bic_invalid",
            ~S.bic_valid(col("cdtr_agt_bicfi")),
            id,
            "Invalid creditor agent BIC",
            detail=col("cdtr_agt_bicfi"),
        ),
        Rule(
            "creditor_iban_invalid",
            ~S.iban_valid(col("cdtr_acct_iban")),
            id,
            "Invalid creditor IBAN",
            detail=col("cdtr_acct_iban"),
        ),
        Rule("creditor_blank", S.null_or_blank(col("cdtr_nm")), id, "Creditor name must not be blank"),
    ]
    findings = find(tables.transactions, TRANSACTION_DOMAIN, rules, tables.keys("pmt_inf_id"))
    blocks = tables.remittance.select(*tables.keys("msg_id", "pmt_inf_id")).where(
        col("pmt_inf_id").isNotNull()
    )
    parents = _under_message(blocks, tables)
    return findings.join(parents, tables.keys("pmt_inf_id")).drop("pmt_inf_id")


def _mismatch_text(level: str) -> Column:
    return F.concat(
        F.lit(f"{level} control sum mismatch: declared="),
        S.shown(F.round(col("declared"), 2)),
        F.lit(" computed="),
        S.shown(col("actual")),
    )


def _sum_rules(level: str, id: Column) -> list[Rule]:
    good = S.control_sum_valid(col("declared"))
    return [
        Rule(
            f"ctrl_sum_{level}_invalid",
            ~good,
            id,
            f"Invalid {level} control sum",
            declared=col("declared"),
        ),
        Rule(
            f"ctrl_sum_{level}_mismatch",
            good & ~S.control_sums_match(col("declared"), col("actual")),
            id,
            _mismatch_text(level.capitalize()),
            declared=col("declared"),
            actual=col("actual"),
        ),
    ]


def domain_control_sums(tables: PaymentTables) -> DataFrame:
    """Sums of valid amounts only. A block with an invalid declaration adds nothing to its
    message; under a message with an invalid declaration no block is looked at."""
    valid = S.currency_valid(col("ccy")) & S.amount_valid(col("instd_amt"))
    totals = (
        tables.transactions.where(valid & col("pmt_inf_id").isNotNull())
        .groupBy(*tables.keys("pmt_inf_id"))
        .agg(F.sum("instd_amt").alias("amount"))
    )
    blocks = (
        tables.remittance.where(col("msg_id").isNotNull())
        .select(*tables.keys("msg_id", "pmt_inf_id"), col("ctrl_sum").alias("declared"))
        .join(splittable(totals), tables.keys("pmt_inf_id"), "left")
        .withColumn("actual", F.coalesce(col("amount"), F.lit(0)).cast(schemas.TOTAL))
    )
    message_totals = (
        blocks.where(S.control_sum_valid(col("declared")))
        .groupBy(*tables.keys("msg_id"))
        .agg(F.sum("actual").cast(schemas.TOTAL).alias("amount"))
    )
    messages = tables.message.select(*tables.keys("msg_id"), col("msg_ctrl_sum").alias("declared"))
    walked = messages.where(S.control_sum_valid(col("declared"))).select(*tables.keys("msg_id"))
    # Only blocks with a finding go on to the join with their messages.
    on_blocks = (
        find(blocks, CONTROL_SUM_DOMAIN, _sum_rules("remittance", col("pmt_inf_id")), tables.keys("msg_id"))
        .join(walked, tables.keys("msg_id"))
        .drop("msg_id")
    )
    compared = messages.join(message_totals, tables.keys("msg_id"), "left").withColumn(
        "actual", F.coalesce(col("amount"), F.lit(0)).cast(schemas.TOTAL)
    )
    on_messages = find(compared, CONTROL_SUM_DOMAIN, _sum_rules("message", col("msg_id")), tables.scope)
    return union_all([on_blocks, on_messages])
