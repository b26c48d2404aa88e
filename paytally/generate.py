"""Synthetic payments: blocks of transactions with cyclic reference values.

The values of a row follow from its block and transaction index alone, so any number of rows
is made in parallel from ``spark.range`` or from the index pairs of another table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally import schemas
from paytally.tables import PaymentTables

col = F.col

# ---- fixed values: reference data of the generated documents -------------------------------
DEBTOR_IBANS = (
    "DE89370400440532013000", "FR7630006000011234567890189", "GB29NWBK60161331926819", "NL91ABNA0417164300",
)
DEBTOR_BICS = ("COBADEFFXXX", "BNPAFRPPXXX", "NWBKGB2LXXX", "ABNANL2AXXX")
CREDITOR_IBANS = (
    "IT60X0542811101000000123456", "ES9121000418450200051332", "AT611904300234573201", "BE68539007547034",
    "CH9300762011623852957", "PT50000201231234567890154",
)
CREDITOR_BICS = ("BPPIITRRXXX", "CABORKMRXXX", "BKAUATWWXXX", "BBRUBEBB010", "UBSWCHZH80A", "CGDIPTPLXXX")
CREDITOR_NAMES = (
    "Acme Corporation", "Global Industries Ltd", "Smith Trading Co", "EuroPayments GmbH", "Nordic Supplies AB",
    "Atlantic Services SA",
)
CREDITOR_COUNTRIES = ("IT", "ES", "AT", "BE", "CH", "PT")
REGULATORY_CODES = ("BENEFICIARY_RESIDENT", "RESIDENT", "NONRESIDENT", "REGLF001", "REGLF002")
CATEGORY_PURPOSES = ("SALA", "SUPP", "TAXS", "GDDS", "TRAD")
PURPOSES = ("GDDS", "SUPP", "SALA", "TAXS", "TRAD")
AMOUNT = "100.00"
WRONG_MESSAGE_SUM = "99999.99"
WRONG_BLOCK_SUM = "0.01"
MESSAGE_ID = "MSG-1767225600000"
CREATED = "2026-01-01T00:00:00"
EXECUTED = "2026-01-02"
INITIATING_PARTY = "Sample Initiating Party Corp"
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """One document: so many blocks of so many transactions, with right or wrong control sums."""

    blocks: int
    per_block: int
    wrong_sums: bool = False


# The documents of the tests and benchmarks, by their customary letters.
SPECS = {
    "A": Spec(1, 1_000_000),
    "B": Spec(2, 500_000),
    "C": Spec(1_000_000, 1),
    "D": Spec(2, 100),
    "E": Spec(2, 100, wrong_sums=True),
    "F": Spec(1, 2_000_000),
    "G": Spec(1, 4_000_000),
    "H": Spec(10, 200),
    "I": Spec(5, 400),
    "J": Spec(1, 1),
}


def _cycle(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*(col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def transactions(pairs: DataFrame) -> DataFrame:
    """One transaction per (block, tx) index pair; both count from zero."""
    b, t = col("block") + 1, col("tx") + 1
    name = _cycle(CREDITOR_NAMES, col("tx"))
    return _typed(
        pairs.select(
            F.format_string("PMT-%06d", b).alias("pmt_inf_id"),
            F.format_string("INSTR-%06d-%07d", b, t).alias("instr_id"),
            F.format_string("E2E-%06d-%07d", b, t).alias("end_to_end_id"),
            F.lit(AMOUNT).alias("instd_amt"),
            F.lit("EUR").alias("ccy"),
            _cycle(CREDITOR_BICS, col("tx")).alias("cdtr_agt_bicfi"),
            name.alias("cdtr_nm"),
            _cycle(CREDITOR_IBANS, col("tx")).alias("cdtr_acct_iban"),
            F.concat_ws(
                "\n",
                F.format_string("Invoice PMT%06d-TX%07d", b, t),
                F.concat(F.lit("Ref "), F.replace(name, F.lit(" "), F.lit("-")), F.lit("/"), t.cast("string")),
            ).alias("rmt_inf_ustrd"),
            F.concat_ws("\n", _cycle(REGULATORY_CODES, col("tx")), _cycle(REGULATORY_CODES, t)).alias("rglty_rptg_cd"),
            F.format_string("REF%06d%07d", b, t).alias("rmt_inf_strd_ref"),
            F.lit("SCOR").alias("rmt_inf_strd_ref_tp"),
            _cycle(PURPOSES, col("tx")).alias("purp_cd"),
            F.concat(F.lit("Ultimate "), name).alias("ultmt_cdtr_nm"),
            _cycle(CREDITOR_COUNTRIES, col("tx")).alias("cdtr_ctry"),
        ),
        schemas.TRANSACTIONS,
    )


def remittances(blocks: DataFrame, wrong_sums: bool = False) -> DataFrame:
    """One payment block per (block, txs) row: its index and its number of transactions."""
    b = col("block") + 1
    total = F.lit(WRONG_BLOCK_SUM) if wrong_sums else F.lit(AMOUNT).cast("decimal(18,2)") * col("txs")
    return _typed(
        blocks.select(
            F.lit(MESSAGE_ID).alias("msg_id"),
            F.format_string("PMT-%06d", b).alias("pmt_inf_id"),
            F.lit("TRF").alias("pmt_mtd"),
            col("txs").alias("nb_of_txs"),
            total.alias("ctrl_sum"),
            F.lit("SEPA").alias("svc_lvl_cd"),
            F.lit(EXECUTED).alias("reqd_exctn_dt"),
            F.concat(F.lit("Debtor Company "), b.cast("string")).alias("dbtr_nm"),
            _cycle(DEBTOR_IBANS, col("block")).alias("dbtr_acct_iban"),
            _cycle(DEBTOR_BICS, col("block")).alias("dbtr_agt_bicfi"),
            F.lit("false").alias("btch_bookg"),
            F.when(F.pmod(col("block"), F.lit(3)) == 0, F.lit("HIGH")).otherwise(F.lit("NORM")).alias("instr_prty"),
            F.lit("CORE").alias("lcl_instrm_cd"),
            _cycle(CATEGORY_PURPOSES, col("block")).alias("ctgy_purp_cd"),
            F.lit("SLEV").alias("chrg_br"),
            F.concat(F.lit("Ultimate Debtor "), b.cast("string")).alias("ultmt_dbtr_nm"),
        ),
        schemas.REMITTANCE,
    )


def message(totals: DataFrame, wrong_sums: bool = False) -> DataFrame:
    """The header over a one-row frame with ``txs``, the number of transactions."""
    total = F.lit(WRONG_MESSAGE_SUM) if wrong_sums else F.lit(AMOUNT).cast("decimal(18,2)") * col("txs")
    return _typed(
        totals.select(
            F.lit(MESSAGE_ID).alias("msg_id"),
            F.lit(CREATED).alias("msg_cre_dt_tm"),
            col("txs").alias("msg_nb_of_txs"),
            total.alias("msg_ctrl_sum"),
            F.lit(INITIATING_PARTY).alias("msg_initg_pty_nm"),
        ),
        schemas.MESSAGE,
    )


def from_pairs(pairs: DataFrame, wrong_sums: bool = False) -> PaymentTables:
    """The three tables over (block, tx) index pairs."""
    blocks = pairs.groupBy("block").agg(F.count("*").alias("txs"))
    totals = pairs.agg(F.count("*").alias("txs"))
    return PaymentTables(message(totals, wrong_sums), remittances(blocks, wrong_sums), transactions(pairs))


def from_spec(spark: SparkSession, spec: Spec) -> PaymentTables:
    pairs = spark.range(spec.blocks * spec.per_block).select(
        F.floor(col("id") / spec.per_block).alias("block"), (col("id") % spec.per_block).alias("tx")
    )
    blocks = spark.range(spec.blocks).select(col("id").alias("block"), F.lit(spec.per_block).alias("txs"))
    totals = spark.range(1).select(F.lit(spec.blocks * spec.per_block).alias("txs"))
    return PaymentTables(
        message(totals, spec.wrong_sums), remittances(blocks, spec.wrong_sums), transactions(pairs)
    )
