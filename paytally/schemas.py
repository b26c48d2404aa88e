"""The three fixed table schemas.

Every field is nullable: a Spark non-null flag is a promise to the optimizer, and neither
the documents nor the stored tables enforce one. Whether the payment standard requires the
field is kept in the column metadata as ``required``.
"""

from __future__ import annotations

from pyspark.sql import types as T

CONTROL_SUM = T.DecimalType(18, 2)
AMOUNT = T.DecimalType(18, 5)
TOTAL = T.DecimalType(38, 5)


def _field(name: str, kind: T.DataType, required: bool) -> T.StructField:
    return T.StructField(name, kind, True, {"required": required})


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([_field(*f) for f in fields])


_TEXT = T.StringType()

MESSAGE = _schema(
    ("msg_id", _TEXT, True),
    ("msg_cre_dt_tm", _TEXT, True),
    ("msg_nb_of_txs", _TEXT, True),
    ("msg_ctrl_sum", CONTROL_SUM, True),
    ("msg_initg_pty_nm", _TEXT, True),
)

REMITTANCE = _schema(
    ("msg_id", _TEXT, True),
    ("pmt_inf_id", _TEXT, True),
    ("pmt_mtd", _TEXT, True),
    ("nb_of_txs", _TEXT, True),
    ("ctrl_sum", CONTROL_SUM, False),
    ("svc_lvl_cd", _TEXT, False),
    ("reqd_exctn_dt", T.DateType(), True),
    ("dbtr_nm", _TEXT, True),
    ("dbtr_acct_iban", _TEXT, True),
    ("dbtr_agt_bicfi", _TEXT, True),
    ("btch_bookg", _TEXT, False),
    ("instr_prty", _TEXT, False),
    ("lcl_instrm_cd", _TEXT, False),
    ("ctgy_purp_cd", _TEXT, False),
    ("chrg_br", _TEXT, False),
    ("ultmt_dbtr_nm", _TEXT, False),
)

TRANSACTIONS = _schema(
    ("pmt_inf_id", _TEXT, True),
    ("instr_id", _TEXT, False),
    ("end_to_end_id", _TEXT, True),
    ("instd_amt", AMOUNT, True),
    ("ccy", _TEXT, True),
    ("cdtr_agt_bicfi", _TEXT, False),
    ("cdtr_nm", _TEXT, True),
    ("cdtr_acct_iban", _TEXT, True),
    ("rmt_inf_ustrd", _TEXT, False),
    ("rglty_rptg_cd", _TEXT, False),
    ("rmt_inf_strd_ref", _TEXT, False),
    ("rmt_inf_strd_ref_tp", _TEXT, False),
    ("purp_cd", _TEXT, False),
    ("ultmt_cdtr_nm", _TEXT, False),
    ("cdtr_ctry", _TEXT, False),
)

TABLES = {"message": MESSAGE, "remittance": REMITTANCE, "transactions": TRANSACTIONS}

#: Where a header stands in its file: the split it was read from, its piece there, its place in the piece.
PLACE = T.StructType([T.StructField("split", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("pos", T.IntegerType())])
#: The columns of tables that were read from documents: a row's own place and that of the header it belongs to.
PLACES = {"message": ("position",), "remittance": ("position", "parent"), "transactions": ("parent",)}

#: The ids that tables are looked up by.
LOOKUP_KEYS = {"message": ("msg_id",), "remittance": ("msg_id", "pmt_inf_id"), "transactions": ("pmt_inf_id",)}

# One row per finding. `rule` is a stable code, `detail` the offending value, and `declared`
# and `actual` the compared numbers of a reconciliation.
ISSUES = T.StructType(
    [
        T.StructField("validator", _TEXT),
        T.StructField("severity", _TEXT),
        T.StructField("rule", _TEXT),
        T.StructField("id", _TEXT),
        T.StructField("message", _TEXT),
        T.StructField("detail", _TEXT),
        T.StructField("declared", TOTAL),
        T.StructField("actual", TOTAL),
    ]
)


def stored(table: str, scope: tuple[str, ...] = (), located: bool = False) -> T.StructType:
    """The schema of a stored table: its scope, its places if it has any, its fields."""
    extra = [T.StructField(c, _TEXT) for c in scope]
    extra += [T.StructField(c, PLACE) for c in PLACES[table]] if located else []
    return T.StructType([*extra, *TABLES[table].fields])


#: For tables that are stored to be kept, beside the options below.
COMPACT = {"compression": "zstd"}


def parquet_options(table: str) -> dict[str, str]:
    """How a stored table is written: Bloom filters, no larger than need be, let lookups by id leave row groups out."""
    return {
        "parquet.bloom.filter.adaptive.enabled": "true",
        **{f"parquet.bloom.filter.enabled#{key}": "true" for key in LOOKUP_KEYS[table]},
    }
