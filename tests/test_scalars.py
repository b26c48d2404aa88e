from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paytally.functions import scalars as S
from paytally.sources.ingest import dataset_name, safe_identifier

CASES = {
    "iban_valid": (
        S.iban_valid,
        {
            "DE89370400440532013000": True,
            "de89370400440532013000": True,
            "DE88370400440532013000": False,
            "GB29NWBK60161331926819": True,
            "DE89 3704 0044": False,
            "DE89370400440532013000\n": False,
            "MT84MALT011000012345MTLCAST001S": True,
            "DE89": False,
            "ZZ" + "9" * 33: False,
            None: False,
        },
    ),
    "iban_format_bad": (
        S.iban_format_bad,
        {"DE89370400440532013000": False, "de89": True, "DE8": True, "DE89A\n": True, "": True, None: None},
    ),
    "bic_valid": (
        S.bic_valid,
        {"COBADEFF": True, "COBADEFFXXX": True, "COBADEFFXX": False, "cobadeff": False, "COBADEFF\n": False, None: False},
    ),
    "currency_valid": (S.currency_valid, {"EUR": True, "eur": False, "EURO": False, "EUR\n": False, "": False, None: False}),
    "offset_date_time_valid": (
        S.offset_date_time_valid,
        {
            "2026-01-01T00:00:00+01:00": True,
            "2026-01-01T00:00Z": True,
            "2026-01-01T00:00:00.123456789-03:30": True,
            "2026-01-01T00:00:00": False,
            "2026-02-30T00:00:00Z": False,
            "2026-01-01T24:00:00Z": False,
            "2026-01-01 00:00:00Z": False,
            "2026-01-01T00:00:00+19:00": False,
            "2026-01-01T00:00:00+18:00": True,
            "": False,
            None: False,
        },
    ),
    "count_exact": (
        S.count_exact,
        {"12": 12, "+3": 3, "-1": -1, " 12 ": None, "1.5": None, "x": None, "": None, "9" * 30: None, None: None},
    ),
    "count_sql": (S.count_sql, {"12": 12, " 12 ": 12, "1.5": 2, "x": None, None: None}),
    "null_or_blank": (S.null_or_blank, {"": True, "  \t": True, "\u2003": True, "\u00a0": False, "a": False, None: True}),
    "null_or_empty": (S.null_or_empty, {"": True, "  ": False, "a": False, None: True}),
    "utf16_length": (S.utf16_length, {"abc": 3, "\U0001F600": 2, "é": 1}),
    "iso_date_text": (
        lambda c: S.iso_date_text(c).cast("string"),
        {"2026-01-02": "2026-01-02", "2026-1-2": None, "2026-02-30": None, "20260102": None, "": None, None: None},
    ),
    "decimal_text": (
        lambda c: S.decimal_text(c, 18, 2).cast("string"),
        {"1.005": "1.01", "-1.005": "-1.01", "1E3": "1000.00", ".5": "0.50", "1,5": None, "": None, "9" * 20: None, None: None},
    ),
    "payment_method_unknown": (S.payment_method_unknown, {"TRF": False, "CHK": False, "TRA": True, "": True, None: True}),
    "trim_text": (S.trim_text, {" a b\n": "a b", "\t": "", None: None}),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    function, cases = CASES[name]
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", function(F.col("x")).alias("y"))
    assert {row.x: row.y for row in df.collect()} == cases


def test_control_sums_match(spark):
    df = spark.sql(
        "select cast(a as decimal(18,2)) a, cast(b as decimal(38,5)) b from values "
        "('1.00', '1.00499'), ('1.00', '1.00500'), ('1.00', null) as t(a, b)"
    )
    got = [r[0] for r in df.select(S.control_sums_match(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, None]


def test_names():
    assert dataset_name("/in/pain001.XML") == "pain001"
    assert dataset_name("a.xml.xml") == "a.xml"
    assert safe_identifier("remittance_1") == "remittance_1"
    for bad in ("1a", "a;drop table b", "", "a.b"):
        with pytest.raises(ValueError):
            safe_identifier(bad)


def test_account_numbers_equal_their_definition_and_are_computed_once(spark):
    dice = random.Random(7)
    letters, figures = "ABCXYZabz", "0123456789"
    values = [None, "", "DE0", "DE00", "DE000", "DE" + "9" * 32, "DE" + "9" * 33, "DE89370400440532013000\n", "\u00c4E89370400440532013000"]
    for n in range(600):
        bank = "".join(dice.choice(figures if n % 3 else letters + figures) for _ in range(dice.randrange(1, 31)))
        country = "".join(dice.choice("ADEZ") for _ in range(2))
        number = "".join(str(int(c, 36)) for c in bank + country) + "00"
        check = 98 - int(number) % 97
        values += [f"{country}{check:02d}{bank}", f"{country}{(check + n) % 100:02d}{bank}", f"{country.lower()}{check:02d}{bank}"]

    def valid(v):
        if v is None or not re.fullmatch(r"[A-Za-z0-9]{5,34}", v):
            return False
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", S.iban_valid(F.col("v")).alias("ok"))
    assert [(r["v"], r["ok"]) for r in df.collect() if r["ok"] != valid(r["v"])] == []
    assert df.where("ok").count() > 600
    computed = spark.range(9).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("v")).where(S.iban_valid(F.col("v")))
    assert computed._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1].count("lpad(") == 1
