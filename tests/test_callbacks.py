from __future__ import annotations

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from paytally import fixtures
from paytally.plans import callbacks

SMALL = "/root/testdata/sf0.001"


class _Lists(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, one, two):
        one += two
        return one


def test_handlers_get_the_rows_that_collect_gives(spark):
    tables = fixtures.payments(spark, SMALL)
    odd = spark.sql(
        """select * from values (1, 1.5D, true, 'x', cast(1.20 as decimal(9,2)), date'1969-12-31'),
        (null, double('nan'), null, null, null, null) as t(i, d, b, s, m, day)"""
    )
    invalid = spark.range(2).select(F.expr("cast(X'61FF62' as string)").alias("bad"))
    nested = odd.select(F.struct("i", "s").alias("pair"), F.array("i").alias("list"), F.lit(b"x").alias("raw"))
    twice = odd.select("i", F.col("s").alias("i"))
    for df in (tables.transactions.limit(500), tables.remittance.limit(200), odd, invalid, nested, twice, odd.where("false"), odd.select()):
        names = df.columns
        total = spark.sparkContext.accumulator([], _Lists())
        callbacks.for_each_row(df, lambda row, names=names, total=total: total.add([f"{type(row).__name__} {row.__fields__} {tuple(row)}"]))
        rows = [f"Row {names} {tuple(row)}" for row in df.collect()]
        assert sorted(total.value) == sorted(rows)


def test_plain_tables_are_not_handed_over_row_by_row(spark, monkeypatch):
    def no(*_):
        raise AssertionError("rows are pickled one by one")

    transactions = fixtures.payments(spark, SMALL).transactions
    monkeypatch.setattr(type(transactions), "foreachPartition", no)
    calls = spark.sparkContext.accumulator(0)
    callbacks.for_each_row(transactions, lambda row: calls.add(1))
    assert calls.value == transactions.count()
