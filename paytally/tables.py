"""The three payment tables as one value."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally import schemas
from paytally.storage import fresh_path, remove, shuffles_cleared


def table_path(path: str, table: str, base: str | None = None) -> str:
    return f"{path}/{base}_{table}" if base else f"{path}/{table}"


#: Transactions to a range of ``save_clustered``, until there are so many ranges; then ranges grow.
RANGE_ROWS, RANGES = 250_000, 8


@dataclass(frozen=True)
class PaymentTables:
    """``message``, ``remittance`` and ``transactions``, as lazy DataFrames.

    ``scope`` names extra columns, present in all three tables, that belong to every key.
    Payment-block ids are unique only within a document, so tables that hold many documents
    set ``scope=("source_file",)`` and nothing is matched across documents. The default is a
    single global scope.

    ``located`` tells that the rows carry their place in the document (``schemas.PLACES``), as rows read
    from documents do. Then declarations have an order, and blocks of equal id inside a document are
    kept apart when documents are written.

    ``totals`` may hold the transactions already reduced to their payment blocks, for several
    reconciliations to share (see ``operators.reconcile.share_totals``).
    """

    message: DataFrame
    remittance: DataFrame
    transactions: DataFrame
    scope: tuple[str, ...] = ()
    totals: DataFrame | None = None
    located: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.message.sparkSession

    def items(self) -> Iterable[tuple[str, DataFrame]]:
        return (
            ("message", self.message),
            ("remittance", self.remittance),
            ("transactions", self.transactions),
        )

    def map(self, fn) -> PaymentTables:
        return replace(self, **{name: fn(name, df) for name, df in self.items()})

    def keys(self, *names: str) -> list[str]:
        """The columns of a key: the scope, then ``names``."""
        return [*self.scope, *names]

    # ---- open, store, keep -------------------------------------------------------------

    @staticmethod
    def load(
        spark: SparkSession,
        path: str,
        fmt: str = "parquet",
        scope: tuple[str, ...] = (),
        located: bool = False,
        base: str | None = None,
    ) -> PaymentTables:
        """Open a three-table dataset: ``<path>/message``, ``/remittance``, ``/transactions``.

        With a ``base`` name: ``<path>/<base>_message`` and so on.
        """

        def read(name: str) -> DataFrame:
            return spark.read.format(fmt).schema(schemas.stored(name, scope, located)).load(table_path(path, name, base))

        return PaymentTables(*(read(name) for name in schemas.TABLES), scope=scope, located=located)

    def save(self, path: str, mode: str = "errorifexists", options: dict[str, str] | None = None) -> PaymentTables:
        """Write Parquet tables and return them opened from their new place."""
        for name in schemas.TABLES:
            self._store(name, path, mode, options)
        return PaymentTables.load(self.spark, path, scope=self.scope, located=self.located)

    def clustered(self) -> PaymentTables:
        """The same rows in the order of the ids they are looked up by, dealt out by ranges.

        Worth its shuffle for tables that are looked up often and come in no order; tables read from
        documents have the rows of a block together as it is. The last id splits a block that is larger
        than a range.
        """
        last = {"message": "msg_cre_dt_tm", "remittance": "pmt_inf_id", "transactions": "end_to_end_id"}

        def ordered(name: str, df: DataFrame) -> DataFrame:
            order = self.keys(schemas.LOOKUP_KEYS[name][0], last[name])
            return df.repartitionByRange(*order).sortWithinPartitions(*order)

        return self.map(ordered)

    def save_clustered(self, path: str) -> PaymentTables:
        """``clustered().save(path)``, transactions a range of ids at a time, so that only a range of them is shuffled at once.

        The ranges come from a range partitioning of the ids alone.
        """
        ids = F.struct(*self.keys(*schemas.LOOKUP_KEYS["transactions"]))
        ends = []
        if (n := min(RANGES, -(-self.transactions.count() // RANGE_ROWS))) > 1:
            with shuffles_cleared(self.spark):
                ranges = self.transactions.select(ids.alias("ids")).repartitionByRange(n, "ids")
                last = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.max("ids").alias("ids"))
                found = [row["ids"].asDict() for row in last.orderBy("ids").collect()]
                kinds = self.transactions.schema
                ends = [F.struct(*(F.lit(v).cast(kinds[k].dataType).alias(k) for k, v in end.items())) for end in found[:-1]]
        for low, high in zip([None, *ends], [*ends, None], strict=True):
            within = F.lit(True) if low is None else ids > low
            within = within if high is None else within & (ids <= high)
            some = replace(self, transactions=self.transactions.where(within))
            if low is None:
                some.clustered().save(path, options=schemas.COMPACT)
            else:
                some.clustered()._store("transactions", path, "append", schemas.COMPACT)
        return PaymentTables.load(self.spark, path, scope=self.scope, located=self.located)

    def _store(self, name: str, path: str, mode: str, options: dict[str, str] | None = None) -> None:
        writer = getattr(self, name).write.mode(mode).options(**schemas.parquet_options(name), **(options or {}))
        with shuffles_cleared(self.spark):
            writer.parquet(table_path(path, name))

    def append(self, path: str) -> PaymentTables:
        return self.save(path, mode="append", options=schemas.COMPACT)

    @contextmanager
    def kept(self) -> Iterator[PaymentTables]:
        """The same rows, computed once, for all that is done inside; compressed, in the shared folder.

        Takes a fraction of the disk of ``persist``, whose blocks go to disk as they are when memory is short.
        """
        folder = fresh_path(self.spark, "kept")
        try:
            yield self.save(folder, options=schemas.COMPACT)
        finally:
            remove(self.spark, folder)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PaymentTables:
        return self.map(lambda _, df: df.persist(level))

    def unpersist(self) -> PaymentTables:
        return self.map(lambda _, df: df.unpersist())

    def register(self, prefix: str = "") -> PaymentTables:
        """Make the tables visible to ``spark.sql`` as temporary views."""
        for name, df in self.items():
            df.createOrReplaceTempView(f"{prefix}{name}")
        return self

    # ---- whole-table scans -------------------------------------------------------------

    def counts(self) -> DataFrame:
        """One row: rows per table. Parquet answers this from its footers."""
        parts = [
            df.select(F.lit(name).alias("name")).groupBy("name").count()
            for name, df in self.items()
        ]
        return (
            parts[0].unionByName(parts[1]).unionByName(parts[2])
            .agg(
                *(
                    F.coalesce(F.sum(F.when(F.col("name") == name, F.col("count"))), F.lit(0)).alias(alias)
                    for name, alias in (
                        ("message", "message_rows"),
                        ("remittance", "remittance_rows"),
                        ("transactions", "transaction_rows"),
                    )
                )
            )
        )

    def project(self, table: str, *columns: str) -> DataFrame:
        """A column-subset scan; only these columns are read from a columnar file."""
        return getattr(self, table).select(*columns)
