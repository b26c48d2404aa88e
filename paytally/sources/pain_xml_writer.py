"""Writing pain.001 documents from the three tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.storage import children, exists, fresh_path, remove, shuffles_cleared, write_at
from paytally.tables import PaymentTables

col = F.col

# ---- fixed values: the document frame ------------------------------------------------------
DOCUMENT_OPEN = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<Document xmlns="urn:iso:std:iso:20022:tech:xsd:pain.001.001.09" '
    'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><CstmrCdtTrfInitn>'
)
DOCUMENT_CLOSE = "</CstmrCdtTrfInitn></Document>"
BLOCK_CLOSE = "</PmtInf>"
# ------------------------------------------------------------------------------------------


def _element(*fields: Column) -> Column:
    """A nested element, left out when it would be empty."""
    return F.when(F.coalesce(*(f.isNotNull() for f in fields), F.lit(False)), F.struct(*fields))


def _nested(name: str, *path: str) -> Column:
    """``name`` as the innermost of a chain of elements, absent when NULL."""
    value, filled = col(name), col(name).isNotNull()
    for tag in reversed(path):
        value = F.when(filled, F.struct(value.alias(tag)))
    return value


def _any(*names: str) -> Column:
    out = col(names[0]).isNotNull()
    for n in names[1:]:
        out = out | col(n).isNotNull()
    return out


def _xml(fields: list[Column], tag: str) -> Column:
    text = F.to_xml(F.struct(*fields), {"rowTag": tag, "indent": ""})
    return F.btrim(text, F.lit("\n"))


def _opened(fields: list[Column], tag: str) -> Column:
    """The element without its end tag, for children to follow."""
    return F.regexp_replace(F.regexp_replace(_xml(fields, tag), "</" + tag + r">\z", ""), r"^<" + tag + r"/>\z", f"<{tag}>")


def _group_header() -> Column:
    return _xml(
        [
            col("msg_id").alias("MsgId"),
            col("msg_cre_dt_tm").alias("CreDtTm"),
            col("msg_nb_of_txs").alias("NbOfTxs"),
            col("msg_ctrl_sum").cast("string").alias("CtrlSum"),
            _nested("msg_initg_pty_nm", "Nm").alias("InitgPty"),
        ],
        "GrpHdr",
    )


# Fields of a block that may also stand after its transactions.
TRAILING = {"chrg_br": ("ChrgBr",), "ultmt_dbtr_nm": ("UltmtDbtr", "Nm")}


def _block_header(trailing: Sequence[str] = ()) -> Column:
    def unless_trailing(name: str, value: Column) -> Column:
        return F.lit(None).cast("string") if name in trailing else value

    kind = F.when(
        _any("instr_prty", "svc_lvl_cd", "lcl_instrm_cd", "ctgy_purp_cd"),
        F.struct(
            col("instr_prty").alias("InstrPrty"),
            _nested("svc_lvl_cd", "Cd").alias("SvcLvl"),
            _nested("lcl_instrm_cd", "Cd").alias("LclInstrm"),
            _nested("ctgy_purp_cd", "Cd").alias("CtgyPurp"),
        ),
    )
    return _opened(
        [
            col("pmt_inf_id").alias("PmtInfId"),
            col("pmt_mtd").alias("PmtMtd"),
            col("btch_bookg").alias("BtchBookg"),
            col("nb_of_txs").alias("NbOfTxs"),
            col("ctrl_sum").cast("string").alias("CtrlSum"),
            kind.alias("PmtTpInf"),
            unless_trailing("chrg_br", col("chrg_br")).alias("ChrgBr"),
            F.when(
                col("reqd_exctn_dt").isNotNull(),
                F.struct(F.date_format("reqd_exctn_dt", "yyyy-MM-dd").alias("Dt")),
            ).alias("ReqdExctnDt"),
            _nested("dbtr_nm", "Nm").alias("Dbtr"),
            _nested("dbtr_acct_iban", "Id", "IBAN").alias("DbtrAcct"),
            _nested("dbtr_agt_bicfi", "FinInstnId", "BICFI").alias("DbtrAgt"),
            unless_trailing("ultmt_dbtr_nm", _nested("ultmt_dbtr_nm", "Nm")).alias("UltmtDbtr"),
        ],
        "PmtInf",
    )


def _block_end(trailing: Sequence[str]) -> Column:
    """The end of a block, after the fields that are to stand behind its transactions."""
    late = []
    for name in trailing:
        tag, *path = TRAILING[name]
        element = _xml([col(name).alias(path[0])], tag) if path else F.concat(F.lit(f"<{tag}>"), col(name), F.lit(f"</{tag}>"))
        late.append(F.when(col(name).isNotNull(), element).otherwise(""))
    return F.concat(*late, F.lit(BLOCK_CLOSE))


def _lines(name: str) -> Column:
    return F.split(col(name), "\n")


def _transaction() -> Column:
    reference = F.struct(
        _nested("rmt_inf_strd_ref_tp", "CdOrPrtry", "Cd").alias("Tp"),
        col("rmt_inf_strd_ref").alias("Ref"),
    )
    has_reference = _any("rmt_inf_strd_ref", "rmt_inf_strd_ref_tp")
    remittance = F.when(
        has_reference | col("rmt_inf_ustrd").isNotNull(),
        F.struct(
            _lines("rmt_inf_ustrd").alias("Ustrd"),
            F.when(has_reference, F.struct(reference.alias("CdtrRefInf"))).alias("Strd"),
        ),
    )
    codes = F.transform(_lines("rglty_rptg_cd"), lambda c: F.struct(c.alias("Cd")))
    return _xml(
        [
            F.when(
                _any("instr_id", "end_to_end_id"),
                F.struct(col("instr_id").alias("InstrId"), col("end_to_end_id").alias("EndToEndId")),
            ).alias("PmtId"),
            F.when(
                _any("instd_amt", "ccy"),
                F.struct(
                    F.struct(
                        col("ccy").alias("_Ccy"),
                        F.coalesce(col("instd_amt").cast("string"), F.lit("")).alias("_VALUE"),
                    ).alias("InstdAmt")
                ),
            ).alias("Amt"),
            _nested("cdtr_agt_bicfi", "FinInstnId", "BICFI").alias("CdtrAgt"),
            _nested("ultmt_cdtr_nm", "Nm").alias("UltmtCdtr"),
            F.when(
                _any("cdtr_nm", "cdtr_ctry"),
                F.struct(col("cdtr_nm").alias("Nm"), _nested("cdtr_ctry", "Ctry").alias("PstlAdr")),
            ).alias("Cdtr"),
            _nested("cdtr_acct_iban", "Id", "IBAN").alias("CdtrAcct"),
            _nested("purp_cd", "Cd").alias("Purp"),
            remittance.alias("RmtInf"),
            F.when(col("rglty_rptg_cd").isNotNull(), F.struct(codes.alias("Dtls"))).alias("RgltryRptg"),
        ],
        "CdtTrfTxInf",
    )


# Order of the pieces inside a document: by message, section, block, then place inside the block.
ORDER = ("message_at", "section", "block_at", "place", "end_to_end_id")


def _own_place() -> Column:
    return F.struct(F.lit(0).cast("long").alias("split"), F.monotonically_increasing_id().alias("seq"), F.lit(0).alias("pos"))


def _headers(tables: PaymentTables, folder: str) -> tuple[DataFrame, DataFrame]:
    """Messages and blocks with their places, and blocks with the place and id of their message.

    Tables read from documents know these places already. In others every header gets a place of its own, and
    rows that name an id several headers have belong to the first of these, so no row is written twice; such
    headers are written into ``folder``.
    """
    if tables.located:
        key = _file_key(tables)
        messages = tables.message.withColumnRenamed("position", "message_at")
        blocks = tables.remittance.withColumnsRenamed({"position": "block_at", "parent": "message_at"}).drop("msg_id")
        return messages, blocks.join(messages.select(*key, "message_at", "msg_id"), [*key, "message_at"])
    message_key = tables.keys("msg_id")
    messages = write_at(tables.message.withColumn("message_at", _own_place()), f"{folder}/messages")
    first = messages.groupBy(*message_key).agg(F.min("message_at").alias("message_at"))
    return messages, write_at(tables.remittance.join(first, message_key).withColumn("block_at", _own_place()), f"{folder}/blocks")


def _block_key(tables: PaymentTables) -> list[str]:
    """The columns that transactions and the blocks they belong to share."""
    return [*_file_key(tables), "block_at"] if tables.located else tables.keys("pmt_inf_id")


def _unplaced(tables: PaymentTables) -> DataFrame:
    return tables.transactions.withColumnRenamed("parent", "block_at") if tables.located else tables.transactions


def _heads(tables: PaymentTables, blocks: DataFrame) -> DataFrame:
    """The places, and the message id, that the transactions of a block get; a row for each block."""
    key = _block_key(tables)
    if tables.located:
        return blocks.select(*key, "message_at", "msg_id")
    first = F.min(F.struct("block_at", "message_at", "msg_id")).alias("_first")
    return blocks.groupBy(*key).agg(first).select(*key, "_first.*")


def _placed(tables: PaymentTables, blocks: DataFrame) -> DataFrame:
    """Transactions with the places, and the message id, of their headers, which they meet in one join."""
    return _unplaced(tables).join(_heads(tables, blocks), _block_key(tables))


def _placed_in_parts(tables: PaymentTables, blocks: DataFrame, parts: int, folder: str) -> Iterator[DataFrame]:
    """The same in parts by the hash of the block.

    Transactions are read once, and wait for their part in a compressed table in ``folder``.
    """
    if parts == 1:
        yield _placed(tables, blocks)
        return
    spark, key, transactions = tables.spark, _block_key(tables), _unplaced(tables)
    with shuffles_cleared(spark):
        dealt = transactions.withColumn("part", _dealt(key, parts)).write.partitionBy("part")
        dealt.option("compression", "zstd").parquet(folder)
    heads = _heads(tables, blocks)
    for part in range(parts):
        path = f"{folder}/part={part}"
        here = spark.read.schema(transactions.schema).parquet(path) if exists(spark, path) else transactions.where("false")
        yield here.join(heads.where(_dealt(key, parts) == part), key)
        remove(spark, path)


def _dealt(key: Sequence[Column | str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts))


def _file_key(tables: PaymentTables) -> list[str]:
    """The columns within which places hold."""
    return list(dict.fromkeys([*tables.scope, *(c for c in ("source_file",) if c in tables.message.columns)]))


def fragments(tables: PaymentTables, trailing: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """The documents as ordered pieces of text, one row each, the scope of the tables in front.

    Only what hangs together is written: blocks of a known message, transactions of a known
    block; ``orphans`` lists the rest. Block ids may repeat, also inside a document. Fields named in
    ``trailing`` stand after the transactions of their block. A copy of the headers is kept in ``folder``, which
    can go once the pieces are written.
    """
    messages, blocks = _headers(tables, folder or fresh_path(tables.spark, "headers"))
    return _pieces(_file_key(tables), messages, blocks, _placed(tables, blocks), trailing)


def _pieces(key: list[str], messages: DataFrame, blocks: DataFrame, transactions: DataFrame, trailing: Sequence[str]) -> DataFrame:
    def piece(df: DataFrame, section: int, place: int, text: Column):
        def own(name: str, otherwise: str) -> Column:
            return (col(name) if name in df.columns else F.lit(None).cast(otherwise)).alias(name)

        return df.select(
            *key,
            "msg_id",
            "message_at",
            F.lit(section).alias("section"),
            own("block_at", messages.schema["message_at"].dataType.simpleString()),
            own("pmt_inf_id", "string"),
            F.lit(place).alias("place"),
            own("end_to_end_id", "string"),
            text.alias("value"),
        )

    parts = [
        piece(messages, 0, 0, F.concat(F.lit(DOCUMENT_OPEN), _group_header())),
        piece(blocks, 1, 0, _block_header(trailing)),
        piece(transactions, 1, 1, _transaction()),
        piece(blocks, 1, 2, _block_end(trailing)),
        piece(messages, 2, 0, F.lit(DOCUMENT_CLOSE)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphans(tables: PaymentTables) -> DataFrame:
    """What ``fragments`` leaves out, by key: blocks without their message, transactions without a written block."""
    if tables.located:
        key = _file_key(tables)
        messages = tables.message.select(*key, col("position").alias("parent"))
        message_key = block_key = [*key, "parent"]
        blocks = tables.remittance.join(messages, message_key, "left_semi").select(*key, col("position").alias("parent"))
    else:
        message_key, block_key = tables.keys("msg_id"), tables.keys("pmt_inf_id")
        messages = tables.message.select(*message_key)
        blocks = tables.remittance.join(messages, message_key, "left_semi").select(*block_key)
    lost = tables.remittance.join(messages, message_key, "left_anti")
    loose = tables.transactions.join(blocks, block_key, "left_anti")

    def listed(df: DataFrame, table: str, id: str, reason: str) -> DataFrame:
        return df.select(*tables.scope, F.lit(table).alias("table"), col(id).alias("id"), F.lit(reason).alias("reason"))

    return listed(lost, "remittance", "pmt_inf_id", "no such message").unionByName(
        listed(loose, "transactions", "end_to_end_id", "no such payment block")
    )


LAYOUTS = ("documents", "packed", "spread")


def write(
    tables: PaymentTables, path: str, layout: str = "documents", mode: str = "errorifexists", compression: str | None = None
) -> None:
    """Write documents as text files, compressed if a ``compression`` of Spark's text files is named.

    ``documents``: one well-formed XML file for each document, in a folder of its own that is
    named by a hash of its key. ``packed``: whole documents one after another, as many to a file
    as a task has; for very many small ones. ``spread``: for documents too large for one task;
    the pieces are range-sorted over all tasks, and the part files in name order make up the
    text.

    Markup takes about a tenth of the space as ``gzip``, which the reader takes as it is. A compressed file is one
    split, so that goes with ``packed``, whose files are no larger than a task.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, not {layout!r}")
    key, order = [*_file_key(tables), "message_at"], (*_file_key(tables), *ORDER)

    def stored(df: DataFrame, mode: str):
        return df.write.mode(mode).option("compression", compression or "none")

    if layout == "packed":
        _write_packed(tables, path, mode, lambda pieces, mode: stored(pieces.repartition(*key).sortWithinPartitions(*order).select("value"), mode).text(path))
        return
    with written_from(tables) as pieces:
        if layout == "spread":
            stored(pieces.orderBy(*order).select("value"), mode).text(path)
        else:
            named = pieces.withColumn("document", F.lower(F.hex(F.xxhash64("msg_id", *key))))
            ordered = named.repartition("document").sortWithinPartitions("document", *order)
            stored(ordered.select("document", "value"), mode).partitionBy("document").text(path)


def _write_packed(tables: PaymentTables, path: str, mode: str, store: Callable[[DataFrame, str], None]) -> None:
    """Slice after slice is added to ``path``; if one fails, those before it go too."""
    there = exists(tables.spark, path)
    if there and mode in ("error", "errorifexists"):
        raise FileExistsError(f"{path} already exists")
    if there and mode == "ignore":
        return
    kept = set(children(tables.spark, path)) if mode == "append" else set()
    begun = False
    try:
        for pieces in slices(tables):
            store(pieces, "append" if begun else mode)
            begun = True
    except BaseException:
        if begun:
            for name in set(children(tables.spark, path)) - kept:
                remove(tables.spark, f"{path}/{name}")
        raise


@contextmanager
def written_from(tables: PaymentTables, trailing: Sequence[str] = ()) -> Iterator[DataFrame]:
    """The ``fragments``, to be written inside; neither shuffles nor the copy of the headers outlast it."""
    folder = fresh_path(tables.spark, "headers")
    try:
        with shuffles_cleared(tables.spark):
            yield fragments(tables, trailing, folder)
    finally:
        remove(tables.spark, folder)


#: A slice has so many transactions, until there are so many slices; then slices grow.
SLICE_ROWS, SLICES = 1_000_000, 16


def slice_count(tables: PaymentTables) -> int:
    return max(1, min(SLICES, -(-tables.transactions.count() // SLICE_ROWS)))


def slices(tables: PaymentTables, by: Sequence[Column | str] = (), trailing: Sequence[str] = ()) -> Iterator[DataFrame]:
    """The ``fragments`` a slice at a time, each to be written before the next is asked for.

    Markup takes many times the space of the tables it is made from while it is shuffled; so only a slice of it is at
    a time. Rows equal in ``by``, columns or expressions of the scope and ``msg_id`` (all of them, if not named), are in
    one slice. Transactions meet their headers first, in parts too, and wait in a compressed table dealt out by slice;
    the tables are read once for that, whatever the number of parts.
    Neither this nor the headers nor shuffles outlast their use.
    """
    spark, key = tables.spark, _file_key(tables)
    n = slice_count(tables)
    if n == 1:
        with written_from(tables, trailing) as pieces:
            yield pieces
        return
    folder = fresh_path(spark, "headers")
    waiting, number = f"{folder}/transactions", _dealt(by or [*key, "msg_id"], n)
    try:
        messages, blocks = _headers(tables, folder)
        if tables.located:
            messages, blocks = write_at(messages, f"{folder}/messages"), write_at(blocks, f"{folder}/blocks")
        for placed in _placed_in_parts(tables, blocks, n // 2, f"{folder}/parts"):
            with shuffles_cleared(spark):
                dealt = placed.withColumn("slice", number).write.partitionBy("slice")
                dealt.option("compression", "zstd").mode("append").parquet(waiting)
        for i in range(n):
            path = f"{waiting}/slice={i}"
            transactions = spark.read.schema(placed.schema).parquet(path) if exists(spark, path) else placed.where("false")
            with shuffles_cleared(spark):
                yield _pieces(key, messages.where(number == i), blocks.where(number == i), transactions, trailing)
            remove(spark, path)
    finally:
        remove(spark, folder)
