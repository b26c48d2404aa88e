"""Reading pain.001 XML: a parallel scan of documents of any size into three tables.

A document is not read as one record. The text source cuts it at every occurrence of the
transaction tag's name, so a file of many gigabytes is read by as many tasks as it has
splits, and each piece holds at most one transaction or the headers between two of them:

    ...<PmtInf><PmtInfId>P1</PmtInfId>...<   |>...one transaction...</   |><   |>...</   |></PmtInf>...

The name alone is the separator, so namespace prefixes, attributes and blanks inside the tags
make no difference. The steps:

1. *Stage* (one pass over the XML, no shuffle): classify the pieces, carry the running message
   and block ids forward inside a split, parse with ``from_xml``, write one staged table.
2. *Index* (narrow columns of the staged table): the ids each split inherits from the splits
   before it, and the state of each file.
3. *Tables*: the staged rows of sound files, completed from the index.

A file that cannot be read as a whole gives no rows; it is listed with a reason instead.
Text that only looks like a tag (inside CDATA or a comment, or the tag's name in other text) makes a
file *irregular*; such files are read once more, with the pieces that were cut there made whole again,
also where that goes on over the end of a split.

Headers have a place: split, piece, place in the piece. It orders them as the document does, and every
row knows the place of the header it belongs to. Fields of a block that stand after its transactions are
pieces of their own; that place takes them back to their header.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions import scalars as S
from paytally.sources import plain_markup
from paytally.sources.carry import MARKS, carry_marks, rejoin_open, split_ends, split_starts, write_out_empty
from paytally.storage import fresh_path, remove, write_at, write_once
from paytally.tables import PaymentTables

col = F.col

TRANSACTION_TAG = "CdtTrfTxInf"
SOURCE_FILE = "source_file"

# Everything is read as text and converted afterwards, so that a bad value is seen, not nulled.
HEADER_XML = """
MsgId string, CreDtTm string, NbOfTxs string, CtrlSum string, InitgPty struct<Nm:string>,
PmtInfId string, PmtMtd string, BtchBookg string,
PmtTpInf struct<InstrPrty:string, SvcLvl:struct<Cd:string>, LclInstrm:struct<Cd:string>, CtgyPurp:struct<Cd:string>>,
ReqdExctnDt struct<Dt:string>, Dbtr struct<Nm:string>, DbtrAcct struct<Id:struct<IBAN:string>>,
DbtrAgt struct<FinInstnId:struct<BICFI:string>>, ChrgBr string, UltmtDbtr struct<Nm:string>,
_corrupt_record string
"""
TRANSACTION_FIELDS = """
PmtId:struct<InstrId:string, EndToEndId:string>, Amt:struct<InstdAmt:struct<_Ccy:string, _VALUE:string>>,
CdtrAgt:struct<FinInstnId:struct<BICFI:string>>, UltmtCdtr:struct<Nm:string>,
Cdtr:struct<Nm:string, PstlAdr:struct<Ctry:string>>, CdtrAcct:struct<Id:struct<IBAN:string>>,
Purp:struct<Cd:string>, RgltryRptg:array<struct<Dtls:array<struct<Cd:array<string>>>>>,
RmtInf:struct<Ustrd:array<string>,
  Strd:array<struct<CdtrRefInf:struct<Tp:struct<CdOrPrtry:struct<Cd:string>>, Ref:string>>>>
"""
TRANSACTION_XML = f"struct<{TRANSACTION_FIELDS}, _corrupt_record:string>"

PREFIX = r"(?:[\w.-]+:)?"


_FRAGMENT = rf"(?s)<{PREFIX}(GrpHdr|PmtInf)(?:\s*/>|(?=[\s>]).*?(?:</{PREFIX}\1\s*>|\z))"
_BLOCK_FIELDS = (
    "PmtInfId PmtMtd BtchBookg NbOfTxs CtrlSum PmtTpInf ReqdExctnDt Dbtr DbtrAcct DbtrAgt ChrgBr UltmtDbtr"
).split()
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


# ---- pieces --------------------------------------------------------------------------------


def scan(reader, path: str | Sequence[str]) -> DataFrame:
    """The pieces of all files, from ``spark.read`` or ``spark.readStream``."""
    return (
        reader.option("lineSep", TRANSACTION_TAG)
        .text(path)
        .select(
            col("value"),
            col("_metadata.file_path").alias(SOURCE_FILE),
            col("_metadata.file_block_start").alias("split_start"),
        )
    )


def _guarded(test: Column, costly: Column) -> Column:
    """``costly`` where ``test`` holds, else false.

    Unlike ``&``, whose sides may be evaluated ahead as common subexpressions, a CASE leaves
    the costly side alone for the rows that do not need it.
    """
    return F.when(test, costly).otherwise(F.lit(False))


def _ends_with(value: Column, opening: str) -> Column:
    """Whether a piece ends in ``opening``, directly or followed by a namespace prefix."""
    prefixed = _guarded(value.endswith(":"), value.rlike(rf"{opening}[\w.-]+:\z"))
    return F.when(value.endswith(opening), F.lit(True)).otherwise(prefixed)


def _plain(value: Column) -> Column:
    """Markup without comments, and with CDATA turned into escaped text."""

    def unwrap(part: Column, i: Column) -> Column:
        end = F.instr(part, "]]>")
        inside = F.substr(part, F.lit(1), end - 1)
        for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inside = F.replace(inside, F.lit(raw), F.lit(escaped))
        return F.when((i == 0) | (end == 0), part).otherwise(F.concat(inside, F.substr(part, end + 3)))

    bare = F.regexp_replace(value, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")
    escaped = F.array_join(F.transform(F.split(bare, r"<!\[CDATA\["), unwrap), "")
    return F.when(~value.contains("<!"), value).when(bare.contains("<![CDATA["), escaped).otherwise(bare)


def _unclosed(value: Column) -> Column:
    """Whether a comment or CDATA section starts in this piece and does not end in it."""
    rest = F.regexp_replace(value, r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->", "")
    return _guarded(value.contains("<!"), rest.rlike(r"<!--|<!\[CDATA\["))


def _mark(fragment: Column, tag: str) -> Column:
    """What a header fragment leaves behind for the pieces after it: "=" and the raw text of
    its id element, an empty text if it has none; NULL if there is no fragment."""
    text = F.regexp_extract(fragment, rf"<{PREFIX}{tag}\s*>([^<]*)<", 1)
    has = fragment.rlike(rf"<{PREFIX}{tag}\s*/?>")
    return F.when(fragment.isNotNull(), F.when(has, F.concat(F.lit("="), S.trim_text(text))).otherwise(F.lit("")))


def _marked_id(mark: Column) -> Column:
    """The id in a mark, entities resolved."""
    raw = F.when(mark != "", F.substr(mark, F.lit(2)))
    parsed = F.from_xml(F.concat(F.lit("<r><v>"), raw, F.lit("</v></r>")), "v string")
    return F.when(raw.contains("&"), S.trim_text(parsed["v"])).otherwise(raw)


def _is_group(fragment: Column) -> Column:
    usual = F.when(fragment.startswith("<PmtInf"), F.lit(False)).when(fragment.startswith("<GrpHdr"), F.lit(True))
    return usual.otherwise(fragment.rlike(rf"^<{PREFIX}GrpHdr"))


# What stands between two transactions of a block, and before a block that follows another.
_NOTHING_BETWEEN = rf"\A\s*>\s*<(?:{PREFIX})\z"
_ONLY_CLOSED = r"\A\s*>\s*</PmtInf>\s*\z"


def _one_block(value: Column) -> Column:
    """Whether a piece plainly closes a block and starts the next, and holds nothing else: no
    prefix, attribute, comment or CDATA. Decided mostly by byte searches, as it holds for nearly
    all pieces between blocks."""
    head, rest = F.substring_index(value, "<PmtInf>", 1), F.substring_index(value, "<PmtInf>", -1)
    return (
        value.contains("<PmtInf>")
        & value.endswith("<")
        & ~value.contains("GrpHdr")
        & ~value.contains("<!")
        & ~value.contains(":PmtInf")
        & ~value.contains("PmtInf ")
        & ~rest.contains("</PmtInf>")
        & (F.octet_length(head) + F.octet_length(rest) + len("<PmtInf>") == F.octet_length(value))
        & head.rlike(_ONLY_CLOSED)
    )


def _one_block_fragment(value: Column) -> Column:
    """That block header, closed: the piece ends in the "<" of the first transaction."""
    return F.concat(F.lit("<PmtInf>"), F.substring_index(value, "<PmtInf>", -1), F.lit("/PmtInf>"))


def _fragments(markup: Column) -> Column:
    """All group and block headers in the text between two transactions, in order. The last
    block is usually cut off where its first transaction starts."""
    return F.regexp_extract_all(markup, F.lit(_FRAGMENT), F.lit(0))


def _between_problem(markup: Column) -> Column:
    """What is wrong with the text between two transactions, apart from its headers (NULL if nothing).

    Prolog and the tags that enclose headers and transactions are taken away; what is left has to
    be well-formed.
    """
    rest = F.regexp_replace(markup, _FRAGMENT, "")
    rest = F.regexp_replace(rest, r"(?s)<\?.*?\?>|<!DOCTYPE[^>]*>|\x{FEFF}", "")
    rest = F.regexp_replace(rest, rf"\A\s*/?>|<(?:/?{PREFIX})\z", "")
    bare = F.regexp_replace(rest, rf"</?{PREFIX}(?:Document|CstmrCdtTrfInitn|PmtInf)(?:\s[^<>]*)?>", "")
    parsed = F.from_xml(F.concat(F.lit("<r>"), bare, F.lit("</r>")), "v string, _corrupt_record string", _OPTIONS)
    broken = _guarded(~bare.rlike(r"\A\s*\z"), parsed.isNull() | parsed["_corrupt_record"].isNotNull())
    return F.when(broken, F.lit("malformed markup between transactions"))


def _late_fields(markup: Column) -> Column:
    """Fields of a block in the text after one of its transactions, as a header of their own (NULL if none)."""
    late = F.regexp_extract(markup, rf"(?s)\A\s*>(.*?)(?:</{PREFIX}PmtInf\s*>|<(?:{PREFIX})\z)", 1)
    has = late.rlike(rf"<{PREFIX}(?:{'|'.join(_BLOCK_FIELDS)})[\s>/]")
    return F.when(has, F.concat(F.lit("<PmtInf>"), late, F.lit("</PmtInf>")))


def _one_block_mark(value: Column) -> Column:
    """The block mark of such a piece, if its id is as plain; NULL otherwise."""
    rest = F.substring_index(value, "<PmtInf>", -1)
    text = F.substring_index(F.substring_index(rest, "<PmtInfId>", -1), "<", 1)
    return F.when(rest.contains("<PmtInfId>"), F.concat(F.lit("="), S.trim_text(text)))


def _pieces(raw: DataFrame) -> DataFrame:
    """The pieces that matter, with the marks their headers leave."""
    value = col("value")
    body = _ends_with(value, "</")
    tail = F.when(body, F.lit(False)).otherwise(~_ends_with(value, "<"))
    matters = ~value.rlike(_NOTHING_BETWEEN)
    kept = (
        raw.withColumn("is_body", body)
        .withColumn("tail", tail)
        .where(F.when(col("is_body") | col("tail"), F.lit(True)).otherwise(matters))
        .withColumn("one_block", _guarded(~col("is_body"), _one_block(value)))
        .withColumn("invalid_text", ~F.is_valid_utf8(value))
        .withColumn("mark", F.when(col("one_block"), _one_block_mark(value)))
        .withColumn("fragments", F.when(~col("is_body") & col("mark").isNull(), _fragments(_plain(value))))
    )
    last_group = F.try_element_at(F.filter(col("fragments"), _is_group), F.lit(-1))
    last_block = F.try_element_at(F.filter(col("fragments"), lambda f: ~_is_group(f)), F.lit(-1))
    group_pos = F.array_max(F.transform(col("fragments"), lambda f, i: F.when(_is_group(f), i)))
    block_pos = F.array_max(F.transform(col("fragments"), lambda f, i: F.when(~_is_group(f), i)))
    return kept.select(
        SOURCE_FILE,
        "split_start",
        "value",
        "is_body",
        "tail",
        "one_block",
        "invalid_text",
        F.when(col("fragments").isNotNull(), _mark(last_group, "MsgId")).alias("group"),
        F.when(col("fragments").isNotNull(), _mark(last_block, "PmtInfId")).otherwise(col("mark")).alias("block"),
        group_pos.alias("group_pos"),
        F.when(col("fragments").isNotNull(), block_pos).when(col("mark").isNotNull(), F.lit(0)).alias("block_pos"),
    )


# ---- carrying ids forward inside a split ----------------------------------------------------

def _carried(pieces: DataFrame) -> DataFrame:
    numbers = [schemas.T.StructField(n, schemas.T.LongType()) for n in ("seq", *(f"{mark}_seq" for mark in MARKS))]
    return pieces.mapInArrow(carry_marks, schemas.T.StructType([*pieces.schema.fields, *numbers]))


# ---- parsing -------------------------------------------------------------------------------


def _joined(texts: Column) -> Column:
    """Repeated text as one value: trimmed, blanks skipped, one per line."""
    trimmed = F.transform(texts, S.trim_text)
    return F.array_join(F.filter(trimmed, lambda t: t != ""), "\n")


def _last(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


# Where the fields of a transaction and of the headers are found.
TRANSACTION_PATHS = {
    "instr_id": ("PmtId", "InstrId"),
    "end_to_end_id": ("PmtId", "EndToEndId"),
    "cdtr_agt_bicfi": ("CdtrAgt", "FinInstnId", "BICFI"),
    "cdtr_nm": ("Cdtr", "Nm"),
    "cdtr_acct_iban": ("CdtrAcct", "Id", "IBAN"),
    "purp_cd": ("Purp", "Cd"),
    "ultmt_cdtr_nm": ("UltmtCdtr", "Nm"),
    "cdtr_ctry": ("Cdtr", "PstlAdr", "Ctry"),
}
# Repeated texts, each kept as one joined value.
REPEATED = ("rmt_inf_ustrd", "rglty_rptg_cd")
HEADER_PATHS = {
    "msg_id": ("MsgId",),
    "msg_cre_dt_tm": ("CreDtTm",),
    "nb_of_txs": ("NbOfTxs",),
    "ctrl_sum": ("CtrlSum",),
    "msg_initg_pty_nm": ("InitgPty", "Nm"),
    "pmt_inf_id": ("PmtInfId",),
    "pmt_mtd": ("PmtMtd",),
    "svc_lvl_cd": ("PmtTpInf", "SvcLvl", "Cd"),
    "reqd_exctn_dt": ("ReqdExctnDt", "Dt"),
    "dbtr_nm": ("Dbtr", "Nm"),
    "dbtr_acct_iban": ("DbtrAcct", "Id", "IBAN"),
    "dbtr_agt_bicfi": ("DbtrAgt", "FinInstnId", "BICFI"),
    "btch_bookg": ("BtchBookg",),
    "instr_prty": ("PmtTpInf", "InstrPrty"),
    "lcl_instrm_cd": ("PmtTpInf", "LclInstrm", "Cd"),
    "ctgy_purp_cd": ("PmtTpInf", "CtgyPurp", "Cd"),
    "chrg_br": ("ChrgBr",),
    "ultmt_dbtr_nm": ("UltmtDbtr", "Nm"),
}


def _walk(parsed: Column, path: Sequence[str]) -> Column:
    for name in path:
        parsed = parsed[name]
    return parsed


def parsed_transaction(t: Column) -> dict[str, Column]:
    """The raw texts of a transaction parsed by ``from_xml``, repeated ones joined."""
    codes = F.flatten(F.transform(F.flatten(t["RgltryRptg"]["Dtls"]), lambda d: F.coalesce(d["Cd"], F.array())))
    references = t["RmtInf"]["Strd"]["CdtrRefInf"]
    return {
        **{name: _walk(t, path) for name, path in TRANSACTION_PATHS.items()},
        "instd_amt": t["Amt"]["InstdAmt"]["_VALUE"],
        "ccy": t["Amt"]["InstdAmt"]["_Ccy"],
        "rmt_inf_ustrd": _joined(t["RmtInf"]["Ustrd"]),
        "rglty_rptg_cd": _joined(codes),
        "rmt_inf_strd_ref": _last(references["Ref"]),
        "rmt_inf_strd_ref_tp": _last(references["Tp"]["CdOrPrtry"]["Cd"]),
    }


def plain_transaction(cut: Column) -> dict[str, Column]:
    """The same of a transaction whose markup is plain, repeated texts joined already."""
    shape = plain_markup.TRANSACTION_SHAPE
    return {name: (shape.lines if name in REPEATED else shape.text)(cut, name) for name in shape.fields}


def typed_transaction(raw: dict[str, Column]) -> tuple[list[Column], Column]:
    """The fields of a transaction, and what is wrong with it (NULL if nothing)."""
    amount_text = S.trim_text(raw["instd_amt"])
    amount = S.decimal_text(amount_text, 18, 5)
    columns = {name: (text if name == "ccy" else S.trim_text(text)) for name, text in raw.items()}
    columns["instd_amt"] = amount
    for name in REPEATED:
        columns[name] = F.when(raw[name] != "", raw[name])
    problem = F.when((amount_text != "") & amount.isNull(), F.concat(F.lit("bad InstdAmt: "), amount_text))
    names = [n for n in schemas.TRANSACTIONS.names if n != "pmt_inf_id"]
    return [columns[n].alias(n) for n in names], problem


def parsed_header(h: Column) -> dict[str, Column]:
    return {name: _walk(h, path) for name, path in HEADER_PATHS.items()}


def plain_header(cut: Column) -> dict[str, Column]:
    shape = plain_markup.HEADER_SHAPE
    return {name: shape.text(cut, name) for name in shape.fields}


def typed_header(raw: dict[str, Column]) -> tuple[list[Column], Column]:
    """The fields of a group or block header, and what is wrong with it."""
    texts = {name: S.trim_text(text) for name, text in raw.items()}
    sum_text, day_text = texts["ctrl_sum"], texts["reqd_exctn_dt"]
    total, day = S.decimal_text(sum_text, 18, 2), S.iso_date_text(day_text)
    problem = F.coalesce(
        F.when(sum_text.isNotNull() & total.isNull(), F.concat(F.lit("bad CtrlSum: "), sum_text)),
        F.when(day_text.isNotNull() & day.isNull(), F.concat(F.lit("bad ReqdExctnDt: "), day_text)),
    )
    texts |= {"ctrl_sum": total, "reqd_exctn_dt": day}
    return [value.alias(name) for name, value in texts.items()], problem


def _either(plain: Column, short: dict[str, Column], full: dict[str, Column]) -> dict[str, Column]:
    return {name: F.when(plain, short[name]).otherwise(full[name]) for name in full}


_FACTS = ("documents_opened", "documents_closed", "blocks_opened", "blocks_closed", "tails")


def _parse_transactions(rows: DataFrame) -> tuple[DataFrame, list[Column], Column]:
    """Adds what the transaction fields are computed from; returns the fields and a problem."""
    value, body = col("value"), col("is_body")
    # A body ends in the "</" (and prefix) of its closing tag, so only the name is missing.
    prefix = F.when(value.endswith("</"), F.lit("")).otherwise(F.regexp_extract(value, r"</([\w.-]+:)\z", 1))
    element = F.concat(F.lit("<"), prefix, F.lit(TRANSACTION_TAG), value, F.lit(f"{TRANSACTION_TAG}>"))
    cut, t = col("body_cut"), col("t")
    plain = plain_markup.Shape.is_plain(cut)
    # The text itself is dropped as soon as it is cut, so that it is not copied from step to step.
    rows = (
        rows.withColumn("body_cut", F.when(body, plain_markup.TRANSACTION_SHAPE.cut(value)))
        .withColumn("value", F.when(~plain, value))
        .withColumn("t", F.when(body & ~plain, F.from_xml(element, TRANSACTION_XML, _OPTIONS)))
    )
    raw = _either(plain, plain_transaction(cut), parsed_transaction(t))
    # Joined in a step of their own, as what follows names them more than once.
    rows = rows.withColumns({name: F.when(body, raw[name]) for name in REPEATED}).withColumns(
        {
            "irregular": F.when(value.isNull(), F.lit(False)).otherwise(_unclosed(value)),
            "value": F.when(~body, value),
        }
    )
    fields, problem = typed_transaction(raw | {name: col(name) for name in REPEATED})
    malformed = body & ~plain & (t.isNull() | t["_corrupt_record"].isNotNull())
    return rows, fields, F.when(malformed, F.lit("malformed transaction")).otherwise(problem)


def _parse_headers(rows: DataFrame) -> tuple[DataFrame, list[Column], Column]:
    """The same for ``fragment``, a group or block header."""
    fragment, cut, h = col("fragment"), col("head_cut"), col("h")
    plain = plain_markup.Shape.is_plain(cut)
    tag = F.when(_is_group(fragment), F.lit("GrpHdr")).otherwise(F.lit("PmtInf"))
    complete = F.when(fragment.endswith("</PmtInf>"), F.lit(True)).otherwise(
        fragment.rlike(rf"(?:</{PREFIX}(?:GrpHdr|PmtInf)\s*>|/>)\z")
    )
    closed = F.concat(
        F.regexp_replace(fragment, rf"<{PREFIX}\z", ""),
        F.lit("</"), F.regexp_extract(fragment, r"^<([\w.-]+:)?", 1), tag, F.lit(">"),
    )
    rows = (
        rows.withColumn("fragment", F.when(complete, fragment).otherwise(closed))
        .withColumn("head_cut", F.when(fragment.isNotNull(), plain_markup.HEADER_SHAPE.cut(fragment)))
        .withColumn("h", F.when(fragment.isNotNull() & ~plain, F.from_xml(fragment, HEADER_XML, _OPTIONS)))
    )
    raw = _either(plain, plain_header(cut), parsed_header(h))
    fields, problem = typed_header(raw)
    malformed = fragment.isNotNull() & ~plain & (h.isNull() | h["_corrupt_record"].isNotNull())
    return rows, fields, F.when(malformed, F.lit("malformed header")).otherwise(problem)


def _place(seq: str | Column, pos: str | Column) -> Column:
    """The place of a header in its file."""
    seq, pos = (col(c) if isinstance(c, str) else c for c in (seq, pos))
    return F.struct(col("split_start").alias("split"), seq.alias("seq"), pos.alias("pos"))


def _dealt_out(carried: DataFrame) -> DataFrame:
    """The pieces over all tasks, those of a block together and in order, as a file that cannot be split is one task."""
    return carried.repartition(SOURCE_FILE, "split_start", "block_seq")


def parse_pieces(raw: DataFrame, dealt_out: bool = False) -> DataFrame:
    """One row per transaction, block and message, plus rows that only carry facts on a file.

    ``kind`` is T, R, M, L (late fields of a block) or F; ``tx`` and ``head`` hold the converted
    fields. ``group`` and ``block`` are the marks of the headers before the row in its split and
    ``parent`` is the place of the header it belongs to, NULL if there are none.
    """
    value, body = col("value"), col("is_body")
    carried = _carried(_pieces(raw))
    pieces, tx_fields, tx_problem = _parse_transactions(_dealt_out(carried) if dealt_out else carried)
    one_block = col("one_block")
    other = ~body & ~one_block
    between = pieces.withColumn("between", F.when(other, _plain(value)))

    def times(pattern: str, word: str, in_one_block: Column | int = 0) -> Column:
        count = F.size(F.regexp_extract_all("between", F.lit(pattern), F.lit(0)))
        usual = F.when(body, F.lit(0)).when(one_block, in_one_block if isinstance(in_one_block, Column) else F.lit(in_one_block))
        return usual.when(~value.contains(word), F.lit(0)).otherwise(count)

    # Closing tags in front of a single block: one at most, or the file is malformed.
    closed_before = (
        F.octet_length(value) - F.octet_length(F.replace(value, F.lit("</PmtInf>"), F.lit("")))
    ) / len("</PmtInf>")
    # An element name followed by "/>" before any other markup: an empty transaction element.
    self_closed = _guarded(~body, value.rlike(r"^[^<>]*/>"))
    groups = F.filter(
        F.transform(
            col("fragments"),
            lambda f, i: F.when(_is_group(f), F.struct(i.alias("pos"), _mark(f, "MsgId").alias("mark"))),
        ),
        lambda g: g.isNotNull(),
    )
    fragments = F.when(one_block, F.array(_one_block_fragment(value))).when(other, _fragments(col("between")))
    with_late = F.when(col("late").isNotNull(), F.concat("fragments", F.array("late"))).otherwise(col("fragments"))
    rows = (
        between.withColumn("fragments", fragments)
        .withColumn("late", F.when(other, _late_fields(col("between"))))
        .withColumn("fragments", with_late)
        .withColumn("late", F.when(col("late").isNotNull(), F.size("fragments") - 1))
        .withColumn("documents_opened", times(rf"<{PREFIX}Document[\s>]", "Document"))
        .withColumn("documents_closed", times(rf"</{PREFIX}Document\s*>", "Document"))
        .withColumn("blocks_opened", times(rf"<{PREFIX}PmtInf[\s>]", "PmtInf", 1))
        .withColumn("blocks_closed", times(rf"</{PREFIX}PmtInf\s*>", "PmtInf", closed_before.cast("int")))
        .withColumn("tails", col("tail").cast("int"))
        .withColumn("irregular", F.when(self_closed, F.lit(True)).otherwise(col("irregular")))
        .withColumn("groups", F.when(other & value.contains("GrpHdr"), groups))
        .withColumn(
            "between_problem",
            F.when(col("invalid_text"), F.lit("text is not valid UTF-8")).when(
                other & ~col("irregular"), _between_problem(col("between"))
            ),
        )
        .select("*", F.posexplode_outer("fragments").alias("pos", "fragment"))
        .drop("fragments", "between", "value")
        .withColumn("pos", F.coalesce("pos", F.lit(0)))
    )
    rows, head_fields, head_problem = _parse_headers(rows)
    fragment = col("fragment")
    late = F.coalesce(col("pos") == col("late"), F.lit(False))
    kind = (
        F.when(body, F.lit("T")).when(fragment.isNull(), F.lit("F")).when(late, F.lit("L"))
        .when(_is_group(fragment), F.lit("M")).otherwise(F.lit("R"))
    )
    # Groups in the same piece, before this fragment, are nearer than those of earlier pieces.
    nearer = F.when(col("groups").isNotNull(), _last(F.filter(col("groups"), lambda g: g["pos"] < col("pos"))))
    group_place = F.when(nearer.isNotNull(), _place("seq", nearer["pos"])).when(col("group_seq").isNotNull(), _place("group_seq", "group_pos"))
    block_place = F.when(col("block_seq").isNotNull(), _place("block_seq", "block_pos"))
    once = col("pos") == 0
    return rows.select(
        SOURCE_FILE,
        "split_start",
        "seq",
        "pos",
        kind.alias("kind"),
        F.when(fragment.isNotNull(), F.coalesce(nearer["mark"], col("group"))).alias("group"),
        F.when(body, col("block")).alias("block"),
        F.when(body | late, block_place).when(fragment.isNotNull(), group_place).alias("parent"),
        F.when(body, F.struct(*tx_fields)).alias("tx"),
        F.when(fragment.isNotNull(), F.struct(*head_fields)).alias("head"),
        F.coalesce(col("between_problem"), F.when(body, tx_problem).otherwise(head_problem)).alias("problem"),
        *(F.when(once, col(c)).otherwise(F.lit(0)).alias(c) for c in _FACTS),
        "irregular",
    )


# ---- index ---------------------------------------------------------------------------------


def file_states(staged: DataFrame) -> DataFrame:
    """Per file: what makes it unreadable as a whole (NULL if nothing), whether it is irregular, and
    whether blocks of it have late fields."""
    sums = staged.groupBy(SOURCE_FILE).agg(
        *(F.sum(c).alias(c) for c in _FACTS),
        F.bool_or("irregular").alias("irregular"),
        F.bool_or(col("kind") == "L").alias("late"),
        F.min("problem").alias("problem"),
    )
    irregular = col("irregular") | (col("tails") > 1)
    reason = (
        F.when((col("documents_closed") == 0) | (col("documents_opened") != col("documents_closed")),
               F.lit("truncated: document is not closed"))
        .when(col("blocks_opened") != col("blocks_closed"), F.lit("malformed: payment block is not closed"))
        .otherwise(col("problem"))
    )
    return sums.select(
        SOURCE_FILE,
        irregular.alias("irregular"),
        "late",
        F.when(~irregular, reason).alias("reason"),
    )


def split_index(staged: DataFrame, states: DataFrame) -> DataFrame:
    """Per split of a sound file: the headers its first rows inherit from the splits before it.

    One row per split, so the window holds a file's splits, never its transactions.
    """
    place = _place("seq", "pos")

    def last(kind: str, id: str) -> Column:
        return F.max_by(F.struct(col(f"head.{id}").alias("id"), place.alias("place")), F.when(col("kind") == kind, place))

    splits = staged.groupBy(SOURCE_FILE, "split_start").agg(last("M", "msg_id").alias("group"), last("R", "pmt_inf_id").alias("block"))
    earlier = (
        Window.partitionBy(SOURCE_FILE).orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    sound = states.where(~col("irregular") & col("reason").isNull()).select(SOURCE_FILE)
    return splits.join(sound, SOURCE_FILE).select(
        SOURCE_FILE,
        "split_start",
        F.last("group", ignorenulls=True).over(earlier).alias("inherited_group"),
        F.last("block", ignorenulls=True).over(earlier).alias("inherited_block"),
    )


def _with_late_fields(blocks: DataFrame, late: DataFrame) -> DataFrame:
    """Block rows whose ``head`` has the fields that stand after transactions; the last of a field counts."""
    names = [f.name for f in blocks.schema["head"].dataType.fields]
    latest = late.groupBy(SOURCE_FILE, "parent").agg(
        *(F.max_by(col(f"head.{n}"), F.when(col(f"head.{n}").isNotNull(), _place("seq", "pos"))).alias(n) for n in names)
    )
    latest = latest.select(col(SOURCE_FILE).alias("late_file"), col("parent").alias("late_place"), F.struct(*names).alias("late_head"))
    merged = F.struct(*(F.coalesce(col("late_head")[n], col("head")[n]).alias(n) for n in names))
    same = (col(SOURCE_FILE) == col("late_file")) & (col("position") == col("late_place"))
    return blocks.join(latest, same, "left").withColumn("head", merged)


def _tables(staged: DataFrame, index: DataFrame, late: bool = False) -> PaymentTables:
    # Messages and blocks are picked before the join, so each table reads its own columns only.
    def rows(*kinds: str) -> DataFrame:
        return staged.where(col("kind").isin(*kinds)).join(index, [SOURCE_FILE, "split_start"])

    def placed(df: DataFrame, inherited: str) -> DataFrame:
        return df.withColumns({"position": _place("seq", "pos"), "parent": F.coalesce("parent", f"{inherited}.place")})

    group = F.when(col("group").isNotNull(), _marked_id(col("group"))).otherwise(col("inherited_group.id"))
    block = F.when(col("block").isNotNull(), _marked_id(col("block"))).otherwise(col("inherited_block.id"))
    blocks = placed(rows("R"), "inherited_group")
    if late:
        blocks = _with_late_fields(blocks, placed(rows("L"), "inherited_block"))
    return PaymentTables(
        message=rows("M").select(SOURCE_FILE, _place("seq", "pos").alias("position"), *_message(col("head"))),
        remittance=blocks.select(SOURCE_FILE, "position", "parent", group.alias("msg_id"), *_remittance(col("head"))),
        transactions=placed(rows("T"), "inherited_block").select(
            SOURCE_FILE, "parent", block.alias("pmt_inf_id"), *_transaction(col("tx"))
        ),
        located=True,
    )


_MESSAGE_NAMES = {"msg_nb_of_txs": "nb_of_txs", "msg_ctrl_sum": "ctrl_sum"}


def _message(head: Column) -> list[Column]:
    return [head[_MESSAGE_NAMES.get(n, n)].alias(n) for n in schemas.MESSAGE.names]


def _remittance(head: Column) -> list[Column]:
    return [head[n].alias(n) for n in schemas.REMITTANCE.names if n != "msg_id"]


def _transaction(tx: Column) -> list[Column]:
    return [tx[n].alias(n) for n in schemas.TRANSACTIONS.names if n != "pmt_inf_id"]


# ---- irregular files -----------------------------------------------------------------------


def _numbered(raw: DataFrame) -> DataFrame:
    """Pieces with their place in the scan, which ascends within a split."""
    return raw.withColumn("at", F.monotonically_increasing_id())


def _in_order(pieces: DataFrame) -> DataFrame:
    order = (SOURCE_FILE, "split_start", "at")
    return pieces.repartition(SOURCE_FILE, "split_start").sortWithinPartitions(*order)


def _made_whole(raw: DataFrame, files: DataFrame) -> DataFrame:
    """The pieces of ``files``, those that were cut at a tag name that is no tag made whole.

    Each split tells what is open at its end for each thing that may be open at its start; over the
    splits of a file, one narrow row each, that gives what is open where. Then every split joins its own
    pieces, and only what goes on from split to split is put together across them.
    """
    ends = _in_order(_numbered(raw).join(files, SOURCE_FILE, "left_semi")).select("value", SOURCE_FILE, "split_start")
    key = "source_file string, split_start long"
    ends = ends.mapInArrow(split_ends, f"{key}, plain string, comment string, section string")
    starts = write_once(ends.groupBy(SOURCE_FILE).applyInPandas(split_starts, f"{key}, kind string"), "starts")
    pieces = _in_order(_numbered(raw).join(starts, [SOURCE_FILE, "split_start"])).select("value", SOURCE_FILE, "split_start", "kind")
    units = write_once(
        pieces.mapInArrow(partial(rejoin_open, TRANSACTION_TAG), f"value string, {key}, at long, begun boolean, goes_on boolean"), "whole"
    )
    over = col("begun") | col("goes_on")
    chain = Window.partitionBy(SOURCE_FILE).orderBy("split_start", "at")
    first = F.last(F.when(~col("begun"), F.struct("split_start", "at")), ignorenulls=True).over(chain)
    parts = F.array_sort(F.collect_list(F.struct("split_start", "at", "value")))
    joined = (
        units.where(over).withColumn("first", first).groupBy(SOURCE_FILE, "first").agg(parts.alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), TRANSACTION_TAG).alias("value"), SOURCE_FILE, "first.*")
    )
    whole = units.where(~over).select("value", SOURCE_FILE, "split_start", "at").unionByName(joined)
    ordered = _in_order(whole).select("value", SOURCE_FILE, "split_start")
    return ordered.mapInArrow(write_out_empty, f"value string, {key}")


# ---- entry points --------------------------------------------------------------------------


@dataclass(frozen=True)
class PaymentFiles:
    """What was read: the tables of the sound files, and the files that gave none."""

    tables: PaymentTables
    rejects: DataFrame
    staging: tuple[str, ...] = ()

    def discard(self) -> None:
        """Delete the parsed copy of the input, once the tables are stored; ``rejects`` stays readable."""
        for path in self.staging:
            remove(self.rejects.sparkSession, path)

    def scoped(self) -> PaymentFiles:
        """Keys that hold within a file only: nothing is matched across documents."""
        return replace(self, tables=replace(self.tables, scope=(SOURCE_FILE,)))

    def stats(self) -> DataFrame:
        return self.tables.counts()


def together(files: Sequence[PaymentFiles]) -> PaymentFiles:
    """What was read in several turns, as one."""
    first, *others = files
    tables = first.tables.map(lambda name, df: reduce(DataFrame.unionByName, [getattr(f.tables, name) for f in others], df))
    rejects = reduce(DataFrame.unionByName, [f.rejects for f in others], first.rejects)
    return PaymentFiles(tables, rejects, tuple(path for f in files for path in f.staging))


def _few_tasks(raw: DataFrame) -> bool:
    """Whether a scan of few files or splits leaves half of the cores or more without work."""
    return 2 * raw.rdd.getNumPartitions() <= raw.sparkSession.sparkContext.defaultParallelism


def assemble(raw: DataFrame) -> PaymentFiles:
    """Tables from scanned pieces.

    A file in which the transaction tag's name is not always a tag is read a second time with the
    pieces cut there made whole, by as many tasks as it has splits. All of this works on the scanned
    pieces themselves, in batch and in a stream, for any number of files.
    """
    spark = raw.sparkSession
    staging: list[str] = [fresh_path(spark, "staged")]
    try:
        staged = write_at(parse_pieces(raw, _few_tasks(raw)), staging[0])
        states = write_once(file_states(staged), "states")
        irregular, late = states.agg(F.bool_or("irregular"), F.bool_or("late")).first()
        if irregular:
            again = states.where("irregular").select(SOURCE_FILE)
            staging.append(fresh_path(spark, "staged"))
            second = write_at(parse_pieces(_made_whole(raw, again)), staging[1])
            never_closed = F.when(col("irregular"), F.lit("malformed: a comment or CDATA section is not closed"))
            second_states = file_states(second).withColumn("reason", F.coalesce(never_closed, col("reason")))
            states = write_once(states.where(~col("irregular")).unionByName(second_states.withColumn("irregular", F.lit(False))), "states")
            staged = staged.join(again, SOURCE_FILE, "left_anti").unionByName(second)
            late = states.agg(F.bool_or("late")).first()[0]
        index = write_once(split_index(staged, states), "index")
        rejects = states.where(col("reason").isNotNull()).select(SOURCE_FILE, "reason")
        return PaymentFiles(_tables(staged, index, bool(late)), rejects, tuple(staging))
    except BaseException:
        for path in staging:
            remove(spark, path)
        raise


def read(spark: SparkSession, path: str | Sequence[str], mode: str = "QUARANTINE") -> PaymentFiles:
    """Read all documents under ``path``.

    A file may hold one document or several, in any number of splits. With ``FAILFAST`` the
    first unreadable file raises instead of being listed.
    """
    if mode not in ("QUARANTINE", "FAILFAST"):
        raise ValueError(f"mode must be QUARANTINE or FAILFAST, not {mode!r}")
    files = assemble(scan(spark.read, path))
    if mode == "FAILFAST":
        first = files.rejects.head()
        if first:
            files.discard()
            raise ValueError(f"{first[SOURCE_FILE]}: {first['reason']}")
    return files
