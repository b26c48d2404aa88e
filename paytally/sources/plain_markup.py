"""A short way to read markup of a known plain shape.

``from_xml`` builds an event object per tag, which costs most of the time of a read. Nearly
all markup in payment files is plain: the usual elements in the usual order, each at most
once, no attributes but the currency, no prefixes, entities, comments or CDATA. For those one
pattern both proves the shape and captures the texts, in a single match: the piece is replaced
by its captured texts, which a split then separates. Whatever does not match is left to
``from_xml``, so the shape decides speed only, never a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character XML cannot contain, between the captured texts.
SEPARATOR = "\x01"

# An element is (tag, field it fills or None) or (tag, list of child elements). A tag that ends
# in "*" may repeat; with a third part the whole run of them is captured as markup under that
# name. A field named twice takes the later of the two places.
_CODE = "Cd"
_ADDRESS = ["StrtNm", "BldgNb", "PstCd", "TwnNm", "CtrySubDvsn"]


def _party(tag: str, name: str, country: str | None = None):
    address = [*((t, None) for t in _ADDRESS), ("Ctry", country), ("AdrLine*", None)]
    return (tag, [("Nm", name), ("PstlAdr", address)])


def _account(tag: str, iban: str):
    return (tag, [("Id", [("IBAN", iban)]), ("Ccy", None)])


def _agent(tag: str, bic: str):
    return (tag, [("FinInstnId", [("BICFI", bic)])])


_REPORTING = ("RgltryRptg*", [("DbtCdtRptgInd", None), ("Dtls*", [("Cd", None)])], "rglty_rptg_cd")

TRANSACTION = [
    ("PmtId", [("InstrId", "instr_id"), ("EndToEndId", "end_to_end_id"), ("UETR", None)]),
    ("Amt", [("InstdAmt", "instd_amt")]),
    ("ChrgBr", None),
    _agent("CdtrAgt", "cdtr_agt_bicfi"),
    _party("UltmtCdtr", "ultmt_cdtr_nm"),
    _party("Cdtr", "cdtr_nm", "cdtr_ctry"),
    _account("CdtrAcct", "cdtr_acct_iban"),
    _party("UltmtCdtr", "ultmt_cdtr_nm"),
    ("Purp", [(_CODE, "purp_cd")]),
    _REPORTING,
    (
        "RmtInf",
        [
            ("Ustrd*", None, "rmt_inf_ustrd"),
            (
                "Strd*",
                [
                    (
                        "CdtrRefInf",
                        [
                            ("Tp", [("CdOrPrtry", [(_CODE, "rmt_inf_strd_ref_tp")]), ("Issr", None)]),
                            ("Ref", "rmt_inf_strd_ref"),
                        ],
                    )
                ],
            ),
        ],
    ),
    _REPORTING,
]
GROUP = (
    "GrpHdr",
    [
        ("MsgId", "msg_id"),
        ("CreDtTm", "msg_cre_dt_tm"),
        ("NbOfTxs", "nb_of_txs"),
        ("CtrlSum", "ctrl_sum"),
        _party("InitgPty", "msg_initg_pty_nm"),
    ],
)
BLOCK = (
    "PmtInf",
    [
        ("PmtInfId", "pmt_inf_id"),
        ("PmtMtd", "pmt_mtd"),
        ("BtchBookg", "btch_bookg"),
        ("NbOfTxs", "nb_of_txs"),
        ("CtrlSum", "ctrl_sum"),
        (
            "PmtTpInf",
            [
                ("InstrPrty", "instr_prty"),
                ("SvcLvl", [(_CODE, "svc_lvl_cd")]),
                ("LclInstrm", [(_CODE, "lcl_instrm_cd")]),
                ("CtgyPurp", [(_CODE, "ctgy_purp_cd")]),
            ],
        ),
        ("ChrgBr", "chrg_br"),
        ("ReqdExctnDt", [("Dt", "reqd_exctn_dt")]),
        _party("Dbtr", "dbtr_nm"),
        _account("DbtrAcct", "dbtr_acct_iban"),
        _agent("DbtrAgt", "dbtr_agt_bicfi"),
        _party("UltmtDbtr", "ultmt_dbtr_nm"),
        ("ChrgBr", "chrg_br"),
    ],
)

# Captures start with the character before the text, so that an empty text is not a missing one.
# Greedy, as a greedy run of one character class is matched in a tight loop.
_TEXT = r"[^<&\r]*"


class _Builder:
    """Writes a pattern and notes which field each capture fills."""

    def __init__(self):
        self.fields: list[str] = []

    def element(self, tag: str, content) -> tuple[str, bool]:
        repeats = tag.endswith("*")
        tag = tag.rstrip("*")
        if tag == "InstdAmt":
            self.fields += ["ccy", content]
            inner = rf'<{tag}(?: Ccy=("[^"<&\s]*+)")?+(>{_TEXT})</{tag}>'
        elif isinstance(content, list):
            inner = f"<{tag}>{self.sequence(content)}</{tag}>"
        elif content is None:
            inner = f"<{tag}>{_TEXT}</{tag}>"
        else:
            self.fields.append(content)
            inner = f"<{tag}(>{_TEXT})</{tag}>"
        return inner, repeats

    def sequence(self, elements) -> str:
        parts = []
        for tag, content, *run in elements:
            self.fields += run
            inner, repeats = self.element(tag, content)
            part = rf"(?:{inner}\s*+){'*+' if repeats else '?+'}"
            parts.append(f"({part})" if run else part)
        return r"\s*+" + "".join(parts)


@dataclass(frozen=True)
class Shape:
    """A pattern, and the fields its captures fill in order."""

    pattern: str
    fields: tuple[str, ...]

    def cut(self, markup: Column) -> Column:
        """The captured texts of plain markup, after an empty first element; any other markup
        stays in one element."""
        captures = "".join(f"{SEPARATOR}${i}" for i in range(1, len(self.fields) + 1))
        return F.split(F.regexp_replace(markup, F.lit(self.pattern), F.lit(captures)), SEPARATOR)

    @staticmethod
    def is_plain(cut: Column) -> Column:
        return F.coalesce(F.size(cut) > 1, F.lit(False))

    def _places(self, cut: Column, field: str) -> list[Column]:
        return [cut[i + 1] for i, name in enumerate(self.fields) if name == field]

    def text(self, cut: Column, field: str) -> Column:
        """The text of ``field`` in a cut; NULL when its element is missing."""
        found = [F.when(p != "", F.substr(p, F.lit(2))) for p in reversed(self._places(cut, field))]
        return F.coalesce(*found) if len(found) > 1 else found[0]

    def lines(self, cut: Column, field: str) -> Column:
        """The texts of a captured run, trimmed, blank ones left out, one per line.

        All markup between two texts, with the white space around it, becomes one mark.
        """
        places = self._places(cut, field)
        run = F.concat(*places) if len(places) > 1 else places[0]
        flagged = run.contains("<DbtCdtRptgInd>")
        run = F.when(flagged, F.regexp_replace(run, "<DbtCdtRptgInd>[^<]*</DbtCdtRptgInd>", "")).otherwise(run)
        marked = F.regexp_replace(run, r"<[^>]*>(?:\s*<[^>]*>)*\s*", SEPARATOR)
        spaced = run.contains(" <") | run.contains("\n<") | run.contains("\t<")
        marked = F.when(spaced, F.regexp_replace(marked, rf"\s+{SEPARATOR}", SEPARATOR)).otherwise(marked)
        return F.replace(F.btrim(marked, F.lit(SEPARATOR)), F.lit(SEPARATOR), F.lit("\n"))


def _transaction_shape() -> Shape:
    build = _Builder()
    return Shape(rf"^>{build.sequence(TRANSACTION)}</\z", tuple(build.fields))


def _header_shape() -> Shape:
    build = _Builder()
    group, _ = build.element(*GROUP)
    block, _ = build.element(*BLOCK)
    return Shape(rf"^(?:{group}|{block})\z", tuple(build.fields))


TRANSACTION_SHAPE = _transaction_shape()
HEADER_SHAPE = _header_shape()
