"""The expected result of each catalogued query, as SQL for another engine.

The tables are the fixture views, written out as common table expressions; the statements
below them state each rule the plain way, join first and aggregate later.
"""

from __future__ import annotations

from paytally import fixtures, generate, schemas

_WITH = "with " + fixtures.ctes("varchar", "hugeint")


def _q(select: str, extra: str = "") -> str:
    return f"{_WITH}{', ' + extra if extra else ''}\n{select}"


_IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"


def _mod97(x: str) -> str:
    moved = f"string_split(upper(substr({x}, 5) || substr({x}, 1, 4)), '')"
    codes = f"list_transform({moved}, lambda ch: case when ascii(ch) < 58 then ascii(ch) - 48 else ascii(ch) - 55 end)"
    rest = (
        f"list_reduce(list_prepend(0::bigint, {codes}), "
        "lambda acc, v: (acc * case when v < 10 then 10 else 100 end + v) % 97)"
    )
    return f"(case when regexp_full_match(coalesce({x}, ''), '[A-Za-z0-9]{{5,34}}') then {rest} = 1 else false end)"


def _bic(x: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), '[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?')"


def _ccy(x: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), '[A-Z]{{3}}')"


def _blank(x: str) -> str:
    return f"(trim(coalesce({x}, '')) = '')"


def _offset(x: str) -> str:
    shape = (
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]*)?)?"
        r"(Z|[+-](0[0-9]|1[0-8]):[0-5][0-9](:[0-5][0-9])?)"
    )
    return (
        f"(regexp_full_match(coalesce({x}, ''), '{shape}') "
        f"and try_cast(substr({x}, 1, 10) as date) is not null)"
    )


_D = "decimal(38,5)"

_CTRL_REMITTANCE = f"""
select r.pmt_inf_id as id, cast(r.ctrl_sum as {_D}) as declared, cast(sum(t.instd_amt) as {_D}) as actual
from remittance r join transactions t on r.pmt_inf_id = t.pmt_inf_id
where r.ctrl_sum is not null
group by r.pmt_inf_id, r.ctrl_sum
having abs(cast(r.ctrl_sum as double) - cast(sum(t.instd_amt) as double)) > 0.001
"""

_CTRL_MESSAGE = f"""
select m.msg_id as id, cast(m.msg_ctrl_sum as {_D}) as declared, cast(sum(t.instd_amt) as {_D}) as actual
from message m join remittance r on m.msg_id = r.msg_id join transactions t on r.pmt_inf_id = t.pmt_inf_id
group by m.msg_id, m.msg_ctrl_sum
having abs(cast(m.msg_ctrl_sum as double) - cast(sum(t.instd_amt) as double)) > 0.001
"""

_NB_REMITTANCE = f"""
select r.pmt_inf_id as id, cast(cast(r.nb_of_txs as bigint) as {_D}) as declared,
  cast(count(t.end_to_end_id) as {_D}) as actual
from remittance r left join transactions t on r.pmt_inf_id = t.pmt_inf_id
group by r.pmt_inf_id, r.nb_of_txs
having cast(r.nb_of_txs as bigint) <> count(t.end_to_end_id)
"""

_NB_MESSAGE = f"""
select m.msg_id as id, cast(cast(m.msg_nb_of_txs as bigint) as {_D}) as declared,
  cast(count(t.end_to_end_id) as {_D}) as actual
from message m left join remittance r on m.msg_id = r.msg_id left join transactions t on r.pmt_inf_id = t.pmt_inf_id
group by m.msg_id, m.msg_nb_of_txs
having cast(m.msg_nb_of_txs as bigint) <> count(t.end_to_end_id)
"""

_BLOCK_SUMS = "sums as (select pmt_inf_id, sum(instd_amt) s, count(*) c from transactions where pmt_inf_id is not null group by 1)"
_MESSAGE_SUMS = (
    "msums as (select r.msg_id, sum(s.s) s, sum(s.c) c from remittance r join sums s on s.pmt_inf_id = r.pmt_inf_id "
    "where r.msg_id is not null group by 1)"
)


def _exact(table: str, id: str, declared: str, sums: str, actual: str) -> str:
    test = "abs(d - a) > 0.001" if actual == "s" else "d <> a"
    return f"""
select id, cast(d as {_D}) as declared, cast(a as {_D}) as actual from (
  select x.{id} as id, {declared} as d, coalesce(y.{actual}, 0) as a
  from {table} x left join {sums} y on y.{id} = x.{id} where x.{id} is not null)
where d is not null and {test}
"""


def _findings(validator: str, rows: list[tuple[str, str, str, str, str, str]]) -> str:
    """Union of (rule, severity, id, message, source, condition)."""
    parts = [
        f"select '{validator}' as validator, '{severity}' as severity, '{rule}' as rule, {id} as id, {message} as message "
        f"from {source} where {condition}"
        for rule, severity, id, message, source, condition in rows
    ]
    return "\nunion all\n".join(parts)


_FIELD_RULES = {
    "msg_id_too_long": ("ERROR", "msg_id", "'MsgId exceeds maximum length of 35 characters'", "message", "length(msg_id) > 35"),
    "initiating_party_missing": (
        "WARNING", "msg_id", "'Initiating party (InitgPty) is missing'", "message",
        "msg_initg_pty_nm is null or msg_initg_pty_nm = ''",
    ),
    "creation_time_missing": (
        "ERROR", "msg_id", "'Creation date/time (CreDtTm) is required but missing'", "message",
        "msg_cre_dt_tm is null or msg_cre_dt_tm = ''",
    ),
    "iban_format_invalid": (
        "ERROR", "pmt_inf_id", "'Invalid IBAN format: ' || dbtr_acct_iban", "remittance",
        f"not regexp_matches(dbtr_acct_iban, '{_IBAN}')",
    ),
    "payment_method_missing": (
        "ERROR", "pmt_inf_id", "'Payment method is required'", "remittance", "pmt_mtd is null or pmt_mtd = ''",
    ),
    "payment_method_unknown": (
        "ERROR", "pmt_inf_id", "'Payment method is not one of TRF, CHK'", "remittance",
        "pmt_mtd is null or pmt_mtd not in ('TRF', 'CHK')",
    ),
    "amount_not_positive": (
        "ERROR", "end_to_end_id",
        "'Amount must be positive: PmtInfId=' || pmt_inf_id || ', Amount=' || cast(instd_amt as varchar)",
        "transactions", "instd_amt <= 0",
    ),
    "amount_not_positive_strict": (
        "ERROR", "end_to_end_id", "'Transaction amount must be greater than 0'", "transactions",
        "instd_amt is null or instd_amt <= 0",
    ),
    "creditor_missing": (
        "ERROR", "end_to_end_id", "'Creditor name is required: PmtInfId=' || pmt_inf_id", "transactions",
        "cdtr_nm is null or cdtr_nm = ''",
    ),
}

_VALIDATOR_OF = {
    "msg_id_too_long": "MessageValidator",
    "initiating_party_missing": "MessageValidator",
    "creation_time_missing": "MessageValidator",
    "iban_format_invalid": "RemittanceValidator",
    "payment_method_missing": "RemittanceValidator",
    "payment_method_unknown": "RemittanceValidator",
    "amount_not_positive": "TransactionValidator",
    "amount_not_positive_strict": "StreamingTransactionIteratorValidator",
    "creditor_missing": "TransactionValidator",
}


def _rules(*names: str, validator: str | None = None) -> str:
    return "\nunion all\n".join(
        _findings(validator or _VALIDATOR_OF[n], [(n, *_FIELD_RULES[n])]) for n in names
    )


_DOMAIN_MESSAGE = _findings(
    "MessageDomainValidator",
    [
        ("msg_id_blank", "ERROR", "msg_id", "'messageId must not be blank'", "message", _blank("msg_id")),
        ("msg_id_too_long", "ERROR", "msg_id", "'messageId exceeds max length 35'", "message",
         f"not {_blank('msg_id')} and length(msg_id) > 35"),
        ("initiating_party_blank", "ERROR", "msg_id", "'initiatingParty must not be blank'", "message",
         _blank("msg_initg_pty_nm")),
        ("creation_time_blank", "ERROR", "msg_id", "'creationDateTime must not be blank'", "message",
         _blank("msg_cre_dt_tm")),
        ("creation_time_invalid", "ERROR", "msg_id", "'creationDateTime is not a valid ISO 8601 offset datetime'",
         "message", f"not {_blank('msg_cre_dt_tm')} and not {_offset('msg_cre_dt_tm')}"),
    ],
)

_UNDER = "remittance r join message m on m.msg_id = r.msg_id"
_DOMAIN_REMITTANCE = _findings(
    "RemittanceDomainValidator",
    [
        ("debtor_iban_invalid", "ERROR", "r.pmt_inf_id", "'Invalid debtor IBAN'", _UNDER,
         f"not {_mod97('r.dbtr_acct_iban')}"),
        ("debtor_bic_invalid", "ERROR", "r.pmt_inf_id", "'Invalid debtor agent BIC'", _UNDER,
         f"not {_bic('r.dbtr_agt_bicfi')}"),
        ("execution_date_missing", "ERROR", "r.pmt_inf_id", "'requestedExecutionDate must not be null'", _UNDER,
         "r.reqd_exctn_dt is null"),
    ],
)

_DEEP = f"transactions t join remittance r on r.pmt_inf_id = t.pmt_inf_id join message m on m.msg_id = r.msg_id"
_DOMAIN_TRANSACTION = _findings(
    "TransactionDomainValidator",
    [
        ("currency_invalid", "ERROR", "t.end_to_end_id", "'Invalid currency code'", _DEEP, f"not {_ccy('t.ccy')}"),
        ("amount_invalid", "ERROR", "t.end_to_end_id", "'Instructed amount must be > 0'", _DEEP,
         f"{_ccy('t.ccy')} and not coalesce(t.instd_amt > 0, false)"),
        ("creditor_bic_invalid", "ERROR", "t.end_to_end_id", "'Invalid creditor agent BIC'", _DEEP,
         f"not {_bic('t.cdtr_agt_bicfi')}"),
        ("creditor_iban_invalid", "ERROR", "t.end_to_end_id", "'Invalid creditor IBAN'", _DEEP,
         f"not {_mod97('t.cdtr_acct_iban')}"),
        ("creditor_blank", "ERROR", "t.end_to_end_id", "'Creditor name must not be blank'", _DEEP,
         _blank("t.cdtr_nm")),
    ],
)

_VALID_TX = f"{_ccy('ccy')} and instd_amt > 0"
_DOMAIN_SUM_CTES = f"""
vt as (select pmt_inf_id, sum(instd_amt) s from transactions where {_VALID_TX} group by 1),
blocks as (select r.msg_id, r.pmt_inf_id, r.ctrl_sum d, coalesce(vt.s, 0) a
           from remittance r left join vt on vt.pmt_inf_id = r.pmt_inf_id),
grand as (select msg_id, sum(a) a from blocks where d >= 0 group by 1)
"""
_DOMAIN_SUMS = f"""
select rule, id, cast(d as {_D}) as declared, cast(a as {_D}) as actual from (
  select 'ctrl_sum_remittance_invalid' as rule, b.pmt_inf_id as id, b.d, null as a
    from blocks b join message m on m.msg_id = b.msg_id
    where m.msg_ctrl_sum >= 0 and (b.d is null or b.d < 0)
  union all
  select 'ctrl_sum_remittance_mismatch', b.pmt_inf_id, b.d, b.a
    from blocks b join message m on m.msg_id = b.msg_id
    where m.msg_ctrl_sum >= 0 and b.d >= 0 and abs(round(b.d, 2) - round(b.a, 2)) >= 0.005
  union all
  select 'ctrl_sum_message_invalid', m.msg_id, m.msg_ctrl_sum, null
    from message m where m.msg_ctrl_sum is null or m.msg_ctrl_sum < 0
  union all
  select 'ctrl_sum_message_mismatch', m.msg_id, m.msg_ctrl_sum, coalesce(g.a, 0)
    from message m left join grand g on g.msg_id = m.msg_id
    where m.msg_ctrl_sum >= 0 and abs(round(m.msg_ctrl_sum, 2) - round(coalesce(g.a, 0), 2)) >= 0.005)
"""

_STANDARD_FIELD = _rules(
    "msg_id_too_long", "initiating_party_missing", "creation_time_missing", "iban_format_invalid",
    "payment_method_missing", "amount_not_positive", "creditor_missing",
)


def _counted(validator: str, rule: str, query: str) -> str:
    return (
        f"select '{validator}' as validator, 'ERROR' as severity, '{rule}' as rule, id, declared, actual from ({query})"
    )


_STANDARD = "\nunion all\n".join(
    [
        f"select validator, severity, rule, id, cast(null as {_D}) as declared, cast(null as {_D}) as actual "
        f"from ({_STANDARD_FIELD}) where rule <> 'amount_not_positive'",
        f"select 'TransactionValidator', 'ERROR', 'amount_not_positive', end_to_end_id, cast(null as {_D}), "
        f"cast(instd_amt as {_D}) from transactions where instd_amt <= 0",
        _counted("ControlSumValidator", "ctrl_sum_remittance", _CTRL_REMITTANCE),
        _counted("ControlSumValidator", "ctrl_sum_message", _CTRL_MESSAGE),
        _counted("NumberOfTransactionsValidator", "nb_txs_remittance", _NB_REMITTANCE),
        _counted("NumberOfTransactionsValidator", "nb_txs_message", _NB_MESSAGE),
    ]
)

_STANDARD_EXACT_CTES = f"{_BLOCK_SUMS}, {_MESSAGE_SUMS}"
_LONG = "case when regexp_full_match({0}, '[+-]?[0-9]+') then try_cast({0} as bigint) end"


def _exact_queries() -> dict[str, str]:
    return {
        "ctrl_sum_remittance_exact": _exact("remittance", "pmt_inf_id", "x.ctrl_sum", "sums", "s"),
        "ctrl_sum_message_exact": _exact("message", "msg_id", "x.msg_ctrl_sum", "msums", "s"),
        "nb_txs_remittance_exact": _exact("remittance", "pmt_inf_id", _LONG.format("x.nb_of_txs"), "sums", "c"),
        "nb_txs_message_exact": _exact("message", "msg_id", _LONG.format("x.msg_nb_of_txs"), "msums", "c"),
    }


def _compared_text(level: str, what: str, shown: str, query: str) -> str:
    """Findings of a reconciliation with their text."""
    validator = "ControlSumValidator" if what == "CtrlSum" else "NumberOfTransactionsValidator"
    return (
        f"select '{validator}' as validator, '{level} {what} mismatch: declared=' || cast(cast(declared as {shown}) as varchar) "
        f"|| ', actual=' || cast(cast(actual as {shown}) as varchar) as message, id from ({query})"
    )


_FIRST_ERRORS = f"""
select validator, message, id from (
  select validator, message, id from ({_STANDARD_FIELD}) where severity = 'ERROR'
  union all {_compared_text("Remittance", "CtrlSum", "double", _CTRL_REMITTANCE)}
  union all {_compared_text("Message", "CtrlSum", "double", _CTRL_MESSAGE)}
  union all {_compared_text("Remittance", "NbOfTxs", "bigint", _NB_REMITTANCE)}
  union all {_compared_text("Message", "NbOfTxs", "bigint", _NB_MESSAGE)})
order by validator nulls first, id nulls first, message nulls first limit 10
"""


def _texts(schema, skip=()) -> str:
    """A select list with texts trimmed, as element text is, and dates as text."""
    parts = []
    for field in schema.fields:
        kind = field.dataType.typeName()
        if kind == "date":
            parts.append(f"cast({field.name} as varchar) as {field.name}")
        elif kind == "string" and field.name not in skip:
            parts.append(f"trim({field.name}, ' ' || chr(9) || chr(10) || chr(13)) as {field.name}")
        else:
            parts.append(field.name)
    return ", ".join(parts)


def _plain(schema) -> str:
    return ", ".join(
        f"cast({f.name} as varchar) as {f.name}" if f.dataType.typeName() == "date" else f.name for f in schema.fields
    )


def _cycle(values: tuple[str, ...], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"[{items}][1 + {index} % {len(values)}]"


def _generated() -> dict[str, str]:
    pairs = "pairs as (select l_orderkey as b, cast(l_linenumber as bigint) as t from lineitem)"
    name = _cycle(generate.CREDITOR_NAMES, "t")
    transactions = f"""
select printf('PMT-%06d', b + 1) as pmt_inf_id, printf('INSTR-%06d-%07d', b + 1, t + 1) as instr_id,
  printf('E2E-%06d-%07d', b + 1, t + 1) as end_to_end_id, cast(100 as decimal(18,5)) as instd_amt, 'EUR' as ccy,
  {_cycle(generate.CREDITOR_BICS, "t")} as cdtr_agt_bicfi, {name} as cdtr_nm,
  {_cycle(generate.CREDITOR_IBANS, "t")} as cdtr_acct_iban,
  printf('Invoice PMT%06d-TX%07d', b + 1, t + 1) || chr(10) || 'Ref ' || replace({name}, ' ', '-') || '/'
    || cast(t + 1 as varchar) as rmt_inf_ustrd,
  {_cycle(generate.REGULATORY_CODES, "t")} || chr(10) || {_cycle(generate.REGULATORY_CODES, "(t + 1)")} as rglty_rptg_cd,
  printf('REF%06d%07d', b + 1, t + 1) as rmt_inf_strd_ref, 'SCOR' as rmt_inf_strd_ref_tp,
  {_cycle(generate.PURPOSES, "t")} as purp_cd, 'Ultimate ' || {name} as ultmt_cdtr_nm,
  {_cycle(generate.CREDITOR_COUNTRIES, "t")} as cdtr_ctry
from pairs"""
    blocks = f"""
select '{generate.MESSAGE_ID}' as msg_id, printf('PMT-%06d', b + 1) as pmt_inf_id, 'TRF' as pmt_mtd,
  cast(n as varchar) as nb_of_txs, cast(100 * n as decimal(18,2)) as ctrl_sum, 'SEPA' as svc_lvl_cd,
  '{generate.EXECUTED}' as reqd_exctn_dt, 'Debtor Company ' || cast(b + 1 as varchar) as dbtr_nm,
  {_cycle(generate.DEBTOR_IBANS, "b")} as dbtr_acct_iban, {_cycle(generate.DEBTOR_BICS, "b")} as dbtr_agt_bicfi,
  'false' as btch_bookg, case when b % 3 = 0 then 'HIGH' else 'NORM' end as instr_prty, 'CORE' as lcl_instrm_cd,
  {_cycle(generate.CATEGORY_PURPOSES, "b")} as ctgy_purp_cd, 'SLEV' as chrg_br,
  'Ultimate Debtor ' || cast(b + 1 as varchar) as ultmt_dbtr_nm
from (select b, count(*) as n from pairs group by b)"""
    return {
        "generated_transactions": f"with {pairs} {transactions}",
        "generated_blocks": f"with {pairs} {blocks}",
        "generated_wrong_sums": f"with {pairs} select 'ControlSumValidator' as validator, 'ERROR' as severity, "
        "count(distinct b) + 1 as n from pairs",
        "generated_right_sums": "select 0 as errors, 0 as warnings, true as passed from (select count(*) as n from lineitem)",
    }


_HANGING = (
    "blocks as (select r.* from remittance r where r.msg_id in (select msg_id from message)), "
    "txs as (select t.* from transactions t join blocks b on b.pmt_inf_id = t.pmt_inf_id)"
)


def _documents() -> dict[str, str]:
    number = "cast(right(msg_id, 10) as bigint)"
    damaged = """case bucket % 10 when 1 then 'truncated' when 2 then 'bad CtrlSum' when 3 then if(amounts > 0, 'bad InstdAmt', null)
  when 4 then if(dates > 0, 'bad ReqdExctnDt', null) when 5 then 'malformed header' when 6 then if(coded > 0, 'malformed transaction', null)
  when 7 then 'malformed markup between transactions' when 8 then 'malformed' end"""
    return {
        "xml_roundtrip_message": _q(f"select {_texts(schemas.MESSAGE)} from message"),
        "xml_roundtrip_remittance": _q(f"select {_texts(schemas.REMITTANCE)} from blocks", _HANGING),
        "xml_roundtrip_transaction": _q(f"select {_texts(schemas.TRANSACTIONS)} from txs", _HANGING),
        "xml_repeated_elements": _q(
            "select coalesce(len(string_split(rmt_inf_ustrd, chr(10))), 0) as ustrd_lines, "
            "coalesce(len(string_split(rglty_rptg_cd, chr(10))), 0) as code_lines, count(*) as n from txs group by 1, 2",
            _HANGING,
        ),
        "xml_quarantine": _q(
            f"select bucket, case when {damaged} is null then n end as messages, {damaged} as reason "
            "from files left join dated using (bucket) left join paid using (bucket)",
            f"{_HANGING}, files as (select {number} // 24 as bucket, count(*) as n from message group by 1), "
            f"dated as (select {number} // 24 as bucket, count(reqd_exctn_dt) as dates from blocks group by 1), "
            f"paid as (select {number.replace('msg_id', 'b.msg_id')} // 24 as bucket, count(t.instd_amt) as amounts, "
            "count(coalesce(cast(t.instd_amt as varchar), t.ccy)) as coded from transactions t join blocks b using (pmt_inf_id) group by 1)",
        ),
        "xml_late_fields": _q(f"select {_texts(schemas.REMITTANCE)} from blocks", _HANGING),
        "xml_last_values": _q(
            "select pmt_inf_id, instr_id, rmt_inf_strd_ref, coalesce(rmt_inf_strd_ref_tp, 'EARLIER') as rmt_inf_strd_ref_tp from txs", _HANGING
        ),
        "repeated_blocks_roundtrip": _q(
            "select b.msg_id, b.dbtr_acct_iban, 'BLOCK-' || cast(cast(right(b.pmt_inf_id, 10) as bigint) % 2 as varchar) as pmt_inf_id, "
            f"count(t.pmt_inf_id) as n, cast(sum(t.instd_amt) as {_D}) as total "
            "from blocks b left join transactions t on t.pmt_inf_id = b.pmt_inf_id group by b.msg_id, b.dbtr_acct_iban, b.pmt_inf_id",
            _HANGING,
        ),
        "last_declaration": _q(
            f"select msg_id, cast(case when {number} % 3 = 1 then msg_ctrl_sum + 1 else msg_ctrl_sum end as decimal(18,2)) as ctrl_sum, "
            "cast(msg_nb_of_txs as bigint) as nb_of_txs from message"
        ),
        "clustered_lookup": _q("select * from transactions where pmt_inf_id = 'PMT-0000000001'"),
        "kept_tables": _q(
            "select (select count(*) from message) as message_rows, (select count(*) from remittance) as remittance_rows, "
            "(select count(*) from transactions) as transaction_rows"
        ),
        "parse_stats": _q(
            "select (select count(*) from message) as message_rows, (select count(*) from blocks) as remittance_rows, "
            "(select count(*) from txs) as transaction_rows",
            _HANGING,
        ),
        "ingest_report": _q(
            "select 'message_rows' as metric, (select count(*) from message) as value union all "
            "select 'remittance_rows', (select count(*) from blocks) union all "
            "select 'transaction_rows', (select count(*) from txs) union all select 'rejected_files', 0",
            _HANGING,
        ),
        "arrow_roundtrip_message": _q(f"select {_plain(schemas.MESSAGE)} from message"),
        "arrow_roundtrip_remittance": _q(f"select {_plain(schemas.REMITTANCE)} from remittance"),
        "arrow_roundtrip_transaction": _q(f"select {_plain(schemas.TRANSACTIONS)} from transactions"),
        "table_append": _q(
            f"select ccy, 2 * count(*) as n, cast(2 * sum(instd_amt) as {_D}) as total from transactions group by ccy"
        ),
        "projected_scan": _q("select end_to_end_id, instd_amt, cdtr_nm from transactions"),
        "stream_irregular": _q(f"select {_texts(schemas.TRANSACTIONS)} from txs", _HANGING),
        "scoped_roundtrip": _q(
            f"select end_to_end_id, 3 * count(*) as n, cast(3 * sum(instd_amt) as {_D}) as total from txs group by 1", _HANGING
        ),
        "stream_ingest": _q(f"select {_texts(schemas.TRANSACTIONS)} from txs", _HANGING),
        # Element text is trimmed on the way in, so a blank creditor name arrives empty.
        "stream_checks": _q(_STANDARD.replace("cdtr_nm = ''", "trim(cdtr_nm) = ''")),
    }


def queries() -> dict[str, str]:
    out = {name: _q(_rules(name)) for name in _FIELD_RULES}
    out |= _documents() | _generated()
    out["field_checks"] = _q(_STANDARD_FIELD)
    out["parallel_transaction_check"] = _q(
        _rules("amount_not_positive", "creditor_missing", validator="ParallelTransactionValidator")
    )
    out["invalid_iban_list"] = _q(
        f"select dbtr_acct_iban from remittance where not regexp_matches(dbtr_acct_iban, '{_IBAN}')"
    )
    out["row_check_counts"] = _q(
        "select count(*) as rows_inspected, count(*) filter (instd_amt is null or instd_amt <= 0) as errors from transactions"
    )
    out["remittances_of_message"] = _q(
        "select * replace (cast(reqd_exctn_dt as varchar) as reqd_exctn_dt) from remittance where msg_id = 'MSG-0000000001'"
    )
    out["transactions_of_remittance"] = _q("select * from transactions where pmt_inf_id = 'PMT-0000000001'")

    out["ctrl_sum_remittance"] = _q(_CTRL_REMITTANCE)
    out["ctrl_sum_message"] = _q(_CTRL_MESSAGE)
    out["nb_txs_remittance"] = _q(_NB_REMITTANCE)
    out["nb_txs_message"] = _q(_NB_MESSAGE)
    for name, sql in _exact_queries().items():
        out[name] = _q(sql, _STANDARD_EXACT_CTES)

    out["sum_of_remittance"] = _q(
        f"select cast(coalesce(sum(instd_amt), 0) as {_D}) as total from transactions where pmt_inf_id = 'PMT-0000000001'"
    )
    out["remittance_count"] = _q("select count(*) as n from remittance")
    out["transaction_count"] = _q("select count(*) as n from transactions")
    out["total_amount"] = _q(f"select cast(coalesce(sum(instd_amt), 0) as {_D}) as total from transactions")
    out["message_summary"] = _q(
        """select 'msg_id=' || coalesce(msg_id, 'null') || ', cre_dt_tm=' || coalesce(msg_cre_dt_tm, 'null')
  || ', nb_of_txs=' || coalesce(msg_nb_of_txs, 'null') || ', ctrl_sum=' || coalesce(cast(msg_ctrl_sum as varchar), 'null')
  || ', initg_pty_nm=' || coalesce(msg_initg_pty_nm, 'null') as summary from message order by msg_id limit 1"""
    )
    out["table_counts"] = _q(
        """select (select count(*) from message) as message_rows, (select count(*) from remittance) as remittance_rows,
  (select count(*) from transactions) as transaction_rows"""
    )

    out["iban_mod97"] = _q(f"select pmt_inf_id, {_mod97('dbtr_acct_iban')} as valid from remittance")
    out["bic_valid"] = _q(f"select cdtr_agt_bicfi, {_bic('cdtr_agt_bicfi')} as valid, count(*) as n from transactions group by 1, 2")
    out["currency_valid"] = _q(f"select ccy, {_ccy('ccy')} as valid, count(*) as n from transactions group by 1, 2")
    out["offset_datetime_valid"] = _q(f"select msg_id, {_offset('msg_cre_dt_tm')} as valid from message")

    out["domain_message"] = _q(_DOMAIN_MESSAGE)
    out["domain_remittance"] = _q(_DOMAIN_REMITTANCE)
    out["domain_transaction"] = _q(_DOMAIN_TRANSACTION)
    out["domain_control_sum"] = _q(_DOMAIN_SUMS, _DOMAIN_SUM_CTES)

    out["amount_by_currency"] = _q(
        f"select pmt_inf_id, ccy, cast(sum(instd_amt) as {_D}) as total, count(*) as n from transactions where {_VALID_TX} group by 1, 2"
    )
    out["mixed_currency_blocks"] = _q(
        f"select pmt_inf_id, min(ccy) as first_ccy, max(ccy) as last_ccy from transactions where {_VALID_TX} "
        "group by 1 having count(distinct ccy) > 1"
    )

    out["standard_suite"] = out["standard_suite_lazy"] = _q(_STANDARD)
    out["standard_suite_summary"] = _q(
        f"select validator, severity, count(*) as n from ({_STANDARD}) group by 1, 2"
    )
    out["standard_suite_totals"] = _q(
        "select count(*) filter (severity = 'ERROR') as errors, count(*) filter (severity = 'WARNING') as warnings, "
        f"count(*) filter (severity = 'ERROR') = 0 as passed from ({_STANDARD})"
    )
    exact_rows = "\nunion all\n".join(
        _counted("ControlSumValidator" if n.startswith("ctrl") else "NumberOfTransactionsValidator",
                 n.removesuffix("_exact"), sql)
        for n, sql in _exact_queries().items()
    )
    strict = (
        f"select validator, severity, rule, id, cast(null as {_D}) as declared, cast(null as {_D}) as actual "
        f"from ({_STANDARD_FIELD}) where rule <> 'amount_not_positive' union all "
        f"select 'TransactionValidator', 'ERROR', 'amount_not_positive', end_to_end_id, cast(null as {_D}), "
        f"cast(instd_amt as {_D}) from transactions where instd_amt is null or instd_amt <= 0"
    )
    out["standard_suite_exact"] = _q(f"{strict}\nunion all\n{exact_rows}", _STANDARD_EXACT_CTES)
    out["created_tables"] = _q(f"select ccy, count(*) as n, cast(sum(instd_amt) as {_D}) as total from transactions group by ccy")
    out["saved_tables"] = out["table_counts"]
    out["batch_callbacks"] = out["parse_stats"]
    out["row_callbacks"] = out["transaction_count"]
    out["dataset_names"] = (
        "select page_id, regexp_replace(string_split(url || '.XML', '/')[-1], '(?i)\\.xml$', '') as dataset from pages"
    )
    out["failing_check"] = (
        f"select * from ({out['standard_suite_summary']}) union all select 'Broken' as validator, 'ERROR' as severity, 1 as n"
    )
    out["first_errors"] = _q(_FIRST_ERRORS)
    out["chained_checks"] = _q(_rules("iban_format_invalid", "payment_method_missing", "amount_not_positive", "creditor_missing"))
    domain_rows = "\nunion all\n".join(
        f"select validator, severity from ({q})" for q in (_DOMAIN_MESSAGE, _DOMAIN_REMITTANCE, _DOMAIN_TRANSACTION)
    )
    out["domain_suite_summary"] = _q(
        f"select validator, severity, count(*) as n from ({domain_rows} union all "
        f"select 'ControlSumDomainService', 'ERROR' from ({_DOMAIN_SUMS})) group by 1, 2",
        _DOMAIN_SUM_CTES,
    )
    return out
