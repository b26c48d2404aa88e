"""The benchmark tables seen as payments: messages from customers, blocks from orders,
transactions from line items, with defects at fixed key moduli.

The same text runs on Spark and, for the expected results, on another SQL engine; only the
names of two types differ. ``{S}`` is the text type, ``{H}`` the wide integer type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paytally.tables import PaymentTables


def _iban(key: str) -> str:
    """A valid account number made from ``key``: check digits over a fixed bank code."""
    account = f"lpad(cast({key} as {{S}}), 10, '0')"
    check = f"98 - cast(cast(concat('37040044', {account}, '131400') as {{H}}) % 97 as int)"
    return f"concat('DE', lpad(cast({check} as {{S}}), 2, '0'), '37040044', {account})"


def _msg_id(key: str) -> str:
    return f"concat('MSG-', lpad(cast({key} as {{S}}), case when {key} % 73 = 0 then 40 else 10 end, '0'))"


def _pmt_id(key: str) -> str:
    return f"concat('PMT-', lpad(cast({key} as {{S}}), 10, '0'))"


TRANSACTIONS_SQL = f"""
select {_pmt_id('l_orderkey')} as pmt_inf_id,
  case when l_linenumber = 6 then null
       else concat('INSTR-', cast(l_orderkey as {{S}}), '-', cast(l_partkey as {{S}})) end as instr_id,
  case when l_partkey % 97 = 0 then null
       else concat('E2E-', cast(l_orderkey as {{S}}), '-', cast(l_linenumber as {{S}}), '-', cast(l_partkey as {{S}})) end as end_to_end_id,
  case when l_partkey % 89 = 0 then cast(0 as decimal(18,5))
       when l_partkey % 83 = 0 then null
       when l_partkey % 79 = 0 then cast(-l_extendedprice as decimal(18,5))
       else cast(l_extendedprice as decimal(18,5)) end as instd_amt,
  case when l_suppkey % 31 = 0 then 'eur' when l_suppkey % 3 = 0 then 'USD' else 'EUR' end as ccy,
  case when l_suppkey % 29 = 0 then 'BAD' when l_suppkey % 37 = 0 then null
       when l_suppkey % 2 = 0 then 'COBADEFF' else 'BNPAFRPPXXX' end as cdtr_agt_bicfi,
  case when l_partkey % 101 = 0 then '' when l_partkey % 103 = 0 then null
       when l_partkey % 107 = 0 then '  ' else concat('Creditor ', cast(l_suppkey as {{S}})) end as cdtr_nm,
  case when l_suppkey % 41 = 0 then concat('XX', {_iban('l_suppkey')}) else {_iban('l_suppkey')} end as cdtr_acct_iban,
  case when l_linenumber = 5 then null
       when l_linenumber = 4 then concat('Invoice ', cast(l_partkey as {{S}}))
       else concat('Invoice ', cast(l_partkey as {{S}}), chr(10), 'Ref ', cast(l_suppkey as {{S}})) end as rmt_inf_ustrd,
  case when l_returnflag = 'A' then 'RESIDENT'
       when l_returnflag = 'R' then concat('RESIDENT', chr(10), 'NONRESIDENT') end as rglty_rptg_cd,
  concat('REF', cast(l_orderkey as {{S}}), '-', cast(l_linenumber as {{S}})) as rmt_inf_strd_ref,
  case when l_linestatus = 'O' then 'SCOR' end as rmt_inf_strd_ref_tp,
  case when l_linenumber % 2 = 0 then 'GDDS' else 'SUPP' end as purp_cd,
  concat('Ultimate ', cast(l_suppkey as {{S}})) as ultmt_cdtr_nm,
  case when l_suppkey % 2 = 0 then 'DE' else 'FR' end as cdtr_ctry
from lineitem
"""

ACTUAL_SQL = """
select pmt_inf_id, count(end_to_end_id) as n, sum(instd_amt) as s
from transactions group by pmt_inf_id
"""

REMITTANCE_SQL = f"""
select {_msg_id('o_custkey')} as msg_id, {_pmt_id('o_orderkey')} as pmt_inf_id,
  case when o_orderkey % 43 = 0 then '' when o_orderkey % 47 = 0 then null
       when o_orderkey % 10 = 0 then 'CHK' else 'TRF' end as pmt_mtd,
  case when o_orderkey % 4001 = 4000 then null
       else cast(coalesce(a.n, 0) + case when o_orderkey % 13 = 0 then 1 else 0 end as {{S}}) end as nb_of_txs,
  case when o_orderkey % 23 = 0 then null when o_orderkey % 311 = 0 then cast(-1 as decimal(18,2))
       else cast(coalesce(a.s, 0) + case when o_orderkey % 11 = 0 then 0.01 else 0 end as decimal(18,2)) end as ctrl_sum,
  case when o_orderstatus = 'F' then 'SEPA' end as svc_lvl_cd,
  case when o_orderkey % 53 = 0 then null else cast(o_orderdate as date) end as reqd_exctn_dt,
  concat('Debtor ', cast(o_custkey as {{S}})) as dbtr_nm,
  case when o_orderkey % 17 = 0 then lower({_iban('o_orderkey')})
       when o_orderkey % 19 = 0 then concat('DE00', lpad(cast(o_orderkey as {{S}}), 18, '0'))
       else {_iban('o_orderkey')} end as dbtr_acct_iban,
  case when o_orderkey % 59 = 0 then 'NOTABIC' else 'COBADEFFXXX' end as dbtr_agt_bicfi,
  'false' as btch_bookg,
  case when o_orderpriority = '1-URGENT' then 'HIGH' else 'NORM' end as instr_prty,
  'CORE' as lcl_instrm_cd, 'SALA' as ctgy_purp_cd, 'SLEV' as chrg_br,
  concat('Ultimate Debtor ', cast(o_custkey as {{S}})) as ultmt_dbtr_nm
from orders left join act a on a.pmt_inf_id = {_pmt_id('o_orderkey')}
"""

MESSAGE_ACTUAL_SQL = """
select r.msg_id, sum(a.n) as n, sum(a.s) as s
from remittance r join act a on r.pmt_inf_id = a.pmt_inf_id group by r.msg_id
"""

MESSAGE_SQL = f"""
select {_msg_id('c_custkey')} as msg_id,
  case when c_custkey % 61 = 0 then '' when c_custkey % 7 = 0 then '2026-01-01T00:00:00'
       else '2026-01-01T00:00:00+01:00' end as msg_cre_dt_tm,
  cast(coalesce(a.n, 0) + case when c_custkey % 17 = 0 then 1 else 0 end as {{S}}) as msg_nb_of_txs,
  cast(coalesce(a.s, 0) + case when c_custkey % 19 = 0 then 5 else 0 end as decimal(18,2)) as msg_ctrl_sum,
  case when c_custkey % 67 = 0 then '' when c_custkey % 71 = 0 then null else c_name end as msg_initg_pty_nm
from customer left join macct a on a.msg_id = {_msg_id('c_custkey')}
"""

VIEWS = (
    ("transactions", TRANSACTIONS_SQL),
    ("act", ACTUAL_SQL),
    ("remittance", REMITTANCE_SQL),
    ("macct", MESSAGE_ACTUAL_SQL),
    ("message", MESSAGE_SQL),
)


def ctes(text_type: str, wide_type: str) -> str:
    """All views as one WITH list, in order of use."""
    parts = [f"{name} as ({sql})" for name, sql in VIEWS]
    return ",\n".join(parts).replace("{S}", text_type).replace("{H}", wide_type)


def payments(spark: SparkSession, sf_dir: str) -> PaymentTables:
    """The three tables over the Parquet files of ``sf_dir``, lazily."""
    views = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "orders", "lineitem")}

    def run(sql: str, **inputs: DataFrame) -> DataFrame:
        text = sql.replace("{S}", "string").replace("{H}", "decimal(38,0)")
        for name in inputs:
            for word in ("from", "join"):
                text = text.replace(f"{word} {name}", f"{word} {{{name}}}")
        return spark.sql(text, **inputs)

    transactions = run(TRANSACTIONS_SQL, lineitem=views["lineitem"])
    actual = run(ACTUAL_SQL, transactions=transactions)
    remittance = run(REMITTANCE_SQL, orders=views["orders"], act=actual)
    message_actual = run(MESSAGE_ACTUAL_SQL, remittance=remittance, act=actual)
    message = run(MESSAGE_SQL, customer=views["customer"], macct=message_actual)
    return PaymentTables(message, remittance, transactions)
