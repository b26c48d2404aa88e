"""Building the issues DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally import schemas

ERROR = "ERROR"
WARNING = "WARNING"
# A finding whose text starts with this mark is a warning; the mark itself is not shown.
WARNING_MARK = "WARN:"


class Rule(NamedTuple):
    """One condition over a row and the finding it makes."""

    code: str
    when: Column
    id: Column
    message: Column | str
    detail: Column | None = None
    declared: Column | None = None
    actual: Column | None = None
    validator: str | None = None


def finding(validator: str, rule: Rule) -> Column:
    """The issue struct of ``rule``. A literal text with the warning mark makes a warning."""
    severity, text = ERROR, rule.message
    if isinstance(text, str):
        if text.startswith(WARNING_MARK):
            severity, text = WARNING, text.removeprefix(WARNING_MARK)
        text = F.lit(text)
    nothing = F.lit(None)
    given = (v if v is not None else nothing for v in (rule.detail, rule.declared, rule.actual))
    row = F.struct(F.lit(rule.validator or validator), F.lit(severity), F.lit(rule.code), rule.id, text, *given)
    return row.cast(schemas.ISSUES)


def split_mark(message: Column) -> tuple[Column, Column]:
    """Severity and shown text of a finding whose text may carry the warning mark."""
    marked = F.startswith(message, F.lit(WARNING_MARK))
    severity = F.when(marked, F.lit(WARNING)).otherwise(F.lit(ERROR))
    return severity, F.when(marked, F.substr(message, F.lit(len(WARNING_MARK) + 1))).otherwise(message)


def find(df: DataFrame, validator: str, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """All findings of ``rules`` in one pass over ``df``; a rule may name a validator of its own.

    Rows that break no rule leave at a plain filter, which Parquet can help with and which
    stays in generated code; only the others reach the array that fans findings out.
    """
    if len(rules) == 1:
        broken, found = rules[0].when, F.array(finding(validator, rules[0]))
    else:
        broken = reduce(lambda a, b: a | b, (F.coalesce(r.when, F.lit(False)) for r in rules))
        found = F.array_compact(F.array(*(F.when(r.when, finding(validator, r)) for r in rules)))
    return df.where(broken).select(*keep, F.inline(found))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union: duplicates are kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)
