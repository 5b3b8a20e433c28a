"""Verification reports: checks declared once, compiled into one aggregation per table, one typed row per check."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as v

REPORT = ("position", "name", "state", "value_type", "expected", "actual", "detail")


@dataclass(frozen=True)
class Check:
    """`actual` is an aggregate over the table; the check passes if it equals `expected` (NULL only equals NULL).

    detail: text, or an aggregate that says more about a failure; it is shown for failures only. A check that doesn't apply to this table is
    reported as skipped with its reason, and never evaluated. `apart` checks have an aggregation of their own.
    """

    name: str
    actual: Column
    expected: object
    detail: str | Column = ""
    skipped: str | None = None
    apart: bool = False


def row_count(name: str, expected: int, **more) -> Check:
    return Check(name, F.count(F.lit(1)), expected, **more)


def none_of(name: str, bad: Column, example: Column | None = None, **more) -> Check:
    """No row for which `bad` holds; the detail of a failure names the least example."""
    if example is not None:
        more["detail"] = F.concat(F.lit("for example "), F.min(F.when(bad, example.cast("string"))))
    return Check(name, F.count_if(F.coalesce(bad, F.lit(False))), 0, **more)


def all_distinct(name: str, column: str, **more) -> Check:
    """Rows beyond the first of each value; rows without a value count.

    Made apart: beside a distinct count every other aggregate is kept for each value, and examples, being text, would have all rows sorted for it.
    """
    return Check(name, F.count(F.lit(1)) - F.count_distinct(F.col(column)), 0, **{"apart": True, **more})


def bounds(name: str, column: Column, low, high, **more) -> Check:
    """Least and greatest value, as text `low..high`."""
    shown = F.concat_ws("..", F.min(column).cast("string"), F.max(column).cast("string"))
    return Check(name, shown, f"{low}..{high}", **more)


def value_counts(name: str, column: Column, expected: dict[str, int], **more) -> Check:
    """Exact distribution: the rows of each expected value and of all others (NULLs among them), as `a=1,b=2,*=0`."""
    values = sorted(expected)
    others = F.count_if(~F.coalesce(column.isin(*values), F.lit(False)))
    parts = [F.concat(F.lit(f"{x}="), F.count_if(column == x).cast("string")) for x in values]
    shown = F.concat_ws(",", *parts, F.concat(F.lit("*="), others.cast("string")))
    return Check(name, shown, ",".join([*[f"{x}={expected[x]}" for x in values], "*=0"]), **more)


def _type_of(value) -> str:
    kinds = ((bool, "boolean"), (int, "integer"), (float, "double"), (Decimal, "decimal"))
    return next((name for kind, name in kinds if isinstance(value, kind)), "text")


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def verify(df: DataFrame, checks: list[Check]) -> DataFrame:
    """REPORT, one row per check in the order given: one aggregation, so one scan of the table however many checks there are.

    A check made apart scans the columns it needs once more.
    """
    names = [c.name for c in checks]
    if len(set(names)) != len(names):
        raise ValueError(f"checks share a name: {sorted({n for n in names if names.count(n) > 1})}")
    asked = [(i, c) for i, c in enumerate(checks) if c.skipped is None]

    def aggregates(i: int, c: Check) -> list[Column]:
        return [c.actual.alias(f"a{i}"), *([c.detail.alias(f"d{i}")] if isinstance(c.detail, Column) else [])]

    together = [x for i, c in asked if not c.apart for x in aggregates(i, c)]
    one = df.agg(*(together or [F.count(F.lit(1)).alias("rows")]))
    for i, c in asked:
        if c.apart:
            one = one.join(df.agg(*aggregates(i, c)), F.lit(True))  # one row on either side
    rows = []
    for i, c in enumerate(checks):
        passed = F.col(f"a{i}").eqNullSafe(F.lit(c.expected)) if c.skipped is None else F.lit(None)
        detail = F.col(f"d{i}") if isinstance(c.detail, Column) else F.lit(c.detail)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(c.name).alias("name"),
                (F.lit("SKIPPED") if c.skipped is not None else F.when(passed, "PASSED").otherwise("FAILED")).alias("state"),
                F.lit(_type_of(c.expected)).alias("value_type"),
                F.lit(_text(c.expected)).alias("expected"),
                (F.lit(None) if c.skipped is not None else F.col(f"a{i}")).cast("string").alias("actual"),
                (F.lit(c.skipped) if c.skipped is not None else F.when(passed, "").otherwise(F.coalesce(detail, F.lit("")))).alias("detail"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def overall(report: DataFrame) -> DataFrame:
    """One row: checks made, failed and skipped, whether all made ones passed, and the names of the failed ones in order."""
    failed = F.col("state") == "FAILED"
    return report.agg(
        F.count_if(F.col("state") != "SKIPPED").alias("checked"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("state") == "SKIPPED").alias("skipped"),
        (F.count_if(failed) == 0).alias("passed"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("position", "name")))), lambda x: x["name"]), ", "
        ).alias("failures"),
    )


def payment_checks(rows: int, audited: dict | None = None) -> list[Check]:
    """Checks of a published payment dataset.

    The structural ones hold for any correct load. Those of `audited` (status_counts, method_counts, amounts, flagged) describe
    one known file: they are made where the loaded content is that file, and reported as skipped otherwise.
    """
    c = F.col
    p2p = F.coalesce(c("payment_method") == "P2P", F.lit(False))
    checks = [
        row_count("rows", rows),
        all_distinct("ids_distinct", "transaction_id"),
        none_of("p2p_without_category", p2p & c("merchant_category").isNotNull(), c("transaction_id")),
        none_of("others_with_category", ~p2p & c("merchant_category").isNull(), c("transaction_id")),
        none_of("type_is_method", ~c("transaction_type").eqNullSafe(c("payment_method")), c("transaction_id")),
        none_of("issuer_is_sender", ~c("issuer_bank").eqNullSafe(c("sender_bank")), c("transaction_id")),
        none_of("positions_present", c("source_row_index").isNull(), c("transaction_id")),
        none_of("known_banks", ~(c("sender_bank").isin(*v.BANKS) & c("receiver_bank").isin(*v.BANKS)), c("transaction_id")),
        none_of("amounts_positive", ~(c("amount") > 0), c("transaction_id")),
        none_of("known_status", ~c("status").isin(*v.STATUSES), c("transaction_id")),
    ]
    known = audited or {}
    why = None if audited else "the content is not the audited file"
    return checks + [
        value_counts("status_counts", c("status"), known.get("status_counts", {}), skipped=why),
        value_counts("method_counts", c("payment_method"), known.get("method_counts", {}), skipped=why),
        bounds("amounts", c("amount"), *known.get("amounts", ("", "")), skipped=why),
        Check("flagged", F.count_if("fraud_flag"), known.get("flagged", 0), skipped=why),
    ]
