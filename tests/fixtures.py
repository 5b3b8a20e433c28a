"""Generated inputs: clean and dirty source rows, and a payment fact with hash-derived, uncorrelated attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions import vocabulary as v
from cohortlens.functions.hashing import digest, lane_uniform
from cohortlens.operators import metrics, whatif
from cohortlens.spec import FactSpec

VALID = {
    "transaction id": "TXN0000000001", "timestamp": "2024-06-15 12:30:45", "transaction type": "P2M", "merchant_category": "Grocery",
    "amount (INR)": "1500", "transaction_status": "SUCCESS", "sender_age_group": "26-35", "receiver_age_group": "36-45",
    "sender_state": "Maharashtra", "sender_bank": "SBI", "receiver_bank": "HDFC", "device_type": "Android", "network_type": "4G",
    "fraud_flag": "0", "hour_of_day": "12", "day_of_week": "Saturday", "is_weekend": "1",
}


def raw(spark: SparkSession, overrides: list[dict]) -> DataFrame:
    """One valid row per override, changed where the override says so."""
    rows = [
        tuple({**VALID, "transaction id": f"T{i}", **o}[c] for c in v.SOURCE_COLUMNS) + (i,) for i, o in enumerate(overrides)
    ]
    schema = ", ".join(f"`{c}` string" for c in v.SOURCE_COLUMNS) + ", source_row_index bigint"
    return spark.createDataFrame(rows, schema)


def payments(spark: SparkSession, n: int = 8000, base: float = 0.05) -> DataFrame:
    """n rows over twelve days; every attribute from its own salted hash, so none correlate and no cohort is empty."""

    def pick(salt, values):
        u = lane_uniform(digest(F.col("txn_id"), salt), 0)
        return F.element_at(F.array(*[F.lit(x) for x in values]), (F.floor(u * len(values)) + 1).cast("int"))

    rows = spark.range(n).select(F.format_string("TXN%08d", "id").alias("txn_id"))
    day = F.floor(lane_uniform(digest(F.col("txn_id"), "day"), 0) * 12)
    failed = lane_uniform(digest(F.col("txn_id"), "status"), 0) < base
    return rows.select(
        "txn_id",
        (F.timestamp_seconds(F.lit(1709251200) + day * 86400 + F.floor(lane_uniform(digest(F.col("txn_id"), "sec"), 0) * 86400))).alias("ts"),
        F.round(10 + 990 * lane_uniform(digest(F.col("txn_id"), "amount"), 0), 2).cast("decimal(12,2)").alias("amount"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.round(200 + 600 * lane_uniform(digest(F.col("txn_id"), "latency"), 0), 0).alias("latency_ms"),
        F.when(failed, "ISSUER_DECLINED").otherwise("APPROVED").alias("response_code"),
        pick("gw", [f"gateway_{x}" for x in "ABCDE"]).alias("gateway"),
        pick("bank", v.BANKS[:4]).alias("sender_bank"),
        pick("method", v.METHODS).alias("payment_method"),
        pick("region", v.REGIONS[:4]).alias("region"),
        pick("device", v.DEVICES).alias("device"),
        pick("net", v.NETWORKS).alias("network"),
    )


def stress_overlay(
    fact: DataFrame, spec: FactSpec, definition: dict[str, str], p_base, multiplier: float, key: str, start, end
) -> DataFrame:
    """Overlay rows for one window slice. Members that succeeded may fail; failures never change; the rest is copied."""
    rows = fact.where(metrics.in_window(F.col(spec.time), start, end))
    member, changed, p_added, code = whatif._stress_columns(spec, definition, p_base, multiplier, key)
    return rows.select(
        F.col(spec.id),
        F.col(spec.outcome).alias("observed_status"),
        F.when(changed, spec.failed_value).otherwise(F.col(spec.outcome)).alias(spec.outcome),
        F.when(changed, code).otherwise(F.col(spec.code)).alias(spec.code),
        F.col(spec.latency),
        member.alias("in_affected_cohort"),
        changed.alias("outcome_changed"),
        F.when(member, p_added).otherwise(F.lit(0.0)).alias("added_probability"),
    )
