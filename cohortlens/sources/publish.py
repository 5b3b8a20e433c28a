"""Dataset identity, idempotent runs, checks of staged copies, views. `versions` switches what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import latest_per_key


def resolve_identity(files: DataFrame, registry: DataFrame, schema_version: str) -> DataFrame:
    """Files to registered datasets by content hash: RESOLVED, UNKNOWN or SCHEMA_MISMATCH."""
    known = registry.select(
        F.col("sha256").alias("_sha"), F.col("dataset_name").alias("dataset"), F.col("schema_version").alias("registered_schema")
    )
    joined = files.join(known, F.col("sha256") == F.col("_sha"), "left").drop("_sha")
    state = (
        F.when(F.col("dataset").isNull(), "UNKNOWN")
        .when(F.col("registered_schema") != schema_version, "SCHEMA_MISMATCH")
        .otherwise("RESOLVED")
    )
    return joined.withColumn("identity", state)


def registration_conflicts(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Name and hash must map one to one; registering the same pair again is idempotent."""
    by_sha = registry.select(F.col("sha256").alias("_s1"), F.col("dataset_name").alias("name_of_sha"))
    by_name = registry.select(F.col("dataset_name").alias("_n2"), F.col("sha256").alias("sha_of_name"))
    joined = requests.join(by_sha, F.col("sha256") == F.col("_s1"), "left").join(by_name, F.col("dataset_name") == F.col("_n2"), "left")
    state = (
        F.when(F.col("name_of_sha").isNull() & F.col("sha_of_name").isNull(), "NEW")
        .when(F.col("name_of_sha").eqNullSafe(F.col("dataset_name")), "IDEMPOTENT")
        .when(F.col("name_of_sha").isNotNull(), "SHA_CONFLICT")
        .otherwise("NAME_CONFLICT")
    )
    return joined.select(*requests.columns, state.alias("registration"))


def recent(runs: DataFrame, order: str, limit: int = 20) -> DataFrame:
    """The latest entries of a run or dataset list: a distributed top-k."""
    return runs.orderBy(F.col(order).desc()).limit(limit)


def prior_success(requests: DataFrame, runs: DataFrame, force: Column | None = None) -> DataFrame:
    """Skip a request that an earlier successful run with the same content, schema and code already covers."""
    keys = ["sha256", "schema_version", "code_version"]
    done = latest_per_key(runs.where(F.col("status") == "SUCCEEDED").select(*keys, "run_id"), keys, ["run_id"])
    joined = requests.join(done.withColumnRenamed("run_id", "prior_run_id"), keys, "left")
    forced = force if force is not None else F.lit(False)
    return joined.withColumn("skip", F.col("prior_run_id").isNotNull() & ~forced)


def run_record(judged: DataFrame, run_id: Column) -> DataFrame:
    """Audit row of a run: counters, and the accounting rule valid + rejected = read."""
    valid = F.count_if(F.col("error_category").isNull())
    rejected = F.count_if(F.col("error_category").isNotNull())
    counted = judged.agg(F.count(F.lit(1)).alias("rows_read"), valid.alias("rows_valid"), rejected.alias("rows_rejected"))
    return counted.select(run_id.alias("run_id"), "*", (F.col("rows_valid") + F.col("rows_rejected") == F.col("rows_read")).alias("accounted"))


def verify_staged(staged: DataFrame, expected_rows: int, key: str) -> DataFrame:
    """Check a written copy: row count as expected, ids distinct. One row; switch to the copy only if it passed."""
    per_key = staged.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("staged_rows"), F.count(F.lit(1)).alias("distinct_ids")
    ).withColumn("passed", (F.col("staged_rows") == F.lit(expected_rows)) & (F.col("distinct_ids") == F.col("staged_rows")))


def stage_and_verify(valid: DataFrame, staging_path: str, expected_rows: int, key: str) -> DataFrame:
    """Write staging, read it back and check it."""
    valid.write.mode("overwrite").parquet(staging_path)
    return verify_staged(valid.sparkSession.read.parquet(staging_path), expected_rows, key)


def append_events(events: DataFrame, path: str) -> None:
    """Append-only log of pointers to what happened."""
    events.write.mode("append").parquet(path)


def canonical_view(fact: DataFrame, banks: DataFrame, view: str | None = None) -> DataFrame:
    """Fact with the legal name of its issuer; optionally registered as a temporary view."""
    names = banks.select(F.col("bank").alias("_bank"), "legal_name")
    joined = fact.join(names, F.col("issuer_bank") == F.col("_bank"), "left").drop("_bank")
    if view:
        joined.createOrReplaceTempView(view)
    return joined


def labelled_view(fact: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Wide view with the layer in every name: `observed_*` from the fact, `synthetic_*` from the assignment."""
    seen = fact.select(F.col(key), *[F.col(c).alias(f"observed_{c}") for c in fact.columns if c != key])
    made = assigned.select(F.col(key), *[F.col(c).alias(f"synthetic_{c}") for c in assigned.columns if c != key])
    return seen.join(made, key).withColumn("observed_layer", F.lit("OBSERVED")).withColumn("synthetic_layer", F.lit("SYNTHETIC"))
