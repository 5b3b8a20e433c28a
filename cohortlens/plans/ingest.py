"""Ingestion end to end: identity, drift and ledger before anything is touched, one judged write, checks, then one switch.

    warehouse/facts        versioned datasets (sources.versions)
    warehouse/quarantine   failed rows with their raw payload, a folder per run
    warehouse/runs         the run ledger
    warehouse/registry     which content is which dataset: sha256, dataset_name, schema_version
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import fingerprint, quality, verification
from ..session import materialize, scratch_path, small_tasks
from ..sources import files, ledger, publish, versions

SCHEMA_VERSION, CODE_VERSION = "1.0.0", "1"
REGISTRY = "sha256 string, dataset_name string, schema_version string"


class IngestionError(Exception):
    """The run stopped; the ledger says why, and what was published before still is."""


class SourceMissing(IngestionError):
    """No file, or no byte, under the path."""


class SchemaDrift(IngestionError):
    """A header lost a required column or repeats one, or a column's values no longer parse."""


class UnknownDataset(IngestionError):
    """The content is not registered, or under another schema version."""


class VerificationFailed(IngestionError):
    """The written copy is not what was read; it was not switched to."""


def judge_and_stage(raw: DataFrame, dataset: str, path: str | None = None) -> quality.Judged:
    """Normalise and judge every raw row once, and write the result by verdict; later steps prune columns of that copy."""
    return quality.write_judged(quality.judge_rows(quality.normalize_rows(raw, dataset)), path or scratch_path(raw.sparkSession, "judged"))


@dataclass(frozen=True)
class Loaded:
    """A version that was written and checked; whether to switch to it is the caller's to say."""

    version: versions.Version
    report: DataFrame
    passed: bool
    rows_read: int
    rows_valid: int
    rows_rejected: int


def load(raw: DataFrame, dataset: str, target: str, quarantine_path: str, run_id: str, audited: dict | None = None) -> Loaded:
    """Judge, quarantine, write a version and check it. Nothing that readers see changes.

    The judged rows are read as follows: failing ones once, the ids of passing ones once, passing rows once, into the version itself. They are
    deleted when the load ends, well or not: what it leaves is the quarantine and the version.
    """
    path = scratch_path(raw.sparkSession, "judged")
    try:
        return _load(judge_and_stage(raw, dataset, path), dataset, target, quarantine_path, run_id, audited)
    finally:
        versions.discard(raw.sparkSession, path)


def _load(judged: quality.Judged, dataset: str, target: str, quarantine_path: str, run_id: str, audited: dict | None) -> Loaded:
    unique, copies = quality.part_duplicates(judged.passing)
    rejected = quality.quarantine_rows(judged.failing.unionByName(copies))
    # One folder per run: a retry of the run replaces what it wrote before.
    rejected.write.mode("overwrite").parquet(f"{quarantine_path.rstrip('/')}/ingestion_run_id={run_id}")
    version = versions.write_version(unique.select(*quality.CANONICAL), target, dataset, run_id)
    spark = unique.sparkSession
    n_copies = copies.count()
    expected = judged.rows_read - judged.rows_failing - n_copies
    with small_tasks(spark):
        report = materialize(verification.verify(versions.open_version(spark, target, version), verification.payment_checks(expected, audited)))
    passed = bool(verification.overall(report).first()["passed"])
    return Loaded(version, report, passed, judged.rows_read, expected, judged.rows_failing + n_copies)


@dataclass(frozen=True)
class Ingestion:
    published: bool
    quarantine: DataFrame
    record: DataFrame


def ingest(raw: DataFrame, dataset: str, target: str, quarantine_path: str, run_id: int) -> Ingestion:
    """Rows at hand into one dataset of a target: quarantine, version, checks, switch. The others stay as they are."""
    done = load(raw, dataset, target, quarantine_path, str(run_id))
    if done.passed:
        versions.switch(raw.sparkSession, target, lambda m: m.with_version(dataset, done.version))
    spark = raw.sparkSession
    record = spark.createDataFrame(
        [(run_id, done.rows_read, done.rows_valid, done.rows_rejected, done.rows_valid + done.rows_rejected == done.rows_read)],
        "run_id long, rows_read long, rows_valid long, rows_rejected long, accounted boolean",
    )
    return Ingestion(done.passed, spark.read.parquet(quarantine_path), record)


@dataclass(frozen=True)
class Warehouse:
    """Folders of one warehouse, and the versions its runs are keyed by."""

    root: str
    schema_version: str = SCHEMA_VERSION
    code_version: str = CODE_VERSION

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def facts(self, spark: SparkSession) -> DataFrame:
        """All published rows, by the manifest in force."""
        return versions.read(spark, self.folder("facts"))

    def ledger(self, spark: SparkSession) -> ledger.Ledger:
        return ledger.Ledger(spark, self.folder("runs"))

    def registry(self, spark: SparkSession) -> DataFrame:
        path = self.folder("registry")
        return spark.read.schema(REGISTRY).parquet(path) if versions.exists(spark, path) else spark.createDataFrame([], REGISTRY)

    def register(self, spark: SparkSession, source: str, dataset: str) -> str:
        """Register the content under a path as a dataset and return its identity. The same pair again changes nothing."""
        asked = materialize(
            files.content_identity(spark, source).select("sha256", F.lit(dataset).alias("dataset_name"), F.lit(self.schema_version).alias("schema_version"))
        )
        state = publish.registration_conflicts(asked, self.registry(spark)).first()
        if state is None:
            raise SourceMissing(f"no file under {source}")
        if state["registration"].endswith("CONFLICT"):
            raise UnknownDataset(f"{state['registration']}: {dataset}")
        if state["registration"] == "NEW":
            asked.coalesce(1).write.mode("append").parquet(self.folder("registry"))
        return state["sha256"]


@dataclass(frozen=True)
class Run:
    run_id: str
    status: str
    dataset: str
    rows_read: int = 0
    rows_valid: int = 0
    rows_rejected: int = 0
    fingerprint: str | None = None
    prior_run_id: str | None = None


def fatal_drift(spark: SparkSession, source: str, raw: DataFrame, threshold: float = 0.5) -> str | None:
    """What in the headers or values of a source forbids loading it, or None."""
    headers = [(str(i), names) for i, (names, _) in enumerate(files.csv_headers(spark, source))]
    drift = quality.header_drift(spark.createDataFrame(headers, "file string, names array<string>")).where("fatal")
    bad = drift.orderBy("file").first()
    if bad:
        return f"missing {bad['missing_required']}, unexpected {bad['unexpected']}, duplicated {bad['duplicated']}"
    checks = {"amount (INR)": text.money(F.col("`amount (INR)`")), "timestamp": text.local_time(F.col("timestamp"))}
    changed = quality.type_drift(raw, checks, threshold).where("changed").orderBy("column").first()
    return f"{changed['column']} no longer parses, for example {changed['examples']}" if changed else None


def run_ingestion(spark: SparkSession, source: str, warehouse: Warehouse, force: bool = False, audited: dict[str, dict] | None = None) -> Run:
    """Ingest the CSV files under a path, or refuse, or skip.

    In this order, before anything is changed: the content's identity (a missing or empty source is an error), the dataset registered for it,
    the ledger (a successful run over the same content, schema and code makes this one a skip, unless forced), and drift. Then load() writes and checks a
    version, and one switch of the manifest publishes it. A failure anywhere before the switch leaves what was published; the run
    ends as FAILED or REFUSED in the ledger and the error is raised. A retry is a new run. `audited` maps identities to what is known of
    their content, for the checks that describe one file.
    """
    identity = files.content_identity(spark, source).first()
    if identity is None or identity["length"] == 0:
        raise SourceMissing(f"nothing to read under {source}")
    sha, runs, run_id = identity["sha256"], warehouse.ledger(spark), ledger.new_run_id()
    keyed = {"sha256": sha, "schema_version": warehouse.schema_version, "code_version": warehouse.code_version}

    known = publish.resolve_identity(spark.createDataFrame([(sha,)], "sha256 string"), warehouse.registry(spark), warehouse.schema_version).first()
    if known["identity"] != "RESOLVED":
        runs.append(run_id, 1, ledger.REFUSED, detail=known["identity"], **keyed)
        raise UnknownDataset(f"{known['identity']}: {source} ({sha})")
    dataset = known["dataset"]
    keyed["dataset"] = dataset

    prior = runs.prior_success(dataset, sha, warehouse.schema_version, warehouse.code_version)
    if prior and not force:
        runs.append(run_id, 1, ledger.SKIPPED, rows_read=0, rows_valid=0, rows_rejected=0, fingerprint=prior["fingerprint"], prior_run_id=prior["run_id"], **keyed)
        return Run(run_id, ledger.SKIPPED, dataset, fingerprint=prior["fingerprint"], prior_run_id=prior["run_id"])

    raw = files.read_text_csv(spark, source)
    drift = fatal_drift(spark, source, raw)
    if drift:
        runs.append(run_id, 1, ledger.REFUSED, detail=drift, **keyed)
        raise SchemaDrift(drift)

    keyed["prior_run_id"] = prior["run_id"] if prior else None
    runs.append(run_id, 1, ledger.RUNNING, **keyed)
    try:
        target = warehouse.folder("facts")
        done = load(raw, dataset, target, warehouse.folder("quarantine"), run_id, (audited or {}).get(sha))
        if not done.passed:
            raise VerificationFailed(verification.overall(done.report).first()["failures"])
        rows = versions.open_version(spark, target, done.version).drop("source_row_index")
        mark = fingerprint.content_fingerprint(rows).first()
        counts = {"rows_read": done.rows_read, "rows_valid": done.rows_valid, "rows_rejected": done.rows_rejected}
        print_ = mark["fingerprint"] if mark else None
        versions.switch(spark, target, lambda m: m.with_version(dataset, done.version))
    except Exception as error:
        runs.append(run_id, 2, ledger.FAILED, detail=f"{type(error).__name__}: {error}"[:2000], **keyed)
        raise
    runs.append(run_id, 2, ledger.SUCCEEDED, fingerprint=print_, version=done.version.folder, **counts, **keyed)
    return Run(run_id, ledger.SUCCEEDED, dataset, fingerprint=print_, prior_run_id=keyed["prior_run_id"], **counts)
