"""JSON artefacts in an envelope, and the schemas of their payloads.

Schemas are always explicit: inference would lose maps that happen to be empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = "struct<upstream: string, source_version: string, runtime: array<string>, dev: array<string>, binaries: array<struct<name: string, versions: array<string>>>>"
COUNTS = "map<string, int>"
OBJECT = f"struct<soname: array<string>, language: string, public: {COUNTS}, third_party: {COUNTS}, private_node: {COUNTS}, symbols_version_renamed: int, mass_rename: boolean, coverage: struct<debug_info_found: array<boolean>, exported_functions: array<bigint>, mangled_functions: array<bigint>>, type_events: array<struct<kind: string, type: string, declared_in: string, count: int>>, symbol_events: array<struct<kind: string, symbol: string, pretty: string, version: string>>>"
COVERAGE = "struct<header_files: int, parsed: int, with_fatal: int, with_errors: int, parsed_as_cxx: int, skipped: int>"
HEADER_DIFF = "struct<definitions_1: int, definitions_2: int, definitions_common: int, definitions_added: int, definitions_removed: int, inline_body_changed: int, inline_body_changed_template: int, inline_decl_changed: int, macros_1: int, macros_2: int, macros_common: int, macro_value_changed: int, macro_value_changed_nonversion: int, examples: array<string>>"
DEFINITION = "struct<path: string, name: string, kind: string, decl: string, body: string, tokens: int>"
FREQUENCY = "struct<title: string, n: bigint, libraries: bigint, rows: array<struct<kind: string, transitions: bigint, events: bigint, median: double, max: bigint, mechanism: string>>>"
RESCUE = "struct<affected: bigint, fully_rescued: bigint, mechanisms: array<struct<mechanism: string, needed_by: bigint, sole_reason: bigint>>>"
#: Payload schemas by stage; the schema id of stage s is tool/s/n.
PAYLOADS = {
    "selection": "struct<libraries: array<struct<rank: int, installs: bigint, binary: string, source: string, language_hint: string>>>",
    "plan": f"struct<jobs: array<struct<source: string, v1: {RELEASE}, v2: {RELEASE}>>>",
    "pair": f"struct<id: string, source: string, upstream: array<string>, objects: array<{OBJECT}>, unpaired: array<array<string>>, object_errors: array<string>, seconds: double, error: string>",
    "header-index": f"struct<language: string, definitions: map<string, {DEFINITION}>, macros: map<string, string>, coverage: {COVERAGE}>",
    "summary": f"struct<corpus: struct<transitions: bigint, libraries: bigint, mass_rename_excluded: bigint>, filtered: map<string, bigint>, frequency: map<string, {FREQUENCY}>, breaks: struct<n: bigint, breaking: bigint, declared: bigint, silent: bigint>, rescue: map<string, {RESCUE}>, unstable: array<struct<source: string, breaking: bigint, total: bigint>>>",
    "header-pair": f"struct<id: string, source: string, upstream: array<string>, language: string, coverage: array<{COVERAGE}>, diff: {HEADER_DIFF}, error: string>",
}
VERSIONS = {"selection": ("1",), "plan": ("1",), "pair": ("1",), "header-index": ("1", "2"), "header-pair": ("2",), "summary": ("1",)}


def read_artifacts(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The payload columns of all artefacts of a stage below path, and file_name.

    Files of another schema id and unreadable ones give no rows; rejected() has them.
    """
    return _enveloped(spark, path, stage).where(is_of(stage)).select("file_name", "data.*")


def rejected(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """file_name and schema of what read_artifacts() leaves out."""
    return _enveloped(spark, path, stage).where(~F.coalesce(is_of(stage), F.lit(False))).select("file_name", "schema")


def is_of(stage: str) -> Column:
    """The envelope's schema is one of the stage's, by whatever tool."""
    return F.col("schema").rlike(f"^[^/]+/{stage}/({'|'.join(VERSIONS[stage])})$")


def _enveloped(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """Files hold one artefact in any layout, or many, each beginning a line.

    Files are read artefact by artefact, never whole. The separator takes the brace of all but
    a file's first; no object goes on with a second brace, so what has none gets it back.
    """
    schema = f"schema string, tool string, generated_at string, data {PAYLOADS[stage]}, _corrupt_record string"
    each = spark.read.text(path, lineSep="\n{").select("value", F.col("_metadata.file_name").alias("file_name")).where(F.trim("value") != "")
    value = F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.concat(F.lit("{"), "value"))
    read = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("a")
    return each.select(read, "file_name").select("a.*", "file_name")


def write_artifact(df: DataFrame, path: str, stage: str, tool: str = "driftlens", compression: str = "none") -> None:
    """Each row of df (the payload's columns) as one JSON line in the envelope; the job commits as a whole. Readers take gzip as well."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    data = F.struct(*df.columns).alias("data")
    df.select(F.lit(f"{tool}/{stage}/{VERSIONS[stage][-1]}").alias("schema"), F.lit(tool).alias("tool"), now.alias("generated_at"), data).write.mode("overwrite").json(path, compression=compression)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept_by(df: DataFrame, by: list[str], path: str) -> DataFrame:
    """df written to path and read back, with rows of equal by in one partition: what groups by these columns needs no shuffle."""
    spark = df.sparkSession
    width, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"driftlens_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.repartition(width, *by).write.format("parquet").option("path", path).bucketBy(width, *by).sortBy(*by).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # the name only: files in a folder of their own stay
    return out


def last_of_folders(spark: SparkSession, folders: list[str], read, key: str) -> DataFrame:
    """Rows of several folders, of equal keys that of the last folder."""
    all_ = None
    for k, folder in enumerate(folders):
        part = read(spark, folder).withColumn("_folder", F.lit(k))
        all_ = part if all_ is None else all_.unionByName(part)
    rest = [c for c in all_.columns if c not in (key, "_folder")]
    return all_.groupBy(key).agg(F.max_by(F.struct(*rest), "_folder").alias("r")).select(key, "r.*")
