"""Package archives: popularity lists, package indexes, packages and their files."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import scalars


def read_popcon(spark: SparkSession, path: str) -> DataFrame:
    """rank, name, installs; comments, short lines and lines without a numeric rank are skipped, bad installs are 0."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("p")).where(F.size("p") >= 3)
    rank = F.get("p", 0).try_cast("int")
    return lines.select(rank.alias("rank"), F.get("p", 1).alias("name"), F.coalesce(F.get("p", 2).try_cast("bigint"), F.lit(0)).alias("installs")).where("rank is not null")


def read_depends(spark: SparkSession, path: str) -> DataFrame:
    """name, depends from a Packages index of stanzas; packages without a Depends line have none.

    Plain, gz and bz2 files are read by Spark; ones whose path ends with .xz or .zst are unpacked whole, one a task.
    """
    if path.endswith((".xz", ".zst")):
        stanzas = read_compressed_text(spark, path).select(F.explode(F.split("text", "\n\n")).alias("value"))
    else:
        stanzas = spark.read.option("lineSep", "\n\n").text(path)
    field = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1)
    return stanzas.select(field("Package").alias("name"), field("Depends").alias("depends")).where("name <> ''")


def unpacked(raw: bytes) -> bytes:
    """gz, bz2, xz or zstd content by its first bytes; anything else as it is."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(raw)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def read_compressed_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files, compressed in any way that unpacked() knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([unpacked(raw).decode("utf-8", "replace")])], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


#: The items of an archive's saved answers, by what was asked.
ANSWERS = {
    "versions": "version: string",
    "binpackages": "name: string, version: string",
    "origin": "source: string, version: string",
    "binfiles": "hash: string, architecture: string, name: string",
}


def read_answers(spark: SparkSession, path: str, asked: str) -> DataFrame:
    """file_path, place and the items' fields from saved JSON answers ({"result": [...]}), one a file.

    Items keep their order in place, from 0. Answers that aren't JSON, or have no result, give no rows.
    """
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    result = F.from_json("value", f"struct<result: array<struct<{ANSWERS[asked]}>>>")["result"]
    return whole.select("file_path", F.posexplode(result).alias("place", "item")).select("file_path", "place", "item.*")


def source_versions(answers: DataFrame) -> DataFrame:
    """The rows of "versions" whose version is one: others can't be ordered, so they can't be paired."""
    return answers.where(scalars.version_parts("version").isNotNull())


def newest_origin(answers: DataFrame, binary: str) -> DataFrame:
    """binary, source, version from "origin": the first item of each answer, without a source the binary's own name."""
    first = answers.groupBy(binary).agg(F.min_by(F.struct("source", "version"), "place").alias("o"))
    return first.select(binary, F.coalesce("o.source", binary).alias("source"), "o.version")


def _stream(raw: bytes):
    """A stream that tarfile reads; it knows gz, bz2 and xz itself."""
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw))
    return io.BytesIO(raw)


#: What an archive that is cut short or odd raises.
_BAD = (ValueError, OSError, EOFError, tarfile.TarError, lzma.LZMAError, zlib.error, UnicodeDecodeError)


def deb_members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the regular files of a package; unsafe paths and devices are left out."""
    if raw[:8] != b"!<arch>\n":
        raise ValueError("not an ar archive")
    at = 8
    while at + 60 <= len(raw):
        name, size = raw[at : at + 16].decode().strip().rstrip("/"), int(raw[at + 48 : at + 58])
        body = raw[at + 60 : at + 60 + size]
        at += 60 + size + size % 2
        if name.startswith("data.tar"):
            # read as a stream: only one file of the package is unpacked at a time
            with tarfile.open(fileobj=_stream(body), mode="r|*") as tar:
                for m in tar:
                    path = m.name.removeprefix("./")
                    if m.isfile() and path and not path.startswith("/") and ".." not in path.split("/"):
                        yield path, tar.extractfile(m).read()


def read_packages(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """package, path, content of all files in .deb packages below path; nothing is written to disk.

    A package that can't be read, or not to its end, doesn't fail the others:
    what comes before the fault counts, and with errors=True a row with its
    reason in the further column error and without path stands for the rest.
    """
    columns = ["package", "path", "content", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], names=columns)
        for b in batches:
            for package, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for name, content in deb_members(raw):
                        yield one(package, name, content, None)
                except _BAD as e:
                    yield one(package, None, None, f"{type(e).__name__}: {e}")

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "package string, path string, content binary, error string")
    return out if errors else out.where("error is null").drop("error")


def shared_objects(files: DataFrame) -> DataFrame:
    return files.where(scalars.is_shared_object("path", "content"))


def headers(files: DataFrame) -> DataFrame:
    return files.where(scalars.is_header_path("path"))


def verified(files: DataFrame, digest: str = "sha1") -> DataFrame:
    """The rows whose content has the SHA-1 in the column digest."""
    return files.where(F.sha1("content") == F.col(digest))


def preferred_files(files: DataFrame, keys: list[str], order: tuple[str, ...] = ("amd64", "all")) -> DataFrame:
    """Of each key's files that of the first architecture in order; other architectures don't count."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("architecture"))
    rest = [c for c in files.columns if c not in keys]
    return files.withColumn("_rank", rank).where("_rank > 0").groupBy(*keys).agg(F.min_by(F.struct(*rest), "_rank").alias("r")).select(*keys, "r.*")
