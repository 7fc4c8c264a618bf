"""Line dedup: lines that many documents share stay only in the smallest document.

Each text is exploded to the hashes of its normalised lines, documents are
counted per hash, lines over the threshold go, and the rest is reassembled by
position. Only (hash, id) pairs are shuffled for counting, combined on the map
side; texts are shuffled once, by doc_id, to meet their dropped hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _pairs(min_chars: int):
    def rows(given):
        for did, text in given:
            for h in {line_key(x, min_chars) for x in text.split(b"\n")} - {None}:
                yield h, did

    return rows


def _assemble(min_chars: int):
    def rows(given):
        for doc_id, text, drops in given:
            lines = text.split(b"\n")
            kept = lines
            if drops:
                gone = set(drops)
                kept = [x for x in lines if line_key(x, min_chars) not in gone]
            yield doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8")

    return rows


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(did, drops): for each document the hashes of the lines that it loses."""
    pairs = common.written(common.arrow_pass(docs.select(common.id_key().alias("did"), common.utf8().alias("text")), _pairs(min_chars), "h binary, did long"), "lines")
    by_hash = pairs.groupBy("h")
    if min_docs <= 2:  # two documents hold a line just when its smallest and largest ids differ
        shared = by_hash.agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    else:
        shared = by_hash.agg(F.min("did").alias("first"), F.count_distinct("did").alias("n")).where(F.col("n") >= min_docs)
    shared = common.written(shared.select("h", "first"), "shared-lines")
    gone = pairs.join(shared, "h").where("did <> first").select("did", "h").groupBy("did").agg(F.collect_set("h").alias("drops"))
    return common.written(gone, "dropped-lines")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Returns doc_id, n_lines, n_dropped and the kept text, a row for each row of docs.

    A null or empty text is one empty line, which is kept as its key is short.
    Rows of one doc_id are one document: a line that repeats only among them
    stays. A null doc_id comes after all other ids, and such rows are one
    document. Repeats within the smallest document stay. Other columns of docs
    are ignored, whatever their names. An empty table gives an empty result.
    """
    drops = dropped_lines(docs, min_chars, min_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.id_key().alias("did"), common.utf8().alias("text"))
    joined = texts.join(drops, "did", "left").select("doc_id", "text", "drops")
    return common.arrow_pass(joined, _assemble(min_chars), "doc_id long, n_lines long, n_dropped long, kept string", 512)


def _assemble_rows(min_chars: int, at: int):
    """Over batches of rows with their dropped hashes as the last column: the rows, with fewer lines in column at."""

    def shorter(text: bytes, drops: list[bytes]) -> bytes:
        gone = set(drops)
        return b"\n".join([x for x in text.split(b"\n") if line_key(x, min_chars) not in gone])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                *columns, drops = b.slice(lo, 256).columns
                lost = drops.to_pylist()
                if any(lost):
                    texts = columns[at].cast(pa.binary()).to_pylist()
                    made = [t if not d or t is None else shorter(t, d) for t, d in zip(texts, lost, strict=True)]
                    columns[at] = pa.array(made, pa.binary()).cast(columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
        common.release()

    return run


def dedup_rows(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, and in text only the lines that dedup_lines keeps; a null text stays null."""
    did, key, gone = (common.free_name(docs, x) for x in ("_did", "_key", "_drops"))
    drops = dropped_lines(docs, min_chars, min_docs).toDF(did, gone)
    joined = docs.withColumn(key, common.id_key()).join(drops, F.col(key) == F.col(did), "left").drop(key, did)
    return common.mapped(joined, _assemble_rows(min_chars, docs.columns.index("text")), docs.schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
shared as (
  select k, min(doc_id) as first_id from keyed where length(k) >= 10
  group by k having count(distinct doc_id) >= 2),
marked as (
  select keyed.doc_id, pos, line, shared.k is not null and keyed.doc_id <> first_id as gone
  from keyed left join shared on keyed.k = shared.k)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
