"""WARC archives with a two-level capture index.

Pages become gzip-compressed WARC/1.1 records, one file a task, in the shared
folder. The capture index holds one line a record, keyed by the reversed-host
form of the URL. Its lines are sorted over all files and cut into compressed
blocks; a sparse directory keeps the first key and the byte range of each block,
and a top list the first key of each index file. A lookup searches the top list,
then one file's directory, reads one block by its range, and reads one record.

Of records with equal payloads of at least ``least`` bytes, that with the smallest
page_id is a response and the others are revisits, which carry no payload and
name the response by URL and id.

Every task writes files under names of its own and reports them with its rows, so
a task that runs again leaves no row that points into a lost file.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 100
DATE = "2000-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, rec string, file string, at long, size long, kind string, refers_key string, refers_to long"
BLOCKS = "first string, file string, at long, size long, n long, dir_at long, dir_size long"
_URL = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)")
_DEFAULT_PORTS = {"http": "80", "https": "443"}


def url_key(url: str | None) -> str:
    """Reversed host, then port if not the scheme's own, then the rest: com,example,www)/path?query."""
    scheme, host, port, rest = _URL.match(url or "").groups()
    host = ",".join(reversed([x for x in host.lower().split(".") if x]))
    port = f":{port}" if port and port != _DEFAULT_PORTS.get((scheme or "").lower()) else ""
    rest = rest if rest.startswith("/") else "/" + rest
    return quote(f"{host}{port}){rest}", safe="!$&'()*+,-./:;=?@_~%|[]")


def line_key(key: str, page_id: int | None, rec: str) -> str:
    """Orders captures of one URL by page_id, nulls last, then by record id."""
    return f"{key} {'~' if page_id is None else f'{page_id + 2**63:020d}'} {rec}"


def filesystem(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


def record(kind: str, url: str, page_id: int | None, rec: str, payload: bytes, digest: str, refers: tuple[str, int, str] | None) -> bytes:
    """One WARC record as a gzip member of its own."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{rec}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=_SAFE)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {quote(refers[0], safe=_SAFE)}", f"X-Refers-To-Page-Id: {refers[1]}", f"WARC-Refers-To: <urn:uuid:{refers[2]}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


_SAFE = "!#$&'()*+,/:;=?@[]-._~%|{}\"<>\\^`"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    return headers, rest[:size]


def members(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a file, read in order by small parts."""
    at, held = 0, b""
    while True:
        un, parts, start = zlib.decompressobj(31), [], at
        while not un.eof:
            if not held and not (held := stream.read(chunk)):
                if parts or at != start:
                    raise ValueError("the archive is cut short")
                return
            parts.append(un.decompress(held))
            at += len(held) - len(un.unused_data)
            held = un.unused_data
        yield start, b"".join(parts)


class Range:
    """The bytes of an open file from start to stop, read in order."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.left = file, stop - start
        file.seek(start)

    def read(self, size: int) -> bytes:
        got = self.file.read(min(size, self.left))
        self.left -= len(got)
        return got


def record_id(page_id: int | None, url: str, digest: str, copy: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}\n{copy}"))


def _write(folder: str, most: int):
    def rows(given):
        fs, path = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for page_id, url, html, digest, copy, refers_to, refers_url, refers_digest in given:
                if out is None or at >= most:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                kind = "response" if refers_url is None else "revisit"
                rec = record_id(page_id, url, digest, copy)
                refers = None if kind == "response" else (refers_url, refers_to, record_id(refers_to, refers_url, refers_digest, 0))
                raw = record(kind, url, page_id, rec, html, digest, refers)
                out.write(raw)
                key = url_key(url)
                yield line_key(key, page_id, rec), page_id, rec, name, at, len(raw), kind, None if refers is None else line_key(url_key(refers_url), refers_to, refers[2]), refers_to
                at += len(raw)
        finally:
            if out:
                out.close()

    return rows


def _index(folder: str, lines: int):
    def rows(given):
        fs, path = filesystem(folder)
        held, name, out, at, directory = [], f"{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def block():
            nonlocal at, out, held
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            raw = gzip.compress("".join(f"{k}\t{json.dumps(v)}\n" for k, v in held).encode(), 6, mtime=0)
            out.write(raw)
            directory.append((held[0][0], at, len(raw), len(held)))
            at += len(raw)
            held = []

        for key, *rest in given:
            held.append((key, rest))
            if len(held) >= lines:
                block()
        if held:
            block()
        if out:  # the directory ends the file
            raw = gzip.compress("".join(f"{k}\t{a}\t{n}\n" for k, a, n, _ in directory).encode(), 6, mtime=0)
            out.write(raw)
            out.close()
            yield directory[0][0], name, 0, at, sum(x[3] for x in directory), at, len(raw)

    return rows


@dataclass
class Archive:
    """Archives in a folder, their captures (a table) and the top list of the index.

    top has one entry for each index file, so as many as there were tasks.
    """

    folder: str
    captures: DataFrame
    top: list[tuple[str, str, int, int]]

    def reader(self) -> Reader:
        return Reader(self.folder, self.top)


class Reader:
    """Lookups by the two-level index; it keeps a few directories and blocks."""

    def __init__(self, folder: str, top: list[tuple[str, str, int, int]], keep: int = 64):
        (self.fs, self.path), self.top, self.keep = filesystem(folder), top, keep
        self.first, self.kept = [x[0] for x in top], OrderedDict()

    def read(self, name: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return f.read_at(size, at)

    def lines(self, name: str, at: int, size: int) -> list[list[str]]:
        if (name, at) not in self.kept:
            text = gzip.decompress(self.read(name, at, size)).decode()
            self.kept[name, at] = [x.split("\t") for x in text.split("\n")[:-1]]
            if len(self.kept) > self.keep:
                self.kept.popitem(last=False)
        self.kept.move_to_end((name, at))
        return self.kept[name, at]

    def find(self, key: str) -> list | None:
        """The capture under the largest key that is at most key."""
        t = bisect.bisect_right(self.first, key) - 1
        if t < 0:
            return None
        _, name, at, size = self.top[t]
        directory = self.lines(name, at, size)
        _, block_at, block_size = directory[bisect.bisect_right(directory, key, key=lambda x: x[0]) - 1]
        block = self.lines(name, int(block_at), int(block_size))
        got = block[bisect.bisect_right(block, key, key=lambda x: x[0]) - 1]
        return [got[0], *json.loads(got[1])]

    def record(self, capture: list) -> tuple[dict[str, str], bytes]:
        return parse(gzip.decompress(self.read(capture[3], capture[4], capture[5])))

    def lookup(self, url: str) -> tuple[dict[str, str], bytes] | None:
        """The latest capture of url (that with the largest page_id), a revisit with its response's payload."""
        key = url_key(url)
        got = self.find(f"{key} \x7f")
        if got is None or got[0].split(" ")[0] != key:
            return None
        headers, payload = self.record(got)
        if headers["WARC-Type"] == "revisit":
            payload = self.record(self.find(got[7]))[1]
        return headers, payload


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Narrow rows: _row, digest, bytes, and for revisits refers_to and refers_url."""
    rows = common.written(pages.select(*_IDS, F.sha2("html", 256).alias("digest"), F.length("html").cast("long").alias("bytes")), "digests")
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(F.struct(F.coalesce("page_id", F.lit(common.NULL_ID)).alias("k"), "page_id", "url", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.written(first.select(F.col("digest").alias("d"), "first.*").toDF("d", "k", "to_id", "to_url", "to_row"), "first-of-payload")
    found = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    other = F.col("to_row").isNotNull() & (F.col("to_row") != F.col("_row"))
    return common.written(found.select("_row", "digest", F.when(other, F.col("to_id")).alias("refers_to"), F.when(other, F.col("to_url")).alias("refers_url"), F.when(other, F.col("d")).alias("refers_digest"), F.when(F.col("to_row") == F.col("_row"), 0).otherwise(1).alias("copy")), "kinds")


#: A row's place in its file tells rows apart that agree in all columns.
_IDS = ["page_id", "url", "_row"]


def _scans_files(df: DataFrame) -> bool:
    """Whether df is a scan of files with nothing but projections and filters, so that rows have a place that stays."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation") and "_metadata" not in [c.lower() for c in df.columns]


def write_archive(pages: DataFrame, least: int = LEAST, block_lines: int = 300, most: int = 1 << 30) -> Archive:
    """Writes pages (page_id, url, html) to archives and indexes them.

    Null html is an empty payload, a null url an empty one. Payloads of under
    least bytes are always responses. A row without page_id comes after all
    others. Rows that repeat are captures of their own. Other columns are ignored.
    Rows are told apart by their place in their file; pages that aren't a plain
    scan of files are written to the shared folder first.
    """
    spark = pages.sparkSession
    folder = f"{common.shared_dir(spark)}/driftlens/warc-{uuid.uuid4().hex}"
    fs, path = filesystem(folder)
    fs.create_dir(path)
    if not _scans_files(pages):
        pages = common.written(pages.select("page_id", "url", "html"), "pages")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), common.utf8("html").alias("html"), F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_row"))
    kinds = classify(rows, least)
    joined = rows.join(kinds, "_row").select("page_id", "url", "html", "digest", F.when(F.col("copy") == 0, 0).otherwise(F.crc32(F.col("_row").cast("binary")) + 1).alias("copy"), "refers_to", "refers_url", "refers_digest")
    captures = common.written(common.arrow_pass(joined, _write(folder, most), CAPTURES, 512), "captures")
    dealt = captures.repartitionByRange(common.shuffle_width(spark), "key").sortWithinPartitions("key")
    blocks = common.written(common.arrow_pass(dealt, _index(folder, block_lines), BLOCKS), "index-files")
    top = sorted((r["first"], r["file"], r["dir_at"], r["dir_size"]) for r in blocks.select("first", "file", "dir_at", "dir_size").collect())
    return Archive(folder, captures, top)


def _read_back(folder: str, top):
    def rows(given):
        fs, path = filesystem(folder)
        reader, known = Reader(folder, top.value), OrderedDict()
        for name, start, stop in given:
            with fs.open_input_file(f"{path}/{name}") as file:
                for _, raw in members(Range(file, start, stop)):
                    headers, payload = parse(raw)
                    page = headers["X-Page-Id"]
                    kind, refers = headers["WARC-Type"], None
                    size, digest = len(payload), None
                    if kind == "revisit":
                        refers = int(headers["X-Refers-To-Page-Id"]) if headers["X-Refers-To-Page-Id"] not in ("", "None") else None
                        rec = headers["WARC-Refers-To"][10:-1]
                        if rec not in known:
                            target = line_key(url_key(headers["WARC-Refers-To-Target-URI"]), refers, rec)
                            full = reader.record(reader.find(target))[1]
                            known[rec] = len(full), hashlib.sha256(full).hexdigest()
                            if len(known) > 4096:
                                known.popitem(last=False)
                        size, digest = known[rec]
                    digest = digest or hashlib.sha256(payload).hexdigest()
                    if f"sha256:{digest}" != headers["WARC-Payload-Digest"]:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
                    yield int(page) if page else None, size, digest, kind, refers

    return rows


def ranges(captures: DataFrame, range_bytes: int) -> DataFrame:
    """(file, start, stop): runs of whole records that together are all files, each of about range_bytes at most."""
    runs = captures.groupBy("file", F.floor(F.col("at") / range_bytes).alias("run"))
    return runs.agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop")).drop("run")


def read_back(archive: Archive, range_bytes: int = 4 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives alone.

    Files are read in parallel, by runs of records of about range_bytes, so tasks
    follow the bytes of the archives; a revisit's payload comes by an index lookup.
    """
    spark = archive.captures.sparkSession
    top = spark.sparkContext.broadcast(archive.top)
    found = common.written(ranges(archive.captures, range_bytes), "ranges")
    count = found.count()
    # dealt one by one to a given number of tasks: adaptive execution doesn't join those again, small as the list is
    dealt = found.repartition(max(1, min(count, max(2 * common.shuffle_width(spark), -(-count // 16)))))
    return common.arrow_pass(dealt, _read_back(archive.folder, top), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", 512)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_archive(common.table(spark, sf_dir, "pages")))


ORACLE_SQL = r"""
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
from f
"""
