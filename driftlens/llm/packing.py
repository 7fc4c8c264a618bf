"""Best-fit packing of token sequences by non-negative least squares.

Only the histogram of piece lengths reaches the driver: at most ``capacity``
rows. Patterns of up to four lengths that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least
squares, rounded, and what is left is packed best-fit, longest first, on
the histogram as well. The plan says for each length which ranks go where;
pieces get their rank within a length by counts of hash buckets, of which a
length has as many as its pieces need, so it is spread over many tasks.
"""

from __future__ import annotations

import bisect
import gc
import struct
import zlib
from collections import defaultdict
from itertools import compress, islice, pairwise, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class CachedTokenizer:
    """Little-endian ids of whole texts, put together from those of runs between white space.

    A run of letters and marks after them is two pieces to the tokenizer, which
    lower-cases both, so the ids of both are looked up apart. Runs of small letters
    are encoded many at a time: each ends with a token that ends a word.

    The memory is bounded: two generations of at most about ``limit`` runs of up
    to 64 characters. What is used moves to the young one; when that is full it
    becomes the old one, and what wasn't used since goes.
    """

    #: ASCII marks but the apostrophe, which may belong to a contraction.
    _MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, limit: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.young, self.old, self.marks = Tokenizer.from_file(path), limit, {}, {}, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def forget(self, but: int = 100_000) -> None:
        """Frees the memory but for the runs met first, among which are the frequent ones; at the end of a task, as workers stay."""
        self.young, self.old, self.marks = dict(islice(self.young.items(), but)), {}, {"": b""}

    def _one_by_one(self, texts: list[str]) -> dict[str, bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {w: _packed(e.ids) for w, e in zip(texts, got, strict=True)}

    def _letters(self, words: list[str], out: dict[str, bytes], group: int = 200) -> None:
        groups = [words[at : at + group] for at in range(0, len(words), group)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            raw = _packed(e.ids)
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            if len(cuts) == len(part):
                out.update(zip(part, [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts)], strict=True))
            else:
                out.update(self._one_by_one(part))

    def _missing(self, wanted: list[str]) -> dict[str, bytes]:
        """Ids of runs that the young memory lacks; it gets those that are kept."""
        new: dict[str, bytes] = {}
        whole, halves, letters = [], [], []
        young, old, marks = self.young, self.old, self.marks
        for w in wanted:
            got = old.get(w)
            if got is not None:
                new[w] = got
            elif w.isalpha() and w.islower() and len(w) <= 48:
                letters.append(w)
            else:
                core = w.rstrip(self._MARKS)
                key = core.lower()
                # a sigma's small letter depends on its place, and some letters have two characters as theirs
                if key.isalpha() and core.isalpha() and len(core) <= 48 and "\u03a3" not in core and key.islower():
                    halves.append((w, key, w[len(core) :]))
                else:
                    whole.append(w)
        keys = {key for _, key, _ in halves}
        keys.difference_update(new, letters)
        for key in keys:
            got = young.get(key) or old.get(key)
            if got is None:
                letters.append(key)
            else:
                new[key] = got
        self._letters(letters, new)
        if len(marks) > 100_000:
            marks = self.marks = {"": b""}
        marks.update(self._one_by_one(list({m for _, _, m in halves} - marks.keys())))
        for w, key, mark in halves:
            new[w] = new[key] + marks[mark]
        new.update(self._one_by_one(whole))
        young.update(zip(wanted, map(new.__getitem__, wanted)))  # in the order in which they are met
        young.update(new)
        for w in [w for w in whole if len(w) > 64]:
            del young[w]
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        # white space at which texts are cut; the tokenizer's own pattern drops it, so no token spans it
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()  # each run is looked up once, however often the texts have it
        runs, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        got = list(map(self.young.get, runs))
        places = list(compress(range(len(got)), map(is_, got, repeat(None))))
        if places:
            new = self._missing([runs[k] for k in places])
            for k in places:
                got[k] = new[runs[k]]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        raw = _gathered(np.frombuffer(b"".join(got), "<u4"), sizes, codes)
        ends = np.concatenate([[0], 4 * np.cumsum(sizes[codes])])
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [raw[lo:hi] for lo, hi in pairwise(cuts)]


def _gathered(table: np.ndarray, sizes: np.ndarray, codes: np.ndarray, step: int = 1 << 20) -> bytes:
    """The runs of codes one after the other; table holds each run's ids, sizes long. So many runs at a time, as texts may be long."""
    starts, out = np.cumsum(sizes) - sizes, []
    for at in range(0, len(codes), step):
        part = codes[at : at + step]
        n = sizes[part]
        shift = starts[part] - (np.cumsum(n) - n)
        out.append(table[np.arange(n.sum()) + np.repeat(shift, n)].tobytes())
    return b"".join(out)


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def _batches(rows, most: int = 8_000_000):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pieces(path: str, end_id: int, capacity: int):
    def rows(given):
        encoder = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        gc.disable()  # nothing here makes cycles, and each pass would go through the memory
        try:
            for batch in _batches(given):
                for (doc_id, _), ids in zip(batch, encoder.encode([t for _, t in batch]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)
        finally:
            gc.enable()
            encoder.forget()

    return rows


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut at capacity."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.arrow_pass(texts, _pieces(path, end_id, capacity), PIECES)


def patterns(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Up to four lengths, longest first, that fill the capacity exactly.

    Every pair; triples and quadruples go through the most frequent lengths of
    each range of sizes, so there are at most some 80 patterns for each length.
    """
    cap = len(hist) - 1
    lengths = [int(x) for x in np.flatnonzero(hist) if x]
    found = {(cap,)} if hist[cap] else set()
    common_ones = sorted({max(group, key=lambda x: hist[x]) for lo in range(0, cap, 64) if (group := [x for x in lengths if lo < x <= lo + 64])})
    few = sorted(common_ones, key=lambda x: -hist[x])[:9]

    def add(*parts: int) -> None:
        last = cap - sum(parts)
        if last > 0 and hist[last]:
            found.add(tuple(sorted((*parts, last), reverse=True)))

    for a in lengths:
        add(a)
        for b in common_ones:
            add(a, b)
        for i, b in enumerate(few):
            for c in few[i:]:
                add(a, b, c)
    return sorted(found, reverse=True)


def fit(hist: np.ndarray, found: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that make A x close to hist, by accelerated projected gradients.

    Rows are weighted by length, so that long pieces, which fit nowhere else, come first.
    """
    if not found:
        return np.zeros(0)
    width = max(map(len, found))
    cols = np.zeros((len(found), width), np.int64)
    for i, p in enumerate(found):
        cols[i, : len(p)] = p
    target, weight = hist.astype(float).copy(), np.sqrt(np.arange(len(hist)) / (len(hist) - 1))
    target[0] = weight[0] = 0

    def times(x):
        return np.bincount(cols.ravel(), np.repeat(x, width), len(hist)) * weight

    def back(r):
        return (r * weight)[cols].sum(1)

    v = np.ones(len(found))
    for _ in range(12):  # the largest eigenvalue of A'A
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - target * weight) / (1.1 * norm))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; hist[n] is the number of pieces of length n."""
    left, out = hist.astype(np.int64).copy(), []
    left[0] = 0
    found = patterns(left)
    counts = fit(left, found)
    for i in sorted(range(len(found)), key=lambda i: (-counts[i], found[i])):
        need: dict[int, int] = defaultdict(int)
        for n in found[i]:
            need[n] += 1
        k = min([round(counts[i]), *(int(left[n]) // m for n, m in need.items())])
        if k > 0:
            out.append((found[i], k))
            for n, m in need.items():
                left[n] -= k * m
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal sequences are kept as one group with its count."""
    cap = len(left) - 1
    groups: dict[int, list[list]] = defaultdict(list)  # room left: [lengths, count]
    rooms: list[int] = []

    def put(room: int, parts: tuple[int, ...], count: int) -> None:
        if not groups[room]:
            bisect.insort(rooms, room)
        groups[room].append([parts, count])

    for n in range(cap, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = cap // n  # new sequences take as many of this length as fit
                full, rest = divmod(todo, each)
                if full:
                    put(cap - each * n, (n,) * each, full)
                if rest:
                    put(cap - rest * n, (n,) * rest, 1)
                todo = 0
                continue
            room = rooms[at]
            parts, count = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = min(room // n, todo)
            k = min(count, todo // each)
            if k < count:
                put(room, parts, count - k)
            put(room - each * n, parts + (n,) * each, k)
            todo -= k * each
    return [(tuple(p), k) for room in groups.values() for p, k in room]


def segments(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset), by rank."""
    out: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for parts, k in planned:
        offset = 0
        for n in parts:
            out[n].append((used[n], sequence, offset))
            used[n] += k
            offset += n
        sequence += k
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _place(places):
    def rows(given):
        at = places.value
        for *piece, rank in given:
            seg = at[piece[3]]
            first, sequence, offset = seg[np.searchsorted(seg[:, 0], rank, "right") - 1].tolist()
            yield *piece, sequence + rank - first, offset

    return rows


#: A task ranks about so many pieces of one length at a time.
BUCKET = 50_000


def bucketed(cut: DataFrame, counts: list[tuple[int, int]], bucket: int = BUCKET) -> DataFrame:
    """cut with _b, a bucket of about bucket pieces of one length; counts holds (length, number of pieces).

    A common length gets as many buckets as it needs, at any number of pieces.
    """
    parts = cut.sparkSession.createDataFrame([(length, -(-n // bucket)) for length, n in counts], "length long, _parts long")  # a row a length
    # rows go by their place, so pieces that agree in all else spread as well
    return cut.join(F.broadcast(parts), "length").withColumn("_b", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts")


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece.

    A null or empty text is the end id alone. Rows with one doc_id, or with
    none, are documents of their own. An empty table gives an empty result.
    Other columns of docs are ignored, whatever their names.

    The plan is broadcast: it holds at most four rows for each pattern and one
    for each step of the best fit, both bounded by the number of lengths and
    not by the number of documents.
    """
    spark = docs.sparkSession
    cut = common.written(pieces(docs, path, end_id, capacity), "pieces")
    # the file's place tells rows apart that agree in all else, and stays the same when a task runs again
    cut = cut.withColumn("_row", F.struct("doc_id", "piece", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")))
    sizes = [(length, n) for length, n in cut.groupBy("length").count().collect()]  # at most capacity rows
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in sizes:
        hist[length] = n
    cut = bucketed(cut, sizes, bucket)
    counts = common.written(cut.groupBy("length", "_b").agg(F.count("*").alias("n")), "lengths")  # a row a bucket
    places = spark.sparkContext.broadcast(segments(plan(hist)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "_b", "_s")
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("_row")) - 1
    columns = [x.split()[0] for x in PIECES.split(", ")]
    ranked = cut.withColumn("_r", rank).join(starts, ["length", "_b"]).select(*columns, (F.col("_r") + F.col("_s")).alias("_r"))
    return common.arrow_pass(ranked, _place(places), PIECES + ", sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
