import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.llm import line_dedup, packing

from .helpers import docs, lower

BLANKS = " \t\n\x0b\x0c\r"


def dedup_brute(rows):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(BLANKS))
            if len(k) >= 10:
                held.setdefault(k, set()).add(2**63 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            owners = held.get(lower(line.strip(BLANKS)), set())
            if len(owners) < 2 or min(owners) == (2**63 if i is None else i):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(spark):
    long = "\n".join(f"line number {k} of a long text" for k in range(3000))
    rows = [(1, "Shared line here\nown line of one\n\n"), (2, "  SHARED LINE HERE\t\nshort\nshort\nother line of two"), (3, "shared line here"), (4, None), (5, ""), (6, "ééééééééé\nééééééééé"), (7, "éééééééééé"), (8, "éééééééééé"), (9, long), (9, "line number 5 of a long text"), (10, long), (None, "shared line here\nonly null has this"), (None, "only null has this"), (2, "other line of two"), (11, "\x1fcontrol marks stay\x1f"), (12, "control marks stay")]
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()), key=str)
    assert got == dedup_brute(rows)


def test_line_dedup_threshold_and_rows(spark):
    rows = [(1, "a line that three have"), (2, "a line that three have\na line that two have"), (3, "a line that three have\na line that two have")]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs(spark, rows), min_docs=3).collect()}
    assert got == {1: "a line that three have", 2: "a line that two have", 3: "a line that two have"}
    whole = line_dedup.dedup_rows(docs(spark, [*rows, (4, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in whole] == ["a line that three have", "a line that two have", "", None]
    assert {r["did"] for r in whole} == {5} and {r["h"] for r in whole} == {"clash"}
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_whole_and_gapless(spark, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = [(k, "word " * (k * 37 % 400) + "it's Don't é" * (k % 3)) for k in range(60)] + [(100, None), (101, ""), (None, "null id"), (7, "again"), (7, "again"), (102, "long text, with marks! " * 2000)]
    got = packing.pack(docs(spark, rows), path).collect()
    expected = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected.append((i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 2048) + 2
    assert packing.pack(docs(spark, []), path).count() == 0


def test_a_common_length_takes_many_buckets(spark):
    cut = spark.range(200_000).select((F.col("id") % 3).alias("doc_id"), F.when(F.col("id") < 150_000, 2048).otherwise(7).cast("long").alias("length")).withColumn("_row", F.struct("doc_id", F.monotonically_increasing_id().alias("m")))
    sizes = packing.bucketed(cut, [(2048, 150_000), (7, 50_000)], 10_000).groupBy("length", "_b").count().collect()
    assert max(r["count"] for r in sizes) < 11_000 and len(sizes) == 20
    assert sum(r["count"] for r in sizes) == 200_000


def test_many_buckets_stay_gapless(spark, path):
    rows = [(None if k % 5 == 0 else k % 7, "same words in many rows") for k in range(400)]
    got = packing.pack(docs(spark, rows), path, capacity=20, bucket=9).collect()
    assert len(got) == 400
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 20 for v in by.values())


def test_tokenizer_memory_gives_the_same_ids(path):
    kept = packing.CachedTokenizer(path, limit=3)
    for text in ("", "  ", "it's we'll don't 'S x's!", "İstanbul ſ Ǆ é é ǅ Ωσς", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c d 12ab3", "x" * 900 + " " + "é" * 100 + "!" * 90, "THE!! the%%% The,### a'b"):
        for _ in range(2):
            got = np.frombuffer(kept.encode([text, "one two three four five"])[0], "<u4").tolist()
            assert got == kept.tokenizer.encode(text, add_special_tokens=False).ids


def test_frequent_runs_are_remembered_between_tasks(path):
    kept = packing.CachedTokenizer(path)
    texts = ["the same words the same", "", "\xa0other\u2003words\x0bare here"]
    first = kept.encode(texts)
    kept.forget(but=3)
    assert list(kept.young) == ["the", "same", "words"] and not kept.old
    asked, missing = [], kept._missing
    kept._missing = lambda wanted: asked.append(set(wanted)) or missing(wanted)
    assert kept.encode(texts) == first == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in kept.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == 1 and not asked[0] & {"the", "same", "words"}


def test_runs_are_gathered_in_any_steps():
    table, sizes, codes = np.arange(6, dtype="<u4"), np.array([2, 0, 3, 1]), np.array([2, 1, 0, 3, 3, 2])
    expected = np.array([2, 3, 4, 0, 1, 5, 5, 2, 3, 4], "<u4").tobytes()
    assert {packing._gathered(table, sizes, codes, step) for step in (1, 2, 4, 100)} == {expected}
    assert packing._gathered(table, sizes, codes[:0]) == b""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_place_every_piece_once(lengths):
    hist = np.bincount(np.array(lengths, int), minlength=65)
    planned = packing.plan(hist)
    used = np.zeros(65, int)
    for parts, k in planned:
        assert k > 0 and 0 < sum(parts) <= 64
        for n in parts:
            used[n] += k
    assert (used == hist).all()
    seg = packing.segments(planned)
    assert {n for n in range(65) if hist[n]} == set(seg)


def test_least_squares_finds_an_exact_mixture():
    hist = np.zeros(101, int)
    for parts, k in (((60, 40), 50), ((70, 20, 10), 30), ((100,), 5)):
        for n in parts:
            hist[n] += k
    found = packing.patterns(hist)
    x = packing.fit(hist, found, 2000)
    made = np.zeros(101)
    for p, c in zip(found, x, strict=True):
        for n in p:
            made[n] += c
    assert np.abs(made - hist).max() < 0.5 and (x >= 0).all()
    assert sum(k for _, k in packing.plan(hist)) == 85


def test_kept_text_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
