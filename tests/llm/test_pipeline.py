"""The pipeline and the queries against brute force and SQL."""

import random
import struct
import zlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from driftlens.llm import common, registry, toxicity

from .test_lines_and_packing import dedup_brute
from .test_similarity import copy_labels, leaks_brute

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic words, shared lines, copies, near copies and benchmark passages; a table folder."""
    r = random.Random(12)
    vocab = [f"v{k}" for k in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = say(30)
    base = say(300)
    rows = [(k, say(60) + ("\nthis notice is everywhere" if k % 4 == 0 else "")) for k in range(160)]
    rows = [(k, t + " vilest" * 2) if k % 8 == 3 else (k, t) for k, t in rows]
    rows += [(200 + k, base + f" end{k}") for k in range(6)] + [(300, say(20) + " " + item + " " + say(20)), (301, item), (302, say(3000)), (303, ""), (304, None), (None, "no id here"), (7, "again under seven")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, say(25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 8 == 3)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, [(0, item)], str(path)


def test_pipeline_against_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows, items, path = corpus
    docs = common.table(spark, path, "documents")
    chain = toxicity.train(docs, common.table(spark, path, "labels"))
    scorer = toxicity.Scorer(chain)
    left = [(i, t) for i, t in rows if scorer((t or "").encode())[1] < chain.threshold]
    gone = {i for i, _ in rows} - {i for i, _ in left}
    assert {k for k in range(160) if k % 8 == 3} <= gone and len(gone) <= 21  # the toxic ones go, the others stay
    stage = corpus_pipeline.drop_toxic(spark, docs, path)
    assert stage.columns == corpus_pipeline.COLUMNS
    assert sorted(((x["doc_id"], x["text"]) for x in stage.collect()), key=str) == sorted(left, key=str)

    texts = {(i, n, d, t) for i, n, d, t in dedup_brute(left)}
    kept = sorted(((i, t) for i, _, _, t in texts), key=str)
    one = [kept[k] for k in sorted({k for _, k in copy_labels(kept)})]
    bad = {d for d, *_ in leaks_brute(one, items)}
    assert {300, 301} <= bad
    clean = [(i, t) for i, t in one if i not in bad]
    got = corpus_pipeline.run(spark, path).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in clean:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(struct.pack(f"<{len(ids[k : k + 2048])}I", *ids[k : k + 2048]))) for k in range(0, len(ids), 2048)]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(expected, key=str)


def test_stages_take_an_empty_table(spark, corpus):
    _, _, path = corpus
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, path), f"empty-{name}")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_on_the_smallest_tables(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    df = registry.QUERIES[name](spark, DATA)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got
    if name in registry.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
        want = con.sql(registry.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == sorted(want.select(*df.columns).fetchall(), key=str)
