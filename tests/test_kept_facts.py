"""Facts that lie together by release pair: the same counts, and no shuffle after the one that deals them."""

import random

import pytest

from driftlens.operators import changes
from driftlens.plans import domain, study
from driftlens.sources import artifacts
from pyspark.sql import functions as F

from . import facts

TABLES = ("symbols", "types", "members", "bases", "vslots", "enumerators")


def shuffles(df) -> int:
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return final.count("Exchange")


def kept(df, folder, name):
    return artifacts.kept_by(df, ["release_pair"], f"{folder}/{name}")


def test_counts_of_kept_facts_equal_the_events(spark, tmp_path):
    sides = facts.tables(spark, 0), facts.tables(spark, 1)
    own = spark.createDataFrame([(c, "lib", f"{c}.h") for c in facts.CASES if c != next(iter(facts.CASES))], "release_pair string, object string, basename string")
    events, tallies = study.classify_facts(*sides, own)
    expected = {tuple(r) for r in events.groupBy("release_pair", "kind", "third_party", "private").count().collect()}
    expected |= {(r["release_pair"], "symbol_version_renamed", False, False, r["renamed"]) for r in tallies.where("renamed > 0").collect()}
    old, new = ({t: kept(side[t], tmp_path, f"{k}{t}") for t in TABLES} for k, side in enumerate(sides))
    got = study.classified_counts(old, new, kept(own, tmp_path, "own"))
    assert {tuple(r) for r in got.select("release_pair", "kind", "third_party", "private", "n").collect()} == expected
    assert expected


def test_null_keys_equal_nothing_where_facts_lie_together(spark):
    schema = "id string, type_id string, name string, value long"
    old = spark.createDataFrame([("a", "t", None, 1), ("a", "t", None, 1), ("a", "t", "x", 1), (None, "t", "x", 1)], schema)
    new = spark.createDataFrame([("a", "t", None, 1), ("a", "t", "x", 2), (None, "t", "x", 1)], schema)
    joined, grouped = (sorted(map(tuple, changes.enumerators(old, new, ["id"], t).collect()), key=str) for t in (False, True))
    assert joined == grouped and len(joined) == 5


def test_q49_public_counts_shuffles_no_facts_again(spark):
    assert shuffles(domain.q49_public_counts(spark, "/root/testdata/sf0.001")) == 0


def test_kept_tables_leave_no_name_and_no_setting(spark, tmp_path):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = artifacts.kept_by(spark.range(100).withColumn("g", F.col("id") % 7), ["g"], f"{tmp_path}/kept")
    assert df.count() == 100 and not [t for t in spark.catalog.listTables() if t.name.startswith("driftlens")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_q48_classified_facts_shuffles_no_facts_again(spark):
    df = domain.q48_classified_facts(spark, "/root/testdata/sf0.001")
    assert shuffles(df) == 0 and "symbol_version_renamed" not in {r["kind"] for r in df.select("kind").distinct().collect()}


def test_q48_classified_facts_sorts_types_and_symbols_only(spark):
    df = domain.q48_classified_facts(spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # types once, symbols by linkage, by name and without digits; members, bases, enumerators and slots are hashed
    assert final.count("Sort [") == 4 and " SortMergeJoin" not in final


def test_q48_deals_pairs_by_number(spark, monkeypatch):
    kept_types, real = {}, artifacts.kept_by
    monkeypatch.setattr(artifacts, "kept_by", lambda df, by, path: kept_types.update({path.split("/")[-1].split("-")[0]: dict(df.dtypes)}) or real(df, by, path))
    rows = domain.q48_classified_facts(spark, "/root/testdata/sf0.001").collect()
    assert kept_types["facts"]["id"] == "bigint" and kept_types["pairs"]["id"] == "string"
    assert all("@" in r["release_pair"] for r in rows) and len(rows) == len({tuple(r)[:4] for r in rows})


def _random_facts(spark, seed):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    at = lambda: (pick("p", "q", "r"), "lib")
    keys = "release_pair string, object string, "
    rows = {
        "symbols": {(*at(), f"{pick('f', 'g', 'h')}{rng.randrange(12)}"): (pick("a", "b", "c"), pick("x", "y", "z", None), pick("V_1", "V_PRIVATE", None), rng.random() < 0.8, pick("int", "const int", None), [pick("int", "long", "long  const")]) for _ in range(90)},
        "types": {(*at(), t): (pick(32, 64, None), pick("/a/h.h", "/b/k.h", "", None)) for t in ("s", "t", "u", None) for _ in range(3)},
        "members": {(*at(), pick("s", "t", None), pick("a", "b", "c", "d", None)): (pick("int", "const int", "int   volatile", "long", None), pick(0, 32, None)) for _ in range(40)},
        "bases": {(*at(), pick("s", "t", None), pick("A", "B", None)): () for _ in range(20)},
        "vslots": {(*at(), pick("s", "t", "u", None), pick("m", "n", "o", None)): (pick(0, 1, 2, None), pick(True, False, None)) for _ in range(40)},
        "enumerators": {(*at(), pick("s", "t", None), pick("E", "F", "G", None)): (pick(0, 1),) for _ in range(30)},
    }
    schemas = {"symbols": "linkage string, pairing string, pretty string, version string, is_function boolean, return_type string, params array<string>", "types": "type_id string, size_bits int, declared_in string", "members": "type_id string, name string, type_name string, offset_bits int", "bases": "type_id string, base string", "vslots": "type_id string, method string, slot int, is_virtual boolean", "enumerators": "type_id string, name string, value int"}
    return {t: spark.createDataFrame([(*k, *v) for k, v in rows[t].items()], keys + schemas[t]) for t in TABLES}


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_random_facts_with_nulls_and_overloads_equal_the_events(spark, tmp_path, seed):
    sides = _random_facts(spark, 2 * seed), _random_facts(spark, 2 * seed + 1)
    own = spark.createDataFrame([("p", "lib", "h.h"), ("p", "lib", None), ("q", "lib", None)], "release_pair string, object string, basename string")
    events, tallies = study.classify_facts(*sides, own)
    expected = {tuple(r) for r in events.groupBy("release_pair", "kind", "third_party", "private").count().collect()}
    expected |= {(r["release_pair"], "symbol_version_renamed", False, False, r["renamed"]) for r in tallies.where("renamed > 0").collect()}
    old, new = ({t: kept(side[t], tmp_path, f"{k}{t}") for t in TABLES} for k, side in enumerate(sides))
    got = study.classified_counts(old, new, kept(own, tmp_path, "own")).select("release_pair", "kind", "third_party", "private", "n").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
