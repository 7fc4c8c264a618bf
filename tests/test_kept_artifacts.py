"""Artefacts are read one by one, and a study parses them once."""

import gzip
import json

import pytest

from driftlens.plans import domain, study
from driftlens.sources import artifacts

from .test_sources_and_study import folder, wrapped  # noqa: F401 (fixture)

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def plan_of(rank: int) -> dict:
    return wrapped("selection", {"libraries": [{"rank": rank, "binary": "{a}"}]})


def test_files_of_many_artifacts_are_never_read_whole(spark, tmp_path):
    (tmp_path / "many.json").write_text("\n".join(json.dumps(plan_of(k)) for k in range(2000)))
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(name, "20000")
        got = artifacts.read_artifacts(spark, str(tmp_path), "selection")
        assert got.rdd.getNumPartitions() > 1
        assert sorted(r["libraries"][0]["rank"] for r in got.collect()) == list(range(2000))
    finally:
        spark.conf.set(name, before)


def test_layouts_of_artifact_files(spark, tmp_path):
    one = lambda k: json.dumps(plan_of(k))
    (tmp_path / "a.json").write_text("\n" + json.dumps(plan_of(1), indent=1) + "\r\n" + one(2) + "\n\n  \n" + one(3) + "\n")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(f"{one(4)}\n{one(5)}\n".encode()))
    (tmp_path / "c.json").write_text("noise\n" + one(6) + "\n{nope\n" + one(7))
    (tmp_path / "d.json").write_text("")
    got = artifacts.read_artifacts(spark, str(tmp_path), "selection").collect()
    assert sorted(r["libraries"][0]["rank"] for r in got) == [1, 2, 3, 4, 5, 6, 7]
    assert [r["file_name"] for r in artifacts.rejected(spark, str(tmp_path), "selection").collect()] == ["c.json", "c.json"]


def test_kept_studies_parse_nothing_again(spark, folder):  # noqa: F811
    paths = f"{folder}/pairs", f"{folder}/headers"
    plain, kept = study.from_artifacts(spark, *paths), study.from_artifacts(spark, *paths, folder=f"{folder}/kept")
    a, b = study.analyse(plain), study.analyse(kept)
    for name in ("corpus", "filtered", "frequency", "breaks", "churn", "top_churn", "unstable", "layout_enum", "sizes"):
        x, y = getattr(a, name), getattr(b, name)
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect())), name
        assert "from_json" not in plan(y) and "FileScan text" not in plan(y), name


@pytest.mark.parametrize("query", [domain.q71_artifact_rollup, domain.q81_summary_artifact, domain.q73_filtered_totals, domain.q75_top_body_churn, domain.q72_study_frequency, domain.q74_study_churn, domain.q76_layout_and_enums])
def test_queries_parse_nothing_again(spark, query):
    assert "from_json" not in plan(query(spark, SF))
