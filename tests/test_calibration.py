from driftlens.operators import headers
from driftlens.plans import study

from . import facts


def test_all_cases_are_judged_right(spark):
    """The named kinds are present, silent cases have no public change, header counters move as told.

    This proves the classifier on facts, not the extraction of facts from binaries.
    """
    old, new = facts.tables(spark, 0), facts.tables(spark, 1)
    own = spark.createDataFrame([(c, "lib", f"{c}.h") for c in facts.CASES], "release_pair string, object string, basename string")
    events, tallies = study.classify_facts(old, new, own)
    got = {}
    for r in study.public_counts(events, tallies).collect():
        got.setdefault(r["release_pair"], {})[r["kind"]] = r["n"]
    counters = {r["release_pair"]: r for r in headers.compare_headers(old["definitions"], new["definitions"], old["macros"], new["macros"], ["release_pair"]).collect()}
    for case, (_, _, kinds, counter) in facts.CASES.items():
        said = set(got.get(case, {}))
        assert kinds <= said and (kinds or not said), (case, said)
        if counter == "none":
            assert case not in counters or counters[case]["inline_body_changed"] == counters[case]["macro_value_changed"] == 0
        elif counter:
            assert counters[case][counter] > 0
    assert len(facts.CASES) == 30
