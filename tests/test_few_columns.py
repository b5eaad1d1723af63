"""Queries of a few columns of the parsed records run only what makes these."""
from graphloom.plans import pipeline as P
from graphloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_class_names_and_deps_do_not_write_whole_records(spark):
    P.clear()
    names = Q.REGISTRY["class_names"](spark, SF)
    deps = Q.REGISTRY["autowired_deps"](spark, SF)
    assert P.known(spark, SF, "parsed") is None
    assert "call_list" not in names._jdf.queryExecution().optimizedPlan().toString()
    alone = [sorted(map(repr, x.collect())) for x in (names, deps)]
    P.parsed(spark, SF)
    assert alone == [sorted(map(repr, Q.REGISTRY[q](spark, SF).collect())) for q in ("class_names", "autowired_deps")]
