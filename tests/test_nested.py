import json

from pelorus.operators.nested import flat_tables, node_table

SCHEMA = "coll_id long, payload string, kind string"


def run(spark, payloads):
    d = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, p in enumerate(payloads)], SCHEMA)
    return sorted((r["coll_id"], r["kind"], r["node_path"], r["parent_path"]) for r in node_table(d).collect())


def test_arrays_objects_nulls_and_depth(spark):
    deep = {"a": 1}
    for _ in range(11):
        deep = {"m_NestedSources": [None, deep]}
    got = run(spark, [None, "", "not json", "[]", {}, {"tasks": None}, {"tasks": {"sources": {}}}, {"tasks": [None, 3, {"ext_sources": [deep], "sources": [{"m_fitPars": {"pars": {"x": 1}}}, {"m_fitPars": {"pars": [None, {}]}}, {"m_fitPars": 5, "m_NestedSources": "no"}]}]}])
    assert (6, "task", "tasks[0]", "") in got and (6, "source", "tasks[0].sources[0]", "tasks[0]") in got
    assert (7, "component", "tasks[2].sources[0].m_fitPars.pars[0]", "tasks[2].sources[0]") in got
    assert (7, "component", "tasks[2].sources[1].m_fitPars.pars[1]", "tasks[2].sources[1]") in got
    assert sum(g[1] == "nested" for g in got) == 11
    assert ("tasks[2].ext_sources[0]" + ".m_NestedSources[1]" * 11) in {g[2] for g in got}
    assert {g[0] for g in got} == {6, 7}
    assert run(spark, []) == []


def test_flat_tables(spark):
    d = spark.createDataFrame([(1, json.dumps({"tasks": [{"jobId": "j", "taskId": 4, "sources": [{"blob": {"Id": "15", "NPix": "many"}}]}]}), None)], SCHEMA)
    t = flat_tables(d)
    assert t["task"].first()["task_id"] == 4
    s = t["source"].first()
    assert s["source_id"] == 15 and s["n_pix"] is None and s["parent_path"] == "tasks[0]"
