"""Workflow graphs: queries against DuckDB, and the semantics case by case."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.graph import document, kinds
from weftline.operators import durable
from weftline.plans.compiled import CYCLE, Host, compile_graph
from weftline.plans.values import Scalar
from weftline.plans.queries import ORACLE_SQL, QUERIES, chain, fields, graph, node

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return "-"
    if hasattr(v, "item"):
        v = v.item()
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/sf0.001/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, f"{data}/sf0.001").toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    rows = [sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)) for df in (ours, theirs)]
    assert rows[0] == rows[1]


def results(spark, doc, seed, host=None, **more):
    """ok, error and outputs of one run whose seed is a JSON object, typed by Spark."""
    rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(seed)])) if seed else spark.range(1).select(F.lit(1).alias("none"))
    columns = list(seed)
    r = compile_graph(doc, rows.withColumn("run_key", F.lit("r")), "run_key", columns, host, **more)
    row = r.results().first()
    return row["ok"], row["error"], json.loads(row["outputs"]), r


def test_dead_edges_do_not_clobber(spark):
    g = graph([node("s", "manual_trigger"), node("b", "branch", {"condition": "{{ in.x }}"}), node("a", "transform", fields(v="live")), node("c", "transform", fields(v="dead")), node("m", "output")], "s>b", "b.true>a", "b.false>c", "a>m", "c>m")
    ok, _, out, _ = results(spark, g, {"x": 1})
    assert ok and out["m"] == {"v": "live"} and "c" not in out
    assert out["b"] == {"branch": "true", "value": {"x": 1}}


def test_null_payload_is_a_payload(spark):
    g = graph([node("s", "manual_trigger"), node("t", "transform", {"expression": "{{ in.nope }}"}), node("b", "branch", {"condition": "{{ in.x }}"}), node("o", "output")], "s>t", "t>b", "b.false>o")
    ok, _, out, _ = results(spark, g, {"x": 1})
    assert ok and out["o"] is None and out["b"] == {"branch": "false", "value": None}


def test_ports_none_and_undeclared(spark):
    g = graph([node("s", "manual_trigger"), node("e", "custom", outputs=[]), node("o", "custom")], "s>e", "e>o")
    pass_on = Host({"*": lambda step: step.input_or_all()})
    _, _, out, r = results(spark, g, {"x": 1}, pass_on)
    assert "o" not in out
    assert r.published().where("node_id = 'e'").count() == 0


def test_reserved_names_in_data_route(spark):
    g = graph([node("s", "manual_trigger"), node("a", "output"), node("b", "output")], "s.out>a", "s.left>b")
    _, _, out, _ = results(spark, g, {"branch": "left", "n": 3})
    assert "a" not in out and out["b"] == {"branch": "left", "n": 3}


def test_errors_stop_what_comes_after(spark):
    g = graph([node("s", "manual_trigger"), node("x", "agent"), node("y", "output"), node("n", "note")], "s>x", "x>y")
    ok, error, out, r = results(spark, g, {"x": 1})
    assert (ok, error) == (False, "No executor registered for kind=agent") and set(out) == {"s"}
    e = r.events().orderBy("seq").collect()
    assert [x["type"] for x in e if x["node_id"] is None] == ["run-start", "run-end"] and e[-1]["ok"] is False


def test_routing_texts(spark):
    for value, port in (("", "false"), ("  ", "false"), (True, "true"), (0, "false"), (1, "true"), (None, "false"), ("{{ in.x }}!", "true")):
        _, error, out, _ = results(spark, graph([node("s", "manual_trigger"), node("b", "branch", {"condition": value})], "s>b"), {"x": "y"})
        assert error is None and out["b"]["branch"] == port
    for value, part in (("in.x", "is not an expression"), ("{{ in.x", "unclosed expression"), ("{{ a }} {{ b", "unclosed expression")):
        ok, error, _, _ = results(spark, graph([node("s", "manual_trigger"), node("b", "branch", {"condition": value})], "s>b"), {"x": "y"})
        assert not ok and part in error


def test_cycle(spark):
    ok, error, out, r = results(spark, graph([node("a", "transform"), node("b", "transform")], "a>b", "b>a"), {})
    assert (ok, error, out) == (False, CYCLE, {})
    assert [x["type"] for x in r.events().orderBy("seq").collect()] == ["run-error", "run-end"]


def test_loop_results_failures_and_caps(spark):
    def body(step):
        value = step.inputs.fields["in"][1]
        if isinstance(value, Scalar):
            step.abort(value.col == "bad", "refused bad")
        return value

    def loop(**config):
        return graph([node("s", "manual_trigger"), node("each", "for_each", {"source": "{{ in.rows }}"} | config), node("body", "custom"), node("after", "output")], "s>each", "each.item>body", "each.done>after")

    host = Host({"custom": body})
    _, _, out, _ = results(spark, loop(), {"rows": ["ok", "bad", "fine"]}, host)
    assert out["after"]["results"] == [{"body": "ok"}, None, {"body": "fine"}]
    assert out["after"]["failures"] == [{"index": 1, "item": "bad", "error": "refused bad"}] and out["after"]["count"] == 3
    ok, error, _, _ = results(spark, loop(maxItems="2"), {"rows": ["a", "b", "c"]}, host)
    assert not ok and error == 'for_each "each" resolved 3 items exceeds its maxItems cap of 2'
    assert "between 1 and 10000" in results(spark, loop(maxItems=10001), {"rows": ["a"]}, host)[1]

    def pauses(step):
        step.abort(True, scalars.encoded_pause(F.lit("body"), F.lit("input")))
        return step.input_or_all()

    _, error, _, r = results(spark, loop(), {"rows": ["a"]}, Host({"custom": pauses}))
    assert r.pauses().first().asDict() == {"run_key": "r", "node_id": "body", "awaiting": "input", "detail": None}


def test_merge_kinds(spark):
    g = graph([node("m", "merge"), node("c", "merge", {"mode": "concat"})])
    rows = spark.sql("select 'r' as run_key, 1 as n")
    seeds = {"m": {"a": F.expr("named_struct('x', 1, 'y', 2)"), "b": F.expr("named_struct('y', 'z')"), "c": F.lit(5), "d": F.lit(None).cast("string")}, "c": {"a": F.expr("array(1, 2)"), "b": F.lit("t"), "c": F.expr("named_struct('k', 1)")}}
    out = json.loads(compile_graph(g, rows, "run_key", seeds).results().first()["outputs"])
    assert out == {"m": {"x": 1, "y": "z", "c": 5}, "c": [1, 2, "t", {"k": 1}]}
    dyn = {"m": {"a": F.expr("parse_json('{\"x\": 1, \"y\": 2}')"), "b": F.expr("parse_json('{\"y\": 3}')"), "c": F.expr("parse_json('7')"), "d": F.expr("parse_json('null')")}, "c": {"a": F.expr("parse_json('[1]')"), "b": F.expr("parse_json('{\"a\":1}')")}}
    out = json.loads(compile_graph(g, rows, "run_key", dyn).results().first()["outputs"])
    assert out == {"m": {"x": 1, "y": 3, "c": 7}, "c": [1, {"a": 1}]}


def test_templates(spark):
    config = fields(text="{{ in.text }} by {{user.name}}{{nothing}}{{ open", list="{{ in.list.1 }}", plus="{{ in.list.+0 }}", none="{{ in.list.9 }}", whole="{{ $json }}", num="n={{ in.f }} {{ in.b }} {{ in.o }}", seven=7)
    g = graph([node("t", "transform", config)])
    rows = spark.sql("select 'r' as run_key, named_struct('text', 'S', 'list', array('a', 'b'), 'f', 3.0D, 'b', true, 'o', named_struct('k', cast(null as string), 'd', 1e21D)) as `in`, named_struct('name', 'U') as user")
    out = json.loads(compile_graph(g, rows, "run_key", ["in", "user"]).results().first()["outputs"])["t"]
    assert out["text"] == "S by U{{ open" and (out["list"], out["plus"], out["none"], out["seven"]) == ("b", "a", None, 7)
    assert out["num"] == 'n=3 true {"k":null,"d":1000000000000000000000}' and out["whole"]["list"] == ["a", "b"]


def test_number_text(spark):
    given = [0.0, -0.0, 3.0, -2.5, 0.1, 1e21, 1.5e-7, -1.25e-5, 12345678.5, 1e-300, 1234567.25, 1e16, float("nan"), float("inf")]
    want = ["0", "0", "3", "-2.5", "0.1", "1" + "0" * 21, "0.00000015", "-0.0000125", "12345678.5", "0." + "0" * 299 + "1", "1234567.25", "1" + "0" * 16, "NaN", "inf"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, d double").select("i", scalars.number_text(F.col("d")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == want


def test_nested_graphs(spark):
    inner = chain(node("t", "transform", fields(v="{{ in.in.x }}")))
    ok, _, out, _ = results(spark, chain(node("g", "subgraph", {"graph": inner})), {"x": 4})
    assert ok and out["end"]["end"] == {"v": 4}
    deep = {"graph": {}}
    doc = chain(node("t", "transform"))
    for _ in range(10):
        doc = chain(node("g", "subgraph", {"graph": doc}))
    assert "nesting exceeded 8 levels" in results(spark, doc, {"x": 1})[1] and deep
    for config, part in (({}, "no workflow reference"), ({"workflow": "w"}, "no WorkflowResolver is configured")):
        assert part in results(spark, chain(node("f", "subflow", config)), {"x": 1})[1]
    assert results(spark, chain(node("f", "subflow", {"workflow": "w"})), {"x": 1}, Host(workflows={}))[1] == 'subflow "w" was not found'
    bad = chain(node("b", "branch", {"condition": "in.x"}))
    assert "is not an expression" in results(spark, chain(node("g", "subgraph", {"graph": bad})), {"x": 1})[1]


def test_resume_publishes_what_is_stored(spark):
    g = graph([node("s", "manual_trigger"), node("x", "agent"), node("o", "output")], "s>x", "x>o")
    rows = spark.sql("select * from values ('a', named_struct('v', 1)), ('b', null) as t(run_key, stored)")
    got = {r["run_key"]: r for r in compile_graph(g, rows, "run_key", [], resume={"x": F.col("stored")}).results().collect()}
    assert json.loads(got["a"]["outputs"])["o"] == {"v": 1} and got["b"]["error"].startswith("No executor")


def test_catalogue_decides_ports(spark):
    g = graph([node("s", "manual_trigger"), node("f", "for_each", {"source": "{{ in.rows }}"}), node("o", "output")], "s>f", "f.done>o")
    assert "o" in results(spark, g, {"rows": ["a"]})[2]
    assert "o" not in results(spark, g, {"rows": ["a"]}, kinds=False)[2]


def test_documents():
    doc = chain(node("t", "transform", outputs=[], inputs=["in", {"id": "x", "label": "X"}, 3]))
    got = document.import_document(doc)
    assert got.ok is False and any("terminal" in i.message for i in got.issues)  # t has no ports but an edge
    again = document.import_document(document.export_document(got.graph)).graph
    assert again.edges == got.graph.edges and [p.id for p in again.nodes[1].inputs] == ["in", "x"] and again.nodes[0].outputs is None and again.nodes[1].outputs == []
    assert not document.import_document(3).ok and not document.import_document({"version": 2}).ok
    assert document.import_document({"version": 2, "graph": {}}, lenient=True).ok
    assert not document.import_document({"version": 1, "graph": {"nodes": [{"kind": "output"}]}}, lenient=True).ok
    with pytest.raises(document.ImportFailed):
        document.import_json("{")
    lost = document.import_document({"version": 1, "graph": {"nodes": [{"id": "a", "kind": "x"}], "edges": [{"id": "e", "source": "a", "target": "b"}]}}, lenient=True)
    assert lost.ok and not lost.graph.edges and {i.severity for i in lost.issues} == {"warning"}
    floats = document.import_document(graph([node("a", "output"), node("b", "output"), node("n", "note")]))
    assert [i.node_id for i in floats.issues] == ["a", "b"]


def test_kind_ids_and_policy():
    r = kinds.built_in()
    assert r.get(kinds.namespaces()[1] + "transform") is r.get("transform") is r.get("@acme/transform") is r.get(kinds.namespaces()[0] + "transform")
    assert kinds.matches(kinds.namespaces()[1] + "note", "note") and not kinds.matches("@acme/note", "note")
    assert r.get("llm_branch").name == "llm_router" and len({id(k) for k in r.by_id.values()}) == 27
    g = document.import_document(chain(node("t", "transform", {"a": {"b": {"c": "x" * 30}}}))).graph
    assert not document.Policy().inspect(g)
    assert len(document.Policy(max_nodes=1, max_edges=1, max_depth=2).inspect(g)) == 3
    assert any("30 characters" in i.message for i in document.Policy(max_string=10).inspect(g))
    assert len(document.Policy.untrusted().inspect(g)) == 3
    assert [i.severity for i in document.manifest_issues({"name": kinds.namespaces()[0] + "x", "version": "1.0"})] == ["warning"]
    assert document.manifest_issues({"name": "x"}) and not document.manifest_issues({"name": "@a/b", "version": "1", "aliases": []})


def test_frontier_order_and_notes(spark):
    g = document.import_document(graph([node("late", "merge"), node("b", "transform"), node("a", "branch"), node("n", "note"), node("free", "transform")], "a.true>b", "b>late", "a>n"), lenient=True).graph
    claims = spark.sql("select 'r' as run_key, 'a' as node_id, 'completed' as status, array('false') as ports")
    row = durable.frontier(g, spark.sql("select 'r' as run_key"), claims).first()
    assert row["ready"] == ["free"] and row["skipped"] == ["b", "n", "late"] and not row["complete"]


def test_claims_and_submissions(spark):
    claims = spark.sql("select * from values ('r', 'a', 'claimed', 'me', 1, 10L), ('r', 'b', 'completed', 'x', 1, 10L) as t(run_key, node_id, status, owner, attempts, first_attempt_at)")
    asked = spark.sql("select * from values ('r', 'a', 'me', 1), ('r', 'b', 'me', 2), ('r', 'c', 'you', 4), ('r', 'c', 'me', 3) as t(run_key, node_id, owner, seq)")
    got = {r["node_id"]: tuple(r)[2:] for r in durable.claimed(asked, claims, F.lit(99).cast("long")).collect()}
    assert got == {"a": ("claimed", "me", 2, 10), "b": ("completed", "x", 1, 10), "c": ("claimed", "me", 1, 99)}
    waiting = spark.sql("select 'r' as run_key, 'gate' as node_id")
    answers = spark.sql("select * from values ('r', 'gate', 2, 'b'), ('r', 'gate', 1, 'a'), ('r', 'other', 0, 'c') as t(run_key, node_id, seq, value)")
    good, refused = durable.submitted(answers, waiting)
    assert [r["value"] for r in good.collect()] == ["a"] and {r["value"] for r in refused.collect()} == {"b", "c"}


def test_public_names():
    import weftline

    assert all(getattr(weftline, name) is not None for name in weftline.__all__)
    with pytest.raises(AttributeError):
        weftline.nothing  # noqa: B018
