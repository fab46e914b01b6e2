"""Durable runs: transitions, passes, fences, retries, resuming."""

from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.graph.document import import_document
from weftline.operators import durable
from weftline.plans.compiled import Host, compile_graph, with_stored
from weftline.plans.queries import fields, graph, node
from weftline.plans.values import Null, text
from weftline.plans.values import step as field_of

EMPTY = "run_key string, node_id string, " + durable.CLAIM


def rows_of(df):
    return {(r["run_key"], r["node_id"]): r.asDict() for r in df.collect()}


def document(g):
    return import_document(g, lenient=True).graph


def test_transitions_fold_in_order(spark):
    held = spark.createDataFrame([("r", "a", "claimed", [], None, None, "me", 1, 5), ("r", "done", "completed", ["out"], "1", None, "me", 1, 5), ("r", "p", "paused", [], None, "why", "me", 1, 5)], EMPTY)
    changes = [
        ("r", "a", 1, "claim", "you", 9, None, None, None), ("r", "a", 2, "claim", "me", 9, None, None, None),  # the second asks for its own
        ("r", "done", 1, "skip", None, 9, None, None, None), ("r", "done", 2, "claim", "me", 9, None, None, None),
        ("r", "p", 1, "release", None, 9, None, None, None), ("r", "p", 2, "claim", "new", 11, None, None, None), ("r", "p", 3, "complete", None, 11, "null", ["x"], None),
        ("s", "f", 1, "fail", None, 9, None, None, "bad"), ("s", "g", 1, "skip", None, 9, None, None, None), ("s", "h", 1, "claim", "w", 3, None, None, None), ("s", "h", 2, "pause", None, 3, None, None, "wait"),
    ]
    asked = spark.createDataFrame(changes, "run_key string, node_id string, seq int, op string, owner string, at long, output string, ports array<string>, error string")
    got = rows_of(durable.folded(asked, held))
    pick = lambda k, *names: tuple(got[k][n] for n in names)
    assert pick(("r", "a"), "status", "owner", "attempts", "first_attempt_at") == ("claimed", "me", 2, 5)
    assert pick(("r", "done"), "status", "ports", "output") == ("completed", ["out"], "1")
    assert pick(("r", "p"), "status", "owner", "attempts", "first_attempt_at", "output", "ports") == ("completed", "new", 1, 11, "null", ["x"])
    assert pick(("s", "f"), "status", "error", "attempts") == ("failed", "bad", 0)
    assert pick(("s", "g"), "status", "attempts", "first_attempt_at") == ("skipped", 0, None)
    assert pick(("s", "h"), "status", "error", "owner") == ("paused", "wait", "w")
    told = {(r["node_id"], r["seq"]): r["applied"] for r in durable.folded(asked, held, outcomes=True).collect()}
    assert not told["a", 1] and told["a", 2] and not told["done", 1] and not told["done", 2] and told["p", 1] and told["p", 2]
    assert durable.folded(asked.limit(0), held).count() == 3 and durable.folded(asked.limit(0), held.limit(0)).count() == 0


def test_a_stored_null_is_not_run_again(spark):
    g = document(graph([node("start", "manual_trigger"), node("x", "variable", {"value": "{{ in.none }}"}), node("end", "output")], "start>x", "x>end"))
    rows = spark.createDataFrame([("r", 1)], "run_key string, v int")
    ran = []

    def once(step):
        ran.append(step.node.id)
        step.abort(True, "it ran again")
        return Null()

    claims = compile_graph(g, rows, "run_key").claims().where("node_id <> 'end'")
    assert rows_of(claims)["r", "x"]["output"] == "null"
    again, stored = with_stored(g, rows, claims)
    result = compile_graph(g, again, "run_key", ["v"], Host({"x": once}), resume=stored).results().first()
    assert result["ok"] and '"end":null' in result["outputs"]


def test_ports_that_are_named_twice_or_by_no_edge(spark):
    g = graph([node("start", "manual_trigger"), node("m", "many"), node("a", "output")], "start>m", "m.a>a")

    def many(step):
        from weftline.plans.values import of_json

        return of_json({"__ports": ["a", "a", "zz"], "value": 7})

    run = compile_graph(g, spark.createDataFrame([("r", 1)], "run_key string, v int"), "run_key", ["v"], Host({"many": many}))
    assert [(r["port_id"], r["value"]) for r in run.published(["m"]).collect()] == [("a", "7"), ("a", "7"), ("zz", "7")]
    outs = [r["port_id"] for r in run.events(["m"]).where("type = 'node-output'").orderBy("seq").collect()]
    assert outs == ["a", "a", "zz"]
    assert rows_of(run.claims())["r", "m"]["ports"] == ["a", "a", "zz"] and run.output("a").count() == 1


def gate(step):
    step.pause(True, "approval", F.lit('{"title":"T"}'))
    return Null()


def test_a_pause_parks_its_run_and_an_answer_resumes_it(spark):
    g = document(graph([node("start", "manual_trigger"), node("ask", "human_approval"), node("side", "transform", fields(v="{{ in.v }}")), node("end", "output")], "start>ask", "start>side", "ask.approved>end"))
    rows = spark.createDataFrame([("r", 1), ("q", 2)], "run_key string, v int")
    c = durable.Coordinator(g, rows, host=Host({"human_approval": gate}))
    got = {r["run_key"]: r for r in c.run_to_completion().collect()}
    assert not got["r"]["ok"] and got["r"]["error"] is None and "approval" in got["r"]["pause"]
    claims = rows_of(c.claims)
    assert claims["r", "ask"]["status"] == "paused" and ("r", "side") not in claims  # a serial run does nothing beside
    pause = c.claims.where("node_id = 'ask' and run_key = 'r'").select(scalars.decoded_pause(F.col("error")).alias("p")).first()["p"]
    assert (pause["node_id"], pause["awaiting"]) == ("ask", "approval")
    freed = durable.folded(spark.createDataFrame([("r", "ask", 1, "release")], "run_key string, node_id string, seq int, op string"), c.claims)
    c = durable.Coordinator(g, rows, claims=freed)
    got = {r["run_key"]: r for r in c.run_to_completion().collect()}
    assert got["r"]["ok"] and '"end"' in got["r"]["outputs"] and not got["q"]["ok"]


def test_failures_stuck_runs_and_fences(spark):
    def bad(step):
        step.abort(text(field_of(step.inputs.fields["in"][1], "v")[1]) == "1", "bad one")
        return step.input_or_all()

    g = document(graph([node("start", "manual_trigger"), node("t", "bad"), node("late", "bad"), node("end", "output")], "start>t", "t>end", "start>late"))
    rows = spark.createDataFrame([("r", 1), ("q", 2)], "run_key string, v int")
    for cap in (0, 1, 3):
        c = durable.Coordinator(g, rows, host=Host({"bad": bad}), max_concurrent=cap)
        got = {r["run_key"]: r for r in c.run_to_completion().collect()}
        assert got["q"]["ok"] and not got["r"]["ok"] and got["r"]["error"] == "bad one"
        assert ("r", "late") not in rows_of(c.claims)  # what comes after a failure is let go
    held = spark.createDataFrame([("r", "start", "claimed", [], None, None, "other", 1, 5)], EMPTY)
    c = durable.Coordinator(g, rows.limit(1), claims=held, host=Host({"bad": bad}))
    assert c.run_to_completion().first()["error"] == durable.STOPPED
    stuck = durable.Coordinator(g, rows.where("v = 2"), host=Host({"bad": bad}))
    assert stuck.run_to_completion(most=1).first()["error"] == durable.STUCK + "t, late, end"
    # a replay of one node runs no other, and an earlier sibling makes it no skip
    claims = compile_graph(g, rows, "run_key").claims().where("node_id = 'start'")
    told = durable.replayed(g, rows.where("v = 2"), claims, "late", host=Host({"bad": bad})).outcomes().collect()
    assert [(r["node_id"], r["status"], r["ports"]) for r in told] == [("late", "completed", ["out"])]
    probe = durable.replayed(g, rows, claims, host=Host({"bad": bad}))
    assert probe.outcomes().count() == 0 and {r["port_id"] for r in probe.published().collect()} == {"out"}


def test_a_loop_within_a_lane_is_the_runs_error(spark):
    g = graph([node("start", "manual_trigger"), node("each", "for_each", {"source": "{{ in.xs }}"}), node("inner", "for_each", {"source": "{{ in }}"}), node("body", "output")], "start>each", "each.item>inner", "inner.item>body")
    rows = spark.createDataFrame([("r", [[1, 2], [3]])], "run_key string, xs array<array<int>>")
    run = compile_graph(g, rows, "run_key", ["xs"])
    assert run.results().count() == 1 and "within another loop" in str(run.published(["each"]).collect())


def test_levels_have_no_limit(spark):
    from weftline.operators.graphs import levels

    n = 40
    nodes = spark.createDataFrame([(1, i) for i in range(n)], "graph_id int, node_id int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "graph_id int, source int, target int")
    assert {r["node_id"]: r["level"] for r in levels(nodes, edges).collect()} == {i: i for i in range(n)}


def test_namespaces_are_the_hosts_to_name():
    from weftline.graph import kinds

    before = kinds.namespaces()
    try:
        kinds.use_namespaces("@acme/", "@a/")
        assert kinds.built_in().get("@a/branch").name == "branch" and kinds.canonical("x") == "@acme/x" and kinds.matches("@a/note", "note")
    finally:
        kinds.use_namespaces(*before)


def test_documents_in_a_table_are_imported_as_one_is(spark):
    import json

    from weftline.graph.document import import_json
    from weftline.operators.graphs import exported, imported

    odd = [
        {"version": 1, "graph": {"nodes": [{"id": "a", "kind": "branch"}, {"id": "b", "kind": "nope"}, {"kind": "log"}, {"id": "n", "kind": "note"}, {"id": "l", "kind": "log"}], "edges": [{"id": "1", "source": "a", "target": "b", "sourceHandle": "true"}, {"id": "2", "source": "x", "target": "b"}, {"id": "3", "source": "l", "target": "b"}, {"id": "4", "source": "b", "target": "y"}]}},
        {"version": 2, "graph": {"nodes": [{"id": "a", "kind": "log"}]}},
        {"version": 1, "graph": {"nodes": [{"id": "a", "kind": "transform", "outputs": []}, {"id": "b", "kind": "log", "outputs": ["out"], "config": {"message": "x"}}, {"id": "c", "kind": "log"}], "edges": [{"id": "1", "source": "a", "target": "b"}, {"id": "2", "source": "b", "target": "a"}]}},
        [1], {"version": 1}, {"version": 1, "graph": {"nodes": [{"id": "only", "kind": "log"}]}},
    ]
    texts = [*map(json.dumps, odd), "no json"]
    df = spark.createDataFrame(list(enumerate(texts)), "graph_id int, document string")
    for lenient in (False, True):
        nodes, edges, issues = imported(df, lenient=lenient)
        got = {}
        for r in issues.collect():
            got.setdefault(r["graph_id"], []).append((r["severity"], r["message"], r["node_id"], r["edge_id"]))
        for i, text in enumerate(texts[:-1]):
            one = import_json(text, lenient=lenient)
            want = [(x.severity, x.message, x.node_id, x.edge_id) for x in one.issues if "is required" not in x.message]
            assert sorted(map(str, got.get(i, []))) == sorted(map(str, want)), i
            assert {n.id for n in one.graph.nodes} == {r["node_id"] for r in nodes.where(f"graph_id = {i}").collect()}
            assert [(e.source, e.target, e.out) for e in one.graph.edges] == [(r["source"], r["target"], r["source_handle"] or "out") for r in edges.where(f"graph_id = {i}").orderBy("place").collect()]
        assert got[len(texts) - 1] == [("error", "Schema is not an object.", None, None)]
    again, drawn, _ = imported(exported(nodes, edges))
    assert sorted(map(tuple, again.select("graph_id", "node_id", "kind", "terminal").collect())) == sorted(map(tuple, nodes.select("graph_id", "node_id", "kind", "terminal").collect()))
    assert drawn.count() == edges.count()


def test_kinds_from_manifests_and_back():
    import pytest

    from weftline.graph import kinds

    manifest = {"name": "@acme/score", "version": "1.0", "label": "Score", "outputs": ["hi", {"id": "lo"}], "inputs": [], "aliases": ["rate"], "defaultConfig": {"top": 3}, "sideEffects": "none", "icon": "star"}
    kind = kinds.kind_of_manifest(manifest)
    assert (kind.outputs, kind.inputs, kind.category, kinds.default_config(kind)) == (("hi", "lo"), (), "custom", {"top": 3})
    assert kinds.kind_of(kinds.kind_value(kind)) == kind
    registry = kinds.built_in().register(kind)
    assert registry.get("rate") is kind and registry.get("@acme/score") is kind
    with pytest.raises(ValueError, match="version"):
        kinds.kind_of_manifest({"name": "@acme/score"})
    assert kinds.kind_of({"label": "x"}) is None
    for built in kinds.built_in().by_id.values():
        again = kinds.kind_of(kinds.kind_value(built))
        assert (again.name, again.inputs, again.outputs, again.aliases, again.side_effects) == (built.name, built.inputs, built.outputs, built.aliases, built.side_effects)


def test_fields_whose_names_hold_marks(spark):
    from weftline.plans.values import field_at

    row = spark.range(1).select(F.parse_json(F.lit('{"a\'b": 1, "c\\"d": 2, "e\'f\\"g": 3, "h.i": 4}')).alias("v"))
    got = row.select(*(F.to_json(field_at(F.col("v"), k)).alias(str(i)) for i, k in enumerate(("a'b", 'c"d', "e'f\"g", "h.i", "none'")))).first()
    assert tuple(got) == ("1", "2", "3", "4", None)


def test_steps_know_who_they_are_in_lanes(spark):
    from weftline.plans.values import Scalar

    def who(step):
        return Scalar(step.step_key, "string")

    g = graph([node("start", "manual_trigger"), node("each", "for_each", {"source": "{{ in.xs }}"}), node("w", "who"), node("top", "who")], "start>each", "each.item>w", "start>top")
    rows = spark.createDataFrame([("r", ["x", "y"])], "run_key string, xs array<string>")
    run = compile_graph(g, rows, "run_key", ["xs"], Host({"who": who}))
    got = {r["node_id"]: r["value"] for r in run.published().collect()}
    assert got["top"] == '"r:top"' and '"results":[{"w":"r:each#0/w"},{"w":"r:each#1/w"}]' in got["each"]


def test_events_of_a_pass_are_handed_on(spark):
    seen = []
    g = document(graph([node("start", "manual_trigger"), node("end", "output")], "start>end"))
    rows = spark.createDataFrame([("r", 1), ("q", 2)], "run_key string, v int")
    c = durable.Coordinator(g, rows, on_events=lambda e: seen.append({(r["run_key"], r["node_id"]) for r in e.where("status = 'done'").collect()}))
    assert c.run_to_completion().where("ok").count() == 2
    assert seen == [{("r", "start"), ("q", "start")}, {("r", "end"), ("q", "end")}]


def test_each_document_is_read_once(spark):
    from pyspark.sql import functions as F

    from weftline.operators.graphs import exported, imported

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def document(i):
        reads.add(1)
        return '{"version": 1, "graph": {"nodes": [{"id": "a", "kind": "log"}, {"id": "b", "kind": "mystery"}], "edges": [{"id": "e", "source": "a", "target": "c"}]}}'

    df = spark.range(3).select(F.col("id").alias("graph_id"), document.asNondeterministic()("id").alias("document"))
    nodes, edges, issues = imported(df, lenient=True)
    again, drawn, _ = imported(exported(nodes, edges), lenient=True)
    assert issues.count() == 3 * 3 and again.count() == 6 and drawn.count() == 0
    assert reads.value == 3


def test_a_pass_without_skips_writes_no_claims(spark, monkeypatch):
    from weftline.operators import durable

    g = graph([node("start", "manual_trigger"), node("end", "output")], "start>end")
    c = durable.Coordinator(import_document(g, lenient=True).graph, spark.createDataFrame([(1, 2)], "run_key long, v long"))
    kept = []
    monkeypatch.setattr(c, "_keep", kept.append)
    assert [r["dispatch"] for r in c.advance().collect()] == [["start"]] and not kept


def test_export_is_one_text_whatever_the_order_of_rows(spark):
    """Nodes are sorted as whole rows, and objects told from other JSON by a letter."""
    import json

    from weftline.operators import graphs

    nodes = [("g", 1, "b", "log", None, '{"x":[1]}', None), ("g", 1, "a", "log", "l", None, "[]"), ("g", 0, "c", "end", None, "7", None)]
    names = "graph_id string, place int, node_id string, kind string, label string, config string, outputs string"
    edges = spark.createDataFrame([], "graph_id string, place int, edge_id string, source string, target string, source_handle string, target_handle string")
    told = [graphs.exported(spark.createDataFrame(rows, names).coalesce(1), edges).first()["document"] for rows in (nodes, nodes[::-1])]
    assert told[0] == told[1]
    assert [n["id"] for n in json.loads(told[0])["graph"]["nodes"]] == ["c", "a", "b"]
    texts = [' \n\t{"version":1}', "[1]", '"{}"', "{", "", None, "null"]
    docs = spark.createDataFrame(list(enumerate(texts)), "graph_id int, document string")
    _, _, issues = graphs.imported(docs)
    assert {r["graph_id"] for r in issues.where("message = 'Schema is not an object.'").collect()} == {1, 2, 3, 4, 5, 6}
