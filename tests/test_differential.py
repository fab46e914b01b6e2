"""Compiled plans against a walk of one run at a time, on random graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.graph.document import import_document
from weftline.plans.compiled import compile_graph
from weftline.plans.queries import node

FALSE = ("", "0", "false", "no", "off", "null")


def truth(v):
    return v.strip().lower() not in FALSE if isinstance(v, str) else bool(v)


def lookup(path, context):
    at = context
    for i, part in enumerate(path.split(".")):
        if i == 0 and part == "$json":
            at = context.get("in", context)
        elif isinstance(at, dict) and part in at:
            at = at[part]
        else:
            return None
    return at


def evaluate(template, context):
    return lookup(template[2:-2].strip(), context) if isinstance(template, str) and template.startswith("{{") else template


def walk(graph, seed):
    """outputs and error of one run."""
    lit, outputs = {}, {}
    for n in graph.order():
        edges = graph.incoming(n.id)
        live = [e for e in edges if (e.source, e.out) in lit]
        if edges and not live:
            continue
        inputs = dict(seed) if not edges else {}
        inputs |= {e.into: lit[e.source, e.out] for e in live}
        whole = inputs.get("in", inputs)
        c = n.config
        ports, payload = ["out"], None
        if n.kind == "manual_trigger":
            result = inputs
        elif n.kind == "branch":
            port = "true" if truth(evaluate(c["condition"], inputs)) else "false"
            result, ports, payload = {"branch": port, "value": whole}, [port], whole
        elif n.kind == "switch_case":
            key = evaluate(c["value"], inputs)
            key = "" if key is None else json.dumps(key) if not isinstance(key, str) else key
            port = c["cases"].get(key, "default")
            result, ports, payload = {"__port": port, "value": whole}, [port], whole
        elif n.kind == "transform":
            result = {r["key"]: evaluate(r["value"], inputs) for r in c["fields"]}
        elif n.kind == "merge":
            result = {}
            for port, v in inputs.items():
                if isinstance(v, dict):
                    result |= v
                elif v is not None:
                    result[port] = v
        elif n.kind == "gone":
            return outputs, "No executor registered for kind=gone"
        else:
            result, ports = whole, []
        outputs[n.id] = result
        for p in ports:
            lit[n.id, p] = result if n.kind in ("manual_trigger", "transform", "merge") else payload
    return outputs, None


def random_graph(rng):
    nodes, edges = [node("n0", "manual_trigger")], []
    ports = {"n0": ["out"]}
    for i in range(1, rng.randrange(4, 9)):
        kind = rng.choice(["branch", "switch_case", "transform", "transform", "merge", "output", "gone" if rng.random() < 0.3 else "transform"])
        path = rng.choice(["in.x", "in.y", "in.s", "$json.x", "in.k0", "in.none", "a.x", "in.k1.x"])
        config = {"branch": {"condition": "{{ %s }}" % path}, "switch_case": {"value": "{{ %s }}" % path, "cases": {"1": "one", "b": "bee"}}}.get(kind, {})
        if kind == "transform":
            config = {"mode": "fields", "fields": [{"key": f"k{rng.randrange(3)}", "value": rng.choice(["{{ in.x }}", "{{ in.s }}", "{{ in }}", 5, "t", "{{ %s }}" % path])}, {"key": "x", "value": rng.choice([1, 0, 2])}]}
        nodes.append(node(f"n{i}", kind, config))
        ports[f"n{i}"] = {"branch": ["true", "false"], "switch_case": ["one", "bee", "default"], "output": []}.get(kind, ["out"])
        for _ in range(rng.randrange(1, 4)):
            source = f"n{rng.randrange(i)}"
            if ports[source]:
                out = rng.choice(ports[source])
                edges.append({"id": f"e{len(edges)}", "source": source, "target": f"n{i}", "sourceHandle": out, "targetHandle": rng.choice(["in", "in", "a"] if kind != "merge" else ["a", "b"])})
    return {"version": 1, "graph": {"nodes": nodes, "edges": edges}}


SEEDS = [{"x": 1, "y": True, "s": "b"}, {"x": 0, "y": False, "s": "off"}, {"x": 2, "y": None, "s": None}]


@pytest.mark.parametrize("number", range(25))
def test_plan_is_the_walk(spark, number):
    doc = random_graph(random.Random(number))
    graph = import_document(doc, lenient=True).graph
    rows = spark.createDataFrame([(i, s["x"], s["y"], s["s"]) for i, s in enumerate(SEEDS)], "run_key int, x long, y boolean, s string")
    fed = {e.target for e in graph.edges}
    seeds = {n.id: ["x", "y", "s"] for n in graph.nodes if n.id not in fed}
    got = {r["run_key"]: r for r in compile_graph(graph, rows, "run_key", seeds, kinds=False).results().orderBy(F.col("run_key")).collect()}
    for i, seed in enumerate(SEEDS):
        outputs, error = walk(graph, seed)
        assert got[i]["error"] == error
        assert json.loads(got[i]["outputs"]) == outputs, json.dumps(doc)
