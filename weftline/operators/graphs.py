"""Many graphs at once, as tables of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.graph.document import VERSION
from weftline.graph.kinds import Registry, built_in
from weftline.sources.shared import cut


def floating(nodes: DataFrame, edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """Nodes of graphs with more than one node that no edge touches; those that may_float are not named."""
    tied = edges.select(key, F.explode(F.array("source", "target")).alias("node_id"))
    several = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return nodes.where("not may_float").join(several, key, "left_semi").join(tied, [key, "node_id"], "left_anti")


def terminator_edges(nodes: DataFrame, edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """Edges whose source is a terminal node."""
    ends = nodes.where("terminal").select(key, F.col("node_id").alias("source"))
    return edges.join(ends, [key, "source"], "left_semi")


def dangling(nodes: DataFrame, edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """Edges of which an end is no node."""
    own = nodes.select(key, F.col("node_id"))
    lost = [edges.join(own.withColumnRenamed("node_id", end), [key, end], "left_anti") for end in ("source", "target")]
    return lost[0].unionByName(lost[1]).distinct()


def levels(nodes: DataFrame, edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """Each node's longest path from a seed; nodes on or behind a cycle have none. One join a level."""
    links = edges.select(key, "source", "target").distinct()
    waiting = links.groupBy(key, F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("waits"))
    front = cut(nodes.select(key, "node_id").join(waiting, [key, "node_id"], "left_anti").withColumn("level", F.lit(0)))
    done = front
    while True:
        met = done.withColumnRenamed("node_id", "source").join(links, [key, "source"]).select(key, F.col("target").alias("node_id"), "level")
        ready = met.groupBy(key, "node_id").agg(F.count(F.lit(1)).alias("have"), F.max("level").alias("top")).join(waiting, [key, "node_id"]).where("have = waits")
        front = cut(ready.join(done.select(key, "node_id"), [key, "node_id"], "left_anti").select(key, "node_id", (F.col("top") + 1).alias("level")))
        if front.isEmpty():
            return done
        done = cut(done.unionByName(front))


_DOCUMENT = (
    "graph struct<nodes:array<struct<id:string,kind:string,label:string,config:string,outputs:string>>,"
    "edges:array<struct<id:string,source:string,target:string,sourceHandle:string,targetHandle:string>>>"
)


def imported(documents: DataFrame, key: str = "graph_id", text: str = "document", lenient: bool = False, kinds: Registry | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, issues) of a table of JSON documents, by the rules that import_document() has for one.

    nodes have place, node_id, kind, label, config and outputs (JSON), terminal and may_float; edges have place,
    edge_id, source, target, source_handle and target_handle, those of them whose ends are nodes; issues have severity,
    message, node_id and edge_id. A document that is no object, and without `lenient` one of another version, has
    issues alone. What a kind says of its config is not looked at here. Documents are read once, in Spark's own JSON:
    what was read, and the edges with the nodes that they found, are written to the shared folder, from which all else follows.
    """
    registry = kinds or built_in()
    bad = F.lit("warning" if lenient else "error")
    none = F.lit(None).cast("string")
    read = documents.select(key, F.col(text).alias("text"), F.from_json(text, _DOCUMENT).alias("d"))
    whole = F.coalesce(F.col("text").rlike(r"^[ \t\n\r]*\{") & F.try_parse_json("text").isNotNull(), F.lit(False))
    version = F.get_json_object("text", "$.version")
    right = F.coalesce(version == str(VERSION), F.lit(False))
    read = cut(read.select(key, "d", whole.alias("whole"), right.alias("right"), version.alias("version")))
    version = F.col("version")
    issue = lambda rows, severity, message, node=none, edge=none: rows.select(key, severity.alias("severity"), message.alias("message"), node.alias("node_id"), edge.alias("edge_id"))
    issues = [
        issue(read.where("not whole"), F.lit("error"), F.lit("Schema is not an object.")),
        issue(read.where("whole and not right"), bad, F.concat(F.lit("Unsupported workflow schema version: "), F.coalesce(version, F.lit("None")), F.lit(f" (expected {VERSION})"))),
    ]
    good = read.where("whole" if lenient else "whole and right")
    every = good.select(key, F.posexplode("d.graph.nodes").alias("place", "n")).select(key, "place", F.col("n.id").alias("node_id"), F.coalesce("n.kind", F.lit("")).alias("kind"), "n.label", "n.config", "n.outputs")
    known = F.col("kind").isin(*sorted(registry.by_id))
    ends = F.col("kind").isin(*sorted(k for k, v in registry.by_id.items() if v.outputs == ()))
    floats = F.col("kind").isin(*sorted(k for k, v in registry.by_id.items() if v.category in ("annotation", "layout")))
    nodes = every.where("node_id is not null").withColumns({"terminal": F.when(F.col("outputs").startswith("["), F.col("outputs") == "[]").otherwise(ends), "may_float": ~known | floats})
    issues.append(issue(every.where("node_id is null"), F.lit("error"), F.lit("A node has no id.")))
    issues.append(issue(nodes.where(~known), bad, F.concat(F.lit('Unknown kind "'), F.col("kind"), F.lit('" - register it before importing.')), F.col("node_id")))
    drawn = good.select(key, F.posexplode("d.graph.edges").alias("place", "e"))
    drawn = drawn.select(key, "place", *(F.coalesce(f"e.{f}", F.lit("")).alias(n) for f, n in (("id", "edge_id"), ("source", "source"), ("target", "target"))), F.nullif("e.sourceHandle", F.lit("")).alias("source_handle"), F.nullif("e.targetHandle", F.lit("")).alias("target_handle"))
    own = nodes.select(key, "node_id").distinct()
    told = drawn
    for end in ("source", "target"):
        told = told.join(own.select(key, F.col("node_id").alias(end), F.lit(True).alias(f"has_{end}")), [key, end], "left")
    lost = F.when(F.col("has_source").isNull(), F.concat(F.lit('Edge source "'), F.col("source"), F.lit('" not found.'))).when(F.col("has_target").isNull(), F.concat(F.lit('Edge target "'), F.col("target"), F.lit('" not found.')))
    told = cut(told.withColumn("lost", lost).drop("has_source", "has_target"))
    issues.append(issue(told.where("lost is not null"), F.lit("warning"), F.col("lost"), edge=F.col("edge_id")))
    edges = told.where("lost is null").select(*drawn.columns)
    issues.append(issue(floating(nodes, edges, key), F.lit("error"), F.concat(F.lit('Node "'), F.col("node_id"), F.lit('" is connected to nothing.')), F.col("node_id")))
    issues.append(issue(terminator_edges(nodes, edges, key), F.lit("error"), F.concat(F.lit('Edge "'), F.col("edge_id"), F.lit('" reads from "'), F.col("source"), F.lit('", a terminal node.')), F.col("source"), F.col("edge_id")))
    return nodes, edges, reduce(DataFrame.unionByName, issues)


def exported(nodes: DataFrame, edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """(graph_id, document): each graph's nodes and edges as JSON text, in their places; what imported() reads again."""
    node = F.struct("place", F.struct(F.col("node_id").alias("id"), "kind", "label", "config", "outputs").alias("n"))
    edge = F.struct("place", F.struct(F.col("edge_id").alias("id"), "source", "target", F.col("source_handle").alias("sourceHandle"), F.col("target_handle").alias("targetHandle")).alias("e"))
    drawn = edges.groupBy(key).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    told = lambda n: F.struct(n["id"].alias("id"), n["kind"].alias("kind"), n["label"].alias("label"), F.try_parse_json(n["config"]).alias("config"), F.try_parse_json(n["outputs"]).alias("outputs"))
    rows = nodes.groupBy(key).agg(F.sort_array(F.collect_list(node)).alias("nodes")).join(drawn, key, "left")
    body = F.struct(F.transform("nodes", lambda x: told(x["n"])).alias("nodes"), F.coalesce(F.transform("edges", lambda x: x["e"]), F.transform(F.slice("edges", 1, 0), lambda x: x["e"]), F.expr("cast(array() as array<struct<id:string,source:string,target:string,sourceHandle:string,targetHandle:string>>)")).alias("edges"))
    return rows.select(key, F.to_json(F.struct(F.lit(VERSION).alias("version"), body.alias("graph"))).alias("document"))
