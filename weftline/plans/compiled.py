"""A workflow graph compiled to one DataFrame plan: a row is a run, ports are conditions, errors are data.

The texts of errors, warnings and statuses here are fixed values: documents and other runners find them equal.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import escape_segment, is_pause
from weftline.graph.document import Edge, Graph, Node, import_document, possible_ports
from weftline.graph.kinds import Registry, bare, built_in, matches, variants
from weftline.operators.nodes import OPERATORS, Step, all_of, echoed
from weftline.plans.values import (
    Arr,
    Cond,
    Dyn,
    Null,
    Obj,
    Scalar,
    Value,
    choose,
    col_of,
    either,
    field_at,
    is_null,
    json_text,
    leaves,
    no,
    nulled,
    of_column,
    struct,
)

CYCLE = "Cycle detected in flow graph — aborting."  # fixed value

Operator = Callable[[Step], Value]


@dataclass
class Host:
    """What a workflow meets outside of itself; what is not given is the offline stand-in."""

    executors: dict[str, Operator] = field(default_factory=dict)
    workflows: dict[str, dict] | None = None
    store: DataFrame | None = None  # table, key, value (JSON)
    memory: DataFrame | None = None  # key, value (JSON)
    http: Callable[[str, Column, object, Value], Obj] | None = None
    search: Callable[[Scalar, int], Value] | None = None
    model: Callable[[Column, Obj], Value] | None = None  # of the prompt and the node's options
    tool: Callable[[str, Value], Value] | None = None  # of the tool's name and its arguments
    notifier: Callable[[Column, Column, Column], Column] | None = None  # of channel, receiver and message: null, or why it failed

    def executor(self, node: Node) -> Operator | None:
        """By node id, then by any spelling of the kind, then the one for all."""
        names = [node.id, *variants(node.kind), "*"]
        return next((self.executors[n] for n in names if n in self.executors), None)


@dataclass
class Published:
    """A port that a node may have published: when, its name, what it carries. With many, port is an array of names."""

    when: Cond
    port: str | Column
    value: Value
    many: bool = False

    def names(self) -> Column:
        """The names as an array, null where nothing is published."""
        names = self.port if self.many else F.array(F.lit(self.port) if isinstance(self.port, str) else self.port)
        return F.when(col_of(self.when), names)


class Compiler:
    """Walks a graph in its order and adds each node's columns to the frame.

    In a lane the plan is an expression over the item; nothing is added to the frame there.
    """

    def __init__(self, graph: Graph, frame: DataFrame | None, host: Host, kinds: Registry | None = None, depth: int = 0, parent: Compiler | None = None, inline: bool = False):
        self.graph, self.host, self.kinds, self.depth, self.inline = graph, host, kinds, depth, inline
        self.known = kinds or built_in()
        self.root = parent.root if parent else self
        if parent is None:
            self.frame, self.columns = frame, 0
        self.err: Column | None = None
        self.done: dict[str, Cond] = {}
        self.active: dict[str, Cond] = {}
        self.result: dict[str, Value] = {}
        self.published: dict[str, list[Published]] = {}
        self.events: list[tuple[Cond, dict]] = []
        self.effects: list[tuple[Cond, str, Column]] = []
        self.pending: dict[str, Column] = {}
        self.skipped: dict[str, Cond] = {}
        self.failed: dict[str, Cond] = {}
        self.may_run: dict[str, Column] | None = None  # None: every node may
        self.attempts: dict[str, Column] = {}
        self.path: list[Column] = []  # rendered segments of the invocations that led here
        self.key = parent.key if parent else None
        self.ran: dict[str, Cond] = {}
        self.errors: dict[str, Column] = {}

    # -- columns of the frame

    def keep(self, col: Column) -> Column:
        if self.inline:
            return col
        root = self.root
        name = f"__{root.columns}"
        root.columns += 1
        root.pending[name] = col
        return F.col(name)

    def flush(self) -> None:
        root = self.root
        if root.pending:
            root.frame = root.frame.withColumns(root.pending)
            root.pending = {}

    def type_of(self, col: Column) -> T.DataType:
        self.flush()
        return self.root.frame.select(col.alias("c")).schema["c"].dataType

    def held(self, cond: Cond) -> Cond:
        return cond if isinstance(cond, bool) else self.keep(cond)

    # -- the walk

    def run(self, seeds: dict[str, Obj], resumed: dict[str, tuple[Cond, Value]] | None = None) -> None:
        order = self.graph.order()
        if order is None:
            self.err = F.lit(CYCLE)
            self.event(True, type="run-error", error=CYCLE)
        else:
            self.event(True, type="run-start")
            for node in order:
                self.visit(node, seeds.get(node.id, Obj()), (resumed or {}).get(node.id))
        ok = F.lit(True) if self.err is None else self.err.isNull()
        self.event(True, type="run-end", ok=ok)
        if not self.inline:
            self.flush()

    def clear(self) -> Cond:
        return True if self.err is None else self.err.isNull()

    def lit(self, edge: Edge) -> tuple[Cond, Value]:
        """Whether an edge carries a value, and which; the last publication of a port counts."""
        when: Cond = False
        value: Value = Null()
        for p in self.published.get(edge.source, ()):
            if p.many:
                here = all_of(p.when, F.coalesce(F.array_contains(p.port, edge.out), F.lit(False)))
            elif isinstance(p.port, Column):
                here = all_of(p.when, F.coalesce(p.port == edge.out, F.lit(False)))
            else:
                here = p.when if p.port == edge.out else False
            if here is not False:
                value = choose(here, p.value, value) if when is not False else p.value
                when = either(when, here)
        return when, value

    def inputs(self, node: Node, seed: Obj) -> Obj:
        fields = dict(seed.fields)
        for edge in self.graph.incoming(node.id):
            when, value = self.lit(edge)
            if when is False:
                continue
            there, before = fields.get(edge.into, (False, Null()))
            fields[edge.into] = (either(there, when), value if there is False else choose(when, value, before))
        if set(fields) == {e.into for e in self.graph.incoming(node.id)} and len(fields) == 1:
            fields = {k: (True, v) for k, (_, v) in fields.items()}  # a node that runs has it
        return Obj(fields)

    def visit(self, node: Node, seed: Obj, stored: tuple[Cond, Value] | None) -> None:
        clear = self.clear()
        incoming = self.graph.incoming(node.id)
        self.undelivered(node, incoming, clear)
        gate: Cond = not incoming
        for edge in incoming:
            gate = either(gate, self.lit(edge)[0])
        fresh = True if stored is None else no(stored[0])
        may = True if self.may_run is None else self.may_run.get(node.id, False)
        active = self.held(all_of(clear, gate, fresh, may))
        self.ran[node.id] = active
        self.active[node.id] = active
        self.skipped[node.id] = all_of(clear, fresh, no(gate))
        self.event(self.skipped[node.id], type="node-status", node_id=node.id, status="idle", text="skipped")
        visual = self.visual(node)
        if visual:
            self.skipped[node.id] = all_of(clear, fresh)
            self.event(active, type="node-status", node_id=node.id, status="idle", text=visual)
            self.done[node.id] = False
            return
        if active is False:  # no edge into it can ever be lit
            self.done[node.id] = False
            return
        self.event(active, type="node-status", node_id=node.id, status="running")
        step = Step(node, self.inputs(node, seed), self)
        operator = self.host.executor(node)
        if operator is None:
            kind = self.known.get(node.kind)
            operator = OPERATORS.get(kind.name if kind else "") if bare(node.kind) == node.kind or kind else None
        if operator is None:
            step.abort(True, f"No executor registered for kind={node.kind}")
            result: Value = Null()
        else:
            result = operator(step)
        for level, message in step.logs:
            self.event(all_of(active, message.isNotNull()), type="log", node_id=node.id, level=level, message=message)
        done = active
        if step.aborts:
            message = None
            for when, text in step.aborts:
                held = F.lit(when) if isinstance(when, bool) else F.coalesce(when, F.lit(False))
                message = F.when(held, text) if message is None else message.when(held, text)
            message = F.when(col_of(active), message)
            if self.may_run is None:
                err = self.err = self.keep(message if self.err is None else F.coalesce(self.err, message))
            else:  # nodes behind fences fail each for itself
                err = self.keep(message)
            self.errors[node.id] = err
            failed = self.failed[node.id] = all_of(active, err.isNotNull())
            self.event(failed, type="node-status", node_id=node.id, status="error", text=err)
            self.event(failed, type="log", node_id=node.id, level="error", message=err)
            done = self.held(all_of(active, err.isNull()))
        self.effects += [(done, node.id, e) for e in step.effects]
        if stored is not None:
            result = choose(no(fresh), stored[1], result)
            done = self.held(either(all_of(clear, no(fresh)), done))
        result = leaves(result, self.keep)
        self.result[node.id], self.done[node.id] = result, done
        self.published[node.id] = [Published(self.held(all_of(done, p.when)), p.port if isinstance(p.port, str) else self.keep(p.port), p.value, p.many) for p in self.ports(node, result) if p.when is not False]
        for p in self.published[node.id]:
            self.event(p.when, type="node-output", node_id=node.id, port_id=p.port, many=p.many, value=json_text(p.value))
        self.event(done, type="node-status", node_id=node.id, status="done", text=None if stored is None else F.when(col_of(no(fresh)), F.lit("resumed")))
        if not self.inline:
            self.flush()

    def visual(self, node: Node) -> str | None:
        if matches(node.kind, "note"):
            return "annotation"
        kind = self.kinds.get(node.kind) if self.kinds else None
        return {"layout": "lane", "annotation": "annotation"}.get(kind.category) if kind else None

    def declared(self, node: Node) -> list[str]:
        if node.outputs is not None:
            return [p.id for p in node.outputs]
        kind = self.kinds.get(node.kind) if self.kinds else None
        return list(kind.outputs) if kind and kind.outputs is not None else ["out"]

    def ports(self, node: Node, result: Value) -> list[Published]:
        """The ports that a result lights: __port, else __ports, else branch, else all that are declared."""
        out: list[Published] = []
        left: Cond = True

        def take(when: Cond, port: str | Column, value: Value, many: bool = False) -> None:
            if left is False or when is False:
                return
            out.append(Published(all_of(left, when), port, value, many))

        if isinstance(result, Obj):
            fields, whole = result.fields, no(result.null)
            there, value = fields.get("value", (False, Null()))
            payload = nulled(value, no(there))
            one, name = fields.get("__port", (False, Null()))
            if isinstance(name, Scalar) and name.type == "string":
                when = all_of(whole, one, no(is_null(name)))
                take(when, name.col if name.const is None else name.const, payload)
                left = all_of(left, no(when))
            some, many = fields.get("__ports", (False, Null()))
            if isinstance(many, Arr):
                when = all_of(whole, some, many.col.isNotNull())
                if isinstance(many.element, T.StringType):
                    take(when, F.array_compact(many.col), payload, many=True)
                elif isinstance(many.element, T.VariantType):
                    take(when, _texts(many.col), payload, many=True)
                left = all_of(left, no(when))
            elif isinstance(many, Obj):
                when = all_of(whole, some, no(many.null))
                for h, (present, own) in many.fields.items():
                    take(all_of(when, present), h, own)
                left = all_of(left, no(when))
            took, to = fields.get("branch", (False, Null()))
            if isinstance(to, Scalar) and to.type == "string":
                when = all_of(whole, took, no(is_null(to)))
                take(when, to.col if to.const is None else to.const, choose(there, value, result))
                left = all_of(left, no(when))
        elif isinstance(result, Dyn):
            get = lambda key, kind: F.try_variant_get(result.col, f"$['{key}']", kind)
            is_text = lambda key: F.coalesce(F.schema_of_variant(get(key, "variant")) == "STRING", F.lit(False))
            value = get("value", "variant")
            when = is_text("__port")
            take(when, get("__port", "string"), Dyn(value))
            left = ~when
            listed = F.coalesce(F.schema_of_variant(get("__ports", "variant")).startswith("ARRAY"), F.lit(False))
            take(listed, _texts(get("__ports", "array<variant>")), Dyn(value), many=True)
            mapped = F.coalesce(F.schema_of_variant(get("__ports", "variant")).startswith("OBJECT"), F.lit(False))
            own = get("__ports", "map<string,variant>")
            for h in self.handles(node):
                take(all_of(mapped, F.coalesce(F.map_contains_key(own, h), F.lit(False))), h, Dyn(F.element_at(own, h)))
            left = all_of(left, ~listed, ~mapped)
            when = is_text("branch")
            take(when, get("branch", "string"), Dyn(F.when(value.isNotNull(), value).otherwise(result.col)))
            left = all_of(left, ~when)
        for port in self.declared(node):
            take(True, port, result)
        return out

    def handles(self, node: Node) -> list[str]:
        """Names under which anything can tell a port: those that edges read and those that are declared."""
        return list(dict.fromkeys([*(e.out for e in self.graph.edges if e.source == node.id), *self.declared(node)]))

    def undelivered(self, node: Node, incoming: list[Edge], clear: Cond) -> None:
        """The warnings that an edge reads a port which its source ran without publishing and never publishes."""
        for edge in incoming:
            source = self.graph.node(edge.source)
            if source is None or edge.out in possible_ports(source, self.known):
                continue
            when = all_of(clear, self.done.get(edge.source, False), no(self.lit(edge)[0]))
            if when is False:
                continue
            message = F.lit(f'Edge {edge.id} reads port "{edge.out}" from node {edge.source}, which never publishes it — nothing would reach {edge.target} at run time.')
            names = _all_names(self.published.get(edge.source, ()))
            parts = [message, F.when(F.size(names) > 0, F.concat(F.lit(" Available: "), F.array_join(F.array_distinct(names), ", "), F.lit("."))).otherwise(F.lit(""))]
            kind = self.known.get(source.kind)
            if kind and isinstance(kind.shape, tuple) and edge.out in kind.shape:
                parts.append(F.lit(f' Note: "{edge.out}" is a FIELD this node emits, not a port — read it downstream as {{{{ in.{edge.out} }}}} rather than naming it as a source handle.'))
            if edge.source_handle:
                parts.append(F.lit(" Leave sourceHandle off to read the node's output."))
            detail = json.dumps({"edge": edge.id, "source": edge.source, "sourceHandle": edge.source_handle}, separators=(",", ":"))
            self.event(when, type="log", node_id=node.id, level="warn", message=F.concat(*parts), detail=detail)

    def event(self, when: Cond, **fields: object) -> None:
        if when is not False and not self.inline:
            self.events.append((when, fields))

    # -- what operators ask for

    def lane(self, node_id: str) -> Graph | None:
        """The nodes that follow the loop's `item` and not its `done`; None without an `item` edge."""
        starts = [e.target for e in self.graph.edges if e.source == node_id and e.out == "item"]
        if not starts:
            return None
        body = self.graph.reach(starts) - self.graph.reach([e.target for e in self.graph.edges if e.source == node_id and e.out == "done"]) - {node_id}
        return Graph([n for n in self.graph.nodes if n.id in body], [e for e in self.graph.edges if e.source in body and e.target in body])

    def lane_result(self, step: Step, lane: Graph, item: Value, index: Column) -> tuple[Column, Column]:
        host = replace(self.host, executors={k: v for k, v in self.host.executors.items() if self.graph.node(k) is None})
        inner = Compiler(lane, None, host, self.kinds, self.depth + 1, self, inline=True)
        inner.path = [*self.path, F.concat(escape_segment(F.lit(step.node.id)), F.lit("#"), index.cast("string"))]
        seeds: dict[str, Obj] = {}
        for e in self.graph.edges:
            if e.source == step.node.id and e.out == "item" and lane.node(e.target):
                seeds.setdefault(e.target, Obj()).fields[e.into] = (True, item)
        inner.run(seeds)
        value = Obj({k: (inner.done[k], inner.result[k]) for k in sorted(inner.result) if inner.done[k] is not False})
        return struct(value), F.lit(None).cast("string") if inner.err is None else inner.err

    def child(self, step: Step, document: dict) -> Value:
        """A nested document in place: its entry nodes get this node's inputs, its outputs are the result."""
        graph = import_document(document, lenient=True).graph
        inner = Compiler(graph, None, replace(self.host, executors={}), built_in(), self.depth + 1, self, self.inline)
        inner.path = [*self.path, escape_segment(F.lit(step.node.id))]
        fed = {e.target for e in graph.edges}
        inner.run({n.id: step.inputs for n in graph.nodes if n.id not in fed})
        if inner.err is not None:
            step.abort(inner.err.isNotNull(), inner.err)
        return Obj({k: (inner.done[k], inner.result[k]) for k in sorted(inner.result) if inner.done[k] is not False})

    def http(self, method: str, url: Column, headers: object, body: Value) -> Obj:
        return (self.host.http or echoed)(method, url, headers, body)

    def search(self, query: Scalar, k: int) -> Value:
        return self.host.search(query, k) if self.host.search else Arr(F.array().cast("array<string>"), T.StringType())

    def memory(self, key: str) -> Value:
        if self.host.memory is None:
            return Null()
        return self._one(self.host.memory.where(F.col("key") == key))

    def _one(self, rows: DataFrame) -> Value:
        return Dyn(F.parse_json(rows.agg(F.first("value")).scalar()))

    def stored(self, table: str, key: object) -> Value:
        from weftline.plans.values import of_json, text

        if self.host.store is None:
            return Null()
        return self._one(self.host.store.where((F.col("table") == table) & (F.col("key") == text(of_json(key)))))

    def stored_list(self, table: str) -> Value:
        """All rows of a table as one object, in the order of keys."""
        if self.host.store is None:
            return Obj()
        rows = self.host.store.where(F.col("table") == table).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("rows"))
        body = F.array_join(F.transform("rows", lambda r: F.concat(json_text(Scalar(r["key"], "string")), F.lit(":"), r["value"])), ",")
        return Dyn(F.parse_json(rows.select(F.concat(F.lit("{"), body, F.lit("}"))).scalar()))

    def stored_query(self, table: str, where: dict[str, Value]) -> Value:
        """The rows whose fields are all equal to what is asked, in the order of keys."""
        if self.host.store is None:
            return Arr(F.array().cast("array<variant>"), T.VariantType())
        if where and not self.inline:
            return self._joined(table, where)
        rows = self.host.store.where(F.col("table") == table).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("rows"))
        listed = self.keep(rows.select(F.to_json(F.transform("rows", lambda r: r["value"]))).scalar())
        found = F.transform(F.from_json(listed, "array<string>"), lambda r: F.parse_json(r))
        def equal(key: str, wanted: Column) -> Callable[[Column], Column]:
            return lambda r: F.coalesce(F.to_json(field_at(r, key)) == wanted, F.lit(False))

        for key, value in where.items():
            found = F.filter(found, equal(key, json_text(value)))
        return Arr(found, T.VariantType())


    def _joined(self, table: str, where: dict[str, Value]) -> Value:
        """The runs meet the rows that they ask for in a join on the asked fields; only rows with the same fields stand together."""
        root = self.root
        n = root.columns
        asked = {f"__w{n}_{i}": self.keep(json_text(v)) for i, v in enumerate(where.values())}
        self.flush()
        root.columns += 1
        had = self.host.store.where(F.col("table") == table).withColumn("__row", F.parse_json("value"))
        fields = [F.to_json(field_at(F.col("__row"), k)).alias(name) for k, name in zip(where, asked, strict=True)]
        had = had.select("key", "value", *fields).groupBy(*asked).agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda r: r["value"]).alias(f"__rows{n}"))
        match = None
        for name, column in asked.items():
            same = column == F.col(name)
            match = same if match is None else match & same
        root.frame = root.frame.join(had, match, "left").drop(*asked)
        found = self.keep(F.transform(F.coalesce(f"__rows{n}", F.array().cast("array<string>")), lambda r: F.parse_json(r)))
        return Arr(found, T.VariantType())


@dataclass
class Run:
    """The compiled runs; each method is a projection of one plan."""

    frame: DataFrame
    key: str
    compiler: Compiler

    def _error(self) -> Column:
        return F.lit(None).cast("string") if self.compiler.err is None else self.compiler.err

    def results(self) -> DataFrame:
        """run_key, ok, error and outputs (JSON, by node id)."""
        c = self.compiler
        outputs = Obj({k: (c.done[k], c.result[k]) for k in sorted(c.result)})
        return self.frame.select(F.col(self.key), self._error().isNull().alias("ok"), self._error().alias("error"), json_text(outputs).alias("outputs"))

    def output(self, node_id: str, flat: bool = True) -> DataFrame:
        """The runs that finished a node, with its result: a column for each field, or `value`."""
        c = self.compiler
        value, done = c.result[node_id], c.done[node_id]
        rows = self.frame if done is True else self.frame.where(col_of(done))
        if flat and isinstance(value, Obj):
            return rows.select(F.col(self.key), *(F.when(col_of(p), struct(v)).alias(k) if p is not True else struct(v).alias(k) for k, (p, v) in value.fields.items()))
        return rows.select(F.col(self.key), struct(value).alias("value"))

    def errors(self) -> DataFrame:
        return self.frame.select(F.col(self.key), self._error().alias("error")).where("error is not null")

    def pauses(self) -> DataFrame:
        from weftline.functions.scalars import decoded_pause

        return self.errors().select(self.key, decoded_pause(F.col("error")).alias("pause")).where("pause is not null").select(self.key, "pause.*")

    def claims(self) -> DataFrame:
        """What a durable run keeps: run_key, node_id, status, ports, output (JSON) and error; untouched nodes have no row."""
        c, parts = self.compiler, []
        none = F.lit(None).cast("string")

        def row(when: Cond, node: str, status: Column, ports: Column, output: Column, error: Column) -> None:
            if when is not False:
                parts.append(F.when(col_of(when), F.struct(F.lit(node).alias("node_id"), status.alias("status"), ports.alias("ports"), output.alias("output"), error.alias("error"))))

        empty = F.array().cast("array<string>")
        for n in c.active:
            ports = _all_names(c.published.get(n, ()))
            if n in c.result:
                row(c.done[n], n, F.lit("completed"), ports, json_text(c.result[n]), none)
            row(c.skipped.get(n, False), n, F.lit("skipped"), empty, none, none)
            if n in c.failed:
                row(c.failed[n], n, F.when(is_pause(c.err), F.lit("paused")).otherwise(F.lit("failed")), empty, none, self._error())
        return self.frame.select(F.col(self.key), F.explode(F.array_compact(F.array(*parts))).alias("c")).select(self.key, "c.*")

    def published(self, nodes: list[str] | None = None) -> DataFrame:
        """run_key, node_id, port_id and value (JSON) of every port that was lit, of all nodes or those named."""
        parts = []
        for n, ps in self.compiler.published.items():
            for p in ps if nodes is None or n in nodes else ():
                parts.append(_each(p, n))
        if not parts:
            return self.frame.select(F.col(self.key), *(F.lit("").alias(c) for c in ("node_id", "port_id", "value"))).where(F.lit(False))
        return self.frame.select(F.col(self.key), F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("p")).select(self.key, "p.*")

    def outcomes(self) -> DataFrame:
        """run_key, node_id, status, ports, output and error of the nodes that ran in this plan, not of those resumed or fenced."""
        c, parts = self.compiler, []
        none = F.lit(None).cast("string")
        for n, ran in c.ran.items():
            error = c.errors.get(n, none)
            status = F.when(error.isNull(), "completed").when(is_pause(error), "paused").otherwise("failed")
            output = json_text(c.result[n]) if n in c.result else F.lit("null")
            row = F.struct(F.lit(n).alias("node_id"), status.alias("status"), F.when(error.isNull(), _all_names(c.published.get(n, ()))).otherwise(F.array().cast("array<string>")).alias("ports"), F.when(error.isNull(), output).alias("output"), error.alias("error"))
            if ran is not False:
                parts.append(F.when(col_of(ran), row))
        if not parts:
            return self.frame.select(F.col(self.key)).where(F.lit(False)).selectExpr(self.key, "'' as node_id", "'' as status", "cast(array() as array<string>) as ports", "'' as output", "'' as error")
        return self.frame.select(F.col(self.key), F.explode(F.array_compact(F.array(*parts))).alias("o")).select(self.key, "o.*")

    def effects(self) -> DataFrame:
        """run_key, node_id and effect (JSON): what a sink is to do outside; key it by step_key, for tasks may repeat."""
        parts = [F.when(col_of(w), F.struct(F.lit(n).alias("node_id"), e.alias("effect"))) for w, n, e in self.compiler.effects]
        if not parts:
            return self.frame.select(F.col(self.key), F.lit("").alias("node_id"), F.lit("").alias("effect")).where(F.lit(False))
        return self.frame.select(F.col(self.key), F.explode(F.array_compact(F.array(*parts))).alias("e")).select(self.key, "e.*")

    def events(self, nodes: list[str] | None = None) -> DataFrame:
        """run_key, seq and the fields of each event, in order; with nodes, those of these nodes alone, numbered among themselves."""
        kinds = {"type": "string", "node_id": "string", "status": "string", "text": "string", "port_id": "string", "value": "string", "level": "string", "message": "string", "detail": "string", "ok": "boolean", "error": "string"}
        parts = []
        for when, fields in self.compiler.events:
            if nodes is not None and fields.get("node_id") not in nodes:
                continue
            names = fields["port_id"] if fields.get("many") else None
            told = fields | {"port_id": None} if names is not None else fields
            cols = {k: (v if isinstance(v := told.get(k), Column) else F.lit(v)).cast(t).alias(k) for k, t in kinds.items()}
            parts.append(F.when(col_of(when), _event(cols, names)))
        if not parts:
            return self.frame.select(F.col(self.key)).where(F.lit(False)).select(self.key, F.lit(0).alias("seq"), *(F.lit(None).cast(t).alias(k) for k, t in kinds.items()))
        rows = self.frame.select(F.col(self.key), F.posexplode(F.flatten(F.array_compact(F.array(*parts)))).alias("seq", "e"))
        return rows.select(self.key, "seq", "e.*")


def _each(p: Published, node: str) -> Column:
    value = json_text(p.value)
    return F.transform(p.names(), lambda name: F.struct(F.lit(node).alias("node_id"), name.alias("port_id"), value.alias("value")))


def _event(cols: dict[str, Column], names: Column | None) -> Column:
    """An event as an array of one, or of one for each of the names of ports."""
    one = lambda port: F.struct(*((port if k == "port_id" else c).alias(k) for k, c in cols.items()))
    return F.array(one(cols["port_id"])) if names is None else F.transform(names, lambda name: one(name))


def _texts(listed: Column) -> Column:
    """The texts of an array of variants."""
    return F.transform(F.filter(listed, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), lambda x: F.try_variant_get(x, "$", "string"))


def _all_names(published: list[Published] | tuple) -> Column:
    empty = F.array().cast("array<string>")
    return F.flatten(F.array_compact(F.array(*(p.names() for p in published)))) if published else empty


def compile_graph(
    graph: Graph | dict,
    runs: DataFrame,
    key: str,
    seeds: dict[str, dict[str, Column] | list[str]] | list[str] | None = None,
    host: Host | None = None,
    kinds: Registry | None | bool = True,
    resume: dict[str, Column | tuple[Column, Column]] | None = None,
    may_run: dict[str, Column] | None = None,
    attempts: dict[str, Column] | None = None,
) -> Run:
    """Compile a graph over runs, a row each.

    seeds are the inputs of entry nodes: names of columns for all of them, or by node id names or a dict of
    columns. kinds is the catalogue that a runner may have (True: the built-in one, False: none). resume has,
    by node id, a column of stored results, which counts where it is not null, or a pair of columns: whether there
    is a result, which may well be null, and the result. Where there is one the node is not run but published again.
    may_run has, by node id, where a node may run at all; with it all others are fenced, and each node's error
    stops that node alone. attempts has structs of attempts and first_attempt_at, for operators that ask.
    """
    if isinstance(graph, dict):
        graph = import_document(graph, lenient=True).graph
    registry = built_in() if kinds is True else kinds or None
    compiler = Compiler(graph, runs, host or Host(), registry)
    schema = {f.name: f.dataType for f in runs.schema.fields}
    fed = {e.target for e in graph.edges}
    if seeds is None or isinstance(seeds, list):
        names = seeds if seeds is not None else [c for c in runs.columns if c != key]
        seeds = {n.id: names for n in graph.nodes if n.id not in fed}
    given = {}
    for node, cols in seeds.items():
        if isinstance(cols, dict):
            given[node] = Obj({k: (True, of_column(c, runs.select(c.alias("c")).schema["c"].dataType)) for k, c in cols.items()})
        else:
            given[node] = Obj({c: (True, of_column(F.col(c), schema[c])) for c in cols})
    stored = {}
    for n, c in (resume or {}).items():
        there, value = c if isinstance(c, tuple) else (c.isNotNull(), c)
        stored[n] = (there, of_column(value, runs.select(value.alias("c")).schema["c"].dataType))
    compiler.key, compiler.may_run, compiler.attempts = key, may_run, attempts or {}
    compiler.run(given, stored)
    compiler.flush()
    return Run(compiler.frame, key, compiler)


def with_stored(graph: Graph, runs: DataFrame, claims: DataFrame, key: str = "run_key") -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """runs with what their completed nodes gave, null too, and the columns to resume from: `compile_graph(..., resume=...)`."""
    kept = claims.where("status = 'completed'").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.coalesce("output", F.lit("null")).alias("output")))).alias("__stored"))
    rows = runs.join(kept, key, "left")
    at = {n.id: F.try_element_at("__stored", F.lit(n.id)) for n in graph.nodes}
    return rows, {k: (c.isNotNull(), F.parse_json(c)) for k, c in at.items()}
