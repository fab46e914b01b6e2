"""What each kind of node does, as columns. An operator takes a Step and returns its result; aborts go to step.abort.

The texts of aborts, logs and warnings here are fixed values: documents and other runners find them equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import encoded_pause, escape_segment, is_pause, word_count
from weftline.graph.document import Node
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
    evaluate,
    is_null,
    json_text,
    no,
    nulled,
    of_column,
    of_json,
    resolve,
    step as field_of,
    struct,
    text,
    truthy,
    variant,
    whole,
)

if TYPE_CHECKING:
    from weftline.plans.compiled import Compiler


@dataclass
class Step:
    """One node with its inputs, where the plan has come to."""

    node: Node
    inputs: Obj
    compiler: Compiler
    aborts: list[tuple[Cond, Column]] = field(default_factory=list)
    logs: list[tuple[Column | str, Column]] = field(default_factory=list)
    effects: list[Column] = field(default_factory=list)

    def option(self, key: str, default: object = None) -> object:
        value = self.node.config.get(key)
        return default if value is None else value

    def option_text(self, key: str, default: str) -> str:
        value = self.node.config.get(key)
        return value if isinstance(value, str) else default

    def value(self, key: str) -> Value:
        return evaluate(self.node.config.get(key), self.inputs)

    def input_or_all(self) -> Value:
        there, value = self.inputs.fields.get("in", (False, Null()))
        return choose(there, value, self.inputs)

    def abort(self, when: Cond, message: str | Column) -> None:
        if when is not False:
            self.aborts.append((when, F.lit(message) if isinstance(message, str) else message))

    def log(self, message: Column, level: str = "info") -> None:
        self.logs.append((level, message))

    def pause(self, when: Cond, awaiting: str, detail: Column | None = None) -> None:
        """Park the run on this node until someone answers; detail is JSON."""
        self.abort(when, encoded_pause(F.lit(self.node.id), F.lit(awaiting), detail))

    @property
    def step_key(self) -> Column:
        """The step's identity, the same for every try: run_key:segment/.../node, a loop's lanes by their number."""
        c = self.compiler
        return F.concat(F.col(c.key).cast("string"), F.lit(":"), *(x for p in c.path for x in (p, F.lit("/"))), escape_segment(F.lit(self.node.id)))

    @property
    def attempt(self) -> Column:
        """Which try of this node it is, from 1."""
        told = self.compiler.root.attempts.get(self.node.id)
        return F.lit(1) if told is None else F.coalesce(told["attempts"], F.lit(1))

    @property
    def first_attempt_at(self) -> Column:
        """When its first try was claimed, in milliseconds; null outside of durable runs."""
        told = self.compiler.root.attempts.get(self.node.id)
        return F.lit(None).cast("bigint") if told is None else told["first_attempt_at"]


def lit(value: str) -> Scalar:
    return Scalar(F.lit(value), "string", value, True)


def wrapper(**fields: Value) -> Obj:
    return Obj({k: (True, v) for k, v in fields.items()})


def only(port: Value, value: Value) -> Obj:
    return wrapper(__port=port, value=value)


def routed(step: Step, key: str) -> bool:
    """Whether a routing text may be evaluated; else the run aborts where the node is reached."""
    raw = step.node.config.get(key)
    if not isinstance(raw, str) or not raw.strip():
        return True
    head = f'{step.node.kind} "{step.node.id}" {key} "{raw}"'
    if "{{" not in raw:
        step.abort(True, f"{head} is not an expression -- wrap it: {{{{ {raw} }}}}")
        return False
    rest = raw
    while "{{" in rest:
        rest = rest.split("{{", 1)[1]
        if "}}" not in rest:
            step.abort(True, f"{head} has an unclosed expression -- close every {{{{ with }}}}")
            return False
        rest = rest.split("}}", 1)[1]
    return True


def unresolved(step: Step, key: str, took: Column) -> None:
    """The warning that a route was decided by a path that leads nowhere."""
    raw = step.node.config.get(key)
    path = whole(raw) if isinstance(raw, str) else None
    if path is None:
        return
    found, _ = resolve(path, step.inputs)
    if found is True:
        return
    message = F.concat(
        F.lit(f'Node {step.node.id} took the "'), took, F.lit(f'" port because `{key}` resolved to NOTHING — the path {path.strip()} names no field on this node\'s inputs. That is not the same as a false condition: the route was decided by an absent value rather than by the data.')
    )
    step.logs.append(("warn", F.when(~col_of(found), message)))


def manual_trigger(step: Step) -> Value:
    return step.inputs


def webhook_trigger(step: Step) -> Value:
    there, value = step.inputs.fields.get("payload", (False, Null()))
    return choose(there, value, step.inputs)


def schedule_trigger(step: Step) -> Value:
    out = {"cron": (True, of_json(step.option("cron"))), "timezone": (True, of_json(step.option("timezone", "UTC")))}
    for key, (there, value) in step.inputs.fields.items():
        before = out.get(key)
        out[key] = (True, choose(there, value, before[1])) if before else (there, value)
    return Obj(out)


def user_input(step: Step) -> Value:
    there, value = step.inputs.fields.get("values", (False, Null()))
    return choose(there, value, step.input_or_all())


def human_approval(step: Step) -> Value:
    there, value = step.inputs.fields.get("approved", (False, Null()))
    port = choose(either(no(there), truthy(value)), lit("approved"), lit("denied"))
    return wrapper(branch=port, value=step.input_or_all())


def notify(step: Step) -> Value:
    channel, to = of_json(step.option("channel", "slack")), of_json(step.option("to", ""))
    message = text(step.value("message"))
    step.log(F.concat(F.lit("notify -> "), text(channel), F.lit(":"), text(to)))
    step.effects.append(F.to_json(F.struct(F.lit("notify").alias("effect"), text(channel).alias("channel"), text(to).alias("to"), message.alias("message"))))
    if step.compiler.host.notifier:
        failed = step.compiler.host.notifier(text(channel), text(to), message)
        step.abort(failed.isNotNull(), failed)
    return wrapper(sent=of_json(True), channel=channel, to=to, message=Scalar(message, "string"))


def branch(step: Step) -> Value:
    if not routed(step, "condition"):
        return Null()
    port = choose(truthy(step.value("condition")), lit("true"), lit("false"))
    unresolved(step, "condition", port.col)
    return wrapper(branch=port, value=step.input_or_all())


def switch_case(step: Step) -> Value:
    if not routed(step, "value"):
        return Null()
    key, port = text(step.value("value")), F.lit("default")
    cases = step.option("cases")
    for value, name in reversed(list(cases.items())) if isinstance(cases, dict) else ():
        if isinstance(name, str):
            port = F.when(key == value, F.lit(name)).otherwise(port)
    unresolved(step, "value", port)
    return only(Scalar(port, "string", sure=True), step.input_or_all())


def collection(v: Value) -> Arr:
    """What a loop goes over: an array's items, an object's values, nothing for null, else the value alone."""
    if isinstance(v, Arr):
        return Arr(F.coalesce(v.col, F.array().cast(T.ArrayType(v.element))), v.element)
    if isinstance(v, Null):
        return Arr(F.array().cast("array<string>"), T.StringType())
    if isinstance(v, Scalar):
        kind = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[v.type]
        return Arr(F.when(v.col.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(v.col)), kind)
    if isinstance(v, Obj):
        items = [F.when(col_of(p), F.array(variant(x))).otherwise(F.array().cast("array<variant>")) for p, x in v.fields.values()]
        whole_ = F.concat(*items) if items else F.array().cast("array<variant>")
        return Arr(F.when(col_of(v.null), F.array().cast("array<variant>")).otherwise(whole_), T.VariantType())
    kind = F.coalesce(F.schema_of_variant(v.col), F.lit("VOID"))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(v.col, "$", "array<variant>"))
    mapped = F.when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(v.col, "$", "map<string,variant>")))
    none = F.array().cast("array<variant>")
    return Arr(F.when(kind == "VOID", none).when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), mapped).otherwise(F.array(v.col)), T.VariantType())


DEFAULT_ITEMS, MOST_ITEMS = 1000, 10_000  # fixed values


def for_each(step: Step) -> Value:
    items = collection(step.value("source"))
    lane = None if step.node.config.get("mode") == "collect" else step.compiler.lane(step.node.id)
    count = Scalar(F.size(items.col).cast("bigint"), "bigint")
    if lane is None:
        return wrapper(count=count, items=items)
    name = f'for_each "{step.node.id}"'
    if step.compiler.inline:  # Spark tells no types within a lambda, which a lane's columns need
        step.abort(True, f"{name} with a lane cannot run within another loop's lane")
        return Null()
    if not lane.nodes:
        step.abort(True, f"{name} has an item edge but its derived lane is empty")
        return Null()
    most = step.node.config.get("maxItems")
    try:
        most = DEFAULT_ITEMS if most is None else float(most) if not isinstance(most, bool) else -1.0
    except (TypeError, ValueError):
        most = -1.0
    if not 1 <= most <= MOST_ITEMS:
        step.abort(True, f"{name} maxItems must be between 1 and {MOST_ITEMS}")
        return Null()
    shown = f"{most:g}" if most != int(most) else str(int(most))
    over = F.size(items.col) > most
    step.abort(over, F.concat(F.lit(f"{name} resolved "), F.size(items.col).cast("string"), F.lit(f" items exceeds its maxItems cap of {shown}")))
    run = lambda x, i: step.compiler.lane_result(step, lane, of_column(x, items.element), i)
    taken = F.when(over, F.slice(items.col, 1, 0)).otherwise(items.col)
    outcome = F.transform(taken, lambda x, i: F.struct(*(c.alias(n) for c, n in zip(run(x, i), ("value", "error"), strict=True))))
    outcome = step.compiler.keep(outcome)
    kind = step.compiler.type_of(outcome).elementType
    results = F.transform(outcome, lambda o: F.when(o["error"].isNull(), o["value"]))
    failures = F.filter(F.transform(F.arrays_zip(outcome.alias("o"), taken.alias("item")), lambda z, i: F.struct(i.cast("bigint").alias("index"), z["item"].alias("item"), z["o"]["error"].alias("error"))), lambda f: f["error"].isNotNull())
    paused = F.filter(outcome, lambda o: is_pause(o["error"]))
    step.abort(F.size(paused) > 0, F.get(paused, F.lit(0))["error"])
    item_kind = items.element
    failed = T.StructType([T.StructField("index", T.LongType()), T.StructField("item", item_kind), T.StructField("error", T.StringType())])
    return only(lit("done"), wrapper(items=items, results=Arr(results, kind["value"].dataType), failures=Arr(failures, failed), count=count))


def merge(step: Step) -> Value:
    if step.node.config.get("mode") == "concat":
        parts = []
        for there, value in step.inputs.fields.values():
            keep = ~col_of(is_null(value)) & col_of(there)
            listed = value if isinstance(value, Arr) else None
            parts.append((keep, listed, value))
        kinds = {str(v.element) if lst is not None else {"string": str(T.StringType()), "bigint": str(T.LongType()), "double": str(T.DoubleType()), "boolean": str(T.BooleanType())}.get(getattr(v, "type", ""), "variant") for _, lst, v in parts}
        if len(kinds) == 1 and "variant" not in kinds:
            element = next(v.element if lst is not None else of_type(v) for _, lst, v in parts)
            cols = [F.when(k, v.col if lst is not None else F.array(v.col)).otherwise(F.array().cast(T.ArrayType(element))) for k, lst, v in parts]
            return Arr(F.concat(*cols), element)
        cols = []
        for k, lst, v in parts:
            many = variants_of(v) if lst is not None else collection(v).col if isinstance(v, Dyn) else F.array(variant(v))
            if isinstance(v, Dyn):  # an object is one item here
                kind = F.coalesce(F.schema_of_variant(v.col), F.lit("VOID"))
                many = F.when(kind.startswith("ARRAY"), F.try_variant_get(v.col, "$", "array<variant>")).otherwise(F.array(v.col))
            cols.append(F.when(k, many).otherwise(F.array().cast("array<variant>")))
        return Arr(F.concat(*cols) if cols else F.array().cast("array<variant>"), T.VariantType())
    out: dict[str, tuple[Cond, Value]] = {}

    def put(key: str, there: Cond, value: Value) -> None:
        if there is False:
            return
        before = out.get(key, (False, Null()))
        out[key] = (either(before[0], there), value if before[0] is False else choose(there, value, before[1]))

    for port, (there, value) in step.inputs.fields.items():
        if isinstance(value, Null):
            continue
        if isinstance(value, Obj):
            for key, (present, inner) in value.fields.items():
                put(key, all_of(there, present, no(value.null)), inner)
        elif isinstance(value, Dyn):
            return merged_dynamic(step)
        else:
            put(port, all_of(there, no(is_null(value))), value)
    return Obj(out)


def merged_dynamic(step: Step) -> Value:
    """A merge of what only the rows know, by maps of VARIANT; later keys win."""
    maps = []
    empty = F.expr("cast(map() as map<string,variant>)")
    for port, (there, value) in step.inputs.fields.items():
        v = variant(value)
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        own = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")).otherwise(F.create_map(F.lit(port), v))
        maps.append(F.when(col_of(there) & (kind != "VOID"), own).otherwise(empty))
    out = maps[0]
    for later in maps[1:]:
        out = F.map_concat(without(out, F.map_keys(later)), later)
    return Dyn(F.to_variant_object(out))


def without(entries: Column, names: Column) -> Column:
    return F.map_filter(entries, lambda k, _: ~F.array_contains(names, k))


def variants_of(v: Arr) -> Column:
    return F.transform(v.col, lambda x: variant(of_column(x, v.element)))


def all_of(*conds: Cond) -> Cond:
    out: Cond = True
    for c in conds:
        if c is False:
            return False
        if c is not True:
            out = c if out is True else out & c
    return out


def of_type(v: Scalar) -> T.DataType:
    return {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[v.type]


def wait(step: Step) -> Value:
    mode = step.option_text("mode", "duration")
    step.log(F.lit(f"wait ({mode}) - not sleeping in framework-free mode"))
    return wrapper(waited=lit(mode), duration=of_json(step.option("duration")), input=step.input_or_all())


def js_trim(s: str) -> str:
    return s.strip(" \t\n\v\f\r\x85\xa0                　﻿")


def transform_rows(config: dict) -> dict[str, object]:
    rows = config.get("fields")
    return {js_trim(r["key"]): r.get("value") for r in rows if isinstance(r, dict) and isinstance(r.get("key"), str) and js_trim(r["key"])} if isinstance(rows, list) else {}


def transform(step: Step) -> Value:
    config = step.node.config
    mode, expression, rows = config.get("mode"), config.get("expression"), transform_rows(config)
    if mode in (None, "expression"):
        if isinstance(expression, str) and js_trim(expression):
            return evaluate(expression, step.inputs)
        if mode == "expression":
            return step.input_or_all()
    if rows:
        return Obj({k: (True, evaluate(v, step.inputs)) for k, v in rows.items()})
    return step.input_or_all()


def variable(step: Step) -> Value:
    return step.value("value")


def memory_store(step: Step) -> Value:
    operation, key = step.option_text("operation", "read"), step.option_text("key", "")
    if operation == "write":
        value = step.value("value")
        step.effects.append(F.to_json(F.struct(F.lit("memory_write").alias("effect"), F.lit(key).alias("key"), json_text(value).alias("value"))))
        return value
    before = step.compiler.memory(key)
    if operation == "append":
        value = step.value("value")
        step.effects.append(F.to_json(F.struct(F.lit("memory_append").alias("effect"), F.lit(key).alias("key"), json_text(value).alias("value"))))
        if isinstance(before, Null):
            return Arr(F.array(struct(value)), step.compiler.type_of(struct(value)))
        kind = F.coalesce(F.schema_of_variant(before.col), F.lit("VOID"))
        old = F.when(kind == "VOID", F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(before.col, "$", "array<variant>")).otherwise(F.array(before.col))
        return Arr(F.concat(old, F.array(variant(value))), T.VariantType())
    return before


def data_store(step: Step) -> Value:
    operation, table = step.option_text("operation", "get"), step.option_text("table", "")
    key = text(of_json(step.option("key")))
    if operation == "set":
        value = step.value("value")
        step.effects.append(F.to_json(F.struct(F.lit("set").alias("effect"), F.lit(table).alias("table"), key.alias("key"), json_text(value).alias("value"))))
        return value
    if operation == "delete":
        step.effects.append(F.to_json(F.struct(F.lit("delete").alias("effect"), F.lit(table).alias("table"), key.alias("key"))))
        return wrapper(deleted=Scalar(key, "string"))
    if operation == "list":
        return step.compiler.stored_list(table)
    if operation == "query":
        where = step.option("where")
        return step.compiler.stored_query(table, {k: evaluate(v, step.inputs) for k, v in where.items()} if isinstance(where, dict) else {})
    return step.compiler.stored(table, step.option("key"))


MODEL_OPTIONS = ("provider", "model", "system", "temperature", "max_tokens", "tools", "response_schema")  # fixed values


def llm_call(step: Step) -> Value:
    """The host's model on the prompt and the options that are set; without one, the prompt again and its words."""
    model = step.option("model")
    prompt = text(step.value("prompt"))
    step.log(F.lit(f"llm_call -> {model if isinstance(model, str) else 'model'}"))
    if step.compiler.host.model:
        return step.compiler.host.model(prompt, Obj({k: (True, of_json(v)) for k in MODEL_OPTIONS if (v := step.option(k)) is not None}))
    words = Scalar(word_count(prompt).cast("bigint"), "bigint")
    said = Scalar(F.concat(F.lit(f"[{model if isinstance(model, str) else 'echo'}] "), prompt), "string")
    return wrapper(text=said, usage=wrapper(input_tokens=words, output_tokens=words))


def llm_router(step: Step) -> Value:
    routes = step.option("routes")
    port = next((r for r in routes if isinstance(r, str)), "default") if isinstance(routes, list) else "default"
    return only(lit(port), wrapper(route=lit(port), reason=lit(""), input=step.input_or_all()))


def tool_use(step: Step) -> Value:
    raw = step.node.config.get("args")
    if isinstance(raw, dict):
        args: Value = of_json(raw)
    else:
        args = evaluate(raw, step.inputs)
        if isinstance(args, Dyn):
            kind = F.coalesce(F.schema_of_variant(args.col), F.lit("VOID"))
            args = choose(kind.startswith("OBJECT"), args, wrapper(value=args))
        elif not isinstance(args, Obj) or args.null is not False:
            args = wrapper(value=args)
    if step.compiler.host.tool:
        return step.compiler.host.tool(step.option_text("tool", ""), args)
    return wrapper(tool=of_json(step.option("tool", "")), args=args)


def embed_search(step: Step) -> Value:
    query = Scalar(text(step.value("query")), "string")
    k = step.option("topK", 5)
    k = int(k) if isinstance(k, (int, float)) and not isinstance(k, bool) and k >= 0 else 5
    return wrapper(query=query, matches=step.compiler.search(query, k))


def echoed(method: str, url: Column, headers: object, body: Value) -> Obj:
    """The answer of the client that answers with what it is sent."""
    sent = wrapper(method=lit(method), url=Scalar(url, "string"), body=body)
    return wrapper(status=of_json(200), headers=of_json(headers if isinstance(headers, dict) else {}), body=wrapper(echoed=sent))


def api_request(step: Step) -> Value:
    method = step.option_text("method", "GET").upper()
    url = text(step.value("url"))
    step.log(F.concat(F.lit(f"api_request {method} "), url))
    return step.compiler.http(method, url, step.option("headers"), step.value("body"))


def webhook_out(step: Step) -> Value:
    url = text(step.value("url"))
    step.log(F.concat(F.lit("webhook_out -> "), url))
    answer = step.compiler.http("POST", url, step.option("headers"), step.value("payload"))
    found = {}
    for name, key in (("status", "status"), ("response", "body")):
        there, value = field_of(answer, key)
        found[name] = nulled(value, no(there))
    return wrapper(sent=of_json(True), **found)


def output(step: Step) -> Value:
    return step.input_or_all()


def log(step: Step) -> Value:
    level, message = step.option("level", "info"), text(step.value("message"))
    step.log(message, level if level in ("info", "warn", "error", "debug") else "info")
    return wrapper(logged=Scalar(message, "string"), level=of_json(level))


MAX_DEPTH = 8  # fixed value


def subgraph(step: Step) -> Value:
    if not isinstance(step.node.config.get("graph"), dict):
        return step.input_or_all()
    if step.compiler.depth >= MAX_DEPTH:
        step.abort(True, f"subgraph nesting exceeded {MAX_DEPTH} levels at node {step.node.id}")
        return Null()
    return step.compiler.child(step, step.node.config["graph"])


def subflow(step: Step) -> Value:
    name = step.node.config.get("workflow")
    if not isinstance(name, str) or not name.strip():
        step.abort(True, "subflow has no workflow reference configured")
        return Null()
    if step.compiler.depth >= MAX_DEPTH:
        step.abort(True, f"subflow nesting exceeded {MAX_DEPTH} levels at node {step.node.id}")
        return Null()
    if step.compiler.host.workflows is None:
        step.abort(True, f'subflow "{name}" cannot run: no WorkflowResolver is configured')
        return Null()
    document = step.compiler.host.workflows.get(name)
    if document is None:
        step.abort(True, f'subflow "{name}" was not found')
        return Null()
    return step.compiler.child(step, document)


OPERATORS: dict[str, Callable[[Step], Value]] = {
    f.__name__: f
    for f in (manual_trigger, webhook_trigger, schedule_trigger, user_input, human_approval, notify, branch, switch_case, for_each, merge, wait, transform, variable, memory_store, data_store, llm_call, llm_router, tool_use, embed_search, api_request, webhook_out, output, log, subgraph, subflow)
}
