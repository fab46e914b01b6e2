"""Workflows over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.graph.kinds import namespaces
from weftline.operators import durable, graphs, search
from weftline.plans.compiled import Host, Run, compile_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(id: str, kind: str, config: dict | None = None, **more) -> dict:
    return {"id": id, "kind": kind, "config": config or {}} | more


def graph(nodes: list[dict], *edges: str) -> dict:
    """A document; an edge is `source[.port]>target[.port]`."""
    made = []
    for i, e in enumerate(edges):
        (source, _, out), (target, _, into) = (end.partition(".") for end in e.split(">"))
        made.append({"id": f"e{i}", "source": source, "target": target} | ({"sourceHandle": out} if out else {}) | ({"targetHandle": into} if into else {}))
    return {"version": 1, "graph": {"nodes": nodes, "edges": made}}


def chain(*nodes: dict) -> dict:
    """A trigger, the nodes, one after the other, and an output."""
    everything = [node("start", "manual_trigger"), *nodes, node("end", "output")]
    return graph(everything, *(f"{a['id']}>{b['id']}" for a, b in zip(everything[:-1], everything[1:], strict=True)))


def fields(**rows: object) -> dict:
    return {"mode": "fields", "fields": [{"key": k, "value": v} for k, v in rows.items()]}


def run(spark, sf_dir, name: str, key: str, columns: list[str], document: dict, host: Host | None = None, **more) -> Run:
    return compile_graph(document, table(spark, sf_dir, name).select(F.col(key).alias("run_key"), *columns), "run_key", columns, host, **more)


def flagship(labels: DataFrame) -> DataFrame:
    verdict = graph(
        [node("start", "manual_trigger"), node("toxic", "branch", {"condition": "{{ in.toxic }}"}), node("drop", "transform", fields(doc_id="{{ in.doc_id }}", verdict="drop", note="toxic document {{ in.doc_id }}")), node("keep", "transform", fields(doc_id="{{ in.doc_id }}", verdict="keep", note="quality {{ in.quality }}")), node("both", "merge"), node("end", "output")],
        "start>toxic", "toxic.true>drop", "toxic.false>keep", "drop>both.a", "keep>both.b", "both>end",
    )
    columns = ["doc_id", "quality", "toxic"]
    return compile_graph(verdict, labels.select(F.col("doc_id").alias("run_key"), *columns), "run_key", columns).output("end").drop("run_key")


@query("select doc_id, case when toxic <> 0 then 'drop' else 'keep' end as verdict, case when toxic <> 0 then 'toxic document ' || doc_id else 'quality ' || quality end as note from labels")
def branch_merge_labels(spark, sf_dir):
    return flagship(table(spark, sf_dir, "labels"))


@query("select event_id, case event_type when 'purchase' then 'money' when 'click' then 'web' when 'view' then 'web' else 'default' end as port from events")
def switch_event_type(spark, sf_dir):
    cases = {"purchase": "money", "click": "web", "view": "web"}
    r = run(spark, sf_dir, "events", "event_id", ["event_type"], graph([node("start", "manual_trigger"), node("sw", "switch_case", {"value": "{{ in.event_type }}", "cases": cases})], "start>sw"))
    return r.published().where("node_id = 'sw'").select(F.col("run_key").alias("event_id"), F.col("port_id").alias("port"))


@query("select event_id, case when cast(json_extract_string(props, '$.k') as int) <> 0 then 'some' else 'none' end as kind from events")
def branch_json_path(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("b", "branch", {"condition": "{{ in.props.k }}"}), node("some", "transform", fields(kind="some")), node("none", "transform", fields(kind="none")), node("m", "merge")], "start>b", "b.true>some", "b.false>none", "some>m.a", "none>m.b")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_key"), F.parse_json("props").alias("props"))
    return compile_graph(g, rows, "run_key", ["props"]).output("m").withColumnRenamed("run_key", "event_id")


@query("select c_custkey, lower(trim(t)) not in ('', '0', 'false', 'no', 'off', 'null') as truth, t as tried from customer, (values (' No '), ('0'), ('0.0'), ('OFF'), ('yes'), (''), ('false'), ('null'), ('None')) as v(t)")
def truthy_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, (" No ", "0", "0.0", "OFF", "yes", "", "false", "null", "None")))).alias("tried"))
    g = graph([node("start", "manual_trigger"), node("b", "branch", {"condition": "{{ in.tried }}"})], "start>b")
    r = compile_graph(g, rows.withColumn("run_key", F.struct("c_custkey", "tried")), "run_key", ["tried"])
    return r.output("b").select("run_key.c_custkey", (F.col("branch") == "true").alias("truth"), "run_key.tried")


@query("select c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ', nation ' || c_nationkey || '{{ open' as letter from customer")
def template_interpolate(spark, sf_dir):
    g = chain(node("t", "transform", fields(letter="Dear {{ in.c_name }} of {{in.c_mktsegment}}{{ in.nothing }}, nation {{ $json.c_nationkey }}{{ open")))
    return run(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"], g).output("end").withColumnRenamed("run_key", "c_custkey")


@query("select o_orderkey, case when o_totalprice = round(o_totalprice) then cast(cast(o_totalprice as bigint) as varchar) else cast(o_totalprice as varchar) end as shown, cast(cast(round(o_totalprice) as hugeint) * 1000000000000 as varchar) as large from orders where o_totalprice < 1e15")
def number_text_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.round("o_totalprice") * 1e12).alias("large"))
    g = chain(node("t", "transform", fields(shown="{{ in.price }}|", large="{{ in.large }}|")))
    out = compile_graph(g, rows.withColumnsRenamed({"o_orderkey": "run_key", "o_totalprice": "price"}), "run_key", ["price", "large"]).output("end")
    return out.select(F.col("run_key").alias("o_orderkey"), F.rtrim("shown", F.lit("|")).alias("shown"), F.rtrim("large", F.lit("|")).alias("large"))


@query("select p_partkey, p_name as name, p_size as size, 'n/a' as fixed, cast(null as varchar) as missing from part")
def transform_fields(spark, sf_dir):
    config = {"mode": "fields", "fields": [{"key": " name ", "value": "{{ in.p_name }}"}, {"key": "size", "value": 1}, {"key": "size", "value": "{{ in.p_size }}"}, {"key": "fixed", "value": "n/a"}, {"key": "missing", "value": "{{ in.nope }}"}, {"key": "  ", "value": 3}, None, "x"]}
    return run(spark, sf_dir, "part", "p_partkey", ["p_name", "p_size"], chain(node("t", "transform", config))).output("end").withColumnRenamed("run_key", "p_partkey")


@query("select p_partkey, p_retailprice as value from part")
def transform_expression(spark, sf_dir):
    return run(spark, sf_dir, "part", "p_partkey", ["p_retailprice"], chain(node("t", "transform", {"expression": " {{ in.p_retailprice }} "}))).output("end").withColumnRenamed("run_key", "p_partkey")


@query("select p_partkey, p_brand, p_type from part")
def transform_passthrough(spark, sf_dir):
    g = chain(node("t", "transform", {"mode": "fields", "fields": [{"key": "", "value": ""}]}), node("u", "transform", {"mode": "expression", "expression": " "}))
    return run(spark, sf_dir, "part", "p_partkey", ["p_brand", "p_type"], g).output("end").withColumnRenamed("run_key", "p_partkey")


@query("select n_nationkey, n_name as value from nation")
def variable_path(spark, sf_dir):
    return run(spark, sf_dir, "nation", "n_nationkey", ["n_name"], chain(node("v", "variable", {"value": "{{ $input.n_name }}"}))).output("end").withColumnRenamed("run_key", "n_nationkey")


def _nations(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("run_key"), F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")).alias("nation"), F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")).alias("region"), F.array("n_name").alias("names"), "r_name")


@query("select n_nationkey, r_name as name, n_nationkey as id, r_regionkey as region, r_name as c from nation join region on n_regionkey = r_regionkey")
def merge_object(spark, sf_dir):
    rows = _nations(spark, sf_dir)
    g = graph([node("m", "merge")])
    seeds = {"m": {"a": F.col("nation"), "b": F.col("region"), "c": F.col("r_name"), "d": F.lit(None).cast("string")}}
    return compile_graph(g, rows, "run_key", seeds).output("m").drop("d").withColumnRenamed("run_key", "n_nationkey")


@query("select n_nationkey, n_name || '|' || r_name as listed, 2 as n from nation join region on n_regionkey = r_regionkey")
def merge_concat(spark, sf_dir):
    seeds = {"m": {"a": F.col("names"), "b": F.col("r_name"), "c": F.lit(None).cast("string")}}
    out = compile_graph(graph([node("m", "merge", {"mode": "concat"})]), _nations(spark, sf_dir), "run_key", seeds).output("m")
    return out.select(F.col("run_key").alias("n_nationkey"), F.array_join("value", "|").alias("listed"), F.size("value").alias("n"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'finished' else 'open' end as state from orders")
def same_handle_last_active(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("sw", "switch_case", {"value": "{{ in.o_orderstatus }}", "cases": {"F": "f"}}), node("f", "transform", fields(state="finished")), node("o", "transform", fields(state="open")), node("m", "output")], "start>sw", "sw.f>f", "sw.default>o", "f>m", "o>m")
    return run(spark, sf_dir, "orders", "o_orderkey", ["o_orderstatus"], g).output("m").withColumnRenamed("run_key", "o_orderkey")


@query("select l_orderkey, l_linenumber, 'returned' as port from lineitem where l_returnflag = 'R' union all select l_orderkey, l_linenumber, 'large' from lineitem where l_quantity > 40 union all select l_orderkey, l_linenumber, 'all' from lineitem")
def multi_port_subset(spark, sf_dir):
    def route(step):
        from weftline.plans.values import Arr, Obj, evaluate
        from pyspark.sql import types as T

        flag, quantity = evaluate("{{ in.l_returnflag }}", step.inputs), evaluate("{{ in.l_quantity }}", step.inputs)
        ports = F.array_compact(F.array(F.when(flag.col == "R", F.lit("returned")), F.when(quantity.col > 40, F.lit("large")), F.lit("all")))
        return Obj({"__ports": (True, Arr(ports, T.StringType())), "value": (True, flag)})

    g = graph([node("start", "manual_trigger"), node("r", "router"), node("a", "output"), node("b", "output"), node("c", "output")], "start>r", "r.returned>a", "r.large>b", "r.all>c")
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("run_key"), "l_returnflag", "l_quantity")
    r = compile_graph(g, rows, "run_key", ["l_returnflag", "l_quantity"], Host({"router": route}))
    return r.published().where("node_id = 'r'").select("run_key.l_orderkey", "run_key.l_linenumber", F.col("port_id").alias("port"))


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.withColumnRenamed("conv_id", "run_key")


@query("select conv_id, count(*) as count from conversations group by conv_id")
def foreach_collect(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("each", "for_each", {"source": "{{ in.turns }}", "mode": "collect"})], "start>each")
    return compile_graph(g, _turns(spark, sf_dir), "run_key", ["turns"]).output("each").select(F.col("run_key").alias("conv_id"), "count")


@query("select conv_id, count(*) as n, cast(sum(len(regexp_extract_all(text, '[A-Za-z''-]+'))) as bigint) as words from conversations group by conv_id")
def foreach_lane_words(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("each", "for_each", {"source": "{{ in.turns }}"}), node("call", "llm_call", {"prompt": "{{ in.text }}"}), node("after", "output")], "start>each", "each.item>call", "each.done>after")
    out = compile_graph(g, _turns(spark, sf_dir), "run_key", ["turns"]).output("after")
    words = F.aggregate("results", F.lit(0).cast("long"), lambda s, x: s + x["call"]["usage"]["input_tokens"])
    return out.select(F.col("run_key").alias("conv_id"), F.col("count").alias("n"), words.alias("words"))


@query("select conv_id, count(*) filter (where role = 'system') as failed, count(*) as n, min(turn) filter (where role = 'system') as first from conversations group by conv_id")
def foreach_lane_failures(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("each", "for_each", {"source": "{{ in.turns }}"}), node("sw", "switch_case", {"value": "{{ in.role }}", "cases": {"system": "sys"}}), node("bad", "unknown_kind"), node("ok", "transform", fields(role="{{ in.role }}")), node("after", "output")], "start>each", "each.item>sw", "sw.sys>bad", "sw.default>ok", "each.done>after")
    out = compile_graph(g, _turns(spark, sf_dir), "run_key", ["turns"]).output("after")
    return out.select(F.col("run_key").alias("conv_id"), F.size("failures").cast("long").alias("failed"), F.size("results").cast("long").alias("n"), F.get("failures", F.lit(0))["item"]["turn"].alias("first"))


def _store(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("string").alias("key"), F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("value"))


@query("select r_regionkey, count(*) as n, min(n_name) as least from region join nation on n_regionkey = r_regionkey group by r_regionkey")
def data_store_query(spark, sf_dir):
    g = chain(node("q", "data_store", {"operation": "query", "table": "nation", "where": {"n_regionkey": "{{ in.r_regionkey }}"}}))
    out = run(spark, sf_dir, "region", "r_regionkey", ["r_regionkey"], g, Host(store=_store(spark, sf_dir))).output("end")
    names = F.transform("value", lambda v: F.variant_get(v, "$.n_name", "string"))
    return out.select(F.col("run_key").alias("r_regionkey"), F.size("value").cast("long").alias("n"), F.array_min(names).alias("least"))


@query("select r_regionkey, (select count(*) from nation) as n, (select n_name from nation where n_nationkey = 7) as seventh from region")
def data_store_list(spark, sf_dir):
    g = chain(node("q", "data_store", {"operation": "list", "table": "nation"}))
    out = run(spark, sf_dir, "region", "r_regionkey", ["r_regionkey"], g, Host(store=_store(spark, sf_dir))).output("end")
    listed = F.variant_get("value", "$", "map<string,variant>")
    return out.select(F.col("run_key").alias("r_regionkey"), F.size(listed).cast("long").alias("n"), F.variant_get("value", "$['7'].n_name", "string").alias("seventh"))


@query("select r_regionkey, (select n_name from nation where n_nationkey = 3) as third, cast(null as varchar) as none from region")
def data_store_get(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("a", "data_store", {"table": "nation", "key": 3}), node("b", "data_store", {"table": "nation", "key": "99"}), node("t", "transform", fields(third="{{ x.n_name }}", none="{{ y.n_name }}"))], "start>a", "start>b", "a>t.x", "b>t.y")
    out = run(spark, sf_dir, "region", "r_regionkey", ["r_regionkey"], g, Host(store=_store(spark, sf_dir))).output("t")
    return out.select(F.col("run_key").alias("r_regionkey"), F.variant_get("third", "$", "string").alias("third"), F.variant_get("none", "$", "string").alias("none"))


@query("select n_nationkey, 'nation' as tab, cast(n_nationkey as varchar) as kept, 'gone' as deleted from nation")
def data_store_writes(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("s", "data_store", {"operation": "set", "table": "nation", "key": "k", "value": "{{ in.n_nationkey }}"}), node("d", "data_store", {"operation": "delete", "table": "nation", "key": "gone"})], "start>s", "s>d")
    e = run(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey"], g).effects()
    parsed = e.select("run_key", "node_id", F.from_json("effect", "`table` string, key string, value string").alias("e"))
    return parsed.groupBy(F.col("run_key").alias("n_nationkey")).agg(F.min("e.table").alias("tab"), F.max(F.when(F.col("node_id") == "s", F.col("e.value"))).alias("kept"), F.max(F.when(F.col("node_id") == "d", F.col("e.key"))).alias("deleted"))


@query("select user_id, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total from events group by user_id")
def memory_append(spark, sf_dir):
    """Each user's events appended to one list, in the order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_key"), F.parse_json("props").alias("props"))
    g = chain(node("m", "memory_store", {"operation": "append", "key": "events", "value": "{{ in.props.k }}"}))
    out = compile_graph(g, rows, "run_key", ["props"])
    appended = out.output("m").withColumnRenamed("run_key", "event_id")
    times = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    kept = times.join(appended, "event_id").select("user_id", "ts", F.variant_get(F.get("value", F.lit(0)), "$", "long").alias("k"))
    lists = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "k"))).alias("l"))
    return lists.select("user_id", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["k"]).alias("total"))


@query("select item_id, '[echo] ' || text as said, cast(len(regexp_extract_all(text, '[A-Za-z''-]+')) as bigint) as tokens from benchmark")
def llm_usage(spark, sf_dir):
    out = run(spark, sf_dir, "benchmark", "item_id", ["text"], chain(node("l", "llm_call", {"prompt": "{{ in.text }}"}))).output("end")
    return out.select(F.col("run_key").alias("item_id"), F.col("text").alias("said"), F.col("usage.input_tokens").alias("tokens"))


@query("""with q as (select vec_id as query_id, embedding as a from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id as id, round(list_cosine_similarity(cast(a as double[]), cast(embedding as double[])), 6) as score,
  row_number() over (partition by query_id order by list_cosine_similarity(cast(a as double[]), cast(embedding as double[])) desc, vec_id) as rank from q, embeddings)
select query_id, id, score, rank from s where rank <= 5""")
def embed_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 as a query against all of them."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = search.nearest(vectors.where("id % 20 = 0"), vectors, 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""with q as (select vec_id as query_id, embedding as a from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id as id, round(list_cosine_similarity(cast(a as double[]), cast(embedding as double[])), 6) as score,
  row_number() over (partition by query_id order by list_cosine_similarity(cast(a as double[]), cast(embedding as double[])) desc, vec_id) as rank from q, embeddings)
select query_id, id, score, rank from s where rank <= 5""")
def embed_topk_twentieth(spark, sf_dir):
    """embed_topk under the name that it had while that asked with eight vectors."""
    return embed_topk(spark, sf_dir)


@query("select p_partkey, p_name as query, 0 as n from part")
def embed_search_default(spark, sf_dir):
    out = run(spark, sf_dir, "part", "p_partkey", ["p_name"], chain(node("s", "embed_search", {"query": "{{ in.p_name }}"}))).output("end")
    return out.select(F.col("run_key").alias("p_partkey"), "query", F.size("matches").alias("n"))


@query("select page_id, 200 as status, 'PUT' as method, url || '?p=' || page_id as url, url as body from pages")
def http_echo(spark, sf_dir):
    g = chain(node("h", "api_request", {"method": "put", "url": "{{ in.url }}?p={{ in.page_id }}", "body": "{{ in.url }}"}))
    out = run(spark, sf_dir, "pages", "page_id", ["page_id", "url"], g).output("end")
    return out.select(F.col("run_key").alias("page_id"), F.col("status").cast("int").alias("status"), "body.echoed.method", "body.echoed.url", "body.echoed.body")


@query("select page_id, true as sent, 200 as status, 'POST' as method, url as body from pages")
def webhook_echo(spark, sf_dir):
    out = run(spark, sf_dir, "pages", "page_id", ["page_id", "url"], chain(node("h", "webhook_out", {"url": "http://x/{{ in.page_id }}", "payload": "{{ in.url }}"}))).output("end")
    return out.select(F.col("run_key").alias("page_id"), "sent", F.col("status").cast("int").alias("status"), "response.echoed.method", "response.echoed.body")


@query("select c_custkey, 'lookup' as tool, c_name as value from customer")
def tool_echo(spark, sf_dir):
    out = run(spark, sf_dir, "customer", "c_custkey", ["c_name"], chain(node("t", "tool_use", {"tool": "lookup", "args": "{{ in.c_name }}"}))).output("end")
    return out.select(F.col("run_key").alias("c_custkey"), "tool", "args.value")


@query("select c_custkey, true as sent, 'slack' as channel, 'ops {{ in.c_name }}' as \"to\", 'Hello ' || c_name as message from customer")
def notify_rows(spark, sf_dir):
    out = run(spark, sf_dir, "customer", "c_custkey", ["c_name"], chain(node("n", "notify", {"to": "ops {{ in.c_name }}", "message": "Hello {{ in.c_name }}"}))).output("end")
    return out.withColumnRenamed("run_key", "c_custkey")


@query("select c_custkey, 'info' as level, 'balance of ' || c_name as message from customer")
def log_rows(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("l", "log", {"level": "loud", "message": "balance of {{ in.c_name }}"})], "start>l")
    e = run(spark, sf_dir, "customer", "c_custkey", ["c_name"], g).events()
    return e.where("type = 'log'").select(F.col("run_key").alias("c_custkey"), "level", "message")


@query("select doc_id, 'fast' as route, quality from labels")
def router_first_route(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("r", "llm_router", {"routes": [{"port": "slow"}, "fast", "other"]}), node("end", "output")], "start>r", "r.fast>end")
    out = run(spark, sf_dir, "labels", "doc_id", ["quality"], g).output("end")
    return out.select(F.col("run_key").alias("doc_id"), "route", F.col("input.quality").cast("int").alias("quality"))


@query("select doc_id, case when quality <> 0 then 'approved' else 'denied' end as port from labels")
def approval_default(spark, sf_dir):
    g = graph([node("h", "human_approval")])
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_key"), F.col("quality").alias("approved"))
    return compile_graph(g, rows, "run_key", ["approved"]).published().select(F.col("run_key").alias("doc_id"), F.col("port_id").alias("port"))


@query("select doc_id, quality, toxic from labels")
def user_input_values(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_key"), F.struct("quality", "toxic").alias("values"))
    out = compile_graph(graph([node("u", "user_input")]), rows, "run_key", ["values"]).output("u")
    return out.select(F.col("run_key").alias("doc_id"), F.col("quality").cast("int"), F.col("toxic").cast("int"))


@query("select o_orderkey, 'duration' as waited, '5m' as duration, o_orderstatus as status from orders")
def wait_passthrough(spark, sf_dir):
    out = run(spark, sf_dir, "orders", "o_orderkey", ["o_orderstatus"], chain(node("w", "wait", {"duration": "5m"}))).output("end")
    return out.select(F.col("run_key").alias("o_orderkey"), "waited", "duration", F.col("input.o_orderstatus").alias("status"))


@query("select o_orderkey, '0 * * * *' as cron, o_orderpriority as timezone, o_orderstatus from orders")
def schedule_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_key"), F.col("o_orderpriority").alias("timezone"), "o_orderstatus")
    return compile_graph(graph([node("s", "schedule_trigger", {"cron": "0 * * * *"})]), rows, "run_key", ["timezone", "o_orderstatus"]).output("s").withColumnRenamed("run_key", "o_orderkey")


@query("select o_orderkey, o_orderstatus as value from orders")
def webhook_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_key"), F.col("o_orderstatus").alias("payload"), F.lit(1).alias("other"))
    return compile_graph(graph([node("w", "webhook_trigger")]), rows, "run_key", ["payload", "other"]).output("w").withColumnRenamed("run_key", "o_orderkey")


_INNER = chain(node("t", "transform", fields(label="{{ in.in.p_brand }}/{{ in.in.p_size }}")))


@query("select p_partkey, p_brand || '/' || p_size as label from part")
def subgraph_inline(spark, sf_dir):
    out = run(spark, sf_dir, "part", "p_partkey", ["p_brand", "p_size"], chain(node("s", "subgraph", {"graph": _INNER}))).output("end")
    return out.select(F.col("run_key").alias("p_partkey"), F.col("end.label").alias("label"))


@query("select p_partkey, p_brand || '/' || p_size as label, cast(null as varchar) as error from part")
def subflow_named(spark, sf_dir):
    r = run(spark, sf_dir, "part", "p_partkey", ["p_brand", "p_size"], chain(node("s", "subflow", {"workflow": "label"})), Host(workflows={"label": _INNER}))
    rows = r.results().select(F.col("run_key").alias("p_partkey"), F.parse_json("outputs").alias("o"), "error")
    return rows.select("p_partkey", F.variant_get("o", "$.end.end.label", "string").alias("label"), "error")


@query("select 'run-start' as type, '' as status, count(*) as n from labels union all select 'run-end', '', count(*) from labels union all select 'node-status', 'running', 5 * count(*) from labels union all select 'node-status', 'done', 5 * count(*) from labels union all select 'node-status', 'idle', count(*) from labels union all select 'node-output', '', 4 * count(*) from labels")
def run_events_counts(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("b", "branch", {"condition": "{{ in.toxic }}"}), node("x", "transform", fields(v=1)), node("y", "transform", fields(v=2)), node("m", "merge"), node("end", "output")], "start>b", "b.true>x", "b.false>y", "x>m.a", "y>m.b", "m>end")
    e = run(spark, sf_dir, "labels", "doc_id", ["toxic"], g).events()
    return e.groupBy("type", F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when toxic <> 0 then 'true' else 'false' end as port, count(*) as n from labels group by 1")
def undelivered_warnings(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("b", "branch", {"condition": "{{ in.toxic }}"}), node("x", "output"), node("y", "output"), node("z", "output")], "start>b", "b.true>x", "b.false>y", "b.ture>z")
    e = run(spark, sf_dir, "labels", "doc_id", ["toxic"], g).events().where("level = 'warn'")
    return e.groupBy(F.regexp_extract("message", r"Available: (\w+)\.", 1).alias("port")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, 'false' as port from labels")
def unresolved_route_warnings(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("b", "branch", {"condition": "{{ in.nothing.there }}"}), node("c", "branch", {"condition": "{{ in.toxic }}"})], "start>b", "b.false>c")
    e = run(spark, sf_dir, "labels", "doc_id", ["toxic"], g).events().where("level = 'warn'")
    return e.groupBy(F.regexp_extract("message", r'took the "(\w+)" port', 1).alias("port")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'No executor registered for kind=nowhere' when o_orderstatus = 'P' then 'branch \"late\" condition \"in.x\" is not an expression -- wrap it: {{ in.x }}' end as error, o_orderstatus not in ('F', 'P') as finished from orders")
def run_errors(spark, sf_dir):
    g = graph([node("start", "manual_trigger"), node("sw", "switch_case", {"value": "{{ in.o_orderstatus }}", "cases": {"F": "f", "P": "p"}}), node("gone", "nowhere"), node("late", "branch", {"condition": "in.x"}), node("end", "output")], "start>sw", "sw.f>gone", "sw.p>late", "start>end")
    r = run(spark, sf_dir, "orders", "o_orderkey", ["o_orderstatus"], g)
    return r.results().select(F.col("run_key").alias("o_orderkey"), "error", F.col("ok").alias("finished"))


@query("select c_custkey, 'n' || c_custkey as node_id, 'approval' as awaiting from customer")
def pause_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", scalars.encoded_pause(F.concat(F.lit("n"), F.col("c_custkey").cast("string")), F.lit("approval"), F.lit('{"a":1}')).alias("reason"))
    return rows.select("c_custkey", scalars.decoded_pause(F.col("reason")).alias("p")).select("c_custkey", "p.node_id", "p.awaiting")


@query("select page_id, page_id || ':' || replace(replace(replace(url, '%', '%25'), '/', '%2F'), '#', '%23') || '/step' as plain, page_id || ':' || replace(replace(replace(url, '%', '%25'), '/', '%2F'), '#', '%23') || '/step#0' as again from pages")
def step_keys(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    return p.select("page_id", scalars.step_key(key, F.lit("step"), F.array("url")).alias("plain"), scalars.step_key(key, F.lit("step"), F.array("url"), F.lit(0)).alias("again"))


@query("with e as (select event_id, epoch_ms(ts) as moment, row_number() over (partition by user_id order by ts, event_id) as attempt, min(epoch_ms(ts)) over (partition by user_id) as began from events) select event_id, attempt <= 1 or moment - began <= 864000 * 1000 as safe from e")
def replay_safe(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumns({"at": F.unix_millis(F.col("ts").cast("timestamp")), "attempt": F.row_number().over(w.orderBy("ts", "event_id"))})
    e = e.withColumn("first", F.min("at").over(w))
    return e.select("event_id", scalars.is_replay_safe(F.col("attempt"), F.col("first"), F.col("at"), F.lit(864000)).alias("safe"))


_VERSIONS = ("0.3.1", "0.4.0", "1.0.0", "1.2.3", "1.2.9", "1.3.0", "2.0.0")
_RANGES = ("*", "", "^1.2", "~1.2.3", ">=1.2.9", "<1", "=1.3.0", "^0.3.0 || 2.0.0")


@query(f"""with v as (select unnest({list(_VERSIONS)!r}) as version), r as (select unnest({list(_RANGES)!r}) as range),
p as (select version, range, [cast(x as int) for x in string_split(version, '.')] as a from v, r)
select version, range, case range when '*' then true when '' then true when '^1.2' then a[1] = 1 and a[2] >= 2 when '~1.2.3' then a[1] = 1 and a[2] = 2 and a[3] >= 3
  when '>=1.2.9' then (a[1], a[2], a[3]) >= (1, 2, 9) when '<1' then a[1] < 1 when '=1.3.0' then version = '1.3.0' else (a[1] = 0 and a[2] = 3) or version = '2.0.0' end as fits from p""")
def satisfies_range(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, _VERSIONS))).alias("version")).select("version", F.explode(F.array(*map(F.lit, _RANGES))).alias("range"))
    return grid.select("version", "range", scalars.satisfies_range(F.col("version"), F.col("range")).alias("fits"))


_DURABLE = graph([node("start", "manual_trigger"), node("ship", "branch", {"condition": "{{ in.x }}"}), node("a", "transform"), node("b", "transform"), node("m", "merge")], "start>ship", "ship.true>a", "ship.false>b", "a>m.a", "b>m.b")


def _claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A run an order: started in all, decided unless the order is open, in work at `a` for those partly done."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_key"), "o_orderstatus")
    rows = F.array(
        F.struct(F.lit("start").alias("node_id"), F.lit("completed").alias("status"), F.array(F.lit("out")).alias("ports")),
        F.when(F.col("o_orderstatus") != "O", F.struct(F.lit("ship").alias("node_id"), F.lit("completed").alias("status"), F.array(F.when(F.col("o_orderstatus") == "F", F.lit("true")).otherwise(F.lit("false"))).alias("ports"))),
        F.when((F.col("o_orderstatus") == "P") & (F.col("run_key") % 2 == 0), F.struct(F.lit("b").alias("node_id"), F.lit("claimed").alias("status"), F.array().cast("array<string>").alias("ports"))),
    )
    return o, o.select("run_key", F.explode(F.array_compact(rows)).alias("c")).select("run_key", "c.*")


def _front(spark, sf_dir) -> DataFrame:
    from weftline.graph.document import import_document

    runs, claims = _claims(spark, sf_dir)
    return durable.frontier(import_document(_DURABLE).graph, runs, claims)


@query("select o_orderkey as run_key, case o_orderstatus when 'O' then 'ship' when 'F' then 'a' else case when o_orderkey % 2 = 0 then '' else 'b' end end as ready from orders")
def frontier_ready(spark, sf_dir):
    return _front(spark, sf_dir).select("run_key", F.array_join("ready", ",").alias("ready"))


@query("select o_orderkey as run_key, case o_orderstatus when 'O' then '' when 'F' then 'b' else 'a' end as skipped from orders")
def skip_cascade(spark, sf_dir):
    return _front(spark, sf_dir).select("run_key", F.array_join("skipped", ",").alias("skipped"))


@query("select o_orderkey as run_key, case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 0 else 1 end as started, o_orderstatus = 'P' and o_orderkey % 2 = 0 as in_flight from orders")
def dispatch_cap(spark, sf_dir):
    return durable.dispatched(_front(spark, sf_dir), 1).select("run_key", F.size("dispatch").alias("started"), "in_flight")


@query("select event_id, case event_type when 'purchase' then 1 when 'view' then 4 else 3 end as tries from events")
def retry_tries(spark, sf_dir):
    kinds = F.when(F.col("event_type") == "purchase", F.lit(namespaces()[-1] + "notify")).when(F.col("event_type") == "view", F.lit("branch")).otherwise(F.lit("merge"))
    policy = durable.RetryPolicy(3, 100, {"notify": (9, 1), namespaces()[0] + "branch": (4, 50)})
    return table(spark, sf_dir, "events").select("event_id", policy.column(kinds).alias("tries"))


@query("with r as (select user_id as run_key, 'n' || (event_id % 3) as node_id, event_type as owner, first_value(event_type) over (partition by user_id, event_id % 3 order by event_id) as won from events) select run_key, node_id, won as owner, 'claimed' as status, cast(count(*) filter (where owner = won) as int) as attempts from r group by run_key, node_id, won")
def claim_exclusive(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_key"), F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("node_id"), F.col("event_type").alias("owner"), F.col("event_id").alias("seq"))
    none = spark.createDataFrame([], "run_key long, node_id string, status string, owner string, attempts int, first_attempt_at long")
    return durable.claimed(asked, none, F.lit(0).cast("long")).select("run_key", "node_id", "owner", "status", "attempts")


def _bulk(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A graph a customer: a node for each order, tied to those of the next key, and its line items."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    nodes = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").cast("string").alias("node_id"), F.lit(False).alias("may_float"), (F.col("o_orderstatus") == "F").alias("terminal"))
    edges = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").cast("string").alias("source"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("target"))
    return nodes, edges


@query("select o_custkey as graph_id, cast(o_orderkey as varchar) as node_id from orders where o_orderkey not in (select l_orderkey from lineitem) and o_custkey in (select o_custkey from orders group by 1 having count(*) > 1)")
def graph_floating(spark, sf_dir):
    return graphs.floating(*_bulk(spark, sf_dir)).select("graph_id", "node_id")


@query("select o_custkey as graph_id, cast(o_orderkey as varchar) as source, count(*) as edges from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1, 2")
def graph_terminators(spark, sf_dir):
    return graphs.terminator_edges(*_bulk(spark, sf_dir)).groupBy("graph_id", "source").agg(F.count(F.lit(1)).alias("edges"))


@query("with recursive e as (select n_nationkey % 5 as g, n_nationkey as s, n_nationkey + 5 as t from nation where n_nationkey < 20 union all select n_nationkey % 5, n_nationkey, n_nationkey + 10 from nation where n_nationkey < 15), l(g, n, level) as (select n_nationkey % 5, n_nationkey, 0 from nation where n_nationkey < 5 union all select e.g, e.t, level + 1 from l join e on e.s = l.n) select g as graph_id, n as node_id, max(level) as level from l group by 1, 2")
def topo_levels(spark, sf_dir):
    from weftline.sources.shared import checkpoint_folder

    checkpoint_folder(spark)
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("graph_id"), F.col("n_nationkey").alias("node_id"))
    steps = [n.where(F.col("node_id") < 25 - d).select("graph_id", F.col("node_id").alias("source"), (F.col("node_id") + d).alias("target")) for d in (5, 10)]
    return graphs.levels(n, steps[0].unionByName(steps[1]))


@query("select c_custkey, upper(c_name) as name, 2 * c_nationkey as twice from customer")
def host_pandas(spark, sf_dir):
    """A host's own kind, in Python over batches of JSON."""
    from weftline.operators.host import from_pandas

    def call(inputs):
        value = inputs["in"]
        return {"name": value["c_name"].upper(), "twice": 2 * value["c_nationkey"]}

    out = run(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_nationkey"], chain(node("h", "house_kind")), Host({"house_kind": from_pandas(call)})).output("end")
    return out.select(F.col("run_key").alias("c_custkey"), F.variant_get("value", "$.name", "string").alias("name"), F.variant_get("value", "$.twice", "int").alias("twice"))


@query("select status, count(*) as n from (select unnest(case o_orderstatus when 'F' then ['completed', 'completed', 'failed', 'completed'] when 'P' then ['completed', 'completed', 'skipped', 'completed', 'paused'] else ['completed', 'completed', 'skipped', 'completed', 'skipped', 'completed'] end) as status from orders) group by status")
def durable_claims(spark, sf_dir):
    """Claims of runs that end, fail or wait for a person."""
    from weftline.plans.values import Null

    def gate(step):
        step.abort(True, scalars.encoded_pause(F.lit(step.node.id), F.lit("approval")))
        return Null()

    g = graph([node("start", "manual_trigger"), node("sw", "switch_case", {"value": "{{ in.o_orderstatus }}", "cases": {"F": "f", "P": "p"}}), node("gone", "nowhere"), node("log", "log"), node("ask", "human_approval"), node("end", "output")], "start>sw", "start>log", "sw.f>gone", "sw.p>ask", "sw.default>end")
    rows = run(spark, sf_dir, "orders", "o_orderkey", ["o_orderstatus"], g, Host({"human_approval": gate})).claims()
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_orderstatus in ('F', 'P') as was, true as ok from orders")
def durable_resume(spark, sf_dir):
    """Runs that stopped, taken up from their claims once the missing kind is there."""
    from weftline.graph.document import import_document
    from weftline.plans.compiled import with_stored

    doc = import_document(graph([node("start", "manual_trigger"), node("sw", "switch_case", {"value": "{{ in.o_orderstatus }}", "cases": {"F": "late", "P": "late"}}), node("late", "nowhere"), node("end", "output")], "start>sw", "sw.late>late", "sw.default>end", "late>end"), lenient=True).graph
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_key"), "o_orderstatus")
    first = compile_graph(doc, rows, "run_key", ["o_orderstatus"])
    stopped = first.errors().select("run_key", F.lit(True).alias("was"))
    again, stored = with_stored(doc, rows, first.claims())
    second = compile_graph(doc, again, "run_key", [], Host({"nowhere": lambda step: step.input_or_all()}), resume=stored)
    return second.results().join(stopped, "run_key", "left").select(F.col("run_key").alias("o_orderkey"), F.coalesce("was", F.lit(False)).alias("was"), "ok")


@query("""with recursive e as (select event_id // 5 as run_key, row_number() over (partition by event_id // 5 order by event_id) as k, event_type as t, 'w' || (event_id % 2) as w from events),
s(run_key, k, status, attempts, owner) as (select distinct run_key, 0, cast(null as varchar), cast(null as int), cast(null as varchar) from e
union all select e.run_key, e.k,
  case when t = 'signup' then null when t = 'view' then 'paused' when t = 'purchase' then 'completed' when t = 'error' then case when status = 'completed' then status else 'skipped' end when status is null or (status = 'paused' and owner = w) then 'claimed' else status end,
  case when t = 'signup' then null when t in ('view', 'purchase', 'error') then coalesce(attempts, 0) when status is null then 1 when status in ('claimed', 'paused') and owner = w then attempts + 1 else attempts end,
  case when t = 'signup' then null when t = 'click' and status is null then w else owner end
from s join e on e.run_key = s.run_key and e.k = s.k + 1)
select run_key, status, attempts, owner from s where status is not null and not exists (select 1 from e where e.run_key = s.run_key and e.k > s.k)""")
def durable_transitions(spark, sf_dir):
    """Batches of claims, pauses, releases, completions and skips, five to a run, folded in their order."""
    op = F.element_at(F.create_map(*(F.lit(x) for x in ("click", "claim", "view", "pause", "purchase", "complete", "signup", "release", "error", "skip"))), F.col("event_type"))
    owner = F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("run_key"), F.lit("n").alias("node_id"), F.col("event_id").alias("seq"), op.alias("op"), owner.alias("owner"))
    none = rows.select("run_key", "node_id", *(F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in durable.CLAIM.split(", ")))).where("false")
    return durable.folded(rows, none).select("run_key", "status", "attempts", "owner")


_REVIEW = graph([node("start", "manual_trigger"), node("sort", "branch", {"condition": "{{ in.toxic }}"}), node("drop", "transform", fields(doc="{{ in.doc_id }}", verdict="drop")), node("keep", "transform", fields(doc="{{ in.doc_id }}", verdict="keep")), node("end", "merge")], "start>sort", "sort.true>drop", "sort.false>keep", "drop>end.a", "keep>end.b")


def _coordinator(spark, sf_dir, document: dict, host: Host | None = None, **more) -> durable.Coordinator:
    from weftline.graph.document import import_document

    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_key"), "doc_id", "quality", "toxic")
    return durable.Coordinator(import_document(document, lenient=True).graph, rows, host=host, **more)


@query("select doc_id as run_key, true as ok, case when toxic <> 0 then 'drop' else 'keep' end as verdict, doc_id as doc from labels")
def durable_pass(spark, sf_dir):
    """Durable runs driven pass by pass to their end, from claims alone."""
    done = _coordinator(spark, sf_dir, _REVIEW, max_concurrent=1).run_to_completion()
    end = F.get_json_object("outputs", "$.end")
    return done.select("run_key", "ok", F.get_json_object(end, "$.verdict").alias("verdict"), F.get_json_object(end, "$.doc").cast("bigint").alias("doc"))


@query("select doc_id as run_key, quality = 0 or toxic = 0 as ok, case when quality = 0 then 1 when toxic = 0 then 2 else 3 end as attempts, case when quality <> 0 and toxic <> 0 then 'refused at try 3' end as error, cast(77 as bigint) as first_attempt_at from labels")
def durable_retry(spark, sf_dir):
    """A node that fails at first: tried again under the same claim, whose first time stays."""
    from weftline.plans.values import step as field_of
    from weftline.plans.values import text

    def flaky(step):
        seen = {k: text(field_of(step.inputs.fields["in"][1], k)[1]) for k in ("quality", "toxic")}
        tries = F.when(seen["quality"] == "0", 1).when(seen["toxic"] == "0", 2).otherwise(9)
        step.abort(step.attempt < tries, F.concat(F.lit("refused at try "), step.attempt.cast("string")))
        return step.input_or_all()

    g = graph([node("start", "manual_trigger"), node("try", "flaky"), node("end", "output")], "start>try", "try>end")
    c = _coordinator(spark, sf_dir, g, Host({"flaky": flaky}), retry=durable.RetryPolicy(3), now=F.lit(77).cast("bigint"))
    done = c.run_to_completion()
    tried = c.claims.where("node_id = 'try'").select("run_key", "attempts", "first_attempt_at")
    return done.join(tried, "run_key").select("run_key", "ok", "attempts", "error", "first_attempt_at")


@query("select doc_id as run_key, 'sort' as node_id, case when toxic <> 0 then 'true' else 'false' end as port_id from labels union all select doc_id, 'start', 'out' from labels union all select doc_id, case when toxic <> 0 then 'drop' else 'keep' end, 'out' from labels")
def replay_probe(spark, sf_dir):
    """What completed nodes light, told by a replay in which nothing runs."""
    from weftline.graph.document import import_document

    g = import_document(_REVIEW, lenient=True).graph
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_key"), "doc_id", "quality", "toxic")
    claims = compile_graph(g, rows, "run_key").claims().where("node_id <> 'end'")
    return durable.replayed(g, rows, claims).published().select("run_key", "node_id", "port_id")


@query("select 'X' as key, 'old' as value union all select o_orderstatus, cast(max(o_orderkey) as varchar) from orders where o_orderstatus <> 'F' group by 1")
def data_store_applied(spark, sf_dir):
    """Sets and deletes of a table of runs, applied to the store in order of the runs' keys; three keys take all of them."""
    from weftline.operators.stores import applied

    put = lambda id, key: node(id, "data_store", {"operation": "set", "table": "t", "key": key, "value": "{{ in.o_orderkey }}"})
    g = graph([node("start", "manual_trigger"), node("sort", "switch_case", {"value": "{{ in.o_orderstatus }}", "cases": {"F": "f", "O": "o"}}), node("drop", "data_store", {"operation": "delete", "table": "t", "key": "F"}), put("put_o", "O"), put("put_p", "P")], "start>sort", "sort.f>drop", "sort.o>put_o", "sort.default>put_p")
    done = run(spark, sf_dir, "orders", "o_orderkey", ["o_orderkey", "o_orderstatus"], g).effects()
    store = spark.createDataFrame([("t", k, "old") for k in "FOX"], "table string, key string, value string")
    return applied(store, done, F.col("run_key")).select("key", "value")


@query("select '' || user_id % 7 as key, count(*) as items, '[' || string_agg(cast(event_id as varchar), ',' order by event_id) || ']' as value from (select *, max(case when event_type = 'error' then event_id end) over (partition by user_id % 7) as since from events where event_type in ('error', 'purchase')) where since is null or event_id >= since group by user_id % 7")
def memory_accumulates(spark, sf_dir):
    """Writes and appends to memory, batch after batch: an error starts a key's items anew, a purchase adds one."""
    from weftline.operators.stores import accumulated, no_items, remembered

    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    effect = F.when(F.col("event_type") == "error", F.lit("memory_write")).otherwise(F.lit("memory_append"))
    done = e.select(F.col("event_id").alias("run_key"), F.lit("m").alias("node_id"), F.to_json(F.struct(effect.alias("effect"), (F.col("user_id") % 7).cast("string").alias("key"), F.col("event_id").cast("string").alias("value"))).alias("effect"))
    half = e.agg(F.percentile("event_id", 0.5)).first()[0] or 0
    items = accumulated(no_items(e), done.where(F.col("run_key") <= half), F.col("run_key"))
    items = accumulated(items, done.where(F.col("run_key") > half), F.col("run_key"))
    return remembered(items).join(items.groupBy("key").agg(F.count(F.lit(1)).alias("items")), "key").select("key", "items", "value")


@query("select c_custkey, 'm1|0.5|Hi ' || c_name as said from customer")
def llm_host(spark, sf_dir):
    """A host's model, asked with the node's options."""
    from weftline.plans.values import Obj, Scalar, text

    def model(prompt, options):
        named = [text(options.fields[k][1]) for k in ("model", "temperature")]
        return Obj({"text": (True, Scalar(F.concat_ws("|", *named, prompt), "string"))})

    out = run(spark, sf_dir, "customer", "c_custkey", ["c_name"], chain(node("ask", "llm_call", {"prompt": "Hi {{ in.c_name }}", "model": "m1", "temperature": 0.5})), Host(model=model)).output("end")
    return out.select(F.col("run_key").alias("c_custkey"), F.col("text").alias("said"))


@query("select c_custkey, 'lookup:' || c_name as got from customer")
def tool_host(spark, sf_dir):
    """A host's tool, with the arguments that its node gives."""
    from weftline.plans.values import Obj, Scalar, text
    from weftline.plans.values import step as field_of

    def tool(name, args):
        return Obj({"got": (True, Scalar(F.concat(F.lit(name + ":"), text(field_of(args, "value")[1])), "string"))})

    out = run(spark, sf_dir, "customer", "c_custkey", ["c_name"], chain(node("t", "tool_use", {"tool": "lookup", "args": "{{ in.c_name }}"})), Host(tool=tool)).output("end")
    return out.select(F.col("run_key").alias("c_custkey"), "got")


def _documents(spark, sf_dir) -> DataFrame:
    """A JSON document a customer: a node for each order, edges to the next one and some to a node that is not there."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), "o_orderkey", "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "F", "log").when(F.col("o_orderstatus") == "O", "transform").otherwise("mystery")
    n = o.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", kind.alias("kind")))).alias("os"))
    name = lambda x: x["o_orderkey"].cast("string")
    nodes = F.transform("os", lambda x: F.struct(name(x).alias("id"), x["kind"].alias("kind")))
    ahead = F.transform(F.filter(F.transform("os", lambda x, i: F.struct(x.alias("x"), F.get("os", i + 1).alias("y"))), lambda p: p["y"].isNotNull() & (p["x"]["o_orderkey"] % 3 != 0)), lambda p: F.struct(F.concat(F.lit("e"), name(p["x"])).alias("id"), name(p["x"]).alias("source"), name(p["y"]).alias("target")))
    gone = F.transform(F.filter("os", lambda x: x["o_orderkey"] % 11 == 0), lambda x: F.struct(F.concat(F.lit("g"), name(x)).alias("id"), name(x).alias("source"), F.lit("gone").alias("target")))
    return n.select("graph_id", F.to_json(F.struct(F.lit(1).alias("version"), F.struct(nodes.alias("nodes"), F.concat(ahead, gone).alias("edges")).alias("graph"))).alias("document"))


_IMPORT_SQL = """with o as (select o_custkey as g, o_orderkey as k, o_orderstatus as s, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prv, count(*) over (partition by o_custkey) as n from orders),
i as (select g, 'unknown' as what from o where s not in ('F', 'O') union all select g, 'lost' from o where k % 11 = 0
union all select g, 'floating' from o where n > 1 and s in ('F', 'O') and (nxt is null or k % 3 = 0) and (prv is null or prv % 3 = 0)
union all select g, 'terminal' from o where s = 'F' and nxt is not null and k % 3 <> 0)
select g as graph_id, what, count(*) as n from i group by all"""


def _what(message):
    return F.when(message.startswith("Unknown"), "unknown").when(message.startswith("Edge target"), "lost").when(message.contains("connected to nothing"), "floating").when(message.contains("terminal node"), "terminal").otherwise(message)


@query(_IMPORT_SQL)
def graph_import(spark, sf_dir):
    """What is wrong with a table of documents, all read and checked at once."""
    _, _, issues = graphs.imported(_documents(spark, sf_dir))
    return issues.groupBy("graph_id", _what(F.col("message")).alias("what")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_custkey as graph_id, count(*) as nodes, count(*) filter (where nxt is not null and o_orderkey % 3 <> 0) as edges, min(o_orderkey) as first from (select *, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders) group by 1")
def graph_export(spark, sf_dir):
    """Documents read, written as JSON and read again."""
    nodes, edges, _ = graphs.imported(_documents(spark, sf_dir))
    nodes, edges, _ = graphs.imported(graphs.exported(nodes, edges))
    drawn = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    rows = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.min(F.when(F.col("place") == 0, F.col("node_id").cast("bigint"))).alias("first")).join(drawn, "graph_id", "left")
    return rows.select("graph_id", "nodes", F.coalesce("edges", F.lit(0)).cast("bigint").alias("edges"), "first")
