"""Workflows and gates on streams."""

from pyspark.sql import functions as F

from weftline.plans.queries import chain, fields, node
from weftline.streaming import gates


def batches(spark, tmp_path, rows_by_batch, schema):
    for i, rows in enumerate(rows_by_batch):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stateless_graph_streams(spark, tmp_path):
    stream = batches(spark, tmp_path, [[("a", 1)], [("b", 0)]], "run_key string, x int")
    r = gates.streamed(chain(node("b", "branch", {"condition": "{{ in.x }}"})), stream, "run_key", ["x"])
    run(r.published().where("node_id = 'b'").writeStream.format("memory").queryName("ports").option("checkpointLocation", str(tmp_path / "c")))
    assert {tuple(x) for x in spark.table("ports").select("run_key", "port_id").collect()} == {("a", "true"), ("b", "false")}
    assert fields(a=1)["mode"] == "fields"


def test_gates(spark, tmp_path):
    schema = "run_key string, node_id string, event string, awaiting string, detail string, value string, seq int, auto boolean"
    first = [("r", "g", "arrive", "approval", '{"title":"T"}', "true", 1, False), ("q", "g", "arrive", "input", None, '{"a":1}', 1, True), ("p", "g", "answer", None, None, "1", 1, None), ("s", "g", "arrive", "input", None, '{"a":1}', 1, None)]
    second = [("r", "g", "answer", None, None, "false", 2, None), ("r", "g", "answer", None, None, "true", 3, None)]
    stream = batches(spark, tmp_path, [first, second], schema)
    run(gates.gated(stream).writeStream.format("memory").queryName("gates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")))
    got = {(r["run_key"], r["status"], r["port"], r["value"]) for r in spark.table("gates").collect()}
    assert ("r", "paused", None, None) in got and ("q", "completed", "out", '{"a":1}') in got and ("p", "refused", None, "1") in got
    reasons = {r["run_key"]: r["reason"] for r in spark.table("gates").collect() if r["status"] == "paused"}
    assert reasons.keys() == {"r", "s"} and '"title":"Need your input"' in reasons["s"]  # a value alone answers nothing
    done = [x for x in got if x[0] == "r" and x[1] == "completed"]
    assert len(done) == 1 and done[0][2] == "denied" and ("r", "refused") in {x[:2] for x in got}


def test_claim_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [[("r", "a", "me", 1), ("r", "a", "you", 2)], [("r", "a", "you", 3), ("r", "a", "me", 4)]], "run_key string, node_id string, owner string, seq int")
    run(gates.claim_batches(stream, str(tmp_path / "claims"), str(tmp_path / "c"), 7))
    rows = spark.read.parquet(str(tmp_path / "claims" / "v1")).select("owner", "attempts", F.col("first_attempt_at")).collect()
    assert len(rows) == 1 and rows[0]["owner"] == "me" and rows[0]["first_attempt_at"] == 7 and rows[0]["attempts"] == 2
