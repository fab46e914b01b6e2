"""Workflows on streams: runs that need no one's answer, human gates, and claims kept batch by batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.scalars import FALSE_TEXTS, PAUSE
from weftline.graph.document import Graph
from weftline.operators.durable import claimed
from weftline.plans.compiled import Host, Run, compile_graph

GATE_SCHEMA = "run_key string, node_id string, status string, port string, value string, reason string"
STATE_SCHEMA = "node_id string, awaiting string, detail string, settled boolean"


def streamed(graph: Graph | dict, runs: DataFrame, key: str, columns: list[str] | None = None, host: Host | None = None) -> Run:
    """A graph over a stream of runs. The plan has no exchange and no state, and so is written in append mode."""
    if not runs.isStreaming:
        raise ValueError("runs is no stream")
    return compile_graph(graph, runs, key, columns, host)


def _pause(node_id: str, awaiting: str, detail: str | None) -> str:
    body = json.dumps({"nodeId": node_id, "awaiting": awaiting}, separators=(",", ":"))
    return PAUSE + (body if detail is None else body[:-1] + f',"detail":{detail}' + "}")


#: What a gate asks for if its node says nothing else, as JSON. Fixed values.
DETAIL = {"input": '{"title":"Need your input","fields":[]}', "approval": '{"title":"Approve action","description":null}'}


def _step(forget_after: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    columns = ["run_key", "node_id", "status", "port", "value", "reason"]
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=columns)
        return
    run_key, node_id = key
    _, awaiting, detail, settled = state.get if state.exists else (node_id, None, None, False)
    rows = pd.concat(list(batches))
    rows["first"] = rows.event.map({"arrive": 0, "answer": 1})
    out = []
    for r in rows.sort_values(["seq", "first"]).itertuples():
        said = None if pd.isna(r.value) else r.value
        if r.event == "arrive" and awaiting is None:
            awaiting, detail = r.awaiting, DETAIL.get(r.awaiting) if pd.isna(r.detail) else r.detail
            if r.auto and said is not None and said != "null":  # the node lets its input answer
                settled = True
                out.append((run_key, node_id, "completed", _port(awaiting, said), said, None))
            else:
                out.append((run_key, node_id, "paused", None, None, _pause(node_id, awaiting, detail)))
        elif r.event == "answer" and awaiting is not None and not settled:
            settled = True
            out.append((run_key, node_id, "completed", _port(awaiting, said or "null"), said, None))
        elif r.event == "answer":
            out.append((run_key, node_id, "refused", None, said, "the run does not wait on this node"))
    state.update((node_id, awaiting, detail, settled))
    if settled:
        state.setTimeoutDuration(forget_after)
    yield pd.DataFrame(out, columns=columns)


def _port(awaiting: str, said: str) -> str:
    """An approval goes by the truth of its answer; an input has one port."""
    if awaiting != "approval":
        return "out"
    try:
        value = json.loads(said)
    except ValueError:
        value = said
    if isinstance(value, str):
        value = value.strip().lower() not in FALSE_TEXTS
    return "approved" if value else "denied"


def gated(events: DataFrame, forget_after_s: int = 7 * 24 * 3600) -> DataFrame:
    """Human gates over a stream of events: run_key, node_id, event (arrive or answer), awaiting, detail, value, seq and auto.

    A run that arrives parks with a pause, whatever value it brings; only where auto is true (the node's
    autoAnswerFromInput) a value that is not null answers at once. The first answer to a parked gate completes it
    on its port, and every other answer is refused. Each run and node is a state of its own, which one task holds
    at a time, so that no two answers can both count; a settled one is let go after forget_after_s.
    """
    auto = F.coalesce(F.col("auto"), F.lit(False)) if "auto" in events.columns else F.lit(False)
    rows = events.select("run_key", "node_id", "event", "awaiting", "detail", "value", "seq", auto.alias("auto"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _step(1000 * forget_after_s, key, batches, state)

    return rows.groupBy("run_key", "node_id").applyInPandasWithState(step, GATE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def claim_batches(requests: DataFrame, path: str, checkpoint: str, now_ms: int):
    """A query that folds batches of claim requests into the claims under path; each batch writes a version of its own.

    A batch that is run again writes the same version again, from the version before it, so that nothing counts twice.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        empty = "run_key string, node_id string, status string, owner string, attempts int, first_attempt_at long"
        before = spark.read.schema(empty).parquet(f"{path}/v{batch_id - 1}") if batch_id else spark.createDataFrame([], empty)
        asked = batch.select("run_key", "node_id", "owner", "seq")
        claimed(asked, before, F.lit(now_ms).cast("long")).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return requests.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
