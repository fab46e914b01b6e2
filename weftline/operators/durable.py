"""Durable runs as tables: what may run next, what is skipped, what is held, what is retried.

claims has a row for each run and node that was touched: run_key, node_id, status (claimed, completed, skipped,
failed or paused) and ports (array of text, the ports that were lit). A graph's nodes and edges are plan-time
data, so one pass over the runs' claims, grouped by run, settles every run's frontier at once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.graph.document import Graph
from weftline.graph.kinds import Registry, built_in, matches, variants
from weftline.sources.shared import cut

SETTLED, HELD = ("completed", "skipped", "failed"), ("claimed", "paused")


def states(claims: DataFrame, key: str = "run_key") -> DataFrame:
    """A row a run: the map from node to (status, ports)."""
    return claims.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("status", F.coalesce("ports", F.array().cast("array<string>")).alias("ports"))))).alias("state"))


def frontier(graph: Graph, runs: DataFrame, claims: DataFrame, key: str = "run_key") -> DataFrame:
    """runs' keys with ready and skipped nodes, in order, and whether all is settled and any is held.

    A node waits while a source is unsettled. It is ready without edges or with a live one, and skipped with
    dead ones alone; what is skipped settles at once, without ports, and so skips on. The order is by rounds of
    a repeated scan in document order: a node whose skipped source stands after it comes a round later.
    """
    order = graph.order()
    if order is None:
        raise ValueError("the graph has a cycle")
    place = {n.id: i for i, n in enumerate(graph.nodes)}
    rows = runs.select(key).join(states(claims, key), key, "left")
    rows = rows.withColumn("state", F.coalesce("state", F.expr("cast(map() as map<string,struct<status:string,ports:array<string>>>)")))
    for i, n in enumerate(order):
        at = F.try_element_at("state", F.lit(n.id))
        status = at["status"]
        had = F.coalesce(status.isin(*SETTLED), F.lit(False))
        held = F.coalesce(status.isin(*HELD), F.lit(False))
        incoming = graph.incoming(n.id)
        blocked, live, round_ = F.lit(False), F.lit(not incoming), F.lit(0)
        for e in incoming:
            j = next(k for k, m in enumerate(order) if m.id == e.source)
            blocked = blocked | ~F.col(f"s{j}")
            ports = F.try_element_at("state", F.lit(e.source))["ports"]
            live = live | F.coalesce(F.array_contains(ports, e.out), F.lit(False))
            round_ = F.greatest(round_, F.when(F.col(f"k{j}"), F.col(f"r{j}") + int(place[e.source] > place[n.id])).otherwise(0))
        open_ = ~had & ~held & ~blocked
        skip = open_ & (~live | matches(n.kind, "note"))
        rows = rows.withColumns({f"k{i}": skip, f"d{i}": open_ & ~skip, f"s{i}": had | skip, f"h{i}": held, f"r{i}": round_})
    ranked = lambda what: F.transform(F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"{what}{i}"), F.struct(F.col(f"r{i}").alias("r"), F.lit(place[n.id]).alias("p"), F.lit(n.id).alias("id"))) for i, n in enumerate(order))))), lambda x: x["id"])
    every = F.lit(True)
    some = F.lit(False)
    count = F.lit(0)
    for i in range(len(order)):
        every, some, count = every & F.col(f"s{i}"), some | F.col(f"h{i}"), count + F.col(f"h{i}").cast("int")
    return rows.select(key, ranked("d").alias("ready"), ranked("k").alias("skipped"), every.alias("complete"), some.alias("in_flight"), count.alias("held"))


def dispatched(fronts: DataFrame, max_concurrent: int = 1) -> DataFrame:
    """The ready nodes that may start: all for 0, else as many as the cap leaves beside those held."""
    if max_concurrent < 0:
        raise ValueError("max_concurrent must not be negative")
    free = F.size("ready") if max_concurrent == 0 else F.greatest(F.lit(max_concurrent) - F.col("held"), F.lit(0))
    return fronts.withColumn("dispatch", F.slice("ready", F.lit(1), free))


#: A row of claims, besides its run and node.
CLAIM = "status string, ports array<string>, output string, error string, owner string, attempts int, first_attempt_at bigint"
_FIELDS = [f.split()[0] for f in CLAIM.split(", ")]
CHANGES = ("claim", "complete", "skip", "fail", "pause", "release")


def folded(changes: DataFrame, claims: DataFrame, key: str = "run_key", outcomes: bool = False) -> DataFrame:
    """claims after changes (run_key, node_id, seq, op, owner, at, output, ports, error), in order of seq for each run and node.

    claim takes a free node, or enters again for the owner who holds it, with one attempt more; the time of the
    first attempt stays. skip leaves a settled node as it is. complete, fail and pause set what they say, of a
    node that no one claimed too, and release takes the row away. With `outcomes` the result is instead a row a
    change: seq, op and applied, false for a claim that was lost and a skip of a settled node.

    Changes of one node of one run are folded together, as many as a batch has; claims and changes meet by run and node.
    """
    ends = _ended(changes, claims, key)
    return _outcomes(ends, key) if outcomes else _left(ends, key)


def _outcomes(ends: DataFrame, key: str) -> DataFrame:
    each = ends.where("changes is not null").select(key, "node_id", F.explode(F.arrays_zip(F.col("changes").alias("c"), F.col("end.applied").alias("a"))).alias("z"))
    return each.select(key, "node_id", "z.c.seq", "z.c.op", F.col("z.a").alias("applied"))


def _left(ends: DataFrame, key: str) -> DataFrame:
    return ends.where("end.state is not null").select(key, "node_id", "end.state.*")


def _ended(changes: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """A row for each run and node of claims and changes: the changes in order, and what they end in with what was applied."""
    asked = changes.groupBy(key, "node_id").agg(F.array_sort(F.collect_list(F.struct("seq", *(_given(changes, n, t).alias(n) for n, t in (("op", "string"), ("owner", "string"), ("at", "bigint"), ("output", "string"), ("ports", "array<string>"), ("error", "string")))))).alias("changes"))
    known = claims.select(key, "node_id", F.struct(*(_given(claims, n, t).alias(n) for n, t in (f.split(" ") for f in CLAIM.split(", ")))).alias("had"))
    rows = known.join(asked, [key, "node_id"], "full_outer")
    none = F.expr(f"cast(null as struct<{', '.join(f.replace(' ', ':') for f in CLAIM.split(', '))}>)")
    empty = F.array().cast("array<string>")

    def row(**parts: Column) -> Column:
        return F.struct(*(parts[n].alias(n) for n in _FIELDS))

    def told(state: Column, applied: Column) -> Column:
        return F.struct(state.alias("state"), applied.alias("applied"))

    def step(s: Column, c: Column) -> Column:
        there = s.isNotNull()
        same = {n: s[n] for n in _FIELDS} | {"attempts": F.coalesce(s["attempts"], F.lit(0)), "ports": F.coalesce(s["ports"], empty)}
        null = F.lit(None).cast("string")
        fresh = row(status=F.lit("claimed"), ports=empty, output=null, error=null, owner=c["owner"], attempts=F.lit(1), first_attempt_at=c["at"])
        own = F.coalesce(s["status"].isin(*HELD) & (s["owner"] == c["owner"]), F.lit(False))
        again = row(**(same | {"status": F.lit("claimed"), "attempts": same["attempts"] + 1}))
        set_to = lambda status, **more: row(**(same | {"status": F.lit(status), "ports": empty} | more))
        yes, settled = F.lit(True), F.coalesce(s["status"].isin(*SETTLED), F.lit(False))
        return (
            F.when((c["op"] == "claim") & ~there, told(fresh, yes))
            .when((c["op"] == "claim") & own, told(again, yes))
            .when(c["op"] == "claim", told(s, F.lit(False)))
            .when((c["op"] == "skip") & settled, told(s, F.lit(False)))
            .when(c["op"] == "skip", told(set_to("skipped"), yes))
            .when(c["op"] == "complete", told(set_to("completed", output=c["output"], ports=F.coalesce(c["ports"], empty), error=null), yes))
            .when(c["op"] == "fail", told(set_to("failed", error=c["error"]), yes))
            .when(c["op"] == "pause", told(set_to("paused", error=c["error"]), yes))
            .when(c["op"] == "release", told(none, there))
            .otherwise(told(s, F.lit(False)))
        )

    first = F.struct(F.col("had").alias("state"), F.expr("cast(array() as array<boolean>)").alias("applied"))

    def fold(done: Column, c: Column) -> Column:
        return let(step(done["state"], c), lambda t: F.struct(t["state"].alias("state"), F.concat(done["applied"], F.array(t["applied"])).alias("applied")))

    end = F.aggregate(F.coalesce("changes", F.expr("array()").cast(asked.schema["changes"].dataType)), first, fold)
    return rows.select(key, "node_id", "changes", end.alias("end"))


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def claimed(requests: DataFrame, claims: DataFrame, now: Column, key: str = "run_key") -> DataFrame:
    """claims after requests (run_key, node_id, owner, seq), in order of seq: see folded()."""
    asked = requests.select(key, "node_id", "owner", "seq", F.lit("claim").alias("op"), now.alias("at"))
    return folded(asked, claims, key).select(key, "node_id", "status", "owner", "attempts", "first_attempt_at")


def owner_token(run_key: Column, node_id: Column, n: Column) -> Column:
    """run_key:node_id:n, n being how many were given out before and this one; a queue's workers bring tokens of their own."""
    return F.concat(run_key.cast("string"), F.lit(":"), node_id, F.lit(":"), n.cast("string"))


@dataclass
class RetryPolicy:
    """Tries and backoff by kind; a kind that is unsafe to replay is tried once, whatever is set for it."""

    tries: int = 1
    backoff_ms: int = 0
    by_kind: dict[str, tuple[int, int]] = field(default_factory=dict)

    def of(self, kind: str, kinds: Registry | None = None) -> tuple[int, int]:
        found = (kinds or built_in()).get(kind)
        if found and found.side_effects == "unsafe-to-replay":
            return 1, 0
        names = [*variants(kind), *(v for a in (found.name, *found.aliases) for v in variants(a))] if found else variants(kind)
        tries, backoff = next((self.by_kind[n] for n in names if n in self.by_kind), (self.tries, self.backoff_ms))
        return max(1, tries), max(0, backoff)

    def column(self, kind: Column, kinds: Registry | None = None) -> Column:
        """The tries of each row's kind."""
        registry = kinds or built_in()
        out = F.lit(max(1, self.tries))
        by_tries: dict[int, list[str]] = {}
        for name in {*registry.by_id, *self.by_kind}:
            by_tries.setdefault(self.of(name, registry)[0], []).append(name)
        for tries, names in sorted(by_tries.items()):
            out = F.when(kind.isin(*sorted(names)), F.lit(tries)).otherwise(out)
        return out


def submitted(submissions: DataFrame, waiting: DataFrame, key: str = "run_key") -> tuple[DataFrame, DataFrame]:
    """(recorded, refused): an answer counts for the node that its run waits on, and the first one only."""
    rows = submissions.join(waiting.select(key, F.col("node_id").alias("awaited")), key, "left")
    good = F.coalesce(F.col("node_id") == F.col("awaited"), F.lit(False))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, good).orderBy("seq"))).withColumn("good", good)
    return ranked.where("good and n = 1").drop("n", "good", "awaited"), ranked.where("not (good and n = 1)").drop("n", "good", "awaited")


STOPPED, STUCK = "the run is waiting on work held elsewhere", "the run cannot progress; unsettled nodes: "  # fixed values
UNREACHED = "the engine skipped this node: no inbound edge was active"  # fixed value


@dataclass
class Coordinator:
    """A graph's durable runs, all of a table's at once: each pass is a few jobs over every run that can go on.

    runs has a row a run with the entry inputs; claims are kept as a table that every pass writes anew to the
    shared folder, so that a lost executor or driver loses one pass at most. `resume_from` continues from claims kept.
    """

    graph: Graph
    runs: DataFrame
    key: str = "run_key"
    seeds: object = None
    host: object = None
    kinds: object = True
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    max_concurrent: int = 1
    now: Column = field(default_factory=lambda: F.lit(0).cast("bigint"))
    claims: DataFrame | None = None
    on_events: object = None  # called with each pass's events (Run.events()) of the nodes that ran in it

    def __post_init__(self) -> None:
        if self.max_concurrent < 0:
            raise ValueError("max_concurrent must not be negative")
        if self.claims is None:
            none = (F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in ("node_id string, " + CLAIM).split(", ")))
            self.claims = self.runs.select(self.key, *none).where(F.lit(False))
        else:
            told = (_given(self.claims, n, t).alias(n) for n, t in (f.split(" ") for f in CLAIM.split(", ")))
            self.claims = self.claims.select(self.key, "node_id", *told)
        self.passes = 0

    def _keep(self, claims: DataFrame) -> None:
        self.claims = cut(claims)

    def tries(self) -> Column:
        registry = None if self.kinds is True else self.kinds
        out = F.lit(1)
        for n in self.graph.nodes:
            out = F.when(F.col("node_id") == n.id, F.lit(self.retry.of(n.kind, registry or None)[0])).otherwise(out)
        return out

    def advance(self, only: DataFrame | None = None) -> DataFrame:
        """Settle what is skipped; (run_key, dispatch): the nodes of each run that may start now."""
        runs = self.runs if only is None else self.runs.join(only, self.key, "left_semi")
        front = cut(frontier(self.graph, runs, self.claims, self.key))
        skips = front.select(self.key, F.posexplode("skipped").alias("seq", "node_id"), F.lit("skip").alias("op"))
        if not skips.isEmpty():
            self._keep(folded(skips, self.claims, self.key))
        return dispatched(front, self.max_concurrent).select(self.key, "dispatch")

    def run_nodes(self, targets: DataFrame) -> DataFrame:
        """Claim, replay and settle targets (run_key, node_id, owner, place); (run_key, node_id, place, status, output, ports, error, attempt, retryable).

        Each node is replayed behind a fence: what is completed is published again, the node itself runs, and no
        other does. A node that fails with tries left stays claimed, for its owner to enter again. What comes
        after a run's first pause or failure, in order of place, is let go, to be dispatched again if the run goes on.
        """
        from weftline.plans.compiled import compile_graph, with_stored

        asked = targets.select(self.key, "node_id", "place", F.col("place").alias("seq"), F.lit("claim").alias("op"), "owner", self.now.alias("at"))
        ends = cut(_ended(asked, self.claims, self.key))
        won, claims = _outcomes(ends, self.key).where("applied").select(self.key, "node_id"), _left(ends, self.key)
        mine = claims.join(won, [self.key, "node_id"], "left_semi").select(self.key, "node_id", "attempts", "first_attempt_at", "owner")
        by_run = mine.groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("attempts", "first_attempt_at")))).alias("__targets"))
        rows, resume = with_stored(self.graph, self.runs.join(by_run, self.key), claims, self.key)
        attempts = {n.id: F.try_element_at("__targets", F.lit(n.id)) for n in self.graph.nodes}
        may = {k: a.isNotNull() for k, a in attempts.items()}
        seeds = self.seeds if self.seeds is not None else [c for c in self.runs.columns if c != self.key]
        run = compile_graph(self.graph, rows, self.key, seeds, self.host, self.kinds, resume=resume, may_run=may, attempts=attempts)
        if self.on_events:
            self.on_events(run.events().join(won, [self.key, "node_id"], "left_semi"))
        told = run.outcomes()
        own = targets.select(self.key, "node_id", "place").join(mine, [self.key, "node_id"])
        told = own.join(told, [self.key, "node_id"], "left").withColumn("tries", self.tries())
        status = F.coalesce("status", F.lit("skipped"))
        error = F.when(status == "skipped", F.lit(UNREACHED)).otherwise(F.col("error"))
        retry = (status == "failed") & (F.col("attempts") < F.col("tries"))
        told = told.withColumns({"status": status, "error": error, "retryable": retry})
        ends = F.min(F.when(F.col("status").isin("paused", "failed"), F.col("place"))).over(Window.partitionBy(self.key))
        told = cut(told.withColumn("until", ends))
        counted = F.col("until").isNull() | (F.col("place") <= F.col("until"))
        op = F.when(~counted, F.when(F.col("attempts") == 1, "release")).when(F.col("retryable"), F.lit(None)).otherwise(F.element_at(F.create_map(*(F.lit(x) for x in ("completed", "complete", "skipped", "skip", "failed", "fail", "paused", "pause"))), F.col("status")))
        settled = told.withColumn("op", op).where("op is not null").select(self.key, "node_id", F.col("place").alias("seq"), "op", "output", "ports", "error")
        self._keep(folded(settled, claims, self.key))
        return told.where(counted).select(self.key, "node_id", "place", "status", "output", "ports", "error", F.col("attempts").alias("attempt"), "first_attempt_at", "retryable", "owner")

    def pass_on(self, only: DataFrame | None = None) -> DataFrame | None:
        """One pass over all runs, or those of `only`: advance, run what may start, try again what may. None if nothing may."""
        ready = self.advance(only)
        self.passes += 1
        targets = ready.select(self.key, F.posexplode("dispatch").alias("place", "node_id"))
        targets = cut(targets.withColumn("owner", owner_token(F.col(self.key), F.col("node_id"), F.lit(self.passes))))
        if targets.isEmpty():
            return None
        done = self.run_nodes(targets)
        while True:
            again = cut(done.where("retryable").select(self.key, "node_id", "place", "owner"))
            if again.isEmpty():
                return done
            done = done.where("not retryable").unionByName(self.run_nodes(again))

    def run_to_completion(self, most: int | None = None) -> DataFrame:
        """Passes until no run goes on, or `most` of them; then results(). A run that pauses or fails goes no further."""
        going = self.runs.select(self.key)
        for _ in range(max(10_000, len(self.graph.nodes) + 1) if most is None else most):
            done = self.pass_on(going)
            if done is None:
                break
            stopped = done.where("status in ('paused', 'failed')").select(self.key).distinct()
            going = cut(going.join(stopped, self.key, "left_anti"))
        return self.results()

    def results(self) -> DataFrame:
        """run_key, ok, outputs (JSON, in the order of nodes), error and pause, the text of the gate that a run waits at."""
        order = {n.id: i for i, n in enumerate(self.graph.nodes)}
        by_run = self.claims.groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("status", "output", "error")))).alias("state"))
        rows = self.runs.select(self.key).join(by_run, self.key, "left")
        at = {n: F.try_element_at("state", F.lit(n)) for n in order}
        none = F.lit(None).cast("string")
        parts = [F.when(at[n]["status"] == "completed", F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), F.coalesce(at[n]["output"], F.lit("null")))) for n in order]
        first = lambda status: F.get(F.array_compact(F.array(*(F.when(at[n]["status"] == status, F.coalesce(at[n]["error"], F.lit("node failed"))) for n in order))), F.lit(0))
        held = F.array_compact(F.array(*(F.when(at[n]["status"].isin(*HELD), F.lit(n)) for n in order)))
        open_ = F.array_compact(F.array(*(F.when(~F.coalesce(at[n]["status"].isin(*SETTLED), F.lit(False)), F.lit(n)) for n in order)))
        paused, failed = first("paused"), first("failed")
        error = F.when(paused.isNotNull(), none).when(failed.isNotNull(), failed).when(F.size(held) > 0, F.lit(STOPPED)).when(F.size(open_) > 0, F.concat(F.lit(STUCK), F.array_join(open_, ", ")))
        outputs = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
        return rows.select(self.key, (paused.isNull() & error.isNull()).alias("ok"), outputs.alias("outputs"), error.alias("error"), paused.alias("pause"))


def replayed(graph: Graph, runs: DataFrame, claims: DataFrame, node_id: str | None = None, key: str = "run_key", seeds: object = None, host: object = None, kinds: object = True):
    """The graph replayed up to one node: what is completed is published again, that node runs, all others are fenced.

    With node_id None nothing runs: a probe of what the completed nodes light. The result is a compiled Run;
    its published() has the ports that were lit and its outcomes() what the node gave.
    """
    from weftline.plans.compiled import compile_graph, with_stored

    rows, resume = with_stored(graph, runs, claims, key)
    may = {n.id: F.lit(n.id == node_id) for n in graph.nodes}
    names = seeds if seeds is not None else [c for c in runs.columns if c != key]
    return compile_graph(graph, rows, key, names, host, kinds, resume=resume, may_run=may)
