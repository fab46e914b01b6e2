"""What runs did to a host's stores, applied to its tables: a table of keys, and memory that accumulates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EFFECT = "effect string, table string, key string, value string"


def _told(effects: DataFrame, order: Column, kinds: tuple[str, ...]) -> DataFrame:
    """The effects of these kinds as columns, with their order; of one run's, by node."""
    rows = effects.select(F.struct(order.alias("run"), F.col("node_id").alias("node")).alias("order"), F.from_json("effect", _EFFECT).alias("e"))
    return rows.where(F.col("e.effect").isin(*kinds)).select("order", F.col("e.effect").alias("op"), F.col("e.table").alias("table"), F.coalesce("e.key", F.lit("")).alias("key"), F.col("e.value").alias("value"))


def applied(store: DataFrame, effects: DataFrame, order: Column) -> DataFrame:
    """A store (table, key, value) after the set and delete effects of runs (Run.effects()).

    Of effects on one key the last in `order` counts; a hot key's are combined before their exchange. Keys of the
    store that nothing touched stay as they are.
    """
    last = _told(effects, order, ("set", "delete")).groupBy("table", "key").agg(F.max_by(F.struct("op", "value"), "order").alias("did"))
    rows = store.select("table", "key", F.struct("value").alias("had")).join(last, ["table", "key"], "full_outer")
    value = F.when(F.col("did").isNull(), F.col("had.value")).otherwise(F.col("did.value"))
    return rows.where("did is null or did.op = 'set'").select("table", "key", value.alias("value"))


def accumulated(items: DataFrame, effects: DataFrame, order: Column) -> DataFrame:
    """Memory as items (key, at, value) after the memory_write and memory_append effects of runs.

    A write puts its value in the place of all before it, an append adds one; `at` is where an item stands among
    its key's, old items first, from the batch's own order. Items stay rows each, so that no key's are gathered.
    """
    done = _told(effects, order, ("memory_write", "memory_append"))
    wrote = done.where("op = 'memory_write'").groupBy("key").agg(F.max("order").alias("since"))
    kept = items.join(wrote.select("key"), "key", "left_anti").select("key", "at", "value")
    base = kept.groupBy("key").agg(F.max("at").alias("top"))
    new = done.join(wrote, "key", "left").where("since is null or order >= since").join(base, "key", "left")
    batch = F.coalesce(F.get(F.col("top"), F.lit(0)).cast("bigint"), F.lit(0)) + 1
    at = F.array(F.lpad(batch.cast("string"), 20, "0"), F.lpad(F.col("order.run").cast("string"), 20, "0"), F.col("order.node"))
    return kept.unionByName(new.select("key", at.alias("at"), "value"))


def remembered(items: DataFrame) -> DataFrame:
    """(key, value): each key's items as one JSON list, as a run reads them; for keys whose lists are wanted."""
    listed = items.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("items"))
    return listed.select("key", F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["value"]), ","), F.lit("]")).alias("value"))


def no_items(df: DataFrame) -> DataFrame:
    """Memory without items."""
    return df.sparkSession.createDataFrame([], "key string, at array<string>, value string")
