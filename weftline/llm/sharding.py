"""Shards of near equal bytes by histogram sort, in DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.cluster import cut

#: Bytes that a document counts for besides its text.
OVERHEAD = 16
#: A splitter is good if no row or group of rows that it could pass is larger than this share of a shard.
TOLERANCE = 0.001
#: Bits of the keys that the first and each later probe takes in.
FIRST_BITS, BITS = 16, 8
#: A task numbers about one such part of all rows at most, 1,000 at least.
PARTS = 1024

_LOW = -(1 << 63)


@dataclass
class _Leaf:
    """Rows whose keys lie in lo..hi (two signed longs each), with what was counted of them."""

    lo: tuple[int, int]
    hi: tuple[int, int]
    depth: int
    size: int
    rows: int
    only: bool


def _prefix(key: Column, bits: int) -> Column:
    """The first bits of a signed long, in its order."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(_LOW)), 64 - bits) if bits < 64 else key


def _counted(keys: DataFrame, depth: int, bits: int, within: list[_Leaf] | None) -> list[_Leaf]:
    """One exact count of rows and bytes for every value of the next bits of the keys."""
    first = depth < 64
    digit = F.shiftrightunsigned(F.col("k1" if first else "k2").bitwiseXOR(F.lit(_LOW)), 64 - depth % 64 - bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("digit")
    if within is None:
        parent = F.lit(0).cast("long").alias("parent")
        rows = keys.select(parent, digit, "k1", "k2", "size")
    else:
        spark = keys.sparkSession
        small = spark.createDataFrame([(i, _to(leaf.lo[0], min(depth, 64)), _to(leaf.lo[1], depth - 64) if not first and depth > 64 else 0) for i, leaf in enumerate(within)], "parent long, p1 long, p2 long")
        own = keys.withColumns({"p1": _prefix(F.col("k1"), min(depth, 64)), "p2": _prefix(F.col("k2"), depth - 64) if depth > 64 else F.lit(0).cast("long")})
        rows = own.join(F.broadcast(small), ["p1", "p2"]).select("parent", digit, "k1", "k2", "size")  # a row a leaf: fewer than the shards and PARTS
    found = rows.groupBy("parent", "digit").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")
    )
    out = []
    for r in found.collect():
        lo, hi = tuple(r["lo"]), tuple(r["hi"])
        deep = depth + bits
        if lo[0] == hi[0]:  # one text: only the second key can part it
            deep = max(deep, 64)
        out.append(_Leaf(lo, hi, deep, r["size"], r["n"], lo == hi))
    return sorted(out, key=lambda x: x.lo)


def _to(key: int, bits: int) -> int:
    return (key - _LOW) >> (64 - bits) if bits < 64 else key


def _split(keys: DataFrame, n: int, tolerance: float) -> tuple[list[_Leaf], list[tuple[int, int]], int]:
    """Leaves in key order, and the n - 1 splitters as (leaf, rows of it that come before)."""
    leaves = _counted(keys, 0, FIRST_BITS, None)
    total, rows = sum(x.size for x in leaves), sum(x.rows for x in leaves)
    most = max(1000, rows // PARTS)
    while True:
        within, below, target = set(), 0, 1
        for i, x in enumerate(leaves):
            while target < n and total * target <= below * n:
                target += 1
            wanted = target < n and total * target < (below + x.size) * n
            if not x.only and (wanted and x.size * n > tolerance * total or x.rows > most):
                within.add(i)
            below += x.size
        if not within:
            break
        depths = {leaves[i].depth for i in within}
        new: dict[int, list[_Leaf]] = {}
        for depth in sorted(depths):
            own = [i for i in sorted(within) if leaves[i].depth == depth]
            parts = _counted(keys, depth, BITS, [leaves[i] for i in own])
            at = 0
            for i in own:
                new[i] = []
                while at < len(parts) and parts[at].hi <= leaves[i].hi:
                    new[i].append(parts[at])
                    at += 1
        leaves = [y for i, x in enumerate(leaves) for y in new.get(i, [x])]
    cuts, below, at = [], 0, 0
    for target in range(1, n):
        while at < len(leaves) and (below + leaves[at].size) * n <= total * target:
            below += leaves[at].size
            at += 1
        if at == len(leaves):
            cuts.append((at, 0))
            continue
        x = leaves[at]
        each = x.size // x.rows if x.only else x.size
        steps = x.rows if x.only else 1
        k = min(steps, round((total * target / n - below) / max(1, each)))
        cuts.append((at, k if x.only else k * x.rows))
    return leaves, cuts, most


def sharded(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in its shard).

    The shards' bytes are equal but for `tolerance` of a shard, or the one row next to a splitter if that is
    larger. Rows are in order of a hash of the text and one of the doc_id, so that equal texts stand together
    and are parted only where a splitter falls among more of them than the tolerance; equal rows are parted by
    their number. A null text has no bytes; a null doc_id is hashed as null; an empty table gives no rows;
    columns of these four names are replaced.

    Plan: one scan writes the keys and sizes to the shared folder; each probe counts bytes exactly below
    candidate keys, finer around the splitters, and sends the driver 2^16 counts, then 2^8 for each leaf that it
    parts; one exchange by the parts so found numbers the rows. Part tables are of 2^16 + n_shards + 2 * PARTS
    rows or fewer, and so are broadcast.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    tag = "__"  # names of its own; columns stay apart, so that those no one asks for are not moved
    while any(c.startswith(tag) for c in names):
        tag += "_"
    k1, k2, p, part, n, cuts_, shard0, slot0, lo1, lo2, hi1, hi2 = (tag + c for c in ("k1", "k2", "p", "part", "n", "cuts", "shard0", "slot0", "lo1", "lo2", "hi1", "hi2"))
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    told = docs.select(*kept, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias(k1), F.xxhash64(F.col(id_col), F.lit(1)).alias(k2))
    keys = cut(told.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "size"))
    leaves, cuts, most = _split(keys, n_shards, tolerance)
    if not leaves:
        return told.select(*kept, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    by_leaf: dict[int, list[int]] = {}
    for leaf, rows in cuts:
        by_leaf.setdefault(leaf, []).append(rows)
    parts, shard, slot = [], 0, 0
    for i, x in enumerate(leaves):
        own = by_leaf.get(i, [])
        while own and own[0] == 0:
            shard, slot, own = shard + 1, 0, own[1:]
        at = _to(x.lo[0], FIRST_BITS)
        last = parts[-1] if parts else None
        if last and last["p"] == at and last["shard"] == shard and last["slot"] + last["rows"] == slot and not last["cuts"] and not own and last["rows"] + x.rows <= most:
            last["hi"], last["rows"] = x.hi, last["rows"] + x.rows
        else:
            parts.append({"p": at, "lo": x.lo, "hi": x.hi, "shard": shard, "slot": slot, "cuts": own, "rows": x.rows})
        if own:
            shard, slot = shard + len(own), x.rows - own[-1]
        else:
            slot += x.rows
    table = docs.sparkSession.createDataFrame(
        [(p["p"], *p["lo"], *p["hi"], i, p["shard"], p["slot"], p["cuts"]) for i, p in enumerate(parts)],
        f"{p} long, {lo1} long, {lo2} long, {hi1} long, {hi2} long, {part} int, {shard0} int, {slot0} long, {cuts_} array<long>",
    )
    inside = (F.struct(k1, k2) >= F.struct(lo1, lo2)) & (F.struct(k1, k2) <= F.struct(hi1, hi2))
    placed = told.withColumn(p, _prefix(F.col(k1), FIRST_BITS)).alias("a").join(F.broadcast(table.alias("b")), (F.col(f"a.{p}") == F.col(f"b.{p}")) & inside).drop(p)
    placed = placed.withColumn(n, F.row_number().over(Window.partitionBy(part).orderBy(k1, k2)).cast("long") - 1)
    passed = F.size(F.filter(cuts_, lambda c: c <= F.col(n)))
    before = F.try_element_at(cuts_, F.greatest(passed, F.lit(1)))
    return placed.select(*kept, "size", "text_crc32", (F.col(shard0) + passed).alias("shard"), F.when(passed == 0, F.col(slot0) + F.col(n)).otherwise(F.col(n) - before).alias("slot"))
