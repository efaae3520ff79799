"""Parent-child links to full hierarchies.

Three steps, so that the shuffles carry links between fragments and not every
level of every tree:

1. *Contract.* The nodes are partitioned by a locality key (a document, say; one
   with too many nodes for a partition is dealt out by id).
   Inside a partition pointer doubling over numpy arrays leads each node to its
   *exit*: the last ancestor inside the partition. Circles that lie in one
   partition are found here.
2. *Solve the quotient.* Only exits whose parent lies in another partition make
   up the quotient forest. While it is larger than ``task_rows`` it is contracted
   again under a coarser partitioning (``fanin`` partitions become one); what is
   left when one partition remains, or when a level no longer shrinks it, is
   solved by one task if it fits and by pointer doubling with joins if not.
3. *Expand.* Each node takes root, depth and circle of its exit and adds its own
   distance, level by level.

Defined cases: a null or empty parent, and a parent that is no node, make a
root; a node that is its own parent is a circle of one; nodes on or below a
circle have depth -1 and the smallest id of the circle as root; repeated rows of
a node must be resolved before (``current_zones``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.runtime import staged

#: Rows that one task may hold for the quotient forest (about 100 bytes each).
TASK_ROWS = 1_000_000
#: Sorts after every id.
LAST = "\U0010ffff"
#: Nodes of one partition in the first contraction.
NODES_PER_PART = 200_000


def current_zones(zones: DataFrame, *columns: str) -> DataFrame:
    """The row with the latest ``saved_at`` of each zone, with ``columns`` only.

    ``max_by`` combines on the map side, so repeated and stale rows don't travel.
    Rows with null zone_id are dropped; a null ``saved_at`` counts as the oldest;
    a tie takes the larger row in the order of ``columns``.
    """
    cols = [c for c in columns if c != "zone_id"]
    plain = [c for c in cols if not zones.schema[c].dataType.typeName() == "map"]
    order = F.struct(F.coalesce(F.col("saved_at").cast("timestamp"), F.lit(0).cast("timestamp")), *plain)
    return (
        zones.where("zone_id is not null")
        .groupBy("zone_id")
        .agg(F.max_by(F.struct(*cols), order).alias("_r"))
        .select("zone_id", *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def _key(c) -> F.Column:
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def _doubled(up: np.ndarray, values: np.ndarray, op) -> tuple[np.ndarray, np.ndarray]:
    """Follow ``up`` to its end by doubling; ``values`` of the steps passed are combined by ``op``."""
    for _ in range(int(np.ceil(np.log2(len(up) + 1))) + 1):
        values = op(values, values[up])
        up = up[up]
    return up, values


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of links -> for each node its exit, and what lies between.

    In: id, parent (null at a root), w (tree steps of the link), low (smallest
    tree node that the link passes, its target included), seg (tree nodes after
    the parent down to the node). Out: id, exit, steps, low, path (after the exit
    down to the node), exit_parent, exit_w, exit_low, exit_seg, ring.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).sort_by("id")
    n = t.num_rows
    ids, parents, lows, w = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "parent", "low", "w"))
    segs = t["seg"].to_pylist()
    has = np.array([p is not None for p in parents], dtype=bool)
    at = np.arange(n)
    up = at.copy()
    if has.any():
        wanted = parents[has].astype(object)
        pos = np.minimum(np.searchsorted(ids, wanted), n - 1)
        hit = ids[pos] == wanted
        up[np.flatnonzero(has)[hit]] = pos[hit]
    inner = up != at
    own = np.zeros(n, bool)
    own[has] = parents[has] == ids[has]
    names, rank = np.unique(np.array([LAST if x is None else x for x in lows], dtype=object), return_inverse=True)
    jump, _ = _doubled(up, np.zeros(n, np.int8), np.add)
    circle = inner[jump] | own[jump]
    free = ~circle
    calm = np.where(free, up, at)
    _, steps = _doubled(calm, np.where(free & inner, w, 0).astype(np.int64), np.add)
    _, low = _doubled(calm, np.where(free & inner, rank, len(names)), np.minimum)
    ring = np.full(n, -1)
    if circle.any():
        on = np.unique(jump[circle])  # a circle maps onto itself, so these are all nodes on circles
        best = np.full(n, len(names))
        best[on] = rank[on]
        _, best = _doubled(up, best, np.minimum)
        ring[circle] = best[jump[circle]]
    paths: list = [[]] * n
    if any(segs):
        _, hops = _doubled(calm, (free & inner).astype(np.int64), np.add)
        for k in np.argsort(hops, kind="stable"):
            if hops[k]:
                paths[k] = paths[up[k]] + segs[k]
    out = {
        "id": ids,
        "exit": ids[jump],
        "steps": np.where(free, steps, -1),
        "low": [names[x] if x < len(names) else None for x in low],
        "path": paths,
        "exit_parent": [parents[e] if f else None for e, f in zip(jump, free)],
        "exit_w": w[jump],
        "exit_low": lows[jump],
        "exit_seg": [segs[k] if k == e else [] for k, e in enumerate(jump)],
        "ring": [names[r] if r >= 0 else None for r in ring],
    }
    for k in range(0, n, 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name][k : k + 20_000], f.type) for f in _SCHEMA], schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("id", pa.string()), ("exit", pa.string()), ("steps", pa.int64()), ("low", pa.string()), ("path", pa.list_(pa.string())), ("exit_parent", pa.string()), ("exit_w", pa.int64()), ("exit_low", pa.string()), ("exit_seg", pa.list_(pa.string())), ("ring", pa.string())]
)
_OUT = "id string, exit string, steps bigint, low string, path array<string>, exit_parent string, exit_w bigint, exit_low string, exit_seg array<string>, ring string"
_SOLVED = ("id", "exit", "steps", "path", "ring")
_LINK = ("id", "parent", "w", "low", "seg")


def _contracted(links: DataFrame) -> DataFrame:
    return links.select(*_LINK).mapInArrow(_contract, _OUT)


def _by_joins(links: DataFrame) -> DataFrame:
    """Roots of a quotient forest of any size, by pointer doubling with joins.

    A first doubling moves ids alone: a node that has not come to a root after
    log2(n)+1 rounds is on or below a circle, and there a second one carries the
    smallest id along. Paths are carried last and only by nodes that have a root, so
    they are as long as the tree is deep, whatever that is.
    """
    up = staged(links.select("id", F.col("parent").alias("to")), "jump")
    rounds = max(1, int(np.ceil(np.log2(up.count() + 1))) + 1)
    for _ in range(rounds):
        if not up.where("to is not null").take(1):
            break
        nxt = up.select(F.col("id").alias("to"), F.col("to").alias("_t"), F.lit(True).alias("_k"))
        # at a root the way ends: ``to`` becomes null one step after the root is reached
        up = staged(up.join(nxt, "to", "left").select("id", F.when(F.col("_k"), F.col("_t")).alias("to")), "jump")
    stuck = up.where("to is not null")
    edge = links.where("parent is not null").select(F.col("id").alias("to"), F.col("parent").alias("_t"), F.col("low").alias("_l"))
    on = staged(stuck.select(F.col("to").alias("id")).distinct().join(edge.withColumnRenamed("to", "id"), "id").select("id", F.col("_t").alias("to"), F.col("_l").alias("best")), "ring")
    if on.take(1):
        for _ in range(rounds):
            nxt = on.select(F.col("id").alias("to"), F.col("to").alias("_t"), F.col("best").alias("_l"))
            on = staged(on.join(nxt, "to").select("id", F.col("_t").alias("to"), F.least("best", "_l").alias("best")), "ring")
    empty = F.array().cast("array<string>")
    circles = stuck.join(on.select(F.col("id").alias("to"), F.col("best").alias("ring")), "to").select("id", F.col("to").alias("exit"), F.lit(-1).cast("bigint").alias("steps"), empty.alias("path"), "ring")
    cur = staged(links.join(stuck.select("id"), "id", "left_anti").select("id", F.col("parent").alias("to"), F.col("w").alias("d"), F.col("seg").alias("path")), "jump")
    for _ in range(rounds):
        nxt = cur.where("to is not null").select(F.col("id").alias("to"), F.col("to").alias("_t"), F.col("d").alias("_d"), F.col("path").alias("_p"))
        moved = F.col("_t").isNotNull()
        if not cur.join(nxt, "to", "left_semi").take(1):
            break
        cur = staged(
            cur.join(nxt, "to", "left").select(
                "id", F.when(moved, F.col("_t")).otherwise(F.col("to")).alias("to"), F.when(moved, F.col("d") + F.col("_d")).otherwise(F.col("d")).alias("d"),
                F.when(moved, F.concat("_p", "path")).otherwise(F.col("path")).alias("path"),
            ),
            "jump",
        )
    root = F.col("to").isNull()
    free = cur.select("id", F.coalesce("to", "id").alias("exit"), F.when(root, 0).otherwise(F.col("d")).alias("steps"), F.when(root, empty).otherwise(F.col("path")).alias("path"), F.lit(None).cast("string").alias("ring"))
    return free.unionByName(circles)


def _solve(links: DataFrame, parts: int, task_rows: int, fanin: int) -> DataFrame:
    """links of exits, with ``home`` (the partition of a node) -> _SOLVED, the final root as exit.

    Every parent is a node of ``links``.
    """
    n = links.count()
    if n <= task_rows:
        return _contracted(links.coalesce(1)).select(*_SOLVED)
    if parts <= 1:
        return _by_joins(links)
    coarse = max(1, parts // fanin)
    moved = links.withColumn("home", F.col("home") % coarse)
    done = staged(_contracted(moved.repartition(coarse, "home")).join(moved.select("id", "home"), "id"), "contracted")
    if done.where("id = exit and exit_parent is not null and ring is null").count() > 0.9 * n:
        return _by_joins(links)
    return _resolve(done, coarse, task_rows, fanin)


def _resolve(done: DataFrame, parts: int, task_rows: int, fanin: int) -> DataFrame:
    """A contraction (with ``home``) -> _SOLVED across all its partitions."""
    links = staged(_quotient(done), "links")
    if not links.take(1):
        return done.select(*_SOLVED)
    solved = _solve(links, parts, task_rows, fanin)
    hung = links.where("ring0 is not null").select(F.col("id").alias("exit"), F.col("ring0").alias("_r0"))
    solved = solved.join(hung, "exit", "left").withColumn("ring", F.coalesce("ring", "_r0")).drop("_r0")
    return _expand(done, solved)


def _quotient(done: DataFrame) -> DataFrame:
    """The links between the fragments of a contraction, and the roots they lead to."""
    exits = done.where("id = exit and exit_parent is not null and ring is null").select("id", F.col("exit_parent").alias("_p"), "exit_w", "exit_low", "exit_seg", "home")
    target = done.select(F.col("id").alias("_p"), F.col("exit").alias("parent"), F.col("steps").alias("_s"), F.col("low").alias("_l"), F.col("path").alias("_path"), F.col("ring").alias("ring0"))
    links = exits.join(target, "_p").select(
        "id", F.when(F.col("ring0").isNull(), F.col("parent")).alias("parent"), (F.col("exit_w") + F.greatest("_s", F.lit(0))).alias("w"), F.least("exit_low", "_l").alias("low"),
        F.concat("_path", "exit_seg").alias("seg"), "home", "ring0",
    )
    tops = done.where("id = exit and exit_parent is null and ring is null").join(links.select(F.col("parent").alias("id")), "id", "left_semi")
    null = F.lit(None).cast("string")
    return links.unionByName(tops.select("id", null.alias("parent"), F.lit(0).cast("bigint").alias("w"), null.alias("low"), F.array().cast("array<string>").alias("seg"), "home", null.alias("ring0")))


def _expand(done: DataFrame, solved: DataFrame) -> DataFrame:
    s = solved.select(F.col("id").alias("exit"), F.col("exit").alias("_root"), F.col("steps").alias("_up"), F.col("path").alias("_path"), F.col("ring").alias("_ring"))
    ring = F.coalesce("ring", "_ring")
    return done.join(s, "exit", "left").select(
        "id",
        F.coalesce("_root", "exit").alias("exit"),
        F.when(ring.isNotNull(), F.lit(-1)).otherwise(F.col("steps") + F.coalesce("_up", F.lit(0))).alias("steps"),
        F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
        ring.alias("ring"),
    )


def _placed(base: DataFrame, parts: int, node_rows: int) -> DataFrame:
    """Adds ``home``: the partition of a node, by its locality; a locality of more than ``node_rows`` nodes is dealt out by id."""
    large = base.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > node_rows).select("_h", F.ceil(F.col("_n") / node_rows).alias("_k"))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_k")), F.lit(0))
    return base.join(large, "_h", "left").withColumn("home", F.pmod(F.pmod("_h", F.lit(parts)) + part, F.lit(parts)).cast("int")).drop("_k")


def hierarchy(nodes: DataFrame, locality: str | None = None, with_path: bool = False, task_rows: int = TASK_ROWS, node_rows: int = NODES_PER_PART, parts: int | None = None, fanin: int = 8) -> DataFrame:
    """nodes(id, parent, and the column ``locality``) -> (id, root, depth, ring[, path]).

    ``ring`` is the smallest id of the circle that a node is on or below, else
    null. ``path`` holds the ids from the root down to the node, null with a ring.
    Ids must be unique and not null. An empty table gives an empty one.
    """
    spark = nodes.sparkSession
    loc = F.col(locality) if locality else F.col("id")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_k"))
    base = nodes.select("id", "parent", F.xxhash64(loc).alias("_h")).join(known, "parent", "left").select("id", F.when(F.col("_k"), F.col("parent")).alias("parent"), "_h")
    seg = F.array("id") if with_path else F.array().cast("array<string>")
    base = staged(base.select("id", "parent", F.lit(1).cast("bigint").alias("w"), F.col("parent").alias("low"), seg.alias("seg"), "_h"), "nodes")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // node_rows))
    base = _placed(base, parts, node_rows)
    done = staged(_contracted(base.repartition(parts, "home")).join(base.select("id", "home"), "id"), "contracted")
    flat = _resolve(done, parts, task_rows, fanin)
    free = F.col("ring").isNull()
    path = [F.when(free, F.concat(F.array("exit"), "path")).alias("path")] if with_path else []
    return flat.select("id", F.coalesce("ring", "exit").alias("root"), F.when(free, F.col("steps")).otherwise(-1).cast("int").alias("depth"), "ring", *path)


def zone_nodes(zones: DataFrame) -> DataFrame:
    """Current zones as nodes: id and parent in one spelling, with doc_id and level.

    Zone keys match regardless of case and blanks; of keys that become equal the
    smallest zone_id stays.
    """
    cur = current_zones(zones, "parent_id", "level", "doc_id")
    return (
        cur.withColumn("id", _key(F.col("zone_id"))).where("id is not null")
        .groupBy("id")
        .agg(F.min_by(F.struct("zone_id", "parent_id", "level", "doc_id"), "zone_id").alias("r"))
        .select("id", F.col("r.zone_id").alias("zone_id"), _key(F.col("r.parent_id")).alias("parent"), F.col("r.level").alias("level"), F.col("r.doc_id").alias("doc_id"))
    )


def zone_hierarchy(zones: DataFrame, **kw) -> DataFrame:
    """zones -> (zone_id, level, root_id, depth, ring[, path]): root_id is a stored zone_id, path holds keys."""
    nodes = staged(zone_nodes(zones), "zone-nodes")
    h = hierarchy(nodes.select("id", "parent", "doc_id"), "doc_id", **kw)
    names = nodes.select(F.col("id").alias("root"), F.col("zone_id").alias("root_id"))
    return nodes.select("id", "zone_id", "level").join(h, "id").join(names, "root").drop("id", "root")


def level_errors(zones: DataFrame, **kw) -> DataFrame:
    """Zones whose level is null or not the true depth, and zones on or below a circle (depth -1)."""
    h = zone_hierarchy(zones, **kw)
    return h.where("depth = -1 or level is null or level <> depth").select("zone_id", "root_id", "depth")


def zone_paths(zones: DataFrame, **kw) -> DataFrame:
    """(zone_id, root_id, depth, path): the keys from the root down to the zone; null on or below a circle."""
    return zone_hierarchy(zones, with_path=True, **kw).select("zone_id", "root_id", "depth", "path")


def zone_descendants(zones: DataFrame, **kw) -> DataFrame:
    """(zone_id, descendant_id, distance): every pair of a zone and one below it, as keys in one spelling."""
    p = zone_paths(zones, **kw).where("depth > 0")
    pairs = p.select(F.col("zone_id").alias("descendant_id"), "depth", F.posexplode("path").alias("pos", "zone_id"))
    return pairs.where("pos < depth").select("zone_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))
