"""Parent-child links to full hierarchies by tree contraction.

Rounds alternate raking (remove every leaf) and compression (splice out an independent set of nodes with one child, chosen
by a coin per round so that no two neighbours go at once). Each removal is recorded as (node, surviving ancestor, distance);
undoing the records from the last round to the first gives root, depth and path of every node. The live set shrinks
geometrically whatever the depth, so a chain of a million links takes about as many rounds as a bush. What can't be contracted
is a self-loop: a cycle, whose smallest id travelled along the spliced edges.

A round is one shuffle with partial aggregation on the node key: a parent of a third of all nodes gets one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.session import cut

MAX_ROUNDS = 400


def _coin(x: Column, rnd: int) -> Column:
    return F.xxhash64(x, F.lit(rnd)).bitwiseAND(F.lit(1)) == 1


def contract(nodes: DataFrame, node_id: str = "id", parent_id: str = "parent_id", label: str | None = None) -> DataFrame:
    """(node_id, root_id, depth[, path, path_ids]) for every distinct node id of ``nodes``.

    * The chain of parents ends at a node whose parent is null or has no row: the root, of depth 0.
    * A node on a cycle, or whose chain leads into one: depth -1, root_id the smallest id on the cycle, path null.
    * Repeated node ids: the largest parent counts (nulls last); rows with a null id are dropped; an empty table gives no rows.
    * With ``label``, path holds the labels and path_ids the ids from the root to the node; a null label shows as its id.
    """
    n = nodes.select(F.col(node_id).alias("id"), F.col(parent_id).alias("parent"), *([F.coalesce(F.col(label), F.col(node_id)).alias("label")] if label else [])).where("id is not null")
    n = n.groupBy("id").agg(F.max("parent").alias("parent"), *([F.max("label").alias("label")] if label else []))
    known = n.select(F.col("id").alias("_known"))
    n = cut(n.join(known, F.col("parent") == F.col("_known"), "left").withColumn("parent", F.col("_known")).drop("_known"))
    step = "struct<id:string,label:string>"
    none = F.array().cast(f"array<{step}>") if label else None
    keep = ["label", "seg"] if label else []
    live = n.where("parent is not null").withColumn("w", F.lit(1)).withColumn("lo", F.lit(None).cast("string"))
    if label:
        live = live.withColumn("seg", none)
    over = None
    records: list[DataFrame] = []
    loops: DataFrame | None = None
    nulls = {"id": "string", "parent": "string", "w": "int", "lo": "string", "label": "string", "seg": f"array<{step}>", "p2": "string", "w2": "int", "lo2": "string", "seg2": f"array<{step}>", "n": "bigint", "child": "string"}
    cols = ["id", "parent", "w", "lo", *keep, "p2", "w2", "lo2", *(["seg2"] if label else []), "n", "child"]
    shape = lambda df, **x: df.select(*[x.get(c, F.lit(None).cast(nulls[c])).alias(c) for c in cols])
    col = F.col
    for rnd in range(MAX_ROUNDS):
        rows = shape(live, id=col("id"), parent=col("parent"), w=col("w"), lo=col("lo"), **{k: col(k) for k in keep})
        rows = rows.unionByName(shape(live, id=col("parent"), n=F.lit(1).cast("bigint"), child=col("id")))
        if over is not None:
            rows = rows.unionByName(shape(over, id=col("child"), p2=col("parent"), w2=col("w"), lo2=col("lo"), **({"seg2": col("seg")} if label else {})))
            rows = rows.unionByName(shape(over, id=col("parent"), n=F.lit(1).cast("bigint"), child=col("child")))
        g = rows.groupBy("id").agg(*[F.max(c).alias(c) for c in cols if c not in ("id", "n", "child")], F.sum("n").alias("n"), F.min("child").alias("child")).where("parent is not null")
        g = g.select(
            "id", F.coalesce("p2", "parent").alias("parent"), (col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.least("lo", "lo2").alias("lo"),
            *(["label", F.concat(F.coalesce("seg2", none), "seg").alias("seg")] if label else []), F.coalesce("n", F.lit(0)).alias("n"), "child",
        )
        loop = col("id") == col("parent")
        if rnd % 2 == 0:
            gone = col("n") == 0
        else:
            gone = (col("n") == 1) & ~loop & (col("child") != col("id")) & _coin(col("id"), rnd) & ~_coin(col("child"), rnd)
        g = cut(g.withColumn("gone", gone))
        live = g.where("not gone")
        records.append(g.where("gone").select("id", "parent", "w", *keep))
        over = None
        if rnd % 2:
            over = g.where("gone").select("child", "parent", "w", F.least("lo", "id").alias("lo"), *([F.concat("seg", F.array(F.struct("id", "label"))).alias("seg")] if label else []))
        loops = live.where(loop)
        if not live.where(~loop).limit(1).count():
            break
    else:
        raise RuntimeError(f"not contracted in {MAX_ROUNDS} rounds")

    extra = ["rel"] if label else []
    done = loops.select("id", F.least("id", "lo").alias("root_id"), F.lit(-1).alias("depth"), *([F.lit(None).cast(f"array<{step}>").alias("rel")] if label else []))
    for k, r in enumerate(reversed(records)):
        up = done.select(col("id").alias("_up"), col("root_id").alias("_root"), col("depth").alias("_depth"), *[col(c).alias(f"_{c}") for c in extra])
        hit = col("_up").isNotNull()
        tail = F.concat("seg", F.array(F.struct("id", "label"))) if label else None
        back = r.join(up, col("parent") == col("_up"), "left").select(
            "id", F.coalesce("_root", "parent").alias("root_id"), F.when(~hit, col("w")).when(col("_depth") < 0, F.lit(-1)).otherwise(col("_depth") + col("w")).alias("depth"),
            *([F.when(~hit, tail).otherwise(F.concat("_rel", tail)).alias("rel")] if label else []),
        )
        done = done.unionByName(back)
        if k + 1 < len(records):
            done = cut(done)
    roots = n.where("parent is null").select("id", col("id").alias("root_id"), F.lit(0).alias("depth"), *([none.alias("rel")] if label else []))
    out = roots.unionByName(done)
    if not label:
        return out.withColumnRenamed("id", node_id)
    names = n.select(col("id").alias("_root"), col("label").alias("_top"))
    out = out.join(names, col("root_id") == col("_root"), "left")
    top = F.when(col("depth") == 0, F.array(F.struct(col("id"), col("_top").alias("label")))).when(col("depth") > 0, F.concat(F.array(F.struct(col("root_id").alias("id"), col("_top").alias("label"))), "rel"))
    out = out.withColumn("_p", top)
    return out.select(col("id").alias(node_id), "root_id", "depth", F.col("_p.label").alias("path"), F.col("_p.id").alias("path_ids"))


def descendants(paths: DataFrame, node_id: str = "id") -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every pair in a tree, from ``contract(label=...)``; nodes of cycles have none."""
    e = paths.where("depth > 0").select(F.col(node_id).alias("descendant_id"), "depth", F.posexplode("path_ids").alias("pos", "ancestor_id"))
    return e.where("pos < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))
