"""p3: train, validation and test splits that keep related records together.

Records that share a key (evidence group, evidence text, trace, parent) are one unit, directly or through others. The
graph is one of keys: each record links its keys to its first one, and these links are few once repeats are gone, also
where one key holds a third of the rows. Units are its components, found by Borůvka's contraction: every component
picks its lightest edge (weights are distinct), the edges picked are appended to a persisted spanning forest,
components are merged along them by pointer doubling, and the graph shrinks until no edge is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.plans.shared import Workspace

#: Values that stand for "no value" in key columns (fixed values of the data).
PLACEHOLDERS = ("", "-", "--", "?", "??", "n/a", "na", "none", "null", "nan", "unknown", "und", "undefined", "tbd")


#: Edges of a node from which on it is dealt with in so many tasks.
HUB, SALTS = 2_000_000, 32


def usable(c: Column | str) -> Column:
    """The key, or null where it is missing or a placeholder."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), c)


def _record_keys(gold: DataFrame) -> DataFrame:
    bare = F.regexp_replace("source_text", r"[\s\p{Z}\u001c-\u001f\u0085]+", "")
    tag = lambda name, c: F.when(c.isNotNull(), F.xxhash64(F.lit(name), c))
    own = usable("group_id")
    return gold.select(
        "row_id",
        own.alias("group_id"),
        F.col("group_id").alias("stated"),
        tag("uid", usable("uid")).alias("u"),
        tag("uid", usable("parent_sid")).alias("p"),
        tag("group", own).alias("g"),
        # whether there is text at all is told from its first character, so the text is gone through once
        F.when(F.col("source_text").rlike(r"[^\s\p{Z}]"), F.xxhash64(F.lit("text"), F.md5(bare))).alias("s"),
        tag("trace", usable("trace_id")).alias("t"),
    ).withColumn("node", F.coalesce("g", "s", "t", "u", F.xxhash64(F.lit("row"), "row_id")))


def _edges(keys: DataFrame) -> DataFrame:
    """Distinct links ``a < b`` between keys."""
    within = keys.select("node", F.explode(F.array("g", "s", "t")).alias("other")).filter("other is not null and node <> other").distinct()
    child = keys.filter("p is not null").select("p", F.col("node").alias("a")).distinct()
    parent = keys.filter("u is not null").select(F.col("u").alias("p"), F.col("node").alias("b"))
    across = child.join(parent, "p").select("a", "b")
    both = within.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(across).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spanning_forest(edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``(labels, forest)``: ``node, root`` of every node with an edge; ``a, b, round`` of the edges of the forest.

    Weights are hashes of the edge with the edge itself as tie-break, so they are distinct and a component's choice can
    close only cycles of two, which the smaller root breaks. Each round at least halves the components that have an
    edge. All tables are written to the shared folder; nothing is collected but counts.
    """
    spark = edges.sparkSession
    live = work.save(edges.select("a", "b", F.col("a").alias("ea"), F.col("b").alias("eb")), "edges")
    labels = work.save(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "labels")
    forests: list[DataFrame] = []
    rounds = 0
    while not live.isEmpty():
        weight = F.struct(F.xxhash64("ea", "eb"), "ea", "eb")
        ends = live.select("a", "b", weight.alias("w")).union(live.select(F.col("b").alias("a"), F.col("a").alias("b"), weight.alias("w")))
        pick = ends.groupBy("a").agg(F.min_by(F.struct("b", "w"), "w").alias("x"), F.count(F.lit(1)).alias("degree")).select("a", "degree", F.col("x.b").alias("to"), F.col("x.w.ea").alias("ea"), F.col("x.w.eb").alias("eb"))
        pick = work.save(pick, "pick")
        forests.append(work.save(pick.select("ea", "eb").distinct().select(F.col("ea").alias("a"), F.col("eb").alias("b"), F.lit(rounds).alias("round")), "forest"))
        # hook: of two that picked each other, the smaller becomes a root
        back = pick.select(F.col("a").alias("to"), F.col("to").alias("back"))
        hook = pick.join(back, "to", "left").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to"))
        hook = work.save(hook, "hook")
        while True:
            nxt = hook.select(F.col("a").alias("to"), F.col("to").alias("far"))
            jumped = work.save(hook.join(nxt, "to").select("a", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "jump")
            done = jumped.filter("moved").isEmpty()
            work.drop(hook)
            hook = jumped.select("a", "to")
            hook._veriscope_path = jumped._veriscope_path
            if done:
                break
        root = hook.select(F.col("a").alias("root"), F.col("to").alias("top"))
        new_labels = work.save(labels.join(root, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        # of degree HUB or more there are at most two nodes for HUB edges, a bounded few
        hubs = pick.filter(F.col("degree") >= HUB).select("a")
        hubs = None if hubs.isEmpty() else hubs
        merged = _with_top(_with_top(live, "a", hook, hubs), "b", hook, hubs).filter("na <> nb")
        lo, hi = F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")
        w = F.struct(F.xxhash64("ea", "eb"), "ea", "eb")
        shrunk = merged.select(lo, hi, w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", F.col("w.ea").alias("ea"), F.col("w.eb").alias("eb"))
        new_live = work.save(shrunk, "edges")
        for old in (live, labels, pick, hook):
            work.drop(old)
        live, labels = new_live, new_labels
        rounds += 1
    empty = spark.createDataFrame([], "a bigint, b bigint, round int")
    return labels, reduce(DataFrame.unionByName, forests, empty)


def forest(gold: DataFrame, spark: SparkSession) -> DataFrame:
    """``a, b, round``: the persisted spanning forest over the keys of the records, one row an edge."""
    return spanning_forest(_edges(_record_keys(gold)), Workspace(spark, "forest"))[1]


def _with_top(live: DataFrame, end: str, tops: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``live`` with ``n<end>``, the component of its end. The edges of a hub meet its component in ``SALTS`` tasks."""
    tops = tops.select(F.col("a").alias(end), F.col("to").alias(f"n{end}"))
    if hubs is None:
        return live.join(tops, end)
    hub = F.broadcast(hubs.select(F.col("a").alias(end), F.lit(True).alias("hub")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("ea", "eb"), F.lit(SALTS))).otherwise(0).cast("int")
    left = live.join(hub, end, "left").withColumn("salt", salt).drop("hub")
    salts = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = tops.join(hub, end, "left").withColumn("salt", F.explode(salts)).drop("hub")
    return left.join(right, [end, "salt"]).drop("salt")


def units(gold: DataFrame, work: Workspace) -> DataFrame:
    """``row_id, group_id, stated, unit`` of every record; ``unit`` is the component's root key."""
    keys = work.save(_record_keys(gold), "keys")
    labels, _ = spanning_forest(_edges(keys), work)
    out = keys.join(labels.select("node", "root"), "node", "left")
    return work.save(out.select("row_id", "group_id", "stated", F.coalesce("root", "node").alias("unit")), "units")


def misplaced(gold: DataFrame, spark: SparkSession) -> DataFrame:
    """``row_id, unit_id``: records whose own ``group_id`` is missing or not the smallest one of their unit."""
    work = Workspace(spark, "splits")
    u = units(gold, work)
    ids = u.groupBy("unit").agg(F.min("group_id").alias("unit_id")).filter("unit_id is not null")
    return u.join(ids, "unit").filter("stated is null or stated <> unit_id").select("row_id", "unit_id")


def assign_splits(gold: DataFrame, spark: SparkSession, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """``row_id, unit, unit_size, split`` with ``split`` one of train, validation, test.

    Roots are stratified by size band (powers of two) and dealt systematically inside each band, in an order given by a
    hash. From the largest band down, each band deals as much to validation and test as the rows so far ask for; a band
    whose few units are too coarse for that leaves the rest to smaller ones. Ranks come from counts of hash buckets, so
    no window holds more than one bucket; only the totals of the bands (at most 64 rows) reach the driver. An empty
    table gives no rows; null keys join nothing.
    """
    work = Workspace(spark, "splits")
    u = units(gold, work)
    sizes = u.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("h", F.xxhash64(F.lit("deal"), "unit")).withColumn("bucket", F.pmod("h", F.lit(4096)))
    sizes = work.save(sizes, "sizes")
    plan, seen, given_v, given_t = [], 0.0, 0.0, 0.0
    for r in sizes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows"), F.max("size").alias("top")).orderBy(F.desc("band")).collect():
        seen += r["rows"]
        mean = r["rows"] / r["n"]
        shares = []
        for want, given in ((val * seen, given_v), (test * seen, given_t)):
            count = int(max(0.0, want - given) / mean)  # whole units, never more than is wanted
            shares.append(min(count, r["n"] // 2))
        given_v += shares[0] * mean
        given_t += shares[1] * mean
        plan.append((r["band"], r["n"], shares[0], shares[1]))
    from pyspark.sql import Window as W

    bands = F.broadcast(spark.createDataFrame(plan or [(0, 1, 0, 0)], "band int, n bigint, nv bigint, nt bigint"))
    counts = sizes.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("band").orderBy("bucket")) - F.col("c")).select("band", "bucket", "before")
    rank = F.col("before") + F.row_number().over(W.partitionBy("band", "bucket").orderBy("h", "unit")) - 1
    dealt = sizes.join(before, ["band", "bucket"]).withColumn("rank", rank).join(bands, "band")
    # every n/(nv+nt)-th unit leaves training, and these go to validation and test in turn in proportion
    held = F.floor((F.col("rank") + 1) * (F.col("nv") + F.col("nt")) / F.col("n"))
    held0 = F.floor(F.col("rank") * (F.col("nv") + F.col("nt")) / F.col("n"))
    share = F.col("nv") / F.greatest(F.lit(1), F.col("nv") + F.col("nt"))
    split = F.when(held == held0, "train").when(F.floor(held * share + 0.5) > F.floor(held0 * share + 0.5), "validation").otherwise("test")
    dealt = dealt.select("unit", F.col("size").alias("unit_size"), split.alias("split"))
    return u.join(dealt, "unit").select("row_id", "unit", "unit_size", "split")
