"""Search and scoring over embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.plans.shared import Workspace


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_k(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, k: int, vector: str = "embedding", block: int = 512) -> DataFrame:
    """``query_id, base_id, score, rank``: the ``k`` nearest of all vectors by cosine; exact, ties to the smaller id.

    The stated queries are packed into blocks of vectors, the base is read once per block and scored against it as one
    matrix product, and each task passes on only its ``k`` best for a query, so what is shuffled is ``k`` rows per query
    and task. Null vectors are left out.
    """
    import numpy as np

    def nearest(q: dict, at: dict, s) -> tuple:  # noqa: ANN001
        best = np.lexsort((at["b"], -s))[:k]
        return at["b"][best], s[best]

    best = _product(queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")), base.select(F.col(base_id).alias("b"), F.col(vector).alias("w")), nearest, ("b bigint", "s double"), block)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("b").alias(base_id), F.col("s").alias("score"), "rank")


def _product(queries: DataFrame, base: DataFrame, score, out: tuple[str, ...], block: int = 512) -> DataFrame:  # noqa: ANN001
    """``q`` and the columns ``out``: what ``score`` gives for each query (``q, v``) and block of the base (``b, w``, ...).

    ``score`` gets the query's row, the base's columns as arrays and the cosines of the two, and returns an array for each
    column of ``out``.
    """
    import numpy as np
    import pyarrow as pa

    h = F.pmod(F.xxhash64("q"), F.lit(64))
    q = queries.withColumn("v", F.col("v").cast("array<float>")).filter("v is not null")
    blocks = q.withColumn("g", F.floor((F.row_number().over(Window.partitionBy(h).orderBy("q")) - 1) / max(1, block // 8)))
    packed = blocks.groupBy(h.alias("h"), "g").agg(F.collect_list(F.struct(*q.columns)).alias("qs")).select("qs")
    rows = base.withColumn("w", F.col("w").cast("array<float>")).filter("w is not null")
    names, kinds = zip(*(c.split() for c in out))
    types = [{"bigint": pa.int64(), "double": pa.float64()}[x] for x in kinds]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for qs, bs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([r["v"] for r in qs], np.float64)
                y = np.array([r["w"] for r in bs], np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
                s = np.round(x @ y.T, 9)
                at = {n: np.array([r[n] for r in bs]) for n in bs[0] if n != "w"}
                got = [score(r, at, s[i]) for i, r in enumerate(qs)]
                keys = [r["q"] for r, g in zip(qs, got) for _ in range(len(g[0]))]
                cols = [np.concatenate([np.asarray(g[j]) for g in got]) for j in range(len(out))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, t, from_pandas=True) for c, t in zip(cols, types))], ["q", *names])

    packs = rows.withColumn("p", F.spark_partition_id()).withColumn("i", F.floor(F.monotonically_increasing_id() % (1 << 33) / 4096)).groupBy("p", "i").agg(F.collect_list(F.struct(*rows.columns)).alias("bs")).select("bs")
    return packed.crossJoin(packs).mapInArrow(run, "q bigint, " + ", ".join(out))  # a stated query set in blocks


def all_pairs(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, vector: str = "embedding") -> DataFrame:
    """``query_id, base_id, score`` of every query with every other row of the base; nothing is shuffled after scoring."""
    import numpy as np

    def every(q: dict, at: dict, s) -> tuple:  # noqa: ANN001
        other = np.flatnonzero(at["b"] != q["q"])
        return at["b"][other], s[other]

    out = _product(queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")), base.select(F.col(base_id).alias("b"), F.col(vector).alias("w")), every, ("b bigint", "s double"))
    return out.select(F.col("q").alias(query_id), F.col("b").alias(base_id), F.col("s").alias("score"))


def positions(base: DataFrame, base_id: str, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``b, w, pos`` with the 0-based position of each vector in the order of its id, and one row ``n``; null vectors are left out.

    Ids are unique. Rows are sorted by ranges and saved, so that the positions stay what they are.
    """
    work = Workspace(base.sparkSession, "positions")
    rows = base.select(F.col(base_id).alias("b"), F.col(vector).cast("array<float>").alias("w")).filter("w is not null")
    rows = rows.repartitionByRange("b").sortWithinPartitions("b").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    rows = work.save(rows, "sorted")
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    return rows.join(F.broadcast(before), "_p").select("b", "w", (F.col("_before") + F.col("_i")).alias("pos")), sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def sampled_pairs(base: DataFrame, base_id: str, vector: str = "embedding", draws: int = 200) -> DataFrame:
    """``score`` of pairs drawn from all pairs of the base by a hash: draw ``d`` takes the positions that the digests of ``d:a`` and ``d:b`` give.

    At most as many draws as there are pairs; the second of two equal positions moves on by one.
    """
    rows, total = positions(base, base_id, vector)
    at = lambda x: F.conv(F.substring(F.md5(F.concat(F.col("d").cast("string"), F.lit(x))), 1, 8), 16, 10).cast("bigint") % F.col("n")
    pairs = base.sparkSession.range(draws).withColumnRenamed("id", "d").crossJoin(F.broadcast(total)).filter("n > 1 and d < n * (n - 1) / 2")  # one row
    pairs = pairs.withColumn("i", at(":a")).withColumn("j", at(":b")).withColumn("j", F.when(F.col("i") == F.col("j"), (F.col("j") + 1) % F.col("n")).otherwise(F.col("j"))).select("d", "i", "j")
    a, b = rows.select(F.col("pos").alias("i"), F.col("w").alias("v")), rows.select(F.col("pos").alias("j"), "w")
    mine = a.join(F.broadcast(pairs), "i")
    return b.join(F.broadcast(mine), "j").select(F.round(cosine(F.col("v"), F.col("w")), 9).alias("score"))


def summaries(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, vector: str = "embedding", temperature: float = 0.1, high: float = 0.5, edge: float = 0.3, schedule: tuple[int, ...] = (1, 1, 2, 4), ks: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """What ``distribution``, ``early_exit_max`` and ``running_max`` give over all other rows of the base in the order of their ids.

    ``query_id, top, top2_mean, soft_max, log_high, margin, best, scored`` and ``k1, ...`` (null where there are fewer
    rows). A task passes on one row for a query and block, never the pairs.
    """
    import numpy as np

    bounds = np.cumsum(schedule)

    def batch(p):  # noqa: ANN001, ANN202
        return np.where(p < bounds[-1], np.searchsorted(bounds, p, side="right"), len(bounds) + (p - bounds[-1]) // schedule[-1])

    def summary(q: dict, at: dict, s) -> tuple:  # noqa: ANN001
        order = np.argsort(at["pos"], kind="stable")
        order = order[at["b"][order] != q["q"]]
        v, p = s[order], at["pos"][order]
        if not len(v):
            return ([],) * (7 + len(ks))
        if q["pos"] is not None:
            p = p - (p > q["pos"])
        two = np.sort(v)[::-1][:2]
        over, b = np.flatnonzero(v >= edge), batch(p)
        first = b[over[0]] if len(over) else None
        reached = v[b == first].max() if len(over) else np.nan
        most = [v[p < k].max() if (p < k).any() else np.nan for k in ks]
        row = [len(v), two[0], two[1] if len(two) > 1 else np.nan, np.exp(v / temperature).sum(), (v >= high).sum(), np.nan if first is None else first, reached, *most]
        return tuple([x] for x in row)

    rows, _ = positions(base, base_id, vector)
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).join(rows.select(F.col("b").alias("q"), "pos"), "q", "left")
    names = [f"k{k}" for k in ks]
    parts = _product(q, rows, summary, ("n bigint", "top double", "second double", "e double", "high bigint", "first double", "reached double", *(f"{n} double" for n in names)))
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array("top", "second")))), False), 1, 2)
    got = parts.groupBy("q").agg(
        F.sum("n").alias("n"), top.alias("two"), F.sum("e").alias("e"), F.sum("high").alias("high"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("first", (-F.col("reached")).alias("less")))).alias("stop"), *(F.max(n).alias(n) for n in names),
    )
    first = F.col("stop.first").cast("bigint")
    end = F.lit(int(bounds[-1])) + (first - len(bounds) + 1) * schedule[-1]
    for i, e in reversed(list(enumerate(bounds))):
        end = F.when(first == i, int(e)).otherwise(end)
    most, second = F.col("two")[0], F.get("two", F.lit(1))
    return got.select(
        F.col("q").alias(query_id), most.alias("top"), F.when(second.isNull(), most).otherwise((most + second) / 2).alias("top2_mean"),
        (F.log("e") * temperature).alias("soft_max"), F.log1p("high").alias("log_high"), (most - F.coalesce(second, F.lit(0.0))).alias("margin"),
        F.coalesce(-F.col("stop.less"), most).alias("best"), F.coalesce(F.least(end, "n"), F.col("n")).alias("scored"), *names,
    )


def percentile_threshold(sample: DataFrame, score: str, share: float = 0.02, floor: float = 0.65) -> DataFrame:
    """One row ``threshold``: the upper ``share`` quantile of sampled pair scores, between the floor and 1."""
    return sample.agg(F.least(F.lit(1.0), F.greatest(F.lit(floor), F.percentile(score, F.lit(1 - share)))).alias("threshold"))


def early_exit_max(pairs: DataFrame, key: str, order: str, score: str, edge: float, schedule: tuple[int, ...] = (1, 1, 2, 4)) -> DataFrame:
    """``key, best, scored``: the maximum when batches of a schedule are scored until one reaches the edge.

    The last size of the schedule repeats. A batch is skipped once a batch before it reached the edge.
    """
    bounds = [sum(schedule[: i + 1]) for i in range(len(schedule))]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    batch = F.lit(len(bounds)) + F.floor((F.col("_r") - bounds[-1] - 1) / schedule[-1])
    for i, b in reversed(list(enumerate(bounds))):
        batch = F.when(F.col("_r") <= b, i).otherwise(batch)
    ranked = pairs.withColumn("_r", rank).withColumn("_b", batch)
    before = F.max(score).over(Window.partitionBy(key).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("_m", before).filter(F.col("_m").isNull() | (F.col("_m") < edge)).groupBy(key).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("scored"))


def running_max(pairs: DataFrame, key: str, order: list, score: str, ks: tuple[int, ...]) -> DataFrame:
    """``key, k, best``: the maximum over the first ``k`` for several ``k`` in one pass."""
    w = Window.partitionBy(key).orderBy(*order)
    top = pairs.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    grid = F.array(*map(F.lit, ks))
    return top.withColumn("k", F.explode(F.filter(grid, lambda k: (k == F.col("_r")) | ((k > F.col("_n")) & (F.col("_r") == F.col("_n")))))).select(key, "k", F.col("_m").alias("best"))


def distribution(pairs: DataFrame, key: str, score: str, temperature: float = 0.1, high: float = 0.5) -> DataFrame:
    """``key, top, top2_mean, soft_max, log_high, margin`` of the scores of each key."""
    ranked = pairs.select(key, F.col(score).alias("_s")).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s"))))
    second = F.max(F.when(F.col("_r") == 2, F.col("_s")))
    top = F.max("_s")
    return ranked.groupBy(key).agg(
        top.alias("top"),
        F.avg(F.when(F.col("_r") <= 2, F.col("_s"))).alias("top2_mean"),
        (F.log(F.sum(F.exp(F.col("_s") / temperature))) * temperature).alias("soft_max"),
        F.log1p(F.sum((F.col("_s") >= high).cast("int"))).alias("log_high"),
        (top - F.coalesce(second, F.lit(0.0))).alias("margin"),
    )


def staged(pairs: DataFrame, gate: Column, band: Column, first, second) -> DataFrame:  # noqa: ANN001
    """Cheap stage first: rows outside the gate keep their cheap score, the others get ``first``; those in the band then ``second``.

    ``first`` and ``second`` are functions from a DataFrame to one with a column more; neither sees a row it need not.
    """
    kept, on = pairs.filter(~gate), first(pairs.filter(gate))
    done, again = on.filter(~band), second(on.filter(band))
    return kept.unionByName(done, allowMissingColumns=True).unionByName(again, allowMissingColumns=True)
