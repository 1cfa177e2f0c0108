"""Measures of verdicts against labels, threshold scans and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.operators.ranks import ranked
from veriscope.plans.shared import Workspace


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """``keys, tp, fp, fn, tn``; rows with a null truth or prediction count for nothing."""
    t, s = truth.cast("int"), said.cast("int")
    return df.groupBy(*keys).agg(_n((t == 1) & (s == 1)).alias("tp"), _n((t == 0) & (s == 1)).alias("fp"), _n((t == 1) & (s == 0)).alias("fn"), _n((t == 0) & (s == 0)).alias("tn"))


def measures(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Adds precision, recall, f1, macro_f1, accuracy, balanced accuracy and the recall of the negative class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r, tnr = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fn + fp)
    cols = {"precision": p, "recall": r, "f1": f1, "macro_f1": (f1 + f0) / 2, "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "balanced": (r + tnr) / 2, "tnr": tnr}
    return counts.withColumns({k: F.round(v, digits) for k, v in cols.items()})


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """``keys, auc`` by mean ranks, from counts by distinct score; a row with a null ``auc`` for a table without scores of both classes."""
    per = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("int")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    ranks = ranked(per, keys, [score], sums=("_n",)).withColumn("_rank", F.col("_sum__n") - F.col("_n") + (F.col("_n") + 1) / 2)
    out = ranks.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_p")).alias("_r"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    return out.select(*keys, F.when((F.col("_p") > 0) & (neg > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg)).alias("auc"))


def cohens_d(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    pos, neg = F.when(F.col(label) == 1, F.col(score)), F.when(F.col(label) == 0, F.col(score))
    pooled = F.sqrt((F.var_pop(pos) + F.var_pop(neg)) / 2)
    return df.groupBy(*keys).agg(F.when(pooled > 0, (F.avg(pos) - F.avg(neg)) / pooled).otherwise(0.0).alias("d"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement, kappa`` of two label columns."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col("x").alias("v")).agg(F.sum("c").alias("r"))
    cols = cells.groupBy(F.col("y").alias("v")).agg(F.sum("c").alias("s"))
    chance = rows.join(cols, "v").agg(F.sum(F.col("r") * F.col("s")).alias("e"))
    out = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def grid(lo: float, hi: float, n: int) -> Column:
    """Array of ``n`` evenly spaced thresholds."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(lo + i * (hi - lo) / max(1, n - 1), 6))


def scan(df: DataFrame, keys: list[str], score: str, label: str, thresholds: Column) -> DataFrame:
    """Confusion counts at each threshold.

    Scores are counted once by the number of thresholds at or below them; the counts of a threshold are running sums
    over that histogram, so the rows are never multiplied by the grid.
    """
    level = F.size(F.filter(F.col("_g"), lambda t: t <= F.col(score)))
    # first by distinct score: the score is computed once and the grid meets far fewer rows
    by_score = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(_n(F.col(label) == 1).alias("_p"), _n(F.col(label) == 0).alias("_q"))
    counted = by_score.withColumn("_g", thresholds).groupBy(*keys, level.alias("_l")).agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    spread = counted.groupBy(*keys).agg(F.collect_list(F.struct("_l", "_p", "_q")).alias("_h")).withColumn("_g", thresholds)
    spread = spread.select(*keys, "_h", F.posexplode("_g").alias("_i", "threshold"))

    def total(name: str, over: bool) -> Column:
        return F.aggregate(F.filter("_h", lambda x: (x["_l"] > F.col("_i")) if over else (x["_l"] <= F.col("_i"))), F.lit(0).cast("bigint"), lambda s, x: s + x[name])

    return spread.select(*keys, "threshold", total("_p", True).alias("tp"), total("_q", True).alias("fp"), total("_p", False).alias("fn"), total("_q", False).alias("tn"))


def best_threshold(scanned: DataFrame, keys: list[str], by: str = "macro_f1") -> DataFrame:
    """The threshold with the best measure, the lowest one on ties."""
    m = measures(scanned)
    return m.groupBy(*keys).agg(F.min_by("threshold", F.struct(-F.col(by), F.col("threshold"))).alias("threshold"), F.max(by).alias(by))


def leave_one_out(df: DataFrame, group: str, score: str, label: str, thresholds: Column) -> DataFrame:
    """``group, threshold`` tuned on all other groups: total counts less the group's own."""
    per = scan(df, [group], score, label, thresholds)
    total = per.groupBy("threshold").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn", "tn")])
    others = per.join(F.broadcast(total), "threshold").select(group, "threshold", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return best_threshold(others, [group])


def adaptive_gap(df: DataFrame, key: str, score: str, order: str, bottom_half: bool = True, least: int = 4) -> DataFrame:
    """``key, threshold, gap``: the middle of the widest gap between neighbouring scores, the last one on ties.

    With ``bottom_half`` only the lower half of the gaps counts. Keys with fewer than ``least`` scores have none.
    """
    gaps = ranked(df.select(key, score, order), [key], [score, order], ahead=score).withColumnsRenamed({"_rows": "_n", "_place": "_i"}).filter(F.col("_next").isNotNull() & (F.col("_n") >= least))
    if bottom_half:
        gaps = gaps.filter(F.col("_i") <= F.greatest(F.lit(2), F.floor((F.col("_n") + 1) / 2)))
    gaps = gaps.withColumn("gap", F.round(F.col("_next") - F.col(score), 9))
    return gaps.groupBy(key).agg(F.max_by((F.col(score) + F.col("_next")) / 2, F.struct("gap", "_i")).alias("threshold"), F.max("gap").alias("gap"))


def jenks(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """``key, threshold`` of the two-class cut."""
    return jenks_cut(df, key, score, order).select(key, "threshold")


def jenks_cut(df: DataFrame, key: str, score: str, order: str, least: int = 2) -> DataFrame:
    """``key, threshold, gap``: the cut into two classes with the least squared deviation (the first one on ties)."""
    s = F.col(score)
    rows = df.select(key, score, order).withColumns({"_x": s, "_xx": s * s})
    names = {"_place": "_i", "_rows": "_n", "_sum__x": "_s", "_sum__xx": "_q", "_all__x": "_sum", "_all__xx": "_sq"}
    t = ranked(rows, [key], [score, order], sums=("_x", "_xx"), ahead=score).withColumnsRenamed(names).filter(F.col("_next").isNotNull() & (F.col("_n") >= least))
    left = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_i")
    rest, m = F.col("_sum") - F.col("_s"), F.col("_n") - F.col("_i")
    sse = F.round(left + (F.col("_sq") - F.col("_q")) - rest * rest / m, 9)
    return t.groupBy(key).agg(F.min_by((s + F.col("_next")) / 2, F.struct(sse, F.col("_i"))).alias("threshold"), F.min_by(F.round(F.col("_next") - s, 9), F.struct(sse, F.col("_i"))).alias("gap"))


def resample_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: the share that makes both classes count alike."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = n.agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_k"))
    table = n.crossJoin(total).select(label, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("weight"))  # one row a class
    return df.join(F.broadcast(table), label)


def band_sweep(df: DataFrame, score: str, label: str, below: Column, inside: Column, above: Column, lows: list[float], highs: list[float]) -> DataFrame:
    """``lo, hi, tp, fp, fn, tn, share`` for each band: ``below`` up to ``lo``, ``above`` from ``hi`` on, ``inside`` between.

    ``share`` is that of the records inside. Records are counted once by where they lie among all bounds, so the bands
    meet a histogram of a few hundred rows, not the records.
    """
    bounds = sorted({*lows, *highs})
    edges = F.array(*map(F.lit, bounds))
    s = F.col(score)
    # even: between two bounds, odd: on one
    place = 2 * F.size(F.filter(edges, lambda e: e < s)) + F.array_contains(edges, s).cast("int")
    rows = df.filter(F.col(label).isNotNull() & s.isNotNull()).select(place.alias("at"), F.col(label).cast("int").alias("y"), *(c.cast("int").alias(n) for n, c in (("b", below), ("i", inside), ("a", above))))
    counted = rows.groupBy("at", "y", "b", "i", "a").agg(F.count(F.lit(1)).alias("n"))
    spot = {x: 2 * k + 1 for k, x in enumerate(bounds)}
    cells = df.sparkSession.createDataFrame([(x, y, spot[x], spot[y]) for x in sorted(set(lows)) for y in sorted(set(highs)) if x < y], "lo double, hi double, l int, h int")
    met = counted.crossJoin(F.broadcast(cells))  # hundreds of rows by hundreds
    within = (F.col("at") > F.col("l")) & (F.col("at") < F.col("h"))
    said = F.when(F.col("at") <= F.col("l"), F.col("b")).when(within, F.col("i")).otherwise(F.col("a"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    y = F.col("y")
    return met.groupBy("lo", "hi").agg(count((y == 1) & (said == 1)).alias("tp"), count((y == 0) & (said == 1)).alias("fp"), count((y == 1) & (said == 0)).alias("fn"), count((y == 0) & (said == 0)).alias("tn"), (count(within) / F.sum("n")).alias("share"))


def scoped_thresholds(df: DataFrame, score: str, label: str, fold: str, parts: dict[str, str], thresholds: Column, least: int = 30) -> DataFrame:
    """``scheme, tp, fp, fn, tn`` with thresholds tuned on the other folds only.

    ``parts``: by scheme the column whose values have thresholds of their own. A value with fewer than ``least`` records
    in the other folds, or with one class only, takes the threshold tuned on all of them.
    """
    four = ("tp", "fp", "fn", "tn")
    per = scan(df, [fold, *dict.fromkeys(parts.values())], score, label, thresholds)
    own = reduce(DataFrame.unionByName, [per.select(F.lit(s).alias("scheme"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("part"), fold, "threshold", *four) for s, c in parts.items()] + [per.select(F.lit("global").alias("scheme"), F.lit("all").alias("part"), fold, "threshold", *four)])
    own = Workspace(df.sparkSession, "scopes").save(own.groupBy("scheme", "part", fold, "threshold").agg(*(F.sum(c).alias(c) for c in four)), "counts")
    total = own.groupBy("scheme", "part", "threshold").agg(*(F.sum(c).alias(f"all_{c}") for c in four))
    folds = own.select(F.col(fold).alias("held")).distinct()
    rest = total.crossJoin(folds)  # a few thresholds by a few folds
    mine = own.select("scheme", "part", F.col(fold).alias("held"), "threshold", *four)
    others = rest.join(mine, ["scheme", "part", "held", "threshold"], "left").select("scheme", "part", "held", "threshold", *((F.col(f"all_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in four))
    enough = (F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")) / F.count(F.lit(1)) >= least) & (F.max(F.col("tp") + F.col("fn")) > 0) & (F.max(F.col("fp") + F.col("tn")) > 0)
    tuned = best_threshold(others, ["scheme", "part", "held"]).select("scheme", "part", "held", F.col("threshold").alias("t"))
    tuned = tuned.join(others.groupBy("scheme", "part", "held").agg(enough.alias("enough")), ["scheme", "part", "held"])
    overall = tuned.filter("scheme = 'global'").select("held", F.col("t").alias("all_t"))
    chosen = mine.join(tuned, ["scheme", "part", "held"]).join(overall, "held").filter(F.col("threshold") == F.when(F.col("enough"), F.col("t")).otherwise(F.col("all_t")))
    return chosen.groupBy("scheme").agg(*(F.sum(c).alias(c) for c in four))


def composite(parts: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """Quality, the weighted sum of the parts, and the score that is 0 for the best (100 less the quality in per cent)."""
    quality = reduce(lambda a, b: a + b, (weights[k] * v for k, v in parts.items()))
    return F.round(quality, 4), F.round(100 * (1 - quality), 1)


def batch_thresholds(df: DataFrame, batch: str, score: str, order: str, label: str, fixed: float, floor: float, least: int = 4) -> DataFrame:
    """``batch, strategy, threshold`` of the five strategies fixed, tuned, gap, gap_bottom and jenks.

    A gap below ``floor`` says nothing and leaves the fixed threshold, as does a batch of fewer than ``least`` scores,
    which has no gap. ``tuned`` takes the best macro-F1 of 181 thresholds.
    """
    all_ = df.select(batch).distinct()
    tuned = best_threshold(scan(df, [batch], score, label, grid(0.05, 0.95, 181)), [batch]).select(batch, F.lit("tuned").alias("strategy"), "threshold", F.lit(1.0).alias("gap"))
    gap = adaptive_gap(df, batch, score, order, bottom_half=False, least=least).select(batch, F.lit("gap").alias("strategy"), "threshold", "gap")
    bottom = adaptive_gap(df, batch, score, order, least=least).select(batch, F.lit("gap_bottom").alias("strategy"), "threshold", "gap")
    cut = jenks_cut(df, batch, score, order, least).select(batch, F.lit("jenks").alias("strategy"), "threshold", "gap")
    flat = all_.select(batch, F.lit("fixed").alias("strategy"), F.lit(fixed).alias("threshold"), F.lit(1.0).alias("gap"))
    every = reduce(DataFrame.unionByName, [flat, tuned, gap, bottom, cut])
    return every.select(batch, "strategy", F.when(F.col("gap") < floor, fixed).otherwise(F.col("threshold")).alias("threshold"))
