"""Building labelled sets: first rows by key, lineage ids, agreement of judges, balanced slices, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.functions import text as T
from veriscope.operators.ranks import ranked


RESAMPLING = ("oversample_minority", "undersample_majority", "oversample_foreign", "oversample_foreign_negatives")


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def first_n(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    """Adds ``fold``: rows of a class dealt to ``k`` folds in turn."""
    return ranked(df, keys, order).withColumn("fold", (F.col("_place") - 1) % k).drop("_place", "_rows")


def halves(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Adds ``half``, 1 or 2: each class in two, the first one larger where they cannot be equal."""
    return ranked(df, keys, order).withColumn("half", F.when(F.col("_place") * 2 <= F.col("_rows") + 1, 1).otherwise(2)).drop("_place", "_rows")


def resampled(df: DataFrame, key: str, label: str, foreign: Column, modes: tuple[str, ...] = RESAMPLING) -> DataFrame:
    """``mode`` and ``copies`` of each row, without rows that a mode leaves out.

    ``oversample_minority`` and ``undersample_majority`` bring both classes to the larger and the smaller count,
    ``oversample_foreign`` the rows with ``foreign`` to the number of the others, and ``oversample_foreign_negatives``
    takes foreign rows of class 0 five times. Where copies must be uneven, rows come in the order of a digest of their key,
    so the same rows are taken every time. Rows with a null label are left out.
    """
    rows = df.filter(F.col(label).isNotNull()).withColumns({"_foreign": F.coalesce(foreign, F.lit(False)), "_d": F.md5(F.col(key).cast("string"))})
    one = ranked(rows, [label], ["_d", key]).withColumnsRenamed({"_place": "_pl", "_rows": "_nl"})
    both = ranked(one, ["_foreign"], ["_d", key]).withColumnsRenamed({"_place": "_pf", "_rows": "_nf"})
    sizes = rows.groupBy(label, "_foreign").agg(F.count(F.lit(1)).alias("c"))
    most, least = sizes.groupBy(label).agg(F.sum("c").alias("c")).agg(F.max("c"), F.min("c")).first()
    home = sizes.filter("not _foreign").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    def up_to(target: int | None, place: str, n: str) -> Column:
        t = F.lit(target or 0)
        return F.floor(t / F.col(n)) + (F.col(place) <= t % F.col(n)).cast("int")

    counts = {
        "oversample_minority": up_to(most, "_pl", "_nl"),
        "undersample_majority": up_to(least, "_pl", "_nl"),
        "oversample_foreign": F.when(F.col("_foreign"), up_to(home, "_pf", "_nf")).otherwise(1),
        "oversample_foreign_negatives": F.when(F.col("_foreign") & (F.col(label) == 0), 5).otherwise(1),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), counts[m].cast("bigint").alias("copies")) for m in modes]))
    return both.withColumn("_m", each).select(*df.columns, "_m.mode", "_m.copies").filter("copies > 0")


def build(records: DataFrame, prefix: str = "eval") -> DataFrame:
    """Deduplicated records with lineage: the first of each claim and evidence, its group hash and a running id."""
    claim, source = T.normalize_whitespace("claim"), F.coalesce(F.col("source_text"), F.lit(""))
    kept = first_by(records.withColumn("_k", F.md5(F.concat(claim, F.lit("\x1f"), source))), ["_k"], ["row_id"]).drop("_k")
    return kept.select("row_id", F.concat(F.lit(prefix + "_"), F.lpad(F.col("row_id").cast("string"), 9, "0")).alias("uid"), F.lit(prefix).alias("role"), T.lang_base("lang").alias("lang_norm"), T.group_hash(source).alias("group_hash"), F.col("label"))


def agreeing(judgments: DataFrame, keys: list[str], judge: str, verdict: Column, a: str, b: str) -> DataFrame:
    """Items that two judges gave the same verdict."""
    said = judgments.select(*keys, F.col(judge).alias("_j"), verdict.alias("verdict")).filter("verdict is not null")
    x, y = (said.filter(F.col("_j") == j).drop("_j").distinct() for j in (a, b))
    return x.join(y.withColumnRenamed("verdict", "_v"), keys).filter("verdict = _v").drop("_v")


def replicate(df: DataFrame, label: str, factors: dict[int, int]) -> DataFrame:
    """Each row as many times as its class's factor, with ``copy`` from 1."""
    n = F.lit(1)
    for k, v in factors.items():
        n = F.when(F.col(label) == k, v).otherwise(n)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def shortest_overlap(records: DataFrame, key: str, claim: str, source: str, most: bool = True) -> DataFrame:
    """``key, sentence, shared``: one sentence of each record's evidence, with most (or least) words of the claim."""
    parts = records.select(key, T.token_set(claim).alias("_c"), F.posexplode(T.sentences(source)).alias("_i", "sentence"))
    scored = parts.withColumn("shared", F.size(F.array_intersect("_c", T.token_set("sentence"))))
    order = F.struct(-F.col("shared") if most else F.col("shared"), F.col("_i"))
    return scored.groupBy(key).agg(F.min_by("sentence", order).alias("sentence"), F.min_by("shared", order).alias("shared"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in the output of an earlier run."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
