"""p1: consensus of several annotators by message passing on the bipartite graph of records and annotators.

For each class against the rest, an edge (a judgment) carries two messages. Record to annotator: the probability that
the record is of the class, told from the judgments of its *other* annotators. Annotator to record: the log-likelihood
ratio of this judgment, told from how the annotator did on its *other* records (hit rate and false-alarm rate, with a
weak prior). Both are iterated to convergence; the verdict is the class with the largest sum of messages. An annotator
who is right, guesses, always says the same or is wrong on purpose so gets a positive, no, no or a negative weight.

The judgments of a record are kept together in one row, so an iteration is a map over records and a sum per annotator
with map-side combination: an annotator with a third of all judgments costs no more than any other. The messages are
written to the shared folder at each iteration, which cuts the lineage. They have converged when no annotator's rate
moves any more; where that is not reached in ``MOST_ROUNDS``, a warning says so.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.plans.shared import Workspace

#: The verdicts, in order of their number.
CLASSES = ("SUPPORTED", "HALLUCINATION", "NOT_A_CLAIM")
LEAST_ANNOTATORS = 3
#: Up to so many annotators, their rates (12 numbers each) are sent to the tasks; beyond that they are joined.
SENT_ANNOTATORS = 50_000
TOLERANCE, MOST_ROUNDS = 2e-3, 40
#: Parts in which a joined annotator's judgments are dealt with, and hash buckets in which annotators are numbered.
SALTS, BUCKETS = 16, 1024


def verdict_number(label: Column) -> Column:
    """Number of the class that a label names, however spelled; null for undecided and unknown ones."""
    x = F.regexp_replace(F.upper(label), r"[^\p{L}\p{N}]+", "")
    return (
        F.when((x == "1") | x.rlike("^SUPP?ORT"), 0)
        .when((x == "0") | x.rlike("^HALL?UCINAT") | x.rlike("^REFUTE"), 1)
        .when(x.isin("NOTACLAIM", "NAC", "NOCLAIM"), 2)
        .cast("tinyint")
    )


def standing_judgments(judgments: DataFrame) -> DataFrame:
    """``uid, annotator_id, c``: of each annotator's usable judgments of a record the latest by ``judged_at``.

    Ties go to the larger ``judgment_id``; a null time counts as the earliest. Null keys and unusable labels are left out.
    """
    usable = judgments.select("uid", "annotator_id", verdict_number(F.col("label")).alias("c"), "judged_at", "judgment_id").filter("c is not null and uid is not null and annotator_id is not null")
    last = F.max_by("c", F.struct(F.coalesce("judged_at", F.lit("0001-01-01").cast("timestamp_ntz")), "judgment_id"))
    return usable.groupBy("uid", "annotator_id").agg(last.alias("c"))


def _messages(a: np.ndarray, c: np.ndarray, offsets: np.ndarray, m: np.ndarray, rates: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New record-to-annotator messages of each edge and the log-odds of each record, for the three classes.

    ``rates``: by edge and class the annotator's sums of p, p and hit, 1-p, 1-p and hit.
    """
    lengths = np.diff(offsets)
    item = np.repeat(np.arange(len(lengths)), lengths)
    new, total = np.empty_like(m), np.empty((len(lengths), 3))
    for k in range(3):
        hit, own = c == k, m[:, k]
        n1, h1, n0, h0 = (rates[:, k, i] for i in range(4))
        right = np.clip((h1 - own * hit + 1.0) / (n1 - own + 1.5), 1e-4, 1 - 1e-4)
        wrong = np.clip((h0 - (1 - own) * hit + 0.5) / (n0 - (1 - own) + 1.5), 1e-4, 1 - 1e-4)
        ratio = np.where(hit, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        total[:, k] = np.bincount(item, ratio, len(lengths)) + np.log(prior[k] / (1 - prior[k]))
        new[:, k] = 1 / (1 + np.exp(-np.clip(total[item, k] - ratio, -30, 30)))
    return new, total


def _kernel(table: np.ndarray | None, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_list = b.column("a")
            offsets = a_list.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            a, c = a_list.flatten().to_numpy(zero_copy_only=False), b.column("c").flatten().to_numpy(zero_copy_only=False)
            m = b.column("m").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(np.float64)
            rates = table[a] if table is not None else b.column("r").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 4)
            m, total = _messages(a, c, offsets, m, rates, prior) if len(a) else (m, np.zeros((b.num_rows, 3)))
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), a_list, b.column("c"), pa.ListArray.from_arrays(pa.array((offsets * 3).astype(np.int32)), pa.array(m.astype(np.float32).ravel())), pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * b.num_rows + 1, 3, dtype=np.int32)), pa.array(total.ravel()))],
                ["uid", "a", "c", "m", "total"],
            )

    return run


_STATE = "uid string, a array<int>, c array<tinyint>, m array<float>, total array<double>"


def _rates(state: DataFrame) -> DataFrame:
    """``a, r``: by annotator the sums that its rates are made of, 4 for each class."""
    edges = state.select(F.expr("inline(transform(sequence(0, size(a) - 1), i -> struct(a[i] as a, c[i] as c, m[3 * i] as m0, m[3 * i + 1] as m1, m[3 * i + 2] as m2)))"))
    sums = []
    for k in range(3):
        p, hit = F.col(f"m{k}").cast("double"), (F.col("c") == k).cast("double")
        sums += [F.sum(p), F.sum(p * hit), F.sum(1 - p), F.sum((1 - p) * hit)]
    return edges.groupBy("a").agg(F.array(*sums).alias("r"))


def pass_messages(standing: DataFrame, spark: SparkSession, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(state, rates, annotators)`` after convergence; ``state.total`` holds the log-odds of each record and class."""
    standing = work.save(standing, "standing")
    annotators = work.save(_numbered(standing.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_judgments")), work), "annotators")
    share = "transform(c, x -> cast({k} as tinyint) = x)"
    grouped = standing.join(annotators.select("annotator_id", "a"), "annotator_id").groupBy("uid").agg(F.collect_list(F.struct("a", "c")).alias("e"))
    state = grouped.select("uid", F.expr("array_sort(e)").alias("e")).select("uid", F.expr("e.a").alias("a"), F.expr("e.c").alias("c"))
    counts = ", ".join(f"cast(aggregate({share.format(k=k)}, 0, (s, y) -> s + cast(y as int)) / size(c) as float)" for k in range(3))
    state = state.withColumn("m", F.expr(f"flatten(transform(c, x -> array({counts})))")).withColumn("total", F.expr("cast(null as array<double>)"))
    state = work.save(state, "state")
    n = annotators.count()
    before = None
    for turn in range(MOST_ROUNDS):
        if n == 0:
            break
        rates = _rates(state)
        if n <= SENT_ANNOTATORS:
            table = np.zeros((n, 3, 4))
            for row in rates.collect():
                table[row["a"]] = np.array(row["r"]).reshape(3, 4)
            overall, fed, now = table.sum(0), state, table
        else:
            rates = now = work.save(rates, "rates")
            sums = rates.select([F.sum(F.col("r")[i]).alias(str(i)) for i in range(12)]).first()
            overall, table = np.array(list(sums)).reshape(3, 4), None
            # rates are sent along once for each salt, so that a hot annotator's judgments meet them in several tasks
            salted = rates.select(F.col("a").alias("x"), "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            edges = state.select("uid", "c", "m", F.posexplode("a").alias("i", "x"), F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt"))
            fed = edges.join(salted, ["x", "salt"]).groupBy("uid").agg(F.any_value("c").alias("c"), F.any_value("m").alias("m"), F.array_sort(F.collect_list(F.struct("i", "x", "r"))).alias("e"))
            fed = fed.select("uid", F.expr("e.x").alias("a"), "c", "m", F.expr("flatten(e.r)").alias("r"))
        prior = np.clip(overall[:, 0] / (overall[:, 0] + overall[:, 2]), 1e-3, 1 - 1e-3)
        columns = ["uid", "a", "c", "m"] + (["r"] if table is None else [])
        new = work.save(fed.select(*columns).mapInArrow(_kernel(table, prior), _STATE), "state")
        work.drop(state)
        state = new
        # one rule for both ways: no annotator's rate and no prior moves by the tolerance
        if before is not None and max(_largest_change(before[0], now), np.abs(before[1] - prior).max()) < TOLERANCE:
            break
        if before is not None and table is None:
            work.drop(before[0])
        before = (now, prior)
    else:
        warnings.warn(f"messages still moved by {TOLERANCE} or more after {MOST_ROUNDS} rounds", stacklevel=2)
    return state, _rates(state), annotators


def _largest_change(before: np.ndarray | DataFrame, now: np.ndarray | DataFrame) -> float:
    """The largest change of a hit or false-alarm rate of any annotator and class."""
    if isinstance(now, np.ndarray):
        rate = lambda t: t[:, :, 1::2] / np.maximum(t[:, :, ::2], 1e-9)
        return float(np.abs(rate(now) - rate(before)).max())
    moved = [F.abs(F.col("r")[i + 1] / F.greatest(F.col("r")[i], F.lit(1e-9)) - F.col("q")[i + 1] / F.greatest(F.col("q")[i], F.lit(1e-9))) for i in range(0, 12, 2)]
    return now.join(before.select("a", F.col("r").alias("q")), "a").agg(F.max(F.greatest(*moved))).first()[0]


def _numbered(names: DataFrame, work: Workspace) -> DataFrame:
    """With ``a``, numbers from 0 without gaps: places of hash buckets from their counts, then the order within a bucket."""
    names = work.save(names.withColumn("bucket", F.pmod(F.xxhash64("annotator_id"), F.lit(BUCKETS)).cast("int")), "names")
    first, starts = 0, []
    for bucket, c in sorted(map(tuple, names.groupBy("bucket").count().collect())):  # a row a bucket
        starts.append((bucket, first))
        first += c
    places = F.broadcast(names.sparkSession.createDataFrame(starts, "bucket int, first int"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("annotator_id"))
    return names.join(places, "bucket").select("annotator_id", "n_judgments", (F.col("first") + within - 1).cast("int").alias("a"))


def consensus(judgments: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(records, annotators)``.

    ``records``: ``uid, n_annotators, consensus, confidence, agreement`` of every record with usable judgments of at
    least three annotators; ``agreement`` is the share of its pairs of annotators that agree. Ties go to the earlier of
    SUPPORTED, HALLUCINATION, NOT_A_CLAIM. ``annotators``: ``annotator_id, n_judgments, reliability`` and the hit and
    false-alarm rate for each class; ``reliability`` is the mean over the classes of hit rate less false-alarm rate (1:
    always right, 0: tells nothing, below 0: misleads). Empty tables give empty results.
    """
    work = Workspace(spark, "consensus")
    state, rates, names = pass_messages(standing_judgments(judgments), spark, work)
    best = F.expr("array_position(total, array_max(total))").cast("int")
    p = "transform(total, x -> 1 / (1 + exp(-least(30d, greatest(-30d, x)))))"
    pairs = " + ".join(f"size(filter(c, x -> x = {k})) * (size(filter(c, x -> x = {k})) - 1)" for k in range(3))
    records = state.filter(F.size("a") >= LEAST_ANNOTATORS).select(
        "uid",
        F.size("a").alias("n_annotators"),
        F.element_at(F.array(*map(F.lit, CLASSES)), best).alias("consensus"),
        F.expr(f"array_max({p}) / aggregate({p}, 0d, (s, x) -> s + x)").alias("confidence"),
        F.expr(f"({pairs}) / (size(c) * (size(c) - 1))").alias("agreement"),
    )
    out = names.join(rates, "a").select("annotator_id", "n_judgments", *(e for k, w in enumerate(CLASSES) for e in ((F.col("r")[4 * k + 1] / F.col("r")[4 * k]).alias(f"hit_{w.lower()}"), (F.col("r")[4 * k + 3] / F.col("r")[4 * k + 2]).alias(f"false_{w.lower()}"))))
    reliability = sum((F.coalesce(F.col(f"hit_{w.lower()}"), F.lit(0.0)) - F.coalesce(F.col(f"false_{w.lower()}"), F.lit(0.0)) for w in CLASSES), F.lit(0.0)) / 3
    return records, out.withColumn("reliability", reliability)


def wrong_labels(judgments: DataFrame, gold: DataFrame, spark: SparkSession) -> DataFrame:
    """``row_id, consensus`` of the records whose label is null or says otherwise than their consensus."""
    records, _ = consensus(judgments, spark)
    said = F.when(F.col("label") == 1, CLASSES[0]).when(F.col("label") == 0, CLASSES[1])
    return gold.select("uid", "row_id", said.alias("said")).join(records.select("uid", "consensus"), "uid").filter("said is null or said <> consensus").select("row_id", "consensus")
