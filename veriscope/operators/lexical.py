"""BM25 of records that each have a small corpus of their own, in one pass over the records and without postings tables.

The scores and weights are those of ``bm25``; the tokens those of ``functions.text``.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.functions import kernels as K
from veriscope.functions import text as T
from veriscope.operators.bm25 import EPSILON, K1, B
from veriscope.plans.shared import Workspace

#: Records of one text in a block, from which on the text is among those dealt to several tasks; most such texts.
BLOCK, HOT = 500, 2000
#: Records that a task holds at a time.
AT_ONCE = 4000


def tokens(text: str) -> list[str]:
    """As ``functions.text.tokens``."""
    return K.WORD.findall(text.lower().replace("ς", "σ"))


@functools.cache
def _bare() -> dict[int, str | None]:
    marks = {c: None for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))}
    return marks | {ord(a): b for a, b in zip(T._MARKED, T._PLAIN)}


@functools.lru_cache(20_000)
def _grams(token: str) -> tuple[str, ...]:
    t = f"#{token}#"
    return tuple(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))


def bare_ngrams(text: str) -> list[str]:
    """As ``functions.text.bare_ngrams``."""
    return [g for t in tokens(text.translate(_bare())) for g in _grams(t)]


class Corpus:
    """Postings of a few passages by term: ``(passage, part of the score)``; passages without tokens don't count."""

    def __init__(self, passages: list[str], analyzer: Callable[[str], list[str]] = tokens):
        counts = [(no, Counter(analyzer(p))) for no, p in enumerate(passages)]
        counts = [(no, tf, tf.total()) for no, tf in counts if tf]
        n = len(counts)
        df = Counter(term for _, tf, _ in counts for term in tf)
        of = {d: math.log(n - d + 0.5) - math.log(d + 0.5) for d in set(df.values())}
        mean = sum(of[d] for d in df.values()) / max(1, len(df))
        of = {d: x if x >= 0 else EPSILON * mean for d, x in of.items()}
        self.idf = {term: of[d] for term, d in df.items()}
        self.max_idf = max(of.values(), default=None)  # None: no passage has tokens
        self.posts: dict[str, list[tuple[int, float]]] = {}
        average = sum(dl for *_, dl in counts) / max(1, n)
        for no, tf, dl in counts:
            long = K1 * (1 - B + B * dl / average)
            for term, k in tf.items():
                self.posts.setdefault(term, []).append((no, self.idf[term] * k * (K1 + 1) / (k + long)))

    def best(self, asked: Counter[str]) -> int | None:
        """The first passage of the highest score, if that is above 0."""
        total: dict[int, float] = {}
        for term, k in asked.items():
            for no, part in self.posts.get(term, ()):
                total[no] = total.get(no, 0.0) + k * part
        score, no = min(((-round(x, 9), no) for no, x in total.items()), default=(0.0, None))
        return no if score < 0 else None

    def weight(self, term: str) -> float:
        return max(0.0, self.idf.get(term, self.max_idf))

    def recalls(self, asked: Counter[str]) -> dict[int, float]:
        """Of each passage that has a term of the claim, the share of the claim's term weight."""
        if self.max_idf is None:
            return {}
        weights = {term: self.weight(term) for term in asked}
        return shares([(w, [no for no, _ in self.posts.get(term, ())]) for term, w in weights.items()])


def shares(terms: list[tuple[float, list[int]]]) -> dict[int, float]:
    """By passage, from weight and passages of each term of a claim: the share of the weight, or of the terms where none weighs anything."""
    held: dict[int, float] = {}
    if not any(w > 0 for w, _ in terms):
        terms = [(1.0, at) for _, at in terms]
    for w, at in terms:
        for no in at:
            held[no] = held.get(no, 0.0) + w
    whole = sum(w for w, _ in terms)
    return {no: w / whole for no, w in held.items()}


def dealt(rows: DataFrame, by: str, key: str) -> DataFrame:
    """The records by their text, so that a task makes a text's corpus once; a text of many records is dealt to several tasks."""
    n = rows.count()
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(BLOCK, n // HOT))
    hot = F.broadcast(sizes.select(by, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_of")))  # less than HOT rows
    out = rows.join(hot, by, "left").withColumn("_blk", F.pmod(F.xxhash64(key), F.coalesce("_of", F.lit(1))).cast("int"))
    # a stated number of partitions: few bytes are much work here
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(tasks, by, "_blk").sortWithinPartitions(by, "_blk").drop("_of", "_blk")


_TERM = pa.struct([("term", pa.string()), ("w", pa.float64()), ("at", pa.list_(pa.int32()))])
_RARE = ("r1", "oracle", "second", "unmatched", "worst")


def records(rows: DataFrame, background: DataFrame, key: str, claim: str, source: str, doc: str, work: Workspace, unknown: float, features: Callable[[list[tuple[str, str, str]]], list[tuple]] | None = None, names: tuple[str, ...] = (), keep: bool = False, most: int = 300, blend: float = 0.5) -> DataFrame:
    """``key, r1, oracle, second, unmatched, worst`` of each record against the chunks of its own text.

    Recall of the chunk that BM25 puts first (the first chunk if none scores), the highest and second highest over all
    chunks (weights have a floor of ``blend`` times the rarity), and what the best chunk lacks: share of the rarity, and
    the largest one over ``unknown``. With ``features`` (of claim, text and best chunk) also ``charng``, the n-gram recall of
    the chunk that n-grams put first, and ``names``; with ``keep`` also ``claim`` and ``best``.

    Records of a text go through in blocks; what meets the rarities is each term of a block once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, key_type = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    more, texts = (("charng", *names) if features else ()), (("claim", "best") if keep else ())
    rec = pa.struct([("k", key_type), ("no", pa.int32()), ("idx", pa.list_(pa.int32())), *((n, pa.string()) for n in texts), *((n, pa.float64()) for n in more)])
    fields = "".join([*(f",{n}:string" for n in texts), *(f",{n}:double" for n in more)])

    def blocks(recs: list[list[tuple]], dicts: list[list[dict]]) -> pa.RecordBatch:
        flat = [r for block in recs for r in block]
        got = features([(c or "", s, best or "") for _, _, _, c, s, best, _ in flat]) if features else [()] * len(flat)
        at, out = 0, []
        for block in recs:
            out.append([{"k": k, "no": no, "idx": idx} | ({"claim": c, "best": best} if keep else {}) | (dict(zip(more, (charng, *x))) if features else {}) for (k, no, idx, c, _, best, charng), x in zip(block, got[at : at + len(block)])])
            at += len(block)
        return pa.RecordBatch.from_arrays([pa.array([x[0]["k"] for x in out], key_type), pa.array(out, pa.list_(rec)), pa.array(dicts, pa.list_(_TERM))], ["blk", "recs", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunks, words, grams = None, [], None, None
        recs: list[list[tuple]] = []
        dicts: list[dict[str, int]] = []
        known: list[list[dict]] = []
        count = 0
        for b in batches:
            for k, c, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != last:
                    last = s
                    chunks = [t for *_, t in ([(0, len(s), s)] if len(s) <= most else K.recursive_chunks(s, most, 0.1))] if s else []
                    words, grams = Corpus(chunks), Corpus(chunks, bare_ngrams) if features else None
                    fresh = True
                if fresh or not recs or len(recs[-1]) >= BLOCK:
                    if count >= AT_ONCE:
                        yield blocks(recs, known)
                        recs, dicts, known, count = [], [], [], 0
                    recs.append([])
                    dicts.append({})
                    known.append([])
                    fresh = False
                asked, at = Counter(tokens(c or "")), dicts[-1]
                for t in asked:
                    if t not in at:
                        at[t] = len(at)
                        known[-1].append({"term": t, "w": None if words.max_idf is None else words.weight(t), "at": [x for x, _ in words.posts.get(t, ())]})
                no = words.best(asked) or 0
                charng = 0.0
                if features:
                    pieces = Counter(bare_ngrams(c or ""))
                    charng = grams.recalls(pieces).get(grams.best(pieces) or 0, 0.0)
                recs[-1].append((k, no, [at[t] for t in asked], c, s, chunks[no] if no < len(chunks) else None, charng))
                count += 1
        if recs:
            yield blocks(recs, known)

    dealt_rows = dealt(rows.select(F.col(key).alias("k"), claim, source, doc), doc, "k").select("k", claim, source)
    scanned = work.save(dealt_rows.mapInArrow(run, f"blk {kind}, recs array<struct<k:{kind},no:int,idx:array<int>{fields}>>, terms array<struct<term:string,w:double,at:array<int>>>"), "scanned")
    asked = scanned.select("blk", F.posexplode("terms.term").alias("i", "term"))
    rare = asked.join(background.select("term", "rarity"), "term").groupBy("blk").agg(F.collect_list("i").alias("i"), F.collect_list("rarity").alias("r"))
    slim = scanned.select("blk", "recs", F.col("terms.w").alias("w"), F.col("terms.at").alias("at"), F.transform("terms.term", lambda t: F.length(t) > 1).alias("long"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                recs, w, at, long, i, r = (b.column(n)[row].as_py() for n in ("recs", "w", "at", "long", "i", "r"))
                rarity = [unknown] * len(w)
                for x, y in zip(i or (), r or ()):
                    rarity[x] = y
                weight = [None if x is None else max(x, blend * y) for x, y in zip(w, rarity)]
                out = []
                for x in recs:
                    idx, no = x["idx"], x["no"]
                    got = shares([(weight[t], at[t]) for t in idx]) if idx and weight[idx[0]] is not None else {}
                    top = sorted(got.values(), reverse=True)[:2] or [0.0]
                    lacks, whole = [rarity[t] for t in idx if long[t] and no not in at[t]], sum(rarity[t] for t in idx if long[t])
                    out.append((got.get(no, 0.0), top[0], top[-1], sum(lacks) / whole if whole else 0.0, max(lacks, default=0.0) / unknown))
                cols = [pa.array([x["k"] for x in recs], key_type), *(pa.array(x, pa.float64()) for x in zip(*out))]
                cols += [pa.array([x[n] for x in recs], pa.string()) for n in texts] + [pa.array([x[n] for x in recs], pa.float64()) for n in more]
                yield pa.RecordBatch.from_arrays(cols, ["k", *_RARE, *texts, *more])

    schema = f"k {kind}" + "".join([*(f", {n} double" for n in _RARE), *(f", {n} string" for n in texts), *(f", {n} double" for n in more)])
    return slim.join(rare, "blk", "left").mapInArrow(measured, schema).withColumnRenamed("k", key)


def best_recall(claims: DataFrame, passages: DataFrame, claim_id: str, group: str, passage: str, claim: str = "claim", text: str = "text") -> DataFrame:
    """``claim_id, recall``: the highest n-gram recall (as ``bm25.recalls`` with ``bare_ngrams``) over the passages of the
    claim's group; none for a claim that shares no n-gram with them. A group's passages are one row.
    """
    corpora = passages.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(passage).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]).alias("texts"))
    asked = claims.select(F.col(claim_id).alias("k"), group, F.coalesce(F.col(claim), F.lit("")).alias("c"))
    sizes = asked.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("of"))
    blocks = asked.join(sizes, group).withColumn("blk", F.pmod(F.xxhash64("k"), F.col("of")).cast("int")).groupBy(group, "blk").agg(F.collect_list(F.struct("k", "c")).alias("qs"))
    tasks = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = claims.schema[claim_id].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(claims.schema[claim_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                corpus = Corpus(row.column("texts").to_pylist()[0], bare_ngrams)
                got = [(q["k"], max(corpus.recalls(Counter(bare_ngrams(q["c"]))).values(), default=None)) for q in row.column("qs").to_pylist()[0]]
                got = [x for x in got if x[1] is not None]
                if got:
                    k, r = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(k, key_type), pa.array(r, pa.float64())], ["k", "recall"])

    met = blocks.join(corpora, group).select("qs", "texts").repartition(tasks, F.xxhash64(F.col("qs")[0]["k"]))
    return met.mapInArrow(run, f"k {kind}, recall double").withColumnRenamed("k", claim_id)
