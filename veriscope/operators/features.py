"""The lexical features of claim and evidence pairs, and the frozen heads over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.functions import entities as E
from veriscope.functions import kernels as K
from veriscope.functions import text as T
from veriscope.operators import bm25, lexical, segment
from veriscope.plans.shared import Workspace

LOW = ("r1_direct", "charng", "fuzzy", "anchor", "anchor_mm", "oracle", "top3", "specificity", "conflict_n", "conflict_flag", "num_edit_mag", "unmatched_rarity", "max_unmatched")
MEDIUM = (*LOW, "is_en", "same_lang", "wn_antonym_flip")
HIGH = ("r1_direct", "r1_mt", "r1_best", "charng", "fuzzy", "anchor", "anchor_mm", "oracle", "top3", "same_lang", "is_en", "specificity", "conflict_n", "conflict_flag", "num_edit_mag", "wn_antonym_flip", "unmatched_rarity", "max_unmatched")
TIERS = {"low": LOW, "medium": MEDIUM, "high": HIGH}
# Intercept, weights in the order above, threshold.
HEADS = {
    "low": (1.970069, (-3.426245, 2.657733, 1.383015, 0.305115, -0.154112, -0.961777, 1.793644, 0.968138, -0.254483, -1.708215, 1.944355, -5.683108, 1.133431), 0.45),
    "medium": (1.237915, (-1.500626, 3.024769, 2.139417, 0.321914, 0.179276, 0.353838, 2.484652, 0.356991, -0.435647, -2.102543, 2.285132, -2.762577, 0.446687, -2.305987, -0.386071, -2.237083), 0.4),
    "high": (-4.923953, (-3.724295, 1.372516, 4.076367, 2.434198, 2.767816, 0.133409, 0.260883, 0.249215, 2.222120, 1.236576, -0.898982, 1.040784, 0.687994, -2.928168, 2.417809, -2.704356, 0.100700, 1.038760), 0.5),
}
JOINT = (-5.186199, {"lex_p": 5.300125, "rr_max": 1.037737, "nli_ent": 2.216246, "cos_max": 3.751941, "nli_contra": -0.897544, "lex_contra": -0.630457, "lex_blocked": 2.914284}, 0.579798)
UNKNOWN_RARITY = 9.0
# A hand-written stand-in for a dictionary of antonyms.
ANTONYMS = [("before", "after"), ("more", "less"), ("above", "below"), ("first", "last"), ("opened", "closed"), ("open", "closed"), ("high", "low"), ("increase", "decrease"), ("old", "new"), ("north", "south"), ("northern", "southern"), ("reliable", "unreliable"), ("confirmed", "unconfirmed"), ("nothing", "everything"), ("nobody", "everybody"), ("dry", "wet"), ("start", "stop"), ("agree", "disagree"), ("later", "earlier"), ("same", "different")]


#: Claims against a source of one line: what they tell of is there, or it is not.
PROBE = (
    ("the harbour has a lighthouse", "The harbour has a lighthouse and two piers.", 1), ("there are two piers in the harbour", "The harbour has a lighthouse and two piers.", 1),
    ("a cable car leads up to the fortress", "A cable car leads from the market up to the old fortress.", 1), ("the bridge was rebuilt in 1974", "The bridge was opened in 1911 and rebuilt in 1974.", 1),
    ("the tunnel measures 640 metres", "The tunnel below the ridge measures 640 metres in all.", 1), ("chess tournaments", "Only about beekeeping.", 0),
    ("the harbour has an oil terminal", "The harbour has a lighthouse and two piers.", 0), ("a museum of glass stands in the harbour", "The harbour has a lighthouse and two piers.", 0),
    ("a ferry for tourists serves the harbour", "The harbour has a lighthouse and two piers.", 0), ("snowy mountain refuge", "Seven grey cats sleep under the warm stove.", 0),
    ("the forest covers ninety hectares", "The forest covers thirty hectares on the north side.", 0), ("the bridge was opened in 1802", "The bridge was opened in 1911 and rebuilt in 1974.", 0),
)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic(intercept: float, weights: dict[str, float]) -> Column:
    """Probability of a frozen logistic head over columns, added up in the order of the weights."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + w * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return sigmoid(z)


def head(tier: str) -> Column:
    intercept, weights, _ = HEADS[tier]
    return logistic(intercept, dict(zip(TIERS[tier], weights)))


def threshold(tier: str, non_english: float | None = None) -> Column:
    base = F.lit(HEADS[tier][2])
    return F.when(F.col("is_en") < 0.5, non_english).otherwise(base) if non_english is not None else base


def rarity(texts: DataFrame, text: str = "text") -> DataFrame:
    """``term, rarity``: minus the decimal logarithm of a term's share of all tokens (a substitute for word lists)."""
    counts = texts.select(F.explode(T.tokens(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("term", (-F.log10(F.col("n") / F.col("total"))).alias("rarity"))  # one row


def gap_rarity(pairs: DataFrame, background: DataFrame, key: str, claim: str, best: str) -> DataFrame:
    """``key, unmatched_rarity, max_unmatched``: weight of the claim's words that the best text lacks."""
    words = pairs.select(key, F.explode(F.filter(T.token_set(claim), lambda t: F.length(t) > 1)).alias("term"), T.token_set(F.coalesce(F.col(best), F.lit(""))).alias("_b"))
    words = words.select(key, "term", F.array_contains("_b", F.col("term")).alias("held")).join(background, "term", "left").withColumn("r", F.coalesce("rarity", F.lit(UNKNOWN_RARITY)))
    missing = F.when(~F.col("held"), F.col("r"))
    out = words.groupBy(key).agg((F.coalesce(F.sum(missing), F.lit(0.0)) / F.sum("r")).alias("unmatched_rarity"), (F.coalesce(F.max(missing), F.lit(0.0)) / UNKNOWN_RARITY).alias("max_unmatched"))
    return pairs.select(key).join(out, key, "left").fillna(0.0, ["unmatched_rarity", "max_unmatched"])


def antonym_flip(claim: Column, best: Column) -> Column:
    """Whether a claim's word is missing in the best text while its opposite is there."""
    both = ANTONYMS + [(b, a) for a, b in ANTONYMS]
    c, b = T.token_set(claim), T.token_set(best)
    table = F.array(*[F.struct(F.lit(x).alias("w"), F.lit(y).alias("a")) for x, y in both])
    return F.exists(table, lambda p: F.array_contains(c, p["w"]) & ~F.array_contains(b, p["w"]) & F.array_contains(b, p["a"]))


_PAIR = ("fuzzy", "anchor", "anchor_mm", "specificity", "conflict_n", "conflict_flag", "num_edit_mag")


def _pair_rows(rows: list[tuple[str, str, str]]) -> list[tuple]:
    """The features of ``_PAIR`` of claims with their sources and best chunks."""
    fuzzy = K.partial_ratios([(c.lower(), t.lower()) for c, _, t in rows])
    out = []
    for (c, s, t), (ratio, *_) in zip(rows, fuzzy):
        spec = (len(E.entities(c)) + len(E.re.findall(r"\d+", c))) / (len(K.WORD.findall(c)) or 1)
        out.append((ratio if c and t else 0.0, *E.anchors(c, s, t), spec, *E.conflicts(c, t)))
    return out


def pair_features(pairs: DataFrame, key: str, claim: str, source: str, best: str) -> DataFrame:
    """Features that need a scan of claim, whole source and best chunk; one Arrow pass."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _pair_rows([(c or "", s or "", t or "") for c, s, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))])
            cols = list(zip(*rows)) or [[]] * len(_PAIR)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in cols)], ["k", *_PAIR])

    out = pairs.select(F.col(key).alias("k"), claim, source, best).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} double" for n in _PAIR))
    return out.withColumnRenamed("k", key)


def best_chunks(records: DataFrame, key: str, claim: str = "claim", source: str = "source_text") -> DataFrame:
    """``key, claim, source, best``: the chunk of each record's whole text that BM25 puts first.

    Without a score above 0 it is the first chunk that has tokens; empty for a claim without tokens or an empty text.
    Chunks of records that share a text are made once.
    """
    rec = records.select(key, claim, F.coalesce(F.col(source), F.lit("")).alias(source)).withColumn("_doc", F.md5(source))
    work = Workspace(records.sparkSession, "best")
    chunks = work.save(segment.view_chunks(rec.select("_doc", source).dropDuplicates(["_doc"]), ["_doc"], source), "chunks")
    posts = work.save(bm25.postings(chunks, "_doc", "chunk_no"), "postings")
    score = bm25.scores(rec.select(key, "_doc", claim), posts, *bm25.statistics(posts, "_doc", "chunk_no"), key, "_doc", "chunk_no", claim).filter("score > 0")
    won = score.groupBy(key).agg(F.min_by("chunk_no", F.struct(-F.col("score"), F.col("chunk_no"))).alias("_won"))
    first = posts.groupBy("_doc").agg(F.min("chunk_no").alias("_first"))
    said = rec.join(won, key, "left").join(first, "_doc", "left").withColumn("chunk_no", F.when(F.size(T.tokens(claim)) > 0, F.coalesce("_won", "_first")))
    said = said.join(chunks.select("_doc", "chunk_no", F.col("text").alias("best")), ["_doc", "chunk_no"], "left")
    return said.select(key, claim, source, F.coalesce("best", F.lit("")).alias("best"))


def tier(records: DataFrame, background: DataFrame, effort: str, claim_lang: str, source_lang: str, translate: Callable[[Column, Column], Column] | None = None, key: str = "row_id", claim: str = "claim", source: str = "source_text") -> DataFrame:
    """The features of a tier (``low``, ``medium`` or ``high``) in the order of its head, with the languages from two columns.

    ``translate`` makes a text of a claim and its language; it is asked for claims in a known language that is neither
    English nor that of the source, and only in the high tier. Without it ``r1_mt`` is ``r1_direct``. A null language is
    no known one. An antonym counts only where the best chunk is alike otherwise (fuzzy above .5).
    """
    low = low_tier(records, background, key, claim, source, keep=("_claim", "_best") if effort != "low" else ())
    if effort == "low":
        return low
    lang, other = T.lang_base(claim_lang), T.lang_base(source_lang)
    said = records.select(key, (lang == "en").alias("_en"), (lang == other).alias("_same"), lang.alias("_lang"), (lang.isNotNull() & ~lang.isin("en", "und", "") & ~F.coalesce(lang == other, F.lit(False))).alias("_asks"))
    out = low.join(said, key).withColumns({
        "is_en": F.coalesce("_en", F.lit(False)).cast("double"), "same_lang": F.coalesce("_same", F.lit(False)).cast("double"),
        "wn_antonym_flip": F.coalesce(antonym_flip(F.col("_claim"), F.col("_best")) & (F.col("fuzzy") > 0.5), F.lit(False)).cast("double"),
    })
    if effort == "high":
        if translate is None:
            out = out.withColumn("r1_mt", F.col("r1_direct"))
        else:
            asked = records.join(said.filter("_asks").select(key, "_lang"), key).withColumn(claim, translate(F.col(claim), F.col("_lang")))
            out = out.join(_direct_recall(asked, background, key, claim, source).withColumnRenamed("r1", "r1_mt"), key, "left").withColumn("r1_mt", F.coalesce("r1_mt", "r1_direct"))
        out = out.withColumn("r1_best", F.greatest("r1_direct", "r1_mt"))
    return out.select(key, *TIERS[effort])


def _direct_recall(records: DataFrame, background: DataFrame, key: str, claim: str, source: str) -> DataFrame:
    """``key, r1``: recall of each record's claim in the chunk that BM25 puts first, 0 where there is none."""
    rec = _records(records, key, claim, source)
    work = Workspace(records.sparkSession, "recall")
    return lexical.records(rec, background, key, "_claim", "_src", "_doc", work, UNKNOWN_RARITY).select(key, "r1")


def _records(records: DataFrame, key: str, claim: str, source: str) -> DataFrame:
    return records.select(key, F.col(claim).alias("_claim"), F.coalesce(F.col(source), F.lit("")).alias("_src")).withColumn("_doc", F.md5("_src"))


def low_tier(records: DataFrame, background: DataFrame, key: str = "row_id", claim: str = "claim", source: str = "source_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The thirteen low-tier features of labelled records (claim with its own evidence text).

    ``keep`` names what is given besides: ``_claim`` and ``_best``, the chunk that BM25 puts first.

    A record's evidence is chunked at 300 characters and is a corpus of its own. Records of one text are dealt to tasks
    together, so a text's chunks are made and counted once for each block of its records. After that only the blocks'
    terms are shuffled, to meet their rarities.
    """
    rec = _records(records, key, claim, source)
    work = Workspace(records.sparkSession, "features")
    got = lexical.records(rec, background, key, "_claim", "_src", "_doc", work, UNKNOWN_RARITY, _pair_rows, _PAIR, keep=bool(keep))
    names = {"r1": "r1_direct", "second": "top3", "unmatched": "unmatched_rarity", "worst": "max_unmatched", "claim": "_claim", "best": "_best"}
    return got.withColumnsRenamed(names).select(key, *LOW, *keep)
