"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.plans.shared import Workspace


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "sources").select(F.col("source_key").alias("item_id"), "text")
    return s.unionByName(_t(spark, sf, "chunks").select(F.col("chunk_id").alias("item_id"), "text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.consensus import wrong_labels

    return wrong_labels(_t(spark, sf, "judgments"), _t(spark, sf, "gold"), spark)


def p1_consensus(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.consensus import consensus

    return consensus(_t(spark, sf, "judgments"), spark)[0]


def p1_agreement(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.consensus import consensus

    return consensus(_t(spark, sf, "judgments"), spark)[0].select("uid", F.col("n_annotators").cast("bigint").alias("n_annotators"), F.round("agreement", 6).alias("agreement"))


def p1_annotators(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.consensus import consensus

    return consensus(_t(spark, sf, "judgments"), spark)[1]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.split_oversized import oversized, split_oversized

    return oversized(split_oversized(_items(spark, sf), "item_id"))


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.split_oversized import split_oversized

    return split_oversized(_items(spark, sf), "item_id")


def p2_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of each item with a text: whether all pieces are within the limit, and how many characters their cores cover."""
    p = p2_pieces(spark, sf)
    return p.groupBy("item_id").agg(F.bool_and(F.length("piece") <= 1500).alias("within"), F.sum(F.col("char_end") - F.col("core_start")).alias("covered"))


def p3_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Records, units that are divided, and whether the held-out shares are within two points of a tenth; none for an empty table."""
    s = p3_splits(spark, sf)
    units = s.groupBy("unit").agg(F.count_distinct("split").alias("n"), F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("split") == x).alias(x) for x in ("validation", "test")))
    near = lambda x: F.abs(F.sum(x) / F.sum("rows") - 0.1) < 0.02
    return units.agg(F.sum("rows").alias("records"), F.count_if(F.col("n") > 1).alias("divided"), (near("validation") & near("test")).alias("near")).filter("records > 0")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.related_splits import misplaced

    return misplaced(_t(spark, sf, "gold"), spark)


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.related_splits import assign_splits

    return assign_splits(_t(spark, sf, "gold"), spark)


def p3_forest(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.related_splits import forest

    return forest(_t(spark, sf, "gold"), spark)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.near_duplicates import similar_pairs

    return similar_pairs(_t(spark, sf, "gold"), spark)


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.near_duplicates import near_duplicate_classes

    return near_duplicate_classes(_t(spark, sf, "gold"), spark)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.sentences import found

    return found(_t(spark, sf, "sources"), _t(spark, sf, "extracted_claims"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.language_labels import mislabelled

    return mislabelled(_t(spark, sf, "gold"), _t(spark, sf, "languages"))


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.language_labels import language_list, language_segments, train_on

    gold, known = _t(spark, sf, "gold"), language_list(_t(spark, sf, "languages"))
    out = language_segments(gold, train_on(gold, known), known)
    return out.select("row_id", F.posexplode("segments").alias("segment_no", "s")).select("row_id", "segment_no", "s.*")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.tokenize_automaton import encode_documents

    return encode_documents(_t(spark, sf, "documents"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.tokenize_automaton import decode_documents, encode_documents

    return decode_documents(encode_documents(_t(spark, sf, "documents")))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.fill_containers import fill_containers

    return fill_containers(_t(spark, sf, "documents"), spark)


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.fill_containers import audit, fill_containers

    documents = _t(spark, sf, "documents")
    placed = Workspace(spark, "audit").save(fill_containers(documents, spark), "placed")
    return audit(documents, placed)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.canonical_text import look_alike_pairs

    return look_alike_pairs(_t(spark, sf, "documents"), Workspace(spark, "look"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.canonical_text import look_alike_classes

    return look_alike_classes(_t(spark, sf, "documents"), Workspace(spark, "look"))


def p9_canonical(spark: SparkSession, sf: str) -> DataFrame:
    from veriscope.llm.canonical_text import canonical_text

    return canonical_text(_t(spark, sf, "documents")).select("doc_id", "canonical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_agreement": """
            WITH n AS (SELECT *, regexp_replace(upper(label), '[^\\p{L}\\p{N}]+', '', 'g') AS x FROM judgments WHERE uid IS NOT NULL AND annotator_id IS NOT NULL),
            c AS (SELECT uid, annotator_id, judgment_id, judged_at, CASE WHEN x = '1' OR regexp_matches(x, '^SUPP?ORT') THEN 0 WHEN x = '0' OR regexp_matches(x, '^HALL?UCINAT') OR regexp_matches(x, '^REFUTE') THEN 1 WHEN x IN ('NOTACLAIM', 'NAC', 'NOCLAIM') THEN 2 END AS c FROM n),
            s AS (SELECT uid, annotator_id, arg_max(c, struct_pack(a := coalesce(judged_at, TIMESTAMP '0001-01-01'), b := judgment_id)) AS c FROM c WHERE c IS NOT NULL GROUP BY 1, 2),
            k AS (SELECT uid, c, count(*) AS k FROM s GROUP BY 1, 2)
            SELECT uid, sum(k)::BIGINT AS n_annotators, round(sum(k * (k - 1)) / (sum(k) * (sum(k) - 1)), 6) AS agreement FROM k GROUP BY 1 HAVING sum(k) >= 3""",
        "p2_audit": """
            WITH i AS (SELECT source_key AS item_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS n FROM sources UNION ALL SELECT chunk_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) FROM chunks)
            SELECT item_id, true AS within, n AS covered FROM i WHERE n > 0""",
        "p3_audit": "SELECT count(*) AS records, 0::BIGINT AS divided, true AS near FROM gold",
        "p4_found": """
            WITH t AS (SELECT row_id, trim(regexp_replace(lower(claim), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM gold), d AS (SELECT t, min(row_id) AS rep FROM t WHERE length(t) >= 3 GROUP BY 1),
            g AS (SELECT DISTINCT rep, substring(t, i::INT, 3) AS g FROM d, range(1, 100000) r(i) WHERE i <= length(t) - 2), n AS (SELECT rep, count(*) AS n FROM g GROUP BY 1),
            c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
            e AS (SELECT a, b FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9 UNION ALL SELECT rep, rep FROM d),
            m AS (SELECT row_id, rep FROM t JOIN d USING (t)), p AS (SELECT x.row_id AS i, y.row_id AS j FROM e JOIN m x ON x.rep = e.a JOIN m y ON y.rep = e.b WHERE x.row_id <> y.row_id)
            SELECT DISTINCT least(i, j) AS row_id_a, greatest(i, j) AS row_id_b FROM p""",
        "p8_audit": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS split_within_capacity, 0::BIGINT AS gaps, 0::BIGINT AS shared_sources FROM documents",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p2_found": """
            SELECT source_key AS item_id FROM sources WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1500
            UNION SELECT chunk_id FROM chunks WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1500""",
    }
