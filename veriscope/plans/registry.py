"""Queries with their SQL, and the fragments both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# SQL fragments
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}]"


def s_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def s_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def s_fold(x: str) -> str:
    return f"replace(lower({x}), 'ς', 'σ')"


def s_tokens(x: str) -> str:
    return f"coalesce(regexp_extract_all({s_fold(x)}, '{WORD}'), [])"


def s_set(x: str) -> str:
    return f"list_distinct({s_tokens(x)})"


#: Records with the share of their claim's words that their evidence has, the score of the evaluation queries.
S_SCORED = f"""scored AS (SELECT row_id, uid, group_id, role, origin, label, coalesce(string_split(lower(lang), '-')[1], 'none') AS lang_norm,
 CASE WHEN len(c) > 0 THEN round(len(list_intersect(c, s))::DOUBLE / len(c), 6) ELSE 0.0 END AS p, len(c) AS n_words
 FROM (SELECT *, {s_set('claim')} AS c, {s_set('source_text')} AS s FROM gold))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold")
    c, s = T.token_set("claim"), T.token_set("source_text")
    return g.select("row_id", "uid", "group_id", "role", "origin", "label", F.coalesce(T.lang_base("lang"), F.lit("none")).alias("lang_norm"), F.round(T.overlap(c, s), 6).alias("p"), big(F.size(c)).alias("n_words"))


def s_counts(truth: str = "label", said: str = "said") -> str:
    return f"""count(*) FILTER (WHERE {truth} = 1 AND {said} = 1) AS tp, count(*) FILTER (WHERE {truth} = 0 AND {said} = 1) AS fp,
 count(*) FILTER (WHERE {truth} = 1 AND {said} = 0) AS fn, count(*) FILTER (WHERE {truth} = 0 AND {said} = 0) AS tn"""


def s_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END)"


S_F1 = s_ratio("2*tp", "2*tp+fp+fn")
S_F0 = s_ratio("2*tn", "2*tn+fn+fp")
S_MACRO = f"round(({S_F1} + {S_F0}) / 2, 4)"
S_MEASURES = f"""round({s_ratio('tp', 'tp+fp')}, 4) AS precision, round({s_ratio('tp', 'tp+fn')}, 4) AS recall, round({S_F1}, 4) AS f1, {S_MACRO} AS macro_f1,
 round({s_ratio('tp+tn', 'tp+fp+fn+tn')}, 4) AS accuracy, round(({s_ratio('tp', 'tp+fn')} + {s_ratio('tn', 'tn+fp')}) / 2, 4) AS balanced, round({s_ratio('tn', 'tn+fp')}, 4) AS tnr"""
