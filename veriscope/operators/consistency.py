"""Divergences of a document with itself: values, sets and variants of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.functions import entities as E
from veriscope.operators.segment import lines
from veriscope.plans.shared import Workspace

# How enumerations are written, and words that are no members.
_JOIN = r"\s*(?:,\s+and\s+|,\s+or\s+|,|\s+and\s+|\s+or\s+|/|\s+&\s+)\s*"
_WORD = r"[A-Za-z][A-Za-z\-]{1,20}"
GENERIC = ["and", "or", "the", "a", "an", "of", "to", "in", "on", "is", "are", "be", "for", "with", "without", "such", "also"]


def numeric(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, category, unit, context, n_values, occurrences``: values that differ under one unit and context."""
    per = lines(docs, key, text).select(key, "line_no", F.posexplode(E.numbers_column(F.col("line"))).alias("_p", "_x"))
    per = per.select(key, "line_no", "_p", "_x.*").filter("unit <> '' or context <> ''")
    shown = F.concat(F.col("value"), F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise(""), F.when(F.col("context") != "", F.concat(F.lit(" "), "context")).otherwise(""))
    grouped = per.groupBy(key, "unit", "context").agg(F.count_distinct("value").alias("n_values"), F.array_sort(F.collect_list(F.struct("line_no", "_p", shown.alias("value")))).alias("o"))
    category = F.trim(F.concat_ws(" ", "unit", "context"))
    return grouped.filter("n_values >= 2").select(key, category.alias("category"), "unit", "context", "n_values", F.transform("o", lambda x: F.struct(x["line_no"].alias("line"), x["value"].alias("value"))).alias("occurrences"))


def sets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, members, line``: enumerations as sorted sets with the first line of each."""
    found = lines(docs, key, text).select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(rf"(?<![A-Za-z0-9_]){_WORD}(?:{_JOIN}{_WORD}){{1,5}}(?![A-Za-z0-9_])"), F.lit(0))).alias("_r"))
    members = F.filter(F.transform(F.split("_r", _JOIN), lambda t: F.lower(F.trim(t))), lambda t: (t != "") & ~t.isin(GENERIC))
    named = found.select(key, "line_no", F.size(members).alias("_n"), F.array_sort(F.array_distinct(members)).alias("members")).filter("_n >= 2")
    return named.groupBy(key, "members").agg(F.min("line_no").alias("line"))


def set_pairs(docs: DataFrame, key: str, text: str = "text", least: float = 0.5) -> DataFrame:
    """Pairs of different sets of a document that share at least half of their members, joined on a shared member.

    A member in very many sets of one document would pair them all, so sets meet on their rarest members only: as many
    as it takes that no pair alike enough is missed. Each pair is kept once.
    """
    s = Workspace(docs.sparkSession, "sets").save(sets(docs, key, text), "sets")
    each = s.select(key, "members", "line", F.explode("members").alias("_m"))
    often = each.groupBy(key, "_m").agg(F.count(F.lit(1)).alias("_f"))
    # two sets that share at least the share ``least`` of their union have in common one of the rarest of either: all but so many
    # members may be passed over in a set of n that n * least, rounded up, less one remain
    place = F.row_number().over(Window.partitionBy(key, "members").orderBy("_f", "_m"))
    m = each.join(often, [key, "_m"]).withColumn("_place", place)
    m = m.filter(F.col("_place") <= F.size("members") - F.ceil(F.size("members") * F.lit(least)) + 1).select(key, "members", "line", "_m")
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._m") == F.col("b._m")) & (F.struct("a.line", "a.members") < F.struct("b.line", "b.members")))
    pairs = pairs.select(F.col(f"a.{key}").alias(key), F.col("a.members").alias("set_a"), F.col("a.line").alias("line_a"), F.col("b.members").alias("set_b"), F.col("b.line").alias("line_b")).distinct()
    share = F.size(F.array_intersect("set_a", "set_b")) / F.size(F.array_union("set_a", "set_b"))
    return pairs.withColumn("jaccard", share).filter(F.col("jaccard") >= least)


def name_variants(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, head, variants, occurrences``: phrases with one first word and different rest, one of them with a digit."""
    word = r"[A-Z][a-zA-Z0-9]*(?:-[A-Za-z0-9]+)*"
    found = lines(docs, key, text).select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(rf"(?U)\b{word}(?:\s+{word}){{1,3}}\b"), F.lit(0))).alias("phrase"))
    found = found.withColumn("head", F.element_at(F.split("phrase", r"\s+"), 1))
    out = found.groupBy(key, "head").agg(F.array_sort(F.collect_set("phrase")).alias("variants"), F.count(F.lit(1)).alias("occurrences"), F.max(F.col("phrase").rlike(r"\d")).alias("_d"))
    return out.filter((F.size("variants") >= 2) & F.col("_d")).drop("_d")


def check(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, kind, category, first_line, detail`` of all three checks."""
    a = numeric(docs, key, text).select(key, F.lit("numeric").alias("kind"), "category", F.col("occurrences")[0]["line"].alias("first_line"), F.to_json("occurrences").alias("detail"))
    label = F.when(F.size("set_a") == F.size("set_b"), F.concat(F.size("set_a").cast("string"), F.lit("-item set"))).otherwise("set")
    b = set_pairs(docs, key, text).select(key, F.lit("entity_set").alias("kind"), label.alias("category"), F.col("line_a").alias("first_line"), F.to_json(F.struct("set_a", "set_b")).alias("detail"))
    c = name_variants(docs, key, text).select(key, F.lit("entity_set").alias("kind"), F.concat(F.lit("'"), "head", F.lit("' variants")).alias("category"), F.lit(None).cast("int").alias("first_line"), F.to_json("variants").alias("detail"))
    return a.unionByName(b).unionByName(c)


def report(findings: DataFrame, key: str) -> DataFrame:
    """``key, report``: one markdown text for each document with findings."""
    line = F.concat(F.lit("## "), F.upper("kind"), F.lit(" - "), "category", F.lit("\n- line "), F.coalesce(F.col("first_line").cast("string"), F.lit("?")), F.lit(": `"), "detail", F.lit("`\n"))
    got = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("kind", "category", line.alias("l")))).alias("x"))
    return got.select(key, F.concat(F.lit("# Self-Consistency Report\n\n- Findings: "), F.col("n").cast("string"), F.lit("\n\n"), F.array_join("x.l", "\n")).alias("report"))
