"""Evidence, claims, labelled records and traces from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import text as T

CLAIM = "array<struct<claim:string,id:string,line_number:int,char_start:int,char_end:int>>"


def evidence(spark: SparkSession, *paths: str) -> DataFrame:
    """``source_path, text`` of text files (any Hadoop path or glob); files that are not valid UTF-8 are left out."""
    raw = spark.read.format("binaryFile").load(list(paths))
    return raw.select(F.col("path").alias("source_path"), F.col("content")).filter(F.expr("is_valid_utf8(content)")).select("source_path", F.decode("content", "UTF-8").alias("text"))


def mirror(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, content`` of the files under a prefix whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def numbered_sources(spark: SparkSession, sources: list[str | tuple[str, str]], group_id: str = "") -> DataFrame:
    """``group_id, source_index, source_path, text`` of texts or (path, text) pairs given in a list."""
    rows = [(group_id, i, *(s if isinstance(s, tuple) else ("", s))) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "group_id string, source_index int, source_path string, text string")


def parse_claims(raw: DataFrame, text: str = "value") -> DataFrame:
    """Claims of whole texts: a JSON list of objects or strings, else one claim a line. Empty claims are refused."""
    body = F.trim(F.col(text))
    objects, strings = F.from_json(body, CLAIM), F.from_json(body, "array<string>")
    plain = F.transform(strings, _bare)
    listed = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = F.transform(listed, lambda x: _bare(F.trim(x)))
    is_object = body.rlike(r"^\[\s*\{")
    claims = F.when(is_object, objects).when(body.startswith("["), plain).otherwise(by_line)
    rows = raw.select(F.posexplode(claims).alias("position", "_c")).select("position", "_c.*")
    return rows.withColumn("claim", F.when(F.length("claim") > 0, F.col("claim")).otherwise(F.raise_error(F.lit("a claim must not be empty"))))


def _bare(x: Column) -> Column:
    none = F.lit(None)
    return F.struct(x.alias("claim"), none.cast("string").alias("id"), *(none.cast("int").alias(n) for n in ("line_number", "char_start", "char_end")))


def claims(spark: SparkSession, path: str) -> DataFrame:
    return parse_claims(spark.read.text(path, wholetext=True))


def records(spark: SparkSession, path: str, claim: str = "claim", source: str = "source_text", label: str = "label", lang: str | None = "lang") -> DataFrame:
    """Labelled records from parquet, JSON lines, JSON or CSV, with the columns under their usual names."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("jsonl", "ndjson"):
        df = spark.read.json(path)
    elif kind == "json":
        df = spark.read.json(path, multiLine=True)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    else:
        raise ValueError(f"unknown kind of file: {path}")
    missing = [c for c in (claim, source, label) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = [F.col(claim).alias("claim"), F.col(source).alias("source_text"), F.col(label).alias("label")]
    return df.select(*out, F.col(lang).alias("lang") if lang and lang in df.columns else F.lit(None).cast("string").alias("lang"))


def events(raw: DataFrame, text: str = "value") -> DataFrame:
    """``claim, sources, effort`` of JSON events, one row a claim and list of sources."""
    e = F.from_json(F.col(text), "struct<claims:array<string>,sources:array<array<string>>,effort:string>")
    x = raw.select(e.alias("e")).select(F.explode(F.arrays_zip("e.claims", "e.sources")).alias("z"), F.coalesce("e.effort", F.lit("high")).alias("effort"))
    return x.select(F.col("z.claims").alias("claim"), F.col("z.sources").alias("sources"), "effort")


def strip_markup(x: Column) -> Column:
    """Text of an HTML fragment: tags to blanks, the common entities resolved, white space collapsed."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(F.regexp_replace(x, "<[^>]*>", " ") if a == "&nbsp;" else x, F.lit(a), F.lit(b))
    return T.normalize_whitespace(x)


def trace_evidence(spans: DataFrame, trace: str = "trace_id", kind: str = "type", output: str = "output", kinds: tuple[str, ...] = ("tool", "rag"), least: int = 80) -> DataFrame:
    """``trace, evidence``: distinct stripped outputs of the tool spans of a trace that are long enough, joined."""
    s = spans.filter(F.col(kind).isin(*kinds)).select(trace, strip_markup(F.col(output)).alias("_t")).filter(F.length("_t") > least).distinct()
    return s.groupBy(trace).agg(F.array_join(F.array_sort(F.collect_list("_t")), "\n\n").alias("evidence"))
