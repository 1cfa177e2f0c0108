"""Texts into passages, chunks, sentences and claims (rows out of rows)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.functions import kernels as K
from veriscope.functions import text as T

_SPANS = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string())]))


def _explode_spans(df: DataFrame, keys: list[str], text: str, kernel: Callable[[str], list[tuple[int, int, str]]], number: str) -> DataFrame:
    """Rows ``keys, number, char_start, char_end, text`` of the spans that a kernel finds; one Arrow pass."""
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["spans array<struct<char_start:int,char_end:int,text:string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("char_start", "char_end", "text"), s)) for s in kernel(t)] if t else [] for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(spans, _SPANS)], [*keys, "spans"])

    out = df.select(*keys, F.col(text).cast("string").alias("_t")).mapInArrow(run, schema)
    return out.select(*keys, F.posexplode("spans").alias(number, "_s")).select(*keys, number, "_s.char_start", "_s.char_end", "_s.text")


def passages(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Runs of lines with offsets; the sentence fallback for a long text that is one run."""
    return _explode_spans(df, keys, text, K.passages, "passage_no")


def chunks(df: DataFrame, keys: list[str], text: str = "text", most: int = 1500, overlap_ratio: float = 0.25, least: int = 20) -> DataFrame:
    """Recursive chunks with offsets; ``least`` drops slivers."""
    return _explode_spans(df, keys, text, lambda t: K.recursive_chunks(t, most, overlap_ratio, least), "chunk_no")


def view_chunks(df: DataFrame, keys: list[str], text: str = "text", most: int = 300, overlap_ratio: float = 0.1) -> DataFrame:
    """The whole text when it is short, else its chunks."""
    return _explode_spans(df, keys, text, lambda t: [(0, len(t), t)] if len(t) <= most else K.recursive_chunks(t, most, overlap_ratio), "chunk_no")


def packed_sentences(df: DataFrame, keys: list[str], text: str = "text", most: int = 300) -> DataFrame:
    return _explode_spans(df, keys, text, lambda t: [(-1, -1, p) for p in K.pack_by_sentence(t, most)], "chunk_no").drop("char_start", "char_end")


def clauses(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return _explode_spans(df, keys, text, lambda t: [(-1, -1, p) for p in K.clauses(t)], "clause_no").drop("char_start", "char_end")


def line_passages(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Runs of lines by one regular expression in the JVM (no offsets, no fallback)."""
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"[^\n]+(?:\n(?!{T.SPACE}*\n)[^\n]+)*"), F.lit(0))
    runs = F.filter(runs, lambda p: p.rlike(T.WORD))
    return df.select(*keys, F.posexplode(runs).alias("passage_no", "text"))


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line_no, line``: numbered from 1."""
    parts = F.split(F.col(text), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    return df.select(key, F.posexplode(parts).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, paragraph_no, line_no, text``: lines of prose without their markdown, joined up to the next empty one."""
    bare = lines(df, key, text).withColumn("bare", T.strip_markdown("line"))
    by = Window.partitionBy(key).orderBy("line_no")
    islands = bare.withColumn("paragraph_no", F.sum((F.col("bare") == "").cast("int")).over(by)).filter("bare <> ''")
    joined = islands.groupBy(key, "paragraph_no").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "bare"))).alias("p"))
    return joined.select(key, "paragraph_no", "line_no", F.array_join(F.col("p.bare"), " ").alias("text"))


def extract_claims(df: DataFrame, key: str, text: str = "text", gate: str = "verb") -> DataFrame:
    """``key, id, line_number, claim``: sentences that look like claims, with ids ``c01`` on in order of appearance.

    ``gate``: ``verb`` (a verb-shaped word), ``agnostic`` (length only) or ``content`` (words with letters).
    """
    passes = {"verb": T.looks_like_claim, "agnostic": T.agnostic_gate, "content": T.content_gate}[gate]
    parts = paragraphs(df, key, text).select(key, "line_no", F.posexplode(T.sentences("text")).alias("_s", "claim"))
    parts = parts.withColumn("claim", T.trim("claim")).filter(passes("claim"))
    by = Window.partitionBy(key)
    rank = F.row_number().over(by.orderBy("line_no", "_s"))
    total = F.count(F.lit(1)).over(by)
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return parts.select(key, F.concat(F.lit("c"), F.lpad(rank.cast("string"), width, F.lit("0"))).alias("id"), F.col("line_no").alias("line_number"), "claim")


def relocate(claims: DataFrame, documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds ``char_start, char_end`` of each extracted claim in its document (null where it is not found)."""
    joined = claims.join(documents.select(key, F.col(text).alias("_t")), key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema)
    names = list(claims.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = [], []
            for claim, line, t in zip(b.column("claim").to_pylist(), b.column("line_number").to_pylist(), b.column("_t").to_pylist()):
                anchor = sum(len(x) for x in t.splitlines(keepends=True)[: line - 1])
                s, e = K.relocate(t, claim, anchor)
                starts.append(None if s < 0 else s)
                ends.append(None if s < 0 else e)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*names, "char_start", "char_end"])

    return joined.select(*claims.columns, "_t").mapInArrow(run, f"{fields}, char_start int, char_end int")
