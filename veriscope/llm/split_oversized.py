"""p2: cutting oversized texts at natural boundaries with an overlap, in built-in SQL functions only.

One regular expression with bounded quantifiers consumes a text from its start to its end. Its alternatives are ordered
by the strength of the boundary: the rest of the text, a blank line, a sentence end, a line break, a blank, and any
character as the last resort. Each match (a *core*) is at most ``limit - overlap`` characters long and the cores, put
together, are the text. A piece is its core with up to ``overlap`` characters of the core before looked back on,
starting at a blank where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: White space that does not count at either end of a text.
EDGE = " \t\r\n"


def _pattern(core: int) -> str:
    least = max(1, core // 3)
    run = f".{{{least},{core}}}"
    return (
        rf"(?s).{{1,{core}}}\z"
        rf"|{run}(?<=\n[ \t]{{0,8}}\n)"
        rf"|{run}(?<=[.!?…؟।][\"'”’»)\]]{{0,3}}[ \t\n\r]{{1,2}})"
        rf"|{run}(?<=[。！？][”’」』）]{{0,3}})"
        rf"|{run}(?<=\n)"
        rf"|{run}(?<=[ \t 　])"
        rf"|.{{1,{core}}}"
    )


def cores(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the cores of a text."""
    return F.regexp_extract_all(text, F.lit(_pattern(limit - overlap)), F.lit(0))


def split_oversized(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``item_id, piece_no, n_pieces, piece, char_start, core_start, char_end`` of every row with a text.

    Offsets are 0-based code points of the stored text, end exclusive; ``piece`` is the text between ``char_start`` and
    ``char_end``, and ``core_start`` is where the part begins that the piece before does not hold. White space at
    either end of the whole text belongs to no piece. A text within the limit is one piece. Null, empty and blank texts
    give no piece. Rows are treated one by one: no shuffle, and a very long text costs time in proportion to its length.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")
    stored = F.col(text).cast("string")
    base = (
        df.select(F.col(key).alias("item_id"), stored.alias("_s"))
        .withColumn("_t", F.expr("trim(BOTH ' \\t\\r\\n' FROM _s)"))
        .filter(F.length("_t") > 0)
        .withColumn("_lead", F.length("_s") - F.length(F.expr("trim(LEADING ' \\t\\r\\n' FROM _s)")))
        .withColumn("_c", F.when(F.length("_t") <= limit, F.array("_t")).otherwise(cores(F.col("_t"), limit, overlap)))
        .withColumn("_ends", F.expr("aggregate(_c, array(0), (a, x) -> concat(a, array(element_at(a, -1) + length(x))))"))
    )
    pieces = base.select("item_id", "_lead", "_c", "_ends", F.size("_c").alias("n_pieces"), F.posexplode("_c").alias("piece_no", "_core"))
    tail = F.when(F.col("piece_no") > 0, F.expr(f"right(element_at(_c, piece_no), {overlap})" if overlap else "''")).otherwise("")
    # from the first blank on, unless that would leave nothing
    pieces = pieces.withColumn("_tail", tail).withColumn("_cut", F.regexp_extract("_tail", r"(?s)[ \t\r\n　]([^ \t\r\n　].*)\z", 1))
    back = F.when(F.length("_cut") > 0, F.col("_cut")).otherwise(F.col("_tail"))
    begin = F.expr("_lead + element_at(_ends, piece_no + 1)")
    return pieces.select(
        "item_id",
        "piece_no",
        "n_pieces",
        F.concat(back, "_core").alias("piece"),
        (begin - F.length(back)).alias("char_start"),
        begin.alias("core_start"),
        F.expr("_lead + element_at(_ends, piece_no + 2)").alias("char_end"),
    )


def oversized(pieces: DataFrame) -> DataFrame:
    """``item_id`` of the items that were cut, each once."""
    return pieces.filter("piece_no = 1").select("item_id").distinct()
