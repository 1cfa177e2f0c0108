"""p8: filling containers of fixed capacity with documents, by conflict-constrained best fit.

Documents are spread over blocks by a hash, so that each block has the same mixture of sizes, and each block is packed
by itself. Its open containers are ordered by what is left in them (the residual); each carries one bitmap of the
sources and clusters of copies in it. For a document the search goes to the smallest residual that holds it and on from
there to the next ones until a container without a conflict is found: the tightest compatible one. Where there is none,
a new container is opened. No two documents of one source and no two copies share a container.

Documents come in decreasing order of their size, weighted up by the share of the block's containers that their source
will fill: those that are hard to place come while there is still a choice. A cluster or source with more documents than
the block needs containers cannot be spread without containers beyond need. It is divided into as few parts as fit, and
the rule holds within each part. Blocks hold some thousands of documents whatever the size of the table, so what they
leave in their last containers is a fixed small share.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.tokenize_automaton import TOKENIZER, count_tokens
from veriscope.plans.shared import Workspace

CAPACITY = 2048
#: Documents aimed at in one block.
BLOCK = 6000
#: How much the share of the containers that a source fills adds to the weight of its documents.
HARDNESS = 0.5


class _Bins:
    """Open containers of a block, by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit r: some container has residual r
        self.masks: list[int] = []
        self.fill: list[int] = []

    def take(self, size: int, mask: int) -> int:
        """Container for a document: the tightest compatible one, else a new one."""
        b = self._find(size, mask)
        if b < 0:
            b = len(self.masks)
            self.masks.append(0)
            self.fill.append(0)
        self._put(b, size, mask)
        return b

    def _find(self, size: int, mask: int) -> int:
        """Successor search over the residuals; takes the container out of its place."""
        ahead = self.open >> size
        r = size
        while ahead:
            low = (ahead & -ahead).bit_length() - 1
            r += low
            for k, b in enumerate(self.at[r]):
                if not self.masks[b] & mask:
                    last = self.at[r].pop()
                    if k < len(self.at[r]):
                        self.at[r][k] = last
                    if not self.at[r]:
                        self.open ^= 1 << r
                    return b
            ahead >>= low + 1
            r += 1
        return -1

    def _put(self, b: int, size: int, mask: int) -> None:
        self.masks[b] |= mask
        self.fill[b] += size
        left = self.capacity - self.fill[b]
        if left:
            self.at[left].append(b)
            self.open |= 1 << left


def _parts(values: list, sizes: list[int], most: int) -> dict:
    """First bit, number of parts, and number of documents met, of each value that stands with more than one document."""
    counts = Counter(v for v, n in zip(values, sizes) if v is not None and n > 0)
    out, bit = {}, 0
    for v, c in sorted(counts.items(), key=lambda x: (-x[1], str(x[0]))):
        if c > 1:
            k = math.ceil(c / most)
            out[v] = [bit, k, 0, c / k / most]
            bit += k
    return out


def pack(rows: list[tuple[int, int, str | None, int | None]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """``(row, part, token_start, n_tokens, container, position)`` of rows ``(key, size, source, cluster)``.

    A document over the capacity gives full containers and a rest that is packed like a document. One without tokens
    needs no room and goes behind the last document of the first container.
    """
    pieces: list[tuple[int, int, int, int]] = []  # size, row, part, start
    for i, (_, n, _, _) in enumerate(rows):
        start = part = 0
        while n - start > capacity:
            pieces.append((capacity, i, part, start))
            start, part = start + capacity, part + 1
        pieces.append((n - start, i, part, start))
    need = max(1, math.ceil(sum(p[0] for p in pieces) / capacity))
    sizes = [r[1] for r in rows]
    sources, clusters = _parts([r[2] for r in rows], sizes, need), _parts([r[3] for r in rows], sizes, need)
    base = sum(x[1] for x in sources.values())
    masks, weights = [], []
    for _, n, source, cluster in rows:
        m, hard = 0, 0.0
        for table, value, first in ((sources, source, 0), (clusters, cluster, base)):
            x = table.get(value)
            if x is not None and n > 0:
                m |= 1 << (first + x[0] + x[2] % x[1])
                hard = max(hard, x[3])
                x[2] += 1
        masks.append(m)
        weights.append(1 + HARDNESS * hard)
    bins = _Bins(capacity)
    placed: list[list[int]] = []
    out = []
    for size, i, part, start in sorted(pieces, key=lambda p: (-p[0] * weights[p[1]], -p[0], rows[p[1]][0] is None, rows[p[1]][0] or 0, p[2])):
        if size == 0 and bins.masks:
            b = 0
        else:
            # a full container has room for no other document, so the pieces that fill one conflict with nothing
            b = bins.take(size, masks[i] if size < capacity else 0)
        while len(placed) <= b:
            placed.append([])
        placed[b].append(i)
        out.append((i, part, start, size, b, len(placed[b]) - 1))
    return out


_SCHEMA = "doc_id {kind}, part int, token_start int, n_tokens int, container bigint, position int"


def fill_containers(df: DataFrame, spark: SparkSession, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``<key>, part, token_start, n_tokens, container, position``: where the tokens of each document go.

    One row a document, or one a part for those over the capacity; null and empty texts have 0 tokens and a place all
    the same. Copies (texts equal but for case and white space) are kept apart. Null sources conflict with nothing.
    """
    work = Workspace(spark, "containers")
    bare = F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\s+", " "))
    rows = df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), F.when(F.length(bare) > 0, F.xxhash64(bare)).alias("c"), F.col(text).alias("t"))
    sized = work.save(count_tokens(rows, "t", tokenizer, ("k", "s", "c")), "sizes")
    blocks = max(1, round(sized.count() / BLOCK))
    kind = df.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        got = sorted(zip(table["k"].to_pylist(), table["n_tokens"].to_pylist(), table["s"].to_pylist(), table["c"].to_pylist()), key=str)
        out = pack(got, capacity)
        cols = list(zip(*out))
        base = block << 32
        return pa.table({"doc_id": pa.array([got[i][0] for i in cols[0]], table.schema.field("k").type), "part": pa.array(cols[1], pa.int32()), "token_start": pa.array(cols[2], pa.int32()), "n_tokens": pa.array(cols[3], pa.int32()), "container": pa.array([base + b for b in cols[4]], pa.int64()), "position": pa.array(cols[5], pa.int32())})

    # rows that repeat a key are dealt over the blocks too; few tables have any
    repeated = sized.groupBy("k").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    if blocks > 1 and not repeated.isEmpty():
        joined = sized.join(repeated.withColumnRenamed("k", "same"), F.col("k").eqNullSafe(F.col("same")), "left").drop("same")
        sized = work.save(joined.withColumn("salt", F.when(F.col("times") > 1, F.floor(F.rand(1) * blocks)).otherwise(0)).drop("times"), "dealt")
    else:
        sized = sized.withColumn("salt", F.lit(0))
    spread = sized.withColumn("block", F.pmod(F.pmod(F.xxhash64("k"), F.lit(blocks)) + F.col("salt"), F.lit(blocks)))
    return spread.drop("salt").groupBy("block").applyInArrow(run, _SCHEMA.format(kind=kind)).withColumnRenamed("doc_id", key)


def audit(documents: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """``documents, over_capacity, split_within_capacity, gaps, shared_sources``: one row that says what a packing keeps, none
    where nothing was placed.

    ``gaps`` are documents whose parts do not follow each other from token 0; ``shared_sources`` are containers with two
    documents of one source, of keys that are there once.
    """
    fill = placed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).agg(F.count_if(F.col("fill") > capacity).alias("over_capacity"))
    docs = placed.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    whole = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("split_within_capacity"), F.count_if(F.col("n") != F.col("end")).alias("gaps"))
    of = documents.filter(F.col(source).isNotNull()).select(key, F.col(source).alias("s"))
    met = placed.filter("n_tokens > 0").select(key, "container").distinct().join(of, key).groupBy("container", "s").count()
    shared = met.agg(F.count_if(F.col("count") > 1).alias("shared_sources"))
    return whole.crossJoin(fill).crossJoin(shared).filter("documents > 0")  # one row each
