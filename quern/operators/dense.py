"""Dense retrieval: exact cosine top-k for a batch of query vectors, and vectors of texts.

Texts become vectors through an embedder: a function from (id, text) to (id, embedding). The one here counts tokens in hashed
dimensions; a model can take its place."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import index_tokens
from quern.runtime import ship, spread, stored, written

#: Query vectors that one scan compares with; more go block by block.
MOST_QUERIES = 4096
#: Rows that meet a block of queries at once, and what two ways of adding up one score differ by at most.
AT_ONCE, MARGIN = 256, 1e-9
#: Dimensions of hashed token counts.
DIMENSIONS = 64

Embedder = Callable[[DataFrame], DataFrame]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dimension(token: Column) -> Column:
    """The dimension that a token counts in: the first sixteen bits of its SHA-1."""
    return F.conv(F.substring(F.sha1(token), 1, 4), 16, 10).cast("int") % DIMENSIONS


def hashed(texts: DataFrame) -> DataFrame:
    """(id, embedding): how often tokens of (id, text) fall in each dimension; texts without tokens have no vector."""
    tokens = texts.select("id", F.explode(index_tokens(F.col("text"))).alias("token"))
    counts = tokens.groupBy("id", dimension(F.col("token")).alias("d")).agg(F.count("*").cast("double").alias("n"))
    by_dimension = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"))  # DIMENSIONS entries at most
    return by_dimension.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("embedding"))


def described(docs: DataFrame) -> DataFrame:
    """What a catalogue's vectors are made of."""
    return docs.select(F.col("rowid").alias("id"), F.concat_ws(" ", "name", "description").alias("text"))


def vectors(docs: DataFrame, embed: Embedder = hashed) -> DataFrame:
    """(id, embedding) of a catalogue, kept in the shared folder until its files change."""
    return stored(docs.sparkSession, f"vectors-{embed.__module__}.{embed.__qualname__}", docs, lambda: embed(described(spread(docs))))


def _near(sent, top_k: int):
    """Pairs that can be among a query's top_k of this task by scores from matrix products; those that have no such score all stay."""

    def pairs(batches):
        q, odd = sent.value
        qn, best = np.sqrt((q * q).sum(axis=1)), np.full((len(q), top_k), -np.inf)
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                part = b.slice(at, AT_ONCE)
                lists = part.column(1)
                whole = np.array([x is not None and len(x) == q.shape[1] and None not in x for x in lists.to_pylist()]) if lists.null_count or lists.flatten().null_count or len(lists.flatten()) != len(lists) * q.shape[1] else np.ones(len(lists), bool)
                v = np.zeros((len(lists), q.shape[1]))
                v[whole] = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                with np.errstate(all="ignore"):
                    score = v @ q.T / (np.sqrt((v * v).sum(axis=1))[:, None] * qn + 1e-10)
                score[~whole], score[:, odd] = np.nan, np.nan
                real = np.where(np.isfinite(score), score, -np.inf)
                better = np.flatnonzero((real > best.min(axis=1)).any(axis=0))
                best[better] = np.partition(np.concatenate([best[better], real[:, better].T], axis=1), -top_k, axis=1)[:, -top_k:]
                row, query = np.nonzero(~np.isfinite(score) | (score >= best.min(axis=1) - MARGIN))
                for k in range(0, len(row), 4096):
                    some = pa.array(row[k : k + 4096])
                    yield pa.record_batch([part.column(0).take(some), lists.take(some), pa.array(query[k : k + 4096], pa.int32())], names=["id", "v", "no"])

    return pairs


def cosine_topk(queries: DataFrame, vectors: DataFrame, top_k: int = 20) -> DataFrame:
    """(qid, rank, id, score) for queries(qid, embedding) and vectors(id, embedding); score = q.v / (|q| |v| + 1e-10).

    Queries meet all rows in blocks of MOST_QUERIES, one alive at a time. A task leaves out pairs that are below top_k others of its own by more
    than matrix products can err; the rest is scored exactly, in order of dimension, and cut before the shuffle."""
    spark = vectors.sparkSession
    ship(spark)
    blocks = -(-queries.count() // MOST_QUERIES)
    v = spread(vectors.select("id", F.col("embedding").cast("array<double>").alias("v")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    norm = lambda x: F.sqrt(dot(F.col(x), F.col(x)))

    def found(asked: DataFrame) -> DataFrame:
        block = asked.select("qid", F.col("embedding").cast("array<double>").alias("q")).toArrow().combine_chunks()
        lists = block.column("q").to_pylist()
        width = max((len(x) for x in lists if x), default=1)
        whole = np.array([x is not None and len(x) == width and None not in x for x in lists], bool)
        q = np.array([x if ok else [0.0] * width for x, ok in zip(lists, whole, strict=True)], np.float64).reshape(-1, width)
        numbered = spark.createDataFrame(block.append_column("no", pa.array(np.arange(len(q)), pa.int32())))
        sent = spark.sparkContext.broadcast((q, ~whole))
        kind = vectors.schema["id"].dataType.simpleString()
        near = v.mapInArrow(_near(sent, top_k), f"id {kind}, v array<double>, no int").join(F.broadcast(numbered), "no")
        scored = near.select("qid", "id", (dot(F.col("q"), F.col("v")) / (norm("q") * norm("v") + 1e-10)).alias("score"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("qid", "rank", "id", "score")

    if blocks <= 1:
        return found(queries)
    parts = [written(found(queries.where(F.pmod(F.xxhash64("qid"), F.lit(2 * blocks)) == k)), "nearest") for k in range(2 * blocks)]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def search(queries: DataFrame, docs: DataFrame, top_k: int = 20, embed: Embedder = hashed, index: DataFrame | None = None) -> DataFrame:
    """(qid, rank, rowid, name, score, method): the rows of most similar vectors for queries(qid, query), similar at all."""
    asked = embed(queries.select(F.col("qid").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "qid")
    found = cosine_topk(asked, vectors(docs, embed) if index is None else index, top_k).where("score > 0")
    named = found.join(docs.select(F.col("rowid").alias("id"), "name"), "id")
    return named.select("qid", "rank", F.col("id").alias("rowid"), "name", F.round("score", 4).alias("score"), F.lit("embed").alias("method"))
