"""The best rows of any-word queries without scoring every posting: block bounds, two passes.

An index keeps for each term and block of rows the most that the term can give there (lexical.impacts). A query's bound in a block is
the sum of its phrases' bounds. The best blocks of each query are scored first; the k-th best score found there is what a block's
bound has to reach, and only blocks that do are read then. The result is that of scoring everything.

A phrase of several tokens is bounded by its rarest token; how many rows hold it is counted, since that follows from no bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import index_tokens
from quern.operators import lexical
from quern.runtime import bounded, written

#: The first pass takes blocks whose rows are at least so many times top_k by their bounds' counts.
FIRST = 2
#: Scores are compared at this precision, ties by rowid.
DIGITS = 6


def _tokens(phrases: DataFrame) -> DataFrame:
    """(text, m, term) of distinct phrases."""
    each = phrases.select("text").distinct().withColumn("tokens", index_tokens(F.col("text")))
    return each.select("text", F.size("tokens").alias("m"), F.explode(F.array_distinct("tokens")).alias("term"))


def frequencies(phrases: DataFrame, postings: DataFrame, impacts: DataFrame | None) -> DataFrame:
    """(text, prefix, n): how many rows hold each phrase; of one token from the bounds' counts where there are any."""
    tokens = _tokens(phrases)
    if impacts is None:
        return lexical.frequencies(lexical.phrase_counts(phrases, postings))
    several = phrases.join(tokens.where("m > 1").select("text").distinct(), "text", "left_semi")
    counted = lexical.frequencies(lexical.phrase_counts(several, postings))
    single = bounded(tokens.where("m = 1")).join(impacts, "term").groupBy("text").agg(F.sum("n").alias("n"))
    return counted.unionByName(single.select("text", F.lit(False).alias("prefix"), "n"))


def bounds(phrases: DataFrame, impacts: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, block, bound, rows): what a query can get in a block at most, and how many rows its widest phrase has there at least."""
    tokens = bounded(_tokens(phrases))
    each = impacts.join(tokens, "term").groupBy("text", "term", "block").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.max("n").alias("n"))
    phrase = each.groupBy("text", "block").agg(F.min("most").alias("f"), F.max("least").alias("length"), F.min("n").alias("n"), F.count("*").alias("met"))
    need = tokens.groupBy("text").agg(F.count("*").alias("wanted"))
    part = phrase.join(need, "text").where("met = wanted").join(weights, "text").withColumn("part", lexical.contribution(F.col("f"), F.col("length")))
    return part.join(bounded(phrases.select("qid", "text")), "text").groupBy("qid", "block").agg(F.sum("part").alias("bound"), F.max("n").alias("rows"))


def search(phrases: DataFrame, index: lexical.Index, impacts: DataFrame, top_k: int = 10, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(qid, rank, rowid, bm25) of phrases(qid, strategy, every, no, text, prefix) of an any-word strategy, and (qid, blocks, read).

    `exact`: the impacts count live rows alone. Where some have been replaced since, phrases are counted in the postings."""
    corpus = lexical.totals(index.lengths) if index.corpus is None else index.corpus
    df = written(frequencies(phrases, index.postings, impacts if exact else None), "frequencies")
    weights = lexical.weighed(df, corpus).drop("prefix")
    found = written(bounds(phrases, impacts, weights), "bounds")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = found.withColumn("before", before).where(F.col("before") < FIRST * top_k).select("qid", "block")

    def scored(blocks: DataFrame) -> DataFrame:
        """Scores of the queries' own blocks; the rows of others don't reach the scoring."""
        blocks = written(blocks, "blocks")
        ends = blocks.agg(F.min("block").alias("low"), F.max("block").alias("high")).first()
        near = index.postings.where(F.lit(False)) if ends.low is None else index.postings.where(F.col("rowid").between(ends.low * lexical.BLOCK_ROWS, (ends.high + 1) * lexical.BLOCK_ROWS))
        part = near.withColumn("block", lexical.block(F.col("rowid"))).join(bounded(blocks.select("block").distinct()), "block", "left_semi").drop("block")
        rows = lexical.bm25(phrases, part, index.lengths, corpus, df, index.terms).withColumn("block", lexical.block(F.col("rowid")))
        return rows.join(blocks, ["qid", "block"], "left_semi").select("qid", "rowid", "block", F.round("bm25", DIGITS).alias("bm25"))

    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "rowid"))
    # a lower bound of each query's k-th best score; of fewer rows than top_k none
    known = written(scored(first), "first")
    least = known.withColumn("place", place).where(F.col("place") == top_k).select("qid", F.col("bm25").alias("least"))
    second = found.join(least, "qid", "left").where(F.col("least").isNull() | (F.round("bound", DIGITS) + 10.0**-DIGITS >= F.col("least"))).select("qid", "block")
    rest = second.join(first, ["qid", "block"], "left_anti")
    every = known.unionByName(scored(rest)).withColumn("rank", place).where(F.col("rank") <= top_k).select("qid", "rank", "rowid", "bm25")
    read = first.unionByName(rest).groupBy("qid").agg(F.count("*").alias("read"))
    report = found.groupBy("qid").agg(F.count("*").alias("blocks")).join(read, "qid")
    return every, report
