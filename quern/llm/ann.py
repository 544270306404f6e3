"""Operator 1: approximate nearest neighbours by additive quantisation with exact reranking.

A vector is approximated by a sum of CODEBOOKS full-dimensional codewords, one of each codebook. Codebooks are fitted on a
bounded sample (SAMPLE vectors, the least by a hash of their id): k-means on residuals, then least squares over all
codebooks at once for the codes that beam search finds. Every vector is encoded by beam search and stored with its codes,
the ratio of its norm to its approximation's, and itself.

A scan compares all stored vectors with all queries: inner products with the approximation are sums of table lookups
(a query's products with all codewords), corrected by the stored norms. Of each batch of vectors the best one in SHORT by such scores, 2 *
NEAREST at least, are a query's shortlist there, whose inner products are worked out exactly, in double precision (of the original components,
summed in their order); a task hands on each query's NEAREST best by these. So the shortlist grows with the table and no list does. Queries go to
the tasks in blocks of QUERY_BLOCK, one block at a time: a block's answers are written before the next is sent. All pairs of queries
and vectors are scored, so the work grows with the product of the two.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than most.
Queries of another length than the vectors that take part have no answer. Ties go to the smaller id. A query that is stored several
times is asked once (the least of different vectors); candidates under the query's own id are skipped, and other ids stored
several times count once, by their best score. Empty tables give empty results. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import ship, written

CODEBOOKS, WORDS, BEAM, SAMPLE = 12, 256, 6, 20_000
SHORT, NEAREST = 20, 20
QUERY_BLOCK, AT_ONCE = 4096, 128


def _fine(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors with an id whose components are all finite, and not all zero."""
    sized = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return sized.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors that take part, and their length."""
    fine = _fine(vectors)
    length = fine.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = length.n if length else 0
    return fine.where(F.size("embedding") == n), n


def _matrix(column: pa.Array, n: int, kind=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, n)


def beam_codes(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each row of x: codebook by codebook, with the `beam` sums nearest to x kept."""
    n, m, words = len(x), len(books), books.shape[1]
    rest, cost, codes = x[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, m), np.uint8)
    for k, book in enumerate(books):
        b = rest.shape[1]
        new = (cost[:, :, None] - 2 * (rest.reshape(n * b, -1) @ book.T).reshape(n, b, words) + (book**2).sum(1)).reshape(n, -1)
        keep = min(beam if k < m - 1 else 1, new.shape[1])
        best = np.argpartition(new, keep - 1, axis=1)[:, :keep]
        rows = np.arange(n)[:, None]
        cost, word, parent = new[rows, best], best % words, best // words
        codes = codes[rows, parent]
        codes[:, :, k] = word
        rest = rest[rows, parent] - book[word]
    return codes[np.arange(n), cost.argmin(1)]


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, k]] for k, book in enumerate(books))


def fitted(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 2) -> np.ndarray:
    """Codebooks (codebooks, words, length) for a sample."""
    random, rest, books = np.random.default_rng(11), x.copy(), []
    for _ in range(codebooks):
        book = rest[random.choice(len(x), words, replace=len(x) < words)].copy()
        for _ in range(8):
            near = ((book**2).sum(1) - 2 * rest @ book.T).argmin(1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, near, rest)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book).astype(np.float32)
        books.append(book)
        rest = rest - book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
    books = np.stack(books)
    for _ in range(rounds):
        codes = np.concatenate([beam_codes(x[a : a + 1024], books, 4) for a in range(0, len(x), 1024)])
        at = codes.astype(np.int64) + np.arange(codebooks) * words
        gram = np.zeros((codebooks * words, codebooks * words), np.float32)
        for a in range(codebooks):
            for b in range(codebooks):
                np.add.at(gram, (at[:, a], at[:, b]), 1)
        right = np.zeros((codebooks * words, x.shape[1]), np.float32)
        for a in range(codebooks):
            np.add.at(right, at[:, a], x)
        ridge = 0.1 * np.eye(len(gram), dtype=np.float32)
        books = np.linalg.solve(gram + ridge, right + 0.1 * books.reshape(len(gram), -1)).astype(np.float32).reshape(books.shape)
    return books


def index(vectors: DataFrame, length: int) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, codes, scale, embedding) of every vector, written; and the codebooks."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    books = fitted(_matrix(sample, length))
    sent = spark.sparkContext.broadcast(books)
    kind = vectors.schema["embedding"].dataType.simpleString()

    def batches(it):
        for b in it:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1), length)
                codes = beam_codes(x, sent.value)
                norm = np.linalg.norm(decoded(codes, sent.value), axis=1)
                scale = np.linalg.norm(x, axis=1) / np.where(norm > 0, norm, 1)
                yield pa.record_batch([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), part.column(1)], names=["vec_id", "codes", "scale", "embedding"])

    return written(vectors.mapInArrow(batches, f"vec_id long, codes binary, scale float, embedding {kind}"), "index"), books


def _best(k: int, ids: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of the best scores in each row, each once by its best one; higher scores first, then smaller ids."""
    rows = np.arange(len(ids))[:, None]
    order = np.lexsort((-exact, ids), axis=1)
    ids, exact = ids[rows, order], exact[rows, order]
    exact[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    order = np.lexsort((ids, -exact), axis=1)[:, :k]
    return ids[rows, order], exact[rows, order]


def _searched(sent, length: int, k: int):
    def batches(it):
        asked, exact, tables = sent.value  # ids, vectors, products with all codewords
        top = [np.full((len(asked), k), np.iinfo(np.int64).max), np.full((len(asked), k), -np.inf)]
        for part in it:
            if not len(part):
                continue
            ids = part.column(0).to_numpy()
            codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
            scale, x = part.column(2).to_numpy(), _matrix(part.column(3), length, np.float64)
            # room for ids that are stored several times in this batch
            n = max(2 * k, -(-len(ids) // SHORT)) + len(ids) - len(np.unique(ids))
            n = min(n, len(ids))
            for a in range(0, len(asked), AT_ONCE):
                mine = slice(a, a + AT_ONCE)
                rough = np.zeros((len(asked[mine]), len(ids)), np.float32)
                for m in range(codes.shape[1]):
                    rough += tables[mine, m][:, codes[:, m]]
                rough *= scale
                own = asked[mine, None] == ids
                rough[own] = -np.inf
                chosen = np.argpartition(-rough, n - 1, axis=1)[:, :n]
                score = np.zeros(chosen.shape)
                for d in range(length):  # in the order of components
                    score += exact[mine, d, None] * x[chosen, d]
                score[np.take_along_axis(own, chosen, 1)] = -np.inf
                for kept, new in zip(top, _best(k, *(np.concatenate([t[mine], f], 1) for t, f in zip(top, (ids[chosen], score), strict=True))), strict=True):
                    kept[mine] = new
        row, col = np.nonzero(top[1] > -np.inf)
        for a in range(0, len(row), 100_000):
            r, c = row[a : a + 100_000], col[a : a + 100_000]
            yield pa.record_batch([pa.array(asked[r]), pa.array(top[0][r, c]), pa.array(top[1][r, c])], names=["query_id", "vec_id", "score"])

    return batches


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product for each row of queries(vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    vectors, length = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if not length or vectors.isEmpty():
        return spark.createDataFrame([], schema)
    stored, books = index(vectors, length)
    asked = _fine(queries).where(F.size("embedding") == length).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, out = 1 + asked.count() // QUERY_BLOCK, None
    for no in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == no).toArrow().combine_chunks()
        if not len(block):
            continue
        exact = _matrix(block.column(1).combine_chunks(), length, np.float64)
        tables = np.einsum("qd,mwd->qmw", exact.astype(np.float32), books, optimize=True).astype(np.float32)
        sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), exact, tables))
        found = written(stored.mapInArrow(_searched(sent, length, k), "query_id long, vec_id long, score double"), "lists")
        sent.destroy()
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
