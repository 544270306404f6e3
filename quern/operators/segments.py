"""A catalogue with its full-text index in immutable segments: adding, changing and deleting documents writes no more than the batch.

Tables below `root`, each partitioned by segment: `entries` (the catalogue's columns, tokens and their count, whether the row is a tombstone),
`postings` (sorted by term in runs), `grams` (runs of three characters of names and descriptions), `impacts` (a row for each term and block of rows: what the term can give there at most), `vectors` (where an embedder is
given), and `sealed`, one row a segment, written last: a segment without it isn't there for readers, so a writer that dies
leaves nothing but files that nobody reads. Of rows with one rowid the newest segment's counts.

Segments of similar size are merged into one that names those it replaces. A merge drops rows that newer segments have
replaced, and tombstones once nothing older is left. Whatever is made of tokens is made of a segment's entries in the tasks
that read them, so texts are split once and neither a load nor a merge shuffles postings. Names sort in the order of writing. A writer that may run again with the same
batch gives the segment its name, and writes the same files again; others get a name of their own.

The driver holds a row for each segment; everything else is read, joined and written by Spark."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import inverted, lexical
from quern.operators.dense import described
from quern.runtime import bounded, drop, written

#: So many neighbouring segments of one size class are merged; a class holds FAN times the documents of the one below.
FAN = 4
SEALED = "place bigint, documents bigint, replaces array<string>, live array<string>, total bigint, mean double, words boolean"
VECTORS = "id bigint, embedding array<double>"
#: Replaced or deleted rows that are sent to every task; where there are more, tables are joined by row.
MOST_DEAD = 300_000
#: Tokens of a file; and of one that is made smaller so that all cores have work.
FILE_TOKENS, LEAST_TOKENS = 4_000_000, 250_000


class Segments:
    """`columns`: the catalogue's schema, which has a rowid; `embed`: an embedder, whose vectors are kept too."""

    def __init__(self, spark: SparkSession, root: str, columns: str = schemas.CATALOGUE, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.columns, self.embed = spark, root.rstrip("/"), columns, embed
        self.schemas = {"entries": f"{columns}, length bigint, gone boolean, {inverted.WORDS}", "postings": inverted.POSTINGS, "impacts": lexical.IMPACTS, "grams": inverted.GRAMS, "vectors": VECTORS, "sealed": SEALED}

    def _read(self, table: str, names: list[str] | None = None) -> DataFrame:
        """A table, or some segments of it; empty where nothing has been written."""
        schema = f"{self.schemas[table]}, segment string"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return found if names is None else found.where(F.col("segment").isin(names))

    def _write(self, table: str, name: str, rows: DataFrame) -> None:
        out = rows.withColumn("segment", F.lit(name)).write.partitionBy("segment").mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(f"{self.root}/{table}")

    def sealed(self) -> list[Row]:
        """The live segments' rows, oldest first."""
        every = self._read("sealed").collect()  # a row a segment
        replaced = {x for r in every for x in r.replaces}
        return sorted((r for r in every if r.segment not in replaced), key=lambda r: r.segment)

    # reading
    def _owners(self, live: list[str]) -> DataFrame:
        """(rowid, segment, gone, length): where each row's newest version is."""
        rows = self._read("entries", live).select("rowid", "segment", "gone", "length")
        if len(live) <= 1:
            return rows
        return rows.groupBy("rowid").agg(F.max(F.struct("segment", "gone", "length")).alias("x")).select("rowid", "x.*")

    def _replaced(self, live: list[str]) -> DataFrame | None:
        """(rowid, segment) of entries that a newer segment has replaced or deleted; of one segment none."""
        return self._dead(live, self._owners(live).where("not gone")) if len(live) > 1 else None

    def _current(self, table: str, live: list[str], dead: DataFrame | None, key: str = "rowid") -> DataFrame:
        """A table's rows but for those of _replaced()."""
        rows = self._read(table, live)
        if dead is not None:
            rows = self._without(rows, dead, key)
        elif table == "entries":
            rows = rows.where("not gone")
        return rows.drop("segment")

    def _tokens(self, rows: list[Row]) -> DataFrame:
        """Entries of some segments with their tokens; those of a segment that was written before entries kept them are split again."""
        found = self._read("entries", [r.segment for r in rows])
        old = [r.segment for r in rows if not r.words]
        if not old:
            return found
        columns = [c for c in found.columns if c not in ("words", "length")]
        again = inverted.worded(lexical.tokened(self._read("entries", old), *columns), *columns)
        again = again.withColumn("length", F.when(F.col("gone"), F.lit(0)).otherwise(F.col("length")))
        return found.where(~F.col("segment").isin(old)).unionByName(again)

    def _dead(self, names: list[str], kept: DataFrame) -> DataFrame:
        """(rowid, segment) of entries of some segments that aren't among `kept`; written, since several tables leave them out."""
        rows = self._read("entries", names).select("rowid", "segment")
        return written(rows.join(kept.select("rowid", "segment"), ["rowid", "segment"], "left_anti"), "dead")

    @staticmethod
    def _without(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
        return rows.join(bounded(dead.select(F.col("rowid").alias(key), "segment"), MOST_DEAD), [key, "segment"], "left_anti")

    def _live(self) -> list[str]:
        return [r.segment for r in self.sealed()]

    def catalogue(self) -> DataFrame:
        live = self._live()
        return self._current("entries", live, self._replaced(live)).drop("gone", "length", "words")

    def _corpus(self, rows: list[Row], lengths: DataFrame) -> DataFrame:
        live = [r.segment for r in rows]
        known = [r for r in rows if sorted(r.live) == live]  # totals of just these segments; a writer at the same time may have left none
        return self.spark.createDataFrame([(known[-1].total, known[-1].mean)], lexical.CORPUS) if known else lexical.totals(lengths)

    def index(self) -> lexical.Index:
        """The index of one state, as lexical.search() takes it."""
        rows = self.sealed()
        live = [r.segment for r in rows]
        lengths = self._owners(live).where("not gone").select("rowid", "length")
        dead = self._replaced(live)
        return lexical.Index(self._current("postings", live, dead), lengths, self._corpus(rows, lengths), self._current("grams", live, dead), self._read("impacts", live).select("term").distinct())

    def counts(self, *columns: str) -> DataFrame:
        """(rowid, col, term, n, first_pos, length, columns of the catalogue, documents) of live rows: how often each term stands in a column of a row, and where first."""
        rows = self.sealed()
        live = [r.segment for r in rows]
        dead, tokens = self._replaced(live), self._tokens(rows).where("not gone")
        tokens = tokens if dead is None else self._without(tokens, dead, "rowid")
        corpus = self._corpus(rows, self._owners(live).where("not gone").select("rowid", "length"))
        return inverted.counts(tokens, *columns).crossJoin(F.broadcast(corpus.select(F.col("total").alias("documents"))))

    def vectors(self) -> DataFrame:
        live = self._live()
        return self._current("vectors", live, self._replaced(live), "id")

    def impacts(self) -> tuple[DataFrame, bool]:
        """Block bounds of all live segments, and whether they count live rows alone; bounds of replaced rows are bounds still.

        A term may have several bounds in one block: of some segments, or of rows that different tasks wrote."""
        live = self._live()
        return self._read("impacts", live).drop("segment"), len(live) <= 1

    # writing
    def _seal(self, name: str, place: int, replaces: list[str]) -> None:
        live = sorted({*self._live(), name} - set(replaces))
        documents = self._read("entries", [name]).count()
        total = lexical.totals(self._owners(live).where("not gone").select("rowid", "length")).first()
        self._write("sealed", name, self.spark.createDataFrame([(place, documents, replaces, live, total.total, total.mean, True)], SEALED).coalesce(1))

    def add(self, docs: DataFrame, gone: DataFrame | None = None, name: str | None = None) -> str:
        """Add or replace the rows of `docs` by rowid, and delete those of gone(rowid); returns the segment's name.

        Rows of one batch have different rowids. With a name that is there already the same segment is written again."""
        rows = self.sealed()
        place = int(name) if name else max([r.place for r in rows], default=-1) + 1
        name = f"{place:012d}" if name else f"{place:012d}-{uuid.uuid4().hex[:8]}"
        columns = [c.split()[0] for c in self.columns.split(", ")]
        entries = inverted.worded(lexical.tokened(docs, *columns), *columns).withColumn("gone", F.lit(False))
        if gone is not None:
            null = self.spark.createDataFrame([], self.schemas["entries"])
            entries = entries.unionByName(gone.select(F.col("rowid").cast("bigint"), F.lit(0).cast("bigint").alias("length"), F.lit(True).alias("gone")), allowMissingColumns=True).select(null.columns)
        self._write("entries", name, entries)
        self._invert(name)
        if self.embed:
            self._write("vectors", name, self.embed(described(docs)))
        self._seal(name, place, [])
        return name

    def _dealt(self, rows: DataFrame, lengths: DataFrame) -> DataFrame:
        """Entries in no more tasks than their tokens are worth a file each, so that merged segments have no more files than large ones."""
        tokens = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
        files = max(tokens // FILE_TOKENS, min(tokens // LEAST_TOKENS, self.spark.sparkContext.defaultParallelism)) + 1
        return rows.coalesce(files)

    def _invert(self, name: str) -> None:
        """Postings, bounds and grams of a segment, out of its entries."""
        rows = self._read("entries", [name]).where("not gone")
        rows = self._dealt(rows, rows)
        for table, made in (("postings", inverted.postings), ("impacts", inverted.impacts), ("grams", inverted.grams)):
            self._write(table, name, made(rows))

    def merge(self, fan: int = FAN) -> list[str]:
        """Merge runs of `fan` or more neighbouring segments of one size class, until there is none; returns new names."""
        made: list[str] = []
        while run := self._run(fan):
            made.append(self._merged(run))
        return made

    def _run(self, fan: int) -> list[Row]:
        rows, at = self.sealed(), 0
        size = lambda r: int(math.log(max(r.documents, 1), fan))
        while at < len(rows):
            end = at
            while end < len(rows) and size(rows[end]) == size(rows[at]):
                end += 1
            if end - at >= fan:
                return rows[at:end]
            at = end
        return []

    def _merged(self, run: list[Row]) -> str:
        live, chosen = self._live(), [r.segment for r in run]
        own = self._owners(live).where(F.col("segment").isin(chosen))
        if live[0] == chosen[0]:  # nothing older is left that tombstones could hide
            own = own.where("not gone")
        # the last one's place in the order; a merge of the same segments has the same name
        name = f"{chosen[-1]}+{uuid.uuid5(uuid.NAMESPACE_OID, ' '.join(chosen)).hex[:8]}"
        dead = self._dead(chosen, own)
        rows = self._without(self._tokens(run), dead, "rowid").drop("segment")
        self._write("entries", name, self._dealt(rows, self._read("entries", chosen)))
        self._invert(name)
        if self.embed:
            self._write("vectors", name, self._without(self._read("vectors", chosen), dead, "id").drop("segment"))
        drop(dead)
        self._seal(name, run[-1].place, chosen)
        return name
