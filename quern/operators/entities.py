"""Entity deduplication of names: normal form, entropy gate, MinHash with LSH bands, guards, Jaro-Winkler, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import entropy, is_prefix_pair, is_variant_pair, name_shingles, normal_name
from quern.functions.unicode import jaro_winkler, normal_name_exact
from quern.operators.components import components

# Permutations, bands of six rows, thresholds.
PERMUTATIONS, BANDS, ROWS = 128, 20, 6
LEAST_ENTROPY, MERGE = 2.5, 0.92


def minhash(shingles: Column, permutations: int = PERMUTATIONS) -> Column:
    """Signature: for each permutation i the least of the first four bytes of SHA-1 of i and the shingle, as a number.

    An empty set has the largest number throughout."""

    def value(i: Column, s: Column) -> Column:
        return F.conv(F.substring(F.sha1(F.concat(i.cast("string"), s)), 1, 8), 16, 10).cast("bigint")

    least = lambda i: F.coalesce(F.array_min(F.transform(shingles, lambda s: value(i, s))), F.lit(0xFFFFFFFF).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), least)


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def signatures(names: DataFrame, least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """(rowid, name, sig) of names that pass the entropy gate."""
    return names.where(entropy(F.col("name")) >= least_entropy).select("rowid", "name", minhash(name_shingles(F.col("name"))).alias("sig"))


def bands(signed: DataFrame) -> DataFrame:
    """(no, key, rowid): each signature's bands."""
    band = lambda i: F.struct(i.alias("no"), F.array_join(F.slice(F.col("sig"), i * ROWS + 1, F.lit(ROWS)).cast("array<string>"), ",").alias("key"))
    return signed.select("rowid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band")).select("band.no", "band.key", "rowid")


def lsh_candidates(signed: DataFrame) -> DataFrame:
    """(a, b): rowids that share a band, a < b."""
    found = bands(signed)
    other = found.withColumnRenamed("rowid", "b")
    return found.withColumnRenamed("rowid", "a").join(other, ["no", "key"]).where("a < b").select("a", "b").distinct()


def merge_pairs(names: DataFrame, least_entropy: float = LEAST_ENTROPY, merge: float = MERGE) -> DataFrame:
    """(a, b): rows of one entity, by equal normal names or by similar ones."""
    named = names.select("rowid", "name", normal_name_exact(F.col("name")).alias("norm"))
    first = named.withColumn("a", F.min("rowid").over(Window.partitionBy("norm")))
    equal = first.where("a < rowid").select("a", F.col("rowid").alias("b"))
    # rows of one name have one signature, and equal names are joined above
    alike = names.groupBy("name").agg(F.min("rowid").alias("rowid")).select("rowid", "name")
    near = lsh_candidates(signatures(alike, least_entropy))
    side = lambda x: named.select(F.col("rowid").alias(x), F.col("norm").alias(f"n{x}"))
    near = near.join(side("a"), "a").join(side("b"), "b")
    guarded = ~is_variant_pair(F.col("na"), F.col("nb")) & ~is_prefix_pair(F.col("na"), F.col("nb"))
    return equal.unionByName(near.where(guarded & (jaro_winkler(F.col("na"), F.col("nb")) >= merge)).select("a", "b")).distinct()


def survivors(names: DataFrame, least_entropy: float = LEAST_ENTROPY, merge: float = MERGE) -> DataFrame:
    """`names` with survivor: the least rowid of the row's entity; the row that is its own survivor stays."""
    found = components(merge_pairs(names, least_entropy, merge))
    return names.join(found, names.rowid == found.node, "left").select(*[names[c] for c in names.columns], F.coalesce("component", names.rowid).alias("survivor"))


def groups(names: DataFrame, **limits: float) -> DataFrame:
    """(survivor, kept, removed): entities of more than one row, with the name that stays and the names that go, in order of rowid."""
    found = survivors(names, **limits)
    return found.groupBy("survivor").agg(
        F.min_by("name", "rowid").alias("kept"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rowid") != F.col("survivor"), F.struct("rowid", "name")))), lambda x: x["name"]).alias("removed")
    ).where("size(removed) > 0")


def deduplicated(catalogue: DataFrame, **limits: float) -> DataFrame:
    """The catalogue without merged rows; dependent tables drop the others by an anti join on name."""
    return survivors(catalogue, **limits).where("rowid = survivor").drop("survivor")
