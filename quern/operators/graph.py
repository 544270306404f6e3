"""Similarity graph: five edge builders, neighbours, personalized PageRank, statistics.

Builders return pairs (src, dst, weight, edge_type) with src < dst; both_ways() gives the graph of directed edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import text_shingles
from quern.runtime import bounded, written

# Weights and limits of the builders.
CATEGORY, TAGS, FEEDBACK, LEAST_TEXT, PARENT, GRANDPARENT = 0.3, 0.4, 0.1, 0.3, 0.4, 0.2
DAMPING, MOST_ROUNDS, TOLERANCE = 0.85, 20, 1e-6
#: Names that go to the reader of edges as a filter.
FEW = 500
#: Names of a folder that a task holds while others pass by, and how many tasks the pairs are dealt to at most.
FOLDER_BLOCK, MOST_TASKS = 1000, 10_000


def both_ways(pairs: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type"))


def cooccurrence_edges(uses: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of names used in one session, from uses(session_id, skill_name).

    Uses are counted by session and name first, so a pair's count is a sum of products and a hot name costs one row a session."""
    n = uses.groupBy("session_id", "skill_name").agg(F.count("*").alias("n"))
    a, b = (n.select("session_id", F.col("skill_name").alias(x), F.col("n").alias(f"n{x}")) for x in ("src", "dst"))
    pairs = a.join(b, "session_id").where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("nsrc") * F.col("ndst")).alias("n"))
    marginal = pairs.select(F.explode(F.array("src", "dst")).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("m"))
    total = pairs.agg(F.sum("n").alias("total"))
    p = pairs.join(marginal.select(F.col("name").alias("src"), F.col("m").alias("ms")), "src").join(marginal.select(F.col("name").alias("dst"), F.col("m").alias("md")), "dst").crossJoin(F.broadcast(total))
    t = F.col("total")
    score = F.log2((F.col("n") / t) / ((F.col("ms") / t) * (F.col("md") / t) + 1e-10))
    return p.select("src", "dst", F.round(F.greatest(F.lit(0.0), score), 4).alias("weight"), F.lit("co_occur").alias("edge_type"), score.alias("_s")).where("_s > 0").drop("_s")


def content_edges(docs: DataFrame) -> DataFrame:
    """Shared category and similar tags, from docs(name, category, tags): found by equi-joins on either, never by all pairs."""
    d = docs.select("name", "category", F.array_distinct("tags").alias("tags"))
    real = d.where("category is not null and category not in ('uncategorized', '')")
    pair = lambda x, key: x.select(F.col("name").alias("src"), key).join(x.select(F.col("name").alias("dst"), key), key).where("src < dst").select("src", "dst")
    tag = d.select("name", F.explode("tags").alias("tag"))
    found = pair(real, "category").union(pair(tag, "tag")).distinct()
    side = lambda x: d.select(F.col("name").alias(x), F.col("category").alias(f"c_{x}"), F.col("tags").alias(f"t_{x}"))
    both = found.join(side("src"), "src").join(side("dst"), "dst")
    same = (F.col("c_src") == F.col("c_dst")) & ~F.col("c_src").isin("uncategorized", "")
    tags = F.coalesce(F.try_divide(F.size(F.array_intersect("t_src", "t_dst")), F.size(F.array_union("t_src", "t_dst"))), F.lit(0.0))
    weight = F.when(same, F.lit(CATEGORY)).otherwise(F.lit(0.0)) + TAGS * tags
    return both.select("src", "dst", F.round(weight, 4).alias("weight"), F.lit("content").alias("edge_type")).where("weight > 0")


def feedback_edges(weights: DataFrame) -> DataFrame:
    """Names of better than average success, from weights(skill_name, successes, failures): all pairs of that selection."""
    rated = weights.where("successes + failures > 0").select(F.col("skill_name").alias("name"), (F.col("successes") / (F.col("successes") + F.col("failures"))).alias("rate"))
    good = rated.crossJoin(F.broadcast(rated.agg(F.avg("rate").alias("mean"), F.count("*").alias("n")))).where("n >= 2 and rate > mean").select("name", "rate")
    a, b = (good.select(F.col("name").alias(x), F.col("rate").alias(f"r_{x}")) for x in ("src", "dst"))
    return a.join(b, F.col("src") < F.col("dst")).select("src", "dst", F.round(FEEDBACK * (F.col("r_src") + F.col("r_dst")) / 2, 4).alias("weight"), F.lit("feedback").alias("edge_type"))


def text_edges(docs: DataFrame, least: float = LEAST_TEXT) -> DataFrame:
    """Jaccard similarity of character shingles of name and description.

    Names that are similar enough share one of their rarest shingles: of n, all but the ceil(least n) - 1 most frequent ones. Those
    alone are joined, so shingles that nearly all names have bring no pairs; whole sets decide."""
    s = written(docs.select("name", text_shingles(F.col("name"), F.col("description")).alias("s")).withColumn("n", F.size("s")), "shingles")
    each = s.select("name", "n", F.explode("s").alias("shingle"))
    often = written(each.groupBy("shingle").agg(F.count("*").alias("often")), "shingle-counts")
    place = F.row_number().over(Window.partitionBy("name").orderBy("often", "shingle"))
    rare = written(each.join(often, "shingle").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n")) + 1).select("name", "n", "shingle"), "rare-shingles")
    a, b = (rare.select("shingle", F.col("name").alias(x), F.col("n").alias(f"n_{x}")) for x in ("src", "dst"))
    pairs = a.join(b, "shingle").where(f"src < dst and least(n_src, n_dst) >= {least} * greatest(n_src, n_dst)").select("src", "dst").distinct()
    side = lambda x: s.select(F.col("name").alias(x), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    weight = F.size(F.array_intersect("s_src", "s_dst")) / F.size(F.array_union("s_src", "s_dst"))
    return both.select("src", "dst", weight.alias("w")).where(F.col("w") >= least).select("src", "dst", F.round("w", 4).alias("weight"), F.lit("text_overlap").alias("edge_type"))


def path_edges(paths: DataFrame, others: DataFrame) -> DataFrame:
    """Same parent folder, else same grandparent, from paths(name, path), unless other edges say as much.

    A parent edge gives way to a co-occurrence or text edge of PARENT or more, a grandparent edge to any edge. Names of one path
    make each of their pairs once, so these are neither shuffled nor held; only pairs with a name of several paths are told apart."""
    parts = paths.where("name is not null and path is not null and path <> ''").select("name", F.regexp_replace("path", "/[^/]*$", "").alias("parent"))
    parts = parts.withColumn("grand", F.regexp_replace("parent", "/[^/]*$", "")).distinct()
    ordered = written(others.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("edge_type").isin("co_occur", "text_overlap") & (F.col("weight") >= PARENT)).alias("strong")), "others")
    met = ordered.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("met", F.lit(True))
    places = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("parent", "grand"))).alias("at")).join(bounded(met), "name", "left")
    places = written(places.select("name", (F.size("at") > 1).alias("many"), F.coalesce("met", F.lit(False)).alias("met"), F.explode("at").alias("at")).select("name", "many", "met", "at.*"), "folders")
    strong, known = (bounded(x.select("src", "dst").distinct()) for x in (ordered.where("strong"), ordered))
    some, several = not places.where("met").isEmpty(), not places.where("many").isEmpty()

    def found(key: str, but: DataFrame) -> DataFrame:
        """Pairs without those of other edges; only pairs of names that both have such edges are looked up."""
        out = _together(places, key)
        if not some:
            return out
        pair = ["src", "dst"]
        return out.where("not met").unionByName(_together(places.where("met"), key).join(but, pair, "left_anti"))

    near, far = found("parent", strong), found("grand", known).where("not together")
    if several:
        again = lambda x: x.where("many").select("src", "dst").distinct()
        shared = again(_together(places, "parent"))
        near, far = near.where("not many").select("src", "dst").unionByName(again(near)), far.where("not many").select("src", "dst").unionByName(again(far).join(shared, ["src", "dst"], "left_anti"))
    edge = lambda x, w: x.select("src", "dst", F.lit(w).alias("weight"), F.lit("path_shared").alias("edge_type"))
    return edge(near, PARENT).unionByName(edge(far, GRANDPARENT))


def _together(places: DataFrame, key: str) -> DataFrame:
    """(src, dst, many, met, together) of names in one folder: whether one of them has several places, both have other edges, both one parent here.

    A folder's names are dealt to blocks of about FOLDER_BLOCK. Each block meets itself and those after it in a task of its own, which holds
    one block and streams the others, so a large folder is neither one task's work nor held in one."""
    here = places.where(F.col(key) != "").select(F.col(key).alias("key"), "name", "many", "met", "parent").distinct()
    sizes = here.groupBy("key").agg(F.ceil(F.count("*") / FOLDER_BLOCK).cast("int").alias("blocks"))
    cells = int(sizes.agg(F.sum(F.when(F.col("blocks") > 1, F.col("blocks")).otherwise(0))).first()[0] or 0)
    tasks = min(max(2 * cells, here.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
    dealt = here.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    side = lambda x, block: dealt.select("key", block.alias("cell"), *[F.col(c).alias(f"{c}_{x}") for c in ("name", "many", "met", "parent", "block")]).repartition(tasks, "key", "cell")
    held, streamed = side("a", F.col("block")), side("b", F.explode(F.sequence(F.lit(0), F.col("block"))))
    both = streamed.join(held.hint("shuffle_hash"), ["key", "cell"]).where("block_b > block_a or name_a < name_b")
    return both.select(F.least("name_a", "name_b").alias("src"), F.greatest("name_a", "name_b").alias("dst"), (F.col("many_a") | F.col("many_b")).alias("many"), (F.col("met_a") & F.col("met_b")).alias("met"), (F.col("parent_a") == F.col("parent_b")).alias("together"))


def neighbors(edges: DataFrame, name: str, edge_types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """A node's edges, strongest first."""
    out = edges.where(F.col("src") == name)
    if edge_types:
        out = out.where(F.col("edge_type").isin(edge_types))
    return out.orderBy(F.desc("weight"), "dst", "edge_type").limit(limit).select(F.col("dst").alias("name"), "weight", "edge_type")


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, every: int = 5) -> DataFrame:
    """(name, score): personalized PageRank from seeds(name), started at zero, for a fixed number of rounds or until no score moves.

    Out-weights are normalised once; a round is one join and one sum. Every few rounds the scores are written, which cuts
    the lineage and is when the stop is looked for."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = written(edges.join(out, "src").where("out > 0").groupBy("src", "dst").agg((F.sum("weight") / F.first("out")).alias("share")), "share")
    nodes = share.select(F.col("src").alias("name")).union(share.select("dst")).distinct()
    known = seeds.select("name").distinct().join(nodes, "name", "left_semi")
    teleport = nodes.join(known.withColumn("seed", F.lit(1.0)), "name", "left").crossJoin(F.broadcast(known.agg(F.count("*").alias("n"))))
    teleport = written(teleport.where("n > 0").select("name", ((1 - damping) * F.coalesce("seed", F.lit(0.0)) / F.col("n")).alias("t")), "teleport")
    score = teleport.select("name", F.lit(0.0).alias("score"))
    for k in range(1, rounds + 1):
        moved = share.join(score, share.src == score.name).groupBy(F.col("dst").alias("name")).agg((damping * F.sum(F.col("share") * F.col("score"))).alias("in"))
        new = teleport.join(moved, "name", "left").select("name", (F.col("t") + F.coalesce("in", F.lit(0.0))).alias("score"))
        if k % every == 0:
            new = written(new, "scores")
            before, score = score, new
            if new.join(before.withColumnRenamed("score", "old"), "name").where(F.abs(F.col("score") - F.col("old")) >= tolerance).isEmpty():
                break
        else:
            score = new
    return score


def graph_stats(edges: DataFrame) -> DataFrame:
    """(metric, value): nodes, undirected edges, and directed edges by type."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.count_distinct("n").alias("value")).select(F.lit("nodes").alias("metric"), "value")
    total = edges.agg(F.expr("count(*) div 2").alias("value")).select(F.lit("edges").alias("metric"), "value")
    types = edges.groupBy(F.concat(F.lit("type:"), "edge_type").alias("metric")).agg(F.count("*").alias("value"))
    return nodes.unionByName(total).unionByName(types)

