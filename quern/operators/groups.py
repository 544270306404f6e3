"""The similarity graph with groups kept as groups: a category of n names is n rows, not n squared.

`members`: (grp, name, h, edge_type): every two names of a group have an edge of weight h + h' (half of a category's weight each; a
twentieth of each one's success rate for feedback). `pairs`: (src, dst, weight, edge_type, n), src < dst: edges of their own (n = 1), or what is added to
an edge that a group gives (n = 0: only its weight changes). Statistics, neighbours and PageRank work on sums by group, so no step makes
a group's pairs: what comes to v from group g is sum(h q) + h_v sum(q) - 2 h_v q_v, where q_u is what u gives for a unit of weight.

Names that share a tag differ in how many they share, so those stay pairs, found by an equi-join on tags. Feedback weights aren't rounded
here, where graph.feedback_edges() rounds each to four digits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import graph
from quern.runtime import bounded, written

MEMBERS = "grp string, name string, h double, edge_type string"
PAIRS = "src string, dst string, weight double, edge_type string, n int"


class Groups(NamedTuple):
    members: DataFrame
    pairs: DataFrame


def of_pairs(pairs: DataFrame) -> Groups:
    """Edges that stand for themselves."""
    none = pairs.sparkSession.createDataFrame([], MEMBERS)
    return Groups(none, pairs.select("src", "dst", F.col("weight").cast("double"), "edge_type", F.lit(1).alias("n")))


def content(docs: DataFrame) -> Groups:
    """graph.content_edges() as categories, and pairs of names that share a tag."""
    d = docs.select("name", "category", F.array_distinct("tags").alias("tags"))
    real = F.coalesce(~F.col("category").isin("uncategorized", ""), F.lit(False))
    members = d.where(real).select(F.col("category").alias("grp"), "name", F.lit(graph.CATEGORY / 2).alias("h"), F.lit("content").alias("edge_type"))
    side = lambda x: d.select(F.explode("tags").alias("tag"), F.col("name").alias(x), F.when(real, F.col("category")).alias(f"c_{x}"), F.col("tags").alias(f"t_{x}"))
    both = side("src").join(side("dst"), "tag").where("src < dst").drop("tag").dropDuplicates(["src", "dst"])
    same = F.coalesce(F.col("c_src") == F.col("c_dst"), F.lit(False))
    tags = F.size(F.array_intersect("t_src", "t_dst")) / F.size(F.array_union("t_src", "t_dst"))
    own = F.when(same, F.lit(graph.CATEGORY)).otherwise(F.lit(0.0))
    pairs = both.select("src", "dst", (F.round(own + graph.TAGS * tags, 4) - own).alias("weight"), F.lit("content").alias("edge_type"), F.when(same, F.lit(0)).otherwise(F.lit(1)).alias("n"))
    return Groups(members, pairs)


def feedback(weights: DataFrame) -> Groups:
    """graph.feedback_edges() as one group: the names of better than average success."""
    rated = weights.where("successes + failures > 0").select(F.col("skill_name").alias("name"), (F.col("successes") / (F.col("successes") + F.col("failures"))).alias("rate"))
    good = rated.crossJoin(F.broadcast(rated.agg(F.avg("rate").alias("mean"), F.count("*").alias("n")))).where("n >= 2 and rate > mean")  # one row
    members = good.select(F.lit("better").alias("grp"), "name", (F.col("rate") * graph.FEEDBACK / 2).alias("h"), F.lit("feedback").alias("edge_type"))
    return Groups(members, weights.sparkSession.createDataFrame([], PAIRS))


def folders(paths: DataFrame) -> Groups:
    """graph.path_edges() where no other edges stand: a folder's names, and those of its parent folder."""
    parts = paths.where("path is not null and path <> ''").select("name", F.regexp_replace("path", "/[^/]*$", "").alias("parent")).distinct()
    parts = parts.withColumn("grand", F.regexp_replace("parent", "/[^/]*$", "")).where("parent <> ''")
    kind = F.lit("path_shared").alias("edge_type")
    # names of one folder have an edge by their parent folder too: the folder only adds to that
    far = parts.where("grand <> ''").select(F.concat(F.lit("far:"), "grand").alias("grp"), "name", F.lit(graph.GRANDPARENT / 2).alias("h"), kind)
    more = F.when(F.col("grand") != "", F.lit(graph.PARENT - graph.GRANDPARENT)).otherwise(F.lit(graph.PARENT))
    near = parts.select(F.concat(F.when(F.col("grand") != "", F.lit("more:")).otherwise(F.lit("near:")), "parent").alias("grp"), "name", (more / 2).alias("h"), kind)
    return Groups(far.unionByName(near), paths.sparkSession.createDataFrame([], PAIRS))


def united(*graphs: Groups) -> Groups:
    """One graph of several, written: later steps read it again and again. Groups of different kinds stay apart."""
    members, pairs = graphs[0]
    for g in graphs[1:]:
        members, pairs = members.unionByName(g.members), pairs.unionByName(g.pairs)
    return Groups(written(members.withColumn("grp", F.concat_ws("/", "edge_type", "grp")), "members"), written(pairs, "pairs"))


def _adds() -> Column:
    """Whether a group's edges are edges of their own, or only add weight to another group's."""
    return F.when(F.col("grp").contains("/more:"), F.lit(0)).otherwise(F.lit(1))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type", "n"))


def degrees(g: Groups) -> DataFrame:
    """(name, edge_type, edges, out): how many edges a name has of each type, and their weight."""
    sizes = g.members.groupBy("grp").agg(F.count("*").alias("size"), F.sum("h").alias("sum"))
    here = g.members.join(sizes, "grp").where("size > 1").select("name", "edge_type", ((F.col("size") - 1) * _adds()).alias("edges"), ((F.col("size") - 2) * F.col("h") + F.col("sum")).alias("out"))
    own = _both(g.pairs).select(F.col("src").alias("name"), "edge_type", F.col("n").cast("bigint").alias("edges"), F.col("weight").alias("out"))
    return here.unionByName(own).groupBy("name", "edge_type").agg(F.sum("edges").alias("edges"), F.sum("out").alias("out")).where("edges > 0")


def stats(g: Groups) -> DataFrame:
    """graph.graph_stats(): nodes, undirected edges, directed edges by type."""
    d = degrees(g)
    nodes = d.select("name").distinct().agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), "value")
    total = d.agg(F.expr("coalesce(sum(edges), 0) div 2").alias("value")).select(F.lit("edges").alias("metric"), "value")
    return nodes.unionByName(total).unionByName(d.groupBy(F.concat(F.lit("type:"), "edge_type").alias("metric")).agg(F.sum("edges").alias("value")))


def neighbors(g: Groups, name: str, edge_types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """graph.neighbors(): a node's edges, strongest first, from its own groups and pairs alone."""
    kinds = lambda x: x.where(F.col("edge_type").isin(edge_types)) if edge_types else x
    own = bounded(kinds(g.members).where(F.col("name") == name).select("grp", F.col("h").alias("own")))
    near = kinds(g.members).where(F.col("name") != name).join(own, "grp").select("name", (F.col("h") + F.col("own")).alias("weight"), "edge_type", _adds().alias("n"))
    pairs = kinds(g.pairs).where((F.col("src") == name) | (F.col("dst") == name))
    pairs = pairs.select(F.when(F.col("src") == name, F.col("dst")).otherwise(F.col("src")).alias("name"), "weight", "edge_type", "n")
    found = near.unionByName(pairs).groupBy("name", "edge_type").agg(F.round(F.sum("weight"), 4).alias("weight"), F.sum("n").alias("n")).where("n > 0")
    return found.orderBy(F.desc("weight"), "name", "edge_type").limit(limit).select("name", "weight", "edge_type")


def pagerank(g: Groups, seeds: DataFrame, damping: float = graph.DAMPING, rounds: int = graph.MOST_ROUNDS, tolerance: float = graph.TOLERANCE, every: int = 5) -> DataFrame:
    """graph.pagerank(): a round sums by group and goes back to members, in work linear in members and pairs.

    Members read a round's scores twice, for the sums and for their share in them, so each round is written."""
    out = degrees(g).groupBy("name").agg(F.sum("out").alias("out")).where("out > 0")
    known = seeds.select("name").distinct().withColumn("seed", F.lit(1.0))
    nodes = out.join(known, "name", "left")
    nodes = nodes.crossJoin(F.broadcast(nodes.agg(F.count("seed").alias("k")))).where("k > 0")  # one row
    nodes = written(nodes.select("name", "out", ((1 - damping) * F.coalesce("seed", F.lit(0.0)) / F.col("k")).alias("t")), "nodes")
    members, pairs = g.members.drop("edge_type"), written(_both(g.pairs).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "both")
    score = nodes.select("name", "out", F.lit(0.0).alias("score"))
    for k in range(1, rounds + 1):
        given = score.where("score <> 0").select("name", (F.col("score") / F.col("out")).alias("q"))
        held = members.join(given, "name", "left").select("grp", "name", "h", F.coalesce("q", F.lit(0.0)).alias("q"))
        sums = held.groupBy("grp").agg(F.sum(F.col("h") * F.col("q")).alias("hq"), F.sum("q").alias("sq")).where("sq <> 0")
        by_group = held.join(sums, "grp").select("name", (F.col("hq") + F.col("h") * F.col("sq") - 2 * F.col("h") * F.col("q")).alias("x"))
        by_pair = pairs.join(given, pairs.src == given.name).select(F.col("dst").alias("name"), (F.col("weight") * F.col("q")).alias("x"))
        moved = by_group.unionByName(by_pair).groupBy("name").agg(F.sum("x").alias("x"))
        new = nodes.join(moved, "name", "left").select("name", "out", (F.col("t") + damping * F.coalesce("x", F.lit(0.0))).alias("score"))
        before, score = score, written(new, "scores")
        if k % every == 0 and k < rounds:
            if score.join(before.select("name", F.col("score").alias("old")), "name").where(F.abs(F.col("score") - F.col("old")) >= tolerance).isEmpty():
                break
    return score.select("name", "score")


def pushed(edges: DataFrame, seeds: DataFrame, damping: float = graph.DAMPING, rounds: int = graph.MOST_ROUNDS, least: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(set, name, score) of personalized PageRank for many seed sets at once, seeds(set, name), by residual push over graph.both_ways()
    edges; and (round, frontier, touched): how many (set, name) were pushed and how many edges that read.

    What a name has received and not passed on is its residual. A round pushes names whose residual is above `least` only, over their
    own edges; the others keep theirs. Without that bound a round is one of graph.pagerank(), so scores differ by the residuals
    that were kept, `least` for each name at most."""
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("out")).where("out > 0")
    share = edges.join(out, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("out")).alias("share"))
    share = written(share.repartitionByRange("src").sortWithinPartitions("src"), "share")  # a few names' edges lie together
    known = seeds.select("set", "name").distinct().join(share.select(F.col("src").alias("name")).distinct(), "name", "left_semi")
    start = known.join(known.groupBy("set").agg(F.count("*").alias("k")), "set").select("set", "name", ((1 - damping) / F.col("k")).alias("r"))
    state = written(start.select("set", "name", F.lit(0.0).alias("score"), "r"), "residuals")
    seen = []
    for k in range(1, rounds + 1):
        frontier = state.where(F.col("r") > least).select("set", "name", "r")
        active = frontier.select("name").distinct().limit(graph.FEW + 1).toArrow().column(0).to_pylist()  # FEW names at most
        if not active:
            break
        own = share.where(F.col("src").isin(active)) if len(active) <= graph.FEW else share  # the reader skips other names' edges
        flow = own.join(frontier, own.src == frontier.name).select("set", F.col("dst").alias("name"), (damping * F.col("share") * F.col("r")).alias("x"))
        flow = written(flow, "flow")
        seen.append((k, frontier.count(), flow.count()))
        kept = state.select("set", "name", (F.col("score") + F.when(F.col("r") > least, F.col("r")).otherwise(F.lit(0.0))).alias("score"), F.when(F.col("r") > least, F.lit(0.0)).otherwise(F.col("r")).alias("r"))
        state = kept.unionByName(flow.select("set", "name", F.lit(0.0).alias("score"), F.col("x").alias("r"))).groupBy("set", "name").agg(F.sum("score").alias("score"), F.sum("r").alias("r"))
        state = written(state, "residuals")
    return state.select("set", "name", "score"), spark.createDataFrame(seen, "round int, frontier long, touched long")
