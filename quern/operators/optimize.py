"""Metadata rewriting: tag extraction, description compression and expansion, action prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import spread

# Ordered rewrites of long descriptions, case ignored.
REWRITES = [
    (r"\b(this skill|this tool|the tool|the skill)\b", "it"),
    (r"\byou can use (this|the)\b", "use"),
    (r"\bis used to\b", "→"),
    (r"\ballows you to\b", "enables"),
    (r"\bprovides\b", "gives"),
    (r"\bin order to\b", "to"),
    (r"\bas well as\b", "&"),
    (r"\bcapabilities\b", "features"),
    (r"\bimplementation\b", "impl"),
    (r"\bconfiguration\b", "config"),
    (r"\binformation\b", "info"),
    (r"\bdocumentation\b", "docs"),
    (r"\butilization\b", "use"),
    (r"\badditionally,\b", "also"),
    (r"\bfurthermore,\b", ""),
    (r"\bhowever,\b", "but"),
    (r"\btherefore,\b", "so"),
]
# Keywords of a body, in order, and the phrase or prefix that each brings.
PHRASES = {
    "deploy": "Deploy and manage", "test": "Run tests for", "build": "Build and compile", "config": "Configure and manage", "monitor": "Monitor and observe",
    "analyze": "Analyze and report on", "migrate": "Migrate and transform", "backup": "Backup and restore", "debug": "Debug and troubleshoot",
}
PREFIXES = {
    "deploy": "Deploy", "kubernetes": "Deploy", "docker": "Build & deploy", "test": "Test & validate", "pytest": "Test & validate", "build": "Build & compile",
    "compile": "Build & compile", "migrate": "Migrate", "monitor": "Monitor", "debug": "Debug", "troubleshoot": "Debug", "backup": "Backup", "restore": "Backup",
    "create": "Create", "generate": "Create", "analyze": "Analyze", "report": "Analyze", "search": "Search", "query": "Search", "configure": "Configure",
    "setup": "Configure", "install": "Configure",
}
DEFAULT_PHRASE, DEFAULT_PREFIX = "Manage and operate", "Use"
# Beginnings that need no prefix, and words that make no tags.
VERBS = "when for how manage create deploy run build test analyze monitor configure".split()
TAG_STOP_WORDS = "the this that with from your will should would could have been their which when where what there these".split()
LEAST, MOST = 20, 120


def compressed(description: Column, most: int = MOST) -> Column:
    """Rewritten; if still too long, cut after the last full stop beyond seven tenths, else cut off with dots."""
    text = description
    for pattern, new in REWRITES:
        text = F.regexp_replace(text, f"(?i){pattern}", new)
    return let(text, lambda x: _cut(x, most))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once; keeps long chains out of one generated method."""
    return F.transform(F.array(value), f)[0]


def _cut(text: Column, most: int) -> Column:
    head = F.substring(text, 1, most)
    stop = most - F.locate(".", F.reverse(head))  # zero-based place of the last full stop
    sentence = (F.instr(head, F.lit(".")) > 0) & (stop > most * 0.7)
    return F.when(F.char_length(text) <= most, text).when(sentence, F.left(head, stop + 1)).otherwise(F.concat(head, F.lit("...")))


def _first(body: Column, table: dict[str, str], default: str) -> Column:
    low, out = F.lower(F.coalesce(body, F.lit(""))), F.lit(default)
    for word, value in reversed(table.items()):
        out = F.when(F.contains(low, F.lit(word)), F.lit(value)).otherwise(out)
    return out


def title_case(text: Column) -> Column:
    """Every run of letters with its first one in upper case and the others in lower case: `k8s-DNS` gives `K8S-Dns`."""
    runs = F.split(text, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.char_length(r))))), "")


def expanded(name: Column, body: Column, tags: Column) -> Column:
    """A description from the body's first known keyword, the name in title case and three tags; never text of the body."""
    title = title_case(F.translate(name, "-_", "  "))
    first = F.slice(tags, 1, 3)
    end = F.when(F.size(first) > 0, F.concat(F.lit(" ["), F.array_join(first, ", "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(_first(body, PHRASES, DEFAULT_PHRASE), F.lit(" "), title, end)


def prefixed(description: Column, body: Column) -> Column:
    """With an action in front, unless it begins with a known verb."""
    return F.when(F.lower(description).rlike(f"^({'|'.join(VERBS)})"), description).otherwise(F.concat(_first(body, PREFIXES, DEFAULT_PREFIX), F.lit(": "), description))


def body_tags(docs: DataFrame, n: int = 5) -> DataFrame:
    """(rowid, tags): the n most frequent words of the first 500 characters, first seen first on ties."""
    words = F.regexp_extract_all(F.substring("body", 1, 500), F.lit("([A-Z][a-z]+|[a-z]+)"), F.lit(1))
    each = docs.select("rowid", F.posexplode(words).alias("pos", "w")).where(F.char_length("w") > 3).select("rowid", "pos", F.lower("w").alias("w")).where(~F.col("w").isin(TAG_STOP_WORDS))
    counted = each.groupBy("rowid", "w").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("rowid").orderBy(F.desc("n"), "pos"))
    top = counted.withColumn("k", place).where(F.col("k") <= n)
    return top.groupBy("rowid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("tags"))


def optimized(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The catalogue with new tags (sorted), description and metadata cost, and before/after figures."""
    docs = spread(docs)
    found = body_tags(docs).withColumnRenamed("tags", "more")
    out = docs.join(found, "rowid", "left").withColumn("_tags", F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))))
    old = F.coalesce("description", F.lit(""))
    short = F.when(F.char_length(old) > most, compressed(old, most)).otherwise(old)
    full = let(short, lambda x: F.when(F.char_length(x) < least, expanded(F.col("name"), F.col("body"), F.col("_tags"))).otherwise(x))
    out = out.withColumn("_new", let(full, lambda x: prefixed(x, F.col("body"))))
    cost = (F.floor(F.char_length("_new") / 4) + F.floor(F.char_length("name") / 4)).cast("bigint")
    return out.select(
        "rowid", "name", F.col("_tags").alias("tags"), F.col("_new").alias("description"), F.col("token_cost_meta").alias("before_tokens"), cost.alias("after_tokens"),
        F.char_length(old).cast("bigint").alias("before_len"), F.char_length("_new").cast("bigint").alias("after_len"), (F.col("_new") != old).alias("changed"),
    )


def totals(result: DataFrame) -> DataFrame:
    """One row: tokens before, after and saved over the changed rows, and rows with an error if the result has that column."""
    c = F.col("changed")
    part = lambda x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    errors = [F.count("error").alias("errors")] if "error" in result.columns else []
    return result.agg(F.count("*").alias("total"), F.count_if(c).alias("changed"), part("before_tokens").alias("before_tokens"), part("after_tokens").alias("after_tokens"), *errors).withColumn("saved", F.col("before_tokens") - F.col("after_tokens"))
