"""Text expressions: tokens, keywords, pattern keys, shingles, entropy, token costs. Java-side, inside code generation."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count as keywords of a query.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can
to of in for on with at by from as into through during before after above below between out off over under
again further then once here there when where why how all each every both few more most other some such
no nor not only own same so than too very just because but and or if while although this that these those
i me my myself we our ours you your yours he him his she her hers it its they them their theirs
please help need want like get make do does did done doing go went gone come came take took taken give gave
given find found use used using
""".split()
# Words that don't count in a query's pattern key.
PATTERN_STOP_WORDS = "the a an is are was please help need want like get can you me i to of in for on with at".split()
# Terms too generic to count as a hint at a name, and terms that bring others.
GENERIC_TERMS = ["pipeline", "dashboard"]
EXPANSIONS = {"pipeline": ["ci", "cd", "build", "release", "deploy"]}
# Letters with one mark and what the index folds them to: Latin ones, by their canonical decomposition.
_MARKED = [(chr(k), d[0]) for k in range(0xC0, 0x1F00) if len(d := unicodedata.normalize("NFD", chr(k))) == 2 and d[0] in string.ascii_lowercase and unicodedata.combining(d[1])]
FOLD_FROM, FOLD_TO = ("".join(x) for x in zip(*_MARKED, strict=True))


def literals(words: list[str]) -> Column:
    """A constant array."""
    return F.array(*map(F.lit, words))


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits, in lower case, without marks."""
    text = F.coalesce(text, F.lit(""))
    lower = F.lower(text)
    folded = F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(F.translate(lower, FOLD_FROM, FOLD_TO))  # ASCII has no marks
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def keywords(query: Column) -> Column:
    """Words of a query longer than two letters that aren't stop-words; hyphens stay, duplicates too."""
    words = F.split(F.lower(F.regexp_replace(query, r"[^\p{L}\p{N}_\s-]", " ")), r"\s+")
    return F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(STOP_WORDS))


def expanded(words: Column) -> Column:
    """Keywords with the terms that they bring, each new one once, at the end."""
    out = words
    for term, more in EXPANSIONS.items():
        out = F.when(F.array_contains(words, term), F.concat(out, F.array_except(literals(more), out))).otherwise(out)
    return out


def pattern_key(query: Column) -> Column:
    """A query's words, less stop-words and short ones, sorted and joined."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_join(F.array_sort(F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(PATTERN_STOP_WORDS))), " ")


def normal_name(name: Column) -> Column:
    """Lower case, everything but letters and digits to one space; null to ''. For exact NFKC and case folding see unicode.py."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct character runs of length k; a shorter text is its own only shingle, an empty one has none."""
    n = F.char_length(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def name_shingles(name: Column, k: int = 3) -> Column:
    """Shingles of a raw name without spaces, as entity deduplication takes them."""
    return shingles(F.replace(name, F.lit(" "), F.lit("")), k)


def text_shingles(name: Column, description: Column, k: int = 3) -> Column:
    """Shingles of normalised name and description, spaces kept, as the similarity graph takes them."""
    return shingles(normal_name(F.concat_ws(" ", name, description)), k)


def entropy(name: Column) -> Column:
    """Shannon entropy of the normalised name, in bits a character."""
    text = normal_name(name)
    letters = F.split(text, "")
    n = F.char_length(text)
    each = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def token_estimate(text: Column) -> Column:
    """About four characters a token."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def metadata_line(name: Column, description: Column, tags: Column) -> Column:
    """`name: description [tag, tag, tag]`, at most three tags."""
    first = F.slice(tags, 1, 3)
    return F.concat(name, F.lit(": "), description, F.when(F.size(first) > 0, F.concat(F.lit(" ["), F.array_join(first, ", "), F.lit("]"))).otherwise(F.lit("")))


def safe_name(name: Column) -> Column:
    """Control characters stripped, at most 128 characters."""
    return F.substring(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), 1, 128)


def percent(score: Column) -> Column:
    """A score as a whole number of hundredths, cut off."""
    return (score * 100).cast("int")


def score_bar(score: Column) -> Column:
    """A score as a bar of ten places; scores of one and more fill it."""
    full = F.greatest(F.least(F.floor(percent(score) / 10), F.lit(10)), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full))


def hinted(query: Column, *fields: Column, least: int = 0) -> Column:
    """Whether a term of the query, or its first six letters, stands in one of the fields; stop-words take part.

    Generic terms and those of `least` letters or fewer don't."""
    terms = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: ~t.isin(GENERIC_TERMS) & (F.char_length(t) > least))
    lower = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]

    def stands(t: Column) -> Column:
        out = F.contains(lower[0], t) | F.contains(lower[0], F.substring(t, 1, 6))
        for f in lower[1:]:
            out = out | F.contains(f, t)
        return out

    return F.exists(terms, stands)


def is_variant_pair(a: Column, b: Column) -> Column:
    """Short names of one stem with different endings, such as model versions: never the same entity."""
    # Fixed value: what a name with a variant's ending looks like.
    pattern = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    stem = lambda x: F.regexp_extract(x, pattern, 1)
    end = lambda x: F.regexp_extract(x, pattern, 2)
    both = a.rlike(pattern) & b.rlike(pattern)
    return (a != b) & (F.greatest(F.char_length(a), F.char_length(b)) < 12) & both & (stem(a) == stem(b)) & (end(a) != end(b))


def is_prefix_pair(a: Column, b: Column) -> Column:
    """The shorter name is a proper prefix of the longer one."""
    return (a != b) & (F.startswith(a, b) | F.startswith(b, a))
