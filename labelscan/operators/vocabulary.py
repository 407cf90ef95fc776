"""Vocabulary management over (allergen, term) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.functions.text import similarity
from labelscan.operators.match import bounded, vocab_hits
from labelscan.sources.scratch import spread, stored


def union_vocab(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def corpus_words(texts: DataFrame, min_length: int = 3) -> DataFrame:
    """(word, n) of normalised texts."""
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def unused_terms(vocab: DataFrame, texts: DataFrame) -> DataFrame:
    return vocab.join(vocab_hits(texts, vocab).select("allergen", "term").distinct(), ["allergen", "term"], "left_anti")


def duplicate_terms(raw: DataFrame) -> DataFrame:
    """(allergen, term, n) of raw rows that agree once normalised (term)."""
    return raw.groupBy("allergen", "term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Edits up to which near duplicates are looked for by the deletions of a whole term, and not by its parts.
DELETED = 2


def _deletions(term: Column, most: int) -> list[Column]:
    """The distinct strings that `term` becomes without 0, 1, ... `most` of its characters, an array for each number."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    out = [F.array(term)]
    for _ in range(most):
        out.append(F.array_distinct(F.flatten(F.transform(out[-1], one))))
    return out


def near_duplicates(vocab: DataFrame, bar: float = 0.85) -> DataFrame:
    """(allergen, a, b) of terms of an allergen whose similarity is at least bar.

    A term of nb letters differs from a partner that is no longer in `most` places at most. Up to DELETED places the two
    meet in what is left of the longer one without `most` letters and of the other one without as many less as it is
    shorter: what meets there is hardly ever farther apart than twice that.

    With more places (long terms) one of most + 1 parts of the shorter term stands in the longer one. As edits before a
    part and behind it share that number, and the difference of the lengths is part of it, the part can begin at few places
    only: the longer term looks there for the parts of terms of each length that it could be near to. Parts of a term with fewer
    letters than parts may be empty.
    """
    limit = lambda n: F.floor((1 - bar) * n + 1e-9).cast("int")
    rows = spread(stored(vocab.select("allergen", "term", F.length("term").alias("n")).distinct().where("n > 0"), "terms"))
    met = _met_by_deletions(rows, limit).unionByName(_met_by_parts(rows, limit, bar))
    near = met.where(similarity(F.col("a"), F.col("b")) >= bar)
    return near.select("allergen", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met_by_deletions(rows: DataFrame, limit: Callable[[Column], Column]) -> DataFrame:
    """(allergen, a, b), a no longer than b, that agree without limit(b's length) of b's letters, if those are DELETED at most."""
    none = F.array().cast("array<string>")
    left = _deletions(F.col("term"), DELETED)

    def of(shorter: int) -> Column:
        """The deletions by which a term meets terms that are longer by so many letters."""
        most = limit(F.col("n") + shorter)
        out = F.lit(None)
        for d in range(max(1, shorter), DELETED + 1):
            out = F.when(most == d, F.struct(F.lit(d).alias("d"), left[d - shorter].alias("left"))).otherwise(out)
        return F.coalesce(out, F.struct(F.lit(0).alias("d"), none.alias("left")))

    def keys(name: str, entries: list[Column]) -> DataFrame:
        each = rows.select("allergen", F.col("term").alias(name), F.explode(F.array(*entries)).alias("e"))
        cut = each.select("allergen", name, F.col("e.d").alias("d"), F.explode("e.left").alias("left"))
        return cut.select(F.xxhash64("allergen", "d", "left").alias("key"), F.col("allergen").alias(f"_{name}"), name)

    met = keys("a", [of(i) for i in range(DELETED + 1)]).join(keys("b", [of(0)]).hint("merge"), "key")  # similarity is tested, so that the keys may be hashes
    met = met.where((F.col("_a") == F.col("_b")) & ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))))
    return met.select(F.col("_a").alias("allergen"), "a", "b")


def _met_by_parts(rows: DataFrame, limit: Callable[[Column], Column], bar: float) -> DataFrame:
    """(allergen, a, b), a no longer than b, of which a part of a stands in b, if they may differ in more than DELETED places."""
    at = lambda i: F.floor(i * F.col("na") / F.col("k")).cast("int")
    size = at(F.col("i") + 1) - at(F.col("i"))
    place, i = at(F.col("i")), F.col("i")
    most = limit(F.ceil(F.col("na") / bar))
    cut = lambda df: df.withColumn("k", F.col("most") + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    short = rows.select("allergen", F.col("term").alias("a"), F.col("n").alias("na")).withColumn("most", most).where(F.col("most") > DELETED)
    parts = cut(short).select("allergen", "a", "na", "i", F.substring("a", place + 1, size).alias("part"))
    lengths = F.explode(F.sequence(F.ceil(F.col("n") * bar - 1e-9).cast("int"), F.col("n"))).alias("na")
    long = rows.where(limit(F.col("n")) > DELETED)
    asked = long.select("allergen", F.col("term").alias("b"), F.col("n").alias("nb"), lengths).withColumn("most", most)
    more = F.col("nb") - F.col("na")
    asked = cut(asked.where(more <= F.col("most")))
    low = F.greatest(place - i, place + more - (F.col("most") - i), F.lit(0))
    high = F.least(place + i, place + more + (F.col("most") - i), F.col("nb") - size)
    asked = asked.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    asked = asked.withColumn("q", F.explode(F.sequence("_low", "_high"))).select("allergen", "b", "nb", "na", "i", F.substring("b", F.col("q") + 1, size).alias("part"))
    met = parts.join(asked.hint("merge"), ["allergen", "na", "i", "part"]).where((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    return met.select("allergen", "a", "b")


def conflicts(vocab: DataFrame) -> DataFrame:
    """(term, n) of terms that several allergens have."""
    return vocab.groupBy("term").agg(F.countDistinct("allergen").alias("n")).where("n > 1")


def inflections(vocab: DataFrame, words: DataFrame, least: int = 4, most: int = 5) -> DataFrame:
    """(allergen, term, word, n): corpus words that begin with a one-word term and go on for one to `most` letters, and are no terms."""
    terms = bounded(vocab.where(~F.col("term").contains(" ") & (F.length("term") >= least)).withColumn("_head", F.substring("term", 1, least)))
    met = words.withColumn("_head", F.substring("word", 1, least)).join(terms, "_head").where(F.col("word").startswith(F.col("term")) & (F.length("word") - F.length("term")).between(1, most))
    return met.join(bounded(vocab.select(F.col("term").alias("word")).distinct()), "word", "left_anti").select("allergen", "term", "word", "n")


def coverage_gaps(keywords: DataFrame, vocab: DataFrame, texts: DataFrame) -> DataFrame:
    """Keywords (keyword) that occur as a word of the corpus and in no term."""
    seen = texts.select(F.explode(F.array_distinct(F.split("text", " "))).alias("keyword")).distinct()
    terms = vocab.select(F.explode(F.split("term", " ")).alias("keyword")).distinct()
    return keywords.join(seen, "keyword", "left_semi").join(terms, "keyword", "left_anti")


def audit_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, n): rows of each part of an audit."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(allergen, term, decision) of two versions of a vocabulary: approved, removed or kept."""
    before, after = (df.select("allergen", "term").distinct().withColumn(c, F.lit(True)) for df, c in ((old, "o"), (new, "n")))
    decision = F.when(F.col("o").isNull(), "approved").when(F.col("n").isNull(), "removed").otherwise("kept")
    return before.join(after, ["allergen", "term"], "full").select("allergen", "term", decision.alias("decision"))


def add_terms(vocab: DataFrame, approved: DataFrame, groups: DataFrame) -> DataFrame:
    """vocab and the approved terms that it lacks; an error if one's allergen is not among the groups (allergen)."""
    unknown = approved.join(groups, "allergen", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("an approved term has an unknown group")
    return vocab.unionByName(approved.select("allergen", "term").distinct().join(vocab, ["allergen", "term"], "left_anti"))


def remove_term(vocab: DataFrame, allergen: str, term: str) -> DataFrame:
    one = (F.col("allergen") == allergen) & (F.col("term") == term)
    if vocab.where(one).isEmpty():
        raise ValueError(f"{term!r} is no term of {allergen}")
    return vocab.where(~one)
