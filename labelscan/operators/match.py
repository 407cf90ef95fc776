"""Matching: split labels, join phrases, apply rules, choose evidence.

Texts are joined to the vocabulary by the first word of each term (the anchor): distinct words of a text that begin some
term, a hash join on the anchor, and a test of the whole term. Where a term may stand within a word, its anchor is its
rarest run of three characters. The vocabulary is broadcast up to BROADCAST_TERMS rows. Beyond that the distinct words
are shuffled without their texts, which come back by a row number for the candidates that remain. Rules are anti joins on
the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.functions.tags import ALLERGENS, parse_tags, tags_to_allergens
from labelscan.functions.text import LETTER, normalize, padded, plain, raw_phrase_in, strip_all
from labelscan.operators.risk import general_risk
from labelscan.plans import rules
from labelscan.sources.scratch import stored

BROADCAST_TERMS = 50_000
#: Characters of an anchor within words, and texts by which the rarest is chosen, which makes a difference to the time only.
RUN, SAMPLE = 3, 1000
#: Terms up to which each is looked for in each text, if they may stand within words.
FEW = 1000
SECTIONS = ("declared", "trace")


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether a vocabulary or rule table has at most so many rows, by default BROADCAST_TERMS."""
    most = BROADCAST_TERMS if most is None else most
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint, if it fits."""
    return F.broadcast(df) if fits(df) else df


def trace_start(normalized: Column) -> Column:
    """Place (from 0) at which the earliest precautionary marker starts in a normalised text; -1 without one."""
    return F.regexp_instr(padded(normalized), F.lit(rules.MARKER_PATTERN)) - 1


def split_declared_trace(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus declared_text, trace_text, and norm, the whole text normalised.

    Places in the normalised and the original text differ, so the cut is looked for in the original near the marker:
    the first anchor phrase in that fragment decides, by its exact spelling if it is there, and else the estimate.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    at = F.col("_at")
    estimate = F.least(at, F.length(raw))
    begin = F.greatest(estimate - rules.BEFORE, F.lit(0))
    out = df.withColumn("norm", normalize(F.col(text))).withColumn("_at", trace_start(F.col("norm")))
    out = out.withColumn("_begin", begin).withColumn("_fragment", F.substring(raw, F.col("_begin") + 1, F.least(F.length(raw), estimate + rules.AFTER) - F.col("_begin")))
    out = out.withColumn("_plain", normalize(F.col("_fragment")))
    cut = estimate
    for phrase in reversed(rules.ANCHORS):
        own = F.locate(phrase, F.lower(F.col("_fragment")))
        cut = F.when(F.col("_plain").contains(plain(phrase)), F.when(own > 0, F.col("_begin") + own - 1).otherwise(estimate)).otherwise(cut)
    out = out.withColumn("_cut", F.when(at >= 0, cut))
    declared = F.when(F.col("_cut").isNull(), raw).otherwise(F.substring(raw, F.lit(1), F.col("_cut")))
    trace = F.when(F.col("_cut").isNull(), F.lit("")).otherwise(F.substring(raw, F.col("_cut") + 1, F.length(raw)))
    return out.withColumn("declared_text", strip_all(declared)).withColumn("trace_text", strip_all(trace)).drop("_at", "_begin", "_fragment", "_plain", "_cut")


def sections(df: DataFrame, key: str = "code") -> DataFrame:
    """Long form of a split table: (code, section, text). What split_declared_trace() has normalised is not normalised again where there is no trace."""
    declared = normalize(F.col("declared_text"))
    if "norm" in df.columns:
        declared = F.when(F.col("trace_text") == "", F.col("norm")).otherwise(declared)
    texts = {"declared": declared, "trace": normalize(F.col("trace_text"))}
    both = F.inline(F.array(*[F.struct(F.lit(s).alias("section"), texts[s].alias("text")) for s in SECTIONS]))
    return df.select(F.col(key).alias("code"), both).where("text <> ''")


def _met(texts: DataFrame, by: tuple[str, ...], pieces: Column, terms: DataFrame, whole: Column) -> DataFrame:
    """(by, text, what terms has) of texts and terms (anchor, ...) where the anchor is one of the text's pieces and `whole` holds.

    Either way a row of texts is a text, whatever its keys: they may be null, or the same in several rows.
    """
    anchors = F.explode(pieces).alias("anchor")
    if fits(terms):
        return texts.select(*by, "text", anchors).join(F.broadcast(terms), "anchor").where(whole).drop("anchor")
    rows = stored(texts.select(*by, "text").withColumn("_row", F.monotonically_increasing_id()), "texts")
    candidates = rows.select("_row", anchors).join(terms, "anchor").drop("anchor")
    found = candidates.join(rows, "_row").where(whole)
    return found.select(*by, "text", *[c for c in terms.columns if c not in (*by, "anchor")])


def vocab_hits(texts: DataFrame, vocab: DataFrame, by: tuple[str, ...] = ("code", "section")) -> DataFrame:
    """Every term of the vocabulary (allergen, term) in every text, as (by, text, allergen, term and what else vocab has)."""
    terms = vocab.withColumn("anchor", F.split("term", " ")[0]).where("anchor <> ''")
    whole = padded(F.col("text")).contains(padded(F.col("term")))
    return _met(texts, by, F.array_distinct(F.split("text", " ")), terms, whole)


def _runs(c: Column, size: int) -> Column:
    """Distinct runs of so many characters; what of the last ones is shorter meets no anchor. Characters are split once, as places in a string cost its length."""
    after = lambda cs, i: [F.get(cs, i + k) for k in range(1, size)]
    cut = F.transform(F.array(F.split(c, "")), lambda cs: F.transform(cs, lambda x, i: F.concat(x, *after(cs, i))))
    return F.array_distinct(F.array_compact(F.flatten(cut)))


def substring_hits(texts: DataFrame, vocab: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Every term (term, ...) anywhere in every text, also within words: (by, text, term and what else vocab has).

    Up to FEW terms are each looked for in the whole text. With more, a term's anchor is that of its runs of RUN characters (all of a shorter term) which fewest of SAMPLE texts hold.
    """
    terms = vocab.where("term <> ''")
    if fits(terms, min(FEW, BROADCAST_TERMS)):  # looking for a few terms costs less than cutting a text into runs
        return texts.select(*by, "text").join(F.broadcast(terms), F.col("text").contains(F.col("term")))
    terms = terms.withColumn("_size", F.least(F.length("term"), F.lit(RUN)))
    sizes = sorted(r["_size"] for r in terms.select("_size").distinct().collect())  # RUN rows at most
    if not sizes:
        return texts.select(*by, "text").join(vocab.limit(0), F.lit(False))
    pieces = F.concat(*[_runs(F.col("text"), n) for n in sizes])
    seen = texts.select("text").limit(SAMPLE).select(F.explode(pieces).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    own = F.coalesce(*[F.when(F.col("_size") == n, _runs(F.col("term"), n)) for n in sizes])
    runs = terms.select("term", "_size").distinct().select("term", "_size", F.explode(own).alias("anchor")).where(F.length("anchor") == F.col("_size"))
    anchors = runs.join(seen, "anchor", "left").groupBy("term").agg(F.min_by("anchor", F.struct(F.coalesce("_n", F.lit(0)), "anchor")).alias("anchor"))
    return _met(texts, by, pieces, stored(terms.drop("_size").join(anchors, "term"), "anchors"), F.col("text").contains(F.col("term")))


def negation_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.NEGATIONS, "allergen string, phrase string")


def exclusion_rules(spark: SparkSession, kinds: tuple[str, ...] = tuple(rules.EXCLUSIONS), legacy: bool = False) -> DataFrame:
    return spark.createDataFrame([r for r in rules.exclusion_rows(legacy) if r[3] in kinds], "allergen string, term string, phrase string, kind string")


def drop_negated(hits: DataFrame, negations: DataFrame) -> DataFrame:
    """Hits whose text has no negation of their allergen, wherever it stands in the section."""
    n = bounded(negations)
    return hits.join(n, (hits.allergen == n.allergen) & padded(hits.text).contains(padded(n.phrase)), "left_anti")


def drop_excluded(hits: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Hits whose text has no phrase that excludes their term, wherever it stands in the section."""
    x = bounded(exclusions)
    return hits.join(x, (hits.allergen == x.allergen) & (hits.term == x.term) & padded(hits.text).contains(padded(x.phrase)), "left_anti")


def best_term(hits: DataFrame, by: tuple[str, ...] = ("code", "section")) -> DataFrame:
    """The longest term of each allergen, the first in order on a tie."""
    return hits.groupBy(*by, "allergen").agg(F.min_by("term", F.struct(-F.length("term"), F.col("term"))).alias("matched_term"))


def valid_hits(texts: DataFrame, vocab: DataFrame, negate: bool = True, kinds: tuple[str, ...] = tuple(rules.EXCLUSIONS), legacy: bool = False, by: tuple[str, ...] = ("code", "section")) -> DataFrame:
    spark = texts.sparkSession
    hits = vocab_hits(texts, vocab, by)
    hits = drop_negated(hits, negation_rules(spark)) if negate else hits
    return drop_excluded(hits, exclusion_rules(spark, kinds, legacy)) if kinds else hits


def marked(hits: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, allergen, term, _n, _x): hits, with whether a negation and whether an exclusion speaks against each; all rules are joined at once."""
    spark = hits.sparkSession
    denials = negation_rules(spark).select("allergen", F.lit(None).cast("string").alias("term"), "phrase")
    table = bounded(denials.unionByName(exclusion_rules(spark).select("allergen", "term", "phrase")).select(F.col("allergen").alias("_a"), F.col("term").alias("_t"), F.col("phrase").alias("_p")))
    own = (F.col("allergen") == F.col("_a")) & (F.col("_t").isNull() | (F.col("_t") == F.col("term")))
    met = hits.join(table, own & padded(F.col("text")).contains(padded(F.col("_p"))), "left")
    is_rule = F.col("_p").isNotNull()
    return met.groupBy(*by, "allergen", "term").agg(F.max(is_rule & F.col("_t").isNull()).alias("_n"), F.max(is_rule & F.col("_t").isNotNull()).alias("_x"))


def detect_both(texts: DataFrame, vocab: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """detect() plus unruled, the set that the terms give without rules, in one pass; a row of `by` has one text."""
    hits = marked(vocab_hits(texts, vocab, by), by)
    term = F.when(~F.col("_n") & ~F.col("_x"), F.col("term"))
    each = hits.groupBy(*by, "allergen").agg(F.min_by(term, F.when(term.isNotNull(), F.struct(-F.length("term"), F.col("term")))).alias("matched_term"))
    stands = F.col("matched_term").isNotNull()
    evidence = F.struct("allergen", "matched_term", F.lit("direct").alias("match_type"))
    sets = {"allergens": F.when(stands, F.col("allergen")), "matches": F.when(stands, evidence), "unruled": F.col("allergen")}
    return each.groupBy(*by).agg(*[F.array_sort(F.collect_list(c)).alias(name) for name, c in sets.items()])


def detect(texts: DataFrame, vocab: DataFrame, by: tuple[str, ...] = ("code", "section"), **options) -> DataFrame:
    """Detected set and evidence of each text: (by, allergens, matches)."""
    best = best_term(valid_hits(texts, vocab, by=by, **options), by)
    evidence = F.struct("allergen", "matched_term", F.lit("direct").alias("match_type"))
    return best.groupBy(*by).agg(F.array_sort(F.collect_list("allergen")).alias("allergens"), F.array_sort(F.collect_list(evidence)).alias("matches"))


def analyze(labels: DataFrame, vocab: DataFrame, key: str = "code", text: str = "text", unruled: bool = False) -> DataFrame:
    """labels plus declared and trace texts, sets and evidence, and risk; labels without a hit are SAFE.

    Each row is judged by its own text: hits come back by the row's code and the digest of its text, so that rows without
    a code, or with one that another text has too, get what is found in theirs. unruled: with the sets that the terms give
    without rules, declared_unruled and trace_unruled.
    """
    own = F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    split = split_declared_trace(labels, text).withColumn("_own", own)
    texts = sections(split, "_own")
    if unruled:
        found, columns = detect_both(texts, vocab, ("code", "section")), ("allergens", "matches", "unruled")
    else:
        found, columns = detect(texts, vocab), ("allergens", "matches")
    wide = found.groupBy("code").agg(*[F.first(F.when(F.col("section") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}") for s in SECTIONS for c in columns])
    out = split.join(wide.withColumnRenamed("code", "_code"), F.col("_own") == F.col("_code"), "left").drop("_code", "_own", "norm")
    for s in SECTIONS:
        for c in columns:
            out = out.withColumn(f"{s}_{c}", F.coalesce(f"{s}_{c}", F.array().cast(wide.schema[f"{s}_{c}"].dataType)))
    return out.withColumn("risk", general_risk(F.col("declared_allergens"), F.col("trace_allergens")))


def analyze_products(products: DataFrame, vocab: DataFrame, dialect: str = "eval") -> DataFrame:
    """analyze() plus reference sets from allergens_tags and traces_tags."""
    out = analyze(products, vocab)
    for name, c in (("reference_declared", "allergens_tags"), ("reference_trace", "traces_tags")):
        out = out.withColumn(name, tags_to_allergens(parse_tags(F.col(c), dialect), dialect))
    return out


def diagnose_tags(products: DataFrame, vocab: DataFrame) -> DataFrame:
    """Every reference tag: matched if its text shows its allergen, unmatched if not, unsupported if it has no allergen."""
    tags = products.select("code", F.explode(F.array_distinct(parse_tags(F.col("allergens_tags"), "diagnose"))).alias("tag"))
    tags = tags.withColumn("allergen", F.get(tags_to_allergens(F.array("tag"), "diagnose"), F.lit(0)))
    texts = products.select("code", F.lit("declared").alias("section"), normalize(F.col("text")).alias("text"))
    found = valid_hits(texts, vocab).select("code", "allergen").distinct().withColumn("found", F.lit(True))
    status = F.when(F.col("allergen").isNull(), "unsupported").when(F.col("found"), "matched").otherwise("unmatched")
    return tags.join(found, ["code", "allergen"], "left").withColumn("status", status).select("code", "tag", "allergen", "status")


def baseline_raw(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Bounded test of terms in the text as it is, without rules: (code, allergens). Terms are joined by their first word.

    A bounded term begins and ends where words of the text do, so that its first word is a whole word of the text.
    """
    word = rf"([{LETTER}]+)"
    terms = bounded(vocab.withColumn("_word", F.regexp_extract(F.lower("term"), word, 1)).where("_word <> ''"))
    texts = labels.select("code", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(1)))
    hits = texts.select("code", "text", F.explode(words).alias("_word")).join(terms, "_word").where(raw_phrase_in(F.col("term"), F.col("text")))
    return hits.groupBy("code").agg(F.array_sort(F.collect_set("allergen")).alias("allergens"))


def baseline_substring(labels: DataFrame, vocab: DataFrame, normalized: bool = False) -> DataFrame:
    """(code, allergens): terms anywhere in the text, also within words, without rules."""
    text = normalize(F.col("text")) if normalized else F.lower(F.coalesce("text", F.lit("")))
    hits = substring_hits(labels.select("code", text.alias("text")), vocab.select("allergen", "term").distinct(), ("code",))
    return hits.groupBy("code").agg(F.array_sort(F.collect_set("allergen")).alias("allergens"))


#: Configurations of the matcher from plain to whole.
METHODS = ("raw", "keyword", "negation", "context", "full")


def ablation(labels: DataFrame, texts: DataFrame, vocab: DataFrame, raw_vocab: DataFrame) -> DataFrame:
    """(code, method, allergens) of each of METHODS that finds something: raw terms in raw text, normalised keywords, with negations, with exclusions, and with both.

    labels is (code, text), texts the same normalised. Texts are matched once for the last four: all rules are joined to
    the hits at once, and each hit of a code is marked with the kinds of rules that speak against it.
    """
    flags = marked(vocab_hits(texts, vocab, ("code",)), ("code",))
    n, x = ~F.col("_n"), ~F.col("_x")
    stands = F.array(F.lit("keyword"), F.when(n, "negation"), F.when(x, "context"), F.when(n & x, "full"))
    found = flags.select("code", "allergen", F.explode(F.array_compact(stands)).alias("method"))
    found = found.groupBy("code", "method").agg(F.array_sort(F.collect_set("allergen")).alias("allergens"))
    return found.unionByName(baseline_raw(labels, raw_vocab).select("code", F.lit("raw").alias("method"), "allergens"))


def match_versions(texts: DataFrame, versions: DataFrame) -> DataFrame:
    """Detected sets by vocabulary version, all versions in one pass: versions is (version, allergen, term)."""
    return best_term(valid_hits(texts, versions), ("version", "code", "section")).groupBy("version", "code", "section").agg(F.array_sort(F.collect_list("allergen")).alias("allergens"))


def known_allergens(spark: SparkSession) -> DataFrame:
    from labelscan.functions.tags import DISPLAY

    return spark.createDataFrame([(a, DISPLAY[a]) for a in ALLERGENS], "allergen string, name string")
