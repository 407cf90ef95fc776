"""Labels, profiles, OCR lines and the like, derived from the given tables by modular arithmetic, for Spark and for DuckDB alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.functions.tags import ALLERGENS, parse_tags, tags_to_allergens
from labelscan.functions.text import normalize
from labelscan.operators import match
from labelscan.operators.risk import general_risk
from labelscan.plans import rules
from labelscan.sources.scratch import stored
from labelscan.sources.tables import vocabulary

#: Label terms and the tag of each; "" is none.
TERMS = (
    ("wheat flour", "en:gluten"), ("milk powder", "en:milk"), ("soy lecithin", "en:soybeans"), ("almond milk", "en:nuts"), ("cocoa butter", ""), ("gluten free oats", ""), ("peanut butter", "en:peanuts"),
    ("œufs", "en:eggs"), ("crème", "en:milk"), ("no milk", ""), ("noix de coco", ""), ("Haselnüsse", "en:nuts"), ("poisson", "en:fish"), ("crevettes", "en:crustaceans"), ("sésame", "en:sesame-seeds"),
    ("sugar", ""), ("butter", "en:milk"), ("salt", ""), ("_soja_", "en:soybeans"), ("Thunfisch, thon", "en:fish"), ("mantequilla", "en:milk"), ("unknown thing", "en:lupin"),
)
TRACES = (("nuts", "en:nuts"), ("sesame", "en:sesame-seeds"), ("milk", "en:milk"), ("soja", "en:soybeans"), ("peanuts", "en:peanuts"), ("eggs", "en:eggs"), ("gluten", "en:gluten"), ("fish", "en:fish"), ("shrimp", "en:crustaceans"))


def _labels_sql(pick, docs: str) -> str:
    """SQL that both engines read; pick(list, index) is the dialect's element access."""
    n = len(TERMS)
    term = lambda e: pick([t for t, _ in TERMS], f"{e} % {n} + 1")
    tag = lambda e: pick([t for _, t in TERMS], f"{e} % {n} + 1")
    trace, trace_tag = (pick([t[i] for t in TRACES], f"(doc_id * 5 + 2) % {len(TRACES)} + 1") for i in (0, 1))
    a, b = "doc_id", "(doc_id * 7 + 3)"
    return f"""
      SELECT doc_id AS id, CAST(doc_id AS STRING) AS code, lang, source,
        CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat({term(a)}, ', ', {term(b)}, ', ', text, CASE WHEN doc_id % 5 <> 0 THEN '' ELSE concat(
          CASE lang WHEN 'de' THEN '. Kann ' WHEN 'fr' THEN '. Peut contenir ' WHEN 'es' THEN '. Puede contener ' ELSE '. May contain ' END, {trace},
          CASE WHEN lang = 'de' THEN ' enthalten.' ELSE '.' END) END) END AS text,
        CASE WHEN doc_id % 3 = 0 THEN concat('[', chr(39), CASE WHEN doc_id % 11 = 0 THEN '' ELSE {tag(a)} END, chr(39), ', ', chr(39), {tag(b)}, chr(39), ']')
             ELSE concat(CASE WHEN doc_id % 11 = 0 THEN '' ELSE {tag(a)} END, ',', {tag(b)}) END AS allergens_tags,
        concat(CASE WHEN doc_id % 5 = 0 THEN {trace_tag} ELSE '' END, ',', CASE WHEN doc_id % 7 = 0 THEN 'en:milk' ELSE '' END) AS traces_tags
      FROM {docs}"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def labels_duckdb() -> str:
    return _labels_sql(lambda xs, i: f"list_extract([{', '.join(map(quoted, xs))}], {i})", "documents").replace("AS STRING", "AS VARCHAR")


def labels_spark() -> str:
    return _labels_sql(lambda xs, i: f"element_at(array({', '.join(map(quoted, xs))}), CAST({i} AS INT))", "{docs}")



class Inputs:
    """Derived inputs of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def labels(self) -> DataFrame:
        return self.spark.sql(labels_spark(), docs=self.table("documents"))

    @cached_property
    def vocab(self) -> DataFrame:
        import json

        rows = self.spark.createDataFrame([(json.dumps(rules.VOCABULARY),)], "value string")
        return vocabulary(rows)

    @cached_property
    def raw_vocab(self) -> DataFrame:
        import json

        return vocabulary(self.spark.createDataFrame([(json.dumps(rules.VOCABULARY),)], "value string"), raw=True)

    @cached_property
    def split(self) -> DataFrame:
        return match.split_declared_trace(self.labels)

    @cached_property
    def sections(self) -> DataFrame:
        return match.sections(self.split)

    @cached_property
    def texts(self) -> DataFrame:
        """(code, section, text) of whole labels, normalised."""
        return self.labels.select("code", F.lit("label").alias("section"), normalize(F.col("text")).alias("text")).where("text <> ''")

    @cached_property
    def analysis(self) -> DataFrame:
        return match.analyze(self.labels, self.vocab)

    @cached_property
    def evaluated(self) -> DataFrame:
        """Reference and predicted sets and risks of each label."""
        return self._evaluated(self.analysis)

    def _evaluated(self, analysis: DataFrame, *more: str) -> DataFrame:
        ref = lambda c: tags_to_allergens(parse_tags(F.col(c), "eval"), "eval")
        out = analysis.select(*more, "id", "code", "lang", "source", "text", ref("allergens_tags").alias("ref_declared"), ref("traces_tags").alias("ref_trace"), F.col("declared_allergens").alias("pred_declared"), F.col("trace_allergens").alias("pred_trace"), F.col("risk").alias("pred_risk"))
        return out.withColumn("ref_risk", general_risk(F.col("ref_declared"), F.col("ref_trace")))

    @cached_property
    def references(self) -> DataFrame:
        """(code, ref): declared reference sets, without matching anything."""
        return self.labels.select("code", tags_to_allergens(parse_tags(F.col("allergens_tags"), "eval"), "eval").alias("ref"))

    def versions(self, *more: str) -> tuple[DataFrame, DataFrame]:
        """(code, more, ref_declared, pred_declared) of evaluated, and of a second, weaker version of the predictions: terms without rules.

        Labels are judged once for both.
        """
        both = self._evaluated(match.analyze(self.labels, self.vocab, unruled=True), "declared_unruled")
        both = stored(both.select("code", *more, "ref_declared", "pred_declared", "declared_unruled"), "versions")
        found = both.select("code", F.explode("declared_unruled").alias("a")).groupBy("code").agg(F.array_sort(F.collect_set("a")).alias("p"))
        after = both.drop("declared_unruled")
        return after, after.join(found, "code", "left").withColumn("pred_declared", F.coalesce("p", F.array().cast("array<string>"))).drop("p")

    @cached_property
    def corpus_raw(self) -> DataFrame:
        """(allergen, raw): all raw words of the documents, with a group by their normalised length."""
        words = self.table("documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "[ \n]"))).alias("raw")).distinct()
        terms = words.withColumn("term", normalize(F.col("raw"))).where("term <> ''")
        return terms.select(F.concat(F.lit("g"), (F.length("term") % 9).cast("string")).alias("allergen"), "raw", "term")

    @cached_property
    def corpus_vocab(self) -> DataFrame:
        return self.corpus_raw.select("allergen", "term").distinct()

    @cached_property
    def prose(self) -> DataFrame:
        """(code, section, text) of the documents themselves, normalised."""
        return self.table("documents").select(F.col("doc_id").cast("string").alias("code"), F.lit("text").alias("section"), normalize(F.col("text")).alias("text")).where("text <> ''")

    @cached_property
    def scans(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for kv in {"click": "SAFE", "view": "CAUTION", "error": "AVOID", "purchase": "UNKNOWN"}.items() for x in kv])
        return self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("SAFE")).alias("verdict"))

    @cached_property
    def profiles(self) -> DataFrame:
        """(user_id, profile): JSON lists and comma-separated entries, some blank, some unknown."""
        a = F.array(*[F.lit(x) for x in ("milk", "gluten", "peanuts", "tree nuts", "soy", "eggs", "fish", "other", "sesame")])
        one, two = F.get(a, F.col("c_nationkey") % 9), F.get(a, ((F.col("c_custkey") * 5 + 1) % 9).cast("int"))
        text = F.when(F.col("c_custkey") % 6 == 0, "").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('["'), one, F.lit('", "'), two, F.lit('"]'))).otherwise(F.concat(one, F.lit(", "), two, F.when(F.col("c_custkey") % 5 == 0, ", kiwi").otherwise("")))
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), text.alias("profile"))

    @cached_property
    def lines(self) -> DataFrame:
        """OCR lines of two passes: the documents' lines with a heading and a stop line put in."""
        docs = self.table("documents").select("doc_id", F.split(F.concat(F.lit("Produkt\n"), F.when(F.col("doc_id") % 3 == 0, "Ingredients: ").when(F.col("doc_id") % 3 == 1, "lngredients\n").otherwise(""), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "\nNutrition facts\nsalt 1 g").otherwise("")), "\n").alias("ls"))
        long = docs.select(F.col("doc_id").alias("image_id"), F.posexplode("ls").alias("line_no", "text"))
        both = long.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2))))
        return both.withColumn("confidence", ((F.col("image_id") * 31 + F.col("line_no") * F.col("pass")) % 100).cast("double") / 100)

    @cached_property
    def pairs(self) -> DataFrame:
        """(image_id, lang, reference, predicted): each document's text, and the same with every third word of a line gone or changed."""
        bad = lambda w, i: F.when((i + F.col("doc_id")) % 3 != 0, w).when(F.col("doc_id") % 2 == 0, F.concat(w, F.lit("x")))
        lines = F.transform(F.split("text", "\n"), lambda l: F.array_join(F.transform(F.split(l, " "), bad), " "))
        docs = self.table("documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
        return docs.select(F.col("doc_id").alias("image_id"), "lang", F.col("text").alias("reference"), F.array_join(lines, "\n").alias("predicted"))

    @cached_property
    def phrases(self) -> DataFrame:
        """All vectors that stand for no term."""
        return self.table("embeddings").where("vec_id % 10 <> 0 or vec_id >= 3000").select((F.col("vec_id") % 200).cast("string").alias("code"), F.col("vec_id").alias("pos"), F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("phrase"), F.col("embedding").alias("vector"))

    @cached_property
    def term_rows(self) -> DataFrame:
        """One in ten of the first 3000 vectors stands for a vocabulary's terms, which does not grow with the corpus."""
        return self.table("embeddings").where("vec_id % 10 = 0 and vec_id < 3000").select(F.get(F.array(*map(F.lit, ALLERGENS)), (F.abs("label") % 9).cast("int")).alias("allergen"), F.concat(F.lit("term "), F.col("vec_id").cast("string")).alias("term"), F.col("embedding").alias("vector"))

    @cached_property
    def score_table(self) -> DataFrame:
        return self.table("labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 100) / 100.0 * 0.6 + F.col("quality") * 0.3).alias("p"), (F.col("doc_id") % 97 / 97.0).alias("x"))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir)
