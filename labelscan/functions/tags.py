"""Reference tags: parsing and mapping, by dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscan.functions.text import normalize, strip_all

ALLERGENS = ("wheat_gluten", "milk", "egg", "peanut", "tree_nut", "soy", "sesame", "fish", "shellfish")
DISPLAY = dict(zip(ALLERGENS, ("Wheat / gluten", "Milk", "Egg", "Peanut", "Tree nuts", "Soy", "Sesame", "Fish", "Shellfish"), strict=True))

#: Tags of the evaluation dialect (fixed values).
EVAL_TAGS = {
    "en:gluten": "wheat_gluten", "en:wheat": "wheat_gluten", "en:milk": "milk", "en:eggs": "egg", "en:peanuts": "peanut", "en:nuts": "tree_nut",
    "en:soybeans": "soy", "en:sesame-seeds": "sesame", "en:fish": "fish", "en:crustaceans": "shellfish", "en:molluscs": "shellfish",
}
#: What the other dialects change in it (fixed values).
TAGS = {
    "eval": EVAL_TAGS,
    "ocr": EVAL_TAGS | {"en:egg": "egg", "en:soy": "soy", "en:tree-nuts": "tree_nut", "en:sesame": "sesame"},
    "sampling": EVAL_TAGS | {"en:dairy": "milk", "en:shellfish": "shellfish"},
    "collect": {k: v for k, v in EVAL_TAGS.items() if k not in ("en:wheat", "en:molluscs", "en:sesame-seeds")} | {"en:sesame": "sesame"},
}
#: Normalised names of the multilingual dialect (own list); a final s may be missing.
NAMES = {
    "gluten": "wheat_gluten", "wheat": "wheat_gluten", "ble": "wheat_gluten", "weizen": "wheat_gluten", "trigo": "wheat_gluten", "milk": "milk", "lait": "milk", "milch": "milk", "leche": "milk",
    "eggs": "egg", "oeufs": "egg", "eier": "egg", "huevos": "egg", "peanuts": "peanut", "arachides": "peanut", "nuts": "tree_nut", "soybeans": "soy", "soja": "soy",
    "sesame": "sesame", "sesamo": "sesame", "fish": "fish", "poisson": "fish", "fisch": "fish", "pescado": "fish", "crustaceans": "shellfish", "molluscs": "shellfish",
}
DIALECTS = ("multilingual", "multilingual_legacy", "eval", "ocr", "sampling", "collect", "diagnose")


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def parse_tags(c: Column, dialect: str = "eval") -> Column:
    """Tags of a stringified list or a delimited string, in order; null is the empty list.

    sampling reads list literals only; ocr picks one separator (the first present of | ; ,), the others split at any
    of them. The multilingual dialects drop a language prefix and normalise.
    """
    t = strip_all(F.coalesce(c, F.lit("")))
    quoted = F.regexp_extract_all(t, F.lit("['\"]([^'\"]*)['\"]"), F.lit(1))
    if dialect == "sampling":
        plain = F.array().cast("array<string>")
    elif dialect == "ocr":
        plain = F.when(t.contains("|"), F.split(t, r"\|")).when(t.contains(";"), F.split(t, ";")).otherwise(F.split(t, ","))
    else:
        plain = F.split(t, "[,;|]")
    parts = F.transform(F.when(t.startswith("["), quoted).otherwise(plain), strip_all)
    if dialect.startswith("multilingual") or dialect == "diagnose":
        parts = F.transform(parts, lambda x: normalize(F.regexp_replace(x, "^[a-zA-Z]{2}:", "")))
    else:
        parts = F.transform(parts, F.lower)
    return F.filter(parts, lambda x: x != "")


def tags_to_allergens(c: Column, dialect: str = "eval") -> Column:
    """Sorted allergen ids of parsed tags; tags without one are left out."""
    if dialect.startswith("multilingual") or dialect == "diagnose":
        names = _literal_map(NAMES | {k.removesuffix("s"): v for k, v in NAMES.items()})
        bare = (lambda x: F.rtrim(x, F.lit("s"))) if dialect == "multilingual_legacy" else (lambda x: F.regexp_replace(x, "s$", ""))
        found = F.transform(c, lambda x: F.coalesce(F.try_element_at(names, x), F.try_element_at(names, bare(x))))
    else:
        names = _literal_map(TAGS[dialect])
        found = F.transform(c, lambda x: F.try_element_at(names, x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


#: Other names that a profile may use (own list); "other" is accepted and never detected.
ALIASES = {a: a for a in ALLERGENS} | {"gluten": "wheat_gluten", "wheat": "wheat_gluten", "dairy": "milk", "eggs": "egg", "peanuts": "peanut", "nuts": "tree_nut", "tree nuts": "tree_nut", "soya": "soy", "crustaceans": "shellfish", "other": "other"}


def parse_profile(c: Column) -> Column:
    """struct(allergens, unsupported) of a profile: a JSON list, a JSON string or comma-separated; both empty for a blank one.

    Entries keep their order and count once.
    """
    t = strip_all(F.coalesce(c, F.lit("")))
    listed = F.from_json(t, "array<string>")
    quoted = F.when(t.startswith('"'), F.regexp_replace(t, '^"|"$', "")).otherwise(t)
    entries = F.when(t.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(quoted, ","))
    entries = F.filter(F.transform(entries, lambda x: F.trim(F.regexp_replace(F.lower(strip_all(x)), "[_-]+", " "))), lambda x: x != "")
    names = _literal_map({k.replace("_", " "): v for k, v in ALIASES.items()})
    known = F.array_distinct(F.filter(F.transform(entries, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull()))
    unknown = F.array_distinct(F.filter(entries, lambda x: F.try_element_at(names, x).isNull()))
    return F.struct(known.alias("allergens"), unknown.alias("unsupported"))
