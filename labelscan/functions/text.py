"""Text scalars: Column -> Column, built-in expressions only."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"\p{L}\p{N}_"
#: Stands for a character of expansions() while a text is normalised; in a text it is no letter.
SEVERAL = "\x01"


@lru_cache
def marks() -> str:
    """The combining characters of the basic plane."""
    return "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)).startswith("M"))


@lru_cache
def expansions() -> dict[str, str]:
    """Small characters of the basic plane that stand for several letters or digits (ligatures, fractions), and these."""
    out = {}
    for code in [*range(0x80, 0xAC00), *range(0xF900, 0xFE70)]:  # no Hangul syllables, surrogates or Arabic forms
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        base = " ".join("".join(x if x.isalnum() else " " for x in base).split())
        if len(base) > 1 and not 0xFB50 <= code <= 0xFDFF:
            out[c] = base
    return out | {"œ": "oe", "æ": "ae"}


def _ranges(characters: str, gap: int = 8) -> str:
    """A pattern's class that covers the characters by a few ranges."""
    codes = sorted(map(ord, characters))
    cuts = [0, *(i for i in range(1, len(codes)) if codes[i] - codes[i - 1] > gap), len(codes)]
    return "[" + "".join(f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(cuts, cuts[1:], strict=False)) + "]"


@lru_cache
def accents() -> tuple[str, str]:
    """Characters that decompose into one base character and marks, and these bases, over the basic plane."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x)]
        if 0xD800 <= code <= 0xDFFF or len(base) != 1 or base[0] == c:
            continue
        source.append(c)
        target.append(base[0])
    return "".join(source), "".join(target)


def strip_all(c: Column) -> Column:
    """trim() of all white space, not of spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column, strip_underscore: bool = True) -> Column:
    """Lower case, ligatures spelled out, accents and punctuation gone, single spaces; "" for null.

    strip_underscore=False keeps underscores, as older results had it. Characters that stand for several letters or
    digits are spelled out, but for Hangul syllables and Arabic presentation forms.
    """
    table = expansions()
    names = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in table.items())), F.lit(";"), F.lit("="))
    beyond = lambda t: F.octet_length(t) > F.length(t)
    source, target = accents()

    def bare(t: Column) -> Column:
        """One pass: accents and marks gone, characters that stand for several marked."""
        seen = "".join(table)
        return F.when(beyond(t), F.translate(t, source + seen + marks(), target + SEVERAL * len(seen))).otherwise(t)

    def spelled(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"({_ranges(''.join(table))})"), F.lit(1)))
        return F.aggregate(found, t, lambda s, x: F.replace(s, x, F.coalesce(F.try_element_at(names, x), x)))

    def words(t: Column) -> Column:
        any_, plain = (r"[^\p{L}\p{N}]+", "[^a-z0-9]+") if strip_underscore else (rf"[^{LETTER}]+", "[^a-z0-9_]+")
        return F.when(beyond(t), F.regexp_replace(F.regexp_replace(t, r"\p{M}", ""), any_, " ")).otherwise(F.regexp_replace(t, plain, " "))

    # one element at a time: what a step names several times is worked out, and stands in the plan, once
    t = F.transform(F.array(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(SEVERAL), F.lit(" "))), lambda t: F.named_struct(F.lit("t"), t, F.lit("b"), bare(t)))
    t = F.transform(t, lambda x: F.when(x["b"].contains(SEVERAL), F.transform(F.array(spelled(x["t"])), bare)[0]).otherwise(x["b"]))
    return F.trim(F.transform(t, words)[0])


def plain(s: str) -> str:
    """normalize() of a Python string, for phrases that are known beforehand."""
    t = unicodedata.normalize("NFKD", s.lower().replace("œ", "oe").replace("æ", "ae"))
    return " ".join("".join(x if x.isalnum() else " " for x in t if not unicodedata.combining(x)).split())


def normalize_latin(c: Column) -> Column:
    """A tag without its language prefix: Latin letters, digits and single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "^[a-z]{2,3}:", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9à-ÿ]+", " "))


def normalize_ocr(c: Column) -> Column:
    """Lower case, one space for white space, letters, digits and the punctuation of labels only."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"[^{LETTER} %.,;:()'/+-]", " "), " +", " "))


def normalize_heading(c: Column) -> Column:
    """A line as headings are compared: lower case, letters and single spaces."""
    return F.trim(F.regexp_replace(normalize(c), r"[^\p{L}]+", " "))


def clean_ocr_text(c: Column) -> Column:
    """Spaces and tabs run together, no space before punctuation, at most one empty line."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ([,.;:)])", "$1")
    return strip_all(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether normalised text holds the normalised phrase as whole words: text is letters, digits and single spaces."""
    return (phrase != "") & padded(text).contains(padded(phrase))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: padded(text).contains(p))


def raw_phrase_in(phrase: Column, text: Column) -> Column:
    """Bounded test without normalising: no letter, digit or underscore on either side, case ignored."""
    p, t = F.lower(phrase), F.lower(F.coalesce(text, F.lit("")))
    # all bounded places at once: what stands around each occurrence of the phrase
    parts = F.split(t, F.concat(F.lit(r"\Q"), p, F.lit(r"\E")), -1)
    # nothing between two occurrences: each has a letter beside it
    parts = F.transform(parts, lambda x, i: F.when((x == "") & (i > 0) & (i < F.size(parts) - 1), F.lit("x")).otherwise(x))
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), lambda a, b: ~a.rlike(rf"[{LETTER}]$") & ~b.rlike(rf"^[{LETTER}]"))
    return (p != "") & (F.size(parts) > 1) & F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def ingredient_phrases(c: Column) -> Column:
    """Phrases between commas and semicolons (Latin or Arabic) of at least three characters and two words, normalised."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;،؛]"), lambda x: normalize(x))
    return F.filter(parts, lambda x: (F.length(x) >= 3) & x.contains(" "))


def clauses(c: Column) -> Column:
    """Stretches between full stops and semicolons of at least three characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.;]"), strip_all), lambda x: F.length(x) >= 3)


def parse_set(c: Column, separator: str = "|", allowed: list[str] | None = None) -> Column:
    """Sorted distinct entries of a delimited column; blank or null is the empty set."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"\Q{separator}\E"), strip_all), lambda x: x != "")
    if allowed is not None:
        parts = F.filter(parts, lambda x: x.isin(allowed))
    return F.array_sort(F.array_distinct(parts))


def joined(c: Column, separator: str = "|") -> Column:
    return F.array_join(c, separator)


def cer(reference: Column, predicted: Column) -> Column:
    """Character error rate of normalised texts; against an empty reference 0 if both are empty and else 1."""
    r, p = normalize_ocr(reference), normalize_ocr(predicted)
    return F.when(r == "", (p != "").cast("double")).otherwise(F.levenshtein(r, p) / F.length(r))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def word_distance(r: Column, p: Column, words: Column | None = None) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one character (there are over a million).

    words: the distinct words as a column of their own, which else are worked out anew for each word.
    """
    words = F.array_distinct(F.concat(r, p)) if words is None else words

    def letter(w: Column) -> Column:
        at = F.array_position(words, w) + 255
        point = F.when(at < 0xD800, at).otherwise(at + 0x800)  # surrogates are no characters
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    code = lambda ws: F.array_join(F.transform(ws, letter), "")
    return F.levenshtein(code(r), code(p))


def wer(reference: Column, predicted: Column) -> Column:
    """Word error rate: as cer(), with words for characters."""
    r, p = (split_words(normalize_ocr(c)) for c in (reference, predicted))
    return F.when(F.size(r) == 0, (F.size(p) > 0).cast("double")).otherwise(word_distance(r, p) / F.size(r))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance relative to the longer of two strings."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
