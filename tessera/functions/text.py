"""Text functions C01-C16, E14 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded by the short accent table (fixed values).
ACCENTED, PLAIN = "àâäçéèêëîïôöùûüÿñáíóúÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚ", "aaaceeeeiioouuuynaiouAAACEEEEIIOOUUUNAIOU"
#: Function words that tell French from English, and the letters that words are made of.
FRENCH = ("le", "la", "les", "des", "une", "un", "du", "de", "et", "est", "sur", "avec", "pour", "dans", "cette", "ses", "son", "aux", "au")
ENGLISH = ("the", "a", "an", "of", "and", "is", "on", "with", "for", "in", "this", "its", "his", "her", "to", "at", "are", "was")
LETTERS = "a-zàâçéèêëîïôûùüÿñæœ'"
#: Abbreviations whose stop ends no sentence.
ABBREVIATIONS = ("M", "Mme", "Dr", "St", "etc", "cf", "p", "ex")
#: What a predicate's signature leaves out, in the order it is tried.
PREFIXES, SUFFIXES, ARTICLES, ENDINGS = ("is_", "has_", "was_", "were_"), ("_of", "_to", "_for"), ("the", "a", "an"), ("ing", "ed", "es", "s")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def tokens(c: Column) -> Column:
    """Lower-case words split at white space; empty text has none."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def sentence_count(c: Column) -> Column:
    """Parts between runs of stops, exclamation or question marks that white space or the end follows; abbreviations end none."""
    guarded = F.regexp_replace(c, f"(^|[^A-Za-z0-9_])({'|'.join(ABBREVIATIONS)})\\.", "$1$2")
    parts = F.split(F.regexp_replace(guarded, r"[.!?]+(\s|$)", "\x01"), "\x01")
    return F.size(F.filter(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).cast("long")


def language_guess(c: Column) -> Column:
    """By counts of function words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"([{LETTERS}]+)"), 1)
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    fr, en = count(FRENCH), count(ENGLISH)
    return F.when(fr > en, "fr").when(en > fr, "en").otherwise("undecided")


def without_headings(c: Column) -> Column:
    """A text's lines but those of Markdown headings (C11)."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~F.ltrim(line).startswith("#")), "\n")


def fenced_json(c: Column, stop_reason: Column) -> Column:
    """The JSON object of a model's answer as text, code fence taken off; null if the answer was cut off or holds no object."""
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_extract(raw, r"(?s)^```[^\n]*\n(.*)$", 1)
    inner = F.when(inner.contains("```"), F.regexp_extract(inner, r"(?s)^(.*)```", 1)).otherwise(inner)
    bare = F.when(raw.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(raw)
    is_object = bare.startswith("{") & F.try_parse_json(bare).isNotNull()
    return F.when((F.coalesce(stop_reason, F.lit("")) != "max_tokens") & F.coalesce(is_object, F.lit(False)), bare)


def urls(c: Column) -> Column:
    """Links in the order of their first mention, trailing punctuation cut."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"']+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def html_title(c: Column) -> Column:
    return squeeze(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(c: Column) -> Column:
    """Visible text: script, style, nav and head blocks and all tags go, the five basic entities are decoded, white space is squeezed."""
    for block in ("script", "style", "nav", "head", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{block}(?![0-9A-Za-z_]).*?</{block}>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return squeeze(c)


def nullable_text(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("", "null", "none"), None).otherwise(c)


def predicate_signature(c: Column) -> Column:
    """Words of a predicate without empty affixes, articles and the endings of plural and past, sorted."""
    bare = F.trim(F.lower(c))
    for affix in (*(f"^{p}" for p in PREFIXES), *(f"{x}$" for x in SUFFIXES)):
        bare = F.regexp_replace(bare, affix, "")
    ending = f"({'|'.join(ENDINGS)})$"
    stems = F.transform(F.split(bare, r"[_\s]+"), lambda t: F.when(t.isin(*ARTICLES), "").when(F.length(t) > 4, F.regexp_replace(t, ending, "")).otherwise(t))
    return F.array_join(F.array_sort(F.filter(stems, lambda t: t != "")), " ")
