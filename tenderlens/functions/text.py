"""Text keys and tokens as plain column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored by the tokeniser (accents already removed).
STOPWORDS = [
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "a", "au", "aux", "en",
    "pour", "sur", "dans", "par", "avec", "ce", "ces", "sa", "son", "ses", "est", "sont",
]

# Prefixes split off compound words; the first that fits wins.
PREFIXES = [
    "cyber", "tele", "multi", "pluri", "auto", "socio", "geo", "bio", "eco", "micro",
    "macro", "inter", "intra", "pre", "post", "sous", "sur", "anti", "pro", "co",
]

_NON_ASCII = r"[^\x00-\x7F]"
_APOSTROPHE = "’"
_MARK = "\x02"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Every character whose compatibility decomposition keeps some ASCII."""
    single_from, single_to, multi = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        kept = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(kept) == 1:
            single_from.append(char)
            single_to.append(kept)
        elif kept:
            multi.append((char, kept))
    return "".join(single_from), "".join(single_to), multi


def accent_fold(text: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII.

    One ``translate`` maps the one-to-one characters and marks the rare one-to-many
    ones; only rows with a mark take the slower replacement path, and pure ASCII
    rows skip everything.
    """
    source, target, multi = _fold_tables()
    wide = "".join(a for a, _ in multi)
    once = F.translate(text, source + wide, target + _MARK * len(wide))
    # Two literals, cut by constant-folded splits: the characters and what replaces them.  The
    # few that a text holds are looked for where it is not ASCII, and replaced one by one.
    table = F.map_from_arrays(*[F.split(F.lit("\x01".join(column)), "\x01") for column in zip(*multi, strict=True)])
    rare = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    present = F.array_distinct(F.regexp_extract_all(rare, F.lit(f"[{wide}]"), F.lit(0)))
    expanded = F.aggregate(present, text, lambda acc, c: F.replace(acc, c, F.element_at(table, c)))
    folded = F.when(F.contains(once, F.lit(_MARK)), F.translate(expanded, source, target)).otherwise(once)
    return F.when(text.rlike(_NON_ASCII), F.regexp_replace(folded, _NON_ASCII, "")).otherwise(text)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_key(text: Column) -> Column:
    """Trim, lower case, fold accents."""
    return accent_fold(F.lower(strip_space(text)))


def category_key(text: Column) -> Column:
    """Key that also unifies apostrophes, a lone ``d`` and repeated spaces."""
    folded = accent_fold(F.replace(F.lower(strip_space(text)), F.lit(_APOSTROPHE), F.lit("'")))
    return collapse_space(F.replace(folded, F.lit(" d "), F.lit(" d'")))


def relevance_key(text: Column) -> Column:
    """Key for keyword relevance: apostrophes count as spaces."""
    spaced = F.translate(F.lower(text), _APOSTROPHE + "'", "  ")
    return collapse_space(accent_fold(spaced))


def keyword_keys(keywords: Column) -> Column:
    """Relevance keys of a keyword list; computed once per query, not per text."""
    return F.transform(keywords, relevance_key)


def text_key(text: Column) -> Column:
    """Relevance key of a text; a missing one reads ``nan``, as text conversion gives."""
    return relevance_key(F.coalesce(text, F.lit("nan")))


def is_relevant(key: Column, keywords: Column) -> Column:
    """True when a text key contains any of the keyword keys.

    The key is bound as a lambda variable so that it is computed once per row.
    """
    return F.exists(F.array(key), lambda t: F.exists(keywords, lambda k: F.contains(t, k)))


def tokens(text: Column) -> Column:
    """Word list without stop words and one-letter words, compounds also split.

    The folded text is rewritten as a whole (stop words blanked, prefix and stem
    written after their compound) and cut once, so no lambda runs per word.
    """
    folded = accent_fold(F.lower(F.coalesce(text, F.lit(""))))
    kept = F.regexp_replace(folded, r"\b(?:\w|" + "|".join(STOPWORDS) + r")\b", " ")
    split = F.regexp_replace(kept, r"\b(" + "|".join(PREFIXES) + r")(\w{4,})", "$0 $1 $2")
    return F.regexp_extract_all(split, F.lit(r"\w+"), F.lit(0))
