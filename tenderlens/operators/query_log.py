"""A table of natural-language queries turned into filter columns and free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known regions in their listed order.
REGIONS = [
    "Auvergne-Rhône-Alpes", "Bourgogne-Franche-Comté", "Bretagne", "Centre-Val de Loire",
    "Corse", "Grand Est", "Guadeloupe", "Guyane", "Hauts-de-France", "La Réunion",
    "Martinique", "Mayotte", "Normandie", "Nouvelle-Aquitaine", "Nouvelle-Calédonie",
    "Occitanie", "Pays de la Loire", "Polynésie française", "Provence-Alpes-Côte d'Azur",
    "Saint-Barthélemy", "Saint-Martin", "Saint-Pierre-et-Miquelon", "Wallis-et-Futuna",
    "Île-de-France",
]

# Patterns of an explicit and of a qualitative minimum amount.
EXPLICIT_AMOUNT = (r"(?:sup[ée]rieur[e]?\s+[àa]|plus\s+de)\s+([\d\s]+(?:[.,]\d+)?)"
                   r"\s*(?:€|euros?)?")
HIGH_AMOUNT = r"montants?\s+[ée]lev[ée]s?|gros\s+montants?"

# Connecting words trimmed from both ends of the free text.
CONNECTORS = ["en", "de", "du", "des", "et", "à", "au", "aux"]

_FLAGS = "(?iU)"


def _find_region(query: Column) -> Column:
    """First known region contained in the query, longest name first."""
    lowered = F.lower(query)
    by_length = sorted(REGIONS, key=len, reverse=True)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(r.lower())), F.lit(r)) for r in by_length])


def with_region(queries: DataFrame, text: str = "requete") -> DataFrame:
    """Adds ``region`` and ``_rest``, the query without any mention of it."""
    found = queries.withColumn("region", _find_region(F.col(text)))
    pattern = F.concat(F.lit("(?iu)\\Q"), F.col("region"), F.lit("\\E"))
    return found.withColumn("_rest", F.when(
        F.col("region").isNotNull(), F.regexp_replace(F.col(text), pattern, F.lit(""))
    ).otherwise(F.col(text)))


def with_amount(queries: DataFrame, text: str = "_rest") -> DataFrame:
    """Adds ``montant_min`` and ``montant_eleve_qualitatif``, drops their mention.

    An explicit amount that does not read as a number falls through to the
    qualitative pattern.
    """
    rest = F.col(text)
    digits = F.regexp_extract(rest, _FLAGS + EXPLICIT_AMOUNT, 1)
    number = F.replace(F.replace(digits, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    out = queries.withColumn("montant_min", number.try_cast("double"))
    high = F.col("montant_min").isNull() & rest.rlike(_FLAGS + HIGH_AMOUNT)
    out = out.withColumn("montant_eleve_qualitatif", high)
    return out.withColumn("_rest", F.when(
        F.col("montant_min").isNotNull(), F.regexp_replace(rest, _FLAGS + EXPLICIT_AMOUNT, "")
    ).when(F.col("montant_eleve_qualitatif"), F.regexp_replace(rest, _FLAGS + HIGH_AMOUNT, "")
           ).otherwise(rest))


def free_text(rest: Column) -> Column:
    """Collapsed spaces, bare ends, no connecting words at either end."""
    words = "|".join(CONNECTORS)
    steps = [
        (r"(?U)\s+", " "),
        (r"^[ ,.]+|[ ,.]+$", ""),
        (rf"(?iu)^(?:(?:{words})(?:\s+|$))+", ""),
        (rf"(?iu)(?:(?:^|\s+)(?:{words}))+$", ""),
    ]
    return reduce(lambda value, step: F.regexp_replace(value, *step), steps, rest)


def parse_queries(queries: DataFrame, text: str = "requete") -> DataFrame:
    """Adds region, montant_min, montant_eleve_qualitatif and texte_libre."""
    return queries.transform(lambda d: with_region(d, text)).transform(with_amount).withColumn(
        "texte_libre", free_text(F.col("_rest"))).drop("_rest")
