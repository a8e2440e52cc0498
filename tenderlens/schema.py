"""Column names of the contract table and the default 22-column projection."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns kept by the default scan.
CORE_COLUMNS = [
    "uid", "id", "nature", "acheteur_id", "acheteur_nom", "titulaire_id", "titulaire_nom",
    "objet", "montant", "type", "codeCPV", "procedure", "dureeMois", "offresRecues",
    "dateNotification", "datePublicationDonnees", "acheteur_region_nom",
    "acheteur_departement_nom", "titulaire_region_nom", "modification_id",
    "donneesActuelles", "sourceDataset",
]

DATE_COLUMNS = ["dateNotification", "datePublicationDonnees"]
CURRENT_FLAG = "donneesActuelles"

VECTOR_SCHEMA = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])
