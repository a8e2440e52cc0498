"""Given tables seen as contracts, a text corpus, a query log, vectors and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_KEYS = ["uid", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "datePublicationDonnees"]
TIE_BREAK = ROW_KEYS[1:]
DATE_LOW, DATE_HIGH = "1995-01-01", "1999-12-31"

# Language of a text -> region of its buyer.
REGION_OF_LANG = {"en": "Île-de-France", "fr": "Bretagne", "de": "Grand Est", "es": "Occitanie"}

# Filter phrases added to the query texts, chosen by item number.
PHRASES = ["", " en Île-de-France", " en bretagne de montant élevé", " supérieur à 1 500,5 euros",
           " plus de 2000€ en GRAND EST", " de gros montants en Occitanie"]
# Queries that are filters only, one per row of the region table.
FILTER_ONLY = ["en Bretagne", "plus de 3000 euros", "montant élevé en Île-de-France",
               "de la  Grand Est, et", "Corse"]

# Test themes in the invented vocabulary: query text, keywords, vector used as query vector.
THEMES = {
    "t_ention": ("ention edtion hation en Île-de-France de montant élevé", ["Ention", "hetion"], 3),
    "t_inging": ("inging thshing nttion", ["inging", "ingble"], 5),
    "t_enlich": ("enlich enheit erkeit plus de 500 euros", ["enkeit", "énlich"], 8),
    "t_cionas_difficile": ("cionas cionue cionado", ["cionos", "cion ll"], 11),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows of a table with fewer files than cores (the given ones hold one
    row group each), so that text work is not one task; larger tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def contracts(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """Grain order x supplier, as (contract x holder); ``full`` adds descriptive columns."""
    def t(name):
        return table(spark, sf_dir, name)

    df = (t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey"))
          .join(t("part"), F.expr("l_partkey = p_partkey"))
          .join(t("customer"), F.expr("o_custkey = c_custkey"))
          .join(t("nation"), F.expr("c_nationkey = n_nationkey"))
          .join(t("region"), F.expr("n_regionkey = r_regionkey")))
    columns = {
        "uid": "o_orderkey",
        "titulaire_id": "case when l_linenumber <> 7 then l_suppkey end",
        "acheteur_id": "c_custkey",
        "objet": "p_name",
        "montant": "case when o_orderkey % 50 <> 0 then o_totalprice end",
        "montant_signe": "c_acctbal",
        "type": "p_type",
        "codeCPV": "case when o_orderkey % 97 <> 0 then concat(lpad(cast(p_size as string), 2, '0'), "
                   "lpad(cast(l_partkey % 1000000 as string), 6, '0')) end",
        "procedure": "case when o_orderkey % 2 = 0 then lower(o_orderpriority) else o_orderpriority end",
        "nature": "element_at(array('Marché', 'MARCHE', 'marché ', 'Accord cadre'), cast(o_orderkey % 4 as int) + 1)",
        "dureeMois": "l_quantity",
        "offresRecues": "case when o_orderstatus <> 'P' then cast(l_linenumber - 1 as double) end",
        "dateNotification": "o_orderdate",
        "datePublicationDonnees": "l_shipdate",
        "acheteur_region_nom": "r_name",
        "acheteur_departement_nom": "n_name",
        "modification_id": "l_linenumber",
        "donneesActuelles": "case when l_partkey % 101 <> 0 then l_linestatus = 'O' end",
        "sourceDataset": "l_returnflag",
        "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
        "l_extendedprice": "l_extendedprice",
    }
    if full:
        df = df.join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
        columns |= {"id": "concat(o_orderkey, '-', l_linenumber)", "acheteur_nom": "c_name",
                    "titulaire_nom": "s_name", "titulaire_region_nom": "cast(s_nationkey as string)"}
    return df.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def signed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose amount may be negative; gaps kept."""
    return contracts(spark, sf_dir).withColumn(
        "montant", F.when(F.col("montant").isNotNull(), F.col("montant_signe"))).drop("montant_signe")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contracts with a text."""
    names = F.create_map(*[F.lit(x) for pair in REGION_OF_LANG.items() for x in pair])
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("uid"), F.col("text").alias("objet"),
        F.col("n_chars").cast("double").alias("montant"),
        names[F.col("lang")].alias("acheteur_region_nom"))


CORPUS_KEYS = ["uid"]


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with filter phrases, and filter-only queries."""
    phrase = F.array(*[F.lit(p) for p in PHRASES])
    texts = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat("text", F.element_at(phrase, (F.col("item_id") % len(PHRASES)).cast("int") + 1)).alias("requete"))
    only = F.array(*[F.lit(p) for p in FILTER_ONLY])
    filters = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 100_000).cast("long").alias("query_id"),
        F.element_at(only, (F.col("r_regionkey") % len(FILTER_ONLY)).cast("int") + 1).alias("requete"))
    return texts.unionByName(filters)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with a query's number stands for the encoded query."""
    return vectors(spark, sf_dir).select(F.col("uid").alias("query_id"), F.col("vec").alias("qvec"))


def two_models(frame: DataFrame, column: str) -> DataFrame:
    """Two vector sets: the whole vectors and their first half."""
    return frame.select("*", F.inline(F.array(
        F.struct(F.lit("entier").alias("model"), F.col(column).alias("_v")),
        F.struct(F.lit("moitie").alias("model"), F.slice(column, 1, 32).alias("_v"))))
    ).drop(column).withColumnRenamed("_v", column)


def theme_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n, v) for n, (_, _, v) in THEMES.items()], "query_id string, uid long")
    return vectors(spark, sf_dir).join(names, "uid").select("query_id", F.col("vec").alias("qvec"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as further queries (text only)."""
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("requete"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels on documents; the theme is assigned by document number."""
    names = F.array(*[F.lit(n) for n in THEMES], F.lit("inconnue"))
    docs = table(spark, sf_dir, "documents")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.element_at(names, (F.col("doc_id") % (len(THEMES) + 1)).cast("int") + 1).alias("requete"),
        F.col("text").alias("objet"), F.col("quality").alias("pertinent"))
