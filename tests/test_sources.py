import re

import pytest
from pyspark.sql import functions as F

from tenderlens.operators.cleaning import clean
from tenderlens.runtime import materialize, shared_dir
from tenderlens.sources import exports
from tenderlens.sources.vector_store import append_vectors, missing_uids, read_vectors, upsert_vectors
from tenderlens.streaming import flag_amounts, parse_queries


def sheet_rows(spark):
    return spark.createDataFrame([
        ("q1", 1, 'texte "cité", avec\nsaut', 10.0, "Bretagne"), ("q1", 2, "deux", None, None),
        ("q1", 3, "trois", 1.0, "Corse"), ("q2", 1, "un; deux", 2.5, "Corse")],
        "requete string, rank int, objet string, montant double, acheteur_region_nom string")


def test_annotation_round_trip(spark, tmp_path):
    sheet = exports.annotation_sheet(sheet_rows(spark), top_k=2)
    assert sheet.count() == 3 and sheet.filter("rang > 2").isEmpty()
    exports.write_annotation_sheet(sheet, str(tmp_path / "sheet"))
    part = next((tmp_path / "sheet").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    with pytest.raises(ValueError, match="3 row"):
        exports.load_annotations(spark, str(part))
    filled = re.sub(r',(?:"")?\n(?=q|$)', ",1\n", part.read_text("utf-8-sig"))
    (tmp_path / "filled.csv").write_text(filled, "utf-8-sig")
    got = exports.load_annotations(spark, str(tmp_path / "filled.csv"))
    assert got.columns == ["requete", "rang", "objet", "montant", "region", "pertinent"]
    assert got.filter("pertinent = 1").count() == 3
    assert got.filter("requete = 'q1' and rang = 1").first()["objet"] == 'texte "cité", avec\nsaut'


def test_semicolon_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("requete;rang;objet;montant;region;pertinent\nq;1;a, b;1.0;R;0\nq;2;c;;R;1\n")
    got = exports.load_annotations(spark, str(tmp_path / "s.csv"))
    assert [(r["objet"], r["pertinent"]) for r in got.orderBy("rang").collect()] == [("a, b", 0), ("c", 1)]


def test_csv_export(spark, tmp_path):
    exports.write_csv(sheet_rows(spark), str(tmp_path / "out"), ["requete", "rank"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["requete", "rank"]


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_vectors(spark, path).isEmpty()
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([("a", "x"), ("b", "xyz")], "uid string, objet string")
    assert upsert_vectors(texts.limit(1), path, "m", encoder).count() == 1
    stored = upsert_vectors(texts, path, "m", encoder)
    assert calls.value == 2 and stored.count() == 2
    assert stored.select(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("n")).filter(
        "abs(n - 1) > 1e-6").isEmpty()
    assert missing_uids(texts, stored, "other").count() == 2
    append_vectors(stored.withColumn("model", F.lit("other")), path)
    assert read_vectors(spark, path).groupBy("model").count().count() == 2


def test_vector_commits_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")

    def vectors(*pairs):
        return spark.createDataFrame([(u, "m", [float(x)]) for u, x in pairs], "uid string, model string, vec array<float>")

    for _ in range(2):  # a retried append
        append_vectors(vectors(("a", 1), ("b", 2)), path, "00")
    assert read_vectors(spark, path).count() == spark.read.parquet(path).count() == 2
    append_vectors(vectors(("b", 3), ("c", 4)), path)  # a second writer that encoded b as well
    stored = {r["uid"]: r["vec"][0] for r in read_vectors(spark, path).collect()}
    assert stored == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_materialize_reads_the_session_setting(spark):
    folder = shared_dir(spark)
    stored = materialize(spark.range(3), "probe")
    assert stored.count() == 3
    assert all(f.replace("file://", "").replace("file:", "").startswith(folder.replace("file:", ""))
               for f in stored.inputFiles())


def test_stateless_operators_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("A", "MARCHE", -1.0, "voirie en Bretagne"), ("B", "x", 2.0, "plus de 5 euros")],
                          "uid string, nature string, montant double, requete string").write.parquet(source)
    stream = spark.readStream.schema("uid string, nature string, montant double, requete string").parquet(source)
    out = parse_queries(flag_amounts(clean(stream)))
    query = out.writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select nature, montant_negatif_ou_nul, region, montant_min from cleaned order by uid").collect()
    assert [tuple(r) for r in got] == [("Marché", True, "Bretagne", None), ("x", False, None, 5.0)]


def test_an_encoder_is_given_bounded_batches(spark):
    from tenderlens.sources import vector_store

    most = vector_store.ENCODE_ROWS

    def lengths(texts):
        if len(texts) > most:
            raise ValueError(f"{len(texts)} texts at once")
        return [[float(len(t)), 0.0] for t in texts]

    n = 2 * most + 3
    texts = spark.range(n).select(F.col("id").alias("uid"), F.when(F.col("id") > 0, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("objet"))
    rows = vector_store.encode(texts.coalesce(1), "m", lengths).collect()
    assert sorted((int(r.uid), r.model, r.vec) for r in rows) == [(i, "m", [float(i > 0), 0.0]) for i in range(n)]


def test_storing_a_result_leaves_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(key, None)
    stored = materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("g")).count(), "counted")
    assert {r.g: r["count"] for r in stored.collect()} == {g: len(range(g, 1000, 7)) for g in range(7)}
    assert not held() - before
    assert spark.conf.get(key, None) == set_before
