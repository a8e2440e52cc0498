import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenderlens.operators import cleaning, quality
from tenderlens.operators.contracts import dedup_contracts, group_by_contract
from tenderlens.sources.contracts import coerce_dates, current_only, load_current_only


@pytest.fixture
def audited(spark):
    d = dt.datetime
    return spark.createDataFrame([
        ("A", "t1", 1000.0, "Marché", d(2022, 1, 1), True), ("A", "t2", 1000.0, "Marché", d(2022, 1, 1), True),
        ("B", "t3", -500.0, "MARCHE", d(2001, 1, 1), True), ("C", None, 2e9, "marché", d(1900, 1, 1), None),
        ("D", "t5", None, "Accord-cadre", d(2023, 5, 1), True)],
        "uid string, titulaire_id string, montant double, nature string, dateNotification timestamp, "
        "donneesActuelles boolean")


def test_report(audited):
    rows = {r["column"]: r for r in quality.quality_report(audited).collect()}
    amount = rows["montant"]
    assert (amount["n_missing"], amount["missing_rate"], amount["n_total"]) == (1, 0.2, 5)
    assert amount["issues"] == ["1 montants négatifs ou nuls", "1 montants > 1,000,000,000 € (à vérifier)"]
    assert amount["quality_score"] == 0.7
    assert rows["nature"]["issues"][0].startswith("4 variantes distinctes se réduisent à 2")
    assert rows["dateNotification"]["issues"] == ["1 dates hors plage plausible [2000-01-01, 2027-12-31]"]
    assert rows["donneesActuelles"]["issues"] == ["1 valeurs nulles pour un champ censé être booléen"]
    assert rows["uid"]["issues"] == [] and rows["uid"]["quality_score"] == 1.0
    scores = [r["quality_score"] for r in quality.quality_report(audited).collect()]
    assert scores == sorted(scores) and all(0 <= s <= 1 for s in scores)


def test_empty_table_has_rate_zero(audited):
    rows = quality.quality_report(audited.limit(0)).collect()
    assert {r["missing_rate"] for r in rows} == {0.0} and all(r["issues"] == [] for r in rows)


def test_cleaning_flags(spark):
    d = dt.datetime
    df = spark.createDataFrame([
        ("A", "Marché", 1000.0, d(2022, 1, 1), d(2022, 1, 5)), ("B", "MARCHE", -500.0, d(1999, 1, 1), d(1999, 1, 5)),
        ("C", "marché", 2e9, None, None), ("D", "Accord cadre", None, d(2023, 5, 1), d(2023, 5, 5)),
        ("E", "Autre", float("nan"), d(2027, 12, 31, 0, 0, 1), d(2027, 12, 31))],
        "uid string, nature string, montant double, dateNotification timestamp, datePublicationDonnees timestamp")
    rows = cleaning.clean(df).orderBy("uid").collect()
    assert len(rows) == 5
    assert [r["nature"] for r in rows] == ["Marché", "Marché", "Marché", "Accord-cadre", "Autre"]
    assert [r["nature_original"] for r in rows][1] == "MARCHE"
    assert [r["dateNotification_hors_plage"] for r in rows] == [False, True, False, False, True]
    assert [r["datePublicationDonnees_hors_plage"] for r in rows] == [False, True, False, False, False]
    assert [(r["montant_negatif_ou_nul"], r["montant_extreme"]) for r in rows] == [
        (False, False), (True, False), (False, True), (False, False), (False, False)]


def test_missing_optional_columns_are_skipped(spark):
    df = spark.createDataFrame([("A",)], "uid string")
    assert cleaning.clean(df).columns == ["uid"]


def test_contract_grain(spark):
    df = spark.createDataFrame([("A", "t1", 1.0, 1), ("A", "t2", 2.0, 2), ("A", None, 3.0, 3), ("B", "t1", 4.0, 4)],
                               "uid string, titulaire_id string, montant double, n int")
    rows = {r["uid"]: r for r in group_by_contract(df, ["n"]).collect()}
    assert rows["A"]["nb_titulaires"] == 2 and rows["A"]["montant"] == 1.0
    assert rows["B"]["nb_titulaires"] == 1
    with pytest.raises(ValueError):
        group_by_contract(df.drop("uid"), ["n"])
    assert dedup_contracts(df.drop("uid"), ["n"]).count() == 4


def test_dedup_reduces_before_the_shuffle(spark, capsys):
    df = spark.range(10).selectExpr("id % 2 as uid", "id as n")
    dedup_contracts(df, ["n"]).explain()
    plan = capsys.readouterr().out
    before_exchange = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_dates_and_current_scan(spark, tmp_path):
    df = spark.createDataFrame([("A", "2022-01-01", True), ("B", "n'importe", None), ("C", "0001-01-01", False)],
                               "uid string, dateNotification string, donneesActuelles boolean")
    out = coerce_dates(df).select("uid", F.col("dateNotification").cast("string").alias("s")).orderBy("uid").collect()
    assert [r["s"] for r in out] == ["2022-01-01 00:00:00", None, "0001-01-01 00:00:00"]
    assert coerce_dates(df, min_valid="1900-01-01").filter("dateNotification is null").count() == 2
    assert [r["uid"] for r in current_only(df, ["uid"]).collect()] == ["A"]
    df.write.parquet(str(tmp_path / "t"))
    scanned = load_current_only(spark, str(tmp_path / "t"), ["uid"])
    assert [r["uid"] for r in scanned.collect()] == ["A"]
