import unicodedata

from pyspark.sql import functions as F

from tenderlens.functions import text as tx


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("t"))).collect()]


def test_fold_equals_decomposition(spark):
    chars = [chr(c) for c in range(1, 0x3000)] + list("ﬁ№™…½𝐀Ａ㎏œß’")
    values = ["".join(chars[i:i + 40]) for i in range(0, len(chars), 40)] + [f"a{c}b" for c in chars[:600]]
    want = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert column(spark, values, tx.accent_fold) == want


def test_category_key(spark):
    a, b, c, d, e, n = column(spark, [
        "Appel d'offres ouvert", "Appel d’offres ouvert", "Appel d offres ouvert",
        "  Marché   Public  ", "Marché Public", None], tx.category_key)
    assert a == b == c == "appel d'offres ouvert"
    assert d == e == "marche public"
    assert n is None


def test_tokens(spark):
    got = column(spark, ["Le marché de la sécurité et des systèmes", "cybersécurité", "surveiller x", None, ""],
                 tx.tokens)
    assert got == [["marche", "securite", "systemes"], ["cybersecurite", "cyber", "securite"],
                   ["surveiller", "sur", "veiller"], [], []]


def test_first_fitting_prefix_wins(spark):
    got = column(spark, ["prosecco", "precoce", "coop", "coopera", "interne"], tx.tokens)
    assert got == [["prosecco", "pro", "secco"], ["precoce", "pre", "coce"], ["coop"],
                   ["coopera", "co", "opera"], ["interne"]]


def test_relevance(spark):
    frame = spark.createDataFrame(
        [("SECURITE DES SYSTEMES D’INFORMATION", ["sécurité des systèmes d'information"]),
         ("Travaux de voirie", ["cantine", "repas"]), (None, ["nan"])], "t string, k array<string>")
    got = frame.select(tx.is_relevant(tx.text_key(F.col("t")), tx.keyword_keys(F.col("k")))).collect()
    assert [r[0] for r in got] == [True, False, True]


def test_rare_characters_cost_no_more_than_accents(spark):
    import time

    def seconds(char):
        long = F.concat(F.repeat(F.lit("abcdefgh "), 10_000), F.lit(char), F.col("id").cast("string"))
        start = time.perf_counter()
        spark.range(200).select(F.sum(F.length(tx.accent_fold(long)))).collect()
        return time.perf_counter() - start

    seconds("é")  # warm up
    usual = seconds("é")
    assert all(seconds(c) < 3 * usual + 2 for c in "…½™")
