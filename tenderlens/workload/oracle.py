"""DuckDB SQL for the registered queries, written independently of the library."""

from __future__ import annotations

from tenderlens.functions.text import PREFIXES, STOPWORDS
from tenderlens.operators.cleaning import CANONICAL_NATURE
from tenderlens.operators.query_log import CONNECTORS, EXPLICIT_AMOUNT, HIGH_AMOUNT, REGIONS
from tenderlens.plans.evaluation import RRF_CONFIGS, SAMPLE_SIZES
from tenderlens.schema import CORE_COLUMNS
from tenderlens.workload import bindings as b

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def select(key: str, body: str, *ctes: str) -> None:
    ORACLE[key] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# Shared pieces --------------------------------------------------------------------------

CONTRACTS = """contracts AS (
  SELECT o_orderkey AS uid,
    CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS titulaire_id, c_custkey AS acheteur_id,
    p_name AS objet, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS montant,
    c_acctbal AS montant_signe, p_type AS type,
    CASE WHEN o_orderkey % 97 <> 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0')
      || lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') END AS codeCPV,
    CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS procedure,
    (['Marché', 'MARCHE', 'marché ', 'Accord cadre'])[CAST(o_orderkey % 4 AS INT) + 1] AS nature,
    l_quantity AS dureeMois,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(l_linenumber - 1 AS DOUBLE) END AS offresRecues,
    o_orderdate AS dateNotification, l_shipdate AS datePublicationDonnees,
    r_name AS acheteur_region_nom, n_name AS acheteur_departement_nom,
    l_linenumber AS modification_id,
    CASE WHEN l_partkey % 101 <> 0 THEN l_linestatus = 'O' END AS donneesActuelles,
    l_returnflag AS sourceDataset, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    o_orderkey || '-' || l_linenumber AS id, c_name AS acheteur_nom, s_name AS titulaire_nom,
    CAST(s_nationkey AS VARCHAR) AS titulaire_region_nom
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey)"""

SIGNED = """signed AS (
  SELECT * REPLACE (CASE WHEN montant IS NOT NULL THEN montant_signe END AS montant) FROM contracts)"""

TIE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, datePublicationDonnees"
KEYS = "uid, l_linenumber, l_partkey, l_suppkey"


def first_of(source: str, name: str = "firsts") -> str:
    return (f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY uid ORDER BY {TIE}) AS rn FROM {source}) WHERE rn = 1)")


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def fold(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def plain(x: str) -> str:
    return fold(f"lower(trim({x}))")


def category(x: str) -> str:
    folded = fold(f"replace(lower(trim({x})), '’', '''')")
    return f"trim(regexp_replace(replace({folded}, ' d ', ' d'''), '\\s+', ' ', 'g'))"


def relevance(x: str) -> str:
    spaced = f"replace(replace(lower({x}), '’', ' '), '''', ' ')"
    return f"trim(regexp_replace({fold(spaced)}, '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    cases = " ".join(
        f"WHEN starts_with(w, '{p}') AND length(w) > {len(p) + 3} THEN [w, '{p}', substr(w, {len(p) + 1})]"
        for p in PREFIXES)
    return (f"flatten(list_transform(list_filter(regexp_extract_all({fold(f'lower({x})')}, '\\w+'), "
            f"lambda w: length(w) > 1 AND NOT list_contains({names(STOPWORDS)}, w)), "
            f"lambda w: CASE {cases} ELSE [w] END))")


CORPUS = "corpus AS (SELECT doc_id AS uid, text AS objet, CAST(n_chars AS DOUBLE) AS montant, CASE lang " + \
    " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in b.REGION_OF_LANG.items()) + \
    " END AS acheteur_region_nom FROM documents)"

QUERY_LOG = f"""query_log AS (
  SELECT item_id AS query_id,
    text || ({names(b.PHRASES)})[CAST(item_id % {len(b.PHRASES)} AS INT) + 1] AS requete FROM benchmark
  UNION ALL SELECT CAST(r_regionkey + 100000 AS BIGINT),
    ({names(b.FILTER_ONLY)})[CAST(r_regionkey % {len(b.FILTER_ONLY)} AS INT) + 1] FROM region)"""

_REGION_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(requete), {q(r.lower())}) THEN {q(r)}"
    for r in sorted(REGIONS, key=len, reverse=True)) + " END"


def amount_parts(source: str, text: str, name: str) -> str:
    explicit, high = q("(?i)" + EXPLICIT_AMOUNT), q("(?i)" + HIGH_AMOUNT)
    number = (f"TRY_CAST(replace(replace(regexp_extract({text}, {explicit}, 1), ' ', ''), ',', '.') AS DOUBLE)")
    return f"""{name}_n AS (SELECT *, {number} AS montant_min FROM {source}),
{name} AS (SELECT *, montant_min IS NULL AND regexp_matches({text}, {high}) AS montant_eleve_qualitatif,
  CASE WHEN montant_min IS NOT NULL THEN regexp_replace({text}, {explicit}, '', 'g')
       WHEN regexp_matches({text}, {high}) THEN regexp_replace({text}, {high}, '', 'g')
       ELSE {text} END AS reste2 FROM {name}_n)"""


def parse(source: str, name: str = "parsed") -> str:
    words_ = "|".join(CONNECTORS)
    text = "regexp_replace(regexp_replace(reste2, '\\s+', ' ', 'g'), '^[ ,.]+|[ ,.]+$', '', 'g')"
    text = f"regexp_replace({text}, '(?i)^(?:(?:{words_})(?:\\s+|$))+', '')"
    text = f"regexp_replace({text}, '(?i)(?:(?:^|\\s+)(?:{words_}))+$', '')"
    return f"""{name}_r AS (SELECT *, {_REGION_CASE} AS region FROM {source}),
{name}_s AS (SELECT *, CASE WHEN region IS NULL THEN requete
  ELSE regexp_replace(requete, '(?i)' || regexp_escape(region), '', 'g') END AS reste FROM {name}_r),
{amount_parts(f'{name}_s', 'reste', f'{name}_a')},
{name} AS (SELECT * EXCLUDE (reste, reste2), {text} AS texte_libre FROM {name}_a)"""


def strict(queries: str = "parsed", rows: str = "corpus", name: str = "subset") -> str:
    """(query_id, uid, ...): rows each query keeps; uid is unique in the corpus."""
    return f"""{name}_cut AS (
  SELECT query_id, quantile_cont(montant, 0.9) AS cut FROM {queries} p JOIN {rows} c
    ON p.region IS NULL OR p.region = c.acheteur_region_nom GROUP BY query_id),
{name} AS (
  SELECT p.query_id, c.* FROM {queries} p LEFT JOIN {name}_cut USING (query_id) JOIN {rows} c
    ON p.region IS NULL OR p.region = c.acheteur_region_nom
  WHERE CASE WHEN montant_min IS NOT NULL THEN montant >= montant_min
             WHEN montant_eleve_qualitatif THEN montant >= cut ELSE TRUE END)"""


def bm25(asked: str, docs: str, k: int, name: str = "bm25", zeros: bool = True) -> str:
    """``asked`` (query_id, texte_libre), ``docs`` (query_id, uid): every pair is scored."""
    kept = "" if zeros else "WHERE score <> 0"
    return f"""{name}_words AS MATERIALIZED (SELECT uid, {words('objet')} AS ws FROM corpus),
{name}_pairs AS (SELECT d.query_id, d.uid, ws, len(ws) AS dl FROM {docs} d JOIN {name}_words USING (uid)),
{name}_stat AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM {name}_pairs GROUP BY 1),
{name}_df AS (SELECT query_id, token, count(*) AS df FROM (
  SELECT query_id, unnest(list_distinct(ws)) AS token FROM {name}_pairs) GROUP BY 1, 2),
{name}_raw AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {name}_df JOIN {name}_stat USING (query_id)),
{name}_idf AS (SELECT query_id, token, n, avgdl, CASE WHEN raw < 0
    THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM {name}_raw),
{name}_terms AS (SELECT query_id, token, count(*) AS qtf FROM (
  SELECT query_id, unnest({words('texte_libre')}) AS token FROM {asked}) GROUP BY 1, 2),
{name}_tf AS (SELECT query_id, uid, dl, token, count(*) AS tf FROM (
  SELECT query_id, uid, dl, unnest(ws) AS token FROM {name}_pairs)
  WHERE (query_id, token) IN (SELECT query_id, token FROM {name}_terms) GROUP BY 1, 2, 3, 4),
{name}_scores AS (SELECT query_id, uid,
    round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM {name}_tf JOIN {name}_terms USING (query_id, token) JOIN {name}_idf USING (query_id, token) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, uid, score AS bm25_score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank
  FROM (SELECT d.query_id, d.uid, coalesce(s.score, 0.0) AS score FROM {docs} d
    JOIN {asked} USING (query_id) LEFT JOIN {name}_scores s ON s.query_id = d.query_id AND s.uid = d.uid
    WHERE trim(texte_libre) <> '') {kept}) WHERE rank <= {k})"""


def near(pairs: str, k: int, name: str = "near", extra: str = "") -> str:
    """``pairs`` (query_id, uid, qvec, vec): exact ranking by dot product."""
    keys = f"query_id{', ' + extra if extra else ''}"
    return f"""{name} AS (SELECT * FROM (SELECT {keys}, uid, score,
    row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, uid) AS rank
  FROM (SELECT {keys}, uid, round(list_dot_product(CAST(qvec AS DOUBLE[]), CAST(vec AS DOUBLE[])), 9) AS score
    FROM {pairs})) WHERE rank <= {k})"""


def fuse(parts: list[tuple[str, str]], name: str = "fused", keys: str = "query_id", k: int | None = None) -> str:
    union = " UNION ALL ".join(f"SELECT {keys}, uid, {w} / (60 + rank) AS part FROM {t}" for t, w in parts)
    limit = f"WHERE rank <= {k}" if k else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY {keys} ORDER BY rrf_score DESC, uid) AS rank
  FROM (SELECT {keys}, uid, round(sum(part), 12) AS rrf_score FROM ({union}) GROUP BY {keys}, uid)) {limit})"""


# Scans ------------------------------------------------------------------------------------

select("scan_core", "SELECT " + ", ".join(
    ts(c) if c.startswith("date") else c for c in CORE_COLUMNS) + " FROM contracts", CONTRACTS)
select("scan_coerce_dates", f"""SELECT uid, l_linenumber, l_partkey,
  CASE WHEN uid % 10 <> 3 AND dateNotification >= TIMESTAMP '1993-01-01'
    THEN strftime(dateNotification, '%Y-%m-%d %H:%M:%S') END AS dateNotification,
  CASE WHEN datePublicationDonnees >= TIMESTAMP '1993-01-01'
    THEN strftime(datePublicationDonnees, '%Y-%m-%d %H:%M:%S') END AS datePublicationDonnees
FROM contracts""", CONTRACTS)
select("scan_current", "SELECT uid, montant, dureeMois, codeCPV FROM contracts WHERE donneesActuelles", CONTRACTS)
ROW_HASH = ("md5(concat_ws(':', uid, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR), "
            "strftime(datePublicationDonnees, '%Y-%m-%d %H:%M:%S'), '42'))")
select("sample_exact", f"""SELECT uid, l_linenumber, l_partkey, montant FROM contracts
ORDER BY {ROW_HASH}, uid, {TIE} LIMIT 5000""", CONTRACTS)
select("drop_missing", """SELECT uid, l_linenumber, l_partkey, montant, codeCPV FROM contracts
WHERE montant IS NOT NULL AND codeCPV IS NOT NULL""", CONTRACTS)

# Filters and flags --------------------------------------------------------------------------

_ONE = "SELECT uid, l_linenumber, l_partkey, montant, acheteur_region_nom FROM firsts"
for _key, _where in {
    "filter_region": "acheteur_region_nom = 'ASIA'",
    "filter_min_amount": "montant >= 250000",
    "filter_high_amount": "montant >= (SELECT quantile_cont(montant, 0.9) FROM contracts)",
    "strict_filters_high_in_region": "acheteur_region_nom = 'EUROPE' AND montant >= (SELECT quantile_cont("
                                     "montant, 0.9) FROM contracts WHERE acheteur_region_nom = 'EUROPE')",
}.items():
    select(_key, _ONE, CONTRACTS, f"kept AS (SELECT * FROM contracts WHERE {_where})", first_of("kept"))
select("strict_filters_many", "SELECT query_id, uid, montant FROM subset",
       CORPUS, QUERY_LOG, parse("query_log"), strict())
select("valid_target", """SELECT uid, l_linenumber, l_partkey, montant, dureeMois, offresRecues FROM signed
WHERE offresRecues >= 0 AND montant > 0 AND dureeMois > 0 AND dureeMois <= 240""", CONTRACTS, SIGNED)
select("flag_amount", f"""SELECT {KEYS}, coalesce(montant * 200000 <= 0, FALSE) AS montant_negatif_ou_nul,
  coalesce(montant * 200000 > 1e9, FALSE) AS montant_extreme FROM signed""", CONTRACTS, SIGNED)


def outside(column: str) -> str:
    return (f"coalesce({column} < TIMESTAMP '{b.DATE_LOW}' OR {column} > TIMESTAMP '{b.DATE_HIGH}', FALSE)")


select("flag_dates", f"""SELECT {KEYS},
  {outside('CASE WHEN uid % 11 <> 0 THEN dateNotification END')} AS dateNotification_hors_plage,
  {outside('datePublicationDonnees')} AS datePublicationDonnees_hors_plage FROM contracts""", CONTRACTS)
_NATURE = f"CASE {plain('nature')} " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in CANONICAL_NATURE.items()) + " ELSE nature END AS nature"
select("canonical_category", f"SELECT {KEYS}, {_NATURE}, nature AS nature_original FROM contracts", CONTRACTS)
select("clean_pipeline", f"""SELECT {KEYS}, {_NATURE}, nature AS nature_original,
  coalesce(montant <= 0, FALSE) AS montant_negatif_ou_nul, coalesce(montant > 1e9, FALSE) AS montant_extreme,
  {outside('dateNotification')} AS dateNotification_hors_plage,
  {outside('datePublicationDonnees')} AS datePublicationDonnees_hors_plage FROM signed""", CONTRACTS, SIGNED)

# Query log ------------------------------------------------------------------------------------

select("query_region", "SELECT query_id, region, reste FROM parsed_s", QUERY_LOG, parse("query_log"))
select("query_amount", """SELECT query_id, montant_min, montant_eleve_qualitatif, reste2 AS reste FROM x""",
       QUERY_LOG, amount_parts("query_log", "requete", "x"))
select("parse_queries", "SELECT query_id, region, montant_min, montant_eleve_qualitatif, texte_libre FROM parsed",
       QUERY_LOG, parse("query_log"))
select("parse_user_turns", "SELECT query_id, region, montant_min, montant_eleve_qualitatif, texte_libre FROM parsed",
       "turns AS (SELECT conv_id || '-' || turn AS query_id, text AS requete FROM conversations WHERE role = 'user')",
       parse("turns"))

# Quality ----------------------------------------------------------------------------------------

_AUDITED = [c for c in CORE_COLUMNS if c not in ("id", "acheteur_nom", "titulaire_nom", "titulaire_region_nom")]
_MISSING = " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n_total FROM signed"
    for c in _AUDITED)
select("audit_missing", 'SELECT "column", round(n_missing / n_total, 6) AS missing_rate, n_missing, n_total '
       "FROM missing", CONTRACTS, SIGNED, f"missing AS ({_MISSING})")
_DATES = " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", count(*) FILTER ({outside(c)}) AS n_out_of_range FROM signed"
    for c in ("dateNotification", "datePublicationDonnees"))
select("audit_dates", _DATES, CONTRACTS, SIGNED)
select("audit_amount", """SELECT count(*) FILTER (montant <= 0) AS n_not_positive,
  count(*) FILTER (montant > 1e9) AS n_extreme FROM signed""", CONTRACTS, SIGNED)
_VARIANTS = " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", count(DISTINCT {c}) AS n_raw, count(DISTINCT {plain(c)}) AS n_normalised "
    "FROM signed" for c in ("nature", "procedure", "type"))
select("audit_categories", _VARIANTS, CONTRACTS, SIGNED)
select("audit_versioning", "SELECT count(*) - count(donneesActuelles) AS n_null_flag FROM signed", CONTRACTS, SIGNED)
select("quality_report", f"""SELECT "column", round(missing_rate, 6) AS missing_rate, n_missing, n_total,
  coalesce(array_to_string(issues, '; '), '') AS issue_text,
  round(greatest(0.0, 1 - missing_rate - 0.05 * len(issues)), 6) AS quality_score
FROM (SELECT m."column", m.n_missing / m.n_total AS missing_rate, m.n_missing, m.n_total,
  list_filter([
    CASE WHEN d.n_out_of_range > 0 THEN d.n_out_of_range
      || ' dates hors plage plausible [{b.DATE_LOW}, {b.DATE_HIGH}]' END,
    CASE WHEN m."column" = 'montant' AND a.n_not_positive > 0 THEN a.n_not_positive
      || ' montants négatifs ou nuls' END,
    CASE WHEN m."column" = 'montant' AND a.n_extreme > 0 THEN a.n_extreme
      || ' montants > 1,000,000,000 € (à vérifier)' END,
    CASE WHEN v.n_raw > v.n_normalised THEN v.n_raw || ' variantes distinctes se réduisent à '
      || v.n_normalised || ' après normalisation (casse/accents) — à normaliser avant tout groupby' END,
    CASE WHEN m."column" = 'donneesActuelles' AND m.n_missing > 0 THEN m.n_missing
      || ' valeurs nulles pour un champ censé être booléen' END], lambda i: i IS NOT NULL) AS issues
  FROM missing m LEFT JOIN dates d ON d."column" = m."column" LEFT JOIN variants v ON v."column" = m."column"
  CROSS JOIN amounts a)""",
       CONTRACTS, SIGNED, f"missing AS ({_MISSING})", f"dates AS ({_DATES})", f"variants AS ({_VARIANTS})",
       "amounts AS (SELECT count(*) FILTER (montant <= 0) AS n_not_positive, "
       "count(*) FILTER (montant > 1e9) AS n_extreme FROM signed)")
select("missing_by_group", f"""SELECT {category('procedure')} AS groupe, count(*) AS n_rows,
  round(avg(CASE WHEN offresRecues IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate
FROM contracts GROUP BY 1""", CONTRACTS)

# Contract grain and peers ---------------------------------------------------------------------------

select("group_by_contract", """SELECT f.uid, f.titulaire_id, f.montant, f.dureeMois, h.nb_titulaires
FROM firsts f LEFT JOIN (SELECT uid, count(DISTINCT titulaire_id) AS nb_titulaires FROM contracts GROUP BY uid) h
USING (uid)""", CONTRACTS, first_of("contracts"))
select("dedup_contract", "SELECT uid, titulaire_id, montant, dureeMois, l_linenumber, l_partkey FROM firsts",
       CONTRACTS, first_of("contracts"))


def deviation(source: str) -> str:
    return f"""dev AS (SELECT *, substr(codeCPV, 1, 2) AS cpv_division FROM {source}),
grp AS (SELECT cpv_division, count(*) AS cpv_groupe_taille, median(montant) AS mm, median(dureeMois) AS dm
  FROM dev WHERE cpv_division IS NOT NULL GROUP BY 1),
peer AS (SELECT d.*, g.cpv_groupe_taille, coalesce(g.cpv_groupe_taille >= 30, FALSE) AS cpv_groupe_fiable,
    CASE WHEN mm > 0 THEN montant / mm END AS montant_ratio_mediane_cpv,
    CASE WHEN dm > 0 THEN dureeMois / dm END AS duree_ratio_mediane_cpv
  FROM dev d LEFT JOIN grp g USING (cpv_division))"""


_RATIOS = "montant_ratio_mediane_cpv", "duree_ratio_mediane_cpv"
select("peer_deviation", f"""SELECT uid, montant, dureeMois, cpv_division, cpv_groupe_taille, cpv_groupe_fiable,
  {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)} FROM peer""",
       CONTRACTS, first_of("contracts"), deviation("firsts"))
_LOGGED = "feat AS (SELECT * REPLACE (sign(montant) * ln(1 + abs(montant)) AS montant, " \
          "sign(montant_ratio_mediane_cpv) * ln(1 + abs(montant_ratio_mediane_cpv)) " \
          "AS montant_ratio_mediane_cpv) FROM peer)"
for _key, _feat in {"anomaly_features": "feat AS (SELECT * FROM peer)", "anomaly_features_log": _LOGGED}.items():
    select(_key, "SELECT uid, " + ", ".join(
        f"round(coalesce({c}, (SELECT median({c}) FROM feat)), 6) AS {c}"
        for c in ("montant", "dureeMois", *_RATIOS)) + " FROM feat",
        CONTRACTS, SIGNED, first_of("signed"), deviation("firsts"), _feat)
select("most_above_peers", """SELECT uid, round(montant, 6) AS montant, cpv_division, cpv_groupe_taille,
  round(r, 6) AS montant_ratio_mediane_cpv
FROM (SELECT uid, coalesce(montant, (SELECT median(montant) FROM peer)) AS montant, cpv_division,
  cpv_groupe_taille, cpv_groupe_fiable, coalesce(montant_ratio_mediane_cpv,
  (SELECT median(montant_ratio_mediane_cpv) FROM peer)) AS r FROM peer)
WHERE cpv_groupe_fiable ORDER BY r DESC, uid LIMIT 50""",
       CONTRACTS, first_of("contracts"), deviation("firsts"))
select("scale_features", f"""SELECT {KEYS}, {', '.join(
    f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_z' for c in ('montant', 'dureeMois'))}
FROM contracts WHERE montant IS NOT NULL""", CONTRACTS)

# Text -------------------------------------------------------------------------------------------------

select("accent_fold", f"SELECT doc_id AS uid, {fold('text')} AS plie FROM documents")
select("category_key", f"SELECT {KEYS}, {category('''nature || ' d ' || procedure''')} AS cle FROM contracts", CONTRACTS)
select("tokenize", f"SELECT doc_id AS uid, array_to_string({words('text')}, ' ') AS mots FROM documents")
select("signed_log_amount", f"""SELECT {KEYS}, round(sign(montant) * ln(1 + abs(montant)), 6) AS montant_log
FROM signed""", CONTRACTS, SIGNED)
select("theme_sample_size", f"""SELECT doc_id, CAST(CASE ({names([*SAMPLE_SIZES, 'autre'])})[CAST(doc_id % 5 AS INT) + 1]
  {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in SAMPLE_SIZES.items())} ELSE 15000 END AS INTEGER) AS taille
FROM documents""")

# Search -------------------------------------------------------------------------------------------------

select("bm25_stats", """SELECT t.token, t.df, c.cf, round(t.idf, 6) AS idf, t.n AS n_docs, round(t.avgdl, 6) AS avgdl
FROM (SELECT r.*, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM x_raw r) t
JOIN (SELECT token, count(*) AS cf FROM (SELECT unnest(ws) AS token FROM x_words) GROUP BY 1) c USING (token)""",
       CORPUS, "one AS (SELECT 0 AS query_id, '' AS texte_libre)",
       "pairs AS (SELECT 0 AS query_id, uid FROM corpus)", bm25("one", "pairs", 1, "x"))
select("bm25_search", "SELECT query_id, uid, round(bm25_score, 6) AS bm25_score, rank FROM bm25",
       CORPUS, QUERY_LOG, "asked AS (SELECT query_id, requete AS texte_libre FROM query_log)",
       "pairs AS (SELECT query_id, uid FROM asked, corpus)", bm25("asked", "pairs", 50))
_ALL_PAIRS = ("vpairs AS (SELECT a.vec_id AS query_id, c.vec_id AS uid, a.embedding AS qvec, c.embedding AS vec "
              "FROM embeddings a, embeddings c)")
select("vector_topk", "SELECT query_id, uid, round(score, 6) AS score, rank FROM near", _ALL_PAIRS, near("vpairs", 20))
_CELLS = ["centres AS (SELECT vec_id AS cell, embedding AS c FROM embeddings WHERE vec_id < 10)",
          """celled AS MATERIALIZED (SELECT vec_id AS uid, any_value(embedding) AS vec,
  arg_min(cell, list_distance(CAST(embedding AS DOUBLE[]), CAST(c AS DOUBLE[]))) AS cell
  FROM embeddings, centres GROUP BY vec_id)""",
          "cpairs AS (SELECT vec_id AS query_id, cell AS uid, embedding AS qvec, c AS vec FROM embeddings, centres)"]
select("vector_cells_topk", "SELECT query_id, uid, round(score, 6) AS score, rank FROM near",
       *_CELLS, near("cpairs", 2, "probes"),
       """ppairs AS (SELECT p.query_id, x.uid, e.embedding AS qvec, x.vec FROM probes p
  JOIN celled x ON x.cell = p.uid JOIN embeddings e ON e.vec_id = p.query_id)""", near("ppairs", 20))
select("vector_index_complete", "SELECT query_id, uid, round(score, 6) AS score, rank FROM near",
       *_CELLS, near("cpairs", 10, "ordered"),
       """probes AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY query_id ORDER BY rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before
  FROM ordered JOIN (SELECT cell AS uid, count(*) AS held FROM celled GROUP BY 1) USING (uid))""",
       """ppairs AS (SELECT p.query_id, x.uid, e.embedding AS qvec, x.vec FROM probes p
  JOIN celled x ON x.cell = p.uid JOIN embeddings e ON e.vec_id = p.query_id
  WHERE p.rank = 1 OR p.held_before < 50)""", near("ppairs", 50))
select("topk_overlap", """SELECT n.query_id, count(*) AS n_exact, count(h.uid) AS n_common,
  round(count(h.uid) / count(*), 6) AS overlap
FROM near n LEFT JOIN half h ON n.query_id = h.query_id AND n.uid = h.uid GROUP BY 1""",
       _ALL_PAIRS, near("vpairs", 20),
       "hpairs AS (SELECT query_id, uid, qvec[1:32] AS qvec, vec[1:32] AS vec FROM vpairs)", near("hpairs", 20, "half"))
select("missing_vectors", "SELECT doc_id AS uid FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
select("vector_upsert", """SELECT uid, 'lettres' AS model, CAST(26 AS INTEGER) AS dim,
  coalesce(round(list_sum([i * l[i] FOR i IN range(1, 27)]) / nullif(sqrt(list_sum([x * x FOR x IN l])), 0), 3), 0.0) AS lettres
FROM (SELECT doc_id AS uid, [CAST(length(text) - length(replace(lower(text), chr(CAST(96 + i AS INTEGER)), '')) AS DOUBLE)
  FOR i IN range(1, 27)] AS l FROM documents)""")
_RANKINGS = """by_length AS (SELECT lang AS query_id, doc_id AS uid, row_number() OVER (
  PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
by_hash AS (SELECT lang AS query_id, doc_id AS uid, row_number() OVER (
  PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents)"""
for _key, _w in {"rrf_fusion": "1.0", "rrf_weighted": "3.0"}.items():
    select(_key, "SELECT query_id, uid, round(rrf_score, 9) AS rrf_score, rank FROM fused",
           _RANKINGS, fuse([("by_length", _w), ("by_hash", "1.0")]))

_HYBRID = [CORPUS, QUERY_LOG, parse("query_log"), strict()]
_NEAR_PAIRS = """npairs AS (SELECT p.query_id, s.uid, a.embedding AS qvec, v.embedding AS vec
  FROM parsed p JOIN embeddings a ON a.vec_id = p.query_id JOIN subset s ON s.query_id = p.query_id
  JOIN embeddings v ON v.vec_id = s.uid WHERE trim(p.texte_libre) <> '')"""
_BLANK = """blank AS (SELECT s.query_id, s.uid, row_number() OVER (PARTITION BY s.query_id ORDER BY s.uid) AS rank
  FROM subset s JOIN parsed p USING (query_id) WHERE trim(p.texte_libre) = '')"""


def hybrid(zeros: bool = True, w: tuple[str, str] = ("1.0", "1.0")) -> list[str]:
    return [*_HYBRID, bm25("parsed", "subset", 200, zeros=zeros), _NEAR_PAIRS, near("npairs", 200),
            fuse([("bm25", w[0]), ("near", w[1])], k=20), _BLANK,
            """top AS (SELECT query_id, uid, rrf_score, rank FROM fused
  UNION ALL SELECT query_id, uid, NULL, rank FROM blank WHERE rank <= 20)"""]


for _key, _zeros, _w in (("hybrid_search", True, ("1.0", "1.0")),
                         ("hybrid_search_matches_only", False, ("1.0", "3.0"))):
    select(_key, """SELECT t.query_id, t.uid, t.rank, round(t.rrf_score, 9) AS rrf_score, c.montant,
  c.acheteur_region_nom FROM top t JOIN corpus c USING (uid)""", *hybrid(_zeros, _w))


def letters(text: str) -> str:
    """Unit vector of letter counts in single precision."""
    counts = f"""[CAST(length({text}) - length(replace(lower({text}), chr(CAST(96 + i AS INTEGER)), '')) AS DOUBLE)
    FOR i IN range(1, 27)]"""
    return f"(SELECT [CAST(x / n AS FLOAT) FOR x IN l] FROM (SELECT l, CASE list_sum([x * x FOR x IN l]) WHEN 0 THEN 1.0 " \
           f"ELSE sqrt(list_sum([x * x FOR x IN l])) END AS n FROM (SELECT {counts} AS l)))"


select("hybrid_search_encoded", """SELECT t.query_id, t.uid, t.rank, round(t.rrf_score, 9) AS rrf_score, c.montant,
  c.acheteur_region_nom FROM top t JOIN corpus c USING (uid)""", *[c if c != _NEAR_PAIRS else f"""
lv AS MATERIALIZED (SELECT uid, {letters("objet")} AS vec FROM corpus),
npairs AS (SELECT p.query_id, s.uid, p.qvec, lv.vec FROM (SELECT query_id, {letters("texte_libre")} AS qvec FROM parsed
  WHERE trim(texte_libre) <> '') p JOIN subset s USING (query_id) JOIN lv USING (uid))""" for c in hybrid()])
select("search_explain", """SELECT p.query_id, p.region AS region_filtree, p.montant_min AS montant_min_applique,
  p.montant_eleve_qualitatif, p.texte_libre AS texte_recherche,
  (SELECT count(*) FROM corpus) AS n_marches_avant_filtre, coalesce(a.n, 0) AS n_marches_apres_filtre_strict,
  CASE WHEN a.n > 0 AND trim(p.texte_libre) <> '' THEN coalesce(b.n, 0) END AS n_candidats_bm25,
  CASE WHEN a.n > 0 AND trim(p.texte_libre) <> '' THEN coalesce(v.n, 0) END AS n_candidats_embeddings,
  CASE WHEN a.n > 0 AND trim(p.texte_libre) <> '' THEN a.n - a.known END AS n_marches_sans_vecteur,
  CASE WHEN a.n > 0 AND trim(p.texte_libre) <> '' THEN p.query_id NOT IN (SELECT vec_id FROM embeddings) END AS requete_sans_vecteur
FROM parsed p LEFT JOIN (SELECT query_id, count(*) AS n, count(vec_id) AS known FROM subset LEFT JOIN embeddings ON vec_id = uid GROUP BY 1) a
  USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM bm25 GROUP BY 1) b USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM near GROUP BY 1) v USING (query_id)""", *hybrid())
select("filter_only_search", """SELECT query_id, uid, rank, montant FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY uid) AS rank FROM subset) WHERE rank <= 20""", *_HYBRID)
select("annotation_sheet", """SELECT CAST(t.query_id AS VARCHAR) AS requete, t.rank AS rang, c.objet, c.montant,
  c.acheteur_region_nom AS region, '' AS pertinent FROM top t JOIN corpus c USING (uid) WHERE t.rank <= 8""", *hybrid())

# Evaluation -----------------------------------------------------------------------------------------------

THEMES = "themes AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(n)}, {q(text)}, {names(keys)}, {v})"
    for n, (text, keys, v) in b.THEMES.items()) + ") t(query_id, requete, mots, vec_id))"
KEYED = f"keyed AS (SELECT *, {relevance('objet')} AS cle FROM corpus)"
_HIT = f"len(list_filter(mots, lambda m: contains(cle, {relevance('m')}))) > 0"
select("keyword_relevance", f"SELECT query_id, uid, {_HIT} AS pertinent FROM themes, keyed", CORPUS, THEMES, KEYED)
select("relevant_in_corpus", f"""SELECT query_id, count(*) FILTER ({_HIT}) AS n_pertinents_corpus
FROM themes, keyed GROUP BY 1""", CORPUS, THEMES, KEYED)


def evaluated(results: str, relevant: str, ks, extra: str = "", name: str = "ev") -> str:
    """Metrics of ``results`` (query_id, uid, rank) against ``relevant`` (query_id, n)."""
    keys = "query_id" + (f", {extra}" if extra else "")
    every = "themes" if not extra else f"(SELECT * FROM themes, (SELECT DISTINCT {extra} FROM {results}))"
    cols = ", ".join(
        f"coalesce(h{k}, 0) / {k} AS \"precision@{k}\", CASE WHEN n > 0 THEN coalesce(d{k}, 0) / (SELECT "
        f"sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, {k}) AS BIGINT) + 1) r(i)) ELSE 0.0 END AS \"ndcg@{k}\", "
        f"CASE WHEN n > 0 THEN coalesce(h{k}, 0) / n END AS \"recall@{k}\"" for k in ks)
    aggs = ", ".join(f"count(*) FILTER (rel AND rank <= {k}) AS h{k}, "
                     f"sum(1 / log2(rank + 1)) FILTER (rel AND rank <= {k}) AS d{k}" for k in ks)
    return f"""{name}_j AS (SELECT r.*, {_HIT} AS rel FROM {results} r JOIN themes USING (query_id) JOIN keyed USING (uid)),
{name}_a AS (SELECT {keys}, count(*) AS n_resultats, {aggs} FROM {name}_j GROUP BY {keys}),
{name} AS (SELECT t.query_id AS nom, {extra + ', ' if extra else ''}coalesce(a.n_resultats, 0) AS n_resultats,
  coalesce(v.n, 0) AS n_pertinents_corpus, {cols}
  FROM {every} t LEFT JOIN {name}_a a USING ({keys}) LEFT JOIN {relevant} v USING (query_id))"""


def shown(ks, metrics=("precision", "ndcg", "recall")) -> str:
    return ", ".join(f'round("{m}@{k}", 6) AS "{m}@{k}"' for k in ks for m in metrics)


_REL = f"rel AS (SELECT query_id, count(*) AS n FROM themes, keyed WHERE {_HIT} GROUP BY 1)"
_THEME_BM25 = [CORPUS, THEMES, KEYED, "asked AS (SELECT query_id, requete AS texte_libre FROM themes)",
               "pairs AS (SELECT query_id, uid FROM asked, corpus)", bm25("asked", "pairs", 20), _REL]
_K3, _K2 = (5, 10, 20), (5, 10)
for _key, _metric in {"precision_at_k": "precision", "recall_at_k": "recall", "ndcg_at_k": "ndcg"}.items():
    select(_key, f"SELECT nom, {shown(_K3, (_metric,))} FROM ev", *_THEME_BM25, evaluated("bm25", "rel", _K3))
select("evaluate_queries", f"SELECT nom, n_resultats, n_pertinents_corpus, {shown(_K3)} FROM ev",
       *_THEME_BM25, evaluated("bm25", "rel", _K3))

_SAMPLED = "sampled AS (SELECT t.query_id, c.* FROM themes t, corpus c)"
_SIZES = "sizes AS (SELECT query_id AS nom, count(*) AS n_echantillon FROM sampled GROUP BY 1)"
_SREL = f"""srel AS (SELECT s.query_id, count(*) AS n FROM sampled s JOIN themes USING (query_id)
  JOIN keyed k ON k.uid = s.uid WHERE {_HIT} GROUP BY 1)"""
select("eval_bm25", f"SELECT nom, n_resultats, n_pertinents_corpus, {shown(_K2)}, n_echantillon FROM ev JOIN sizes USING (nom)",
       CORPUS, THEMES, KEYED, _SAMPLED, _SIZES, _SREL,
       "asked AS (SELECT query_id, requete AS texte_libre FROM themes)", bm25("asked", "sampled", 20),
       evaluated("bm25", "srel", _K2))

_THEME_HYBRID = [CORPUS, THEMES, KEYED, _SAMPLED, _SIZES, _SREL, parse("themes"), f"""cuts AS (
  SELECT p.query_id, quantile_cont(s.montant, 0.9) AS cut FROM parsed p JOIN sampled s ON p.query_id = s.query_id
    AND (p.region IS NULL OR p.region = s.acheteur_region_nom) GROUP BY 1),
subset AS (SELECT s.* FROM parsed p LEFT JOIN cuts USING (query_id) JOIN sampled s
    ON p.query_id = s.query_id AND (p.region IS NULL OR p.region = s.acheteur_region_nom)
  WHERE CASE WHEN montant_min IS NOT NULL THEN montant >= montant_min
             WHEN montant_eleve_qualitatif THEN montant >= cut ELSE TRUE END),
frel AS (SELECT s.query_id, count(*) AS n FROM subset s JOIN themes USING (query_id)
  JOIN keyed k ON k.uid = s.uid WHERE {_HIT} GROUP BY 1)""",
                 bm25("parsed", "subset", 200)]
_TPAIRS = """tpairs AS (SELECT p.query_id, s.uid, a.embedding AS qvec, v.embedding AS vec FROM parsed p
  JOIN embeddings a USING (vec_id) JOIN subset s ON s.query_id = p.query_id JOIN embeddings v ON v.vec_id = s.uid)"""
select("eval_hybrid", f"SELECT nom, n_resultats, n_pertinents_corpus, {shown(_K2)}, n_echantillon FROM ev JOIN sizes USING (nom)",
       *_THEME_HYBRID, _TPAIRS, near("tpairs", 200), fuse([("bm25", "1.0"), ("near", "1.0")], k=20),
       evaluated("fused", "frel", _K2))
_CONFIGS = [fuse([("bm25", str(w[0])), ("near", str(w[1]))], f"f_{c}", k=20) for c, w in RRF_CONFIGS.items()]
_UNION = "results AS (" + " UNION ALL ".join(
    f"SELECT {q(c)} AS configuration, query_id, uid, rank FROM f_{c}" for c in RRF_CONFIGS) + ")"
select("sweep_rrf_weights", f"SELECT nom, configuration, n_resultats, n_pertinents_corpus, {shown(_K2)} FROM ev",
       *_THEME_HYBRID, _TPAIRS, near("tpairs", 200), *_CONFIGS, _UNION,
       evaluated("results", "srel", _K2, "configuration"))
select("compare_vector_sets", f"SELECT nom, model, n_resultats, n_pertinents_corpus, {shown(_K2)} FROM ev",
       *_THEME_HYBRID, _TPAIRS, """mpairs AS (SELECT 'entier' AS model, * FROM tpairs UNION ALL
  SELECT 'moitie', query_id, uid, qvec[1:32], vec[1:32] FROM tpairs)""", near("mpairs", 200, extra="model"),
       "mbm25 AS (SELECT model, b.* FROM bm25 b, (VALUES ('entier'), ('moitie')) m(model))",
       fuse([("mbm25", "1.0"), ("near", "1.0")], "fused", "query_id, model", 20),
       evaluated("fused", "srel", _K2, "model"))
select("annotation_agreement", f"""SELECT requete, count(*) AS n_lignes,
  round(avg(CASE WHEN rule = quality THEN 1.0 ELSE 0.0 END), 6) AS taux_accord,
  count(*) FILTER (rule = 1 AND quality = 0) AS faux_positifs_motscles,
  count(*) FILTER (rule = 0 AND quality = 1) AS faux_negatifs_motscles
FROM (SELECT t.query_id AS requete, l.quality, CASE WHEN {_HIT} THEN 1 ELSE 0 END AS rule
  FROM labels l JOIN keyed k ON k.uid = l.doc_id JOIN themes t
    ON t.query_id = ({names([*b.THEMES, 'inconnue'])})[CAST(l.doc_id % {len(b.THEMES) + 1} AS INT) + 1])
GROUP BY 1""", CORPUS, THEMES, KEYED)

# Anomalies -------------------------------------------------------------------------------------------------


def neighbours(rows: str, columns: list[str], k: int) -> str:
    """``rows`` has uid and the columns.  Equal rows form one point named by its lowest
    uid; of its k + 1 nearest rows the first is the point itself."""
    keys = ", ".join(columns)
    distance = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns) + ")"
    return f"""pts AS MATERIALIZED (SELECT {keys}, min(uid) AS pid FROM {rows} WHERE {' AND '.join(
        f'{c} IS NOT NULL' for c in columns)} GROUP BY {keys}),
named AS MATERIALIZED (SELECT r.uid, p.* FROM {rows} r JOIN pts p USING ({keys})),
lists AS (SELECT a.pid, min({{'d': {distance}, 'nid': b.pid}}, {k + 1}) AS l FROM pts a, named b GROUP BY a.pid),
near_ AS MATERIALIZED (SELECT pid, e.nid AS nid, e.d AS d, count(*) AS used
  FROM (SELECT pid, unnest(l[2:]) AS e FROM lists) GROUP BY 1, 2, 3)"""


select("knn_neighbours", "SELECT pid, nid, round(d, 6) AS d, used FROM near_",
       CONTRACTS, SIGNED, first_of("signed"), neighbours("firsts", ["montant", "dureeMois"], 5))
select("lof_score", """SELECT montant, dureeMois, round(-(mean_lrd / lrd), 6) AS anomaly_score_lof
FROM pts JOIN density USING (pid) JOIN around USING (pid)""",
       CONTRACTS, SIGNED, first_of("signed"), neighbours("firsts", ["montant", "dureeMois"], 5),
       "reach AS (SELECT pid AS nid, max(d) AS kd FROM near_ GROUP BY 1)",
       """density AS (SELECT pid, 1.0 / (sum(used * greatest(kd, d)) / sum(used) + 1e-10) AS lrd
  FROM near_ JOIN reach USING (nid) GROUP BY 1)""",
       """around AS (SELECT n.pid, sum(used * lrd) / sum(used) AS mean_lrd
  FROM near_ n JOIN density g ON g.pid = n.nid GROUP BY 1)""")
# The detection's imputed and scaled features make equal distances that flip on last digits;
# a test compares that with brute force.

# Prediction -----------------------------------------------------------------------------------------------

_VALID = """valid AS (SELECT * FROM contracts WHERE offresRecues >= 0 AND montant > 0
  AND dureeMois > 0 AND dureeMois <= 240)"""
_PREPARED = f"""prepared AS (SELECT *, {category('procedure')} AS procedure_normalisee,
  {category('nature')} AS nature_normalisee, substr(codeCPV, 1, 2) AS cpv_division FROM firsts)"""
select("prepare_training", """SELECT uid, montant, dureeMois, offresRecues, procedure_normalisee, nature_normalisee,
  cpv_division FROM prepared""", CONTRACTS, _VALID, first_of("valid"), _PREPARED)
select("training_features", """SELECT uid, round(ln(1 + montant), 6) AS log_montant, dureeMois,
  procedure_normalisee, nature_normalisee, coalesce(cpv_division, 'inconnu') AS cpv_division,
  acheteur_region_nom, round(ln(1 + offresRecues), 6) AS log_offresRecues FROM prepared""",
       CONTRACTS, _VALID, first_of("valid"), _PREPARED)
select("train_test_split", "SELECT uid, md5(uid || ':42') < '33333333' AS is_test FROM (SELECT DISTINCT uid FROM contracts)",
       CONTRACTS)
select("kfold_assign", """SELECT uid, CAST((row_number() OVER (ORDER BY md5(uid || ':42'), uid) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT DISTINCT uid FROM contracts)""", CONTRACTS)
select("regression_metrics", f"""SELECT procedure,
  round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2_log, round(sqrt(avg((y - p) ** 2)), 6) AS rmse_log,
  round(1 - sum((ry - rp) ** 2) / (var_pop(ry) * count(*)), 6) AS r2_reel,
  round(sqrt(avg((ry - rp) ** 2)), 6) AS rmse_reel, round(avg(abs(ry - rp)), 6) AS mae_reel
FROM (SELECT procedure, y, p, exp(y) - 1 AS ry, greatest(exp(p) - 1, 0) AS rp FROM (
  SELECT {category('procedure')} AS procedure, ln(1 + offresRecues) AS y, dureeMois / 25 - 0.1 AS p FROM valid))
GROUP BY 1""", CONTRACTS, _VALID)
select("baseline_median", """SELECT uid, round(y, 6) AS log_offresRecues,
  round((SELECT median(y) FROM split WHERE NOT t), 6) AS prediction FROM split WHERE t""",
       CONTRACTS, _VALID, first_of("valid"),
       "split AS (SELECT uid, ln(1 + offresRecues) AS y, md5(uid || ':42') < '33333333' AS t FROM firsts)")
