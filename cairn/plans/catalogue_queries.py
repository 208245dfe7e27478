"""Registered queries over the driver's tables and the SQL they are checked against.

The driver's tables stand in for a catalogue: `part` for datasets, `lineitem` for their links to values,
`orders` for snapshots and dates, `documents` and `benchmark` for searches, `embeddings` for vectors.
Arrays are shown as sorted, comma-joined text, and scores rounded, so that both engines print alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import enrich, evaluate, facets, graph, ingest, retrieval, service, snapshot, vocabulary
from cairn.operators.bm25_index import index_of
from cairn.schemas import DISTRIBUTION_NAMES
from cairn.sources.store import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LISTS = ["keywords", "themes", "categories", "spatial_coverage", "temporal_coverage"]
APP = "http://localhost:5000/"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    p, size, none = table(spark, sf, "part"), F.col("p_size"), F.array().cast("array<string>")
    return p.select(
        F.concat(F.lit("http://catalogue.example/ds"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_name").alias("title"),
        F.concat("p_name", F.lit(" of size "), size.cast("string"), F.lit(". Type "), "p_type").alias("description"),
        F.col("p_brand").alias("provider"),
        F.split("p_name", " ").alias("keywords"),
        F.array("p_type").alias("themes"),
        F.when(size % 5 == 0, F.array(F.concat(F.lit("category "), (size % 3).cast("string")))).otherwise(none).alias("categories"),
        F.when(size % 7 == 0, none).otherwise(F.array(F.concat(F.lit("region_"), (F.col("p_partkey") % 25).cast("string")))).alias("spatial_coverage"),
        F.array((1990 + size % 10).cast("string")).alias("temporal_coverage"),
    )


CAT = """cat AS (SELECT 'http://catalogue.example/ds' || p_partkey AS url, p_name AS title, p_name || ' of size ' || p_size || '. Type ' || p_type AS description,
 p_brand AS provider, string_split(p_name, ' ') AS keywords, [p_type] AS themes,
 CASE WHEN p_size % 5 = 0 THEN ['category ' || (p_size % 3)] ELSE []::VARCHAR[] END AS categories,
 CASE WHEN p_size % 7 = 0 THEN []::VARCHAR[] ELSE ['region_' || (p_partkey % 25)] END AS spatial_coverage,
 [CAST(1990 + p_size % 10 AS VARCHAR)] AS temporal_coverage FROM part)"""


def text_of(c):
    return X.joined(F.col(c) if isinstance(c, str) else c, ",")


def sql_text(c: str) -> str:
    return f"array_to_string(list_sort({c}), ',')"


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue in its denormalised form: one row for each keyword and theme."""
    c = catalogue(spark, sf).select("url", "title", "description", "provider", F.explode("keywords").alias("keywords"), "themes")
    return c.select("url", "title", "description", "provider", "keywords", F.explode("themes").alias("themes"))


# ---------------------------------------------------------------- sources and projections


@query(f"WITH {CAT} SELECT url, title, provider, {sql_text('keywords')} AS keywords, {sql_text('themes')} AS themes FROM cat")
def s01_catalog_scan(spark, sf):
    return catalogue(spark, sf).select("url", "title", "provider", text_of("keywords").alias("keywords"), text_of("themes").alias("themes"))


@query(f"""WITH {CAT} SELECT url, title || chr(10) || description || chr(10) || '(' || provider || ' | ' || array_to_string(list_sort(keywords), ', ') || ' | ' || array_to_string(list_sort(themes), ', ')
 || ' | ' || array_to_string(list_sort(spatial_coverage), ', ') || ' | ' || array_to_string(list_sort(temporal_coverage), ', ') || ')' AS full_description FROM cat""")
def p05_full_description(spark, sf):
    return ingest.with_fingerprint(catalogue(spark, sf)).select("url", "full_description")


@query(f"""WITH {CAT} SELECT url, md5(title || chr(10) || description || chr(10) || '(' || provider || ' | ' || array_to_string(list_sort(keywords), ', ') || ' | ' || array_to_string(list_sort(themes), ', ')
 || ' | ' || array_to_string(list_sort(spatial_coverage), ', ') || ' | ' || array_to_string(list_sort(temporal_coverage), ', ') || ')') AS full_description_hash FROM cat""")
def p06_md5(spark, sf):
    return ingest.with_fingerprint(catalogue(spark, sf)).select("url", "full_description_hash")


@query(f"""WITH {CAT} SELECT url AS doc_id, title || chr(10) || description || chr(10) || 'Poskytovatel: ' || provider || chr(10) || 'Klíčová slova: ' || array_to_string(list_sort(keywords), ', ')
 || chr(10) || 'Témata: ' || array_to_string(list_sort(themes), ', ') || chr(10) || 'Kategorie: ' || array_to_string(list_sort(categories), ', ') || chr(10) || 'Prostorové pokrytí: '
 || array_to_string(list_sort(spatial_coverage), ', ') || chr(10) || 'Časové pokrytí: ' || array_to_string(list_sort(temporal_coverage), ', ') AS text FROM cat""")
def p07_document_text(spark, sf):
    return ingest.documents(catalogue(spark, sf)).select("doc_id", "text")


@query(f"""WITH {CAT}, asked AS (SELECT 'http://catalogue.example/ds' || (o_orderkey % 5000) AS url, o_orderkey % 2 AS detail FROM orders),
 addresses AS (SELECT DISTINCT CASE WHEN detail = 1 THEN '{APP}dataset_detail?source=' || url ELSE url END AS address, url FROM asked)
 SELECT a.address, c.url, c.title, c.provider FROM addresses a JOIN cat c ON c.url = a.url""")
def p11_lookup_url(spark, sf):
    o = table(spark, sf, "orders")
    url = F.concat(F.lit("http://catalogue.example/ds"), (F.col("o_orderkey") % 5000).cast("string"))
    asked = o.select(F.when(F.col("o_orderkey") % 2 == 1, X.detail_url(APP, url)).otherwise(url).alias("address"))
    return facets.by_url(catalogue(spark, sf), asked, APP).select("address", "url", "title", "provider")


@query(f"WITH {CAT} SELECT title, min(url) AS url FROM cat GROUP BY title")
def p12_lookup_title(spark, sf):
    c = catalogue(spark, sf)
    return facets.by_title(c, c.select("title"))


@query("SELECT doc_id, score FROM (SELECT doc_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS score FROM labels) WHERE score >= 0.2")
def p13_cutoff(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", (F.col("doc_id") * 37 % 100 / 100.0).alias("score"))
    ranked = retrieval.reranked(rows.select(F.lit("q").alias("query"), F.col("doc_id").alias("id"), "score"), 0.2, 1 << 30)
    return ranked.select(F.col("id").alias("doc_id"), "score")


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter([CASE c_custkey % 4 WHEN 0 THEN 'Česko' WHEN 1 THEN 'cz' WHEN 2 THEN 'obec Brno' ELSE 'okres Zlín' END, 'region ' || c_nationkey],
 lambda x: NOT upper(x) IN ('ČESKÁ REPUBLIKA', 'CZ', 'CZECH REPUBLIC', 'ČESKO', 'CZECH'))), ',') AS places FROM customer""")
def p14_country_exclusion(spark, sf):
    place = F.element_at(F.array(*(F.lit(x) for x in ("Česko", "cz", "obec Brno", "okres Zlín"))), (F.col("c_custkey") % 4).cast("int") + 1)
    arr = F.array(place, F.concat(F.lit("region "), F.col("c_nationkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", text_of(X.without_countries(arr)).alias("places"))


@query(f"WITH {CAT} SELECT url, provider FROM cat WHERE list_contains(keywords, 'red') AND list_contains(themes, 'ECONOMY') AND provider = 'Brand#17'")
def p15_facet_filter_all(spark, sf):
    return facets.filtered(catalogue(spark, sf), {"keywords": ["red"], "themes": ["ECONOMY"], "provider": ["Brand#17"], "categories": []}).select("url", "provider")


@query(f"""WITH {CAT}, sel AS (SELECT * FROM (VALUES ('keywords', 'red'), ('keywords', 'no such'), ('provider', 'Brand#2'), ('themes', 'nothing')) t(facet, value)),
 there AS (SELECT 'keywords' AS facet, unnest(keywords) AS value FROM cat UNION SELECT 'themes', unnest(themes) FROM cat UNION SELECT 'provider', provider FROM cat)
 SELECT facet, value FROM sel SEMI JOIN there USING (facet, value)""")
def p16_live_filters(spark, sf):
    sel = spark.createDataFrame([("keywords", "red"), ("keywords", "no such"), ("provider", "Brand#2"), ("themes", "nothing")], "facet string, value string")
    return facets.live_filters(sel, facets.facet_counts(catalogue(spark, sf)))


_DIST = """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS title, l_linestatus,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY 'http://files/' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '/' || l_partkey || '/' || l_suppkey || '/' || l_extendedprice) AS nth FROM lineitem"""


def _distributions(spark, sf):
    file = F.concat(F.lit("http://files/"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_extendedprice").cast("string"))
    return table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("title"), F.col("l_orderkey").cast("string").alias("dataset_url"), file.alias("url"), F.col("l_linestatus").alias("file_format"))


@query(f"WITH d AS ({_DIST}) SELECT CAST(l_orderkey AS VARCHAR) AS dataset, nth AS nth, coalesce(title, 'Distribution ' || nth) AS title, l_linestatus AS file_format FROM d")
def p19_default_title(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("url"))
    rows = facets.with_distributions(o, _distributions(spark, sf)).select("url", F.explode("distributions").alias("d"))
    return rows.select(F.col("url").alias("dataset"), F.col("d.nth").cast("long").alias("nth"), F.col("d.title").alias("title"), F.col("d.file_format").alias("file_format"))


# ---------------------------------------------------------------- aggregation


@query(f"""WITH {CAT} SELECT url, title, description, provider, array_to_string(list_sort(list_distinct(keywords)), ',') AS keywords, {sql_text('themes')} AS themes FROM cat""")
def a01_merge_rows(spark, sf):
    m = ingest.merged_rows(raw_rows(spark, sf), ["keywords", "themes"])
    return m.select("url", "title", "description", "provider", text_of("keywords").alias("keywords"), text_of("themes").alias("themes"))


_FACETS = """SELECT 'keywords' AS facet, unnest(keywords) AS value, {by} AS k FROM cat UNION ALL SELECT 'themes', unnest(themes), {by} FROM cat UNION ALL SELECT 'categories', unnest(categories), {by} FROM cat
 UNION ALL SELECT 'spatial_coverage', unnest(spatial_coverage), {by} FROM cat UNION ALL SELECT 'temporal_coverage', unnest(temporal_coverage), {by} FROM cat UNION ALL SELECT 'provider', provider, {by} FROM cat"""
_TITLES = "CASE facet WHEN 'keywords' THEN 'Keywords' WHEN 'themes' THEN 'Themes' WHEN 'categories' THEN 'Categories' WHEN 'spatial_coverage' THEN 'Spatial coverage' WHEN 'temporal_coverage' THEN 'Temporal coverage' ELSE 'Provider' END"


@query(f"WITH {CAT}, f AS ({_FACETS.format(by=1)}) SELECT facet, value, count(*) AS n, {_TITLES} AS title FROM f GROUP BY facet, value")
def a03_global_facets(spark, sf):
    return facets.ordered_facets(facets.facet_counts(catalogue(spark, sf)))


@query(f"WITH {CAT}, f AS ({_FACETS.format(by='title')}) SELECT k AS title, facet, value, count(*) AS n FROM f GROUP BY ALL")
def a04_result_facets(spark, sf):
    return facets.facet_counts(catalogue(spark, sf), ["title"])


@query(f"WITH {CAT} SELECT 'keywords' AS kind, unnest(keywords) AS word FROM cat UNION SELECT 'themes', unnest(themes) FROM cat UNION SELECT 'spatial_coverage', unnest(spatial_coverage) FROM cat")
def a05_vocabulary(spark, sf):
    c = catalogue(spark, sf)
    parts = [vocabulary.vocabulary(c, k).select(F.lit(k).alias("kind"), "word") for k in ("keywords", "themes", "spatial_coverage")]
    return parts[0].union(parts[1]).union(parts[2])


def _mixed_words(spark, sf):
    p = table(spark, sf, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.lower("p_type")).otherwise(F.initcap("p_type"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.lower("p_name"))
    return p.select(F.col("p_partkey").cast("string").alias("url"), F.array(brand, name).alias("keywords"))


_INITCAP = "array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_MIXED = f"""mixed AS (SELECT CAST(p_partkey AS VARCHAR) AS url, [CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN lower(p_type) ELSE {_INITCAP.format(c='p_type')} END,
 CASE WHEN p_partkey % 2 = 0 THEN {_INITCAP.format(c='p_name')} ELSE lower(p_name) END] AS keywords FROM part),
 words AS (SELECT DISTINCT unnest(keywords) AS word FROM mixed),
 variants AS (SELECT lower(word) AS lowered, list_sort(list(word)) AS variants, bool_or(regexp_full_match(word, '[[:alpha:]]+') AND word = upper(word) AND word <> lower(word)) AS caps FROM words GROUP BY 1 HAVING count(*) > 1)"""


@query(f"WITH {_MIXED} SELECT lowered, array_to_string(variants, ',') AS variants, CASE WHEN caps THEN upper(lowered) ELSE lowered END AS unified FROM variants")
def a06_case_variants(spark, sf):
    v = vocabulary.case_variants(vocabulary.vocabulary(_mixed_words(spark, sf), "keywords"))
    return v.select("lowered", text_of("variants").alias("variants"), "unified")


@query(f"""WITH {_MIXED}, items AS (SELECT url, unnest(keywords) AS word FROM mixed)
 SELECT url, array_to_string(list_sort(list(DISTINCT CASE WHEN v.lowered IS NULL THEN word WHEN caps THEN upper(word) ELSE lower(word) END)), ',') AS keywords FROM items LEFT JOIN variants v ON v.lowered = lower(word) GROUP BY url""")
def f06_unify_case(spark, sf):
    return vocabulary.case_unified(_mixed_words(spark, sf), "keywords").select("url", text_of("keywords").alias("keywords"))


@query(f"WITH {CAT} SELECT word, count(*) AS n FROM (SELECT unnest(keywords) AS word FROM cat) GROUP BY word")
def a08_word_counts(spark, sf):
    return vocabulary.counts(catalogue(spark, sf), "keywords")


# ---------------------------------------------------------------- snapshots and joins


def _snapshots(spark, sf):
    o = table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    new = o.where("o_orderkey % 10 <> 3").select(key.cast("string").alias("url"), F.md5(F.concat(F.when(key % 7 == 0, F.lit("changed")).otherwise(F.lit("")), price)).alias("full_description_hash"))
    old = o.where("o_orderkey % 10 <> 4").select(key.cast("string").alias("url"), F.md5(price).alias("full_description_hash"))
    return new, old


_SNAP = """price AS (SELECT o_orderkey AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS p FROM orders),
 new AS (SELECT CAST(k AS VARCHAR) AS url, md5(CASE WHEN k % 7 = 0 THEN 'changed' ELSE '' END || p) AS h FROM price WHERE k % 10 <> 3),
 old AS (SELECT CAST(k AS VARCHAR) AS url, md5(p) AS h FROM price WHERE k % 10 <> 4)"""


@query(f"WITH {_SNAP} SELECT coalesce(n.url, o.url) AS url, coalesce(n.h, o.h) AS full_description_hash, CASE WHEN n.url IS NULL THEN 'old' WHEN o.url IS NULL THEN 'new' ELSE 'both' END AS state FROM new n FULL JOIN old o ON n.url = o.url AND n.h = o.h")
def j02_snapshot_diff(spark, sf):
    return snapshot.marked(*_snapshots(spark, sf), ["url", "full_description_hash"])


@query(f"WITH {_SNAP}, gone AS (SELECT url FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.url = o.url AND n.h = o.h)), kept AS (SELECT * FROM old WHERE url NOT IN (SELECT url FROM gone)) SELECT url, h AS full_description_hash FROM new WHERE url NOT IN (SELECT url FROM kept)")
def j03_new_only(spark, sf):
    return snapshot.difference(*_snapshots(spark, sf))[0]


@query(f"WITH {_SNAP}, gone AS (SELECT url FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.url = o.url AND n.h = o.h)) SELECT url, h AS full_description_hash FROM old WHERE url NOT IN (SELECT url FROM gone)")
def j04_semi(spark, sf):
    return snapshot.difference(*_snapshots(spark, sf))[2]


@query(f"WITH d AS ({_DIST}) SELECT CAST(o_orderkey AS VARCHAR) AS url, count(nth) AS n, coalesce(string_agg(coalesce(title, 'Distribution ' || nth), ',' ORDER BY nth), '') AS titles FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j05_distributions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("url"))
    rows = facets.with_distributions(o, _distributions(spark, sf))
    return rows.select("url", F.coalesce(F.size("distributions"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("distributions.title", ","), F.lit("")).alias("titles"))


@query("""SELECT a.word AS a, b.word AS b FROM (SELECT DISTINCT p_name || '' AS word FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT s_name FROM supplier) a
 JOIN (SELECT DISTINCT p_name || '' AS word FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT s_name FROM supplier) b ON a.word < b.word AND levenshtein(a.word, b.word) = 1""")
def j11_levenshtein_pairs(spark, sf):
    p = table(spark, sf, "part")
    words = p.select(F.col("p_name").alias("word")).union(p.select("p_brand")).union(table(spark, sf, "supplier").select("s_name")).distinct()
    return vocabulary.close_pairs(words)


@query("""WITH f AS (SELECT s_name AS word, s_suppkey % 5 AS n FROM supplier), p AS (SELECT a.word, b.word AS new, b.n FROM f a JOIN f b ON levenshtein(a.word, b.word) = 1 AND (b.n > a.n OR (b.n = a.n AND b.word < a.word)))
 SELECT word, new FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, new) AS r FROM p) WHERE r = 1""")
def f14_merge_similar(spark, sf):
    return vocabulary.merge_mapping(table(spark, sf, "supplier").select(F.col("s_name").alias("word"), (F.col("s_suppkey") % 5).alias("n")))


@query(f"""WITH {CAT}, m AS (SELECT DISTINCT p_type AS word, 'type ' || lower(p_type) AS new FROM part WHERE p_type < 'P'), items AS (SELECT url, unnest(themes) AS word FROM cat)
 SELECT url, string_agg(DISTINCT coalesce(new, word), ',') AS themes FROM items LEFT JOIN m USING (word) GROUP BY url""")
def j15_replace_map(spark, sf):
    m = table(spark, sf, "part").where("p_type < 'P'").select(F.col("p_type").alias("word"), F.concat(F.lit("type "), F.lower("p_type")).alias("new")).distinct()
    return vocabulary.replaced(catalogue(spark, sf), "themes", m).select("url", text_of("themes").alias("themes"))


def _triples(spark, sf):
    c = table(spark, sf, "customer")
    n, none = F.col("c_custkey"), F.lit(None).cast("string")
    one = lambda s, p, o, lang=none, when="true": c.where(when).select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), lang.cast("string").alias("lang"))
    ds, period, place = (F.concat(F.lit(x), n.cast("string")) for x in ("ds", "period", "place"))
    start, end = (1990 + n % 20).cast("string"), F.concat((1990 + n % 20 + n % 3).cast("string"), F.lit("-05-03"))
    parts = [one(ds, "temporal", period, when="c_custkey % 7 <> 0"), one(ds, "spatial", place), one(period, "startDate", start, when="c_custkey % 5 <> 0"), one(period, "endDate", end, when="c_custkey % 4 <> 0")]
    parts += [one(place, "name", F.concat(F.lit("Místo "), n.cast("string")), F.when(n % 6 == 0, "en").otherwise("cs"), "c_custkey % 2 = 0"), one(place, "label", F.concat(F.lit("Label "), n.cast("string")), F.lit("cs"), "c_custkey % 3 = 0")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""WITH t AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'Místo ' || c_custkey WHEN c_custkey % 3 = 0 THEN 'Label ' || c_custkey END AS name,
 CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'en' ELSE 'cs' END WHEN c_custkey % 3 = 0 THEN 'cs' END AS lang,
 CASE WHEN c_custkey % 5 <> 0 THEN CAST(1990 + c_custkey % 20 AS VARCHAR) END AS a, CASE WHEN c_custkey % 4 <> 0 THEN CAST(1990 + c_custkey % 20 + c_custkey % 3 AS VARCHAR) END AS b FROM customer WHERE c_custkey % 7 <> 0)
 SELECT 'ds' || n AS url, coalesce(name, '') AS spatial, coalesce(CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a ELSE a || ' – ' || b END, '') AS temporal FROM t WHERE name IS NULL OR lang = 'cs'""")
def j18_triples(spark, sf):
    return ingest.coverage_from_triples(_triples(spark, sf)).select("url", text_of("spatial_coverage").alias("spatial"), text_of("temporal_coverage").alias("temporal"))


# ---------------------------------------------------------------- sets and texts


@query(f"WITH {CAT} SELECT url, array_to_string(list_sort(list_distinct(list_concat(keywords, themes))), ',') AS words FROM cat")
def u01_union(spark, sf):
    return catalogue(spark, sf).select("url", text_of(X.union_of(F.col("keywords"), F.col("themes"))).alias("words"))


@query(f"""WITH {CAT}, p AS (SELECT a.url AS a, b.url AS b, list_sort(list_intersect(a.keywords, b.keywords)) AS common FROM cat a JOIN cat b ON a.provider = b.provider AND a.themes[1] = b.themes[1] AND a.temporal_coverage[1] = b.temporal_coverage[1] AND a.url < b.url)
 SELECT a, b, array_to_string(common, ',') AS common FROM p WHERE len(common) > 0""")
def u02_common_metadata(spark, sf):
    rows = graph.common_metadata(catalogue(spark, sf), ["provider", "themes", "temporal_coverage"], "keywords")
    return rows.select("a", "b", text_of("common").alias("common"))


@query(f"""WITH {CAT}, cat2 AS (SELECT url, list_concat(keywords, CASE WHEN length(title) % 2 = 0 THEN ['PROMO'] ELSE []::VARCHAR[] END) AS keywords, themes, categories FROM cat), v AS (SELECT list(DISTINCT t) AS t FROM (SELECT unnest(themes) AS t FROM cat2)), c AS (SELECT ['red', 'blue', 'ECONOMY'] AS c)
 SELECT url, {sql_text("list_distinct(list_concat(categories, list_concat(list_intersect(themes, c), list_intersect(keywords, c))))")} AS categories,
 {sql_text("list_filter(list_distinct(list_concat(themes, list_intersect(keywords, t))), lambda x: NOT list_contains(c, x))")} AS themes,
 {sql_text("list_filter(list_distinct(keywords), lambda x: NOT list_contains(c, x) AND NOT list_contains(t, x))")} AS keywords FROM cat2, v, c""")
def u04_promote(spark, sf):
    extra = F.when(F.length("title") % 2 == 0, F.array(F.lit("PROMO"))).otherwise(F.array().cast("array<string>"))
    c = catalogue(spark, sf).withColumn("keywords", F.concat("keywords", extra))
    return ingest.promoted(c, ["red", "blue", "ECONOMY"]).select("url", *(text_of(k).alias(k) for k in ("categories", "themes", "keywords")))


@query("SELECT p_partkey, regexp_replace(regexp_replace(chr(9) || ' ' || p_name || chr(10) || ' ', '^\\s+', ''), '\\s+$', '') AS word FROM part")
def f01_strip(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.strip(F.concat(F.lit("\t "), "p_name", F.lit("\n "))).alias("word"))


@query("""SELECT p_partkey, CASE WHEN w LIKE '%,' OR (w LIKE '%.' AND NOT w LIKE '%Sb.') THEN left(w, length(w) - 1) ELSE w END AS word FROM
 (SELECT p_partkey, p_name || ['.', ',', ' Sb.', '', '..'][1 + p_partkey % 5] AS w FROM part)""")
def f02_trailing_punct(spark, sf):
    marks = F.element_at(F.array(*(F.lit(m) for m in (".", ",", " Sb.", "", ".."))), (F.col("p_partkey") % 5).cast("int") + 1)
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", marks).alias("w"))
    return rows.select("p_partkey", X.without_trailing_mark(F.col("w")).alias("word"))


@query("SELECT word, regexp_full_match(word, '\\p{L}+') AND word = upper(word) AND word <> lower(word) AS caps FROM (SELECT DISTINCT p_type AS word FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT c_mktsegment FROM customer)")
def f04_all_caps(spark, sf):
    p = table(spark, sf, "part")
    words = p.select(F.col("p_type").alias("word")).union(p.select("p_name")).union(p.select("p_brand")).union(table(spark, sf, "customer").select("c_mktsegment")).distinct()
    return words.select("word", X.is_all_caps(F.col("word")).alias("caps"))


@query("""SELECT word, array_to_string(list_transform(regexp_extract_all(word, '(\\p{L}+|\\P{L}+)'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS titled
 FROM (SELECT DISTINCT p_name || '_of' || p_type AS word FROM part)""")
def f05_title_case(spark, sf):
    words = table(spark, sf, "part").select(F.concat("p_name", F.lit("_of"), "p_type").alias("word")).distinct()
    return words.select("word", X.title_case(F.col("word")).alias("titled"))


def _dated(spark, sf):
    o = table(spark, sf, "orders")
    fmt = lambda p: F.date_format("o_orderdate", p)
    month = F.element_at(F.array(*(F.lit(m) for m in X.MONTHS)), F.month("o_orderdate"))
    k = F.col("o_orderkey") % 5
    x = F.when(k == 0, fmt("d.M.yyyy")).when(k == 1, fmt("yyyy-MM-dd")).when(k == 2, fmt("MM/yyyy")).when(k == 3, F.concat(month, F.lit(" "), fmt("yyyy"))).otherwise(F.concat(F.lit("rok "), fmt("yyyy"), F.lit("-dnes")))
    return o.select("o_orderkey", F.array(x).alias("coverage"))


_MONTHS = "['leden', 'únor', 'březen', 'duben', 'květen', 'červen', 'červenec', 'srpen', 'září', 'říjen', 'listopad', 'prosinec']"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'rok ' || year(o_orderdate) || '-dnes' WHEN 2 THEN array_to_string(list_sort([CAST(year(o_orderdate) AS VARCHAR), {_MONTHS}[month(o_orderdate)]]), ',')
 WHEN 3 THEN array_to_string(list_sort([CAST(year(o_orderdate) AS VARCHAR), {_MONTHS}[month(o_orderdate)]]), ',') ELSE CAST(year(o_orderdate) AS VARCHAR) END AS coverage FROM orders""")
def f07_extract_year(spark, sf):
    return _dated(spark, sf).select("o_orderkey", text_of(X.years_and_months(F.col("coverage"))).alias("coverage"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) WHEN 1 THEN strftime(o_orderdate, '%Y–%m–%d') WHEN 2 THEN strftime(o_orderdate, '%m/%Y')
 WHEN 3 THEN {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) ELSE year(o_orderdate) || ' – 2025' END AS coverage FROM
 orders""".replace("strftime(o_orderdate, '%Y–%m–%d')", "strftime(o_orderdate, '%Y') || ' – ' || strftime(o_orderdate, '%m') || ' – ' || strftime(o_orderdate, '%d')"))
def f08_simplify_temporal(spark, sf):
    return _dated(spark, sf).select("o_orderkey", text_of(X.simple_periods(F.col("coverage"), 2025)).alias("coverage"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_transform(list_filter([['Česko', 'cz', 'obec Brno', 'okres Zlín'][1 + c_custkey % 4], 'region ' || c_nationkey], lambda x: NOT upper(x) IN ('ČESKÁ REPUBLIKA', 'CZ', 'CZECH REPUBLIC', 'ČESKO', 'CZECH')),
 lambda x: replace(replace(x, 'obec ', ''), 'okres ', ''))), ',') AS places FROM customer""")
def f09_spatial(spark, sf):
    place = F.element_at(F.array(*(F.lit(x) for x in ("Česko", "cz", "obec Brno", "okres Zlín"))), (F.col("c_custkey") % 4).cast("int") + 1)
    rows = table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_custkey").cast("string").alias("url"), F.array(place, F.concat(F.lit("region "), F.col("c_nationkey").cast("string"))).alias("spatial_coverage"), F.array().cast("array<string>").alias("temporal_coverage"))
    return vocabulary.cleaned_coverage(rows, 2025).select("c_custkey", text_of("spatial_coverage").alias("places"))


_DATES = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' ELSE 'about ' || year(o_orderdate) END"


def _date_text(key="o_orderkey"):
    fmt = lambda p: F.date_format("o_orderdate", p)
    k = F.col(key) % 4
    return F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("yyyy-MM")).when(k == 2, F.concat(fmt("yyyy-MM-dd"), F.lit(" 12:00:00"))).otherwise(F.concat(F.lit("about "), fmt("yyyy")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'about ' || year(o_orderdate) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders")
def f11_year_of_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.year_of(_date_text()).alias("year"))


@query("""WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 4 = 3 THEN 'about ' || year(o_orderdate) ELSE CAST(year(o_orderdate) AS VARCHAR) END END AS a,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) + o_orderkey % 2 AS VARCHAR) END AS b FROM orders)
 SELECT o_orderkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a ELSE a || ' – ' || b END AS years FROM y""")
def f12_year_range(spark, sf):
    start, end = F.when(F.col("o_orderkey") % 3 != 0, _date_text()), F.when(F.col("o_orderkey") % 5 != 0, (F.year("o_orderdate") + F.col("o_orderkey") % 2).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", X.year_range(start, end).alias("years"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN strpos(text, '.') BETWEEN 1 AND 200 THEN left(text, strpos(text, '.'))
 ELSE (CASE WHEN strpos(reverse(left(text, 200)), ' ') > 0 THEN left(text, 200 - strpos(reverse(left(text, 200)), ' ')) ELSE left(text, 199) END) || '...' END AS preview FROM documents""")
def f16_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ', expansion ' || item_id ELSE '' END || CASE WHEN item_id % 3 = 0 THEN ', red.blue' ELSE '' END AS q FROM benchmark")
def f18_compose_query(spark, sf):
    i = F.col("item_id")
    filters = F.when(i % 3 == 0, F.array(F.lit("red"), F.lit("blue"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "benchmark").select("item_id", X.composed_query(F.col("text"), F.when(i % 2 == 0, F.concat(F.lit("expansion "), i.cast("string"))), filters).alias("q"))


@query("SELECT page_id, 'http://localhost:5000/dataset_detail?source=' || url AS address FROM pages")
def f19_detail_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.detail_url(APP, F.col("url")).alias("address"))


# ---------------------------------------------------------------- windows


@query("SELECT l_partkey, l_orderkey, l_linenumber, price, nth FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS nth FROM lineitem) WHERE nth <= 5")
def w01_topk_per_key(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("anchor"), "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    rows = graph.best_of(rows, ["l_extendedprice"], 5, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("nth").cast("long").alias("nth"))


def _scores(spark, sf):
    label = table(spark, sf, "labels")
    q = (F.col("doc_id") % 20).cast("string")
    one = label.select(q.alias("query"), F.lit("vector").alias("retriever"), F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") * 17 % 101 / 101.0).alias("score"))
    two = label.where("doc_id % 3 <> 0").select(q.alias("query"), F.lit("bm25").alias("retriever"), F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") * 7 % 13 / 1.0).alias("score"))
    return one.union(two)


_SCORES = """scores AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS query, 'vector' AS retriever, CAST(doc_id AS VARCHAR) AS id, (doc_id * 17 % 101) / 101.0::DOUBLE AS score FROM labels
 UNION ALL SELECT CAST(doc_id % 20 AS VARCHAR), 'bm25', CAST(doc_id AS VARCHAR), (doc_id * 7 % 13) / 1.0::DOUBLE FROM labels WHERE doc_id % 3 <> 0),
 rel AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY query, retriever)),
 dist AS (SELECT *, avg(score) OVER w - 3 * stddev_pop(score) OVER w AS lo, avg(score) OVER w + 3 * stddev_pop(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY query, retriever))"""
_NORM = "CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END"
_WEIGHT = "CASE retriever WHEN 'vector' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END"
_FUSED = f"SELECT query, id, round(sum({_NORM} * {_WEIGHT}), 9) AS score FROM {{t}} GROUP BY query, id"


@query(f"WITH {_SCORES} SELECT query, retriever, id, round({_NORM}, 6) AS norm FROM rel")
def w03_minmax_norm(spark, sf):
    return retrieval.normalized(_scores(spark, sf)).select("query", "retriever", "id", F.round("norm", 6).alias("norm"))


@query(f"WITH {_SCORES}, f AS ({_FUSED.format(t='rel')}) SELECT query, id, round(score, 6) AS score, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS nth FROM f) WHERE nth <= 40")
def v06_relative_fusion(spark, sf):
    rows = retrieval.fused(_scores(spark, sf), {"vector": 0.6, "bm25": 0.4})
    return rows.select("query", "id", F.round("score", 6).alias("score"), F.col("nth").cast("long").alias("nth"))


@query(f"WITH {_SCORES}, f AS ({_FUSED.format(t='dist')}) SELECT query, id, round(score, 6) AS score, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS nth FROM f) WHERE nth <= 40")
def v07_dist_fusion(spark, sf):
    rows = retrieval.fused(_scores(spark, sf), {"vector": 0.6, "bm25": 0.4}, mode="dist_based_score")
    return rows.select("query", "id", F.round("score", 6).alias("score"), F.col("nth").cast("long").alias("nth"))


@query("""SELECT conv_id, turn, n_tokens FROM (SELECT conv_id, turn, n_tokens, sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM
 (SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM conversations)) WHERE upto <= 60""")
def w07_chat_memory(spark, sf):
    return evaluate.recent_turns(table(spark, sf, "conversations"), 60).select("conv_id", "turn", "n_tokens")


_RESULTS = """res AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS query, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id - doc_id % 40 + doc_id % 20 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS parent, (doc_id * 37 % 100) / 100.0::DOUBLE AS score FROM labels)"""
_FOLDED = f"""{_RESULTS}, marked AS (SELECT r.*, r.parent <> r.id AND EXISTS (SELECT 1 FROM res p WHERE p.query = r.query AND p.id = r.parent) AS child FROM res r),
 folded AS (SELECT query, CASE WHEN child THEN parent ELSE id END AS id, round(sum(score), 9) AS score FROM marked GROUP BY 1, 2)"""


def _results(spark, sf):
    d = F.col("doc_id")
    parent = F.when(d % 3 == 0, (d - d % 40 + d % 20).cast("string")).otherwise(d.cast("string"))
    return table(spark, sf, "labels").select((d % 20).cast("string").alias("query"), d.cast("string").alias("id"), parent.alias("parent"), (d * 37 % 100 / 100.0).alias("score"))


@query(f"WITH {_FOLDED} SELECT query, id, round(score, 6) AS score FROM folded")
def v08_dedup(spark, sf):
    return retrieval.folded(_results(spark, sf)).select("query", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_RESULTS}, marked AS (SELECT r.query, r.id, r.parent, r.score, p.score AS parent_score FROM res r JOIN res p ON p.query = r.query AND p.id = r.parent AND r.id <> r.parent) SELECT query, id, parent, round(score + parent_score, 6) AS score FROM marked")
def j12_parent_merge(spark, sf):
    return retrieval.with_parents(_results(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {_FOLDED} SELECT query, id, round(score, 6) AS score, nth FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS nth FROM folded WHERE score >= 0.2) WHERE nth <= 30")
def v09_rerank(spark, sf):
    rows = retrieval.reranked(retrieval.folded(_results(spark, sf)))
    return rows.select("query", "id", F.round("score", 6).alias("score"), F.col("nth").cast("long").alias("nth"))


# ---------------------------------------------------------------- vectors, BM25 and search


@query("""SELECT query, id, round(score, 5) AS score FROM (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, CAST(v.vec_id AS VARCHAR)) AS nth FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE nth <= 25""")
def v04_vector_search(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieval.nearest(e.where("id % 50 = 0"), e, 25).select("query", "id", F.round("score", 5).alias("score"))


@query("""WITH s AS (SELECT CAST(a.vec_id AS VARCHAR) AS a, CAST(b.vec_id AS VARCHAR) AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS nth FROM s), kept AS (SELECT a, b, score FROM r WHERE nth <= 6 AND a <> b AND score >= 0.2 AND b >= a)
 SELECT a, b, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM kept) WHERE n <= 5""")
def v03_knn_similar(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("vec_id").cast("string").alias("ref_doc_id"), "embedding")
    return retrieval.similar_documents(e, 5, 0.2).select("a", "b", F.round("score", 5).alias("score"))


_BM25 = """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
 post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
 qs AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark WHERE item_id % 10 = 0),
 idf AS (SELECT term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stats WHERE term IN (SELECT term FROM qs) GROUP BY term),
 bm AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM qs JOIN post USING (term) JOIN idf USING (term), stats GROUP BY item_id, doc_id),
 bm25 AS (SELECT CAST(item_id AS VARCHAR) AS query, CAST(doc_id AS VARCHAR) AS id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS nth FROM bm)"""


def _items(spark, sf):
    """The query set: every 10th item."""
    return table(spark, sf, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").cast("string").alias("query"), "text")


def _bm25_index(spark, sf):
    """The index of the documents, kept in the shared folder and built once for each state of their file."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return index_of(spark, shared_folder(spark), f"{sf}/documents.parquet", docs)


@query(f"WITH {_BM25} SELECT query, id, round(score, 5) AS score FROM bm25 WHERE nth <= 25")
def v05_bm25(spark, sf):
    return _bm25_index(spark, sf).top_k(_items(spark, sf)).select("query", "id", F.round("score", 5).alias("score"))


@query(f"""WITH {_BM25}, cos AS (SELECT CAST(q.vec_id AS VARCHAR) AS query, CAST(v.vec_id AS VARCHAR) AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 10 = 0)),
 vec AS (SELECT query, id, round(score, 9) AS score FROM cos QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 25),
 scores AS (SELECT query, 'bm25' AS retriever, id, score FROM bm25 WHERE nth <= 25 UNION ALL SELECT query, 'vector', id, score FROM vec),
 rel AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY query, retriever)), f AS ({_FUSED.format(t='rel')}),
 top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM f QUALIFY r <= 40), good AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS nth FROM top WHERE score >= 0.2 QUALIFY nth <= 30)
 SELECT query, id, round(score, 5) AS score, nth, source, lang FROM good JOIN documents ON CAST(doc_id AS VARCHAR) = id""")
def v11_search(spark, sf):
    """Vectors stand for the documents and items of their ids."""
    bm = _bm25_index(spark, sf).top_k(_items(spark, sf))
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    asked = vectors.join(table(spark, sf, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("id")), "id", "left_semi")
    vec = retrieval.nearest(asked, vectors, 25).withColumn("score", F.round("score", 9))
    cat = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), "source", "lang")
    rows = retrieval.search(vec.select("query", "id", F.col("id").alias("parent"), "score"), bm.select("query", "id", F.col("id").alias("parent"), "score"), cat)
    return rows.select("query", "id", F.round("score", 5).alias("score"), F.col("nth").cast("long").alias("nth"), "source", "lang")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
 c AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 50) / 450.0) AS BIGINT)))) AS chunk FROM w)
 SELECT doc_id || '#' || chunk AS node_id, CAST(doc_id AS VARCHAR) AS ref_doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(w[chunk * 450 + 1:chunk * 450 + 500], ' ') AS text FROM c""")
def v01_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return ingest.chunks(docs, size=500, overlap=50)


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
 SELECT CAST(doc_id AS VARCHAR) AS ref_doc_id, greatest(1, CAST(ceil((n - 50) / 450.0) AS BIGINT)) AS nodes FROM w""")
def a13_nodes_per_document(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return ingest.chunks(docs, size=500, overlap=50).groupBy("ref_doc_id").agg(F.count("*").alias("nodes"))


@query(f"WITH {CAT} SELECT 'themes' AS attribute, unnest(themes) AS value FROM cat UNION SELECT 'categories', unnest(categories) FROM cat UNION SELECT 'provider', provider FROM cat")
def l11_list_values(spark, sf):
    c = catalogue(spark, sf)
    parts = [service.list_values(c, a).select(F.lit(a).alias("attribute"), "value") for a in service.LISTED]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT l_orderkey AS dataset, l_partkey AS url, lower(l_returnflag) AS file_format FROM lineitem")
def p03_distribution_columns(spark, sf):
    columns = {"title": F.col("l_linestatus"), "dataset_url": F.col("l_orderkey"), "url": F.col("l_partkey"), "file_format": F.lower("l_returnflag")}
    raw = table(spark, sf, "lineitem").select("l_linenumber", *(columns[new].alias(old) for old, new in DISTRIBUTION_NAMES.items()))
    return facets.distribution_columns(raw).select(F.col("dataset_url").alias("dataset"), "url", "file_format")


# ---------------------------------------------------------------- graph

_EDGES = """SELECT url, 'HAS_KEYWORD' AS rel_type, 'Keyword' AS node_label, unnest(keywords) AS name FROM cat UNION SELECT url, 'HAS_THEME', 'Theme', unnest(themes) FROM cat UNION SELECT url, 'HAS_CATEGORY', 'Category', unnest(categories) FROM cat
 UNION SELECT url, 'HAS_SPATIAL_COVERAGE', 'SpatialCoverage', unnest(spatial_coverage) FROM cat UNION SELECT url, 'HAS_TEMPORAL_COVERAGE', 'TemporalCoverage', unnest(temporal_coverage) FROM cat UNION SELECT url, 'PROVIDED_BY', 'Provider', provider FROM cat"""
_TITLE = "array_to_string(list_transform(regexp_extract_all(name, '(\\p{L}+|\\P{L}+)'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"
EDGES = f"{CAT}, edges AS (SELECT DISTINCT url, rel_type, node_label, {_TITLE} AS name FROM ({_EDGES}))"
#: A stated set of queries: every dataset whose number is divisible by 50, against all.
_ANCHORS = "anchors AS (SELECT url AS anchor FROM cat WHERE CAST(replace(url, 'http://catalogue.example/ds', '') AS BIGINT) % 50 = 0)"
_PAIRS = "pairs AS (SELECT a.anchor, e.url, e.rel_type, e.name FROM anchors a JOIN edges x ON x.url = a.anchor JOIN edges e ON e.rel_type = x.rel_type AND e.name = x.name AND e.url <> a.anchor)"
_SIM = """sim AS (SELECT 'http://catalogue.example/ds' || least(x, y) AS url_lo, 'http://catalogue.example/ds' || greatest(x, y) AS url_hi, max(score) AS score FROM
 (SELECT p_partkey AS x, p_partkey * 7 % (SELECT count(*) FROM part) AS y, (p_partkey * 31 % 97) / 97.0::DOUBLE AS score FROM part) WHERE x <> y GROUP BY least(x, y), greatest(x, y))"""


def _anchors(spark, sf):
    return catalogue(spark, sf).where(F.replace("url", F.lit("http://catalogue.example/ds"), F.lit("")).cast("long") % 50 == 0).select("url")


def _edges(spark, sf):
    return graph.metadata_edges(catalogue(spark, sf))


def _similar(spark, sf):
    part = table(spark, sf, "part")
    p = part.select(F.col("p_partkey").alias("x"), (F.col("p_partkey") * 7 % F.lit(part.count())).alias("y"), (F.col("p_partkey") * 31 % 97 / 97.0).alias("score")).where("x <> y")
    url = lambda c: F.concat(F.lit("http://catalogue.example/ds"), c.cast("string"))
    return p.groupBy(url(F.least("x", "y")).alias("url_lo"), url(F.greatest("x", "y")).alias("url_hi")).agg(F.max("score").alias("score"))


@query(f"WITH {EDGES} SELECT url, rel_type, node_label, name FROM edges")
def g08_edges(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {EDGES} SELECT node_label, count(DISTINCT name) AS n FROM edges GROUP BY node_label UNION ALL SELECT 'Dataset', count(DISTINCT url) FROM edges")
def a19_node_counts(spark, sf):
    return graph.nodes(_edges(spark, sf)).groupBy("node_label").agg(F.count("*").alias("n"))


def _by_attribute(rel: str) -> str:
    return f"""SELECT anchor, url, shared, other, names FROM (SELECT s.anchor, s.url, s.shared, coalesce(o.other, 0) AS other, s.names, row_number() OVER (PARTITION BY s.anchor ORDER BY shared DESC, coalesce(other, 0) DESC, s.url) AS r FROM
 (SELECT anchor, url, count(DISTINCT name) AS shared, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM pairs WHERE rel_type = '{rel}' GROUP BY anchor, url) s LEFT JOIN
 (SELECT anchor, url, count(DISTINCT rel_type || ':' || name) AS other FROM pairs WHERE starts_with(rel_type, 'HAS_') AND rel_type <> '{rel}' GROUP BY anchor, url) o ON o.anchor = s.anchor AND o.url = s.url) WHERE r <= 5"""


_BY_PROVIDER = """SELECT anchor, url, shared, names FROM (SELECT p.anchor, p.url, count(DISTINCT rel_type || ':' || name) AS shared, array_to_string(list_sort(list(DISTINCT rel_type || ':' || name)), ',') AS names,
 row_number() OVER (PARTITION BY p.anchor ORDER BY count(DISTINCT rel_type || ':' || name) DESC, p.url) AS r FROM pairs p WHERE starts_with(rel_type, 'HAS_') AND (p.anchor, p.url) IN (SELECT (anchor, url) FROM pairs WHERE rel_type = 'PROVIDED_BY') GROUP BY p.anchor, p.url) WHERE r <= 5"""
_BY_DESCRIPTION = "SELECT anchor, url, round(score, 6) AS score FROM (SELECT a.anchor, s.url, s.score, row_number() OVER (PARTITION BY a.anchor ORDER BY s.score DESC, s.url) AS r FROM anchors a JOIN (SELECT url_lo AS anchor, url_hi AS url, score FROM sim UNION ALL SELECT url_hi, url_lo, score FROM sim) s USING (anchor)) WHERE r <= 5"


@query(f"WITH {CAT}, {_ANCHORS}, {_SIM} {_BY_DESCRIPTION}")
def g11_similar_description(spark, sf):
    return graph.similar_by_description(_similar(spark, sf), _anchors(spark, sf)).select("anchor", "url", F.round("score", 6).alias("score"))


@query(f"WITH {EDGES}, {_ANCHORS}, {_PAIRS} {_by_attribute('HAS_KEYWORD')}")
def g12_similar_by_category(spark, sf):
    rows = graph.similar_by_attribute(_edges(spark, sf), _anchors(spark, sf), "HAS_KEYWORD")
    return rows.select("anchor", "url", "shared", "other", text_of("names").alias("names"))


@query(f"WITH {EDGES}, {_ANCHORS}, {_PAIRS} {_BY_PROVIDER}")
def g13_similar_by_provider(spark, sf):
    rows = graph.similar_by_provider(_edges(spark, sf), _anchors(spark, sf))
    return rows.select("anchor", "url", "shared", text_of("names").alias("names"))


@query(f"""WITH {EDGES}, {_ANCHORS}, {_PAIRS}, {_SIM} SELECT anchor, 0 AS place, 'description' AS list, url FROM ({_BY_DESCRIPTION}) UNION ALL SELECT anchor, 3, 'provider', url FROM ({_BY_PROVIDER})
 UNION ALL SELECT anchor, 1, 'themes', url FROM ({_by_attribute('HAS_THEME')}) UNION ALL SELECT anchor, 2, 'keywords', url FROM ({_by_attribute('HAS_KEYWORD')})
 UNION ALL SELECT anchor, 4, 'spatial_coverage', url FROM ({_by_attribute('HAS_SPATIAL_COVERAGE')}) UNION ALL SELECT anchor, 5, 'temporal_coverage', url FROM ({_by_attribute('HAS_TEMPORAL_COVERAGE')})""")
def g14_all_similar(spark, sf):
    return graph.all_similar(_edges(spark, sf), _similar(spark, sf), _anchors(spark, sf)).select("anchor", "place", "list", "url")


@query(f"""WITH {EDGES}, {_ANCHORS}, {_PAIRS}, top AS ({_by_attribute('HAS_KEYWORD')}) SELECT t.anchor, t.url, c.title, c.description AS preview, array_to_string(list_sort(list_intersect(c.keywords, a.keywords)), ',') AS common
 FROM top t JOIN cat c ON c.url = t.url JOIN cat a ON a.url = t.anchor""")
def g18_previews(spark, sf):
    c = catalogue(spark, sf)
    rows = graph.similar_by_attribute(_edges(spark, sf), _anchors(spark, sf), "HAS_KEYWORD").select("anchor", F.lit(2).alias("place"), F.lit("keywords").alias("list"), "url")
    return graph.with_previews(rows, c).select("anchor", "url", "title", "preview", text_of("common").alias("common"))


_GONE = "gone AS (SELECT url FROM cat WHERE CAST(replace(url, 'http://catalogue.example/ds', '') AS BIGINT) % 10 = 0)"


def _gone(spark, sf):
    return catalogue(spark, sf).where(F.replace("url", F.lit("http://catalogue.example/ds"), F.lit("")).cast("long") % 10 == 0).select("url")


@query(f"WITH {CAT}, {_SIM}, {_GONE} SELECT url_lo, url_hi, round(score, 6) AS score FROM sim WHERE url_lo NOT IN (SELECT url FROM gone) AND url_hi NOT IN (SELECT url FROM gone)")
def g17_detach_delete(spark, sf):
    return graph.detached(_edges(spark, sf), _similar(spark, sf), _gone(spark, sf))[1].select("url_lo", "url_hi", F.round("score", 6).alias("score"))


@query(f"""WITH {CAT}, {_SIM}, {_GONE}, lost AS (SELECT url_hi AS url FROM sim WHERE url_lo IN (SELECT url FROM gone) UNION SELECT url_lo FROM sim WHERE url_hi IN (SELECT url FROM gone)),
 asked AS (SELECT url FROM lost WHERE url NOT IN (SELECT url FROM gone)), kept AS (SELECT * FROM sim WHERE url_lo NOT IN (SELECT url FROM gone) AND url_hi NOT IN (SELECT url FROM gone)),
 new AS (SELECT least(url, 'http://catalogue.example/hub') AS url_lo, greatest(url, 'http://catalogue.example/hub') AS url_hi, 0.5::DOUBLE AS score FROM asked)
 SELECT url_lo, url_hi, round(score, 6) AS score FROM kept UNION ALL SELECT url_lo, url_hi, score FROM new""")
def g16_incremental_graph(spark, sf):
    none = catalogue(spark, sf).limit(0)
    to_hub = lambda urls: urls.select(F.col("url").alias("a"), F.lit("http://catalogue.example/hub").alias("b"), F.lit(0.5).alias("score"))
    return graph.updated(_edges(spark, sf), _similar(spark, sf), none, _gone(spark, sf), to_hub)[1].select("url_lo", "url_hi", F.round("score", 6).alias("score"))


def _line_edges(spark, sf):
    """Orders as datasets with their parts as values and their suppliers as providers, and every 50th as an anchor."""
    li = table(spark, sf, "lineitem")
    edge = lambda rel, c: li.select(F.col("l_orderkey").alias("url"), F.lit(rel).alias("rel_type"), F.col(c).cast("string").alias("name")).distinct()
    return edge("HAS_PART", "l_partkey").union(edge("PROVIDED_BY", "l_suppkey")), li.where("l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("url")).distinct()


_BIG_PAIRS = "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), a AS (SELECT * FROM e WHERE l_orderkey % 50 = 0)"


@query(f"{_BIG_PAIRS} SELECT a.l_orderkey AS anchor, e.l_orderkey AS other, count(DISTINCT e.l_partkey) AS shared FROM a JOIN e ON e.l_partkey = a.l_partkey AND e.l_orderkey <> a.l_orderkey GROUP BY 1, 2")
def j07_shared_metadata(spark, sf):
    rows = graph.shared_values(*_line_edges(spark, sf)).where("rel_type = 'HAS_PART'")
    return rows.select("anchor", F.col("url").alias("other"), "shared")


@query(f"""{_BIG_PAIRS} SELECT DISTINCT a.l_orderkey AS anchor, e.l_orderkey AS other FROM a JOIN e ON e.l_partkey = a.l_partkey AND e.l_orderkey <> a.l_orderkey
 WHERE EXISTS (SELECT 1 FROM e s, e t WHERE s.l_orderkey = a.l_orderkey AND t.l_orderkey = e.l_orderkey AND s.l_suppkey = t.l_suppkey)""")
def j09_same_provider(spark, sf):
    rows = graph.of_same_provider(*_line_edges(spark, sf))
    return rows.select("anchor", F.col("url").alias("other"))


@query(f"WITH {EDGES} SELECT name, n, datasets FROM (SELECT name, count(*) AS n, count(DISTINCT url) AS datasets FROM edges GROUP BY name) ORDER BY n DESC, datasets DESC, name LIMIT 5")
def t04_two_key_topk(spark, sf):
    rows = _edges(spark, sf).groupBy(F.lit("all").alias("anchor"), F.col("name").alias("url")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("datasets"))
    return graph.best_of(rows, ["n", "datasets"], 5).select(F.col("url").alias("name"), "n", "datasets")


# ---------------------------------------------------------------- enrichment and evaluation


@query(f"""WITH {CAT} SELECT url, CAST(greatest(3 - len(keywords), 0) AS INTEGER) AS need_keywords, CASE WHEN len(categories) > 0 THEN 0 ELSE 2 END AS need_categories, len(spatial_coverage) = 0 AS need_spatial, len(temporal_coverage) = 0 AS need_temporal,
 len(keywords) < 3 OR len(categories) = 0 OR len(spatial_coverage) = 0 OR len(temporal_coverage) = 0 AS ask FROM cat""")
def l04_enrich_gate(spark, sf):
    return enrich.gate(catalogue(spark, sf)).select("url", "need_keywords", "need_categories", "need_spatial", "need_temporal", "ask")


@query(f"WITH {CAT} SELECT url, {sql_text('keywords')} AS keywords, {sql_text('categories')} AS categories, {sql_text('spatial_coverage')} AS spatial_coverage FROM cat")
def l05_enrich_without_model(spark, sf):
    from cairn import ship

    ship(spark)
    return enrich.enriched(catalogue(spark, sf)).select("url", *(text_of(c).alias(c) for c in ("keywords", "categories", "spatial_coverage")))


_JUDGED = """judg AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS query, CAST(doc_id AS VARCHAR) AS url, CAST(doc_id % 4 + 1 AS INTEGER) AS ranking FROM labels WHERE quality = 1),
 rel AS (SELECT query, url, max(ranking) OVER (PARTITION BY query) - ranking + 1 AS relevance FROM judg),
 found AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS query, CAST(doc_id AS VARCHAR) AS url, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id * 37 % 101 DESC, doc_id) AS nth FROM labels QUALIFY nth <= 30),
 seen AS (SELECT f.query, nth, coalesce(relevance, 0) AS rel, row_number() OVER (PARTITION BY f.query ORDER BY coalesce(relevance, 0) DESC, nth) AS best FROM found f LEFT JOIN rel USING (query, url)),
 sums AS (SELECT query, sum(CASE WHEN nth <= 10 THEN rel / log2(nth + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) AS idcg, sum(CASE WHEN nth <= 10 AND rel > 0 THEN 1 ELSE 0 END) AS hits,
 min(CASE WHEN nth <= 10 AND rel > 0 THEN nth END) AS first FROM seen GROUP BY query), judged AS (SELECT query, count(*) AS n FROM rel GROUP BY query),
 m AS (SELECT query, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, coalesce(hits, 0) / n::DOUBLE AS recall, coalesce(1 / first::DOUBLE, 0) AS mrr FROM judged LEFT JOIN sums USING (query))"""


def _metrics(spark, sf):
    from pyspark.sql import Window

    label, d = table(spark, sf, "labels"), F.col("doc_id")
    judg = label.where("quality = 1").select((d % 20).cast("string").alias("query"), d.cast("string").alias("url"), (d % 4 + 1).cast("int").alias("ranking"))
    nth = F.row_number().over(Window.partitionBy(d % 20).orderBy(F.desc(d * 37 % 101), "doc_id"))
    found = label.withColumn("nth", nth).where("nth <= 30").select((d % 20).cast("string").alias("query"), d.cast("string").alias("url"), "nth")
    return evaluate.metrics(found, judg)


@query(f"WITH {_JUDGED} SELECT query, round(recall, 6) AS recall FROM m")
def e02_recall(spark, sf):
    return _metrics(spark, sf).select("query", F.round("recall", 6).alias("recall"))


@query(f"WITH {_JUDGED} SELECT query, round(mrr, 6) AS mrr FROM m")
def e03_mrr(spark, sf):
    return _metrics(spark, sf).select("query", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_JUDGED} SELECT query, round(ndcg, 6) AS ndcg FROM m")
def e04_ndcg(spark, sf):
    return _metrics(spark, sf).select("query", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_JUDGED} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM m")
def e05_macro(spark, sf):
    return evaluate.macro(_metrics(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))
