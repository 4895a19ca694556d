"""Text, address and fuzzy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()

#: normalize_text in SQL.
_NORM = "trim(regexp_replace(upper(strip_accents(replace(replace(coalesce({0}, ''), 'ß', 'ss'), 'ẞ', 'SS'))), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"""
    SELECT doc_id, sha256(n) AS norm_sha256, length(n) AS n_norm, sha256(k) AS key_sha256 FROM (
      SELECT doc_id, {_NORM.format("text")} AS n, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\\s+', ' ', 'g')) AS k FROM documents)
""")
def text_normalize(spark, sf_dir):
    n = T.normalize_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(n, 256).alias("norm_sha256"), F.length(n).cast("long").alias("n_norm"), F.sha2(T.address_key("text"), 256).alias("key_sha256"))


@query(f"""
    SELECT doc_id, regexp_extract({_NORM.format("text")}, '(\\d{{1,5}})', 1) AS first_number,
      array_to_string(list_sort(list_distinct(regexp_extract_all({_NORM.format("text")}, '\\d{{1,5}}'))), ',') AS numbers,
      regexp_extract({_NORM.format("text")}, '(\\d{{5}})', 1) AS postcode
    FROM documents
""")
def number_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.street_number("text").alias("first_number"), F.array_join(T.street_numbers("text"), ",").alias("numbers"), T.postcode("text").alias("postcode"))


@query(f"""
    SELECT c_custkey, num AS numero_norm, ind AS indice_norm, kind AS type_voie_norm, street AS voie_norm, cp AS code_postal_norm,
      concat_ws(', ', concat_ws(' ', nullif(num, ''), nullif(ind, ''), nullif(kind, ''), nullif(street, '')), nullif(concat_ws(' ', nullif(cp, ''), nullif(city, '')), '')) AS address_norm
    FROM (SELECT c_custkey, regexp_extract(c_name, '(\\d{{1,5}})', 1) AS num,
        CASE c_custkey % 4 WHEN 0 THEN 'BIS' WHEN 1 THEN 'TER' WHEN 2 THEN '' ELSE 'A' END AS ind,
        CASE c_custkey % 3 WHEN 0 THEN 'AVENUE' WHEN 1 THEN 'BOULEVARD' ELSE 'RUE' END AS kind,
        {_NORM.format("c_mktsegment")} AS street, {_NORM.format("n_name")} AS city, lpad((c_custkey % 95000)::VARCHAR, 5, '0') AS cp
      FROM customer JOIN nation ON n_nationkey = c_nationkey)
""")
def address_struct(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int"))
    parts = T.address_parts("c_name", pick(["b", "ter", "", "a"]), pick(["Av.", "bd", "rue"]), "c_mktsegment", "n_name", F.lpad((F.col("c_custkey") % 95000).cast("string"), 5, "0"))
    return c.select("c_custkey", parts.alias("a")).select("c_custkey", "a.numero_norm", "a.indice_norm", "a.type_voie_norm", "a.voie_norm", "a.code_postal_norm", "a.address_norm")


@query("""
    SELECT o_orderkey, lpad(right(o_orderkey::VARCHAR, 4), 4, '0') AS parcel_number, substr(lpad(o_custkey::VARCHAR, 5, '0'), 1, 2) AS division,
      CASE WHEN lpad((97000 + o_custkey % 2000)::VARCHAR, 5, '0')[1:2] IN ('97', '98') THEN lpad((97000 + o_custkey % 2000)::VARCHAR, 5, '0')[1:3] END AS department,
      strftime(o_orderdate, '%Y-%m') AS year_month, 'parcelle:' || o_custkey || ':AB:' || lpad(right(o_orderkey::VARCHAR, 4), 4, '0') AS parcel_id,
      ('0x' || substr(sha256(o_orderkey || '|' || o_custkey), 1, 15))::BIGINT AS hashed_id
    FROM orders
""")
def identifiers(spark, sf_dir):
    number, insee = T.parcel_number(F.concat(F.lit("n°"), F.col("o_orderkey").cast("string"))), F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        number.alias("parcel_number"),
        T.activity_division(F.lpad(insee, 5, "0")).alias("division"),
        T.department(F.lpad((F.col("o_custkey") % 2000 + 97000).cast("string"), 5, "0")).alias("department"),
        T.year_month(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year_month"),
        T.parcel_id(insee, F.lit("AB"), number).alias("parcel_id"),
        T.hashed_id(F.col("o_orderkey").cast("string"), insee).alias("hashed_id"),
    )


@query("SELECT page_id, nullif(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\\.)?([a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1), '') AS domain FROM pages")
def domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.domain("url").alias("domain"))


@query("""
    WITH n AS (SELECT DISTINCT p_type, p_name FROM part)
    SELECT a.p_type, a.p_name AS name_a, b.p_name AS name_b, levenshtein(a.p_name, b.p_name) AS distance
    FROM n a JOIN n b ON a.p_type = b.p_type AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 6
""")
def fuzzy_block(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    pairs = n.withColumnRenamed("p_name", "name_a").join(n.withColumnRenamed("p_name", "name_b"), "p_type").filter("name_a < name_b")
    return pairs.withColumn("distance", F.levenshtein("name_a", "name_b").cast("long")).filter("distance <= 6")


@query()
def fuzzy_scores(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    pairs = n.withColumnRenamed("p_name", "name_a").join(n.withColumnRenamed("p_name", "name_b"), "p_type").filter("name_a < name_b")
    return pairs.withColumn("ratio", fuzzy.ratio_udf("name_a", "name_b")).withColumn("weighted", fuzzy.weighted_ratio_udf("name_a", "name_b")).filter("weighted >= 76")
