"""Fuzzy match of parcel addresses to establishments, blocked by commune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio_udf, weighted_ratio_udf
from ..functions.text import blank
from .filters import establishment_bucket
from .ranking import best_per_key, top_per_group

LEAST_SCORE, FUZZY_STREET, FUZZY_NUMBER = 52.0, 76.0, 88.0
CANDIDATE_STREET, STREETS, ENOUGH, MOST = 80.0, 40, 50, 220
#: What an establishment's score depends on.
ADDRESS = ("code_insee", "voie_db", "numero", "indice", "commune", "cp")


def bare_number(c) -> Column:
    """Without leading zeros; all zeros are '0'."""
    bare = F.regexp_replace(c, "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def number_tier(numbers, number, best_ratio) -> Column:
    """How an establishment's number matches those of the query."""
    same = F.exists(numbers, lambda n: bare_number(n) == bare_number(number))
    return (
        F.when(F.size(numbers) == 0, "numero_absent_source")
        .when(blank(number) == "", "numero_absent_etab")
        .when(F.array_contains(numbers, number), "numero_match")
        .when(same, "numero_leading_zeros")
        .when(best_ratio >= FUZZY_NUMBER, "numero_fuzzy")
        .otherwise("numero_mismatch")
    )


def address_score(tier, voie_q, voie_db, street_ratio, index_q, index_db, commune_q, commune_db, cp_q, cp_db) -> Column:
    """A struct (score, reason), the score within 0 and 100."""
    v, d = blank(voie_q), blank(voie_db)
    both = (v != "") & (d != "")
    part = F.contains(d, v) | F.contains(v, d)
    street = (
        F.when(~both, 0.0)
        .when(v == d, 40.0)
        .when(part, 28.0)
        .when(street_ratio >= FUZZY_STREET, F.least(F.lit(30.0), 16.0 + (street_ratio - FUZZY_STREET) * 0.38))
        .otherwise(0.0)
    )
    street_reason = F.when(~both, None).when(v == d, "voie_exacte").when(part, "voie_partielle").when(street_ratio >= FUZZY_STREET, F.concat(F.lit("voie_fuzzy_"), F.floor(street_ratio).cast("string")))
    points = F.when(tier == "numero_match", 32.0).when(tier == "numero_leading_zeros", 28.0).when(tier == "numero_fuzzy", 26.0).when(tier == "numero_mismatch", -12.0).otherwise(0.0)
    number_reason = F.when(tier.startswith("numero_absent"), None).otherwise(tier)
    indexed = (blank(index_q) != "") & (blank(index_db) != "")
    index = F.when(~indexed, 0.0).when(index_q == index_db, 5.0).otherwise(-8.0)
    index_reason = F.when(indexed, F.when(index_q == index_db, "indice_match").otherwise("indice_mismatch"))
    commune = (blank(commune_q) != "") & (blank(commune_q) == blank(commune_db))
    cp = (blank(cp_q) != "") & (blank(cp_q) == blank(cp_db))
    score = street + points + index + F.when(commune, 14.0).otherwise(0.0) + F.when(cp, 4.0).otherwise(0.0)
    reason = F.concat_ws(", ", street_reason, number_reason, index_reason, F.when(commune, "commune_exacte"), F.when(cp, "cp_exact"))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), reason.alias("reason"))


def candidate_streets(queries: DataFrame, establishments: DataFrame, enough: int | None = None, most: int | None = None) -> DataFrame:
    """(code_insee, voie_q, voie_db, wr, street_ratio, n): a query's exact street, else all streets that contain one another, and
    all other streets of a high fuzzy ratio; scored once per distinct pair of streets of a commune, n is the street's
    establishments. The reference looks for others only where there are fewer than `enough` and takes `most` of them."""
    q = queries.select("code_insee", F.col("voie").alias("voie_q")).distinct()
    streets = establishments.filter(blank("voie") != "").groupBy("code_insee", F.col("voie").alias("voie_db")).agg(F.count(F.lit(1)).alias("n"))
    pairs = q.join(streets, "code_insee")
    exact, part = F.col("voie_q") == F.col("voie_db"), F.contains("voie_db", F.col("voie_q")) | F.contains("voie_q", F.col("voie_db"))
    graded = pairs.withColumn("kind", F.when(exact, 0).when(part, 1).otherwise(2))
    by_query = W.partitionBy("code_insee", "voie_q")
    first = F.min("kind").over(by_query)
    direct = F.when(F.col("kind") == F.least(first, F.lit(1)), F.col("n")).otherwise(0)
    graded = graded.withColumn("first", first).withColumn("found", F.sum(direct).over(by_query))
    plain = (F.col("kind") < 2) & (F.col("kind") == F.col("first"))
    few = F.lit(True) if enough is None else F.col("found") < enough
    near = graded.filter(~plain & few).withColumn("wr", weighted_ratio_udf("voie_q", "voie_db")).filter(F.col("wr") >= CANDIDATE_STREET)
    if most is not None:
        near = top_per_group(near, ["code_insee", "voie_q"], [F.desc("wr"), F.asc("voie_db")], most, "_s").drop("_s")
    direct = graded.filter(plain).withColumn("wr", F.when(F.col("kind") == 0, 100.0).otherwise(90.0))
    direct = direct.withColumn("street_ratio", F.when(F.col("kind") == 0, 100.0).otherwise(weighted_ratio_udf("voie_q", "voie_db")))
    near = near.withColumn("street_ratio", F.col("wr"))
    return direct.unionByName(near).select("code_insee", "voie_q", "voie_db", "wr", "street_ratio", "n")


def street_candidates(queries: DataFrame, establishments: DataFrame) -> DataFrame:
    """(query_id, siret) candidates as the reference lists them, MOST at most; `matches_by_query` takes all."""
    chosen = candidate_streets(queries, establishments, ENOUGH, STREETS)
    by_query = W.partitionBy("code_insee", "voie_q")
    # Nor are those of streets that come after MOST establishments of better ones.
    better = F.sum("n").over(by_query.orderBy(F.desc("wr")).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n").over(W.partitionBy("code_insee", "voie_q", "wr"))
    chosen = chosen.withColumn("_better", better).filter(F.col("_better") < MOST).drop("_better", "n")
    # A street's establishments are equally good candidates, so those beyond its first MOST are none of any query's.
    first = top_per_group(establishments, ["code_insee", "voie"], [F.asc("siret")], MOST, "_e").drop("_e")
    rows = queries.withColumnRenamed("voie", "voie_q").join(chosen, ["code_insee", "voie_q"]).join(first.withColumnRenamed("voie", "voie_db"), ["code_insee", "voie_db"])
    return top_per_group(rows, ["query_id"], [F.desc("wr"), F.asc("siret")], MOST, "_r").drop("_r")


#: The reason of a status without a match.
REASONS = {
    "no_address": "Aucune adresse passerelle.",
    "no_address_tokens": "Adresse passerelle non exploitable.",
    "no_passerelle_numero": "Pas de numéro de voirie côté passerelle : matching SIRENE désactivé.",
    "no_candidate": "Aucun établissement actif avec numéro de voirie sur cette voie.",
    "low_confidence": "Candidats trouvés mais score insuffisant.",
    "source_missing": "Table établissements absente.",
}


def technical_status(queries: DataFrame, tried: Column, n: Column, missing: bool) -> Column:
    """Why a query has its result: no source, no address, no street in it, no number, no candidate, none good enough, or some."""
    address = F.col("address") if "address" in queries.columns else F.lit("given")
    return (
        F.when(F.lit(missing), "source_missing")
        .when(F.trim(blank(address)) == "", "no_address")
        .when(blank("voie") == "", "no_address_tokens")
        .when(F.coalesce(F.size("numbers"), F.lit(0)) <= 0, "no_passerelle_numero")
        .when(n > 0, "matched")
        .when(tried, "low_confidence")
        .otherwise("no_candidate")
    )


def matches_by_query(queries: DataFrame, establishments: DataFrame, least: float) -> DataFrame:
    """query_id, _k (the establishments of the least score, best first) and sirens, for each query with any candidate. A query
    meets each different address of its candidate streets once; the establishments of an address come in where it counts."""
    asked = queries.filter((blank("voie") != "") & (F.size("numbers") > 0))
    asked = asked.filter(F.trim(blank("address")) != "").drop("address") if "address" in queries.columns else asked
    asked = asked.withColumnRenamed("voie", "voie_q")
    known = establishments.filter((F.trim(blank("numero")) != "") & (blank("voie") != "")).withColumnRenamed("voie", "voie_db")
    streets = candidate_streets(asked.withColumnRenamed("voie_q", "voie"), known.withColumnRenamed("voie_db", "voie")).drop("wr", "n")
    addresses = known.select(*ADDRESS).distinct()
    rows = asked.join(streets, ["code_insee", "voie_q"]).join(addresses, ["code_insee", "voie_db"])
    numbers = asked.select("code_insee", "numbers").distinct().join(known.select("code_insee", "numero").distinct(), "code_insee").select("numbers", "numero").distinct()
    numbers = numbers.select("numbers", "numero", F.explode("numbers").alias("asked")).withColumn("r", ratio_udf("numero", "asked"))
    scored = rows.join(numbers.groupBy("numbers", "numero").agg(F.max("r").alias("best_ratio")), ["numbers", "numero"], "left")
    tier = number_tier(F.col("numbers"), F.col("numero"), F.coalesce("best_ratio", F.lit(0.0)))
    score = address_score(tier, F.col("voie_q"), F.col("voie_db"), F.col("street_ratio"), F.col("indice_q"), F.col("indice"), F.col("commune_q"), F.col("commune"), F.col("cp_q"), F.col("cp"))
    scored = scored.select("query_id", *[F.col(c).alias("_" + c) for c in ADDRESS], score.alias("_s"))
    good = F.col("_s.score") >= least
    same = [F.col("_" + c).eqNullSafe(F.col(c)) if c in ("indice", "commune", "cp") else F.col("_" + c) == F.col(c) for c in ADDRESS]
    found = scored.filter(good).join(known, same).select("query_id", "siret", "siren", "_s")
    once = best_per_key(found, ["query_id", "siret"], [F.desc("_s.score"), F.asc("_s.reason"), F.asc("siren")])
    entry = F.struct((-F.col("_s.score")).alias("minus"), "siret", "siren", F.col("_s.reason").alias("reason"))
    # Queries with lower scores only are tried: they had a candidate.
    tried = scored.groupBy("query_id").agg(F.max("_s.score").alias("_best")).filter(F.col("_best") < least).select("query_id", F.lit(None).alias("_entry"))
    entries = once.select("query_id", entry.alias("_entry")).unionByName(tried)
    return entries.groupBy("query_id").agg(F.array_sort(F.collect_list("_entry")).alias("_k"), F.array_sort(F.collect_set("_entry.siren")).alias("sirens"))


def match_establishments(queries: DataFrame, establishments: DataFrame | None, least: float = LEAST_SCORE) -> DataFrame:
    """A row per query: status, bucket, confidence, reason and the matched establishments by score.

    queries: query_id, code_insee, numbers (array), indice_q, voie, commune_q, cp_q and, if there is one, the raw address;
    establishments (None where the source is missing): code_insee, siret, siren, numero, indice, voie, commune, cp. Distinct
    addresses are best matched once and joined back.
    """
    none = lambda kind: F.lit(None).cast(kind)
    if establishments is None:
        joined = queries.withColumns({"_k": none("array<struct<minus:double,siret:string,siren:string,reason:string>>"), "sirens": none("array<string>"), "_tried": F.lit(False)})
    else:
        found = matches_by_query(queries, establishments, least).withColumn("_tried", F.lit(True))
        joined = queries.join(found, "query_id", "left").withColumn("_tried", F.coalesce("_tried", F.lit(False)))
    n = F.greatest(F.coalesce(F.size("_k"), F.lit(0)), F.lit(0))
    told = joined.withColumn("status_technique", technical_status(queries, F.col("_tried"), n, establishments is None))
    fixed = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    some = lambda c: F.when(n > 0, c)
    return told.select(
        "query_id",
        "status_technique",
        establishment_bucket(n).alias("status_metier"),
        n.cast("long").alias("siret_count"),
        F.coalesce(-F.get("_k", F.lit(0))["minus"], F.lit(0.0)).alias("matching_confidence"),
        F.coalesce(F.get("_k", F.lit(0))["reason"], F.try_element_at(fixed, F.col("status_technique")), F.lit("")).alias("matching_reason"),
        some(F.transform("_k", lambda k: k["siret"])).alias("sirets"),
        some(F.col("sirens")).alias("sirens"),
    )
