"""Records in JSON text whose fields have several names: read as VARIANT, the first name that is there counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, blank

#: A field and the names under which sources give it, in order.
SIRET_FIELDS = {
    "tranche_effectifs": ("tranche_effectifs", "tranche_effectif_salarie", "tranche_effectif"),
    "annee_effectifs": ("annee_effectifs", "annee_tranche_effectif_salarie", "annee_tranche_effectif"),
    "activite_principale": ("activite_principale", "naf", "code_naf", "ape"),
}
#: Codes of workforce bands and their labels.
WORKFORCE = {
    "NN": "Non renseigné", "00": "0 salarié", "01": "1 ou 2", "02": "3 à 5", "03": "6 à 9", "04": "10 à 19", "05": "20 à 49", "06": "50 à 99",
    "07": "100 à 199", "08": "200 à 249", "09": "250 à 499", "10": "500 à 999", "11": "1 000 à 1 999", "12": "2 000 à 4 999",
    "13": "5 000 à 9 999", "53": "10 000 et plus",
}


def value(record: Column, *names: str, kind: str = "string") -> Column:
    """The first of the named fields of a VARIANT that is there and isn't null."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{n}", kind) for n in names])


def records(raw) -> Column:
    """The objects of a JSON array as VARIANTs: empty for text that isn't one."""
    found = F.try_variant_get(F.try_parse_json(as_column(raw)), "$", "array<variant>")
    objects = F.filter(found, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    return F.coalesce(objects, F.array().cast("array<variant>"))


def matched_sirets(raw) -> Column:
    """Structs of the matched establishments in a JSON array; entries without a siret are left out."""
    text = lambda v, *names: F.nullif(F.trim(value(v, *names)), F.lit(""))

    def entry(v: Column) -> Column:
        score = text(v, "score").try_cast("double")
        return F.struct(
            text(v, "siret").alias("siret"),
            text(v, "siren").alias("siren"),
            value(v, "denomination").alias("denomination"),
            value(v, "adresse_etablissement").alias("adresse_etablissement"),
            *[value(v, *names).alias(field) for field, names in SIRET_FIELDS.items()],
            F.when(~F.isnan(score) & (F.abs(score) != float("inf")), score).alias("score"),
            text(v, "reason").alias("reason"),
        )

    return F.filter(F.transform(records(raw), entry), lambda e: e["siret"].isNotNull())


def workforce_label(code) -> Column:
    """The label of a band of employees; an unknown code stands for itself, none for a dash."""
    plain = F.upper(F.trim(blank(code)))
    labels = F.create_map(*[F.lit(x) for pair in WORKFORCE.items() for x in pair])
    return F.when(plain == "", "—").otherwise(F.coalesce(F.try_element_at(labels, plain), plain))
