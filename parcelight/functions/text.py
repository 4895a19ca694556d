"""Text and address scalars as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and their base letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _accents()


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """Null as the empty string."""
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def strip_accents(c) -> Column:
    return F.regexp_replace(F.translate(as_column(c), _MARKED, _PLAIN), r"\p{Mn}+", "")


def normalize_text(c) -> Column:
    """Upper case without accents, everything but A-Z and 0-9 as single spaces, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(blank(c))), "[^A-Z0-9]+", " "))


def street_number(c) -> Column:
    """The first run of up to five digits."""
    return F.regexp_extract(normalize_text(c), r"(\d{1,5})", 1)


def street_numbers(c) -> Column:
    """All runs of up to five digits, distinct and sorted (a longer run splits)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(normalize_text(c), F.lit(r"(\d{1,5})"), 1)))


def repetition_index(c) -> Column:
    v = normalize_text(c)
    return F.when(v.isin("B", "BIS"), "BIS").when(v.isin("T", "TER"), "TER").when(v.isin("Q", "QUATER"), "QUATER").otherwise(v)


def repetition_index_for_match(c) -> Column:
    v = repetition_index(c)
    return F.when(v.isin("BIS", "TER", "QUATER"), v).otherwise("")


#: Street types by abbreviation.
STREET_TYPES = {
    "AV": "AVENUE",
    "AVE": "AVENUE",
    "BD": "BOULEVARD",
    "BLVD": "BOULEVARD",
    "RTE": "ROUTE",
    "CHE": "CHEMIN",
    "ALL": "ALLEE",
    "PL": "PLACE",
    "FG": "FAUBOURG",
    "IMP": "IMPASSE",
}


def street_type(c) -> Column:
    v = normalize_text(c)
    known = F.create_map(*[F.lit(x) for pair in STREET_TYPES.items() for x in pair])
    return F.coalesce(known[v], v)


def postcode(c) -> Column:
    return F.regexp_extract(normalize_text(c), r"(\d{5})", 1)


def join_parts(*parts, sep: str = " ") -> Column:
    """The parts that aren't blank, joined."""
    return F.concat_ws(sep, *[F.nullif(F.trim(blank(p)), F.lit("")) for p in parts])


def address_parts(number, index, kind, street, commune, code) -> Column:
    """A struct of the seven normalised fields of an address."""
    n, i, k, s, m, p = street_number(number), repetition_index(index), street_type(kind), normalize_text(street), normalize_text(commune), postcode(code)
    line = join_parts(join_parts(n, i, k, s), join_parts(p, m), sep=", ")
    return F.struct(
        n.alias("numero_norm"), i.alias("indice_norm"), k.alias("type_voie_norm"), s.alias("voie_norm"), m.alias("commune_norm"), p.alias("code_postal_norm"), line.alias("address_norm")
    )


def parcel_number(c) -> Column:
    """Digits only, the last four, padded with zeros; null where there are none."""
    digits = F.regexp_replace(blank(c), r"\D", "")
    return F.when(digits != "", F.lpad(F.right(digits, F.lit(4)), 4, "0"))


def parcel_number_for_import(c) -> Column:
    """As parcel_number, but a text without digits stays as it is."""
    return F.coalesce(parcel_number(c), F.nullif(F.trim(blank(c)), F.lit("")))


def activity_division(c) -> Column:
    """The first two characters of an activity code if they are digits, else null."""
    return F.nullif(F.regexp_extract(F.trim(blank(c)), r"^(\d{2})", 1), F.lit(""))


def department(commune) -> Column:
    """The department of a commune code; overseas ones have three characters."""
    code = F.trim(blank(commune))
    return F.when(F.length(code) < 2, None).when(F.left(code, F.lit(2)).isin("97", "98"), F.left(code, F.lit(3))).otherwise(F.left(code, F.lit(2)))


def loose_int(c) -> Column:
    """An integer written with spaces or a decimal comma; null if it is none."""
    plain = F.replace(F.regexp_replace(blank(c), r"[\s\x{A0}]", ""), F.lit(","), F.lit("."))
    return F.floor(plain.try_cast("double")).cast("int")


def year_month(c) -> Column:
    """yyyy-mm from yyyy-mm-dd or yyyy-mm, else null."""
    text = F.trim(blank(c))
    return F.when(text.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.left(text, F.lit(7)))


def address_key(c) -> Column:
    """Lower case, no accents, single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(blank(c))), r"\s+", " "))


def site_id(commune, year, label) -> Column:
    return F.concat_ws(":", blank(commune), blank(year), address_key(label))


def domain(url) -> Column:
    """The host of a web address without scheme, www, port and path; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(blank(url))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)", 1)
    return F.nullif(host, F.lit(""))


def siren(c) -> Column:
    """Nine digits of a company or the first nine of its establishment's fourteen; null for anything else."""
    digits = F.regexp_replace(blank(c), r"\s", "")
    return F.when(digits.rlike(r"^\d{9}$"), digits).when(digits.rlike(r"^\d{14}$"), F.left(digits, F.lit(9)))


def parcel_id(insee, section, number) -> Column:
    return F.concat_ws(":", F.lit("parcelle"), insee, section, number)


def building_id(kind, number) -> Column:
    return F.concat_ws(":", F.lit("building"), kind, number)


def hashed_id(*parts) -> Column:
    """The first 15 hexadecimal digits of a SHA-256 over the parts, as a number."""
    return F.conv(F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(15)), 16, 10).cast("long")


def once(value, use) -> Column:
    """use(value), with the value worked out once per row: a plain Column is worked out again wherever it is named, in a lambda
    for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def round_half_up(c, digits: int = 0) -> Column:
    """floor(x + 0.5) at the given digit: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(as_column(c) * scale + 0.5).cast("double") / scale


def safe_number(c) -> Column:
    """A double; text that is none and infinities give null, NaN stays."""
    x = as_column(c).try_cast("double")
    return F.when((x == float("inf")) | (x == float("-inf")), None).otherwise(x)
