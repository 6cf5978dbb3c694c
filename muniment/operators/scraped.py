"""Records of people from the paragraphs and fields of scraped pages, in one shape for the person graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# How kin, titles and sources are written, and what a record without any is given.
KIN = {"brother": "brothers?", "sister": "sisters?", "father": "fathers?", "mother": "mothers?", "son": "sons?", "daughter": "daughters?", "spouse": "(?:wifes?|husbands?)", "uncle": "uncles?"}
REALMS = ("King", "Queen", "Count", "Countess", "Prince", "Princess", "Emperor", "Empress", "Lord", "Lady")
CHRONICLES = (
    "RHC Hist. Occ.", "William of Tyre", "Fulcher of Chartres", "Albert of Aachen", "Orderic Vitalis", "Robert the Monk", "Guibert of Nogent",
    "Baldric of Dol", "Raymond d'Aguilers", "Peter Tudebode", "Ibn al-Athīr", "Usāma ibn Munqidh", "Cartulaire général", "Delaville Le Roulx",
)
SHORT_CHRONICLES = ("RHC Hist. Occ.", "William of Tyre", "Fulcher of Chartres", "Albert of Aachen", "Orderic Vitalis", "Robert the Monk", "Raymond d'Aguilers")
UNCITED = "MedLands"


def family(text: Column) -> Column:
    """array<struct<type, name, description>> of "brother: Name (who)" statements, kinds in order."""
    def tagged(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x["n"]).alias("name"), F.nullif(F.trim(x["d"]), F.lit("")).alias("description"))

    found = []
    for kind, word in KIN.items():
        pattern = rf"(?i){word}:\s*([^,(]+)(?:\s*\(([^)]+)\))?"
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("d"))
        found.append(F.transform(pairs, tagged(kind)))
    return F.filter(F.concat(*found), lambda r: r["name"] != "")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def name(text: Column) -> Column:
    """The bold words of a paragraph, else what stands before its first comma, dates or bracket."""
    return F.coalesce(_first(text, r"\*\*([^*]+)\*\*"), _first(text, r"(?i)^([A-Z][^,]+?)(?:,|\s+fl\.|\s+\(|$)"))


def floruit(text: Column) -> Column:
    """Years active, else ?-death, else birth-?."""
    span = r"(?i)(?:fl\.|flourished)\s*(\d{4})(?:[-–](\d{4}))?"
    start, end = _first(text, span), _first(text, span, 2)
    return F.coalesce(
        F.when(end.isNull() | (end == start), start).otherwise(F.concat(start, F.lit("-"), end)),
        F.concat(F.lit("?-"), _first(text, r"(?i)(?:died|d\.)\s*(\d{4})")), F.concat(_first(text, r"(?i)(?:born|b\.)\s*(\d{4})"), F.lit("-?")),
    )


def title(text: Column, region: Column) -> Column:
    """The first title in the order of REALMS with its place, else a noble of the region."""
    held = [F.concat(F.lit(f"{t} of "), F.initcap(_first(text, rf"(?iU){t}\s+of\s+(\w+(?:\s+\w+)?)"))) for t in REALMS]
    return F.coalesce(*held, F.concat(F.lit("Noble of "), region))


def cited(text: Column, chronicles: tuple[str, ...] = CHRONICLES) -> Column:
    """The chronicles that a text names, in order, else UNCITED."""
    hits = [F.when(text.rlike("(?iu)" + r"\s+".join(re.escape(w) for w in c.split())), F.lit(c)) for c in chronicles]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNCITED)))


def genealogy_records(rows: DataFrame) -> DataFrame:
    """Records of scraped people (pos, name, floruit, title, relations, sources, url, region) as (id, label, birth, death,
    floruit, roles, relations, sources, source_url, region, needs_review). Version notes, headings and names
    under three letters are no people; positions number the ids."""
    label, low = F.trim("name"), F.lower("name")
    noise = label.startswith("v5.") | F.col("name").contains("Updated") | low.contains("leaders of") | (F.length(label) < 3) | low.contains("chapter") | low.contains("section")
    years = F.split("floruit", "-")
    known = lambda i: F.when(F.col("floruit").contains("-"), F.nullif(F.nullif(F.get(years, F.lit(i)), F.lit("")), F.lit("?")))
    clean = lambda r: F.trim(F.regexp_replace(F.trim(F.get(F.split(r["name"], r"\("), F.lit(0))), "&+$", ""))
    kin = F.filter(F.transform("relations", lambda r: F.struct(r["type"].alias("type"), clean(r).alias("name"))), lambda r: F.length(r["name"]) > 2)
    return rows.where(~F.coalesce(noise, F.lit(True))).select(
        F.format_string("FMG:%04d", "pos").alias("id"), label.alias("label"), known(0).alias("birth"), known(1).alias("death"), "floruit",
        F.array_compact(F.array(F.nullif(F.col("title"), F.lit("")))).alias("roles"), F.coalesce(kin, F.array().cast("array<struct<type:string,name:string>>")).alias("relations"),
        F.coalesce("sources", F.array(F.lit(UNCITED))).alias("sources"), F.coalesce("url", F.lit("")).alias("source_url"), F.coalesce("region", F.lit("")).alias("region"), F.lit(True).alias("needs_review"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Records of person pages (source_id, source_url, fields, crusades): names in parts with their variants, roles, places,
    expeditions, citations, and whether one participation is certain. fields: map of labels to values; crusades:
    array of such maps."""
    f = lambda k: F.nullif(F.col("fields")[k], F.lit(""))
    full = F.coalesce(F.col("fields")["name"], F.lit("Unknown"))
    shape = r"^([A-Z][a-z]+)(?:\s+([^o]+))?\s+of\s+(.+)$"
    of_place = full.rlike(shape)
    given = F.when(of_place, _first(full, shape)).otherwise(F.nullif(F.get(F.split(F.trim(full), r"\s+"), F.lit(0)), F.lit("")))
    descriptor, toponym = F.when(of_place, _first(full, shape, 2)), F.when(of_place, _first(full, shape, 3))
    role = r"^([^(]+)(?:\s*\(([^)]+)\))?"
    place = lambda kind, label: F.when(label.isNotNull() & (label != ""), F.struct(F.lit(kind).alias("type"), label.alias("label")))
    trips = F.transform(
        "crusades", lambda c: F.struct(*[F.nullif(c[k], F.lit("")).alias(n) for n, k in (("name", "expedition"), ("probability", "probability_of_participation"), ("outcome", "consequences_of_expedition"), ("actions", "actions"), ("leader", "contingent_leader"), ("finance", "financial_arrangements"))])
    )
    trips = F.filter(trips, lambda t: F.coalesce(t["name"], t["probability"], t["outcome"], t["actions"], t["leader"], t["finance"]).isNotNull())
    texts = F.filter(F.transform(F.split(F.coalesce(f("sources"), F.lit("")), r"\."), lambda x: F.trim(x)), lambda s: s != "")
    return pages.select(
        F.col("source_id").alias("id"), full.alias("label"), given.alias("given"), descriptor.alias("descriptor"), toponym.alias("toponym"),
        F.array_sort(F.array_distinct(F.concat(F.array(full), T.name_variants(given, descriptor, toponym)))).alias("variants"), f("gender_and_marital_statusa").alias("gender"),
        F.when(f("role").isNotNull(), F.struct(_first(f("role"), role).alias("role"), F.coalesce(_first(f("role"), role, 2), F.lit("unknown")).alias("type"))).alias("role"),
        F.array_compact(F.array(place("origin", F.trim(F.get(F.split(f("country_and_region_of_origin"), "\n"), F.lit(0)))), place("title", f("specific_title")))).alias("places"),
        trips.alias("expeditions"), texts.alias("citations"), F.exists(F.coalesce(trips, F.array().cast("array<struct<name:string,probability:string,outcome:string,actions:string,leader:string,finance:string>>")), lambda t: t["probability"].eqNullSafe(F.lit("Certain"))).alias("participation_confirmed"),
        "source_url",
    )


def region_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("region").agg(F.count(F.lit(1)).alias("n")).orderBy("region")
