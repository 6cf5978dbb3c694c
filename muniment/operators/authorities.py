"""Records of open authorities, each in its own shape with a source-distinct address, and the statements of
the people they describe as triples. JSON is read once by a schema; all else is Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What each source is called, where its records lie, its licence and whom to name.
SOURCES = {
    "wikidata": ("https://www.wikidata.org/entity/", "CC0-1.0", "Wikidata contributors"),
    "factgrid": ("https://database.factgrid.de/entity/", "CC0-1.0", "FactGrid contributors"),
    "gnd": ("https://d-nb.info/gnd/", "CC0-1.0", "Deutsche Nationalbibliothek (GND)"),
    "pleiades": ("https://pleiades.stoa.org/places/", "CC-BY-3.0", "Pleiades contributors"),
}
ANCIENT = "Pleiades is an ancient-world gazetteer; a candidate link may remain unresolved for a medieval place."

_SNAK = "struct<datavalue:struct<value:string>>"
_ENTITY = (
    f"id string, lastrevid long, labels map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, claims map<string,array<struct<mainsnak:{_SNAK},rank:string,"
    f"qualifiers:map<string,array<{_SNAK}>>,`references`:array<struct<snaks:map<string,array<{_SNAK}>>>>>>>"
)
_PERIODS = "timePeriods:array<string>,provenance:string"


def _named(source: str) -> list[Column]:
    return [F.lit(SOURCES[source][1]).alias("licence"), F.lit(SOURCES[source][2]).alias("attribution")]


def _at(source: str, key: Column) -> list[Column]:
    return [F.lit(source).alias("source"), key.alias("source_id"), F.concat(F.lit(SOURCES[source][0]), key).alias("source_uri")]


def value_of(snak: Column) -> Column:
    """What a snak says: an item's id, a time, or the plain value; null for none."""
    v = snak["datavalue"]["value"]
    return F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.id"), F.get_json_object(v, "$.time"), v)).otherwise(v)


def precision_of(snak: Column) -> Column:
    return F.get_json_object(snak["datavalue"]["value"], "$.precision").cast("int")


def statements_of(claims: Column) -> Column:
    """array<struct<property, value, precision, rank, qualifiers, references>>, by property."""
    said = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast(f"map<string,array<{_SNAK}>>")), lambda _, v: F.transform(v, value_of))

    def one(p: Column):
        return lambda c: F.struct(
            p.alias("property"), value_of(c["mainsnak"]).alias("value"), precision_of(c["mainsnak"]).alias("precision"), F.coalesce(c["rank"], F.lit("normal")).alias("rank"),
            said(c["qualifiers"]).alias("qualifiers"), F.transform(F.coalesce(c["references"], F.array()), lambda r: said(r["snaks"])).alias("references"),
        )

    keys = F.array_sort(F.map_keys(F.coalesce(claims, F.create_map().cast(f"map<string,array<struct<mainsnak:{_SNAK},rank:string,qualifiers:map<string,array<{_SNAK}>>,`references`:array<struct<snaks:map<string,array<{_SNAK}>>>>>>>"))))
    return F.flatten(F.transform(keys, lambda p: F.transform(F.element_at(claims, p), one(p))))


def wikibase(rows: DataFrame, source: str = "wikidata", column: str = "json") -> DataFrame:
    """Records of Wikibase entities, of Wikidata or FactGrid: the same item of both has two addresses."""
    r = rows.select(F.from_json(column, _ENTITY).alias("r")).where("r.id IS NOT NULL").select("r.*")
    return r.select(
        *_at(source, F.col("id")), F.col("lastrevid").alias("revision"), F.transform_values("labels", lambda _, v: v["value"]).alias("labels"),
        F.transform_values("aliases", lambda _, v: F.transform(v, lambda x: x["value"])).alias("aliases"), statements_of(F.col("claims")).alias("statements"), *_named(source),
    )


def gnd(rows: DataFrame, column: str = "json") -> DataFrame:
    schema = "id string, preferred_name string, variant_names array<string>, dates map<string,string>, professions array<string>, record_version string"
    r = rows.select(F.from_json(column, schema).alias("r")).where("r.id IS NOT NULL").select("r.*")
    none = F.array().cast("array<string>")
    return r.select(
        *_at("gnd", F.col("id")), "preferred_name", F.array_sort(F.array_distinct(F.coalesce("variant_names", none))).alias("variant_names"), "dates",
        F.coalesce("professions", none).alias("professions"), "record_version", *_named("gnd"),
    )


def pleiades(rows: DataFrame, column: str = "json") -> DataFrame:
    """Places: names in the attested form, else the romanised one; geometries as JSON."""
    schema = (
        f"id string, title string, names array<struct<attested:string,romanized:string,language:string,{_PERIODS}>>, "
        f"locations array<struct<geometry:string,{_PERIODS}>>, connections array<string>"
    )
    r = rows.select(F.from_json(column, schema).alias("r")).where("r.id IS NOT NULL").select("r.*")
    periods = lambda x: F.coalesce(x["timePeriods"], F.array().cast("array<string>")).alias("time_periods")
    written = lambda x: F.coalesce(F.nullif(x["attested"], F.lit("")), x["romanized"]).alias("name")
    return r.select(
        *_at("pleiades", F.element_at(F.split("id", "/"), -1)), "title",
        F.transform("names", lambda x: F.struct(written(x), x["language"].alias("language"), periods(x), x["provenance"].alias("provenance"))).alias("names"),
        F.transform("locations", lambda x: F.struct(x["geometry"].alias("geometry"), periods(x), x["provenance"].alias("provenance"))).alias("locations"),
        F.coalesce("connections", F.array().cast("array<string>")).alias("connections"), F.lit(ANCIENT).alias("medieval_scope_warning"), *_named("pleiades"),
    )


def attribution(records: DataFrame) -> DataFrame:
    """What must be shown with each record."""
    return records.select("source", "source_uri", "licence", "attribution")


# -- people as CIDOC triples --------------------------------------------------------------------------

VOCABULARY = {"Gender_Male": "Male", "Gender_Female": "Female", "Type_Floruit": "Floruit", "Type_MaritalGroup": "Marital group", "Type_AuthorityID": "Authority ID"}


def vocabulary(spark) -> DataFrame:
    """(s, p, o, o_kind) of the controlled terms."""
    rows = [t for k, v in VOCABULARY.items() for t in ((k, "rdf:type", "crm:E55_Type", "iri"), (k, "rdfs:label", v, "literal"))]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string")


def cidoc(people: DataFrame) -> DataFrame:
    """(s, p, o, o_kind) of people (id, label, variants, norms, qid, authority_id, gender, birth, death, floruit, parents,
    spouses, sources): persons, births, deaths and time-spans, identifiers, and a marital group of each couple
    that both of its people join. Null or empty fields give no triple. Distinct triples."""
    me, part = T.entity_uri(F.col("id")), T.local_name(F.col("id"))
    node = lambda kind, *of: F.concat(F.lit(f"{kind}_"), *(of or (part,)))
    born, died, lived = (T.year_signed(F.col(c)) for c in ("birth", "death", "floruit"))
    # A reference to another person is an authority id, or that of an external item.
    other = lambda c: F.when(c.startswith("AUTH"), c).otherwise(F.concat(F.lit("WIKIDATA:"), F.regexp_replace(c, "^WIKIDATA:", "")))
    no_rows = F.array().cast("array<struct<s:string,p:string,o:string,o_kind:string>>")

    def one(p: str, o: Column, kind: str = "literal", s: Column = me, when: Column | None = None) -> Column:
        row = F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))
        return F.array(row) if when is None else F.when(when, F.array(row)).otherwise(no_rows)

    def each(p: str, column: str, kind: str = "literal", to=lambda v: v) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.struct(me.alias("s"), F.lit(p).alias("p"), to(v).alias("o"), F.lit(kind).alias("o_kind")))

    def event(kind: str, cls: str, link: str, back: str, year: Column) -> list[Column]:
        has, span = year.isNotNull(), node(f"TS_{kind}")
        return [
            one(link, node(kind), "iri", when=has), one("rdf:type", F.lit(cls), "iri", node(kind), has), one(back, me, "iri", node(kind), has), one("crm:P4_has_time-span", span, "iri", node(kind), has),
            one("rdf:type", F.lit("crm:E52_Time-Span"), "iri", span, has), one("crm:P82a_begin_of_the_begin", year, "year", span, has), one("crm:P82b_end_of_the_end", year, "year", span, has),
        ]

    def couple(v: Column) -> Column:
        pair = F.array_sort(F.array(F.col("id"), other(v)))
        group, joining = F.concat(F.lit("FamilyGroup_"), T.local_name(F.array_join(pair, "_"))), F.concat(F.lit("Joining_"), T.local_name(F.array_join(pair, "_")), F.lit("_"), part)
        rows = [(group, "rdf:type", F.lit("crm:E74_Group")), (group, "crm:P2_has_type", F.lit("Type_MaritalGroup")), (joining, "rdf:type", F.lit("crm:E85_Joining")), (joining, "crm:P143_joined", me), (joining, "crm:P144_joined_with", group)]
        return F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind")) for s, p, o in rows])

    gender = F.when(F.col("gender").isin("m", "male"), "Gender_Male").when(F.col("gender").isin("f", "female"), "Gender_Female")
    key, has_key, lives = node("ID", T.local_name(F.col("authority_id"))), F.col("authority_id").isNotNull(), lived.isNotNull()
    items = F.concat(
        one("rdf:type", F.lit("crm:E21_Person"), "iri"), one("rdfs:label", F.nullif(F.col("label"), F.lit(""))), F.filter(each("skos:altLabel", "variants"), lambda t: ~t["o"].eqNullSafe(F.col("label"))),
        each("skos:hiddenLabel", "norms"), one("owl:sameAs", F.concat(F.lit("wd:"), F.col("qid")), "iri"), one("crm:P2_has_type", gender, "iri"),
        *event("Birth", "crm:E67_Birth", "crm:P98i_was_born", "crm:P98_brought_into_life", born), *event("Death", "crm:E69_Death", "crm:P100i_died_in", "crm:P100_was_death_of", died),
        one("crm:P4_has_time-span", node("Floruit"), "iri", when=lives), one("rdf:type", F.lit("crm:E52_Time-Span"), "iri", node("Floruit"), lives),
        one("crm:P2_has_type", F.lit("Type_Floruit"), "iri", node("Floruit"), lives), one("crm:P82a_begin_of_the_begin", lived, "year", node("Floruit"), lives),
        one("crm:P1_is_identified_by", key, "iri", when=has_key), one("rdf:type", F.lit("crm:E42_Identifier"), "iri", key, has_key), one("rdf:value", F.col("authority_id"), "literal", key, has_key),
        one("crm:P2_has_type", F.lit("Type_AuthorityID"), "iri", key, has_key), each("crm:P152_has_parent", "parents", "iri", lambda v: T.entity_uri(other(v))),
        each("crm:P70i_is_documented_in", "sources"), F.flatten(F.transform(F.coalesce("spouses", F.array().cast("array<string>")), couple)),
    )
    return people.select(F.explode(items).alias("t")).where("t.o IS NOT NULL AND t.o <> ''").select("t.*").distinct()
