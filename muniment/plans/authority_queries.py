"""Queries over open authorities, scraped records and the triples of people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import authorities as A
from ..operators import evidence as E
from ..operators import scraped as S
from .registry import register
from .text_queries import table


def _items(spark, sf_dir):
    """A Wikibase entity a part, with a claim of an item, one of a time with a qualifier and a reference, and one without a value."""
    p = table(spark, sf_dir, "part")
    return p.select(F.format_string(
        '{"id":"Q%d","lastrevid":%d,"labels":{"en":{"language":"en","value":"%s"}},"aliases":{"en":[{"value":"%s"},{"value":"x"}]},"claims":{"P569":[{"mainsnak":{"datavalue":{"type":"time","value":{"time":"+%d-00-00T00:00:00Z","precision":9}}},"rank":"preferred",'
        '"qualifiers":{"P1480":[{"datavalue":{"value":{"id":"Q%d"}}}]},"references":[{"snaks":{"P248":[{"datavalue":{"value":{"id":"Q5"}}}],"P813":[{"datavalue":{"value":"plain"}}]}}]}],"P21":[{"mainsnak":{"datavalue":{"value":{"id":"Q%d"}}},"rank":"normal"}],"P40":[{"mainsnak":{"snaktype":"novalue"}}]}}',
        "p_partkey", (F.col("p_partkey") * 7), "p_name", "p_brand", (F.col("p_size") + 1000), "p_size", (F.col("p_partkey") % 2)).alias("json"))


@register("wikidata_records", "SELECT 'wikidata' AS source, 'Q' || p_partkey AS source_id, 'https://www.wikidata.org/entity/Q' || p_partkey AS source_uri, (p_partkey * 7)::BIGINT AS revision, p_name AS label, p_brand || ',x' AS aliases, 3 AS statements, 'CC0-1.0' AS licence, 'Wikidata contributors' AS attribution FROM part")
def wikidata_records(spark, sf_dir):
    r = A.wikibase(_items(spark, sf_dir))
    return r.select("source", "source_id", "source_uri", "revision", r.labels["en"].alias("label"), F.array_join(r.aliases["en"], ",").alias("aliases"), F.size("statements").alias("statements"), "licence", "attribution")


@register("factgrid_addresses", "SELECT source_uri FROM (SELECT 'https://www.wikidata.org/entity/Q' || p_partkey AS source_uri FROM part UNION ALL SELECT 'https://database.factgrid.de/entity/Q' || p_partkey FROM part)")
def factgrid_addresses(spark, sf_dir):
    """The same item of two sources keeps two addresses."""
    i = _items(spark, sf_dir)
    return A.wikibase(i).select("source_uri").unionByName(A.wikibase(i, "factgrid").select("source_uri"))


@register("statement_rows", """SELECT 'Q' || p_partkey AS source_id, 1 AS pos, 'P40' AS property, NULL AS value, 0 AS precision, 'normal' AS rank, NULL AS qualifier, 0 AS n_references FROM part
UNION ALL SELECT 'Q' || p_partkey, 0, 'P21', 'Q' || (p_partkey % 2), 0, 'normal', NULL, 0 FROM part UNION ALL SELECT 'Q' || p_partkey, 2, 'P569', '+' || (p_size + 1000) || '-00-00T00:00:00Z', 9, 'preferred', 'Q' || p_size, 2 FROM part""")
def statement_rows(spark, sf_dir):
    r = A.wikibase(_items(spark, sf_dir)).select("source_id", F.posexplode("statements").alias("pos", "s"))
    return r.select("source_id", "pos", "s.property", "s.value", F.coalesce("s.precision", F.lit(0)).alias("precision"), "s.rank", F.get(F.col("s.qualifiers")["P1480"], F.lit(0)).alias("qualifier"), F.coalesce(F.size(F.get("s.references", F.lit(0))), F.lit(0)).alias("n_references"))


@register("gnd_records", "SELECT 'https://d-nb.info/gnd/' || c_custkey AS source_uri, c_name AS preferred_name, 'a,b,' || c_mktsegment AS variants, (c_custkey % 900)::VARCHAR AS born, 0 AS professions FROM customer")
def gnd_records(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.format_string('{"id":"%d","preferred_name":"%s","variant_names":["b","%s","a","b"],"dates":{"birth":"%d"}}', "c_custkey", "c_name", F.concat(F.lit("z"), "c_mktsegment"), F.col("c_custkey") % 900).alias("json"))
    return A.gnd(c).select("source_uri", "preferred_name", F.replace(F.array_join("variant_names", ","), F.lit("z"), F.lit("")).alias("variants"), F.col("dates")["birth"].alias("born"), F.size("professions").alias("professions"))


@register("pleiades_places", """SELECT s_suppkey::VARCHAR AS source_id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS name, 'roman' AS period, '{"type":"Point","coordinates":[' || s_nationkey || ',1]}' AS geometry, 'CC-BY-3.0' AS licence FROM supplier""")
def pleiades_places(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.format_string(
        '{"id":"https://pleiades.stoa.org/places/%d","title":"%s","names":[{"attested":"%s","romanized":"new","language":"la","timePeriods":["roman"]}],"locations":[{"geometry":{"type":"Point","coordinates":[%d,1]}}]}',
        "s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise(""), "s_nationkey").alias("json"))
    r = A.pleiades(s)
    first = F.get("names", F.lit(0))
    return r.select("source_id", "title", first["name"].alias("name"), F.array_join(first["time_periods"], ",").alias("period"), F.get("locations", F.lit(0))["geometry"].alias("geometry"), "licence")


def _figures(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    return s.select(
        F.concat(F.lit("AUTH:"), key.cast("string")).alias("id"), F.col("s_name").alias("label"), F.array("s_name", F.upper("s_name")).alias("variants"), F.array(F.lower("s_name")).alias("norms"),
        F.when(key % 2 == 0, F.concat(F.lit("Q"), key.cast("string"))).alias("qid"), F.concat(F.lit("AUTH:"), key.cast("string")).alias("authority_id"), F.when(key % 3 == 0, "m").when(key % 3 == 1, "f").alias("gender"),
        F.when(key % 2 == 0, F.lit("c. 1099")).alias("birth"), F.lit(None).cast("string").alias("death"), F.lit("").alias("floruit"), F.when(key % 5 == 0, F.array(F.lit("Q9"))).otherwise(none).alias("parents"),
        F.array(F.concat(F.lit("AUTH:"), F.when(key % 2 == 0, key + 1).otherwise(key - 1).cast("string"))).alias("spouses"), none.alias("sources"),
    )


_U = "'https://example.org/entity/AUTH_' || s_suppkey"
_COUPLE = "(CASE WHEN s_suppkey % 2 = 0 THEN least('AUTH_' || s_suppkey, 'AUTH_' || (s_suppkey + 1)) || '_' || greatest('AUTH_' || s_suppkey, 'AUTH_' || (s_suppkey + 1)) ELSE least('AUTH_' || s_suppkey, 'AUTH_' || (s_suppkey - 1)) || '_' || greatest('AUTH_' || s_suppkey, 'AUTH_' || (s_suppkey - 1)) END)"
_CIDOC = " UNION ".join(
    f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind FROM supplier{w}"
    for s, p, o, k, w in (
        (_U, "rdf:type", "'crm:E21_Person'", "iri", ""), (_U, "rdfs:label", "s_name", "literal", ""), (_U, "skos:altLabel", "upper(s_name)", "literal", " WHERE upper(s_name) <> s_name"), (_U, "skos:hiddenLabel", "lower(s_name)", "literal", ""),
        (_U, "owl:sameAs", "'wd:Q' || s_suppkey", "iri", " WHERE s_suppkey % 2 = 0"), (_U, "crm:P2_has_type", "CASE WHEN s_suppkey % 3 = 0 THEN 'Gender_Male' ELSE 'Gender_Female' END", "iri", " WHERE s_suppkey % 3 < 2"),
        (_U, "crm:P98i_was_born", "'Birth_AUTH_' || s_suppkey", "iri", " WHERE s_suppkey % 2 = 0"), ("'Birth_AUTH_' || s_suppkey", "rdf:type", "'crm:E67_Birth'", "iri", " WHERE s_suppkey % 2 = 0"),
        ("'Birth_AUTH_' || s_suppkey", "crm:P98_brought_into_life", _U, "iri", " WHERE s_suppkey % 2 = 0"), ("'Birth_AUTH_' || s_suppkey", "crm:P4_has_time-span", "'TS_Birth_AUTH_' || s_suppkey", "iri", " WHERE s_suppkey % 2 = 0"),
        ("'TS_Birth_AUTH_' || s_suppkey", "rdf:type", "'crm:E52_Time-Span'", "iri", " WHERE s_suppkey % 2 = 0"), ("'TS_Birth_AUTH_' || s_suppkey", "crm:P82a_begin_of_the_begin", "'1099'", "year", " WHERE s_suppkey % 2 = 0"),
        ("'TS_Birth_AUTH_' || s_suppkey", "crm:P82b_end_of_the_end", "'1099'", "year", " WHERE s_suppkey % 2 = 0"), (_U, "crm:P1_is_identified_by", "'ID_AUTH_' || s_suppkey", "iri", ""), ("'ID_AUTH_' || s_suppkey", "rdf:type", "'crm:E42_Identifier'", "iri", ""),
        ("'ID_AUTH_' || s_suppkey", "rdf:value", "'AUTH:' || s_suppkey", "literal", ""), ("'ID_AUTH_' || s_suppkey", "crm:P2_has_type", "'Type_AuthorityID'", "iri", ""), (_U, "crm:P152_has_parent", "'http://www.wikidata.org/entity/Q9'", "iri", " WHERE s_suppkey % 5 = 0"),
        (f"'FamilyGroup_' || {_COUPLE}", "rdf:type", "'crm:E74_Group'", "iri", ""), (f"'FamilyGroup_' || {_COUPLE}", "crm:P2_has_type", "'Type_MaritalGroup'", "iri", ""),
        (f"'Joining_' || {_COUPLE} || '_AUTH_' || s_suppkey", "rdf:type", "'crm:E85_Joining'", "iri", ""), (f"'Joining_' || {_COUPLE} || '_AUTH_' || s_suppkey", "crm:P143_joined", _U, "iri", ""), (f"'Joining_' || {_COUPLE} || '_AUTH_' || s_suppkey", "crm:P144_joined_with", f"'FamilyGroup_' || {_COUPLE}", "iri", ""),
    )
)


@register("cidoc_triples", _CIDOC)
def cidoc_triples(spark, sf_dir):
    return A.cidoc(_figures(spark, sf_dir))


@register("vocabulary_triples", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'rdf:type', 'crm:E55_Type', 'iri'), ('{k}', 'rdfs:label', '{v}', 'literal')" for k, v in A.VOCABULARY.items()) + ") t(s, p, o, o_kind)")
def vocabulary_triples(spark, sf_dir):
    return A.vocabulary(spark)


@register("marital_blocks", f"""SELECT 'FamilyGroup_' || c AS s, '<FamilyGroup_' || c || '>' || chr(10) || '    crm:P2_has_type <Type_MaritalGroup> ;' || chr(10) || '    rdf:type crm:E74_Group .' AS block FROM (SELECT DISTINCT {_COUPLE} AS c FROM supplier)""")
def marital_blocks(spark, sf_dir):
    return E.serialised(A.cidoc(_figures(spark, sf_dir)).where("s LIKE 'FamilyGroup%'"))


# -- scraped ------------------------------------------------------------------------------------------

_TEXT = "c_custkey, '**' || c_name || '**, king of ' || lower(c_mktsegment) || CASE c_custkey % 4 WHEN 0 THEN ', fl. 1100-1118' WHEN 1 THEN ', died 1130' WHEN 2 THEN ', b. 1098' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ', see William  of Tyre' ELSE '' END AS t"


def _paragraphs(spark, sf_dir):
    k = F.col("c_custkey") % 4
    years = F.when(k == 0, ", fl. 1100-1118").when(k == 1, ", died 1130").when(k == 2, ", b. 1098").otherwise("")
    text = F.concat(F.lit("**"), "c_name", F.lit("**, king of "), F.lower("c_mktsegment"), years, F.when(F.col("c_custkey") % 2 == 0, ", see William  of Tyre").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"))


@register("paragraph_facts", """SELECT c_custkey, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '1100-1118' WHEN 1 THEN '?-1130' WHEN 2 THEN '1098-?' END AS floruit, 'King of ' || c_mktsegment[1] || lower(c_mktsegment[2:]) AS title, CASE WHEN c_custkey % 2 = 0 THEN 'William of Tyre' ELSE 'MedLands' END AS sources FROM customer""")
def paragraph_facts(spark, sf_dir):
    t = F.col("t")
    return _paragraphs(spark, sf_dir).select("c_custkey", S.name(t).alias("name"), S.floruit(t).alias("floruit"), S.title(t, F.lit("Acre")).alias("title"), F.array_join(S.cited(t), "|").alias("sources"))


@register("family_relations", """SELECT c_custkey, 'brother' AS type, c_name AS name, lower(c_mktsegment) AS description FROM customer UNION ALL SELECT c_custkey, 'spouse', 'Maud', NULL FROM customer UNION ALL SELECT c_custkey, 'uncle', 'Guy', 'of ' || c_custkey FROM customer WHERE c_custkey % 3 = 0""")
def family_relations(spark, sf_dir):
    text = F.concat(F.lit("Brother: "), "c_name", F.lit(" ("), F.lower("c_mktsegment"), F.lit("), wife: Maud"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(", Uncle: Guy (of "), F.col("c_custkey").cast("string"), F.lit(")"))).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(S.family(text)).alias("r")).select("c_custkey", "r.*")


@register("genealogy_records", """SELECT printf('FMG:%04d', c_custkey) AS id, c_name AS label, CASE WHEN c_custkey % 4 IN (0, 2) THEN CASE c_custkey % 4 WHEN 0 THEN '1100' ELSE '1098' END END AS birth, CASE c_custkey % 4 WHEN 0 THEN '1118' WHEN 1 THEN '1130' END AS death, 'Maud' AS kin, c_mktsegment AS region
FROM customer WHERE c_custkey % 7 <> 0""")
def genealogy_records(spark, sf_dir):
    t = F.col("t")
    rows = _paragraphs(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    named = F.when(F.col("c_custkey") % 7 == 0, F.lit("Chapter 3")).otherwise(S.name(t))
    kin = F.array(F.struct(F.lit("spouse_of").alias("type"), F.lit("Maud (d. 1101) & ").alias("name")), F.struct(F.lit("child_of").alias("type"), F.lit("X &").alias("name")))
    rows = rows.select(F.col("c_custkey").alias("pos"), named.alias("name"), S.floruit(t).alias("floruit"), S.title(t, F.lit("")).alias("title"), kin.alias("relations"), S.cited(t).alias("sources"), F.lit(None).cast("string").alias("url"), F.col("c_mktsegment").alias("region"))
    return S.genealogy_records(rows).select("id", "label", "birth", "death", F.array_join("relations.name", "|").alias("kin"), "region")


@register("region_counts", "SELECT c_mktsegment AS region, count(*) AS n FROM customer GROUP BY 1")
def region_counts(spark, sf_dir):
    return S.region_counts(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("region")))


@register("page_records", """SELECT 'DHI:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Achard' ELSE 'Bohemond' END AS given, CASE WHEN s_suppkey % 2 = 0 THEN 'unmarried' END AS descriptor, CASE WHEN s_suppkey % 2 = 0 THEN 'Nation' || s_nationkey END AS toponym,
  'Archbishop/cleric' AS role, 'France' AS origin, 1 AS expeditions, s_suppkey % 3 = 0 AS participation_confirmed, 'Albert|Tudebode' AS citations FROM supplier""")
def page_records(spark, sf_dir):
    k = F.col("s_suppkey")
    full = F.when(k % 2 == 0, F.concat(F.lit("Achard unmarried of Nation"), F.col("s_nationkey").cast("string"))).otherwise("Bohemond")
    fields = F.create_map(*[F.lit(x) if isinstance(x, str) else x for kv in (("name", full), ("role", "Archbishop (cleric)"), ("country_and_region_of_origin", "France\nmore"), ("sources", "Albert. Tudebode.")) for x in kv])
    trip = F.create_map(F.lit("expedition"), F.lit("First"), F.lit("probability_of_participation"), F.when(k % 3 == 0, "Certain").otherwise("Possible"))
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("DHI:"), k.cast("string")).alias("source_id"), F.lit("u").alias("source_url"), fields.alias("fields"), F.array(trip, F.create_map(F.lit("other"), F.lit("x"))).alias("crusades"))
    r = S.page_records(pages)
    return r.select("id", "given", "descriptor", "toponym", F.concat_ws("/", "role.role", "role.type").alias("role"), F.get("places", F.lit(0))["label"].alias("origin"), F.size("expeditions").alias("expeditions"), "participation_confirmed", F.array_join("citations", "|").alias("citations"))
