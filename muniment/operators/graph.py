"""One knowledge graph of people from several sources, and the records that feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Properties of long-form statements.
BIRTH, DEATH, GENDER, FLORUIT = "P569", "P570", "P21", "P1317"
ROLES = {"P39": "position", "P97": "noble_title", "P106": "occupation"}
KIN = {"P22": "father", "P25": "mother", "P26": "spouse", "P40": "child", "P3373": "sibling"}


def people_of(statements: DataFrame) -> DataFrame:
    """(qid, label, birth, death, gender, roles, relations) from long statements (pos, qid, label, prop, value_label)."""
    first = lambda p: F.min_by("value_label", F.when(F.col("prop") == p, F.col("pos")))
    only = lambda p: F.when(F.max(F.when(F.col("prop") == p, 1)).isNotNull(), first(p))
    listed = lambda table: F.array_sort(F.collect_set(F.when(F.col("prop").isin(*table), F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("prop")).alias("kind"), F.col("value_label").alias("value")))))
    out = statements.groupBy("qid").agg(F.min_by("label", "pos").alias("label"), T.iso_day(only(BIRTH)).alias("birth"), T.iso_day(only(DEATH)).alias("death"), F.lower(only(GENDER)).alias("g"), listed(ROLES).alias("roles"), listed(KIN).alias("relations"))
    # Equality, not containment: one word lies within the other.
    return out.withColumn("gender", F.when(F.col("g") == "male", "m").when(F.col("g") == "female", "f").otherwise("unknown")).drop("g")


def merged(authority: DataFrame, external: DataFrame, extracted: DataFrame, keep_matched: bool = False) -> DataFrame:
    """(id, label, qid, sources): authority rows (id, label) joined to external ones (qid, label) where a label's
    normal form belongs to one authority record only; external rows that match none (keep_matched: all of them,
    as published counts have it); and extracted names (name) that neither knows."""
    auth = authority.select("id", "label", T.normalise(F.col("label")).alias("norm"))
    ext = external.select("qid", F.col("label").alias("x_label"), T.normalise(F.col("label")).alias("norm"))
    single = auth.groupBy("norm").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1 AND norm <> ''").select("norm", "id")
    hits = ext.join(single, "norm")
    by = hits.groupBy("id").agg(F.max("qid").alias("qid"), F.array_sort(F.collect_set("qid")).alias("qids"))
    base = auth.join(by, "id", "left").select("id", "label", "qid", F.concat(F.array(F.lit("authority")), F.transform(F.coalesce("qids", F.array()), lambda q: F.concat(F.lit("external:"), q))).alias("sources"))
    rest = ext if keep_matched else ext.join(hits.select("qid").distinct(), "qid", "left_anti")
    alone = rest.groupBy("qid").agg(F.min("x_label").alias("label")).select(F.concat(F.lit("WIKIDATA:"), "qid").alias("id"), "label", "qid", F.array(F.lit("external")).alias("sources"))
    known = auth.select("norm").union(ext.select("norm")).distinct()
    new = extracted.select("name", T.normalise(F.col("name")).alias("norm")).where("norm <> ''").join(known, "norm", "left_anti").groupBy("norm").agg(F.min("name").alias("label"))
    new = new.select(F.concat(F.lit("EXTRACTED:"), T.slug(F.col("norm"), "person")).alias("id"), "label", F.lit(None).cast("string").alias("qid"), F.array(F.lit("extracted")).alias("sources"))
    return base.unionByName(alone).unionByName(new)


def breakdown(graph: DataFrame) -> DataFrame:
    return graph.agg(F.count(F.lit(1)).alias("persons"), F.count_if(F.col("qid").isNotNull()).alias("with_qid"), F.count_if(F.col("id").startswith("AUTH:")).alias("with_authority"), F.count_if(F.col("id").startswith("EXTRACTED:")).alias("needs_review"))


def couples(relations: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a, b) of (id, kind, other) rows that name a spouse."""
    return relations.where("kind = 'spouse' AND id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def person_triples(people: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(s, p, o, o_kind) of (id, label, variants, roles, places, birth, death), lists cut at the profile's caps."""
    caps = {"variants": 10, "roles": 5, "places": 5} | (most or {})
    s = T.entity_uri(F.col("id"))
    one = lambda p, o, k="literal": F.array(F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind")))
    many = lambda p, c: F.transform(F.slice(F.coalesce(c, F.array()), 1, caps[c]), lambda v: F.struct(F.lit(p).alias("p"), v.alias("o"), F.lit("literal").alias("o_kind")))
    items = F.concat(one("rdf:type", F.lit("crm:E21_Person"), "iri"), one("rdfs:label", F.col("label")), one("birthYear", T.year4(F.col("birth")), "year"), one("deathYear", T.year4(F.col("death")), "year"), many("altLabel", "variants"), many("hasRole", "roles"), many("hasPlace", "places"))
    return people.select(s.alias("s"), F.explode(items).alias("t")).where("t.o IS NOT NULL").select("s", "t.p", "t.o", "t.o_kind")


# -- scraped genealogies ------------------------------------------------------------------------------

# How a genealogy states relations and lifetimes.
RELATIONS = {
    "child_of": r"(?:son|daughter) of ([A-Z][\w' -]+)", "spouse_of": r"(?:m\.|married|wife of|husband of) ([A-Z][\w' -]+)", "sibling_of": r"(?:brother|sister) of ([A-Z][\w' -]+)",
    "parent_of": r"(?:father|mother) of ([A-Z][\w' -]+)", "heir_of": r"(?:heir|heiress) of ([A-Z][\w' -]+)",
}
LIFETIMES = (r"\((?:b\.|born)?\s*(\d{3,4})\s*-\s*(?:d\.)?\s*(\d{3,4})\)", r"fl\.\s*(\d{3,4})(?:\s*-\s*(\d{3,4}))?", r"d\.\s*()(\d{3,4})")


def paragraphs(pages: DataFrame, tag: str = "p") -> DataFrame:
    """(page_id, pos, paragraph): the text of each element, tags stripped and entities replaced."""
    inner = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    text = F.transform(inner, lambda x: plain_text(x))
    return pages.select("page_id", F.posexplode(text).alias("pos", "paragraph"))


def plain_text(c: Column) -> Column:
    out = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return T.collapse(out)


def fields(pages: DataFrame, cell: str = "td") -> DataFrame:
    """(page_id, label, value) of a page's label and value cells."""
    cells = F.transform(F.regexp_extract_all("html", F.lit(rf"(?is)<{cell}\b[^>]*>(.*?)</{cell}>"), F.lit(1)), plain_text)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.struct(F.get("c", 2 * i).alias("label"), F.get("c", 2 * i + 1).alias("value")))
    return pages.select("page_id", cells.alias("c")).where("size(c) > 1").select("page_id", F.explode(pairs).alias("f")).select("page_id", F.lower(F.regexp_replace("f.label", r":\s*$", "")).alias("label"), "f.value")


def relations_of(text: Column) -> Column:
    """array<struct<type, name>> that a paragraph states, distinct, in the order of the patterns."""
    tagged = lambda kind: lambda n: F.struct(F.lit(kind).alias("type"), F.trim(n).alias("name"))
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), tagged(k)) for k, p in RELATIONS.items()]
    return F.array_distinct(F.concat(*found))


def lifetime(text: Column) -> Column:
    """struct<start, end> of the first pattern that matches."""
    out = None
    for p in LIFETIMES:
        pair = F.struct(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int").alias("start"), F.nullif(F.regexp_extract(text, p, 2), F.lit("")).cast("int").alias("end"))
        out = F.when(text.rlike(p), pair) if out is None else out.when(text.rlike(p), pair)
    return out


def genealogy(rows: DataFrame, name: Column) -> DataFrame:
    """(page_id, person, name, paragraphs, relations) of paragraphs(): one with a name begins a person, others add to it."""
    named = rows.withColumn("name", F.nullif(name, F.lit("")))
    by = Window.partitionBy("page_id").orderBy("pos")
    named = named.withColumn("person", F.sum(F.when(F.col("name").isNotNull(), 1).otherwise(0)).over(by)).where("person > 0")
    return named.groupBy("page_id", "person").agg(F.min_by("name", "pos").alias("name"), F.count(F.lit(1)).alias("paragraphs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(relations_of(F.col("paragraph")))))).alias("relations"))


# -- open authorities ---------------------------------------------------------------------------------

def wikibase_statements(entities: DataFrame) -> DataFrame:
    """(id, property, value, value_type, rank) of Wikibase entities (id, json), properties in order."""
    schema = "claims map<string,array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>,rank:string>>>"
    rows = entities.select("id", F.explode(F.from_json("json", schema)["claims"]).alias("property", "s")).select("id", "property", F.explode("s").alias("s"))
    value = F.col("s.mainsnak.datavalue.value")
    said = F.when(F.col("s.mainsnak.datavalue.type") == "wikibase-entityid", F.get_json_object(value, "$.id")).when(F.col("s.mainsnak.datavalue.type") == "time", F.get_json_object(value, "$.time")).when(F.col("s.mainsnak.datavalue.type") == "monolingualtext", F.get_json_object(value, "$.text")).otherwise(value)
    return rows.select("id", "property", said.alias("value"), F.col("s.mainsnak.datavalue.type").alias("value_type"), F.col("s.rank").alias("rank"))


def snapshot(records: DataFrame, key: str = "source_uri") -> DataFrame:
    """(n, checksum): the checksum of a source's records as sorted canonical JSON, without the time of retrieval."""
    rows = records.select(F.struct(F.col(key), F.to_json(F.struct(*sorted(records.columns))).alias("j")).alias("r"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), "\n"), 256).alias("checksum"))


def candidate_features(pairs: DataFrame) -> DataFrame:
    """pairs (query_labels, candidate_labels, ...) with how many normal labels they share."""
    norm = lambda c: F.array_distinct(F.transform(c, lambda x: T.normalise(x, punctuation=None, casefold=True)))
    both = F.array_intersect(norm(F.col("query_labels")), norm(F.col("candidate_labels")))
    return pairs.withColumn("shared_labels", F.array_sort(both)).withColumn("n_shared", F.size(both))


def relevant(records: DataFrame, low: int = 1000, high: int = 1400, terms: tuple[str, ...] = ()) -> DataFrame:
    """Records whose years meet [low, high] or have none, and that name one of the regions."""
    years = F.col("years")
    inside = (F.size(F.coalesce(years, F.array())) == 0) | ((F.array_min(years) <= high) & (F.array_max(years) >= low))
    named = F.lit(not terms)
    for t in terms:
        named = named | F.lower(F.to_json(F.struct(*records.columns))).contains(t.lower())
    return records.where(inside & named)
