"""Queries over text functions, mentions, noise rules, linking and error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..operators import extraction as X
from ..operators import linking as L
from ..operators import metrics as M
from .registry import register

_NORM = r"lower(trim(regexp_replace(regexp_replace(strip_accents({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')))"
_KEEP = r"lower(trim(regexp_replace(strip_accents({0}), '\s+', ' ', 'g')))"
_STRIP = "list_aggregate(list_filter(string_split({0}, ' '), lambda t: t NOT IN ('de','of','von','du','der','des','le','la','d','')), 'string_agg', ' ')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("norm_names", f"""WITH x AS (SELECT doc_id, {_NORM.format("text")} AS norm, {_KEEP.format("text")} AS keep FROM documents)
SELECT doc_id, md5(norm) AS norm, md5(keep) AS extraction_norm, md5(replace(norm, 'ß', 'ss')) AS eval_norm, md5(CASE WHEN len(list_filter(string_split(norm, ' '), lambda t: t NOT IN ('de','of','von','du','der','des','le','la','d',''))) >= 2 THEN {_STRIP.format("norm")} ELSE norm END) AS folded FROM x""")
def norm_names(spark, sf_dir):
    """Whole texts through each normaliser; digests keep the rows small."""
    d = table(spark, sf_dir, "documents")
    norm = T.normalise(F.col("text"))
    return d.select("doc_id", norm.alias("n"), T.normalise(F.col("text"), punctuation=None).alias("k"), T.normalise(F.col("text"), casefold=True).alias("e")).select("doc_id", F.md5("n").alias("norm"), F.md5("k").alias("extraction_norm"), F.md5("e").alias("eval_norm"), F.md5(T.fold_particles(F.col("n"))).alias("folded"))


@register("stable_ids", r"""SELECT p_partkey, 'id:part:' || substr(sha256(p_name || chr(31) || p_brand), 1, 24) AS stable_id, regexp_replace(regexp_replace(lower(trim(p_brand || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha256(p_name), 1, 12) AS doc_key,
  substr(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 1, 20) || '0000' || substr(md5(p_name), 1, 4) AS cite_key, 'reviewer-' || substr(sha256(p_brand), 1, 12) AS pseudonym FROM part""")
def stable_ids(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_id("part", "p_name", "p_brand").alias("stable_id"), T.doc_key(F.concat_ws(" ", "p_brand", "p_type"), name).alias("doc_key"), T.cite_key(name, F.lit(None).cast("string")).alias("cite_key"), T.pseudonym(F.col("p_brand")).alias("pseudonym"))


@register("escapes", r"""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS turtle,
  md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml, lower(regexp_replace(url, '^https?://', '')) AS bare, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS local FROM pages""")
def escapes(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.turtle(html)).alias("turtle"), F.md5(T.xml(html)).alias("xml"), F.lower(F.regexp_replace("url", "^https?://", "")).alias("bare"), T.local_name(F.col("url")).alias("local"))


@register("sanitised", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')) AS clean,
  md5(substr(replace(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), '"', ''''), 1, 120)) AS term FROM documents""")
def sanitised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitise(F.col("text"))).alias("clean"), F.md5(T.sanitise_term(F.col("text"))).alias("term"))


_SPAN = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿœ]+(?:\s+(?:(?:de|of|von|van|der|den|le|la|du)\s+)?[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿœ]+){0,3}"


@register("mention_offsets", rf"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '{_SPAN}') AS f, regexp_split_to_array(text, '{_SPAN}') AS g FROM documents),
p AS (SELECT doc_id, unnest(f) AS raw, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM x)
SELECT doc_id, raw, (sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw))::BIGINT AS start FROM p""")
def mention_offsets(spark, sf_dir):
    return X.matches(table(spark, sf_dir, "documents"), {"name": _SPAN}).select("doc_id", "raw", F.col("start").cast("long").alias("start"))


_GROUPS = "|".join(X.COLLECTIVES)


@register("collectives", rf"""SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)(?:{_GROUPS}|the|und|que|los)'))::BIGINT AS n FROM conversations""")
def collectives(spark, sf_dir):
    pattern = f"(?i)(?:{_GROUPS}|the|und|que|los)"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(pattern)).cast("long").alias("n"))


def named_lines(spark, sf_dir):
    """A name and a context for every line of every document: its first three words, and the line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "context"))
    words = F.regexp_extract("context", T.portable(r"^\s*(\S+(?: \S+){0,2})"), 1)
    return d.withColumn("name", F.regexp_replace(words, r"^\p{Zs}+|\p{Zs}+\z", ""))


_LINES = r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS context FROM s),
n AS (SELECT doc_id, pos::BIGINT AS pos, context, trim(regexp_extract(context, '^\s*(\S+(?: \S+){0,2})', 1)) AS name FROM e),
"""
_ANY = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_RULES = rf"""m AS (SELECT *, lower(name) AS low, lower(context) AS around, len(regexp_split_to_array(name, '\s+')) AS k, list_transform(regexp_extract_all(context, '\b(1[5-9]\d{{2}}|20\d{{2}})\b', 1), lambda y: y::INT) AS years,
  list_transform(regexp_split_to_array(name, '\s+'), lambda t: lower(regexp_replace(regexp_replace(t, '^[.,''s]+', ''), '[.,''s]+$', ''))) AS w FROM n),
g AS (SELECT *, {_ANY(X.MODERN_TITLES, "low")}::INT + ({_ANY(X.MODERN_PLACES, "low")} OR {_ANY(X.MODERN_PLACES, "around")})::INT + (len(list_filter(years, lambda y: y >= 1800)) > 0)::INT AS strong,
  (len(years) > 0 AND len(list_filter(years, lambda y: y >= 1800)) = 0 AND len(list_filter(years, lambda y: y <= 1500)) = 0)::INT AS weak FROM m),
r AS (SELECT doc_id, pos, strong, weak, CASE WHEN name = '' THEN 'empty_name'
  WHEN low IN {X.NOISE_NAMES} OR {_ANY(X.NOISE_PARTS, "low")} OR regexp_matches(name, '{X.NOISE_WORDS}') OR (k <= 2 AND NOT regexp_matches(name, '{X.STYLED}') AND regexp_matches(context, '{X.NOISE_CONTEXT}')) THEN 'bibliographic_noise'
  WHEN strong >= 2 THEN 'post_medieval' WHEN k > 8 THEN 'name_too_long' WHEN regexp_matches(name, '\d') THEN 'contains_digits' WHEN k = 1 AND length(name) <= 2 THEN 'token_too_short'
  WHEN regexp_matches(name, '^[a-z][a-z\s''\-]+$') THEN 'lowercase_non_name'
  WHEN len(list_filter(range(1, len(w) + 1), lambda i: w[i] IN {X.SCHOLARS} AND NOT (i > 1 AND coalesce(w[i - 1], '') IN {X.ATTACHING}))) > 0 OR regexp_matches(context, '{X.CITED}') THEN 'modern_scholar' END AS reason FROM g)
"""


@register("problem_reasons", _LINES + _RULES + "SELECT doc_id, pos, reason FROM r")
def problem_reasons(spark, sf_dir):
    n = named_lines(spark, sf_dir)
    return n.select("doc_id", F.col("pos").cast("long").alias("pos"), X.problem_reason(F.col("name"), F.col("context"), F.lit(False), F.lit(None).cast("string")).alias("reason"))


@register("penalised_confidence", _LINES + _RULES + "SELECT doc_id, pos, strong::BIGINT AS strong, weak::BIGINT AS weak, greatest(0.0, round(0.5 - CASE WHEN strong = 1 THEN 0.3 WHEN weak >= 1 THEN 0.15 ELSE 0 END, 4))::DOUBLE AS confidence FROM r WHERE reason IS NULL")
def penalised_confidence(spark, sf_dir):
    n = named_lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "name", "context", F.lit(False).alias("group"), F.lit(None).cast("string").alias("title"), F.lit(0.5).alias("confidence"), F.lit("").alias("norm"))
    strong, weak = X.modern_signals(F.col("name"), F.col("context"))
    return X.reweighted(n).where("reason IS NULL").select("doc_id", "pos", strong.cast("long").alias("strong"), weak.cast("long").alias("weak"), "confidence")


@register("noise_statistics", _LINES + _RULES + "SELECT doc_id, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS filtered, round(count(*) FILTER (reason IS NOT NULL)::DOUBLE / count(*), 4) AS noise_share FROM r GROUP BY 1")
def noise_statistics(spark, sf_dir):
    reason = X.problem_reason(F.col("name"), F.col("context"), F.lit(False), F.lit(None).cast("string"))
    return X.noise_statistics(named_lines(spark, sf_dir).select("doc_id", reason.alias("reason"), F.lit(0.5).alias("confidence"))).drop("low_confidence")


@register("deduplicated_people", _LINES + rf"""k AS (SELECT doc_id, pos, {_KEEP.format("name")} AS norm, (length(context) % 10) / 10.0 AS confidence FROM n WHERE name <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY confidence DESC, pos) AS rn FROM k) SELECT doc_id, pos, norm, confidence::DOUBLE AS confidence FROM o WHERE rn = 1""")
def deduplicated_people(spark, sf_dir):
    n = named_lines(spark, sf_dir).where("name <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalise(F.col("name"), punctuation=None).alias("norm"), ((F.length("context") % 10) / 10.0).alias("confidence"))
    return X.deduplicated(n)


@register("document_guess", r"""SELECT doc_id, nullif(regexp_extract(substr(text, 1, 500), '\b(1[0-9]{3})\b', 1), '') AS year,
  CASE WHEN regexp_matches(substr(text, 1, 300), '(?i)\bcharter\b|\bdonation\b|\bgrant\b') THEN 'charter' WHEN regexp_matches(substr(text, 1, 300), '(?i)\bchronicle\b|\bannals?\b') THEN 'chronicle' ELSE 'other' END AS doc_type FROM documents""")
def document_guess(spark, sf_dir):
    return X.document_guess(table(spark, sf_dir, "documents"))


@register("mentions")
def mentions(spark, sf_dir):
    return X.reweighted(X.mentions(table(spark, sf_dir, "documents"))).drop("context")


def authority_from_benchmark(spark, sf_dir):
    """An authority table for the synthetic corpus: the first mention of each benchmark passage."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    first = X.mentions(b).where("pos = 0")
    none = F.array().cast("array<string>")
    return L.authority_lookup(first.select(F.format_string("AUTH:%05d", F.col("doc_id")).alias("authority_id"), F.col("name").alias("preferred_label"), F.lit("person").alias("type"), none.alias("variants"), none.alias("more_variants")))


def linked_people(spark, sf_dir):
    people = X.reweighted(X.mentions(table(spark, sf_dir, "documents"))).where("reason IS NULL")
    return L.links(people, authority_from_benchmark(spark, sf_dir))


@register("link_topk")
def link_topk(spark, sf_dir):
    return linked_people(spark, sf_dir).select("doc_id", "person", "top_id", "confidence", "status", F.size("candidates").alias("n"))


@register("link_status_by_language")
def link_status_by_language(spark, sf_dir):
    """Documents to mentions, noise rules, links to the authority, and how many of each status a language has."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return linked_people(spark, sf_dir).join(langs, "doc_id").groupBy("lang", "status").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("top_id").alias("authorities"))


@register("growth_queue")
def growth_queue(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, person string, id string")
    return L.growth_queue(linked_people(spark, sf_dir), none).select("doc_id", "person", "top_id", "confidence")


@register("prf_greedy")
def prf_greedy(spark, sf_dir):
    """Mentions found after dropping every fifth, against all: matched in order."""
    people = X.mentions(table(spark, sf_dir, "documents")).select("doc_id", "pos", "name")
    return M.extraction_scores(people.where("pos % 5 <> 0"), people)


# -- similarity ---------------------------------------------------------------------------------------

def _neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("a"), "p_size")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


_PAIRS = """WITH RECURSIVE p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS a, p_size FROM part), q AS (SELECT p.p_partkey, p.p_size, p.a, n.a AS b FROM p JOIN p n ON n.p_partkey = p.p_partkey + 1),
"""


@register("name_ratios", _PAIRS + """u AS (SELECT DISTINCT array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM q),
l(x, y, i, r) AS (SELECT x, y, 0::BIGINT, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) FROM u
  UNION ALL SELECT x, y, i + 1, list_transform(range(0, length(y) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1), lambda m: greatest(r[m + 1], r[m] + (x[i + 1] = y[m])::BIGINT))) END) FROM l WHERE i < length(x)),
s AS (SELECT x, y, r[length(y) + 1] AS n FROM l WHERE i = length(x))
SELECT q.p_partkey, round(2.0 * s.n / (length(s.x) + length(s.y)), 6)::DOUBLE AS ratio FROM q JOIN s ON s.x = array_to_string(list_sort(string_split(q.a, ' ')), ' ') AND s.y = array_to_string(list_sort(string_split(q.b, ' ')), ' ')""")
def name_ratios(spark, sf_dir):
    """Word-sorted edit ratios as a Catalyst expression, each distinct pair computed once."""
    q = _neighbours(spark, sf_dir).select("p_partkey", fuzzy.sorted_words(F.col("a")).alias("x"), fuzzy.sorted_words(F.col("b")).alias("y"))
    s = q.select("x", "y").distinct().withColumn("ratio", F.round(fuzzy.ratio_column(F.col("x"), F.col("y")), 6))
    return q.join(s, ["x", "y"]).select("p_partkey", "ratio")


@register("word_overlap", _PAIRS + """w AS (SELECT p_partkey, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM q)
SELECT p_partkey, round(len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y)), 6) AS overlap FROM w""")
def word_overlap(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("p_partkey", F.round(fuzzy.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@register("name_ensemble")
def name_ensemble(spark, sf_dir):
    q = _neighbours(spark, sf_dir)
    return q.select("p_partkey", F.round(fuzzy.ensemble_udf("a", "b"), 4).alias("score"), L.status(fuzzy.ensemble_udf("a", "b")).alias("status"))


@register("cer_pairs", _PAIRS + "z AS (SELECT 1) SELECT p_partkey, round(levenshtein(a, b)::DOUBLE / length(a), 6) AS cer FROM q")
def cer_pairs(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("p_partkey", F.round(M.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@register("wer_pairs", _PAIRS + """c AS (SELECT p_partkey, string_split(a, ' ') AS a, string_split(b, ' ') AS b FROM q), v AS (SELECT DISTINCT unnest(a || b) AS w FROM c), n AS (SELECT w, chr((row_number() OVER (ORDER BY w) + 40)::INT) AS k FROM v),
e AS (SELECT p_partkey, string_agg(n.k, '' ORDER BY i) AS s FROM (SELECT p_partkey, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM c) JOIN n USING (w) GROUP BY 1), f AS (SELECT p_partkey, string_agg(n.k, '' ORDER BY i) AS s FROM (SELECT p_partkey, unnest(b) AS w, generate_subscripts(b, 1) AS i FROM c) JOIN n USING (w) GROUP BY 1)
SELECT p_partkey, round(levenshtein(e.s, f.s)::DOUBLE / length(e.s), 6) AS wer FROM e JOIN f USING (p_partkey)""")
def wer_pairs(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("p_partkey", F.round(M.wer(F.col("a"), F.col("b")), 6).alias("wer"))


@register("candidate_distance", """WITH c AS (SELECT p_brand || '/' || p_size AS item_id, p_partkey AS pos, p_name AS text FROM part), d AS (SELECT a.item_id, levenshtein(a.text, b.text)::DOUBLE / greatest(length(a.text), length(b.text)) AS d FROM c a JOIN c b ON a.item_id = b.item_id AND a.pos < b.pos)
SELECT item_id, count(*) AS pairs, round(avg(d), 4) AS mean_distance, round(max(d), 4) AS max_distance FROM d GROUP BY 1""")
def candidate_distance(spark, sf_dir):
    return M.candidate_distance(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("item_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text")))


@register("external_scores", _PAIRS + rf"""s AS (SELECT p_partkey, lower(a) AS a, lower(b) AS b, CASE WHEN p_size % 3 = 0 THEN 'medieval knight' WHEN p_size % 3 = 1 THEN 'american politician' ELSE '' END AS t, p_size * 40 AS birth, p_size * 41 AS death FROM q)
SELECT p_partkey, least(1.0, greatest(0.0, CASE WHEN a = b THEN 0.5 WHEN contains(a, b) OR contains(b, a) THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(t, '{L.RELEVANT}') THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches(t, '{L.LATER}') THEN 0.5 ELSE 0 END))::DOUBLE AS score,
  NOT coalesce(birth > 1500 AND death > 1500, false) AS kept FROM s""")
def external_scores(spark, sf_dir):
    q = _neighbours(spark, sf_dir)
    told = F.when(F.col("p_size") % 3 == 0, "medieval knight").when(F.col("p_size") % 3 == 1, "american politician").otherwise("")
    return q.select("p_partkey", L.external_score(F.col("a"), F.col("b"), told).alias("score"), L.medieval_dates(F.col("p_size") * 40, F.col("p_size") * 41).alias("kept"))


# -- evaluation ---------------------------------------------------------------------------------------

_GOLD = r"""WITH g AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS verdict, d.n_chars > 500 AS hit, least(1.0, d.n_chars / 5000.0)::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, source, count(*) FILTER (verdict = 'accepted' AND hit) AS accept_hit, count(*) FILTER (verdict = 'accepted' AND NOT hit) AS accept_miss, count(*) FILTER (verdict = 'rejected' AND hit) AS reject_hit, count(*) FILTER (verdict = 'rejected' AND NOT hit) AS reject_avoided FROM g GROUP BY 1, 2)
"""


def _gold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("verdict"), (F.col("n_chars") > 500).alias("hit"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), "n_chars", "toxic")


def _counts(g):
    yes = F.col("verdict") == "accepted"
    return g.groupBy("lang", "source").agg(F.count_if(yes & F.col("hit")).alias("accept_hit"), F.count_if(yes & ~F.col("hit")).alias("accept_miss"), F.count_if(~yes & F.col("hit")).alias("reject_hit"), F.count_if(~yes & ~F.col("hit")).alias("reject_avoided"))


_LIFT = """SELECT lang, sum(accept_hit)::BIGINT AS accept_hit, sum(accept_miss)::BIGINT AS accept_miss, sum(reject_hit)::BIGINT AS reject_hit, sum(reject_avoided)::BIGINT AS reject_avoided,
  round(sum(accept_hit + reject_avoided)::DOUBLE / sum(accept_hit + accept_miss + reject_hit + reject_avoided), 4) AS agreement, round(sum(reject_hit + reject_avoided)::DOUBLE / sum(accept_hit + accept_miss + reject_hit + reject_avoided), 4) AS null_agreement,
  round(sum(accept_hit + reject_avoided)::DOUBLE / sum(accept_hit + accept_miss + reject_hit + reject_avoided) - sum(reject_hit + reject_avoided)::DOUBLE / sum(accept_hit + accept_miss + reject_hit + reject_avoided), 4) AS lift,
  round(sum(accept_hit)::DOUBLE / sum(accept_hit + accept_miss), 4) AS accept_rate, round(sum(reject_hit + reject_avoided)::DOUBLE / sum(accept_hit + accept_miss + reject_hit + reject_avoided), 4) AS negative_share FROM c GROUP BY 1"""


@register("agreement_lift", _GOLD + _LIFT)
def agreement_lift(spark, sf_dir):
    return M.null_reference(_counts(_gold(spark, sf_dir)), ["lang"])


@register("floor_sweep", _GOLD + """, f AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.8])::DOUBLE AS floor), h AS (SELECT floor, verdict, score >= floor AS hit FROM g, f)
SELECT floor, count(*) FILTER (verdict = 'accepted' AND hit) AS accept_hit, count(*) FILTER (verdict = 'accepted' AND NOT hit) AS accept_miss, count(*) FILTER (verdict = 'rejected' AND hit) AS reject_hit, count(*) FILTER (verdict = 'rejected' AND NOT hit) AS reject_avoided,
  round(count(*) FILTER ((verdict = 'accepted') = hit)::DOUBLE / count(*), 4) AS agreement FROM h GROUP BY 1""")
def floor_sweep(spark, sf_dir):
    return M.floor_sweep(_gold(spark, sf_dir), [0.05, 0.1, 0.2, 0.3, 0.5, 0.8])


@register("miss_diagnosis", _GOLD.replace("AS hit,", "AS hit, d.n_chars, l.toxic,") + """SELECT doc_id, CASE WHEN hit AND toxic = 0 THEN 'HIT' WHEN n_chars < 100 THEN 'not_extracted' WHEN n_chars < 300 THEN 'no_candidates' WHEN toxic = 1 THEN 'ranked_below_top' ELSE 'candidate_missing' END AS cause FROM g WHERE verdict = 'accepted'""")
def miss_diagnosis(spark, sf_dir):
    g = _gold(spark, sf_dir).where("verdict = 'accepted'")
    n = F.when(F.col("n_chars") < 300, 0).otherwise(1)
    return g.select("doc_id", M.miss_reason(F.col("n_chars") >= 100, n, F.col("toxic") == 1, F.col("hit") & (F.col("toxic") == 0)).alias("cause"))


@register("quality_gate", _GOLD + """, s AS (SELECT lang AS segment, source, round((accept_hit + reject_avoided)::DOUBLE / (accept_hit + accept_miss + reject_hit + reject_avoided), 4) AS agreement, round((accept_hit + reject_avoided)::DOUBLE / (accept_hit + accept_miss + reject_hit + reject_avoided) - (reject_hit + reject_avoided)::DOUBLE / (accept_hit + accept_miss + reject_hit + reject_avoided), 4) AS lift FROM c)
SELECT segment, min(agreement) AS least_agreement, round(avg(agreement), 4) AS mean_agreement, max(agreement) AS most_agreement, min(lift) AS least_lift, min(agreement) >= 0.3 AND min(lift) >= 0 AS passes FROM s GROUP BY 1""")
def quality_gate(spark, sf_dir):
    s = M.null_reference(_counts(_gold(spark, sf_dir)), ["lang", "source"]).withColumnRenamed("lang", "segment")
    return M.gate(s, 0.3, 0.0)


@register("score_histogram", _GOLD + "SELECT printf('[%.2f,%.2f)', floor(round(score / 0.05, 6)) * 0.05, floor(round(score / 0.05, 6)) * 0.05 + 0.05) AS bin, count(*) AS n FROM g GROUP BY 1")
def score_histogram(spark, sf_dir):
    return _gold(spark, sf_dir).groupBy(T.score_bin(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("system_split", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'external' ELSE 'authority' END AS system, count(*) AS n FROM orders GROUP BY 1")
def system_split(spark, sf_dir):
    key = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "wikidata:Q").otherwise("AUTH:"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").groupBy(M.system_of(key).alias("system")).agg(F.count(F.lit(1)).alias("n"))


@register("first_in_document", "SELECT source, arg_min(doc_id, (n_chars, doc_id)) AS shortest, arg_max(doc_id, (n_chars, -doc_id)) AS longest FROM documents GROUP BY 1")
def first_in_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    up, down = Window.partitionBy("source").orderBy("n_chars", "doc_id"), Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    r = d.select("source", "doc_id", F.row_number().over(up).alias("a"), F.row_number().over(down).alias("b"))
    return r.groupBy("source").agg(F.min(F.when(F.col("a") == 1, F.col("doc_id"))).alias("shortest"), F.min(F.when(F.col("b") == 1, F.col("doc_id"))).alias("longest"))
