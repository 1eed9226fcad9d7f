"""Queries over the driver's tables and inline fixtures, and the SQL that says the same where SQL can."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.names import search_keys
from ..operators import dictionary, matching, presentation, registry
from ..sources import files, web
from ..streaming import sessions
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _save(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """Intermediate tables in the session's shared folder; a local session without one gets a folder that goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            made = tempfile.mkdtemp(prefix="glossweave-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = f"file://{made}"
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        spark.conf.set("spark.checkpoint.dir", folder)
    root = f"{folder.rstrip('/')}/registry-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return save


def latin_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading two to four words of benchmark items as a registry of works; every fifth name is shared by two."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    size = (F.col("item_id") % 3 + 2).cast("int")
    lead = table(spark, sf_dir, "benchmark").select("item_id", size.alias("n"), F.slice(words, F.lit(1), size).alias("w")).where("size(w) = n")
    each = lead.select("item_id", "w", F.explode(F.when(F.col("item_id") % 5 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b")))).alias("kind"))
    return each.select(
        (F.col("item_id") * 2 + F.when(F.col("kind") == "c", 1).otherwise(0)).cast("long").alias("ord"), F.concat("kind", F.col("item_id")).alias("id"), F.array_join("w", " ").alias("name"), F.lit("material").alias("entity_type"),
        F.array(F.lit("extremist_material")).alias("statuses"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("benchmark")).alias("sources"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.array().cast("array<string>").alias("runtime_forms"),
    )


NORM = "trim(regexp_replace(regexp_replace(lower(translate({0}, 'Ёё', 'Ее')), '[«»“”\"''`´]', '', 'g'), '[^0-9a-zа-я]+', ' ', 'g'))"
_STEM = "CASE WHEN regexp_full_match({0}, '[a-z0-9]*') THEN {0} ELSE regexp_replace({0}, '^(.{{4,}}?)(?:" + "|".join(sorted(V.ENDINGS, key=len, reverse=True)) + ")$', '\\1') END"


def _tokens(x: str) -> str:
    return f"[t for t in string_split({NORM.format(x)}, ' ') if t <> '']"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS digest, length({NORM.format('text')}) AS n_chars FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n_chars"))


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, len(list_distinct({_tokens('text')})) AS n_distinct FROM documents")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


_RU = X.sql_values([(i, t) for i, t in X.TEXTS] + [(100 + i, e[1]) for i, e in enumerate(X.ENTITIES)], "id, text")


@query(
    f"WITH w AS (SELECT unnest({_tokens('text')}) AS token FROM documents UNION ALL SELECT unnest({_tokens('text')}) FROM {_RU}) "
    f"SELECT token, {_STEM.format('token')} AS stem, count(*) AS n FROM w GROUP BY token"
)
def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ru = spark.createDataFrame([(t,) for _, t in X.TEXTS] + [(e[1],) for e in X.ENTITIES], "text string")
    words = table(spark, sf_dir, "documents").select("text").unionByName(ru).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).select("token", T.stem(F.col("token")).alias("stem"), "n")


@query(f"SELECT doc_id, md5(array_to_string([{_STEM.format('t')} for t in {_tokens('text')}], ' ')) AS key_digest FROM documents")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.key(F.col("text"))).alias("key_digest"))


_PLACES = ", ".join(f"'{p}'" for p in V.PLACES)
_CITIES, _REPUBLICS, _REGIONS, _ADMIN = (", ".join(f"'{p}'" for p in x) for x in (V.CITIES, V.REPUBLICS, V.REGIONS, V.ADMIN_WORDS))
_REST = "array_to_string(t[2:], ' ')"
_MEANING = f"array_to_string([w for w in t if w NOT IN ({_ADMIN})], ' ')"


@query(
    f"SELECT surface, CASE WHEN n = '' THEN false WHEN n IN ({_PLACES}) THEN true WHEN t[1] = 'город' AND {_REST} IN ({_CITIES}) THEN true "
    f"WHEN t[1] = 'республика' AND {_REST} IN ({_REPUBLICS}) THEN true WHEN t[-1] IN ('область', 'край', 'округ', 'район') THEN n IN ({_REGIONS}) "
    f"ELSE {_MEANING} = '' OR {_MEANING} IN ({_PLACES}) END AS is_place FROM (SELECT surface, {NORM.format('surface')} AS n, {_tokens('surface')} AS t FROM {X.sql_values([(s,) for s in X.SURFACES], 'surface')})"
)
def geographic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in X.SURFACES], "surface string").select("surface", T.is_place(F.col("surface")).alias("is_place"))


_GENERIC = ", ".join(f"'{p}'" for p in V.GENERIC)
_NOISY = " OR ".join(f"contains(' ' || n || ' ', '{p}')" for p in V.NOISY_PHRASES)
_NUMBERS = " OR ".join(f"starts_with(n, '{p}')" for p in V.NUMBER_PREFIXES)


@query(
    f"SELECT surface, CASE WHEN is_place OR n IN ({_GENERIC}) OR {_NOISY} OR regexp_full_match(n, '[0-9]+') OR {_NUMBERS} THEN false "
    f"WHEN regexp_full_match(regexp_replace(surface, '[^A-Za-zА-Яа-яЁё0-9]+', '', 'g'), '[A-ZА-ЯЁ0-9]{{3,}}') THEN true WHEN len(t) = 0 THEN false "
    f"WHEN len(t) >= 2 THEN len([x for x in t if NOT regexp_full_match(x, '[a-z]{{1,5}}')]) > 0 AND len([x for x in t if length(x) >= 2]) >= 2 "
    f"ELSE NOT regexp_full_match(t[1], '[a-z]{{1,3}}|[а-я]{{1,4}}') END AS significant, length(replace(n, ' ', '')) >= 3 AS as_form "
    f"FROM (SELECT surface, {NORM.format('surface')} AS n, {_tokens('surface')} AS t, is_place FROM ({ORACLE_SQL['geographic_filter']}))"
)
def surface_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("surface")
    return spark.createDataFrame([(x,) for x in X.SURFACES], "surface string").select("surface", T.is_significant(s).alias("significant"), T.is_significant_form(s).alias("as_form"))


@query("SELECT p_partkey, substr(sha1(concat_ws('|', 'part', p_name, p_brand)), 1, 16) AS id FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_id(F.lit("part"), F.col("p_name"), F.col("p_brand")).alias("id"))


_LEAD = """
SELECT item_id, kind || item_id AS id, item_id * 2 + (kind = 'c')::INT AS ord, n, name FROM (
  SELECT item_id, 2 + item_id % 3 AS n, array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1 : 2 + item_id % 3], ' ') AS name, unnest(CASE WHEN item_id % 5 = 0 THEN ['b', 'c'] ELSE ['b'] END) AS kind
  FROM benchmark WHERE len(regexp_extract_all(text, '[A-Za-z]+')) >= 2 + item_id % 3)
"""
_SIGNIFICANT = "(NOT starts_with(lower(name), 'id ') AND (regexp_full_match(replace(name, ' ', ''), '[A-Z0-9]{3,}') OR (NOT regexp_full_match(lower(name), '[a-z]{1,5}( [a-z]{1,5})*') AND len([t for t in string_split(name, ' ') if length(t) >= 2]) >= 2)))"
_KEYS = f"SELECT lower(name) AS key, any_value(n) AS n, list(id ORDER BY ord) AS ids, arg_min(name, ord) AS name FROM ({_LEAD}) WHERE {_SIGNIFICANT} GROUP BY 1"


@query(f"SELECT key, len(ids) AS n_entities, ids[1] AS first_id FROM ({_KEYS})")
def dictionary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = dictionary.keys(dictionary.terms(latin_registry(spark, sf_dir)))
    return k.select("key", F.size("entity_ids").cast("long").alias("n_entities"), F.get("entity_ids", F.lit(0)).alias("first_id"))


@query(f"SELECT key, array_to_string(ids, ' ') AS ids FROM ({_KEYS}) WHERE len(ids) > 1")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = dictionary.keys(dictionary.terms(latin_registry(spark, sf_dir)))
    return k.where(F.size("entity_ids") > 1).select("key", F.array_join("entity_ids", " ").alias("ids"))


_RUN = "[A-Za-zА-Яа-яЁё0-9]+"
_HITS = f"""
keys AS ({_KEYS}),
d AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '{_RUN}') AS t, regexp_split_to_array(text, '{_RUN}') AS s FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token FROM d),
c AS (SELECT doc_id, i, key, n, ids FROM p JOIN keys ON lower(p.token) = string_split(keys.key, ' ')[1]),
h AS MATERIALIZED (SELECT c.doc_id, key, ids, (list_sum([length(x) for x in s[1 : i]]) + coalesce(list_sum([length(x) for x in t[1 : i - 1]]), 0))::INT AS b,
  (list_sum([length(x) for x in s[1 : i + n - 1]]) + list_sum([length(x) for x in t[1 : i + n - 1]]))::INT AS e
  FROM c JOIN d USING (doc_id) WHERE lower(array_to_string(t[i : i + n - 1], ' ')) = key AND NOT suffix(s[i], '_') AND NOT prefix(s[i + n], '_')
  AND len([x for x in s[i + 1 : i + n - 1] if NOT regexp_full_match(x, '[^\\p{{L}}\\p{{N}}]+')]) = 0)
"""
#: Longest key first, then by key and place; what is accepted or shared occupies its span, and a key's hits don't overlap each other.
_RESOLVED = f"""
WITH RECURSIVE {_HITS},
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, key, b) AS rn FROM h),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS rn, '' AS key, NULL::VARCHAR[] AS ids, 0 AS b, 0 AS e, 0 AS past, false AS kept, []::STRUCT(b INT, e INT)[] AS spans FROM o
  UNION ALL SELECT doc_id, rn, key, ids, b, e, past, kept, CASE WHEN kept THEN list_append(spans, {{'b': b, 'e': e}}) ELSE spans END FROM (
    SELECT o.doc_id, o.rn, o.key, o.ids, o.b, o.e, CASE WHEN o.key = f.key AND o.b < f.past THEN f.past ELSE o.e END AS past,
      NOT (o.key = f.key AND o.b < f.past) AND len([x for x in f.spans if o.b < x.e AND o.e > x.b]) = 0 AS kept, f.spans
    FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1)),
r AS MATERIALIZED (SELECT f.doc_id, ids, b, e, substr(text, b + 1, e - b) AS text FROM f JOIN documents USING (doc_id) WHERE kept)
"""


@query(f"WITH {_HITS} SELECT doc_id, key, count(*) AS n_hits FROM h GROUP BY doc_id, key")
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = matching.verified(docs, dictionary.keys(dictionary.terms(latin_registry(spark, sf_dir))))
    return hits.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", F.col("h.key").alias("key")).agg(F.count("*").alias("n_hits"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entities = latin_registry(spark, sf_dir)
    return matching.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), entities), entities


@query(f"{_RESOLVED} SELECT doc_id, ids[1] AS entity_id, b AS start, e AS \"end\", text, 0.99::DOUBLE AS confidence, 'exact' AS match_type FROM r WHERE len(ids) = 1")
def resolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _resolved(spark, sf_dir)
    each = found.select("doc_id", F.explode("matches").alias("m"))
    return each.select("doc_id", "m.entity_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), "m.text", "m.confidence", "m.match_type")


@query(f"{_RESOLVED} SELECT doc_id, b AS start, e AS \"end\", text, array_to_string(ids, ' ') AS candidate_ids, 'ambiguous alias or name' AS reason FROM r WHERE len(ids) > 1")
def ambiguous_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _resolved(spark, sf_dir)
    each = found.select("doc_id", F.explode("ambiguous").alias("m"))
    return each.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), "m.text", F.array_join("m.candidate_ids", " ").alias("candidate_ids"), "m.reason")


_EXPECTED = [
    (1, "e1", 0, 13, "95", "person_alias"), (2, "e1", 12, 26, "93", "person_alias"), (3, "e1", 0, 13, "95", "person_alias"), (3, "e1", 22, 29, "88", "context_surname"),
    (7, "e4", 29, 34, "99", "context_alias"), (8, "e5", 12, 44, "99", "exact"), (8, "e5", 55, 58, "95", "context_acronym"),
]


@query(f'SELECT doc_id, entity_id, start, "end", percent, match_type FROM {X.sql_values(_EXPECTED, """doc_id, entity_id, start, "end", percent, match_type""")}')
def fixture_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-worked texts: the oracle lists the expected rows."""
    found = matching.mentions(X.texts(spark), X.entities(spark)).select(F.col("doc_id").cast("int").alias("doc_id"), F.explode("matches").alias("m"))
    return found.select("doc_id", "m.entity_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.round(F.col("m.confidence") * 100).cast("int").cast("string").alias("percent"), "m.match_type")


def _marked(which: str) -> str:
    """Documents with stars after the mentions of ``r`` that ``which`` takes, and a line for each entity under them."""
    return f"""{_RESOLVED},
m AS (SELECT r.doc_id, ids[1] AS id, b, e, coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY b), 0) AS before FROM r WHERE {which}),
body AS (SELECT m.doc_id, string_agg(substr(text, before + 1, e - before) || '*', '' ORDER BY b) || substr(any_value(text), max(e) + 1) AS body FROM m JOIN documents USING (doc_id) GROUP BY m.doc_id),
names AS (SELECT doc_id, string_agg('_* ' || name || ' — {V.STATUS_LABELS["extremist_material"]}_', chr(10) ORDER BY first) AS disclosure
  FROM (SELECT doc_id, id, min(b) AS first FROM m GROUP BY doc_id, id) JOIN ({_LEAD}) USING (id) GROUP BY doc_id)
SELECT doc_id, coalesce(disclosure, '') AS disclosure, sha256(CASE WHEN disclosure IS NULL THEN text ELSE body || chr(10) || chr(10) || disclosure END) AS marked_sha256
FROM documents LEFT JOIN body USING (doc_id) LEFT JOIN names USING (doc_id)"""


#: The fixture texts as they have to come out, worked by hand.
_MARIA = f"_* Тестова Мария Примеровна — {V.STATUS_LABELS['foreign_agent']}_"
_FIXTURE_MARKS = [
    (-1, "Мария Тестова* дала комментарий.", _MARIA), (-2, "Комментарий Марии Тестовой*.", _MARIA), (-3, "Мария Тестова* пришла. Тестова* ответила.", _MARIA),
    (-4, "В тексте есть Общее имя.", ""), (-5, "Ветка сломалась.", ""), (-6, "Проект «Ветка» закрыт.", ""),
    (-7, "Проект городских наблюдений «Ветка*» закрыт.", f"_* Центр городских наблюдений Ветка — {V.STATUS_LABELS['foreign_agent']}_"),
    (-8, "ЛВИ молчит. Лаборатория выдуманных измерений* ответила. ЛВИ* подтвердила.", f"_* Лаборатория Выдуманных Измерений — {V.STATUS_LABELS['undesirable_organization']}_"),
]


@query(f"{_marked('len(ids) = 1')} UNION ALL SELECT doc_id, disclosure, sha256(CASE WHEN disclosure = '' THEN body ELSE body || chr(10) || chr(10) || disclosure END) FROM {X.sql_values(_FIXTURE_MARKS, 'doc_id, body, disclosure')}")
def marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, entities = _resolved(spark, sf_dir)
    ru = X.entities(spark)
    fixture = matching.mentions(X.texts(spark), ru)
    both = presentation.with_entities(found, entities).unionByName(presentation.with_entities(fixture.withColumn("doc_id", -F.col("doc_id")), ru))
    return presentation.annotate(both).select("doc_id", "disclosure", F.sha2("marked_text", 256).alias("marked_sha256"))


@query(_marked("true"))
def applied_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text after a review in which the sure mentions and the first candidate of each unclear one were chosen."""
    found, entities = _resolved(spark, sf_dir)
    reviews = presentation.review_candidates(found)
    first = F.filter("candidates", lambda c: c.selected_by_default | c.candidate_id.rlike(r"^ambiguous:\d+:\d+:\d+:0:"))
    chosen = reviews.withColumn("selected", F.transform(first, lambda c: c.candidate_id))
    return presentation.apply_reviews(chosen, entities).select("doc_id", "disclosure", F.sha2("marked_text", 256).alias("marked_sha256"))


_SURE = [(1, 0, "e1"), (2, 0, "e1"), (3, 0, "e1"), (3, 1, "e1"), (7, 0, "e4"), (8, 0, "e5"), (8, 1, "e5")]
_UNCLEAR = [(4, 0, 14, 23, "e2", 0), (4, 0, 14, 23, "e3", 1), (6, 0, 8, 13, "e4", 0)]


@query(
    f"SELECT doc_id::BIGINT AS doc_id, 'match:' || no AS candidate_id, 'match:' || no AS group_id, entity_id, false AS is_ambiguous, true AS selected_by_default FROM {X.sql_values(_SURE, 'doc_id, no, entity_id')} "
    f"UNION ALL SELECT doc_id, concat_ws(':', 'ambiguous', no, b, e, k, entity_id), concat_ws(':', 'ambiguous', no, b, e), entity_id, true, false FROM {X.sql_values(_UNCLEAR, 'doc_id, no, b, e, entity_id, k')}"
)
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = presentation.review_candidates(matching.mentions(X.texts(spark), X.entities(spark)))
    return c.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.candidate_id", "c.group_id", "c.entity_id", "c.is_ambiguous", "c.selected_by_default")


@query()
def acronyms_and_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return X.entities(spark).select("id", T.acronym(n, V.MATCHER_ACRONYM_STOPS, False).alias("acronym"), T.acronym(n, V.REGISTRY_ACRONYM_STOPS, True).alias("registry_acronym"), F.array_join(T.person_variants(n), "|").alias("variants"), F.array_join(T.latin_components(F.array("name")), "|").alias("components"))


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_TO_CYRILLIC = _replaced("lower(name)", [*V.LATIN_DIGRAPHS, *V.TO_CYRILLIC.items()])
_TO_LATIN = _replaced("lower(name)", list(V.TO_LATIN.items()))
_RU_NAMES = X.sql_values([(e[0], e[1]) for e in X.ENTITIES], "id, name")


@query(
    f"SELECT id, name, upper(x[1]) || substr(x, 2) AS spellings FROM (SELECT id, name, {_TO_CYRILLIC} AS x FROM ({_LEAD}) UNION ALL SELECT id, name, {_TO_LATIN} FROM {_RU_NAMES})"
)
def transliterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name in the other script; none of the fixture's names has the second spelling that a "sht" would give."""
    items = latin_registry(spark, sf_dir).select("id", "name").unionByName(X.entities(spark).select("id", "name"))
    return items.select("id", "name", F.array_join(T.transliterations(F.array("name")), "|").alias("spellings"))


@query()
def name_search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.entities(spark).where("entity_type = 'person'").select(F.explode(T.tokens(F.col("name"))).alias("token"))
    return words.select("token", F.array_join(F.array_sort(search_keys(F.col("token"))), " ").alias("keys"))


@query(
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, e DESC) AS n FROM {X.sql_values(X.SPANS, "id, b, e")}),
    f AS (SELECT id, b, e, n, true AS kept, e AS past FROM s WHERE n = 1
    UNION ALL SELECT s.id, s.b, s.e, s.n, s.b >= f.past, CASE WHEN s.b >= f.past THEN s.e ELSE f.past END FROM f JOIN s ON s.id = f.id AND s.n = f.n + 1)
    SELECT id, b AS "start", e AS "end" FROM f WHERE kept"""
)
def select_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spark.createDataFrame(X.SPANS, "id int, start int, end int").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.select("id", F.explode(presentation.select_intervals(F.col("spans"))).alias("s")).select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(
    "SELECT conv_id, page, total_pages, total_rows, array_to_string(turns[(page - 1) * 3 + 1 : page * 3], ',') AS turns FROM (SELECT conv_id, least(greatest((conv_id % 6)::INT - 1, 1), total_pages) AS page, total_pages, total_rows, turns "
    "FROM (SELECT conv_id, greatest(ceil(count(*) / 3.0)::INT, 1) AS total_pages, count(*)::INT AS total_rows, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id))"
)
def paginate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages -1 to 4 of the conversations' turns, by three, held within bounds."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    p = rows.select("conv_id", presentation.paginate(F.col("turns"), (F.col("conv_id") % 6).cast("int") - 1, 3).alias("p"))
    return p.select("conv_id", "p.page", "p.total_pages", "p.total_rows", F.array_join("p.rows", ",").alias("turns"))


@query(
    f"""WITH l AS (SELECT * FROM {X.sql_values([(i, t) for i, t in enumerate(X.LIST_LINES)], "line, text")}),
    m AS (SELECT line, text, CASE lower(text) WHEN 'организации' THEN 'organization' WHEN 'физические лица' THEN 'person' END AS heading FROM l),
    f AS (SELECT *, last_value(heading IGNORE NULLS) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM m)
    SELECT line, text, section FROM f WHERE heading IS NULL AND section IS NOT NULL AND text <> ''"""
)
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sections(X.lines(spark, X.LIST_LINES)).select("line", "text", "section")


@query(f"SELECT * FROM {X.sql_values([('1', 'Title'), ('2', 'Second'), ('3)', 'Third')], 'number, title')}")
def numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-worked lines: the oracle lists the expected rows."""
    return registry.numbered_titles(X.lines(spark, X.TITLE_LINES)).select("number", "title")


@query()
def listed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = registry.import_listed(X.lines(spark, X.LIST_LINES))
    return e.select("id", "name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


@query()
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [latin_registry(spark, sf_dir), X.entities(spark), registry.import_listed(X.lines(spark, X.LIST_LINES)), registry.builtins(spark)]
    m = registry.merge(registry.stacked(parts), _save(spark))
    return m.select("id", "name", "entity_type", F.array_join("statuses", "|").alias("statuses"), F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "; ").alias("sources"))


@query(f"SELECT count(*) AS entity_count, 'benchmark' AS sources FROM ({_LEAD})")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.database_summary(latin_registry(spark, sf_dir))
    return found.select("entity_count", F.array_join("sources", "|").alias("sources"))


@query(
    f"SELECT id, name, row_number() OVER (ORDER BY name, id) AS place, n_merged FROM (SELECT arg_min(id, ord) AS id, arg_min(name, ord) AS name, count(*) AS n_merged FROM ({_LEAD}) GROUP BY lower(name))"
)
def rebuilt_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged works in their order: equal names are one, under the first one's id and name."""
    parts = latin_registry(spark, sf_dir)
    merged = registry.merge(parts, _save(spark))
    sizes = parts.groupBy(T.key(F.col("name")).alias("k")).agg(F.count("*").alias("n_merged"))
    numbered = merged.select("id", "name", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))  # a registry of some hundred works
    return numbered.join(sizes, T.key(F.col("name")) == F.col("k")).select("id", "name", "place", "n_merged")


@query()
def card_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("e1", "Маша Т.", 0), ("e4", "Vetka", 1)], "card_id string, alias string, ord long")
    forms = spark.createDataFrame([("e1", "Тестовой", 0)], "card_id string, form string, ord long")
    off = spark.createDataFrame([("e2", "obshchee imya", 0)], "card_id string, form string, ord long")
    return registry.card_forms(X.entities(spark), aliases, forms, off)


_CARDS = "card_id string, canonical_name string, entity_type string, official_statuses string, manual_statuses string, source_keys string, source_urls string, is_active string, notes string"


_ENTITY_ROWS = [(i, e[0], e[1], e[2], e[3][0], "|".join(e[4])) for i, e in enumerate(X.ENTITIES)]
_ENTITY_VALUES = X.sql_values(_ENTITY_ROWS, "ord, id, name, entity_type, status, aliases")


@query(
    f"WITH e AS (SELECT * FROM {_ENTITY_VALUES}), c AS (SELECT * FROM {X.sql_values([('e1', 'old', 'person', '', 'extremist', '', '', '0', 'n'), ('gone', 'Gone', 'person', '', '', 's', '', '1', '')], 'card_id, canonical_name, entity_type, official_statuses, manual_statuses, source_keys, source_urls, is_active, notes')}) "
    "SELECT coalesce(e.id, card_id) AS card_id, coalesce(name, canonical_name) AS canonical_name, coalesce(e.entity_type, c.entity_type) AS entity_type, coalesce(status, official_statuses) AS official_statuses, "
    "coalesce(manual_statuses, '') AS manual_statuses, CASE WHEN e.id IS NOT NULL THEN 'test' ELSE source_keys END AS source_keys, CASE WHEN e.id IS NOT NULL THEN '' ELSE source_urls END AS source_urls, coalesce(is_active, '1') AS is_active, coalesce(notes, '') AS notes "
    "FROM c FULL OUTER JOIN e ON c.card_id = e.id"
)
def card_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = spark.createDataFrame([("e1", "old", "person", "", "extremist", "", "", "0", "n"), ("gone", "Gone", "person", "", "", "s", "", "1", "")], _CARDS)
    return registry.sync_cards(cards, X.entities(spark))


@query(
    f"WITH e AS (SELECT * FROM {_ENTITY_VALUES}), a AS (SELECT * FROM {X.sql_values([('e1', 'Маша'), ('e9', 'none')], 'card_id, alias')}) "
    "SELECT id, CASE WHEN id = 'e1' THEN status || '|terrorist|extremist' ELSE status END AS statuses, concat_ws('|', nullif(aliases, ''), alias) AS aliases, CASE WHEN id = 'e1' THEN 'note' ELSE '' END AS notes FROM e LEFT JOIN a ON e.id = a.card_id"
)
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = spark.createDataFrame([("e1", "", "", "", "extremist; terrorist", "", "", "1", "note")], _CARDS)
    aliases = spark.createDataFrame([("e1", "Маша", 0), ("e9", "none", 1)], "card_id string, alias string, ord long")
    e = registry.apply_overrides(X.entities(spark), cards, aliases)
    return e.select("id", F.array_join("statuses", "|").alias("statuses"), F.array_join("aliases", "|").alias("aliases"), F.coalesce(F.try_element_at("metadata", F.lit("manual_notes")), F.lit("")).alias("notes"))


_FEW = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|li|tr|td|th|h[1-6]|section|article)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"


_DECODED = "replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query(
    f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY no) - 1)::INT AS line, md5(text) AS digest FROM (SELECT page_id, no, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS text "
    f"FROM (SELECT page_id::VARCHAR AS page_id, unnest(string_split(x, chr(10))) AS l, unnest(range(0, len(string_split(x, chr(10))))) AS no FROM (SELECT page_id, {_DECODED.format(_FEW)} AS x FROM pages))) WHERE text <> ''"
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.html_lines(table(spark, sf_dir, "pages"), "page_id", "html")
    lines = found.select(F.col("file").alias("page_id"), "line", "text")
    before = Window.partitionBy("page_id").orderBy("line")
    return lines.select("page_id", (F.row_number().over(before) - 1).alias("line"), F.md5("text").alias("digest"))


@query("SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"', 1) AS l FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = web.hrefs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


_PATH = r"regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')"
_EXTENSION = r"lower(regexp_extract({0}, '(?:^|/)[^/]*[^/.](\.[^./]+)$', 1))"
_LAST = f"regexp_replace(regexp_extract({_PATH.format('url')}, '([^/]*)/*$', 1), '([^.])\\.[^.]*$', '\\1')"
_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


@query(
    f"""WITH l AS (SELECT page_id, url, unnest(x) AS link, unnest(range(0, len(x))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1) AS x FROM pages)),
    u AS (SELECT page_id, i, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link
      ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/?(?:.*/)?)', 1) || link END AS target FROM l),
    b AS (SELECT page_id, arg_min(target, list_position(['.html', '.xlsx'], ext) * 100000 + i) AS best FROM (SELECT *, {_EXTENSION.format(_PATH.format('target'))} AS ext FROM u) WHERE list_position(['.html', '.xlsx'], ext) > 0 GROUP BY page_id)
    SELECT page_id, {_EXTENSION.format(_PATH.format('url'))} AS extension, left(coalesce(nullif(trim(regexp_replace(coalesce(nullif({_LAST}, ''), nullif({_HOST}, ''), 'download'), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'download'), 80) AS stem, best FROM pages LEFT JOIN b USING (page_id)"""
)
def best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = [".html", ".xlsx"]
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", web.extension(F.col("url")).alias("extension"), web.safe_stem(F.col("url")).alias("stem"), web.best_link(web.hrefs(F.col("html")), F.col("url"), allowed).alias("best"))


_SPACE = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM conversations),
    f AS (SELECT conv_id, turn, text, l, 0 AS i, '' AS cur, []::VARCHAR[] AS done FROM t WHERE length(text) > 200
      UNION ALL SELECT conv_id, turn, text, l, i + 1, CASE WHEN length(j) <= 200 THEN j WHEN length(line) <= 200 THEN line ELSE '' END,
        CASE WHEN length(j) <= 200 THEN done WHEN length(line) <= 200 THEN flushed ELSE list_concat(flushed, [substr(line, k * 200 + 1, 200) for k in range(0, (length(line) - 1) // 200 + 1)]) END
      FROM (SELECT *, l[i + 1] AS line, CASE WHEN cur = '' THEN l[i + 1] ELSE {_SPACE.format("cur || chr(10) || l[i + 1]")} END AS j, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS flushed FROM f WHERE i < len(l))),
    w AS (SELECT conv_id, turn, text, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS c FROM f WHERE i = len(l)
      UNION ALL SELECT conv_id, turn, text, [text] FROM t WHERE length(text) <= 200),
    e AS (SELECT conv_id, turn, unnest(c) AS chunk, unnest(range(0, len(c)))::INT AS no FROM (SELECT conv_id, turn, CASE WHEN len(c) = 0 THEN [left(text, 200)] ELSE c END AS c FROM w))
    SELECT conv_id, turn, no, length(chunk)::INT AS n_chars, md5(chunk) AS digest FROM e"""
)
def split_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(presentation.split_message(F.col("text"), 200)).alias("no", "chunk"))
    return c.select("conv_id", "turn", "no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
#: Marks are single: in runs of underscores none counts, so runs are hidden, and then a mark is any that is left.
_HIDDEN = f"replace(replace({_ESCAPED}, '__', chr(1) || chr(1)), chr(1) || '_', chr(1) || chr(1))"


@query(f"SELECT conv_id, turn, md5(replace(regexp_replace({_HIDDEN}, '_([^_\\n\\x01]+)_', '<i>\\1</i>', 'g'), chr(1), '_')) AS digest FROM conversations")
def message_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(presentation.to_html(F.col("text"))).alias("digest"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each conversation: created, then a click per turn, with idle gaps."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "conv_id", "turn")
    minutes = F.col("turn") * F.when(F.col("conv_id") % 5 == 0, 31).otherwise(3)
    action = F.when(F.col("turn") == 0, "create").when(F.col("turn") == 6, "apply").otherwise(F.when(F.col("conv_id") % 2 == 0, "toggle").otherwise("page"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("c"), i))
    groups = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("g"), (i / 3).cast("int")))
    return turns.select(
        "session_id", (F.col("conv_id") * 100 + F.col("turn")).alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000)) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("at"),
        action.alias("action"), F.col("turn").cast("string").alias("value"), F.lit("text").alias("text"), ids.alias("candidate_ids"), groups.alias("group_ids"),
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i > 0).alias("ambiguous"), F.array(F.lit("c0")).alias("selected"),
    )


@query()
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.replay(session_events(spark, sf_dir)).withColumn("selected", F.array_join("selected", " "))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the fixture texts, marked: the flagship query."""
    return marked_text(spark, sf_dir)
