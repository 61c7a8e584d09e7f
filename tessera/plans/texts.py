"""Text, hash and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as x
from tessera.sources.bind import table

FOLD = f"translate(text, '{x.ACCENTED}', '{x.PLAIN}')"
TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"


@query(r"SELECT page_id AS id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), x.html_title(F.col("html")).alias("title"))


_STRIP = "html"
for _b in ("script", "style", "nav", "head", "noscript"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?is)<{_b}\b.*?</{_b}>', ' ', 'g')"
_STRIP = rf"regexp_replace({_STRIP}, '(?s)<[^>]*>', ' ', 'g')"
for _e, _s in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_s}')"


@query(rf"SELECT page_id AS id, trim(regexp_replace({_STRIP}, '\s+', ' ', 'g')) AS body FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), x.html_text(F.col("html")).alias("body"))


@query(r"""SELECT id, array_to_string(list_filter(u, lambda v, i: list_position(u, v) = i), ' ') AS urls FROM (
SELECT page_id AS id, list_transform(regexp_extract_all(html, '(https?://[^\s<>"'']+)', 1), lambda v: regexp_replace(v, '[.,;:!?)]+$', '')) AS u FROM pages)""")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    """C01."""
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array_join(x.urls(F.col("html")), " ").alias("urls"))


@query(rf"SELECT doc_id AS id, trim(regexp_replace(lower({FOLD}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    """C05, C06."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), x.slug(F.col("text")).alias("slug"))


@query(rf"SELECT doc_id AS id, CAST(len({TOK}) AS BIGINT) AS words, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_])({"|".join(x.ABBREVIATIONS)})\.', '\1\2', 'g'), '[.!?]+(\s|$)', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS BIGINT) AS sentences FROM documents")
def sentence_and_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), x.word_count(F.col("text")).alias("words"), x.sentence_count(F.col("text")).alias("sentences"))


_WORDS = "regexp_extract_all(lower(text), '[" + x.LETTERS.replace("'", "''") + "]+')"
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)


@query(f"SELECT id, CASE WHEN fr > en THEN 'fr' WHEN en > fr THEN 'en' ELSE 'undecided' END AS guess FROM (SELECT doc_id AS id, len(list_filter({_WORDS}, lambda t: t IN ({_IN(x.FRENCH)}))) AS fr, len(list_filter({_WORDS}, lambda t: t IN ({_IN(x.ENGLISH)}))) AS en FROM documents)")
def lang_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), x.language_guess(F.col("text")).alias("guess"))


@query(f"WITH g AS (SELECT lang, CASE WHEN fr > en THEN 'fr' WHEN en > fr THEN 'en' ELSE 'undecided' END AS guess FROM (SELECT lang, len(list_filter({_WORDS}, lambda t: t IN ({_IN(x.FRENCH)}))) AS fr, len(list_filter({_WORDS}, lambda t: t IN ({_IN(x.ENGLISH)}))) AS en FROM documents)) SELECT lang, count(*) AS n, count(*) FILTER (lang = guess) AS hit, CAST(greatest(0, 200 - count(*)) AS BIGINT) AS deficit FROM g GROUP BY lang")
def language_mix(spark: SparkSession, d: str) -> DataFrame:
    """Languages, how many the guess hits, and what is missing to a target of 200."""
    g = table(spark, d, "documents").select("lang", x.language_guess(F.col("text")).alias("guess"))
    return g.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("guess")).alias("hit"), F.greatest(F.lit(0).cast("long"), 200 - F.count("*")).alias("deficit"))


@query("SELECT doc_id AS id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(ltrim(l), '#')), chr(10)) AS body FROM documents")
def headings_removed(spark: SparkSession, d: str) -> DataFrame:
    """C11."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), x.without_headings(F.col("text")).alias("body"))


ANSWER = "CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN '  ' || props || chr(10) WHEN 2 THEN '```' || chr(10) || props WHEN 3 THEN 'no object' ELSE substring(props, 1, 3) END"


@query("""SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 < 3 THEN props END AS payload FROM events""")
def answer_payload(spark: SparkSession, d: str) -> DataFrame:
    """Fenced, bare, unclosed, cut-off and plain answers."""
    stop = F.expr("CASE WHEN event_id % 7 = 0 THEN 'max_tokens' ELSE 'end_turn' END")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), x.fenced_json(F.expr(ANSWER), stop).alias("payload"))


@query(r"""SELECT min(doc_id) AS id, count(*) AS copies, sha256(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS key FROM documents GROUP BY 3""")
def dedup_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Texts equal but for case and signs."""
    key = F.sha2(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")), 256).alias("key")
    return table(spark, d, "documents").groupBy(key).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))


@query("""SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN starts_with(text, '#') THEN 'heading' END, CASE WHEN contains(lower(text), 'licensed') THEN 'license' END, CASE WHEN regexp_matches(text, '\\b[A-Z]{2,5}-[0-9]+\\b') THEN 'ticket' END, CASE WHEN regexp_matches(text, '!!') THEN 'shout' END], lambda v: v IS NOT NULL), ',') AS violations FROM documents""".replace("\\\\", "\\"))
def prose_checks(spark: SparkSession, d: str) -> DataFrame:
    """Violated rules as a list."""
    text = F.col("text")
    rules = [
        F.when(F.length(text) < 200, "short"),
        F.when(text.startswith("#"), "heading"),
        F.when(F.lower(text).contains("licensed"), "license"),
        F.when(text.rlike(r"(?<![0-9A-Za-z_])[A-Z]{2,5}-[0-9]+(?![0-9A-Za-z_])"), "ticket"),
        F.when(text.rlike("!!"), "shout"),
    ]
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.array_compact(F.array(*rules)), ",").alias("violations"))


@query("SELECT c_custkey AS id, CASE WHEN lower(trim(v)) IN ('', 'null', 'none') THEN NULL ELSE v END AS value, 'Name: ' || c_name || chr(10) || 'Type: ' || c_mktsegment || chr(10) || 'Balance: ' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) AS card FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN ' None ' WHEN 1 THEN '' WHEN 2 THEN 'NULL' ELSE c_name END AS v FROM (SELECT c_custkey, c_name, c_mktsegment, trunc(c_acctbal) AS c_acctbal FROM customer))")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """Nullable text, and the lines an entity is embedded by."""
    c = table(spark, d, "customer").withColumn("v", F.expr("CASE c_custkey % 4 WHEN 0 THEN ' None ' WHEN 1 THEN '' WHEN 2 THEN 'NULL' ELSE c_name END"))
    card = F.concat_ws("\n", F.concat(F.lit("Name: "), "c_name"), F.concat(F.lit("Type: "), "c_mktsegment"), F.concat(F.lit("Balance: "), F.col("c_acctbal").cast("long").cast("string")))
    return c.select(F.col("c_custkey").alias("id"), x.nullable_text(F.col("v")).alias("value"), card.alias("card"))


@query("SELECT n_regionkey AS id, sha1(string_agg(n_name, '|' ORDER BY n_name)) AS signature, substring(sha256(string_agg(n_name, '|' ORDER BY n_name)), 1, 12) AS short FROM nation GROUP BY 1")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Order-free signatures of a group's names."""
    names = F.array_join(F.array_sort(F.collect_list("n_name")), "|")  # a region's nations
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(names.alias("names"))
    return g.select("id", F.sha1("names").alias("signature"), F.substring(F.sha2("names", 256), 1, 12).alias("short"))


@query("SELECT doc_id AS id, sha256(lang || chr(30) || source || chr(30) || text) AS key, to_base64(encode(substring(text, 1, 30))) AS head FROM documents")
def replay_keys(spark: SparkSession, d: str) -> DataFrame:
    """H03, H07."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("\x1e", "lang", "source", "text"), 256).alias("key"), F.base64(F.substring("text", 1, 30).cast("binary")).alias("head"))


@query("""SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"type":"' || event_type || '"}' AS canonical FROM events""")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    """Decode with a default, test a key, write with sorted keys."""
    m = F.from_json("props", "map<string,long>")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.coalesce(m, F.create_map().cast("map<string,bigint>")).alias("m"))
    return e.select("id", F.col("m")["k"].alias("k"), F.map_contains_key("m", "k").alias("has_k"), F.to_json(F.struct(F.col("m")["k"].alias("k"), F.col("event_type").alias("type"))).alias("canonical"))
