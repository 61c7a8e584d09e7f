"""Queues and their passes, recorded answers, what a corpus still lacks, families of predicates, states without ids."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.text import ENDINGS, PREFIXES, SUFFIXES
from tessera.operators import golden, planning, predicates, replay
from tessera.scratch import kept
from tessera.sources.bind import frame, table
from tessera.streaming import offers, trigger

_SLOTS = "[date_trunc('day', x) + INTERVAL (h) HOUR FOR h IN [-24, -12, 0, 12, 24, 36]]"
_BEFORE = f"list_max(list_filter({_SLOTS}, lambda s: s <= x))"
_AFTER = f"list_min(list_filter({_SLOTS}, lambda s: s > x))"


@query(f"""
WITH RECURSIVE t AS (
  SELECT event_type AS scope, date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS k FROM events GROUP BY event_type, date_trunc('hour', ts)),
s AS (
  SELECT DISTINCT scope, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS queued, CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS TIMESTAMP) AS x, CAST(NULL AS TIMESTAMP) AS caught, CAST(0 AS BIGINT) AS caught_n, '' AS why, CAST(0 AS BIGINT) AS n FROM t
  UNION ALL
  SELECT scope, k, CASE WHEN why = '' THEN n ELSE 0 END, CASE WHEN why = '' THEN last ELSE x END, x, caught, caught_n, why, n FROM (
    SELECT *, CASE WHEN n >= 30 THEN 'valve' WHEN last IS NULL OR last < {_BEFORE} THEN 'scheduled' ELSE '' END AS why FROM (
      SELECT scope, k, tick AS x, CASE WHEN queued > 0 AND first < tick THEN first END AS caught, queued AS caught_n, CASE WHEN queued > 0 AND first < tick THEN 0 ELSE queued END + n AS n, CASE WHEN queued > 0 AND first < tick THEN first ELSE last END AS last FROM (
        SELECT s.scope, t.k, s.queued, s.last, {_AFTER} AS first, t.tick, t.n FROM s JOIN t ON t.scope = s.scope AND t.k = s.k + 1)))),
r AS (SELECT scope, caught AS ran, 'scheduled' AS reason, caught_n AS n, k, 0 AS o FROM s WHERE caught IS NOT NULL UNION ALL SELECT scope, x, why, n, k, 1 FROM s WHERE why <> '')
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY k, o) - 1 AS seq, strftime(ran, '%Y-%m-%d %H:%M') AS ran, reason, n FROM r""")
def trigger_replay(spark: SparkSession, d: str) -> DataFrame:
    """The passes that the events of each kind would have set off, with a valve of 30 and passes at midnight and noon."""
    runs = trigger.replayed(table(spark, d, "events"), "event_type", "ts")
    return runs.select("scope", "seq", F.date_format("at", "yyyy-MM-dd HH:mm").alias("ran"), "reason", "n")


_WANTED = "(SELECT source, lang, 2 + (length(source) + length(lang)) % 5 AS weight FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents))"


@query(rf"""
WITH c AS (SELECT *, lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS bare FROM documents),
one AS (SELECT source, lang FROM c WHERE bare <> '' QUALIFY row_number() OVER (PARTITION BY sha256(bare) ORDER BY doc_id) = 1),
h AS (SELECT source, lang, count(*) AS have FROM one GROUP BY ALL),
w AS (SELECT source, lang, weight, sum(weight) OVER () AS weights FROM {_WANTED}),
m AS (SELECT w.source, w.lang, coalesce(have, 0) AS have, CAST(floor(CAST(weight AS DOUBLE) / CAST(weights AS DOUBLE) * (SELECT 2 * count(*) FROM one) + 0.5) AS BIGINT) AS want FROM w LEFT JOIN h ON w.source = h.source AND w.lang = h.lang),
l AS (SELECT *, greatest(0, want - have) AS missing, sum(greatest(0, want - have)) OVER () AS total, (SELECT count(*) // 3 FROM one) AS batch FROM m),
q AS (SELECT *, least(batch, total) AS n, CAST(missing * CAST(least(batch, total) AS HUGEINT) // total AS BIGINT) AS whole, missing * CAST(least(batch, total) AS HUGEINT) % total AS rest FROM l),
z AS (SELECT *, row_number() OVER (ORDER BY rest DESC, missing DESC, source, lang) AS place, sum(whole) OVER () AS given FROM q)
SELECT source, lang, have, want, CAST(missing AS BIGINT) AS missing, whole + CASE WHEN place <= n - given AND missing > 0 THEN 1 ELSE 0 END AS quota FROM z""")
def deficit_plan(spark: SparkSession, d: str) -> DataFrame:
    """How a batch of a third of the corpus is shared out over (source, language), for a corpus twice as large with given shares; copies count once."""
    docs = table(spark, d, "documents")
    once = planning.fresh(docs, docs.limit(0), "text", "doc_id")
    cells = ["source", "lang"]
    counts = once.groupBy(*cells).agg(F.count("*").alias("have"))
    n = counts.agg(F.sum("have")).first()[0]
    wanted = docs.select("source").distinct().crossJoin(F.broadcast(docs.select("lang").distinct().limit(1000)))  # names of languages: a bounded list
    weight = (2 + (F.length("source") + F.length("lang")) % 5).cast("double")
    total = wanted.agg(F.sum(weight)).first()[0]
    missing = planning.shares(counts, cells, wanted.withColumn("share", weight / total), 2 * n)
    return planning.apportioned(missing, cells, n // 3)


_BLOCKS = "'Sort the note.' || chr(10) || chr(10) || 'Language: ' || coalesce(lang, '')"
_KEY = f"sha256({_BLOCKS} || chr(10) || '<<<CAPTURE>>>' || chr(10) || coalesce(text, ''))"
_STORE = f"(SELECT {_KEY} AS key, arg_min(source, doc_id) AS answer FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a question of two blocks, in the order of its language, then its id."""
    docs = table(spark, d, "documents").withColumn("blocks", F.array(F.lit("Sort the note."), F.concat(F.lit("Language: "), F.coalesce("lang", F.lit("")))))
    return replay.positioned(docs, ["en", "fr", "es", "de"], "lang", "doc_id").withColumnRenamed("doc_id", "id")


def answer_store(spark: SparkSession, d: str) -> DataFrame:
    """What was answered before: two documents in three, copies under one key."""
    asked = questions(spark, d).filter("id % 3 <> 0").withColumn("key", replay.key(F.col("blocks"), F.col("text")))
    empty = asked.selectExpr("key", "source AS answer", "id AS at").limit(0)
    return replay.recorded(empty, asked.selectExpr("key", "source AS answer", "id AS at"))


@query(f"""
WITH q AS (SELECT doc_id AS id, list_position(['en', 'fr', 'es', 'de'], lang) AS corpus, {_KEY} AS key, n_chars FROM documents)
SELECT id, CAST(coalesce(corpus, 0) AS BIGINT) AS corpus, key, answer, CASE WHEN answer IS NULL THEN 'missing' WHEN n_chars < 200 THEN 'short' ELSE '' END AS gaps FROM q LEFT JOIN {_STORE} USING (key)""")
def replay_run(spark: SparkSession, d: str) -> DataFrame:
    """All questions against recorded answers; a miss is an error row."""
    short = F.when(F.col("n_chars") < 200, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    rows = replay.run(questions(spark, d), answer_store(spark, d), short)
    return rows.select("id", F.col("position.corpus").alias("corpus"), "key", "answer", F.array_join("gaps", ";").alias("gaps"))


@query(f"SELECT {_KEY} AS key, min(doc_id) AS id FROM documents WHERE {_KEY} NOT IN (SELECT key FROM {_STORE}) GROUP BY 1")
def replay_unanswered(spark: SparkSession, d: str) -> DataFrame:
    """What a repeated run asks: each missing key once."""
    asked = questions(spark, d).withColumn("position", F.col("id"))
    return replay.unanswered(asked, answer_store(spark, d)).select("key", F.col("position").alias("id"))


#: A vocabulary of predicates: four tokens a part, now and then with affixes, and some heads with their variants.
_PREDICATE = (
    "CASE WHEN p_partkey % 199 = 0 THEN 'works_at' WHEN p_partkey % 199 = 1 THEN 'is_work_at' WHEN p_partkey % 199 = 2 THEN 'lived_in' WHEN p_partkey % 199 = 3 THEN 'lives_in' "
    "ELSE CASE WHEN p_size % 7 = 0 THEN 'has_' ELSE '' END || lower(p_type) || '_b' || substr(p_brand, 7) || '_k' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) || '_s' || CAST(p_size % 10 AS STRING) END"
)
_FACTS = f"(SELECT {_PREDICATE} AS predicate, CAST(p_size AS STRING) AS entity_id, p_partkey FROM part)"
_SIGNATURE = "predicate"
for _affix in (*(f"^{x}" for x in PREFIXES), *(f"{x}$" for x in SUFFIXES)):
    _SIGNATURE = f"regexp_replace({'trim(lower(predicate))' if _SIGNATURE == 'predicate' else _SIGNATURE}, '{_affix}', '')"
_SIGNATURE = rf"""array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({_SIGNATURE}, '[_\s]+'), lambda t: CASE WHEN t IN ('the', 'a', 'an') THEN '' WHEN length(t) > 4 THEN regexp_replace(t, '({'|'.join(ENDINGS)})$', '') ELSE t END), lambda t: t <> '')), ' ')"""

HEADS = str(predicates.HEADS)


def predicate_facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(f"{_PREDICATE} AS predicate", "CAST(p_size AS STRING) AS entity_id", "p_partkey")


@query(f"""
WITH RECURSIVE v AS (SELECT predicate, count(*) AS n, count(DISTINCT entity_id) AS entities, min(p_partkey) AS id, {_SIGNATURE} AS sig, string_split(predicate, '_') AS t FROM {_FACTS} f GROUP BY ALL),
k AS (SELECT predicate, array_to_string(list_transform(t, lambda x, i: CASE WHEN i = j THEN '?' ELSE x END), '_') AS rest FROM v, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS j) WHERE len(t) >= 3),
e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT v.predicate, e.e FROM v JOIN e ON v.id = e.id),
w AS (
  SELECT a.predicate AS a, b.predicate AS b FROM v a JOIN v b ON a.sig = b.sig AND a.predicate <> b.predicate
  UNION SELECT a.predicate, b.predicate FROM k a JOIN k b ON a.rest = b.rest AND a.predicate <> b.predicate
  UNION SELECT a.predicate, b.predicate FROM c a JOIN c b ON a.predicate <> b.predicate AND round(list_dot_product(a.e, b.e), 6) >= 0.4),
reach AS (SELECT predicate AS a, predicate AS b FROM v UNION SELECT reach.a, w.b FROM reach JOIN w ON reach.b = w.a),
f AS (SELECT a AS predicate, min(b) AS family FROM reach GROUP BY 1),
j AS (SELECT f.*, n, entities, f.predicate IN {HEADS} AS head FROM f JOIN v USING (predicate))
SELECT predicate, family, first_value(predicate) OVER (PARTITION BY family ORDER BY head DESC, CASE WHEN head THEN 0 ELSE -entities END, CASE WHEN head THEN 0 ELSE -n END, predicate) AS canonical, count(*) OVER (PARTITION BY family) AS members FROM j""")
def predicate_families(spark: SparkSession, d: str) -> DataFrame:
    """predicates connected by signature, by one token or by cosine (0.4; a predicate's vector is that of its first part), and the name each family keeps."""
    rows = kept(predicates.vocabulary(predicate_facts(spark, d), F.min("p_partkey").alias("id")))
    vectors = frame(spark, d, "vectors").join(rows.select("id", "predicate"), "id")
    return predicates.families(rows, vectors=vectors, floor=0.4)


#: Two states of the same orders: their ids are random, one line's price differs, and one order is gone from the second.
STATE = {
    "customer": golden.Table("id", "C", ["name"], moments=["seen"]),
    "orders": golden.Table("id", "O", ["customer", "day", "priority"], {"customer": "customer", "before": "orders"}),
    "lineitem": golden.Table(None, "", [], {"order": "orders"}, ["shipped"]),
}


def state_of(spark: SparkSession, d: str, seed: str) -> dict[str, DataFrame]:
    """The state with ids made from a seed: what is stored does not depend on them."""
    uid = lambda c: F.md5(F.concat(F.lit(seed), c.cast("string")))
    b = seed == "b"
    customer = table(spark, d, "customer").select(uid(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") > 0, F.current_timestamp()).alias("seen"))
    o = table(spark, d, "orders").filter("o_orderkey <> 77" if b else "true")
    orders = o.select(uid(F.col("o_orderkey")).alias("id"), uid(F.col("o_custkey")).alias("customer"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), F.when(F.col("o_orderkey") % 5 == 0, uid(F.col("o_orderkey") - 5)).alias("before"))
    price = F.when((F.col("l_orderkey") % 997 == 3) & F.lit(b), F.col("l_extendedprice") + 0.5).otherwise(F.col("l_extendedprice"))
    lines = table(spark, d, "lineitem").select(uid(F.col("l_orderkey")).alias("order"), F.col("l_linenumber").alias("line"), price.alias("price"), F.col("l_shipdate").alias("shipped"))
    return {"customer": customer, "orders": orders, "lineitem": lines.repartition(7) if b else lines}


def _state_sql(n: str, b: bool) -> str:
    """CTEs c, o, l of a normalised state, named with a suffix."""
    price = "CASE WHEN l_orderkey % 997 = 3 THEN l_extendedprice + 0.5 ELSE l_extendedprice END" if b else "l_extendedprice"
    dec = lambda x: f"CAST({x} AS DECIMAL(38,6))"
    return f"""c{n} AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_name, {dec('c_acctbal')}, c_acctbal > 0) AS i, c_name, {dec('c_acctbal')} AS balance, c_acctbal > 0 AS seen FROM customer),
o{n} AS (SELECT o_orderkey AS k, c{n}.i AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority, {dec('o_totalprice')} AS total, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 5 END AS before FROM orders JOIN c{n} ON o_custkey = c{n}.k {'WHERE o_orderkey <> 77' if b else ''}),
p{n} AS (SELECT *, row_number() OVER (ORDER BY c, day, priority, total) AS i FROM o{n}),
l{n} AS (SELECT p{n}.i AS o, l_linenumber AS line, {dec(price)} AS price, l_shipdate IS NOT NULL AS shipped FROM lineitem LEFT JOIN p{n} ON l_orderkey = p{n}.k)"""


@query(f"WITH {_state_sql('', False)} SELECT 'O' || p.i AS id, 'C' || p.c AS customer, p.day, p.priority, p.total, 'O' || b.i AS before FROM p LEFT JOIN p b ON p.before = b.k")
def golden_orders(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a normalised state, with tokens for ids handed along two references, one of them to an earlier order."""
    return golden.normalised(state_of(spark, d, "a"), STATE)["orders"]


def _rows_sql(n: str) -> str:
    text = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
    return f"""r{n} AS (
  SELECT 'customer' AS "table", '{{"balance":' || balance || ',"id":"C' || i || '","name":"' || c_name || '","seen":' || seen || '}}' AS row FROM c{n}
  UNION ALL SELECT 'orders', '{{"before":' || {text("'O' || b.i")} || ',"customer":"C' || p.c || '","day":"' || p.day || '","id":"O' || p.i || '","priority":"' || p.priority || '","total":' || p.total || '}}' FROM p{n} p LEFT JOIN p{n} b ON p.before = b.k
  UNION ALL SELECT 'lineitem', '{{"line":' || line || ',"order":' || {text("'O' || o")} || ',"price":' || price || ',"shipped":' || shipped || '}}' FROM l{n})"""


@query(f"""
WITH {_state_sql('1', False)}, {_state_sql('2', True)}, {_rows_sql('1')}, {_rows_sql('2')},
s AS (SELECT *, 'left' AS side FROM (SELECT * FROM r1 EXCEPT ALL SELECT * FROM r2) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r2 EXCEPT ALL SELECT * FROM r1)),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY "table", side ORDER BY row) AS INT) AS place FROM s)
SELECT "table", side, place, row FROM z WHERE place <= 3""")
def golden_differences(spark: SparkSession, d: str) -> DataFrame:
    """The first three rows a table and side in which two states differ; their random ids and their row order do not count."""
    return golden.differences(*(golden.normalised(state_of(spark, d, seed), STATE) for seed in ("a", "b")))


@query(f"""
WITH {_state_sql('1', False)}, {_rows_sql('1')}
SELECT "table", count(*) AS n, CAST(sum(CAST(('0x' || substring(sha256(row), 1, 12)) AS BIGINT)) AS DECIMAL(38,0)) AS hash FROM r1 GROUP BY 1""")
def golden_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One number a table of a normalised state, the same for any ids."""
    return golden.fingerprint(golden.normalised(state_of(spark, d, "c"), STATE))


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, event_type = 'signup' AS offered, ts FROM events WHERE event_type IN ('signup', 'purchase')),
w AS (SELECT *, last_value(CASE WHEN offered THEN id END IGNORE NULLS) OVER o AS oid, last_value(CASE WHEN offered THEN ts END IGNORE NULLS) OVER o AS ots, lead(ts) OVER (PARTITION BY key, offered ORDER BY ts, id) AS newer
      FROM e WINDOW o AS (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT key, id, oid, coalesce(ts <= ots + INTERVAL 36 HOUR, FALSE) AS fits, ts FROM w WHERE NOT offered),
t AS (SELECT *, fits AND row_number() OVER (PARTITION BY key, oid, fits ORDER BY ts, id) = 1 AS taken FROM a),
l AS (SELECT key, id AS offer, CASE WHEN newer <= ts + INTERVAL 36 HOUR THEN 'replaced' WHEN ts + INTERVAL 36 HOUR < TIMESTAMP '2024-01-29 12:00:00' THEN 'expired' END AS outcome FROM w WHERE offered AND NOT EXISTS (SELECT 1 FROM t WHERE t.key = w.key AND t.oid = w.id AND t.taken))
SELECT key, id, CASE WHEN taken THEN oid END AS offer, CASE WHEN taken THEN 'taken' ELSE 'refused' END AS outcome FROM t UNION ALL SELECT key, NULL, offer, outcome FROM l WHERE outcome IS NOT NULL""")
def offer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A signup is an offer open for a day and a half, a purchase takes it; what became of each at a given moment."""
    e = table(spark, d, "events").filter("event_type in ('signup', 'purchase')")
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), (F.col("event_type") == "signup").alias("offered"), F.col("ts").alias("at"))
    return offers.outcomes(rows, timedelta(hours=36), "2024-01-29 12:00:00")
