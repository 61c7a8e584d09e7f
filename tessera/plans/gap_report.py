"""E01-E03 over cases and answers made from orders: what an answer says is an order's lines, what a case asserts is another part's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import evaluation, gaps
from tessera.sources.bind import table

_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
#: JSON pieces of an answer, one a line, in text that both engines read: (condition, piece).
_LINE = {
    "memories": (
        "l_quantity > 10",
        "'{\"note\":\"' || p_name || ' ' || l_linestatus || '\",\"kind\":\"' || CASE l_returnflag WHEN 'A' THEN 'task' WHEN 'N' THEN 'event' ELSE 'episode' END || '\",\"owner\":' || CASE WHEN l_linestatus = 'F' THEN '\"' || c_mktsegment || '\"' ELSE 'null' END"
        f" || ',\"event_date\":' || CASE WHEN l_tax > 0.03 THEN '\"' || {_DAY} || '\"' ELSE 'null' END || ',\"event_recurring\":' || CASE WHEN l_discount > 0.07 THEN 'true' ELSE 'false' END || '}}'",
    ),
    "entities": (
        "l_quantity > 5",
        "'{\"canonical_name\":\"' || p_name || '\",\"aliases\":[\"' || p_brand || '\"],\"type\":\"' || lower(p_type) || '\"' || CASE WHEN p_size > 40 THEN ',\"type_proposal\":\"gadget\"' ELSE '' END || CASE WHEN p_size % 10 = 0 THEN ',\"renamed_to\":\"' || p_brand || ' plus\"' ELSE '' END"
        f" || ',\"facts\":[' || CASE WHEN l_quantity > 25 THEN '{{\"predicate\":\"ships_on\",\"value\":\"' || {_DAY} || '\",\"persistence_value\":' || CAST(p_size % 5 + 1 AS STRING) || ',\"evidence_strength\":\"' || CASE l_returnflag WHEN 'A' THEN 'hedged' WHEN 'N' THEN 'implicit' ELSE 'explicit' END || '\"}}' ELSE '' END || ']}}'",
    ),
    "relations": ("l_discount > 0.04", "'{\"from\":\"' || c_mktsegment || '\",\"to\":\"' || p_name || '\",\"predicate\":\"Ordered_' || lower(l_returnflag) || '\",\"confidence\":' || CASE WHEN l_discount > 0.06 THEN '0.9' ELSE '0.5' END || '}'"),
    "resources": ("l_tax > 0.05", "'{\"url\":\"https://shop.example/' || CAST(l_partkey % 20 AS STRING) || '\",\"entity_canonical\":\"' || p_name || '\",\"user_comment\":\"' || CASE WHEN p_size > 25 THEN 'from ' || p_brand ELSE '' END || '\"}'"),
    "obsoleted_facts": ("l_quantity < 6", f"'{{\"predicate\":\"ships_on\",\"value\":\"' || {_DAY} || '\"}}'"),
}
_HEAD = "'{\"language\":\"' || CASE o_orderpriority WHEN '5-LOW' THEN 'FR-fr' WHEN '1-URGENT' THEN 'null' ELSE 'en' END || '\",\"classification_confidence\":' || CASE WHEN o_totalprice > 200000 THEN '0.95' ELSE '0.6' END || CASE WHEN o_orderkey % 6 = 0 THEN ',\"cancels_action\":\"the ' || lower(c_mktsegment) || ' order\"' ELSE '' END || ',\"project_entries\":[' || CASE WHEN o_orderstatus = 'O' THEN '\"x\"' ELSE '' END || ']'"
#: What a case asserts: (asserted where, value). e_*: the part that the case speaks of.
_ASSERTED = {
    "drop_guard": ("o_orderkey % 2 = 0", "'true'"), "note": ("o_orderkey % 3 = 0", "CASE WHEN o_orderkey % 9 = 0 THEN 'false' ELSE 'true' END"), "kind": ("o_orderkey % 4 = 1", "'\"task\"'"), "memories": ("o_orderkey % 5 = 0", "CAST(o_orderkey % 4 AS STRING)"),
    "owner": ("o_orderkey % 4 = 2", "CASE WHEN o_orderkey % 8 = 2 THEN 'null' ELSE '\"BUILDING\"' END"), "recurring": ("o_orderkey % 5 = 1", "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END"), "event_date": ("o_orderkey % 5 = 2", "CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '\"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '\"' END"),
    "language": ("o_orderkey % 3 = 1", "CASE WHEN o_orderkey % 6 = 1 THEN 'null' ELSE '\"en\"' END"), "needs_review": ("o_orderkey % 3 = 2", "CASE WHEN o_orderkey % 6 = 2 THEN 'true' ELSE 'false' END"), "rel": ("o_orderkey % 7 = 0", "CASE WHEN o_orderkey % 2 = 0 THEN '\"ordered_a|ordered_n\"' ELSE '[\"ordered_r\",\"sold\"]' END"),
    "facts_on": ("o_orderkey % 7 = 1", "'{\"' || e_name || '\":1}'"), "relation_proposed": ("o_orderkey % 7 = 2", "'\"ordered_r\"'"), "proj": ("o_orderkey % 7 = 3", "'true'"), "facts_min": ("o_orderkey % 7 = 4", "'3'"), "entity_expected": ("o_orderkey % 7 = 5", "'[\"' || e_name || '\",\"' || upper(e_brand) || '\"]'"),
    "resource_url": ("o_orderkey % 8 < 3", "'\"https://shop.example/' || CAST(o_orderkey % 20 AS STRING) || '\"'"), "resource_owner_type": ("o_orderkey % 8 = 1", "'\"economy\"'"), "resource_comment": ("o_orderkey % 8 IN (0, 2)", "CASE WHEN o_orderkey % 8 = 2 THEN 'null' ELSE '\"' || lower(e_brand) || '\"' END"), "entity_proposed": ("o_orderkey % 7 = 6", "'\"' || e_name || '\"'"),
    "fact_proposed": ("o_orderkey % 9 = 1", "'\"' || e_name || ':ships\"'"), "fact_asserted": ("o_orderkey % 9 = 2", "'\"' || e_brand || ':ships_on\"'"), "type_proposal": ("o_orderkey % 9 = 3", "'\"' || e_name || '\"'"), "no_type_proposal": ("o_orderkey % 9 = 4", "'true'"), "no_entity": ("o_orderkey % 9 = 5", "'\"' || e_name || '\"'"),
    "forbidden_value": ("o_orderkey % 9 = 6", "'\"-' || lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0') || '-\"'"), "text": ("o_orderkey % 9 = 6", "CASE WHEN o_orderkey % 2 = 0 THEN '\"on the 3rd\"' ELSE '\"in July\"' END"), "renamed_to": ("o_orderkey % 9 = 7", "'\"' || e_brand || ' Plus\"'"), "no_rename": ("o_orderkey % 9 = 8", "'true'"),
    "obsoletes": ("o_orderkey % 10 < 2", "'\"ships_on' || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '=' || CAST(CAST(o_orderdate AS DATE) AS STRING) END || '\"'"), "no_obsolete": ("o_orderkey % 10 = 2", "'true'"), "cancels": ("o_orderkey % 10 IN (3, 6)", "'\"' || CASE WHEN o_orderkey % 20 < 10 THEN 'order' ELSE 'machinery' END || '\"'"), "no_cancel": ("o_orderkey % 10 = 4", "'true'"),
    "forbidden_predicate": ("o_orderkey % 10 = 5", "'\"SHIPS\"'"),
}
_BODY = "'{\"id\":' || CAST(o_orderkey AS STRING) || " + " || ".join(f"CASE WHEN {c} THEN ',\"{k}\":' || {v} ELSE '' END" for k, (c, v) in _ASSERTED.items()) + " || '}'"
TODAY = "1998-01-01"


def cases(spark: SparkSession, d: str) -> DataFrame:
    """id, body, answer: a row an order that has lines."""
    part = table(spark, d, "part")
    other = part.selectExpr("p_partkey AS e_key", "p_name AS e_name", "p_brand AS e_brand").filter("e_key < 60")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(other, F.expr("o_orderkey % 60 = e_key"))
    heads = o.selectExpr("o_orderkey", "c_mktsegment", f"{_HEAD} AS head", f"{_BODY} AS body")
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(heads.select("o_orderkey", "c_mktsegment"), F.col("l_orderkey") == F.col("o_orderkey"))
    piece = F.struct("l_linenumber", "l_partkey", *[F.when(F.expr(c), F.expr(x)).alias(k) for k, (c, x) in _LINE.items()])
    of_order = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(piece)).alias("lines"))  # an order's lines
    listed = [F.concat(F.lit(f',"{k}":['), F.array_join(F.col("lines").getField(k), ","), F.lit("]")) for k in _LINE]
    answer = F.when(F.col("o_orderkey") % 101 == 0, "{}").otherwise(F.concat("head", *listed, F.lit("}")))
    return heads.join(of_order, "o_orderkey").select(F.col("o_orderkey").alias("id"), "body", answer.alias("answer"))


CASES = (
    "SELECT o_orderkey AS id, any_value(body) AS body, CASE WHEN o_orderkey % 101 = 0 THEN '{}' ELSE any_value(head) || "
    + " || ".join(f"',\"{k}\":[' || coalesce(string_agg(CASE WHEN {c} THEN {x} END, ',' ORDER BY l_linenumber, l_partkey), '') || ']'" for k, (c, x) in _LINE.items())
    + f" || '}}' END AS answer FROM (SELECT *, {_HEAD} AS head, {_BODY} AS body FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT p_partkey AS e_key, p_name AS e_name, p_brand AS e_brand FROM part WHERE p_partkey < 60) ON o_orderkey % 60 = e_key) JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey"
)
SCHEMA = '{"language":"VARCHAR","classification_confidence":"DOUBLE","cancels_action":"VARCHAR","memories":[{"note":"VARCHAR","kind":"VARCHAR","owner":"VARCHAR","event_date":"VARCHAR","event_recurring":"BOOLEAN"}],"entities":[{"canonical_name":"VARCHAR","aliases":["VARCHAR"],"type":"VARCHAR","type_proposal":"VARCHAR","renamed_to":"VARCHAR","facts":[{"predicate":"VARCHAR","value":"VARCHAR","persistence_value":"INTEGER","evidence_strength":"VARCHAR"}]}],"relations":[{"from":"VARCHAR","to":"VARCHAR","predicate":"VARCHAR","confidence":"DOUBLE"}],"project_entries":["VARCHAR"],"resources":[{"url":"VARCHAR","entity_canonical":"VARCHAR","user_comment":"VARCHAR"}],"obsoleted_facts":[{"predicate":"VARCHAR","value":"VARCHAR"}]}'


def _sql() -> str:
    """The rules once more, over DuckDB's lists."""
    t = lambda k: f"(body ->> '$.{k}')"
    has = lambda k: f"json_exists(body, '$.{k}')"
    some = lambda xs, v, cond: f"(len(list_filter({xs}, lambda {v}: {cond})) > 0)"
    named = lambda name: f"list_filter(ents, lambda e: lower(e.canonical_name) = lower({name}) OR list_contains(list_transform(e.aliases, lambda b: lower(b)), lower({name})))"
    link = "list_filter(rels, lambda r: contains(lower(r.predicate), 'ordered_r'))"
    goes = lambda k: f"""(SELECT CASE WHEN f IS NULL THEN 'absent' ELSE CASE WHEN c > 0.85 THEN 'facts' WHEN c >= 0.5 THEN 'pending' ELSE 'review' END END FROM (SELECT f, round(least(1, greatest(0, CASE WHEN f.evidence_strength = 'hedged' THEN least(0.84, raw) ELSE raw END)), 4) AS c FROM (SELECT f, CASE f.evidence_strength WHEN 'hedged' THEN 0.65 WHEN 'implicit' THEN 0.4 ELSE 0.92 END + 0.02 + CASE f.persistence_value WHEN 5 THEN 0.2 WHEN 4 THEN 0.15 WHEN 3 THEN 0.05 WHEN 1 THEN -0.1 ELSE 0 END AS raw FROM (SELECT list_filter(flatten(list_transform({named(f"split_part({t(k)}, ':', 1)")}, lambda e: e.facts)), lambda f: contains(f.predicate, split_part({t(k)}, ':', 2)))[1] AS f))))"""
    born = f"""CASE WHEN len({named(t('entity_proposed'))}) = 0 THEN 'absent'
      WHEN {some('rels', 'r', f"lower(r.to) = lower({t('entity_proposed')}) OR lower(r.\"from\") = lower({t('entity_proposed')})")} OR {some('ress', 'r', f"lower(r.entity_canonical) = lower({t('entity_proposed')})")} THEN 'created'
      WHEN len({named(t('entity_proposed'))}[1].facts) = 1 AND {named(t('entity_proposed'))}[1].facts[1].persistence_value >= 4 THEN 'created' WHEN len(mem) > 0 THEN 'proposed' ELSE 'ignored' END"""
    kind = "CASE WHEN len(mem) > 0 THEN mem[1].kind WHEN a.cancels_action IS NOT NULL THEN 'note' END"
    past, future = "f.value::DATE - INTERVAL 1 MONTH", "f.value::DATE + INTERVAL 1 MONTH"
    snapped = f"CASE WHEN contains({t('text')}, 'July') THEN f.value WHEN kind = 'episode' AND f.value > '{TODAY}' AND day({past}) = day(f.value::DATE) THEN strftime({past}, '%Y-%m-%d') WHEN kind IN ('event', 'task') AND f.value <= '{TODAY}' AND day({future}) = day(f.value::DATE) THEN strftime({future}, '%Y-%m-%d') ELSE f.value END"
    res = f"list_filter(ress, lambda r: r.url = {t('resource_url')})[1]"
    typed = f"list_filter(ents, lambda e: lower(e.canonical_name) = lower({t('type_proposal')}))"
    one = lambda name, asked, bad: f"CASE WHEN {asked} AND {bad} THEN ['{name}'] ELSE [] END"
    parts = [
        one("drop_guard", has("drop_guard"), "NOT (note OR len(projs) > 0 OR durable > 0)"),
        one("note", has("note"), f"note <> CAST({t('note')} AS BOOLEAN)"),
        one("kind", f"{has('kind')} AND note", f"NOT (CASE WHEN len(mem) > 0 THEN {some('mem', 'm', f'm.kind = {t('kind')}')} ELSE {t('kind')} = 'note' END)"),
        one("memories", has("memories"), f"len(mem) <> CAST({t('memories')} AS BIGINT)"),
        one("owner", has("owner"), f"NOT (CASE WHEN len(mem) = 0 THEN {t('owner')} IS NULL ELSE {some('mem', 'm', f'm.owner IS NOT DISTINCT FROM {t('owner')}')} END)"),
        one("recurring", has("recurring"), f"NOT (CASE WHEN len(mem) = 0 THEN NOT CAST({t('recurring')} AS BOOLEAN) ELSE {some('mem', 'm', f'm.event_recurring = CAST({t('recurring')} AS BOOLEAN)')} END)"),
        one("event_date: dated", f"{has('event_date')} AND {t('event_date')} IS NULL", some("mem", "m", "m.event_date IS NOT NULL")),
        one("event_date", f"{t('event_date')} IS NOT NULL", f"NOT {some('mem', 'm', f'coalesce(m.event_date = {t('event_date')}, FALSE)')}"),
        one("language", has("language"), f"left(lower(nullif(a.language, 'null')), 2) IS DISTINCT FROM {t('language')}"),
        one("needs_review", has("needs_review"), f"(a.classification_confidence < 0.7 OR (len(mem) = 0 AND a.cancels_action IS NULL AND durable + len(projs) + len(ress) + len(obs) = 0)) <> CAST({t('needs_review')} AS BOOLEAN)"),
        f"CASE WHEN {has('rel')} THEN CASE WHEN json_type(body, '$.rel') = 'ARRAY' THEN list_concat(CASE WHEN {some('rels', 'r', "r.predicate = 'Ordered_r'")} THEN [] ELSE ['rel ordered_r'] END, ['rel sold']) WHEN {some('rels', 'r', "r.predicate IN ('Ordered_a', 'Ordered_n')")} THEN [] ELSE ['rel ' || {t('rel')}] END ELSE [] END",
        f"CASE WHEN {has('facts_on')} AND len(flatten(list_transform(list_filter(ents, lambda e: lower(e.canonical_name) = lower(json_keys(body, '$.facts_on')[1])), lambda e: e.facts))) < 1 THEN ['facts_on ' || json_keys(body, '$.facts_on')[1]] ELSE [] END",
        one("relation_proposed: absent ordered_r", has("relation_proposed"), f"len({link}) = 0"),
        one("relation_proposed: certain ordered_r", has("relation_proposed"), f"coalesce({link}[1].confidence >= 0.7, FALSE)"),
        one("proj", has("proj"), "len(projs) = 0"),
        one("facts_min", has("facts_min"), "durable < 3"),
        f"CASE WHEN {has('entity_expected')} THEN list_transform(list_filter(CAST(body -> '$.entity_expected' AS VARCHAR[]), lambda w: NOT list_contains(names, lower(w))), lambda w: 'entity_expected ' || w) ELSE [] END",
        one("resource_url", has("resource_url"), f"{res} IS NULL"),
        one("resource_owner_type", f"{has('resource_owner_type')} AND {res} IS NOT NULL", f"coalesce(lower(list_filter(ents, lambda e: e.canonical_name = {res}.entity_canonical)[1].type), '') <> {t('resource_owner_type')}"),
        one("resource_comment: extra", f"{has('resource_comment')} AND {t('resource_comment')} IS NULL AND {res} IS NOT NULL", f"{res}.user_comment <> ''"),
        one("resource_comment: lost", f"{t('resource_comment')} IS NOT NULL AND {res} IS NOT NULL", f"NOT contains(lower({res}.user_comment), {t('resource_comment')})"),
        f"CASE WHEN {has('entity_proposed')} AND {born} <> 'proposed' THEN ['entity_proposed ' || {t('entity_proposed')}] ELSE [] END",
        one("fact_proposed", has("fact_proposed"), f"{goes('fact_proposed')} <> 'pending'"),
        one("fact_asserted", has("fact_asserted"), f"{goes('fact_asserted')} <> 'facts'"),
        one("type_proposal: absent", has("type_proposal"), f"len({typed}) = 0"),
        one("type_proposal: asserted", f"{has('type_proposal')} AND len({typed}) > 0", f"{typed}[-1].type_proposal IS NULL"),
        one("no_type_proposal", has("no_type_proposal"), some("ents", "e", "e.type_proposal IS NOT NULL")),
        f"CASE WHEN {has('no_entity')} AND list_contains(names, lower({t('no_entity')})) THEN ['no_entity ' || {t('no_entity')}] ELSE [] END",
        one("forbidden_value", has("forbidden_value"), some("facts", "f", f"contains({snapped}, {t('forbidden_value')})")),
        one("renamed_to", has("renamed_to"), f"NOT {some('ents', 'e', f"coalesce(lower(e.renamed_to), '') = lower({t('renamed_to')})")}"),
        one("no_rename", has("no_rename"), some("ents", "e", "e.renamed_to IS NOT NULL")),
        one("obsoletes", has("obsoletes"), f"NOT {some('obs', 'o', f"split_part({t('obsoletes')}, '=', 2) IN ('', o.value)")}"),
        one("no_obsolete", has("no_obsolete"), "len(obs) > 0"),
        one("cancels: unnamed", has("cancels"), "a.cancels_action IS NULL"),
        one("cancels: other", f"{has('cancels')} AND a.cancels_action IS NOT NULL", f"NOT contains(a.cancels_action, {t('cancels')})"),
        one("no_cancel", has("no_cancel"), "a.cancels_action IS NOT NULL"),
        one("forbidden_predicate", has("forbidden_predicate"), "len(facts) > 0"),
    ]
    return f"""
WITH c AS ({CASES}), p AS (SELECT *, from_json(answer, '{SCHEMA}') AS a FROM c),
l AS (SELECT id, body, answer, a, coalesce(a.memories, []) AS ms, coalesce(a.entities, []) AS ents, coalesce(a.relations, []) AS rels, coalesce(a.resources, []) AS ress, coalesce(a.obsoleted_facts, []) AS obs, coalesce(a.project_entries, []) AS projs FROM p),
m AS (SELECT *, list_filter(ms, lambda x, i: len(list_filter(ms[1 : i - 1], lambda y: lower(y.note) = lower(x.note))) = 0) AS mem, flatten(list_transform(ents, lambda e: e.facts)) AS facts, list_concat(list_transform(ents, lambda e: lower(e.canonical_name)), flatten(list_transform(ents, lambda e: list_transform(e.aliases, lambda b: lower(b))))) AS names FROM l),
n AS (SELECT *, len(mem) > 0 OR a.cancels_action IS NOT NULL AS note, len(facts) + len(rels) AS durable, {kind} AS kind FROM m),
g AS (SELECT id, body, CASE WHEN answer = '{{}}' THEN ['unusable answer'] ELSE flatten([{', '.join(parts)}]) END AS gaps FROM n)
"""


GAPS = _sql()


@query(GAPS + "SELECT id, array_to_string(gaps, ';') AS gaps, len(gaps) = 0 AS conforming FROM g")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of every case."""
    g = gaps.with_gaps(cases(spark, d), "body", "answer", F.lit(TODAY).cast("date"))
    return g.select("id", F.array_join("gaps", ";").alias("gaps"), (F.size("gaps") == 0).alias("conforming"))


_BOUNDARIES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in evaluation.AXES)


@query(GAPS + f", u AS (SELECT id, unnest(gaps) AS gap FROM g) SELECT CASE regexp_extract(gap, '^[a-z_]+') {_BOUNDARIES} ELSE 'other' END AS boundary, count(*) AS n, count(DISTINCT id) AS cases FROM u GROUP BY 1")
def gap_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and cases by the boundary that their axis serves."""
    g = gaps.with_gaps(cases(spark, d), "body", "answer", F.lit(TODAY).cast("date")).select("id", F.explode_outer("gaps").alias("gap")).filter("gap is not null")  # outer: else all rules go once more into a filter below
    boundary = F.create_map(*[F.lit(x) for pair in evaluation.AXES for x in pair])[F.regexp_extract("gap", "^[a-z_]+", 0)]
    return g.groupBy(F.coalesce(boundary, F.lit("other")).alias("boundary")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("cases"))
