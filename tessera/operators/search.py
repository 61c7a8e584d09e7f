"""Search as served: gates, several sources, text where vectors find nothing, merge proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.filters import clamped
from tessera.functions.vector import distance_score
from tessera.functions.visibility import live_entity
from tessera.operators.knn import block_knn
from tessera.operators.pruned import pruned_knn
from tessera.scratch import kept

KINDS = ("note", "entity", "resource")


def open_entities(entities: DataFrame, types: tuple | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Entities that a search may find: live, of ``types``, not in ``exclude`` (id)."""
    out = entities.filter(live_entity())
    out = out if types is None else out.filter(F.col("type").isin(*types))
    return out if exclude is None else out.join(exclude.select("id").distinct(), "id", "left_anti")


def entity_hits(queries: DataFrame, entities: DataFrame, limit: int, min_score: float = 0.0, types: tuple | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Q, id, score, rank. The score falls with the rank, so the floor may follow the cut."""
    near = block_knn(queries, open_entities(entities, types, exclude), limit)
    return near.select("q", "id", distance_score(F.col("sim")).alias("score"), "rank").filter(F.col("score") >= min_score)


def search_memory(queries: DataFrame, vectors: DataFrame, texts: DataFrame, words: dict[int, str], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(q, kind, id, score, rank; id of the notes to reactivate).

    ``queries``: id, embedding (null: no vector), type. ``vectors``: id, embedding, type, source (place in KINDS), owner (what is found).
    Each source gives its ``limit`` best; they are merged by score, then source, then place. A query no vector answers
    takes the newest ``texts`` (kind, id, content, created_at) that hold its ``words`` literally, whatever the case. A query
    without words then finds nothing. ``words`` are the callers' arguments, as many as there are queries.
    """
    limit = clamped(limit, 20)
    hits = block_knn(queries, vectors, limit, unit="owner", part="source").withColumnRenamed("rank", "pos").withColumn("score", distance_score(F.col("sim")))
    hits = kept(hits)  # three results come from it
    order = Window.partitionBy("q").orderBy(F.desc("score"), "source", "pos")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("source") + 1)
    merged = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("q", kind.alias("kind"), "id", "score", "rank")

    silent = queries.select(F.col("id").alias("q")).distinct().join(hits.select("q").distinct(), "q", "left_anti")
    asked = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(w.lower()).alias("word")) for q, w in sorted(words.items())]) if words else F.expr("cast(array() as array<struct<q: bigint, word: string>>)")
    content = F.lower(F.coalesce("content", F.lit("")))
    held = texts.select("kind", "id", "created_at", F.explode(F.filter(asked, lambda x: content.contains(x["word"]))).alias("x")).select("x.q", "kind", "id", "created_at")
    newest = Window.partitionBy("q").orderBy(F.desc("created_at"), "kind", "id")
    found = held.join(silent, "q", "left_semi").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)
    return merged.unionByName(found.select("q", "kind", "id", F.lit(None).cast("double").alias("score"), "rank")), hits.filter("source = 0").select("id").distinct()


def merge_proposals(entities: DataFrame, proposed: DataFrame, floor: float = 0.85) -> DataFrame:
    """Candidate (the younger, by id), existing, reason, sim, without pairs proposed before (candidate, existing).

    ``entities``: id, type, name, embedding. Entities of one type and name, whatever the case, are one class, named by its
    smallest id: members are proposed to it (name_equal), and classes to classes whose name holds theirs as a run of
    whole words (name_substring; that words must be whole is ours). Candidates without such a pair are proposed to
    all of their type at a cosine of ``floor`` or more (embedding). Runs of a name are its words squared: names are short.
    """
    words = F.split(F.lower("name"), " ")
    named = entities.filter(F.coalesce("name", F.lit("")) != "").select("id", "type", F.lower("name").alias("name"))
    class_of = named.groupBy("type", "name").agg(F.min("id").alias("rep"))
    runs = F.expr("array_distinct(flatten(transform(sequence(1, size(w)), i -> transform(sequence(i, size(w)), j -> array_join(slice(w, i, j - i + 1), ' ')))))")
    inside = class_of.withColumn("w", words).select("type", F.col("name").alias("whole"), F.col("rep").alias("other"), F.explode(runs).alias("name"))
    part_of = class_of.join(inside, ["type", "name"]).filter("name <> whole")
    pairs = part_of.select(F.greatest("rep", "other").alias("candidate"), F.least("rep", "other").alias("existing"), F.lit("name_substring").alias("reason"))
    equal = named.join(class_of, ["type", "name"]).filter("id <> rep").select(F.col("id").alias("candidate"), F.col("rep").alias("existing"), F.lit("name_equal").alias("reason"))
    by_name = pairs.unionByName(equal)
    left = entities.join(by_name.select(F.col("candidate").alias("id")).distinct(), "id", "left_anti")
    near = pruned_knn(left, entities, None, floor, same_type=True).hits.filter("q > id")
    found = by_name.withColumn("sim", F.lit(None).cast("double")).unionByName(near.select(F.col("q").alias("candidate"), F.col("id").alias("existing"), F.lit("embedding").alias("reason"), "sim"))
    return found.join(proposed.select("candidate", "existing").distinct(), ["candidate", "existing"], "left_anti")
