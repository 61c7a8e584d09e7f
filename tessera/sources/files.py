"""File sources S03-S08 (S09, S10: pages and change pages come as tables; D13: captures as declared structs) and exports K15-K17: JSON lines, snapshots, tables in Markdown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cases(spark: SparkSession, path: str, fields: dict[str, str], required: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """JSON lines, a set a file. The declared fields, ``set`` (the file's stem), ``asserted`` (keys present, null or not),
    and ``problem``: broken line, unknown field, missing field, or repeated id; null where a case is sound."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("set"))
    keys = F.json_object_keys("value")
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    parsed = lines.withColumn("asserted", keys).withColumn("__r", F.from_json("value", schema))
    named = F.array(*map(F.lit, fields))
    problem = (
        F.when(F.col("asserted").isNull(), "broken line")
        .when(F.size(F.array_except("asserted", named)) > 0, "unknown field")
        .when(F.size(F.array_except(F.array(*map(F.lit, required)), "asserted")) > 0, "missing field")
    )
    out = parsed.select("set", "asserted", problem.alias("problem"), "__r.*")
    repeated = out.filter("id is not null").groupBy("id").agg(F.count("*").alias("__n")).filter("__n > 1").select("id", F.lit("repeated id").alias("__p"))
    return out.join(repeated, "id", "left").withColumn("problem", F.coalesce("problem", "__p")).drop("__p")


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't start an object are skipped; a line that can't be read keeps its text in ``bad``."""
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("{"))
    kinds = T._parse_datatype_string(schema)
    parsed = lines.withColumn("__r", F.from_json("value", kinds, {"mode": "PERMISSIVE"}))
    broken = F.json_object_keys("value").isNull()
    return parsed.select(*[F.col(f"__r.{f.name}") for f in kinds.fields], F.when(broken, F.col("value")).alias("bad"))


def read_snapshot(spark: SparkSession, path: str, record: str) -> DataFrame:
    """One JSON document with a map of cases, as a row a case."""
    text = spark.read.text(path, wholetext=True)
    cases = F.from_json("value", f"cases map<string, struct<{record}>>")["cases"]
    return text.select(F.explode(cases).alias("id", "r")).select("id", "r.*")


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """File, row (in the file's order, per table line) and cells of Markdown tables, without the rule under the head."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    rows = lines.filter(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("file", "row", cells.alias("cells"))


def unpivot_languages(cases: DataFrame, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """A row a case and language from columns named by language."""
    return cases.unpivot("id", list(languages), "lang", "text")


def write_chat(threads: DataFrame, path: str) -> None:
    """Threads (id, messages array) as JSON lines, keys in the declared order, nulls kept."""
    threads.select(F.to_json(F.struct("id", "messages"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def changes_export(entities: DataFrame, facts: DataFrame, since: str, clock: str) -> tuple[DataFrame, DataFrame, str]:
    """K17, trap T8: entities in full with vectors as text, facts created since a moment, and the caller's clock as the next cursor."""
    vectors = F.base64(F.to_json("embedding").cast("binary"))
    return entities.withColumn("embedding", vectors), facts.filter(F.col("created_at") >= F.lit(since).cast("timestamp")), clock


def change_page(changes: DataFrame, since: int, limit: int) -> DataFrame:
    """The first ``limit`` changes after a cursor by ``seq``, each with the next cursor and whether more follow."""
    ahead = changes.filter(F.col("seq") > since).orderBy("seq").limit(limit + 1)  # one more than the page shows if there is more
    page = Window.orderBy("seq")  # a page's rows
    ranked = ahead.withColumns({"__n": F.row_number().over(page), "has_more": F.count("*").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit})
    kept = ranked.filter(F.col("__n") <= limit)
    return kept.withColumn("next", F.max("seq").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("__n")


def pull_pages(changes: DataFrame, since: int, limit: int) -> Iterator[tuple[int, DataFrame]]:
    """Page after page until none is left, with the cursor to store after each. One row a page comes to the driver."""
    more = True
    while more:
        page = change_page(changes, since, limit)
        head = page.select("next", "has_more").head()
        if head is None:
            return
        since, more = head
        yield since, page
