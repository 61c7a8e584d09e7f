"""Recorded answers, found again by what was asked: H03, E04."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between the blocks of a question, and before its text.
BETWEEN, BEFORE = "\n\n", "\n<<<CAPTURE>>>\n"


def key(blocks: Column, text: Column) -> Column:
    """The fingerprint of a question: its blocks and its text, so that an answer to another prompt is never served."""
    return F.sha2(F.concat(F.array_join(blocks, BETWEEN), F.lit(BEFORE), F.coalesce(text, F.lit(""))), 256)


def recorded(store: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of ``answers`` (key, answer, at) that a store of the same columns lacks: of a key the earliest answer, then the smallest.

    The store is only appended to: writing the result twice adds nothing the second time, as its keys are known by then.
    """
    first = answers.groupBy("key").agg(F.min(F.struct("at", "answer")).alias("a")).select("key", "a.answer", "a.at")
    return first.join(store.select("key").distinct(), "key", "left_anti")


def replayed(questions: DataFrame, store: DataFrame, blocks: str = "blocks", text: str = "text") -> DataFrame:
    """``questions`` with key, answer and error; a question without an answer has the error ``missing``, never an empty answer.

    Rows keep the columns of the question, among them its place in the corpus (``position``), by which a run is read.
    """
    asked = questions.withColumn("key", key(F.col(blocks), F.col(text)))
    known = store.select("key", "answer")
    found = asked.join(known, "key", "left")
    return found.withColumn("error", F.when(F.col("answer").isNull(), "missing"))


def unanswered(questions: DataFrame, store: DataFrame, blocks: str = "blocks", text: str = "text") -> DataFrame:
    """What a repeated run has to ask: each missing key once, with the first question that has it."""
    missed = replayed(questions, store, blocks, text).filter("error is not null")
    return missed.groupBy("key").agg(F.min("position").alias("position"), F.min(text).alias(text))


def positioned(cases: DataFrame, corpora: list[str], corpus: str, order: str) -> DataFrame:
    """Adds ``position``: the place of a case when the corpora are read one after another, each by ``order``; sorting by it gives that order.

    It is a pair (corpus, place) rather than one running number, so no task sees a corpus whole.
    """
    rank = F.array_position(F.array(*map(F.lit, corpora)), F.col(corpus))
    return cases.withColumn("position", F.struct(rank.alias("corpus"), F.col(order).alias("place")))


def run(questions: DataFrame, store: DataFrame, gaps: Column, blocks: str = "blocks", text: str = "text") -> DataFrame:
    """A row a case: key, whether an answer was read, and its gaps (the error where there is none)."""
    rows = replayed(questions, store, blocks, text)
    found = F.when(F.col("error").isNotNull(), F.array(F.col("error"))).otherwise(gaps)
    return rows.withColumn("gaps", found).withColumn("conforming", F.size("gaps") == 0)


def tally(rows: DataFrame, boundary: Column) -> DataFrame:
    """boundary, n, first: how many cases have gaps of a boundary, and up to six of their ids."""
    per = rows.select("id", F.explode("gaps").alias("gap")).withColumn("boundary", boundary).select("boundary", "id").distinct()
    order = Window.partitionBy("boundary").orderBy("id")
    first = per.withColumn("__r", F.row_number().over(order)).filter("__r <= 6").groupBy("boundary").agg(F.array_sort(F.collect_list("id")).alias("first"))
    return per.groupBy("boundary").agg(F.count("*").alias("n")).join(first, "boundary")
