"""The blocking gate: the first reason why an answer cannot be used at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.gaps import Answer, Case, prepared

#: Kinds of note, and the characters that no tokenizer packs into one token.
KINDS = ("note", "task", "event", "episode")
CHARS_A_TOKEN = 8
HALVES = ("note", "graph")


def half_reason(half: str, size: int, window: int) -> Column:
    """Why a half of a call (columns ``<half>_error``, ``_prompt_tokens``, ``_stop``, ``_parsed``) cannot be read; null if it can.

    ``size``: characters of its prompt.  More tokens than the window: the prompt was cut; fewer than an eighth of its
    characters: part of it is missing.  Unknown token counts say nothing.
    """
    c = lambda name: F.col(f"{half}_{name}")
    tokens = c("prompt_tokens")
    because = F.when(F.coalesce(c("error"), F.lit("")) != "", F.concat(F.lit("call failed: "), c("error")))
    because = because.when(tokens >= window, "prompt longer than the window").when(tokens < size // CHARS_A_TOKEN, "prompt cut on its way")
    because = because.when(c("stop").eqNullSafe("max_tokens"), "output cut").when(~F.coalesce(c("parsed"), F.lit(False)), "no JSON")
    return F.concat(F.lit(f"{half}: "), because)


def gated(df: DataFrame, case: str, answer: str, sizes: dict[str, int], window: int) -> DataFrame:
    """``df`` with ``reason``: the first that blocks, in this order: each half, no answer at all, a kind outside the list, and
    where the case guards against loss, no durable trace; null if none does."""
    ready, a = prepared(df, case, answer), Answer()
    odd = F.get(F.filter(F.transform(a.memories, lambda m: m["kind"]), lambda k: ~k.isin(*KINDS)), 0)
    kept = (F.size(a.memories) > 0) | (F.size(a.projects) > 0) | (a.durable > 0)
    guard = Case(F.col("__case"), F.col("__keys")).asks("drop_guard")
    last = F.when(~a.usable, "no answer").when(odd.isNotNull(), F.concat(F.lit("kind: "), odd)).when(guard & ~kept, "no durable trace")
    return ready.withColumn("reason", F.coalesce(*[half_reason(h, sizes[h], window) for h in HALVES], last)).select(*df.columns, "reason")
