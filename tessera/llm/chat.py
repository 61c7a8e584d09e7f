"""Operator 1: chat formatting by minimum-cost role repair.

Legal turns are the words of an automaton: an optional system turn, then user and assistant in turn, ending
with the assistant.  Every input turn is kept, relabelled, merged into the turn before it, or preceded by an
inserted empty turn; each has a cost, and dynamic programming over the automaton's states finds the cheapest
repair of the whole conversation (ties: the first option in the order written here).  Rendered fragments,
concatenated in the order of the turns, are the repaired conversation.

Scale: turns are range-partitioned by conversation and turn, so that a conversation with a third of all rows
spreads over parts.  A run of turns maps entry states to exit states and costs (a small min-plus matrix);
only the first and last run of a part can belong to a conversation that crosses its border, so two matrices a part
are composed, FAN at a time in a tree of groups, down which the states at the borders are fixed; then the parts
backtrack between them.  Nothing is gathered on the driver.

Edge cases: null or unknown roles may take any role for a small cost; null or empty texts are kept as empty
turns; null conversation ids form one conversation; null turns come first; equal turns are ordered by role,
then text; repeated rows are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, null_safe, table

ROLES = ("system", "user", "assistant")
START = len(ROLES)
STATES = range(len(ROLES) + 1)
LEGAL = {(START, 0), (START, 1), (0, 1), (1, 2), (2, 1)}
MERGE, INSERT, RELABEL, GUESS = 1, 3, 4, 1
#: Empty turns that end a conversation left in a state.
ENDING = {0: (1, 2), 1: (2,), 2: (), START: ()}
ROWS_A_PART = 20_000
FAN = 1000
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
INF = math.inf


def option(role: int | None, state: int, to: int) -> tuple[float, str, int | None]:
    """(cost, action, role of an empty turn inserted before) of giving a turn the role ``to`` in ``state``."""
    label = 0 if role == to else GUESS if role is None else RELABEL
    named = "keep" if role == to else "relabel"
    found = []
    if (state, to) in LEGAL:
        found.append((label, named, None))
    if state == to:
        found.append((label + MERGE, "merge" if role == to else "relabel+merge", None))
    found += [(label + INSERT, f"insert+{named}", x) for x in range(len(ROLES)) if (state, x) in LEGAL and (x, to) in LEGAL]
    return min(found, key=lambda o: o[0], default=(INF, "", None))


#: For each role, state and new role, the cheapest option.
OPTIONS = {r: [[option(r, s, t) for t in range(len(ROLES))] for s in STATES] for r in (None, *range(len(ROLES)))}


def step(costs: list[float], role: int | None) -> tuple[list[float], list[int]]:
    """Costs of the states after a turn, and the state each came from."""
    table_, out, came = OPTIONS[role], [INF] * len(STATES), [0] * len(STATES)
    for t in range(len(ROLES)):
        out[t], came[t] = min((costs[s] + table_[s][t][0], s) for s in STATES)
    return out, came


def run_matrix(roles: list[int | None]) -> list[list[float]]:
    matrix = []
    for s in STATES:
        costs = [0.0 if x == s else INF for x in STATES]
        for r in roles:
            costs, _ = step(costs, r)
        matrix.append(costs)
    return matrix


def end_cost(state: int) -> int:
    return INSERT * len(ENDING[state])


def repair(roles: list[int | None], entry: int, leave: int | None) -> list[int]:
    """The states after each turn on the cheapest way from ``entry`` to ``leave`` (None: to the conversation's end)."""
    costs, back = [0.0 if x == entry else INF for x in STATES], []
    for r in roles:
        costs, came = step(costs, r)
        back.append(came)
    state = min(STATES, key=lambda s: (costs[s] + end_cost(s), s)) if leave is None else leave
    states = []
    for came in reversed(back):
        states.append(state)
        state = came[state]
    return states[::-1]


def composed(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[min(a[s][x] + b[x][t] for x in STATES) for t in STATES] for s in STATES]


def way(matrices: list[list[list[float]]], entry: int, leave: int | None) -> list[int]:
    """The states after each of the matrices on the cheapest way from ``entry`` to ``leave`` (None: to the conversation's end)."""
    costs, back = [0.0 if s == entry else INF for s in STATES], []
    for m in matrices:
        best = [min((costs[s] + m[s][t], s) for s in STATES) for t in STATES]
        costs = [c for c, _ in best]
        back.append([s for _, s in best])
    state = min(STATES, key=lambda s: (costs[s] + end_cost(s), s)) if leave is None else leave
    states = []
    for came in reversed(back):
        states.append(state)
        state = came[state]
    return states[::-1]


RUN = "conv string, at int, rows long, matrix array<array<double>>"
BORDER = "conv string, at int, entry int, leave int, before long"


def border_states(runs: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """For each run (conv, at, rows, matrix) of a conversation that crosses borders: entry, leave (null: the end) and the rows before it."""

    def join_up(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        matrices = [[list(r) for r in m] for m in g["matrix"]]
        return pd.DataFrame([{"conv": g["conv"].iloc[0], "at": int(g["at"].iloc[0]) // FAN, "rows": int(g["rows"].sum()), "matrix": reduce(composed, matrices)}])

    group = F.floor(F.col("at") / FAN).cast("int").alias("up")
    above = scratch.keep(runs.groupBy("conv", group).applyInPandas(join_up, RUN), f"runs{level}")
    if above.groupBy("conv").count().filter("count > 1").isEmpty():
        fixed = above.select("conv", "at", F.lit(START).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(0).cast("long").alias("before"))
    else:
        fixed = border_states(above, scratch, level + 1)

    def split_up(g: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        g, top = g.sort_values("at"), top.iloc[0]
        end = None if pd.isna(top["leave"]) else int(top["leave"])
        states = way([[list(r) for r in m] for m in g["matrix"]], int(top["entry"]), end)
        before = int(top["before"]) + g["rows"].cumsum() - g["rows"]
        leave = [*states[:-1], end]
        return pd.DataFrame({"conv": g["conv"], "at": g["at"], "entry": [int(top["entry"]), *states[:-1]], "leave": pd.array(leave, "Int32"), "before": before})

    return scratch.keep(runs.groupBy("conv", group).cogroup(fixed.groupBy("conv", F.col("at").alias("up"))).applyInPandas(split_up, BORDER), f"borders{level}")


def known_role(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def runs_of(part: pd.DataFrame) -> list[pd.DataFrame]:
    part = part.sort_values("idx")
    return [g for _, g in part.groupby("conv", sort=False)]


def edges(part: pd.DataFrame) -> pd.DataFrame:
    runs = runs_of(part)
    ends = [(False, runs[0])] + ([(True, runs[-1])] if len(runs) > 1 else [])
    return pd.DataFrame([{"conv": g["conv"].iloc[0], "at": int(part["part"].iloc[0]), "rows": len(g), "matrix": run_matrix([known_role(r) for r in g["role"]])} for _, g in ends])


def render(role: int, text: str) -> str:
    return OPEN.format(ROLES[role]) + text


def repaired_run(g: pd.DataFrame, entry: int, leave: int | None, first: int) -> pd.DataFrame:
    roles = [known_role(r) for r in g["role"]]
    before, rows = entry, []
    states = repair(roles, entry, leave)
    for i, (role, state, text) in enumerate(zip(roles, states, g["text"], strict=True)):
        cost, action, inserted = OPTIONS[role][before][state]
        merged = "merge" in action
        out = "\n" if merged else "" if before == START else CLOSE
        if inserted is not None:
            out += render(inserted, "") + CLOSE
        out += (text or "") if merged else render(state, text or "")
        if leave is None and i == len(states) - 1:
            out += CLOSE + "".join(render(x, "") + CLOSE for x in ENDING[state])
            cost += end_cost(state)
        rows.append((first + i, ROLES[state], action, int(cost), (not merged) + (inserted is not None), out))
        before = state
    made = pd.DataFrame(rows, columns=["position", "out_role", "action", "cost", "opened", "fragment"], index=g.index)
    return pd.concat([g[["conv_id", "turn", "role"]], made], axis=1)


def repair_roles(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """A row an input turn: conv_id, turn, role, position (in the conversation, from 0), out_role, action, cost, opened (turns that it opens),
    fragment. The fragments of a conversation, concatenated by position, are the repaired one."""
    ids = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", "role", "text", null_safe(F.col("conv_id")).alias("conv"), F.monotonically_increasing_id().alias("tie"))
    rows = scratch.keep(rows, "turns")
    parts = -(-rows.count() // ROWS_A_PART) or 1
    order = ["conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), "tie"]
    dealt = rows.repartitionByRange(max(parts, 8), *order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.withColumns({"part": F.spark_partition_id(), "idx": F.monotonically_increasing_id()}), "dealt")
    ends = scratch.keep(dealt.select("part", "idx", "conv", "role").groupBy("part").applyInPandas(edges, RUN), "ends")
    borders = border_states(ends, scratch)

    def repair_part(part: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        fixed = {r.conv: (int(r.entry), None if pd.isna(r.leave) else int(r.leave), int(r.before)) for r in border.itertuples()}
        return pd.concat([repaired_run(g, *fixed.get(g["conv"].iloc[0], (START, None, 0))) for g in runs_of(part)])

    schema = f"conv_id {ids['conv_id']}, turn {ids['turn']}, role string, position long, out_role string, action string, cost int, opened int, fragment string"
    return dealt.groupBy("part").cogroup(borders.groupBy(F.col("at").alias("part"))).applyInPandas(repair_part, schema)


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"), Scratch(spark, "op1"))
