"""Operator 4: quality rules with robust multivariate outliers (minimum covariance determinant).

Base statistics are counted for every whole text by built-in functions.  Texts that pass the base rule become
vectors of transformed statistics: smoothed mean word length, and inverse-hyperbolic-sine rates of symbols,
repeated lines and repeated words (all per word or character, so that length alone is no outlier).  Each
language and source has its own location and covariance by minimum covariance determinant: from two
deterministic starts (medians and quartiles; mean and covariance) concentration steps keep the closest
three quarters of the group's rows, the start with the smaller determinant wins, and one reweighting step
follows.  Each estimate is shrunk towards that of its language, and that towards all rows', with a weight of
PSEUDO_ROWS / (rows + PSEUDO_ROWS): one formula for groups of every size, in which a lone row is judged by its
language.  Rows beyond a far quantile of the chi-square distribution are rejected.

Scale: all estimates are sums per group, merged on the map side, so a source with a third of the rows costs
what any other costs; rows meet the estimates of their groups by a salted key.  The closest three quarters are
found from a histogram of log distances (bounded bins a group), not by sorting a group.  Covariances get a floor,
as rates that are zero in nearly all texts would make them singular.

Windows of words are compared by 64-bit hashes of their words within one text.

Edge cases: null text has no words and fails the base rule; null language or source is a value of its own;
equal rows get equal verdicts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, null_safe, table, words
from .stats import SYMBOLS, count_of, duplicate_lines, lines_with_words, word_chars

WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: The vector: name and floor of its standard deviation.
DIMS = (("v_length", 0.04), ("v_symbols", 0.1), ("v_lines", 0.2), ("v_repeats", 0.2))
PSEUDO_ROWS = 15
SALTS = 32
SHARE = 0.75
STEPS = 3
BINS_AN_OCTAVE = 32
REJECT_AT = 1e-7  # share of a normal population beyond the cutoff
PRIOR_WORDS, PRIOR_LENGTH = 40, 5.0


def base_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = lines_with_words(text)
    df = docs.select(*keep, words(text).alias("__w"), word_chars(text).alias("word_chars"), count_of(text, SYMBOLS).alias("n_symbols"), lines.alias("__lines"))
    df = df.select(*keep, "word_chars", "n_symbols", F.transform("__w", lambda w: F.xxhash64(w)).alias("__w"), duplicate_lines(F.col("__lines")).alias("n_dup_lines"), F.size("__lines").alias("n_lines"))
    window = F.transform(F.sequence(F.lit(1), F.size("__w") - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at("__w", i + k) for k in range(WINDOW)]))
    rest = ["word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    df = df.select(*keep, *rest, F.size("__w").cast("long").alias("n_words"), F.when(F.size("__w") > WINDOW, window).alias("__h"))
    rest.append("n_words")
    placed = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, *rest, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed).alias("__s"))
    same = lambda x, j: F.coalesce(F.get("__s", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("__s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    df = df.select(*keep, *rest, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("__p"))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")), lambda a: a["n"])
    df = df.select(*keep, *rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def vectors() -> dict[str, Column]:
    rate = lambda times, c, of, prior: F.asinh(times * F.col(c) / (F.col(of) + prior))
    return {
        "v_length": F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS)),
        "v_symbols": rate(50, "n_symbols", "word_chars", 20),
        "v_lines": rate(10, "n_dup_lines", "n_lines", 5),
        "v_repeats": rate(10, "n_repeat_words", "n_words", 20),
    }


def chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def own_group() -> Column:
    return F.struct(F.col("lkey").alias("lkey"), F.col("skey").alias("skey"))


def groups_of() -> Column:
    """The groups a row is part of: its language and source, its language, all. Keys are never empty, so empty means any."""
    any_, lang = F.lit("").alias("skey"), F.col("lkey").alias("lkey")
    return F.array(own_group(), F.struct(lang, any_), F.struct(F.lit("").alias("lkey"), any_))


def salted(df: DataFrame) -> DataFrame:
    """A small table with a copy of each row a salt, for joins with rows of hot groups."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def centred(sums: DataFrame, keys: list[str]) -> DataFrame:
    """From n, s_i, p_i_j to n, means m_i and covariances c_i_j."""
    d, n = range(len(DIMS)), F.col("n").cast("double")
    mean = sums.select(*keys, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in d], *[(F.col(f"p{i}_{j}") / n).alias(f"p{i}_{j}") for i in d for j in range(i + 1)])
    cov = [(F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}_{j}") for i in d for j in range(i + 1)]
    return mean.select(*keys, "n", *[f"m{i}" for i in d], *cov)


def factored(est: DataFrame, keys: list[str]) -> DataFrame:
    """From means and covariances to means m_i, the Cholesky factor l_i_j of the floored covariance, and log_det."""
    d = range(len(DIMS))
    for i in d:
        for j in range(i + 1):
            c = F.greatest(F.lit(0.0), F.col(f"c{i}_{i}")) + DIMS[i][1] ** 2 if i == j else F.col(f"c{i}_{j}")
            for k in range(j):
                c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            est = est.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(c, F.lit(DIMS[i][1] ** 2 / 4))) if i == j else c / F.col(f"l{j}_{j}"))
    log_det = sum((F.log(f"l{i}_{i}") for i in d), F.lit(0.0)) * 2
    return est.select(*keys, *[f"m{i}" for i in d], *[f"l{i}_{j}" for i in d for j in range(i + 1)], log_det.alias("log_det"))


def shrunk(est: DataFrame, towards: DataFrame, on: list[str]) -> DataFrame:
    """``est`` with means and covariances moved towards those of the group above."""
    values = [c for c in est.columns if c[:1] in "mc" and c[1:2].isdigit()]
    above = towards.select(*on, *[F.col(c).alias(f"above_{c}") for c in values])
    w = F.col("n") / (F.col("n") + PSEUDO_ROWS)
    both = est.join(above, on) if on else est.join(above, F.lit(True))
    return both.select(*[c for c in est.columns if c not in values], *[(w * F.col(c) + (1 - w) * F.col(f"above_{c}")).alias(c) for c in values])


def moments() -> list[Column]:
    names = [n for n, _ in DIMS]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    return [F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]]


def distance(scale: float = 1.0) -> Column:
    """Squared Mahalanobis distance by forward substitution with the factor at hand."""
    solved: list[Column] = []
    for i, (v, _) in enumerate(DIMS):
        rest = F.col(v) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            rest = rest - F.col(f"l{i}_{j}") * y
        solved.append(rest / F.col(f"l{i}_{i}"))
    return sum((y * y for y in solved), F.lit(0.0)) / scale


def starts(rows: DataFrame) -> DataFrame:
    """Two estimates a group: start 0 from medians and quartiles, start 1 from all rows."""
    names = [n for n, _ in DIMS]
    quartiles = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in names])
    n = F.col("n").cast("double")
    spread = lambda v: (F.col(v)[2] - F.col(v)[0]) / 1.349
    made = [(F.col(v)[1] * n).alias(f"s{i}") for i, v in enumerate(names)]
    made += [((F.col(names[i])[1] * F.col(names[j])[1] + (spread(names[i]) ** 2 if i == j else 0.0)) * n).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    robust = quartiles.select("g", F.lit(0).alias("start"), "n", *made)
    return factored(centred(robust.unionByName(rows.groupBy("g").agg(*moments()).withColumn("start", F.lit(1))), ["g", "start"]), ["g", "start"])


def concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step: the estimate of the closest rows of each group and start."""
    near = rows.join(salted(est), ["g", "salt"]).withColumn("bin", F.floor(F.log2(distance() + 1e-9) * BINS_AN_OCTAVE))
    # sums a bin, so that the closest rows' sums need no second look at the rows
    bins = near.groupBy("g", "start", "bin").agg(*moments())
    upto = F.sum("n").over(Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    all_ = F.sum("n").over(Window.partitionBy("g", "start"))
    kept = bins.withColumn("upto", F.coalesce(upto, F.lit(0))).withColumn("all", all_).filter(F.col("upto") < F.ceil(SHARE * F.col("all")))
    sums = [c for c in bins.columns if c not in ("g", "start", "bin")]
    return factored(centred(kept.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in sums]), ["g", "start"]), ["g", "start"])


def robust_estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """lkey, skey and the reweighted minimum-covariance-determinant estimate of each language and source, shrunk."""
    est = scratch.keep(starts(rows), "est0")
    for step in range(STEPS):
        est = scratch.keep(concentrate(rows, est), f"est{step + 1}")
    best = est.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("log_det", "start"))).filter("rn = 1").drop("rn", "start", "log_det")
    d = len(DIMS)
    widened = SHARE / 0.56  # consistency of the covariance of the closest 75 % in four dimensions
    inliers = rows.join(salted(best), ["g", "salt"]).filter(distance(widened) <= chi_square(0.975, d))
    final = scratch.keep(centred(inliers.groupBy("g").agg(*moments()), ["g"]).select("g.lkey", "g.skey", "*").drop("g"), "inliers")
    every = final.filter("lkey = ''")
    lang = shrunk(final.filter("lkey <> '' and skey = ''"), every, [])
    own = shrunk(final.filter("skey <> ''"), lang, ["lkey"])
    return scratch.keep(factored(own, ["lkey", "skey"]).drop("log_det"), "final")


def judge(docs: DataFrame, keep: list[str], scratch: Scratch) -> DataFrame:
    """``keep``, the base statistics, base_failed and kept for every row."""
    docs = docs.withColumns({"lkey": null_safe(F.col("lang")), "skey": null_safe(F.col("source"))})
    known = scratch.keep(base_statistics(docs, [*keep, "lkey", "skey"]), "known")
    passed = known.filter(~F.col("base_failed")).withColumns(vectors()).withColumn("salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int"))
    rows = scratch.keep(passed.select(F.explode(groups_of()).alias("g"), "salt", *vectors()), "vectors")
    est = robust_estimates(rows, scratch)
    verdicts = passed.join(salted(est), ["lkey", "skey", "salt"], "left")
    kept = F.coalesce(distance() <= chi_square(1 - REJECT_AT, len(DIMS)), F.lit(True))
    columns = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return verdicts.select(*columns, kept.alias("kept")).unionByName(known.filter("base_failed").select(*columns, F.lit(False).alias("kept")))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"], Scratch(spark, "op4"))
