"""Quality rules: base counts of a text, then robust multivariate outliers by language and source.

Only DataFrame functions: every count is an expression over one row, and the minimum-covariance-determinant estimates
are concentration steps made of grouped sums. No rows but one per group meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Transformed statistics that the estimates are made of.
VECTOR = ("v0", "v1", "v2", "v3")
#: Share of a group's documents that each concentration step keeps, and the number of steps.
CORE, STEPS = 0.75, 4
#: Documents that a group's language counts as in the group's own estimate, and all languages in the language's.
PRIOR = 30.0
#: Quantiles of chi-square with 4 degrees of freedom, 0.75 and 1 - 1e-9.
CHI_CORE, CUT = 5.385, 47.60
#: Least spread of each statistic: keeps a group of like documents from rejecting small differences.
FLOOR = (0.12, 0.06, 0.10, 0.08)
#: Estimates of up to this many groups are broadcast to the rows that are judged; more meet them in a shuffled join.
BROADCAST_GROUPS = 20_000


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed under __-names.

    A null text counts as empty; texts are whole, however long; repeated rows get equal values and an empty table stays
    empty. docs must not have columns of these names (ValueError); others may clash with no helper of this function.
    Repeated windows are found in a row's own array: windows are hashed (64 bits), and only
    a text with equal hashes has them sorted with their places; the words covered follow from neighbouring places.
    """
    if clash := {"__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed"} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)} already")
    if any(c.startswith("__") for c in docs.columns):
        d = statistics(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].alias("text")), "text")
        return d.select("row.*", *(c for c in d.columns if c.startswith("__")))
    t = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select("*", common.words(t).alias("__w"))
    n = F.size("__w")
    hashes = F.when(n >= 2 * WINDOW - WINDOW + 1, F.expr(f"transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64({', '.join(f'__w[i + {k}]' for k in range(WINDOW))}))")).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = reduce(lambda c, s: F.replace(c, F.lit(s)), SYMBOLS, t)
    d = d.select(
        "*",
        n.cast("long").alias("__n_words"),
        F.length(F.concat_ws("", "__w")).cast("long").alias("__word_chars"),
        (F.length(t) - F.length(left)).cast("long").alias("__n_symbols"),
        lines.alias("__lines"),
        hashes.alias("__h"),
    )
    d = d.select("*", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"), (F.size(F.array_distinct("__h")) < F.size("__h")).alias("__again"))
    # hashes with places, in order; a place counts if its hash equals a neighbour's; then how much each adds to the cover
    d = d.select("*", F.when(F.col("__again"), F.expr("array_sort(transform(__h, (h, i) -> struct(h AS h, i AS i)))")).alias("__s"))
    d = d.select("*", F.when(F.col("__again"), F.expr("array_sort(transform(filter(__s, (x, j) -> (j > 0 AND get(__s, j - 1).h = x.h) OR coalesce(get(__s, j + 1).h = x.h, false)), x -> x.i))")).alias("__p"))
    cover = F.expr(f"aggregate(transform(__p, (p, j) -> if(j = 0, {WINDOW}, least({WINDOW}, p - get(__p, j - 1)))), 0L, (a, x) -> a + x)")
    d = d.select("*", F.coalesce(F.when(F.col("__again"), cover), F.lit(0)).cast("long").alias("__n_repeat_words"))
    failed = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    return d.select(*(docs[c] for c in docs.columns), "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", failed.alias("__base_failed"))


def vector(d: DataFrame) -> DataFrame:
    """The statistics as shares, transformed to spread alike at all lengths."""
    n = F.greatest(F.col("__n_words"), F.lit(1)).cast("double")
    share = lambda c, of: F.sqrt(F.col(c) / of)
    return d.withColumns(
        {
            "v0": F.log(F.greatest(F.col("__word_chars"), F.lit(1)) / n),
            "v1": share("__n_symbols", n),
            "v2": share("__n_dup_lines", F.sqrt(n)),
            "v3": share("__n_repeat_words", n),
        }
    )


P = range(len(VECTOR))
CROSS = [(i, j) for i in P for j in range(i + 1)]
GROUP = ["__l", "__s"]
RUN = [*GROUP, "__start"]


def _distance() -> Column:
    """Squared distance of the vector to m0.. under the Cholesky factor l00.. of the covariance."""
    y: list[Column] = []
    for i, v in enumerate(VECTOR):
        y.append((F.col(v) - F.col(f"m{i}") - reduce(lambda a, b: a + b, (F.col(f"l{i}{j}") * y[j] for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (x * x for x in y))


def _sums(where: Column) -> list[Column]:
    """Number, sums and sums of products of the vectors of rows where holds."""
    on = F.when(where, F.lit(1.0))
    return [F.coalesce(F.sum(on * x), F.lit(0.0)).alias(n) for n, x in [("n", F.lit(1.0)), *((f"s{i}", F.col(VECTOR[i])) for i in P), *((f"q{i}{j}", F.col(VECTOR[i]) * F.col(VECTOR[j])) for i, j in CROSS)]]


def _estimate(sums: DataFrame) -> DataFrame:
    """Means and Cholesky factors of each group and start, from _sums by RUN: one small row a group.

    A group's moments are averaged with PRIOR documents of its language's, and those with PRIOR documents of all: the
    fewer documents a group has, the more it follows its language, and no size is a threshold.
    """
    names = ["n", *(f"s{i}" for i in P), *(f"q{i}{j}" for i, j in CROSS)]
    d = sums  # windows over one row a group and start
    for of, keys in (("lang", ["__l", "__start"]), ("all", ["__start"])):
        w = Window.partitionBy(*keys)
        d = d.select("*", *(F.sum(c).over(w).alias(f"{of}_{c}") for c in names))
    n = {k: F.col(f"{k}n") for k in ("", "lang_", "all_")}

    def moment(c: str) -> Column:
        every = F.coalesce(F.try_divide(F.col(f"all_{c}"), n["all_"]), F.lit(0.0))
        lang = (F.col(f"lang_{c}") + PRIOR * every) / (n["lang_"] + PRIOR)
        return (F.col(c) + PRIOR * lang) / (n[""] + PRIOR)

    d = d.select(*RUN, *(moment(f"s{i}").alias(f"m{i}") for i in P), *(moment(f"q{i}{j}").alias(f"e{i}{j}") for i, j in CROSS))
    for i, j in CROSS:
        rest = F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") - reduce(lambda a, b: a + b, (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + F.lit(FLOOR[i] ** 2)) if i == j else rest / F.col(f"l{j}{j}"))
    return d.select(*RUN, *(f"m{i}" for i in P), *(f"l{i}{j}" for i, j in CROSS))


def _core(far: DataFrame) -> DataFrame:
    """(group, start, cut): the squared distance under which CORE of the group lies, from counts on a fixed grid of 32 steps a doubling."""
    grid = F.floor(F.log2(F.greatest(F.col("dist"), F.lit(1e-6))) * 32)
    counts = far.groupBy(*RUN, grid.alias("g")).agg(F.count("*").alias("c"))
    got = counts.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("g", "c"))).alias("h"), F.sum("c").alias("all"))  # at most 32 * log2(range) entries
    at = F.expr(f"aggregate(h, struct(0L AS c, cast(null as bigint) AS g), (a, x) -> struct(a.c + x.c AS c, if(a.g is null and a.c + x.c >= {CORE} * all, x.g, a.g) AS g)).g")
    return got.select(*RUN, F.pow(F.lit(2.0), (at + 1) / 32.0).alias("cut"))


def _keyed(d: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(d[c].cast("string"), F.lit("\x00")).alias(k) for c, k in zip((lang_col, source_col), GROUP, strict=True)]


def fit(stats: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """An estimate for each language and source, one row each, of the rows of statistics() that passed the base rules.

    Minimum covariance determinant: from two starts (medians with quartile spreads; means with the covariance of all
    rows) each concentration step takes the CORE share of a group nearest to its estimate and estimates anew; the start
    whose covariance has the least determinant stays. All groups and starts go together, in grouped sums of narrow rows.
    An empty table gives no estimates; null languages and sources are groups of their own.
    """
    d = vector(stats.where(~F.col("__base_failed")))
    d = common.materialize(d.select(*_keyed(d, lang_col, source_col), *VECTOR), "vectors")
    med = d.groupBy(*GROUP).agg(*(F.percentile_approx(v, [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i, v in enumerate(VECTOR)))
    spread = lambda i: F.sqrt(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + F.lit(FLOOR[i] ** 2))
    first = med.select(*GROUP, F.lit(0).alias("__start"), *(F.col(f"p{i}")[1].alias(f"m{i}") for i in P), *((spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in CROSS))
    whole = _estimate(d.groupBy(*GROUP).agg(*_sums(F.lit(True))).withColumn("__start", F.lit(1)))
    est = common.materialize(first.unionByName(whole), "estimate")
    for step in range(STEPS + 1):
        far = _beside(d, est).select(*RUN, *VECTOR, _distance().alias("dist"))
        cut = common.materialize(_core(far), "core")
        if step == STEPS:
            break
        near = far.join(_small(cut), RUN)
        est = common.materialize(_estimate(near.groupBy(*RUN).agg(*_sums(F.col("dist") <= F.col("cut")))), "estimate")
    logdet = reduce(lambda a, b: a + b, (F.log(f"l{i}{i}") for i in P))
    est = est.join(cut, RUN).withColumn("scale", F.greatest(F.col("cut") / F.lit(CHI_CORE), F.lit(1.0)))
    values = [c for c in est.columns if c not in RUN]
    best = est.groupBy(*GROUP).agg(F.min_by(F.struct(*values), F.struct(logdet, "__start")).alias("x"))
    return common.materialize(best.select(*GROUP, "x.*"), "estimate")


def _small(groups: DataFrame) -> DataFrame:
    """A table of one row a group (or two), to be broadcast if it has few enough rows."""
    return F.broadcast(groups) if groups.limit(2 * BROADCAST_GROUPS + 1).count() <= 2 * BROADCAST_GROUPS else groups


def _beside(d: DataFrame, est: DataFrame, how: str = "inner") -> DataFrame:
    return d.join(_small(est), GROUP, how)


def judge(stats: DataFrame, model: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """stats with __distance (null where the base rules failed) and __kept.

    Any columns of stats keep their names, but __distance and __kept must be new (ValueError). Repeated rows are judged
    alike, an empty table stays empty; ties of the distance are kept. The estimates are broadcast, so that rows stay where
    they are, unless there are more than BROADCAST_GROUPS. Rows of a
    language or source that the model has not met have no distance, and the base rules alone decide.
    """
    cols = stats.columns
    if {"__distance", "__kept"} & set(cols):
        raise ValueError("stats has a column __distance or __kept already")
    d = vector(stats.select(F.struct(*(stats[c] for c in cols)).alias("__row"), *_keyed(stats, lang_col, source_col), "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words"))
    d = _beside(d, model, "left")
    far = F.when(~F.col("__row.__base_failed"), _distance() / F.col("scale"))
    return d.select("__row.*", far.alias("__distance")).select("*", (~F.col("__base_failed") & (F.coalesce(F.col("__distance"), F.lit(0.0)) <= CUT)).alias("__kept"))


def rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs and the columns of statistics() and judge(). Drop the text before if it is not needed after: rows are written once."""
    stats = common.materialize(statistics(docs, text_col), "statistics")
    return judge(stats, fit(stats, lang_col, source_col), lang_col, source_col)
