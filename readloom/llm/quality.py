"""Quality rules: robust multivariate outliers by minimum covariance determinant, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import BLANKS, WORD, materialise, maybe_broadcast

WINDOW = 5
#: The base rule: least words, most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The vector, in units of 1 / SCALE, and the standard deviation added to each part, so that a part that hardly varies can't reject alone by a trifle.
PARTS = ("x_length", "x_symbols", "x_lines", "x_repeats")
SCALE = 1024
FLOOR = (0.03, 0.04, 0.04, 0.05)
#: Share of a group that the estimate rests on; steps of concentration for all starts and then for the best.
SHARE, FIRST_STEPS, MORE_STEPS = 0.75, 2, 4
#: Chi-square of as many degrees of freedom as parts: the median, the reweighting cut and the verdict's cut (upper tail 0.001; each part can reach it alone).
CHI_MEDIAN, CHI_REWEIGHT, CHI_CUT = 3.3567, 11.1433, 18.4668
#: Distances are binned on a logarithmic scale, so many bins to a factor of two.
BINS = 32
#: Rows that a group or language needs for an estimate of its own, and the whole table for any.
LEAST_GROUP, LEAST_POOL = 100, 40


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda e, k: F.coalesce(e["h"] == F.get(s, k)["h"], F.lit(False))
            twice = F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
            return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        total = F.aggregate(bind(pairs, marked), start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bind(hashes, covered))


def text_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null and empty texts have 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    by_words = bind(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    dup = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.struct(by_words.alias("w"), symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"))


def stats_table(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed and the vector of every row of docs."""
    s = docs.select("doc_id", "lang", "source", text_stats(F.col("text")).alias("s"))
    s = s.select("doc_id", "lang", "source", "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.n_dup_lines", "s.w.n_repeat_words")
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * n)
    # a few words more of the usual kind steady the shares of short texts
    vector = (
        F.log((F.col("word_chars") + 220.0) / (n + 40.0)),
        F.log1p(5.0 * F.col("n_symbols") / (n + 40.0)),
        F.log1p(20.0 * F.col("n_dup_lines") / (n + 40.0)),
        F.sqrt(F.col("n_repeat_words") / (n + 40.0)),
    )
    return s.withColumn("base_failed", failed).withColumns({name: F.round(x * SCALE).cast("long") for name, x in zip(PARTS, vector)})


def _groups(rows: DataFrame) -> DataFrame:
    """lang, source, grp, pools: the key that a group is judged by, its own or, if it has few rows, its language's or that of all; and the keys of the estimates that its rows enter."""
    by_lang = W.partitionBy("lang")
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = own.withColumns({"in_lang": F.sum("n").over(by_lang), "least": F.min("n").over(by_lang)})
    own = materialise(own)
    all_needed = own.where(F.col("in_lang") < LEAST_GROUP).limit(1).count() > 0
    own_key, lang_key, all_key = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]")
    enough, enough_in_lang = F.col("n") >= LEAST_GROUP, F.col("in_lang") >= LEAST_GROUP
    key = F.when(enough, own_key).when(enough_in_lang, lang_key).otherwise(all_key)
    pools = F.array(F.when(enough, own_key), F.when(enough_in_lang & (F.col("least") < LEAST_GROUP), lang_key), F.when(F.lit(all_needed), all_key))
    return own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), key.alias("grp"), F.array_compact(pools).alias("pools"))


def _cholesky(params: DataFrame) -> DataFrame:
    """Columns l_i_j of the lower factor and log_det, from s_i_j."""
    p = len(PARTS)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s_{j}_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")
            params = params.withColumn(f"l_{i}_{j}", value)
    return params.withColumn("log_det", 2 * sum((F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its parameters."""
    y: list[Column] = []
    for i, part in enumerate(PARTS):
        y.append((F.col(part) / SCALE - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _bin() -> Column:
    return F.floor(BINS * F.log2(1.0 + F.least(F.col("d2"), F.lit(1e15)))).cast("int")


def _measured(rows: DataFrame, params: DataFrame, n_params: int) -> DataFrame:
    near = rows.join(maybe_broadcast(params, 400, n_params), "grp")
    return near.withColumn("d2", _distance())


def _moments(binned: DataFrame, keep: Callable[[DataFrame], DataFrame], by: list[str]) -> DataFrame:
    """Means, covariances with the floor, and the median bin of the bins that keep leaves.

    Sums are of whole numbers, so that they don't depend on the order of rows.
    """
    p = range(len(PARTS))
    pairs = list(combinations_with_replacement(p, 2))
    sums = {f"a_{i}": F.sum(PARTS[i]).alias(f"a_{i}") for i in p} | {f"b_{i}_{j}": F.sum(F.col(PARTS[i]).cast("decimal(12,0)") * F.col(PARTS[j]).cast("decimal(12,0)")).alias(f"b_{i}_{j}") for i, j in pairs}
    bins = binned.withColumn("bin", _bin()).groupBy(*by, "bin").agg(F.count("*").alias("n"), *sums.values())
    ordered = W.partitionBy(*by).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    bins = bins.withColumn("median", F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bin"))).over(W.partitionBy(*by)))
    kept = keep(bins).groupBy(*by).agg(F.sum("n").alias("n"), F.max("all").alias("all"), F.max("median").alias("median"), *[F.sum(c).cast("double").alias(c) for c in sums])
    cols = {f"m_{i}": F.col(f"a_{i}") / F.col("n") / SCALE for i in p}
    cols |= {f"s_{i}_{j}": F.col(f"b_{i}_{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"a_{i}") * F.col(f"a_{j}") / F.col("n") / F.col("n") / (SCALE * SCALE) + F.lit(FLOOR[i] ** 2 if i == j else 0.0) for i, j in pairs}
    return _cholesky(kept.withColumns(cols)).select(*by, "all", "median", "log_det", *cols, *[f"l_{i}_{j}" for i in p for j in range(i + 1)])


def _nearest(bins: DataFrame) -> DataFrame:
    """The bins that hold the nearest SHARE of a group, the last one whole."""
    return bins.where(F.col("upto") - F.col("n") < F.ceil(F.col("all") * SHARE))


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates of each group to start from: its medians, with scales from inner and outer quantiles, and with the floors alone."""
    p = range(len(PARTS))
    long = rows.select("grp", F.posexplode(F.array(*PARTS)).alias("part", "value"))
    by = ["grp", "part"]
    counts = long.groupBy(*by, F.floor(F.col("value") / 8).alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("v"))).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))) * 8.0 / SCALE
    q = counts.groupBy(*by).agg(at(0.5).alias("mid"), at(0.25).alias("q25"), at(0.75).alias("q75"), at(0.1).alias("q10"), at(0.9).alias("q90"))
    q = q.groupBy("grp").agg(*[F.max(F.when(F.col("part") == i, F.col(c))).alias(f"{c}_{i}") for i in p for c in ("mid", "q25", "q75", "q10", "q90")])
    scale = lambda i: F.array((F.col(f"q75_{i}") - F.col(f"q25_{i}")) / 1.349, (F.col(f"q90_{i}") - F.col(f"q10_{i}")) / 2.563, F.lit(0.0))
    q = q.withColumns({f"sc_{i}": scale(i) for i in p}).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(2))))
    cols = {f"m_{i}": F.col(f"mid_{i}") for i in p}
    cols |= {f"s_{i}_{j}": (F.pow(F.get(f"sc_{i}", F.col("start")), F.lit(2.0)) + FLOOR[i] ** 2 if i == j else F.lit(0.0)) for i, j in combinations_with_replacement(p, 2)}
    return _cholesky(q.withColumns(cols)).select("grp", "start", *cols, *[f"l_{i}_{j}" for i in p for j in range(i + 1)])


def robust_outliers(rows: DataFrame) -> DataFrame:
    """grp, the parameters and the factor of each group, of rows (grp, the vector).

    Every step counts all rows of a group: the distances' histogram and the
    moments of each bin come from one grouped sum with map-side combining, so a
    group of any size is never gathered; the parameters are one row a group.
    """
    estimates = materialise(_starts(rows))
    n = estimates.count()
    by = ["grp", "start"]
    for _ in range(FIRST_STEPS):
        estimates = materialise(_moments(_measured(rows, estimates.select("grp", "start", *_fields(estimates)), n), _nearest, by))
    best = W.partitionBy("grp").orderBy("log_det", "start")
    estimates = materialise(estimates.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "start"))
    n = estimates.count()
    for _ in range(MORE_STEPS):
        estimates = materialise(_moments(_measured(rows, estimates.select("grp", *_fields(estimates)), n), _nearest, ["grp"]))
    # the estimate of a part of the rows is too narrow: scaled by the median distance, then taken anew from all rows within the cut
    scaled = estimates.select("grp", *_fields(estimates))
    middle = _moments(_measured(rows, scaled, n), _nearest, ["grp"]).select("grp", F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("median") + 0.5) / BINS) - 1.0) / CHI_MEDIAN).alias("factor"))
    scaled = materialise(scaled.join(middle, "grp"))
    inner = _measured(rows, scaled, n).where(F.col("d2") <= CHI_REWEIGHT * F.col("factor"))
    final = _moments(inner, lambda bins: bins, ["grp"])
    return materialise(final.select("grp", "all", *_fields(final)))


def _fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[:2] in ("m_", "l_")]


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """op2: the counts, base_failed and kept of every row of docs (doc_id, text, lang, source).

    Documents that pass the base rule are compared with the robust centre and
    spread of their language and source; those of a group of few rows with all
    rows of their language or, if these are few too, of the table; only where
    the whole table is small there is no verdict and the document stays. A document goes if its squared distance is
    over CHI_CUT. Null and empty texts fail the base rule; null lang and source
    are values of their own; repeated rows count each; an empty table gives an
    empty result; other columns are ignored.
    """
    stats = materialise(stats_table(docs))
    passed = stats.where(~F.col("base_failed"))
    groups = materialise(_groups(passed))
    n = groups.count()
    with_group = lambda df: df.join(maybe_broadcast(groups, 200, n), df["lang"].eqNullSafe(F.col("g_lang")) & df["source"].eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")
    rows = materialise(with_group(passed.select("lang", "source", *PARTS)).select(F.explode("pools").alias("grp"), *PARTS))
    estimates = robust_outliers(rows)
    judged = with_group(stats).join(maybe_broadcast(estimates, 400), "grp", "left").withColumn("d2", _distance())
    outlier = F.coalesce((F.col("d2") > CHI_CUT) & (F.col("all") >= LEAST_POOL), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), F.col("d2").alias("distance"))
