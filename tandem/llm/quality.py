"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Counts per document give fixed base rules and a vector of four transformed statistics. Per
language and source, the minimum-covariance-determinant estimate (Rousseeuw 1984; concentration
steps of Rousseeuw and Van Driessen 1999) is taken by Spark aggregates: start from medians and
absolute deviations, then STEPS times take mean and covariance of the half of the group's
documents nearest by Mahalanobis distance. Which documents are the nearest half is read off a
histogram of the squared distance in fine logarithmic bins, so no group is ever sorted or
collected. Documents far beyond the chi-squared point of the final estimate are rejected.

Statistics are shrunk towards the group's median by PRIOR words, as short texts vary more. Many
are constant in most documents (no symbols, no repeats), which makes covariances singular; each
variance gets a FLOOR, that is the least deviation that counts as one unit.

Null and empty texts have no words: they fail the base rules. Documents that fail them take no
part in the estimates. Null language and null source are groups of their own. Every group's centre and
covariance are mixed with those over its language, pooled over sources, with weights n to LEAST for a group of n
documents; a language with few documents has nothing else to lean on, and is judged by its own.

Rows repeated under one doc_id are judged one by one and count as often as they come; of ties at
the edge of the nearest half all are in it; an empty table gives no rows; long texts are counted whole;
columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, written

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACE = "\x20\t\n\x0b\f\r"
PRIOR = 50.0
#: Per statistic (mean word length, symbols per word, duplicate lines, repeated words; see stats): least standard deviation.
FLOOR = (0.25, 0.05, 0.12, 0.12)
P = len(FLOOR)
STEPS = 4
SHARE = 0.5
LEAST = 40
#: Groups whose estimates are broadcast; beyond that they are joined by Spark's own choice.
MOST_GROUPS = 50_000
#: Source of the groups that hold a whole language; others begin with = or are -.
POOLED = "*"
#: Chi-squared, four degrees of freedom: median and 1 - 1e-6.
CHI_MEDIAN, CHI_CUT = 3.3567, 33.377
BINS = 64


def counts(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, lang, source and the base counts."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    plain = F.translate("text", SPACE, "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    df = df.select(
        "doc_id",
        "lang",
        "source",
        F.length(plain).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    n = F.size("words")
    at = lambda i, k: F.get("words", i + k)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    df = df.select("doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"), windows.alias("windows"))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    df = df.withColumn("placed", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda e, i: F.get("placed", i)["h"] == e["h"]
    twice = F.filter(F.transform("placed", lambda e, i: F.when(F.coalesce(same(e, i - 1), F.lit(False)) | F.coalesce(same(e, i + 1), F.lit(False)), e["i"])), lambda i: i.isNotNull())
    df = df.withColumn("starts", F.sort_array(twice)).drop("placed")
    covered = F.aggregate(F.transform("starts", lambda e, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - e, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def stats() -> list[Column]:
    """The raw statistics of a document with at least one word."""
    n = F.col("n_words")
    return [F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def whitened(group: DataFrame) -> DataFrame:
    """Per group: the centre and the inverse of the covariance's lower factor (names m0.., w00..)."""
    cov = [[F.col(f"c{max(i, j)}{min(i, j)}") + (F.lit(FLOOR[i] ** 2) if i == j else 0) for j in range(P)] for i in range(P)]
    # the factor's columns are made one by one, as each is used by the later ones
    for i in range(P):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), cov[i][j])  # noqa: B023
            group = group.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        group = group.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            rest = reduce(lambda a, k: a + F.col(f"l{i}{k}") * F.col(f"w{k}{j}"), range(j, i), F.lit(0.0))  # noqa: B023
            group = group.withColumn(f"w{i}{j}", -rest / F.col(f"l{i}{i}"))
    return group.drop(*(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


def covariances() -> list[str]:
    return [f"c{i}{j}" for i in range(P) for j in range(i + 1)]


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the centre m0.. under the factor w00.."""
    rows = [reduce(lambda a, j: a + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")), range(i + 1), F.lit(0.0)) for i in range(P)]  # noqa: B023
    return reduce(lambda a, r: a + r * r, rows, F.lit(0.0))


def moments() -> list[Column]:
    mean = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)]
    return [F.count("*").alias("n"), *mean, *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1))]


def robust(vectors: DataFrame, keys: list[str], small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """MCD estimate per group of ``keys``: n, m0.., c00.., scale. ``small`` marks tables of one row a group for joins."""
    start = vectors.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile_approx(f"x{i}", 0.5).alias(f"m{i}") for i in range(P)))
    spread = vectors.join(small(start), keys).groupBy(*keys).agg(F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i in range(P)))
    group = spread.select(*keys, "n", *(f"m{i}" for i in range(P)), *((F.pow(F.col(f"d{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))
    group = written(whitened(group), "group")
    bin_of = F.floor(F.log(distance() + 1e-6) * BINS)
    for step in range(STEPS + 1):
        placed = vectors.join(small(group.drop(*covariances())), keys).select(*keys, F.col("n").alias("all"), *(f"x{i}" for i in range(P)), bin_of.alias("bin"))
        histogram = placed.groupBy(*keys, "bin").agg(F.first("all").alias("all"), F.count("*").alias("k"))
        bins = histogram.groupBy(*keys).agg(F.first("all").alias("all"), F.sort_array(F.collect_list(F.struct("bin", "k"))).alias("bins"))
        # up to some thousand bins per group, whatever its size: the first at which half of the documents are covered
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cut"))
        grow = lambda a, b: F.struct((a["seen"] + b["k"]).alias("seen"), F.coalesce(a["cut"], F.when(a["seen"] + b["k"] >= F.col("all") * SHARE, b["bin"])).alias("cut"))
        cut = bins.select(*keys, F.aggregate("bins", zero, grow)["cut"].alias("cut"))
        if step == STEPS:
            # consistency: the median squared distance of a normal vector is CHI_MEDIAN; the floor already covers constant statistics
            scale = F.greatest(F.exp((F.col("cut") + 1) / BINS) / CHI_MEDIAN, F.lit(1.0))
            return written(group.join(small(cut), keys).withColumn("scale", scale).drop("cut"), "group")
        near = placed.join(small(cut), keys).where("bin <= cut")
        half = near.groupBy(*keys).agg(F.first("all").alias("all"), *moments()).withColumn("n", F.col("all")).drop("all")
        group = written(whitened(half), "group")


def judge(docs: DataFrame) -> DataFrame:
    """All counts, base_failed, distance (null if not estimated) and kept."""
    rows = written(counts(docs).withColumn("base_failed", base_failed()), "counts")
    # null-safe keys, for plain equi-joins
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumns({"g_lang": key("lang"), "g_source": key("source")})
    raw = rows.where(~F.col("base_failed")).withColumns({f"r{i}": s for i, s in enumerate(stats())})
    typical = raw.groupBy("g_lang", "g_source").agg(*(F.percentile_approx(f"r{i}", 0.5).alias(f"t{i}") for i in range(P)))
    shrink = lambda i: (F.col(f"r{i}") * F.col("n_words") + F.col(f"t{i}") * PRIOR) / (F.col("n_words") + PRIOR)
    root = lambda i: shrink(i) if i == 0 else F.sqrt(shrink(i))
    groups = raw.select("g_lang", "g_source").distinct().count()
    small = F.broadcast if groups <= MOST_GROUPS else lambda df: df
    vectors = written(raw.join(small(typical), ["g_lang", "g_source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "g_lang", "g_source", *(root(i).alias(f"x{i}") for i in range(P))), "vectors")
    # each document counts in its group and in that of its language
    both = vectors.withColumn("g_source", F.explode(F.array("g_source", F.lit(POOLED))))
    found = robust(both.select("g_lang", "g_source", *(f"x{i}" for i in range(P))), ["g_lang", "g_source"], small)
    pooled = found.where(F.col("g_source") == POOLED).drop("g_source")
    share, f, p = F.col("f.n") / (F.col("f.n") + LEAST), lambda c: F.col(f"f.{c}"), lambda c: F.col(f"p.{c}")
    apart = lambda i: f(f"m{i}") - p(f"m{i}")
    mixed = found.where(F.col("g_source") != POOLED).alias("f").join(small(pooled).alias("p"), "g_lang")
    chosen = mixed.select(
        "g_lang",
        "g_source",
        *((share * f(f"m{i}") + (1 - share) * p(f"m{i}")).alias(f"m{i}") for i in range(P)),
        *((share * f("scale") * f(f"c{i}{j}") + (1 - share) * p("scale") * p(f"c{i}{j}") + share * (1 - share) * apart(i) * apart(j)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)),
    )
    chosen = written(whitened(chosen).drop(*covariances()), "chosen")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = vectors.join(small(chosen), ["g_lang", "g_source"]).select(*cols, distance().alias("distance"))
    return good.withColumn("kept", F.col("distance") <= CHI_CUT).union(rows.where("base_failed").select(*cols, F.lit(None).cast("double"), F.lit(False)))


def op3_mcd_quality(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
