"""URL filters: a rule list, and gradient-boosted trees where no rule fits.

Rules name a host with its subdomains and the start of a path; the longest fitting rule wins.  They
are compiled into one expression.  The trees (Spark ML) use lexical features, all built-in
expressions: lengths, depth, digit ratio, character entropy, parameter counts, and statistics of
the host's suffix (its share of all urls, and its smoothed share of blocked ruled urls).  They
are trained on the urls that a rule judges, at most ``SAMPLE`` of them.  A ruled url's share of
blocked ones is taken from the other ``FOLDS`` - 1 folds, so that its own label is no input.  Only
ruled urls carry labels: of suffixes without any the trees know the lexical features alone.

Features are computed once and written.  Suffix statistics are counted over all urls, by suffix and
fold, with map-side combination; the counted table is broadcast where it has at most ``SUFFIXES``
rows, and beyond that joined by suffix and fold, which splits a hot suffix.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged by the trees like any other; without both classes among the ruled urls the verdict is the
only class seen, or ``allow``; repeated rows, and rows without a page_id, are judged each for itself;
columns other than page_id and url are not read; very long urls cost time in proportion to their
length and distinct characters.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import saved

SAMPLE = 20_000
FOLDS, SUFFIXES = 5, 200_000
# host, start of the path, verdict (fixed values)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "suffix_share", "suffix_blocked")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query), empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, "(?s)^[^?#]*\\?([^#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, query


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F, F
    for k, (h, p, v) in enumerate(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character: log2 n - sum(c log2 c) / n over the distinct characters' counts c."""
    n = F.char_length(text)
    chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
    total = F.aggregate(chars, F.lit(0.0), lambda s, c: s + F.log2(n - F.char_length(F.replace(text, c, F.lit("")))) * (n - F.char_length(F.replace(text, c, F.lit("")))))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def _features(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    host, path, query = parts(F.col("url"))
    df = pages.select(*keep, F.coalesce(F.col("url"), F.lit("")).alias("_url"), host.alias("host"), path.alias("path"), query.alias("_query"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    n = F.char_length("_url")
    digits = n - F.char_length(F.regexp_replace("_url", "[0-9]", ""))
    count = lambda c, x: (F.char_length(c) - F.char_length(F.replace(F.col(c), F.lit(x), F.lit("")))).cast("double")
    return df.select(
        *keep, "host", "path", rule.alias("rule"), verdict.alias("_verdict"),
        F.element_at(F.split("host", "\\."), -1).alias("_suffix"),
        n.cast("double").alias("url_length"), F.char_length("host").cast("double").alias("host_length"), F.char_length("path").cast("double").alias("path_length"),
        count("path", "/").alias("depth"), count("host", ".").alias("host_depth"),
        F.when(n > 0, digits / n).otherwise(0.0).alias("digit_ratio"), _entropy(F.col("_url")).alias("entropy"),
        F.when(F.col("_query") != "", count("_query", "&") + 1).otherwise(0.0).alias("n_params"), count("_url", "-").alias("n_hyphens"))


def judge(pages: DataFrame, sample: int = SAMPLE, trees: int = 8, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = saved(_features(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), ("page_id",))
                 .withColumn("_fold", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(FOLDS)).cast("int")), "url-features")
    total = rows.count()
    per = rows.groupBy("_suffix", "_fold").agg(F.count("*").alias("n"), F.count_if(F.col("_verdict") == "block").alias("b"), F.count_if(F.col("_verdict").isNotNull()).alias("k"))
    w = Window.partitionBy("_suffix")
    n, b, k = (F.sum(c).over(w) for c in ("n", "b", "k"))
    suffixes = saved(per.select("_suffix", "_fold", (n / F.lit(max(1, total))).alias("suffix_share"), ((b + 1) / (k + 2)).alias("_every"),
                                ((b - F.col("b") + 1) / (k - F.col("k") + 2)).alias("_others")), "suffixes")
    if suffixes.count() <= SUFFIXES:
        suffixes = F.broadcast(suffixes)
    rows = rows.join(suffixes, ["_suffix", "_fold"]).withColumn("suffix_blocked", F.when(F.col("_verdict").isNull(), F.col("_every")).otherwise(F.col("_others")))
    ready = VectorAssembler(inputCols=list(LEXICAL), outputCol="_features").transform(rows)
    train = (ready.where("_verdict is not null").select("_features", (F.col("_verdict") == "block").cast("double").alias("_label"), "page_id")
             .orderBy(F.xxhash64("page_id"), "page_id").limit(sample).coalesce(1).persist())
    try:
        classes = sorted(r[0] for r in train.select("_label").distinct().collect())
        if len(classes) < 2:
            only = "block" if classes == [1.0] else "allow"
            return ready.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(only)).alias("verdict"))
        model = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_said",
                              maxIter=trees, maxDepth=depth, maxBins=32, seed=17).fit(train)
    finally:
        train.unpersist()
    return model.transform(ready).select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_said") == 1.0, "block").otherwise("allow")).alias("verdict"))
