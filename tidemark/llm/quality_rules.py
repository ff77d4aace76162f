"""Quality rules: a threshold table compiled into Spark projections, with no user functions.

``RULES`` is the table.  ``measures`` builds every length, symbol, stop-word and line figure from
built-in functions, and ``verdict`` folds the table into one boolean column.  There is no
shuffle: each document is judged alone, in the scan's own tasks.

Defined results: a null text counts as empty; texts without a word have ratios of 0 and fail the
length rule; length alone rejects no long text; texts of 60 or more words in a language whose function
words are not in ``STOP_WORDS`` fail unless the caller passes other ``rules``; ties with a bound pass; repeated rows are judged each for itself; other columns are
left alone by ``apply_rules`` and absent from ``judge``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import documents

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the corpus languages (English, German, French, Spanish).
# They are compared as written, so shouted or decorated words do not count.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "dans de des du en est et la le les on par pas pour que qui sur un une "
    "al como con del el la las lo los no por se su una y"
).split()

# measure, smallest value, largest value, fewest words from which the rule holds
RULES = (
    ("n_words", 10, None, 0),
    ("repeat_ratio", None, 0.20, 0),
    ("symbol_ratio", None, 0.25, 0),
    ("mean_word_length", 2.0, 14.0, 0),
    ("stop_word_ratio", 0.02, None, 60),
    ("dup_line_ratio", None, 0.50, 0),
)


def _by_hash(hashes: Column) -> Column:
    """Windows as (hash, place) in order, empty where none repeats, which is the usual case."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(
        F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeat_words(order: Column) -> Column:
    """Words inside windows that occur twice or more.

    ``order`` must be a plain column: the lambdas look at an element's neighbours, and an
    expression would be computed anew for each.  Windows next to an equal hash repeat.  Their
    sorted places p cover min(WINDOW, p - previous p) words each, a union without a set of words.
    """
    near = lambda e, k: F.coalesce(F.get(order, k)["h"] == e["h"], F.lit(False))
    places = F.array_sort(F.transform(
        F.filter(order, lambda e, k: near(e, k - 1) | near(e, k + 1)), lambda e: e["i"]))
    state = F.struct(F.lit(0).cast("bigint").alias("covered"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places, state,
        lambda s, p: F.struct((s["covered"] + F.least(F.lit(WINDOW), p - s["last"])).alias("covered"), p.alias("last")),
        lambda s: s["covered"])


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the figures that RULES names, each a JVM-side expression."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.select(
        *keep, t.alias("_t"),
        F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"))
    bare = F.col("_t")
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    w = F.col("_w")
    step = step.select(
        *keep, "_w", F.size("_w").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        F.size("_l").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: x.isin(STOP_WORDS))).alias("n_stop_words"),
        F.when(F.size("_w") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("_w") - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("_h"))
    step = step.withColumn("_o", _by_hash(F.col("_h"))).withColumn("n_repeat_words", _repeat_words(F.col("_o")))
    words = F.greatest("n_words", F.lit(1))
    out = step.select(
        *keep, F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("word_chars") / words).alias("mean_word_length"),
        (F.col("n_stop_words") / words).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"))
    # A filter on a measure must not be pushed below the projections: it would compute every
    # measure anew for each use.  Filters do not pass a generator of one row.
    return out.select(F.explode(F.array(F.struct(*out.columns))).alias("_m")).select("_m.*")


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the columns of ``measures``."""
    passed = F.lit(True)
    for measure, low, high, from_words in rules:
        fits = F.lit(True)
        if low is not None:
            fits = fits & (F.col(measure) >= low)
        if high is not None:
            fits = fits & (F.col(measure) <= high)
        passed = passed & (fits | (F.col("n_words") < from_words) if from_words else fits)
    return passed


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row a document: the base figures, whether the base rules fail, and the verdict."""
    m = measures(documents(docs), keep=("doc_id",))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    m = measures(docs.select(row, F.col("text")), keep=("_row",))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.where(~failed & verdict(rules)).select("_row.*")
