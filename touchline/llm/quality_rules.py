"""Quality rules whose cutoffs are chosen under a guaranteed limit on false rejections.

A document fails a base rule (too few words, too many repeated 5-word windows) or one of the measured
rules: a share of the text is above the rule's cutoff.  The cutoffs are chosen per stratum (language)
from labelled good documents.  For a rule, candidate cutoffs are fixed beforehand and tried from the
loosest to the tightest; a candidate stands if, were the true false-rejection rate as high as the
allowed one, a binomial count as small as the observed one would have a probability of at most
``delta`` (the exact Clopper-Pearson test).  Testing stops at the first candidate that does not stand
(fixed-sequence testing needs no correction along the sequence); over rules and strata ``delta`` is
divided by their number (Bonferroni), and the allowed rate by the number of rules, so that with
probability 1 - ``delta`` the good documents rejected by any rule stay below ``alpha`` in every stratum.
A rule without a standing candidate rejects nothing there.

Everything is DataFrame and SQL functions.  The arrays belong to single documents; what is counted over
documents are sums per stratum, combined before the shuffle.

Defined results: a null text has no words and fails.  A null language is a stratum of its own.  A
document labelled both good and bad counts as good; labels without a document, and of null quality, are
not used.  Rows that repeat an id are judged each by its own text.  Without labels only the base rules hold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import scratch, whole_text

SPACE = " \t\n\u000b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LOUD = r"[A-Z!]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
GRAM = 5
ALPHA = 0.02
DELTA = 0.05
#: Candidate cutoffs of every rule, loosest first; a document is rejected where its share is above.
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
#: Rules: a share between 0 and 1 from the columns of ``measures``.
RULES = {
    "symbol_share": "_n_symbols / _word_chars",
    "loud_share": "_n_loud / _word_chars",
    "dup_line_share": "_n_dup_lines / _n_lines",
    "repeat_share": "_n_repeat_words / _n_words",
}


def repeated_words(windows: Column, ordered: Column) -> Column:
    """Words covered by windows that occur twice or more; ``ordered`` is the sorted (hash, place) array, null if all differ."""
    same = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
    places = F.array_sort(F.transform(same, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-GRAM).alias("last"))
    total = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(GRAM), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(windows.isNull() | ordered.isNull(), F.lit(0)).otherwise(total).cast("long")


def measures(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """``docs`` with the base columns and the shares, all under names that begin with ``_``."""
    trimmed = F.btrim(whole_text(text), F.lit(SPACE))
    lines = F.filter(F.split(whole_text(text), "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    df = docs.withColumns({
        "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)),
        "_lines": lines,
        "_n_symbols": F.regexp_count(whole_text(text), F.lit(SYMBOLS)).cast("long"),
        "_n_loud": F.regexp_count(whole_text(text), F.lit(LOUD)).cast("long"),
    })
    window = F.transform(F.sequence(F.lit(0), F.size("_words") - GRAM), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(GRAM)]))
    df = df.withColumn("_windows", F.when(F.size("_words") > GRAM, window))
    df = df.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"),
                                          F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumns({
        "_n_words": F.size("_words").cast("long"),
        "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_repeat_words": repeated_words(F.col("_windows"), F.col("_ordered")),
        "_stratum": F.col(stratum).cast("string"),
    }).drop("_words", "_lines", "_windows", "_ordered")
    df = df.withColumn("_base_failed", (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words")))
    return df.withColumns({f"_{name}": F.coalesce(F.expr(f"try_divide({share.split(' / ')[0]}, {share.split(' / ')[1]})"), F.lit(0.0)) for name, share in RULES.items()})


def at_most(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the probability of k by its logarithm, the smaller counts by their ratios to it."""
    log_k = F.expr(f"aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE array() END, 0.0D, (a, j) -> a + ln(({n} - j + 1D) / j))")
    odds = (1 - p) / p
    below = F.expr(f"aggregate(CASE WHEN {k} > 0 THEN sequence({k}, 1L, -1L) ELSE array() END, named_struct('s', 1.0D, 't', 1.0D), "
                   f"(a, j) -> named_struct('s', a.s + a.t * j / ({n} - j + 1D) * {odds!r}D, 't', a.t * j / ({n} - j + 1D) * {odds!r}D), a -> a.s)")
    small = F.exp(log_k + F.col(k) * F.log(F.lit(p)) + (F.col(n) - F.col(k)) * F.log(F.lit(1 - p))) * below
    return F.when(F.col(k) >= F.col(n) * p, F.lit(1.0)).otherwise(small)


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(_stratum, one column per rule): the chosen cutoffs, null where a rule has none."""
    good = labels.where(F.col(label) == 1).select(F.col(key).alias("_label_id")).distinct()
    held = measured.where("not _base_failed").select(F.col(key).alias("_label_id"), "_stratum", *[f"_{r}" for r in RULES]).join(good, "_label_id", "left_semi")
    counts = scratch(held.groupBy("_stratum").agg(F.count("*").alias("n"), *[
        F.sum((F.col(f"_{rule}") > cut).cast("long")).alias(f"{rule}_{i}") for rule in RULES for i, cut in enumerate(CUTOFFS)]), "strata")
    tests = counts.select("_stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cut"), F.col(f"{rule}_{i}").alias("k"))
        for rule in RULES for i, cut in enumerate(CUTOFFS)])).alias("t")).select("_stratum", "n", "t.*")
    tested = tests.withColumn("stands", at_most("k", "n", alpha / len(RULES)) <= delta / (max(1, counts.count()) * len(RULES)))
    run = Window.partitionBy("_stratum", "rule").orderBy("step")
    standing = tested.withColumn("stands", F.min("stands").over(run)).where("stands")
    return standing.groupBy("_stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"_max_{rule}") for rule in RULES])


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` with ``_kept``."""
    limits = chosen.withColumnRenamed("_stratum", "_limit_of")
    joined = measured.join(limits, F.col("_stratum").eqNullSafe(F.col("_limit_of")), "left").drop("_limit_of")
    passed = F.lit(True)
    for rule in RULES:
        passed = passed & F.coalesce(F.col(f"_{rule}") <= F.col(f"_max_{rule}"), F.lit(True))
    return joined.withColumn("_kept", ~F.col("_base_failed") & passed)


def select(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    mark = F.xxhash64(whole_text(text))
    narrow = scratch(measures(docs.select(key, text, stratum), text, stratum).withColumn("_mark", mark).drop(text), "measures")
    chosen = scratch(cutoffs(narrow, labels, key), "cutoffs")
    kept = judge(narrow, chosen).where("_kept").select(F.col(key).alias("_kept_id"), F.col("_stratum").alias("_kept_stratum"), F.col("_mark").alias("_kept_mark")).distinct()
    same = docs[key].eqNullSafe(F.col("_kept_id")) & docs[stratum].cast("string").eqNullSafe(F.col("_kept_stratum")) & (mark == F.col("_kept_mark"))
    return docs.join(kept, same, "left_semi")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    narrow = scratch(measures(docs.select("doc_id", "text", "lang")).drop("text"), "measures")
    chosen = scratch(cutoffs(narrow, labels), "cutoffs")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(narrow, chosen).select("doc_id", *[F.col(f"_{c}").alias(c) for c in names])
