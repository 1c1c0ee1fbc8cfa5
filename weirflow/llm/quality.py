"""Quality rules whose cutoffs carry a statistical guarantee.

Each rule rejects a document whose statistic exceeds a cutoff, from a fixed grid. Each
stratum has one sequence of sets of cutoffs, all rules together, from the loosest to the
tightest: the grids of all rules are walked side by side, and steps that reject no
further labelled bad document are left out. The sequence does not depend on the good
documents, which alone are tested. A set of cutoffs counts as safe when the exact
binomial tail P(Bin(n, alpha) <= k) of the k false rejections of all its rules together
among n good documents is at most the level of the test; testing stops at the first
failure (fixed-sequence testing, which needs no correction along the sequence), and only
the strata divide the level (Bonferroni). So with probability ``1 - delta`` in no
stratum the rules together reject more than ``alpha`` of the good documents that pass
the base. Cutoffs looser than certified ones reject less, so each rule may choose freely
among those. With no false rejection a stratum needs ln(delta / strata) / ln(1 - alpha)
good labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Statistics: name, expression over the counts; all are rejected when too large.
RULES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
}
#: Cutoffs of each rule, loosest first; they do not depend on the data.
GRID = {
    "symbols_per_word": [5, 4, 3, 2, 1.5, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "dup_lines_per_word": [0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "repeat_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "chars_per_word": [60, 40, 30, 25, 20, 18, 16, 14, 12, 11, 10],
    "shouts_per_word": [5, 4, 3, 2, 1.5, 1, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1],
}
#: All steps of all grids, by their place within the grid: position, rule, step, cutoff.
SEQUENCE = [
    (at, rule, step, float(cutoff))
    for at, (_, _, rule, step, cutoff) in enumerate(
        sorted(((i + 1) / len(GRID[name]), r, name, i, c) for r, name in enumerate(RULES) for i, c in enumerate(GRID[name]))
    )
]
#: Strata up to which the cutoffs are broadcast (a few KB); beyond, they are joined by a shuffle.
MAX_BROADCAST_STRATA = 1000


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def occurrences(text: Column, chars: str) -> Column:
    """How often any of some ASCII characters occurs, by the bytes that go with it."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows whose hashes are all different are all different, which settles most texts. Else
    windows become longs, hash bits above position bits, so one primitive sort brings equal
    ones together, and those that share their hash bits are compared by their words.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def count(h: Column) -> Column:
            low = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n.cast("long") + 1)).cast("int")) - 1
            high = F.bitwise_not(low)
            keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))

            def shared(s: Column) -> Column:
                top = lambda j: F.get(s, j).bitwiseAND(high)
                alike = lambda x, j: (x.bitwiseAND(high) == top(j + 1)) | ((j > 0) & (x.bitwiseAND(high) == top(j - 1)))
                found = F.filter(s, lambda x, j: F.coalesce(alike(x, j), F.lit(False)))
                return F.transform(found, lambda x: x.bitwiseAND(low).cast("int"))

            window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))

            def repeats(s: Column) -> Column:
                same = lambda x, j: (x["t"] == F.get(s, j + 1)["t"]) | ((j > 0) & (x["t"] == F.get(s, j - 1)["t"]))
                at = F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
                zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
                return F.aggregate(
                    at,
                    zero,
                    lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                    lambda a: a["n"],
                )

            several = let(let(keys, shared), lambda at: let(F.sort_array(F.transform(at, window)), repeats))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(several)

        return F.when(n >= 4, let(hashes, count)).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def text_statistics(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        (F.length(text) - occurrences(text, SPACES)).alias("word_chars"),
        occurrences(text, SYMBOLS).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        occurrences(text, "!").alias("n_shouts"),
    )
    return d.select(
        "doc_id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.r").alias("n_repeat_words"), "n_shouts",
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term on the log scale."""
    first = n * F.log1p(-p)
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def add(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) / i) + F.log(p) - F.log1p(-p)
        top = F.greatest(a["s"], term)
        return F.struct(term.alias("t"), (top + F.log(F.exp(a["s"] - top) + F.exp(term - top))).alias("s"))

    return F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), add, lambda a: a["s"])


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float, delta: float, price: float) -> DataFrame:
    """``stratum, rule, cutoff``: per stratum and rule the safe cutoff of best use.

    Among the certified cutoffs of a rule the one with the greatest (bad rejected -
    ``price`` * good rejected) is taken, the loosest of equals. Rules without a
    certified or useful cutoff have no row. labels: ``doc_id, quality``; null
    qualities are left out and a document labelled twice counts with its lower one.
    """
    lab = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # a statistic exceeds the tightest cutoffs first: a rule rejects from its step `first` on
    firsts = F.map_from_arrays(
        F.array(*[F.lit(name) for name in RULES]),
        F.array(*[sum((F.when(F.expr(expr) > float(c), 0).otherwise(1) for c in GRID[name]), F.lit(0)) for name, expr in RULES.items()]),
    )
    held = stats.filter(~F.col("base_failed")).join(lab, "doc_id").select("stratum", (F.col("quality") >= 1).alias("good"), firsts.alias("first"))
    held = written(held, "labelled")
    steps = "array(" + ", ".join(f"struct({at} as at, '{rule}' as rule, {step} as step, {cut}D as cutoff)" for at, rule, step, cut in SEQUENCE) + ")"
    catches = F.explode(F.expr(f"filter({steps}, x -> x.step = first[x.rule])"))
    paths = held.filter("not good").select("stratum", catches.alias("x")).distinct().groupBy("stratum").agg(F.collect_list("x").alias("path"))
    joint = F.expr("array_min(transform(filter(path, x -> x.step >= first[x.rule]), x -> x.at))")
    count = lambda what: F.sum(F.expr(f"if({what}, 1L, 0L)"))
    tested = (
        held.join(paths, "stratum")
        .select("stratum", "good", "first", joint.alias("joint"), F.explode("path").alias("x"))
        .groupBy("stratum", "x.at", "x.rule", "x.step", "x.cutoff")
        .agg(
            count("good").alias("n"),
            count("good and coalesce(joint <= x.at, false)").alias("all_false_rejected"),
            count("good and first[x.rule] <= x.step").alias("false_rejected"),
            count("not good and first[x.rule] <= x.step").alias("rejected"),
        )
    )  # at most one row for each stratum and step
    tested = written(tested, "tested")
    level = math.log(delta / max(1, tested.select("stratum").distinct().count()))
    n, k, a = F.col("n"), F.col("all_false_rejected"), F.lit(float(alpha))
    safe = (n > 0) & (k <= n * a) & (log_binomial_tail(F.least(k, F.floor(n * a)), n, a) <= level)
    w = Window.partitionBy("stratum").orderBy("at")
    certified = (
        tested.withColumn("ok", F.min(F.when(safe, 1).otherwise(0)).over(w))
        .filter("ok = 1")
        .withColumn("use", F.col("rejected") - price * F.col("false_rejected"))
        .filter("use > 0")
    )
    return certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("use", -F.col("step"))).alias("cutoff"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    alpha: float = 0.01,
    delta: float = 0.05,
    price: float = 10.0,
) -> DataFrame:
    """Statistics and verdict of each document.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed_rules``. A null text has no words and fails the base; a
    null stratum is the stratum of the empty string. A stratum too small to certify a
    cutoff, or without labels, is judged by the base alone. Repeated rows are judged
    alike. Empty tables give an empty result, without labels no cutoff is learned.
    """
    stats = written(text_statistics(docs, id_col, text_col, stratum_col), "statistics")
    cutoffs = fit_cutoffs(stats, labels.select("doc_id", "quality"), alpha, delta, price)
    wide = written(
        cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == n, F.col("cutoff"))).alias(f"cut_{n}") for n in RULES]),
        "cutoffs",
    )
    if wide.count() <= MAX_BROADCAST_STRATA:
        wide = F.broadcast(wide)
    failed = F.array_compact(
        F.array(*[F.when(F.expr(f"n_words > 0 and {expr} > cut_{n}"), F.lit(n)) for n, expr in RULES.items()])
    )
    return (
        stats.join(wide, "stratum", "left")
        .withColumn("failed_rules", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
            "failed_rules",
        )
    )
