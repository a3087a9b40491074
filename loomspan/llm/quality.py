"""Quality rules: repetition and length rules, and distribution divergence from language references.

Only DataFrame functions; every document is judged by its own row against references that are fitted on all rows
labelled as good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, joined_if_small, let, packed, table, words, written

#: Classes of characters: each takes what it matches of what the ones before have left.
CLASSES = {"lower": r"\p{Ll}+", "space": r"\s+", "upper": r"\p{Lu}+", "point": r"[.,;:!?'\"()’«»-]+", "digit": r"[0-9]+"}

#: Common words of a language's reference, and labelled documents and their words that a reference needs at least.
COMMON, DOCS_LEAST, WORDS_LEAST = 20, 20, 2_000
#: Ids of labelled documents that are broadcast at most.
SMALL = 2_000_000
#: lang -> (shares of the classes above among characters (the rest: anything else), {common word: share of words})
References = dict[str, tuple[tuple[float, ...], dict[str, float]]]
#: Greatest Jensen-Shannon distances (base 2, from 0 to 1), and the lengths below which a
#: histogram says too little and its test is not made.
CHAR_MOST, CHAR_LEAST_CHARS = 0.25, 200
WORD_MOST, WORD_LEAST_WORDS = 0.45, 50
#: Greatest sum of both distances, where both are measured.
BOTH_MOST = 0.45
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


def removed(text: Column, chars: str) -> Column:
    """Text without the given characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def covered_words(w: Column, k: int = 5) -> Column:
    """Words that lie in a run of ``k`` words which the array holds twice or more.

    Runs are compared by 64-bit hashes. Only rows with a repeated run sort theirs.
    """

    def runs(a: Column) -> Column:
        return F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    def places(s: Column) -> Column:  # s: sorted (run, place)
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def cover(p: Column) -> Column:  # p: sorted places of repeated runs
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(p, start, lambda a, x: F.struct((a["n"] + x + k - F.greatest(a["end"], x)).alias("n"), (x + k).alias("end")), lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), cover(let(pairs, places))).otherwise(0)

    return let(let(w, runs), count).cast("long")


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance, base 2, of two distributions given as columns."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = F.lit(0.0)
    for a, b in zip(p, q):
        total = total + part(a, (a + b) / 2) + part(b, (a + b) / 2)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def by_language(lang: Column, values: dict[str, Column]) -> Column:
    """The value of a language, null of others."""
    if not values:
        return F.lit(None)
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lang)


def class_lengths(text: Column) -> list[tuple[str, Column]]:
    """What is left of a text after each class is taken away, in turn."""
    out, left = [], text
    for name, pattern in CLASSES.items():
        left = F.regexp_replace(left, pattern, "")
        out.append((name, left))
    return out


def fitted_references(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> References:
    """Histograms of the documents labelled as good (quality = 1), by language.

    The shares of character classes and of the COMMON most frequent words (ties by the word) are those of
    all texts of a language together that are long enough to be tested. Languages of fewer than DOCS_LEAST such documents
    or WORDS_LEAST words have none. All labelled documents are read; only the sums and common words come to the driver.
    """
    good = written(labels.filter("quality = 1").select(F.col(key).alias("_good")).distinct(), "qu-good")
    d = docs.select(F.col(key).alias("_good"), F.col(text).alias("_t"), F.col(lang).alias("_l")).filter((F.length("_t") >= CHAR_LEAST_CHARS) & F.col("_l").isNotNull())
    d = joined_if_small(d, good, ["_good"], "left_semi", SMALL)
    lengths = [F.length("_t"), *(F.length(x) for _, x in class_lengths(F.col("_t")))]
    shares = d.groupBy("_l").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(x.cast("long")).alias(f"_n{i}") for i, x in enumerate(lengths)]).filter(F.col("docs") >= DOCS_LEAST).collect()
    each = written(d.select("_l", F.explode(words(F.col("_t"))).alias("w")).groupBy("_l", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n")), "qu-words")
    n_words = {r["_l"]: r["n"] for r in each.groupBy("_l").agg(F.sum("n").alias("n")).filter(F.col("n") >= WORDS_LEAST).collect()}
    out: References = {r["_l"]: (tuple((r[f"_n{i}"] - r[f"_n{i + 1}"]) / r["_n0"] for i in range(len(CLASSES))), {}) for r in shares if r["_l"] in n_words}
    best = each.withColumn("k", F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("n"), "w"))).filter(F.col("k") <= COMMON)
    for r in best.orderBy("_l", "k").collect():
        if r["_l"] in out:
            out[r["_l"]][1][r["w"]] = r["n"] / n_words[r["_l"]]
    drop(good, each)
    return out


def quality_rules(docs: DataFrame, references: References, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance and kept; columns of these names are replaced.

    A null text is an empty one: no words, base_failed. The distances are null, and don't
    reject, where the text is shorter than its guard or the language has no reference (see fitted_references).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text)))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    d = d.withColumn("_known", let(F.col("_w"), lambda w: F.filter(F.transform(w, F.lower), lambda x: x.isin(sorted({x for _, r in references.values() for x in r})))))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(removed(t, SPACES)).cast("long"),
        "n_symbols": (F.length(t) - F.length(removed(t, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered_words(F.col("_w")),
        "_n_chars": F.length(t),
    })
    names = []
    for name, left in class_lengths(t):  # each class from what the one before has left
        d = d.withColumn(f"_left_{name}", left if not names else F.regexp_replace(F.col(names[-1]), CLASSES[name], ""))
        names.append(f"_left_{name}")
    lengths = [F.col("_n_chars"), *(F.length(n) for n in names), F.lit(0)]
    shares = [(a - b) / F.col("_n_chars") for a, b in zip(lengths, lengths[1:])]
    key = F.col(lang)
    expected = [by_language(key, {k: F.lit(r[0][i] if i < len(CLASSES) else 1 - sum(r[0])) for k, r in references.items()}) for i in range(len(CLASSES) + 1)]
    known = key.isin(list(references)) if references else F.lit(False)
    measured = (F.col("_n_chars") >= CHAR_LEAST_CHARS) & known
    d = d.withColumn("char_distance", F.when(measured, js_distance(shares, expected)) if references else F.lit(None).cast("double"))

    n = F.col("n_words")
    common = by_language(key, {k: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(q).alias("q")) for x, q in r[1].items()]) for k, r in references.items()})
    if not references:
        common = F.array().cast("array<struct<x:string,q:double>>")
    d = d.withColumn("_hist", F.when((n >= WORD_LEAST_WORDS) & known, let(F.col("_known"), lambda have: F.transform(common, lambda r: F.struct((F.size(F.filter(have, lambda x: x == r["x"])) / F.col("n_words")).alias("p"), r["q"].alias("q"))))))
    rest = F.struct((1 - F.aggregate("_hist", F.lit(0.0), lambda a, x: a + x["p"])).alias("p"), (1 - F.aggregate("_hist", F.lit(0.0), lambda a, x: a + x["q"])).alias("q"))
    d = d.withColumn("_hist", F.concat("_hist", F.array(rest)))

    def both(x: Column) -> Column:
        m = (x["p"] + x["q"]) / 2
        return F.when(x["p"] > 0, x["p"] * F.log2(x["p"] / m)).otherwise(0.0) + F.when(x["q"] > 0, x["q"] * F.log2(x["q"] / m)).otherwise(0.0)

    distance = F.sqrt(F.greatest(F.aggregate("_hist", F.lit(0.0), lambda a, x: a + both(x)) / 2, F.lit(0.0)))
    d = d.withColumn("word_distance", F.when(F.col("_hist").isNotNull(), distance))
    d = d.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    c, x = F.col("char_distance"), F.col("word_distance")
    fine = (F.coalesce(c, F.lit(0.0)) <= CHAR_MOST) & (F.coalesce(x, F.lit(0.0)) <= WORD_MOST) & (F.coalesce(c + x, F.lit(0.0)) <= BOTH_MOST)
    return d.withColumn("kept", ~F.col("base_failed") & fine).drop("_w", "_lines", "_known", "_n_chars", "_hist", *names)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules(docs, fitted_references(docs, table(spark, sf_dir, "labels")))
    return out.select(*RESULT, F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go. Other columns, whatever their names, are carried along."""
    references = fitted_references(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules(packed(docs, text=F.col("text"), lang=F.col("lang")), references)
    # a row number isn't deterministic to the optimizer: without it the filter would be pushed below
    # the projections that share the words, and each use of them would split the text again
    return judged.withColumn("_n", F.monotonically_increasing_id()).filter("kept and _n >= 0").select("_row.*")
