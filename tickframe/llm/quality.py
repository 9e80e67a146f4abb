"""Quality rules with thresholds that adapt to each language and source.

Only DataFrame functions are used.  A group's quantiles come from a sketch of
counts per value step; sketches of sources add up to those of their language and of
the whole table, which stand in for groups with few texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = "array<struct<h:bigint,p:int>>"
#: Value steps of the sketches; a sketch has at most this many counts per measure.
STEPS = 2000
#: Upper quantiles and how many quarter spreads (upper quartile to median) they lie above the median in a normal distribution.
TAILS = {0.75: 1.0, 0.85: 1.54, 0.95: 2.44, 0.99: 3.45}
#: Per measure: how many spreads from the median are still kept, the least spread that counts (in steps), the highest tail, two-sided or not.
#: Junk has many symbols and odd words, so those tails end below its share; repeats are zero in most texts and show only far out.
RULES = {"symbols": (6, 4, 0.85, False), "dup_lines": (6, 10, 0.99, False), "repeats": (6, 10, 0.99, False), "length": (6, 2, 0.85, True)}
MIN_TEXTS = 200


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of each row.

    Repeated three-word windows are found by sorting the windows' hashes inside
    the row: equal neighbours repeat, and the words they cover are counted from
    the gaps between their places.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
                       F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
                       F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
                       F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    base = ["doc_id", "lang", "source", "text_hash", F.col("n_symbols"), F.size("words").cast("bigint").alias("n_words"),
            F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines")]
    at = lambda i: F.get("words", i)
    windows = F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")))).otherwise(F.array().cast(_EMPTY))
    step = step.select(*base, F.sort_array(windows).alias("w"))
    base = ["doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    twice = F.filter("w", lambda x, i: (x["h"] == F.get("w", i - 1)["h"]) | (x["h"] == F.get("w", i + 1)["h"]))
    step = step.select(*base, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda v, i: F.least(F.lit(3), F.get("p", i + 1) - v)), F.lit(0), lambda a, b: a + b)
    return step.select(*base, covered.cast("bigint").alias("n_repeat_words"))


def _steps() -> dict[str, Column]:
    """Each measure in whole steps: thousandths, or twentieths of a character for the mean word length."""
    per = lambda a, b, k: F.least(F.floor(F.lit(k) * F.col(a) / F.greatest(F.col(b), F.lit(1))), F.lit(STEPS))
    return {"symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000),
            "repeats": per("n_repeat_words", "n_words", 1000), "length": per("word_chars", "n_words", 20)}


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Median, upper and lower spread, in steps, and the number of texts of each group and measure.

    A spread is the largest of the measure's tails, each as a share of its distance in a normal distribution.
    """
    order = Window.partitionBy(*by, "measure").orderBy("step")  # at most STEPS + 1 rows per group
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = sketch.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "all", F.sum("n").over(every))
    first = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * F.lit(q), F.col("step")))
    found = cum.groupBy(*by, "measure").agg(
        first(0.5).alias("mid"), *[first(q).alias(f"h{k}") for k, q in enumerate(TAILS)],
        *[first(round(1 - q, 2)).alias(f"l{k}") for k, q in enumerate(TAILS)], F.max("all").alias("texts"))
    last = F.lit(0.0)
    for name, rule in RULES.items():
        last = F.when(F.col("measure") == name, F.lit(rule[2])).otherwise(last)
    wide = lambda side, sign: F.greatest(*[F.when(F.lit(q) <= last, sign * (F.col(f"{side}{k}") - F.col("mid")) / F.lit(z))
                                           for k, (q, z) in enumerate(TAILS.items())])
    return found.select(*by, "measure", "mid", wide("h", 1).alias("up"), wide("l", -1).alias("down"), "texts")


def fences(judged: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(g_lang, g_source, low_length, high_<measure>…) per language and source, from its own sketch or a merged one."""
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("int").alias("step")) for k, c in _steps().items()]))
    by_source = (judged.select("g_lang", "g_source", spread.alias("x")).select("g_lang", "g_source", "x.*")
                 .groupBy("g_lang", "g_source", "measure", "step").agg(F.count(F.lit(1)).alias("n")))
    by_lang = by_source.groupBy("g_lang", "measure", "step").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("measure", "step").agg(F.sum("n").alias("n"))
    own = _quantiles(by_source, ["g_lang", "g_source"])
    lang = _quantiles(by_lang, ["g_lang"]).select("g_lang", "measure", *[F.col(c).alias(f"l_{c}") for c in ("mid", "up", "down", "texts")])
    all_ = _quantiles(whole, []).select("measure", *[F.col(c).alias(f"a_{c}") for c in ("mid", "up", "down")])
    pick = lambda c: (F.when(F.col("texts") >= min_texts, F.col(c)).when(F.col("l_texts") >= min_texts, F.col(f"l_{c}"))
                      .otherwise(F.col(f"a_{c}")))
    chosen = own.join(lang, ["g_lang", "measure"]).join(all_, "measure").select(
        "g_lang", "g_source", "measure", *[pick(c).alias(c) for c in ("mid", "up", "down")])
    out = []
    for name, (times, least, _, both) in RULES.items():
        reach = lambda c: F.lit(times) * F.greatest(F.col(c), F.lit(float(least)))  # noqa: B023, E731
        mine = F.col("measure") == name
        out.append(F.max(F.when(mine, F.col("mid") + reach("up"))).alias(f"high_{name}"))
        if both:
            out.append(F.max(F.when(mine, F.col("mid") - reach("down"))).alias(f"low_{name}"))
    return chosen.groupBy("g_lang", "g_source").agg(*out)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
           min_texts: int = MIN_TEXTS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text_hash) for each row.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated
    three-word windows.  The others are kept unless a measure (symbols per
    character, repeated lines, repeated words, mean word length) lies outside the
    fence around its group's median.  Fences come from all texts that
    passed the base rules.  A null or empty text has no words and fails; a null language or source
    is a group of its own; groups with fewer than ``min_texts`` texts use their
    language's fences, or those of the whole table.  Repeated rows are judged alike; an
    empty table gives no rows; other columns are ignored.
    """
    store = Store(docs.sparkSession, "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = store.keep(measures(docs, id_col, text_col, lang_col, source_col).select(
        "*", failed.alias("base_failed"), known("lang").alias("g_lang"), known("source").alias("g_source")), "measures")
    limit = store.keep(fences(rows.where(~F.col("base_failed")), min_texts), "fences")
    fits = F.lit(True)
    for name, c in _steps().items():
        fits = fits & (c <= F.col(f"high_{name}"))
        if RULES[name][3]:
            fits = fits & (c >= F.col(f"low_{name}"))
    kept = ~F.col("base_failed") & F.coalesce(fits, F.lit(False))
    return rows.join(limit, ["g_lang", "g_source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "text_hash")
