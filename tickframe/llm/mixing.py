"""Mixing sources to target weights by hash thresholds.

Every row has a reproducible 60-bit hash.  A source whose target is r times its
size takes all rows floor(r) times and those below a hash threshold once more:
nested budgets of which only the last is partial.  The threshold is found from
sums per source and hash bucket; only the bucket at the budget is refined, with
more bits of the hash, down to single hash values.  No row is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from .store import Store, column

WORD = r"[^\x20\x09-\x0D]+"
_LEVELS = ((48, 12), (32, 16), (0, 32))  # shift and bits of the hash at each refinement


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of md5 over id and text; equal rows share it."""
    whole = F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def source_key(source: str) -> Column:
    """A key that is never null, so that rows without a source form one."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, size, h): what mixing needs of each row."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), source_key(source_col).alias("key"),
                       n_words(text_col).alias("size"), row_hash(id_col, text_col).alias("h"))


def targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(key, source_size, target): the weights in code point order of the sources, at most ``most`` times a size.

    What a capped source can't take is shared anew by weight until no source is above
    its cap.  Each round reads two sums over one row per source.
    """
    total = sized.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("key") == "")
    placed = global_position(total, "last", ["key"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    share = placed.select("key", "source_size", weight.cast("bigint").alias("w"))
    everything = share.agg(F.sum("source_size")).head()[0] or 0
    cap, level, held = F.lit(most) * F.col("source_size"), 0.0, -1
    while True:
        over = F.lit(level) * F.col("w") > cap
        n, spent, free = share.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).head()
        if n == held or not free:
            break
        held, level = n, (everything - spent) / free
    want = F.lit(level) * F.col("w")
    return share.select("key", "source_size", F.when(want > cap, cap.cast("double")).otherwise(want).alias("target"))


def thresholds(sized: DataFrame, store: Store, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(key, source_size, target, full, upto): rows are taken ``full`` times, once more if their hash is at most ``upto``."""
    goal = targets(sized, weights, most)
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("bigint")
    goal = store.keep(goal.withColumn("full", full).withColumn("left", F.col("target") - F.col("full") * size), "goal")
    edge = goal.select("key", F.col("left"), F.lit(0).cast("bigint").alias("prefix"))
    rows, cumulated = sized, Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for level, (shift, bits) in enumerate(_LEVELS):
        # at most 2**bits sums per source, and from the second level on only of rows in its open bucket
        bucket = F.shiftright("h", shift)
        hist = (rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
                .withColumn("upto", F.sum("n").over(cumulated)).join(edge, "key")
                .withColumn("before", F.col("upto") - F.col("n")))
        if shift == 0:
            take = F.when(2 * F.col("before") + F.col("n") <= 2 * F.col("left"), F.col("bucket"))
            last = hist.groupBy("key").agg(F.max(take).alias("taken"))
            edge = edge.join(last, "key", "left").select("key", F.coalesce("taken", F.shiftleft("prefix", 32) - 1).alias("upto"))
        else:
            open_ = hist.where((F.col("before") <= F.col("left")) & (F.col("upto") > F.col("left")))
            edge = store.keep(open_.select("key", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("prefix")),
                              f"edge{level}")
            rows = sized.join(edge.select("key", "prefix"), (sized["key"] == edge["key"]) & (bucket == edge["prefix"]), "left_semi")
    return goal.join(edge, "key", "left").select("key", "source_size", "target", "full", F.coalesce("upto", F.lit(-1)).alias("upto"))


def copies() -> Column:
    return F.col("full") + F.when(F.col("h") <= F.col("upto"), F.lit(1)).otherwise(F.lit(0))


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row: how often the mix takes it.

    The size of a text is its number of words (null and empty: 0).  Sources in code
    point order, null last, get ``weights`` in turn, and all targets together
    are the size of the table.  The rows taken come as near to a source's target
    as whole rows in hash order allow.  Rows equal in id and text share a hash and are taken alike; texts
    of size 0 take nothing.  An empty table gives no rows; other columns are ignored.
    """
    store = Store(docs.sparkSession, "mix")
    sized = store.keep(measured(docs, id_col, text_col, source_col), "sized")
    limit = store.keep(thresholds(sized, store, weights, most), "limit")
    return sized.join(limit, "key").select("doc_id", "size", "source_size", "target", copies().alias("copies"),
                                           (copies() * F.col("size")).alias("taken"))


def resample(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mixture`` takes them, with all their columns."""
    store = Store(docs.sparkSession, "mix")
    sized = store.keep(measured(docs, id_col, text_col, source_col), "sized")
    limit = store.keep(thresholds(sized, store, weights, most), "limit")
    own = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("d"), source_key(source_col).alias("key"), row_hash(id_col, text_col).alias("h"))
    often = own.join(limit.select("key", "full", "upto"), "key").withColumn("copies", copies().cast("int"))
    return often.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("d.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
      CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
  o AS (SELECT *, 3.0::DOUBLE * source_size / w AS r, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
  c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
      sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
      sum(source_size) OVER () AS everything FROM o),
  l AS (SELECT CAST(arg_min(everything - spent, k) AS DOUBLE) / arg_min(free, k) AS level FROM c
      WHERE r >= CAST(everything - spent AS DOUBLE) / free),
  t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, level * w) AS target FROM s, l),
  u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS f FROM t),
  v AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, h),
  b AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS before FROM v)
SELECT d.doc_id, d.size, u.source_size, u.target,
  CAST(d.size * (u.f + CASE WHEN 2 * b.before + b.n <= 2 * (u.target - u.f * u.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN b ON b.source IS NOT DISTINCT FROM d.source AND b.h = d.h
"""
