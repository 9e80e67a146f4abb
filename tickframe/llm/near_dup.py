"""Near-duplicate documents: one-permutation hashing with optimal densification, bands, star-shaped candidates.

Documents with the same shingle set form a class and are handled once.  Each
class gets one hash per bin from a single permutation; an empty bin borrows from
the first filled bin of a random order of its own, so signatures of small sets
stay independent per bin.  Members of a band's bucket are compared with the
bucket's hub only (the member that shares most buckets), which bounds the pairs by
the members.  A link between two members that are not linked to the hub could be
lost that way; buckets that still hold several components are therefore
finished by exact bounds on the places of shared shingles, which leave few pairs
to compare.  All links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .filters import bit_table, passing
from .store import Store
from .words import find, grams, mix, pieces, stream

_U = np.uint64
_SKETCH = "doc_id bigint, h bigint, n bigint, cls binary, bands array<bigint>"
_NO_ID = (1 << 63) - 1
_SETS = "cls binary, n bigint, shingles array<bigint>"


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of each text."""
    whole = stream(size, 41)
    for batch in batches:
        for part, data, bounds in pieces(batch):
            w = find(data, bounds)
            hashed, _ = grams(w, size)
            out = []
            for a, b in zip(w.first[:-1], w.first[1:]):
                if b - a >= size:
                    out.append(np.unique(hashed[a:b - size + 1]))
                else:  # a short text is one shingle, none without words
                    out.append(mix((w.hash[a:b] * whole[:b - a]).sum(keepdims=True) + _U(b - a))[:int(b > a)])
            yield part, out


def _digest(u: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return b"".join(int(mix(u ^ _U(s)).sum()).to_bytes(8, "big") for s in (0x5BD1E995, 0xC2B2AE35))


def _orders(bins: int) -> np.ndarray:
    """For each bin, the rank of every bin in its own random order; a bin is the first of its order."""
    rank = np.argsort(np.argsort(mix(stream(bins * bins, 53)).reshape(bins, bins), axis=1), axis=1).astype(np.int32) + 1
    np.fill_diagonal(rank, 0)
    return rank


def signature(u: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of a non-empty sorted set, empty bins filled from the first filled bin in their order."""
    bins = len(rank)
    at = ((u >> _U(32)) * _U(bins)) >> _U(32)
    filled, first = np.unique(at, return_index=True)
    filled = filled.astype(np.int64)
    out = np.empty(bins, _U)
    out[filled] = u[first]
    empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
    if len(empty):
        out[empty] = u[first][rank[np.ix_(empty, filled)].argmin(axis=1)]
    return out


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weight, salt = _orders(bands * rows), stream(rows, 59), stream(bands, 61)
        for part, sets in _sets(batches, size):
            keys = [(mix((signature(u, rank).reshape(bands, rows) * weight).sum(axis=1) + salt)).view(np.int64)
                    if len(u) else None for u in sets]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), pa.array([len(u) for u in sets], pa.int64()),
                pa.array([_digest(u) if len(u) else None for u in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "n", "cls", "bands"])
    return run


def _full_sets(size: int, bits: np.ndarray):
    """Class and shingles of the texts whose key (third column) passes the filter."""
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(bits, batch.column(2).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(wanted(batches), size):
            sets = [u for u in sets if len(u)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_digest(u) for u in sets], pa.binary()), pa.array([len(u) for u in sets], pa.int64()),
                pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))], ["cls", "n", "shingles"])
    return run


def _similar(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return F.lit(100) * shared >= F.lit(percent) * (n_a + n_b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("bigint")
    return (pairs.join(left, "a").join(right, "b")
            .where(_similar(shared, F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))


def _sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets that differ more in size can't be similar enough."""
    return F.lit(100) * F.least(n_a, n_b) >= F.lit(percent) * F.greatest(n_a, n_b)


def _rest(members: DataFrame, sets: DataFrame, label: DataFrame, percent: int, store: Store) -> DataFrame:
    """Pairs that may still be similar, from buckets with more than one component.

    Shingles of these classes are ordered from the rarest to the commonest.  Two
    sets with a similarity of t share a shingle within the first
    n - ceil(t * n) + 1 of each, and nothing before it, so a shared shingle at place
    i leaves an overlap of n - i at most and a partner of at most
    (n - i) * (1 + t) / t - n shingles.  Classes meet at such shingles in steps of
    the partner's size; those of the shingle's largest component are not compared with each other.
    """
    t = percent / 100
    placed = members.join(label.withColumnRenamed("a", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    mixed = placed.join(open_keys, "key", "left_semi").select("cls", "root").distinct()
    held = store.keep(sets.join(mixed, "cls").select("cls", "root", "n", F.explode("shingles").alias("s")), "held")
    common = held.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = held.join(common, "s").groupBy("cls").agg(F.min("root").alias("root"), F.min("n").alias("n"),
                                                       F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))  # of one set
    first = F.col("n") - F.size("shared")  # shingles of no other class come before the shared ones
    reach = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1 - first).cast("int")
    prefix = ranked.select("cls", "root", "n", first.alias("first"), F.posexplode(F.slice("shared", F.lit(1), reach)).alias("i", "x"))
    most = (F.col("n") - F.col("first") - F.col("i")) * F.lit((1 + t) / t) - F.col("n") + F.lit(1e-6)
    prefix = store.keep(prefix.select("cls", "root", "n", F.col("x.s").alias("s"), most.alias("most"))
                        .where(F.col("most") >= F.col("n") * t), "prefix")
    crowd = prefix.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(
        F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("major")).where("roots > 1")
    step = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))
    side = lambda df, x: df.select("s", "step", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "root", "most")])
    meeting = prefix.join(crowd.select("s", F.col("major.root").alias("major")), "s")
    a = side(meeting.where("root <> major").withColumn(
        "step", F.explode(F.sequence(step(F.col("n") * t) - 1, step(F.col("most")) + 1))), "a")
    b = side(meeting.withColumn("step", step(F.col("n"))), "b")
    return (a.join(b, ["s", "step"])
            .where((F.col("root_a") != F.col("root_b")) & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
                   & _sizes_fit(F.col("n_a"), F.col("n_b"), percent))
            .select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 75, bands: int = 40, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, chosen) for each row of ``docs``.

    Two texts are linked if their sets of ``shingle`` words have a Jaccard
    similarity of at least ``percent`` / 100; with 40 bands of 4 rows a pair at
    0.75 misses all bands with a probability of 2.5e-7.  ``component_id`` is the smallest id in the connected
    component and ``kept`` marks that row.  A text without words, an empty text
    and a null have no shingles and are linked with nothing (n_shingles 0, kept).
    A null id takes part in links but is never the smallest id unless all ids of its
    component are null.  Rows that share an id are all marked like that id; ``chosen``
    marks one text per component even then, named by (doc_id, text_hash), the
    xxhash64 of the text.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    store = Store(spark, "near-dup")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows_ = store.keep(base.mapInArrow(_sketches(shingle, bands, rows), _SKETCH), "sketch")
    full = rows_.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("n").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("k"), "h")).alias("first"),
                                      F.min_by("bands", "h").alias("bands"))
    spread = classes.select("cls", "n", "first", F.explode("bands").alias("key"))
    crowd = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = store.keep(spread.join(crowd, "key"), "members")

    # full sets of the classes that share a bucket with another
    wanted = members.select("cls", "first").distinct()
    named = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("k"), "h")
    bits = bit_table(wanted.select("first.*"), F.xxhash64("k", "h"))
    texts = named.select("doc_id", "text", F.xxhash64("k", "h").alias("key"))
    sets = store.keep(texts.mapInArrow(_full_sets(shingle, bits), _SETS)
                      .join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    # a star in each bucket, around the member that shares most buckets
    hub = members.groupBy("cls").agg(F.sum("m").alias("weight"))
    weighed = members.join(hub, "cls")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "cls", "n")).alias("c")).select(
        "key", F.col("c.cls").alias("a"), F.col("c.n").alias("n_a"))
    stars = (members.join(centre, "key").where((F.col("a") != F.col("cls")) & _sizes_fit(F.col("n"), F.col("n_a"), percent))
             .select("a", F.col("cls").alias("b")).distinct())
    linked = store.keep(_confirmed(stars, sets, percent), "stars")
    label = components(linked, store, "first")
    more = _confirmed(_rest(members.select("key", "cls"), sets, label, percent, store), sets, percent)
    label = components(label.select("a", F.col("root").alias("b")).union(more), store, "all")

    named = classes.select("cls", "first").join(label.withColumnRenamed("a", "cls"), "cls", "left").select(
        "cls", "first", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = store.keep(named.join(least, "root").select("cls", F.col("component_id").alias("least")), "names")
    store.drop("members", "sets", "stars", "held", "prefix")
    id_ = F.when(F.col("least.k") != _NO_ID, F.col("least.k"))
    chosen = (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("least.k")) & (F.col("h") == F.col("least.h"))
    alone = rows_.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("chosen", F.lit(True))
    grouped = full.join(of_class, "cls").withColumn("component_id", id_).withColumn("chosen", chosen)
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
           F.col("h").alias("text_hash"), "chosen"]
    return grouped.select(*out).union(alone.select(*out))
