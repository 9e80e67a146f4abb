"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two blocks of ``BLOCK`` words, one starting at each block,
so that every word of a text is covered.  Their TF-IDF rows over the benchmark's
terms (only these can weigh in a cosine with an item) are mapped to a latent
space found by randomised SVD.  Passages close to an item are candidates; the longest
common subsequence of words with the text around them decides, and for
paraphrases whether the item's answer, its last words, is there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import column
from .words import PUNCT, Words, buffers, find, grams, pieces

BLOCK = 32
MIN_WORDS = 8  # items with fewer words are found as they stand, all others in the latent space
ITEMS = 4096  # items searched at once
_PARTS = 64  # ranges of terms whose sums are added up apart
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                     T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("lcs", T.DoubleType())])


@dataclass
class Terms:
    """The sorted term hashes of the items, with a table that rejects most other words."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.gate = np.zeros(1 << 20, bool)
        self.gate[self.hashes >> np.uint64(44)] = True

    def rows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (block, term) pairs of the texts, and the first block of each text."""
        first = np.concatenate([[0], np.cumsum(-(-w.count // BLOCK))])
        at = np.flatnonzero(self.gate[w.hash >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.hashes, w.hash[at]), max(len(self.hashes) - 1, 0))
        hit = self.hashes[place] == w.hash[at] if len(at) else np.zeros(0, bool)
        at, place = at[hit], place[hit]
        text = np.searchsorted(w.first, at, "right") - 1
        block = first[text] + (at - w.first[text]) // BLOCK
        pair = np.unique(block * len(self.hashes) + place)
        return pair // max(len(self.hashes), 1), pair % max(len(self.hashes), 1), first


@dataclass
class Item:
    key: int | None
    masks: dict[int, int]  # of each word, the bits of its places in the item
    size: int
    answer: dict[int, int]
    answer_size: int


def _bits(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, h in enumerate(words):
        out[h] = out.get(h, 0) | 1 << k
    return out


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by one addition on bit rows per word."""
    row = full = (1 << size) - 1
    for h in words:
        m = masks.get(h)
        if m:
            row = ((row + (row & m)) | (row & ~m)) & full
    return size - row.bit_count()


def read_items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> tuple[
        list[tuple[Item, np.ndarray]], list[tuple[int | None, np.ndarray]]]:
    """The items of one block with their word hashes, the answer being its column or else the last sentence; ids and hashes of short items."""
    cols = [F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    out, short = [], []
    for key, text, *given in benchmark.select(*cols, *([F.col(answer_col).cast("string")] if answer_col else [])).collect():
        hashed = lambda t: find(*buffers(pa.array([t])), PUNCT).hash.tolist()
        words = hashed(text)
        if len(words) >= MIN_WORDS:
            last = hashed(given[0] if given and given[0] else re.split(r"(?<=[.!?])\s+", text.strip())[-1])
            last = last if len(last) >= 3 else words[-3:]
            out.append((Item(key, _bits(words), len(words), _bits(last), len(last)), np.array(words, np.uint64)))
        elif words:
            short.append((key, np.array(words, np.uint64)))
    return sorted(out, key=lambda x: (x[0].key is None, x[0].key, x[1].tolist())), short


def _counts(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(len(terms.hashes) + 1, np.int64), 0
        for batch in batches:
            for _, data, bounds in pieces(batch):
                _, term, first = terms.rows(find(data, bounds, PUNCT))
                total[:-1] += np.bincount(term, minlength=len(terms.hashes))
                total[-1] += first[-1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])
    return run


def _windows(block: np.ndarray, term: np.ndarray, vectors: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the vectors of the terms of each block and its next block in the same text.

    The k-th terms of all blocks are added at once; a block has ``BLOCK`` at most.
    """
    out = np.zeros((int(first[-1]) + 1, vectors.shape[1]), np.float32)
    if len(block):
        start = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(start, append=len(block))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        total = vectors[term[start]]
        for k in range(1, int(size[0])):
            more = int(np.searchsorted(-size, -k))  # blocks with more than k terms
            total[:more] += vectors[term[start[:more] + k]]
        out[block[start]] = total
    after = out[1:].copy()
    after[(first[1:] - 1)[np.diff(first) > 0]] = 0
    return out[:-1] + after


def _gram(terms: Terms, weight: np.ndarray, probe: np.ndarray):
    """Partial sums of transposed(A) · A · probe over the passages A of a partition, and of the squares of A · probe."""
    scaled = (weight[:, None] * probe).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(probe.shape)
        for batch in batches:
            for _, data, bounds in pieces(batch):
                block, term, first = terms.rows(find(data, bounds, PUNCT))
                y = _windows(block, term, scaled, first)
                g = y.copy()  # a block is in its own window and in the one before
                g[1:] += y[:-1]
                opening = first[:-1][np.diff(first) > 0]
                opening = opening[opening > 0]
                g[opening] -= y[opening - 1]
                order = np.argsort(term, kind="stable")
                if len(order):
                    start = np.flatnonzero(np.diff(term[order], prepend=-1))
                    mine, rows = term[order], block[order]
                    for lo, hi in zip(start.tolist(), np.append(start[1:], len(order)).tolist()):
                        total[mine[lo]] += g[rows[lo:hi]].sum(axis=0)
        parts = np.array_split((weight[:, None] * total).astype(np.float32), _PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS)), pa.array([z.tobytes() for z in parts], pa.binary())], ["range", "z"])
    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial sums of all partitions added up for each range of terms."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, z in zip(batch.column(0).to_pylist(), batch.column(1)):
            z = np.frombuffer(z.as_py(), np.float32).astype(float)
            total[k] = total[k] + z if k in total else z
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([z.astype(np.float32).tobytes() for z in total.values()], pa.binary())],
                                     ["range", "z"])


def _search(terms: Terms, space: np.ndarray, queries: np.ndarray, items: list[Item], close: float, same: float, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in pieces(batch):
                w = find(data, bounds, PUNCT)
                block, term, first = terms.rows(w)
                e = _windows(block, term, space, first)
                norm = np.sqrt((e * e).sum(axis=1))
                tested: dict[int, dict[int, float]] = {}
                for lo in range(0, len(e), 4096):
                    near = e[lo:lo + 4096] @ queries.T >= np.maximum(close * norm[lo:lo + 4096, None], 1e-6)
                    for j, i in zip(*np.nonzero(near)):
                        text = int(np.searchsorted(first, lo + j, "right") - 1)
                        item, best = items[i], tested.setdefault(text, {})
                        if best.get(i, 0) >= same:
                            continue
                        begin = int(w.first[text] + (lo + j - first[text]) * BLOCK)
                        words = w.hash[max(w.first[text], begin - item.size // 2):
                                       min(w.first[text + 1], begin + 2 * BLOCK + item.size // 2)].tolist()
                        share = common(item.masks, item.size, words) / item.size
                        if share >= same or share >= similar and common(item.answer, item.answer_size, words) >= 0.8 * item.answer_size:
                            best[i] = max(share, best.get(i, 0))
                found = [sorted({items[i].key for i in tested.get(d, {}) if items[i].key is not None}) for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(w.count), pa.array(found, pa.list_(pa.int64())),
                    pa.array([max(tested.get(d, {}).values(), default=0.0) for d in range(part.num_rows)], pa.float64()),
                    *part.columns[2:]], [*part.schema.names[:1], "n_words", "item_ids", "lcs", *part.schema.names[2:]])
    return run


def _exact(short: list[tuple[int | None, np.ndarray]]):
    """Short items by the hash of their words among all windows of as many words."""
    sizes: dict[int, dict[int, list]] = {}
    for key, words in short:
        one = Words(np.zeros(0, int), np.zeros(0, int), np.array([0, len(words)]), words)
        sizes.setdefault(len(words), {}).setdefault(int(grams(one, len(words))[0][0]), []).append(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in pieces(batch):
                w = find(data, bounds, PUNCT)
                found, hit = [set() for _ in range(part.num_rows)], np.zeros(part.num_rows)
                for n, items in sizes.items():
                    hashed, fits = grams(w, n)
                    for at in np.flatnonzero(fits & np.isin(hashed, np.array(list(items), np.uint64))):
                        text = int(np.searchsorted(w.first, at, "right") - 1)
                        found[text].update(k for k in items[int(hashed[at])] if k is not None)
                        hit[text] = 1.0
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(w.count), pa.array([sorted(x) for x in found], pa.list_(pa.int64())), pa.array(hit), *part.columns[2:]],
                    [*part.schema.names[:1], "n_words", "item_ids", "lcs", *part.schema.names[2:]])
    return run


def fit(base: DataFrame, found: list[tuple[Item, np.ndarray]], rank: int, seed: int) -> tuple[Terms, np.ndarray, np.ndarray]:
    """Terms, their latent vectors (weights times right singular vectors) and the items' latent directions."""
    terms = Terms(np.unique(np.concatenate([h for _, h in found])))
    n = len(terms.hashes)
    counted = base.mapInArrow(_counts(terms), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(n + 1)
    for term, c in counted:
        df[term] = c
    weight = np.log((df[-1] + 1) / (df[:-1] + 1))
    items = np.zeros((len(found), n))
    for k, (_, h) in enumerate(found):
        items[k, np.unique(np.searchsorted(terms.hashes, h))] = 1
    items *= weight
    probe = np.random.default_rng(seed).standard_normal((n, min(rank, n)))
    # the partitions' sums are added up by ranges of terms, in the order of the partitions; one sum comes to the driver
    partial = base.mapInArrow(_gram(terms, weight, probe), "range bigint, z binary").withColumn("part", F.spark_partition_id())
    sums = dict(partial.repartition(_PARTS, "range").sortWithinPartitions("range", "part").select("range", "z")
                .mapInArrow(_total, "range bigint, z binary").collect())
    z = np.frombuffer(b"".join(bytes(sums[k]) for k in sorted(sums)), np.float32).astype(float)
    z = z.reshape(probe.shape) if len(z) else np.zeros(probe.shape)
    # the items take part in the fit with the same total as all passages, so their directions are in the space
    own = items.T @ (items @ probe)
    basis, _ = np.linalg.qr(z / max(np.linalg.norm(z), 1e-12) + own / max(np.linalg.norm(own), 1e-12))
    space = (weight[:, None] * basis).astype(np.float32)
    direction = items @ basis
    direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-12)
    return terms, space, direction.astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", answer_col: str | None = None, rank: int = 192, close: float = 0.5,
                 same: float = 0.75, similar: float = 0.6, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, item_ids, lcs) for each row of ``docs``: the benchmark items its text holds.

    An item is found if a passage has a latent cosine of ``close`` with it and the
    text around shares a common subsequence of ``same`` of the item's words, or of ``similar`` and
    0.8 of its answer (``answer_col``, or the last sentence, three words at
    least).  Words are runs of letters, digits and non-ASCII characters, A-Z in
    lower case.  Inverse frequencies count all passages; the latent space is
    fitted on all passages and on the items; every passage is searched.  Items are a query set, taken in blocks of ``ITEMS``.  Items of fewer than ``MIN_WORDS``
    words are found where their words follow each other; null and empty ones have none.  A null item id is found but not listed.
    Null and empty texts have no words and no items; repeated rows are judged alike; an
    empty table of either kind gives no finds.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return search(base, benchmark, item_col, item_text, answer_col, rank, close, same, similar, seed)


def search(base: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text",
           answer_col: str | None = None, rank: int = 192, close: float = 0.5, same: float = 0.75, similar: float = 0.6,
           seed: int = 7) -> DataFrame:
    """``contaminated`` on a table whose first two columns are doc_id and text; further columns are passed through unchanged."""
    extra = [column(c) for c in base.columns[2:]]
    blocks = -(-benchmark.count() // ITEMS)
    passes, short = [], []
    for k in range(blocks):
        mine = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(blocks)) == k)
        found, few = read_items(mine, item_col, item_text, answer_col)
        short += few
        if found:
            passes.append(_search(*fit(base.select("doc_id", "text"), found, rank, seed), [i for i, _ in found], close, same, similar))
    passes += [_exact(short)] if short else []
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"), F.lit(1)))
    now = base.withColumn("_items", F.array().cast("array<bigint>")).withColumn("_lcs", F.lit(0.0))
    if not passes:
        now = now.withColumn("n_words", n.cast("bigint"))
    for k, step in enumerate(passes):
        if k + 1 < len(passes):  # the next pass reads the text again
            now = now.withColumn("_text", F.col("text"))
        hit = now.mapInArrow(step, T.StructType([*_OUT.fields, *now.schema.fields[2:]]))
        now = hit.select("doc_id", *([F.col("_text").alias("text")] if k + 1 < len(passes) else ["n_words"]), *extra,
                         F.concat("_items", "item_ids").alias("_items"), F.greatest("_lcs", "lcs").alias("_lcs"))
    return now.select("doc_id", "n_words", F.sort_array(F.array_distinct("_items")).alias("item_ids"), F.col("_lcs").alias("lcs"), *extra)
