"""Runs: stretches of words that repeat with a period, found as maximal pairs of each text's suffixes.

Suffixes that share words with another one of their text are sorted by doubling, for many texts at
once.  Their longest common prefixes span a tree of intervals, walked from the bottom up; each
interval keeps the positions of its suffixes in lists by the word to their left.  Two suffixes
from different children with different words to their left are a maximal pair: the shared
words end on both sides.  If they start no further apart than they share words, both copies
and the gap between them are one run, which needs no extension.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import column

#: Bytes of text whose suffixes are sorted together; one longer text is sorted alone.
PIECE = 1 << 20
_OUT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, n_words bigint, collapsed string"


def suffix_order(codes: np.ndarray, ends: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next words recur in their text, in suffix order, and the number of their group.

    ``codes`` are dense numbers of words, no two texts sharing one; ``ends`` has the end of each position's text.
    Positions that share fewer than ``shared`` (a power of two) words with every other one are left out.
    """
    n = len(codes)
    none = np.zeros(0, np.int64)
    count = np.bincount(codes)
    rank = ((np.cumsum(count) - count)[codes] + 1).astype(np.int64)  # where the group begins, 0 for the end of a text
    active, group, size = np.flatnonzero(count[codes] > 1), rank, 1
    while len(active):
        if size == shared:
            chosen, group = active, rank.copy()
        after = active + size
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)], 0)
        key = rank[active] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        old = rank[active]
        begins = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        base = np.repeat(begins, np.diff(np.append(begins, len(old))))
        fresh = rank.copy()
        fresh[active] = old + np.repeat(first, length) - base
        rank, active, size = fresh, active[np.repeat(length > 1, length)], size * 2
    if size <= shared:
        return none, none
    chosen = chosen[np.argsort(rank[chosen], kind="stable")]
    return chosen, group[chosen]


def _prefixes(words: list[int], order: list[int], group: list[int], least: int) -> list[int]:
    """The words that each suffix shares with the one before it in ``order``, 0 across groups."""
    n, out, shared, last = len(words), [0] * len(order), 0, -2
    place = {p: k for k, p in enumerate(order)}
    for p in sorted(order):
        k = place[p]
        shared = shared - 1 if p == last + 1 and shared > least else 0
        last = p
        if k and group[k] == group[k - 1]:
            q = order[k - 1]
            while p + shared < n and q + shared < n and words[p + shared] == words[q + shared]:
                shared += 1
            out[k] = shared
        else:
            shared = 0
    return out


def _pairs(p: int, left: int, every: list[int], lists: dict[int, list[int]], words: list[int], most: int) -> Iterator[int]:
    """Positions at most ``most`` away with another word to their left."""
    a, b = bisect_left(every, p - most), bisect_right(every, p + most)
    if b - a <= len(lists):
        for q in every[a:b]:
            if (words[q - 1] if q else -1) != left:
                yield q
    else:
        for c, own in lists.items():
            if c != left:
                yield from own[bisect_left(own, p - most):bisect_right(own, p + most)]


def runs(words: list[int], order: list[int], group: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words and two periods or more, by start and period.

    ``order`` and ``group`` come from ``suffix_order``.
    """
    floor = -(-least // 2)  # a pair as far apart as it shares words is half of its run
    found: dict[tuple[int, int], int] = {}

    def merged(x: tuple, y: tuple, depth: int) -> tuple:
        """Pairs across two children of an interval of ``depth`` shared words, then both as one."""
        if len(x[0]) < len(y[0]):
            x, y = y, x
        every, lists = x
        for p in y[0]:
            for q in _pairs(p, words[p - 1] if p else -1, every, lists, words, depth):
                gap = p - q if p > q else q - p
                if gap + depth >= least:
                    at = (min(p, q), gap + depth)
                    found[at] = min(gap, found.get(at, gap))  # the same stretch has multiples of its period too
        for c, own in y[1].items():
            mine = lists.setdefault(c, [])
            for p in own:
                insort(mine, p)
        for p in y[0]:
            insort(every, p)
        return x

    stack: list[list] = []
    shared = _prefixes(words, order, group, 4)
    for k, p in enumerate(order):
        depth = shared[k + 1] if k + 1 < len(order) else 0
        node = ([p], {words[p - 1] if p else -1: [p]})
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            node = merged(top[1], node, top[0])
        if stack and stack[-1][0] == depth:
            stack[-1][1] = merged(stack[-1][1], node, depth)
        elif depth >= floor:
            stack.append([depth, node])
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs and in the first period of each run that no other one repeats."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([w for w, drop in zip(words, np.cumsum(edge[:-1]).tolist()) if not drop])


def _found(texts: list[bytes], least: int) -> Iterator[tuple[list[tuple[int, int, int]], int, bytes]]:
    split = [t.split() for t in texts]
    total, seen, codes = 0, 0, np.empty(sum(map(len, split)), np.int64)
    ends, bounds = np.empty(len(codes), np.int64), [0]
    for words in split:
        table: dict[bytes, int] = {}
        codes[total:total + len(words)] = [table.setdefault(w, len(table)) for w in words]
        codes[total:total + len(words)] += seen
        seen, total = seen + len(table), total + len(words)
        ends[bounds[-1]:total] = total
        bounds.append(total)
    order, group = suffix_order(codes, ends, 4) if total else (codes, codes)
    text = np.searchsorted(bounds, order, "right") - 1
    by = np.argsort(text, kind="stable")  # suffixes of one text keep their order
    order, group, text = order[by], group[by], text[by]
    cut = np.searchsorted(text, np.arange(len(split) + 1))
    for k, words in enumerate(split):
        a, b = cut[k], cut[k + 1]
        got = runs(codes[bounds[k]:bounds[k + 1]].tolist(), (order[a:b] - bounds[k]).tolist(), group[a:b].tolist(), least) if b > a else []
        yield got, len(words), collapsed(words, got)


def _task(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.int64(), pa.large_string()]
        for batch in batches:
            at, names = 0, [*batch.schema.names[:-1], "runs", "n_words", "collapsed"]
            size = np.cumsum([0, *(len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(batch.num_columns - 1).cast(pa.large_string()))])
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + PIECE, "right")) - 1)
                part = batch.slice(at, to - at)
                texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in part.column(part.num_columns - 1).cast(pa.large_string())]
                rows = [([{"start": s, "length": n, "period": q} for s, n, q in got], n_words, text.decode())
                        for got, n_words, text in _found(texts, least)]
                added = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], added[0], added[1], added[2].cast(pa.string())], names)
                at = to
    return run


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, n_words, collapsed) for each row; ``runs`` lists (start, length, period) by start and period.

    A run is a stretch of at least ``least`` words (8 or more) and two periods that no neighbouring word extends, with its
    smallest period; words are parted by the six ASCII white-space characters and compared byte by byte.
    ``collapsed`` has the words joined by one space, without those that any run holds after its
    first period.  A null, empty or blank text has no words and no runs.  Repeated rows are each
    answered, null ids stay null, other columns are ignored, and an empty table gives no rows.
    A text is handled whole by one task, which takes some 150 bytes a word.
    """
    if least < 8:
        raise ValueError("suffixes are told apart by their first four words")
    key, text = (column(c) for c in (id_col, text_col))
    rows = docs.select(key.alias("doc_id"), text.cast("string").alias("text"))
    return rows.mapInArrow(_task(least), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts get their words from one on replaced by a repetition, as the crc32 of the id decides."""
    key, text = (column(c) for c in (id_col, text_col))
    seed = F.crc32(key.cast("string"))
    rows = docs.select(key.alias("doc_id"), text.cast("string").alias("text"), F.floor(seed / 10).cast("bigint").alias("g"),
                       F.when(seed % 10 == 0, words_of(text)).alias("words"))  # a step of its own, so that a text is split once
    n = F.greatest(F.lit(1), F.size("words")).cast("bigint")
    sized = rows.withColumn("n", n).withColumn("a", F.col("g") % F.col("n"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    left = (F.col("n") - F.col("a")).cast("int")
    sized = sized.withColumn("left", left).withColumn("p", period).withColumn("a", F.col("a").cast("int"))
    times = F.ceil(F.col("left") / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("left"))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.size("words") > 0, again).otherwise(F.col("text")).alias("text"))
