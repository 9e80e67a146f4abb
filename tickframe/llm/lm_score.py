"""Stupid-backoff language-model scores of documents from n-gram counts of the whole corpus.

The model has words and word pairs.  A word after its predecessor scores
log10(c(pair) / c(predecessor)) if the pair was seen at least ``least`` times, else
log10(backoff * c(word) / total).  The work is relational, on blocks of rows
packed as numpy arrays: pairs are exploded from the texts and dealt out by the hash
of the predicted word, where the counts of pairs and words are made and joined to
them; counts of predecessors are looked up in a second exchange; sums meet per
document.  Words and pairs with more than a small share of all places would crowd one
partition, so their counts are found first and travel with the job: at most
2 / share of each kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .words import Words, find, mix, pieces

PLACES = 1_250_000  # pairs per partition
SHARE = 1e-4
_U, _NEW = np.uint64, np.uint64(1 << 48)  # codes from here on are word hashes, those below are ranks of frequent words
_START = np.uint64(0xA5A5A5A5A5A5)
_PACK = "bucket int, piece bigint, kind int, data binary"
_NAMES = ["bucket", "piece", "kind", "data"]
_DOCS, _PAIRS, _SUMS, _COUNTS, _ASK = range(5)


def _places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of each word and of the word before it; the first word of a text follows a start mark."""
    word = w.hash >> _U(16)
    before = np.concatenate([[_START], word[:-1]]) if len(word) else word
    before[w.first[:-1][w.count > 0]] = _START
    return before, word


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + mix(word))


@dataclass
class Frequent:
    """Counts of the frequent words and pairs, sorted by hash."""

    word: np.ndarray
    word_count: np.ndarray
    pair: np.ndarray
    pair_count: np.ndarray
    total: int

    def code(self, hashed: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.word, hashed), len(self.word) - 1)
        return np.where(self.word[at] == hashed, at.astype(_U), hashed | _NEW)


def _row(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _crowded(share: float):
    """Words and pairs with at least half of ``share`` of a piece, and the number of places (kind 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in pieces(batch):
                before, word = _places(find(data, bounds))
                least, starts = len(word) * share / 2, int((before == _START).sum())
                key, kind, n = [0], [2], [len(word)]
                for k, hashed in enumerate((np.concatenate([word, before[before == _START]]), _pair(before, word))):
                    names, count = np.unique(hashed, return_counts=True)
                    at = np.flatnonzero(count >= least)
                    key += names[at].view(np.int64).tolist()
                    kind += [k] * len(at)
                    n += count[at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())],
                                                 ["key", "kind", "n"])
    return run


def _exact(words: np.ndarray, pairs: np.ndarray):
    """Counts of the given words and pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(words) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)]
        for batch in batches:
            for _, data, bounds in pieces(batch):
                before, word = _places(find(data, bounds))
                for k, (known, hashed) in enumerate(((words, np.concatenate([word, before[before == _START]])),
                                                     (pairs, _pair(before, word)))):
                    if len(known):
                        at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                        total[k][:-1] += np.bincount(at[known[at] == hashed], minlength=len(known))
        for k, known in enumerate((words, pairs)):
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array([k] * len(known), pa.int32()),
                                              pa.array(total[k][:-1])], ["key", "kind", "n"])
    return run


def frequent(base: DataFrame, share: float, total: int | None = None) -> Frequent:
    """Exact counts of all words and pairs that have ``share`` of all places (and of some that have half of it)."""
    schema = "key bigint, kind int, n bigint"
    seen = base.mapInArrow(_crowded(share), schema).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    if total is None:
        total = base.mapInArrow(_crowded(1.0), schema).where("kind = 2").agg(F.sum("n")).head()[0] or 0
    # what stays below half the share in a piece adds up to less than half over all: these are 2 / share rows at most
    found = seen.where((F.col("kind") < 2) & (F.col("n") >= total * share / 2)).collect()
    known = [np.sort(np.array([r["key"] for r in found if r["kind"] == k], np.int64).view(_U)) for k in (0, 1)]
    known[0] = np.union1d(known[0], np.array([_START]))
    rows = base.mapInArrow(_exact(*known), schema).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    count = [dict() for _ in known]
    for r in rows:
        count[r["kind"]][r["key"]] = r["n"]
    tables = [np.array([count[k].get(int(x), 0) for x in known[k].view(np.int64)], np.int64) for k in (0, 1)]
    return Frequent(known[0], tables[0], known[1], tables[1], total)


def _route(code: np.ndarray, before: np.ndarray, buckets: int) -> np.ndarray:
    """Rare words are dealt by the word, frequent ones by the pair."""
    return (np.where(code >= _NEW, mix(code), _pair(before, code)) % _U(buckets)).astype(np.int64)


def _packed(code: np.ndarray, wide: bool) -> bytes:
    """Ranks as 2 or 4 bytes, hashes as 6."""
    raw = code.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :6] if len(code) and code[0] >= _NEW else raw[:, :4 if wide else 2]).tobytes()


def _unpacked(data: memoryview, at: int, n: int, new: bool, wide: bool) -> tuple[np.ndarray, int]:
    width = 6 if new else 4 if wide else 2
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    code = raw.view("<u8").ravel().astype(_U)
    return (code | _NEW if new else code), at + n * width


def _write_pairs(before: np.ndarray, word: np.ndarray, doc: np.ndarray, wide: bool) -> bytes:
    out = []
    for new_w in (False, True):
        for new_b in (False, True):
            pick = ((word >= _NEW) == new_w) & ((before >= _NEW) == new_b)
            w, b, d = word[pick], before[pick], doc[pick]
            order = np.argsort(w)
            out += [len(d).to_bytes(4, "little"), _packed(w[order], wide), _packed(b[order], wide), d[order].astype("<u2").tobytes()]
    return b"".join(out)


def _read_pairs(data: memoryview, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, out = 0, []
    for new_w in (False, True):
        for new_b in (False, True):
            n = int.from_bytes(data[at:at + 4], "little")
            w, at = _unpacked(data, at + 4, n, new_w, wide)
            b, at = _unpacked(data, at, n, new_b, wide)
            out.append((b, w, np.frombuffer(data, "<u2", n, at)))
            at += 2 * n
    return tuple(np.concatenate(x) for x in zip(*out))


def _sums(piece: np.ndarray, doc: np.ndarray, value: np.ndarray) -> Iterator[tuple]:
    """A row per piece with the documents' sums."""
    names, place = np.unique((piece.astype(_U) << _U(16)) | doc.astype(_U), return_inverse=True)
    total = np.bincount(place, weights=value, minlength=len(names))
    number = (names >> _U(16)).astype(np.int64)
    edge = np.concatenate([np.flatnonzero(np.diff(number, prepend=-1)), [len(names)]])
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(number[a]), (names[a:b] & _U(0xFFFF)).astype("<u2").tobytes() + total[a:b].astype("<f4").tobytes()


def _explode(freq: Frequent, buckets: int):
    """Stage 1: documents, and their pairs packed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, wide = TaskContext.get().partitionId() << 20, len(freq.word) > 1 << 16
        for batch in batches:
            for part, data, bounds in pieces(batch):
                for lo in range(0, part.num_rows, 1 << 16):  # a document's number within its piece has two bytes
                    hi = min(lo + (1 << 16), part.num_rows)
                    w = find(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
                    before, word = _places(w)
                    doc, local = w.text, np.zeros(hi - lo)
                    if len(freq.pair):
                        key = _pair(before, word)
                        at = np.minimum(np.searchsorted(freq.pair, key), len(freq.pair) - 1)
                        known = freq.pair[at] == key  # both words are frequent then
                        of = np.searchsorted(freq.word, before[known])
                        local += np.bincount(doc[known], minlength=hi - lo, weights=np.log10(freq.pair_count[at[known]] / freq.word_count[of]))
                        before, word, doc = before[~known], word[~known], doc[~known]
                    before, word = freq.code(before), freq.code(word)
                    bucket = _route(word, before, buckets)
                    order = np.argsort(bucket, kind="stable")
                    before, word, doc, bucket = before[order], word[order], doc[order], bucket[order]
                    ids = part.column(0).slice(lo, hi - lo)
                    head = pa.RecordBatch.from_arrays([ids, pa.array(w.count), pa.array(local)], ["doc_id", "n", "local"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, head.schema) as writer:
                        writer.write_batch(head)
                    rows = [(number % buckets, number, _DOCS, sink.getvalue().to_pybytes())]
                    edge = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
                    for a, b in zip(edge[:-1], edge[1:]):
                        rows.append((int(bucket[a]), number, _PAIRS, _write_pairs(before[a:b], word[a:b], doc[a:b], wide)))
                    yield _row(rows)
                    number += 1
    return run


def _count(freq: Frequent, buckets: int, least: int, backoff: float):
    """Stage 2: a partition has all places of its words; score what its counts can and ask for the predecessors' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, held = len(freq.word) > 1 << 16, []
        for batch in batches:
            docs = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if row[2] == _DOCS:
                    docs.append((*row[:3], row[3].as_py()))
                else:
                    b, w, d = _read_pairs(memoryview(row[3].as_buffer()), wide)
                    held.append((b, w, d, np.full(len(d), row[1])))
            if docs:
                yield _row(docs)
        if not held:
            return
        before, word, doc, piece = (np.concatenate(x) for x in zip(*held))
        held.clear()
        if not len(word):
            return
        names, place, c_word = np.unique(word, return_inverse=True, return_counts=True)
        new = names >= _NEW
        c_word[~new] = freq.word_count[names[~new].astype(np.int64)]
        _, at, c_pair = np.unique(_pair(before, word), return_inverse=True, return_counts=True)
        c_pair, found = c_pair[at], c_pair[at] >= least
        value = np.where(found, np.log10(c_pair), np.log10(backoff * c_word[place] / freq.total))
        known = found & (before < _NEW)
        value[known] -= np.log10(freq.word_count[before[known].astype(np.int64)])
        yield _row([(number % buckets, number, _SUMS, data) for number, data in _sums(piece, doc, value)])
        # counts of the rare words for the second exchange, then the questions of this partition
        names, c_word = names[new], c_word[new]
        ask = found & (before >= _NEW)
        for kind, code, extra in ((_COUNTS, names, [c_word.astype("<u4")]),
                                  (_ASK, before[ask], [piece[ask].astype("<i8"), doc[ask].astype("<u2")])):
            bucket = (mix(code) % _U(buckets)).astype(np.int64)
            order = np.lexsort((code, bucket))
            bucket, code, extra = bucket[order], code[order], [x[order] for x in extra]
            edge = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
            for a, b in zip(edge[:-1], edge[1:]):
                yield _row([(int(bucket[a]), 0, kind, (int(b - a)).to_bytes(4, "little") + _packed(code[a:b], wide)
                             + b"".join(x[a:b].tobytes() for x in extra))])
    return run


def _answer(buckets: int):
    """Stage 3: join the questions to the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, asks = [], []
        for batch in batches:
            through = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if row[2] in (_DOCS, _SUMS):
                    through.append((*row[:3], row[3].as_py()))
                    continue
                data = memoryview(row[3].as_buffer())
                n = int.from_bytes(data[:4], "little")
                code, at = _unpacked(data, 4, n, True, False)
                if row[2] == _COUNTS:
                    counts.append((code, np.frombuffer(data, "<u4", n, at)))
                else:
                    asks.append((code, np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u2", n, at + 8 * n)))
            if through:
                yield _row(through)
        if asks:
            word, count = (np.concatenate(x) for x in zip(*counts))
            order = np.argsort(word)
            word, count = word[order], count[order]
            code, piece, doc = (np.concatenate(x) for x in zip(*asks))
            value = -np.log10(count[np.searchsorted(word, code)])
            yield _row([(number % buckets, number, _SUMS, data) for number, data in _sums(piece, doc, value)])
    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 4: sums per document; all rows of a piece are in this partition."""
    heads, sums = {}, {}
    for batch in batches:
        for piece, kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if kind == _DOCS:
                heads[piece] = data.as_py()
            else:
                raw = memoryview(data.as_buffer())
                n = len(raw) // 6
                total = sums.setdefault(piece, np.zeros(1 << 16))
                total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<f4", n, 2 * n)
    for piece, raw in heads.items():
        head = pa.ipc.open_stream(raw).read_next_batch()
        value = head.column(2).to_numpy() + sums.get(piece, np.zeros(1 << 16))[:head.num_rows]
        yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(value)], ["doc_id", "n_words", "log_score"])


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, backoff: float = 0.4,
                   places: int = PLACES, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, log_score, score) for each row of ``docs``.

    Words are separated by white space, A-Z in lower case.  ``log_score`` is the sum of
    the words' log10 scores and ``score`` its mean.  Counts cover all rows, so repeated rows
    count again and score alike; a text's own words are counted too, hence ``least``
    (a pair seen once backs off).  Null and empty texts and texts without words have a
    ``log_score`` of 0 and a null ``score``.  Null and repeated ids are kept row by row.  An
    empty table gives no rows; other columns are ignored.  ``docs`` must give the same rows in the same partitions when it is read
    again, as files do.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"))).head()[0] or 0
    parts = int(total // places) + 1
    freq = frequent(base, min(share, 0.5 / parts), total)
    buckets = 4 * parts
    rows = base.mapInArrow(_explode(freq, buckets), _PACK).repartition(parts, "bucket")
    rows = rows.mapInArrow(_count(freq, buckets, least, backoff), _PACK).repartition(parts, "bucket")
    rows = rows.mapInArrow(_answer(buckets), _PACK).repartition(parts, "piece")
    out = rows.mapInArrow(_total, "doc_id bigint, n_words bigint, log_score double")
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
