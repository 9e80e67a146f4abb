"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Token scores compare toxic and clean training texts under Dirichlet priors.  A
significant toxic token scores high, every other token a little below zero, so a
segment's score is the log-likelihood ratio of "toxic passage" against "clean
text" (the scale parameter of the extreme-value law is 1).  The linear-time
search finds all maximal segments of a text.  Segments are measured against the
expected number of such segments in clean text of the same length, and a text's
evidence is mapped to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store
from .words import PUNCT, Words, find, grams, mix, pieces

SAMPLE = 40_000  # labelled texts the model is fitted on, at most, chosen by hash
TERMS = 20_000  # tokens in the model, at most
PRIOR = 100.0  # texts that the Dirichlet prior is worth
LEAST_Z = 4.0
DENSITY = 0.05  # share of toxic tokens in a toxic passage
CUT = 0.7
_STEM = 4  # bytes
_FLOOR, _CEIL, _BIN = -20.0, 40.0, 0.25
_PASSAGE = "array<struct<first:bigint,last:bigint,score:double>>"


def split_key(doc_id: str) -> Column:
    """The remainder that deals rows to training (0, 2) and hold-out (1); -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)), F.lit(-1))


def stems(data: np.ndarray, w: Words) -> np.ndarray:
    """A token for the first bytes of each word that has as many, 0 for the others."""
    long = np.flatnonzero(w.end - w.start >= _STEM)
    out = np.zeros(len(w.start), np.uint64)
    if len(long):
        byte = data[w.start[long][:, None] + np.arange(_STEM)].astype(np.uint64)
        byte += np.where((byte >= 65) & (byte <= 90), np.uint64(32), np.uint64(0))
        out[long] = mix((byte << (np.arange(_STEM, dtype=np.uint64) * np.uint64(8))).sum(axis=1) + np.uint64(0x1234567800000000))
    return out


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest shingle hash of each text: near copies mostly share it."""
    for batch in batches:
        for part, data, bounds in pieces(batch):
            w = find(data, bounds, PUNCT)
            hashed, fits = grams(w, 5)
            hashed = np.where(fits, hashed, np.uint64(2 ** 64 - 1))
            out = [int(hashed[a:max(a, b - 4)].min()) if b - a > 4 else int(mix(w.hash[a:b]).sum()) for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "family"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a token, per piece of a batch."""
    for batch in batches:
        for part, data, bounds in pieces(batch):
            w = find(data, bounds, PUNCT)
            toxic = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            text = w.text
            seen = []
            for hashed in (w.hash, stems(data, w)):
                at = np.flatnonzero(hashed)
                order = at[np.lexsort((text[at], hashed[at]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (text[order][1:] != text[order][:-1])
                seen.append(np.stack([hashed[order[new]], toxic[text[order[new]]].astype(np.uint64)]))
            token, is_toxic = np.concatenate(seen, axis=1)
            if len(token):
                names, place = np.unique(token, return_inverse=True)
                y = np.bincount(place, weights=is_toxic).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(y),
                                                  pa.array(np.bincount(place) - y)], ["token", "toxic", "clean"])


@dataclass
class Scores:
    """Log-likelihood ratios of the significant tokens, and of any other token."""

    token: np.ndarray
    score: np.ndarray
    rest: float

    def of(self, hashed: np.ndarray) -> np.ndarray:
        """Score of each token, 0 if it is not significant."""
        if not len(self.token):
            return np.zeros(len(hashed))
        at = np.minimum(np.searchsorted(self.token, hashed), len(self.token) - 1)
        return np.where(self.token[at] == hashed, self.score[at], 0.0)


def segments(place: list[int], score: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), in linear time.

    ``place`` are the places of the tokens with a positive score; all places
    between score ``rest`` (below zero).
    """
    out: list[list] = []  # [first, last, sum before, sum at the end, index of the last one with a smaller sum before]
    total, last = 0.0, -1
    for p, s in zip(place, score):
        before = total + rest * (p - last - 1)
        total, last = before + s, p
        new = [p, p, before, total, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(a, b, r - left) for a, b, left, r, _ in out]


def _passages(model: Scores):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in pieces(batch):
                w = find(data, bounds, PUNCT)
                score = model.of(w.hash)
                none = np.flatnonzero(score == 0)
                score[none] = model.of(stems(data, w)[none])
                hit = np.flatnonzero(score > 0)
                edge = np.searchsorted(hit, w.first)
                found = []
                for d, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                    found.append([{"first": x, "last": y, "score": s} for x, y, s in segments(
                        (hit[a:b] - w.first[d]).tolist(), score[hit[a:b]].tolist(), model.rest)] if b > a else [])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.count), pa.array(found, kind), *part.columns[2:]],
                                                 ["doc_id", "n_tokens", "passages", *part.schema.names[2:]])
    return run


def evidence(log_k: float) -> Column:
    """Sum of the passages' scores above the level expected by chance in a text of that length, or the best one's distance to it."""
    level = F.lit(log_k) + F.log(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    above = F.aggregate("passages", F.lit(0.0), lambda a, x: a + F.greatest(x["score"] - level, F.lit(0.0)))
    best = F.coalesce(F.array_max(F.transform("passages", lambda x: x["score"])), F.lit(0.0)) - level
    return F.when(F.col("n_tokens") == 0, F.lit(_FLOOR)).otherwise(
        F.greatest(F.lit(_FLOOR), F.least(F.lit(_CEIL), F.when(above > 0, above).otherwise(best))))


def _logistic(rows: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float]:
    """Intercept and slope from (evidence, clean texts, toxic texts), with a weak pull to 0 that keeps them finite."""
    x = np.array([r[0] for r in rows]) / 10
    n, y = np.array([r[1] + r[2] for r in rows], float), np.array([r[2] for r in rows], float)
    beta = np.array([0.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * x, -30, 30)))
        g = np.array([(y - n * p).sum(), ((y - n * p) * x).sum()]) - 0.05 * beta
        v = n * p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.05 * np.eye(2)
        move = np.linalg.solve(h, g)
        beta = beta + move * min(1, 5 / max(np.abs(move).max(), 1e-9))
    return float(beta[0]), float(max(beta[1], 0.0) / 10)


def _rising(rows: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(lower bound of the evidence, share of toxic texts) of the best rising step function: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for x, n, y in sorted(rows):
        blocks.append([x, float(n), float(y)])
        while len(blocks) > 1 and (blocks[-1][2] + 0.25) / (blocks[-1][1] + blocks[-1][2] + 0.5) <= (
                blocks[-2][2] + 0.5) / (blocks[-2][1] + blocks[-2][2] + 1):
            _, n_, y_ = blocks.pop()
            blocks[-1][1] += n_
            blocks[-1][2] += y_
    return [(x, (y + 0.25) / (n + y + 0.5)) for x, n, y in blocks]


@dataclass
class Calibration:
    """From a text's evidence to the probability of the label: mostly the rising steps, a little of a logistic curve to order within them."""

    log_k: float
    intercept: float
    slope: float
    steps: list[tuple[float, float]]

    def score(self) -> Column:
        x = evidence(self.log_k)
        curve = 1 / (1 + F.exp(-(F.lit(self.intercept) + F.lit(self.slope) * x)))
        share = F.lit(self.steps[0][1]) if self.steps else curve
        for bound, p in self.steps[1:]:
            share = F.when(x >= bound, F.lit(p)).otherwise(share)
        return F.lit(0.95) * share + F.lit(0.05) * curve


def fit(docs: DataFrame, labels: DataFrame, store: Store, sample: int = SAMPLE, terms: int = TERMS) -> tuple[Scores, Calibration]:
    """Token scores and the calibration.

    ``docs`` (doc_id, text); ``labels`` (doc_id, toxic) without the hold-out rows.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = known.count()
    share = int((1 << 30) * min(1.0, sample / max(n, 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share)
    # at most about `sample` rows of nine bytes, so they fit every executor
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").dropDuplicates()  # a repeated row is learnt once
    rows = store.keep(rows, "labelled")
    one = rows.mapInArrow(_families, "doc_id bigint, family bigint").groupBy("family").agg(F.min("doc_id").alias("doc_id"))
    train = store.keep(rows.join(one.select("doc_id").distinct(), "doc_id", "left_semi"), "train")
    size = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    big_y, big_n = float(size.get(True, 0)), float(size.get(False, 0))
    counts = train.mapInArrow(_counts, "token bigint, toxic bigint, clean bigint").groupBy("token").agg(
        F.sum("toxic").cast("double").alias("y"), F.sum("clean").cast("double").alias("n"))
    prior = F.lit(PRIOR / max(big_y + big_n, 1.0)) * (F.col("y") + F.col("n"))
    odds = lambda c, a, all_: F.log((c + a) / (F.lit(all_ + PRIOR) - c - a))
    z = (odds(F.col("y"), prior, big_y) - odds(F.col("n"), prior, big_n)) / F.sqrt(1 / (F.col("y") + prior) + 1 / (F.col("n") + prior))
    best = (counts.withColumn("a", prior).where((F.col("y") >= 5)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
            .orderBy(F.desc("z"), "token").limit(terms).select("token", "y", "n", "a").collect()) if big_y and big_n else []
    token = np.array([r[0] for r in best], np.int64).view(np.uint64)
    order = np.argsort(token)
    y, n_, a = (np.array([r[k] for r in best], float)[order] for k in (1, 2, 3))
    words = train.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")))).head()[0] or 1
    clean = (n_ + a) / (words + PRIOR)  # chance of the token at a place of clean text
    toxic = DENSITY * (y + a) / max((y + a).sum(), 1e-9)
    score = np.maximum(np.log(toxic / clean), 0.1) if len(best) else np.zeros(0)
    model = Scores(token[order], score, float(np.log((1 - DENSITY) / max(1 - clean.sum(), 0.5))) if len(best) else -DENSITY)
    seen = store.keep(train.select("doc_id", "text", "toxic").mapInArrow(
        _passages(model), f"doc_id bigint, n_tokens bigint, passages {_PASSAGE}, toxic boolean"), "scored")
    # chance level: segments of at least 6 in clean text, one more than counted, as K * length * exp(-6)
    strong = F.size(F.filter("passages", lambda x: x["score"] >= 6)).cast("bigint")
    hits, length = seen.where(~F.col("toxic")).agg(F.coalesce(F.sum(strong), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).head()
    log_k = float(np.log((hits + 1) / (length + 1)) + 6)
    binned = seen.groupBy((F.floor(evidence(log_k) / _BIN) * _BIN).alias("x")).agg(
        F.count(F.when(~F.col("toxic"), 1)).alias("n"), F.count(F.when(F.col("toxic"), 1)).alias("y")).collect()
    points = [(float(r[0]), r[1], r[2]) for r in binned]
    if not (big_y and big_n):
        return model, Calibration(log_k, -2.0, 0.1, [])
    return model, Calibration(log_k, *_logistic(points), _rising(points))


def toxic_passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   sample: int = SAMPLE, terms: int = TERMS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, passages) for each row of ``docs``.

    Tokens are runs of letters, digits and non-ASCII characters, A-Z in lower case; a
    token the model does not know counts as its first four bytes if it knows these.
    ``passages`` are all maximal toxic segments with first and last token and score; ``score``
    is the probability of the label, ``predicted`` is 1 from 0.7 on.  Only labels of
    rows whose crc32(id as text) mod 3 is not 1 are learnt, at most about ``sample`` of them, one of
    each family of copies; a label without id or value is ignored, the larger of two labels
    of an id counts.  Null and empty texts have no tokens and no passages and get the lowest score; a null id is
    not held out and has no label.  Without both classes all scores are low.  Repeated rows score
    alike; an empty table gives no rows; other columns are ignored.
    """
    store = Store(docs.sparkSession, "toxic")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("toxic")).where(split_key("doc_id") != 1)
    model, calibration = fit(base, held, store, sample, terms)
    store.drop("labelled", "train", "scored")
    scored = base.mapInArrow(_passages(model), f"doc_id bigint, n_tokens bigint, passages {_PASSAGE}")
    return scored.withColumn("score", calibration.score()).select(
        "doc_id", (split_key("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        "n_tokens", "passages")
