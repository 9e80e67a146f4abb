"""Recurring line templates across documents, found with a fixed-depth tree of tokens.

A line goes to a leaf by its number of tokens and its first tokens, a token
with a digit being a variable field.  Lines of a leaf that agree with its usual
tokens in enough places after the first share a template, in which places without a usual
token are variable.  Lines that have too few tokens in common with any others of the leaf stay out of it.  The others are grouped again, by the token that most of them have
in common, until no group is large enough; what is left are templates of their own.
Lines whose template recurs in several texts are dropped, except in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import bit_table, passing
from .store import Store
from .words import find, mix, pieces, stream

DEPTH = 4  # leading tokens in the tree
MIN_TOKENS = 3  # shorter lines are ordinary words rather than templates
MIN_TEXTS = 3
SIMILAR = 0.5
MIN_REST = 4  # lines with fewer tokens after the leading ones are compared as a whole
CELLS = 1 << 20  # lines x tokens of a leaf that one task groups; the lines of larger leaves are spread by their tokens
LONG_TOKENS = 20  # lines from here on can recur as they stand, see long_texts
_U, _FIELD = np.uint64, np.uint64(0x2A2A2A2A2A2A2A2A)
_NO_ID = (1 << 63) - 1
_LINES = "k bigint, h bigint, line int, leaf bigint, sig bigint, exact bigint"
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with variable fields masked, and as they stand; first token, text and number within the text of each line that has tokens."""
    w = find(data, bounds, fold=False)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    token = np.where(digits[w.end] > digits[w.start], _FIELD, w.hash)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    text = w.text
    line = breaks[w.start] - breaks[bounds[:-1]][text]
    first = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    return token, w.hash, first, text[first], line[first]


def _leaves(token: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf and masked signature of each line, and its number of tokens."""
    size = np.diff(np.append(first, len(token)))
    place = np.arange(len(token)) - np.repeat(first, size)
    value = token * stream(int(size.max()) if len(size) else 1, 71)[place]
    sig = mix(np.add.reduceat(value, first) + size.astype(_U)) if len(first) else np.zeros(0, _U)
    lead = np.add.reduceat(np.where(place < depth, value, _U(0)), first) if len(first) else np.zeros(0, _U)
    return mix(lead ^ mix(size.astype(_U) + _U(97))), sig, size


def _scan(depth: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in pieces(batch):
                token, raw, first, text, line = _tokens(data, bounds)
                leaf, sig, size = _leaves(token, first, depth)
                at = np.flatnonzero(size >= least)
                exact = pa.array(_leaves(raw, first, depth)[1][at].view(np.int64), mask=size[at] < LONG_TOKENS)
                doc = pa.array(text[at])
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(doc), part.column(2).take(doc), pa.array(line[at].astype(np.int32)),
                    pa.array(leaf[at].view(np.int64)), pa.array(sig[at].view(np.int64)), exact],
                    ["k", "h", "line", "leaf", "sig", "exact"])
    return run


def _read(depth: int, least: int, bits: np.ndarray):
    """The tokens of each different line whose leaf passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in pieces(batch):
                token, _, first, _, _ = _tokens(data, bounds)
                leaf, sig, size = _leaves(token, first, depth)
                at = np.flatnonzero((size >= least) & passing(bits, leaf))
                at = at[np.unique(sig[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(leaf[at].view(np.int64)), pa.array(sig[at].view(np.int64)),
                    pa.array([token[first[j]:first[j] + size[j]].view(np.int64) for j in at], pa.list_(pa.int64()))], ["leaf", "sig", "tokens"])
    return run


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out, counts, gone = batch.column(1).to_pylist(), [], [], []
        for text, drop in zip(texts, batch.column(2).to_pylist()):
            lines, drop = (text or "").split("\n"), set(drop or ())
            counts.append(sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in lines))
            gone.append(len(drop))
            out.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def _documents(copies: bool) -> Column:
    return F.count_distinct("k", "h") if copies else F.count_distinct("h")


def _counts(tokens: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines of equal length: the number of each cell's (place, token), and place, token and texts of each number."""
    n, rest = tokens.shape
    place, flat = np.tile(np.arange(rest), n), tokens.ravel()
    order = np.lexsort((flat, place))
    place, flat = place[order], flat[order]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (flat[1:] != flat[:-1])])
    first = np.flatnonzero(new)
    number = np.empty(n * rest, np.int64)
    number[order] = np.cumsum(new) - 1
    return number.reshape(n, rest), place[first], flat[first], np.add.reduceat(np.repeat(texts, rest)[order], first)


def grouped(tokens: np.ndarray, texts: np.ndarray, similar: float, min_texts: int) -> np.ndarray:
    """The number of each line's template within its leaf, -1 for lines that join none; all tokens after the leading ones."""
    out, rest, made = np.full(len(tokens), -1), tokens.shape[1], 0
    teams = [(np.arange(len(tokens)), ())]
    while teams:
        rows, path = teams.pop()
        number, place, token, count = _counts(tokens[rows], texts[rows])
        best = np.lexsort((token, count, place))
        best = best[np.append(place[best][1:] != place[best][:-1], True)]  # the commonest token of each place
        usual = np.where(2 * count[best] >= texts[rows].sum(), best, -1)
        joins = (number == usual).sum(1) >= similar * rest
        out[rows[joins]], made = made, made + 1
        rows = rows[~joins]
        if not len(rows):
            continue
        number, _, _, count = _counts(tokens[rows], texts[rows])
        common = np.where(count >= min_texts, count, 0)[number]
        common[:, list(path)] = 0
        pivot = common.argmax(1)  # the first of equally common places
        cell = number[np.arange(len(rows)), pivot]
        cell[common.max(1) == 0] = -1
        for c in np.unique(cell[cell >= 0]):
            mine = cell == c
            teams.append((rows[mine], (*path, int(pivot[mine][0]))))
    return out


def _near(leaf: np.ndarray, tokens: list[np.ndarray], similar: float) -> np.ndarray:
    """Whether enough tokens of a line stand at the same place of another line of its leaf."""
    size = np.array([len(t) for t in tokens])
    first = np.cumsum(size) - size
    key = mix(np.concatenate(tokens).view(_U) + mix(np.repeat(leaf.view(_U), size) ^ mix((np.arange(size.sum()) - np.repeat(first, size)).astype(_U))))
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    return np.add.reduceat((count[number] > 1).astype(np.int64), first) >= similar * size


def _local(similar: float, min_texts: int, depth: int):
    """Templates of leaves whose lines follow each other."""
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        leaf, sig, texts = (rows.column(c).to_numpy() for c in ("leaf", "sig", "texts"))
        tokens = [np.asarray(t.values.to_numpy(), np.int64)[depth:] for t in rows.column("tokens")]
        keep = np.flatnonzero(_near(leaf, tokens, similar))
        cut = np.flatnonzero(np.diff(leaf[keep])) + 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in np.split(keep, cut):
            if len(part) > 1 and texts[part].sum() >= min_texts:
                template = grouped(np.stack([tokens[j] for j in part]), texts[part], similar, min_texts)
                name = mix(leaf[part].view(_U) + mix(template.astype(_U) + _U(5))).view(np.int64)
                found.append((part[template >= 0], name[template >= 0]))
        if found:
            at = np.concatenate([p for p, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(sig[at]), pa.array(np.concatenate([n for _, n in found]))],
                                             ["leaf", "sig", "template"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            leaf = table.column("leaf").to_numpy()
            whole = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1 if leaf[0] != leaf[-1] else 0
            if whole:
                yield from solve(table.slice(0, whole).combine_chunks())
            held = table.slice(whole)  # the last leaf may go on in the next batch
        if held is not None:
            yield from solve(held.combine_chunks())
    return run


def _usual(placed: DataFrame, similar: float) -> DataFrame:
    """(leaf, sig, template) of the lines that agree with the usual tokens of their group."""
    usual = (placed.groupBy("team", "place", "token").agg(F.sum("texts").alias("c"))
             .groupBy("team", "place").agg(F.max(F.struct("c", "token")).alias("u"), F.sum("c").alias("all"))
             .where(2 * F.col("u.c") >= F.col("all")).select("team", "place", F.col("u.token").alias("token")))
    return (placed.join(usual, ["team", "place", "token"]).groupBy("leaf", "sig", "team").agg(
        F.count(F.lit(1)).alias("same"), F.max("rest").alias("rest")).where(F.col("same") >= F.lit(similar) * F.col("rest"))
        .select("leaf", "sig", F.col("team").alias("template")))


def _shared(placed: DataFrame, similar: float) -> DataFrame:
    """``placed`` without lines that have too few tokens in common with other lines of the leaf."""
    twice = placed.groupBy("team", "place", "token").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")
    near = placed.join(twice, ["team", "place", "token"]).groupBy("leaf", "sig").agg(
        F.count(F.lit(1)).alias("same"), F.max("rest").alias("rest")).where(F.col("same") >= F.lit(similar) * F.col("rest"))
    return placed.join(near.select("leaf", "sig"), ["leaf", "sig"], "left_semi")


def _regroup(left: DataFrame, min_texts: int) -> DataFrame:
    """``left`` with each line in the group of its commonest token at a place that made no group yet; lines without one go."""
    common = left.groupBy("team", "place", "token").agg(F.sum("texts").alias("c")).where(F.col("c") >= min_texts)
    pivot = left.where(~F.array_contains("path", F.col("place"))).join(common, ["team", "place", "token"]).groupBy("leaf", "sig").agg(
        F.max(F.struct("c", (-F.col("place")).alias("back"), "token")).alias("p"))
    return left.join(pivot, ["leaf", "sig"]).select(
        "leaf", "sig", "texts", "rest", F.xxhash64("team", "p.back", "p.token").alias("team"),
        F.concat("path", F.array(-F.col("p.back"))).alias("path"), "place", "token")


def _of_large_leaves(several: DataFrame, store: Store, depth: int, min_texts: int, similar: float) -> list[DataFrame]:
    """The same rounds as ``grouped``, over one row a token, for leaves that are too large for one task."""
    rest = F.size("tokens") - depth
    placed = store.keep(several.select(
        "leaf", "sig", "texts", rest.alias("rest"), F.col("leaf").alias("team"), F.array().cast("array<int>").alias("path"),
        F.posexplode(F.slice("tokens", F.lit(depth + 1), rest)).alias("place", "token")), "placed")
    joined, last = [], "placed"
    if not placed.isEmpty():
        placed, last = store.keep(_shared(placed, similar), "shared"), "shared"
        store.drop("placed")
    while not placed.isEmpty():  # a place groups a line at most once
        joined.append(store.keep(_usual(placed, similar), f"joined{len(joined)}"))
        name = f"placed{len(joined)}"
        placed = store.keep(_regroup(placed.join(joined[-1], ["leaf", "sig"], "left_anti"), min_texts), name)
        store.drop(last)
        last = name
    return joined


def templates(docs: DataFrame, store: Store, depth: int, least: int, min_texts: int, similar: float, copies: bool = False,
              cells: int = CELLS) -> DataFrame:
    """(k, h, line, exact, template) of each line of ``docs`` (k, text, h) that the tree takes."""
    lines = store.keep(docs.select("k", "text", "h").mapInArrow(_scan(depth, least), _LINES), "lines")
    sigs = lines.groupBy("leaf", "sig").agg(_documents(copies).alias("texts"))
    sigs = store.keep(sigs, "sigs")
    mixed = sigs.groupBy("leaf").agg(F.count(F.lit(1)).alias("sigs"), F.sum("texts").alias("all")).where(
        (F.col("sigs") > 1) & (F.col("all") >= min_texts)).select("leaf", "sigs")
    several = store.keep(sigs.join(mixed, "leaf"), "several")
    if similar > 1:
        return lines.select("k", "h", "line", "exact", F.col("sig").alias("template"))
    read = _read(depth, max(least, depth + MIN_REST), bit_table(several.select("leaf").distinct(), F.col("leaf")))
    tokens = docs.select("k", "text").mapInArrow(read, "leaf bigint, sig bigint, tokens array<bigint>").dropDuplicates(["leaf", "sig"])
    several = store.keep(tokens.join(several, ["leaf", "sig"]), "tokens")
    large = F.col("sigs") * F.size("tokens") > cells  # of a leaf all lines or none
    own = several.where(~large).select("leaf", "sig", "texts", "tokens").repartition("leaf").sortWithinPartitions("leaf")
    joined = [store.keep(own.mapInArrow(_local(similar, min_texts, depth), "leaf bigint, sig bigint, template bigint"), "local"),
              *_of_large_leaves(several.where(large), store, depth, min_texts, similar)]
    return lines.join(reduce(DataFrame.union, joined), ["leaf", "sig"], "left").select(
        "k", "h", "line", "exact", F.coalesce("template", "sig").alias("template"))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = MIN_TOKENS,
                   min_texts: int = MIN_TEXTS, similar: float = SIMILAR, long_texts: int | None = None, copies: bool = False, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs``: the text without lines of recurring templates.

    Lines are split at line feeds, tokens at white space.  A template recurs if it
    occurs in at least ``min_texts`` different texts, and a line of ``LONG_TOKENS`` tokens or more also
    if it stands as it is in ``long_texts`` (none: no such rule).  With ``copies`` each document counts, not only each text.
    Exact copies of a text are treated alike.  The text with the smallest id (null ids last, then by text hash) keeps its lines.  Lines with
    fewer than ``least`` tokens stay.  A null text stays null and has no lines, an empty one stays
    empty; rows equal in id and text are treated alike; an empty table gives no rows;
    other columns are ignored.
    """
    store = Store(docs.sparkSession, "templates")
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    placed = store.keep(templates(base, store, depth, least, min_texts, similar, copies, cells), "templates")
    keyed = placed.select("k", "h", "line", F.col("template").alias("key"), F.lit(min_texts).alias("needed"), F.lit(False).alias("long"))
    if long_texts:
        keyed = keyed.union(placed.where(F.col("exact").isNotNull()).select(
            "k", "h", "line", "exact", F.lit(long_texts).alias("needed"), F.lit(True).alias("long")))
    often = keyed.groupBy("key", "long", "needed").agg(
        _documents(copies).alias("texts"), F.min("h").alias("low"), F.max("h").alias("high"), F.min(F.struct("k", "h")).alias("first")).where(
        (F.col("texts") >= F.col("needed")) & (F.col("low") != F.col("high"))).select("key", "long", "first")
    gone = (keyed.join(often, ["key", "long"]).where(F.col("h") != F.col("first.h"))
            .groupBy("k", "h").agg(F.collect_set("line").alias("gone")))  # line numbers of one text
    gone = store.keep(gone, "gone")
    store.drop(*[name for name in store.paths if name != "gone"])
    joined = base.join(gone, ["k", "h"], "left").select(F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"), "text", "gone")
    return joined.mapInArrow(_clean, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
