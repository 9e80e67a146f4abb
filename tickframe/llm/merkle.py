"""A Merkle manifest of a table: one root, a subroot per source, and for each row the siblings that prove it.

Levels of the tree are strings of hexadecimal digests.  A block of ``arity ** LEVELS`` neighbouring
nodes keeps each of its levels as one string: fixed-width substrings are hashed to the next
level, the substrings beside a node's own place are its siblings.  The roots of the blocks
are the nodes of the next round, until one is left per source; the subroots are hashed in
the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store, column

#: Levels of the tree within one block: 243 nodes of a tree with three children.
LEVELS = 5
_WIDTH = 64  # hexadecimal digits of a digest
_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value that no other list of values can imitate: ``-`` or its bytes after their number."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def numbered(rows: DataFrame, store: Store, name: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each within its ``key`` in the given order, and ``n``, the rows of the key.

    Rows are sorted in ranges of (key, order) and numbered as they are written, so a key with
    most rows spans many tasks; only counts per range and key are added up afterwards.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # many equal rows are several ranges too
    ranged = (salted.repartitionByRange("key", *order, "salt").sortWithinPartitions("key", *order, "salt").drop("salt")
              .withColumn("part", F.spark_partition_id()).withColumn("at", place))
    ranged = store.keep(ranged, name)
    counts = ranged.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("key", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("base"),
                          F.sum("here").over(whole).alias("n"))
    bases = store.keep(bases, f"{name}-bases")
    return ranged.join(bases, ["key", "part"]).withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "base")


def _parents(level: str, run: int) -> Column:
    """The next level's string: digests of substrings of ``run`` digits, cut from bytes, which needs no walk from the start."""
    below, last = F.encode(F.col(level), "UTF-8"), F.floor((F.octet_length(level) - 1) / run).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(below, i * run + 1, F.lit(run)), 256)), "")


def blocks(nodes: DataFrame, arity: int, levels: int, members: Sequence[str] = ()) -> DataFrame:
    """(key, n, block, members, depth, levels, top): nodes (key, n, pos, node) in aligned blocks with all their levels.

    ``levels`` has the string of each level below ``top``, the digest of the block; a key with one block
    ends at its root, in all others each block is hashed ``levels`` times, runs of one node too.
    """
    span = arity ** levels
    own = (nodes.groupBy("key", "n", F.expr(f"pos div {span}L").alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("pos", "node", *members))).alias("members")))
    depth = reduce(lambda a, b: a + b, [F.when(F.col("n") > arity ** j, 1).otherwise(0) for j in range(levels)])
    own = own.withColumn("depth", depth).withColumn("l0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    for j in range(levels):
        own = own.withColumn(f"l{j + 1}", F.when(F.col("depth") > j, _parents(f"l{j}", arity * _WIDTH)))
    top = F.coalesce(*[F.col(f"l{j}") for j in range(levels, -1, -1)])
    kept = F.slice(F.array(*[F.encode(F.col(f"l{j}"), "UTF-8") for j in range(levels)]), F.lit(1), F.col("depth"))
    return own.select("key", "n", "block", "members", "depth", kept.alias("levels"), top.alias("top"))


def segments(pos: Column, levels: Column, depth: Column, arity: int, most: int) -> Column:
    """For each level of a block the siblings to the left and to the right of the node above ``pos``."""
    def beside(j: int) -> Column:
        i, row = F.floor(pos / arity ** j).cast("int"), F.get(levels, F.lit(j))
        mine = i % arity
        cut = lambda first, count: F.decode(F.substring(row, first * _WIDTH + 1, count * _WIDTH), "UTF-8")
        return F.struct(cut(i - mine, mine).alias("left"), cut(i + 1, F.lit(arity - 1) - mine).alias("right"))
    return F.slice(F.array(*[beside(j) for j in range(most)]), F.lit(1), depth)


def _rounds(most: int, span: int) -> int:
    rounds = 1
    while most > span:
        most, rounds = -(-most // span), rounds + 1
    return rounds


def _tree(nodes: DataFrame, store: Store, name: str, most: int, arity: int, levels: int, members: Sequence[str] = ()) -> list[DataFrame]:
    """The block tables of all rounds; the last has one block per key."""
    out = []
    for k in range(_rounds(most, arity ** levels)):
        out.append(store.keep(blocks(nodes, arity, levels, members if k == 0 else ()), f"{name}{k}"))
        above = F.greatest(F.lit(1), F.ceil(F.col("n") / arity ** levels)).cast("bigint")
        nodes = out[-1].select("key", above.alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"))
    return out


def _with_paths(own: DataFrame, upper: DataFrame, arity: int, levels: int) -> DataFrame:
    """The members of blocks, each with its path from the block's lowest level to the root; ``upper`` has the blocks' paths."""
    span = arity ** levels
    rows = own.join(upper, ["key", "block"]).select(
        "key", "depth", "levels", "upper", "subroot", F.explode("members").alias("m"))
    here = segments(F.col("m.pos") % span, F.col("levels"), F.col("depth"), arity, levels)
    return rows.select("key", "m", "subroot", F.concat(here, "upper").alias("path"))


def manifest(docs: DataFrame, columns: Sequence[str] = _COLUMNS, order_col: str = "doc_id", group_col: str = "source",
             arity: int = 3, levels: int = LEVELS, now: dict[str, Column] | None = None) -> DataFrame:
    """(order_col, leaf, now_leaf, path, subroot, root) for each row; ``path`` has the siblings (left, right) of each level.

    A leaf is the digest of the named columns, a null told from an empty text.  Leaves of a group
    ascend by ``order_col``, null first and equal ones by leaf, so repeated rows are neighbours;
    every ``arity`` neighbours, fewer at the end, become their digest until one is
    left, the subroot; subroots ascend by group, null first, and give the root in the same way.
    ``now_leaf`` is the leaf of the present values: ``now`` maps columns to expressions for them.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    store = Store(docs.sparkSession, "merkle")
    kind = docs.schema[order_col].dataType
    own = [column(c) for c in columns]
    changed = [(now or {}).get(c, column(c)) for c in columns]
    leaves = docs.select(column(order_col).alias("id"), leaf_hash(own).alias("node"),
                         leaf_hash(changed).alias("now_leaf"),
                         F.coalesce(F.concat(F.lit("="), column(group_col).cast("string")), F.lit("")).alias("key"))
    nodes = numbered(leaves, store, "leaves", ["id", "node", "now_leaf"])
    most = nodes.agg(F.max("n")).head()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], f"`{order_col}` {kind.simpleString()}, leaf string, now_leaf string, "
                                                     "path array<struct<left:string,right:string>>, subroot string, root string")
    rounds = _tree(nodes, store, "block", most, arity, levels, ("id", "now_leaf"))
    tops = rounds[-1].select(F.col("key").alias("source_key"), F.col("top").alias("node"), F.lit("").alias("key"))
    sources = store.keep(numbered(tops, store, "subroots", ["source_key"]), "sources")
    over = _tree(sources, store, "over", sources.count(), arity, levels, ("source_key",))
    root = over[-1].select("top").head()[0]
    nothing = F.array().cast("array<struct<left:string,right:string>>")

    upper = over[-1].select("key", "block", nothing.alias("upper"), F.lit(None).cast("string").alias("subroot"))
    for k in range(len(over) - 1, -1, -1):
        found = _with_paths(over[k], upper, arity, levels)
        upper = found.select("key", F.col("m.pos").alias("block"), F.col("path").alias("upper"), "subroot") if k else found.select(
            F.col("m.source_key").alias("key"), F.lit(0).cast("bigint").alias("block"), F.col("path").alias("upper"), F.col("m.node").alias("subroot"))
        upper = store.keep(upper, f"above{k}")
    for k in range(len(rounds) - 1, 0, -1):
        found = _with_paths(rounds[k], upper, arity, levels)
        upper = store.keep(found.select("key", F.col("m.pos").alias("block"), F.col("path").alias("upper"), "subroot"), f"up{k}")
    return _with_paths(rounds[0], upper, arity, levels).select(
        F.col("m.id").alias(order_col), F.col("m.node").alias("leaf"), F.col("m.now_leaf").alias("now_leaf"), "path", "subroot",
        F.lit(root).alias("root"))


def proof_hash(path: str = "path") -> Column:
    """The digest of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: str = "now_leaf", path: str = "path") -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, F.col(leaf), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


#: The tree level by level: recursion over all nodes, then over the siblings of each row.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inverse FROM documents),
  t AS (SELECT *, CASE WHEN inverse & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS now_text FROM d),
  f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM t),
  l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(now_text) || ':' || now_text, '-')) AS now_leaf FROM f),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now_leaf) - 1 AS pos,
      count(*) OVER (PARTITION BY source) AS n FROM l),
  nodes AS (SELECT 0 AS lvl, source, pos, leaf AS h, n FROM p
    UNION ALL SELECT lvl + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes
      WHERE n > 1 GROUP BY lvl, source, pos // 3, n),
  s AS (SELECT source, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM nodes WHERE n = 1),
  tops AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM s
    UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tops
      WHERE n > 1 GROUP BY lvl, pos // 3, n),
  r AS (SELECT h AS root, lvl AS depth FROM tops WHERE n = 1),
  q AS (SELECT p.doc_id, p.pos, p.source, p.leaf, p.now_leaf, s.subroot, s.pos AS spos, s.depth AS sdepth, r.root, r.depth AS rdepth
      FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source, r),
  runs AS (SELECT lvl, source, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY ALL),
  topruns AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM tops GROUP BY ALL),
  steps AS (SELECT q.doc_id, q.source, q.pos, g.lvl, runs.hs, CAST((q.pos // CAST(pow(3, g.lvl) AS BIGINT)) % 3 AS INT) AS mine
      FROM q, LATERAL (SELECT unnest(range(q.sdepth)) AS lvl) g JOIN runs ON runs.lvl = g.lvl
        AND runs.source IS NOT DISTINCT FROM q.source AND runs.run = q.pos // CAST(pow(3, g.lvl + 1) AS BIGINT)
    UNION ALL SELECT q.doc_id, q.source, q.pos, q.sdepth + g.lvl, topruns.hs, CAST((q.spos // CAST(pow(3, g.lvl) AS BIGINT)) % 3 AS INT)
      FROM q, LATERAL (SELECT unnest(range(q.rdepth)) AS lvl) g JOIN topruns ON topruns.lvl = g.lvl
        AND topruns.run = q.spos // CAST(pow(3, g.lvl + 1) AS BIGINT)),
  paths AS (SELECT source, pos, list({'l': array_to_string(hs[:mine], ''), 'r': array_to_string(hs[mine + 2:], '')} ORDER BY lvl) AS path
      FROM steps GROUP BY source, pos),
  whole AS (SELECT q.*, coalesce(path, []) AS path FROM q LEFT JOIN paths ON paths.source IS NOT DISTINCT FROM q.source AND paths.pos = q.pos),
  folds AS (SELECT source, pos, 0 AS k, now_leaf AS h, path FROM whole
    UNION ALL SELECT source, pos, k + 1, sha256(path[k + 1].l || h || path[k + 1].r), path FROM folds WHERE k < len(path))
SELECT w.doc_id, w.leaf, w.subroot, w.root,
  sha256(array_to_string(list_transform(w.path, lambda x: x.l || x.r), '')) AS proof_sha256, f.h AS folded_root, f.h = w.root AS verified
FROM whole w JOIN folds f ON f.source IS NOT DISTINCT FROM w.source AND f.pos = w.pos AND f.k = len(w.path)
"""
