"""Conversations rebuilt from event logs and rendered for training, with the parts that bear loss.

A log has one row per event.  Streamed deltas, edits and regenerations are folded to the final
text of each message, messages that a later edit or regeneration took back are left out, and
the rest is rendered between marks that no text can imitate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

#: Consecutive numbers of a log whose messages are rendered to one row.
SPAN = 4096
START = "<s>"
#: Control strings after their first character; in a text a backslash goes between the two.
_CONTROL = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|AS\])"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_CONTROL}", rf"([<\[])\\(\\*){_CONTROL}"
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[SYS\] (.*?) \[/SYS\]|\[ROLE\] (.*?) \[AS\] (.*?) \[/ROLE\]|(.*?)</s>", re.S)
_BACK = re.compile(_UNESCAPE)
_FIRST, _NO_CONVERSATION = -(1 << 62), -(1 << 63)


def escape(text: Column) -> Column:
    """``text`` without control strings: each gets one more backslash after its first character."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1\2\3", text)


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, opened, role, text, reset): the final text of each message of a log.

    ``log`` has conv_id, seq, message, kind, role and text.  ``open`` begins a message with a role
    and maybe a text, ``delta`` appends, ``edit`` replaces the text by its own, ``regenerate``
    empties it.  Events count in the order of seq (null first, equal ones in the order named here,
    then by text); an event delivered twice counts once; other kinds change nothing.  A message
    without an ``open`` begins at its first event and has no role.  ``reset`` is the last edit or regeneration.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("open", 0), ("edit", 1), ("regenerate", 2), ("delta", 3))
                                                  for x in kv]), F.col("kind")), F.lit(9))
    key = F.coalesce(F.col("conv_id").cast("bigint"), F.lit(_NO_CONVERSATION))
    events = log.select(key.alias("conv_id"), "message", F.struct(
        F.coalesce("seq", F.lit(_FIRST)).cast("bigint").alias("seq"), rank.alias("rank"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("e")).where(F.col("e.rank") < 9)
    own = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set("e")).alias("all"))
    opens = F.filter("all", lambda e: e["rank"] == 0)
    resets = F.filter("all", lambda e: e["rank"].isin(1, 2))
    last = F.get(resets, F.size(resets) - 1)
    own = own.withColumn("first", F.coalesce(F.get(opens, F.lit(0)), F.get("all", F.lit(0)))).withColumn("last", last)
    after = F.filter("all", lambda e: F.col("last").isNull() | (F.struct(e["seq"], e["rank"]) >= F.struct("last.seq", "last.rank")))
    spoken = F.transform(F.filter(after, lambda e: e["rank"] != 2), lambda e: e["text"])
    return own.select("conv_id", "message", F.col("first.seq").alias("opened"),
                      F.when(F.col("first.rank") == 0, F.col("first.role")).alias("role"),
                      F.array_join(spoken, "").alias("text"), F.col("last.seq").alias("reset"))


def current(said: DataFrame, store: Store, span: int = SPAN) -> DataFrame:
    """The messages that stand, with ``part`` and whether it is the conversation's first (``head``).

    A message opened between another one and its last edit or regeneration is taken back.  The latest such
    event of all earlier messages is a running maximum: within blocks of ``span`` numbers, and over one row per block.
    """
    blocked = said.withColumn("part", F.expr(f"(opened - pmod(opened, {span})) div {span}"))
    blocked = store.keep(blocked, "messages")
    tops = blocked.groupBy("conv_id", "part").agg(F.max("reset").alias("top"))
    ordered = Window.partitionBy("conv_id").orderBy("part")
    carried = tops.select("conv_id", "part", F.max("top").over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
                          (F.row_number().over(ordered) == 1).alias("head"))  # the earliest message always stands
    inside = Window.partitionBy("conv_id", "part").orderBy("opened").rangeBetween(Window.unboundedPreceding, -1)
    known = blocked.join(carried, ["conv_id", "part"])
    until = F.greatest("carried", F.max("reset").over(inside))
    return known.withColumn("until", until).where(F.coalesce(F.col("until") < F.col("opened"), F.lit(True))).drop("until", "carried")


def _piece() -> tuple[Column, Column]:
    """A rendered message, and the characters before its text."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.col("text"))
    named = F.concat(F.lit("[ROLE] "), role, F.lit(" [AS] "))
    piece = (F.when(F.col("role") == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
             .when(F.col("role") == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]")))
             .when(F.col("role") == "assistant", F.concat(text, F.lit("</s>")))
             .otherwise(F.concat(named, text, F.lit(" [/ROLE]"))))
    return piece, F.length(text)


def format_chats(log: DataFrame, span: int = SPAN, label: str = "chat") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss) of each conversation of a log, see ``messages``.

    ``loss`` lists the character ranges [start, end) of the replies of the role assistant.  A conversation is one
    row for each ``span`` numbers in which messages were opened, in the order of ``part``, so a very long
    one is not gathered in one task; its first row begins with the start mark.  Messages opened at one
    number are ordered by role and text and share a row.  A null conv_id is a conversation of its own,
    which the smallest bigint would name too.
    An empty log gives no rows; other columns are ignored.
    """
    store = Store(log.sparkSession, label)
    stand = current(messages(log), store, span)
    piece, inside = _piece()
    drawn = stand.withColumn("piece", piece).withColumn("inside", inside).withColumn("at", F.struct("opened", "role", "text", "message"))
    before = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    ranges = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.col("inside")).alias("end")))
    parts = drawn.groupBy("conv_id", "part", "head").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("start", "piece", "at"))).alias("all"),
        F.array_sort(F.collect_list(ranges)).alias("loss"))
    mark = F.when(F.col("head"), F.lit(START)).otherwise(F.lit(""))
    key = F.when(F.col("conv_id") != _NO_CONVERSATION, F.col("conv_id"))
    return parts.select(key.alias("conv_id"), "part", "n_turns",
                       F.concat(mark, F.array_join(F.transform("all", lambda x: x["piece"]), "")).alias("formatted"),
                       F.transform("loss", lambda x: F.struct((x["start"] + F.length(mark)).cast("bigint").alias("start"),
                                                              (x["end"] + F.length(mark)).cast("bigint").alias("end"))).alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered part."""
    out, at = [], len(START) if formatted.startswith(START) else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        user, system, role, other, assistant = m.groups()
        out.append(("user", user) if user is not None else ("system", system) if system is not None
                   else ("assistant", assistant) if assistant is not None else (role, other))
        at = m.end()
    return [(unescape(r), unescape(t)) for r, t in out]


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _READ.split(", ")]
    key, state, done = None, None, []

    def closed() -> tuple:
        turns, loss, n, chars, length = state
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), length

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    done.append(closed())
                key, state = row["conv_id"], [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            text = row["formatted"]
            for role, said in parse(text):
                state[0].update(f"{role}\n{said}\n".encode())
                state[2] += 1
            for r in row["loss"]:
                said = unescape(text[r["start"]:r["end"]])
                state[1].update(said.encode())
                state[3] += len(said)
            state[4] += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), kinds)], names)


def read_back(parts: DataFrame) -> DataFrame:
    """Turns and loss of whole conversations, parsed from rendered parts and hashed as they stream by in order.

    A digest over a conversation is sequential, so one conversation is read by one task, a batch at a time.
    """
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select(F.col("conv_id").cast("bigint"), "formatted", "loss").mapInArrow(_digests, _READ)


def replayed(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """An event log that ends in the given rows: replies stream in as deltas after a first try, others are edited once.

    Each row is a message, opened at eight times its turn (a null turn comes first).
    """
    rows = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("message", F.monotonically_increasing_id())
    third = F.greatest(F.lit(1), F.ceil(F.length("text") / 3)).cast("int")
    cut = lambda a, n: F.substring("text", a, n)
    event = lambda k, kind, text: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit("")
    answer = F.array(event(0, "open", none), event(1, "delta", cut(F.lit(1), third)), event(2, "regenerate", none),
                     event(3, "delta", cut(F.lit(1), third)), event(4, "delta", cut(third + 1, third)), event(5, "delta", cut(2 * third + 1, third)))
    other = F.array(event(0, "open", cut(F.lit(1), third)), event(1, "edit", F.col("text")))
    log = rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", answer).otherwise(other)))
    return log.select("conv_id", F.coalesce(8 * F.col("turn") + F.col("e.k"), F.lit(_FIRST) + F.col("e.k")).alias("seq"), "message",
                      F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|AS\])', '\1\\\2\3', 'g') AS shown,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|AS\])', '\1\\\2\3', 'g') AS named FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(shown) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 4 ELSE 21 + length(named) END)
    AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
