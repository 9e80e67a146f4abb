import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from texts import awkward, prose, words

from tickframe.llm import chat, merkle, queries
from tickframe.llm import runs as R
from tickframe.llm.store import Store


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).withColumn("a.b", F.lit(1)).withColumn("my col", F.lit(2)).withColumn("ti`ck", F.lit(3)).cache()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# periodic runs

def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                at = (start, i - start + q)
                found[at] = min(q, found.get(at, q))
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


@pytest.mark.parametrize("least", [8, 12, 20])
def test_runs_of_random_words(least):
    rng, texts = random.Random(least), []
    for _ in range(400):
        n, vocabulary = rng.choice([0, 3, 12, 40, 150]), rng.choice([1, 2, 2, 3, 60])
        w = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        texts.append(w)
    got = list(R._found([" ".join(w).encode() for w in texts], least))
    assert [g for g, _, _ in got] == [brute_runs(w, least) for w in texts]
    assert [c.decode() for _, _, c in got] == [brute_collapsed(w, g) for w, (g, _, _) in zip(texts, got)]
    assert sum(bool(g) for g, _, _ in got) > 50


def test_fibonacci_words_have_all_their_runs():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    w = list(b)
    assert next(R._found([" ".join(w).encode()], 12))[0] == brute_runs(w)


def test_long_runs_and_common_lines_end_soon():
    line = "this is a common line of words".split()
    many = [x for k in range(4000) for x in [f"item{k}", *line]]
    for w, want in ((["a"] * 60_000, 1), (["a", "b", "c"] * 20_000, 1), (many, 0)):
        assert len(next(R._found([" ".join(w).encode()], 12))[0]) == want


def test_runs_of_awkward_rows(odd, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 300)
    rows = odd.union(odd.where("doc_id = 11"))
    got = R.find_runs(rows).collect()
    texts = [(r.doc_id, words(r.text)) for r in rows.select("doc_id", "text").collect() if r.doc_id != 7]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.doc_id != 7), key=key) == sorted(
        ((i, len(w), brute_runs(w), brute_collapsed(w, brute_runs(w))) for i, w in texts), key=key)
    assert R.find_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(odd, least=5)


def planted(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_runs_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, some = queries.QUERIES["op11_periodic_runs"](spark, sf).collect(), 0
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        w = planted(r.doc_id, docs[r.doc_id])
        if len(w) > 2500:
            continue
        found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        some += bool(found)
        assert tuple(r) == (r.doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
                            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(brute_collapsed(w, found)))
    assert some > 10


# chats

LOG = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def brute_fold(log):
    rank, said = {"open": 0, "edit": 1, "regenerate": 2, "delta": 3}, defaultdict(list)
    for c, seq, m, kind, role, text in set(log):
        if kind in rank:
            said[c, m].append((-(1 << 62) if seq is None else seq, rank[kind], role or "", text or "", role))
    out = defaultdict(list)
    for (c, m), events in said.items():
        events.sort(key=lambda e: e[:4])
        opens = [e for e in events if e[1] == 0]
        resets = [e[:2] for e in events if e[1] in (1, 2)]
        spoken = [e[3] for e in events if e[1] != 2 and (not resets or e[:2] >= resets[-1])]
        first = opens[0] if opens else events[0]
        out[c].append((first[0], first[4] if opens else None, "".join(spoken), m, resets[-1][0] if resets else None))
    for c, all_ in out.items():
        stand = [x for x in all_ if not any(y[4] is not None and y[0] < x[0] <= y[4] for y in all_)]
        out[c] = [(r or "", t) for _, r, t, _, _ in sorted(stand, key=lambda x: (x[0], x[1] or "", x[2], x[3]))]
    return out


def restored(parts):
    """Turns and loss by conversation, from the rendered rows."""
    turns, loss = defaultdict(list), defaultdict(str)
    for r in sorted(parts, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.part)):
        turns[r.conv_id] += chat.parse(r.formatted)
        loss[r.conv_id] += "".join(chat.unescape(r.formatted[x.start:x.end]) for x in r.loss)
        assert r.formatted.startswith(chat.START) == (len(turns[r.conv_id]) == r.n_turns)
        assert r.n_turns == len(chat.parse(r.formatted))
    return turns, loss


@pytest.mark.parametrize("span", [4, 16, 4096])
def test_logs_fold_like_a_plain_replay(spark, span):
    rng, log = random.Random(span), []
    for c in range(40):
        opened, seq = [], 0
        for _ in range(rng.choice([1, 5, 60])):
            seq += rng.randint(1, 3)
            kind = rng.choice(["open", "open", "delta", "delta", "edit", "regenerate", "typing"]) if opened else "open"
            if kind == "open":
                opened.append(len(opened))
            m = opened[-1] if kind == "open" or rng.random() < 0.7 else rng.choice(opened)
            log.append((c, seq, m, kind, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "a", "é\n", "</s>", "x [INST] "])))
    log += log[::7]  # delivered twice
    random.Random(1).shuffle(log)
    turns, loss = restored(chat.format_chats(spark.createDataFrame(log, LOG), span).collect())
    want = brute_fold(log)
    assert dict(turns) == dict(want)
    assert {c: "".join(t for r, t in all_ if r == "assistant") for c, all_ in want.items()} == {c: loss[c] for c in want}


def test_marks_inside_texts_come_back(spark):
    bad = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[\\INST]", "[SYS] [/SYS] [ROLE] [AS] [/ROLE]", "<</s>", "[[/INST]]", "<", "[", "\\", "", " ", "é𝔘</s>\n"]
    rows = [(k, 2 * k + j, 2 * k + j, "open", role, text) for k, text in enumerate(bad) for j, role in enumerate(["user", "assistant"])]
    rows += [(99, k, k, "open", role, text) for k, (role, text) in enumerate((r, t) for r in ("user", "assistant", "system", "tool", "</s>[AS]", "") for t in bad)]
    turns, loss = restored(chat.format_chats(spark.createDataFrame(rows, LOG)).collect())
    for k, text in enumerate(bad):
        assert turns[k] == [("user", text), ("assistant", text)] and loss[k] == text
    assert turns[99] == [(r[4], r[5]) for r in rows if r[0] == 99] and loss[99] == "".join(bad)
    for r in chat.format_chats(spark.createDataFrame(rows, LOG)).collect():
        assert r.formatted.count("</s>") == sum(role == "assistant" for role, _ in turns[r.conv_id])


def test_chats_of_awkward_logs(spark):
    log = [(None, None, None, None, None, None), (None, None, 1, "open", None, None), (1, None, None, "open", "user", None), (1, 3, None, "delta", None, "x"),
           (1, 3, None, "delta", None, "x"), (2, 1, 7, "delta", "user", "no open"), (2, 2, 7, "edit", None, None), (3, 5, 1, "open", "user", prose(3, 30_000)),
           (3, 5, 2, "open", "assistant", "same number"), (3, 5, 2, "open", "assistant", "same number")]
    df = spark.createDataFrame(log, LOG).withColumn("part", F.lit("p")).withColumn("a.b", F.lit(1)).withColumn("opened", F.lit(2))
    turns, _ = restored(chat.format_chats(df).collect())
    assert dict(turns) == {None: [("", "")], 1: [("user", "x")], 2: [("", "")], 3: [("assistant", "same number"), ("user", prose(3, 30_000))]}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query_reads_whole_conversations(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t} </s>") for t in range(3000)] + [(2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, "é")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    parts = chat.format_chats(chat.replayed(spark.read.parquet(str(tmp_path / "conversations.parquet"))))
    assert parts.where("conv_id = 1").count() == 6
    got = {r.conv_id: r for r in queries.QUERIES["op12_chat"](spark, str(tmp_path)).collect()}
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3000])) and got[1].n_turns == 3000
    assert got[1].loss_sha256 == sha("".join(t for _, k, _, t in rows[:3000] if k % 2))
    assert (got[2].n_turns, got[2].loss_chars) == (2, 0) and got[3].turns_sha256 == sha("\né\n")
    probe = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n") and got[-7].loss_sha256 == sha(probe)


# manifest

def brute_tree(leaves, arity):
    """The root of a list of digests and the siblings of each, level by level."""
    paths, level = [[] for _ in leaves], [(h, [k]) for k, h in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), arity):
            run = level[a:a + arity]
            for k, (_, below) in enumerate(run):
                for leaf in below:
                    paths[leaf].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1:])))
            above.append((sha("".join(h for h, _ in run)), [x for _, b in run for x in b]))
        level = above
    return level[0][0], paths


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows, arity):
    """{(doc_id, leaf): (path, subroot)} and the root; rows are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    order, out = sorted(groups, key=lambda s: (s is not None, (s or "").encode())), []
    trees = [brute_tree([x[2] for x in sorted(groups[s])], arity) for s in order]
    root, over = brute_tree([t[0] for t in trees], arity)
    for s, (sub, paths), up in zip(order, trees, over):
        out += [(x[3], x[2], tuple(p + up), sub) for x, p in zip(sorted(groups[s]), paths)]
    return out, root


@pytest.mark.parametrize("arity,levels,sizes", [(3, 1, [1, 2, 3, 4, 9, 10, 28]), (3, 2, [81, 82, 1]), (2, 2, [5, 17, 0, 33]), (3, 5, [700]), (4, 1, [1])])
def test_manifest_of_random_tables(spark, arity, levels, sizes):
    rng = random.Random(levels)
    rows = [(rng.choice([None, *range(60)]), None if g == 0 else f"s{g}é", rng.choice([None, "en"]), k, rng.choice([None, "", "a\nb", f"t{k % 5}"]))
            for g, n in enumerate(sizes) for k in range(n)]
    rows += rows[:4]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    got = merkle.manifest(docs, arity=arity, levels=levels).withColumn("proof", merkle.proof_hash()).withColumn("again", merkle.folded("leaf")).collect()
    want, root = brute_manifest(rows, arity)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.leaf, tuple(map(tuple, r.path)), r.subroot) for r in got), key=key) == sorted(want, key=key)
    assert {r.root for r in got} == {root} == {r.again for r in got}
    assert all(r.proof == sha("".join(a + b for a, b in r.path)) for r in got)


def test_manifest_of_awkward_rows(spark, odd):
    got = merkle.manifest(odd, now={"text": F.concat(F.col("text"), F.lit("!"))}).withColumn("ok", merkle.folded() == F.col("root")).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want, root = brute_manifest(rows, 3)
    assert sorted(r.leaf for r in got) == sorted(x[1] for x in want) and {r.root for r in got} == {root}
    assert sum(r.ok for r in got) == sum(r[4] is None for r in rows)  # only nulls stay as they were
    assert merkle.manifest(odd.limit(0)).collect() == []
    own = merkle.manifest(odd, columns=["a.b", "my col", "ti`ck"], order_col="k")
    assert own.count() == len(rows) and own.columns[0] == "k"


def test_a_key_of_equal_rows_is_numbered_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(4000).select(F.lit("x").alias("key"), F.lit(1).alias("id"))
    store = Store(spark, "t")
    out = merkle.numbered(rows, store, "n", ["id"])
    assert sorted(r.pos for r in out.collect()) == list(range(4000))
    assert spark.read.parquet(store.path("n")).select("part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
