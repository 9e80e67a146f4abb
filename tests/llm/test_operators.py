import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from harness import connect, differences
from texts import awkward, edited, prose, words

from tickframe.llm import decontaminate, licences, line_templates, lm_score, mixing, near_dup, quality, queries, token_records, toxicity, url_filter
from tickframe.llm import words as W
from tickframe.llm.store import Store

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("key", list(queries.ORACLES))
def test_matches_sql(spark, sf, duck, key):
    assert differences(queries.QUERIES[key](spark, sf), duck, queries.ORACLES[key]) == []


# words

def test_words_match_a_regular_expression(odd):
    texts = [t for _, t in rows_of(odd)]
    column = pa.array(["skip", *texts])[1:]
    data, bounds = W.buffers(column)
    found = W.find(data, bounds, fold=False)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(found.start[i:j], found.end[i:j])] for i, j in zip(found.first[:-1], found.first[1:])]
    assert got == [words(t) for t in texts]
    names = {}
    for text, hashes in zip(got, np.split(found.hash, found.first[1:-1])):
        for w, h in zip(text, hashes.tolist()):
            assert names.setdefault(h, w) == w
    assert len(names) == len({w for t in got for w in t})
    folded = W.find(*W.buffers(pa.array(["Ab aB ÄB äb"]))).hash
    assert folded[0] == folded[1] and folded[2] != folded[3]


def test_pieces_cover_all_rows(odd):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(16)), "text": [t for _, t in rows_of(odd)]})
    parts = list(W.pieces(batch, size=500))
    assert [x for p, _, _ in parts for x in p.column(0).to_pylist()] == list(range(16)) and len(parts) > 3


# mixing

def brute_mix(rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        level = (total - sum(3 * size[s] for s in capped)) / free if free else 0.0
        over = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            return size, {s: 3.0 * size[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_mix_reaches_targets_and_is_stable(spark, sf, odd):
    for docs in (odd, table(spark, sf, "documents")):
        rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
        size, target = brute_mix(rows)
        got = mixing.mixture(docs).collect()
        again = mixing.mixture(docs.repartition(3)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
        assert Counter((r.size, r.source_size, round(r.target, 6)) for r in got) == Counter(
            (len(words(t)), size[s], round(target[s], 6)) for _, t, s in rows)
        assert all(0 <= r.taken <= 3 * r.size for r in got)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
    largest = max(len(words(t)) for _, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= largest / 2 for s in size)


def test_resample_repeats_rows(spark, sf, odd):
    docs = table(spark, sf, "documents")
    often = {r.doc_id: r.copies for r in mixing.mixture(docs).collect()}
    assert Counter(r.doc_id for r in mixing.resample(docs).collect()) == Counter({k: n for k, n in often.items() if n})
    assert mixing.resample(odd).columns == odd.columns
    assert mixing.mixture(odd.limit(0)).count() == 0 == mixing.resample(odd.limit(0)).count()


# token records

@pytest.mark.parametrize("shard", [1 << 25, 30_000])
def test_records_round_trip(spark, sf, odd, tmp_path, shard):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(TOKENIZER)
    for name, docs in (("odd", odd), ("docs", table(spark, sf, "documents"))):
        path = str(tmp_path / name)
        token_records.write_records(docs, path, TOKENIZER, shard_bytes=shard)
        index = token_records.write_index(spark, path).collect()
        want = sorted(((i is not None, i or 0), plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows_of(docs))
        index.sort(key=lambda r: r.start)
        assert [(r.doc_id is not None, r.doc_id or 0) for r in index] == [k for k, _ in want]
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == Counter(
            (k[1] if k[0] else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want)
        assert [r.start for r in index] == np.cumsum([0, *[r.n_tokens for r in index]])[:-1].tolist()
        for r in random.Random(1).sample(index, 10):
            with open(f"{path}/records/{r.file}", "rb") as handle:
                key, ids = token_records.seek_record(handle, r.offset, r.n_bytes)
            assert key == r.doc_id and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32


def test_records_show_damage():
    good = token_records.frame(b"payload")
    assert bytes(token_records.record_at(good, 0)[0]) == b"payload" and token_records.record_at(good, 0)[1] == len(good)
    for at in (0, 9, 14, len(good) - 2):
        with pytest.raises(ValueError):
            token_records.record_at(good[:at] + bytes([good[at] ^ 1]) + good[at + 1:], 0)


def test_no_records(spark, odd, tmp_path):
    token_records.write_records(odd.limit(0), str(tmp_path / "none"), TOKENIZER)
    assert token_records.write_index(spark, str(tmp_path / "none")).count() == 0


# quality

def brute_quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    three = Counter(zip(w, w[1:], w[2:]))
    again = {i + d for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def test_quality_measures(spark, sf, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs in (odd, table(spark, sf, "documents")):
        got = quality.judged(docs).collect()
        assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((i, *brute_quality(t)) for i, t in rows_of(docs))
        assert not any(r.base_failed and r.kept for r in got)
    assert quality.judged(odd.limit(0)).count() == 0


def test_quality_fences_follow_the_group(spark):
    """A source whose clean texts carry many symbols keeps them; the same text stands out elsewhere."""
    rows = []
    for k in range(300):
        rows.append((k, prose(k, 120), "en", "plain"))
        rows.append((1000 + k, re.sub(r" (?=[bdfg])", " ## ", prose(k, 120)), "en", "code"))
    rows.append((5000, re.sub(r" (?=[bdfg])", " ## ", prose(7, 120)), "en", "plain"))
    rows.append((5001, prose(8, 120).replace(" ", " ## "), "fr", "tiny"))
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[k] for k in range(300)) >= 297 and not got[5000]
    assert sum(got[1000 + k] for k in range(300)) >= 290


def test_quality_fences_of_rare_measures_follow_the_group(spark):
    """Repeated lines are zero in most texts; where many texts have them they stay, elsewhere the same text stands out."""
    plain = lambda k: "\n".join(" ".join(prose(k, 200).split()[8 * j:8 * j + 8]) for j in range(20))
    menu = lambda k: "\n".join(x + ("\nread more" if j % 2 else "") for j, x in enumerate(plain(k).split("\n")))
    rows = [(k, plain(k), "en", "plain") for k in range(300)]
    rows += [(1000 + k, plain(k) if k % 10 else menu(k), "en", "forum") for k in range(300)] + [(5000, menu(0), "en", "plain")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5000].n_dup_lines == 9 and not got[5000].base_failed and not got[5000].kept
    assert all(got[1000 + k].kept for k in range(0, 300, 10)) and sum(got[k].kept for k in range(300)) >= 297


def test_quality_is_native(spark, sf):
    plan = queries.op3_quality(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_separates_labelled_texts(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r.kept for r in queries.op3_quality(spark, sf).collect()}
    label = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [got[i] for i, q in label.items() if q and i in got]
    bad = [got[i] for i, q in label.items() if not q and i in got]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.2


# near duplicates

def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_components(rows):
    sets, ids = {}, {}
    for i, text in rows:
        s = shingles(text)
        sets.setdefault(s, []).append(i)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s
    for a, b in combinations([s for s in sets if s], 2):
        x = len(a & b)
        if 100 * x >= 75 * (len(a) + len(b) - x):
            root[find(a)] = find(b)
    for s, members in sets.items():
        if s:
            ids.setdefault(find(s), []).extend(members)
    least = {s: min((i for i in m if i is not None), default=None) for s, m in ids.items()}
    return [(i, len(shingles(t)), least[find(shingles(t))] if shingles(t) else i) for i, t in rows]


def test_near_duplicates_match_all_pairs(spark, sf, odd):
    base = prose(3, 150)
    copies = [(k, edited(base, k, 0.005 * (k % 12))) for k in range(60)] + [(100 + k, edited(edited(base, 7, 0.03), k, 0.02)) for k in range(20)]
    copies += [(200 + k, prose(50 + k, 4 + k % 9)) for k in range(40)] + [(300 + k, prose(50 + k, 4 + k % 9).upper()) for k in range(10)]
    for docs in (odd, table(spark, sf, "documents"), spark.createDataFrame(copies, "doc_id long, text string")):
        got = near_dup.near_duplicates(docs).collect()
        want = brute_components(rows_of(docs))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_links_beside_the_hub_are_found(spark):
    """Pairs linked with each other but not with their bucket's hub."""
    base = prose(9, 300)
    rows = [(k, edited(base, k, 0.01)) for k in range(30)]
    far = edited(base, 77, 0.06)
    rows += [(100, far), (101, edited(far, 5, 0.01)), (102, edited(base, 78, 0.06))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=60, rows=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows))


def test_signatures_estimate_similarity():
    rank, rng = near_dup._orders(160), np.random.default_rng(5)
    for n in (4, 30, 700):
        got = []
        for _ in range(40):
            u = W.mix(rng.integers(1, 2 ** 62, 8 * n, dtype=np.uint64))
            a, b = np.sort(u[:7 * n]), np.sort(u[n:])  # 6 of 8 parts are common
            got.append((near_dup.signature(a, rank) == near_dup.signature(b, rank)).mean())
        assert abs(np.mean(got) - 0.75) < 0.03


# licences

def test_licence_rules(spark):
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance\n"
              "# with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Text.")
    rows = [(1, "Intro.\nReleased under the MIT License.\nmore"), (2, "no end\nAll rights reserved.\nx"), (3, None), (4, ""),
            (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (6, "the software license is odd"), (7, apache)]
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, "MIT") and got[2] == (1, "LicenseRef-all-rights-reserved") and got[3] == got[4] == got[6] == (0, "")
    assert got[5] == (2, "CC-BY-NC-4.0") and got[7][1] == "Apache-2.0"
    assert all(re.search(licences.KEYWORDS, t) for t, _ in licences._KNOWN)


def test_wrapped_licence_sentences(spark):
    """A known sentence counts wherever its words are cut by line ends, comment signs or blanks, also if it has one keyword."""
    rows, want = [], []
    for text, name in licences._KNOWN:
        for gap in ("  ", "\n * ", "\n# "):
            rows.append((len(rows), text.replace(" ", gap) + "."))
            want.append(name)
    got = {r.doc_id: r.sentence_ids for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == want


def test_licences_on_awkward_rows(odd):
    assert licences.licences(odd).count() == odd.count() and licences.licences(odd.limit(0)).count() == 0


# line templates

def test_templates_drop_variable_lines(spark, odd):
    same = "please accept our cookie policy number {} now"
    rows = [(k, f"{prose(k, 40)}\n{same.format(k)}\nitems shown today to user {chr(97 + k)}x of the day list\nshort") for k in range(8)]
    rows += [(50, prose(70, 60)), (51, None), (52, ""), (3, rows[3][1]), (60, rows[5][1])]
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].n_dropped == 0 and by[50][0].n_dropped == 0 and by[51][0].text is None and by[52][0].text == ""
    for k in range(1, 8):
        assert all(r.n_dropped == 2 and "cookie" not in r.text and "shown" not in r.text and "short" in r.text for r in by[k])
    assert len(by[3]) == 2 and by[60][0].n_dropped == 2
    assert line_templates.drop_templates(odd).count() == odd.count() and line_templates.drop_templates(odd.limit(0)).count() == 0


def test_exact_templates_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    mask = lambda line: tuple("*" if re.search("[0-9]", w) else w for w in words(line))
    texts = {}
    for i, t in rows_of(docs):
        for x in {mask(x) for x in (t or "").split("\n") if len(words(x)) >= 3}:
            texts.setdefault(x, {}).setdefault(t, i)
    want = {}
    for i, t in rows_of(docs):
        want[i] = sum(len(words(x)) >= 3 and len(texts[mask(x)]) >= 3 and min(texts[mask(x)].values()) != texts[mask(x)][t]
                      for x in (t or "").split("\n"))
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_templates(docs, similar=1.01).collect()}
    assert got == want


def dropped(spark, rows, **kw):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in line_templates.drop_templates(frame, **kw).collect()}


def test_long_lines_recur_from_two_documents(spark):
    """A long line in two documents goes from the second; short lines need three documents, of which copies of a text are some."""
    long, short = " ".join(prose(9, 60).split()), "short line of clean words"
    rows = [(k, f"{' '.join(prose(20 + k, 15).split())}\n{x}") for k, x in enumerate((long, long, short, short))]
    rows += [(10, "some other words here\nanother short line to see"), (11, "some other words here\nanother short line to see"),
             (12, "unlike the rest\nanother short line to see")]
    assert dropped(spark, rows, long_texts=2, copies=True) == {0: 0, 1: 1, 2: 0, 3: 0, 10: 0, 11: 0, 12: 1}


def test_templates_beside_a_commoner_one(spark):
    """Several variable templates of one leaf are found, a hot one and three equally common ones."""
    names = [f"{a}{b}" for a in "bdfgklmn" for b in "aeiou"]
    make = lambda t, n: f"see our news today {t}one {n} {t}two {n}s {t}three {t}four {n}r {t}five"
    for sizes in ({"hot": 30, "rare": 5}, {"x": 6, "y": 6, "z": 6}):
        rows, first = [], set()
        for t, many in sizes.items():
            first.add(len(rows))
            rows += [(len(rows) + k, f"{t}{names[k]} alone\n{make(t, names[k] + t)}") for k in range(many)]
        assert dropped(spark, rows) == {i: int(i not in first) for i, _ in rows}


def plain_groups(lines, similar, min_texts):
    """{line: template} of one leaf; lines are (texts, tokens after the leading ones)."""
    rest, out = len(lines[0][1]), {}
    seen = Counter((p, t) for _, tokens in lines for p, t in enumerate(tokens))
    near = [k for k, (_, tokens) in enumerate(lines) if sum(seen[p, t] > 1 for p, t in enumerate(tokens)) >= similar * rest]

    def split(team, path, name):
        count = Counter()
        for k in team:
            for cell in enumerate(lines[k][1]):
                count[cell] += lines[k][0]
        return count

    teams = [(near, (), ("leaf",))]
    while teams:
        team, path, name = teams.pop()
        if not team:
            continue
        count, all_ = split(team, path, name), sum(lines[k][0] for k in team)
        usual = {}
        for (p, t), c in count.items():
            if (c, t) > usual.get(p, (0, 0)) and 2 * c >= all_ or p not in usual and 2 * c >= all_:
                usual[p] = max(usual.get(p, (c, t)), (c, t))
        left = []
        for k in team:
            if sum(p in usual and usual[p][1] == t for p, t in enumerate(lines[k][1])) >= similar * rest:
                out[k] = name
            else:
                left.append(k)
        count, groups = split(left, path, name), {}
        for k in left:
            ways = [(count[p, t], -p, t) for p, t in enumerate(lines[k][1]) if p not in path and count[p, t] >= min_texts]
            if ways:
                c, back, t = max(ways)
                groups.setdefault((-back, t), []).append(k)
        teams += [(g, (*path, p), (*name, p, t)) for (p, t), g in groups.items()]
    return out


def plain_templates(rows, similar, min_texts, long_texts, copies):
    """{id: lines dropped} at any settings, by plain Python over all lines."""
    held, leaves = [], {}
    for i, text in rows:
        if not text:
            continue
        token, raw, first, _, line = line_templates._tokens(*W.buffers(pa.array([text])))
        for a, b, no in zip(first, np.append(first[1:], len(token)), line):
            if b - a >= 3:
                masked, exact = tuple(token[a:b].view(np.int64).tolist()), tuple(raw[a:b].tolist())
                held.append((i, text, int(no), masked, exact if b - a >= 20 else None))
                leaves.setdefault((len(masked), masked[:4]), {}).setdefault(masked, set()).add((i, text) if copies else text)
    template = {}
    for leaf, sigs in leaves.items():
        lines = [(len(docs), m[4:]) for m, docs in sigs.items()]
        if leaf[0] >= 8 and len(lines) > 1 and sum(n for n, _ in lines) >= min_texts:
            names = plain_groups(lines, similar, min_texts)
            template.update({m: (leaf, names[k]) for k, m in enumerate(sigs) if k in names})
    gone = {}
    for needed, key_of in ((min_texts, lambda r: template.get(r[3], r[3])), (long_texts, lambda r: r[4])):
        keyed = {}
        for r in held:
            if key_of(r) is not None:
                keyed.setdefault(key_of(r), []).append(r)
        for group in keyed.values():
            if len({(r[0], r[1]) if copies else r[1] for r in group}) >= needed and len({r[1] for r in group}) > 1:
                kept = min(group, key=lambda r: r[0])[1]
                for r in group:
                    if r[1] != kept:
                        gone.setdefault(r[0], set()).add(r[2])
    return {i: len(gone.get(i, ())) for i, _ in rows}


@pytest.mark.parametrize("cells", [line_templates.CELLS, 0])
def test_templates_at_the_shipped_settings_match_brute_force(spark, sf, cells):
    """In tasks of whole leaves, and spread by tokens."""
    rng, rows = random.Random(5), rows_of(table(spark, sf, "documents"))
    pool = [f"v{a}{b}" for a in "bdfgklmnpr" for b in "aeiou"]
    shapes = [[rng.choice(pool) for _ in range(rng.choice([9, 12, 24]))] for _ in range(6)]
    shapes += [[*x[:4], *[rng.choice(pool) for _ in x[4:]]] for x in shapes[:4] for _ in range(3)]  # several in one leaf
    for k in range(160):
        lines = [" ".join(w if rng.random() < 0.8 or p < 4 else rng.choice(pool) for p, w in enumerate(rng.choice(shapes))) for _ in range(rng.choice([1, 2, 4]))]
        rows.append((10_000 + k, "\n".join([f"own words {pool[k % 50]} {k}x{k}", *lines])))
    rows += [(20_000 + k, t) for k, (_, t) in enumerate(rows[-8:])]
    want = plain_templates(rows, 0.5, 3, 2, True)
    assert dropped(spark, rows, long_texts=2, copies=True, cells=cells) == want and sum(want.values()) > 150


def test_short_items_are_found_as_they_stand(spark):
    docs = spark.createDataFrame([(1, "we ask: what is\nthe Capital of France, and more"), (2, "the capital of a France"), (3, "Paris"), (4, None), (5, "x paris y paris"),
                                  (6, prose(4, 300) + " " + prose(77, 40))], "doc_id long, text string")
    items = spark.createDataFrame([(10, "The capital of France"), (11, "paris"), (None, "what is"), (12, ""), (13, None), (14, prose(77, 40)), (15, "Paris")], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.lcs > 0, r.n_words) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: ([10], True, 10), 2: ([], False, 5), 3: ([11, 15], True, 1), 4: ([], False, 0), 5: ([11, 15], True, 4), 6: ([14], True, 340)}
    only = decontaminate.contaminated(docs, items.where("item_id != 14 OR item_id IS NULL")).collect()
    assert {r.doc_id: r.item_ids for r in only} == {1: [10], 2: [], 3: [11, 15], 4: [], 5: [11, 15], 6: []}


def test_a_common_url_counts_once(spark):
    rows = [("http://a.net/x", 0)] * 500 + [(f"http://b{k}.org/fr/p{k}", 1) for k in range(60)] + [(f"http://c{k}.net/q{k}", 0) for k in range(60)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(("http://zz.org/fr/p", "http://zz.net/q"))], "page_id long, url string")
    more = url_filter.judge_urls(pages, labelled, rules=())
    once = url_filter.judge_urls(pages, labelled.distinct(), rules=())
    p = lambda df: {r.page_id: round(r.p_allow, 9) for r in df.collect()}
    assert p(more) == p(once) and p(more)[0] > 0.5 > p(more)[1]


def test_a_repeated_labelled_row_is_learnt_once(spark):
    rows = [(k, f"{prose(200 + k, 30)} {'vile rotten swine ' * (k % 3 == 0)}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    hot = docs.union(spark.createDataFrame([rows[4]] * 300, docs.schema))
    score = lambda df: {r.doc_id: round(r.score, 9) for r in toxicity.toxic_passages(df, labels).collect()}
    assert score(hot) == score(docs)


def test_leading_tokens_are_no_agreement(spark):
    """Short lines that have only their first four tokens in common stay; so do table rows."""
    tails = [" ".join(prose(40 + k, 3).split()[:3]) for k in range(5)]
    rows = [(k, f"it is said that {t}\n1 2 3 4 {t.split()[0]} {t.split()[1]}") for k, t in enumerate(tails)]
    assert set(dropped(spark, rows).values()) == {0}


# decontamination

def normal(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common(decontaminate._bits(a), len(a), b) == t[-1, -1]


def test_contaminated_texts_are_found(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = {r.item_id: normal(r.text) for r in bench.collect()}
    want = set()
    for i, t in rows_of(docs):
        text = " " + " ".join(normal(t)) + " "
        want |= {(i, k) for k, w in items.items() if len(w) >= decontaminate.MIN_WORDS and f" {' '.join(w)} " in text}
    got = {(r.doc_id, k) for r in decontaminate.contaminated(docs, bench).collect() for k in r.item_ids}
    assert len(want) > 10 and len(want & got) >= 0.99 * len(want) and len(got - want) <= 2


def test_paraphrases_and_awkward_rows(spark, odd):
    item = " ".join(f"term{k}" for k in range(30)) + ". The answer is seventeen blue whales."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, prose(90, 20))], "item_id long, text string")
    w = item.split()
    most = " ".join(x for k, x in enumerate(w) if k % 4 or k >= 30)  # every fourth word gone, the answer whole
    rows = [(1, prose(11, 400) + item + prose(12, 300)), (2, prose(13, 100) + item.upper().replace(" ", ",  ") + "!"), (3, prose(14, 200) + most),
            (4, " ".join(w[:12]) + prose(15, 200)), (5, prose(16, 500)), (6, None), (7, ""), (8, prose(90, 20))]
    got = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert [got[k].item_ids for k in range(1, 9)] == [[1], [1], [1], [], [], [], [], []] and got[8].lcs == 1.0
    assert decontaminate.contaminated(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0
    assert all(r.item_ids == [] for r in decontaminate.contaminated(odd, bench.limit(0)).collect())


def test_items_in_blocks(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    one = sorted((r.doc_id, r.item_ids) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ITEMS", 15)
    assert sorted((r.doc_id, r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()) == one


# language model

def brute_lm(rows):
    texts = [[x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)] for _, t in rows]
    one, two = Counter(), Counter()
    for w in texts:
        one.update(w)
        one[None] += bool(w)
        two.update(zip([None, *w], w))
    total = sum(map(len, texts))
    score = lambda a, b: math.log10(two[a, b] / one[a]) if two[a, b] >= 2 else math.log10(0.4 * one[b] / total)
    return [(i, len(w), sum(score(a, b) for a, b in zip([None, *w], w))) for (i, _), w in zip(rows, texts)]


@pytest.mark.parametrize("places,share", [(10 ** 9, 1e-4), (3000, 1e-4), (5000, 0.05), (5000, 2.0)])
def test_backoff_scores(spark, sf, odd, places, share):
    for docs in (odd, table(spark, sf, "documents")):
        got = lm_score.backoff_scores(docs, places=places, share=share).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        got = sorted(((r.doc_id, r.n_words, r.log_score) for r in got), key=key)
        want = sorted(brute_lm(rows_of(docs)), key=key)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) <= 1e-4 * max(1, abs(w[2])) for g, w in zip(got, want))
    assert lm_score.backoff_scores(odd.limit(0)).count() == 0


# toxicity

def test_segments_match_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(200):
        n, rest = rng.randrange(1, 40), -rng.choice([0.3, 1.0])
        score = [rng.choice([1.0, 2.5]) if rng.random() < 0.3 else rest for _ in range(n)]
        place = [k for k, s in enumerate(score) if s > 0]
        got = toxicity.segments(place, [score[k] for k in place], rest)

        def maximal(lo, hi):
            best = max(((sum(score[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 1e-9:
                return []
            _, _, a, b = best
            return [*maximal(lo, a), (a, b - 1, best[0]), *maximal(b, hi)]
        want = maximal(0, n)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in want), default=0))


def test_toxicity_on_held_out_texts(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    label = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(label[i], r.predicted) for i, r in got.items() if r.held_out and i in label]
    hit = sum(p for t, p in held if t) / sum(t for t, _ in held)
    false = sum(p for t, p in held if not t) / sum(not t for t, _ in held)
    assert hit > 0.85 and false < 0.01  # some labelled texts hold no toxic word at all


def test_toxicity_on_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 1), (7, 0), (9, 1), (1, 0), (5, 0)], "doc_id long, toxic int")
    for mine in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.toxic_passages(odd, mine).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        empty = [r.score for r in got if r.n_tokens == 0]
        assert len(set(empty)) == 1 and min(r.score for r in got) == empty[0]
    assert toxicity.toxic_passages(odd.limit(0), labels).count() == 0


# URL filter

def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark, sf):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.NET/en/x?y#z", "http://example.net/de/", "http://notexample.net/en/",
            "ftp://x.org/fr/1", "http://x.org/fra", "http://example.com/de/a", "http://net/", "http://a.net", "http://a.net?x=/en/", "://b.Com:80/é#"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[4]), (4, urls[4])], "page_id long, url string")
    for df in (pages, table(spark, sf, "pages")):
        got = url_filter.judge_urls(df).collect()
        source = Counter((r.page_id, *brute_url(r.url)[:3]) for r in df.collect())
        assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == source
        ruled = dict((r, v) for v, r in url_filter.RULES)
        assert all(r.verdict == ruled[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_model_learns_labels(spark):
    train = spark.createDataFrame([(f"http://shop{k}.casino-win.test/bonus/{k}", 0) for k in range(60)]
                                  + [(f"http://news{k}.daily.test/world/{k}", 1) for k in range(60)], "url string, label int")
    pages = spark.createDataFrame([(k, f"http://s{k}.casino-win.test/bonus/x{k}") for k in range(20)]
                                  + [(100 + k, f"http://m{k}.daily.test/world/y{k}") for k in range(20)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, train).collect()}
    assert sum(v == ("block" if k < 100 else "allow") for k, v in got.items()) >= 38


def test_store_removes_tables(spark, odd):
    store = Store(spark, "test")
    store.keep(odd, "t")
    path = store.path("t")
    store.drop("t")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                  'You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to '
                  'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
                  "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                         "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                         "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
                    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
                    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, "
            "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
               "https://www.eclipse.org/legal/epl-2.0/",
}


def test_notices_in_all_their_forms(spark, tmp_path):
    import textwrap
    head, rows, want = "Copyright (c) 2020 Some One", [], {}
    for name, text in NOTICES.items():
        paragraphs = text.split("\n\n")
        for width in (None, 72, 80):
            body = ["\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) if width else p for p in x.split("\n")) for x in paragraphs]
            forms = ["\n\n".join(body), "\n\n".join([head, *body]), head + "\n" + "\n\n".join(body)]
            for sign in ("# ", "// ", " * ", ";; "):
                forms += ["\n".join((sign + line).rstrip() for line in f.split("\n")) for f in forms[:3]]
            if width is None:
                forms.append(" ".join(text.split()))
            for f in forms:
                want[len(rows)] = name
                rows.append((len(rows), f"{prose(6, 20)}.\n\n{f}\n\n{prose(7, 20)}"))
    for text, name in (("Licensed under the MIT license (see LICENSE).", "MIT"), ("x = 1\n# SPDX-License-Identifier: BSD-3-Clause\nimport y", "BSD-3-Clause"),
                       ("/* SPDX-License-Identifier: LGPL-3.0-or-later */", "LGPL-3.0-or-later"), ("the licence of this odd work is not known", "")):
        want[len(rows)] = name
        rows.append((len(rows), text))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.licences for r in licences.licences(docs).collect()}
    assert [(rows[i][1], got[i], n) for i, n in want.items() if got[i] != n] == []
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert differences(licences.licences(docs), con, licences.ORACLE) == []
