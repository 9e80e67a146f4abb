import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import TOKENIZER, brute_components, table
from texts import awkward

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from tickframe.llm import decontaminate, mixing, quality  # noqa: E402


def test_each_stage_against_its_operator(spark, sf, tmp_path):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(TOKENIZER)
    docs, seen = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        if name != "tokens":
            assert docs.columns == before.columns
        rows, ids = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name == "quality":
            want = Counter(r.doc_id for r in quality.judged(before).collect() if r.kept)
        elif name == "near_dup":
            want = Counter(i for i, _, c in brute_components(rows) if i == c)
        elif name == "decontaminate":
            want = Counter(r.doc_id for r in decontaminate.contaminated(before, table(spark, sf, "benchmark")).collect() if not r.item_ids)
        elif name == "mix":
            want = Counter({r.doc_id: r.copies for r in mixing.mixture(before).collect() if r.copies})
        else:
            want = Counter(i for i, _ in rows)
            got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in docs.collect())
            assert got == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows
                                  for x in [plain.encode(t, add_special_tokens=False).ids + [2]])
        assert ids == want
    assert seen == ["quality", "near_dup", "decontaminate", "mix", "tokens"]


def test_run_gives_the_last_stage(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows_pass_all_stages(spark, sf, tmp_path, empty):
    docs = awkward(spark)
    docs = docs.limit(0) if empty else docs.unionByName(docs.limit(4))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        if name == "near_dup" and not empty:
            assert spark.read.parquet(str(tmp_path / name)).count() < docs.count()
        if name not in ("quality", "tokens"):  # quality would leave few of these rows
            docs = spark.read.parquet(str(tmp_path / name))
            assert out.columns == docs.columns


def test_odd_column_names_pass_all_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    for name in ("a.b", "my col", "ti`ck"):
        docs = docs.withColumn(name, docs["doc_id"] % 7)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and after.count() > 0
        assert after.where("`a.b` != doc_id % 7 OR `my col` != doc_id % 7").count() == 0
        docs = after


def test_a_run_leaves_the_tables_of_other_queries(spark, sf):
    from tickframe.llm.near_dup import near_duplicates
    docs = table(spark, sf, "documents")
    lazy = near_duplicates(docs)
    corpus_pipeline.run(spark, sf).count()
    assert lazy.count() == docs.count()
