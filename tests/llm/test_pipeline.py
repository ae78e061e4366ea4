"""The pipeline stage by stage against brute force, on the small table and on awkward rows."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from panelspark.llm.scratch import stored, table
from tests.conftest import SMALL
from tests.llm.helpers import awkward, frame
from tests.llm.test_bagminhash import classes
from tests.llm.test_decontam_secrets import brute_base, brute_leaks


def test_stages_equal_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    columns, library = docs.columns, Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontaminate", "secrets", "packing"]
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SMALL), name)
        if name == "packing":
            want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.values())
            assert docs.groupBy().sum("length").first()[0] == want
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert {i for i, r in before.items() if re.search(r"\w{4}", r.text or "")} <= set(after)
        elif name == "near_dedup":
            rows = [(i, r.text) for i, r in before.items()]
            assert set(after) == set(classes(rows))
        elif name == "decontaminate":
            assert set(after) == {r[0] for r in brute_leaks([(i, r.text) for i, r in before.items()], items) if not r[5]}
        else:
            assert set(after) == set(before)
            for i, r in after.items():
                found = brute_base(before[i].text)
                assert all(before[i].text[s:e] not in r.text for s, _, e in found) and r.n_chars == len(r.text)
        if name != "secrets":
            assert all(after[i] == before[i] for i in after)


def test_awkward_rows_run_through(spark, tmp_path):
    texts = awkward(random.Random(1))
    folder = str(tmp_path)
    docs = frame(spark, texts * 2, ids=[*range(len(texts)), *[None] * len(texts)])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "a"), (2, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = C.run(spark, folder)
    assert out.count() > 0
    docs.where("false").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert C.run(spark, folder).count() == 0
