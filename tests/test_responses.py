"""The response store: no answered prompt is asked again, whatever happened to the task that asked it."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelspark.models import textscore
from panelspark.sources import responses


def _scratch():
    return tempfile.mkdtemp(prefix="panelspark-test-", dir="/tmp")


def _factory(log: str, fail_after: int | None = None):
    """A predictor that notes every prompt it is asked; with ``fail_after`` a task dies after so many batches."""
    def factory():
        calls = []

        def predict(prompts):
            calls.append(1)
            if fail_after is not None and len(calls) > fail_after:
                raise RuntimeError("the task dies")
            with open(os.path.join(log, f"{os.getpid()}-{id(calls)}"), "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [str(len(p) % 2) for p in prompts]
        return predict
    return factory


def _asked(log):
    return [line.strip() for f in os.listdir(log) for line in open(os.path.join(log, f))]


def _prompts(spark, n):
    return spark.range(n).select(F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))


def test_a_failed_run_loses_no_answer(spark):
    store, first, second = os.path.join(_scratch(), "store"), _scratch(), _scratch()
    p = _prompts(spark, 500)
    with pytest.raises(Exception, match="the task dies"):
        textscore.score_prompts(p, _factory(first, fail_after=3), store=store, batch_size=5, partitions=4)
    kept = {r.prompt_hash for r in responses.answers(spark, store).collect()}
    assert len(kept) == len(_asked(first)) == len(set(_asked(first))) > 0            # every answer that was given is there
    got = textscore.score_prompts(p, _factory(second), store=store, batch_size=5, partitions=4).collect()
    again = _asked(second)
    assert len(got) == 500 and len(again) == len(set(again)) and not set(again) & set(_asked(first))
    assert set(again) | set(_asked(first)) == {r.prompt for r in p.collect()}
    done = responses.commits(spark, store).collect()
    assert len(done) == 1 and done[0].asked == len(again) and done[0].skipped == len(kept)


def test_repeated_prompts_and_later_runs(spark):
    store, log = os.path.join(_scratch(), "store"), _scratch()
    p = _prompts(spark, 60)
    both = p.union(p).union(spark.createDataFrame([(None,)], "prompt string")).where("prompt is not null")
    textscore.score_prompts(both, _factory(log), store=store)
    assert sorted(_asked(log)) == sorted(r.prompt for r in p.collect())
    more = textscore.score_prompts(_prompts(spark, 80), _factory(log), store=store)
    assert more.count() == 80 and len(_asked(log)) == 80
    assert textscore.score_prompts(p.where("false"), _factory(log), store=store).count() == 0 and len(_asked(log)) == 80
    assert [r.asked for r in responses.commits(spark, store).orderBy(F.desc("asked")).collect()] == [60, 20, 0]


def test_wrong_number_of_answers_is_an_error(spark):
    with pytest.raises(Exception, match="answers to"):
        textscore.score_prompts(_prompts(spark, 5), lambda: (lambda prompts: prompts[1:]), store=os.path.join(_scratch(), "store"))
