"""L3: score prompts with a user-supplied predictor, one predictor per partition.

The predictor factory is called once per partition (e.g. to open a client); the predictor
maps a list of prompts to a list of responses.  Equal prompts are scored once (dedupe by
hash); raw responses are stored before parsing, so evaluating the plan again does not call the
predictor again.  With ``store`` every batch of answers is kept as soon as it is given
(``sources.responses``), so neither a failed task nor a later run asks for it again.  Concurrency = number
of partitions; ``pause`` seconds between calls bounds the rate per partition.
"""

from __future__ import annotations

import re
import time
from typing import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.text import clinical_prompt, parse_response
from panelspark.session import ship_package, stored
from panelspark.sources import responses

Predictor = Callable[[list[str]], list[str]]


def mmse_rule_predictor_factory() -> Predictor:
    """Deterministic stand-in predictor: '1' if the prompt's MMSE change is below -2."""
    pat = re.compile(r"MMSE change: ([+-]?[0-9.]+|[+-]?nan)")

    def predict(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m = pat.search(p)
            v = float(m.group(1)) if m else float("nan")
            out.append("1" if v < -2 else "0")
        return out
    return predict


def score_prompts(prompts: DataFrame, factory: Callable[[], Predictor] = mmse_rule_predictor_factory,
                  prompt_col: str = "prompt", batch_size: int = 64, pause: float = 0.0,
                  partitions: int | None = None, store: str | None = None) -> DataFrame:
    """(prompt_hash, response) for each distinct prompt of ``prompts``, stored.

    With ``store`` (a folder on shared storage) answers are kept keyed by prompt hash across tasks and runs."""
    spark = prompts.sparkSession
    ship_package(spark)
    distinct = stored(prompts.select(F.sha2(F.col(prompt_col), 256).alias("prompt_hash"), F.col(prompt_col).alias("prompt"))
                      .dropDuplicates(["prompt_hash"]), "prompts")

    def run(batches: Iterable):
        import pandas as pd
        predict = factory()
        for pdf in batches:
            got = []
            texts = pdf["prompt"].tolist()
            for i in range(0, len(texts), batch_size):
                got.extend(predict(texts[i:i + batch_size]))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame({"prompt_hash": pdf["prompt_hash"], "response": got})

    def answered(todo: DataFrame) -> DataFrame:
        todo = todo.repartition(partitions, "prompt_hash") if partitions else todo
        return todo.mapInPandas(run, _ANSWER)

    if not store:
        return stored(answered(distinct), "responses")
    responses.ask(distinct, store, factory, batch_size, pause, partitions)
    return responses.answers(spark, store).join(distinct.select("prompt_hash"), "prompt_hash", "left_semi")


_ANSWER = "prompt_hash string, response string"


def score_text_batch(features: DataFrame, factory: Callable[[], Predictor] = mmse_rule_predictor_factory, **kw) -> DataFrame:
    """Feature rows + ``text_prediction`` and ``parse_status`` (prompt -> predictor -> parse).

    The features with their prompts are written once; the distinct prompts and the join read that."""
    with_prompt = stored(clinical_prompt(features).withColumn("prompt_hash", F.sha2(F.col("prompt"), 256)), "prompted")
    got = score_prompts(with_prompt, factory, **kw)
    j = with_prompt.drop("prompt").join(got, "prompt_hash", "left")
    pred, status = parse_response(F.col("response"))
    return j.withColumn("text_prediction", pred).withColumn("parse_status", status).drop("prompt_hash", "response")
