"""End to end on a study CSV: read -> preprocess -> three predictors -> comparison.

usage: python examples/study_flow.py <panel.csv> <out_dir>

The CSV has the study's header (``Subject ID, MRI ID, Group, Visit, MR Delay, M/F, Hand, Age,
EDUC, SES, MMSE, CDR, eTIV, nWBV, ASF``, blanks around names allowed).  Writes the feature
splits, predictions, metrics and the comparison table under ``out_dir``.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.plans import jobs  # noqa: E402
from panelspark.session import get_session  # noqa: E402
from panelspark.sources import io  # noqa: E402


def run(spark, csv_path: str, out: str, n_trees: int = 200, epochs: int = 100, augment: bool = True) -> dict:
    panel = io.read_panel(spark, csv_path)
    if augment:
        panel = jobs.job_augment(panel, out=os.path.join(out, "augmented"))
    split = jobs.job_preprocess(panel, out=os.path.join(out, "features"))
    train = io.read_feature_splits(spark, os.path.join(out, "features"), "train").drop("split")
    test = io.read_feature_splits(spark, os.path.join(out, "features"), "test").drop("split")
    text = jobs.job_text_scoring(test)
    boosted = jobs.job_boosted(train, test, out=os.path.join(out, "boosted"), n_trees=n_trees)
    joint = jobs.job_joint_embedding(train, test, out=os.path.join(out, "joint"), epochs=epochs)
    preds = text["predictions"].unionByName(boosted["predictions"]).unionByName(joint["predictions"])
    return jobs.job_comparison(preds, panel, out=os.path.join(out, "comparison"))


if __name__ == "__main__":
    spark = get_session()
    result = run(spark, sys.argv[1], sys.argv[2])
    result["metrics"].show()
    result["notes"].where("note <> ''").show(truncate=False)
