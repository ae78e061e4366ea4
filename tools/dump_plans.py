"""Write the physical plans of the headline queries to docs/PLANS.md (tree part of explain)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from panelspark.plans import catalog as C  # noqa: E402
from panelspark.session import get_session  # noqa: E402

NOTES = {
    "read_panel": "Orders are counted per (customer, day), the small per-day table gets running offsets per customer, and the order rows are hash-partitioned on (customer, day) for the final row_number: a hot customer is split over its days.",
    "participant_features": "The binding plan followed by one aggregate on subject (partial + final). The imputer's median table was fitted beforehand, stored, and joined back (broadcast after a size check).",
    "stratified_split_forced": "The split input is stored as Parquet (one row per subject). Only rows in each stratum's crossing hash bucket reach the local window; the threshold table is a size-checked local relation.",
    "classification_metrics": "Confusion counts and the bucketed AUC from one stored table of distinct outcomes, one row per model each.",
    "roc_points": "Distinct scores (stored) -> quantile buckets -> running sums per bucket (small) + inside the bucket.",
    "compare_predictions": "One conditional aggregate on subject over the long predictions (no chained joins).",
    "fit_generation_priors": "Baseline stats per group, plus consecutive-visit pairs from the bucketed positions helper.",
    "generate_panel": "spark.range -> keyed draws -> fold over the visit array -> inline: no exchange.",
    "score_text_batch": "Prompt (JVM format_string + Python number formatting) -> distinct prompts -> mapInPandas predictor -> stored answers -> join back.",
}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # plans as they would be with large inputs
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/dump_plans.py` on `{sf}` with `autoBroadcastJoinThreshold=-1` (large-input plans; "
           "explicit broadcasts are the size-checked small tables). Adaptive execution re-plans at run time.", ""]
    for name in HEADLINE:
        df = C.REGISTRY[name][0](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().treeString()
        out += [f"## {name}", "", NOTES.get(name, ""), "", "```", plan.rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
