"""Fits the model of ``prose``: python -m pagewright.llm.prose_fit TABLES_DIR HOLDOUT_TABLES_DIR

Weak labels come from at most ``SAMPLE`` pages, those with the smallest hashes. The holdout names pages of other tables
and what reading them told; every other one calibrates the scores, and the rest, which the fit never sees, measures.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import prose
from pagewright.llm.common import PAGE_SCHEMA, pages
from pagewright.sources.tables import table

SAMPLE = 20_000
HOLDOUT = Path(__file__).with_name("prose_holdout.json")


def fit(page_docs: DataFrame, held: DataFrame, sites: DataFrame, common_words: DataFrame, holdout: dict, sample: int = SAMPLE) -> dict:
    """A calibrated model of ``page_docs``, with the accuracy and Brier score on the measuring half of the holdout, whose pages are in ``held``."""
    blank = {"base": 0.0, "trees": [], "slope": 1.0, "offset": 0.0}
    stats = prose.statistics(page_docs, sites, common_words, blank)
    rows = stats.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select(*prose.STATS).collect()
    x = np.array([list(r) for r in rows])
    y = prose.weak_labels(x)
    model = prose.fit_trees(x[y >= 0], y[y >= 0].astype(float))
    told = dict(zip(holdout["page_id"], holdout["prose"]))
    seen = {r["page_id"]: [r[s] for s in prose.STATS] for r in prose.statistics(held, sites, common_words, blank).where(F.col("page_id").isin(list(told))).collect()}
    ids = [i for i in told if i in seen]
    hx, hy = np.array([seen[i] for i in ids]), np.array([told[i] for i in ids], float)
    model = prose.calibrate(model, hx[::2], hy[::2])
    p, truth = prose.probability(model, hx[1::2]), hy[1::2]
    return model | {"stats": list(prose.STATS), "accuracy": float(((p >= 0.5) == (truth == 1)).mean()), "brier": float(((p - truth) ** 2).mean()), "measured": len(truth)}


def _rounded(node):
    if isinstance(node, dict):
        return {k: _rounded(v) for k, v in node.items()}
    if isinstance(node, list):
        return [_rounded(v) for v in node]
    return round(node, 6) if isinstance(node, float) else node


def main(data_dir: str, holdout_dir: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    read = lambda d: pages(spark, d, PAGE_SCHEMA)
    model = fit(read(data_dir), read(holdout_dir), table(spark, data_dir, "sites"), table(spark, data_dir, "common_words"), json.loads(HOLDOUT.read_text()))
    prose.MODEL.write_text(json.dumps(_rounded(model), separators=(",", ":")) + "\n")
    print({k: model[k] for k in ("accuracy", "brier", "measured", "slope", "offset")})


if __name__ == "__main__":
    main(*sys.argv[1:3])
