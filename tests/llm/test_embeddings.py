"""Recall of the filters of embedding near-dedup at any size of a label."""

from __future__ import annotations

import numpy as np
import pytest


@pytest.mark.parametrize("vectors", [5_600, 1_000_000, 5_000_000, 8_000_000, 30_000_000])
def test_recall_at_the_threshold_at_any_size(vectors):
    from evalgrid.llm.embeddings import Codes

    rng = np.random.default_rng(10)
    x, z = rng.standard_normal((2, 600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    codes = Codes(64, vectors)
    both = [set(zip(*[v.tolist() for v in codes.decode(side)], strict=True)) for side in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * z)]
    recall = len({row for row, _ in both[0] & both[1]}) / 600
    print(f"RECALL {vectors}: {recall:.3f} with {len(codes.all)} codes")
    assert recall >= 0.94


def test_filters_follow_each_label(spark):
    from evalgrid.llm.embeddings import label_sizes

    rows = [("hot", 8 if i % 2 else -8) for i in range(1000)] + [("small", 8)] * 3 + [("small", 4)]
    found = {(r["label"], r["size"]): r["most"] for r in label_sizes(spark.createDataFrame(rows, "label string, dim long")).collect()}
    assert found == {("hot", 8): 1024, ("small", 8): 4, ("small", 4): 1}
