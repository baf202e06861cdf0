"""Scores in single precision find the pairs that the exact search ranks; it returns what scores in double give."""

import numpy as np
import pandas as pd

from recsift.operators import retrieval as R


def test_rough_scores_find_the_same_best_as_double(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(4000, 16)) * np.exp(2 * rng.normal(size=(4000, 1)))
    items[100:140] = items[7]  # equal scores: by id
    items[200:260] = items[7] * (1 + 1e-8 * np.arange(60))[:, None]  # closer than single precision tells apart
    q = np.vstack([rng.normal(size=(30, 16)), np.zeros((1, 16)), items[7:8] * 50])
    ex = {(i, j) for i in range(len(q)) for j in rng.integers(0, 4000, 40).tolist()} | {(2, j) for j in range(3995)} | {(3, j) for j in range(4000)}
    side = pd.concat([pd.DataFrame({"qid": np.arange(len(q)), "v": list(q), "ex": 0, "is_ex": False}),
                      pd.DataFrame([(i, None, j, True) for i, j in sorted(ex)], columns=["qid", "v", "ex", "is_ex"])])
    it = pd.DataFrame({"iid": np.arange(4000), "iv": list(items)})
    out = R._local_topk("dot", 10)(side, it)
    assert R.Rough(items).of(q) is not None
    for i in range(len(q)):
        score = items @ q[i]
        free = [j for j in range(4000) if (i, j) not in ex]
        want = sorted(free, key=lambda j: (-round(score[j], R.V.RANK_DIGITS), j))[:10]
        assert out[out["qid"] == i]["item_id"].tolist() == want, i


def test_rough_scores_are_not_used_where_single_precision_cannot_hold_them():
    small = np.full((3, 4), 1e-20)
    assert R.Rough(small).of(np.ones((1, 4))) is None
    assert R.Rough(np.full((3, 4), 1e20)).of(np.ones((1, 4))) is None
    assert R.Rough(np.ones((3, 4))).of(np.full((1, 4), np.nan)) is None
