import numpy as np

from tidewell.operators.analytics import similar


def test_blocks_equal_all_pairs(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(300, None), (301, [0.0] * 8)], "id bigint, v array<double>")
    got = {(r["query"], r.id): r.cosine for r in similar(rows, "id", "v", rows.where("id % 20 = 0"), 0.2, block=64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): unit[i] @ unit[j] for i in range(0, 300, 20) for j in range(300) if i != j and unit[i] @ unit[j] >= 0.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
