import numpy as np

from treeloom.llm import neighbours
from tests.llm.test_exact import _nearest


def test_crowds_meet_scaled_copies_of_smaller_ids(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=8).astype(np.float32)
    longer = (v * np.float32(1.7)).astype(np.float32)
    rows = [("g", f"copy{i:02}", v.tolist()) for i in range(30)] + [("g", f"also{i:02}", longer.tolist()) for i in range(3)]
    rows += [("g", f"crowd{i:02}", (v * np.float32(0.6)).astype(np.float32).tolist()) for i in range(20)]
    rows += [("g", f"x{i:02}", rng.normal(size=8).astype(np.float32).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, id string, v array<float>")
    got = [(r["id"], r["near_id"]) for r in neighbours.nearest(df, 5, 8).collect()]
    assert len(got) == 5 * len(rows) and set(got) == _nearest(rows, 5)
