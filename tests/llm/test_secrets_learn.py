"""Tests of what the third review found in the secret scan."""

import numpy as np
import pytest

from recallsmith.llm import secret_scan


@pytest.mark.parametrize("part_rows", [20_000, 60])
def test_secrets_are_learned_from_all_findings(spark, part_rows):
    """Findings of more than 256 characters are learned from too, in one part or in several whose networks are averaged."""
    rng = np.random.default_rng(1)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, f"see token={draw('ABCDEFGHJKLMNPQRSTUVWXYZ23456789', 300 + i % 9)} here" if i % 2 else f"see {draw('eaiou', 300 + i % 9)} here") for i in range(400)]
    found = secret_scan.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    model = secret_scan.train(found, secret_scan.default_fold(), part_rows)
    assert model.network is not None
    p = model.scores([(draw("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 300), "use ", " there"), (draw("eaiou", 300), "use ", " there")])
    assert p[0] >= model.threshold > p[1]


def test_counted_calibration_equals_that_of_rows():
    rng = np.random.default_rng(0)
    z, y = np.round(rng.standard_normal(300) * 2, 1), rng.random(300)
    y = (y < 1 / (1 + np.exp(-z))).astype(float)
    keys, n = np.unique(np.array([z, y]), axis=1, return_counts=True)
    a, b = secret_scan.Network(), secret_scan.Network()
    a.calibrate(z, y)
    b.calibrate(keys[0], keys[1], n.astype(float))
    assert a.scale == pytest.approx(b.scale) and a.shift == pytest.approx(b.shift)
    p = lambda x: 1 / (1 + np.exp(-x))
    assert secret_scan.recall_threshold(p(z), y, 0.9) == pytest.approx(secret_scan.recall_threshold(p(keys[0]), keys[1], 0.9, n.astype(float)))
