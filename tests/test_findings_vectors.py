"""Hypervectors of many rows at once."""

import numpy as np
from pyspark.sql import functions as F

from recallsmith.functions import text
from recallsmith.operators import hdc

SAID = ["", None, "   ", "a bc", "ab cd", "One two, three! (four) five.", "x" * 3000 + " tail", "ÉCOLE Straße Kelvin İstanbul word", "a/b c++ src/ ... ''' -- //", " ".join(f"Name{i % 50}." for i in range(400)), " ".join(f"n{i}" for i in range(90)), "ü ä ö üäö ääää"]


def test_entities_in_tasks_equal_the_column(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SAID)], "id long, t string")
    want = {r.id: r.e for r in rows.select("id", text.extract_entities(F.col("t")).alias("e")).collect()}
    assert [hdc.entities_of(t) for t in SAID] == [want[i] for i in range(len(SAID))]


def test_rows_at_once_equal_rows_one_by_one(monkeypatch):
    texts = SAID * 3
    entities = [hdc.entities_of(t) for t in texts]
    kinds = [{}, {"tier": "semantic", "module": "src3"}, {"type": " en ", "workspace_name": "near", "room": None, "module": ""}]
    metadata = [kinds[i // len(SAID)] for i in range(len(texts))]
    for words in (1, 16, 200, hdc.WORDS):
        encoder = hdc.Encoder(words)
        want = np.array([encoder.memory(*row) for row in zip(texts, entities, metadata, strict=True)])
        assert (encoder.memories(texts, entities, metadata) == want).all()
