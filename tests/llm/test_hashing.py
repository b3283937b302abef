import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.hashing import hash_longs


def test_same_as_the_jvm(spark):
    values = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789012345]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert hash_longs(np.array(values)).tolist() == want


def test_powers_of_nothing(monkeypatch):
    """No bytes to hash, in a process that has hashed none before."""
    from tallyspark.llm import hashing, toxicity

    monkeypatch.setattr(hashing, "_powers", {})
    assert len(hashing.powers(3, 0)) == 0 and len(toxicity.words_of([]).keys) == 0
