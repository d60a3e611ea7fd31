"""Rounds of leaders and bounded buckets change cost only."""

import random
from collections import Counter

import numpy as np
import pytest

from chronarch.llm import jaccard_join, packed
from chronarch.llm.jaccard_join import similar_components


@pytest.mark.parametrize(("crowd", "leaders", "rounds"), [(2, 1, 3), (4, 2, 2), (32, 12, 3)])
def test_components_equal_brute_force_for_any_rounds(spark, monkeypatch, crowd, leaders, rounds):
    """Chains and groups of near copies that share a common passage with texts that link with nothing."""
    for name, value in (("CROWD", crowd), ("LEADERS", leaders), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(crowd)
    shared, rows = [f"c{k}" for k in range(40)], []
    for group in range(4):
        own = shared + [f"g{group}w{k}" for k in range(60)]
        for _ in range(10):
            own = list(own)
            own[rng.randrange(40, 100)] = f"n{len(rows)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100 + k, " ".join(shared + [f"s{k}w{j}" for j in range(60)])) for k in range(12)]
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in ((k, t.split()) for k, t in rows)}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_components(df, size=3, percent=90).collect()}
    assert got == {k: find(k) for k in sets}
    assert 1 < len(set(got.values())) < len(got)


@pytest.mark.parametrize("most", [3, packed.MOST_VALUES])
def test_repeated_values_with_any_bound(spark, monkeypatch, most):
    monkeypatch.setattr(packed, "MOST_VALUES", most)
    rng = random.Random(3)
    rows = [(owner, [rng.randrange(2**40) if rng.random() < 0.5 else rng.randrange(90) for _ in range(rng.randrange(12))] + [7] * (owner % 3 == 0)) for owner in range(150)]
    count = Counter(v for _, values in rows for v in values)
    want = {(owner, k) for owner, values in rows for k, v in enumerate(values) if count[v] > 1}
    df = spark.createDataFrame([(o, bytearray(np.array(v, np.uint64).tobytes())) for o, v in rows], "owner long, values binary")
    got = [(r["owner"], int(k)) for r in packed.repeated(df).collect() for k in np.frombuffer(r["places"], np.int32)]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_rows_have_no_repeated_values(spark):
    assert packed.repeated(spark.createDataFrame([], "owner long, values binary")).count() == 0
