from cellspark.operators import lifting as li


def test_pairs_are_drawn_by_gaps(spark, monkeypatch):
    """As many pairs as the chance says, none twice, evenly over places; batches of pairs stay small; the seed counts."""
    monkeypatch.setattr(li, "PAIRS", 500)
    nodes = spark.range(2000).withColumnRenamed("id", "node")

    def pairs(seed):
        return sorted(tuple(r["key"]) for r in li.random_flag(nodes, p=0.005, dim=1, seed=seed).where("rank = 1").collect())

    got, n = pairs(0), 2000 * 1999 / 2
    assert len(set(got)) == len(got) and all(a < b for a, b in got)
    assert abs(len(got) - 0.005 * n) < 5 * (0.005 * n) ** 0.5
    late = sum(b >= 1414 for _, b in got)  # half of all pairs
    assert abs(late - len(got) / 2) < 5 * (len(got) / 4) ** 0.5
    assert got == pairs(0) != pairs(1)
    assert len(li.pair_batch([(li.np.zeros(2, li.np.int64), li.np.ones(2, li.np.int64))])) == 2
