"""Greedy choices against a plain loop."""

import random

import pytest

from convlake.operators import budget


@pytest.mark.parametrize("many", [0, 100_000])
@pytest.mark.parametrize("most", [None, 0, 3])
def test_take_what_fits(spark, many, most):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None, "c"]), i, f"r{i}", rng.choice([None, 0, 1, 3, 10, 60, 149, 151, 1000, -5])) for i in range(400)] + [("only", 1, "x", 10), ("only", 2, "y", None), ("only", 3, "z", 10), ("big", 1, "w", 10**9)]
    expected = set()
    for group in {r[0] for r in rows}:
        used = n = 0
        for _, _, rid, size in sorted((r for r in rows if r[0] == group), key=lambda r: -r[1]):
            size = max(size or 0, 0)
            if used + size <= 150 and (most is None or n < most):
                used, n = used + size, n + 1
                expected.add((group, rid))
    df = spark.createDataFrame(rows, "conv string, idx int, rid string, tokens long")
    out = budget.take_what_fits(df, ["conv"], [df.idx.desc()], 150, most=most, many=many).collect()
    assert len(out) == len(expected) and {(r.conv, r.rid) for r in out} == expected
    assert budget.take_what_fits(df.limit(0), ["conv"], ["idx"], 150, most=most).collect() == []
