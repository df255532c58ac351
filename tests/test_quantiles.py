import random
import statistics

import numpy as np
import pytest

from tarn.operators import quantiles as Q

SHARES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
KINDS = {
    "even": lambda r: r.random(),
    "ties": lambda r: float(r.randint(0, 3)),
    "wide": lambda r: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300),
    "one far": lambda r: 1e308 if r.random() < 0.01 else r.random() * 1e-9,
    "same": lambda r: 7.5,
    "extreme": lambda r: r.choice([-1.7e308, 1.7e308, 0.0, 5e-324]),
}


def test_same_as_sorting(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 20)
    r = random.Random(5)
    rows = [(g, f(r)) for g, f in KINDS.items() for _ in range(300)] + [(None, r.random()) for _ in range(60)] + [("c", 3.0)]
    odd = [("even", None), ("even", float("nan")), ("e", float("inf")), ("f", None)]
    df = spark.createDataFrame(rows + odd, "g string, v double").coalesce(2)
    got = {x["g"]: x for x in Q.percentiles(df, ["g"], "v", SHARES).collect()}
    low = {x["g"]: x for x in Q.percentiles(df, ["g"], "v", SHARES, floor=True).collect()}
    assert set(got) == set(low) == {*KINDS, None, "c"}
    for g in got:
        values = sorted(v for k, v in rows if k == g)
        assert got[g]["n"] == len(values)
        for name, p in SHARES.items():
            place = p * (len(values) - 1)
            assert low[g][name] == values[int(place)], (g, name)
            a, b = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
            assert got[g][name] == (a if place == int(place) else a + (place - int(place)) * (b - a)), (g, name)


def test_known_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0)], "g int, v double")
    row = Q.percentiles(df, ["g"], "v", {"p95": 0.95, "mid": 0.5}).first()
    assert row["p95"] == pytest.approx(np.percentile([1, 2, 4], 95)) == pytest.approx(3.8) and row["mid"] == statistics.median([1, 2, 4])
    assert Q.percentiles(df, ["g"], "v", {"p95": 0.95}, floor=True).first()["p95"] == 2.0
    assert Q.percentiles(df.where("false"), ["g"], "v", {"p95": 0.95}).count() == 0
