import random

import pytest

import __spark_entry__
from tarn.operators import quotas as Q

SCHEMA = "bucket string, id long, qtype string, evidence string, topic string, value double, other int"


def plain(rows, targets, quotas):
    """Every row is valued anew for every pick."""
    order = sorted(targets, key=lambda b: sum(r[0] == b for r in rows) - targets[b])
    picked, out = [], []
    for bucket in order:
        for place in range(1, targets[bucket] + 1):
            need = {t: max(0, n - sum(p[2] == t for p in picked)) for t, n in quotas.items()}
            values = []
            for r in rows:
                if r[0] != bucket or r in picked or r[5] is None or r[1] is None:
                    continue
                v = round(r[5] - 0.35 * sum(p[3] == r[3] for p in picked) - 0.12 * sum(p[4] == r[4] for p in picked), 9)
                v += (0.7 * need.get(r[2], 0) / sum(need.values()) if any(need.values()) else 0.0) - (0.0 if need.get(r[2]) else 0.55)
                v -= 0.9 if sum(p[0] == bucket and p[2] == r[2] for p in picked) >= max(3, int(targets[bucket] * 0.6)) else 0.0
                values.append((-round(v, 9), r[1], r))
            if not values:
                break
            best = min(values, key=lambda x: x[:2])[2]
            picked.append(best)
            out.append((bucket, best[1], place))
    return out


def candidates(seed, n):
    r = random.Random(seed)
    some = lambda values: r.choice([*values, None]) if r.random() < 0.1 else r.choice(values)
    hot = lambda: "b" if r.random() < 0.4 else r.choice("acd")
    return [(hot(), i, some(["x", "y", "z", "w"]), some([f"e{j}" for j in range(60)]), some(["s", "t", "u"]), r.choice([None, *(j / 20 for j in range(20))]), 1) for i in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (2, 400), (3, 2500)])
def test_equal_to_valuing_every_row_for_every_pick(spark, seed, n):
    rows, targets, quotas = candidates(seed, n), {"a": 6, "b": 8, "c": 4, "none": 2}, {"x": 7, "y": 5, "z": 2}
    got = Q.quota_selection(spark.createDataFrame(rows, SCHEMA).repartition(3), targets, quotas).collect()
    assert sorted(tuple(g) for g in got) == sorted(plain(rows, targets, quotas)) and len(got) == (14 if n == 40 else 18)  # two buckets of the smallest table run out


def test_what_reaches_the_task_does_not_grow_with_the_table(spark):
    rows = [("a", i, "x", f"e{i % 700}", "t", float(i % 91), 1) for i in range(7000)]
    assert Q.pickable(spark.createDataFrame(rows, SCHEMA).select("bucket", "id", "qtype", "evidence", "topic", "value"), {"a": 5}).count() <= 6 * 5
    assert Q.quota_selection(spark.createDataFrame([], SCHEMA), {"a": 5}, {"x": 1}).collect() == []


def test_query(spark):
    got = __spark_entry__.queries()["quota_selection"](spark, "/root/testdata/sf0.001").collect()
    assert len({g["id"] for g in got}) == len(got) > 50
    places = {}
    for g in got:
        places.setdefault(g["bucket"], []).append(g["place"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
