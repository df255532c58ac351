import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tarn.llm import common as C
from tarn.llm import scans
from tarn.llm import tries as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a int, n int"


def brute(rows, heads=True):
    """[(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends)] in plain Python."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, int(digest[:15], 16), int(digest[15:30], 16), (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20)) if c else 0
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:]) if heads else tuple(turns)
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children, saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * words
            leaves[n[:d]] += not children[n]
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(whole[c]) == len(n)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in members.items()), key=repr)


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, T.prefix_trie(df, **options).collect()), key=repr)


@pytest.fixture()
def narrow(spark):
    """Batches of three rows and many small partitions, so that conversations go over the borders of both."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    was = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, narrow, monkeypatch, seed):
    monkeypatch.setattr(T, "RUN", 4)
    monkeypatch.setattr(T, "CHILDREN", 2)
    monkeypatch.setattr(T, "SHARE", 10**9)
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 45), 100, 101, 107, -3, -20, 10**12]:
        for t in range(r.randint(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["", "a", "a b", "c d e"])))
    rows += [(40, None, None, None), (41, 0, "user", "a"), (41, 0, "user", "a"), (None, 0, "user", "lost"), (44, 9, "", "x " * 3000)]
    rows += [(60 + i % 20, i // 20, "user", "same") for i in range(100)]
    r.shuffle(rows)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, shared_heads=False) == brute(rows, heads=False)


def test_a_conversation_with_most_of_the_turns(spark, narrow):
    rows = [(20, i, "user", f"w{i % 5}") for i in range(90)] + [(21, i, "user", f"w{i % 5}") for i in range(80)] + [(i, 0, "user", "w0") for i in range(22, 35)]
    assert found(spark, rows, parts=5) == brute(rows)


def test_running_sums_over_borders(spark, narrow):
    r = random.Random(9)
    rows = [(r.choice([1, 1, 1, 2, 3, -(2**60)]), i, r.randint(-(2**62), 2**62)) for i in range(120)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "k long, o long, x long").withColumn("y", F.col("x"))
    got = scans.running(df, "k", [F.col("o")], ["o"], sums=["x"], hashes=["y"]).collect()
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    import numpy as np

    want = []
    for k in {x[0] for x in rows}:
        total = hashed = 0
        for at, (_, o, x) in enumerate(sorted(q for q in rows if q[0] == k)):
            total += x
            hashed += int(C.mix(np.array([x], np.int64).view(np.uint64))[0]) * pow(scans.BASE, at, 2**64)
            want.append((k, o, at, wrap(total), wrap(hashed)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []


def test_sql_twin_on_odd_turns(spark):
    rows = [(0, None, None, "a b"), (0, 1, "user", None), (1, 1, "x", "ü"), (1, 1, "x", "v"), (5, 0, "", ""), (7, 0, "u", "q"), (7, 0, "u", "q"), (33, 2, "u", "z")]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(T.OP12_SQL).fetchall(), key=repr) == found(spark, rows) == brute(rows)
