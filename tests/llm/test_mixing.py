import random

import pytest

from tarn.llm import mixing as M


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by giving out shares again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * w[s]
            rest -= target[s]
        open_ -= full or open_
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_limits(spark, monkeypatch, seed):
    monkeypatch.setattr(M, "CHUNK_DOCS", 20)
    monkeypatch.setattr(M, "SHARD_SLOTS", 32)
    monkeypatch.setattr(M, "CHUNK_SHARDS", 3)
    monkeypatch.setattr(M, "CHUNKS", 2)
    r = random.Random(seed)
    names = ["a", "B", "é", None, "zz", ""]
    docs = [(i, "w " * r.randint(0, 400), r.choices(names, [60, 1, 5, 9, 30, 2])[0]) for i in range(300)] + [(900, None, "a"), (901, "", "only empty")]
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id long, text string, source string, rank int, size int")
    got = M.mix(df.repartition(5))["documents"].collect()
    again = M.mix(df.repartition(2))["documents"].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {i: s for i, _, s in docs}
    sizes, taken = {s: 0 for s in set(source.values())}, {s: 0 for s in set(source.values())}
    assert sorted(x["id"] for x in got) == sorted(source)
    for x in got:
        sizes[source[x["id"]]] += x["size"]
        taken[source[x["id"]]] += x["taken"]
        assert 0 <= x["taken"] <= 2 * x["size"]
    want = water(sizes)
    for x in got:
        assert x["source_size"] == sizes[source[x["id"]]]
        assert x["target"] == pytest.approx(want[source[x["id"]]])
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2 * M.BLOCK


def test_parts_are_the_words_taken(spark):
    docs = [(i, " ".join(f"{i}w{j}" for j in range(200)), "en", "s" if i % 3 else "t", 5) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = M.mixed_documents(df).collect()
    taken = {r["id"]: r["taken"] for r in M.mix(df)["documents"].collect()}
    got = dict.fromkeys(taken, 0)
    for r in rows:
        words = r["text"].split(" ")
        at = [int(w.split("w")[1]) for w in words]
        assert at == sorted(set(at)) and all(w.startswith(f"{r['doc_id']}w") for w in words)
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(words)
    assert got == taken


def draws(rows, total, seed, shard_slots):
    """{rank: {shard: slots}} drawn slot by slot: rows (rank, blocks, slots)."""
    got = {r: {} for r, _, _ in rows}
    low = 0
    ranges = []
    for r, _, n in rows:
        ranges.append((low, low + n, r))
        low += n
    for i, u in enumerate(total):
        r = next(r for a, b, r in ranges if a <= u < b)
        got[r][i // shard_slots] = got[r].get(i // shard_slots, 0) + 1
    out = {}
    for r, _, n in rows:
        drawn, at = sum(got[r].values()), 0
        for shard in sorted(got[r]):
            k0, at = at * n // drawn, at + got[r][shard]
            if at * n // drawn > k0:
                out[r, shard] = (k0, at * n // drawn)
    return out


def test_draws_against_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "SHARD_SLOTS", 50)
    monkeypatch.setattr(M, "CHUNK_SHARDS", 4)
    sources = [(1, 64 * 500, 64 * 400.0), (2, 64 * 300, 64 * 600.0), (3, 64 * 90 + 5, 64 * 180.0)]
    df = spark.createDataFrame(sources, "rank int, source_size long, target double")
    wanted = [(r, -(-s // 64), int(t * -(-s // 64) / s + 0.5)) for r, s, t in sources]
    total = sum(n for _, _, n in wanted)
    us = [r[0] for r in spark.range(total).select(F.pmod(F.xxhash64(F.lit(17), F.col("id")), F.lit(total))).orderBy("id").collect()]
    want = draws(wanted, us, 17, 50)
    got = {}
    for r in M.draw(df, 17, 64).collect():
        got.setdefault((r["rank"], r["shard"]), []).append(r["k"])
    assert {k: (min(v), max(v) + 1) for k, v in got.items()} == want
    assert all(sorted(v) == list(range(*want[k])) for k, v in got.items())
    # every shard's counts follow the weights: no shard makes up for the others
    for shard in range(total // 50):
        n = [len(got.get((r, shard), [])) for r, _, _ in wanted]
        assert abs(sum(n) - 50) <= 6


def test_taken_against_brute_force(spark):
    """The words taken of every document, from the slots and the permutations alone."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    docs = [(i, "w " * r.randint(0, 300), "ab"[i % 3 == 0]) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mixed = M.mix(df)
    sized = {x["id"]: x for x in mixed["documents"].collect()}
    order = {x[0]: (x[1], x[0]) for x in spark.createDataFrame(docs, "doc_id long, text string, source string").join(spark.createDataFrame([(s, sum(d[2] == s for d in docs)) for s in "ab"], "source string, docs long"), "source").select("doc_id", F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.expr(f"docs div {M.CHUNK_DOCS} + 1"))).collect()}
    taken = dict.fromkeys(sized, 0)
    for rank, s in enumerate("ab", 1):
        mine = sorted((i for i, _, x in docs if x == s and sized[i]["size"]), key=lambda i: order[i])
        stream = [i for i in mine for _ in range(sized[i]["size"])]
        blocks = -(-len(stream) // M.BLOCK)
        slots = int(sized[mine[0]]["target"] * blocks / len(stream) + 0.5)
        ks = spark.createDataFrame([(k % blocks, blocks, k // blocks) for k in range(slots)], "x long, n long, pass long")
        for row in ks.select(M.permuted("x", "n", F.xxhash64(F.lit(17), F.lit(rank), "pass")).alias("at")).collect():
            for i in stream[row["at"] * M.BLOCK : (row["at"] + 1) * M.BLOCK]:
                taken[i] += 1
    assert taken == {i: x["taken"] for i, x in sized.items()}


def test_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert M.mix(spark.createDataFrame([], schema))["documents"].collect() == []
    assert M.mixed_documents(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in M.mix(spark.createDataFrame([(1, None, "en", "s", 0)], schema))["documents"].collect()] == [(1, 0, 0, 0.0, 0)]


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 64, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long")).select(M.permuted("id", "n", F.lit(5)).alias("y"))
        assert sorted(r[0] for r in df.collect()) == list(range(n))
