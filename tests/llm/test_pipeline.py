import zlib

import brute
import numpy as np

import corpus_pipeline as P
from tarn.llm.tokens import Encoder


def test_stages_one_by_one(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(70))
    base = [" ".join(f"w{i}x{j}" for j in range(40 + i)) for i in range(60)]
    docs = [(i, base[i] + (" " + passage if i % 10 == 0 else "")) for i in range(60)]
    docs += [(100 + i, base[i] + " tail") for i in range(8)] + [(200 + i, base[i] + f" vile scum zorg{i}") for i in range(20, 60)] + [(300, None), (301, "")]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(200 <= i < 300)) for i, _ in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        outs.append(df)
    for out in outs[:-1]:
        assert out.dtypes == spark.createDataFrame([], schema).dtypes
    clean, single, cut, mixed, packed = ([r.asDict() for r in o.collect()] for o in outs)
    assert {r["doc_id"] for r in clean} == {i for i, _ in docs if not 200 <= i < 300}
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in clean])
    assert {r["doc_id"] for r in single} == {g for _, g in groups.values()}
    want = brute.substring([(r["doc_id"], r["text"]) for r in single])
    import hashlib

    assert {r["doc_id"] for r in cut} == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for r in cut:
        assert hashlib.sha256(" ".join(brute.WORD.findall(r["text"] or "")).encode()).hexdigest() == want[r["doc_id"]][2]
    given = {r["doc_id"]: set((r["text"] or "").split()) for r in cut}
    assert mixed and all(set(r["text"].split()) <= given[r["doc_id"]] for r in mixed)
    e = Encoder(None)
    pieces = sorted(zlib.crc32(e.ids([r["text"].encode()])[0].astype("<u4").tobytes()) for r in mixed)
    assert pieces == sorted(r["ids_crc32"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) == -(-sum(r["length"] for r in packed) // 4096)
    assert P.run(spark, str(tmp_path)).count() == len(packed)
    assert np.all([r["offset"] + r["length"] <= 4096 for r in packed])


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows and columns with clashing names: every stage has its result."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, size long, rep long"
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, long, None, None, None), (None, "no id " * 30, "en", "a", 1), (None, None, None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, long + " tail", "en", "b", 7)]
    empty = spark.createDataFrame([], columns)
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (3, 0, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], columns)
    for k, (name, stage) in enumerate(P.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        if k == 2:
            continue  # its ids don't repeat
        got = stage(spark, odd, str(tmp_path)).collect()
        if k < 4:
            assert list(got[0].asDict()) == P.COLUMNS
        assert len(got) == {0: 8, 1: 5, 4: 8}.get(k, len(got)), name
    single = P.one_of_each_group(spark, odd, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in P.cut_repeats(spark, single, str(tmp_path)).collect()) == [0, 0, 1, 3, 4]
