import zlib

import numpy as np
import pytest

from tarn.llm import tokens as T


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(0, 700))
        v = r.integers(0, 2**63, n, dtype=np.uint64) >> r.integers(0, 64, n).astype(np.uint64)
        if n and r.random() < 0.5:
            v[int(r.integers(0, n)) :] = 0
        if n > 3 and r.random() < 0.3:
            v[r.integers(0, n, 3)] = 2**64 - 1
        assert np.array_equal(T.unpack(T.pack(v)), v)


def test_block_round_trip():
    ids, lengths = [-5, 3, 3, 2**40], [1, 0, 4, 2]
    got = T.read_block(T.write_block(ids, lengths, np.arange(7)))
    assert [x.tolist() for x in got] == [ids, lengths, list(range(7))]
    with pytest.raises(ValueError):
        T.read_block(b"XXXX" + T.write_block(ids, lengths, np.arange(7))[4:])


def test_same_ids_as_the_tokenizer():
    e = T.Encoder(None)
    odd = ["a b", "Ó X̌", "J̌x", "it's", "İstanbul ΑΣ ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "x²3½", "\x00a\x1cb　c", "ab''s", "ÀÉÖ×÷ßÿ", "a.'s", "naïve—dash", "日本語", ""]
    for o in odd:
        assert e.ids([o.encode()])[0].tolist() == [*e.tokenizer.encode(o, add_special_tokens=False).ids, 1]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    e = T.Encoder(None)
    texts = ["it is 12,5 naïve (words) here\nand THERE " * 40, "日本語 text's " * 30, "x" * 500, ""]
    want = [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for size in (7, 100, 1000):
        monkeypatch.setattr(T, "AT_ONCE", size)
        assert [x.tolist() for x in e.ids([t.encode() for t in texts])] == want


def test_index_finds_ids():
    tokens = np.random.default_rng(3).integers(0, 50_000, 20_000)
    data = T.write_block(list(range(20)), [1000] * 20, tokens)
    block = T.Block(data)
    assert len(block.index) > 3
    for a, b in ((0, 1), (0, 20_000), (7000, 9000), (19_999, 20_000), (5, 5)):
        assert block.tokens(a, b).tolist() == tokens[a:b].tolist()
    spoilt = bytearray(data)
    spoilt[28 : 28 + 4 * len(block.index)] = b"\xff" * 4 * len(block.index)
    with pytest.raises(ValueError):
        T.read_block(bytes(spoilt))


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_written_and_read_back(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_IDS", block)
    docs = [(i * 3 % 101, f"Word {i} " * (i % 7)) for i in range(101)] + [(500, None), (501, ""), (502, "x " * 5000), (502, "x " * 5000), (None, "no id")]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, start long").repartition(3)
    T.write_tokens(df, str(tmp_path / "t"))
    got = T.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    e, at, want = T.Encoder(None), 0, []
    for i, t in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    some = T.look_up(spark, str(tmp_path / "t"), [3, 501, 999]).collect()
    assert sorted(map(tuple, some)) == sorted((w[0], w[4]) for w in want if w[0] in (3, 501))


def test_empty_table(spark, tmp_path):
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert T.read_tokens(spark, str(tmp_path / "t")).collect() == []
