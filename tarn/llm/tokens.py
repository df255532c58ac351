"""Token ids of whole texts, and a binary file format for them by Simple-8b word-aligned coding.

Format. A table of blocks, written and read by Spark's own file writers so that any store it reaches will do; each row
is (shard, seq, ids in the block, first and last document, block). Shards hold ascending ranges of ids, blocks hold whole
documents in order. A block is
    magic "S8B1", then 6 little-endian uint32: documents, ids, words of document ids, words of lengths, words of ids,
        entries of the offset index
    the index: for every INDEX_WORDS words of ids, how many ids come before (uint32)
    document ids (differences, zigzag), lengths, and token ids, each as Simple-8b words (uint64)
A word has a 4-bit selector on top and 60 bits of payload, the first value lowest. Selectors 0 and 1 are runs of 240 and
120 zeros; 2 to 14 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3 and 2 values of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15,
20 and 30 bits; 15 is an escape: a value below 2**59 in the payload, or, with the payload's top bit set, in the next word.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import common as C

END_ID = 1
#: Words, or parts of words, whose ids a Python worker remembers.
CACHE = 1_200_000
BLOCK_IDS = 1 << 16
#: Stands for a null id of a document in a block.
NO_ID = np.iinfo(np.int64).min
INDEX_WORDS = 1024
#: Fixed values of the format: how many values a selector packs, and of how many bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 59], np.int64)
_BIG = np.uint64(1 << 59)


def default_tokenizer() -> str:
    """The path of the 49k word BPE file among the public tokenizers of the machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: In a text of ASCII and Latin letters without apostrophes, what the tokenizer encodes each by itself: runs of letters,
#: digits, runs of other marks. These are the kinds of bytes of such a text in lower case.
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_LATIN = bytes([*range(0x80), *range(0x80, 0xC0), 0xC3])
_NOT_PLAIN = (b"'", b"<|", b"\xc3\x97", b"\xc3\xb7")
_GAP = re.compile(rb"[ \t-\r]")
#: Bytes of text whose parts are looked up at once; longer texts are cut at white space, which the tokenizer drops.
AT_ONCE = 8 << 20


class Known(dict):
    """The ids of words, as bytes; what is missing is asked from learn."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    """Ids of texts by a tokenizer that drops white space and case, so that each part between white space stands by itself.

    Texts of Latin letters are cut as the tokenizer cuts them, many texts at once: the bytes where the kind changes are the
    cuts, equal parts are looked up once, and the ids gathered by number. Runs of letters that are not known yet go straight
    to the tokenizer's model, spelled in its byte-level alphabet, if that gives the ids of encode() on a set of probes. Other
    texts are cut at white space only.
    """

    _loaded: dict[str | None, Encoder] = {}

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.words, self.parts = Known(self._whole), Known(self._part)
        self.end = np.array([END_ID], self.kind)
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
        self.spelling = str.maketrans({c: bytes_of.pre_tokenize_str(c)[0][0] for c in letters})
        probes = ["".join(letters[(7 * i + j * j) % len(letters)] for j in range(1 + i % 9)) for i in range(300)]
        probes += [*letters, " ".join(probes), "".join(f"{p}{m}{i}{m}{p.upper()} " for i, p in enumerate(probes) for m in ".,-|(%_")]
        got = self._plain([p.encode() for p in probes])
        self.direct = all(ids.tolist() == self.tokenizer.encode(p, add_special_tokens=False).ids for p, ids in zip(probes, got, strict=True))
        self.parts.clear()

    @classmethod
    def get(cls, path: str | None) -> Encoder:
        """The worker's own encoder of a file; None stands for the default's place on the worker's machine."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, word: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _part(self, part: bytes) -> bytes:
        if _KIND[part[0]] != _LETTER:
            return self._whole(part)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(part.decode().translate(self.spelling))]).tobytes()

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts of Latin letters."""
        ends = np.cumsum([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts).decode().lower().encode(), np.uint8)  # these letters keep their lengths
        if not len(raw):
            return [np.zeros(0, self.kind)] * len(texts)
        kind = _KIND[raw]
        new = np.ones(len(raw), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[ends[ends < len(raw)]] = True
        solid = kind != _SPACE
        bounds = np.searchsorted(np.flatnonzero(new & solid), ends)
        letters = raw[solid]
        starts = np.append(np.flatnonzero(new[solid]), len(letters)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(letters)]).dictionary_encode()
        known = list(map(self.parts.__getitem__, parts.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(known), self.kind)
        n = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        which = parts.indices.to_numpy()
        counts = n[which]
        to = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat((np.cumsum(n) - n)[which] - to[:-1], counts) + np.arange(to[-1])]
        return np.split(ids, to[bounds[:-1]])

    def _is_plain(self, data: bytes) -> bool:
        return self.direct and not data.translate(None, _LATIN) and not any(x in data for x in _NOT_PLAIN)

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        if self._is_plain(b"".join(texts)):
            return self._plain(texts)
        plain = [self._is_plain(t) for t in texts]
        cut = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(cut) if p else np.frombuffer(b"".join(map(self.words.__getitem__, t.split())), self.kind) for t, p in zip(texts, plain, strict=True)]

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For every text (UTF-8) its ids and the end id; null counts as empty."""
        for known in (self.words, self.parts):
            if len(known) > CACHE:
                known.clear()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._some([t for _, t in held]), strict=True):
                out[i].append(ids)

        for i, text in enumerate(texts):
            for piece in _segments(text or b""):
                if held and size + len(piece) > AT_ONCE:
                    flush()
                    held, size = [], 0
                held.append((i, piece))
                size += len(piece)
        flush()
        return [np.concatenate([*pieces, self.end]) for pieces in out]


def _segments(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about AT_ONCE bytes, cut at white space."""
    at = 0
    while len(text) - at > AT_ONCE:
        gap = _GAP.search(text, at + AT_ONCE)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


C.CACHES["tokens"] = Encoder._loaded.clear


def encoded(batches: Iterator[pa.RecordBatch], path: str | None, key: str = "id") -> Iterator[tuple[list, list[np.ndarray]]]:
    """(keys of documents, their token ids), as many at a time as AT_ONCE bytes of text hold, one at least."""
    C.serving("tokens")
    encoder = Encoder.get(path)
    keys: list = []
    texts: list[bytes | None] = []
    size = 0
    for batch in batches:
        for k, text in zip(batch.column(key).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            keys.append(k)
            texts.append(text)
            size += len(text or b"")
            if size >= AT_ONCE:
                yield keys, encoder.ids(texts)
                keys, texts, size = [], [], 0
    if keys:
        yield keys, encoder.ids(texts)


# --- Simple-8b -------------------------------------------------------------------------------


_FEW = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    """How many bits each value takes."""
    bits = _FEW[(v & np.uint64(0xFFFF)).astype(np.uint16)]
    for shift in (16, 32, 48):
        over = np.flatnonzero(v >> np.uint64(shift))
        bits[over] = shift + _FEW[(v[over] >> np.uint64(shift)) & np.uint64(0xFFFF)]
    return bits


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned values; every word takes as many values as fit."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    best = np.full(n, 15, np.int8)
    bits = _bits(v)
    # level[i]: the most bits of any of v[i:i+m]; values past the end count as too wide, so a word never runs over
    level, m = np.concatenate([bits, np.full(256, 255, np.uint8)]), 1
    for sel in range(14, -1, -1):
        count = int(COUNTS[sel])
        while m * 2 <= count:
            level, m = np.concatenate([np.maximum(level[:-m], level[m:]), level[-m:]]), 2 * m
        # more values never take fewer bits, and later selectors have fewer
        if level.min() > WIDTHS[sel]:
            break
        fits = np.maximum(level[:n], level[count - m : count - m + n]) <= WIDTHS[sel]
        best[fits] = sel
    step = COUNTS[best].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    starts = np.array(at)
    sel = best[starts].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel[sel > 1]):
        rows = np.flatnonzero(sel == s)
        for j in range(int(COUNTS[s])):
            words[rows] |= (v[starts[rows] + j] & np.uint64((1 << 60) - 1 if s < 15 else (1 << 59) - 1)) << np.uint64(j * int(WIDTHS[s]))
    large = np.flatnonzero((sel == 15) & (v[starts] >= _BIG))
    if len(large):
        words[large] = (np.uint64(15) << np.uint64(60)) | _BIG
        words = np.insert(words, large + 1, v[starts[large]])
    return words


def layout(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the words that have a selector, how many values each holds); the others are escaped values."""
    flag = (words >> np.uint64(59)) == np.uint64(31)
    if not flag.any():
        where = np.arange(len(words))
    else:
        raw, i = np.zeros(len(words), bool), 0
        for i in np.flatnonzero(flag).tolist():
            if not raw[i]:
                raw[i + 1] = True
        where = np.flatnonzero(~raw)
    return where, COUNTS[(words[where] >> np.uint64(60)).astype(np.int64)]


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words, all words of a selector at a time."""
    where, counts = layout(words)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    heads, sel = words[where], (words[where] >> np.uint64(60)).astype(np.int64)
    for s in np.unique(sel[sel > 1]):
        rows = np.flatnonzero(sel == s)
        first, width = ends[rows] - counts[rows], int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for j in range(int(COUNTS[s])):
            out[first + j] = (heads[rows] >> np.uint64(j * width)) & mask
        if s == 15:
            large = rows[(heads[rows] & _BIG) > 0]
            out[ends[large] - 1] = words[where[large] + 1]
    return out


def write_block(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """One block; ids are the documents', in order, a null one as NO_ID."""
    d = np.diff(np.array([0, *(NO_ID if i is None else i for i in ids)], np.int64))  # wraps, and wraps back when read
    streams = [pack(((d << 1) ^ (d >> 63)).view(np.uint64)), pack(np.array(lengths, np.uint64)), pack(tokens)]
    counts = COUNTS[(streams[2] >> np.uint64(60)).astype(np.int64)]
    index = (np.cumsum(counts) - counts)[::INDEX_WORDS]
    head = struct.pack("<4s6I", b"S8B1", len(ids), len(tokens), *map(len, streams), len(index))
    return head + index.astype("<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for s in streams)


class Block:
    """A block as written: documents at once, ids of tokens where they are asked for."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, a, b, c, n_index = struct.unpack_from("<4s6I", data)
        if magic != b"S8B1" or len(data) != 28 + 4 * n_index + 8 * (a + b + c) or n_index != -(-c // INDEX_WORDS):
            raise ValueError("not a Simple-8b block")
        self.index = np.frombuffer(data, "<u4", n_index, 28).astype(np.int64)
        w = np.frombuffer(data, "<u8", a + b + c, 28 + 4 * n_index).astype(np.uint64)
        self._words = w[a + b :]
        d, self.lengths = unpack(w[:a]), unpack(w[a : a + b]).astype(np.int64)
        self.docs = np.cumsum((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).astype(np.int64))
        if (len(d), len(self.lengths), int(self.lengths.sum())) != (n_docs, n_docs, self.n_ids):
            raise ValueError("a Simple-8b block does not hold what its head says")

    def tokens(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Token ids first to before last: only the words that the offset index names for them are decoded.

        Token ids take 32 bits, so every word of theirs has a selector, also the first one of a stretch of the index.
        """
        last = self.n_ids if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = int(np.searchsorted(self.index, first, "right")) - 1, int(np.searchsorted(self.index, last))
        got = unpack(self._words[low * INDEX_WORDS : high * INDEX_WORDS])
        base = int(self.index[low]) if low >= 0 else -1
        if base < 0 or base + len(got) != (self.index[high] if high < len(self.index) else self.n_ids):
            raise ValueError("the offset index of a Simple-8b block does not fit its words")
        return got[first - base : last - base].astype(np.uint32)


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, token ids) of a block."""
    block = Block(data)
    return block.docs, block.lengths, block.tokens()


BLOCKS = "shard int, seq int, n_ids long, first_id long, last_id long, block binary"


def _blocks(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    shard, seq = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    tokens: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        data = write_block(ids, [len(t) for t in tokens], np.concatenate(tokens))
        ends = [pa.array([NO_ID if i is None else i], pa.int64()) for i in (ids[0], ids[-1])]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), *ends, pa.array([data], pa.binary())], names=["shard", "seq", "n_ids", "first_id", "last_id", "block"])

    for some, arrays in encoded(batches, path):
        for id_, t in zip(some, arrays, strict=True):
            ids.append(id_)
            tokens.append(t)
            held += len(t)
            if held >= BLOCK_IDS:
                yield block()
                ids, tokens, held, seq = [], [], 0, seq + 1
    if ids:
        yield block()


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Write every text's ids, with the end id, to a folder, in ascending order of id over shards, blocks and rows.

    Null and empty texts are one end id. Rows with a null id come first and keep it (the least long is not told from it).
    Repeated rows are written once each; rows with equal ids are in order of their texts. Other columns aren't read,
    whatever their names. An empty table writes an empty folder.
    """
    C.arrow_rows(docs.sparkSession)
    rows = C.inputs(docs, id=id_col, text=text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(lambda it: _blocks(it, tokenizer), BLOCKS).write.parquet(folder)


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _documents(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids, lengths, tokens = read_block(batch.column("block")[i].as_py())
            ends = np.cumsum(lengths)
            yield make(ids, lengths, ends - lengths + batch.column("first")[i].as_py(), np.split(tokens, ends[:-1]))


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of all documents in a folder of write_tokens, from the decoded blocks.

    Rows are those that were written, null ids and repeated rows as they are; an empty folder gives none.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    narrow = blocks.select("shard", "seq", "n_ids")
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = narrow.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", before.alias("base"))  # one row for each writing task
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = narrow.withColumn("inner", inner).join(shards, "shard").select("shard", "seq", (F.col("inner") + F.col("base")).alias("first"))
    kind = pa.list_(pa.int32())

    def make(ids, lengths, starts, tokens):
        cols = [_ids(ids), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64())]
        cols += [pa.array([t.astype(np.int32) for t in tokens], kind)] if with_ids else []
        return pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.join(C.checkpointed(first), ["shard", "seq"]).select("first", "block").mapInArrow(lambda it: _documents(it, make), schema)


def look_up(spark, folder: str, ids: list[int]) -> DataFrame:
    """(id, ids) of some documents: of the blocks that may hold one, only the words of its ids are decoded."""
    wanted = sorted(ids)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block"):
                block = Block(data.as_py())
                ends = np.cumsum(block.lengths)
                at = np.flatnonzero(np.isin(block.docs, wanted))
                got = [block.tokens(int(ends[i] - block.lengths[i]), int(ends[i])).astype(np.int32) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(block.docs[at]), pa.array(got, pa.list_(pa.int32()))], names=["id", "ids"])

    some = [(F.col("first_id") <= i) & (F.col("last_id") >= i) for i in wanted]
    blocks = spark.read.schema(BLOCKS).parquet(folder).where(reduce(or_, some, F.lit(False)))
    return blocks.select("block").mapInArrow(found, "id long, ids array<int>")


def op5_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = C.shared_folder(spark, f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, folder)
    return read_tokens(spark, folder).withColumnRenamed("id", "doc_id")
