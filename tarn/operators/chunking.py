"""Chunkers that built-in functions can't express: row-expanding, order-sensitive."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators in order of preference, sizes of chunks and overlaps.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
SIZE, OVERLAP, MOST, LEAST = 1200, 200, 6000, 50
#: Texts that are cut at once.
ROWS = 500


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that there is; neighbours share up to overlap."""
    sep = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = text.split(sep) if sep else list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def emit() -> None:
        piece = sep.join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size and finer:
            if held:
                emit()
                held, length = [], 0
            out += split_recursive(part, size, overlap, finer)
            continue
        if held and length + len(sep) + len(part) > size:
            emit()
            while held and (length > overlap or length + len(sep) + len(part) > size):
                length -= len(held.pop(0)) + (len(sep) if held else 0)
        length += len(part) + (len(sep) if held else 0)
        held.append(part)
    if held:
        emit()
    return out


def pieces(docs: DataFrame, keep: list[str], whole: str | None = None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(keep..., part, nth, chunk, start) of docs (keep..., text): pieces by size, numbered before (part) and after (nth) those of
    under `least` characters go. start is where a piece is found from the end of the one before, less the overlap. Texts of
    rows that the column `whole` marks stay as they are, without part. Null texts have none. Nothing is moved."""
    fields = [docs.schema[c] for c in keep]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "part int, nth int, chunk string, start int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b, rows = batch.slice(i, ROWS), []
                wholes = b.column("whole").to_pylist()
                for row, text in enumerate(b.column("text").to_pylist()):
                    if wholes[row]:
                        rows.append((row, None, 0, text, 0))
                        continue
                    cursor = nth = 0
                    for part, chunk in enumerate(split_recursive(text or "", size, overlap)):
                        at = (text or "").find(chunk, cursor)
                        at = cursor if at < 0 else at
                        if len(chunk) >= least:
                            rows.append((row, part, nth, chunk, at))
                            nth += 1
                        cursor = max(at + len(chunk) - overlap, 0)
                at, *out = zip(*rows, strict=True) if rows else [()] * 5
                kept = b.select(keep).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True))], [*keep, "part", "nth", "chunk", "start"])

    rows = docs.select(*keep, "text", (F.coalesce(whole, F.lit(False)) if whole else F.lit(False)).alias("whole"))
    return rows.mapInArrow(run, kinds)


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, part, chunk, start): see pieces()."""
    return pieces(docs, ["doc_id"], None, size, overlap, least).select("doc_id", "part", "chunk", "start")


def first_json(text: str | None) -> str | None:
    """The first object of JSON in a text outside code fences; null if there is none."""
    text = re.sub(r"```(?:json)?", "", text or "")
    decoder = json.JSONDecoder()
    for start in (m.start() for m in re.finditer("{", text)):
        try:
            end = decoder.raw_decode(text, start)[1]
        except ValueError:
            continue
        return text[start:end]
    return None


def first_json_of(text: Column) -> Column:
    """first_json of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def found(x: pd.Series) -> pd.Series:
        return x.map(first_json)

    return found(text)
