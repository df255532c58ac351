"""Running sums by key over a table that is sorted across all tasks, so that no key has to fit into one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

#: The base of polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_ALL = 1 << 64


def base_power(of: np.ndarray) -> np.ndarray:
    """BASE ** of modulo 2**64, by squaring: as many steps as the greatest exponent has bits."""
    out, square = np.ones(len(of), np.uint64), np.uint64(BASE)
    for bit in range(int(of.max(initial=0)).bit_length()):
        out = np.where(of >> bit & 1, out * square, out)
        square = np.uint64(int(square) ** 2 % _ALL)
    return out


def _local(key: str, sums: list[str], hashes: list[str], names: list[str]):
    """A pass over a task's sorted rows: place in the key, sums and hashes up to here, as far as this task knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at0, upto = TaskContext.get().partitionId(), None, 0, dict.fromkeys(sums + hashes, np.uint64(0))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b[key].to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            first[0] = keys[0] != last
            group = np.cumsum(first)
            starts = np.flatnonzero(first)
            at = np.arange(n, dtype=np.int64)
            at -= np.concatenate([[-at0], starts])[group]
            cols = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)]
            for c in sums + hashes:
                x = b[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                if c in hashes:
                    x = C.mix(x) * base_power(at)
                s = np.cumsum(x)
                s += np.concatenate([np.array([upto[c]], np.uint64), (x - s)[starts]])[group]
                cols.append(pa.array(s.view(np.int64)))
                upto[c] = s[-1]
            last, at0 = keys[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _carried(key: str, sums: list[str], hashes: list[str], carry: dict[int, tuple], names: list[str]):
    """A pass that adds what earlier tasks know of the key a task starts with. carry: task -> (key, rows, *values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, parts = b[key].to_numpy(zero_copy_only=False), b["_part"].to_numpy()
            cols = {c: b[c] for c in names}
            for part in set(parts.tolist()) & carry.keys():
                of, rows, *values = carry[part]
                where = np.flatnonzero((parts == part) & (keys == of))
                if not len(where):
                    continue
                at = cols["at"].to_numpy().copy()
                at[where] += rows
                cols["at"] = pa.array(at)
                for c, v in zip(sums + hashes, values):
                    x = cols[f"{c}_upto"].to_numpy().view(np.uint64).copy()
                    x[where] = x[where] * (np.uint64(pow(BASE, rows, _ALL)) if c in hashes else np.uint64(1)) + np.uint64(v)
                    cols[f"{c}_upto"] = pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return run


def running(df: DataFrame, key: str, order: list[Column], keep: list[str], sums: list[str] = [], hashes: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, keep..., at, <c>_upto for each of sums and hashes): place of each row in its key, from 0, and what c makes up to
    and with it: the sum, or the sum of mix(c) * BASE ** place, modulo 2**64. key is a long without nulls.

    Rows are sorted by key and order over all tasks, so a key with any share of the rows is spread over many of them. What
    a task must know of the tasks before it is one row of each, which the driver adds up.
    """
    fields = [key, *dict.fromkeys(keep + sums + hashes)]
    kinds = dict(df.dtypes)
    made = ["at", *(f"{c}_upto" for c in sums + hashes)]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in fields), "_part int", *(f"`{c}` long" for c in made)])
    ordered = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*fields)
    local = C.stored(ordered.mapInArrow(_local(key, sums, hashes, [*fields, "_part", *made]), schema))
    tail = F.max_by(F.struct(*made), F.struct(key, "at"))
    carry, last = {}, None
    for r in local.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"), tail.alias("tail")).orderBy("_part").collect():
        rows, values = r["tail"]["at"] + 1, [r["tail"][c] % _ALL for c in made[1:]]
        if last and last[0] == r["low"]:
            carry[r["_part"]] = tuple(last)
            if r["low"] == r["high"]:
                shift = [1] * len(sums) + [pow(BASE, last[1], _ALL)] * len(hashes)
                values = [(v * s + b) % _ALL for v, s, b in zip(values, shift, last[2:])]
                rows += last[1]
        last = [r["high"], rows, *values]
    names = [key, *keep, *made]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [key, *keep]), *(f"`{c}` long" for c in made)])
    out = local.mapInArrow(_carried(key, sums, hashes, carry, names), schema) if carry else local.select(*names)
    return C.made_of(out, local)
