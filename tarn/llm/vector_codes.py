"""Compression of vectors to product codes, by Lloyd's rounds with the bounds of Hamerly.

Method. Components become integers; a vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES
entries. With each part of a row its code, one upper bound of the distance to its entry and one lower bound of that to the
second nearest are persisted from round to round. When entries have moved, the bounds are moved along: the upper one by what
the entry moved, the lower one by the most that any other entry did. Where the upper bound is strictly less than the lower
one, or than half of the distance from the entry to the next entry, the entry is the only nearest. Elsewhere the distance to
the entry is taken anew, and if that is not enough either, the part is compared with all entries, in whole numbers, and the
least index of equal ones is taken. Bounds are rounded outwards, so that rounding can't hide a tie.

Rows stay where they are: a round is one pass over the table, each task sums its rows by entry, and (entries x parts) sums
are merged, whatever the number of rows. Codebooks have a fixed size and travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bounds are moved outwards by this share, which is far more than what rounding of a few doubles can do.
SLACK = 1e-12
#: Rows that are compared with all entries at once.
ROWS = 2048
#: Products of whole numbers up to this are exact in doubles.
EXACT = 1 << 52

STATE = "code array<int>, upper array<double>, lower array<double>, scans int"


def most_of(width: int) -> int:
    """The greatest component in either direction with which squared distances of a part fit 64 bits."""
    return int((2**61 / max(width, 1)) ** 0.5) // 2


def integers(vector: Column, most: int, scale: int) -> Column:
    """floor(scale * x) of each component, not beyond most in either direction."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x.cast("double") * scale))).cast("long"))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, both whole numbers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


class Moves:
    """What bounds need to know about a codebook (entries, width) and the one before it."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        gaps = distances(entries, entries).astype(np.float64)
        np.fill_diagonal(gaps, np.inf)
        self.half = np.sqrt(gaps.min(1)) / 2 * (1 - SLACK)
        if before is None:
            return
        self.own = np.sqrt(((entries - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        far = int(self.own.argmax())
        self.others = np.full(len(entries), self.own[far])
        self.others[far] = np.delete(self.own, far).max(initial=0.0)


def assigned(x: np.ndarray, moves: Moves, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower, whether all entries were looked at) of one part of some rows."""
    if fresh:
        code, upper, lower, look = code.copy(), upper.copy(), lower.copy(), np.ones(len(x), bool)
    else:
        upper = (upper + moves.own[code]) * (1 + SLACK)
        lower = np.maximum(lower - moves.others[code], 0) * (1 - SLACK)
        sure = np.maximum(moves.half[code], lower)
        near = np.flatnonzero(~(upper < sure))
        upper[near] = np.sqrt(((x[near] - moves.entries[code[near]]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        look = ~(upper < sure)
    code = code.copy()
    todo = np.flatnonzero(look)
    for a in range(0, len(todo), ROWS):
        at = todo[a : a + ROWS]
        d = distances(x[at], moves.entries)
        rows = np.arange(len(at))
        best = d.argmin(1)  # the first of equal ones
        code[at], upper[at] = best, np.sqrt(d[rows, best].astype(np.float64)) * (1 + SLACK)
        rest = d.astype(np.float64)
        rest[rows, best] = np.inf
        lower[at] = np.sqrt(rest.min(1)) * (1 - SLACK)
    return code, upper, lower, look


def matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def parts_of(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """The whole numbers of a batch's vectors, (rows, parts, width)."""
    return matrix(batch["q"], batch.num_rows, np.int64).reshape(batch.num_rows, parts, width)


def step(books: np.ndarray, before: np.ndarray | None):
    """A pass over (id, label, q[, code, upper, lower]): assign all parts to the codebooks (parts, entries, width)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = [Moves(books[p], None if before is None else before[p]) for p in range(parts)]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = parts_of(b, parts, width)
            fresh = before is None
            code = np.zeros((n, parts), np.int64) if fresh else matrix(b["code"], n, np.int64)
            upper = np.zeros((n, parts)) if fresh else matrix(b["upper"], n, np.float64)
            lower = np.zeros((n, parts)) if fresh else matrix(b["lower"], n, np.float64)
            done = [assigned(x[:, p], moves[p], code[:, p], upper[:, p], lower[:, p], fresh) for p in range(parts)]
            code, upper, lower, look = (np.stack(v, 1) for v in zip(*done))
            columns = [b["id"], b["label"], b["q"], lists(code, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(look.sum(1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "q", "code", "upper", "lower", "scans"])

    return run


def summed(parts: int, entries: int, width: int):
    """A pass over (q, code): the number and the sum of the parts of each entry that a task has, as one row an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            if b.num_rows:
                cell = matrix(b["code"], b.num_rows, np.int64) + np.arange(parts) * entries
                np.add.at(sums, cell.reshape(-1), parts_of(b, parts, width).reshape(-1, width))
                counts += np.bincount(cell.reshape(-1), minlength=len(counts))
        used = np.flatnonzero(counts)
        columns = [pa.array(used, pa.int64()), pa.array(counts[used]), *(pa.array(sums[used, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n", *(f"s{i}" for i in range(width))])

    return run


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floor of the mean of its parts; unused ones stay. As many rows as there are entries reach the driver."""
    parts, entries, width = books.shape
    names = ["n", *(f"s{i}" for i in range(width))]
    sums = state.select("q", "code").mapInArrow(summed(parts, entries, width), ", ".join(f"{c} long" for c in ["cell", *names]))
    new = books.copy()
    for r in sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in names)).collect():
        new[r["cell"] // entries, r["cell"] % entries] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def measured(books: np.ndarray):
    """A pass over (id, label, q, code): the code as hexadecimal digits and the exact squared error."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = matrix(b["code"], b.num_rows, np.int64)
                near = np.stack([books[p][code[:, p]] for p in range(parts)], 1)
                error = ((parts_of(b, parts, width) - near) ** 2).sum((1, 2))
                hexes = pa.array(["".join(f"{c:02x}" for c in row) for row in code.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([b["id"], b["label"], hexes, pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> dict[str, object]:
    """Returns "codes" (id, label, code, error), "labels" (label, label_error), "codebooks", whole numbers by (part, entry,
    position), and "scans", how many parts were compared with all entries in each round.

    There are at most 256 entries, as a code has two digits a part. Rows whose vector is null, or holds null or non-finite components, have no code and no row. Codebooks start as the parts
    of the first rows by id (equal ids: by components), null ids never among them; of fewer rows there are fewer entries.
    Vectors that are shorter than the longest, or whose length `parts` doesn't divide, end in zeros as far as needed; an empty
    vector is all zeros. Components beyond what squared distances in 64 bits allow (over a million times the scale at 16
    a part) count as that limit. Repeated rows, equal and null ids are rows of their own; null labels are one label. An
    empty table, or one without a row that has an id, gives empty results. Other columns aren't read, whatever their names.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = C.inputs(vectors, id=id_col, v=vector_col, label=label_col).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-size // parts)
    padded = F.concat(integers(F.col("v"), most_of(width), scale), F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v")))
    rows = rows.select("id", "label", padded.alias("q"))
    first = [r["q"] for r in rows.where("id is not null").orderBy("id", "q").limit(entries).select("q").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2) if first else np.zeros((parts, 0, width), np.int64)
    label = dict(rows.dtypes)["label"]
    if not first:
        none = rows.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return {"codes": none, "labels": none.select("label", F.col("error").alias("label_error")), "codebooks": books, "scans": []}
    schema, before, state, scans = f"id long, label {label}, q array<long>, {STATE}", None, rows, []
    with C.small_batches(spark):
        for i in range(rounds + 1):
            new = C.stored(state.mapInArrow(step(books, before), schema))
            if i:
                C.dropped(state)
            state = new
            scans.append(state.agg(F.sum("scans")).first()[0])
            if i < rounds:
                before, books = books, moved(state, books)
        codes = C.checkpointed(state.select("id", "label", "q", "code").mapInArrow(measured(books), f"id long, label {label}, code string, error long"))
    C.dropped(state)
    return {"codes": codes, "labels": codes.groupBy("label").agg(F.sum("error").alias("label_error")), "codebooks": books, "scans": scans}


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, vector): the vectors that codes stand for. codes (id, code, ...) as vector_codes() returns them."""
    parts = [F.array(*(F.array(*(F.lit(x / scale) for x in e)) for e in book.tolist())) for book in books]
    places = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return codes.select("id", F.concat(*(F.get(b, at) for b, at in zip(parts, places))).alias("vector"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    out = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, out["codebooks"].reshape(-1).tolist())).encode()).hexdigest()
    labels = C.checkpointed(out["labels"]).withColumnRenamed("label", "of")
    few = labels.limit(C.BROADCAST_IDS + 1).count() <= C.BROADCAST_IDS
    codes = out["codes"]
    joined = codes.join(F.broadcast(labels) if few else labels, codes["label"].eqNullSafe(labels["of"]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds(rounds: int) -> str:
    """Common tables b0, a0, b1, a1, ...: the codebooks and the assignment to them of each round."""
    out = []
    for i in range(rounds + 1):
        if i:
            mean = f"SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT a.p, a.e, v.x FROM a{i - 1} AS a JOIN v USING (r, p)), range(1, 17) AS g(i) GROUP BY p, e, i"
            out.append(f"b{i} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i - 1} AS b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM ({mean}) GROUP BY p, e) AS n ON n.p = b.p AND n.e = b.e)")
        square = "list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, p, min(k)[2] AS e, min(k)[1] AS d FROM (SELECT v.r, v.p, [CAST({square} AS BIGINT), b.e] AS k FROM v JOIN b{i} AS b USING (p)) GROUP BY r, p)")
    return ",\n".join(out)


OP11_SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM kept),
v AS MATERIALIZED (SELECT r, p, q[16 * p + 1:16 * p + 16] AS x FROM q, range(0, 4) AS g(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM v WHERE r < 256),
{_rounds(ROUNDS)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM sha) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
