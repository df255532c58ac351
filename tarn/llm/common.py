"""What several operators of this package share: input columns, checkpoints, word arrays and components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that mapInArrow gets at once, so that long texts don't fill a Python worker.
ARROW_ROWS = 1000
#: Bytes of text that are turned into arrays at once.
CHUNK_BYTES = 1 << 19
#: Rows of ids (8 bytes each) up to which a side of a join may be broadcast: 8 MB.
BROADCAST_IDS = 1_000_000

WORD_SPLIT = "[ \\t-\\r]+"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def arrow_rows(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has the default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs within; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name, "10000")
    spark.conf.set(name, str(min(int(was), ARROW_ROWS) if int(was) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the session set in its stead.

    In local mode, where one machine is all there is, a folder is made if none is set. On a cluster that is an error, as
    each executor would write to its own disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-checkpoint-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint where rows are many. See dropped()."""
    path = shared_folder(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def made_of(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, with which the table of stored() that it reads can be dropped."""
    df._stored_at = table._stored_at
    return df


def dropped(*tables: DataFrame) -> None:
    """Delete the tables of stored() that nothing will read again, and let Spark drop shuffle files of finished steps."""
    for t in tables:
        delete(t.sparkSession, t._stored_at)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir; see shared_base()."""
    sc = df.sparkSession.sparkContext
    base = shared_base(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def inputs(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the columns named, under our own names, whatever else docs has; ids as long, texts as string."""
    kinds = {"id": "long", "text": "string"}
    return docs.select(*(docs[old].cast(kinds[new]).alias(new) if new in kinds else docs[old].alias(new) for new, old in columns.items()))


def join_ids(df: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """df joined with a narrow side: broadcast where it has few rows, shuffled beyond that."""
    few = side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(side) if few else side, on, how)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array, null texts giving none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def crc32_mod3(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 3


#: What a Python worker remembers from task to task, by operator, and how to let go of it.
CACHES: dict[str, Callable[[], None]] = {}


def serving(owner: str) -> None:
    """A Python worker serves one stage after another: let go of what others than this owner remember."""
    for name, clear in CACHES.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()


# --- words as arrays -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240613).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
CACHES["words"] = _powers.clear


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and of its inverse; at least as many as a chunk takes."""
    size = -(-max(n, CHUNK_BYTES + 2) // 65536) * 65536
    if (which, size) not in _powers:
        inverse = np.uint64(pow(int(_BASE[which]), -1, 2**64))
        both = []
        for base in (_BASE[which], inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        for key in [k for k in _powers if k[0] == which and k[1] < size]:
            del _powers[key]
        _powers[which, size] = tuple(both)
    return _powers[which, size]


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for every range, by prefix sums modulo 2**64."""
    up, down = powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a run of texts: bounds[i]:bounds[i+1] are those of text i; hashes are made when asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        space = _SPACE[self.data]
        first, last = np.ones(len(space), bool), np.ones(len(space), bool)
        first[1:], last[:-1] = space[:-1], space[1:]
        inner = offsets[(offsets > 0) & (offsets < len(space))]
        first[inner], last[inner - 1] = True, True
        self.starts = np.flatnonzero(first & ~space)
        self.ends = np.flatnonzero(last & ~space) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, which: int) -> np.ndarray:
        return ranges_hash(_RANDOM[which][self.data], self.starts, self.ends, which)


def word_chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first, after last, Words) of runs of texts of about CHUNK_BYTES; a longer text stands alone."""
    serving("words")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


# --- components ------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for the undirected edges (a, b); component is the least node that can be reached.

    Every round takes the least label of the neighbours and then the label of that label, so that chains shorten
    fast; it ends when nothing changes. Labels are checkpointed each round; only a count reaches the driver.
    """
    both = checkpointed(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        top = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = checkpointed(step.join(top, "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component")))
        labels = new.select("node", "component")
        if new.where("old <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
