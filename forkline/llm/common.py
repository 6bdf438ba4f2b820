"""What the operators of this subpackage share: safe names, written tables, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]

#: A side whose rows were counted and are no more than this may be broadcast;
#: beyond it every caller has a shuffled plan that gives the same rows.
BROADCAST_ROWS = 1_000_000

#: Distinct words (or pieces) that a Python worker remembers before it forgets all.
CACHE_ENTRIES = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes that go to a Python worker at once, where the session leaves Spark's much larger default.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path, and
    send them texts in small batches: ten thousand long documents at once are too many."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or os.getcwd() == str(ROOT) or getattr(spark.sparkContext, "_forkline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="forkline-zip-")  # on the driver, which serves it to the executors
    target = Path(folder, "forkline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "forkline").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._forkline_shipped = True


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = Path(tempfile.mkdtemp(prefix="forkline-checkpoint-")).as_uri()
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is already over: the folder's owner clears it
        pass


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/forkline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised side may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if its counted rows allow it; a shuffle join otherwise."""
    return F.broadcast(df) if small(df, rows) else df


def id_longs(df: DataFrame, col: str) -> Column:
    """The column of ids as longs. Operators that sort and pack ids take whole numbers only:
    ids of another type are refused before any job runs, rather than cut or dropped."""
    if not isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"ids must be whole numbers; {col} is {df.schema[col].dataType.simpleString()}: number the rows first")
    return df[col].cast("long")


def text_bytes(df: DataFrame, col: str) -> int:
    """The bytes of all texts, counted (a plan's estimate is far off after a join)."""
    return int(df.agg(F.sum(F.octet_length(df[col]))).first()[0] or 0)


def plan_bytes(df: DataFrame) -> int:
    """Estimated bytes of the frame's source, without a job; 0 if the planner can't tell."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else 0


class Bounded(dict):
    """A memo whose misses are computed by `make`. trim() keeps it from growing with the
    data: the younger half becomes the older one, and what is used again comes back."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.entries // 2:
            self.older = dict(self)
            self.clear()


def normal_word(piece: str) -> str:
    """Lower case, letters and digits only."""
    return piece.lower() if piece.isalnum() else "".join(filter(str.isalnum, piece)).lower()


def _hash_word(piece: str) -> int:
    w = normal_word(piece)
    return (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1) if w else 0


class Words:
    """Texts to arrays of 64-bit word hashes. A word is a piece between white space, lower
    case, letters and digits only; pieces without any are left out. Null counts as empty."""

    def __init__(self):
        self.memo = Bounded(_hash_word)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        pieces = text.split()
        h = np.empty(len(pieces), np.uint64)
        for k in range(0, len(pieces), 1 << 16):  # a very long text keeps to the memo's bound, too
            some = pieces[k : k + (1 << 16)]
            h[k : k + len(some)] = np.fromiter(map(self.memo.__getitem__, some), np.uint64, len(some))
            self.memo.trim()
        return h[h != 0] if not h.all() else h


_HELD: dict = {}
_LIBC = ctypes.CDLL(None)
_M_MMAP_THRESHOLD, _LARGE = -3, 1 << 18


def _lean() -> None:
    """Let large arrays, Arrow's too, have pages of their own, so that a worker gives them back
    to the system as they are freed, and doesn't keep holes of the largest it ever had."""
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(_M_MMAP_THRESHOLD, _LARGE)
        pa.set_memory_pool(pa.system_memory_pool())


def held(key, make):
    """What a Python worker keeps from task to task, such as memos: for one operator at a
    time, so that a worker that turns to the next doesn't hold the last one's too."""
    if key not in _HELD:
        if not _HELD:
            _lean()
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):  # give it back to the system
            _LIBC.malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


def words_of_worker() -> Words:
    return held("words", Words)


def sliced(batches, rows: int = 1000):
    """Record batches of fewer rows, so that what a task holds as Python objects is small."""
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            yield whole.slice(k, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One 64-bit hash for each window of n successive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, a in enumerate(odd_constants(n, seed)):
        out += words[k : k + m] * a
    return mix(out)


def rolling(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """As windows(), in time that doesn't depend on n: differences of prefix sums of a
    polynomial over 2**64, brought to one power by an odd (invertible) base."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = int(odd_constants(1, seed)[0]) | 5
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(words), base, np.uint64)) if len(words) else words
        down = np.cumprod(np.full(m, inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * up)])
        return mix((sums[n:] - sums[:m]) * down)


if sys.byteorder != "little":  # arrays travel as little-endian bytes
    raise ImportError("a little-endian machine is needed")


def drop_name(df: DataFrame, name: str, kind: str):
    """The frame's schema and one more column."""
    return df.limit(0).withColumn(name, F.lit(None).cast(kind)).schema
