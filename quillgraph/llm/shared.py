"""What the text operators share: intermediate tables, array views of Arrow text, word hashes."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the memory of a Python worker.
PASS_BYTES = 1 << 20

#: While a table is written: rows and bytes of text that go to a Python worker at once.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Tables between two collections of the driver's garbage: only then Spark lets go of shuffle files and broadcasts of tables already written.
COLLECT_EVERY = 12


# ---------------------------------------------------------------- intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
        if here.isDefined():
            return here.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "local" not in _own:
            _own["local"] = tempfile.mkdtemp(prefix="quillgraph-")
            atexit.register(shutil.rmtree, _own["local"], True)
        found = f"file://{_own['local']}"
    return found


_own: dict[str, str] = {}


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost no recomputation.

    ``keep`` writes and rereads a frame, under ``settings`` of the session; ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str, settings: dict[str, str] | None = None):
        self.spark = spark
        self.settings = SMALL_BATCHES | (settings or {})
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: list[str] = []

    def keep(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        before = {key: self.spark.conf.get(key, None) for key in self.settings}
        try:
            for key, value in self.settings.items():
                self.spark.conf.set(key, value)
            frame.write.parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        if self.count % COLLECT_EVERY == 0:
            self.spark._jvm.System.gc()
        self.paths.append(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def keep_only(self, *frames: DataFrame) -> None:
        """Removes all tables kept so far but these."""
        stay = {frame._scratch_path for frame in frames}
        self._remove([path for path in self.paths if path not in stay])

    def drop(self, *frames: DataFrame) -> None:
        self._remove([frame._scratch_path for frame in frames])

    def _remove(self, paths: list[str]) -> None:
        jvm = self.spark._jvm
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            if name in self.paths:
                self.paths.remove(name)


def fit_once(sample: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """What ``fit`` makes of the rows of a bounded sample, in one task, so that the driver holds the result alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["made"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "made binary").first()["made"])


def fresh_name(taken: list[str], wanted: str) -> str:
    """A column name that ``taken`` has not, whatever extra columns the input carries."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def training_row(doc_id: Column | str) -> Column:
    """True on rows that models may learn from: crc32 of the id as text is not 2 modulo 4."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % 4 != 2


# ---------------------------------------------------------------- Arrow text as arrays


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_groups(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


# ---------------------------------------------------------------- word hashes

_RNG = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words: space and the five control characters from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = np.ones(1, np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n + 1:
        grown = np.full(max(n + 1, PASS_BYTES + 1), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; a word never crosses a text's end."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(part[data], out=inside[1:-1])
    begin = inside[1:] & ~inside[:-1]
    stop = ~inside[1:] & inside[:-1]
    edges = offsets[1:-1]
    joined = edges[inside[edges] & inside[edges + 1]] if len(edges) else edges
    begin[joined] = True
    stop[joined] = True
    return np.flatnonzero(begin), np.flatnonzero(stop)


def span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], fold: np.ndarray = LOWER) -> list[np.ndarray]:
    """Hashes of the folded bytes of several lists of spans (starts, ends) over the same bytes."""
    n = len(data)
    power = _power_table(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[fold[data]] * power[:n], out=total[1:])
    return [scramble((total[ends] - total[starts]) * power[n - starts] * _inverse(n)) for starts, ends in spans]


_inverses: dict[int, np.uint64] = {}


def _inverse(n: int) -> np.uint64:
    """The power -n of the base, so that a word's hash does not depend on its place."""
    if n not in _inverses:
        if len(_inverses) > 10_000:
            _inverses.clear()
        _inverses[n] = np.uint64(pow(int(_BASE), -n, 2**64))
    return _inverses[n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = BLANK, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each folded word, first word of each text and the end).

    Works through a long text piece by piece, cut where words part, so memory follows PASS_BYTES.
    """
    starts, ends = word_spans(data, offsets, part)
    first = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + PASS_BYTES, side="right"))
        to = max(to, at + 1)
        low, high = starts[at], ends[to - 1]
        out[at:to] = span_hashes(data[low:high], [(starts[at:to] - low, ends[at:to] - low)], fold)[0]
        at = to
    return out, first


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- links to components


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every linked node that is not the smallest of its component.

    ``links`` has long columns a and b. Large-star and small-star rounds in turn: every round is two
    aggregations and two joins on node ids, no group is gathered, and the rounds needed grow with the
    logarithm of the longest chain. Each round is written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = scratch.keep(links.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    seen = _state(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.union(centre.toDF("u", "v")).distinct())
        now = _state(after)
        scratch.drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set: two numbers on the driver, never the edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("d")).first()
    return row.n, row.d
