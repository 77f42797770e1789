"""Near-duplicate embeddings by cosine, with randomised-rotation binary codes.

A vector is turned by seeded random rotations; the signs of its turned coordinates are its bits. The signs of
the first rotation are its code, stored with the correction factor f, the inner product of the code with the
turned unit vector. For another unit vector y, <code, Py> / f estimates <x, y> without bias, and the error stays
within SIGMAS * sqrt((1 - f^2) / f^2 / (D - 1)) but for rare cases. A pair is recomputed exactly, in double
precision, only if the upper bounds from both of its codes reach the threshold; nothing is linked by estimate.

Candidates are pairs that agree in all bits of one of several tables. The bits of a table grow with the logarithm
of the number of vectors, and there are as many tables as a pair at the threshold needs to be missed with
probability MISS at most. Only ids and keys are shuffled to find the buckets that hold several vectors; only
their members then carry vectors. A bucket of over TILE members is split into tiles of two chunks each, so no
task gathers it. A tile gives one row for each linked vector: its number of new links and its root in the
tile's own components; pairs are never written. A pair is counted in the first table only in which it agrees.

Equal vectors are one class from the start, with a multiplicity.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing;
vectors of different lengths never link; rows that share a vec_id are one vector whose links are joined; a null
vec_id links with nothing and is kept; labels and extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import Scratch, components, scramble

THRESHOLD = 0.95
MISS = 1e-3
SIGMAS = 4.0
TILE = 1024
PAIRS_AT_ONCE = 100_000

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotations(dim: int, bits: int) -> np.ndarray:
    """dim x (a multiple of dim, at least ``bits``): seeded random rotations side by side."""
    count = max(1, -(-bits // dim))
    if (dim, count) not in _rotations:
        made = []
        for k in range(count):
            q, r = np.linalg.qr(np.random.default_rng((dim, k, 11)).normal(size=(dim, dim)))
            made.append(q * np.sign(np.diag(r)))
        _rotations[dim, count] = np.concatenate(made, 1)
    return _rotations[dim, count]


def table_plan(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a table, tables) for so many vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(8, math.ceil(math.log2(max(vectors, 2))) + 2))
    return bits, math.ceil(math.log(miss) / math.log(1 - agree**bits))


def _table_keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    packed = signs[:, : bits * tables].reshape(len(signs), tables, bits).astype(np.uint64) @ weights
    return scramble(packed + (np.arange(tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as double, nulls and all, list offsets, rows that are null)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    empty = np.asarray(column.is_null())
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    sizes = np.where(empty, 0, sizes)
    return values, np.concatenate(([0], np.cumsum(sizes))), empty


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and two digests of each usable vector; null digests for the others."""
    for batch in batches:
        values, ends, _ = _lists(batch.column(1))
        rows = batch.num_rows
        size = np.diff(ends)
        of = np.repeat(np.arange(rows), size)
        good = np.ones(rows, bool)
        good[of[~np.isfinite(values)]] = False
        clean = np.where(np.isfinite(values), values, 0.0) + 0.0  # -0.0 becomes 0.0
        norm = np.bincount(of, clean * clean, rows)
        good &= (size > 0) & (norm > 0) & np.isfinite(norm)
        place = (np.arange(len(values)) - np.repeat(ends[:-1], size)).astype(np.uint64)
        digests = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            h = scramble(clean.view(np.uint64) ^ scramble(place * np.uint64(2) + np.uint64(salt)))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
            digests.append(pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64), mask=~good))
        yield pa.RecordBatch.from_arrays([batch.column(0), *digests], names=["vec_id", "d1", "d2"])


def _check_with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for made in _check(iter([batch])):
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column(1)], names=[*made.schema.names, "embedding"])


def _coded(bits: int, tables: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends, _ = _lists(batch.column(2))
            size = np.diff(ends)
            keys, packed, factor = np.zeros((batch.num_rows, tables), np.uint64), [b""] * batch.num_rows, np.zeros(batch.num_rows)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = values[ends[rows][:, None] + np.arange(dim)]
                turn = rotations(int(dim), bits * tables)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
                signs = y > 0
                keys[rows] = _table_keys(signs, bits, tables) + np.uint64(int(dim))
                factor[rows] = np.abs(y[:, :dim]).sum(1) / math.sqrt(dim)
                for row, code_bytes in zip(rows, np.packbits(signs, 1), strict=True):
                    packed[row] = code_bytes.tobytes()
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(packed, pa.binary()), pa.array(factor)], names=[*batch.schema.names, "keys", "bits", "factor"])

    return code


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name reachable from each of n vertices over the edges."""
    rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
    label = rank.copy()
    by_rank = np.argsort(rank)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[by_rank[after]]
        if np.array_equal(after, label):
            return names[by_rank[label]]
        label = after


def _link_tiles(bits: int, tables: int, threshold: float):
    """Links inside each run of rows with the same (key, ti, tj); rows come sorted by these."""

    def link(group: pa.Table) -> pa.RecordBatch | None:
        key, ti, tj, chunk = (group.column(c).to_numpy() for c in ("key", "ti", "tj", "chunk"))
        node, count, factor = (group.column(c).to_numpy() for c in ("node", "copies", "factor"))
        values, ends, _ = _lists(group.column("embedding"))
        n = len(key)
        dims = np.diff(ends)
        run = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1]))))
        ends_of = np.searchsorted(run, run, side="right")
        longest = int((ends_of - np.arange(n)).max())
        codes = group.column("bits").to_pylist()
        found_a, found_b = [], []
        held, size = [], 0

        def settle(a: np.ndarray, b: np.ndarray) -> None:
            for dim in np.unique(dims[a]):
                own = (dims[a] == dim) & (dims[b] == dim)
                i, j = a[own], b[own]
                rows, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                i_at, j_at = where[: len(i)], where[len(i) :]
                x = values[ends[rows][:, None] + np.arange(dim)]
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                signs = np.unpackbits(np.frombuffer(b"".join(codes[r] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(bool)
                turned = unit @ rotations(int(dim), bits * tables)[:, :dim]
                code = np.where(signs[:, :dim], 1.0, -1.0) / math.sqrt(dim)
                f = np.maximum(factor[rows], 1e-9)
                slack = SIGMAS * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1))
                upper_i = np.einsum("pd,pd->p", code[i_at], turned[j_at]) / f[i_at] + slack[i_at]
                upper_j = np.einsum("pd,pd->p", code[j_at], turned[i_at]) / f[j_at] + slack[j_at]
                near = (upper_i >= threshold) & (upper_j >= threshold)
                i, j, i_at, j_at = i[near], j[near], i_at[near], j_at[near]
                u, v = x[i_at], x[j_at]
                cosine = np.einsum("pd,pd->p", u, v) / (np.sqrt(np.einsum("pd,pd->p", u, u)) * np.sqrt(np.einsum("pd,pd->p", v, v)))
                hit = cosine >= threshold
                i, j, i_at, j_at = i[hit], j[hit], i_at[hit], j_at[hit]
                if not len(i):
                    continue
                keys = _table_keys(signs, bits, tables) + np.uint64(int(dim))
                first = (keys[i_at] == keys[j_at]).argmax(1)
                new = keys[i_at, first].view(np.int64) == key[i]
                found_a.append(i[new])
                found_b.append(j[new])

        for d in range(1, longest):
            a = np.flatnonzero(np.arange(n) + d < ends_of)
            b = a + d
            low, high = np.minimum(chunk[a], chunk[b]), np.maximum(chunk[a], chunk[b])
            mine = (low == ti[a]) & (high == tj[a])
            a, b = a[mine], b[mine]
            held.append((a, b))
            size += len(a)
            if size >= PAIRS_AT_ONCE or d == longest - 1:
                every = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                for k in range(0, len(every[0]), PAIRS_AT_ONCE):
                    settle(every[0][k : k + PAIRS_AT_ONCE], every[1][k : k + PAIRS_AT_ONCE])
                held, size = [], 0
        if not found_a:
            return None
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        names, index = np.unique(node, return_inverse=True)
        linked = np.bincount(index[a], count[b], len(names)) + np.bincount(index[b], count[a], len(names))
        roots = _local_roots(len(names), index[a], index[b], names)
        some = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(linked[some].astype(np.int64)), pa.array(roots[some])], names=["node", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if rest is None else pa.concat_tables([rest, got]).combine_chunks()
            last = held.slice(held.num_rows - 1).select(["key", "ti", "tj"]).to_pylist()[0]
            same = (held.column("key").to_numpy() == last["key"]) & (held.column("ti").to_numpy() == last["ti"]) & (held.column("tj").to_numpy() == last["tj"])
            cut = int(np.argmax(same))
            rest = held.slice(cut)
            if cut:
                made = link(held.slice(0, cut).combine_chunks())
                if made is not None:
                    yield made
        if rest is not None and rest.num_rows:
            made = link(rest.combine_chunks())
            if made is not None:
                yield made

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "embed-dup")
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    checked = scratch.keep(read.mapInArrow(_check, "vec_id long, d1 long, d2 long"))
    usable = checked.where("vec_id is not null and d1 is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    split = scratch.keep(usable.groupBy("vec_id").agg(F.min(F.struct("d1", "d2")).alias("p"), F.max(F.struct("d1", "d2")).alias("q")).where("p <> q").select("vec_id"))
    repeated = not split.isEmpty()
    if repeated:
        # an id with several vectors cannot name a class: a hash of the vector does
        named = classes.join(split.select(F.col("vec_id").alias("node"), F.lit(True).alias("split")), "node", "left")
        classes = named.withColumn("node", F.when(F.col("split"), F.xxhash64("d1", "d2")).otherwise(F.col("node"))).drop("split")
    classes = scratch.keep(classes.select("d1", "d2", "node", "copies"))
    bits, tables = table_plan(classes.count(), threshold)
    if repeated:
        vectors_of = read.join(classes.join(usable, ["d1", "d2"]).select("vec_id").distinct(), "vec_id", "left_semi")
        digested = vectors_of.mapInArrow(_check_with_vector, "vec_id long, d1 long, d2 long, embedding array<double>")
        stood = digested.join(classes, ["d1", "d2"]).select("node", "copies", "embedding").dropDuplicates(["node"])
    else:
        # the vector of each class comes from the row of its smallest id
        stood = read.join(classes, read["vec_id"] == classes["node"]).select("node", "copies", "embedding").dropDuplicates(["node"])
    coded = scratch.keep(stood.mapInArrow(_coded(bits, tables), "node long, copies long, embedding array<double>, keys array<long>, bits binary, factor double"))
    placed = coded.select("node", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = placed.join(shared, "key")
    chunks = F.ceil(F.col("m") / TILE).cast("int")
    members = members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select("key", "node", "chunk", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"))
    tiles = members.join(coded.select("node", "copies", "embedding", "bits", "factor"), "node")
    tiles = tiles.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "node")
    found = scratch.keep(tiles.mapInArrow(_link_tiles(bits, tables, threshold), "node long, n long, root long"))
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if repeated:
        joined = usable.join(split, "vec_id", "left_semi").join(classes, ["d1", "d2"]).select("vec_id", "node").distinct()
        least = joined.groupBy("vec_id").agg(F.min("node").alias("a"))
        links = links.union(joined.join(least, "vec_id").select("a", F.col("node").alias("b")).where("a <> b"))
    roots = components(links, scratch)
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    by_class = classes.join(linked, "node", "left").join(roots, "node", "left").select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    rows = checked.join(by_class, ["d1", "d2"], "left")
    if repeated:
        # hashes may be roots: the smallest id of each component takes their place
        rows = rows.join(rows.where("vec_id is not null").groupBy("root").agg(F.min("vec_id").alias("least")), "root", "left").withColumn("root", F.col("least"))
    return rows.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
