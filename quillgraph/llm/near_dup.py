"""MinHash near-duplicate detection of documents.

Signatures come from one-permutation hashing: the 64-bit hash range is cut into BANDS * ROWS bins and each
bin keeps its least hash; an empty bin copies the bin that a fixed probe sequence reaches first (optimal
densification). Bands of ROWS bins make buckets. In a bucket every member is paired with the smallest id
only (a star), so a bucket of m documents costs m - 1 pairs. Each pair is confirmed on the full shingle
sets. Where a star leaves a bucket's members in several components, further stars settle it: around its least
edited member (buckets with such members in one component are settled as one group), then in the smaller groups of
members that share a shingle which this hub has not (see ``_around_hubs``), until every group is in one component or small enough for a tile of TILE members that
one task compares. A group that a round leaves with more than half of the members it came from is not dealt further: those of its
members that are outside its largest component are compared with all others in blocks (see ``_across``). So the rounds grow with the logarithm of the
largest group. No link inside a bucket is lost, and no round makes more than HUBS pairs a member.

Documents with equal sets are one class from the start (grouped by a 128-bit digest of the set), so copies
never meet in a bucket, whatever their number.

Defined cases: null or blank text has no shingles and links with nothing; fewer than five words make one
shingle; rows that share a doc_id are one document whose links are joined, also where their texts differ; a null
doc_id links with nothing and is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import shared
from quillgraph.llm.shared import Scratch, as_long, components, scramble

WORDS = 5
PERCENT = 75
#: 32 bands of 4 bins: a pair at similarity 0.75 is missed with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
#: Groups of at most so many members, and shingles in all, are settled in one task.
TILE, TILE_SHINGLES = 256, 1 << 20
#: Members of a larger group whose sets together stand for what its members have in common.
HUBS = 4
#: Shingles that are columns of one dense product of a block.
STRIP = 4096
#: Bits that tell which ids may be asked for: 1024 bitmaps of 4 kB, whatever the number of ids.
ID_BITS = 1 << 25
#: Joins of two shuffled sides stay as they are: a small side would be sent through the driver, and a hot key of the other would not be split.
NO_LATE_BROADCASTS = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

_MIX = np.random.default_rng(71).integers(1, 2**63, WORDS + ROWS + BANDS + 8, dtype=np.uint64) | np.uint64(1)
_SHORT_SALT = np.arange(WORDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, offsets into them)."""
    words, first = shared.word_hashes(data, offsets)
    n, rows = len(words), len(offsets) - 1
    rolled = np.zeros(n, np.uint64)
    whole = max(n - WORDS + 1, 0)
    for k in range(WORDS):
        rolled[:whole] += words[k : k + whole] * _MIX[k]
    rolled = scramble(rolled)
    parts, sizes = [], np.zeros(rows + 1, np.int64)
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= WORDS:
            got = np.sort(rolled[a : b - WORDS + 1])
            got = got[np.concatenate(([True], got[1:] != got[:-1]))]
        elif b > a:
            got = scramble((words[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT_SALT[b - a])
        else:
            continue
        parts.append(got)
        sizes[i + 1] = len(got)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


_BINS = BANDS * ROWS
_BIN_SHIFT = np.uint64(64 - (_BINS - 1).bit_length())
_BIN_LOW = np.arange(_BINS, dtype=np.uint64) << _BIN_SHIFT
_PROBES = np.random.default_rng(72).integers(0, _BINS, (4096, _BINS))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band keys, one row a text; rows of empty sets mean nothing."""
    rows = len(offsets) - 1
    values, filled = np.zeros((rows, _BINS), np.uint64), np.zeros((rows, _BINS), bool)
    for i in range(rows):
        own = sets[offsets[i] : offsets[i + 1]]
        if len(own):
            at = np.searchsorted(own, _BIN_LOW)
            got = own[np.minimum(at, len(own) - 1)]
            filled[i] = (at < len(own)) & (got >> _BIN_SHIFT == np.arange(_BINS, dtype=np.uint64))
            values[i] = got
    row, column = np.nonzero(~filled & filled.any(1)[:, None])
    for probe in _PROBES:
        if not len(row):
            break
        source = probe[column]
        hit = filled[row, source]
        values[row[hit], column[hit]] = values[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    keys = np.zeros((rows, BANDS), np.uint64)
    for r in range(ROWS):
        keys += scramble(values[:, r::ROWS][:, :BANDS]) * _MIX[WORDS + r]
    return scramble(keys + _MIX[WORDS + ROWS : WORDS + ROWS + BANDS])


def _digests(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two order-free 64-bit sums over each set."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k, salt in enumerate((np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(sets ^ salt), dtype=np.uint64)))
        out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = shared.text_bytes(batch.column(1))
        for a, b in shared.row_groups(offsets):
            part = offsets[a : b + 1]
            sets, at = shingle_sets(data[part[0] : part[-1]], part - part[0])
            size = np.diff(at)
            keys, digest = as_long(signatures(sets, at)[size > 0].ravel()), as_long(_digests(sets, at).T.copy().ravel())
            ends = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size), pa.array(digest[: b - a]), pa.array(digest[b - a :]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = shared.text_bytes(batch.column(1))
        for a, b in shared.row_groups(offsets):
            part = offsets[a : b + 1]
            sets, at = shingle_sets(data[part[0] : part[-1]], part - part[0])
            digest = as_long(_digests(sets, at).T.copy().ravel())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(as_long(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digest[: b - a]), pa.array(digest[b - a :]), lists], names=["node", "d1", "d2", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach PERCENT; the sets of a pair meet in one row, never a group."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    least, most = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(least * 100 >= most * PERCENT).select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("s")).where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * PERCENT).select("a", "b").distinct()


def _bitmaps(ids: DataFrame) -> DataFrame:
    """(part, bits): bitmaps of the hashes of ``ids`` (one column), ID_BITS in all."""
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(ID_BITS))
    marks = ids.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).repartition("part")
    return marks.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _byte_at(bits: Column, slot: Column) -> Column:
    """The byte of a bitmap that holds the bit of a slot."""
    return F.conv(F.hex(F.substring(bits, (F.bitmap_bit_position(slot) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")


def _bit_at(slot: Column) -> Column:
    return (F.bitmap_bit_position(slot) % 8).cast("int")


def _maybe_in(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``name`` is not among ``ids`` (one column): bitmaps of hashed ids are all that is broadcast.

    No asked row goes. Of the others a share of |ids| / ID_BITS stays, so beyond some ten million ids this saves nothing.
    """
    maps = _bitmaps(ids)
    own = F.pmod(F.xxhash64(name), F.lit(ID_BITS))
    held = F.expr("shiftright(b, o) & 1") == 1
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(own) == maps["part"])
    return met.select(*rows.columns, _byte_at(F.col("bits"), own).alias("b"), _bit_at(own).alias("o")).where(held).select(*rows.columns)


def _rows_of(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``name`` is among the distinct ``ids``; an inner join, as a semi-join would be moved below the bitmaps."""
    some = _maybe_in(rows, name, ids)
    return some.join(ids.hint("shuffle_hash"), some[name] == ids[ids.columns[0]]).select(*[some[c] for c in rows.columns])


def _sets_of(docs: DataFrame, signed: DataFrame, classes: DataFrame, nodes: DataFrame, same_id: DataFrame | None, repeated: bool) -> DataFrame:
    """node, shingles of each of ``nodes``, once."""
    schema = "node long, d1 long, d2 long, shingles array<long>"
    if same_id is None:
        made = _rows_of(docs, "doc_id", nodes).mapInArrow(_sets, schema)
    else:
        asked = classes.join(nodes, "node", "left_semi").select("d1", "d2", "node")
        ids = signed.join(asked, ["d1", "d2"], "left_semi").select("doc_id").distinct()
        made = _rows_of(docs, "doc_id", ids).mapInArrow(_sets, schema).drop("node").join(asked, ["d1", "d2"])
    made = made.select("node", "shingles")
    return made.dropDuplicates(["node"]) if repeated else made


def _sizes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n, u: the size of its set and how many of its shingles no other of these nodes has."""
    own = sets.join(nodes, "node", "left_semi")
    alone = own.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    counts = alone.groupBy("node").agg(F.count("*").alias("u"))
    return own.select("node", F.size("shingles").cast("long").alias("n")).join(counts, "node", "left").select("node", "n", F.coalesce("u", F.lit(0).cast("long")).alias("u"))


def _open(members: DataFrame) -> DataFrame:
    """The members (key, node, home, part, n, u) of groups that still hold several components, with ``tile``.

    A member whose private shingles leave too few to share, even with the smallest set of its group, has no
    partner there and goes. Of groups with the same members one stays. ``tile`` marks groups that fit a tile, ``stalled``
    others with more than half of the ``was`` members of the group that they come from (null: none); ``m`` counts their members.
    """
    least = members.groupBy("key").agg(F.min("n").alias("least"))
    able = members.join(least, "key").where((F.col("n") - F.col("u")) * (100 + PERCENT) >= (F.col("n") + F.col("least")) * PERCENT).drop("least")
    digests = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    facts = able.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), *digests, F.count("*").alias("m"), F.sum("n").alias("total")).where("p < q")
    first = facts.groupBy("h1", "h2", "m").agg(F.min("key").alias("key"), F.max("total").alias("total"))
    sized = able.join(first.select("key", "m", ((F.col("m") <= TILE) & (F.col("total") <= TILE_SHINGLES)).alias("tile")), "key")
    return sized.withColumn("stalled", ~F.col("tile") & F.coalesce(F.col("m") * 2 > F.col("was"), F.lit(False)))


def _tile_links(table: pa.Table) -> pa.Table:
    """Links across the components of one group of at most TILE members, as pairs of their homes."""
    homes, parts = table.column("home").to_pylist(), table.column("part").to_pylist()
    lists = table.column("shingles").combine_chunks()
    sets = [lists[i].values.to_numpy() for i in range(len(lists))]
    root = {p: p for p in parts}
    found: list[tuple[int, int]] = []
    for i, own in enumerate(sets):
        for j in range(i):
            size = len(own) + len(sets[j])
            if root[parts[i]] == root[parts[j]] or min(len(own), len(sets[j])) * (100 + PERCENT) < size * PERCENT:
                continue
            if len(np.intersect1d(own, sets[j], assume_unique=True)) * (100 + PERCENT) >= size * PERCENT:
                found.append((homes[i], homes[j]))
                gone, stays = root[parts[i]], root[parts[j]]
                root = {p: stays if r == gone else r for p, r in root.items()}
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` (rows) and each of ``right`` (columns) have in common, by dense products of STRIP shingles."""
    both, n = left + right, len(left)
    of = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    here, there = (np.bincount(column[side], minlength=len(values)) > 0 for side in (of < n, of >= n))
    shared_by = here & there
    used = shared_by[column]
    of, column = of[used], (np.cumsum(shared_by) - 1)[column[used]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((n, len(right)), np.int64)
    for low in range(0, int(shared_by.sum()), STRIP):
        a, b = np.searchsorted(column, (low, low + STRIP))
        dense = np.zeros((len(both), STRIP), np.float32)
        dense[of[a:b], column[a:b] - low] = 1
        out += (dense[:n] @ dense[n:].T).astype(np.int64)
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the sets of either side of a block (of one side among themselves), as a pair of homes for each pair of components."""
    side = table.column("side").to_numpy()
    homes, parts = table.column("home").to_numpy(), table.column("part").to_numpy()
    lists = table.column("shingles").combine_chunks()
    sets = [lists[i].values.to_numpy() for i in range(len(lists))]
    rows, columns = np.flatnonzero(side), np.flatnonzero(~side)
    columns = columns if len(columns) else rows
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if len(rows):
        size = np.array([len(x) for x in sets])
        both = size[rows][:, None] + size[columns]
        near = _common([sets[i] for i in rows], [sets[i] for i in columns]) * (100 + PERCENT) >= both * PERCENT
        for i, j in zip(*np.nonzero(near & (parts[rows][:, None] != parts[columns])), strict=True):
            a, b = rows[i], columns[j]
            found.setdefault((parts[a], parts[b]), (homes[a], homes[b]))
    return pa.table({"a": pa.array([x for x, _ in found.values()], pa.int64()), "b": pa.array([y for _, y in found.values()], pa.int64())})


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): homes of linked members of different components, from groups of any size.

    A pair inside the largest component of its group joins nothing, so each pair that is compared has a member
    outside it. Both kinds of members are dealt into blocks of about TILE members and TILE_SHINGLES shingles, and each
    block of the others meets every block of the group, in one task of its own: of l such members among m, each set
    is sent at most m / TILE times and most of them l / TILE times.
    """
    parts = members.groupBy("key", "part").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "part")).alias("x")).select("key", F.col("x.part").alias("main"))
    rows = members.select("key", "node", "home", "part", "n").join(main, "key").withColumn("lone", F.col("part") != F.col("main"))

    def blocks(kind: Column) -> Column:
        count, total = F.count(F.when(kind, 1)), F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
        return F.greatest(F.ceil(count / TILE), F.ceil(total / TILE_SHINGLES))

    dealt = rows.join(rows.groupBy("key").agg(blocks(F.col("lone")).alias("ones"), blocks(~F.col("lone")).alias("others")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("lone"), F.col("ones")).otherwise(F.col("others"))))
    # (i, j): block i of lone members meets block j of the main component, or, numbered after those, block j of lone ones, j <= i
    meets = F.expr(
        "if(lone, concat(transform(sequence(0L, others + own), x -> struct(own as i, x as j, true as side)),"
        " filter(transform(sequence(own, ones - 1), x -> struct(x as i, others + own as j, false as side)), x -> x.i > own)),"
        " transform(sequence(0L, ones - 1), x -> struct(x as i, own as j, false as side)))"
    )
    met = dealt.select("key", "node", "home", "part", meets.alias("meets")).join(sets, "node").select("key", F.explode("meets").alias("x"), "home", "part", "shingles")
    return met.select("key", "x.*", "home", "part", "shingles").groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long").distinct()


def _merged(rows: DataFrame, found: list[DataFrame], scratch: Scratch, names: tuple[str, ...]) -> DataFrame:
    """``rows`` with a ``part`` from each home column, after the links between homes found so far."""
    if not found or all(f.isEmpty() for f in found):
        return rows
    merges = components(reduce(DataFrame.union, found), scratch)
    for name in names:
        home, part = f"{name}home", f"{name}part"
        rows = rows.drop(part).join(merges.select(F.col("node").alias(home), F.col("root").alias(part)), home, "left").withColumn(part, F.coalesce(part, home))
    return rows


def _around_hubs(members: DataFrame, sets: DataFrame, found: list[DataFrame], scratch: Scratch) -> DataFrame:
    """One round of stars around the least edited member of each group: adds its links to ``found``, returns smaller groups.

    Let B be the union of the sets of HUBS little edited members, which all others are paired with, and x a member
    outside the component of the first of them. x must share 0.75 / 1.75 * (|x| + |y|) shingles with a partner y. If they share none outside B, all are in
    x & B and in y & B, so |y| <= reach(x) = |x & B| * 1.75 / 0.75 - |x| and |x| <= reach(y), and one of the two
    reaches its own size: such x, and the members small and near enough for one of them, form one new group, if any
    in it has that reach; these come first when its hubs are chosen. All other pairs meet
    in the groups of one shingle outside B, of which a member enters all but its q - 1 commonest ones, where
    q = ceil(0.75 / 1.75 * (|x| + least)) - |x & B| counts what it must share there and least is the smallest
    size in the group. Only shingles that an x asks for make a group, and none holds one of the HUBS members; a
    round costs HUBS pairs a member, whatever the size of the group. ``was`` is the size of the group that was dealt.
    """
    facts = F.struct("turn", "u", "node", "n", "home", "part")
    picked = scratch.keep(members.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("h")).agg(F.min(facts).alias("c"), F.min("n").alias("least")))
    hubs = picked.groupBy("key").agg(F.min("c").alias("c"), F.min("least").alias("least")).select("key", F.col("c.node").alias("a"), F.col("c.home").alias("chome"), F.col("c.part").alias("cpart"), "least")
    chosen = picked.select("key", F.col("c.node").alias("a"), F.col("c.home").alias("ahome"), F.col("c.part").alias("apart"))
    base = chosen.withColumnRenamed("a", "node").join(sets, "node").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("base"))
    rows = scratch.keep(members.drop("tile", "stalled", "was").join(hubs.drop("a"), "key").join(chosen.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti"))
    star = members.join(chosen, "key").where(F.col("part") != F.col("apart")).select("a", F.col("node").alias("b"), "home", "ahome").distinct()
    links = _confirm(star.select("a", "b").distinct(), sets).join(star, ["a", "b"])
    found.append(scratch.keep(links.select(F.col("home").alias("a"), F.col("ahome").alias("b")).distinct()))
    rows = _merged(rows, found, scratch, ("", "c")).withColumn("lone", F.col("part") != F.col("cpart"))
    rows = rows.join(rows.where("lone").select("key").distinct(), "key", "left_semi").join(sets, "node").join(base, "key")
    rows = rows.withColumn("extra", F.array_except("shingles", "base")).withColumn("i", F.col("n") - F.size("extra")).drop("shingles", "base")
    rows = rows.withColumn("q", F.expr(f"((n + least) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT} - i")).withColumn("reach", F.expr(f"(i * {100 + PERCENT}) div {PERCENT} - n"))
    rows = scratch.keep(rows)
    own = ["node", "home", "part", "n", "u", "m"]
    outside = rows.select("key", *own, "lone", F.greatest("q", F.lit(1)).alias("q"), F.explode("extra").alias("s"))
    common = outside.groupBy("key", "s").agg(F.count("*").alias("f")).where("f > 1")
    listed = outside.join(common, ["key", "s"]).groupBy("key", *own, "lone", "q").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("list"))
    fit = F.greatest(F.size("list") - F.col("q") + 1, F.lit(0)).cast("int")
    taken = listed.select("key", *own, "lone", F.explode(F.slice("list", F.lit(1), fit)).alias("x")).select("key", *own, "lone", "x.s")
    asked = taken.where("lone").select("key", "s").distinct()
    sharing = taken.join(asked, ["key", "s"], "left_semi").select(F.xxhash64("key", "s").alias("key"), *own, F.lit(0).alias("turn"))
    high = F.col("reach") >= F.col("n")
    central = F.col("lone") & (F.col("reach") >= F.col("least"))
    bounds = rows.where(central).groupBy("key").agg(F.max("reach").alias("most"), F.min("n").alias("low"))
    inside = rows.join(bounds, "key").where(central | ((F.col("n") <= F.col("most")) & (F.col("reach") >= F.col("low")))).withColumn("turn", F.when(high, 0).otherwise(1))
    inside = inside.join(inside.where("turn = 0").select("key").distinct(), "key", "left_semi")
    return sharing.union(inside.select(F.xxhash64("key", F.lit("inside")).alias("key"), *own, "turn")).withColumnRenamed("m", "was")


def _settle(stars: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root) of components that join when the buckets that stars leave in several of them are settled."""
    many = stars.where("m > 2")
    members = many.select("key", F.col("b").alias("node")).union(many.select("key", F.col("a").alias("node")).distinct())
    members = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("home"))
    split = members.groupBy("key").agg(F.min("home").alias("p"), F.max("home").alias("q")).where("p < q").select("key")
    left = scratch.keep(members.join(split, "key", "left_semi"))
    if left.isEmpty():
        return None
    facts = scratch.keep(_sizes(left.select("node").distinct(), sets))
    new = F.lit(None).cast("long").alias("was")
    buckets = scratch.keep(_open(left.join(facts, "node").select("*", F.col("home").alias("part"), new)).select("key", "node", "home", "part", "n", "u"))
    # a component's members meet in many buckets: those whose least edited member is of one component become one group
    middle = buckets.groupBy("key").agg(F.min(F.struct("u", "node", "part")).alias("c")).select("key", F.col("c.part").alias("whole"))
    members = buckets.join(middle, "key").select(F.col("whole").alias("key"), "node", "home", "part", "n", "u", F.lit(0).alias("turn"), new).distinct()
    members = scratch.keep(_open(members))
    # few sets are read over and over: the rounds must not deal the others each time
    sets = scratch.keep(_rows_of(sets, "node", members.select("node").distinct()))
    found: list[DataFrame] = []
    while True:
        kinds = {(r.tile, r.stalled) for r in members.select("tile", "stalled").distinct().collect()}
        if (True, False) in kinds:
            tiles = members.where("tile").join(sets, "node").select("key", "home", "part", "shingles")
            found.append(scratch.keep(tiles.groupBy("key").applyInArrow(_tile_links, "a long, b long")))
        if (False, True) in kinds:
            found.append(scratch.keep(_across(members.where("stalled"), sets)))
        if (False, False) not in kinds:
            break
        after = scratch.keep(_open(_around_hubs(members.where("not tile and not stalled"), sets, found, scratch)))
        scratch.drop(members)
        members = after
    if not found or all(f.isEmpty() for f in found):
        return None
    return components(reduce(DataFrame.union, found), scratch)


def _classes(usable: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, bool]:
    """(d1, d2, node, bands of each distinct set; links that join the sets of one id, or None; whether any id is repeated).

    A set's node is its smallest doc_id; where an id has several sets, a hash of the set stands for it instead.
    """
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    digest = F.struct("d1", "d2")
    again = scratch.keep(usable.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(digest).alias("p"), F.max(digest).alias("q")).where("c > 1").select("doc_id", F.expr("p <> q").alias("differ")))
    kinds = {r.differ for r in again.select("differ").distinct().collect()}
    if True not in kinds:
        return scratch.keep(classes), None, bool(kinds)
    split = again.where("differ").select("doc_id")
    named = classes.join(split.select(F.col("doc_id").alias("node"), F.lit(True).alias("split")), "node", "left")
    classes = scratch.keep(named.withColumn("node", F.when(F.col("split"), F.xxhash64("d1", "d2")).otherwise(F.col("node"))).select("d1", "d2", "node", "bands"))
    joined = usable.join(split, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select("doc_id", "node").distinct()
    least = joined.groupBy("doc_id").agg(F.min("node").alias("a"))
    return classes, joined.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct(), True


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup", NO_LATE_BROADCASTS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(docs.mapInArrow(_sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes, same_id, repeated = _classes(usable, scratch)
    rows = classes.select("node", F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    stars = scratch.keep(rows.join(centres, "key").where("node <> a").select("key", "a", F.col("node").alias("b"), "m"))
    pairs = stars.select("a", "b").distinct()
    nodes = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.keep(_sets_of(docs, signed, classes, nodes, same_id, repeated))
    links = _confirm(pairs, sets)
    roots = components(links if same_id is None else links.union(same_id), scratch)
    merges = _settle(stars, roots, sets, scratch)
    by_class = classes.join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("component_id"))
    if merges is not None:
        by_class = by_class.join(merges.select(F.col("node").alias("component_id"), "root"), "component_id", "left").select("d1", "d2", F.coalesce("root", "component_id").alias("component_id"))
    by_class = scratch.keep(by_class)
    found = signed.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    if same_id is not None:
        # hashes may be roots: the smallest id of each component takes their place
        smallest = found.where("n_shingles > 0").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        found = found.join(smallest, "component_id", "left").withColumn("component_id", F.col("least"))
    scratch.keep_only(signed, by_class)
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose document stands for its group; rows that share its id stay together.

    Rows whose id the bitmaps of the ids that go do not hold stay where they are; only the others are shuffled and compared with those ids.
    """
    part, bits, name = (shared.fresh_name(docs.columns, x) for x in ("part", "bits", "gone"))
    gone = Scratch(docs.sparkSession, "near-dup-gone").keep(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    own = F.pmod(F.xxhash64(docs["doc_id"].cast("long")), F.lit(ID_BITS))
    maps = _bitmaps(gone).toDF(part, bits)
    marked = docs.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col(part), "left")
    held = F.coalesce(F.getbit(_byte_at(F.col(bits), own), _bit_at(own)) == 1, F.lit(False))
    stay, asked = marked.where(~held).drop(part, bits), marked.where(held).drop(part, bits)
    return stay.union(asked.join(gone, asked["doc_id"].cast("long") == gone[name], "left_anti"))
