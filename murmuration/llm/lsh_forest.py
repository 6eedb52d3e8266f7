"""MinHash near-duplicate detection with an LSH forest (Bawa et al., 2005).

Each tree is one sorted order of the documents by the tree's own sequence of
minimum hashes. Neighbours with a long common prefix are candidates: a region
that shares a prefix of ``min_depth`` is compared as a whole when it is small,
and taken at a deeper prefix where it is dense, region by region. Candidates
are then confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, texts_of
from .graph import components
from .shingles import mixed, shingle_sets


@dataclass(frozen=True)
class Forest:
    """Production parameters.

    A pair of similarity 0.8 shares a prefix of 3 in at least one of 12 trees
    with probability 0.9998. ``region`` is how many neighbours are compared
    with each other before a deeper prefix is asked for. ``floor`` and
    ``fine_floor`` are the shares of equal minimum hashes from which a pair is
    worth a closer look, by the first ``sketch`` of them in the sorted orders
    and by all before an exact comparison; both are four standard deviations
    under the threshold.
    """

    trees: int = 12
    depth: int = 8
    min_depth: int = 3
    sketch: int = 64
    region: int = 512
    floor: float = 0.6
    fine_floor: float = 0.64
    order_rows: int = 50_000
    verify_group: int = 400
    seed: int = 11


def signature(values: np.ndarray, forest: Forest, chunk: int = 512) -> np.ndarray:
    """Minimum of each hash function over the set."""
    m = forest.trees * forest.depth
    a = mixed(np.arange(m), forest.seed) | np.uint64(1)
    b = mixed(np.arange(m), forest.seed + 1)
    low = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(values), chunk):
        np.minimum(low, (values[i : i + chunk, None] * a + b).min(axis=0), out=low)
    return low


def _fingerprints(docs: DataFrame, width: int, forest: Forest) -> DataFrame:
    """``doc_id, mark, n_shingles, sid, check, orders, sketch`` of every row; sid null where a set is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            rows = batch.num_rows
            n, sid, check = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            orders: list[bytes | None] = [None] * rows
            sketch: list[bytes | None] = [None] * rows
            for i, values in shingle_sets(data, offsets, width):
                if n_values := len(values):
                    n[i] = n_values
                    # two sums that equal sets share; the second proves the first unique
                    sums = np.array([mixed(values, 3).sum(), mixed(values, 4).sum()], np.uint64) + np.uint64(n_values)
                    sid[i], check[i] = mixed(sums, 5).view(np.int64)
                    low = mixed(signature(values, forest), 6)
                    orders[i] = (low >> np.uint64(48)).astype(">u2").tobytes()
                    sketch[i] = low[: forest.sketch].astype(np.uint8).tobytes()
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(sid, mask=empty), pa.array(check, mask=empty), pa.array(orders, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "mark", "n_shingles", "sid", "check", "orders", "sketch"],
            )

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, sid long, check long, orders binary, sketch binary")


def regions(keys: np.ndarray, min_depth: int, region: int) -> Iterator[tuple[int, int]]:
    """Row ranges of sorted ``keys`` (rows x depth) to compare as a whole.

    A run that shares ``min_depth`` values is taken whole up to ``region``
    rows, else at the next depth; runs that share all values and are still
    larger are cut into neighbouring stretches.
    """
    if len(keys) < 2:
        return
    same = keys[1:] == keys[:-1]
    common = np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1))
    work = [(0, len(keys), min_depth)]
    while work:
        a, b, depth = work.pop()
        breaks = np.flatnonzero(common[a : b - 1] < depth) + a + 1
        edges = np.concatenate([[a], breaks, [b]])
        sizes = np.diff(edges)
        for k in np.flatnonzero(sizes > 1):
            first, last = int(edges[k]), int(edges[k + 1])
            if last - first <= region:
                yield first, last
            elif depth < keys.shape[1]:
                work.append((first, last, depth + 1))
            else:
                for i in range(first, last - 1, region):
                    yield i, min(i + region, last)


def _equal_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal sketch bytes for all rows of a against all rows of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out / a.shape[1]


def _cells(share: np.ndarray, floor: float) -> np.ndarray:
    """Groups of a region's rows that chains of similar sketches connect."""
    near = share >= floor
    n = len(near)
    group = np.full(n, -1)
    for i in range(n):
        if group[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            found = front.copy()
            while front.any():
                front = near[front].any(axis=0) & ~found
                found |= front
            group[found] = i
    return group


NAMES = ["cell", "sid", "leader", "leader_share", "partner", "partner_share", "seam"]


def _candidate_cells(entries: DataFrame, forest: Forest) -> DataFrame:
    """Rows of sorted orders that may be near, cell by cell: ``cell, sid`` and two neighbours with their shares.

    ``leader`` is the cell's row that is most like all others, ``partner`` the
    one most like this row. Rows with ``seam`` instead name the regions at a
    partition's two ends, which the next partition may share.
    """
    nothing = [pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.float64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.float64())]

    def region_at(table, row):
        key = np.frombuffer(table.column("key")[row].as_py(), ">u2")[: forest.min_depth]
        return int(table.column("tree")[row].as_py()) << 48 | int("".join(f"{int(v):04x}" for v in key), 16)

    def run(batches):
        # a region's rows stand together; what follows the last break waits for the next batch
        held = None
        number = 0
        part = TaskContext.get().partitionId()

        def found(table):
            nonlocal number
            rows = table.num_rows
            tree = table.column("tree").to_numpy().astype(np.uint16)
            keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u2").reshape(rows, forest.depth)
            keys = np.concatenate([tree[:, None], keys], axis=1)
            sid = table.column("sid").to_numpy()
            raw = table.column("sketch").to_pylist()
            sketches = np.frombuffer(b"".join(raw), np.uint8).reshape(rows, forest.sketch)
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in regions(keys, forest.min_depth + 1, forest.region):
                if b - a == 2 and np.count_nonzero(sketches[a] == sketches[a + 1]) < forest.floor * forest.sketch:
                    continue
                share = _equal_share(sketches[a:b], sketches[a:b])
                group = _cells(share, forest.floor)
                values, counts = np.unique(group, return_counts=True)
                for g in values[counts > 1]:
                    mine = np.flatnonzero(group == g)
                    own = share[np.ix_(mine, mine)]
                    leader = int(own.sum(axis=0).argmax())
                    np.fill_diagonal(own, -1)
                    partner = own.argmax(axis=1)
                    names = sid[a + mine]
                    out.append((np.full(len(mine), number), names, np.full(len(mine), names[leader]), own[:, leader], names[partner], own.max(axis=1)))
                    number += 1
            if not out:
                return None
            cell, *columns = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array((part << 40) | cell), *map(pa.array, columns)], names=NAMES[:-1]).append_column("seam", pa.nulls(len(cell), pa.int64()))

        ends = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows:
                ends = [*ends[:1], region_at(table, table.num_rows - 1)] if ends else [region_at(table, 0), region_at(table, table.num_rows - 1)]
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            tree = held.column("tree").to_numpy()
            keys = np.frombuffer(b"".join(held.column("key").to_pylist()), ">u2").reshape(held.num_rows, forest.depth)[:, : forest.min_depth]
            differs = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (tree[1:] != tree[:-1])) + 1
            # a dense region may fill the buffer: it is cut where it stands, other trees cover the seam
            last = int(differs[-1]) if differs.size else (held.num_rows if held.num_rows > 200_000 else 0)
            if last:
                if (out := found(held.slice(0, last).combine_chunks())) is not None:
                    yield out
                held = held.slice(last)
        if held is not None and held.num_rows and (out := found(held.combine_chunks())) is not None:
            yield out
        if ends:
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(ends)], names=NAMES)

    return entries.mapInArrow(run, "cell long, sid long, leader long, leader_share double, partner long, partner_share double, seam long")


def _is_link(own: np.ndarray, others: list[np.ndarray], per_mille: int) -> np.ndarray:
    """Which of the other whole sets reach the threshold with this one; all sets ascend."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 1000 * both >= per_mille * (len(own) + sizes - both)


class _Rows:
    """A task's rows of one group: ids, components, whole sets and minimum hashes."""

    def __init__(self, table: pa.Table, forest: Forest):
        self.forest = forest
        self.sid, self.root = (table.column(c).to_numpy() for c in ("sid", "root"))
        shingles = table.column("shingles").combine_chunks()
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles]
        self.size = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        raw = b"".join(table.column("orders").to_pylist())
        self.orders = np.frombuffer(raw, ">u2").reshape(len(self.sid), forest.trees * forest.depth).astype(np.uint16)

    def may_link(self, i: int, others: _Rows, threshold: float) -> np.ndarray:
        """Rows of ``others`` in other components that size and minimum hashes leave open."""
        n = self.size[i]
        may = (others.root != self.root[i]) & (np.minimum(n, others.size) >= threshold * np.maximum(n, others.size))
        at = np.flatnonzero(may)
        share = np.count_nonzero(others.orders[at] == self.orders[i], axis=1)
        return at[share >= self.forest.fine_floor * self.orders.shape[1]]

    def links(self, i: int, others: _Rows, at: np.ndarray, per_mille: int) -> Iterator[tuple[int, int, int]]:
        """One confirmed (this id, other id, other component) for each component among ``others`` at ``at``."""
        if len(at):
            good = at[_is_link(self.sets[i], [others.sets[j] for j in at], per_mille)]
            for j in good[np.unique(others.root[good], return_index=True)[1]]:
                yield int(self.sid[i]), int(others.sid[j]), int(others.root[j])


def _pairs_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _between_components(cells: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, forest: Forest) -> DataFrame:
    """Confirmed links ``a, b`` between components that meet in a cell.

    Only cells that still hold several components are read, with a whole set
    for each row; a cell is bounded by ``region``, and gives one link for a row
    and component at most.
    """
    rooted = cells.select("cell", "sid").join(roots, cells.sid == roots.node, "left").select("cell", "sid", F.coalesce("root", "sid").alias("root"))
    spans = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
    rows = rooted.join(spans, "cell").join(sets, "sid").select("cell", "sid", "root", "shingles", "orders")
    dealt = rows.repartition(shuffle_partitions(cells.sparkSession), "cell").sortWithinPartitions("cell")
    per_mille = round(threshold * 1000)

    def run(batches):
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            cell = held.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            whole = len(edges) - 1 if batch is None else len(edges) - 2
            for k in range(whole):
                mine = _Rows(held.slice(int(edges[k]), int(edges[k + 1] - edges[k])), forest)
                found = []
                for i in range(len(mine.sid)):
                    at = mine.may_link(i, mine, threshold)
                    for a, b, other in mine.links(i, mine, at[at > i], per_mille):
                        found.append((a, b, other))
                        mine.root = np.where(mine.root == other, mine.root[i], mine.root)
                if found:
                    yield _pairs_batch(found)
            held = held.slice(int(edges[whole]))

    return dealt.mapInArrow(run, "a long, b long")


def _dense(nodes: DataFrame, seams: DataFrame, forest: Forest) -> DataFrame:
    """``region, tree, sid, size, trees`` for the rows of regions that no one cell held: too large, or at a partition's end.

    ``trees`` marks all of a row's such regions. A region is named by its tree
    and prefix. ``seams`` has two rows a partition.
    """
    step = 2 * forest.depth
    prefix = F.array(*[F.substring("orders", 1 + t * step, 2 * forest.min_depth) for t in range(forest.trees)])
    name = F.shiftleft(F.col("tree").cast("long"), 48).bitwiseOR(F.conv(F.hex("prefix"), 16, 10).cast("long"))
    each = nodes.select("sid", F.posexplode(prefix).alias("tree", "prefix")).select("sid", "tree", name.alias("region"))
    split = F.broadcast(seams.select(F.col("seam").alias("region"), F.lit(True).alias("split")).distinct())
    counted = each.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    sizes = counted.join(split, "region", "left").where((F.col("size") > forest.region) | F.col("split")).select("region", "size")
    rows = cut(each.join(sizes, "region"))
    marks = rows.groupBy("sid").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("trees"))
    return rows.join(marks, "sid").select("region", "tree", "sid", "size", "trees")


def _across_dense(dense: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, forest: Forest) -> DataFrame:
    """Confirmed links between components that meet in a region that no one cell held.

    The rows outside a region's largest component are held against all its
    rows, which stand in blocks of about ``region``; a task keeps one block and
    reads the others past it. A pair that meets in several dense regions is
    compared in the first.
    """
    rooted = dense.join(roots, dense.sid == roots.node, "left").select("region", "tree", "sid", "size", "trees", F.coalesce("root", "sid").alias("root"))
    largest = rooted.groupBy("region", "root").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    blocks = F.ceil(F.col("size") / forest.region).cast("int")
    mixed_rows = rooted.join(largest, "region")
    kept = ["sid", "root", "tree", "trees"]
    members = mixed_rows.select("region", F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("block"), *kept, F.lit(0).alias("visits"))
    guests = mixed_rows.where("root <> main").select("region", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *kept, F.lit(1).alias("visits"))
    rows = members.unionByName(guests).join(sets, "sid").select("region", "block", "visits", *kept, "shingles", "orders")
    dealt = rows.repartition(shuffle_partitions(sets.sparkSession), "region", "block").sortWithinPartitions("region", "block", "visits")
    per_mille, step, deep = round(threshold * 1000), forest.depth, forest.min_depth

    def run(batches):
        key, held, block_rows = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            region, block, visits, tree, trees = (table.column(c).to_numpy() for c in ("region", "block", "visits", "tree", "trees"))
            edges = np.flatnonzero((np.diff(region) != 0) | (np.diff(block) != 0) | (np.diff(visits) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(region)], strict=True):
                part, here = table.slice(i, j - i), (region[i], block[i])
                if not visits[i]:  # a block may come in two batches
                    block_rows = pa.concat_tables([block_rows, part]) if key == here else part
                    key, held = here, None
                    continue
                if held is None:
                    held, held_trees = _Rows(block_rows, forest), block_rows.column("trees").to_numpy()
                mine, found = _Rows(part, forest), []
                for g in range(j - i):
                    at = mine.may_link(g, held, threshold)
                    for t in range(int(tree[i])):  # met before, in an earlier dense region
                        if trees[i + g] >> t & 1 and len(at):
                            same = (held.orders[at, t * step : t * step + deep] == mine.orders[g, t * step : t * step + deep]).all(axis=1)
                            at = at[~(same & (held_trees[at] >> t & 1 == 1))]
                    found += mine.links(g, held, at, per_mille)
                if found:
                    yield _pairs_batch(found)

    return dealt.mapInArrow(run, "a long, b long")


def _and_end(batches):
    yield from batches
    yield None


def _bits_of(sids: DataFrame, most: int = 25) -> np.ndarray:
    """A bitmap over the low bits of ``sids``, of 2**most bits (4 MB) at most.

    It only saves shuffling sets that no candidate needs: what it lets through
    is joined exactly, so a full bitmap costs time and no result.
    """
    bits = min(most, max(10, (16 * sids.count()).bit_length()))
    low = F.col("sid").bitwiseAND(F.lit((1 << bits) - 1))
    words = sids.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(sid & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _sets_of(docs: DataFrame, sids: DataFrame, width: int) -> DataFrame:
    """``sid, shingles``: the whole shingle sets behind ``sids``, one row each."""
    wanted = _bits_of(sids)
    mask = 64 * len(wanted) - 1

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            seen: dict[int, bytes] = {}
            for _, values in shingle_sets(data, offsets, width):
                if len(values):
                    total = mixed(values, 3).sum() + np.uint64(len(values))
                    sid = int(mixed(np.array([total]), 5).view(np.int64)[0])
                    if sid not in seen and int(wanted[(sid & mask) >> 6]) >> (sid & 63) & 1:
                        seen[sid] = values.tobytes()
                if len(seen) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], names=["sid", "shingles"])
                    seen = {}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], names=["sid", "shingles"])

    found = docs.select("text").mapInArrow(run, "sid long, shingles binary")
    return found.join(sids, "sid", "left_semi").dropDuplicates(["sid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float, group: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold.

    A pair's left set is sent once for each ``group`` of its partners and read
    before them, so a set of very many partners is spread and no task holds
    more than one left set.
    """
    per_mille = round(threshold * 1000)
    counted = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    salted = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / group)).alias("salt"))
    left = salted.select("a", "salt").distinct().select(F.col("a").alias("sid"), "a", "salt", F.lit(None).cast("long").alias("b"))
    sends = left.unionByName(salted.select(F.col("b").alias("sid"), "a", "salt", "b"))
    n = shuffle_partitions(pairs.sparkSession)
    dealt = sends.join(sets, "sid").select("a", "salt", "b", "shingles").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        key = own = None
        for batch in batches:
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            sets_here = batch.column(3)
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                values = np.frombuffer(sets_here[i].as_buffer(), np.uint64)
                if b[i] is None:
                    key, own = (a[i], salt[i]), values.copy()
                elif key == (a[i], salt[i]):
                    small, large = sorted((own, values), key=len)
                    if len(small) * 1000 < per_mille * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    if 1000 * both >= per_mille * (len(small) + len(large) - both):
                        out_a.append(a[i])
                        out_b.append(b[i])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, width: int, threshold: float, forest: Forest) -> DataFrame:
    """``doc_id, mark, n_shingles, sid, root, component_id`` of every row; the last three null for texts without words."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    prints = cut(_fingerprints(docs, width, forest))
    members = prints.select("doc_id", "mark", "n_shingles", "sid")
    nodes = cut(
        prints.where("sid is not null")
        .groupBy("sid")
        .agg(
            F.min("doc_id").alias("low_doc"),
            F.min("check").alias("c0"),
            F.max("check").alias("c1"),
            F.first("orders").alias("orders"),
            F.first("sketch").alias("sketch"),
        )
    )
    if nodes.where("c0 <> c1").limit(1).count():
        raise RuntimeError("two different shingle sets share an id; use another seed")
    width_bytes = 2 * forest.depth
    entries = nodes.select(
        "sid",
        "sketch",
        F.posexplode(F.array(*[F.substring("orders", 1 + t * width_bytes, width_bytes) for t in range(forest.trees)])).alias("tree", "key"),
    ).select(F.col("tree").cast("smallint").alias("tree"), "key", "sid", "sketch")
    parts = max(1, min(n, nodes.count() * forest.trees // forest.order_rows))
    # equal keys go on by the sketch, from a place of the tree's own, so each order has other neighbours
    order = ["tree", "key", F.expr(f"substring(sketch, 1 + tree * {forest.sketch // forest.trees})"), "sid"]
    orders = entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = cut(_candidate_cells(orders, forest))
    cells, seams = found.where("seam is null").drop("seam"), found.where("seam is not null").select("seam")
    # whatever meets a like row in a cell or stands in a dense region may be compared
    dense = cut(_dense(nodes, seams, forest))
    wanted = cut(cells.select("sid").union(dense.select("sid")).distinct())
    sets = cut(_sets_of(docs, wanted, width).join(nodes.select("sid", "orders"), "sid"))
    nearest = cells.groupBy("sid").agg(
        F.expr("max_by(leader, leader_share) filter (where leader <> sid)").alias("leader"),
        F.max_by("partner", "partner_share").alias("partner"),
    )
    ends = nearest.select("sid", F.explode(F.array_distinct(F.array("leader", "partner"))).alias("other")).where("other is not null")
    first = ends.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
    links = cut(_confirmed(first, sets, threshold, forest.verify_group))
    roots = components(links)
    for search, rows in ((_between_components, cells), (_across_dense, dense)):
        more = cut(search(rows, roots, sets, threshold, forest))
        if more.limit(1).count():
            links = cut(links.unionByName(more))
            roots = components(links)
    rooted = nodes.join(roots, nodes.sid == roots.node, "left").select("sid", "low_doc", F.coalesce("root", "sid").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low_doc").alias("component_id"))
    named = rooted.join(names, "root").select("sid", "root", "component_id")
    return members.join(named, "sid", "left").select("doc_id", "mark", "n_shingles", "sid", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, forest: Forest = Forest()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows of equal shingle sets are one node. Nodes go through the forest; in a
    cell of near neighbours each node is first held against the one most like
    all and the one most like itself, on whole sets. What a cell still holds
    in different components after that is confirmed pair by pair, so copies of
    a large group cost a link or two each and no pair between components is
    skipped.

    ``component_id`` is the smallest doc_id reachable; ``kept`` marks it.
    Texts without words (null and empty too) have 0 shingles, link with
    nothing and are kept. A null doc_id takes part, but names a component only
    where that has no other; repeated rows share their component; an empty
    table gives no rows; other columns are not read.
    """
    rows = _grouped(docs, width, threshold, forest)
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8, forest: Forest = Forest()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id's, one of its repeated rows.

    Rows whose text has no word all stay. Columns are unchanged, whatever their
    names; of repeated rows that differ in other columns any one stays.
    """
    rows = cut(_grouped(docs, width, threshold, forest))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    stay = rows.where("sid is not null").groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("stay_id"), F.col("o.mark").alias("stay_mark"), F.lit(True).alias("stays"))
    # the input's columns stand in one struct, so their names can't clash
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own"))
    joined = packed.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own") == F.col("stay_mark")), "left")
    wordless = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = joined.where(F.col("stays") | wordless)
    repeated = rows.where("sid is not null").groupBy("doc_id", "mark").count().where("count > 1")
    if repeated.limit(1).count():
        one = out.where(~wordless).dropDuplicates(["own_id", "own"])
        out = one.unionByName(out.where(wordless))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
