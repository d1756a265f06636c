"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass makes each document's set of word shingles, its fingerprint and a
   MinHash signature.  Documents with equal sets are one node from here on, so
   exact copies cost nothing more, however many there are.
2. A signature is cut into ``TREES`` labels, each a tree's sort key.  Nodes that
   share a label's prefix form a region.  How many values the prefix has, and at
   low thresholds how many trees there are, follows from the threshold alone, so
   what else the table holds doesn't decide whether two documents meet.
3. Candidates are the neighbours in each tree's sorted order, the nodes with
   the longest common prefix, as deep as that is in each region.  After them
   comes the region's centre, the node that shares most regions with others.
   A group of near copies thus gives a few pairs for each node, not all pairs.
4. Candidates whose sketches are far apart go; the others are compared on
   their full shingle sets.  Links give connected components.  Centres are
   compared only where the neighbours left their nodes in different components.
5. Where a region still has nodes of different components, all pairs of such
   nodes are compared on their full sets, block of nodes by block of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.graph import components
from tessel.llm.staging import drop, free_shuffles, partitions, stage
from tessel.llm.textbytes import _odd, chunks, mix, view, word_hashes, words

WIDTH = 5
TREES, DEPTH = 16, 8
#: Most nodes of a region's block; the blocks of a region are compared pair by pair.
REGION = 1024
#: Largest share of pairs at the threshold that may have no prefix in common in any tree.
MISS = 2e-5
#: Shingles of a block and columns of its matrix.
VOLUME, COLUMNS = 1 << 20, 4096
_U = np.uint64
_MULT, _XOR = _odd(5, TREES * DEPTH), _odd(6, TREES * DEPTH)
_ROLL = _odd(7, WIDTH)


def shingles(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, one after another, and their bounds.

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle; a text without words has none.
    """
    s, e, w = words(data, at)
    h = word_hashes(data, s, e)
    n = np.diff(w)
    total = np.zeros(max(0, len(h) - width + 1), _U)
    for k in range(width):
        total += h[k : k + len(total)] * _ROLL[k]
    total = mix(total)
    sets = []
    for i in range(len(n)):
        a, b = w[i], w[i + 1]
        if n[i] >= width:
            sets.append(np.unique(total[a : b - width + 1]))
        elif n[i]:
            sets.append(mix((h[a:b] * _ROLL[: n[i]]).sum(keepdims=True) + _U(n[i])))
        else:
            sets.append(np.zeros(0, _U))
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash of sets that are not empty: (sets, TREES * DEPTH)."""
    out = np.empty((len(bounds) - 1, len(_MULT)), _U)
    for k in range(len(_MULT)):
        out[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _MULT[k], bounds[:-1])
    return out


_SKETCH = ["s0", "s1", "s2", "s3"]


def shape(percent: int) -> tuple[int, int]:
    """Trees and length of their prefixes at which pairs of that similarity are missed by ``MISS`` at most; below 9 all values are trees."""
    for depth in range(DEPTH, 0, -1):
        if (1 - (percent / 100) ** depth) ** TREES <= MISS:
            return TREES, depth
    most = TREES * DEPTH
    return next((n for n in range(TREES, most) if (1 - percent / 100) ** n <= MISS), most), 1


def _digest(trees: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from _digest_one(whole, trees)

    return work


def _digest_one(whole: pa.RecordBatch, trees: int) -> Iterator[pa.RecordBatch]:
    step = 4 * (TREES * DEPTH // trees)
    for batch in chunks(whole, "__text"):
        values, bounds = shingles(*view(batch.column(2)))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        marks = [xxhash.xxh3_128_digest(values[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:])]
        labels = [None] * len(n)
        planes = np.zeros((len(n), 4), np.int64)
        if len(full):
            sig = signatures(values, np.append(bounds[:-1][full], len(values)))
            cut = (mix(sig) >> _U(32)).astype(">u4")
            raw = cut.tobytes()
            for j, i in enumerate(full):
                at = j * 4 * TREES * DEPTH
                labels[i] = [raw[at + t * step : at + (t + 1) * step] for t in range(trees)]
            bits = np.stack([cut & 1, (cut >> 1) & 1], axis=1).astype(np.uint8)
            planes[full] = np.packbits(bits, axis=2).reshape(len(full), 32).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(n), *(pa.array(planes[:, k]) for k in range(4)), pa.array(labels, pa.list_(pa.binary()))],
            ["__id", "__th", "fp", "n", *_SKETCH, "labels"],
        )


def _compare(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "ta"):
                va, ba = shingles(*view(batch.column(2)))
                vb, bb = shingles(*view(batch.column(3)))
                keep = np.zeros(len(batch), bool)
                for i in range(len(batch)):
                    x, y = va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        same = len(np.intersect1d(x, y, assume_unique=True))
                        keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return work


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "t"):
            values, bounds = shingles(*view(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["fp", "shingles"])


def _joins(rows: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs of roots that links between the two sides (or within the first, if it's alone) bring together."""
    names: dict[bytes, int] = {}
    code = np.array([names.setdefault(r, len(names)) for r in rows["root"].to_pylist()])
    sets = [np.frombuffer(x, _U) for x in rows["shingles"].to_pylist()]
    n = np.array([len(x) for x in sets])
    right = np.flatnonzero(rows["side"].to_numpy())
    left = np.setdiff1d(np.arange(len(n)), right, assume_unique=True)
    right = right if len(right) else left
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(n)), n)[count[word] > 1], count > 1
    word = (np.cumsum(shared) - 1)[word[shared[word]]]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    same = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(word, [low, low + COLUMNS])
        has = np.zeros((len(n), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        has[owner[a:b], word[a:b] - low] = 1
        same += (has[left] @ has[right].T).astype(np.int64)
    alike = 100 * same >= percent * (n[left][:, None] + n[right] - same)
    i, j = np.nonzero(alike & (code[left][:, None] != code[right]))
    up, out, roots = list(range(len(names))), [], list(names)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in {*zip(code[left[i]].tolist(), code[right[j]].tolist())}:
        tx, ty = top(x), top(y)
        if tx != ty:
            up[tx] = ty
            out.append((roots[x], roots[y]))
    return out


def _blocks(percent: int):
    """Links between components in rows that are sorted by ``cell``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            out = []
            cell = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)] if len(cell) else [0]
            for a, b in zip(cut, cut[1:]):
                if held and cell[a] != last:
                    out += _joins(pa.Table.from_batches(held), percent)
                    held = []
                held.append(batch.slice(a, b - a))
                last = cell[a]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])
        if held:
            out = _joins(pa.Table.from_batches(held), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return work


def far(percent: int) -> int:
    """Differing sketch positions of 128 that a pair at the threshold exceeds by five deviations of chance alone."""
    n = TREES * DEPTH
    p = (1 - percent / 100) * 0.75
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5)


def _near(a: str, b: str, most: int) -> Column:
    """Whether two sketches (structs or tables named by prefix) differ in ``most`` positions or fewer."""
    s = [(F.col(f"{a}{k}"), F.col(f"{b}{k}")) for k in _SKETCH]
    x = [p.bitwiseXOR(q) for p, q in s]
    return F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3])) <= most


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b")]


def _regions(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, label, fp, sketch, size, weight) with prefixes of ``depth`` values; lone nodes are left out."""
    rows = nodes.select("fp", "n", *_SKETCH, F.posexplode("labels").alias("tree", "label"))
    keyed = rows.withColumn("prefix", F.substring("label", 1, 4 * depth))
    # Written first: a join with the aggregate itself would keep all of a region in one task.
    sizes = stage(keyed.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1"), "region-sizes")
    # A node has a row for each tree at most.
    weight = F.sum("size").over(Window.partitionBy("fp"))
    forest = stage(keyed.join(sizes, ["tree", "prefix"]).withColumn("weight", weight), "forest")
    drop(sizes)
    return forest


def _centre_pairs(regions: DataFrame, most: int) -> DataFrame:
    centre = stage(regions.groupBy("tree", "prefix").agg(F.max(F.struct("weight", "fp", *_SKETCH)).alias("c")), "centres")
    both = regions.join(centre, ["tree", "prefix"]).where((F.col("fp") != F.col("c.fp")) & _near("", "c.", most))
    pairs = stage(both.select(*_pair("fp", "c.fp")).distinct(), "pairs")
    drop(centre)
    return pairs


def _neighbour_pairs(regions: DataFrame, most: int, reach: int = 2) -> DataFrame:
    """Pairs of nodes that stand within ``reach`` of each other in a region's order: those with the longest common prefixes.

    Each tree is sorted as a whole, in ranges, so a region of any size spans as
    many tasks as it needs; a range's last node meets the first one of the next.
    """
    key = ["tree", "label", "fp"]
    dealt = regions.select(*key, "prefix", *_SKETCH).repartitionByRange(partitions(regions.sparkSession), *key)
    placed = stage(dealt.withColumn("range", F.spark_partition_id()), "sorted-forest")
    order = Window.partitionBy("tree", "prefix", "range").orderBy("label", "fp")
    next_ = [F.lead(F.struct("fp", *_SKETCH), k).over(order) for k in range(1, reach + 1)]
    rows = placed.select("fp", *_SKETCH, F.array(*next_).alias("near")).select("fp", *_SKETCH, F.explode("near").alias("c"))
    # A row for each region and range that it spans.
    edge = F.struct("label", "fp", *_SKETCH)
    ends = placed.groupBy("tree", "prefix", "range").agg(F.min(edge).alias("head"), F.max(edge).alias("tail"))
    over = ends.select("tail", F.lead("head").over(Window.partitionBy("tree", "prefix").orderBy("range")).alias("c"))
    over = over.select("tail.fp", *(f"tail.{k}" for k in _SKETCH), F.struct("c.fp", *(f"c.{k}" for k in _SKETCH)).alias("c"))
    rows = rows.unionAll(over).where(F.col("c.fp").isNotNull() & _near("", "c.", most))
    pairs = stage(rows.select(*_pair("fp", "c.fp")).distinct(), "pairs")
    drop(placed)
    return pairs


def _cells(forest: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(cell, side, fp, root): pairs of blocks in which all nodes of a region with different roots meet; None if no region has such.

    A root with more than ``REGION`` nodes of a region has blocks of its own,
    which needn't be compared with each other.  A region of one block is a cell
    as it is.
    """
    region, block = ["tree", "prefix"], ["tree", "prefix", "own", "part"]
    nodes = forest.select(*region, "fp", "n").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(nodes, "rooted")
    ends = rooted.groupBy(*region).agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m"), F.sum("n").alias("volume"))
    whole = (F.col("m") <= REGION) & (F.col("volume") <= VOLUME)
    open_ = stage(ends.where("least <> most").select(*region, whole.alias("whole")), "open-regions")
    if open_.isEmpty():
        drop(rooted, open_)
        return None
    opened, large = stage(rooted.join(open_, region), "open-nodes"), not open_.where(~F.col("whole")).isEmpty()
    drop(rooted, open_)
    zero = F.lit(0).cast("long")
    cell = F.xxhash64(*region, F.lit(b""), zero, F.lit(b""), zero)
    alone = opened.where("whole").select(cell.alias("cell"), F.lit(0).alias("side"), "fp", "root")
    if not large:
        dealt = stage(alone, "cell-nodes")
        drop(opened)
        return dealt
    nodes = opened.where(~F.col("whole"))
    counts = nodes.groupBy(*region, "root").agg(F.count("*").alias("m"), F.sum("n").alias("volume"))
    # Mixed blocks have the empty name.
    counts = stage(counts.withColumn("own", F.when(F.col("m") > REGION, F.col("root")).otherwise(F.lit(b""))), "region-roots")
    parts = counts.groupBy(*region, "own").agg(F.ceil(F.greatest(F.sum("m") / REGION, F.sum("volume") / VOLUME)).alias("parts"))
    parts = stage(parts, "region-parts")
    owns = stage(counts.select(*region, "root", "own").join(parts, [*region, "own"]), "region-owns")
    nodes = nodes.join(owns, [*region, "root"]).select(*region, "own", F.pmod(F.xxhash64("fp", F.lit(1)), "parts").alias("part"), "fp", "root")
    blocks = parts.select(*region, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    other = blocks.select(*region, F.col("own").alias("own2"), F.col("part").alias("part2"))
    first, second = F.struct("own", "part"), F.struct(F.col("own2").alias("own"), F.col("part2").alias("part"))
    pairs = blocks.join(other, region).where(((F.col("own") == b"") | (F.col("own") != F.col("own2"))) & (first <= second))
    pairs = stage(pairs.withColumn("cell", F.xxhash64(*block, "own2", "part2")), "cells")
    left = pairs.select(*block, "cell", F.lit(0).alias("side"))
    right = pairs.where(first != second).select(*region, F.col("own2").alias("own"), F.col("part2").alias("part"), "cell", F.lit(1).alias("side"))
    dealt = stage(nodes.join(left.unionAll(right), block).select("cell", "side", "fp", "root").unionAll(alone), "cell-nodes")
    drop(opened, counts, parts, owns, pairs)
    return dealt


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b) between roots: only these are gone through."""
    if links.isEmpty():
        return roots
    moves = components(links)
    to = moves.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return stage(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionAll(moves), "roots")


def link_near_copies(docs: DataFrame, percent: int = 85, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Components of documents whose 5-word shingle sets are alike.

    Two documents are linked if 100 * |A and B| >= percent * |A or B|.  Returns
    one row for each row of ``docs``: ``row_id, n_shingles, component_id`` (the
    least id in the component) and ``kept`` (is it that row).  A text without
    words, or null, has no shingles and is linked with nothing.  Rows with a
    null id take part; a component of such rows alone has a null id and all of
    it is kept.  Repeated rows are in one component.  No rows give no rows;
    other columns are ignored.
    """
    spark, most, (trees, depth) = docs.sparkSession, far(percent), shape(percent)
    kind = docs.schema[row_id].dataType.simpleString()
    body = docs.select(F.col(row_id).alias("__id"), F.xxhash64(text).alias("__th"), F.col(text).alias("__text"))
    digest = stage(
        body.mapInArrow(_digest(trees), f"__id {kind}, __th long, fp binary, n long, s0 long, s1 long, s2 long, s3 long, labels array<binary>"), "minhash"
    )
    nodes = digest.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.first(F.struct("n", *_SKETCH, "labels")).alias("x")).select("fp", "x.*")
    nodes = stage(nodes, "nodes")
    free_shuffles(spark)
    forest = _regions(nodes, depth)
    drop(nodes)
    near, hubs = _neighbour_pairs(forest, most), _centre_pairs(forest, most)
    free_shuffles(spark)

    def texts_of(wanted: DataFrame) -> DataFrame:
        holder = digest.groupBy("fp").agg(F.min(F.struct("__th", "__id")).alias("h"))
        holder = wanted.join(holder, "fp").select("fp", F.col("h.__th").alias("__th"), F.col("h.__id").alias("hid"))
        return body.join(holder, "__th").where(F.col("__id").eqNullSafe(F.col("hid"))).select("fp", F.col("__text").alias("t"))

    texts = stage(texts_of(near.unionAll(hubs).select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "texts")
    free_shuffles(spark)

    def confirm(pairs: DataFrame, *names: str) -> DataFrame:
        """(a, b) under other names of pairs that are alike; one may come more than once."""
        left = texts.select(F.col("fp").alias("a"), F.col("t").alias("ta"))
        right = texts.select(F.col("fp").alias("b"), F.col("t").alias("tb"))
        both = pairs.join(right, "b").join(left, "a").select(*names, "ta", "tb")
        return stage(both.mapInArrow(_compare(percent), "a binary, b binary"), "links")

    def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose nodes have different roots, with these."""
        for side in ("a", "b"):
            named = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
            pairs = pairs.join(named, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
        return pairs.where("ra <> rb").select("a", "b", "ra", "rb")

    roots = components(confirm(near, "a", "b"))
    more = stage(rooted(hubs, roots), "pairs")
    if not more.isEmpty():
        roots = _merged(roots, confirm(more, "ra", "rb"))
    drop(near, hubs, more, texts)
    free_shuffles(spark)
    cells = _cells(forest, roots)
    drop(forest)
    free_shuffles(spark)
    if cells is not None:
        sets = texts_of(cells.select("fp").distinct()).dropDuplicates(["fp"]).mapInArrow(_sets, "fp binary, shingles binary")
        sets = stage(sets, "sets")
        free_shuffles(spark)
        dealt = cells.join(sets, "fp").select("cell", "side", "root", "shingles").repartition("cell").sortWithinPartitions("cell")
        roots = _merged(roots, stage(dealt.mapInArrow(_blocks(percent), "a binary, b binary"), "links"))
        drop(sets, cells)
    free_shuffles(spark)
    named = digest.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stage(named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("__id").alias("component_id")), "components")
    free_shuffles(spark)
    out = named.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("__id")).otherwise(F.col("component_id")))
    return out.select(F.col("__id").alias(row_id), F.col("n").alias("n_shingles"), "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
