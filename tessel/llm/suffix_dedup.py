"""Removal of byte strings that also start elsewhere, by suffix arrays of what can match.

Two equal windows of ``length`` bytes have the same anchor: the leftmost
substring of ANCHOR bytes with the least hash.  One pass over the texts finds
the anchor of every window; consecutive windows with one anchor make a run.

* A run whose anchor occurs nowhere else has no equal window and is done.
* Runs with one anchor that are all the same bytes repeat as a whole; counting
  them settles exact copies and the inside of repeated passages.
* Of the others, windows are cut into blocks of BLOCK places relative to the
  anchor.  All windows of a block share their middle bytes, so blocks with
  different middles have no equal windows.  Blocks with equal middles are put
  into a text with the middle as one symbol, and a suffix array of that text
  puts equal windows side by side.  Equal blocks are counted first and enter
  twice at most.

Blocks are dealt by anchor and middle.  Where more than HOT different blocks
share one, their windows are compared after a further exchange by window, so
no group has to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.staging import drop, free_shuffles, partitions, stage
from tessel.llm.suffix_array import suffix_array
from tessel.llm.textbytes import BYTE, chunks, mix, powers, view

_U = np.uint64
ANCHOR, BLOCK, HOT = 32, 32, 4096
#: Symbols of one suffix array; more blocks go into the next one.
BATCH = 40_000
#: Bits for a place beside its hash; longer texts are taken in overlapping halves of that length.
PLACE_BITS = 24


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of ``length`` bytes: the place of its anchor, and hashes of all ANCHOR-byte substrings."""
    n = len(data) - ANCHOR + 1
    w = length - ANCHOR + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    h = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[:n])
    # Hash above, place below: the least value is the least hash, and of equal ones the leftmost.
    low = _U((1 << PLACE_BITS) - 1)
    if len(data) > int(low):
        half = 1 << PLACE_BITS - 1
        parts = [window_anchors(data[a : a + half + length - 1], length)[0] + a for a in range(0, len(data) - length + 1, half)]
        return np.concatenate(parts)[: n - w + 1], h
    v = (h & ~low) | np.arange(n, dtype=_U)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, _U)
    padded[:n] = v
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64), h


def _runs(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                data, at = view(batch.column(2))
                anchor, h = window_anchors(data, length)
                n = np.diff(at)
                full = np.flatnonzero(n >= length)
                m = n[full] - length + 1
                p = np.repeat(at[:-1][full] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                owner = np.repeat(full, m)
                a = anchor[p] if len(p) else p
                new = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(owner) != 0)]) if len(p) else p
                size = np.diff(np.append(new, len(p)))
                first, own = p[new], owner[new]
                raw = memoryview(np.ascontiguousarray(data))
                content = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + k + length - 1]) for s, k in zip(first.tolist(), size.tolist())), _U, len(first))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[a[new]].view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(first - at[own]), pa.array(size.astype(np.int32)), pa.array((a[new] - first).astype(np.int32))],
                    ["anchor", "content", "r1", "r2", "first", "n", "offset"],
                )

    return work


def _blocks(length: int):
    """Blocks of the runs listed for each text; ``ends`` holds the places used and the bytes on both sides of the middle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                data, at = view(batch.column(2))
                raw = data.tobytes()
                k1, k2, ends, r1, r2, place = [], [], [], [], [], []
                ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at.tolist(), batch.column(3).to_pylist())
                for a, b, base, listed in ids:
                    for run in listed:
                        first, n, offset = run["first"], run["n"], run["offset"]
                        anchor = base + first + offset
                        for j in range((offset - n + 1) // BLOCK, offset // BLOCK + 1):
                            t0, t1 = max(0, offset - n + 1 - j * BLOCK), min(BLOCK - 1, offset - j * BLOCK)
                            x = anchor - j * BLOCK
                            y = x + length - BLOCK + 1
                            key = xxhash.xxh3_128_intdigest(raw[x:y], seed=j)
                            k1.append((key >> 64) - (1 << 63))
                            k2.append((key & (1 << 64) - 1) - (1 << 63))
                            ends.append(bytes((t0, t1)) + raw[x - t1 : x] + raw[y : y + BLOCK - 1 - t0])
                            r1.append(a)
                            r2.append(b)
                            place.append(x - base)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (k1, k2)), pa.array(ends, pa.binary()), *(pa.array(c, pa.int64()) for c in (r1, r2, place))], ["k1", "k2", "ends", "r1", "r2", "place"])

    return work


def _repeated(groups: list[list[tuple[bytes, int]]]) -> list[list[tuple[int, int] | None]]:
    """Least and greatest repeated window of each block in groups of (ends, count) with one middle.

    A block that occurs more than once stands in the text twice.  Where all
    blocks of a group are equal, they have all their bytes in common, so the
    whole block is the middle and one symbol.
    """
    listed = [(g, ends, len(group) == 1) for g, group in enumerate(groups) for ends, count in group for _ in range(min(count, 2))]
    strings = len(listed)
    text: list[int] = []
    where: list[tuple[int, int, int]] = []  # string, first and last of its windows that start at a symbol
    at_symbol: list[int] = []
    for string, (g, ends, alone) in enumerate(listed):
        t0, t1 = ends[0], ends[1]
        text.append(strings - string)  # separators fall, so no Lyndon word crosses one
        if alone:
            where.append((string, t0, t1))
            at_symbol.append(len(text))
            text.append(strings + 257 + g)
            continue
        for t in range(t0, t1 + 1):
            where.append((string, t, t))
            at_symbol.append(len(text) + t1 - t)
        text += [strings + 1 + c for c in ends[2 : 2 + t1]]
        text.append(strings + 257 + g)
        text += [strings + 1 + c for c in ends[2 + t1 :]]
    text += [0] * BLOCK
    flat = np.array(text, np.int64)
    name = np.full(len(text), -1, np.int64)
    name[at_symbol] = np.arange(len(where))
    order = name[np.array(suffix_array(text[: 1 - BLOCK]))]
    order = order[order >= 0]  # windows in the order of their suffixes
    begin = np.array(at_symbol)[order]
    equal = flat[begin[1:, None] + np.arange(BLOCK)] == flat[begin[:-1, None] + np.arange(BLOCK)]
    whole = np.array([listed[where[k][0]][2] for k in order])
    same = np.where(whole[1:], equal[:, 0], equal.all(axis=1))
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    low, high = [BLOCK] * strings, [-1] * strings
    for k in order[hit]:
        s, first, last = where[k]
        low[s], high[s] = min(low[s], first), max(high[s], last)
    out, string = [], 0
    for group in groups:
        found: list[tuple[int, int] | None] = []
        for _, count in group:
            found.append((low[string], high[string]) if high[string] >= 0 else None)
            string += min(count, 2)
        out.append(found)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, ends, count) in the order of k1, k2: the repeated windows; hot groups pass as they are."""
    waiting: list[tuple[tuple[int, int], list[tuple[bytes, int]]]] = []
    symbols = 0
    key: tuple[int, int] | None = None
    group: list[tuple[bytes, int]] = []
    hot = False

    def settle() -> pa.RecordBatch:
        nonlocal waiting, symbols
        rows = []
        if waiting:
            for ((a, b), g), found in zip(waiting, _repeated([g for _, g in waiting]), strict=True):
                rows += [(a, b, e, c, *f, False) for (e, c), f in zip(g, found, strict=True) if f]
        waiting, symbols = [], 0
        return _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k1", "k2", "ends", "count", "low", "high", "hot"])

    def close() -> None:
        nonlocal symbols
        if group and not hot and (len(group) > 1 or group[0][1] > 1):
            waiting.append((key, group))
            symbols += 4 if len(group) == 1 else sum((len(e) + 1) * min(c, 2) for e, c in group)

    for batch in batches:
        passing = []
        for a, b, e, c in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (a, b) != key:
                close()
                key, group, hot = (a, b), [], False
                if symbols >= BATCH:
                    yield settle()
            if hot:
                passing.append((a, b, e, c, 0, 0, True))
                continue
            group.append((e, c))
            if len(group) > HOT:
                passing += [(a, b, e, c, 0, 0, True) for e, c in group]
                group, hot = [], True
        if passing:
            yield _rows(passing)
    close()
    yield settle()


def repeated_spans(docs: DataFrame, length: int = 400, text: str = "text", row_id: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """(r1, r2, spans): byte spans covered by a string of ``length`` bytes that also starts elsewhere.

    ``r1, r2`` are the hashes of a row's text and id (see ``keyed``); the spans
    are sorted by neither and may overlap.  With ``known``, an earlier result,
    only the spans of rows that it lacks are asked for and complete; they are
    sought in all rows.
    """
    if length < ANCHOR + BLOCK:
        raise ValueError(f"length must be {ANCHOR + BLOCK} or more")
    spark = docs.sparkSession
    body = keyed(docs, text, row_id).select("r1", "r2", "__text")
    runs = stage(body.mapInArrow(_runs(length), "anchor long, content long, r1 long, r2 long, first long, n int, offset int"), "runs")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    # Written first: a join with the aggregate itself would keep all runs of an anchor in one task.
    shared = stage(shared.where("c > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("same")), "shared-anchors")
    found = stage(runs.join(shared, "anchor").select("anchor", "r1", "r2", "first", "n", "offset", "same"), "shared-runs")
    drop(runs, shared)
    free_shuffles(spark)
    if known is not None:
        marked = found.join(known.select("r1", "r2", F.lit(True).alias("known")), ["r1", "r2"], "left")
        asked = stage(marked.where(F.col("known").isNull()).select("anchor").distinct(), "asked-anchors")
        wanted = stage(found.join(asked, "anchor", "left_semi"), "asked-runs")
        drop(found, asked)
        found = wanted

    listed = found.where(~F.col("same")).groupBy("r1", "r2").agg(F.collect_set(F.struct("first", "n", "offset")).alias("runs"))
    blocks = stage(
        body.join(listed, ["r1", "r2"]).select("r1", "r2", "__text", "runs").mapInArrow(_blocks(length), "k1 long, k2 long, ends binary, r1 long, r2 long, place long"), "blocks"
    )
    free_shuffles(spark)
    counted = blocks.groupBy("k1", "k2", "ends").agg(F.count("*").alias("count"))
    dealt = counted.repartition(partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2", "ends")
    judged = stage(dealt.mapInArrow(_compare, "k1 long, k2 long, ends binary, count long, low int, high int, hot boolean"), "windows")
    # Windows of hot groups, one by one: the bytes around the middle are what tells them apart.
    t = F.explode(F.sequence(F.conv(F.hex(F.substring("ends", 1, 1)), 16, 10).cast("int"), F.conv(F.hex(F.substring("ends", 2, 1)), 16, 10).cast("int")))
    single = judged.where("hot").select("k1", "k2", "ends", "count", t.alias("t"))
    single = single.withColumn("window", F.expr(f"substring(ends, 3 + conv(hex(substring(ends, 2, 1)), 16, 10)::int - t, {BLOCK - 1})"))
    often = single.groupBy("k1", "k2", "t", "window").agg(F.sum("count").alias("c")).where("c > 1").drop("c")
    hot = single.join(often, ["k1", "k2", "t", "window"], "left_semi").groupBy("k1", "k2", "ends").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    windows = judged.where("NOT hot").select("k1", "k2", "ends", "low", "high").unionAll(hot)
    ranges = blocks.join(windows, ["k1", "k2", "ends"]).select("r1", "r2", (F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + length).alias("b"))
    whole = found.where("same").select("r1", "r2", F.col("first").alias("a"), (F.col("first") + F.col("n") + length - 1).alias("b"))
    spans = stage(ranges.unionAll(whole).groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop(found, blocks, judged)
    free_shuffles(spark)
    return spans


def keyed(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``__id, __text`` and two hashes that tell a row's text and id."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(row_id).alias("__id"), body.alias("__text"), F.xxhash64(body).alias("r1"), F.xxhash64(F.coalesce(F.col(row_id).cast("string"), F.lit("null"))).alias("r2")
    )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", row_id: str = "doc_id", with_kept: bool = True, report: int | None = None) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts elsewhere.

    Texts are their UTF-8 bytes, null is empty, and no string crosses texts.
    All occurrences go, the first one too; strings are judged on the input.
    Returns ``row_id, n_bytes, n_removed, removed`` (start, end in bytes),
    ``kept_sha256`` and, if wanted, ``kept``, the other bytes as binary (a
    character may be cut).  Repeated rows remove each other; shorter texts stay;
    no rows give no rows; other columns are ignored.

    ``report``, a shorter length, adds ``n_passages``: how many maximal runs of
    bytes repeated strings cover, of ``length`` bytes or, in a row without
    such, of ``report`` bytes.  Nothing more is removed for it.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    spans = repeated_spans(docs, length, text, row_id)
    both = keyed(docs, text, row_id).join(spans, ["r1", "r2"], "left")
    brief = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    if report is not None:
        both = both.join(repeated_spans(docs, report, text, row_id, spans).withColumnRenamed("spans", "brief"), ["r1", "r2"], "left")
        brief = F.when(F.col("spans").isNull(), F.col("brief"))
    # Texts without spans stay as they are and needn't be sent.
    whole = F.col("spans").isNull()
    sent = F.col("__text") if with_kept else F.when(~whole, F.col("__text"))
    both = both.select("__id", sent.alias("__text"), "spans", F.octet_length("__text").cast("long").alias("__n"), F.when(whole, F.sha2("__text", 256)).alias("__sha"), brief.alias("__brief"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, removed, kept, sha, passages = [], [], [], [], [], []
            rows = zip(batch.column(1).cast(pa.binary()), *(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
            for body, listed, size, done, short in rows:
                raw = body.as_buffer()
                passages.append(len(merged(listed or short or [])))
                if done:
                    n.append(size)
                    gone.append(0)
                    removed.append([])
                    sha.append(done)
                    if with_kept:
                        kept.append(raw.to_pybytes() if raw is not None else b"")
                    continue
                raw = memoryview(raw) if raw is not None else b""
                runs = merged(listed or [])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                rest = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
                digest = hashlib.sha256()
                for part in rest:
                    digest.update(part)
                n.append(len(raw))
                gone.append(sum(b - a for a, b in runs))
                removed.append([{"start": a, "end": b} for a, b in runs])
                sha.append(digest.hexdigest())
                if with_kept:
                    kept.append(b"".join(rest))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span), pa.array(sha, pa.string())]
            names = ["__id", "n_bytes", "n_removed", "removed", "kept_sha256"]
            if with_kept:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            if report is not None:
                columns.append(pa.array(passages, pa.int64()))
                names.append("n_passages")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"__id {kind}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_kept + ", n_passages long" * (report is not None)
    return both.mapInArrow(work, schema).withColumnRenamed("__id", row_id)
