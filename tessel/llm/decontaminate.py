"""Benchmark items in training passages: BM25 with block-max WAND, then overlap.

The test items are indexed: for each term the items that have it, in order of
their numbers, with the term's BM25 weight as a share of the item's score
against itself, so that one threshold serves all items.  Items lie in blocks,
and the index keeps each term's largest weight, in all and by block.

Every passage of every document is a query.  Passages are as long as two of
the longest items and half overlap, so an item always lies whole in one.  A
passage has a cursor in the list of each of its terms.  Sorted by the items
that they stand at, the first cursor at which the largest weights add up to the
threshold gives the pivot: no item before it can reach it.  If the weights of
the pivot's block can't either, all cursors up to the pivot skip the block;
else the pivot is scored.  All passages of a chunk take these steps together,
as arrays, and a passage leaves when no pivot is left.

Terms that a large share of the items have get no cursors, as their sum over an
item is bounded beforehand; it is added to every bound.  All passages and items
above the threshold are found.

A hit counts if enough of the question's word triples and enough of the
answer's stand in the passage.  Items of a few terms are found as phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.staging import stage
from tessel.llm.textbytes import HashIndex, chunks, mix, runs, view, word_hashes

_U = np.uint64
#: Bytes of terms: ASCII letters and digits and all bytes of longer UTF-8 characters.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
K1, B = 1.2, 0.75
BLOCK = 4
#: Terms that more than this share of the items have are bounded, and have no cursors.
COMMON = 0.1
#: For sums of floats that are compared with the threshold.
EPS = 1e-9
#: Most entries of a table of block weights that has the zeros too.
DENSE = 1 << 22
#: Bytes of text whose passages take their steps together.
TOGETHER = 1 << 18
#: Most items in one index; more items make more indexes, each sent out by itself.
INDEX_ITEMS = 20_000


def triples(h: np.ndarray) -> np.ndarray:
    """Hashes of three terms in a row."""
    return np.unique(mix(h[:-2] * _U(3) + h[1:-1] * _U(5) + h[2:] * _U(7)))


def _share(wanted: np.ndarray, passage: np.ndarray, there: np.ndarray) -> float:
    """Share of the triples of ``wanted`` that the passage has; of its terms, if they are fewer than three."""
    if not len(wanted):
        return 1.0
    part, whole = (triples(wanted), there) if len(wanted) >= 3 else (np.unique(wanted), np.unique(passage))
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part)


@dataclass
class ItemIndex:
    """Block-max index of items; postings are sorted by term, then item."""

    terms: HashIndex
    rare: np.ndarray  # by term: whether its postings have cursors
    top: np.ndarray  # by term: largest weight; 0 if not rare
    block_key: np.ndarray  # term * blocks + block, of the rare terms; None where block_max has them all
    block_max: np.ndarray
    rest: np.ndarray  # by block: most that the common terms add to an item
    post_from: np.ndarray  # by term + 1: its (item, weight) postings
    post: np.ndarray
    post_key: np.ndarray  # term * (items + 1) + item
    post_weight: np.ndarray
    question: list[np.ndarray]  # by item: hashes of the terms in order
    answer: list[np.ndarray]
    ids: list
    longest: int


def _terms(texts: pa.Array) -> list[np.ndarray]:
    data, at = view(texts)
    s, e, first = runs(data, at, TERM)
    h = word_hashes(data, s, e)
    return [h[a:b] for a, b in zip(first, first[1:])]


def build_index(ids: list, questions: pa.Array, answers: pa.Array, least: int, bounded: float) -> ItemIndex | None:
    """Index of the items with ``least`` terms or more; None if there are none.

    The terms that have no cursors add less than ``bounded`` to any item.
    """
    q, a = _terms(questions), _terms(answers)
    keep = [i for i in range(len(ids)) if len(q[i]) + len(a[i]) >= least]
    if not keep:
        return None
    q, a, ids = [q[i] for i in keep], [a[i] for i in keep], [ids[i] for i in keep]
    whole = [np.concatenate(x) for x in zip(q, a, strict=True)]
    n = len(whole)
    lengths = np.array([len(x) for x in whole])
    per_item = [np.unique(x, return_counts=True) for x in whole]
    names, df = np.unique(np.concatenate([t for t, _ in per_item]), return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    item_terms, item_weights = [], []
    for (t, tf), size in zip(per_item, lengths, strict=True):
        k = np.searchsorted(names, t)
        w = idf[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / lengths.mean()))
        item_terms.append(k)
        item_weights.append(w / w.sum())
    term = np.concatenate(item_terms)
    weight = np.concatenate(item_weights)
    limit = max(COMMON * n, 2.0)
    while True:
        rare = df <= limit
        rest_item = np.array([w[~rare[t]].sum() for t, w in zip(item_terms, item_weights, strict=True)])
        if rest_item.max() < bounded:
            break
        limit *= 2
    item = np.repeat(np.arange(n), [len(x) for x in item_terms])
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    post_from = np.searchsorted(term, np.arange(len(names) + 1))
    top = np.where(rare, np.maximum.reduceat(weight, post_from[:-1]), 0.0)
    blocks = -(-n // BLOCK)
    key = (term * blocks + item // BLOCK)[rare[term]]
    new = np.flatnonzero(np.r_[True, np.diff(key) != 0])[: len(key)]
    block_max = np.maximum.reduceat(weight[rare[term]], new) if len(new) else np.zeros(0)
    key = key[new]
    if len(names) * blocks <= DENSE:
        dense = np.zeros(len(names) * blocks)
        dense[key] = block_max
        key, block_max = None, dense
    return ItemIndex(
        HashIndex(names), rare, top, key, block_max, np.maximum.reduceat(rest_item, np.arange(0, n, BLOCK)),
        post_from, item, term * (n + 1) + item, weight, q, a, ids, int(lengths.max()),
    )


def _at(keys: np.ndarray | None, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where there is none; without keys, all have one."""
    if keys is None:
        return values[wanted]
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0.0)


def wand(index: ItemIndex, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, items) that may reach ``threshold``: the pivots whose block bounds do.

    ``passage, term`` are the different rare terms of each passage, by passage.
    """
    n, blocks = len(index.ids), len(index.rest)
    must = threshold - EPS - index.rest.max()  # what terms with cursors have to bring
    at = index.post_from[term]
    here = index.post[at]
    while len(passage):
        order = np.argsort(passage * (n + 1) + here)
        passage, term, at, here = passage[order], term[order], at[order], here[order]
        first = np.flatnonzero(np.r_[True, np.diff(passage) != 0])
        size = np.diff(np.append(first, len(passage)))
        owner = np.repeat(np.arange(len(first)), size)
        total = np.cumsum(index.top[term])
        total -= np.repeat(total[first] - index.top[term[first]], size)
        # Cursors at the end of their lists stand at item n and can't be pivots.
        enough = np.flatnonzero((total >= must) & (here < n))
        pivot = np.full(len(first), n)
        np.minimum.at(pivot, owner[enough], here[enough])
        stays = (pivot < n)[owner] & (here < n)
        if not stays.all():  # passages without a pivot are done, as are lists at their end
            passage, term, at, here, owner = passage[stays], term[stays], at[stays], here[stays], owner[stays]
            if not len(passage):
                return
        goal = pivot[owner]
        upto = here <= goal
        before = owner[upto]
        bound = np.bincount(before, _at(index.block_key, term[upto] * blocks + goal[upto] // BLOCK, index.block_max), len(pivot))
        good = (pivot < n) & (bound + index.rest[np.minimum(pivot, n - 1) // BLOCK] >= threshold - EPS)
        if good.any():
            whose = np.zeros(len(pivot), np.int64)
            whose[owner] = passage
            yield whose[good], pivot[good]
        # Past the pivot if it was scored; else past its block, but not past a cursor that may add to the bound.
        beyond = np.full(len(pivot), n)
        np.minimum.at(beyond, owner[~upto], here[~upto])
        target = np.where(good, pivot + 1, np.minimum((pivot // BLOCK + 1) * BLOCK, beyond))[before]
        t = term[upto]
        moved = np.minimum(np.searchsorted(index.post_key, t * (n + 1) + target), index.post_from[t + 1])
        at[upto] = moved
        here[upto] = np.where(moved < index.post_from[t + 1], index.post[np.minimum(moved, len(index.post) - 1)], n)


def search(index: ItemIndex, h: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first term, last term + 1, item, score) of all passages that reach ``threshold``.

    ``h`` has the term hashes of all texts, ``first`` the bounds of the texts.
    """
    stride = index.longest
    known = index.terms.find(h)
    n = np.diff(first)
    strides = -(-n // stride)
    stride_first = np.concatenate([[0], np.cumsum(strides)])
    place = np.flatnonzero(known >= 0)
    owner = np.searchsorted(first, place, "right") - 1
    unit = stride_first[owner] + (place - first[owner]) // stride
    t = known[place]
    # A passage is a stride and the next one of the same text; without enough in the largest weights it has no pivot.
    single = np.bincount(unit, index.top[t], stride_first[-1])
    double = single.copy()
    double[:-1] += single[1:]
    last = stride_first[1:][strides > 0] - 1
    double[last] = single[last]
    passages = np.flatnonzero(double >= threshold - EPS - index.rest.max())
    if not len(passages):
        return
    terms = len(index.rare)
    live = np.zeros(stride_first[-1] + 1, bool)
    live[passages] = True
    ends = np.zeros(stride_first[-1] + 1, bool)
    ends[last + 1] = True  # the stride after begins another text
    own = live[unit]
    after = np.r_[False, live][unit] & ~ends[unit]
    pair = np.unique(np.concatenate([unit[own] * terms + t[own], (unit[after] - 1) * terms + t[after]]))
    which, t = np.divmod(pair, terms)
    rare = index.rare[t]
    for p, item in wand(index, which[rare], t[rare], threshold):
        # All terms of the passage, common ones too, that the item has.
        a, b = np.searchsorted(which, p), np.searchsorted(which, p, "right")
        m = b - a
        k = np.repeat(np.arange(len(p)), m)
        e = np.arange(m.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m)
        score = np.bincount(k, _at(index.post_key, t[e] * (len(index.ids) + 1) + item[k], index.post_weight), len(p))
        for i in np.flatnonzero(score >= threshold):
            text = int(np.searchsorted(stride_first, p[i], "right")) - 1
            begin = int(first[text] + (p[i] - stride_first[text]) * stride)
            yield text, begin, int(min(begin + 2 * stride, first[text + 1])), int(item[i]), float(score[i])


_PHRASE = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], _U)


def _phrases(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all ``m`` terms in a row."""
    out = np.zeros(max(0, len(h) - m + 1), _U)
    for k in range(m):
        out += h[k : k + len(out)] * _PHRASE[k]
    return mix(out + _U(m))


def phrase_index(ids: list, questions: pa.Array, answers: pa.Array, least: int) -> dict[int, tuple[HashIndex, list[list]]]:
    """By length: the items of fewer than ``least`` terms, as phrases; several items may share one."""
    by_length: dict[int, dict[int, list]] = {}
    for i, q, a in zip(ids, _terms(questions), _terms(answers), strict=True):
        whole = np.concatenate([q, a])
        if 0 < len(whole) < least:
            by_length.setdefault(len(whole), {}).setdefault(int(_phrases(whole, len(whole))[0]), []).append(i)
    out = {}
    for m, found in by_length.items():
        keys = sorted(found)
        out[m] = HashIndex(np.array(keys, _U)), [found[k] for k in keys]
    return out


def phrase_hits(index: dict[int, tuple[HashIndex, list[list]]], h: np.ndarray, first: np.ndarray) -> dict[tuple, int]:
    """How often each (text, item) with the whole phrase occurs."""
    out: dict[tuple, int] = {}
    for m, (names, ids) in index.items():
        found = names.find(_phrases(h, m))
        place = np.flatnonzero(found >= 0)
        text = np.searchsorted(first, place, "right") - 1
        inside = place + m <= first[text + 1]
        pair, times = np.unique(text[inside] * len(ids) + found[place[inside]], return_counts=True)
        for p, n in zip(pair.tolist(), times.tolist(), strict=True):
            for i in ids[p % len(ids)]:
                out[p // len(ids), i] = n
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, least_terms: int = 6, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """One row for each document and item found in it.

    Returns ``row_id, item_id, passages`` (that hold the item), ``score`` (the
    best passage's BM25 score as a share of the item's score against itself),
    ``question_overlap`` and ``answer_overlap`` of that passage.  Items with
    fewer than ``least_terms`` terms are found where all their terms stand in a
    row; ``passages`` counts these places, and the shares are 1.  Items without
    terms are in no document.  Null texts, questions and answers are empty.  No
    documents or items give no rows; repeated rows give repeated results; other
    columns are ignored.  ``INDEX_ITEMS`` items are searched at a time, each
    time in one pass over the documents.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[row_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"__id {kind}, item_id {item_kind}, passages long, score double, question_overlap double, answer_overlap double"
    plain = docs.select(F.col(row_id).alias("__id"), F.col(text).alias("__text"))
    listed = items.select(F.col(item_id).alias("i"), F.col(question).alias("q"), F.col(answer).alias("a"))
    slices = max(1, -(-listed.count() // INDEX_ITEMS))
    out = None
    for k in range(slices):
        part = listed.where(F.pmod(F.xxhash64("i", "q", "a"), F.lit(slices)) == k).orderBy("i", "q", "a").toArrow().combine_chunks()
        id_type = part.schema.field("i").type
        own = part["i"].to_pylist(), *(pa.concat_arrays(part[c].chunks or [pa.array([], pa.string())]) for c in "qa")
        index, short = build_index(*own, least_terms, threshold / 2), phrase_index(*own, least_terms)
        if index is None and not short:
            continue
        shared = spark.sparkContext.broadcast((index, short))  # about INDEX_ITEMS items

        def work(batches: Iterator[pa.RecordBatch], shared=shared, id_type=id_type) -> Iterator[pa.RecordBatch]:
            ix, phrases = shared.value
            for whole in batches:
                for batch in chunks(whole, "__text", TOGETHER):
                    data, at = view(batch.column(1))
                    s, e, first = runs(data, at, TERM)
                    h = word_hashes(data, s, e)
                    best: dict[tuple[int, int], tuple] = {}
                    for text_, begin, end, item, score in search(ix, h, first, threshold) if ix else ():
                        passage = h[begin:end]
                        there = triples(passage)
                        q, a = _share(ix.question[item], passage, there), _share(ix.answer[item], passage, there)
                        if q >= overlap and a >= overlap:
                            old = best.get((text_, item), (0, 0.0, 0.0, 0.0))
                            best[text_, item] = (old[0] + 1, *max(old[1:], (score, q, a)))
                    rows = [(t, ix.ids[i], *v) for (t, i), v in best.items()]
                    rows += [(t, i, n, 1.0, 1.0, 1.0) for (t, i), n in phrase_hits(phrases, h, first).items()]
                    kinds = (pa.int64(), id_type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    columns = [pa.array([r[c] for r in rows], kind_) for c, kind_ in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["__id", "item_id", "passages", "score", "question_overlap", "answer_overlap"])

        found = plain.mapInArrow(work, schema)
        if slices > 1:  # written, so that one index at a time is held
            found = stage(found, "leaks")
            shared.unpersist()
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("__id", row_id)


def split_item(items: DataFrame, text: str = "text") -> DataFrame:
    """Add ``question`` and ``answer``: the last sentence of an item is its answer.

    An item of one sentence is cut after two thirds of its words.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    last = F.regexp_extract(body, r"(?s)^(.*[.!?])\s+(\S.*)$", 2)
    first = F.regexp_extract(body, r"(?s)^(.*[.!?])\s+(\S.*)$", 1)
    parts = F.split(body, r"\s+")
    cut = F.ceil(F.size(parts) * 2 / 3).cast("int")
    return items.withColumns({
        "question": F.when(last != "", first).otherwise(F.array_join(F.slice(parts, F.lit(1), cut), " ")),
        "answer": F.when(last != "", last).otherwise(F.array_join(F.slice(parts, cut + 1, F.size(parts)), " ")),
    })
