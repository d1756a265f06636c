"""Packing token pieces into sequences by vector best-fit.

A piece asks for a vector: tokens, one document, and attention cost (the square
of its length).  A sequence starts with capacities for all three.  Sequences
are filled one after another: of all lengths that are still in stock and fit
every residual capacity, the one with the best score goes in, until none fits.
The score is the weighted dot product of demand and residual, or the norm of
the residual that would remain.

The vector depends on the length alone, so stock is a count for each length
(as many as the token capacity at most).  A filled sequence is a pattern that
is repeated while stock lasts.  The plan is thus as small for 100 TB as for a
test table, and is made on the driver from the histogram of lengths.  Pieces
learn their place from their rank among pieces of their length, which is
counted in parts, so one common length doesn't meet in one task.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.staging import stage
from tessel.llm.textbytes import chunks

END = 2

# Fixed values of the public byte-level BPE vocabularies: the pattern that
# splits a text, and the bytes that stand for themselves in the JSON file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _ranks(whole: dict) -> dict[bytes, int]:
    """The vocabulary as bytes; the bytes that aren't printed are written as characters from 256 on."""
    rest = [b for b in range(256) if b not in PRINTED]
    byte = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in whole["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}


def _plain_bytes(whole: dict) -> bool:
    """Whether the file describes byte-level BPE with PATTERN, and nothing before or beside it."""
    split = whole.get("pre_tokenizer") or {}
    model = whole["model"]
    return (
        whole.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and model.get("type", "BPE") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not model.get("dropout") and not model.get("ignore_merges") and all("<|" in t["content"] for t in whole["added_tokens"])
    )


class TextEncoder:
    """Byte-level BPE ids of texts, as the ``tokenizers`` library gives them.

    The merges run in tiktoken with the ranks read from the same file; it gives
    the same ids several times as fast.  A text in which no white space follows
    white space is split without the pattern's look-ahead, which has nothing to
    do there and is slow.  What may hold a special token goes to ``tokenizers``,
    and everything does if the file asks for another way to split or normalise.
    """

    #: Two of Unicode's white space characters in a row.
    DOUBLE = r"[\s\x0b\x{85}\pZ]{2}"

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.as_file = not _plain_bytes(whole)
        if self.as_file:
            return
        ranks = _ranks(whole)
        self.full = Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = Encoding("plain", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: pa.Array) -> Iterator[array]:
        """Ids of each text; null is the empty text."""
        texts = texts.fill_null("")
        double = pc.match_substring_regex(texts, self.DOUBLE).to_pylist()
        special = pc.match_substring(texts, "<|").to_pylist()
        for text, d, s in zip(texts.to_pylist(), double, special, strict=True):
            if s or self.as_file:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                yield array("I", self.full(text) if d else self.plain(text))


_encoders: dict[str, TextEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 1024, text: str = "text", row_id: str = "doc_id", end: int = END, with_ids: bool = False) -> DataFrame:
    """Token ids of each text and an end id, cut into pieces of ``most`` tokens.

    Only texts with more tokens are cut; the first piece takes the odd rest.
    Returns ``row_id, piece, start, length, ids_crc32`` and, if wanted,
    ``ids``.  A null or empty text is one piece with the end id alone.
    """
    kind = docs.schema[row_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = TextEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        for whole in batches:
            for batch in chunks(whole, "__text"):
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(batch.column(1))):
                    ids.append(end)
                    ids = np.frombuffer(ids, np.uint32).astype("<u4", copy=False)
                    n = len(ids)
                    cuts = [0, *range(n % most or most, n + 1, most)] if n > most else [0, n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b]))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                names = ["__id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"__id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{row_id}` AS __id", f"`{text}` AS __text").mapInArrow(work, schema).withColumnRenamed("__id", row_id)


def plan(stock: dict[int, int], tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "dot") -> list[tuple[int, int, int, int, int, int]]:
    """Fill sequences from ``stock`` (length -> count) until nothing is left.

    Returns (length, rank_from, rank_to, first sequence, pieces of this length
    in a sequence, offset of the first of them): a piece of that length with
    rank r has place (r - rank_from) divided by the pieces in a sequence.
    """
    lengths = np.array(sorted(stock, reverse=True), np.int64)
    left = np.array([stock[n] for n in lengths], np.int64)
    capacity = np.array([tokens, documents, attention], np.float64)
    if len(lengths) and (lengths[0] > tokens or lengths[0] ** 2 > attention or documents < 1):
        raise ValueError("a piece doesn't fit into an empty sequence")
    demand = np.stack([lengths, np.ones_like(lengths), lengths**2], axis=1)
    share = demand / capacity
    w = np.array(weights)
    used_up = np.zeros(len(lengths), np.int64)
    out, sequence = [], 0
    while left.any():
        residual = np.array([tokens, documents, attention], np.int64)
        taken = np.zeros(len(lengths), np.int64)
        while True:
            fits = np.flatnonzero((demand <= residual).all(axis=1) & (left > taken))
            if not len(fits):
                break
            r = residual / capacity
            if score == "dot":
                best = fits[np.argmax(share[fits] @ (w * r))]
            else:
                best = fits[np.argmin((((r - share[fits]) ** 2) * w).sum(axis=1))]
            taken[best] += 1
            residual = residual - demand[best]
        some = np.flatnonzero(taken)
        times = int((left[some] // taken[some]).min())
        offset = 0
        for k in some:
            m = int(taken[k])
            out.append((int(lengths[k]), int(used_up[k]), int(used_up[k]) + times * m, sequence, m, offset))
            offset += m * int(lengths[k])
        used_up += taken * times
        left -= taken * times
        sequence += times
    return out


def pack(pieces: DataFrame, tokens: int = 1024, documents: int = 1024, attention: int = 1024**2, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "dot") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length`` up to ``tokens``.

    With the default capacities for documents and attention only tokens bind.
    Equal lengths are interchangeable; which piece of a length goes where
    follows from its place in the staged table.  All other columns stay, of
    whatever name, but ``sequence_id`` and ``offset``, which are replaced.  No
    pieces give no rows.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # The caller's columns travel in one, so that their names can't clash with those used here.
    placed = pieces.select(F.struct(*kept).alias("piece"), F.col("length").alias("n"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = stage(placed, "pieces")
    counts = stage(placed.groupBy("n", "part").agg(F.count("*").alias("k")), "piece-counts")
    stock = {r["n"]: r["k"] for r in counts.groupBy("n").agg(F.sum("k").alias("k")).collect()}  # `tokens` rows at most
    rows = plan(stock, tokens, documents, attention, weights, score)
    # Each pattern uses up a length and holds few different ones, so it has `tokens * sqrt(2 * tokens)` rows at most, however many pieces there are.
    places = spark.createDataFrame(rows, "length long, from long, to long, first long, m long, offset long")
    before = F.sum("k").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("n", "part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("n", "part").orderBy("at")) - 1
    ranked = placed.withColumn("own", own).join(base, ["n", "part"]).withColumn("rank", F.col("own") + F.col("base"))
    inside = (F.col("n") == F.col("length")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    r = F.col("rank") - F.col("from")
    return ranked.join(F.broadcast(places), inside).select(
        *(F.col(f"piece.`{c}`").alias(c) for c in kept),
        (F.col("first") + F.floor(r / F.col("m"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (r % F.col("m")) * F.col("length")).cast("long").alias("offset"),
    )
