"""Secrets in texts: patterns, and a battery of randomness tests.

Patterns find assignments, access keys and long hexadecimal strings.  Beyond
them, every run of 20 or more characters of base64's alphabets is a candidate:

* its encoding is the smallest alphabet that holds it (decimal, hexadecimal,
  base32, letters and digits, base64);
* three statistics are taken over the letters' places in that alphabet: pairs of
  equal letters (which is the chi-squared statistic of uniformity, shifted and
  scaled), changes between the alphabet's halves (runs), and serial products;
* each is held against a random string of the alphabet.  The least of the three
  p-values, times 3, must not fall under ``ALPHA``;
* each is held against running text of the same length: what letters of that
  alphabet, and pairs of neighbours, do in all texts.  The least of these three,
  times 3, is the p-value of not being text; it sharpens with length.  Within
  bands of length the Benjamini-Hochberg rule on these p-values bounds the share
  of false discoveries.

The rule needs only counts of p-values, which are collected in bins of fixed
width, and of pairs of letters, so its state doesn't grow with the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.staging import stage
from tessel.llm.textbytes import chunks, view

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A maximal run that is too short fails as a whole, so the least lengths can stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: The same for whole columns, to pass over texts without a match.
_HINTS = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", "[A-Za-z0-9+/_=-]{20}")

ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=")
#: Lengths from which a new band begins; false discoveries are bounded in each.
BANDS = (20, 32, 64, 128)
ALPHA, RATE = 1e-3, 1e-2
#: Bins of -log10 p.
BIN, BINS = 0.05, 6000


LETTERS = ALPHABETS[-1]
_PLACE = np.full(256, len(LETTERS))
_PLACE[list(LETTERS.encode())] = np.arange(len(LETTERS))
#: Counts of neighbours: letters by letters, and all other bytes as one more.
_SIDE = len(LETTERS) + 1


def _tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _log10_tail(z: float) -> float:
    """-log10 of the upper tail, also far out."""
    if z > 30:
        return (z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10)
    return -math.log10(_tail(z))


@dataclass
class Null:
    """What the letters of one alphabet do in a source of strings: moments of the three statistics."""

    same: float  # chance that two letters are equal
    same3: float  # that three are
    change: float  # that neighbours lie in different halves
    change2: float  # that three in a row change half twice
    product: float  # mean and variance of the product of neighbours' distances from the middle
    spread: float

    @classmethod
    def of(cls, single: np.ndarray, pairs: np.ndarray) -> Null:
        """From the chances of letters and of pairs of neighbours."""
        k = len(single)
        dev = np.arange(k) - (k - 1) / 2
        high = np.arange(k) >= k / 2
        both = np.outer(dev, dev)
        mean = (pairs * both).sum()
        leave = [pairs[high == h][:, high != h].sum() / pairs[high == h].sum() for h in (False, True)]
        return cls((single**2).sum(), (single**3).sum(), pairs[high[:, None] != high].sum(), leave[0] * leave[1], mean, (pairs * both**2).sum() - mean**2)


def statistics(values: np.ndarray, k: int) -> tuple[int, int, float]:
    """Pairs of equal letters, changes of half, and the sum of neighbours' products."""
    counts = np.bincount(values, minlength=k)
    high = values >= k / 2
    dev = values - (k - 1) / 2
    return int((counts * (counts - 1) // 2).sum()), int(np.count_nonzero(high[1:] != high[:-1])), float((dev[1:] * dev[:-1]).sum())


def _deviations(found: tuple[int, int, float], n: int, null: Null) -> tuple[float, float, float]:
    """The statistics of ``n`` letters in standard deviations from what the source gives."""
    same, change, product = found
    a, b = null.same, null.same3
    z_same = (same - n * (n - 1) / 2 * a) / math.sqrt(n * (n - 1) / 2 * a * (1 - a) + n * (n - 1) * (n - 2) * max(0.0, b - a * a) + 1e-9)
    c = null.change
    z_change = (change - (n - 1) * c) / math.sqrt(max(0.0, (n - 1) * c * (1 - c) + 2 * (n - 2) * (null.change2 - c * c)) + 1e-9)
    return z_same, z_change, (product - (n - 1) * null.product) / math.sqrt((n - 1) * null.spread + 1e-9)


def battery(token: str, text: list[Null] | None = None) -> tuple[float, float]:
    """Three times the least p-value that ``token`` is random, and -log10 of that that it is text.

    Equal letters are too many for a random string, and too few for text; the
    other tests are two-sided.
    """
    which = next(i for i, a in enumerate(ALPHABETS) if not set(token) - set(a))
    k, n = len(ALPHABETS[which]), len(token)
    place = {c: i for i, c in enumerate(ALPHABETS[which])}
    found = statistics(np.array([place[c] for c in token]), k)
    _, z_change, z_product = _deviations(found, n, Null.of(np.full(k, 1 / k), np.full((k, k), 1 / k**2)))
    # Chi-squared from the pairs: Wilson and Hilferty's cube root, with the variance of the exact multinomial.
    chi, free = (2 * found[0] + n) * k / n - n, (k - 1) * n / max(1, n - 1)
    z_chi = ((max(0.0, chi) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    random_p = min(1.0, 3 * min(_tail(z_chi), 2 * _tail(abs(z_change)), 2 * _tail(abs(z_product))))
    if text is None:
        return random_p, 0.0
    few, z_change, z_product = _deviations(found, n, text[which])
    against = max(_log10_tail(-few), _log10_tail(abs(z_change)) - math.log10(2), _log10_tail(abs(z_product)) - math.log10(2))
    return random_p, max(0.0, against - math.log10(3))


def text_nulls(pairs: np.ndarray) -> list[Null]:
    """By alphabet: what its letters do in texts with these counts of neighbouring letters."""
    out = []
    for a in ALPHABETS:
        own = [LETTERS.index(c) for c in a]
        joint = pairs[np.ix_(own, own)] + 1.0
        single = pairs[own].sum(axis=1) + 1.0
        out.append(Null.of(single / single.sum(), joint / joint.sum()))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("token", pa.string())]))
    pairs, kind = np.zeros(_SIDE * _SIDE, np.int64), None
    for whole in batches:
        kind = whole.column(0).type
        for batch in chunks(whole, "__text", 4 << 20):
            text = batch.column(1).fill_null("")
            hint = [pc.match_substring_regex(text, h).to_numpy(zero_copy_only=False) for h in _HINTS]
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for i in np.flatnonzero(np.logical_or.reduce(hint)):
                t = text[i].as_py()
                if hint[0][i]:
                    found[i] += [{"start": m.start(), "kind": 0, "end": m.end()} for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
                for k, pattern in ((1, ACCESS), (2, HEX), (3, CANDIDATE)):
                    if hint[k][i]:
                        found[i] += [{"start": m.start(), "kind": k, "end": m.end(), "token": m[0] if k == 3 else None} for m in pattern.finditer(t)]
            data, at = view(text)
            place = _PLACE[data]
            two = place[:-1] * _SIDE + place[1:]
            two[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))] - 1] = _SIDE * _SIDE - 1  # the last letter of a text has no next one
            pairs += np.bincount(two, minlength=_SIDE * _SIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span), pa.nulls(len(batch), pa.list_(pa.int64()))], ["__id", "found", "pairs"])
    if kind is not None:  # one row for each task
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, span), pa.array([pairs.tolist()], pa.list_(pa.int64()))], ["__id", "found", "pairs"])


def _judge(text: list[Null]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column(2).to_pylist()
            both = [battery(t, text) for t in token]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.searchsorted(BANDS, [len(t) for t in token], "right").astype(np.int32)), pa.array([x for _, x in both], pa.float64()), pa.array([x for x, _ in both], pa.float64())],
                ["__row", "start", "band", "against_text", "random_p"],
            )

    return work


def find_secrets(docs: DataFrame, rate: float = RATE, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``row_id`` and ``spans``: (start, kind, end), by start, then kind as in ``KINDS``.

    Positions are code points, ends exclusive.  Pattern matches always stay;
    strings judged random are added, also where they lie in such a match (its
    value is then confirmed).  A null or empty text has no spans, an empty table
    gives no rows, repeated rows give repeated results, and other columns are
    ignored.  At most a share ``rate`` of the random strings added in a band of
    lengths is expected to be running text.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    plain = docs.select(F.col(row_id).alias("__id"), F.col(text).alias("__text"))
    scanned = stage(
        plain.mapInArrow(_scan, f"__id {kind}, found array<struct<start:long,kind:int,end:long,token:string>>, pairs array<long>")
        .withColumn("__row", F.monotonically_increasing_id()),
        "secrets",
    )
    rows = scanned.where(F.col("pairs").isNull())
    pairs = np.zeros(_SIDE * _SIDE)
    for r in scanned.where(F.col("pairs").isNotNull()).select(F.posexplode("pairs").alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]  # _SIDE * _SIDE rows
    candidates = rows.select("__row", F.explode(F.filter("found", lambda x: x["kind"] == 3)).alias("c")).select("__row", "c.start", "c.token")
    nulls = text_nulls(pairs.reshape(_SIDE, _SIDE))
    judged = stage(candidates.mapInArrow(_judge(nulls), "__row long, start long, band int, against_text double, random_p double"), "secrets-judged")
    bins = judged.groupBy("band", F.least(F.lit(BINS), F.floor(F.col("against_text") / BIN)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()  # BINS rows for each band at most
    limits = {b: _threshold([(r["bin"], r["n"]) for r in bins if r["band"] == b], rate) for b in range(len(BANDS) + 1)}
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("band"))
    added = judged.where((F.col("against_text") >= limit) & (F.col("random_p") >= ALPHA)).groupBy("__row").agg(F.collect_set("start").alias("added"))
    spans = F.filter("found", lambda x: (x["kind"] < 3) | F.coalesce(F.array_contains("added", x["start"]), F.lit(False)))
    bare = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return rows.join(added, "__row", "left").select(F.col("__id").alias(row_id), F.array_sort(bare).alias("spans"))


def _threshold(bins: list[tuple[int, int]], rate: float) -> float:
    """The least -log10 p at which p * m / (number at least as extreme) is within ``rate``; bins count as their weaker edge."""
    m, above, best = sum(n for _, n in bins), 0, math.inf
    for b, n in sorted(bins, reverse=True):
        above += n
        if 10 ** (-b * BIN) * m <= rate * above:
            best = b * BIN
    return best


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
