"""Toxic spans and document scores by a linear-chain conditional random field.

Training: words that stand in toxic training documents far more often than in
others name the toxic tokens of the toxic training documents; all other tokens
are clean.  A two-state chain with word, prefix and neighbour features and
learnt transitions is fitted to these tags by gradient ascent on its
conditional likelihood.  A logistic layer, fitted across folds, turns a
document's marginals into the probability of its label.

Scoring: forward and backward passes give each token's marginal.  In a chain of
two states both passes are recursions of one log-odds value, run side by side
for all texts of a batch.  Runs of tokens with a marginal of at least 0.5 are
the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.staging import drop, stage
from tessel.llm.textbytes import HashIndex, chunks, mix, runs, view, word_hashes

_U = np.uint64
#: Bytes of tokens: ASCII letters and all bytes of longer UTF-8 characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PREFIX = 6
SEGMENT = 64
#: Bytes of text that are scored together.
TOGETHER = 2 << 20
#: Tokens that are gone through one after another.
STRETCH = 1024
#: Largest log-odds that a document's summary tells apart, and those of a sure token.
LIMIT, SURE = 12.0, 1.0
_SALTS = [_U(0), _U(0xA5A5), _U(0x5A5A5A), _U(0x3C3C3C3C)]


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the tokens by template: the word, its prefix, the word before, the word after; 0 is none."""
    h = word_hashes(data, s, e)
    full = np.diff(first) > 0
    out = []
    for template in range(4):
        if template == 0:
            row = h
        elif template == 1:
            row = mix(word_hashes(data, s, np.minimum(e, s + PREFIX)) ^ _SALTS[1])
            row[e - s <= PREFIX] = 0
        else:
            row = np.zeros_like(h)
            if template == 2:
                row[1:] = mix(h[:-1] ^ _SALTS[2])
                row[first[:-1][full]] = 0
            else:
                row[:-1] = mix(h[1:] ^ _SALTS[3])
                row[first[1:][full] - 1] = 0
        out.append(row)
    return out


class Chain:
    """Marginals of two-state chains that lie one after another in flat arrays.

    Chains go side by side, token by token, in stretches of ``STRETCH`` tokens.
    What a stretch does to the log-odds that enter it is a 2 x 2 matrix, so the
    stretches of a long chain go side by side too: first their matrices, then
    the values at their borders, then the tokens inside.
    """

    def __init__(self, first: np.ndarray) -> None:
        n = np.diff(first)
        count = -(-n // STRETCH)
        chain = np.repeat(np.arange(len(n)), count)
        rank = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[:-1][chain] + rank * STRETCH
        size = np.minimum(STRETCH, first[1:][chain] - begin)
        order = np.argsort(-size, kind="stable")
        self.begin, self.n = begin[order], size[order]
        self.active = np.searchsorted(-self.n, -np.arange(1, (self.n[0] if len(self.n) else 0) + 1), "right")
        # Places of the stretches that are the second, third, ... of their chain, and of those before them.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_rank = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[by_rank], np.arange(1, (rank.max() if len(rank) else 0) + 2))
        self.later = [(place[by_rank[x:y]], place[by_rank[x:y] - 1]) for x, y in zip(cuts, cuts[1:])]

    def _forward(self, emission: np.ndarray, t: np.ndarray, enter: np.ndarray) -> np.ndarray:
        """``enter`` has the log-odds before each stretch, nan at a chain's beginning."""
        f = emission.astype(np.float64)
        for i, k in enumerate(self.active):
            at = self.begin[:k] + i
            x = f[at - 1] if i else np.nan_to_num(enter[:k])
            step = np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])
            f[at] += step if i else np.where(np.isnan(enter[:k]), 0.0, step)
        return f

    def _backward(self, emission: np.ndarray, t: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """``leave`` has the backward log-odds at each stretch's last token."""
        b = np.zeros(len(emission))
        b[self.begin + self.n - 1] = leave
        for i in range(len(self.active) - 2, -1, -1):
            at = self.begin[: self.active[i + 1]] + i
            x = b[at + 1] + emission[at + 1]
            b[at] = np.logaddexp(t[1, 0], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[0, 1])
        return b

    def _matrices(self, emission: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Logarithms of the products of each stretch's steps, [from, to, stretch]."""
        m = np.empty((2, 2, len(self.begin)))
        for i, k in enumerate(self.active):
            e = emission[self.begin[:k] + i]
            if not i:
                m[:, 0], m[:, 1] = t[:, :1], t[:, 1:] + e
                continue
            zero = np.logaddexp(m[:, 0, :k] + t[0, 0], m[:, 1, :k] + t[1, 0])
            m[:, 1, :k] = np.logaddexp(m[:, 0, :k] + t[0, 1], m[:, 1, :k] + t[1, 1]) + e
            m[:, 0, :k] = zero
        return m

    def run(self, emission: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds; ``t[a, b]`` scores state b after state a, ``emission`` state 1 against 0."""
        enter, leave = np.full(len(self.begin), np.nan), np.zeros(len(self.begin))
        if self.later:
            m = self._matrices(emission, t)
            own = self.begin[self.later[0][1]]  # the first stretches of long chains, which nothing enters
            after = np.full(len(self.begin), np.nan)
            x = emission[own].astype(np.float64)
            for i in range(1, STRETCH):
                x = emission[own + i] + np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])
            after[self.later[0][1]] = x
            for here, before in self.later:
                x = enter[here] = after[before]
                after[here] = np.logaddexp(m[0, 1, here], x + m[1, 1, here]) - np.logaddexp(m[0, 0, here], x + m[1, 0, here])
            for here, before in reversed(self.later):
                x = leave[here]
                leave[before] = np.logaddexp(m[1, 0, here], x + m[1, 1, here]) - np.logaddexp(m[0, 0, here], x + m[0, 1, here])
        return self._forward(emission, t, enter), self._backward(emission, t, leave)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """``names`` are sorted feature hashes with ``weights``; ``layer`` maps summaries to a label's log-odds."""

    names: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    layer: np.ndarray

    def emission(self, feats: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(feats[0]), self.bias)
        if len(self.names):
            if not hasattr(self, "index"):
                self.index = HashIndex(self.names)
            for row in feats:
                at = self.index.find(row)
                hit = at >= 0
                out[hit] += self.weights[at[hit]]
        return out

    def odds(self, feats: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Log-odds of each token's marginal."""
        f, b = Chain(first).run(self.emission(feats), self.transitions)
        return f + b

    def summary(self, batch: pa.RecordBatch) -> np.ndarray:
        """Summaries of the texts in the only column."""
        data, at = view(batch.column(0))
        s, e, first = runs(data, at, LETTER)
        return summaries(self.odds(features(data, s, e, first), first), first)


def summaries(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: constant, log-odds of any toxic token, the largest of one token, log of
    their expected number, their share, log of the number that are sure."""
    n = np.diff(first)
    out = np.zeros((len(n), 6))
    out[:, 0] = 1
    out[:, 1:3] = -LIMIT
    full = np.flatnonzero(n)
    if len(full):
        cuts = first[:-1][full]
        odds = np.clip(odds, -LIMIT, LIMIT)
        p = _sigmoid(odds)
        none = -np.add.reduceat(np.logaddexp(0, odds), cuts)
        total = np.add.reduceat(p, cuts)
        out[full, 1] = np.clip(np.log(np.maximum(-np.expm1(none), 1e-12)) - none, -LIMIT, LIMIT)
        out[full, 2] = np.maximum.reduceat(odds, cuts)
        out[full, 3] = np.log1p(total)
        out[full, 4] = np.log1p(100 * total / n[full])
        out[full, 5] = np.log1p(np.add.reduceat(odds >= SURE, cuts, dtype=np.int64))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, folds: int = 3) -> Model:
    """Fit a model to whole labelled texts; ``weight`` is the rows that a sampled row stands for.

    The layer is fitted to summaries that chains give of texts which they
    haven't seen, ``folds`` of them trained for that; on its own texts a chain
    is surer than on new ones, and clean texts would be rejected.
    """
    table = pa.table({"t": texts})
    base = np.log((toxic @ weight + 0.5) / ((1 - toxic) @ weight + 1.0))  # without labels, nothing is toxic
    out = np.zeros((len(toxic), 6))
    fold = np.zeros(len(toxic), np.int64)
    for y in (0, 1):  # as many of either label in each
        fold[toxic == y] = np.arange((toxic == y).sum()) % folds
    for k in range(folds):
        own = np.flatnonzero(fold == k)
        part = fit_chain(texts.take(pa.array(np.flatnonzero(fold != k))), toxic[fold != k])
        if part is not None and len(own):
            out[own] = np.concatenate([part.summary(b) for w in table.take(pa.array(own)).to_batches() for b in chunks(w, "t")])
    model = fit_chain(texts, toxic)
    if model is None or not out[:, 0].all():
        return Model(np.zeros(0, _U), np.zeros(0), -5.0, np.zeros((2, 2)), np.array([base, 0, 0, 0, 0, 0]))
    model.layer = _logistic(out, toxic, weight)
    return model


def fit_chain(texts: pa.Array, toxic: np.ndarray, odds: float = 5.0, least: int = 6, epochs: int = 25) -> Model | None:
    """A chain without its layer; None if there are no words or only one label."""
    table = pa.table({"t": texts})
    parts, firsts = [], [np.zeros(1, np.int64)]
    for part in table.to_batches():
        for batch in chunks(part, "t"):
            data, at = view(batch.column(0))
            s, e, first = runs(data, at, LETTER)
            parts.append(features(data, s, e, first))
            firsts.append(first[1:] + firsts[-1][-1])
    feats = []
    for _ in range(4):  # template by template, so that no more than one is held twice
        feats.append(np.concatenate([p.pop(0) for p in parts]) if parts else np.zeros(0, _U))
    first = np.concatenate(firsts)
    del parts, firsts
    owner = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(first))
    pos, neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))

    def frequencies(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different hashes, and how many toxic and clean texts have them."""
        order = np.argsort(row, kind="stable")  # owners rise within a hash
        h, o = row[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[new], o[new]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        bad = np.add.reduceat(toxic[o], edge)
        return h[edge], bad, np.diff(np.append(edge, len(h))) - bad

    if not len(feats[0]) or not toxic.any() or toxic.all():
        return None
    tags = np.zeros(len(feats[0]), bool)
    for row in feats[:2]:
        names, a, b = frequencies(row)
        share = pos / (pos + neg)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = a * np.log(a / (share * (a + b))) + np.nan_to_num(b * np.log(b / ((1 - share) * (a + b))))
        # Far more often in toxic texts, and by no chance among so many words.
        sure = (names != 0) & (g >= np.log(20 * len(names))) & ((a + 0.5) / pos >= odds * (b + 0.5) / neg)
        tags |= np.isin(row, names[sure])
    listed = tags
    tags = (tags & (toxic[owner] == 1)).astype(np.float64)
    cuts = np.unique(np.concatenate([first, *(np.arange(x, y, SEGMENT) for x, y in zip(first, first[1:]) if y - x > SEGMENT)]))
    # Most segments have no suspicious token; all that have one and twice as many others train the chain.
    has = np.logical_or.reduceat(listed, cuts[:-1])
    others = np.flatnonzero(~has)
    some = np.sort(np.concatenate([np.flatnonzero(has), others[:: max(1, len(others) // (2 * int(has.sum()) + 500))]]))
    take = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in some])
    first_ = np.concatenate([[0], np.cumsum(cuts[some + 1] - cuts[some])])
    tags_ = tags[take]
    del owner, listed
    feats = [row[take] for row in feats]
    vocabulary = []
    for row in feats:
        names, counts = np.unique(row, return_counts=True)
        vocabulary.append(names[(counts >= least) & (names != 0)])
    vocabulary = np.unique(np.concatenate(vocabulary))
    index = []
    for row in feats:
        at = np.searchsorted(vocabulary, row).clip(max=max(0, len(vocabulary) - 1)).astype(np.int32)
        index.append(np.where(vocabulary[at] == row, at, np.int32(len(vocabulary))) if len(vocabulary) else at)
    del feats
    chain, w, t = Chain(first_), np.zeros(len(vocabulary) + 1), np.zeros((2, 2))
    bias = float(np.log(tags.mean() + 1e-6)) - 1  # an unknown word is rarely toxic
    speed = np.full(len(w), 1.0)
    inner = np.ones(len(take), bool)
    inner[first_[:-1]] = False
    cur = np.flatnonzero(inner).astype(np.int32)
    del tags, take, inner
    prev, now = tags_[cur - 1], tags_[cur]
    seen = np.array([((1 - prev) * (1 - now)).sum(), ((1 - prev) * now).sum(), (prev * (1 - now)).sum(), (prev * now).sum()])
    del prev, now
    for _ in range(epochs):
        x = np.full(len(tags_), bias)
        for row in index:
            x += w[row]
        f, b_ = chain.run(x, t)
        expected = np.zeros(4)
        for at in range(0, len(cur), 1 << 16):  # in parts, as these arrays are many
            c = cur[at : at + (1 << 16)]
            ahead, here = f[c - 1], x[c] + b_[c]
            z = [np.full(len(c), t[0, 0]), t[0, 1] + here, ahead + t[1, 0], ahead + t[1, 1] + here]
            norm = np.logaddexp(np.logaddexp(z[0], z[1]), np.logaddexp(z[2], z[3]))
            expected += [np.exp(v - norm).sum() for v in z]
        f += b_
        del x, b_
        gap = tags_ - _sigmoid(f)
        del f
        grad = -0.05 * w
        for row in index:
            grad += np.bincount(row, gap, len(w))
        grad[-1] = 0
        speed += grad**2
        w += 2.5 * grad / np.sqrt(speed)
        t = t + (0.5 * (seen - expected) / np.sqrt(len(cur) * np.maximum(seen, 1))).reshape(2, 2)
    keep = np.abs(w[:-1]) > 0.2
    return Model(vocabulary[keep], w[:-1][keep], bias, t, np.zeros(6))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1000, max_bytes: int = 64 << 20, text: str = "text", row_id: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on labelled rows whose crc32(id as text) is no multiple of 5.

    At most ``max_rows`` rows of either label are used, those with the least
    hash of the id, and their weights make up for the rest.  Of these, taken
    from either label in turn, as many whole texts go to the driver as
    ``max_bytes`` hold; one that is too long for the rest is passed over.  Of
    several labels for an id the largest counts; null labels and ids are left
    out.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(row_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    known = known.where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    taken = [known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_rows) for y in (0, 1)]
    sample = F.broadcast(taken[0].unionAll(taken[1]))  # 2 * max_rows ids at most
    rows = docs.select(F.col(row_id).alias("__id"), F.col(text).alias("__text")).join(sample, "__id")
    rows = stage(rows.dropDuplicates(["__id"]).select("__id", "__y", "__text", F.coalesce(F.octet_length("__text"), F.lit(0)).alias("__n")), "labelled")
    turn = F.row_number().over(Window.partitionBy("__y").orderBy(F.xxhash64("__id"), "__id"))
    lengths = rows.select("__id", "__n", "__y", turn.alias("turn")).orderBy("turn", "__y").collect()  # 2 * max_rows rows
    taken, left = [], max_bytes
    for r in lengths:
        if r["__n"] <= left:
            taken.append(r["__id"])
            left -= r["__n"]
    found = rows.where(F.col("__id").isin(taken)).orderBy("__y", "__id").select("__y", "__text").toArrow()
    drop(rows)
    y = found.column(0).to_numpy().astype(np.float64)
    texts = pa.concat_arrays([c.cast(pa.large_string()) for c in found.column(1).chunks] or [pa.array([], pa.large_string())])
    weight = np.array([counts.get(int(k), 0) for k in y]) / np.maximum(1, np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    return fit(texts, y, weight)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def annotate(docs: DataFrame, model: Model, text: str = "text", score: str = "toxic_score", spans: str = "toxic_spans") -> DataFrame:
    """All columns of ``docs``, and ``score`` and ``spans`` (start, end in code points, end exclusive; p: the largest marginal).

    Each whole text is scored by itself from its text alone.  A null or empty
    text has no spans and the score of a text without toxic tokens.  Columns
    of the input with these names are replaced.
    """
    docs = docs.drop(score, spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its features are bounded by the training sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in chunks(whole, text, TOGETHER):
                data, at = view(batch.column(batch.schema.get_field_index(text)))
                s, e, first = runs(data, at, LETTER)
                odds = m.odds(features(data, s, e, first), first)
                scores = _sigmoid(summaries(odds, first) @ m.layer)
                p = _sigmoid(odds)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                hot = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(first, hot, "right") - 1
                new = np.ones(len(hot), bool)
                new[1:] = (np.diff(hot) > 1) | (np.diff(owner) > 0)
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(hot)) - 1 if len(hot) else begin
                zero = points[at[owner[begin]]]
                found = pa.StructArray.from_arrays(
                    [pa.array(points[s[hot[begin]]] - zero), pa.array(points[e[hot[last]]] - zero), pa.array(np.maximum.reduceat(p[hot], begin) if len(hot) else np.zeros(0))],
                    ["start", "end", "p"],
                )
                bounds = np.searchsorted(owner[begin], np.arange(len(batch) + 1)).astype(np.int32)
                columns = [*batch.columns, pa.array(scores), pa.ListArray.from_arrays(pa.array(bounds), found)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, score, spans])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(spans, _SPANS)])
    return docs.mapInArrow(work, schema)


def score(docs: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``row_id, score, spans`` of each row; see ``annotate``."""
    plain = docs.select(F.col(row_id).alias("__id"), F.col(text).alias("__text"))
    return annotate(plain, model, "__text", "score", "spans").select(F.col("__id").alias(row_id), "score", "spans")


def held_out(row_id: str = "doc_id") -> Column:
    """Whether a row is kept from training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit(""))) % 5 == 0
