"""Shards of near-equal bytes by histogram sort.

Rows get a key of three longs: the hash of the text, the hash of the id and a
row number that is fixed by writing the key table first.  The driver looks for
splitters that cut the key range into as many ranges as there are partitions, a
whole number for each shard: it asks for the exact bytes in equal cells of the
key range, sees between which cell borders (the probes) each splitter must lie,
and asks again for cells inside those only, until the bytes below a probe are
within ``tolerance`` of the wanted share or a single row lies between two
probes.  One round moves at most ``COUNTS`` counts to the driver, however many
rows there are.  Then the rows are exchanged once, each range to its partition.

Copies of a text share the first long and so lie side by side; a group of
copies larger than a range is cut at the second long, repeated rows at the
third, so no group makes a range heavy.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.staging import drop, partitions, stage

#: Most counts that one round brings to the driver, and most ranges.
COUNTS, RANGES = 1 << 18, 1 << 12
#: Bits of the key by which rows look up the splitters near them.
LOOK = 12
_KEY = ("__k0", "__k1", "__k2")
_WORD, _ALL = 64, 192


def _bits(depth: int, n: int) -> Column:
    """Bits [depth, depth + n) of the key, read as 192 bits from the top; ``n`` is below 64."""
    word, bit = divmod(depth, _WORD)
    part = F.shiftrightunsigned(F.shiftleft(F.col(_KEY[word]), bit), _WORD - n)
    over = bit + n - _WORD
    if over > 0:
        part = part.bitwiseOR(F.shiftrightunsigned(F.col(_KEY[word + 1]), _WORD - over))
    return part


def _signed(x: int) -> int:
    return x - (1 << _WORD) if x >> (_WORD - 1) else x


def _words(key: int) -> list[int]:
    """The three longs (signed) of a key."""
    return [_signed((key >> (_WORD * (2 - i))) & ((1 << _WORD) - 1)) for i in range(3)]


def _flip(c: Column) -> Column:
    """Signed order of the result is the unsigned order of ``c``."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a literal, without a Python worker."""
    names = [f.split()[0] for f in schema.split(", ")]
    whole = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(whole), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def _cells(rows: DataFrame, cells: list[int], depth: int) -> DataFrame:
    """Rows whose first ``depth`` key bits are one of ``cells``, whose place in the list is ``cell``."""
    if not depth:
        return rows.withColumn("cell", F.lit(0))
    used = [min(_WORD, max(0, depth - _WORD * i)) for i in range(3)]
    top = [_words(c << (_ALL - depth)) for c in cells]
    names = [f"__c{i}" for i in range(3) if used[i]]
    known = [(k, *(_signed((w[i] % (1 << _WORD)) >> (_WORD - used[i])) for i in range(3) if used[i])) for k, w in enumerate(top)]
    known = _table(rows.sparkSession, known, ", ".join(f"{n} long" for n in ["cell", *names]))  # a row for each open splitter at most
    own = {n: F.shiftrightunsigned(F.col(_KEY[int(n[-1])]), _WORD - used[int(n[-1])]) for n in names}
    return rows.withColumns(own).join(F.broadcast(known), names).drop(*names)


def splitters(keyed: DataFrame, ranges: int, tolerance: float) -> list[int]:
    """Smallest keys of ranges 1, 2, ... (2**192 where there is none); ``keyed`` has the key longs and ``size``."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [total * k / ranges for k in range(1, ranges)]
    slack = tolerance * total / ranges
    found = [1 << _ALL] * len(goals)
    open_ = {k: (0, 0) for k in range(len(goals))}  # splitter -> (its cell, bytes below the cell)
    depth = 0
    while open_ and total:
        cells = sorted({c for c, _ in open_.values()})
        step = min((COUNTS // len(cells)).bit_length() - 1, _WORD // 2, _ALL - depth)
        counts = _cells(keyed, cells, depth).groupBy("cell", _bits(depth, step).alias("digit")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        histogram: dict[int, list[tuple[int, int, int]]] = {c: [] for c in cells}
        for r in counts.collect():  # COUNTS rows at most
            histogram[cells[r["cell"]]].append((r["digit"], r["b"], r["n"]))
        depth += step
        asked: dict[int, list[int]] = {}
        for k, (cell, _) in open_.items():
            asked.setdefault(cell, []).append(k)
        for cell, own in asked.items():
            below, digits = open_[own[0]][1], iter(sorted(histogram[cell]))
            digit, b, n = next(digits)
            for k in sorted(own):  # their goals grow, so one pass serves all
                while below + b < goals[k]:
                    below += b
                    digit, b, n = next(digits)
                at, low, high = (cell << step) + digit, goals[k] - below, below + b - goals[k]
                if n == 1 or min(low, high) <= slack or depth == _ALL:
                    found[k] = (at + (high < low)) << (_ALL - depth)
                    del open_[k]
                else:
                    open_[k] = (at, below)
    return found


def _in_range(keyed: DataFrame, borders: list[int]) -> DataFrame:
    """Add ``__range``, the number of borders at or below the key.

    The first LOOK bits tell the borders of all cells before a row's own; only
    those inside its own cell are compared with the key.
    """
    inside: dict[int, list[int]] = {}
    for b in borders:
        inside.setdefault(min(b >> (_ALL - LOOK), 1 << LOOK), []).append(b)
    rows, before = [], 0
    for cell in range(1 << LOOK):
        near = [_words(b ^ sum(1 << (_WORD * (i + 1) - 1) for i in range(3))) for b in inside.get(cell, [])]
        rows.append((cell, before, [dict(zip("abc", w, strict=True)) for w in near]))
        before += len(inside.get(cell, []))
    look = _table(keyed.sparkSession, rows, "__look long, __before int, __near array<struct<a:long,b:long,c:long>>")
    key = F.struct(*(_flip(F.col(k)).alias(n) for k, n in zip(_KEY, "abc")))
    both = keyed.withColumn("__look", _bits(0, LOOK)).withColumn("__key", key).join(F.broadcast(look), "__look")  # 2**LOOK rows
    reached = F.when(F.size("__near") == 0, F.lit(0)).otherwise(F.size(F.filter("__near", lambda x: x <= F.col("__key"))))
    return both.withColumn("__range", F.col("__before") + reached).drop("__look", "__before", "__near", "__key")


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 1e-4, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Deal rows to ``shards`` shards of near-equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1.  Shards
    differ from an equal share by at most ``tolerance`` of it plus one row.
    Returns ``row_id, size, text_crc32, shard, slot``: slots count from 0
    without gaps in the order of the key.  An empty table gives no rows; rows
    with a null id are rows like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = stage(
        docs.select(
            F.col(row_id).alias("__id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).cast("long").alias("text_crc32"),
            F.xxhash64(body).alias(_KEY[0]),
            F.xxhash64(F.coalesce(F.col(row_id).cast("string"), F.lit("null"))).alias(_KEY[1]),
            F.xxhash64(F.monotonically_increasing_id()).alias(_KEY[2]),
        ),
        "shard-keys",
    )
    each = -(-min(partitions(spark), RANGES) // shards)
    borders = splitters(keyed, shards * each, tolerance)
    dealt = _in_range(keyed, borders).repartitionById(shards * each, F.col("__range"))
    placed = stage(dealt.sortWithinPartitions(*(_flip(F.col(k)) for k in _KEY)).withColumn("__at", F.monotonically_increasing_id()).drop(*_KEY), "shard-rows")
    drop(keyed)
    # A range is one partition, so its rows have numbers in a row; counts of the ranges give each its first slot.
    runs = placed.groupBy("__range").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    shard = F.floor(F.col("__range") / each).cast("int")
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("__range", shard.alias("shard"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))  # RANGES rows at most
    return placed.join(F.broadcast(runs), "__range").select(
        F.col("__id").alias(row_id), "size", "text_crc32", "shard", (F.col("__at") + F.col("__shift")).cast("long").alias("slot")
    )
