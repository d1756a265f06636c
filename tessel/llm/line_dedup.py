"""Frequent-line removal over levelled sorted runs of line hashes.

Documents come in batches.  A batch is reduced to (line hash, documents that
have the line), dealt into the buckets that all runs share and anti-joined,
hash order against hash order, with the run of lines already known to be
frequent; those need no more counting.  The rest becomes a sorted run at level
0.  Where a level has a run already, the two are merged, bucket by bucket, into
one run of the next level, their counts added up.  After the last batch all
runs are merged, and every line that reached ``min_docs`` is frequent.

Runs are bucketed tables, so a batch is exchanged once and merging needs no
exchange at all.  Only built-in DataFrame functions are used.  What is shuffled
of a line is its hash and place; a line in a third of all documents costs a
count per task.  All steps on one text are linear in its length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.staging import drop, partitions, shared_dir, stage

#: ``[\x20\x09-\x0D]``, the white space taken off both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]
_ROW = ["__tessel_id", "__tessel_text"]
#: Columns that the operator adds; columns of the input with these names are replaced.
ADDED = ("n_lines", "n_dropped", "kept")


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    key = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(key) == F.char_length(key)  # all ASCII, where lower() is right and fast
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row, also where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(lines: Column, gone: Column) -> Column:
    """The elements of an array but those at the sorted places ``gone``: what lies between them, put together."""

    def between(at: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(at) - 1)
        return _bound(lines, lambda x: F.flatten(F.transform(starts, lambda i: F.slice(x, F.get(at, i - 1) + 2, F.get(at, i) - F.get(at, i - 1) - 1))))

    return _bound(F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines))), between)


class LineRuns:
    """Document counts of line hashes, kept as sorted runs, one in each level at most."""

    def __init__(self, spark: SparkSession, min_docs: int) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.buckets = partitions(spark)
        self.levels: list[DataFrame | None] = []
        self.frequent: DataFrame | None = None

    def _run(self, counts: DataFrame, label: str) -> DataFrame:
        """Write a sorted run: a bucketed table in the shared folder."""
        name = f"tessel_{label}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        counts.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        run = self.spark.table(name)
        run._run_name, run._staged_path = name, path
        return run

    def _free(self, *runs: DataFrame | None) -> None:
        for run in runs:
            if run is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS {run._run_name}")
                drop(run)

    def add(self, hashes: DataFrame) -> None:
        """Add a batch: one row (h1, h2) for each document and different line."""
        counts = hashes.groupBy(*_HASH).agg(F.count("*").alias("docs"))
        if self.frequent is not None:
            # An anti join by name would be moved below the counting, and all rows of a hot line into one task.
            known = self.frequent.withColumn("known", F.lit(True)).hint("merge")
            counts = counts.join(known, _HASH, "left").where(F.col("known").isNull()).drop("known")
        self._put(self._run(counts, "run"))

    def _put(self, run: DataFrame) -> None:
        for level, other in enumerate(self.levels):
            if other is None:
                self.levels[level] = run
                return
            self.levels[level] = None
            run = self._merge(other, run)
        self.levels.append(run)

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Merge two runs; lines that are frequent by now go to the frequent run."""
        merged = a.hint("merge").join(b.withColumnRenamed("docs", "more"), _HASH, "full")
        merged = merged.select(*_HASH, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        rest = self._run(merged.where(F.col("docs") < self.min_docs), "run")
        self._enough(merged)
        self._free(a, b)
        return rest

    def _enough(self, counts: DataFrame) -> None:
        enough, old = counts.where(F.col("docs") >= self.min_docs).select(*_HASH), self.frequent
        if old is not None:
            enough = old.hint("merge").join(enough, _HASH, "full")
        self.frequent = self._run(enough, "frequent")
        self._free(old)

    def finish(self) -> DataFrame:
        """Merge everything; the run of frequent lines (h1, h2)."""
        left = [r for r in self.levels if r is not None]
        while len(left) > 1:
            left.append(self._merge(left.pop(0), left.pop(0)))
        for only in left:  # a lone batch has met no other
            self._enough(only)
        self._free(*left)
        self.levels = []
        return self.frequent


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with lines found in ``min_docs`` or more documents taken out.

    Adds ``n_lines`` (before), ``n_dropped`` and ``kept`` (the other lines,
    joined by newlines); all columns but those of these names stay as they
    are.  A null or empty text is one empty line; a key under ``min_chars``
    code points never counts as frequent, so empty lines stay.  Each row
    counts as a document, so repeated rows count each time, and all of them
    stay.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    row = dict(zip(_ROW, (F.xxhash64(F.coalesce(F.col(row_id).cast("string"), F.lit("null"))), F.xxhash64(body)), strict=True))
    # Hashed before the lines are taken apart; in one select the hashes would be worked out for each line.
    lines = docs.select(*(c.alias(n) for n, c in row.items()), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    lines = lines.select(*_ROW, "row", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    key = lines.select(*_ROW, "row", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    found = stage(
        key.select(*_ROW, "row", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), F.pmod(_ROW[1], F.lit(batches)).cast("int").alias("__batch")),
        "line-hashes",
        "__batch",
    )
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(found.where(F.col("__batch") == b).select("row", *_HASH).distinct())
    # Read as plain files: without the buckets' fixed dealing, a join may split what one hot line brings.
    last = runs.finish()
    frequent = spark.read.schema("h1 long, h2 long").parquet(last._staged_path)
    spark.sql(f"DROP TABLE {last._run_name}")  # its files stay
    gone = found.join(frequent, _HASH, "left_semi").groupBy(*_ROW).agg(F.sort_array(F.collect_set("place")).alias("__tessel_gone"))
    n = F.size(_lines(F.col(text)))
    rest = F.when(F.col("__tessel_gone").isNull(), body).otherwise(F.array_join(_without(_lines(F.col(text)), F.col("__tessel_gone")), "\n"))
    return docs.withColumns(row).join(gone, _ROW, "left").select(
        *(F.col(c) for c in docs.columns if c not in ADDED),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__tessel_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        rest.alias("kept"),
    )
