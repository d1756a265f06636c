"""WARC records, and the resolution of not-modified revisits.

A revisit holds no page: the server said that the page is as before.  It is
joined to the latest earlier full response of the same canonical URL.  The
validators must agree (the entity tag if the revisit has one, else the
modification date), and the response's headers are brought up to date with
those of the revisit, but for the ones that describe the body or the
connection, as RFC 9111, section 3.2 asks.

The join sorts all records by URL and time into ranges.  Each range looks back
within itself; what lies before it comes from one row for each URL and range.
A URL with a third of all records thus spans many ranges and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.staging import partitions, stage

#: Headers of a not-modified response that don't replace stored ones.
KEPT = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that name a campaign or session, not a page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path of a URL: no scheme, fragment, default port, leading ``www.``, tracking parameters or last slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    joined = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def _header_lines(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and last:  # a folded line
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().lower().decode("utf-8", "replace")
            text = value.strip().decode("utf-8", "replace")
            out[last] = f"{out[last]}, {text}" if last in out else text
    return out


def _next_record(raw: bytes, at: int) -> int:
    """Where the next line that begins with ``WARC/`` starts, from ``at`` on; -1 if there is none."""
    if raw[at : at + 5] == b"WARC/" and (at == 0 or raw[at - 1 : at] == b"\n"):
        return at
    found = raw.find(b"\nWARC/", at)
    return found + 1 if found >= 0 else -1


def parse_warc(raw: bytes) -> Iterator[dict]:
    """Records of uncompressed WARC bytes.

    A torn record, or one with a bad length, is left out, and reading goes on
    at the next line that begins a record.
    """
    at = _next_record(raw, 0)
    while at >= 0:
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        head = _header_lines(raw[at:stop].split(b"\r\n")[1:])
        length = head.get("content-length", "")
        block = raw[stop + 4 : stop + 4 + int(length)] if length.isdecimal() and length.isascii() else None
        end = stop + 4 + len(block) if block is not None else -1
        if block is None or len(block) < int(length) or raw[end : end + 4].strip(b"\r\n"):
            at = _next_record(raw, at + 5)
            continue
        at = _next_record(raw, end)
        http, _, body = block.partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        code = status.split(b" ")[1:2]
        try:
            when = int(datetime.fromisoformat(head.get("warc-date", "").replace("Z", "+00:00")).astimezone(UTC).timestamp())
        except ValueError:
            when = None
        yield {
            "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "url": head.get("warc-target-uri"), "time": when,
            "status": int(code[0]) if code and code[0].isdigit() else None, "headers": list(_header_lines(lines).items()), "body": body,
        }


RECORD = "record_id string, type string, url string, time long, status int, headers map<string,string>, body binary"
_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("time", pa.int64()), ("status", pa.int32()),
    ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()),
])


def read_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Records in a binary column of WARC bytes; null or foreign bytes give none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = list(parse_warc(value.as_py() or b""))
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return raw.select(F.col(column).cast("binary").alias("__raw")).mapInArrow(work, RECORD)


def write_record(kind: Column, record_id: Column, url: Column, time: Column, status: str, headers: list[tuple[str, Column]], body: Column) -> Column:
    """WARC bytes (as text) of one record; headers whose value is null are left out."""
    line = "\r\n"
    http = F.concat(
        F.lit(f"HTTP/1.1 {status}{line}"),
        *(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(line)), F.lit("")) for name, value in headers),
        F.lit(line), body,
    )
    date = F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), kind, F.lit(f"{line}WARC-Record-ID: "), record_id,
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{line}WARC-Date: "), date, F.lit(f"{line}Content-Type: application/http;msgtype=response{line}Content-Length: "),
        F.octet_length(http).cast("string"), F.lit(line + line), http, F.lit(line + line),
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve the revisits among ``records`` (see ``RECORD``; ``body`` isn't read).

    Returns one row for each revisit: ``record_id, url, time, resolution,
    response_id, response_time, headers``.  ``resolution`` is ``resolved``,
    ``unchecked`` (the revisit has no validator), ``validator_mismatch``,
    ``no_earlier_response`` or ``no_url``; the merged headers are given for the
    first two, else the revisit's own.  Full responses are responses with a
    status of 200 to 299.  A response of the same second is not earlier; of
    several at one time the greatest record id counts, and of several with one
    id the one whose headers have the greatest hash.  Repeated revisits are
    each resolved with their own headers; repeated responses count once.  A
    null time resolves to nothing.  No records give no rows; other columns are
    ignored.
    """
    spark = records.sparkSession
    h = F.col("headers")
    full = F.coalesce((F.col("type") == "response") & F.col("status").between(200, 299), F.lit(False))
    events = records.where(full | (F.col("type") == "revisit")).select(
        "record_id", "url", "time", full.alias("full"), canonical_url(F.col("url")).alias("canon"),
        F.regexp_replace(h["etag"], "^W/", "").alias("etag"), h["last-modified"].alias("modified"), "headers",
        # Records may share an id: with it, this names their headers.
        F.coalesce(F.xxhash64(F.array_sort(F.map_entries(h))), F.lit(0)).alias("mark"),
    )
    keys = ["canon", "time", "full", "record_id", "mark"]
    sorted_ = events.drop("headers").repartitionByRange(partitions(spark), *keys)
    placed = stage(sorted_.withColumn("range", F.spark_partition_id()), "warc-events")
    answer = F.struct("time", "record_id", "mark", "etag", "modified")
    order = Window.partitionBy("canon", "range").orderBy("time", "full", "record_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("full"), answer), ignorenulls=True).over(order)
    heads = placed.groupBy("canon", "range").agg(F.max(F.when(F.col("full"), answer)).alias("head"))
    earlier = Window.partitionBy("canon").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("canon").alias("hcanon"), F.col("range").alias("hrange"), F.last("head", ignorenulls=True).over(earlier).alias("far"))
    looked = placed.withColumn("near", near).where(~F.col("full"))
    looked = looked.join(heads, F.col("canon").eqNullSafe(F.col("hcanon")) & (F.col("range") == F.col("hrange")), "left")
    # Only a response with a time, an URL and an earlier time answers.
    found = F.coalesce("near", "far")
    found = F.when(found["time"] < F.col("time"), found)
    looked = looked.select("record_id", "mark", "url", "canon", "time", "etag", "modified", found.alias("r"))
    agreed = F.when(F.col("etag").isNotNull(), F.col("etag").eqNullSafe(F.col("r.etag"))).when(F.col("modified").isNotNull(), F.col("modified").eqNullSafe(F.col("r.modified")))
    resolution = (
        F.when(F.col("canon").isNull(), "no_url").when(F.col("r").isNull(), "no_earlier_response")
        .when(agreed.isNull(), "unchecked").when(agreed, "resolved").otherwise("validator_mismatch")
    )
    looked = looked.withColumn("resolution", resolution).withColumn("good", F.col("resolution").isin("resolved", "unchecked"))
    looked = looked.withColumns({"response_id": F.when(F.col("good"), F.col("r.record_id")), "response_mark": F.when(F.col("good"), F.col("r.mark"))})
    own = events.where(~F.col("full")).groupBy("record_id", "mark").agg(F.first("headers").alias("own"))
    # Written first: a join with the aggregate itself would keep all revisits of one response in one task.
    stored = events.where("full").groupBy(F.col("record_id").alias("response_id"), F.col("mark").alias("response_mark"))
    stored = stage(stored.agg(F.first("headers").alias("stored")), "warc-responses")
    both = looked.join(own, ["record_id", "mark"], "left").join(stored, ["response_id", "response_mark"], "left")
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(
        F.coalesce("stored", empty), F.coalesce("own", empty), lambda k, a, b: F.when(k.isin(*KEPT), a).otherwise(F.coalesce(b, a))
    )
    merged = F.map_filter(merged, lambda k, v: v.isNotNull())
    return both.select(
        "record_id", "url", "time", "resolution", "response_id", F.when(F.col("good"), F.col("r.time")).alias("response_time"),
        F.when(F.col("good"), merged).otherwise(F.col("own")).alias("headers"),
    )
