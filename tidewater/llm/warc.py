"""WARC archives: pages written as records, and records read back by boundary-chain verification.

Writing.  Spark's text writer puts out one record a row, with the blank lines that end a record as its
line separator, so any file system that Spark knows will do, and a task that is tried again leaves nothing behind.
A page is a ``response`` with an HTTP header and the payload, or, if a page with a smaller id has the same payload,
a ``revisit`` that names that page's record and has the HTTP header only.

Reading.  Files are cut into ranges of bytes.  What looks like the start of a record may as well stand in a payload,
so no task can tell alone:

1. Each task searches its range for the magic of a record and, where a whole record header follows, emits a
   candidate: its offset, and that of its successor, where the record says that it ends.
2. Only the chain of successors from the start of a file consists of records.  In its range a task follows
   the chain of each candidate to the first offset outside; of these links between ranges those that
   can be reached from the start are found by pointer jumping: links double in length in each round, so a file of n ranges
   takes log2(n) joins.
3. Each range that the chain enters, at one offset, is read again from there, record by record.

Magic inside a payload is passed over, as the chain steps over payloads.  A chain that doesn't end at its file's
end tells of a damaged file: an error, or with ``strict=False`` what comes before the damage.

Cases: a null payload counts as empty; empty payloads are equal like others.  Of rows that have one payload and all the smallest id, each is a
response; a row without an id revisits any page of its payload that has one, and is a response if none has.  Payloads are of any length; one is held at a time, whole.  Control characters
in an address are written as percent signs and digits; a null address is left out.  An empty table gives no records.
Columns other than id, address and payload aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.llm.arrow import column, map_arrow
from tidewater.plans.joins import broadcast_if_small
from tidewater.plans.storage import materialize, scratch, shared_folder

#: Fixed values of the format.
VERSION, END = "WARC/1.0", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 0
#: Bytes of a file that one task searches, and that it reads at a time beyond.
RANGE, _STEP = 8 << 20, 1 << 16
#: Payload bytes that a task gives out together.
_TOGETHER = 4_000_000
_MAGIC = re.compile(rb"WARC/\d\.\d\r\n")
_LINE = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]+[ \t]*:[^\r\n]*(?:\r\n[ \t][^\r\n]*)*")
#: Writes a table that is gone when the operator ends.
Keep = Callable[[DataFrame, str], DataFrame]


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in 32 characters of base 32."""
    digits = F.sha1(payload)
    out = []
    for k in range(0, 40, 10):
        part = F.conv(F.substring(digits, k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(part, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*out)


def _page(key: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), digest, F.lit(">"))


def _header(*lines: tuple[str, Column]) -> Column:
    """Lines of a header, without those of null values, and the blank line after it."""
    return F.concat(F.concat_ws("\r\n", *(F.concat(F.lit(name), value) for name, value in lines)), F.lit(END))


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = LEAST_BYTES, date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write ``pages`` to archives in the folder ``path``, a record a row, with ``date`` as the time of the capture."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    size = F.octet_length(body)
    slim = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("body"))
    # Payloads are the same if length, SHA-1 and another hash are.
    same = [F.octet_length("body").alias("size"), base32_sha1(F.col("body").cast("binary")).alias("digest"), F.xxhash64("body").alias("other")]
    with scratch(pages.sparkSession) as keep:
        groups = slim.where(F.octet_length("body") >= least_bytes).select("id", *same).groupBy("size", "digest", "other")
        groups = groups.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")
        groups = keep(groups.select("size", "digest", "other", "first"), "payloads")
        rows = slim.select("*", *same).join(broadcast_if_small(groups), ["size", "digest", "other"], "left")
        again = (F.col("first") < F.col("id")) | (F.col("first").isNotNull() & F.col("id").isNull())
        first = F.when(again, F.col("first"))
        rows = rows.select("id", "url", "body", "size", "digest", first.alias("first"))
        again = F.col("first").isNotNull()
        http = _header(
            ("", F.lit("HTTP/1.1 200 OK")), ("Content-Type: ", F.lit("text/html; charset=utf-8")), ("Content-Length: ", F.col("size").cast("string"))
        )
        block = F.concat(http, F.when(again, "").otherwise(F.col("body")))
        control = F.regexp_replace("url", "[\x00-\x20\x7f]+", " ")
        safe = F.when(F.col("url").rlike("[\x00-\x20\x7f]"), F.replace(F.url_encode(control), F.lit("+"), F.lit("%20"))).otherwise(F.col("url"))
        record = F.concat(
            _header(
                ("", F.lit(VERSION)), ("WARC-Type: ", F.when(again, "revisit").otherwise("response")),
                ("WARC-Record-ID: ", _page(F.col("id"), F.col("digest"))), ("WARC-Date: ", F.lit(date)), ("WARC-Target-URI: ", safe),
                ("WARC-Payload-Digest: sha1:", F.col("digest")), ("WARC-Profile: ", F.when(again, PROFILE)),
                ("WARC-Refers-To: ", F.when(again, _page(F.col("first"), F.col("digest")))),
                ("Content-Type: ", F.lit("application/http; msgtype=response")), ("Content-Length: ", F.octet_length(block).cast("string")),
            ),
            block,
        )
        rows.select(record.alias("value")).write.option("lineSep", END).mode("error").text(path)


class _File:
    """Bytes of a file by their offsets."""

    def __init__(self, path: str, size: int):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
        self.file, self.size = system.open_input_file(place), size

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_: Any) -> None:
        self.file.close()


def _fields(file: _File, data: bytes, base: int, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of the header at an offset and where its block begins; None if no whole header is there.

    ``data`` are the file's bytes from ``base`` on; more are read where the header goes on behind them.
    """
    def line_at(place: int) -> tuple[bytes, int] | None:
        nonlocal data
        while True:
            end = data.find(b"\r\n", place - base)
            if end >= 0 and (end + 2 < len(data) or base + len(data) >= file.size):
                return data[place - base : end], base + end + 2
            more = file.read(base + len(data), _STEP)
            if not more:
                return None
            data += more

    found: dict[str, str] = {}
    line = line_at(at)
    name = ""
    while line:
        text, at = line
        if not _MAGIC.match(text + b"\r\n") or found:
            if not text:
                length = found.get("content-length", "")
                return (found, at) if length.isascii() and length.isdigit() else None
            if text[:1] in b" \t" and name:
                found[name] += " " + text.strip().decode("utf-8", "replace")
            elif _LINE.fullmatch(text):
                key, _, value = text.partition(b":")
                name = key.strip().decode().lower()
                found[name] = value.strip().decode("utf-8", "replace")
            else:
                return None
        line = line_at(at)
    return None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, start, next, leaves`` of what looks like a record: its successor, and where its chain leaves the range."""
    for batch in batches:
        for path, size, low, high in zip(*(column(batch, c).to_pylist() for c in ("path", "size", "low", "high"))):
            with _File(path, size) as file:
                data = file.read(low, high - low + 16)
                starts, after = [], []
                for match in _MAGIC.finditer(data):
                    if match.start() >= high - low:
                        break
                    at = low + match.start()
                    if header := _fields(file, data[match.start() : match.start() + _STEP], at, at):
                        starts.append(at)
                        after.append(header[1] + int(header[0]["content-length"]) + len(END))
            leaves: dict[int, int] = {}
            for at, then in zip(reversed(starts), reversed(after)):
                leaves[at] = leaves.get(then, then)
            ends = [leaves[at] for at in starts]
            # The successor of a forged record may lie anywhere; no file is so long.
            columns = [[path] * len(starts), starts, [min(x, 2**62) for x in after], [min(x, 2**62) for x in ends]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "start", "next", "leaves"])


def _reachable(links: DataFrame, keep: Keep) -> DataFrame:
    """``path, start`` of all candidates that the chain from offset 0 enters a range at; ``links`` has ``path, start, leaves``."""
    # Only what a link leads to, or the start of a file, can be entered.
    targets = links.select("path", F.col("leaves").alias("start")).distinct()
    entries = links.join(targets, ["path", "start"], "left_semi").union(links.where("start = 0"))
    jumps = keep(entries.select("path", F.col("start").alias("a"), F.col("leaves").alias("b")).distinct(), "jumps")
    found = keep(jumps.where("a = 0").select("path", "a"), "reached")
    nodes = jumps.select("path", F.col("a").alias("b"))
    jumps = keep(jumps.join(nodes, ["path", "b"], "left_semi").select("path", "a", "b"), "jumps")
    while jumps.limit(1).count():
        found = keep(found.union(found.join(jumps, ["path", "a"]).select("path", F.col("b").alias("a"))).distinct(), "reached")
        onward = jumps.select("path", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = keep(jumps.join(onward, ["path", "b"]).select("path", "a", F.col("c").alias("b")), "jumps")
    return found.withColumnRenamed("a", "start")


_RECORD = "path string, start long, headers map<string, string>, http map<string, string>, payload binary"


def _parts(block: bytes, kind: str) -> tuple[dict[str, str], bytes]:
    """The HTTP header, if the block has one, and the payload."""
    if not kind.lower().startswith("application/http"):
        return {}, block
    header, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in header.split(b"\r\n")[1:])
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}, payload


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of ranges, from where the chain enters each."""
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["path", "start", "headers", "http", "payload"]
    for batch in batches:
        for path, size, at, high in zip(*(column(batch, c).to_pylist() for c in ("path", "size", "start", "high"))):
            rows: list[tuple] = []
            held = 0
            with _File(path, size) as file:
                data, base = b"", at
                while at < high:
                    if at - base + _STEP > len(data) and base + len(data) < size:
                        data, base = file.read(at, max(_STEP, _TOGETHER // 4)), at
                    header = _fields(file, data[at - base : at - base + _STEP], at, at)
                    if header is None:
                        break  # a damaged file
                    fields, begin = header
                    end = begin + int(fields["content-length"])
                    block = data[begin - base : end - base] if end <= base + len(data) else file.read(begin, end - begin)
                    if len(block) < end - begin:
                        break
                    http, payload = _parts(block, fields.get("content-type", ""))
                    rows.append((path, at, fields, http, payload))
                    held += len(payload) + 500
                    at = end + len(END)
                    if held > _TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _ranges(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``path, size, low, high`` of all ranges of the folder's files; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(width).cast("long"))).alias("low"))
    return ranges.select("path", "size", "low", F.least(F.col("low") + width, F.col("size")).alias("high"))


def read_warc(spark: SparkSession, path: str, strict: bool = True, width: int = RANGE) -> DataFrame:
    """``path, start, headers, http, payload`` of each record of the archives in a folder; names of headers are in lower case.

    What a revisit's payload was is in its headers: its digest, the record that has it, and its length.
    """
    with scratch(spark) as keep:
        ranges = keep(_ranges(spark, path, width), "ranges")
        tasks = max(1, min(ranges.count(), 32 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        spread = ranges.repartition(tasks, "path", "low")
        found = keep(map_arrow(spread, _candidates, "path string, start long, next long, leaves long"), "candidates")
        entered = keep(_reachable(found.select("path", "start", "leaves"), keep), "entered")
        if strict:
            # The last link of a sound file leads to its end.
            last = found.join(entered, ["path", "start"]).select("path", F.col("leaves").alias("size"))
            broken = ranges.select("path", "size").distinct().join(last, ["path", "size"], "left_anti").limit(1).collect()
            if broken:
                raise ValueError(f"the chain of records breaks off in {broken[0]['path']}")
        entered = entered.withColumn("low", F.expr(f"start div {width} * {width}"))
        at = materialize(ranges.join(entered, ["path", "low"]).select("path", "size", "start", "high"), "entries")
    return map_arrow(at.repartition(tasks, "path", "start"), _records, _RECORD)


def page_report(pages: DataFrame, **options) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: pages written to archives and read back.

    The digest of a response is that of the payload as read, that of a revisit the one that its record states.
    """
    spark = pages.sparkSession
    # The archive stays for as long as the result may be read.
    import uuid

    path = f"{shared_folder(spark)}/tidewater/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    records = read_warc(spark, path)
    revisit = F.col("headers")["warc-type"] == "revisit"

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(F.col("headers")[name], "^<urn:page:([^:]+):", 1), F.lit("-")).cast("long")

    digest = F.when(revisit, F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).otherwise(base32_sha1(F.col("payload")))
    size = F.when(revisit, F.col("http")["content-length"].cast("long")).otherwise(F.octet_length("payload").cast("long"))
    return records.select(
        page("warc-record-id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"), F.when(revisit, page("warc-refers-to")).alias("refers_to"),
    )
