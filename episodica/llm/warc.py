"""WARC archives of captures, and their index by external merge.

Writing stays in the JVM.  The table's file splits are the archives' splits: no payload is shuffled unless the table of
repeated payloads is too large to broadcast.  A record ends in two line ends, which is the text writer's separator, so
every task streams its records into archives of some ``ARCHIVE_BYTES``.  Of the captures with equal payloads of at least
``least_bytes`` bytes, the one with the smallest key is a ``response`` and holds the payload; the others are ``revisit``
records that refer to it and hold the HTTP head alone, as the identical-payload profile of WARC 1.1 has it.

Reading parses the archives by their ``Content-Length``, checks each payload against its digest, and sorts what one task
reads by URL key (host reversed, then path and query), time, archive and offset: a run.  The runs are written to the
shared folder once.  Ranges of that whole key, which no two records share, deal them to the mergers, so that a URL with
a third of all captures is many ranges; each merger takes its slices of all runs through a loser tree.  The ranges one
after another are the captures of every URL in order of time.

Defined cases: a null payload counts as empty and all empty ones are equal; null keys come last and stay null; rows that
are equal in all columns are one response and revisits; a null URL has the empty URL key and no target URI; characters
that a header cannot hold are percent-encoded; null times are the epoch; an empty table gives empty archives and an
empty index; other columns are not read.  Payloads may hold anything, header lines of WARC included.  An archive that
ends within a record, or a payload unlike its digest, is an error that names archive and offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, forget, utf8_size

#: Bytes of an archive, by the mean record; a record is never split.
ARCHIVE_BYTES = 16 << 20
#: Index entries that one merger gets, about.
RANGE_ENTRIES = 20_000
#: Bytes of a record's heads beside its payload, about.
HEAD_BYTES = 600
#: Fixed values of RFC 4648: the digits of numbers to base 32 and the letters that stand for them.
BASE32_DIGITS, BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = "url_key string, captured string, archive string, offset long, length long, url string, record_id string, capture_key string, payload_bytes long, payload_digest string, record_type string, refers_to string"
#: What orders the index; archive and offset make it a whole key.
ORDER = ("url_key", "captured", "archive", "offset")


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``text`` in UTF-8: five hex digits are four of base 32."""
    hexadecimal = F.sha1(F.encode(text, "utf-8"))
    fours = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), BASE32_DIGITS, BASE32_LETTERS)


def header_safe(url: Column) -> Column:
    """``url`` with all but printable ASCII characters percent-encoded."""
    bad = lambda c: c.rlike(r"[^\x21-\x7E]")
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(bad(c), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(bad(url), encoded).otherwise(url)


def _lines(*lines: Column | str) -> Column:
    """Header lines, each with its line end; a null line is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")), F.lit("")) for x in lines])


def write_archives(captures: DataFrame, path: str, key: str, url: str, payload: str, captured: Column, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, compression: str = "none") -> None:
    """Write a WARC record for each row of ``captures``; ``compression`` is the text writer's (of whole archives)."""
    if "Exchange" in captures._jdf.queryExecution().executedPlan().toString():
        captures = durable(captures, "captures")  # places must be the same in both passes
    rows = captures.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        F.date_format(F.to_utc_timestamp(F.coalesce(captured, F.timestamp_seconds(F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumns({"digest": base32_sha1(F.col("payload")), "size": utf8_size(F.col("payload"))})
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "place"))
    known = rows.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("repeated")).agg(first.alias("first"), F.count("*").alias("n"))
    # Joined by broadcast only while its file is small.
    repeated = durable(known.where("n > 1").select("repeated", F.col("first.key").alias("first_key"), F.col("first.place").alias("first_place")), "repeated")
    total = rows.agg(F.count("*"), F.sum("size")).first()
    joined = rows.join(repeated, (F.col("digest") == F.col("repeated")) & (F.col("size") >= least_bytes), "left")

    def identity(place: str, of: str) -> Column:
        return F.concat(F.lit("<urn:capture:"), F.col(place), F.lit(":"), F.coalesce(F.col(of).cast("string"), F.lit("")), F.lit(">"))

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    again = F.col("first_place").isNotNull() & (F.col("first_place") != F.col("place"))
    head = F.concat(_lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", line("Content-Length", F.col("size").cast("string"))), F.lit("\r\n"))
    block = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        _lines(
            "WARC/1.1", line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", identity("place", "key")), line("WARC-Date", F.col("captured")), line("WARC-Target-URI", header_safe(F.col("url"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), F.when(again, line("WARC-Refers-To", identity("first_place", "first_key"))), F.when(again, line("WARC-Profile", F.lit(PROFILE))),
            "Content-Type: application/http; msgtype=response", line("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n"), block,
    )
    most = max(1, archive_bytes // (HEAD_BYTES + (total[1] or 0) // max(total[0], 1)))
    joined.select(record.alias("record")).write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", compression).text(path)
    forget(repeated)


def url_key(url: str) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query; scheme, ``www.``, case of the host and fragment do not count."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return url
    if not parts.hostname:
        return url
    host = parts.hostname.removeprefix("www.")
    port_part = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + port_part + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def records(archive: str, data: bytes | memoryview) -> Iterator[dict]:
    """The index entries of one archive's bytes, in order."""
    data, at, n = memoryview(data), 0, len(data)
    while at < n:
        size, stop = 4096, -1
        while stop < 0:
            window = bytes(data[at : at + size])
            stop = window.find(b"\r\n\r\n")
            if stop < 0 and at + size >= n:
                raise ValueError(f"{archive} ends within the record at {at}")
            size *= 4
        version, *lines = window[:stop].decode("ascii").split("\r\n")
        head = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
        if version != "WARC/1.1" or "content-length" not in head:
            raise ValueError(f"{archive} has no WARC record at {at}")
        begin = at + stop + 4
        end = begin + int(head["content-length"])
        if end + 4 > n or bytes(data[end : end + 4]) != b"\r\n\r\n":
            raise ValueError(f"{archive} ends within the record at {at}")
        body = begin + bytes(data[begin : min(end, begin + 4096)]).index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in bytes(data[begin : body - 4]).decode("ascii").split("\r\n")[1:])
        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        if kind == "response" and (base64.b32encode(hashlib.sha1(data[body:end]).digest()).decode() != digest or end - body != int(http["Content-Length"])):
            raise ValueError(f"{archive} holds a payload unlike its digest at {at}")
        url, refers = head.get("warc-target-uri"), head.get("warc-refers-to")
        yield {
            "url_key": url_key(url or ""), "captured": head["warc-date"], "archive": archive, "offset": at, "length": end + 4 - at, "url": url, "record_id": head["warc-record-id"],
            "capture_key": _key(head["warc-record-id"]), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": refers and _key(refers),
        }
        at = end + 4


def _key(identity: str) -> str | None:
    return identity[:-1].split(":", 3)[3] or None


def sorted_runs(spark, path: str) -> DataFrame:
    """Index entries of all archives under ``path`` with ``run``; a run's entries stand together and in order."""
    schema = T.StructType([T.StructField("run", T.LongType()), *T._parse_datatype_string(ENTRY).fields])
    names = [f.name for f in schema.fields][1:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            found = []
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_buffer()
                found += records(name.as_py(), gzip.decompress(data) if name.as_py().endswith(".gz") else data)
            found.sort(key=lambda e: tuple(e[c] for c in ORDER))
            for part in range(0, len(found), 10_000):
                rows = found[part : part + 10_000]
                arrays = [pa.array([e[c] for e in rows], pa.int64() if c in ("offset", "length", "payload_bytes") else pa.string()) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows), pa.int64()), *arrays], names=["run", *names])
            run += 1

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(read, schema)


#: Comes after every key.
_OVER = (1,)


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The items of sorted ``runs`` in order, by a tournament tree whose inner nodes remember the loser.

    Each item costs one comparison a level on the way from its run's leaf to the root; of equal items that of the earlier
    run comes first.
    """
    k = len(runs)
    streams = [iter(r) for r in runs]
    head = [((0, x, i) if (x := next(s, None)) is not None else _OVER) for i, s in enumerate(streams)]
    loser, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if head[a] <= head[b] else (b, a)
    champion = winner[1] if k else None
    while k and head[champion] is not _OVER:
        yield head[champion][1]
        x = next(streams[champion], None)
        head[champion] = (0, x, champion) if x is not None else _OVER
        node = (k + champion) // 2
        while node:
            if head[loser[node]] < head[champion]:
                champion, loser[node] = loser[node], champion
            node //= 2


def merge_runs(runs: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """``range``, ``place``, ``within`` (of the URL key in the range) and the entries of ``runs``, in order in and over ranges."""
    entry = [f for f in runs.schema.fields if f.name != "run"]
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("within", T.LongType()), *entry])
    names = [f.name for f in schema.fields]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        slices: dict[int, list[tuple]] = {}
        for i, (run, *key) in enumerate(zip(*(held.column(c).to_pylist() for c in ("run", *ORDER)), strict=True)):
            slices.setdefault(run, []).append((*key, i))
        for s in slices.values():
            s.sort()  # linear where the exchange kept the run's order, right where it did not
        held = held.take(pa.array([x[-1] for x in merged(list(slices.values()))]))
        within, last, number = [], None, 0
        for k in held.column("url_key").to_pylist():
            last, number = k, number + 1 if k == last else 1
            within.append(number)
        added = [pa.array([TaskContext.get().partitionId()] * len(held), pa.int32()), pa.array(range(len(held)), pa.int64()), pa.array(within, pa.int64())]
        out = pa.table([*added, *(held.column(f.name) for f in entry)], names=names)
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    n = max(1, -(-runs.count() // range_entries))
    return runs.repartitionByRange(n, *ORDER).mapInArrow(merge, schema)


def read_index(spark, path: str, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """The globally ordered index of the archives under ``path``; reading is done once, into the shared folder."""
    return merge_runs(durable(sorted_runs(spark, path), "runs"), range_entries)


def histories(index: DataFrame) -> DataFrame:
    """``index`` with ``capture``, the number of each capture within its URL key by time.

    A URL that goes on over several ranges takes what stands in those before; only the key that a range begins with can,
    so that the window below and what is joined have at most a row or two for each range.
    """
    index = durable(index, "index")
    begins = index.where("place = 0").select(F.col("range").alias("of"), F.col("url_key").alias("begin"))
    counts = index.groupBy("range", "url_key").agg(F.count("*").alias("n")).join(begins.select(F.col("begin").alias("url_key")).distinct(), "url_key", "left_semi")
    before = F.sum("n").over(Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = begins.join(counts.select(F.col("range").alias("of"), F.col("url_key").alias("begin"), before.alias("before")), ["of", "begin"])
    out = index.join(offsets, (F.col("range") == F.col("of")) & (F.col("url_key") == F.col("begin")), "left")
    return out.select(*[c for c in index.columns if c != "within"], (F.col("within") + F.coalesce("before", F.lit(0))).alias("capture"))
