"""WARC archives of page captures, and their index by an external merge.

Writing: payload digests are grouped, the smallest page id of each repeated payload is found, and every page becomes a
response or a revisit record. Records are text (ASCII headers and UTF-8 payloads), so Spark's text writer with the
record end as line separator makes the files, gzipped as a whole, on any file system.

Reading: each file is parsed by its Content-Length headers and each response's digest is computed from its payload.
The captures of a batch of files, sorted by URL key and time, are one run: a row of arrays, written to the shared
folder. Splitters from regular samples of the runs cut the key space into ranges; each run is cut at the splitters, the
segments of a range meet in one task, and a loser tree merges them. (part, place) numbers the captures in global order.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_path
from .common import col, tasks_for, text_of

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: About as many payload bytes go into one archive file.
FILE_BYTES = 32 << 20
FIELDS = {"url_key": "string", "capture_time": "string", "page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint", "file": "string", "offset": "bigint"}
ARROW = {"string": pa.string(), "bigint": pa.int64()}


def url_key(url: str) -> str:
    """Host parts in reverse order, then port, path and query; the scheme, user, "www." and fragment do not count."""
    match = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)", url)
    if not match:
        return url.split("#")[0]
    host, port, rest = match.groups()
    host = host.lower().removeprefix("www.")
    port = "" if port in (None, ":80", ":443") else port
    return f"{','.join(reversed(host.split('.')))}{port}){rest or '/'}"


def decisions(pages: DataFrame, id_col: str, html: Column, least: int) -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another one."""
    keyed = pages.select(col(pages, id_col).alias("id"), F.octet_length(html).alias("size"), F.sha2(html, 256).alias("digest"))
    large = keyed.where((F.col("size") >= least) & F.col("id").isNotNull()).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return large.join(firsts, "digest").where("id != refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time: Column | None = None, least: int = 100) -> None:
    """Write one record per page below ``path``.

    Of equal payloads of at least ``least`` bytes that with the smallest id is the response; pages with another id
    revisit it. Null html: empty payload. Null url: empty. A null id is written as such, is always a response and is never referred to.
    Repeated rows of the smallest id are responses. ``time``: capture time; by default seconds from the id.
    Control characters and blanks of a url are written as %XX. Other columns are ignored.
    """
    html = text_of(pages, html_col)
    revisits = decisions(pages, id_col, html, least)
    stamp = time if time is not None else F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce(col(pages, id_col), F.lit(0)).cast("bigint"), F.lit(100_000_000)))
    url = text_of(pages, url_col)
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(col(pages, id_col).alias("id"), url.alias("url"), html.alias("html"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")).withColumn("digest", F.sha2("html", 256))
    rows = rows.join(revisits, ["id", "digest"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda head, value: F.concat(F.lit(f"{head}: "), value, F.lit("\r\n"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", name("id")), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.col("time")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), F.when(again, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 1.0
    writer = rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / max(mean, 1.0))))
    writer.text(path)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        yield at, headers, data[begin:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has another length")
        at = end + 4


def page_name(value: str) -> int | None:
    found = value.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def capture(file: str, offset: int, headers: dict[str, str], block: bytes) -> tuple:
    """One row of ``FIELDS``; a response's digest and size come from its payload, a revisit's from its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["WARC-Type"]
    claimed = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != claimed or size != len(payload):
            raise ValueError(f"the payload at {offset} of {file} is damaged")
    refers = headers.get("WARC-Refers-To")
    return url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], page_name(headers["WARC-Record-ID"]), size, claimed, kind, page_name(refers) if refers else None, file, offset


def rank(row: tuple) -> tuple:
    """Order of captures: URL key, time, page id (null last), file, offset."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges sorted runs: every inner node holds the loser of its match, so a new head meets one node per level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.next = runs, [1] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        #: Heads with their order; a run that has ended (or pads the tree) loses every match.
        self.heads = [(0, rank(r[0])) if r else (1, ()) for r in runs] + [(1, ())] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self.heads[b] < self.heads[a]:
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1]

    def __iter__(self) -> Iterator[tuple]:
        while self.heads and self.heads[self.winner][0] == 0:
            run = self.winner
            at = self.next[run]
            yield self.runs[run][at - 1]
            self.next[run] = at + 1
            self.heads[run] = (0, rank(self.runs[run][at])) if at < len(self.runs[run]) else (1, ())
            node = (run + self.size) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[run]:
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def arrays(rows: list[tuple]) -> list[pa.Array]:
    """The rows as one array of lists with one element, for each field."""
    return [pa.array([[r[i] for r in rows]], pa.list_(ARROW[kind])) for i, kind in enumerate(FIELDS.values())]


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch of files: its captures in order, as arrays."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = zlib.decompress(content.as_buffer(), wbits=31) if file.endswith(".gz") else content.as_py()
                name = file.rsplit("/", 1)[-1]
                found += [capture(name, offset, headers, block) for offset, headers, block in records(data)]
            if found:
                found.sort(key=rank)
                yield pa.RecordBatch.from_arrays(arrays(found), list(FIELDS))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ", ".join(f"{f} array<{kind}>" for f, kind in FIELDS.items()))


def capture_index(spark: SparkSession, path: str, samples: int = 32) -> DataFrame:
    """All captures of the archives below ``path`` with part and place, their number in global order.

    Ranges are cut by (URL key, time, page id), so one URL with most captures is cut as well. ``samples``: how many
    keys for each range come to the driver.
    """
    runs = materialize(sorted_runs(spark, path), "runs")
    ranges = tasks_for(runs)
    step = F.greatest(F.lit(1), F.floor(F.size("url_key") / samples)).cast("int")
    places = F.sequence(F.lit(1), F.size("url_key"), step)
    keys = runs.select(F.explode(F.transform(places, lambda i: F.struct(F.element_at("url_key", i).alias("k"), F.element_at("capture_time", i).alias("t"), F.element_at("page_id", i).alias("p")))).alias("s")).select("s.*")
    chosen = sorted((r["k"], r["t"], r["p"] is None, r["p"] or 0) for r in keys.orderBy(F.xxhash64("k", "t", "p")).limit(samples * ranges).collect())
    splitters = [chosen[i * len(chosen) // ranges] for i in range(1, ranges)] if chosen else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(batch.column(f).to_pylist() for f in FIELDS)):
                rows = list(zip(*values))
                order = [rank(r)[:4] for r in rows]
                edges = [0, *(bisect.bisect_left(order, s) for s in splitters), len(rows)]
                for part, (a, b) in enumerate(zip(edges, edges[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *arrays(rows[a:b])], ["part", *FIELDS])

    segments = runs.mapInArrow(cut, "part int, " + ", ".join(f"{f} array<{kind}>" for f, kind in FIELDS.items()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def merged() -> pa.RecordBatch:
            rows = list(LoserTree(held))
            fields = [pa.array([r[i] for r in rows], ARROW[kind]) for i, kind in enumerate(FIELDS.values())]
            return pa.RecordBatch.from_arrays([*fields, pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())], [*FIELDS, "part", "place"])

        for batch in batches:
            for now, *values in zip(*(batch.column(f).to_pylist() for f in ("part", *FIELDS))):
                if now != part and held:
                    yield merged()
                    held = []
                part = now
                held.append(list(zip(*values)))
        if held:
            yield merged()

    schema = ", ".join(f"{f} {kind}" for f, kind in FIELDS.items()) + ", part int, place bigint"
    return segments.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(merge, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Write the pages as archives into the shared folder, read them back and return the merged index (see the functions above)."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, id_col, url_col, html_col, least=least)
    return capture_index(pages.sparkSession, path)
