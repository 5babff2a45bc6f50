"""WARC archives and an index of their captures merged from locally sorted runs.

Archives are written and read by Spark's own writers and readers, so they may lie in any store that Spark reaches.
Each archive's captures are one run, sorted where the archive is read. Runs are cut at common splitters of (URL key,
timestamp, page), so that the same range of every run meets in one task, and a loser tree merges the pieces there.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import scratch_path, workers_can_import, written

#: Payloads of at least so many bytes are stored once; smaller ones in every record.
REVISIT_BYTES = 1000
#: Bytes of payload that an archive is meant to hold.
ARCHIVE_BYTES = 8 << 20
#: Entries that a range of the merged index is meant to hold.
RANGE_ROWS = 100_000

CRLF = "\r\n"


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, so a new entry of the winning run is
    compared only along its path to the root."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = len(runs)
        self.losers = [-1] * max(1, self.k)
        self.winner = -1
        for i in range(self.k):
            self._enter(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._enter(run)


def url_key(url: Column) -> Column:
    """Sortable key of a URL: the host's labels reversed, then path and query; no scheme, port, user, fragment or
    leading ``www``; lower case. A null URL has the empty key."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://|#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r"^.*@|:\d*$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    rest = F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def escaped(url: Column) -> Column:
    """A URL that fits on one header line: percent signs, controls and spaces are percent-encoded."""
    out = F.coalesce(url, F.lit(""))
    for c in ("%", "\r", "\n", "\t", " "):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page with its payload, digest, and the page whose response it revisits.

    The winner of equal payloads is found on digests alone; payloads are shuffled once, to their group's winner."""
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "same": F.sha2("html", 256)})
    large = F.col("size") >= REVISIT_BYTES
    winners = (
        rows.where(large).groupBy("same").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("same").alias("s"), "first")
    )
    joined = rows.join(winners, F.col("same") == F.col("s"), "left")
    return joined.select("page", "url", "html", "size", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))


def record(refers: Column) -> Column:
    """A page's WARC record as text, without the line end that closes it. A revisit has no payload of its own; its
    headers tell the whole payload's digest and length."""
    # the crawl has no times of its own: a page is captured as many seconds after the epoch as its id says
    date = F.date_format(F.timestamp_seconds(F.coalesce(F.abs(F.col("page")), F.lit(0)) % 250_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    page = F.coalesce(F.col("page").cast("string"), F.lit("null"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(refers.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), escaped(F.col("url"))),
        F.when(F.col("url").isNull(), F.lit("X-Null-URI: 1")),
        F.concat(F.lit("X-URL-Key: "), escaped(url_key(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.sha1(F.col("html").cast("binary"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">")),
        F.when(refers.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(refers.isNull(), F.col("size")).otherwise(F.lit(0)).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), F.when(refers.isNull(), F.col("html")).otherwise(F.lit("")), F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each page to gzip-compressed archives under ``path``."""
    known = decided(pages, id_col, url_col, html_col)
    total, rows = pages.agg(F.sum(F.octet_length(html_col)), F.count(F.lit(1))).first()
    per_archive = max(1, ARCHIVE_BYTES * rows // max(1, (total or 0) + 500 * rows))
    # payloads stay where the join has put them; Spark splits a group of copies that is large for one task
    known.select(record(F.col("refers")).alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers, start and end of the payload of each record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where its length says")
        yield headers, start, stop
        at = stop + 4


#: Page ids travel as text: as numbers that may be missing they would become floats on the way.
ENTRY = "urlkey string, ts string, page string, url string, run string, offset bigint, type string, digest string, bytes bigint, refers string"


def _page(text: str | None) -> str | None:
    number = (text or "null").removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else number


def _order(entry: tuple) -> tuple:
    """What captures are ordered by: URL key, timestamp, page, a missing page first."""
    return entry[0].encode(), entry[1], entry[2] is not None, int(entry[2] or 0)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive under ``path``, each archive's in order: one run for each archive."""
    workers_can_import(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            for name, content in zip(files["path"], files["content"]):
                data = gzip.decompress(content)
                entries = []
                for h, start, stop in parse(data):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (hashlib.sha1(data[start:stop]).hexdigest(), stop - start) != (digest, size):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't have the digest in its record")
                    url = None if "X-Null-URI" in h else unquote(h["WARC-Target-URI"])
                    entries.append((unquote(h["X-URL-Key"]), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, name, start, h["WARC-Type"], digest, size, _page(h.get("WARC-Refers-To"))))
                entries.sort(key=_order)
                yield pd.DataFrame(entries, columns=[c.split()[0] for c in ENTRY.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, ENTRY)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of all runs in global order of (URL key, timestamp, page), with each capture's number among
    those of its URL key within its range, ``nth``, from 0."""
    n = max(1, -(-runs.count() // RANGE_ROWS))
    names = [f.name for f in runs.schema.fields]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[str, list[tuple]] = {}
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                pieces.setdefault(row[4], []).append(row)
        for rows in pieces.values():  # a piece arrives in its run's order, unless a fetch was retried out of order
            if any(_order(a) > _order(b) for a, b in zip(rows, rows[1:])):
                rows.sort(key=_order)

        def entries(name: str) -> Iterator[tuple]:
            return ((_order(row), i, name) for i, row in enumerate(pieces[name]))

        tree = LoserTree([entries(name) for name in sorted(pieces)])
        merged, nth, last = [], 0, None
        for _, i, name in tree:
            row = pieces[name][i]
            nth, last = (nth + 1 if row[0] == last else 0), row[0]
            merged.append((*row, nth))
            if len(merged) == 10_000:
                yield pd.DataFrame(merged, columns=[*names, "nth"])
                merged = []
        if merged:
            yield pd.DataFrame(merged, columns=[*names, "nth"])

    ranged = runs.repartitionByRange(n, F.col("urlkey"), F.col("ts"), F.col("page").cast("bigint"))
    return ranged.mapInPandas(merge, f"{ENTRY}, nth bigint")


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and return the merged index of captures.

    Returns a row for each page: the id, payload_bytes, payload_digest (hex SHA-1 of the whole payload),
    record_type, refers_to (the page whose response a revisit refers to), and where the capture stands: urlkey, ts,
    nth, archive, offset. Of equal payloads of at least REVISIT_BYTES bytes the one with the largest id is the
    response; smaller ones are all responses. A null html is an empty payload; null URLs have the empty key; a null
    id is smaller than all others, so its page revisits any other of its group; rows of equal id and payload are all
    responses if they have the group's largest id, or if no page of the group has an id. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    runs = written(read_runs(spark, path), "cdx")
    index = merge_runs(runs)
    return index.select(
        F.col("page").cast("bigint").alias(id_col),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast("bigint").alias("refers_to"),
        "urlkey",
        "ts",
        "nth",
        F.col("run").alias("archive"),
        "offset",
    )


#: The contract's columns in DuckDB.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as first, count(*) as n from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html)::bigint as payload_bytes, sha1(p.html) as payload_digest,
       case when g.first is null or g.first is not distinct from p.page_id then 'response' else 'revisit' end as record_type,
       case when p.page_id is distinct from g.first then g.first end as refers_to
from p left join g on p.html = g.html
"""
