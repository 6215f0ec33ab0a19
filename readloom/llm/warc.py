"""WARC archives of pages, and an external merge of their sorted capture runs by a loser tree."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialise, maybe_broadcast, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Payload bytes after which a task begins a new archive; entries sorted in memory for a run; rows of a run's row group; runs merged at once.
ARCHIVE_BYTES, RUN_ENTRIES, GROUP_ROWS, FAN_IN = 256 << 20, 200_000, 4096, 256
#: Entries of a merged range, and the bound of the sample of keys that the ranges are cut by.
RANGE_ENTRIES, SPLIT_SAMPLE = 250_000, 20_000
#: A page of id n was captured n seconds after this.
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = pa.schema(
    [("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
ENTRY_DDL = "url_key string, captured long, page_id long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: captures of a host and its paths stand together. A null URL has an empty host."""
    try:
        parts = urlsplit(url or "")
        parts.hostname
    except ValueError:  # no URL by its form: it stands under itself
        return f"){url}"
    host = (parts.hostname or "").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP header, which tells the payload's length, and not the payload."""
    revisit = refers_to is not None
    name = lambda n: f"<urn:page:{'none' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    head += [f"WARC-Date: {(EPOCH + timedelta(seconds=max(-(10**10), min(10**11, page_id or 0)))).strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


#: Left as they are in a target; all else, line ends and the percent sign among them, is percent-encoded so that it can be read back.
SAFE = "!#$&'()*+,-./:;=?@[]_~"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def read_records(stream: io.RawIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record, one gzip member after another."""
    held, at, member_at, unzip, parts = b"", 0, 0, zlib.decompressobj(31), []
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
        parts.append(unzip.decompress(held))
        rest = unzip.unused_data
        at += len(held) - len(rest)
        held = rest
        if unzip.eof:
            data = b"".join(parts)
            head, _, body = data.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield member_at, at - member_at, headers, body[: int(headers["Content-Length"])]
            member_at, unzip, parts = at, zlib.decompressobj(31), []


def index_entry(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """What the index keeps of a record, all of it read from the archive; a response's digest is computed from its payload and compared."""
    number = lambda s: None if s is None or s == "<urn:page:none>" else int(s[len("<urn:page:") : -1])
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{archive} at {offset}: the payload doesn't match its digest")
    url = unquote(headers["WARC-Target-URI"]) if "WARC-Target-URI" in headers else None
    page = number(headers["WARC-Record-ID"])
    return url_key(url), page or 0, page, archive, offset, length, size, digest, headers["WARC-Type"], number(headers.get("WARC-Refers-To"))


def sort_key(e: tuple) -> tuple:
    """Order of the index: URL key, capture time, page (null first), then place."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so each entry taken costs one walk from leaf to root."""

    def __init__(self, sources: Iterable[Iterator[tuple]], key: Callable[[tuple], tuple] = sort_key):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = len(self.sources)
        self.heads: list[tuple | None] = [None] * self.k
        self.keys: list[tuple | None] = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        """Exhausted sources come last; equal keys in order of the sources."""
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while self.heads[self.top] is not None:
            yield self.heads[self.top]
            winner = self.top
            self._advance(winner)
            node = (winner + self.k) // 2
            while node:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.top = winner


def write_run(folder: str, entries: Iterable[tuple]) -> tuple[str, int]:
    """A sorted run as a Parquet file of small row groups, whose statistics let a reader skip to a range."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name, n = f"run-{uuid.uuid4().hex}.parquet", 0
    with fs.open_output_stream(f"{path}/{name}") as out, pq.ParquetWriter(out, ENTRY, compression="zstd") as writer:
        block: list[tuple] = []

        def flush() -> None:
            columns = list(zip(*block)) if block else [[]] * len(ENTRY)
            writer.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY)], schema=ENTRY))
            block.clear()

        for e in entries:
            block.append(e)
            n += 1
            if len(block) == GROUP_ROWS:
                flush()
        flush()
    return f"{folder}/{name}", n


def read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run with low <= sort_key < high; one row group is held at a time, those outside aren't read."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        run = pq.ParquetFile(f)
        for g in range(run.metadata.num_row_groups):
            stats = run.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and (low and stats.max < low[0] or high and stats.min > high[0]):
                continue
            for e in zip(*[c.to_pylist() for c in run.read_row_group(g).columns]):
                if (low is None or sort_key(e) >= low) and (high is None or sort_key(e) < high):
                    yield e


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least `least` bytes all but the largest page_id refer to it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= least
    groups = materialise(p.where(big).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("g_digest"), "kept"))
    joined = p.join(maybe_broadcast(groups, 96), big & (F.col("digest") == F.col("g_digest")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, records: the archives written. A task's archives count once its rows of this table are committed, so a repeated task leaves nothing but a file without a row."""

    def run(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        out = name = None
        size = n = 0
        for b in batches:
            for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    name, size, n = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(zipper.compress(record_bytes(page, url, payload, digest, refers)) + zipper.flush())
                size, n = size + len(payload), n + 1
                if size >= limit:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    return materialise(records.mapInArrow(run, "archive string, records long"))


RUN_DDL = "run string, n long, sample array<struct<url_key:string,captured:long,page_id:long,archive:string,offset:long>>"


def capture_runs(archives: DataFrame, folder: str) -> DataFrame:
    """run, n, sample: each task reads whole archives and writes their entries as locally sorted runs."""
    spark, n = archives.sparkSession, archives.count()

    def run(batches):
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=sort_key)
            uri, count = write_run(folder, held)
            sample = [dict(zip(("url_key", "captured", "page_id", "archive", "offset"), e)) for e in held[:: max(1, len(held) // 64)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count]), pa.array([sample], pa.list_(pa.struct([ENTRY.field(i) for i in range(5)])))], ["run", "n", "sample"])

        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = filesystem(archive)
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, length, headers, block in read_records(stream):
                        held.append(index_entry(archive, offset, length, headers, block))
                        if len(held) >= RUN_ENTRIES:
                            yield flush()
        if held:
            yield flush()

    return materialise(archives.select("archive").repartition(max(1, n)).mapInArrow(run, RUN_DDL))


def merge_runs(spark: SparkSession, runs: DataFrame, folder: str) -> DataFrame:
    """All entries in the order of the index: partition after partition, each a range of keys merged from every run.

    The driver knows the names of the runs, one for each task that wrote, and a
    bounded sample of keys. More runs than FAN_IN are first merged in groups.
    Keys end with the place in the archive, so a URL of any share of the rows
    is cut into ranges like all others.
    """
    sc = spark.sparkContext
    total = runs.agg(F.sum("n")).first()[0] or 0
    names = sorted(r["run"] for r in runs.select("run").collect())
    sampled = runs.select(F.explode("sample").alias("s")).orderBy(F.xxhash64("s.archive", "s.offset"), "s.archive", "s.offset").limit(SPLIT_SAMPLE).collect()
    keys = sorted(sort_key(tuple(r["s"])) for r in sampled)
    while len(names) > FAN_IN:
        groups = [names[i : i + FAN_IN] for i in range(0, len(names), FAN_IN)]

        def together(part: Iterator[list[str]]) -> Iterator[str]:
            for group in part:
                yield write_run(folder, LoserTree([read_run(r, None, None) for r in group]))[0]

        names = sorted(sc.parallelize(groups, len(groups)).map(lambda g: next(together(iter([g])))).collect())
    parts = min(max(1, -(-total // RANGE_ENTRIES)), max(1, len(keys)))
    cuts = [None, *(keys[len(keys) * i // parts] for i in range(1, parts)), None]
    all_runs = sc.broadcast(names)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                block: list[tuple] = []
                for e in LoserTree([read_run(r, cuts[i], cuts[i + 1]) for r in all_runs.value]):
                    block.append(e)
                    if len(block) == 8192:
                        yield _entries(block)
                        block = []
                if block:
                    yield _entries(block)

    return spark.range(0, parts, 1, parts).mapInArrow(run, ENTRY_DDL)


def _entries(block: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), ENTRY)], schema=ENTRY)


def capture_index(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The merged index of the archives written from pages (page_id, url, html), read back from them.

    Null html is an empty payload; null url has an empty key; a null page_id is
    written as none and read back as null; repeated rows are records of their
    own, and those of the largest page_id are responses; an empty table gives
    an empty index; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    archives = write_archives(plan_records(pages), f"{folder}/archives")
    return merge_runs(spark, capture_runs(archives, f"{folder}/runs"), f"{folder}/runs")


def warc_query(pages: DataFrame) -> DataFrame:
    """op1: one row a page, from the merged index."""
    return capture_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB.
WARC_SQL = r"""
with p as (select page_id, url, coalesce(html, '') as h from pages),
d as (select page_id, url, strlen(h) as n, sha1(h) as digest from p),
m as (select *, max(page_id) over (partition by digest) as kept from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id is distinct from kept and kept is not null then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from kept then kept end as refers_to
from m
"""
