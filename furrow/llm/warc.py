"""WARC archives of captured pages, and a globally ordered capture index by external merge.

Writing: each task appends gzip-compressed WARC/1.1 records to archives of its own in
the shared folder and sorts their index rows into capture runs (Parquet, small row
groups). Files carry a fresh name per attempt and count only when the task's manifest
rows commit, so a lost or repeated task leaves at worst files that nobody names.

Merging: runs, sorted each by (url key, timestamp, page id), meet in k-way loser-tree
merges. Sampled keys of all runs give ranges of about equal size; one task a range
reads from each run only the row groups that overlap it and merges them as streams. A
run's footer holds the whole first key of each row group, so a url with a third of all
captures is cut by timestamp like any other range, and each of its rows is read by one
or two tasks. More runs than FAN_IN are first merged into fewer, in passes. There is a
range for each RANGE_ROWS captures.

Reading back: the index gives record offsets at which an archive can be entered, every
SPLIT_BYTES; a task streams the records of one such range, or of SPLITS_PER_TASK where
there are more ranges than shuffle partitions, and recomputes payload length and digest
from the stored bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.text import slices, tidy
from furrow.session import fresh_path, materialise

GROUP_ROWS = 4096
RUN_ROWS = 100_000
KEY_STEP = 128
ARCHIVE_BYTES = 1 << 30
#: Compressed bytes of an archive that a task reads back.
SPLIT_BYTES = 32 << 20
SPLITS_PER_TASK = 8
#: Captures of one range of the merged index.
RANGE_ROWS = 250_000
FAN_IN = 128
#: Rows of one payload that one task takes.
HOT_ROWS = 50_000
LEVEL = 3
_NONE = -(2**63)

INDEX = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured", pa.int64()),
        ("page", pa.int64()),
        ("url", pa.string()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
#: In a run's footer: the first (url key, timestamp, page id) of each row group.
FIRST_KEYS = b"first_keys"
_INDEX_DDL = "url_key string, captured long, page long, url string, archive string, offset long, length long"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def url_key(url: str | None) -> str:
    """Host labels from the top down, then path and query: a sort keeps a site together."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return (url or "").lower()
    port = parts.netloc.rpartition(":")[2]
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port.isdigit() and port not in ("80", "443") else "")
    return f"{labels}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page: int | None, url: str | None, captured: int, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no payload but its length and the response's id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {datetime.fromtimestamp(captured, timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head = "\r\n".join([*fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    return head + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page, payload bytes, payload digest, type, refers to) of one record, recomputed where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:N>
    page = number(fields["WARC-Record-ID"])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
        return page, size, stated, "revisit", number(fields["WARC-Refers-To"])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated:
        raise ValueError(f"payload of page {page} does not match its digest")
    return page, len(payload), digest, "response", None


def members(stream, start: int = 0, end: int | None = None, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of every gzip member of a stream that stands at offset `start`, up to `end`."""
    at, pending = start, b""
    while end is None or at < end:
        pending = pending or stream.read(chunk)
        if not pending:
            return
        inflate, out, first = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if not pending:
                raise EOFError("an archive ends inside a record")
            out.append(inflate.decompress(pending))
            at += len(pending) - len(inflate.unused_data)
            pending = inflate.unused_data or (b"" if inflate.eof else stream.read(chunk))
        yield first, b"".join(out)


class LoserTree:
    """Merge of k sorted iterators; each step replays one leaf-to-root path, log2 k comparisons."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.k = len(sources)
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:  # while the tree is built, the first to come waits
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            top = self.losers[0]
            yield self.heads[top]
            self.heads[top] = next(self.sources[top], None)
            self._replay(top)


def overlapping(firsts: list[tuple], low: tuple | None, high: tuple | None) -> range:
    """Row groups that may have keys with low <= key < high, by the first keys of all groups in order."""
    start = max(0, bisect_left(firsts, low) - 1) if low is not None else 0
    return range(start, bisect_left(firsts, high) if high is not None else len(firsts))


def run_rows(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run with low <= key < high in order, reading only row groups that may have some."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as source:
        run = pq.ParquetFile(source)
        firsts = [tuple(k) for k in json.loads(run.metadata.metadata[FIRST_KEYS])]
        for g in overlapping(firsts, low, high):
            for row in zip(*(c.to_pylist() for c in run.read_row_group(g).columns), strict=True):
                if (low is None or row[:3] >= low) and (high is None or row[:3] < high):
                    yield row


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == GROUP_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), INDEX, strict=True)], schema=INDEX)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), INDEX, strict=True)], schema=INDEX)


def _write_run(folder: str, rows: Iterator[tuple]) -> tuple[str, int, list[tuple]]:
    """Write sorted rows; (uri, number of rows, every KEY_STEP-th key)."""
    uri = f"{folder}/run-{uuid.uuid4().hex}.parquet"
    fs, path = filesystem(uri)
    n, keys, firsts = 0, [], []
    with fs.open_output_stream(path) as sink, pq.ParquetWriter(sink, INDEX) as writer:
        for batch in _batches(rows):
            n += batch.num_rows
            at = range(min(KEY_STEP // 2, batch.num_rows // 2), batch.num_rows, KEY_STEP)
            keys += zip(*(batch.column(i).take(pa.array(at)).to_pylist() for i in range(3)), strict=True)
            firsts.append([batch.column(i)[0].as_py() for i in range(3)])
            writer.write_batch(batch, row_group_size=GROUP_ROWS)
        writer.add_key_value_metadata({FIRST_KEYS: json.dumps(firsts).encode()})
    return uri, n, keys


_MANIFEST = "archive string, cuts array<long>, run string, n long, keys array<struct<url_key:string,captured:long,page:long>>"
_MANIFEST_ARROW = pa.schema(
    [("archive", pa.string()), ("cuts", pa.list_(pa.int64())), ("run", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.struct([("url_key", pa.string()), ("captured", pa.int64()), ("page", pa.int64())])))]
)


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    keys = [[dict(zip(("url_key", "captured", "page"), k)) for k in ks] for ks in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns[:4], keys], _MANIFEST_ARROW, strict=True)], schema=_MANIFEST_ARROW)


def with_revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """pages with _page, _payload, _sha1, _refers, _revisit: the largest id of equal payloads answers for all.

    Only digests that occur twice are joined. A payload with more than HOT_ROWS rows is
    salted by its count: such payloads are fewer than the rows divided by HOT_ROWS, and
    rows learn their salt from that small table. All rows with the largest id, if it
    repeats, are responses.
    """
    payload = F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8")
    rows = pages.withColumns({"_page": pages[id_col].cast("long"), "_payload": payload}).withColumn("_sha1", F.sha1("_payload"))
    same = rows.groupBy("_sha1").agg(F.max("_page").alias("_answer"), F.count(F.lit(1)).alias("n"), F.max(F.length("_payload")).alias("size"))
    same = materialise(same.filter((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("_sha1", "_answer", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_salts")), "same")
    hot = same.filter("_salts > 1").select("_sha1", F.col("_salts").alias("_of"))
    if hot.take(1):
        rows = rows.join(hot, "_sha1", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_page"), F.col("_of")).cast("int"), F.lit(0))).drop("_of")
    else:
        rows = rows.withColumn("_salt", F.lit(0))
    answers = same.select("_sha1", "_answer", F.lit(True).alias("_known"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    joined = rows.join(answers, ["_sha1", "_salt"], "left")
    revisit = F.coalesce(F.col("_known"), F.lit(False)) & ~F.col("_page").eqNullSafe(F.col("_answer"))
    return joined.withColumn("_revisit", revisit).withColumn("_refers", F.when(revisit, F.col("_answer")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write archives and capture runs of all pages below `folder`; gives the manifest (archive, run, n, keys).

    captured names a column of unix seconds; without one the page id counts seconds
    from 2024-01-01 (a null one: that moment). Null html is an empty payload.
    """
    base = 1704067200
    when = pages[captured].cast("long") if captured else F.lit(base) + pages[id_col].cast("long")
    rows = with_revisits(pages.withColumn("_captured", F.coalesce(when, F.lit(base))), id_col, html_col, min_bytes)
    chosen = rows.select("_page", F.col(url_col).cast("string").alias("_url"), "_captured", "_payload", "_refers", "_revisit", "_sha1")

    def work(batches):
        held: list[tuple] = []
        cuts: list[int] = []
        sink = archive = None
        for batch in (part for whole in batches for part in slices(whole, "_payload")):
            for page, url, at, payload, refers, revisit, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    archive = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
                    fs, path = filesystem(archive)
                    fs.create_dir(filesystem(folder)[1], recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                    offset, cuts = 0, [0]
                elif offset - cuts[-1] >= SPLIT_BYTES:
                    cuts.append(offset)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page, url, at, payload, digest, refers, revisit)) + squeeze.flush()
                sink.write(data)
                held.append((url_key(url), at, _NONE if page is None else page, url, archive, offset, len(data)))
                offset += len(data)
                if len(held) >= RUN_ROWS or offset >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
                    yield _manifest([(archive, [*cuts, offset], *_write_run(folder, iter(sorted(held, key=lambda r: r[:3]))))])
                    held = []
        if sink is not None:
            sink.close()
            yield _manifest([(archive, [*cuts, offset], *_write_run(folder, iter(sorted(held, key=lambda r: r[:3]))))])

    return materialise(chosen.mapInArrow(tidy(work), _MANIFEST), "manifest")


def merge_runs(spark: SparkSession, manifest: DataFrame, folder: str, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Capture histories: all index rows, globally ordered by (url key, timestamp, page id) across partitions.

    Only run names (at most fan_in) and range bounds come to the driver.
    """
    runs = manifest.select("run", "n", "keys")
    while (k := runs.count()) > fan_in:
        groups = -(-k // fan_in)

        def shrink(frames):
            for frame in frames:
                out = []
                for names in frame["names"]:
                    uri, n, keys = _write_run(folder, iter(LoserTree([run_rows(x, None, None) for x in names])))
                    out.append((None, None, uri, n, keys))
                yield _manifest(out).drop_columns(["archive", "cuts"]).to_pandas()

        # a group has about fan_in runs
        dealt = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.collect_list("run").alias("names"))
        fewer = materialise(dealt.repartition(groups, "g").mapInPandas(shrink, _MANIFEST.removeprefix("archive string, cuts array<long>, ")), "runs")
        if fewer.count() >= k:
            break
        runs = fewer
    rows = runs.agg(F.sum("n")).first()[0] or 0
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    keys = runs.select(F.explode("keys").alias("key")).select("key.*")
    firsts = keys.repartitionByRange(ranges, "url_key", "captured", "page").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("url_key", "captured", "page")).alias("key"))
    bounds = [tuple(r["key"]) for r in sorted(firsts.collect(), key=lambda r: r["p"])]
    edges = [None, *bounds[1:], None]
    plan = [(i, *(edges[i] or (None, None, None)), *(edges[i + 1] or (None, None, None))) for i in range(len(edges) - 1)]
    names = spark.sparkContext.broadcast([r["run"] for r in runs.select("run").collect()])

    def merge(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = (None if k[0] is None else k for k in (row[1:4], row[4:7]))
                yield from _batches(iter(LoserTree([run_rows(uri, low, high) for uri in names.value])))

    ddl = "i int, k0 string, c0 long, p0 long, k1 string, c1 long, p1 long"
    # one task a range: the few plan rows are dealt by an RDD of as many slices, as a shuffle would pack them together
    table = spark.createDataFrame(spark.sparkContext.parallelize(plan, len(plan)), ddl)
    return table.mapInArrow(tidy(merge), _INDEX_DDL)


def read_archives(archives: DataFrame) -> DataFrame:
    """(archive, offset, page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives (archive, cuts).

    cuts are record offsets from 0 to the archive's end; each range between two is a task's.
    """
    schema = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names)

    def work(batches):
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(uri)
                held = []
                with fs.open_input_file(path) as stream:
                    stream.seek(start)
                    for offset, data in members(stream, start, end):
                        held.append((uri, offset, *parse(data)))
                        if len(held) == GROUP_ROWS:
                            yield table(held)
                            held = []
                if held:
                    yield table(held)

    pair = F.transform(F.slice("cuts", 2, F.size("cuts") - 1), lambda end, i: F.struct(F.get("cuts", i).alias("start"), end.alias("end")))
    ranges = archives.select("archive", F.inline(pair))
    n = ranges.count()
    tasks = max(min(n, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // SPLITS_PER_TASK), 1)
    # a number of partitions that is asked for isn't merged again, as one of rows this small would be
    return ranges.repartition(tasks).mapInArrow(tidy(work), schema)


def capture_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Archive all pages, merge the index, read the archives back through it.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    captured. Every index row must meet its record, else the read fails. Repeated page
    rows give repeated records. A very long payload is one record like any other.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, html_col, captured, min_bytes)
    history = materialise(merge_runs(spark, manifest, folder), "captures")
    # merge: the optimizer would take the size of the archive names for that of the records
    found = read_archives(manifest).hint("merge")
    joined = history.join(found, ["archive", "offset"], "left")
    there = F.when(F.col("record_type").isNull(), F.raise_error(F.lit("an indexed record is not in its archive"))).otherwise(F.col("record_type"))
    return joined.select("page_id", "payload_bytes", "payload_digest", there.cast("string").alias("record_type"), "refers_to", "url_key", "captured")
