"""WARC records in ZIP packages: write a corpus of pages, read it back by ranges.

Writing: every task packs its pages into packages of bounded size. A package
holds the records (``archive/records.warc.gz``, one gzip member per record,
stored) and an index of them (``indexes/records.idx``, stored). The rows of the
write job name the packages, so only packages of committed tasks are read.

Reading: one job parses the packages' end records and central directories
(ZIP64 included), locates the archive and index members and turns the index
into byte ranges; a second job reads the ranges, spread over the executors.
Nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import zipfiles
from ledgerline.llm.common import Workspace

#: packages are closed at about this many compressed bytes
PACKAGE_BYTES = 8 << 20
#: consecutive records are read in ranges of about this many compressed bytes
RANGE_BYTES = 1 << 20
#: payloads from this many bytes on are stored once
MIN_REVISIT_BYTES = 100
RECORD_DATE = "2000-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/records.warc.gz", "indexes/records.idx"

MANIFEST_SCHEMA = "package string, bytes long, records long"
RANGE_SCHEMA = "package string, offset long, length long, records long"
RECORD_SCHEMA = (
    "page_id long, target_uri string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, digest_ok boolean, payload binary"
)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------------ records
def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, kind: str) -> bytes:
    """One record as a gzip member; a revisit has the digest and the size of its payload only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(record headers, HTTP head, payload) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where the index has one")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


# ------------------------------------------------------------------ writing
def _write(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        chunks: list[bytes] = []
        lines: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal chunks, lines, size
            # an own name for every attempt: a task that runs again never touches a committed package
            name = f"{uuid.uuid4().hex}.zip"
            data = zipfiles.package([
                (ARCHIVE, chunks), (INDEX, ["".join(lines).encode()]),
                ("datapackage.json", [json.dumps({"profile": "data-package", "resources": [ARCHIVE, INDEX], "records": len(lines)}).encode()]),
            ])
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict(
                {"package": [f"{folder}/{name}"], "bytes": [len(data)], "records": [len(lines)]},
                schema=pa.schema([("package", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
            )
            chunks, lines, size = [], [], 0
            return row

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                raw = record(*(c[i].as_py() for c in cols))
                lines.append(f"{size} {len(raw)} {_urn(cols[0][i].as_py())}\n")
                chunks.append(raw)
                size += len(raw)
                if size >= package_bytes:
                    yield close()
        if lines:
            yield close()

    return run


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (dropped for revisits), digest, size, refers_to, kind.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the
    smallest id is the response; rows that repeat this id are responses too, and
    rows without an id revisit it (all are responses if no row has an id)."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = (
        rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null").select(F.col("digest").alias("partner"), "first")
    )
    # few rows have a partner; a hot payload is on the left, where a skewed partition can be split.
    # Payloads too small for a partner are dealt by their page, so empty pages do not meet in one key
    partner = F.when(F.col("size") >= min_bytes, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("page"), F.col("page_id").cast("string"), "url"))
    joined = rows.withColumn("partner", partner).join(first, "partner", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size",
        F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("kind"),
    )


def write_packages(planned: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Lazy manifest (package, bytes, records) of the packages that the tasks write below
    ``folder``; write it as a table before reading the packages."""
    return planned.mapInArrow(_write(folder, package_bytes), MANIFEST_SCHEMA)


# ------------------------------------------------------------------ reading
def _locate(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("package").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                store, name = _filesystem(path)
                out: dict[str, list] = {"package": [], "offset": [], "length": [], "records": []}
                with store.open_input_file(name) as file:
                    members = {m.name: m for m in zipfiles.directory(file, size)}
                    if any(members[n].method != zipfiles.STORED for n in (ARCHIVE, INDEX)):
                        raise ValueError(f"{path}: archive and index must be stored members")
                    base = zipfiles.data_offset(file, members[ARCHIVE])
                    index = file.read_at(members[INDEX].size, zipfiles.data_offset(file, members[INDEX])).decode()
                start = length = count = 0
                entries = [tuple(map(int, line.split(" ")[:2])) for line in index.splitlines()]
                for at, n in entries:
                    if count and length + n > range_bytes:
                        for k, v in zip(out, (path, base + start, length, count), strict=True):
                            out[k].append(v)
                        length = count = 0
                    start = at if not count else start
                    length, count = length + n, count + 1
                if count:
                    for k, v in zip(out, (path, base + start, length, count), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("package", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())]))

    return run


def _read(with_payload: bool):
    schema = pa.schema([
        ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length, count in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                store, name = _filesystem(path)
                with store.open_input_file(name) as file:
                    data = file.read_at(length, offset)
                rows = []
                for _ in range(count):
                    unpack = zlib.decompressobj(31)
                    fields, http, payload = parse(unpack.decompress(data))
                    data = unpack.unused_data
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "revisit":
                        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
                        digest, own = stated, None
                    else:
                        size, digest, own = len(payload), hashlib.sha256(payload).hexdigest(), payload
                    rows.append({
                        "page_id": _page(fields["WARC-Record-ID"]), "target_uri": fields.get("WARC-Target-URI"), "payload_bytes": size,
                        "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")),
                        "digest_ok": digest == stated, "payload": own if with_payload else None,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of whole records (package, offset, length, records), from the packages' directories and indexes."""
    return manifest.select("package", "bytes").mapInArrow(_locate(range_bytes), RANGE_SCHEMA)


def read_records(ranges: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the ranges; a revisit has no payload of its own."""
    spread = ranges.repartition(max(ranges.sparkSession.sparkContext.defaultParallelism, 8))
    return spread.mapInArrow(_read(with_payload), RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` as packages in the shared folder and read the records back."""
    work = Workspace(spark, "warc")
    manifest = work.save(write_packages(plan_records(pages), work.folder("packages")), "manifest")
    ranges = work.save(read_ranges(manifest), "ranges")
    return read_records(ranges, with_payload)
