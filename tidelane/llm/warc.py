"""WARC archives: written as whole-file gzip streams, normalised to one member a record, and read by a sidecar index.

1. Each task writes its pages as records of archives, each one gzip stream, and reports digest and archive of each page.
2. Of the pages with equal payloads the least page_id stays a response; only digests and ids are shuffled for that.
3. The normaliser inflates each archive once as a stream, rewrites every record as a member of its own (duplicates as
   revisits) and writes a sidecar index of offsets.
4. The reader takes each record through the index.

Files lie in a folder that all executors share, by any file system of pyarrow.
"""

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

ARCHIVE_BYTES = 32 << 20  # of records in an archive, before compression
LEVEL = 3
MOST_TASKS = 50_000
MADE = "page_id long, archive string, record long, digest string, size long"
INDEXED = "archive string, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, sha: str, refers_to=None) -> bytes:
    """One record of WARC/1.1. The block is an HTTP response; a revisit keeps only its head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an inflated stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record is cut off")
        yield head, block


def _place(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Pages as responses in monolithic archives under folder; a row for each: page_id, archive, record, digest.

    A task that is run again writes archives of new names; the rows name those that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _place(folder)
        disk.create_dir(root, recursive=True)
        out = zipper = name = None
        size = n = 0

        def close():
            if out is not None:
                out.write(zipper.flush())
                out.close()

        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    name, size, n = uuid.uuid4().hex, 0, 0
                    out, zipper = disk.open_output_stream(f"{root}/{name}.warc.gz", compression=None), zlib.compressobj(LEVEL, wbits=31)
                payload = (html or "").encode("utf-8", "surrogatepass")
                sha = digest(payload)
                data = record("response", page, url, payload, sha)
                out.write(zipper.compress(data))
                rows.append((page, name, n, sha, len(payload)))
                size += len(data)
                n += 1
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "archive", "record", "digest", "size"])
        close()

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select(F.col("page_id").cast("long"), url.alias("url"), "html").mapInArrow(run, MADE)


def normalise(made: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive record by record; made also has `first`, the page whose response holds the payload."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        disk, root = _place(folder)
        name = x["archive"].iloc[0]
        first = dict(zip(x["record"], x["first"]))
        index, at = [], 0
        with disk.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as raw, disk.open_output_stream(f"{root}/{name}.norm.warc.gz", compression=None) as out:
            for k, (head, block) in enumerate(records(io.BufferedReader(gzip.GzipFile(fileobj=raw)))):
                page = head.get("warc-page-id")
                origin = first[k]
                again = page is not None and not pd.isna(origin) and int(origin) != int(page)
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                data = record("revisit" if again else "response", page, head.get("warc-target-uri"), payload, head["warc-payload-digest"][5:], int(origin) if again else None)
                member = gzip.compress(data, LEVEL, mtime=0)
                out.write(member)
                index.append((at, len(member)))
                at += len(member)
        with disk.open_output_stream(f"{root}/{name}.idx.json", compression=None) as out:
            out.write(json.dumps(index).encode())
        return pd.DataFrame({"archive": [name], "records": [len(index)]})

    # the rows are small but the archives are not: a task for each few of them
    n = made.select("archive").distinct().count()
    return made.repartition(max(1, min(n, MOST_TASKS)), "archive").groupBy("archive").applyInPandas(run, INDEXED)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that a sidecar index names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, root = _place(folder)
        for batch in batches:
            for name in batch["archive"]:
                rows = []
                with disk.open_input_stream(f"{root}/{name}.idx.json", compression=None) as f:
                    index = json.loads(f.read())
                with disk.open_input_file(f"{root}/{name}.norm.warc.gz") as f:
                    for at, size in index:
                        f.seek(at)
                        ((head, block),) = records(io.BytesIO(gzip.decompress(f.read(size))))
                        cutoff = block.index(b"\r\n\r\n") + 4
                        length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block[:cutoff])[1])
                        sha, kind = head["warc-payload-digest"][5:], head["warc-type"]
                        if kind == "response" and (len(block) - cutoff != length or digest(block[cutoff:]) != sha):
                            raise ValueError(f"{name}: the payload at {at} does not match its digest")
                        rows.append([*(None if v is None else int(v) for v in (head.get("warc-page-id"), length)), sha, kind, head.get("warc-refers-to-page")])
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "payload_bytes": "int64"}).assign(refers_to=out["refers_to"].astype("Int64"))

    n = index.count()
    return index.repartition(max(1, min(n, MOST_TASKS))).mapInPandas(run, READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages, normalised and read back: a row per page.

    Null html is an empty payload. Pages with equal payloads of at least least_bytes: the least page_id is the response,
    the others revisit it; rows that repeat that page_id are responses too, as is a page without an id. Extra columns are
    ignored; a url may be null or missing. An empty table gives no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/tidelane/warc-{uuid.uuid4().hex}"
    made = cut(write_archives(pages, folder), "warc-made")
    first = made.groupBy("digest").agg(F.min("page_id").alias("first"))
    both = made.join(first, "digest").withColumn("first", F.when(F.col("size") >= least_bytes, F.col("first")))
    index = cut(normalise(both, folder), "warc-index")
    return read_archives(index, folder)
