"""WARC archives: writing, and a reader that salvages damaged files.

Writing. Each page is one record in its own gzip member, so that a reader can
start at any member. The block is an HTTP response: headers, and the html in
UTF-8 as payload. A payload that an earlier page (by id) has already is
written as a revisit record: headers alone, with the payload's digest and
length, and the id of the page it refers to. Archives are files of at most
``roll_bytes``, written under a temporary name and then moved, so a task that
is run again leaves no half file; a manifest lists the files that count.

Reading. Files are read whole as rows of bytes (their size is bounded), member
by member. A record must pass its checks: the version line, the content
length, the digests. The block of an application/http record is headers and
payload; that of any other is the payload. After a failed check the reader
searches for the next valid member or version line with a valid record behind
it, in a member's content as in the file, and goes on from there; the bytes
between are logged as a gap.

Defined results: null html is an empty payload; a null url leaves out the
target; a null page id is written as such and sorts last; of pages equal in id
and html one is the response and the others are its revisits (also where all
their ids are null: they refer to a null id); an empty table gives no files
and no rows. Which of two pages that are equal in id and url is the response
depends on the order of the rows, which must be the same on every reading, as
it is for files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import bound_batches, scratch_path, written

VERSION = b"WARC/1.1\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
PLAIN_MARK = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are closed once they have so many bytes.
ROLL_BYTES = 16 << 20
#: Bytes given to the decompressor at once.
PIECE = 1 << 14
#: One date for all records, so that equal input gives equal archives.
DATE = "2020-01-01T00:00:00Z"

RECORD_FIELDS = ("file string, offset long, length long, page_id long, url string, record_type string, "
                 "payload_bytes long, payload_digest string, refers_to long, payload binary, gap string")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _from_urn(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, payload_digest: str,
           refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, without compression; a revisit has no payload."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
             + (b"" if revisit else payload))
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _page_urn(page_id)),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if url is not None:
        # Header values end at the line's end: control characters are percent-encoded.
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Refers-To", _page_urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the offset after it; ValueError names the check that failed."""
    if data[at:at + 8] not in (b"WARC/1.0", b"WARC/1.1") or data[at + 8:at + 10] != b"\r\n":
        raise ValueError("version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header end")
    head = {}
    for line in data[at + 10:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("content length")
    start, n = end + 4, int(head["content-length"])
    block = data[start:start + n]
    if len(block) < n or data[start + n:start + n + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    if head.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest(block)):
        raise ValueError("block digest")
    revisit = head.get("warc-type") == "revisit"
    length, payload = None, block
    if head.get("content-type", "").lower().startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        if http_end < 0 and not revisit:
            raise ValueError("http header")
        # A revisit may leave out the headers, or the blank line after them.
        headers, payload = (block, b"") if http_end < 0 else (block[:http_end], block[http_end + 4:])
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", headers)
    claimed = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and (claimed not in ("", digest(payload)) or length and int(length[1]) != len(payload)):
        raise ValueError("payload digest")
    return {"page_id": _from_urn(head.get("warc-record-id")), "url": head.get("warc-target-uri"),
            "record_type": head.get("warc-type"), "payload_bytes": int(length[1]) if length else len(payload),
            "payload_digest": claimed or digest(payload), "refers_to": _from_urn(head.get("warc-refers-to")),
            "payload": None if revisit else payload}, start + n + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content of the gzip member at ``at`` as far as it can be read, the offset after it, the check that failed."""
    if data[at:at + 3] != GZIP_MAGIC:
        return b"", at, "member magic"
    d, out, p, stop = zlib.decompressobj(31), [], at, None
    # Piece by piece: what is left over is copied, and should not be the rest of the file.
    while not d.eof:
        piece = data[p:p + (PIECE if stop is None or p < stop else 1)]
        if not piece:
            return b"".join(out), p, "truncated member"
        p += len(piece)
        try:
            out.append(d.decompress(piece))
        except zlib.error:
            if stop is not None or p - at <= 1:
                return b"".join(out), p, "gzip check"
            # Once more, bytewise in the piece that failed, for all that comes before the fault.
            d, out, p, stop = zlib.decompressobj(31), [], at, p - len(piece)
    return b"".join(out), p - len(d.unused_data), None


def _records(content: bytes, last: bool = True) -> list[tuple[dict | None, str | None]]:
    """(record, None) and (None, reason) of a member's content, in order; without ``last``, no record at its very end."""
    found: list[tuple[dict | None, str | None]] = []
    p, lost = 0, None
    while p < len(content):
        try:
            rec, end = parse(content, p)
        except ValueError as e:
            lost = lost or str(e)
            p = content.find(PLAIN_MARK, p + 1)
            if p < 0:
                break
            continue
        if end == len(content) and not last:
            lost = lost or "gzip check"
            break
        found += [(None, lost)] if lost else []
        found.append((rec, None))
        p, lost = end, None
    return found + ([(None, lost)] if lost else [])


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) of each valid record and (offset, length, None, reason) of each gap.

    Records and gaps inside one member have the member's offset and length. Of a member that fails gzip's check or is
    cut off, the records that pass their own checks count, but not the one that ends where gzip's check fails.
    """
    ahead = dict.fromkeys((GZIP_MAGIC, PLAIN_MARK), 0)
    at = 0
    gap: tuple[int, str] | None = None
    while at < len(data):
        failed: str | None = None
        inner: list[tuple[dict | None, str | None]] = []
        if data[at:at + 3] == GZIP_MAGIC:
            content, end, failed = _member(data, at)
            inner = _records(content, failed != "gzip check")
            if failed and inner and inner[-1][0] is None:
                inner.pop()  # what is left at the fault belongs to its gap
            whole = not failed
            if not any(rec for rec, _ in inner):
                failed, inner = failed or (inner[0][1] if inner else None), []
        else:
            whole = False
            try:
                rec, end = parse(data, at)
                inner = [(rec, None)]
            except ValueError as e:
                failed = str(e)
        if gap and (inner or not failed):
            yield gap[0], at - gap[0], None, gap[1]
            gap = None
        for rec, reason in inner:
            yield at, end - at, rec, reason
        if failed:
            gap = gap or (at, failed)
        if not failed or whole:
            at = end
            continue
        # Both marks: a file may be damaged where its kind shows.
        for mark, place in ahead.items():
            if 0 <= place <= at:
                ahead[mark] = data.find(mark, at + 1)
        at = min((place for place in ahead.values() if place > at), default=len(data))
    if gap:
        yield gap[0], len(data) - gap[0], None, gap[1]


def with_roles(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0,
               url: str = "url") -> DataFrame:
    """Add __sha (hex), __bytes, __revisit and, for revisits, __first: the page id of the response.

    The response of a payload is its first page by id (null last), url and row. Digests are counted before pages are
    joined with them, so a payload that a third of the pages share is one row of the smaller side.
    """
    df = (pages.withColumn("__html", F.coalesce(F.col(html), F.lit("")))
          .withColumn("__bytes", F.octet_length("__html").cast("long")).withColumn("__sha", F.sha1(F.encode("__html", "UTF-8")))
          .withColumn("__place", F.struct(F.col(page_id).isNull().alias("last"), F.col(page_id).alias("id"),
                                          F.col(url).alias("url"), F.monotonically_increasing_id().alias("row"))))
    first = (df.where(F.col("__bytes") >= min_bytes).groupBy(F.col("__sha").alias("__s"))
             .agg(F.min("__place").alias("__p"), F.count("*").alias("__n")).where("__n > 1"))
    # Only payloads that occur more than once are joined; all other pages are responses.
    joined = df.drop("__html").join(first, F.col("__sha") == F.col("__s"), "left")
    revisit = F.col("__s").isNotNull() & (F.col("__place") != F.col("__p"))
    return (joined.withColumn("__revisit", revisit).withColumn("__first", F.when(revisit, F.col("__p.id")))
            .drop("__s", "__p", "__n", "__place"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the pages to archives under ``path`` (a shared folder); returns the written manifest (file, records, bytes)."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = with_roles(pages, page_id, html, min_bytes, url).select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.col("__first").cast("long").alias("first"),
        F.col("__sha").alias("sha"), F.col("__bytes").alias("n"),
        # The payload of a revisit is not sent to the writers.
        F.when(~F.col("__revisit"), F.coalesce(F.col(html), F.lit(""))).alias("html"))

    def write(batches):
        from pyarrow import fs
        # Hadoop's name of an object store's scheme, and Arrow's.
        store, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a:") else path)
        store.create_dir(root, recursive=True)
        out, count, size = [], 0, 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/_{name}.part") as f:
                f.write(b"".join(out))
            store.move(f"{root}/_{name}.part", f"{root}/{name}")
            return pd.DataFrame({"file": [name], "records": [count], "bytes": [size]})
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                i = None if pd.isna(r.id) else int(r.id)
                first = None if pd.isna(r.first) else int(r.first)
                revisit = r.html is None
                sha = base64.b32encode(bytes.fromhex(r.sha)).decode()
                data = record(i, r.url, None if revisit else r.html.encode(), int(r.n), sha, first, revisit)
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = c.compress(data) + c.flush()
                out.append(data)
                count, size = count + 1, size + len(data)
                if size >= roll_bytes:
                    yield close()
                    out, count, size = [], 0, 0
        if out:
            yield close()

    return written(rows.mapInPandas(write, "file string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records and gaps (``RECORD_FIELDS``) of the archives under ``path``; a gap has its reason and no record.

    With a manifest only its files count (a task that ran twice may have left others).
    """
    bound_batches(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    if manifest is not None:
        files = files.join(manifest.select("file"), "file", "left_semi")

    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]

    def read(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                rows, held = [], 0
                for at, length, rec, reason in salvage(content):
                    rows.append({"file": file, "offset": at, "length": length, "gap": reason, **(rec or {})})
                    held += length
                    if held > 4 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return files.mapInPandas(read, RECORD_FIELDS)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("page_id", "payload_bytes", "refers_to"):
        df[c] = df[c].astype("Int64")
    return df.astype({"offset": "int64", "length": "int64"})


def archive(pages: DataFrame, path: str | None = None, **options) -> tuple[DataFrame, str]:
    """Write the pages and read them back; returns (records and gaps, the archives' folder)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    # With scheme and host, so that the writers in Python and Spark's readers mean the same place.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    manifest = write_archives(pages, path, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_FIELDS), path
    return read_archives(spark, path, manifest), path
