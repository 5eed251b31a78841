"""WARC archives: writing pages, normalising whole-file gzip to one member per record with an offset index, reading back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import drop_scratch, materialise, scratch_path, table

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: A new archive is begun once one holds so many bytes of records.
ARCHIVE_BYTES = 256 << 20
READ = 1 << 20
INDEX_SCHEMA = "path string, offset long, length long, record_id string, type string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The store behind a URI or path, and the path in it; any store that Arrow can open, and local paths."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC-Payload-Digest has it after "sha1:"."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(kind: str, record_id: str, block: bytes, **headers: str | None) -> bytes:
    """A record: version, headers, empty line, block, two line ends. Headers with no value are left out."""
    lines = [VERSION, f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), f"WARC-Date: {DATE}".encode()]
    for name, value in headers.items():
        if value is not None:
            lines.append(f"{name.replace('_', '-')}: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', value)}".encode("utf-8", "replace"))
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, html: str | None, refers_to) -> bytes:
    """The response or revisit record of a page; a revisit keeps the HTTP header but not the payload."""
    payload = (html or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha1:{payload_digest(payload)}", "Content_Type": "application/http;msgtype=response"}
    if refers_to is None:
        return make_record("response", f"urn:page:{page_id}", http + payload, **common)
    return make_record("revisit", f"urn:page:{page_id}", http, WARC_Refers_To=f"<urn:page:{refers_to}>", WARC_Profile=REVISIT_PROFILE, **common)


def parse_header(raw: bytes) -> dict[str, str]:
    """Header names in lower case to values, from the bytes before the empty line."""
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, record bytes) from a stream of uncompressed WARC bytes; one record is held at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(n: int | None) -> bool:
        """Until n bytes are held, or with None one chunk more; false at the end."""
        while n is None or len(held) < n:
            got = next(chunks, None)
            if got is None:
                return False
            held.extend(got)
            if n is None:
                break
        return True

    while fill(1):
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not fill(None):
                raise ValueError("a WARC header is cut off")
        if not held.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = parse_header(bytes(held[:at]))
        end = at + 4 + int(headers["content-length"]) + 4
        if not fill(end):
            raise ValueError("a WARC record is cut off")
        yield headers, bytes(held[:end])
        del held[:end]


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, read once, in chunks."""
    unzip = zlib.decompressobj(31)
    while raw := stream.read(READ):
        while raw:
            out = unzip.decompress(raw, 4 * READ)
            if out:
                yield out
            if unzip.eof:
                raw, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                raw = unzip.unconsumed_tail


def normalise_archive(source: str, target: str) -> list[dict]:
    """Rewrite one archive so that every record is a gzip member of its own; the index entries, also written beside it.

    The source is inflated once, as a stream. The index is one JSON line per record: path, offset and length of
    the member, record id, type.
    """
    store, path = _open(source)
    out_store, out_path = _open(target)
    entries, offset = [], 0
    with closing(store.open_input_stream(path, compression=None)) as raw, closing(out_store.open_output_stream(out_path, compression=None)) as out:
        for headers, record in split_records(inflate(raw)):
            zipped = zlib.compress(record, 6, wbits=31)
            out.write(zipped)
            entries.append({"path": target, "offset": offset, "length": len(zipped), "record_id": headers["warc-record-id"], "type": headers["warc-type"]})
            offset += len(zipped)
    with closing(out_store.open_output_stream(out_path.removesuffix(".warc.gz") + ".idx.json", compression=None)) as out:
        out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
    return entries


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page id, digest, refers_to) of the pages that revisit another: the one with the largest id of the same payload."""
    digests = pages.select(F.col(id_col), F.sha1(F.coalesce(html_col, F.lit(""))).alias("_digest"), F.octet_length(F.coalesce(html_col, F.lit(""))).alias("_bytes"))
    digests = materialise(digests.filter(F.col("_bytes") >= least_bytes).drop("_bytes"), "warc-digests")
    shared = materialise(digests.groupBy("_digest").agg(F.count("*").alias("_n"), F.max(id_col).alias("refers_to")).filter("_n > 1").drop("_n"), "warc-shared")
    return materialise(digests.join(shared, "_digest").filter(F.col(id_col) != F.col("refers_to")).distinct(), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", least_bytes: int = 0) -> DataFrame:
    """(path,) of the archives written: one whole-file gzip stream each, a warcinfo record and one record per row.

    Null html is an empty payload; a null url is left out; rows with a null id are responses; rows that repeat an
    id and payload are alike. Which pages revisit another is joined by id and digest; Spark sends the revisits to
    all tasks only if their table is small, so the pages needn't be shuffled. An attempt writes files of its own and
    only those of successful tasks are listed.
    """
    found = revisits(pages, id_col, html_col, least_bytes)
    rows = pages.select(id_col, url_col, html_col).withColumn("_digest", F.sha1(F.coalesce(html_col, F.lit(""))))
    rows = rows.join(found, [id_col, "_digest"], "left").select(
        F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.col("refers_to").cast("string")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, out, zipper, size = [], None, None, 0

        def close():
            if out:
                out.write(zipper.flush())
                out.close()

        for batch in batches:
            for page_id, url, html, refers in zip(batch["id"], batch["url"], batch["html"], batch["refers_to"]):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = _open(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out, zipper, size = store.open_output_stream(path, compression=None), zlib.compressobj(1, wbits=31), 0
                    paths.append(name)
                    info = b"software: tablewarden\r\nformat: WARC File Format 1.1\r\n"
                    out.write(zipper.compress(make_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", info, Content_Type="application/warc-fields")))
                record = page_record(page_id, url, html, refers)
                size += len(record)
                out.write(zipper.compress(record))
        close()
        yield pd.DataFrame({"path": pd.Series(paths, dtype="object")})

    return materialise(rows.mapInPandas(write, "path string"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The index of the normalised copies (INDEX_SCHEMA), one row per record, read back from the sidecar files.

    archives has a path column; other columns are ignored, a path that repeats is normalised as often. An archive that is
    cut off or holds something else raises ValueError. No archives give an empty index.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                store, inner = _open(target)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                entries = normalise_archive(path, target)
                yield pd.DataFrame({"path": [target], "records": [len(entries)]})

    spark = archives.sparkSession
    n = max(1, archives.count())
    done = materialise(archives.repartition(n).mapInPandas(rewrite, "path string, records long"), "warc-normalised")
    if done.isEmpty():
        return spark.createDataFrame([], INDEX_SCHEMA)
    listed = spark.read.schema(INDEX_SCHEMA).json(f"{folder}/*.idx.json")
    return listed.join(done.select("path"), "path", "left_semi")  # an attempt that failed may have left a file


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records of an index.

    Each member is read by its offset and inflated alone. A response's length and digest are those of the payload
    read; a revisit's those that its headers give. Ids are exact up to 64 bits; the record of a null id has a null
    page_id. Other columns of the index are ignored; an empty index gives no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, object] | None = None
        for batch in batches:
            out = []
            for path, offset, length in zip(batch["path"], batch["offset"], batch["length"]):
                if held is None or held[0] != path:
                    if held:
                        held[1].close()
                    store, inner = _open(path)
                    held = (path, store.open_input_file(inner))
                raw = zlib.decompress(held[1].read_at(int(length), int(offset)), wbits=31)
                headers, record = next(split_records(iter([raw])))
                at = record.index(b"\r\n\r\n") + 4
                block = record[at : at + int(headers["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                page = headers["warc-record-id"].strip("<>").removeprefix("urn:page:")
                number = lambda x: None if x == "None" else int(x)
                if headers["warc-type"] == "revisit":
                    refers = number(headers["warc-refers-to"].strip("<>").removeprefix("urn:page:"))
                    out.append((number(page), int(parse_header(http)["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), "revisit", refers))
                else:
                    out.append((number(page), len(payload), payload_digest(payload), "response", None))
            page_ids, sizes, digests, kinds, refers = zip(*out, strict=True) if out else ((),) * 5
            whole = lambda ids: pd.array(list(ids), dtype="Int64")  # noqa: E731  by way of floats, large ids beside nulls would be rounded
            yield pd.DataFrame(
                {"page_id": whole(page_ids), "payload_bytes": whole(sizes), "payload_digest": list(digests), "record_type": list(kinds), "refers_to": whole(refers)}
            )
        if held:
            held[1].close()

    members = index.filter(F.col("type").isin("response", "revisit")).select("path", "offset", "length")
    return members.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, single = scratch_path(spark, "warc-whole"), scratch_path(spark, "warc-single")
    archives = write_archives(table(spark, sf_dir, "pages"), whole)
    index = normalise(archives, single)
    drop_scratch(spark, whole)
    return read_records(index)
