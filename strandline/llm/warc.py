"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by id over range partitions whose bounds come from a hash sample of
the ids, so they depend on the rows alone. Each task writes its shard's records as gzip
members and begins a new file once one has ``roll_bytes`` compressed bytes. Headers and
digests are made anew. A file is written under a temporary name and renamed; the
manifest, a written table of all files, is the commit.

Which records revisit others is found on digests alone. Those decisions join the sort as
rows of their own that come before their record, so payloads are shuffled once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import join_hot, materialise
from strandline.llm.files import dealt, get, put

MANIFEST = "name string, shard int, seq int, records long, n_bytes long, sha1 string"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, digest (SHA-256 of the payload), refers_to: the pages that revisit another page.

    Of equal payloads of ``min_bytes`` or more, that with the largest page_id is the
    response. Payloads stay where they are.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("_n")).where(F.col("_n") >= min_bytes)
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_copies")).where("_copies > 1")
    return join_hot(narrow, materialise(largest, "payloads"), ["digest"], "_copies").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def shard_bounds(ids: DataFrame, shards: int, sample: int = 20_000) -> list[int]:
    """Upper bounds of all shards but the last, from about ``sample`` ids that a hash picks (the same ones in each run)."""
    n = ids.count()
    step = max(1, n // sample)
    picked = ids.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0)).orderBy("page_id").toArrow().column(0).to_numpy()
    if not len(picked):
        return []
    return sorted({int(picked[min(len(picked) - 1, len(picked) * i // shards)]) for i in range(1, shards)})


def record(page_id: int | None, occurrence: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record with its headers; a revisit has no payload."""
    digest = hashlib.sha1(payload).digest()
    name = lambda i, k: f"<urn:page:{'null' if i is None else i}:{k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id, occurrence)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}"] if url else []),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Refers-To: {name(refers_to, 0)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, shards: int | None = None, min_bytes: int = 1000, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the manifest.

    A null html is an empty payload; a null url gives no target; a null page_id sorts
    first and is never larger than another. Of repeated rows (same page_id and payload of
    ``min_bytes`` or more) the first is as if alone and the others revisit the response.
    A payload of any length is one record. Other columns are ignored; an empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(shard_bounds(wide.select("page_id"), shards), np.int64)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = wide.select("page_id", F.lit(1).alias("kind"), F.sha2(payload, 256).alias("digest"), "url", payload.alias("payload"), F.lit(None).cast("long").alias("refers_to"))
    decided = revisits(wide, min_bytes).select("page_id", F.lit(0).alias("kind"), "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    schema = pa.schema([("name", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("n_bytes", pa.int64()), ("sha1", pa.string())])

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield batch.append_column("shard", pa.array(np.searchsorted(bounds, ids, side="left").astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, count, out = TaskContext.get().partitionId(), 0, 0, io.BytesIO()
        told: tuple | None = None  # the last decision
        last: tuple | None = None
        occurrence = 0

        def flush() -> pa.RecordBatch:
            data = out.getvalue()
            name = f"{shard:07d}-{seq:07d}.warc.gz"
            put(folder, name, data)
            return pa.RecordBatch.from_pylist([{"name": name, "shard": shard, "seq": seq, "records": count, "n_bytes": len(data), "sha1": hashlib.sha1(data).hexdigest()}], schema=schema)

        for batch in batches:
            for page_id, kind, digest, url, payload, refers_to in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, digest, refers_to = page_id.as_py(), digest.as_py(), refers_to.as_py()
                if not kind.as_py():
                    told = (page_id, digest, refers_to)
                    continue
                body = payload.as_py()
                known = told is not None and told[:2] == (page_id, digest)
                again = (page_id, digest) == last and len(body) >= min_bytes
                occurrence = occurrence + 1 if last is not None and last[0] == page_id else 0
                last = (page_id, digest)
                packed = gzip.compress(record(page_id, occurrence, url.as_py(), body, told[2] if known else page_id, known or again), 6, mtime=0)
                if count and out.tell() + len(packed) > roll_bytes:
                    yield flush()
                    seq, count, out = seq + 1, 0, io.BytesIO()
                out.write(packed)
                count += 1
        if count:
            yield flush()

    both = rows.unionByName(decided)
    dealt = both.mapInArrow(shard_of, "page_id long, kind int, digest string, url string, payload binary, refers_to long, shard int")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "kind", "url").drop("shard")
    return materialise(ordered.mapInArrow(run, MANIFEST), "warc-manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive of gzip members."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))  # reads members one after the other
    while line := stream.readline():
        fields: dict[str, str] = {}
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        yield fields, block


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) from the archives.

    Only files of the manifest are read; a file that is missing, or differs from it in
    size or SHA-1, is an error. Block digests, and the payload digests of responses, are
    checked. An empty manifest gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda urn: None if (i := urn.split(":")[2]) == "null" else int(i)
        for batch in batches:
            for name, n_bytes, sha1 in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows: list[dict] = []
                held = 0
                content = get(folder, name, n_bytes)
                if hashlib.sha1(content).hexdigest() != sha1:
                    raise ValueError(f"{name} differs from its manifest")
                for fields, block in parse(content):
                    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
                    if fields["WARC-Block-Digest"] != f"sha1:{sha(block)}":
                        raise ValueError(f"a block differs from its digest: {fields['WARC-Record-ID']}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or fields["WARC-Payload-Digest"] != f"sha1:{sha(payload)}"):
                        raise ValueError(f"a payload differs from its digest: {fields['WARC-Record-ID']}")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                    rows.append({"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload})
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return dealt(manifest.select("name", "n_bytes", "sha1")).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
