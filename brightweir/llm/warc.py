"""Deterministic sharded WARC writer and its reader.

Pages are put in order of id in shards whose edges depend on the data alone. Each shard is a sequence of files of gzip
members, one a record, and a new file begins once the current one has ``roll_bytes`` compressed bytes. Headers are
generated anew: block and payload digests, lengths, a record id that follows from page id and digest, and a date that
is a parameter, so equal tables give equal bytes. Of records with equal payloads of at least ``min_bytes``, the one with
the largest page id is a response and the others are revisit records that refer to it. Files get temporary names and are
moved when whole; a manifest, written last, names the files that count, with sizes and checksums.

Which pages revisit is settled on ids and digests alone; payloads are shuffled once, into their shards. Digests that occur
more than once are summed up in tasks first and meet their pages in ``SALTS`` parts, so a payload that a third of all pages
share is no hot task. A shard has 16 MB of payload or a 20,000th of all, and rolls into a file each 2 MB of compressed bytes.

Null html counts as empty. Null page ids come first and are the smallest. A page row that is there more than once is one
response and revisits of it, as its payload and id are equal. Null urls become ``urn:page:<id>``. An empty table gives no
files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightweir.llm import shards
from brightweir.llm.arrow import pieces
from brightweir.session import scratch

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "shard int, seq int, name string, n_records long, n_bytes long, sha256 string"
SALTS = 16


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(kind: str, page: int | None, uri: str, date: str, digest: str, payload: bytes, refers: tuple | None) -> bytes:
    """A record of version 1.1; refers: (page id, uri) of the response that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{_record_id(page, digest, kind)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page is None else page}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{_record_id(refers[0], digest, 'response')}>", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {'' if refers[0] is None else refers[0]}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page: int | None, digest: str, kind: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{digest}/{kind}")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, roll_bytes: int = 2 << 20, shard_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes the archives to the folder and returns the manifest's path."""
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    light = base.select("page", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    edges = shards.range_edges(light.select(F.col("page").alias("key"), (F.col("size") + 512).alias("size")), shard_bytes)
    best = light.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Notes go ahead of the pages that they are about: one for each (id, digest) with more than one payload like it. The rows of a
    # digest are dealt to several parts, so that one that a third of the pages share is no single task's.
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = light.select("page", "sha1", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int").alias("salt"))
    notes = salted.join(best.hint("merge"), ["sha1", "salt"]).select("page", "sha1", "response").distinct()
    rows = base.select("page", F.unhex(F.sha1("payload")).alias("sha1"), "url", "payload", F.lit(None).cast("long").alias("response"), F.lit(1).alias("what"))
    rows = rows.unionByName(notes.select("page", "sha1", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "response", F.lit(0).alias("what")))
    dealt = rows.withColumn("shard", shards.bin_of(F.col("page"), edges)).repartitionById(len(edges) + 1, "shard")
    ordered = dealt.sortWithinPartitions("shard", F.col("page").asc_nulls_first(), "sha1", "what", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shards.filesystem(path)
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        rows = (r for b in batches for p in pieces(b, "payload", 4 << 20) for r in zip(*(p[c].to_pylist() for c in ("shard", "page", "sha1", "url", "payload", "response", "what")), strict=True))
        note, before = None, None
        members = _members(rows, note, before, date)
        member = next(members, None)
        seq = 0
        while member is not None:
            shard = member[0]
            name, n, size, digest = f"part-{shard:06d}-{seq:05d}.warc.gz", 0, 0, hashlib.sha256()
            with shards.whole_file(fs, f"{root}/{name}") as out:
                while member is not None and size < roll_bytes:
                    out.write(member[1])
                    digest.update(member[1])
                    size += len(member[1])
                    n += 1
                    member = next(members, None)
            done.append((shard, seq, name, n, size, digest.hexdigest()))
            seq += 1
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["shard", "seq", "name", "n_records", "n_bytes", "sha256"])

    files = ordered.mapInArrow(run, _FILES)
    files.write.mode("errorifexists").json(f"{path}/manifest")
    return f"{path}/manifest"


def _members(rows: Iterator[tuple], note: tuple | None, before: tuple | None, date: str) -> Iterator[tuple[int, bytes]]:
    """(shard, gzip member) of each page; rows in order of id and digest, notes ahead of their pages."""
    for shard, page, sha1, url, payload, response, what in rows:
        if what == 0:
            note, before = (page, sha1, response), None
            continue
        refers = None
        if note and note[:2] == (page, sha1) and (note[2] != page or before == (page, sha1)):
            refers = (note[2], None)
        before = (page, sha1)
        uri = url or f"urn:page:{page}"
        record = _record("revisit" if refers else "response", page, uri, date, base32(sha1), payload, refers)
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield shard, gz.compress(record) + gz.flush()


def _records(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one after another."""
    gz, parts, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        parts.append(gz.decompress(data))
        if gz.eof:
            yield b"".join(parts)
            data, gz, parts = gz.unused_data, zlib.decompressobj(31), []
        else:
            data = b""
        data = data or stream.read(1 << 20)
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(record: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and payload (None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in (x if ": " in x else x + " " for x in head.decode().split("\r\n")[1:]))
    block = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]
    if f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
        raise ValueError("a block does not match its digest")
    if kind == "response" and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError("a payload does not match its digest")
    number = lambda x: int(x) if x and x.strip() else None
    return {
        "page_id": number(fields.get("X-Page-ID")),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("X-Refers-To-Page")),
        "payload": payload if kind == "response" else None,
    }


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives that the manifest names, one task for a few files; digests are verified."""
    files = spark.read.schema(_FILES).json(f"{path}/manifest")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shards.filesystem(path)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=False)], names)

        for batch in batches:
            for name in batch["name"].to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _records(stream):
                        rows.append(parse(record))
                        held += len(record)
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.repartition(max(1, min(files.count(), 4096))).mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    from brightweir.session import table

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


_BITS = ", ".join(f"'{n:04b}'" for n in range(16))
#: Base 32 by way of the digest's bits.
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS m,
  array_to_string(list_transform(string_split(sha1(h), ''), lambda c: [{_BITS}][instr('0123456789abcdef', c)]), '') AS b FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(b, CAST(5 * i + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(b, CAST(5 * i + 2 AS BIGINT), 1) AS INTEGER)
    + 4 * CAST(substr(b, CAST(5 * i + 3 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(b, CAST(5 * i + 4 AS BIGINT), 1) AS INTEGER) + CAST(substr(b, CAST(5 * i + 5 AS BIGINT), 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM q
"""
