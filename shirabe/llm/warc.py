"""Deterministic sharded WARC writer and reader.

Records are sorted by range, written in files that roll by compressed size, with headers
and digests made anew, under temporary names. The driver checks the files against the
tasks' reports, renames them and writes the manifest last: an archive without a manifest
is not complete. Equal input gives equal bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"  # the table has no fetch time; a fixed one keeps the bytes equal
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
KEY, REFERS = "X-Record-Key", "X-Refers-To-Key"


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    """Record id that depends on the key alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key)}>"


def _block(lines: list[tuple[str, str | None]]) -> bytes:
    """Header lines; line breaks inside a value become blanks."""
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines if v is not None).encode()


def record(key: str | None, url: str | None, payload: bytes, size: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the header of the payload, whose bytes stay in the response."""
    http = b"HTTP/1.1 200 OK\r\n" + _block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + b"\r\n"
    block = http if refers_to is not None else http + payload
    head = _block(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", record_id(f"{key}:{payload_digest}")),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("WARC-Profile", None if refers_to is None else PROFILE),
            ("WARC-Refers-To", None if refers_to is None else record_id(f"{refers_to}:{payload_digest}")),
            (REFERS, refers_to),
            (KEY, key),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ]
    )
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def prepared(df: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """(key, sha, url, payload, refers_to): every record, and before each revisit a row that names its response.

    Of equal payloads of ``least`` bytes or more the largest key is the response. Who
    refers to whom is found on keys and digests alone, so payloads are shuffled once, in the
    range sort, which brings both rows together. Null payloads are empty.
    """
    rows = df.select(
        F.col(key).alias("key"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= least).select("key", "sha")
    # Aggregated before the shuffle; the skew join splits the rows of a payload that many pages share.
    heads = slim.groupBy("sha").agg(F.max("key").alias("head"), F.count("*").alias("copies")).where("copies > 1")
    named = slim.join(heads, "sha").where(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("key"))).distinct()
    kind = df.schema[key].dataType.simpleString()
    return rows.select("key", "sha", "url", "payload", F.lit(None).cast(kind).alias("refers_to")).union(
        named.select("key", "sha", F.lit(None).cast("string"), F.lit(None).cast("binary"), "head")
    )


def write(df: DataFrame, path: str, key: str, url: str, payload: str, least: int = 0, roll_bytes: int = 64 << 20, level: int = 4) -> dict:
    """Write every row as a record below ``path`` and return the manifest.

    Rows are sorted by range of the key; each task writes its range to files of about
    ``roll_bytes`` compressed bytes (one record may exceed it). A repeated task writes the
    same bytes under a name of its own attempt; the commit takes the one that was reported.
    An empty table gives an archive of no files.
    """
    spark = df.sparkSession
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(f"{root}/_temporary", recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = prepared(df, key, url, payload, least).repartitionByRange(parts, "key", "sha").sortWithinPartitions(
        "key", "sha", F.col("refers_to").isNull(), "url"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, files, out = TaskContext.get(), fs.FileSystem.from_uri(path)[0], None
        part, done, sink = context.partitionId(), [], None

        def close() -> None:
            sink.close()
            done.append({**out, "sha256": out["sha256"].hexdigest()})

        named = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    named = row
                    continue
                refers = named["refers_to"] if named and (named["key"], named["sha"]) == (row["key"], row["sha"]) else None
                name, refers = (None if x is None else str(x) for x in (row["key"], refers))
                bare = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                data = record(name, row["url"], row["payload"], len(row["payload"]), bare, refers)
                packed = member(data, level)
                if sink is not None and out["bytes"] + len(packed) > roll_bytes:
                    close()
                    sink = None
                if sink is None:
                    final = f"part-{part:05d}-{len(done):05d}.warc.gz"
                    held = f"_temporary/{final}.{context.taskAttemptId()}"
                    out = {"name": final, "held": held, "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                    sink = files.open_output_stream(f"{root}/{held}")
                sink.write(packed)
                out["records"] += 1
                out["bytes"] += len(packed)
                out["sha256"].update(packed)
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist(
            done, schema=pa.schema([("name", pa.string()), ("held", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        )

    made = sorted(ordered.mapInArrow(run, "name string, held string, records long, bytes long, sha256 string").collect())
    for file in made:
        size = store.get_file_info(f"{root}/{file['held']}").size
        if size != file["bytes"]:
            raise OSError(f"{file['held']} has {size} bytes, {file['bytes']} were written")
        store.move(f"{root}/{file['held']}", f"{root}/{file['name']}")
    manifest = {
        "files": [{k: f[k] for k in ("name", "records", "bytes", "sha256")} for f in made],
        "records": sum(f["records"] for f in made),
    }
    with store.open_output_stream(f"{root}/_temporary/manifest.json") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    store.move(f"{root}/_temporary/manifest.json", f"{root}/manifest.json")
    return manifest



def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts, held = zlib.decompressobj(31), [], b""
    while True:
        chunk = held or source.read(CHUNK)
        if not chunk:
            if parts:
                raise OSError("the last gzip member is cut off")
            return
        parts.append(unpacker.decompress(chunk))
        held = b""
        if unpacker.eof:
            yield b"".join(parts)
            held, parts, unpacker = unpacker.unused_data, [], zlib.decompressobj(31)


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of a record whose digests hold."""

    def lines(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = lines(head)
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or warc["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise OSError(f"record {warc['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    if warc["WARC-Type"] == "response" and warc["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise OSError(f"the payload of {warc['WARC-Record-ID']} is damaged")
    return warc, lines(http), payload


FIELDS = "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of a committed archive, a task per file; digests and record counts are checked. A revisit has a null payload."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json") as source:
        files = json.loads(source.read())["files"]
    schema = pa.schema(
        [(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (f.split() for f in FIELDS.split(", "))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_store = fs.FileSystem.from_uri(path)[0]
        for batch in batches:
            for file in batch.to_pylist():
                rows, held, count = [], 0, 0
                with from_store.open_input_stream(f"{root}/{file['name']}", compression=None) as source:
                    for data in members(source):
                        warc, http, payload = parsed(data)
                        full = warc["WARC-Type"] == "response"
                        rows.append(
                            {
                                "key": warc.get(KEY),
                                "url": warc.get("WARC-Target-URI"),
                                "record_type": warc["WARC-Type"],
                                "payload_bytes": len(payload) if full else int(http["Content-Length"]),
                                "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha1:"),
                                "refers_to": warc.get(REFERS),
                                "payload": payload if full else None,
                            }
                        )
                        held, count = held + len(payload), count + 1
                        if held > 16 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if count != file["records"]:
                    raise OSError(f"{file['name']} has {count} records, the manifest says {file['records']}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    if not files:
        return spark.createDataFrame([], FIELDS)
    listed = spark.createDataFrame([(f["name"], f["records"]) for f in files], "name string, records long")
    return listed.repartition(len(files)).mapInArrow(run, FIELDS)
