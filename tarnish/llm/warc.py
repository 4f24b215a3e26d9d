"""A sharded WARC writer whose archives depend on the records alone, and a reader.

Shards are ranges of the record id, cut by a histogram of payload bytes.  Its heavy ranges are
counted again in finer ones, so outlying or clustered ids do no harm; records of one id, or of
none, that exceed a shard are dealt by digest.  Neither partitions nor retries move a record.  Within a shard records are sorted by id and written as gzip members
to files that roll over by compressed size.  Tasks write under temporary names; the list of
finished files, the manifest, is stored, a second job gives the files their names, and only
then is the manifest published.  What a lost task left behind is in no manifest.

Of records with equal payloads of ``revisit_bytes`` or more, the one with the largest id is a
response and the others are revisits that hold no payload but name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnish.session import cut_lineage, shared_folder, ship

#: Payload bytes of a shard, compressed bytes of a file.
SHARD_BYTES = 64 << 20
FILE_BYTES = 8 << 20
#: First ranges of ids, and so many shards of equal weight at most; all heavy ones are cut into four times as many.
RANGES = 1 << 16
#: Weight of a record beside its payload.
HEADER = 512
REVISIT_BYTES = 0
CHUNK = 1 << 20
#: Records carry no time of their own; archives shall not depend on the clock.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_DDL = "name string, temporary string, records long, bytes long, sha256 string"
READ_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    """SHA-1 in bare upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, copy: int = 0) -> bytes:
    """A record with fresh headers; ``refers_to`` is (id,) of the response that a revisit names."""
    digest = digest_of(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is None:
        head.append("X-No-URL: 1")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest)}"]
        if refers_to[0] is not None:
            head.append(f"X-Refers-To-Page: {refers_to[0]}")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, without name or time."""
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class _Files:
    """Rolling files of one shard."""

    def __init__(self, folder: str, size: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.size, self.shard, self.out, self.rows = size, None, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out is not None and self.written + len(data) > self.size:
            self.close()
        if self.out is None:
            self.name = f"pages-{shard:05d}-{self.number:05d}.warc.gz"
            self.number += 1
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.written, self.records, self.sha = 0, 0, hashlib.sha256()
            info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._write(member(("\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, self.name)}", f"WARC-Date: {DATE}",
                                             "Content-Type: application/warc-fields", f"Content-Length: {len(info)}", "", ""])).encode() + info + b"\r\n\r\n"))
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.written += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.records, self.written, self.sha.hexdigest()))
            self.out = None


def _write(batches: Iterator[pa.RecordBatch], folder: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, id and kind: what is known of an id's payloads stands before its records."""
    files, current, known, done = _Files(folder, size), (None,), {}, {}
    for batch in batches:
        for shard, kind, page_id, sha, url, html, target in zip(*batch.columns, strict=True):
            page_id, sha = page_id.as_py(), sha.as_py()
            if current != (page_id, True):
                current, known, done = (page_id, True), {}, {}
            if kind.as_py() == 0:
                known[sha] = target.as_py()
                continue
            copy = done[sha] = done.get(sha, -1) + 1
            first = sha not in known or copy == 0 and known[sha] == page_id
            payload = (html.as_py() or "").encode()
            files.add(shard.as_py(), member(record(page_id, url.as_py(), payload, None if first else (known[sha],), copy)))
    files.close()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in files.rows]) for k in range(5)] if files.rows else
                                     [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())],
                                     [c.split()[0] for c in MANIFEST_DDL.split(", ")])


def _commit(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Give files their names; a repeated attempt finds that done."""
    fs, path = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
            if fs.get_file_info(f"{path}/{temporary}").type != pafs.FileType.NotFound:
                fs.move(f"{path}/{temporary}", f"{path}/{name}")
            elif fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
                raise FileNotFoundError(f"{folder}/{temporary}")
        yield batch


def _weights(keyed: DataFrame, starts: list[int]) -> dict[int, tuple[int, int]]:
    """Weight and number of the records from each start up to the next."""
    bounds = np.array(starts, np.int64)

    def place(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="right") - 1, pa.int32())

    place.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    cell = F.arrow_udf(place, "int")(F.col("page_id"))
    per = keyed.where("page_id is not null").select(cell.alias("cell"), "n").groupBy("cell").agg(F.sum(F.col("n") + HEADER).alias("w"), F.count("*").alias("k"))
    return {r.cell: (r.w, r.k) for r in per.collect()}  # at most a row for each start


def _ranges(keyed: DataFrame, low: int, high: int, share: int) -> list[tuple[int, int, int, int]]:
    """(start, end, weight, records) of ranges of ids that hold records, none above ``share`` but those of a single id."""
    done: list[tuple[int, int, int, int]] = []
    heavy, pieces = [(low, high + 1)], RANGES
    while heavy:
        cells = []
        for start, end in heavy:
            width = -(-(end - start) // pieces)
            cells += [(x, min(x + width, end)) for x in range(start, end, width)]
        inside = sorted([x[:2] for x in done] + cells)
        found = _weights(keyed, [x[0] for x in inside])
        now = [(a, b, *found[k]) for k, (a, b) in enumerate(inside) if k in found]
        heavy = [(a, b) for a, b, w, _ in now if w > share and b - a > 1]
        done = [x for x in now if x[2] <= share or x[1] - x[0] == 1]
        pieces = max(2, 4 * RANGES // max(1, len(heavy)))
    return done


def _shards(keyed: DataFrame, shard_bytes: int) -> tuple[Callable[[Column, Column], Column], int]:
    """A shard number for an id and a digest, as a column function, and the number of shards.

    Shards ascend with the ids, NULL first.
    """
    weight = F.sum(F.col("n") + HEADER)
    r = keyed.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.coalesce(weight, F.lit(0)).alias("all"),
                  F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("n") + HEADER)), F.lit(0)).alias("none"),
                  F.count_if(F.col("page_id").isNull()).alias("lacking")).first()
    share = max(shard_bytes, r["all"] // RANGES + 1)
    ranges = _ranges(keyed, r.low, r.high, share) if r.low is not None else []
    number, held, first, parts = 0, 0, [], []
    for w, k in [(r["none"], r["lacking"]), *(x[2:] for x in ranges)]:
        if held and held + w > share:
            number, held = number + 1, 0
        first.append(number)
        parts.append(max(1, min(k, -(-w // share))))  # one long record is no reason for more
        number, held = (number, held + w) if w <= share else (number + parts[-1], 0)
    shards = number + (held > 0 or number == 0)
    bounds, firsts, counts = np.array([x[0] for x in ranges], np.int64), np.array(first, np.int64), np.array(parts, np.int64)

    def deal(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return pa.array(firsts[at] + hashes.to_numpy(zero_copy_only=False) % counts[at], pa.int32())

    deal.__annotations__ = {"ids": pa.Array, "hashes": pa.Array, "return": pa.Array}
    dealt = F.arrow_udf(deal, "int")
    return lambda page_id, sha: dealt(page_id, F.xxhash64(sha)), shards


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives in ``folder`` (a URI that executors can write to); returns the published manifest.

    A NULL payload is empty; a NULL id sorts first and refers to nothing, nor is it referred to
    unless all copies lack an id; of repeated rows one is the response, if any of them is.  An
    empty table gives no file and an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("n"),
                        F.col(url).alias("url"), F.col(html).alias("html"))
    keyed = cut_lineage(rows.select("page_id", "sha", "n"))
    shard, shards = _shards(keyed, shard_bytes)
    equal = keyed.where(F.col("n") >= revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1")
    known = keyed.join(equal, "sha").select("page_id", "sha", "target").distinct()
    plain = rows.select(F.lit(1).alias("kind"), "page_id", "sha", "url", "html", F.lit(None).cast("long").alias("target"))
    marks = known.select(F.lit(0).alias("kind"), "page_id", "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "target")
    both = plain.unionByName(marks).withColumn("shard", shard(F.col("page_id"), F.col("sha"))).select("shard", "kind", "page_id", "sha", "url", "html", "target")
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "sha", "url")
    manifest = cut_lineage(dealt.mapInArrow(partial(_write, folder=folder, size=file_bytes), MANIFEST_DDL))
    manifest.mapInArrow(partial(_commit, folder=folder), MANIFEST_DDL).drop("temporary").write.parquet(f"{folder}/_manifest")
    fs.delete_dir(f"{path}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    coder, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            if parts or coder.unconsumed_tail:
                raise ValueError("the archive ends within a record")
            return
        parts.append(coder.decompress(data))
        if coder.eof:
            rest = coder.unused_data
            yield b"".join(parts)
            coder, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple | None:
    """(page_id, url, type, refers_to, bytes, digest, payload) of a record; None for others.  Digests are verified."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = block[:int(fields["Content-Length"])]
    if "sha1:" + digest_of(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("X-Page-ID"), None if "X-No-URL" in fields else fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page"),
            size, digest, None if revisit else payload)


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, path = pafs.FileSystem.from_uri(folder)
    names = [c.split()[0] for c in READ_DDL.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
            rows, seen, held = [], 0, 0
            with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for data in members(stream):
                    row = parse(data)
                    if row is None:
                        continue
                    seen += 1
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(row[-1] or b"") if payloads else 64
                    if held > 8 * CHUNK:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)
            if seen != records:
                raise ValueError(f"{name} holds {seen} records, its manifest says {records}")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the published manifest; a revisit's payload is NULL.  Files are read as streams."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/_manifest").select("name", "records")
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(partial(_read, folder=folder, payloads=payloads), READ_DDL)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one, as a URI."""
    base = shared_folder(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}".replace("file:/", "file:///").replace("file://///", "file:///")
