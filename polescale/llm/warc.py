"""Deterministic sharded WARC archives: write, commit, read back.

* Records are range-sorted by page_id into shards of about ``shard_bytes`` of
  payload. Borders come from exact prefix sums of bytes along the sorted page
  ids, not from a sample or from the ids' size, so every run and cluster size
  cuts alike and an outlying id changes nothing. Only shards that hold records
  are numbered; a record is never split.
* Within a shard records are sorted by page_id; a file is closed, and the next
  opened, when its compressed size passes ``roll_bytes``. Each record is a
  gzip member of its own (without time stamps).
* Headers are made anew: record ids are name-based UUIDs, digests SHA-1 in
  base 32 over block and payload. Of records with equal payloads of at least
  ``min_bytes`` bytes the one with the largest page_id is the response, the
  others revisit it and hold no payload.
* A task writes a file under a temporary name of its own and renames it when
  complete; a repeated task puts the same bytes under the same name. The
  manifest, written last, is the commit: readers only open files it names,
  and compare their size and digest. Temporary files that failed attempts left
  are deleted after it.

Shards' first ids go to the tasks as a sorted array while they are at most
``MOST_BORDERS`` (8 MB); beyond, pages get their shard by a join.

Files are opened through ``pyarrow.fs``, so any store with a URI that pyarrow
knows (file, hdfs, s3, gs) will do.

Defined results: null html is an empty payload, null url an empty target;
null page_id is written and read back as null, last of all. Of rows that
repeat a page_id and payload, one is the response; rows that repeat a page_id
stand in order of their payloads. Very long payloads are written whole, as
one record. An empty table gives no file and an empty result; extra columns,
with whatever names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polescale.llm.common import Workspace, documents_of, freed_shuffles, global_row_number, in_order

MOST_BORDERS = 1 << 20
#: Tasks that write or read; each takes consecutive shards if there are more of them.
MOST_TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed namespace for URLs of RFC 4122
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page/{uid}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(uid: int, page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers: dict | None) -> bytes:
    own = [("WARC-Record-ID", record_id(uid)), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(size))]
    http = HTTP.format(size).encode()
    if refers:
        to = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers["uid"])), ("X-Refers-To-Page-ID", "" if refers["page_id"] is None else str(refers["page_id"]))]
        return record("revisit", own + to, http)
    return record("response", own, http + (html or "").encode())


def records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a compressed archive."""
    with gzip.open(data) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                head[k] = v
            block = f.read(int(head["Content-Length"]))
            if head["WARC-Block-Digest"] != f"sha1:{sha1(block)}" or f.read(4) != b"\r\n\r\n":
                raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
            yield head, block


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(x.as_py() or "").encode() for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, raw), pa.int64()), pa.array(map(sha1, raw), pa.string())], names=["uid", "page_id", "size", "digest"])


class _File:
    """An archive that grows under a temporary name."""

    def __init__(self, folder: str, shard: int, seq: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root)
        self.name, self.shard, self.seq = f"shard-{shard:06d}-{seq:05d}.warc.gz", shard, seq
        self.path, self.temporary = f"{root}/{self.name}", f"{root}/_temporary-{uuid.uuid4().hex}-{self.name}"
        self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        info = b"software: polescale\r\nformat: WARC File Format 1.1\r\n"
        self.add(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, self.name)}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self.n = 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.n += 1

    def close(self) -> tuple:
        from pyarrow import fs

        self.out.close()
        try:
            self.fs.move(self.temporary, self.path)
        except OSError:
            # some stores don't rename onto a file that an attempt before left; it has the same bytes
            if self.fs.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.fs.delete_file(self.path)
            self.fs.move(self.temporary, self.path)
        return self.name, self.shard, self.seq, self.n, self.size, self.sha.hexdigest()


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, about, done = None, {}, []
        for b in batches:
            shards, uids, facts, pages, urls, htmls = (b.column(k) for k in range(6))
            for r in range(b.num_rows):
                shard, uid = shards[r].as_py(), uids[r].as_py()
                if (fact := facts[r].as_py()) is not None:
                    about = {uid: fact}  # stands just before its page
                    continue
                fact = about[uid]
                if file and file.shard != shard:
                    done.append(file.close())
                    file = None
                if file and file.size >= roll_bytes:
                    done.append(file.close())
                    file = _File(folder, shard, file.seq + 1)
                file = file or _File(folder, shard, 0)
                file.add(page_record(uid, pages[r].as_py(), urls[r].as_py(), htmls[r].as_py(), fact["digest"], fact["size"], fact["refers"]))
        if file:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["file", "shard", "seq", "n_records", "n_bytes", "sha256"])

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, most_borders: int = MOST_BORDERS, ws: Workspace | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``; the manifest, also as Parquet in ``folder``/manifest."""
    ws = ws or Workspace(spark, "warc")
    base = documents_of(ws, pages, F.col("url").cast("string").alias("_url"), key="page_id", text="html")
    facts = ws.save(base.select("_uid", "_id", "_text").mapInArrow(_digests, "uid long, page_id long, size long, digest string"), "digests")

    # largest page_id of each payload; a null one only if there is no other
    place = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id"), F.col("uid"))
    best = ws.save(facts.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max(place).alias("best")), "best")
    facts = facts.join(best, "digest", "left")  # a plain join, which can be split at the digest of very many pages
    refers = F.when(F.col("best").isNotNull() & (F.col("best.uid") != F.col("uid")), F.struct(F.col("best.uid").alias("uid"), F.col("best.page_id").alias("page_id")))
    facts = facts.select("uid", F.struct("digest", "size", refers.alias("refers")).alias("fact"))

    # shards by prefix sums of bytes over uid
    facts, part, at = in_order(ws, facts, [F.col("uid").asc()], "facts")
    weight = F.col("fact.size") + 512
    sums = facts.groupBy(F.col(part).alias("p")).agg(F.sum(weight).alias("b"))  # a row for each partition
    sums = sums.select(F.col("p").alias(part), F.coalesce(F.sum("b").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(weight).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = facts.withColumn("_inner", inner).join(F.broadcast(sums), part).select("uid", "fact", F.floor((F.col("_before") + F.col("_inner")) / shard_bytes).alias("s"))
    facts = ws.save(facts, "places")
    borders = global_row_number(ws, facts.groupBy("s").agg(F.min("uid").alias("lowest")), [F.col("s").asc()], "shard")
    borders = ws.save(borders.select("s", "lowest", "shard"), "borders")
    n = max(1, borders.count())
    pages_ = base.withColumnRenamed("_uid", "uid")
    if n <= most_borders:
        lowest = spark.sparkContext.broadcast(np.sort(borders.select("lowest").toArrow()["lowest"].to_numpy()))

        @F.pandas_udf("long")
        def shard_of(uid: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(lowest.value, uid.to_numpy(), "right") - 1)

        first, pages_ = (df.withColumn("shard", shard_of("uid")) for df in (facts, pages_))
    else:
        first = ws.save(facts.join(borders.select("s", "shard"), "s"), "sharded")
        pages_ = pages_.join(first.select("uid", "shard"), "uid")

    kind = "struct<digest:string,size:long,refers:struct<uid:long,page_id:long>>"
    none = lambda k: F.lit(None).cast(k)
    first = first.select("shard", "uid", "fact", none("long").alias("page_id"), none("string").alias("url"), none("string").alias("html"))
    then = pages_.select("shard", "uid", none(kind).alias("fact"), F.col("_id").alias("page_id"), F.col("_url").alias("url"), F.col("_text").alias("html"))
    tasks = min(n, MOST_TASKS)
    rows = first.union(then).repartitionById(tasks, F.floor(F.col("shard") * tasks / n).cast("int")).sortWithinPartitions("shard", "uid", F.col("fact").isNull())
    manifest = rows.mapInArrow(_write(folder, roll_bytes), "file string, shard long, seq long, n_records long, n_bytes long, sha256 string")
    with freed_shuffles(spark):
        manifest.write.parquet(f"{folder}/manifest")
    _clean(spark, folder)
    ws.close_tables()
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _clean(spark: SparkSession, folder: str) -> None:
    """Delete temporary archives: after the commit nobody needs them."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary-*")
    store = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.globStatus(glob) or ():
        store.delete(status.getPath(), True)


def _read(folder: str):
    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, size, sha in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    data = f.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                out: list[tuple] = []
                for head, block in records(io.BytesIO(data)):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    body, digest = block.partition(b"\r\n\r\n")[2], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    if response and sha1(body) != digest:
                        raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} has another digest")
                    out.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], len(body) if response else int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), body.decode() if response else None, name))
                    if len(out) >= 2000:
                        yield _page_rows(out)
                        out = []
                if out:
                    yield _page_rows(out)

    return run


def _page_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html", "file"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html, file`` of all records the manifest names; a revisit has no html."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "n_bytes", "sha256")
    n = min(MOST_TASKS, max(1, manifest.count()))
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, file string"
    return manifest.repartition(n).mapInArrow(_read(folder), kinds)
