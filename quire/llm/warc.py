"""Operator 10: Zstandard WARC archives, written and read back.

Each archive starts with a skippable frame that holds the dictionary, followed
by one frame per record. Tasks write archives of a bounded size into the shared
folder under names of their own attempt; only archives of attempts that ended
are listed and read, so a lost or repeated task leaves no record out or twice.
The reader loads the dictionary from the leading frame, decodes frame by frame
and validates headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col, partitions, salted_join
from quire.session import scratch_path, ship_package, stored
from quire.sources.papers import load_table

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC, FRAME_MAGIC = b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
#: Bytes of payload after which a task starts its next archive.
ARCHIVE_BYTES = 16 << 20
#: Records that repeat a payload of at least so many bytes become revisits.
REVISIT_BYTES = 1000
#: Texts that the dictionary is trained on, and its size; any dictionary is right.
SAMPLE_ROWS, DICTIONARY_BYTES = 400, 32 << 10
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or record that does not hold what its headers say."""


def record_id(page_id: int | None, url: str | None, sha1: str, copy: int = 0) -> str:
    """Differs for all rows, also for those that repeat an id; ``copy`` numbers
    rows that are equal in all three."""
    name = f"page/{page_id}/{sha1}/{copy}/{'' if url is None else '=' + url}"
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None,
                 refers_url: str | None = None, copy: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone, a null id
    has no X-Page-Id."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, sha1, copy)),
            ("WARC-Date", DATE), ("WARC-Target-URI", "".join((url or f"urn:page:{'null' if page_id is None else page_id}").split())),
            ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head += [("X-Page-Id", str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url, sha1)),
                 ("X-Refers-To-Page-Id", str(refers_to))]
    block = _HTTP + (payload if refers_to is None else b"")
    head += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError("record does not start with a WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"record without {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(headers["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {size}, the record holds {len(rest) - 4}")

    def digest(name, content):
        want = headers.get(name)
        if want and want != "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode():
            raise WarcError(f"{name} does not match")
    digest("warc-block-digest", block)
    _, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        digest("warc-payload-digest", payload)
    return {"headers": headers, "payload": payload}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


class ArchiveWriter:
    """Frames of one archive, in memory until its bounded size is reached."""

    def __init__(self, dictionary: bytes):
        import zstandard as z
        shared = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_FULLDICT) if dictionary else None
        self._c = z.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
        self.parts, self.size = [dictionary_frame(dictionary)] if dictionary else [], 0

    def add(self, record: bytes) -> None:
        self.parts.append(self._c.compress(record))
        self.size += len(record)


def read_archive(read, chunk: int = 1 << 16):
    """Records of an archive: ``read(n)`` returns its next bytes.

    The dictionary of a leading skippable frame (plain, or a Zstandard frame of
    its own) is used for all records; each frame must hold exactly one record.
    """
    import zstandard as z
    head, shared = read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        found = read(size)
        if len(found) != size:
            raise WarcError("dictionary frame is cut off")
        if found[:4] == FRAME_MAGIC:
            found = z.ZstdDecompressor().decompressobj().decompress(found)
        if found[:4] != DICTIONARY_MAGIC:
            raise WarcError("leading frame holds no dictionary")
        shared, head = z.ZstdCompressionDict(found), b""
    machine = z.ZstdDecompressor(dict_data=shared)
    left = head
    while True:
        left = left or read(chunk)
        if not left:
            return
        frame, out = machine.decompressobj(), []
        while not frame.eof:
            try:
                out.append(frame.decompress(left))
            except z.ZstdError as e:
                raise WarcError(f"frame cannot be decoded: {e}") from e
            left = frame.unused_data if frame.eof else read(chunk)
            if not left and not frame.eof:
                raise WarcError("last frame is cut off")
        yield parse_record(b"".join(out))


def _filesystem(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(folder: str) -> str:
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and \
        not folder.startswith("file://") else folder


def _write(batches, folder: str, dictionary: bytes, archive_bytes: int):
    """Archives of one task, and one row for each record that they hold."""
    from pyspark import TaskContext
    task = TaskContext.get()
    system, root = _filesystem(folder)
    writer, ids, number = ArchiveWriter(dictionary), [], 0

    def flush():
        nonlocal writer, ids, number
        name = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
        with system.open_output_stream(name, compression=None) as f:
            for x in writer.parts:
                f.write(x)
        row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], ["archive", "records"])
        writer, ids, number = ArchiveWriter(dictionary), [], number + 1
        return row
    for batch in batches:
        for r in batch.to_pylist():
            writer.add(build_record(r["page_id"], r["url"], r["payload"] or b"", r["sha1"], r["refers_to"],
                                    r["refers_url"], r["copy"]))
            ids.append(r["page_id"])
            if writer.size >= archive_bytes:
                yield flush()
    if ids:
        yield flush()


def _read(batches, folder: str):
    system, _ = _filesystem(folder)
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            rows = []
            with system.open_input_stream(name, compression=None) as f:
                for record in read_archive(f.read):
                    h = record["headers"]
                    page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    rows.append({
                        "page_id": int(page) if page else None, "record_type": h["warc-type"], "url": h.get("warc-target-uri"),
                        "payload_digest": base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(),
                        "payload_bytes": len(record["payload"]) if h["warc-type"] == "response" else None,
                        "refers_to": int(refers) if refers else None,
                        "payload": record["payload"].decode("utf-8") if h["warc-type"] == "response" else None})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


_RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
                      ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
                      ("payload", pa.string())])


def train_dictionary(pages: DataFrame, text_col: str, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample; empty where the sample is too small."""
    import zstandard as z
    texts = pages.select(F.substring(col(text_col), 1, 20000).alias("t")).where("t is not null")
    sample = [r["t"].encode() for r in texts.limit(rows).collect()]
    try:
        return z.train_dictionary(min(size, max(1024, sum(map(len, sample)) // 10)), sample).as_bytes()
    except z.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   text_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` into archives under ``folder``;
    returns the archives (``archive``, ``records``).

    Of rows with equal texts of at least ``REVISIT_BYTES`` bytes the one with
    the largest id becomes a response, the others revisits of it; all others
    are responses. A null text is empty, a null url gets a name from the id.
    Ids are integers; rows with a null id are responses, rows that repeat an id
    each have a record of their own.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
                        F.coalesce(col(text_col), F.lit("")).cast("binary").alias("payload"))
    key = ["page_id", "url", "sha2"]  # rows alike in all three are interchangeable
    rows = rows.withColumn("sha2", F.sha2("payload", 256))
    light = stored(rows.select(*key, F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
                   .groupBy(*key, "sha1", "size").agg(F.count(F.lit(1)).alias("copies")), "warc-digests")
    groups = (light.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("sha2", "size")
              .agg(F.max(F.struct("page_id", "url")).alias("response")))
    again = F.col("response.page_id") != F.col("page_id")
    # The join's own key is null where a payload has no group.
    named = light.select("*", *[F.col(k).alias("_" + k) for k in key])
    decided = salted_join(named, groups, ["sha2", "size"]).select(
        *["_" + k for k in key], "sha1", "copies", F.when(again, F.col("response.page_id")).alias("refers_to"),
        F.when(again, F.col("response.url")).alias("refers_url"))
    # A revisit holds no payload, so none is moved for it beyond this join.
    same = (F.col("sha2") == F.col("_sha2")) & F.col("page_id").eqNullSafe(F.col("_page_id")) \
        & F.col("url").eqNullSafe(F.col("_url"))
    records = rows.join(decided, same).select(
        *key, F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "sha1", "refers_to", "refers_url", "copies")
    once = records.where("copies = 1").withColumn("copy", F.lit(0))
    if not light.where("copies > 1").isEmpty():
        more = records.where("copies > 1").dropDuplicates(key)
        once = once.unionByName(more.withColumn("copy", F.explode(F.expr("sequence(0, cast(copies - 1 as int))"))))
    records = once.drop("sha2", "copies")
    dictionary = train_dictionary(pages, text_col)
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    return records.mapInArrow(lambda it: _write(it, folder, dictionary, archive_bytes), "archive string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the named archives: ``page_id``, ``record_type``, ``url``,
    ``payload_digest``, ``payload_bytes``, ``refers_to``, ``payload``. A broken
    archive or record raises ``WarcError``."""
    spread = archives.repartition(partitions(archives), "archive")
    return spread.mapInArrow(lambda it: _read(it, folder), "page_id long, record_type string, url string, "
                             "payload_digest string, payload_bytes long, refers_to long, payload string")


def warc_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                    text_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives under ``folder``, read them back, and give a
    revisit the size of its response's payload."""
    written = stored(write_archives(pages, folder, id_col, url_col, text_col), "warc-archives")
    light = stored(read_archives(written, folder).drop("payload"), "warc-records")
    full = light.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")) \
        .dropDuplicates(["refers_to", "payload_digest"])
    revisits = salted_join(light.where("record_type = 'revisit'"), full, ["refers_to", "payload_digest"], "inner")
    return light.where("record_type = 'response'").drop("url").unionByName(
        revisits.select("page_id", "record_type", "payload_digest", F.col("full").alias("payload_bytes"), "refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _uri(scratch_path(spark, "warc"))
    return warc_round_trip(load_table(spark, sf_dir, "pages"), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {"op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g"""}
