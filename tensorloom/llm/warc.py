"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: records with equal payloads (by SHA-1 and length, of at least `least` bytes) are written
once, as the response with the largest id; the others are revisits that refer to it and hold the
HTTP header only. Each task sorts its records and writes archives named by partition and number,
so a task that runs again writes the same files again; files appear by renaming.

Reading: each file's dictionary is taken from its first frame if that is skippable with the
dictionary's magic number, frames are cut by their block headers, each is decoded by itself and
must hold one whole record. Version, header lines, Content-Length, the closing blank lines and the
digest of the payload are checked; a record that fails raises ValueError, or gives a row with
`error` set if strict is false.

Defined results: a null payload is empty; a null address is left out; a null id is written as
`null` and read back as null; rows repeated in full with the largest id are all responses; an empty
table gives an empty folder and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: Tasks that the copies of one payload are dealt to.
SALTS = 16
#: Size at which an archive is closed, and of a dictionary and of what it is trained on.
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 16 << 10
TRAINED_ON = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_system(folder: str):
    """The store of a folder and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    if folder.startswith("s3a:"):
        folder = "s3:" + folder[4:]
    return fs.FileSystem.from_uri(folder)


def train(samples: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8) if len(samples) >= 8 else None
    except zstandard.ZstdError:  # too little to learn from
        return None


class Writer:
    """Archives of one task."""

    def __init__(self, folder: str, partition: int, dictionary):
        import zstandard

        self.store, self.folder = file_system(folder)
        self.partition, self.number = partition, 0
        self.dictionary = dictionary
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        self.held: list[bytes] = []
        self.size = self.records = 0

    def add(self, raw: bytes):
        frame = self.compressor.compress(raw)
        self.held.append(frame)
        self.size += len(frame)
        self.records += 1
        return self.close() if self.size >= ARCHIVE_BYTES else None

    def close(self):
        """Write what is held; returns (path, records, bytes)."""
        if not self.held:
            return None
        head = []
        if self.dictionary is not None:
            d = self.dictionary.as_bytes()
            head = [struct.pack("<II", DICTIONARY_MAGIC, len(d)), d]
        content = b"".join(head + self.held)
        name = f"{self.folder}/part-{self.partition:05d}-{self.number:05d}.warc.zst"
        hidden = f"{self.folder}/_{self.partition:05d}-{self.number:05d}-{hashlib.sha1(content).hexdigest()[:8]}.tmp"
        with self.store.open_output_stream(hidden) as out:
            out.write(content)
        self.store.move(hidden, name)
        done = (name, self.records, len(content))
        self.number, self.held, self.size, self.records = self.number + 1, [], 0, 0
        return done


def write_batches(folder: str):
    """For mapInArrow: (page_id, url, payload, refers_to) to (path, records, bytes)."""

    def raws(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield record(*(batch.column(n)[i].as_py() if n != "payload" else (batch.column(n)[i].as_py() or "").encode("utf-8", "surrogatepass") for n in ("page_id", "url", "payload", "refers_to")))

    def run(batches):
        from pyspark import TaskContext

        first, size, writer, done = [], 0, None, []
        for raw in raws(batches):
            if writer is None:
                first.append(raw)
                size += len(raw)
                if size < TRAINED_ON:
                    continue
                writer = Writer(folder, TaskContext.get().partitionId(), train(first))
                done += [writer.add(x) for x in first]
                first = []
            else:
                done.append(writer.add(raw))
        if first:
            writer = Writer(folder, TaskContext.get().partitionId(), train(first))
            done += [writer.add(x) for x in first]
        if writer is not None:
            done.append(writer.close())
        done = [x for x in done if x]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> tuple[int, int]:
    """Write one record for each row below folder; returns the numbers of archives and records."""
    spark = pages.sparkSession
    ship(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    d = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    content = F.encode(F.col("payload"), "utf-8")
    keys = {"sha": F.unhex(F.sha1(content)), "size": F.octet_length("payload")}
    # only digests that occur twice are joined, each in SALTS copies, so that one payload's pages go to many tasks
    largest = d.select(*[v.alias(k) for k, v in keys.items()], "page_id").groupBy("sha", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    largest = largest.where("n > 1").select("sha", "size", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    d = d.withColumns(keys).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(largest, ["sha", "size", "salt"], "left")
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    d = d.select("page_id", "url", "payload", refers.alias("refers_to")).sortWithinPartitions("page_id", "payload", "url")
    done = d.mapInArrow(write_batches(folder), "path string, records long, bytes long")
    r = done.agg(F.count("*").alias("n"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).collect()[0]
    return r["n"], r["records"]


def frame_end(buf: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, by its header and block headers."""
    flags = buf[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size = (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6] + (0 if single else 1)
    at += 5 + size
    while True:
        if at + 3 > len(buf):
            raise ValueError("cut off within a frame")
        head = int.from_bytes(buf[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head >> 1 & 3 == 3:
            raise ValueError("a block of reserved type")
        if head & 1:
            break
    at += 4 * checksum
    if at > len(buf):
        raise ValueError("cut off within a frame")
    return at


def frames(content: bytes):
    """Decoded frames of an archive, one after the other."""
    import zstandard

    buf, at, dictionary = memoryview(content), 0, None
    decoder = None
    while at < len(buf):
        if at + 8 > len(buf):
            raise ValueError("cut off before a frame")
        magic, size = struct.unpack_from("<II", buf, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(buf):
                raise ValueError("cut off within a skippable frame")
            if at == 0 and magic == DICTIONARY_MAGIC:
                d = bytes(buf[8 : 8 + size])
                if d[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    d = zstandard.ZstdDecompressor().decompressobj().decompress(d)
                dictionary = zstandard.ZstdCompressionDict(d)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(buf, at)
            decoder = decoder or zstandard.ZstdDecompressor(dict_data=dictionary)
            try:
                yield decoder.decompressobj().decompress(buf[at:end])
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame that can't be decoded: {e}") from None
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header line: {line[:60]!r}")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def page_number(uri: str):
    m = re.fullmatch(r"<urn:page:(null|-?\d+)>", uri)
    if not m:
        raise ValueError(f"not a record's id: {uri[:60]}")
    return None if m[1] == "null" else int(m[1])


def parse(raw: bytes) -> dict:
    """One record, validated."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of the header")
    h = headers(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise ValueError(f"without {sorted(missing)}")
    if not h["content-length"].isdigit() or int(h["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length isn't the block's length")
    block = rest[:-4]
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header in the block")
    size = headers(http.split(b"\r\n")[1:]).get("content-length", "")
    kind, sha = h["warc-type"], h.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not sha.startswith("sha1:") or not size.isdigit():
        raise ValueError(f"a {kind} record without SHA-1 digest or payload length")
    if kind == "response" and (int(size) != len(payload) or sha[5:] != digest(payload)):
        raise ValueError("the payload doesn't match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise ValueError("a revisit with a payload or without a reference")
    return {
        "page_id": page_number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind,
        "refers_to": page_number(h["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(size), "payload_digest": sha[5:], "payload": payload if kind == "response" else None, "error": None,
    }


def read_batches(strict: bool, payloads: bool, step: int = 256):
    """For mapInArrow: whole archives (path, content) to records."""

    def parsed(path, content):
        try:
            for raw in frames(content):
                try:
                    r = parse(raw)
                except ValueError as e:
                    if strict:
                        raise
                    r = {"error": f"{path}: {e}"}
                yield r
        except ValueError as e:
            if strict:
                raise ValueError(f"{path}: {e}") from None
            yield {"error": f"{path}: {e}"}

    def run(batches):
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])
        table = lambda rows: pa.RecordBatch.from_pylist([{f.name: r.get(f.name) if payloads or f.name != "payload" else None for f in schema} for r in rows], schema=schema)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for r in parsed(batch.column("path")[i].as_py(), batch.column("content")[i].as_py()):
                    rows.append(r)
                    if len(rows) == step:
                        yield table(rows)
                        rows = []
                yield table(rows)

    return run


def read_archives(spark: SparkSession, folder: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """Records of all archives in folder: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(read_batches(strict, payloads), RECORD)
