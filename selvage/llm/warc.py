"""WARC archives: writing with segmented records and chunked transfer framing, reading with reassembly.

A record whose block exceeds the segment size is written as a first record and continuation records. The reader groups
segments by the identifier of their origin, orders them by segment number, verifies the total length, decodes the
chunked framing and verifies the payload digest.

Archives are written by Spark's own file sink (a record is a row, the blank lines after a record are the row separator),
so task commits, retries and remote stores work as for any table; a file is one gzip stream.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.llm.common import cut, join_spread, shared_folder, tune

#: Bytes of a block in one record, of a chunk of the transfer framing, and records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 4096, 1500, 10_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%s\r\n" % (len(p := payload[a : a + size]), p) for a in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing, with chunk extensions and trailers allowed. Framing that breaks off raises ValueError."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk header breaks off")
        size = int(framed[at:end].split(b";")[0].strip() or b"x", 16)
        if not size:
            return b"".join(out)
        if end + 2 + size + 2 > len(framed) or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk breaks off")
        out.append(framed[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(name: str, url: str, payload: bytes, digest: str, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without the blank lines after each."""
    when, uri = ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))
    common = [when, uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [_record("revisit", [("WARC-Record-ID", f"<{name}>"), ("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", _PROFILE), *common], block)]
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record("response", [("WARC-Record-ID", f"<{name}>"), *common], block)]
    out = [_record("response", [("WARC-Record-ID", f"<{name}>"), ("WARC-Segment-Number", "1"), *common], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(_record("continuation", [("WARC-Record-ID", f"<{name}:{n}>"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(n)), *last, when, uri], part))
    return out


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of a file, gzipped (any number of members) or not.

    The file is unpacked bit by bit: no more than a record and a read-ahead are held besides the file itself.
    """
    view, at, have = memoryview(content), 0, bytearray()
    plain = content[:2] != b"\x1f\x8b"
    unzip = None if plain else zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, unzip
        if at >= len(view) and (plain or not unzip.unconsumed_tail):
            return False
        if plain:
            have.extend(view[at : at + (1 << 20)])
            at += 1 << 20
            return True
        source = unzip.unconsumed_tail or bytes(view[at : at + (1 << 18)])
        if not unzip.unconsumed_tail:
            at += 1 << 18
        have.extend(unzip.decompress(source, 1 << 20))
        if unzip.eof:
            rest = unzip.unused_data
            at = min(at, len(view)) - len(rest)
            unzip = zlib.decompressobj(31)
        return True

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0 or have[:2] == b"\r\n":
            if have[:2] == b"\r\n":
                del have[:2]
            elif not more():
                if have.strip():
                    raise ValueError("record breaks off")
                return
        lines = bytes(have[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        while len(have) < end + 4 + size:
            if not more():
                raise ValueError("block breaks off")
        block = bytes(have[end + 4 : end + 4 + size])
        del have[: end + 4 + size]
        yield fields, block


# --- writing ---------------------------------------------------------------------------------------------------------


def _write(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=0)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        for batch in batches:
            for at in range(0, len(batch), 100):
                out, first = first, []
                for row in batch.slice(at, 100).to_pylist():
                    payload = row["payload"]
                    out += records(row["name"], row["url"], payload, base32_sha1(payload), row["refers"], segment)
                yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, segment: int = SEGMENT) -> None:
    """Archives of a record for each row of pages, in files under `folder`.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least `least` bytes, those of the
    largest id are responses and the others revisit it; smaller ones are all responses. Null ids are revisits where a row
    has an id, else responses. Rows that repeat the largest id are all responses.
    """
    tune(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{id_col}`").alias("order"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    name = F.concat(F.lit("urn:page:"), F.coalesce("id", F.lit("null")), F.lit(":"), F.col("row").cast("string"))
    rows = rows.withColumn("name", name)
    # a page that many rows have makes one head; its rows are dealt over several tasks
    own = F.when(F.col("order").isNotNull(), F.struct("order", "name"))
    heads = rows.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max(own).alias("head"), F.count("*").alias("n"))
    joined = join_spread(rows, cut(heads.where("n > 1 AND head IS NOT NULL")), ["sha1", "bytes"], ["row"], how="left")
    refers = F.when(F.col("head.order").isNotNull() & ~F.col("order").eqNullSafe(F.col("head.order")), F.col("head.name"))
    ready = joined.select("name", "url", "payload", refers.alias("refers"))
    done = ready.mapInArrow(_write(segment), "record binary")
    done.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


# --- reading ---------------------------------------------------------------------------------------------------------

_SEGMENTS = "origin string, number int, total bigint, type string, refers string, url string, digest string, block binary"


def _files(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[list[dict]]:
    """Segments of one origin after the other: of origins that one file holds completely, or else of the others."""
    for batch in batches:
        for content in batch.column(0):
            open_: dict[str, list[dict]] = {}
            for f, block in parsed(content.as_buffer().to_pybytes()):
                if f["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                bare = lambda k: f.get(k, "").strip("<>") or None  # noqa: B023, E731
                total = f.get("warc-segment-total-length")
                row = {
                    "origin": bare("warc-segment-origin-id") or bare("warc-record-id"), "number": int(f.get("warc-segment-number", 0)), "total": int(total) if total else None, "type": f["warc-type"],
                    "refers": bare("warc-refers-to"), "url": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "block": block,
                }
                own = open_.setdefault(row["origin"], [])
                own.append(row)
                last = next((s["total"] for s in reversed(own) if s["total"] is not None), None)
                if not row["number"] or last == sum(len(s["block"]) for s in own) and sorted(s["number"] for s in own) == list(range(1, len(own) + 1)):
                    del open_[row["origin"]]
                    if whole:
                        yield own
            if not whole:
                yield from open_.values()


def _read_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    for own in _files(batches, False):
        for at in range(0, len(own), 100):
            yield _batch(names, [tuple(s[n] for n in names) for s in own[at : at + 100]])


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _decoded((own[0]["origin"], *reassemble(own)) for own in _files(batches, True))


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)


def reassemble(segments: list[dict]) -> tuple[str, str | None, str, bytes | None, int, str, bool]:
    """type, refers, url, payload (None for a revisit), payload bytes, digest, whole: from all segments of one origin.

    A record is whole if its segments are numbered from 1 without gap, add up to the total length, and their payload has
    the stated digest; else its payload is what can be decoded.
    """
    seen: dict[int, dict] = {}
    for s in segments:
        seen.setdefault(s["number"], s)
    order = [seen[k] for k in sorted(seen)]
    first = order[0]
    block = b"".join(s["block"] for s in order)
    whole = first["type"] != "continuation"
    if len(order) > 1 or first["number"] > 0:
        total = next((s["total"] for s in order if s["total"] is not None), None)
        whole = whole and sorted(seen) == list(range(1, len(order) + 1)) and total == len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    stated = (first["digest"] or "").removeprefix("sha1:")
    if first["type"] == "revisit":
        return "revisit", first["refers"], first["url"], None, int(http.get(b"content-length", b"0")), stated, whole
    if http.get(b"transfer-encoding", b"").lower() == b"chunked":
        try:
            body = unchunked(body)
        except ValueError:
            whole = False
    digest = base32_sha1(body)
    return first["type"], None, first["url"], body, len(body), digest, whole and digest == stated


_RECORD = "name string, record_type string, refers string, url string, payload binary, payload_bytes bigint, payload_digest string, whole boolean"


def _decoded(records_: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about a megabyte of reassembled records."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    out: list[tuple] = []
    size = 0
    for record in records_:
        out.append(record)
        size += 200 + len(record[4] or b"")
        if size > 1 << 20:
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _RECORD.split(", ")])
            out, size = [], 0
    if out:
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _RECORD.split(", ")])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["origin"] != row["origin"]:
                    yield (held[0]["origin"], *reassemble(held))
                    held = []
                held.append(row)
        if held:
            yield (held[0]["origin"], *reassemble(held))

    return _decoded(each())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """name, record_type, refers, url, payload, payload_bytes, payload_digest (bare base32), whole: a row for each record.

    Origins whose segments one file holds completely are reassembled where they are read. The segments of the others, which
    lie in several files, are dealt by origin and streamed in order of their numbers, so a task holds one record at a time.
    A segment repeated in another file is a record of its own there, not whole.
    """
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    rest = files.mapInArrow(_read_rest, _SEGMENTS).repartition("origin").sortWithinPartitions("origin", "number")
    return files.mapInArrow(_read_whole, _RECORD).union(rest.mapInArrow(_assemble, _RECORD))


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """The pages written as archives (in a new folder of the shared one, if none is given) and read back: read()'s columns, and the ids."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, id_col=id_col, **options)
    kind = pages.schema[id_col].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*):[0-9]+$", 1), F.lit("null")).cast(kind)
    return read(spark, folder).withColumn("page_id", page(F.col("name"))).withColumn("refers_to", page(F.col("refers")))
