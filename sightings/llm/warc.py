"""WARC archives as seekable Zstandard bundles (operator 9).

A bundle is a file of independent Zstandard frames. Each frame holds whole WARC records; the
last frame is a skippable one with the seek table: compressed and decompressed length of every
frame, their number and the format's mark (the public seekable format). Decompressed as a whole,
a bundle is a plain WARC file; with the table, one frame is read alone. The index maps record
ids to bundle, frame, and offset in the decompressed frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm import storage
from sightings.session import cut, ship

#: Decompressed bytes from which a frame is closed, and compressed bytes of a bundle.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
LEVEL = 3
#: Tasks that bundles are read back in at most.
MOST_READERS = 20_000

# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ENTRY = struct.Struct("<II")
_FOOTER = struct.Struct("<IBI")
_BREAK = b"\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, sha: bytes, size: int, ordinal: int = 0) -> str:
    """The record's name, the same in every run.

    It is made of the page's id, its payload's digest and length, and the row's number among those
    that repeat both.
    """
    page = "none" if page_id is None else page_id
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page/{page}/{sha.hex()}/{size}/{ordinal}")
    return f"<urn:uuid:{name}>"


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first: bool, date: str, ordinal: int = 0
) -> bytes:
    """A response with its payload, or a revisit without."""
    sha = hashlib.sha1(payload).digest()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha, len(payload), ordinal)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Bytes: {len(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        # A line break would end the header.
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " " and c != "\x7f"))
    if not first:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, sha, len(payload))}")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    body = payload if first else b""
    head.append("Content-Type: text/html; charset=utf-8")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _BREAK * 2 + body + _BREAK * 2


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records in decompressed bytes."""
    at = 0
    while at < len(data):
        end = data.index(_BREAK * 2, at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if data[stop : stop + 4] != _BREAK * 2:
            raise ValueError("a record doesn't end where its length says")
        yield at, fields, data[end + 4 : stop]
        at = stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end."""
    body = b"".join(_ENTRY.pack(*s) for s in sizes) + _FOOTER.pack(len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames_of(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer."""
    n, flags, mark = _FOOTER.unpack_from(content, len(content) - _FOOTER.size)
    if mark != _SEEKABLE:
        raise ValueError("no seek table")
    width = _ENTRY.size + (4 if flags & 0x80 else 0)
    start = len(content) - _FOOTER.size - n * width
    out, at = [], 0
    for k in range(n):
        packed, plain = _ENTRY.unpack_from(content, start + k * width)
        out.append((at, packed, plain))
        at += packed
    if at != start - 8:
        raise ValueError("the seek table doesn't fit the frames")
    return out


def _frame(content: bytes, at: int, packed: int, plain: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


def _numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """page_id, url, payload, sha, bytes, first, ordinal: rows with a number among their repeats.

    Rows that repeat id and payload are few, or copies of a few: these are brought together, one
    row with its number of times for each url, and dealt out again.
    """
    groups = rows.groupBy(*same).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = groups.filter("n > 1").select(*same, "first")
    d = rows.join(copies, same, "left")
    known = F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("_page")
    repeats = rows.groupBy(known, *same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = cut(repeats.select("_page", *same, F.lit(True).alias("_many")))
    columns = ["page_id", "url", "payload", *same, "first"]
    d = d.withColumn("_page", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    if repeats.isEmpty():
        return d.select(*columns, F.lit(0).cast("long").alias("ordinal"))
    d = d.join(repeats, ["_page", *same], "left")
    one = d.filter("_many is null").select(*columns, F.lit(0).cast("long").alias("ordinal"))
    times = d.filter("_many").groupBy("_page", "page_id", "url", *same, "first")
    times = times.agg(F.min("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_page", *same).orderBy("url").rowsBetween(Window.unboundedPreceding, 0))
    numbers = F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("ordinal")
    return one.unionByName(times.withColumn("upto", upto).select(*columns, numbers))


def write(
    pages: DataFrame,
    date: str = "2024-01-01T00:00:00Z",
    folder: str | None = None,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> tuple[str, DataFrame]:
    """Write a record for each row of pages (page_id, url, html) and return (folder, index).

    The index has page_id, record_id, bundle, frame, offset (in the decompressed frame) and
    length; record ids are unique, also where page ids repeat or are null. Of rows with equal
    payloads that of the smallest page_id is a response, the others refer to it as revisits; null
    html is the empty payload. A row that repeats the id and payload of a response is a response
    too. A row without an id is a response only where no row of its payload has one. Payloads are
    compared by SHA-1 and length. A task holds a frame and the packed frames of a bundle; a larger
    payload has a frame of its own. Rows are sorted within a task, so one that runs again writes
    the same bundles; the index names those that count. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or storage.new_folder(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("bytes", F.length("payload"))
    placed = _numbered(rows, ["sha", "bytes"]).sortWithinPartitions("page_id", "sha", "bytes", "ordinal")
    placed = placed.select("page_id", "url", "payload", "first", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        open_, held = bytearray(), 0
        index: list[tuple] = []

        def close_frame() -> None:
            nonlocal held
            if open_:
                frames.append(packer.compress(bytes(open_)))
                sizes.append((len(frames[-1]), len(open_)))
                held += len(frames[-1])
                open_.clear()

        def close_bundle() -> pa.RecordBatch:
            nonlocal seq, held
            close_frame()
            name = f"{part:06d}-{seq:06d}.warc.zst"
            storage.put_file(folder, name, [*frames, seek_table(sizes)])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in index], pa.int64()),
                    pa.array([x[1] for x in index], pa.string()),
                    pa.array([name] * len(index), pa.string()),
                    pa.array([x[2] for x in index], pa.int32()),
                    pa.array([x[3] for x in index], pa.int32()),
                    pa.array([x[4] for x in index], pa.int32()),
                ],
                ["page_id", "record_id", "bundle", "frame", "offset", "length"],
            )
            frames.clear()
            sizes.clear()
            index.clear()
            seq, held = seq + 1, 0
            return out

        for b in batches:
            ids, urls, firsts, ordinals = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page_id, url, payload, first, ordinal in zip(ids, urls, b.column(2), firsts, ordinals):
                is_first, payload = first is None or page_id == first, payload.as_py()
                x = record(page_id, url, payload, first, is_first, date, ordinal)
                own = record_id(page_id, hashlib.sha1(payload).digest(), len(payload), ordinal)
                if open_ and len(open_) + len(x) > frame_bytes:
                    close_frame()
                    if held >= bundle_bytes:
                        yield close_bundle()
                index.append((page_id, own, len(frames), len(open_), len(x)))
                open_ += x
        if index:
            yield close_bundle()

    written = placed.mapInArrow(
        run, "page_id long, record_id string, bundle string, frame int, offset int, length int"
    )
    return folder, cut(written)


def read(folder: str, index: DataFrame) -> DataFrame:
    """Read the bundles that the index names back, a record per row.

    page_id, payload_bytes, payload_digest, record_type, refers_to, intact. `intact` says that a
    response's block has the length and digest of its header. A task holds one bundle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                data = storage.get_file(folder, name)
                for frame in frames_of(data):
                    rows = [_described(f, block) for _, f, block in records(_frame(data, *frame))]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
    )
    bundles = index.select("bundle").distinct()
    # A stated number, as so few bytes of names would be brought into one task.
    dealt = bundles.repartition(max(1, min(bundles.count(), MOST_READERS)), "bundle")
    return dealt.mapInArrow(
        run,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "intact boolean",
    )


def _described(fields: dict[str, str], block: bytes) -> dict:
    kind = fields["WARC-Type"]
    size, sha = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None,
        "payload_bytes": size,
        "payload_digest": sha,
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
        "intact": kind == "revisit" or (len(block) == size and digest(block) == sha),
    }


def fetch(folder: str, index: DataFrame, wanted: Column) -> DataFrame:
    """page_id, payload of the index rows that `wanted` selects, each read from its frame alone.

    A revisit has an empty payload. Frames are found by the footer's table at a bundle's end.
    """
    ship(index.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, bundle, frame, offset, length in zip(*[c.to_pylist() for c in b.columns]):
                at, packed, plain = storage_frames(folder, bundle)[frame]
                (data,) = storage.get_ranges(folder, bundle, [(at, packed)])
                part = _frame(data, 0, packed, plain)[offset : offset + length]
                out.append({"page_id": page_id, "payload": next(records(part))[2]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload", pa.binary())]))

    rows = index.filter(wanted).select("page_id", "bundle", "frame", "offset", "length")
    return rows.mapInArrow(run, "page_id long, payload binary")


def storage_frames(folder: str, bundle: str) -> list[tuple[int, int, int]]:
    """Frames of a stored bundle; reads its footer and table only."""
    store, path = storage._place(folder)
    size = store.get_file_info(f"{path}/{bundle}").size
    (foot,) = storage.get_ranges(folder, bundle, [(size - _FOOTER.size, _FOOTER.size)])
    n, _, _ = _FOOTER.unpack(foot)
    table = n * _ENTRY.size + _FOOTER.size
    (tail,) = storage.get_ranges(folder, bundle, [(size - table, table)])
    out, at = [], 0
    for k in range(n):
        packed, plain = _ENTRY.unpack_from(tail, k * _ENTRY.size)
        out.append((at, packed, plain))
        at += packed
    return out


def page_records(pages: DataFrame, **options) -> DataFrame:
    """Write the archives of all pages, read them back and describe each record; see `write`, `read`.

    One row per row of pages, whatever repeats; an empty table gives none. Other columns are left
    aside.
    """
    folder, index = write(pages, **options)
    if index.isEmpty():
        return pages.sparkSession.createDataFrame(
            [],
            "page_id long, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long, intact boolean",
        )
    return read(folder, index)
