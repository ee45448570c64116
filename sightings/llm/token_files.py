"""Token ids of documents in files of Simple-8b words (operator 1).

A file holds documents in ascending order of their id. Layout, little-endian throughout:

    header   magic "S8TOKENS", then u64: block length, documents, ids, words, escapes
    doc ids  i64 per document, then u8 per document: 1 where the document has no id
    starts   u64 per document and the end: place of its first id in the file
    offsets  u64 per block and the end: its first word
    words    u64 each, as in simple8b.py
    escapes  u64 each

Any document is read by its starts and the offsets of the blocks that it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightings.llm import bpe, simple8b, storage
from sightings.llm.bpe import encoder
from sightings.session import cut, ship

MAGIC = b"S8TOKENS"
_HEADER = struct.Struct("<8s5Q")

#: Ids after which a file is closed. A longer document has a file of its own.
FILE_IDS = 4_000_000
#: Characters that go through the tokenizer together, and ids that are decoded together.
BATCH_CHARS = 1 << 20
BATCH_IDS = 1 << 19

_FILES = "name string, part int, seq int, n_docs long, n_ids long"


def pack(doc_ids: list[int | None], ids: list[bytes], block: int = simple8b.BLOCK) -> list:
    """A file's parts from each document's id and its token ids (u32)."""
    all_ids = np.frombuffer(b"".join(ids), "<u4")
    n_ids = len(all_ids)
    words, offsets, escaped = simple8b.encode(all_ids, block)
    del all_ids
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) // 4 for x in ids], out=starts[1:])
    missing = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return [
        _HEADER.pack(MAGIC, block, len(ids), n_ids, len(words), len(escaped)),
        keys.tobytes(), missing.tobytes(), starts.tobytes(), offsets.astype("<u8").tobytes(),
        memoryview(words.astype("<u8", copy=False)), escaped.astype("<u8").tobytes(),
    ]


class TokenFile:
    """A file's content, decoded as far as asked for."""

    def __init__(self, content: bytes) -> None:
        magic, self.block, self.n_docs, self.n_ids, n_words, n_escapes = _HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        keys, missing = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if m else k for k, m in zip(keys.tolist(), missing.tolist())]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = take("<u8", blocks + 1).astype(np.int64)
        self.words = take("<u8", n_words)
        self.escaped = take("<u8", n_escapes)
        if at != len(content):
            raise ValueError("a token file has another length than its header says")

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of documents `first` to `last` (end exclusive, default all)."""
        last = self.n_docs if last is None else last
        lo, hi = int(self.starts[first]), int(self.starts[last])
        b0, b1 = lo // self.block, -(-hi // self.block)
        part = simple8b.decode(self.words, self.offsets, self.escaped, self.n_ids, self.block, b0, b1)
        return part[lo - b0 * self.block : hi - b0 * self.block].astype("<u4")


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 0,
    file_ids: int = FILE_IDS,
    special_as_text: bool = False,
    folder: str | None = None,
    keep: bool = True,
) -> tuple[str, DataFrame]:
    """Encode `text` of docs and write token files in ascending order of `doc_id`.

    Returns the folder and one row per file (name, part, seq, n_docs, n_ids); files in the
    order of part and seq hold all documents in order. Null text is empty. A document without
    an id comes first, equal ids in the order of their texts. `end_id` is appended to each
    document. Other columns are left aside. The texts are sorted by range, so a task holds a
    batch of texts and the ids of one file. Workers keep the encoder for their next task; without
    `keep` they drop it at the end of each, as steps before may have left an executor more workers
    than it has cores, which take turns. A task then learns its pieces anew.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or storage.new_folder(spark, "tokens")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        storage.forget(but=bpe.KIND)
        part = TaskContext.get().partitionId()
        code, seq, held = encoder(tokenizer, special_as_text), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            name = f"{part:06d}-{seq:06d}.s8"
            storage.put_file(folder, name, pack(keys, ids))
            row = pa.RecordBatch.from_pydict(
                {
                    "name": [name],
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "n_docs": [len(keys)],
                    "n_ids": [held],
                }
            )
            seq, held = seq + 1, 0
            keys.clear()
            ids.clear()
            storage.give_back()
            return row

        def encoded(texts: list, names: list) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for key, x in zip(names, code.encode_all(texts)):
                x += end
                if keys and held + len(x) // 4 > file_ids:
                    yield close()
                keys.append(key)
                ids.append(x)
                held += len(x) // 4

        for b in batches:
            texts, names, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                texts.append(text)
                names.append(key)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield from encoded(texts, names)
                    texts, names, size = [], [], 0
            yield from encoded(texts, names)
        if keys:
            yield close()
        if not keep:
            code = None
            storage.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return folder, cut(ordered.mapInArrow(run, _FILES))


def with_starts(files: DataFrame) -> DataFrame:
    """Adds `before`: ids in all files before this one. One row per task meets in one place."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(line), F.lit(0)).alias("_base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))
    return files.join(parts, "part").withColumn("before", before).drop("_base")


def digests(folder: str, files: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and name per document."""
    spark = files.sparkSession

    def sums(f: TokenFile) -> Iterator[int]:
        first = 0
        while first < f.n_docs:
            last = int(np.searchsorted(f.starts, f.starts[first] + BATCH_IDS, "right")) - 1
            last = min(f.n_docs, max(first + 1, last))
            ids = memoryview(f.ids(first, last).tobytes())
            places = (4 * (f.starts[first : last + 1] - f.starts[first])).tolist()
            for a, z in zip(places, places[1:]):
                yield zlib.crc32(ids[a:z])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage.forget()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                f = TokenFile(memoryview(content.as_buffer()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": pa.array([name] * f.n_docs, pa.string()),
                        "doc_id": pa.array(f.doc_ids, pa.int64()),
                        "at": pa.array(f.starts[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(f.starts), pa.int64()),
                        "ids_crc32": pa.array(list(sums(f)), pa.int64()),
                    }
                )

    read = storage.read_files(spark, folder, "*.s8").mapInArrow(
        run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    placed = read.join(with_starts(files).select("name", "before"), "name")
    return placed.select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "name"
    )


def token_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files of docs, read them back and describe each document."""
    folder, files = write(docs, tokenizer, **options)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, start long, n_tokens long, ids_crc32 long, name string"
        )
    return digests(folder, files)
