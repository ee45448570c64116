"""Files of own formats in the shared folder, and small helpers that several operators use."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.session import checkpoint_root, written

#: Words of the contracts: what stands between white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


#: What this Python worker keeps from task to task, by kind.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What this Python worker keeps of a kind from task to task, until a step needs its memory."""
    return _kept.setdefault(kind, {})


def forget(but: str | None = None) -> None:
    """Drop what earlier steps left in this worker, but for one kind; a task of a step begins with it.

    Executors use workers again for all steps, so that what one keeps would stay beside the others'.
    What is free then goes back to the system, where the C library can do that.
    """
    left = [c for kind, c in _kept.items() if c and kind != but]
    for c in left:
        c.clear()
    pa.default_memory_pool().release_unused()
    if left:
        gc.collect()
        give_back()


def give_back() -> None:
    """Give what is free in this worker back to the system, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def new_folder(spark: SparkSession, kind: str) -> str:
    """The address of a new folder for files in the cluster's shared folder; an open scope frees it."""
    root = checkpoint_root(spark)
    return written(f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}")


def _place(address: str):
    from pyarrow import fs

    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def put_file(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under a name of its own, then move it into place.

    A task that runs again, on whatever executor, writes the same name with the same content.
    """
    store, path = _place(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for p in parts:
            out.write(p)
    store.move(draft, f"{path}/{name}")


def get_ranges(folder: str, name: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    """Parts of a file, by (offset, length)."""
    store, path = _place(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return [f.read_at(n, at) for at, n in ranges]


def get_file(folder: str, name: str) -> bytes | None:
    """A whole file; none if there is no such file."""
    store, path = _place(folder)
    try:
        with store.open_input_file(f"{path}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """name, content of the files in a folder that match a pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def word_count(text: Column) -> Column:
    """Words of a text as the contracts count them; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet, whatever columns came with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
