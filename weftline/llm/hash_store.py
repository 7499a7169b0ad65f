"""Sorted hash arrays in the shared folder, which workers map into memory.

Keys are 64-bit hashes; a shard holds those of one prefix, sorted as unsigned integers, in a file, and each value column in
another. A shard's files are the same whichever task writes them and come into place by renaming, so that a task may run again.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def put(uri: str, data: bytes | memoryview) -> None:
    """Writes a file whole or not at all."""
    spare = f"{uri}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(spare), "wb") as f:
            f.write(data)
        os.replace(_local(spare), path)
        return
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path))
    with store.open_output_stream(f"{path}.{spare[-32:]}") as f:
        f.write(data)
    store.move(f"{path}.{spare[-32:]}", path)


#: Files that a worker has mapped at once; each may hold a descriptor.
MAPPED = 256


def _map(f, kind: str) -> np.ndarray:
    size = os.fstat(f.fileno()).st_size
    return np.frombuffer(mmap.mmap(f.fileno(), size, prot=mmap.PROT_READ), kind) if size else np.zeros(0, kind)


@lru_cache(maxsize=MAPPED)
def mapped(uri: str, kind: str) -> np.ndarray:
    """A file as an array, mapped into memory; a file that isn't there is empty. What isn't on a mounted file system is fetched to a nameless local file first."""
    if path := _local(uri):
        try:
            with open(path, "rb") as f:
                return _map(f, kind)
        except FileNotFoundError:
            return np.zeros(0, kind)
    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, kind)
    with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            f.write(block)
        f.flush()
        return _map(f, kind)


def write(rows: DataFrame, folder: str, bits: int, values: dict[str, str]) -> int:
    """Writes rows (key bigint, unique, and values, by name their numpy kind) and returns how many there are."""
    names = list(values)

    def run(batches):
        parts = [[np.asarray(b.column(i)) for i in range(len(names) + 1)] for b in batches if b.num_rows]
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else []
        sizes = []
        if cols:
            key = cols[0].view(np.uint64)
            order = np.argsort(key)
            key = key[order]
            shard = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            for lo, hi in zip(at, [*at[1:], len(key)]):
                put(f"{folder}/{shard[lo]:07d}.key", key[lo:hi].astype("<u8").tobytes())
                for n, c in zip(names, cols[1:]):
                    put(f"{folder}/{shard[lo]:07d}.{n}", c[order[lo:hi]].astype(values[n]).tobytes())
                sizes.append(int(hi - lo))
        yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)], pa.int64())], ["n"])

    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)
    dealt = rows.select("key", *names).repartition(1 << bits, shard)
    return dealt.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def lookup(folder: str, bits: int, keys: np.ndarray, values: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which keys are there, and their values (0 for those that aren't). Touches the shards of the keys' prefixes only."""
    order = np.argsort(keys)
    q = keys[order]
    there = np.zeros(len(q), bool)
    got = {n: np.zeros(len(q), k) for n, k in values.items()}
    shard = (q >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(q), np.int64)
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    for lo, hi in zip(at, [*at[1:], len(q)]):
        held = mapped(f"{folder}/{shard[lo]:07d}.key", "<u8")
        if not len(held):
            continue
        place = np.minimum(np.searchsorted(held, q[lo:hi]), len(held) - 1)
        hit = held[place] == q[lo:hi]
        there[lo:hi] = hit
        for n, k in values.items():
            got[n][lo:hi][hit] = mapped(f"{folder}/{shard[lo]:07d}.{n}", k)[place[hit]]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return there[back], {n: v[back] for n, v in got.items()}
