"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols of the search are words. Windows of a benchmark item are the patterns; windows of one length share a
shift table over blocks of two words, and buckets by the last block, in which direct comparison confirms.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ALNUM, give_back, raw, slices

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text in one block of patterns; more text makes more blocks, never a larger one.
BLOCK_BYTES = 2 << 20
#: Bytes of documents that meet the blocks together: with one block, and with several, whose tables are made anew for each such part.
PART, PART_OF_SEVERAL = 2 << 20, 32 << 20


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of [0-9a-z] and bytes from 0x80 on."""
    return text.translate(ALNUM).split()


class WuManber:
    """Patterns of one length m. shift: how far a block's last place in any pattern is from the end; blocks not in it shift by all that is safe."""

    def __init__(self, patterns: Iterable[tuple[tuple[bytes, ...], object]], m: int):
        self.m, self.b = m, min(2, m)
        self.far = m - self.b + 1
        self.shift: dict[object, int] = {}
        self.buckets: dict[object, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for p, item in patterns:
            for j in range(self.b - 1, m):
                block = p[j] if self.b == 1 else (p[j - 1], p[j])
                self.shift[block] = min(self.shift.get(block, self.far), m - 1 - j)
            self.buckets[block][p].add(item)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def find(self, w: list[bytes]) -> Iterator[tuple[int, set]]:
        """Start and items of each place where a pattern occurs."""
        m, far, buckets, get = self.m, self.far, self.buckets, self.shift.get
        i, n = m - 1, len(w)
        if self.b == 1:
            for i, x in enumerate(w):
                if x in buckets:
                    yield i, buckets[x][(x,)]
            return
        while i < n:
            block = (w[i - 1], w[i])
            s = get(block, far)
            if s:
                i += s
                continue
            items = buckets[block].get(tuple(w[i - m + 1 : i + 1]))
            if items:
                yield i - m + 1, items
            i += 1


def matchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    by_size: dict[int, list] = defaultdict(list)
    for item, text in items:
        w = words(text)
        if len(w) >= window:
            by_size[window] += [(tuple(w[i : i + window]), item) for i in range(len(w) - window + 1)]
        elif w:
            by_size[len(w)].append((tuple(w), item))
    return [WuManber(p, m) for m, p in sorted(by_size.items())]


def hits(found: Iterable[WuManber], w: list[bytes]) -> tuple[np.ndarray, set]:
    """A mark for each word inside an occurrence, and the items with occurring windows."""
    edges, items = None, set()
    for wm in found:
        for at, got in wm.find(w):
            if edges is None:
                edges = np.zeros(len(w) + 1, np.int64)
            edges[at] += 1
            edges[at + wm.m] -= 1
            items |= got
    return (np.zeros(0, bool) if edges is None else np.cumsum(edges[:-1]) > 0), items


@dataclass(frozen=True)
class Block:
    """Benchmark items under a name that no other block of any run has."""

    run: str
    number: int
    items: Broadcast


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[Block]:
    """The benchmark in broadcast blocks of at most block_bytes of text (an item of more is a block of its own). The driver holds one block at a time."""
    sc, run, out, block, size = benchmark.sparkSession.sparkContext, uuid.uuid4().hex, [], [], 0
    rows = benchmark.where(F.col(f"`{text_col}`").isNotNull()).select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"), raw(text_col).alias("t"))
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            out.append(Block(run, len(out), sc.broadcast(block)))
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    return [*out, Block(run, len(out), sc.broadcast(block))] if block else out


#: The matchers of the block used last, by its name and the window: one block is in a worker's memory at a time.
_held: dict[tuple[str, int, int], list[WuManber]] = {}


def _matchers(block: Block, window: int) -> list[WuManber]:
    key = (block.run, block.number, window)
    if key not in _held:
        _held.clear()
        _held[key] = matchers(block.items.value, window)
    return _held[key]


@dataclass
class Marks:
    """What stands in one text: its words, those in occurrences of any window (n_hit), those in occurrences of whole windows (n_full), and the items."""

    n_words: int
    n_hit: int
    n_full: int
    items: list[str]


def _union(a: np.ndarray | None, b: np.ndarray) -> np.ndarray | None:
    return (b if a is None else a | b) if len(b) else a


def marks(texts: list[bytes], blocks: list[Block], window: int = WINDOW) -> list[Marks]:
    """Blocks are the outer loop, so that each block's tables are made once for all the texts."""
    full: list[np.ndarray | None] = [None] * len(texts)
    short: list[np.ndarray | None] = [None] * len(texts)
    items: list[set] = [set() for _ in texts]
    n_words = [0] * len(texts)
    for block in blocks:
        found = _matchers(block, window)
        kinds = ((full, [m for m in found if m.m == window]), (short, [m for m in found if m.m < window]))
        for k, x in enumerate(texts):
            w = words(x)
            n_words[k] = len(w)
            for held, kind in kinds:
                got, of = hits(kind, w)
                held[k] = _union(held[k], got)
                items[k] |= of
    if not blocks:
        n_words = [len(words(x)) for x in texts]
    count = lambda *parts: int(np.logical_or.reduce([p for p in parts if p is not None]).sum()) if any(p is not None for p in parts) else 0
    return [Marks(n, count(f, s), count(f), sorted(i)) for n, f, s, i in zip(n_words, full, short, items)]


def _parts(batches: Iterator[pa.RecordBatch], column: int, blocks: list[Block]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices(batch, PART_OF_SEVERAL if len(blocks) > 1 else PART, column):
            yield part, [x.encode() if isinstance(x, str) else x or b"" for x in part.column(column).to_pylist()]
        give_back()


def _share(min_share: float) -> Callable[[int, int], bool]:
    """Whether hits are at least min_share of words, in whole numbers."""
    parts = round(1 / min_share)
    if abs(parts * min_share - 1) > 1e-9:
        raise ValueError("min_share must be one over a whole number")
    return lambda n_hit, n_words: n_hit > 0 and parts * n_hit >= n_words


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: id, n_words, n_hit, item_ids array<string> sorted, contaminated (n_hit > 0 and n_hit >= min_share * n_words).

    No shuffle: documents meet the benchmark's blocks where they are. Null and empty texts have no words and are clean;
    an empty benchmark hits nothing; items of fewer words than the window are one window; items without words never occur;
    repeated documents each get their row. An item's null id counts as the empty string.
    """
    blocks, enough = pattern_blocks(benchmark, item_col, item_text, block_bytes), _share(min_share)
    given = docs.select(F.col(f"`{id_col}`").alias("id"), raw(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, 1, blocks):
            got = marks(texts, blocks, window)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([m.n_words for m in got], pa.int64()), pa.array([m.n_hit for m in got], pa.int64()),
                    pa.array([m.items for m in got], pa.list_(pa.string())), pa.array([enough(m.n_hit, m.n_words) for m in got], pa.bool_()),
                ],
                [id_col, "n_words", "n_hit", "item_ids", "contaminated"],
            )

    return given.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_hit bigint, item_ids array<string>, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = 0.05, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of full length occurs and less than min_share of whose words stand in occurrences of shorter items.

    Null and empty texts stay, and with an empty benchmark all do. One occurrence of a full window is enough, however long the
    document is; an item of a word or two occurs by chance, so that items shorter than the window need their share.
    """
    blocks, enough = pattern_blocks(benchmark, item_col, item_text, block_bytes), _share(min_share)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, at, blocks):
            yield part.filter(pa.array([not m.n_full and not enough(m.n_hit, m.n_words) for m in marks(texts, blocks, window)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
