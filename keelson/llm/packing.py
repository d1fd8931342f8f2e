"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are cut at the capacity into full windows and a remainder. The remainders of a
block of documents are dealt to the fewest windows that could hold them: the two partial
partitions with the largest imbalance are merged, large sums meeting small ones, until one
partition is left, whose windows are nearly equal. If one exceeds the capacity the window
count rises; after a bounded rise the excess is cut off and moved to windows with room.
Blocks are runs of documents inside a task, so packing needs no shuffle, and what a task
holds is one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import text_bytes
from keelson.llm.vocab import word_vocab

#: Documents, and tokens, after which a block is packed.
BLOCK_DOCS = 2048
BLOCK_TOKENS = 1 << 22
#: Windows above the fewest, as a share, before excess is cut instead.
RISE = 0.004


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in so many windows of nearly equal sums.

    A partial partition is the sorted non-zero sums with their member trees; windows not
    listed are empty. Ties go to the partition made first, so the result is the same each time.
    """
    order = count()
    heap: list[tuple[int, int, np.ndarray, list]] = []
    for i, size in enumerate(sizes):
        heap.append((-size if windows > 1 else 0, next(order), np.array([size]), [i]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        # both ascending; with implied zeros in front, the largest of one meets the smallest of the other
        meet = max(0, len(a) + len(b) - windows)
        if meet:
            na, nb = len(a), len(b)
            # windows sums: a descending against b ascending; only the last of each overlap
            sums = np.concatenate((a[meet:], a[:meet] + b[:meet][::-1], b[meet:]))
            trees = left[meet:] + list(zip(left[:meet], right[:meet][::-1])) + right[meet:]
            assert len(sums) == na + nb - meet
        else:
            sums, trees = np.concatenate((a, b)), left + right
        rank = np.argsort(sums, kind="stable")
        sums = sums[rank]
        trees = [trees[k] for k in rank.tolist()]
        spread = int(sums[-1] - (sums[0] if len(sums) == windows else 0))
        heapq.heappush(heap, (-spread, next(order), sums, trees))
    bins: list[list[int]] = []
    for tree in heap[0][3] if heap else []:
        members, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                members.append(node)
        bins.append(sorted(members))
    return bins + [[] for _ in range(windows - len(bins))]


def pack_block(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length); every token of every document in one of them."""
    full, rest, sizes = [], [], []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((d, whole))
            sizes.append(n - whole)
    if not sizes:
        return full
    fewest = -(-sum(sizes) // capacity)
    most = fewest + int(fewest * RISE)
    for windows in range(fewest, most + 1):
        bins = differencing(sizes, windows)
        if max(sum(sizes[i] for i in b) for b in bins) <= capacity:
            break
    packed = [[(*rest[i], sizes[i]) for i in b] for b in bins]
    return full + _level(packed, capacity)


def _level(windows: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Cut what exceeds the capacity off the longest piece and fill windows with room, fullest first."""
    over: list[tuple[int, int, int]] = []
    for window in windows:
        excess = sum(p[2] for p in window) - capacity
        while excess > 0:
            k = max(range(len(window)), key=lambda j: window[j][2])
            d, start, n = window[k]
            cut = min(excess, n)
            window[k : k + 1] = [(d, start, n - cut)] if n > cut else []
            over.append((d, start + n - cut, cut))
            excess -= cut
    over.sort(key=lambda p: (-p[2], p))
    for window in sorted((w for w in windows if over), key=lambda w: -sum(p[2] for p in w)):
        room = capacity - sum(p[2] for p in window)
        while room > 0 and over:
            d, start, n = over.pop(0)
            window.append((d, start, min(n, room)))
            if n > room:
                over.insert(0, (d, start + room, n - room))
            room -= min(n, room)
    return [w for w in windows if w]


PIECES = "id {0}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` are the piece's token ids, little-endian unsigned 32 bits each. Every document ends
    with ``end_id``, so a null or empty text is one piece of one token. Sequence ids are unique,
    not consecutive: they count up within a task. Repeated rows and null ids are packed like any
    other; an empty table gives an empty result; other columns are not read. A document longer
    than the capacity is cut; the padding of a block is less than one window beyond ``RISE``.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = word_vocab(path)
        end = np.array([end_id], vocab.dtype)
        sequence = TaskContext.get().partitionId() << 40
        id_type = None
        names: list = []
        coded: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for window in pack_block([len(c) for c in coded], capacity):
                offset = 0
                for d, start, n in window:
                    wide = coded[d][start : start + n].astype("<u4").tobytes()
                    out.append((names[d], start, n, len(coded[d]), sequence, offset, wide))
                    offset += n
                sequence += 1
            kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, ids in zip(batch.column(0).to_pylist(), vocab.encode_all(batch.column(1).to_pylist())):
                names.append(name)
                coded.append(np.concatenate((ids, end)))
                held += len(coded[-1])
                if len(names) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield close()
                    names, coded, held = [], [], 0
        if names:
            yield close()

    return rows.mapInArrow(run, PIECES.format(kind.simpleString())).withColumnRenamed("id", id_col)
