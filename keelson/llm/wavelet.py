"""Token ids as a wavelet matrix per shard: one compressed file that answers access, rank, select and occurrence queries.

A shard holds the ids of consecutive documents. Plane by plane, from the highest bit,
the matrix keeps that bit of every token and sorts the tokens stably by it; ones before
every block of 512 bits are counted, so rank needs one look-up and a popcount. Planes
are packed bits under zstd, next to the documents' ids and offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import stored, text_bytes
from keelson.llm.vocab import word_vocab

MAGIC = b"KWM1"
#: Bits between two entries of the rank directory.
BLOCK = 512
#: Tokens after which a shard is closed; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 17
#: Rows that one partition of the sort should hold at most about.
PART_ROWS = 50_000


class WaveletMatrix:
    """Bit planes of a token sequence, highest bit first."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int) -> None:
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        planes, zeros, row = [], [], tokens
        for level in range(bits - 1, -1, -1):
            one = (row & tokens.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = np.compress(~one, row)
            zeros.append(len(low))
            row = np.concatenate((low, np.compress(one, row)))
        return cls(planes, zeros, len(tokens))

    def tokens(self, dtype: np.dtype) -> np.ndarray:
        """The whole sequence: undo the stable sorts from the lowest plane up."""
        row = np.zeros(self.n, dtype)
        # positions, not masks, choose the rows: they cost the same for any bit pattern
        for level in range(self.bits):
            plane = self.bits - 1 - level
            one = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool)
            z = self.zeros[plane]
            before = np.empty_like(row)
            before[np.flatnonzero(~one)] = row[:z]
            before[np.flatnonzero(one)] = row[z:] | dtype.type(1 << level)
            row = before
        return row

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if self._ones is None:  # the rank directory
            counts = [np.unpackbits(p, bitorder="little").reshape(-1, 8).sum(1, dtype=np.int64) for p in self.planes]
            step = BLOCK // 8
            self._ones = [np.concatenate(([0], np.cumsum(np.add.reduceat(c, np.arange(0, len(c), step))))) if len(c) else np.zeros(1, np.int64) for c in counts]
        block = i // BLOCK
        rest = self.planes[plane][block * BLOCK // 8 : (i + 7) // 8]
        bits = np.unpackbits(rest, count=i - block * BLOCK, bitorder="little") if i > block * BLOCK else ()
        return int(self._ones[plane][block]) + int(np.sum(bits))

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = self.planes[plane][i >> 3] >> (i & 7) & 1
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for plane in range(self.bits):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token among the first ``end``."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, min(max(end, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, k from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._select_bit(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        low, high = 0, self.n  # smallest i with more than k such bits in the first i
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def pack_shard(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """The file: header, then zstd frames of the documents, the plane directory and each plane."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(tokens)
    known = np.array([i is not None for i in ids], bool)
    numbers = np.array([i or 0 for i in ids], "<i8")
    head = np.packbits(known).tobytes() + numbers.tobytes() + np.array(lengths, "<u8").tobytes() + np.array(matrix.zeros, "<u8").tobytes()
    parts = [squeeze(head), *(squeeze(p.tobytes()) for p in matrix.planes)]
    sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return MAGIC + struct.pack("<QQBB", len(ids), matrix.n, matrix.bits, tokens.dtype.itemsize) + sizes + b"".join(parts)


class Shard:
    """A shard file opened for reading."""

    def __init__(self, content: bytes) -> None:
        import zstandard

        if content[:4] != MAGIC:
            raise ValueError("not a shard file")
        grow = zstandard.ZstdDecompressor().decompress
        docs, n, bits, width = struct.unpack_from("<QQBB", content, 4)
        sizes = struct.unpack_from(f"<{bits + 1}Q", content, 22)
        at, parts = 22 + 8 * (bits + 1), []
        for size in sizes:
            parts.append(grow(content[at : at + size]))
            at += size
        head, mask = parts[0], (docs + 7) // 8
        known = np.unpackbits(np.frombuffer(head[:mask], np.uint8), count=docs)
        numbers = np.frombuffer(head, "<i8", docs, mask)
        self.ids = [int(i) if k else None for i, k in zip(numbers, known)]
        self.lengths = np.frombuffer(head, "<u8", docs, mask + 8 * docs).astype(np.int64)
        zeros = np.frombuffer(head, "<u8", bits, mask + 16 * docs).tolist()
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.matrix = WaveletMatrix([np.frombuffer(p, np.uint8) for p in parts[1:]], zeros, n)

    def tokens(self) -> np.ndarray:
        return self.matrix.tokens(self.dtype)


FILES = "part int, seq int, n_docs long, n_tokens long, content binary"


def write_shards(
    docs: DataFrame, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, end every document with ``end_id``, and write shard files in ascending order of the id.

    The files are the ``content`` of rows of a committed table in the shared folder (so a lost
    task or a speculative one leaves no half-written file on any file system); (part, seq) is
    their order. Null ids come first; rows of one id are ordered by text; a null text is the
    end id alone. An empty table gives no files. One range partitioning by id is the only
    shuffle; a worker holds one shard at a time.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = word_vocab(path)
        end = np.array([end_id], vocab.dtype)
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        coded: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            content = pack_shard(ids, list(map(len, coded)), np.concatenate(coded))
            tokens = sum(map(len, coded))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([content], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "content"],
            )

        for batch in batches:
            for number, found in zip(batch.column(0).to_pylist(), vocab.encode_all(batch.column(1).to_pylist())):
                ids.append(number)
                coded.append(np.concatenate((found, end)))
                size += len(coded[-1])
                if size >= shard_tokens:
                    yield close()
                    ids, coded, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    return stored(ordered.mapInArrow(build, FILES), "shards")


def read_shards(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, ``start`` (ids before it), ``n_tokens``, ``ids_crc32`` of 32-bit ids."""
    # two steps, so no task sums over all files: totals of the parts, then files inside a part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_file_start")).join(parts, "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(content)
                wide = memoryview(shard.tokens().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "seq", "id", "at", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "seq", "content").mapInArrow(decode, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select(
        F.col("id").alias(id_col), (F.col("_part_start") + F.col("_file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
