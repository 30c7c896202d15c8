"""Token ids as wavelet matrices: one compressed file per shard, read back for access, counts and places of tokens.

Documents are encoded with the tokenizers library (added tokens inside a text as it does by default), an end id is appended, and documents
in ascending order of doc_id (null first, repeated ids by text) are cut into shards of about SHARD_IDS ids. A shard is one Parquet file of one row:
the documents, their lengths, and one bit-plane per bit of an id, highest first, with the number of zeros and ones counted per block
of 4,096 bits (rank directory). Planes lie in their own column chunk each, compressed; whoever needs the documents only reads no plane.

Encoding is remembered per piece of the split pattern (transducers.py): the library encodes each distinct piece once, a piece's ids do not
depend on what surrounds it. Order comes from a range partitioning by doc_id, so no task holds more than its range; the start of a
shard is summed from the partitions' totals, one row each.

Null texts are empty: the end id alone. Repeated rows are written each. Further columns are ignored. An empty table writes no shard.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import on_workers, shared_folder
from ledgerlift.llm.transducers import compiled, passes, split

SHARD_IDS = 1_000_000
KEPT_PIECES = 1_000_000  # whose ids a worker remembers
JOINED_PIECES = 2_000    # new pieces that are encoded as one text
BLOCK = 4096  # bits per entry of the rank directory
SHARD = ("part int, serial int, n_ids long, bits int, docs array<bigint>, lens binary, zeros array<bigint>, ranks binary, "
         "planes array<binary>")
READ = "part int, serial int, doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """A sequence of ids below 2^bits as bit-planes. Positions count from 0; ranges are half open."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int, ranks: list[np.ndarray] | None = None):
        self.planes, self.zeros, self.n = planes, zeros, n
        self.ranks = ranks if ranks is not None else [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        size = BLOCK // 8
        padded = np.zeros(-(-max(1, len(plane)) // size) * size, np.uint8)
        padded[:len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, size).sum(axis=1)
        return np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = (row & row.dtype.type(1 << k)) != 0
            planes.append(np.packbits(one))
            low = row.take(np.flatnonzero(~one))
            zeros.append(len(low))
            row = np.concatenate((low, row.take(np.flatnonzero(one))))
        return cls(planes, zeros, len(ids))

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        row = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.n).view(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~one)] = row[:z]
            at = np.flatnonzero(one)
            up[at] = row[z:] | row.dtype.type(1 << k)
            row = up
        return row

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block = i // BLOCK
        lo, hi = block * BLOCK // 8, i >> 3
        ones = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][lo:hi]).sum())
        return ones + ((int(self.planes[k][hi]) >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8:(block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        """The id at a position."""
        value = 0
        for k, z in enumerate(self.zeros):
            bit, ones = self._bit(k, i), self.rank(k, i)
            value = value << 1 | bit
            i = z + ones if bit else i - ones
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's places of a range stand below the lowest plane."""
        bits = len(self.planes)
        for k, z in enumerate(self.zeros):
            a, b = self.rank(k, lo), self.rank(k, hi)
            lo, hi = (z + a, z + b) if token >> (bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands in a range."""
        if token >> len(self.planes):
            return 0
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def places(self, token: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """Positions of a token in a range, ascending."""
        if token >> len(self.planes):
            return []
        a, b = self._span(token, lo, self.n if hi is None else hi)
        out = []
        for i in range(a, b):
            for k in range(len(self.planes) - 1, -1, -1):
                bit = token >> (len(self.planes) - 1 - k) & 1
                i = self.select(k, bit, i - self.zeros[k] if bit else i)
            out.append(i)
        return out


def matrix_of(row: dict) -> WaveletMatrix:
    planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
    ranks = np.frombuffer(row["ranks"], np.uint32)
    return WaveletMatrix(planes, list(row["zeros"]), row["n_ids"], np.split(ranks, len(planes)) if planes else [])


class Numbers(dict):
    """Numbers pieces in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


class Encoder:
    """Ids of whole texts by the tokenizers library, remembered per piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.machine = Tokenizer.from_file(path), compiled(path)
        self.size = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.index = Numbers()
        self.store, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self) -> None:
        """Encode the pieces that the index met for the first time."""
        # a space and letters are one piece wherever they stand, so many are encoded as one text; its words are the pieces again
        plain = [u[:1] == " " and u[1:].isalpha() for u in self.index.new]
        whole = list(compress(self.index.new, plain))
        found, sizes = [], []
        for at in range(0, len(whole), JOINED_PIECES):
            part = whole[at:at + JOINED_PIECES]
            both = self.tokenizer.encode("".join(part), add_special_tokens=False)
            counts = np.bincount(both.word_ids)
            if len(counts) != len(part):  # letters by another version of Unicode
                alone = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                found.append(list(chain.from_iterable(alone)))
                sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
            else:
                found.append(both.ids)
                sizes.append(counts)
        others = [e.ids for e in self.tokenizer.encode_batch_fast(list(compress(self.index.new, map(not_, plain))), add_special_tokens=False)]
        order = np.argsort(~np.array(plain), kind="stable")  # the plain ones, then the others
        sizes = np.concatenate([*sizes, np.fromiter(map(len, others), np.int64, len(others))])
        n, k = int(sizes.sum()), len(self.index) - len(sizes)
        while len(self.index) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.used + n > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used:self.used + n] = np.fromiter(chain.from_iterable([*found, *others]), np.uint32, n)
        self.begin[k + order] = self.used + np.cumsum(sizes) - sizes
        self.length[k + order] = sizes
        self.used += n
        self.index.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.index) > KEPT_PIECES:
            self._forget()
        whole = {k: self.tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)
                 if any(word in t for word in self.machine.added)}
        pieces, n_pieces = split(["" if k in whole else t for k, t in enumerate(texts)])
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.index.new:
            self._add()
        size = self.length[at]
        ends = np.cumsum(size)
        ids = self.store.take(np.repeat(self.begin[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0))
        sums, last = np.concatenate(([0], ends)), np.cumsum(n_pieces)
        lens = sums[last] - sums[last - n_pieces]
        if whole:
            parts = np.split(ids, np.cumsum(lens)[:-1])
            parts = [np.array(whole[k], np.uint32) if k in whole else p for k, p in enumerate(parts)]
            ids, lens = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, lens


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text) into shard files under the path."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, serial = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = max(1, int(max(enc.size - 1, end_id)).bit_length())
        docs_in, ids_in, lens_in, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(ids_in)
            matrix = WaveletMatrix.build(ids, bits)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "serial": pa.array([serial], pa.int32()), "n_ids": [len(ids)], "bits": pa.array([bits], pa.int32()),
                "docs": pa.array([docs_in], pa.list_(pa.int64())), "lens": [np.concatenate(lens_in).astype(np.int64).tobytes()],
                "zeros": pa.array([matrix.zeros], pa.list_(pa.int64())), "ranks": [np.concatenate(matrix.ranks).tobytes()],
                "planes": [[p.tobytes() for p in matrix.planes]]})

        for rb in batches:
            names, texts = rb.column(0).to_pylist(), [t or "" for t in rb.column(1).to_pylist()]
            for lo, hi in passes(texts):
                ids, lens = enc.encode(texts[lo:hi])
                ended = np.full(len(ids) + len(lens), end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(lens)), lens)] = ids
                docs_in += names[lo:hi]
                ids_in.append(ended)
                lens_in.append(lens + 1)
                held += len(ended)
                if held >= shard_ids:
                    yield close()
                    docs_in, ids_in, lens_in, held, serial = [], [], [], 0, serial + 1
        if docs_in:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, SHARD).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards as rows, planes and all; matrix_of(row) answers questions about one."""
    return spark.read.schema(SHARD).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    on_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                ids = matrix_of(row).ids().astype("<u4")
                lens = np.frombuffer(row["lens"], np.int64)
                ends = np.cumsum(lens)
                n = len(lens)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * n, pa.int32()), "serial": pa.array([row["serial"]] * n, pa.int32()),
                    "doc_id": pa.array(row["docs"], pa.int64()), "start": ends - lens, "n_tokens": lens,
                    "ids_crc32": pa.array([zlib.crc32(ids[e - k:e]) for e, k in zip(ends.tolist(), lens.tolist())], pa.int64())})

    shards = read_shards(spark, path)
    sizes = shards.select("part", "serial", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range partition
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("serial")) - F.col("n_ids")
    offsets = sizes.withColumn("inside", inside).join(before, "part").select("part", "serial", (F.col("before_part") + F.col("inside")).alias("offset"))
    return shards.mapInArrow(run, READ).join(offsets, ["part", "serial"]).select(
        "doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """write_shards under the path (a new one in the shared folder), then read_documents."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
