"""Token ids in directly addressable codes.

A segment holds the ids of whole documents. Each id is split into chunks of 8 bits, lowest first. Level 0 has
a chunk of every id; a level's bitmap marks the ids that go on in the next level, and a directory of counts
every 512 bits gives the rank of a mark, which is the place of the id's chunk in the next level. So the id at
any place is read by at most one chunk, one bit and one rank a level, without decoding a block.

Bytes of a segment: ``DAC1``, number of ids (u64), number of levels (u8); then for each level the number of
chunks (u64), the chunks, the bitmap (little bit order, padded to 64 bytes) and its directory (u32, one for
each 512 bits; the last level has neither). All numbers are little-endian. The container is a Parquet
table, so it can lie in any store that Spark writes: part, seq, doc_ids, lengths, codes."""

from __future__ import annotations

import os
import random
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow, new_path

MAGIC = b"DAC1"
#: Ids after which a segment ends (with the document that reaches them).
SEGMENT = 1 << 17
#: Parts of words whose ids a worker keeps.
KEPT = 500_000
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_segment(ids: np.ndarray) -> bytes:
    """``ids``: unsigned 32-bit integers."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        chunk = (rest & np.uint32(255)).astype(np.uint8)
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            levels.append((chunk, None))
            break
        levels.append((chunk, more))
        rest = rest[more]
    out = [MAGIC, struct.pack("<QB", len(ids), len(levels))]
    for chunk, more in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if more is not None:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
            ones = _BITS[bits].reshape(-1, 64).sum(axis=1, dtype=np.uint32)
            out += [bits.tobytes(), np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """Random access to the ids of an encoded segment."""

    def __init__(self, data: bytes):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment")
        self.n, count = struct.unpack_from("<QB", data, 4)
        at, self.levels = 13, []
        for level in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            if level == count - 1:
                self.levels.append((chunk, None, None))
                break
            size = -(-(-(-n // 8)) // 64) * 64
            bits = np.frombuffer(data, np.uint8, size, at)
            ranks = np.frombuffer(data, "<u4", size // 64, at + size)
            at += size + 4 * (size // 64)
            self.levels.append((chunk, bits, ranks))

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``, in any order."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.n):
            raise IndexError("no such place in the segment")
        out = np.zeros(len(places), np.uint32)
        who = np.arange(len(places))
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            out[who] |= chunk[places].astype(np.uint32) << np.uint32(8 * level)
            if bits is None:
                break
            byte, bit = places >> 3, (places & 7).astype(np.uint8)
            more = (bits[byte] >> bit & 1).astype(bool)
            who, byte, bit = who[more], byte[more], bit[more]
            places = self._rank(bits, ranks, byte, bit)
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Marks before each bit: the directory's count, those of the bytes since, and of the own byte. Only the
        64 bytes of a bit's group are read; for as many places as the bitmap has groups, all groups are, once."""
        own = _BITS[bits[byte] & ((np.uint16(1) << bit.astype(np.uint16)) - 1).astype(np.uint8)]
        if len(byte) < len(ranks):
            group = bits[(byte & ~63)[:, None] + np.arange(64)]
            since = (_BITS[group] * (np.arange(64) < (byte & 63)[:, None])).sum(axis=1, dtype=np.int64)
        else:
            ones = _BITS[bits[:]].reshape(-1, 64)
            within = np.zeros((len(ones), 64), np.int64)
            np.cumsum(ones[:, :-1], axis=1, out=within[:, 1:])
            since = within.reshape(-1)[byte]
        return ranks[byte >> 6].astype(np.int64) + since + own


#: Texts that a vocabulary is tried on.
PROBES = 256


class Encoder:
    """Ids of texts by the tokenizers library. The vocabulary is one whose pretokens never span white space,
    nor plain letters and signs (a word's 's and the like aside), nor digits, and take small for capital
    letters. So a text's ids are those of its parts, and a worker asks the library once for each part that it
    keeps. That is tried on PROBES texts when the file is loaded; a vocabulary that fails gets whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.table = textops.HashTable(KEPT)
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.by_parts = self._parts_suffice()

    def _parts_suffice(self) -> bool:
        """Whether the ids of random texts of mixed characters are those of their parts."""
        rng = random.Random(1)
        kinds = ["abcdefghij", "ABCXYZ", "éÀßñÉ", "0123456789", ".,;:!?-()\"/", "'", " \t\n  ", "漢字かな", "😀€", "щЖλ"]
        texts = ["".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.5 else rng.choice(kinds[i % 3] + " ") for _ in range(60)) for i in range(PROBES)]
        texts += ["don't I'll it's", "A1b2 c3", "  two  spaces ", "end. Next,word", "Straße ÉTÉ naïve"]
        ids, counts = self._encode_parts(pa.array(texts, pa.large_string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == self._ask(texts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large string column, and how many each text has."""
        if self.by_parts:
            return self._encode_parts(column)
        found = self._ask(column.to_pylist())
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _ask(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = textops.raw(column)
        h, owner, s, e = textops.plain_parts(data, offsets)
        place, flat, starts = self.table.get(h), self.flat, self.starts
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            whole = data.tobytes()
            ids = self._ask([whole[s[i] : e[i]].decode("utf-8", "replace") for i in missing[first]])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            place[missing] = len(starts) - 1 + inverse
            starts = np.concatenate([starts, starts[-1] + np.cumsum(sizes)])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            if self.table.n + len(new) <= KEPT:  # else they are known for these texts only
                self.table.add(new)
                self.flat, self.starts = flat, starts
        begin = starts[place]
        length = starts[place + 1] - begin
        ends = np.cumsum(length)
        ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - length), length)]
        edges = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(len(offsets)))]
        counts = np.diff(edges)
        odd = {i for x in self.special for i in self._holders(data, offsets, x)}
        if odd:  # whole texts for the library
            own = {i: np.array(x, np.uint32) for i, x in zip(odd, self._ask([column[i].as_py() for i in odd]), strict=True)}
            ids = np.concatenate([np.empty(0, np.uint32), *(own[i] if i in own else ids[edges[i] : edges[i + 1]] for i in range(len(counts)))])
            counts = np.array([len(own[i]) if i in own else c for i, c in enumerate(counts)], np.int64)
        return ids, counts

    @staticmethod
    def _holders(data: np.ndarray, offsets: np.ndarray, special: bytes) -> list[int]:
        found = [m.start() for m in re.finditer(re.escape(special), data.tobytes())]
        return sorted({int(np.searchsorted(offsets, at, side="right")) - 1 for at in found})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Write the ids of all texts, each with ``end_id`` appended, as segments in ascending order of id_col.

    Range partitions are written in order: ``part`` counts them, ``seq`` the segments of one. Null texts are
    empty; null ids come first; rows with equal ids keep no set order among themselves but by their texts.
    A text of any length is in one segment. Other columns are not read."""
    spark = docs.sparkSession
    arrow_batches(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq = encoder(tokenizer).encode, 0
        ids, lengths, values, size, part = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([[x for y in ids for x in y]], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([encode_segment(np.concatenate(values))], pa.binary())],
                names=["part", "seq", "doc_ids", "lengths", "codes"],
            )

        for batch in batches:
            texts = textops.text_column(batch.column(2))
            part = batch.column(0)[0].as_py() if len(batch) else part
            for a, b in textops.pieces(textops.raw(texts)[1], 1 << 19):
                own, counts = encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                values.append(np.insert(own, ends, np.uint32(end_id)))
                lengths.append(counts + 1)
                ids.append(batch.column(1).slice(a, b - a).to_pylist())
                size += len(values[-1])
                if size >= SEGMENT:
                    yield segment()
                    ids, lengths, values, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield segment()

    map_arrow(ranged, run, "part int, seq long, doc_ids array<long>, lengths array<long>, codes binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: (doc_id, start, n_tokens, ids_crc32), ids taken from the codes
    at their places. ``start`` adds up the ids of all documents before: over parts by a window of one row a
    part, whose number the writer set, and within a part over its segments."""
    stored = spark.read.schema("part int, seq long, doc_ids array<long>, lengths array<long>, codes binary").parquet(path)
    sizes = stored.select("part", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    totals = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    own = Window.partitionBy("part").orderBy("seq")
    starts = sizes.select("part", "seq", (F.sum("ids").over(own) - F.col("ids")).alias("inside")).join(before, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, lengths, codes = (batch.column(k)[i] for k in (0, 1, 2))
                size = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(size)
                begins = ends - size
                segment, crc = Segment(codes.as_buffer()), []
                for a, b in textops.pieces(np.concatenate([[0], ends]), 1 << 20):
                    values = memoryview(segment.get(np.arange(begins[a], ends[b - 1])).astype("<u4").tobytes())
                    shift = begins[a]
                    crc += [zlib.crc32(values[4 * (x - shift) : 4 * (y - shift)]) for x, y in zip(begins[a:b], ends[a:b], strict=True)]
                start = batch.column(3)[i].as_py()
                yield pa.record_batch([pa.array(ids.as_py(), pa.int64()), pa.array(begins + start, pa.int64()), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # the files' codes stay where they are read; only a number for each segment meets them
    placed = stored.join(F.broadcast(starts), ["part", "seq"]) if starts.count() <= 1 << 20 else stored.join(starts, ["part", "seq"])
    return map_arrow(placed.select("doc_ids", "lengths", "codes", "start"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back: ``read_tokens`` of ``write_tokens``. An empty
    table gives an empty result."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(spark, path).withColumnRenamed("doc_id", id_col)
