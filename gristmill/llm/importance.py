"""Importance resampling toward a target distribution, over hashed n-grams whose CRCs are composed by algebra.

CRC-32 is linear over GF(2): the CRC of A followed by B is the CRC of B, exclusive-or the CRC of A moved on by B's
length, and moving on by n bytes is a 32 x 32 matrix. Each word's CRC is computed once; those of its bigrams and
trigrams come from it by matrices looked up by length. No n-gram is ever written as a string.

One pass counts the features by bucket over all documents, a table of one size for any corpus; the target's features
are counted the same way. A second pass sums each document's gains. Documents are then drawn without replacement by
their weight plus Gumbel noise: the highest sums, ranked over range partitions, never in one task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow, materialize

#: Hash buckets of the features, and the words of the longest feature.
BUCKETS, LONGEST_GRAM = 10_000, 3
#: A document is eligible from so many words on; of the eligible ones so many hundredths are drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Eligible rows of a range partition in which ranks are counted, about.
RANK_ROWS = 1 << 20
#: Bytes of a word or a shift beyond which it is handled by itself.
SHORT = 255
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
U32 = np.uint32

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _byte_steps() -> np.ndarray:
    """The CRC register after one more byte, by its low byte."""
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & U32(1), (c >> U32(1)) ^ U32(POLYNOMIAL), c >> U32(1))
    return c


def _spread(columns: np.ndarray) -> np.ndarray:
    """A matrix (32 columns) as four tables by byte, so that a product is four look-ups."""
    out = np.zeros((4, 256), U32)
    for bit in range(8):
        has = (np.arange(256) >> bit & 1).astype(bool)
        for k in range(4):
            out[k, has] ^= columns[8 * k + bit]
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & U32(255)] ^ tables[1][crc >> U32(8) & U32(255)] ^ tables[2][crc >> U32(16) & U32(255)] ^ tables[3][crc >> U32(24)]


_UNIT = U32(1) << np.arange(32, dtype=U32)


@cache
def _power(k: int) -> np.ndarray:
    """The matrix that moves a CRC on by 2^k zero bytes."""
    if k == 0:
        return _spread((_UNIT >> U32(8)) ^ _byte_steps()[_UNIT & U32(255)])
    half = _power(k - 1)
    return _spread(_apply(half, _apply(half, _UNIT)))


def _long_shift(crc: np.ndarray, n: int) -> np.ndarray:
    """CRCs moved on by n bytes."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            crc = _apply(_power(k), crc)
    return crc


@cache
def _short_shifts() -> np.ndarray:
    """The matrices for 0 to SHORT bytes, one after the other."""
    return np.stack([_spread(_long_shift(_UNIT, n)) for n in range(SHORT + 1)]).reshape(-1)


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its own number of bytes."""
    short = np.minimum(n, SHORT).astype(np.int64) * 1024
    t = _short_shifts()
    out = t[short + (crc & U32(255))] ^ t[short + 256 + (crc >> U32(8) & U32(255))] ^ t[short + 512 + (crc >> U32(16) & U32(255))] ^ t[short + 768 + (crc >> U32(24))]
    far = np.flatnonzero(n > SHORT)
    for length in np.unique(n[far]):
        rows = far[n[far] == length]
        out[rows] = _long_shift(crc[rows], int(length))
    return out


def word_crcs(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes from each s to e - 1: all words go on by a byte at a time, the longest first in order,
    so that those still running are always the first ones."""
    n, steps = e - s, _byte_steps()
    short = np.minimum(n, SHORT + 1).astype(np.int16)
    order = np.argsort(-short, kind="stable")
    running = len(n) - np.cumsum(np.bincount(short, minlength=SHORT + 2))  # words of more than i bytes
    crc, at = np.full(len(n), U32(0xFFFFFFFF)), s[order]
    for i in range(SHORT):
        k = int(running[i])
        if not k:
            break
        crc[:k] = steps[(crc[:k] ^ data[at[:k] + i]) & U32(255)] ^ (crc[:k] >> U32(8))
    out = np.empty(len(n), U32)
    out[order] = ~crc
    for w in order[: int(running[SHORT])]:
        out[w] = zlib.crc32(data[s[w] : e[w]])
    return out


def gram_crcs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and for each length of n-gram the text and the CRC of all n-grams."""
    n_texts, data = len(offsets) - 1, _LOWER[data]
    if not len(data):
        return np.zeros(n_texts, np.int64), []
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _WORD[data]
    begin, end = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # words end where their text does
    begin[inner], end[inner - 1] = solid[1:-1][inner], solid[1:-1][inner - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    owner = np.searchsorted(offsets, s, side="right") - 1
    crc, length = word_crcs(data, s, e), e - s
    space = np.full(len(s), U32(zlib.crc32(b" ")))
    spaced = shift(space, length) ^ crc if len(s) else crc  # of a space and the word
    out, gram = [(owner, crc)], crc
    for k in range(1, LONGEST_GRAM):
        gram = shift(gram[:-1], length[k:] + 1) ^ spaced[k:]
        inside = owner[: len(gram)] == owner[k:]
        out.append((owner[: len(gram)][inside], gram[inside]))
        if not len(gram):
            break
    return np.bincount(owner, minlength=n_texts), out


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    column = textops.text_column(column)
    for a, b in textops.pieces(textops.raw(column)[1]):
        yield gram_crcs(*textops.raw(column.slice(a, b - a)))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends a row a bucket at most."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, grams in _blocks(batch.column(0)):
                for _, crc in grams:
                    total += np.bincount(crc % U32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    found = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of the target and the corpus, rounded down."""
    size = len(corpus)
    ratio = (target + 1.0) * (float(corpus.sum()) + size) / ((corpus + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def document_weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight) of each row: the gains of all its features, summed."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)  # sums stay below 2^53: exact
        for batch in batches:
            parts = [(np.empty(0, np.int64),) * 3]
            for n_words, grams in _blocks(batch.column(1)):
                n, n_features, weight = len(n_words), np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for owner, crc in grams:
                    n_features += np.bincount(owner, minlength=n)
                    weight += np.bincount(owner, gain[crc % U32(len(gain))], minlength=n).astype(np.int64)
                parts.append((n_words, n_features, weight))
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)]
            yield pa.record_batch([batch.column(0), *columns], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """Thousandths of standard Gumbel noise, rounded down, from a hash of the seed and the id; of a null id from that
    of the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, most: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``rows`` (id, score, ...) with ``rank``: 1, 2, ... to ``most`` by falling score, equal scores by rising id, null
    beyond. Rows are dealt by ranges of score and id; a range's ranks begin after the counts of those before it,
    which are a number a range."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rank_rows))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranges = materialize(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row a range
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.join(F.broadcast(before), "range").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long")).drop("range", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_words, n_features, weight, score, rank).

    Words are runs of ASCII letters (A-Z lower-cased), ASCII digits and all other characters beyond ASCII. ``rank``
    numbers the drawn rows: floor(percent * eligible / 100) of those with at least ``least`` words, the highest scores
    first, ties to the smaller id (null last; of rows that repeat an id with equal scores any order). Null and empty
    texts have no feature, weigh 0 and are never drawn. An empty target leaves the gains to the corpus alone. Empty
    documents give an empty result. Other columns of either table are not read."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = document_weights(docs, gain, id_col, text_col)
    rows = materialize(rows.withColumn("score", F.col("weight") + gumbel("id", seed)), "weights")
    eligible = F.col("n_words") >= least
    most = percent * rows.where(eligible).count() // 100
    rest = rows.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(eligible), most).unionByName(rest).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (
    SELECT doc_id AS id, false AS target, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
    UNION ALL
    SELECT item_id, true, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
grams AS (SELECT id, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM texts),
counted AS (SELECT id, target, g, count(*) AS n FROM grams GROUP BY ALL),
codes AS (SELECT g, list_transform(string_split(g, ''), lambda x: unicode(x)::BIGINT) AS u FROM (SELECT DISTINCT g FROM counted)),
bytes AS (SELECT g, flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + (c >> 6), 128 + (c & 63)]
    WHEN c < 65536 THEN [224 + (c >> 12), 128 + ((c >> 6) & 63), 128 + (c & 63)] ELSE [240 + (c >> 18), 128 + ((c >> 12) & 63), 128 + ((c >> 6) & 63), 128 + (c & 63)] END)) AS b FROM codes),
hashed AS (SELECT g, xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps),
sums AS (SELECT bucket, sum(n) FILTER (NOT target) AS s, sum(n) FILTER (target) AS t FROM counted JOIN hashed USING (g) GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(a.t, 0) + 1)::DOUBLE * (b.s + 10000)::DOUBLE / ((coalesce(a.s, 0) + 1)::DOUBLE * (b.t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums a, total b),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (g) JOIN gain USING (bucket) WHERE NOT target GROUP BY 1),
scored AS (SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM texts LEFT JOIN weights USING (id) WHERE NOT target),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_words, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM places) // 100 THEN rank END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
