"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy and a
temperature for its probabilities.

Random indexing: each word has a fixed sparse index vector of two signed places, one picked by the word and
one by its form (its last two bytes and whether it has small letters). A word's vector is the sum of the
index vectors of its neighbours over the whole corpus. Words and forms are hashed to a fixed number of rows,
so the table of vectors has one size for any corpus; it is summed exactly, in integers, by a group-by over
rows. A document's features are pooled from the vectors of its words and of its forms alone: their mean, their root
mean square, and the mean product of each with the one before it and the one before that, place by place, which is
large where words come again. Labels come in only after that, from a bounded number of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow, materialize, text_hash

#: Rows of the table of vectors: words first, then forms. Places of a vector. Neighbours on either side.
WORD_ROWS, FORM_ROWS, PLACES, WINDOW = 1 << 15, 1 << 12, 32, 2
#: The classifier learns from at most about so many labelled rows, picked by a hash of the id.
MOST_LABELLED = 30_000
#: A score from here on counts as label 1.
THRESHOLD = 0.3
U64 = np.uint64


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: text, hash, rows in the table (word, form), and length in bytes."""
    h, owner, s, e = textops.words(data, offsets, lower=False)
    small = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 97) & (data <= 122), out=small[1:])
    before = np.where(e - s > 1, data[np.maximum(e - 2, 0)], 0) if len(e) else np.empty(0, np.uint8)
    last = data[e - 1] if len(e) else np.empty(0, np.uint8)
    form = textops.mix((last.astype(U64) << U64(16)) | (before.astype(U64) << U64(8)) | (small[e] > small[s]).astype(U64))
    word_row = (h % U64(WORD_ROWS)).astype(np.int64)
    form_row = WORD_ROWS + (form % U64(FORM_ROWS)).astype(np.int64)
    return owner, h, word_row, form_row, e - s


def _index_vectors(h: np.ndarray, form_row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two signed places of each word."""
    out = []
    for x in (textops.mix(h), textops.mix(form_row.astype(U64))):
        out.append(((x % U64(PLACES)).astype(np.int64), np.where((x >> U64(32)) & U64(1), 1, -1).astype(np.int32)))
    return out


def _context_sums(texts: DataFrame) -> DataFrame:
    """(row, v0, v1, ...): the summed index vectors of all neighbours in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((WORD_ROWS + FORM_ROWS) * PLACES, np.int64)
        for batch in batches:
            column = textops.text_column(batch.column(0))
            for a, b in textops.pieces(textops.raw(column)[1], 1 << 21):
                owner, h, word_row, form_row, _ = _terms(*textops.raw(column.slice(a, b - a)))
                vectors = _index_vectors(h, form_row)
                for lag in range(1, WINDOW + 1):
                    near = np.flatnonzero(owner[lag:] == owner[:-lag])
                    for me, other in ((near, near + lag), (near + lag, near)):
                        for place, sign in vectors:
                            at, value = place[other], sign[other].astype(float)
                            for rows in (word_row, form_row):
                                table += np.bincount(rows[me] * PLACES + at, value, minlength=len(table)).astype(np.int64)
        table = table.reshape(-1, PLACES)
        used = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(used), 4096):
            some = used[i : i + 4096]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(table[some].reshape(-1)), PLACES).cast(pa.list_(pa.int64()))], names=["row", "v"])

    sums = map_arrow(texts, run, "row long, v array<long>")
    return sums.groupBy("row").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(PLACES)))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word and form vectors, each of length 1 or 0; one size for any corpus."""
    arrow_batches(docs.sparkSession)
    found = _context_sums(docs.select(F.col(text_col).alias("text"))).toArrow()
    table = np.zeros((WORD_ROWS + FORM_ROWS, PLACES))
    if found.num_rows:
        rows = found["row"].to_numpy()
        for i in range(PLACES):
            table[rows, i] = found[f"v{i}"].to_numpy()
    table = np.sign(table) * np.sqrt(np.abs(table))
    norm = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


#: Pools of a document's vectors: mean, root mean square, products with the vectors one and two words before.
LAGS = (1, 2)
N_FEATURES = 2 * PLACES * (2 + len(LAGS))


def _pooled(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    owner, _, word_row, form_row, _ = _terms(data, offsets)
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who, share = owner[first], 1.0 / np.diff(np.r_[first, len(owner)])[:, None]
        pools = []
        for rows in (word_row, form_row):
            v = table[rows]
            pools.append(np.add.reduceat(v, first, axis=0) * share)
            pools.append(np.sqrt(np.add.reduceat(v * v, first, axis=0) * share))
            for lag in LAGS:
                product = np.zeros_like(v)
                product[lag:] = v[lag:] * v[:-lag] * (owner[lag:] == owner[:-lag])[:, None]
                pools.append(np.add.reduceat(product, first, axis=0) * share)
        out[who] = np.concatenate(pools, axis=1)
    return out


def document_features(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, features) of each row of ``docs``; a text without words has zeros."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, parts = textops.text_column(batch.column(2)), []
            for a, b in textops.pieces(textops.raw(column)[1], 1 << 19):
                parts.append(_pooled(*textops.raw(column.slice(a, b - a)), shared.value))
            flat = np.concatenate(parts).reshape(-1) if parts else np.empty(0, np.float32)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * N_FEATURES
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "hash", "features"])

    docs = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    return map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, hash long, features array<float>")


@dataclass
class Network:
    """features -> hidden (tanh) -> one logit, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    empty: float = 0.5  # the score of a text without words, which has nothing to pool

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))
        return np.where(x.any(axis=1), p, self.empty)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Network:
    """Adam on the log loss of rows that aren't ``held``; the temperature is the one with the least log loss
    on those that are. Without both labels the score is the share of label 1 (a half without any label)."""
    rng = np.random.default_rng(seed)
    n_in = x.shape[1] if x.ndim == 2 else N_FEATURES
    use = ~held if (~held).any() else np.ones(len(y), bool)
    if len(np.unique(y[use])) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Network(np.zeros(n_in), np.ones(n_in), np.zeros((n_in, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    xs, ys = x[use], y[use]
    mean, scale = xs.mean(axis=0), xs.std(axis=0) + 1e-6
    p = [rng.normal(0, n_in**-0.5, (n_in, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (xs - mean) / scale
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), batch):
            rows = order[i : i + batch]
            a, b = z[rows], ys[rows]
            hid = np.tanh(a @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -500, 500))) - b) / len(rows)
            back = np.outer(err, p[2]) * (1 - hid**2)
            grads = [a.T @ back + decay * p[0], back.sum(axis=0), hid.T @ err + decay * p[2], np.array([err.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logits, truth = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.mean(np.logaddexp(0, -np.where(truth > 0.5, 1, -1) * logits / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = MOST_LABELLED) -> Network:
    """Fit on labelled rows outside fold 0; fold 1 sets the temperature. Of more than ``most`` labelled rows
    a hash of the id picks about as many. Null labels are left out; repeated labels of an id are averaged and
    rounded."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    own = own.where(fold("id") != 0).groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(n)) < most)
    rows = features.join(own, "id").select("id", "y", fold("id").alias("fold"), "features").orderBy("id", "y").toArrow()
    y = rows["y"].to_numpy().astype(float) if rows.num_rows else np.empty(0)
    x = rows["features"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, N_FEATURES) if rows.num_rows else np.empty((0, N_FEATURES))
    held, full = rows["fold"].to_numpy() == 1 if rows.num_rows else np.empty(0, bool), x.any(axis=1)
    net = fit(x[full], y[full], held[full])
    # texts without words: their own labels, and one more that is as likely 1 as any label
    net.empty = float((y[~full].sum() + (y.mean() if len(y) else 0.5)) / ((~full).sum() + 1))
    return net


def score(features: DataFrame, net: Network) -> DataFrame:
    """(id, hash, score) of (id, hash, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(float).reshape(-1, N_FEATURES)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(net.score(x), pa.float64())], names=["id", "hash", "score"])

    return map_arrow(features, run, f"id {features.schema['id'].dataType.simpleString()}, hash long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: (id_col, held_out, score, predicted, text_hash).

    ``held_out``: the crc32 of the id as text is divisible by 5; such rows' labels are never learned from.
    The score depends on the text alone. Null and empty texts get the score of a text without words, the share of label 1
    among labelled ones and one more of the share among all. Null
    ids and repeated rows stay. Empty tables of documents give an empty result, of labels a score of a
    half. Other columns of either table are not read."""
    features = materialize(document_features(docs, word_vectors(docs, text_col), id_col, text_col), "features")
    net = train(features, labels, id_col, label_col)
    scored = score(features, net)
    return scored.select(F.col("id").alias(id_col), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("hash").alias("text_hash"))
