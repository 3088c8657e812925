"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of numbers of the benchmark's words (0 for all others), which one pass writes down.
2. Passages of blocks of words are rows of a TF-IDF matrix, with document frequencies over all passages of the
   corpus. A randomised SVD finds its main directions: each task adds up A'(A X) of its passages for a random
   X, then for the orthonormal basis of the sum, and a small eigenproblem is left for the driver. Both sums
   have one row for each word of the benchmark, whatever the corpus.
3. Windows of two neighbouring passages are compared with those of the benchmark by cosine in the latent
   space, where a region that such a window points at has enough of some item's rarer words: an item that
   passes step 4 leaves at least so many there, however large the corpus is.
4. A candidate is checked at the place where it aligns: the longest common subsequence of words with the
   item, and, for paraphrases, whether the item's answer (its rarest words) is there too."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow, materialize, text_hash

#: Words of a passage; a window is two of them. Latent places, and extra ones of the random start.
PASSAGE, RANK, OVERSAMPLE = 8, 96, 16
#: Least cosine of a candidate, and cosines that are worked out at once.
COSINE, COSINES = 0.3, 1 << 21
#: Least share of an item's words in order: for a leak as it is; for one that has STRONG_ANSWER of its answer's words
#: too; for one that has ANSWER of them.
VERBATIM, STRONG, PARAPHRASE, STRONG_ANSWER, ANSWER = 0.7, 0.6, 0.5, 1 / 3, 0.5
#: Windows of the items that are looked for at once, about; more items are taken in blocks.
BLOCK_WINDOWS = 20_000
#: Rows of the tables of latent directions; a benchmark of more words shares them.
LATENT_ROWS = 1 << 16
#: Rows of a benchmark up to which a task adds up products of words in a square table (200 MB at most).
GRAM_WORDS = 5000
U64 = np.uint64


class Vocabulary:
    """The benchmark's words: word i + 1 has the i-th of the ascending hashes. Words beyond LATENT_ROWS share rows
    of the latent tables."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.rows = min(len(hashes), LATENT_ROWS)
        self.kind = np.uint16 if len(hashes) < 65535 else np.uint32
        size = 1 << max(10, int(len(hashes) * 16).bit_length())
        self.table = np.zeros(size, bool)
        self.table[(hashes & U64(size - 1)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 0 for unknown words. A table by the low bits finds most unknown words."""
        bits = U64(len(self.table) - 1)
        hit = np.flatnonzero(self.table[(h & bits).astype(np.int64)])
        out = np.zeros(len(h), self.kind)
        if len(hit):
            at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            same = self.hashes[at] == h[hit]
            out[hit[same]] = at[same] + 1
        return out

    def row(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of the latent tables, from 1 on, 0 for unknown words."""
        return np.where(numbers > 0, (numbers - 1) % self.rows + 1, 0) if self.rows < len(self.hashes) else numbers


def read_vocabulary(texts: DataFrame) -> Vocabulary:
    """Of the benchmark's texts; only the hashes of its distinct words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = textops.words(*textops.raw(textops.text_column(batch.column(0))), letters=True)[0]
            yield pa.record_batch([pa.array(np.unique(h).view(np.int64))], names=["h"])

    found = map_arrow(texts, run, "h long").distinct().toArrow()
    return Vocabulary(np.sort(found["h"].to_numpy().view(U64)) if found.num_rows else np.empty(0, U64))


def _number_texts(docs: DataFrame, vocabulary: Vocabulary, least: float) -> DataFrame:
    """(id, hash, words) of docs (id, hash, text), written: the word numbers of each text, as bytes; texts with
    fewer than ``least`` known words are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keep, out, base = textops.text_column(batch.column(2)), [], [], 0
            for a, b in textops.pieces(textops.raw(column)[1]):
                h, owner, _, _ = textops.words(*textops.raw(column.slice(a, b - a)), letters=True)
                numbers = shared.value.numbers(h)
                ends = np.searchsorted(owner, np.arange(b - a + 1))
                known = np.concatenate([[0], np.cumsum(numbers > 0)])[ends]
                for t in np.flatnonzero(np.diff(known) >= least):
                    keep.append(base + int(t))
                    out.append(numbers[ends[t] : ends[t + 1]].tobytes())
                base += b - a
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["id", "hash", "words"])

    found = materialize(map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, hash long, words binary"), "numbered")
    shared.destroy()
    return found


class Weights:
    """TF-IDF weights of words, and of latent rows. A word that the benchmark doesn't have, number 0, has none."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, passages: float):
        """``counts``: occurrences of each word in the corpus."""
        self.idf = np.log((passages + 2) / (counts + 1)).clip(0.1)
        by_row = np.bincount(vocabulary.row(np.arange(1, len(counts) + 1)) - 1, counts, vocabulary.rows)
        self.row_idf = np.log((passages + 2) / (by_row + 1)).clip(0.1)


class Runs:
    """Many texts end to end, cut at each text's start and every PASSAGE words."""

    def __init__(self, texts: list[np.ndarray], vocabulary: Vocabulary):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate(texts).astype(np.int64)
        self.rows = vocabulary.row(self.words)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        count = -(-sizes // PASSAGE)
        self.text = np.repeat(np.arange(len(texts)), count)
        first = np.cumsum(count) - count
        self.starts = self.begins[self.text] + PASSAGE * (np.arange(len(self.text)) - first[self.text])

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Passage and latent row less 1 of each word that the benchmark has."""
        at = np.flatnonzero(self.rows)
        return np.searchsorted(self.starts, at, side="right") - 1, self.rows[at] - 1

    def windows(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Passages that begin a window (of them and the next of their text) at a word from one of ``low`` to its
        ``high``."""
        inside = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(inside, np.searchsorted(self.starts, low), 1)
        np.add.at(inside, np.searchsorted(self.starts, high, side="right"), -1)
        last = np.r_[self.text[1:] != self.text[:-1], True]
        alone = np.r_[True, self.text[1:] != self.text[:-1]]
        return np.flatnonzero((np.cumsum(inside)[:-1] > 0) & (~last | alone))

    def _places(self, passages: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words from each passage's start, ``size`` of them or to the text's end."""
        start = self.starts[passages]
        length = np.minimum(size, self.ends[self.text[passages]] - start)
        ends = np.cumsum(length)
        row = np.repeat(np.arange(len(passages)), length)
        return np.arange(int(ends[-1]) if len(ends) else 0) + (start - (ends - length))[row], row

    def vectors(self, windows: np.ndarray, latent: np.ndarray) -> np.ndarray:
        """Unit vectors of windows. ``latent``: a row for each latent row, zero for 0."""
        if not len(windows):
            return np.empty((0, latent.shape[1]), np.float32)
        at, row = self._places(windows, 2 * PASSAGE)
        sums = np.add.reduceat(latent[self.rows[at]], np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), axis=0)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return sums / np.where(norm > 0, norm, 1)


def _text_groups(batches: Iterator[pa.RecordBatch], column: int, kind: type, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Batch, first row, and the numbered texts of some rows."""
    for batch in batches:
        texts, size, first = [], 0, 0
        for i, x in enumerate(batch.column(column)):
            texts.append(np.frombuffer(x.as_buffer(), kind))
            size += len(texts[-1])
            if size >= most or i + 1 == len(batch):
                yield batch, first, texts
                texts, size, first = [], 0, i + 1


def _summed(df: DataFrame, run, width: int, n_words: int) -> np.ndarray:
    """The sum over tasks of their (n_words x width) tables, added up by rows of the table."""
    sums = map_arrow(df, run, "row long, v array<double>").groupBy("row").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)))
    found, out = sums.toArrow(), np.zeros((n_words, width))
    if found.num_rows:
        rows = found["row"].to_numpy()
        for i in range(width):
            out[rows, i] = found[f"v{i}"].to_numpy()
    return out


def _table_batches(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(table.any(axis=1))
    for i in range(0, len(used), 2048):
        some = used[i : i + 2048]
        flat, offsets = table[some].reshape(-1), np.arange(len(some) + 1, dtype=np.int32) * table.shape[1]
        yield pa.record_batch([pa.array(some, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["row", "v"])


def _counts(numbered: DataFrame, vocabulary: Vocabulary) -> Weights:
    """Occurrences of each word in all texts, and the number of passages."""
    n_words, kind = len(vocabulary.hashes), vocabulary.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(n_words + 1)
        for _, _, texts in _text_groups(batches, 0, kind):
            table += np.bincount(np.concatenate(texts), minlength=n_words + 1)
        yield from _table_batches(table[:, None])

    table = _summed(numbered.select("words"), run, 1, n_words + 1)[:, 0]
    return Weights(vocabulary, table[1:], table.sum() / PASSAGE)


def _projected(numbered: DataFrame, vocabulary: Vocabulary, weights: Weights, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over the normalised TF-IDF passages A of all numbered texts."""
    (n_words, width), kind = basis.shape, vocabulary.kind
    basis32 = basis.astype(np.float32)

    def add(runs: Runs, table: np.ndarray) -> None:
        p, w = runs.passages()
        if not len(p):
            return
        key, count = np.unique(p * n_words + w, return_counts=True)
        p, w = key // n_words, key % n_words
        weight = (count * weights.row_idf[w]).astype(np.float32)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        sizes = np.diff(np.r_[first, len(p)])
        weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, first)), sizes)
        y = np.add.reduceat(weight[:, None] * basis32[w], first, axis=0)
        order = np.argsort(w, kind="stable")
        row = np.repeat(np.arange(len(first)), sizes)[order]
        words, at = np.unique(w[order], return_index=True)
        table[words] += np.add.reduceat(weight[order][:, None] * y[row], at, axis=0)

    def add_products(runs: Runs, gram: np.ndarray) -> None:
        """The same as a sum of A'A, half of it: each pair of words in a passage once, a word with itself by half."""
        p, w = runs.passages()
        idf, square, pairs = weights.row_idf[w], np.zeros(len(runs.starts)), []
        for d in range(min(PASSAGE, len(p))):
            at = np.flatnonzero(p[d:] == p[: len(p) - d])
            x = idf[at] * idf[at + d] * (1 if d else 0.5)
            same = w[at] == w[at + d]
            square += np.bincount(p[at[same]], 2 * x[same], len(square))
            pairs.append((at, d, x))
        for at, d, x in pairs:
            np.add.at(gram, w[at] * n_words + w[at + d], x / square[p[at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if n_words <= GRAM_WORDS:
            gram = np.zeros(n_words * n_words)
            for _, _, texts in _text_groups(batches, 0, kind):
                add_products(Runs(texts, vocabulary), gram)
            gram = gram.reshape(n_words, n_words)
            table = gram @ basis + gram.T @ basis
        else:
            table = np.zeros((n_words, width))
            for _, _, texts in _text_groups(batches, 0, kind, 1 << 17):
                add(Runs(texts, vocabulary), table)
        yield from _table_batches(table)

    return _summed(numbered.select("words"), run, width, n_words)


def _fix_signs(basis: np.ndarray) -> np.ndarray:
    return basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1, 1)


def latent_directions(numbered: DataFrame, items: DataFrame, vocabulary: Vocabulary, rank: int = RANK, seed: int = 7) -> tuple[Weights, np.ndarray]:
    """Weights of the words, and the latent rows' places in the right singular vectors of the TF-IDF matrix of all
    passages, each divided by its singular value, so that common directions don't make all passages alike."""
    weights = _counts(numbered, vocabulary)
    passages = numbered.select("words").union(items.select("words"))
    start = np.random.default_rng(seed).normal(size=(vocabulary.rows, min(rank + OVERSAMPLE, vocabulary.rows)))
    basis = np.linalg.qr(_projected(passages, vocabulary, weights, start))[0]
    small = basis.T @ _projected(passages, vocabulary, weights, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    values = np.sqrt(np.maximum(values[order], 1e-9 * max(values.max(), 1e-9)))
    return weights, _fix_signs(basis @ vectors[:, order]) / values


def lcs_mask(text: list[int], item: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence by bit-parallel rows over the item, and the final row."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count(), row


@dataclass
class Rule:
    """What an item asks of a region to count as held there."""

    goal: list[int]
    answer: frozenset[int]

    def kind(self, common: int, region: list[int]) -> str | None:
        share, there = common / len(self.goal), len(self.answer.intersection(region)) / len(self.answer)
        if share >= VERBATIM:
            return "verbatim"
        return "paraphrase" if share >= STRONG and there >= STRONG_ANSWER or share >= PARAPHRASE and there >= ANSWER else None

    @property
    def slack(self) -> int:
        """Words on either side of the item's length that belong to a region."""
        return max(PASSAGE, len(self.goal) // 4)


class Matcher:
    """Finds a block's items, given as word numbers, in numbered texts."""

    def __init__(self, items: list[np.ndarray], vocabulary: Vocabulary, weights: Weights, directions: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights
        self.latent = np.zeros((vocabulary.rows + 1, directions.shape[1]), np.float32)
        self.latent[1:] = directions * weights.row_idf[:, None]
        vectors, self.owner, self.offset, self.rules = [], [], [], []
        for i, words in enumerate(items):
            # windows at every other word, so that one of a text is at most a word off
            for at in range(0, max(1, len(words) - 2 * PASSAGE + 1), 2):
                vectors.append(Runs([words[at : at + 2 * PASSAGE]], vocabulary).vectors(np.zeros(1, int), self.latent)[0])
                self.owner.append(i), self.offset.append(at)
            self.rules.append(Rule(words.tolist(), frozenset(self._rarest_first(words)[: max(3, len(words) // 4)])))
        self.vectors = np.array(vectors, np.float32).T
        self.owner, self.offset = np.array(self.owner), np.array(self.offset)
        self.counts = [{w: r.goal.count(w) for w in set(r.goal)} for r in self.rules]
        self.sets = [frozenset(r.goal) for r in self.rules]
        self._rarer_words()

    def _rarest_first(self, words: np.ndarray) -> list[int]:
        return sorted(set(words.tolist()), key=lambda w: (-self.weights.idf[w - 1], w))

    def _rarer_words(self) -> None:
        """What an accepted region has at least: a paraphrase a third of the answer's words, a verbatim leak all but
        3 in 10 of the item's places. So of an item's rarest words that fill these places and a third of an answer
        more, either leaves ``need`` in its region. ``of`` lists the items that have word w so at first[w] to
        first[w + 1]."""
        self.goals = np.array([len(r.goal) for r in self.rules])
        self.slack = np.array([r.slack for r in self.rules])
        self.need, words, owners = np.zeros(len(self.goals), np.int64), [], []
        for i, rule in enumerate(self.rules):
            self.need[i] = math.ceil(min(STRONG_ANSWER, ANSWER) * len(rule.answer) - 1e-9)
            places, left = 0, len(rule.goal) - math.ceil(VERBATIM * len(rule.goal)) + self.need[i]
            for k, w in enumerate(self._rarest_first(np.array(rule.goal))):
                if places >= left and k >= len(rule.answer):
                    break
                places += self.counts[i][w]
                words.append(w), owners.append(i)
        order = np.argsort(words, kind="stable")
        self.of = np.array(owners, np.int64)[order]
        self.first = np.searchsorted(np.array(words)[order], np.arange(len(self.vocabulary.hashes) + 2))

    def regions(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """First and last word at which a window may begin that points at a region with enough of an item's rarer
        words."""
        first, many = self.first[runs.words], self.first[runs.words + 1] - self.first[runs.words]
        at = np.repeat(np.arange(len(runs.words)), many)
        item = self.of[np.arange(len(at)) + np.repeat(first - (np.cumsum(many) - many), many)]
        order = np.argsort(item.astype(np.uint16) if len(self.rules) < 65535 else item, kind="stable")
        at, item = at[order], item[order]
        end = np.minimum(np.arange(len(at)) + self.need[item] - 1, len(at) - 1)
        enough = (np.arange(len(at)) + self.need[item] <= len(at)) & (item[end] == item)
        here = np.flatnonzero(enough & (at[end] - at < (self.goals + 2 * self.slack)[item]))
        begin, end, goal, slack = at[here], at[end[here]], self.goals[item[here]], self.slack[item[here]]
        return end - goal - slack + 1, begin + slack + np.maximum(goal - 2 * PASSAGE, 0)

    def candidates(self, runs: Runs) -> dict[int, dict[int, list[tuple[float, int]]]]:
        """For each text and item, (cosine, place in the text where the item would begin)."""
        out: dict[int, dict[int, list[tuple[float, int]]]] = {}
        near = runs.windows(*self.regions(runs))
        step = max(1, COSINES // len(self.owner))
        for a in range(0, len(near), step):
            at = near[a : a + step]
            cosine = runs.vectors(at, self.latent) @ self.vectors
            rows, columns = np.nonzero(cosine >= COSINE)
            if not len(rows):
                continue
            text = runs.text[at[rows]]
            begin = runs.starts[at[rows]] - runs.begins[text] - self.offset[columns]
            for t, item, x, b in zip(text.tolist(), self.owner[columns].tolist(), cosine[rows, columns].tolist(), begin.tolist(), strict=True):
                out.setdefault(t, {}).setdefault(item, []).append((x, b))
        return out

    def find(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, float, str]]:
        """(text, item, common words in order, cosine, kind) of the items that texts hold."""
        out = []
        for t, by_item in sorted(self.candidates(Runs(texts, self.vocabulary)).items()):
            for item, places in sorted(by_item.items()):
                best = self._check(texts[t], item, places)
                if best:
                    out.append((t, item, *best))
        return out

    def _check(self, words: np.ndarray, item: int, places: list[tuple[float, int]]) -> tuple[int, float, str] | None:
        rule, best, seen = self.rules[item], None, []
        goal, slack, count, floor = rule.goal, rule.slack, self.counts[item].__getitem__, PARAPHRASE * len(rule.goal)
        for x, begin in sorted(places, key=lambda p: (-p[0], p[1])):
            if any(abs(begin - s) <= slack // 2 for s in seen):
                continue  # the region of a better one holds it
            seen.append(begin)
            region = words[max(0, begin - slack) : max(0, begin + len(goal) + slack)].tolist()
            # at most the item's places whose words the region has
            if sum(map(count, self.sets[item].intersection(region))) < floor:
                continue
            common, _ = lcs_mask(region, goal)
            kind = rule.kind(common, region)
            if kind and (best is None or common > best[0]):
                best = (common, x, kind)
                if common == len(goal):
                    break
        return best


def _matches(numbered: DataFrame, ids: list, matcher: Matcher, item_type: DataType) -> DataFrame:
    """(id, hash, item, common_words, item_words, cosine, kind), written."""
    shared = numbered.sparkSession.sparkContext.broadcast((pa.array(ids, to_arrow_type(item_type)), matcher))
    kind_of = matcher.vocabulary.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matcher = shared.value
        for batch, first, texts in _text_groups(batches, 2, kind_of):
            hits = matcher.find(texts)
            rows, found = pa.array([first + h[0] for h in hits], pa.int64()), [h[1:] for h in hits]
            yield pa.record_batch(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    ids.take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([len(matcher.rules[f[0]].goal) for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.string()),
                ],
                names=["id", "hash", "item", "common_words", "item_words", "cosine", "kind"],
            )

    found = materialize(map_arrow(numbered, run, _schema(numbered.schema["id"].dataType, item_type)), "leaks")
    shared.destroy()
    return found


def _schema(id_type: DataType, item_type: DataType) -> str:
    return f"id {id_type.simpleString()}, hash long, item {item_type.simpleString()}, common_words long, item_words long, cosine double, kind string"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each pair of a row of ``docs`` and an item that its text holds: (id_col, item_col,
    common_words, item_words, cosine, kind, text_hash).

    ``kind`` is verbatim if at least 0.7 of the item's words are there in order, paraphrase if at least 0.6 are and
    a third of its answer, or half of its words and half of its answer. Words are runs of letters and digits; case
    (of characters up to U+07FF) and signs don't count. Null and empty texts hold nothing; an item without words
    is in no text; items with equal texts are all found. A repeated row gives its pairs again; a null id stays
    null; ids and item ids of any atomic type keep it. Texts are read whole. Without any item or text the result
    is empty. Other columns of either table, whatever their names, are not read.

    The benchmark is the stated query set: the hashes of its distinct words come to the driver, and its items in
    blocks of about BLOCK_WINDOWS windows (more if one item has more)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    own = benchmark.select(F.col(item_col).alias("id"), text_hash(item_text_col).alias("hash"), F.col(item_text_col).alias("text"))
    id_type, item_type = docs.schema["id"].dataType, own.schema["id"].dataType
    names = {"id": id_col, "item": item_col, "hash": "text_hash"}
    vocabulary = read_vocabulary(own.select("text"))
    if not len(vocabulary.hashes):
        return spark.createDataFrame([], _schema(id_type, item_type)).withColumnsRenamed(names)
    items = _number_texts(own, vocabulary, 1)
    size = F.length("words") / np.dtype(vocabulary.kind).itemsize
    shortest, windows = items.agg(F.min(size), F.sum(F.greatest(F.lit(1), size / 2 - PASSAGE + 1))).first()
    numbered = _number_texts(docs, vocabulary, PARAPHRASE * shortest)
    weights, directions = latent_directions(numbered, items, vocabulary)
    blocks = -(-int(2 * windows) // BLOCK_WINDOWS) if windows > BLOCK_WINDOWS else 1
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "hash"), F.lit(blocks)) == block).orderBy("id", "words").collect()
        if rows:
            words = [np.frombuffer(r["words"], vocabulary.kind).astype(np.int64) for r in rows]
            found = _matches(numbered, [r["id"] for r in rows], Matcher(words, vocabulary, weights, directions), item_type)
            out = found if out is None else out.union(found)
    return out.withColumnsRenamed(names)
