"""Token counts by heap-and-linked-list byte-pair merging, without making the tokens.

A pretoken starts as one symbol a byte, in a doubly linked list. A heap holds the adjacent pairs that have
a merge, by rank and then place; the lowest is popped, merged if both ends are still what they were, and the
two new neighbour pairs are pushed. The count is the initial symbols minus the merges. Words repeat, so a
worker keeps the counts of words it has met (a bounded number; the rest is counted again)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow

#: Words and pretokens whose counts a worker keeps.
KEPT = 400_000
#: Fixed value: the published pattern of byte-level pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE_WORD = re.compile(r" (?=\S)")
_ODD_SPACE = tuple(" " + c for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others
    for the letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """Counts of texts, by ``count`` when missing; keeps a bounded number."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(self) < KEPT and len(key) < 64:
            self[key] = n
        return n


class Counter:
    """Counts tokens as the library does with a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab = model["vocab"]
        self.base = [vocab[c] for c in _byte_letters()]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_texts = special
        self.pattern = regex.compile(PRETOKEN, regex.V0)
        self.pretokens = _Kept(self.merged)
        self.inner = _Kept(lambda word: sum(map(self.pretokens.__getitem__, self.pattern.findall(" " + word))))

    def merged(self, pretoken: str) -> int:
        """Symbols of a pretoken minus its merges."""
        symbol = [self.base[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        n = left = len(symbol)
        merge = self.merge
        heap = []
        for i in range(n - 1):
            m = merge.get(symbol[i] << 32 | symbol[i + 1])
            if m is not None:
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, new = heapq.heappop(heap)
            a = symbol[i]
            if a < 0 or (j := after[i]) >= n:
                continue
            m = merge.get(a << 32 | symbol[j])
            if m is None or m[0] != rank:
                continue
            symbol[i], symbol[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merge.get(new << 32 | symbol[k])
                if m is not None:
                    heapq.heappush(heap, (m[0], i, m[1]))
            p = before[i]
            if p >= 0:
                m = merge.get(symbol[p] << 32 | new)
                if m is not None:
                    heapq.heappush(heap, (m[0], p, m[1]))
        return left

    def _plain(self, text: str) -> int:
        """A text without special tokens. A space before a character that isn't white space always begins
        a pretoken, so the text falls apart there."""
        if text.isascii() and text[-1] != " " and not any(x in text for x in _ODD_SPACE):
            parts = text.split(" ")
        else:
            parts = _BEFORE_WORD.split(text)
        return sum(map(self.pretokens.__getitem__, self.pattern.findall(parts[0]))) + sum(map(self.inner.__getitem__, parts[1:]))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not any(s in text for s in self.special_texts):
            return self._plain(text)
        found = len(self.special.findall(text))
        return found + sum(self._plain(part) for part in self.special.split(text) if part)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_bytes, n_tokens, over_limit).

    ``tokenizer``: path of a byte-level BPE file that every worker can open. Null and empty texts have 0
    bytes and tokens. Strings of special tokens inside a text count as one token each. Repeated rows, null
    ids and texts of any length are counted like others; other columns of ``docs`` are not read."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            texts = textops.text_column(batch.column(1))
            sizes = pa.array(textops.raw(texts)[1][1:] - textops.raw(texts)[1][:-1], pa.int64())
            n = [count(t.as_py()) for t in texts]
            yield pa.record_batch([batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
