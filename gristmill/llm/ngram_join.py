"""N-gram Jaccard join by prefix trees.

The sets of word shingles of all texts are linked where ``100 * |A and B| >= percent * |A or B|``. The
join is exact up to the 64-bit hashes that stand for shingles:

1. One pass hashes each text's set. Equal sets are one class from here on, so copies cost nothing more.
2. Two sets that link share at least l shingles among the first n - ceil(percent * n) + l of either, in
   any global order. In hash order, shingles in two classes' prefixes are found by a combined count, and
   classes with fewer than l of them drop out. l is a sixteenth of the set, so that a shared licence line
   or passage is not enough to stay.
3. The sets of the classes that stay are ordered globally by frequency. A set whose shingles in common with sets
   of some band of sizes are too few for a link with the least of them, in every band, drops out: pages of one
   template whose common part doesn't suffice never meet. Classes that share one of their
   rarest n - ceil(percent * n) + 1 shingles with others form a block with the least of those classes,
   so that every pair that can link meets in a block, and a class is in as many blocks as it has such
   least classes, not in as many as it has shingles.
4. Within a block the sets lie in a trie, frequent shingles first, so that near copies share its upper
   part. Each set walks the trie: overlap adds up along a path, and a subtree is left as soon as the
   overlap plus the shorter of the two remainders can't reach the least overlap its sets ask for, or
   when all its sets are already joined with the walker.
5. A block that is too large for one task is dealt over chunks by hash, with a few landmark sets that
   every chunk sees. Sets outside the block's main component after that meet all of its chunks, so no
   link between components is missed, while sets that are already together are not compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.components import connected_components
from gristmill.llm.storage import arrow_batches, broadcast_if_small, discard, map_arrow, materialize, text_hash

#: Sets of one trie.
BLOCK = 512
#: Sets of a large block that each of its chunks sees, on average.
LANDMARKS = 16
#: A partner's size lies within so many bands of sizes on either side: STEPS, and one for the place within a band.
STEPS, REACH = 7, 8


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def slack(n: np.ndarray) -> np.ndarray:
    """l of the module's text for a set of n."""
    return n // 16 + 1


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - needed(n, percent) + slack(n))


def _set_ids(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = textops.mix(tokens ^ textops.U64(0x243F6A8885A308D3))
    b = textops.mix(tokens + textops.U64(0x13198A2E03707344))
    n = textops.U64(len(tokens))
    return int(textops.mix(np.array([a.sum() + n]))[0].astype(np.int64)), int(textops.mix(np.array([b.sum() ^ n]))[0].astype(np.int64))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    texts = textops.text_column(column)
    offsets = textops.raw(texts)[1]
    for a, b in textops.pieces(offsets):
        data, off = textops.raw(texts.slice(a, b - a))
        h, owner, _, _ = textops.words(data, off)
        yield from textops.shingle_sets(h, owner, b - a, k)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """A list<int64> column."""
    sizes = np.array([0 if x is None else len(x) for x in arrays], np.int64)
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    full = [x for x in arrays if x is not None and len(x)]
    values = np.concatenate(full).view(np.int64) if full else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, hash, n, sid, sid2, prefix) of docs (id, hash, text): a class's prefix comes with its first text in
    each task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, sid, sid2, prefix = [], [], [], []
            for tokens in _sets(batch.column(2), k):
                n.append(len(tokens))
                if not len(tokens):
                    sid.append(None), sid2.append(None), prefix.append(None)
                    continue
                a, b = _set_ids(tokens)
                sid.append(a), sid2.append(b)
                prefix.append(None if a in seen else tokens[: int(prefix_length(np.int64(len(tokens)), percent))])
                if len(seen) < 1 << 20:
                    seen.add(a)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sid2, pa.int64()), _lists(prefix)], names=["id", "hash", "n", "sid", "sid2", "prefix"])

    id_type = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, run, f"id {id_type}, hash long, n long, sid long, sid2 long, prefix array<long>")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(sid, n, tokens, task) of docs (text, want), once in each task for a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = set(), TaskContext.get().partitionId()
        for batch in batches:
            want, sid, tokens = batch.column(1).to_pylist(), [], []
            for x, w in zip(_sets(batch.column(0), k), want, strict=True):
                if w not in seen and len(x) and _set_ids(x)[0] == w:
                    seen.add(w)
                    sid.append(w), tokens.append(x)
            yield pa.record_batch([pa.array(sid, pa.int64()), pa.array([len(x) for x in tokens], pa.int64()), _lists(tokens), pa.array([task] * len(sid), pa.int32())], names=["sid", "n", "tokens", "task"])

    return map_arrow(docs, run, "sid long, n long, tokens array<long>, task int")


class Trie:
    """A radix tree of ascending code lists. A node has the places low to high - 1 of ``order``; its kids
    are kept last place first."""

    __slots__ = ("codes", "high", "kids", "last", "long", "low", "most", "order", "sizes", "small")

    def __init__(self, lists: list[list[int]], sizes: list[int]):
        """``sizes``: of the whole sets, of which ``lists`` have what more than one set has."""
        self.order = sorted(range(len(lists)), key=lists.__getitem__)
        self.sizes = sizes
        self.codes, self.last, self.low, self.high, self.kids = [], [], [], [], []
        self.long, self.small, self.most = [], [], []  # of a subtree: codes below, least and most whole size
        self._build([lists[i] for i in self.order], [sizes[i] for i in self.order])

    def _build(self, rows: list[list[int]], sizes: list[int]) -> None:
        stack = [(0, len(rows), 0, -1)]
        while stack:
            lo, hi, depth, parent = stack.pop()
            first, last = rows[lo], rows[hi - 1]
            end, most = depth, min(len(first), len(last))
            while end < most and first[end] == last[end]:
                end += 1
            node = len(self.codes)
            self.codes.append(first[depth:end])
            self.last.append(first[end - 1] if end else -1)
            self.low.append(lo), self.high.append(hi), self.kids.append([])
            self.long.append(max(len(rows[i]) for i in range(lo, hi)) - end)
            self.small.append(min(sizes[lo:hi])), self.most.append(max(sizes[lo:hi]))
            if parent >= 0:
                self.kids[parent].append(node)
            at = lo
            while at < hi and len(rows[at]) == end:
                at += 1
            while at < hi:
                nxt = at + 1
                while nxt < hi and rows[nxt][end] == rows[at][end]:
                    nxt += 1
                stack.append((at, nxt, end, node))
                at = nxt

    def walk(self, probe: list[int], size: int, percent: int, done) -> Iterator[tuple[int, int]]:
        """Places in ``order`` of the sets that link with a probe, and the overlaps. ``done(low, high)``
        tells that no place from low to high - 1 needs a look."""
        have, total, floor = set(probe), 100 + percent, size * percent
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            low, high = self.low[node], self.high[node]
            if self.most[node] * 100 < floor or self.small[node] * percent > size * 100 or done(low, high):
                continue
            codes = self.codes[node]
            if codes:
                overlap += len(have.intersection(codes))
            kids = self.kids[node]
            least = -(-percent * (size + self.small[node]) // total)
            passed = self._passed(probe, self.last[node])
            if overlap + min(len(probe) - passed, self.long[node]) < least:
                continue
            for place in range(low, self.low[kids[-1]] if kids else high):  # sets that end at this node
                n = self.sizes[self.order[place]]
                if overlap * total >= percent * (size + n) and not done(place, place + 1):
                    yield place, overlap
            stack.extend((kid, overlap) for kid in kids)

    @staticmethod
    def _passed(probe: list[int], code: int) -> int:
        lo, hi = 0, len(probe)
        while lo < hi:
            mid = (lo + hi) // 2
            if probe[mid] <= code:
                lo = mid + 1
            else:
                hi = mid
        return lo


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _join_block(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) that join the components of one block; rows with probe are compared with all."""
    tokens, dfs = table["tokens"].combine_chunks(), table["dfs"].combine_chunks()
    sid, sizes, probe, comp = (table[c].to_pylist() for c in ("sid", "n", "probe", "comp"))
    flat, df = tokens.flatten().to_numpy(zero_copy_only=False), dfs.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *np.diff(tokens.offsets.to_numpy())])
    _, first, code = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((flat[first], -df[first]))] = np.arange(len(first))
    code = rank[code]
    lists = [sorted(code[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    trie = Trie(lists, sizes)
    seat = {c: i for i, c in reversed(list(enumerate(comp)))}
    parent = [seat[c] for c in comp]
    joined = np.array([_root(parent, i) for i in trie.order])
    out = []
    everyone = all(probe)
    for place, i in enumerate(trie.order):
        if not probe[i]:
            continue

        def done(low: int, high: int, place=place) -> bool:
            if everyone and high <= place + 1:
                return True
            own = joined[place]
            return joined[low] == own and (high - low == 1 or bool((joined[low:high] == own).all()))

        for other, _ in trie.walk(lists[i], sizes[i], percent, done):
            if other == place:
                continue
            a, b = joined[place], joined[other]
            if a != b:
                out.append((sid[i], sid[trie.order[other]]))
                joined[joined == b] = a
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """blocks: (pivot, i, j, sid, n, tokens, dfs, probe, comp), one trie for each (pivot, i, j)."""
    return blocks.groupBy("pivot", "i", "j").applyInArrow(lambda t: _join_block(t, percent), "a long, b long")


def _ratio(percent: int) -> float:
    """Ratio of sizes from one band to the next: a partner's size differs by a factor of 100 / percent at most."""
    return max(1.001, (100 / percent) ** (1 / STEPS))


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(_ratio(percent))).cast("int")


def _may_link(n: Column, shared: Column, percent: int) -> Column:
    """Whether a set of n has, for some band of partners, as many shingles that sets of that band have as a link
    with the least of them asks for: 100 i >= percent (n + m - i). ``shared``: array of structs with ``mask``, whose
    bit i stands for partners i - REACH bands up."""

    def enough(i: Column) -> Column:
        least = F.greatest(F.ceil(n * percent / 100), F.floor(F.pow(F.lit(_ratio(percent)), _band(n, percent) + i - REACH) * (1 - 1e-9)))
        asked = F.ceil((n + least) * percent / (100 + percent) - 1e-9)
        return F.size(F.filter(shared, lambda x: F.getbit(x["mask"], i) == 1)) >= asked

    near_first = sorted(range(2 * REACH + 1), key=lambda i: abs(i - REACH))
    return F.exists(F.array(*map(F.lit, near_first)), enough)


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, tokens, dfs): of each set that may link its shared shingles, those in the fewest sets first."""
    band = _band(F.col("n"), percent)
    tokens = sets.select("sid", "n", F.explode("tokens").alias("token"))
    # bands, modulo 64, of the sets that have a shingle: a bit too many costs a look, never a link
    bit = F.expr("shiftleft(1L, cast(pmod(band, 64) as int))")
    df = tokens.withColumn("band", band).groupBy("token").agg(F.count("*").alias("count"), F.bit_or(bit).alias("bands")).where("count > 1")
    mask = F.when(F.col("count") > F.bit_count("bands"), 1 << REACH).otherwise(0)  # some band has two sets
    for i in range(-REACH, REACH + 1):
        if i:
            mask = mask + F.getbit("bands", F.pmod(F.col("band") + i, F.lit(64))).cast("int") * (1 << (i + REACH))
    shared = tokens.join(df, "token").withColumn("band", band).select("sid", "n", F.struct(F.col("count").cast("int").alias("df"), "token", mask.cast("int").alias("mask")).alias("one"))
    out = shared.groupBy("sid", "n").agg(F.sort_array(F.collect_list("one")).alias("all"))
    out = out.where((F.size("all") >= F.ceil(F.col("n") * percent / 100)) & _may_link(F.col("n"), F.col("all"), percent))
    return out.select("sid", "n", F.col("all.token").alias("tokens"), F.col("all.df").alias("dfs"))


def _links(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """sets: (sid, n, tokens, dfs), shared tokens only, rarest first -> links that span the components."""
    n = F.col("n")
    # of the whole set's rarest ones, those that no other set has come first
    length = n - F.ceil(n * percent / 100) + 1 - (n - F.size("tokens"))
    prefixes = sets.withColumn("p", length.cast("int")).where("p > 0").select("sid", F.explode(F.slice("tokens", 1, F.least("p", F.size("tokens")))).alias("token"))
    least = prefixes.groupBy("token").agg(F.min("sid").alias("pivot"), F.max("sid").alias("most")).where("pivot <> most")
    pivots = materialize(prefixes.join(least, "token").groupBy("sid").agg(F.collect_set("pivot").alias("pivots")), "pivots")
    members = pivots.select("sid", F.explode("pivots").alias("pivot"))
    sizes = materialize(members.groupBy("pivot").count().where("count > 1"), "sizes")
    chunks = F.ceil(F.col("count") / block).cast("int")
    dealt = members.join(sizes, "pivot").withColumn("k", chunks).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    mark = (F.col("k") > 1) & (F.pmod(F.xxhash64("sid", F.lit(7)), F.ceil(F.col("count") / LANDMARKS)) == 0)
    spread = dealt.select("pivot", F.explode(F.when(mark, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("chunk"))).alias("i"), "sid")
    own = sets.select("sid", "n", "tokens", "dfs")
    parts = spread.select("pivot", "i", F.col("i").alias("j"), "sid", F.lit(True).alias("probe"), F.col("sid").alias("comp"))
    links = materialize(_block_links(parts.join(own, "sid"), percent), "links")
    if not sizes.where(F.col("count") > block).limit(1).count():
        return links
    found = connected_components(links).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    labelled = materialize(dealt.where("k > 1").join(found, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "labelled")
    shares = labelled.groupBy("pivot", "comp").count()
    main = shares.groupBy("pivot").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.ceil((F.sum("count") - F.max("count")) / block).cast("int").alias("kr")).where("kr > 0")
    marked = labelled.join(main, "pivot").withColumn("rest", F.col("comp") != F.col("main"))
    everyone = marked.select("pivot", F.explode(F.sequence(F.lit(0), F.col("kr") - 1)).alias("i"), F.col("chunk").alias("j"), "sid", F.lit(False).alias("probe"), "comp")
    rest = marked.where("rest").withColumn("i", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("kr")).cast("int"))
    rest = rest.select("pivot", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), "sid", F.lit(True).alias("probe"), "comp")
    # a set that is both a probe and of the chunk comes twice; its own twin links with nothing new
    more = _block_links(everyone.union(rest).join(own, "sid"), percent)
    return materialize(links.union(more), "links")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_shingles, component_id, class_copies, text_hash, leads).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. ``component_id`` is the least id reachable
    over links, the row's own included; ``class_copies`` counts the rows with the same set. ``text_hash`` is a hash
    of the text, and ``leads`` tells whether id and text are those of the one that stands for the component: the
    least id, and of texts that share it the one with the least hash.

    Null and empty texts and texts of white space only have ``n_shingles`` 0, link with nothing and are
    their own component. A text of fewer than k words is one shingle. Repeated rows stay, each with the
    shared component, and each leads if one does. Rows with a null id stay and link as others do; the null counts
    as no id, so their component is the least id that isn't null, or null. An empty table gives an empty result.
    Other columns of ``docs``, whatever their names, are not touched."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    whole = materialize(_signatures(docs, k, percent), "prefixes")
    signed = materialize(whole.drop("prefix"), "signatures")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    classes = signed.where("sid is not null").groupBy("sid", "sid2").agg(F.min(rep).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")

    rows = whole.where("prefix is not null").select("sid", F.explode("prefix").alias("token"))
    common = rows.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token")
    shared = rows.join(common, "token").distinct().groupBy("sid").count()
    least_n = F.ceil(F.col("n") * percent / 100)
    stay = classes.join(shared, "sid").where(F.col("count") >= F.floor(least_n / 16) + 1)
    reps = materialize(stay.select(F.col("rep.id").alias("rep_id"), F.col("rep.hash").alias("rep_hash"), F.col("sid").alias("want")), "candidates")
    discard(whole)

    same = (F.col("hash") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep_id"))
    written = materialize(_full_sets(docs.join(broadcast_if_small(reps, 40), same).select("text", "want"), k), "sets")
    again = written.groupBy("sid").agg(F.min("task").alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("sid").alias("twice"), "first")
    # the sets stay where they are: repeated rows alone make a class come from two tasks
    sets = written.join(broadcast_if_small(materialize(again, "again"), 24), F.col("sid") == F.col("twice"), "left").where("first is null or task = first")
    ordered = materialize(_ordered(sets, percent), "ordered")
    discard(written)
    links = _links(ordered, percent, block)
    discard(ordered)

    found = materialize(connected_components(links), "components")
    leaders = classes.join(found, F.col("sid") == F.col("node")).groupBy("component").agg(F.min("rep").alias("lead"))
    named = found.join(leaders, "component").select("node", "lead")
    known = classes.join(named, F.col("sid") == F.col("node"), "left").select(F.col("sid").alias("s1"), F.col("sid2").alias("s2"), "copies", F.coalesce("lead", "rep").alias("lead"))
    out = signed.join(known, (F.col("sid") == F.col("s1")) & (F.col("sid2") == F.col("s2")), "left")
    leads = F.col("sid").isNull() | (F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("hash") == F.col("lead.hash")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("lead.id")).alias("component_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("class_copies"),
        F.col("hash").alias("text_hash"),
        leads.alias("leads"),
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.sh FROM s JOIN f USING (sh)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list(sh)) AS shs FROM s GROUP BY doc_id),
z AS (SELECT doc_id, count(*) OVER (PARTITION BY shs) AS copies FROM k)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id,
  CAST(coalesce(z.copies, 1) AS BIGINT) AS class_copies
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
"""
