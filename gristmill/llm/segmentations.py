"""Sampled SentencePiece segmentations without replacement, and decoding.

All ways to cut a text into pieces form a lattice, with a weight for each piece. Gumbel top-k draws k distinct
segmentations as if one after another without replacement: each would get its log probability plus Gumbel
noise, and the k largest are wanted. A-star search finds them without looking at the others. A node of the
search is a set of segmentations with a common beginning; the largest perturbed value below it is known
when it is made, as noise is drawn for the whole set first and then handed down: the drawn path keeps it, and
at each of its steps the group of siblings gets a Gumbel value cut off at it. The best open group is the
next segmentation's start. The value of the best group left open gives the inclusion probabilities.

Pieces never hold two bytes that are neighbours in no piece, so a text falls into segments (mostly words) that
are cut independently, and the lattice of a segment (arcs by place, with the probability of each given the
place, from a backward sum over all completions) is built once for each distinct segment that a worker keeps.
All steps work on arrays over many texts. Noise depends on the row's key and the place in the text alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textops
from gristmill.llm.storage import arrow_batches, map_arrow

#: Distinct segments and arcs that a worker keeps; others are built when they come.
KEPT, KEPT_ARCS = 150_000, 2_500_000
#: Bytes after which a run of spaces is cut, lest its lattice, with an arc for each run of up to 16, fill a worker.
LONGEST = 1 << 16
#: Segments whose lattices are built together.
BUILT = 2048
U64 = np.uint64
_GOLD, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0], then those of the others."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def uniform(seed: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 that depend on a seed and places."""
    x = seed
    for p in places:
        x = textops.mix(x + _GOLD * (np.atleast_1d(p).astype(U64) + U64(1)))
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces of a model file as bytes, a space for the mark of a word's beginning, and their weights: with
    scores that are ranks (0, -1, -2, ...), log weight = -alpha * ln(2 - score)."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        weights = np.zeros(n)
        plain = []
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        for i in range(n):
            weights[i] = -alpha * np.log(2.0 + min(n, max(0.0, -model.get_score(i))))
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                self.bytes_of[i] = bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = model.id_to_piece(i).replace("▁", " ").encode()
                plain.append(i)
        self.weights = weights
        data = np.frombuffer(b"".join(self.bytes_of[i] for i in plain), np.uint8)
        sizes = np.array([len(self.bytes_of[i]) for i in plain], np.int64)
        ends = np.cumsum(sizes)
        hashes = textops.hash_spans(data, ends - sizes, ends)
        _, keep = np.unique(hashes, return_index=True)
        self.table = textops.HashTable(len(keep))
        self.table.add(hashes[keep])
        self.ids = np.array(plain, np.int32)[keep]
        self.sizes = sorted(set(sizes.tolist()))
        self.neighbours = np.zeros((256, 256), bool)
        inner = np.ones(len(data), bool)
        inner[(ends - sizes)] = False
        at = np.flatnonzero(inner)
        self.neighbours[data[at - 1], data[at]] = True
        self.neighbours[:, 0x80:0xC0] = True  # never inside a character
        flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat, self.flat_ends = flat, np.cumsum([len(b) for b in self.bytes_of])
        self.flat_sizes = np.array([len(b) for b in self.bytes_of], np.int64)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of ids up to each end: the pieces' joined, without the space put before a text."""
        sizes = self.flat_sizes[ids]
        data = self.flat[ranges(self.flat_ends[ids] - sizes, sizes)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Lattices:
    """The lattices of distinct segments. A node is a place in a segment; its arcs lie together, likelier ones
    first, with the running sum of their probabilities."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.table = textops.HashTable(KEPT)
        self.arcs = self.nodes = self.nodes_written = 0
        self.roots = np.zeros(KEPT, np.int64)
        self._room(1 << 16, 1 << 16)
        self.first[0] = 0

    def _room(self, n: int, a: int) -> None:
        """Make room for n nodes and a arcs."""

        def grown(old: np.ndarray | None, size: int, kind: type) -> np.ndarray:
            if old is not None and len(old) >= size:
                return old
            new = np.empty(max(size, len(old) + len(old) // 4 if old is not None else 0), kind)
            if old is not None:
                new[: len(old)] = old
            return new

        self.first = grown(getattr(self, "first", None), n, np.int32)
        self.cdf = grown(getattr(self, "cdf", None), a, np.float32)
        self.log_q = grown(getattr(self, "log_q", None), a, np.float32)
        self.piece = grown(getattr(self, "piece", None), a, np.int32)
        self.next = grown(getattr(self, "next", None), a, np.int32)

    def find(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The root node of each segment, building those that aren't kept."""
        self.nodes_written = self.nodes
        place = self.table.get(h)
        missing = np.flatnonzero(place < 0)
        out = self.roots[np.maximum(place, 0)]
        if len(missing):
            new, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            nodes, arcs, roots = self.nodes, self.arcs, []
            for i in range(0, len(at), BUILT):
                own = at[i : i + BUILT]
                more, n, m = self._build(data, s[own], e[own], nodes, arcs)
                roots.append(more)
                nodes, arcs = nodes + n, arcs + m
            roots = np.concatenate(roots)
            self.nodes_written = nodes
            out[missing] = roots[inverse]
            if self.table.n + len(new) <= KEPT and arcs <= KEPT_ARCS:
                self.roots[self.table.n : self.table.n + len(new)] = roots
                self.table.add(new)
                self.nodes, self.arcs = nodes, arcs
        return out

    def _build(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, base: int, arcs: int) -> tuple[np.ndarray, int, int]:
        """Write the lattices of segments from node ``base`` and arc ``arcs`` on: roots, and how many of each."""
        v, sizes = self.v, e - s
        buf = data[ranges(s, sizes)]
        n = len(buf)
        ends = np.cumsum(sizes)
        end_of = np.repeat(ends, sizes)
        remain = end_of - np.arange(n)
        running = textops.RunningHash(buf)
        lead = (buf & 0xC0) != 0x80
        width = np.where(buf < 0x80, 1, np.where(buf >= 0xF0, 4, np.where(buf >= 0xE0, 3, 2)))
        starts = np.flatnonzero(lead)
        have = np.zeros(n, bool)
        at, length, piece = [], [], []
        for size in v.sizes:
            starts = starts[remain[starts] >= size]
            if not len(starts):
                break
            found = v.table.get(running.spans(starts, starts + size))
            hit = found >= 0
            p = starts[hit]
            at.append(p), length.append(np.full(len(p), size)), piece.append(v.ids[found[hit]])
            have[p[width[p] == size]] = True
        bare = np.flatnonzero(lead & ~have)  # characters without a piece: byte by byte
        if len(bare):
            p = ranges(bare, np.minimum(width[bare], remain[bare]))
            at.append(p), length.append(np.ones(len(p), np.int64)), piece.append(v.byte_id[buf[p]])
        at, length, piece = np.concatenate(at), np.concatenate(length), np.concatenate(piece)
        # from the ends backwards: the log sum of the weights of all completions
        total = np.zeros(n + 1)
        order = np.lexsort((at, remain[at]))
        at, length, piece = at[order], length[order], piece[order]
        weight, target, left = v.weights[piece], at + length, remain[at]
        final = target == end_of[at]
        steps = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        value = np.empty(len(at))
        for a, b in zip(steps, [*steps[1:], len(at)], strict=True):
            value[a:b] = weight[a:b] + np.where(final[a:b], 0.0, total[target[a:b]])
            x = at[a:b]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            total[x[first]] = np.logaddexp.reduceat(value[a:b], first)
        log_q = value - total[at]
        order = np.lexsort((piece, -log_q, at))
        at, piece, target, final, log_q = at[order], piece[order], target[order], final[order], log_q[order]
        self._room(base + n + 1, arcs + len(at))
        counts = np.bincount(at, minlength=n)
        offsets = arcs + np.concatenate([[0], np.cumsum(counts)])
        self.first[base : base + n + 1] = offsets
        summed = np.cumsum(np.exp(log_q))
        before = np.concatenate([[0], summed])[offsets[:-1] - arcs]
        cdf = summed - before[at]
        cdf[np.flatnonzero(np.r_[at[1:] != at[:-1], True])] = 2
        a = slice(arcs, arcs + len(at))
        self.cdf[a], self.log_q[a], self.piece[a] = cdf, np.minimum(log_q, 0), piece
        self.next[a] = np.where(final, -1, base + target)
        return base + ends - sizes, n, len(at)

    def walk(self, node: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """Draw arcs from each node to the end of its segment: all arcs, walker after walker, and their numbers.
        ``draw(walkers, step)`` gives their uniform numbers."""
        taken, walkers, counts, step = [], [], np.zeros(len(node), np.int64), 0
        who = np.arange(len(node))
        while len(who):
            u = draw(who, step)
            arc = self.first[node].astype(np.int64)
            on = np.flatnonzero(u >= self.cdf[arc])
            while len(on):
                arc[on] += 1
                on = on[u[on] >= self.cdf[arc[on]]]
            taken.append(arc), walkers.append(who)
            counts[who] += 1
            node = self.next[arc]
            more = node >= 0
            node, who, step = node[more], who[more], step + 1
        out = np.empty(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        for i, (arc, who) in enumerate(zip(taken, walkers, strict=True)):
            out[begin[who] + i] = arc
        return out, counts


class Paths:
    """One segmentation of each of some texts: steps, text after text, with the bounds of the sibling groups."""

    def __init__(self, arc: np.ndarray, occurrence: np.ndarray, sizes: np.ndarray, lattices: Lattices):
        self.arc, self.occurrence, self.sizes = arc, occurrence, sizes
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        log_q = lattices.log_q[arc].astype(np.float64)
        summed = np.concatenate([[0], np.cumsum(log_q)])
        self.log_p = summed[self.ends] - summed[self.begins]
        self.before = summed[:-1] - np.repeat(summed[self.begins], sizes)  # log probability of what comes before a step
        self.log_q = log_q

    def set_bounds(self, g: np.ndarray, u: np.ndarray, skip: np.ndarray) -> None:
        """``g``: the perturbed value of each text's path; the first ``skip`` steps have no group of their own."""
        with np.errstate(divide="ignore"):
            place = self.before + np.log(-np.expm1(self.log_q))
            top = np.repeat(g, self.sizes)
            self.bound = place - np.log(np.exp(place - top) - np.log(u))
        self.bound[~np.isfinite(place)] = -np.inf
        self.bound[ranges(self.begins, skip)] = -np.inf

    def best(self) -> np.ndarray:
        out = np.full(len(self.sizes), -np.inf)
        full = self.sizes > 0
        if full.any():
            out[full] = np.maximum.reduceat(self.bound, self.begins[full])
        return out


class Sampler:
    def __init__(self, path: str, alpha: float):
        self.v = Vocabulary(path, alpha)
        self.lattices = Lattices(self.v)

    def segments(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Root node and text of each segment."""
        data, offsets = textops.raw(column)
        sizes = np.diff(offsets)
        full = sizes > 0
        data = np.insert(data, offsets[:-1][full], 32)  # the space that the library puts before a text
        offsets = np.concatenate([[0], np.cumsum(sizes + full)])
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else []
        if len(mark):  # the mark itself stands for a space
            data[mark] = 32
            keep = np.ones(len(data), bool)
            keep[mark + 1] = keep[mark + 2] = False
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            data = data[keep]
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self.v.neighbours[data[:-1], data[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        for i in np.flatnonzero(np.diff(at) > LONGEST).tolist():
            places = np.arange(at[i] + LONGEST, at[i + 1], LONGEST)
            cut[places[(data[places - 1] == 32) & (data[places] == 32)]] = True
        at = np.flatnonzero(cut)
        s, e = (at[:-1], at[1:]) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
        roots = self.lattices.find(data, textops.hash_spans(data, s, e), s, e) if len(s) else s
        return roots, np.searchsorted(offsets, s, side="right") - 1

    def sample(self, column: pa.Array, seeds: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray, np.ndarray]:
        """Up to k paths for each text, by descending perturbed value; how many each text has, and the value of
        the best group left open."""
        n, lat = len(column), self.lattices
        roots, owner = self.segments(column)
        bounds = np.searchsorted(owner, np.arange(n + 1))
        place = np.arange(len(roots)) - bounds[owner] if len(owner) else np.empty(0, np.int64)

        def noise(texts: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
            return uniform(seeds[texts], *more)

        texts = np.arange(n)
        g = -np.log(-np.log(noise(texts, 1)))
        arc, counts = lat.walk(roots, lambda who, step: noise(owner[who], 2, place[who], step))
        sizes = np.add.reduceat(np.append(counts, 0), bounds[:-1]) * (np.diff(bounds) > 0) if n else np.empty(0, np.int64)
        path = Paths(arc, np.repeat(np.arange(len(roots)), counts), sizes, lat)
        path.set_bounds(g, noise(np.repeat(texts, sizes), 3, ranges(np.zeros(n, np.int64), sizes)), np.zeros(n, np.int64))
        paths, number, taken = [path], np.ones(n, np.int64), {}
        for turn in range(2, k + 1):
            values = np.array([p.best() for p in paths])
            which, g = values.argmax(axis=0), values.max(axis=0)
            live = g > -np.inf
            step = np.zeros(n, np.int64)
            for i, p in enumerate(paths):
                own = np.flatnonzero(live & (which == i))
                if len(own):
                    hit = np.flatnonzero(p.bound == np.repeat(np.where(live & (which == i), g, np.nan), p.sizes))
                    text = np.searchsorted(p.ends, hit, side="right")
                    step[text[::-1]] = hit[::-1]  # the first, should two be equal
            chosen, u, u2 = np.zeros(n, np.int64), noise(texts, turn, 4), noise(texts, turn, 5)
            for t in np.flatnonzero(live).tolist():
                chosen[t] = self._branch(paths[which[t]], int(which[t]), t, int(step[t]), g[t], u[t], u2[t], taken)
            number += live
            paths.append(self._extended(paths, which, step, chosen, live, roots, owner, bounds, place, seeds, turn))
            skip = np.where(live, step - np.array([p.begins for p in paths[:-1]])[which, texts] + 1, 0)
            path = paths[-1]
            path.set_bounds(np.where(live, g, 0), noise(np.repeat(texts, path.sizes), turn, 6, ranges(np.zeros(n, np.int64), path.sizes)), np.minimum(skip, path.sizes))
        return paths, number, np.array([p.best() for p in paths]).max(axis=0) if n else np.empty(0)

    def _branch(self, path: Paths, which: int, text: int, step: int, g: float, u: float, u2: float, taken: dict) -> int:
        """Pick the arc that the best of a sibling group takes; what is left of the group stays open with a value
        below that one's."""
        lat = self.lattices
        arc = int(path.arc[step])
        node = int(np.searchsorted(lat.first[: lat.nodes_written + 1], np.int32(arc), side="right")) - 1
        arcs = range(int(lat.first[node]), int(lat.first[node + 1]))
        gone = taken.setdefault((text, which, step), {arc})
        open_ = [a for a in arcs if a not in gone]
        q = np.exp(lat.log_q[open_].astype(np.float64))
        pick = min(int(np.searchsorted(np.cumsum(q), u * q.sum(), side="right")), len(open_) - 1)
        gone.add(open_[pick])
        rest = q.sum() - q[pick] if len(open_) > 1 else 0.0
        if rest > 0:
            place = path.before[step] + np.log(rest)
            path.bound[step] = place - np.log(np.exp(place - g) - np.log(u2))
        else:
            path.bound[step] = -np.inf
        return open_[pick]

    def _extended(self, paths, which, step, chosen, live, roots, owner, bounds, place, seeds, turn) -> Paths:
        """The paths that keep the steps before ``step``, take the chosen arc, and go on with new draws."""
        lat, texts = self.lattices, np.flatnonzero(live)
        begin = np.array([paths[which[t]].begins[t] for t in texts], np.int64)
        kept = step[texts] - begin
        prefix_arc, prefix_occ = [], []
        here = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts.tolist()):
            p = paths[which[t]]
            prefix_arc.append(p.arc[begin[i] : step[t]]), prefix_occ.append(p.occurrence[begin[i] : step[t]])
            here[i] = p.occurrence[step[t]]
        # walkers: the rest of the own segment, then all later segments of the text
        node = lat.next[chosen[texts]].astype(np.int64)
        later = bounds[texts + 1] - here - 1
        sizes = later + 1
        first = np.cumsum(sizes) - sizes
        occurrence = ranges(here, sizes)
        start = roots[occurrence].copy()
        start[first] = node
        go = start >= 0
        arc, counts = lat.walk(start[go], lambda who, at: uniform(seeds[owner[occurrence[go][who]]], turn, 7, place[occurrence[go][who]], at))
        all_counts = np.zeros(len(start), np.int64)
        all_counts[go] = counts
        suffix = np.add.reduceat(all_counts, first) if len(first) else np.empty(0, np.int64)
        length = kept + 1 + suffix
        out_arc, out_occ = np.empty(int(length.sum()), np.int64), np.empty(int(length.sum()), np.int64)
        at = np.cumsum(length) - length
        if len(texts):
            head = ranges(at, kept)
            out_arc[head], out_occ[head] = np.concatenate(prefix_arc), np.concatenate(prefix_occ)
            out_arc[at + kept], out_occ[at + kept] = chosen[texts], here
            tail = ranges(at + kept + 1, suffix)
            out_arc[tail], out_occ[tail] = arc, np.repeat(occurrence, all_counts)
        sizes = np.zeros(len(live), np.int64)
        sizes[texts] = length
        return Paths(out_arc, out_occ, sizes, lat)


@lru_cache(maxsize=2)
def sampler(path: str, alpha: float) -> Sampler:
    return Sampler(path, alpha)


def log_inclusion(log_p: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Log of 1 - exp(-exp(log_p - threshold)): the chance that a segmentation's perturbed value passes."""
    x = log_p - threshold
    return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 30)))))


def sample_segmentations(docs: DataFrame, model: str, samples: int = 2, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, sample, ids, log_prob, log_inclusion, round_trip): up to ``samples`` distinct segmentations of
    each text in the order drawn. ``log_inclusion`` is the log of the chance to be among the samples, given the
    best that isn't. ``round_trip`` tells that the ids decode to the text again, as they do unless it holds the
    mark U+2581, which stands for a space.

    A text with fewer segmentations has fewer rows; the empty or null text has one row with no ids. Rows with
    equal ids and texts get equal samples; a null id counts as one key. Texts are taken whole; other
    columns are not read."""
    arrow_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = sampler(model, alpha)
        for batch in batches:
            column = textops.text_column(batch.column(1))
            keys = batch.column(2).to_numpy().astype(np.int64).view(U64)
            for a, b in textops.pieces(textops.raw(column)[1], 1 << 17):
                part = column.slice(a, b - a)
                data, offsets = textops.raw(part)
                data, offsets = data.tobytes(), offsets.tolist()
                paths, _, threshold = draw.sample(part, keys[a:b], samples)
                for i, p in enumerate(paths):
                    rows = np.arange(b - a) if i == 0 else np.flatnonzero(p.sizes > 0)
                    ids, ends = draw.lattices.piece[p.arc], p.ends[rows]
                    same = [t == data[offsets[r] : offsets[r + 1]] for r, t in zip(rows.tolist(), draw.v.texts(ids, ends), strict=True)]
                    yield pa.record_batch(
                        [
                            batch.column(0).take(pa.array(rows + a)),
                            pa.array(np.full(len(rows), i + 1, np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)),
                            pa.array(p.log_p[rows]),
                            pa.array(log_inclusion(p.log_p, threshold)[rows]),
                            pa.array(same, pa.bool_()),
                        ],
                        names=["id", "sample", "ids", "log_prob", "log_inclusion", "round_trip"],
                    )

    out = map_arrow(own, run, f"id {own.schema['id'].dataType.simpleString()}, sample int, ids array<int>, log_prob double, log_inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(segmentations: DataFrame, model: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``segmentations`` with the text of their ids as column ``to``: the pieces' bytes joined, without the space
    put before a text. Control pieces have no text. Null ids give the empty text; bytes that are no UTF-8, as
    other programs' ids may be, become U+FFFD."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in segmentations.schema)}, `{to}` string"
    place = segmentations.columns.index(ids_col)
    names = [*segmentations.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sampler(model, 1.0).v
        for batch in batches:
            lists = batch.column(place).fill_null([])
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            texts = [t.decode("utf-8", "replace") for t in v.texts(lists.flatten().to_numpy(zero_copy_only=False), ends)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=names)

    return map_arrow(segmentations, run, schema)
