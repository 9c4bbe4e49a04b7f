"""Benchmark decontamination by latent semantic retrieval (operator 8).

1. One pass over the texts keeps of each document the places and numbers of the
   words that occur in the benchmark (all others are zero in every product
   with a benchmark item); the result is written and is all that is read later.
2. Passages are windows of ``2 * STEP`` words, ``STEP`` apart.  Their document
   frequencies, summed over all passages of all documents, give the IDF, which
   is smoothed and never under ``FLOOR`` of the largest one: copies of an item
   raise their own words' frequencies, so no word may lose its weight by them.
   A passage's other words count to its length with the middle IDF.
3. Randomised SVD of the TF-IDF passages A of the corpus: each partition adds up
   A'(A R) for a sparse random R (one signed entry per word, so the cost is that of
   the passages' own entries), partial sums meet in a tree of groups, and a QR of
   the total gives Q; a second pass adds up the small (A Q)'(A Q), whose
   eigenvectors turn Q into the singular directions.  The first ``RANK`` of them (a third
   of the items, if these are few) are the latent space, in which words that keep the same
   company lie together.  Items are projected into it.
4. Candidates of an item are the passages whose cosine with it in the latent space reaches
   ``LATENT``: other words may stand for its own there, and words that the corpus hardly
   uses don't count.  As a space of the corpus says little about an item of rare
   words, passages whose plain product with it reaches ``COSINE``, and those with ``RUN``
   words of it in a row, or the whole of a shorter item, are candidates too.  (Passages whose
   benchmark words make up less than ``COSINE`` of their length are left out of both
   cosines.)  Around each, the longest common subsequence of the item's words
   and the document's must reach ``COVERAGE`` of the item, and of what the item
   answers, its different words weighted by their IDF, the share ``ANSWER``
   must be there.  This finds paraphrases with words changed, added or left
   out, and passes by texts that share only frequent words with an item.

The benchmark is the query side, and what is sent to the executors and added up in a task
grows with its vocabulary only: the basis, ``(RANK + SPARE) * 8`` bytes a word, is checked
against ``BASIS_BYTES``.  Items over ``LONG`` words are searched by their own passages, as
one window holds too little of them; the check is on the whole item.  All items share
one space, so their number doesn't change the number of passes.

Defined results: a null or empty text or item matches nothing; of several
matches a document reports the best (longest share, then smallest item);
repeated rows are treated alike; an empty benchmark leaves every document
clean; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package
from .common import text_chunks, word_hashes

STEP, FLOOR, COSINE, LATENT, COVERAGE, ANSWER, RUN = 16, 1 / 3, 0.3, 0.9, 0.6, 0.5, 8
RANK, SPARE, SEED, LONG = 48, 16, 11, 4 * STEP
BASIS_BYTES = 1 << 30       # 2 million words of a benchmark
_SEND = 256


class Benchmark:
    """Items as sequences of word numbers, and the sorted hashes of their words."""

    def __init__(self, items: list[tuple[int, str]]):
        items = sorted((i, t) for i, t in items if i is not None and t)
        column = pa.array([t for _, t in items], pa.string())
        words = [np.zeros(0, np.uint64)]
        sequences = []
        for _, _, data, offsets in text_chunks(column):
            h, first = word_hashes(data, offsets)
            sequences += [h[a:b] for a, b in zip(first[:-1], first[1:])]
        words = np.unique(np.concatenate(words + sequences))
        if len(words) * (RANK + SPARE) * 8 > BASIS_BYTES:
            raise ValueError(f"the benchmark has {len(words)} different words; their basis takes more than {BASIS_BYTES} bytes")
        self.words = words
        kept = [(i, np.searchsorted(words, s).astype(np.int32)) for (i, _), s in zip(items, sequences) if len(s)]
        self.ids, self.items = [i for i, _ in kept], [s for _, s in kept]


def _run_hashes(term: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    h = np.zeros(max(len(term) - n + 1, 0), np.uint64)
    for i in range(n if len(h) else 0):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (term[i: i + len(h)].astype(np.uint64) + np.uint64(1))
    return h


class Runs:
    """The items' runs of ``RUN`` words, or of all words of a shorter item, by length: sorted hashes and their items."""

    def __init__(self, items: list[np.ndarray]):
        lists: dict[int, list] = {}
        for i, s in enumerate(items):
            n = min(len(s), RUN)
            h = np.unique(_run_hashes(s, n))
            lists.setdefault(n, []).append((h, np.full(len(h), i)))
        self.tables = {}
        for n, parts in lists.items():
            h, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.tables[n] = h[order], item[order]

    def places(self, row, place, term) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of hits at which a run starts, and the run's item."""
        hits, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (hashes, item) in self.tables.items():
            h, last = _run_hashes(term, n), n - 1
            at = np.flatnonzero((row[last:] == row[: len(h)]) & (place[last:] - place[: len(h)] == last)) if len(h) else hits[0]
            lo, hi = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], side="right")
            times = hi - lo
            hits.append(np.repeat(at, times))
            items.append(item[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])
        return np.concatenate(hits), np.concatenate(items)


def _hits(bench):
    """(id, text) to (id, n_words, places, terms)."""
    def run(batches):
        words = bench.value.words
        top = np.zeros(1 << 20, dtype=bool)
        top[words >> np.uint64(44)] = True
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column(1)):
                h, first = word_hashes(data, offsets)
                maybe = np.flatnonzero(top[h >> np.uint64(44)])
                term = np.searchsorted(words, h[maybe])
                term[term == len(words)] = 0
                true = words[term] == h[maybe] if len(words) else np.zeros(0, bool)
                place, term = maybe[true], term[true].astype(np.int32)
                cut = np.searchsorted(place, first)
                rows = [(place[a:b] - f, term[a:b]) for a, b, f in zip(cut[:-1], cut[1:], first[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(np.diff(first), pa.int64()),
                     pa.array([p.astype(np.int32).tobytes() for p, _ in rows], pa.binary()),
                     pa.array([t.tobytes() for _, t in rows], pa.binary())], names=["id", "n_words", "places", "terms"])
    return run


def n_passages(n_words: np.ndarray) -> np.ndarray:
    """A text of w words has max(1, ceil(w / STEP) - 1) passages; none, if it has no words."""
    return np.where(n_words > 0, np.maximum(-(-n_words // STEP) - 1, 1), 0)


def _batch(batch):
    """Flat arrays of a batch of documents: n_words, row, place and term of each hit."""
    n = batch.column(1).to_numpy()
    places = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
    terms = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(3)]
    row = np.repeat(np.arange(len(n)), [len(p) for p in places])
    flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (places, terms)]
    return n, row, *flat


def _counts(n, row, place, term, size: int):
    """Passage numbers (over the batch), their terms and counts, sorted by passage and term; and first passages."""
    per = n_passages(n)
    base = np.concatenate([[0], np.cumsum(per)])
    last = per[row] - 1
    here = np.minimum(place // STEP, last)
    before = place // STEP - 1
    both = (before >= 0) & (before < here)
    key = np.concatenate([(base[row] + here), (base[row] + before)[both]]).astype(np.int64) * size
    key += np.concatenate([term, term[both]])
    key, count = np.unique(key, return_counts=True)
    return key // size, key % size, count, base


def _others(n, base, passage, count, idf) -> tuple[np.ndarray, np.ndarray]:
    """Of the passages that have hits: their numbers and the squared length of their other words."""
    own, at = np.unique(passage, return_inverse=True)
    d = np.searchsorted(base, own, side="right") - 1
    words = np.minimum(2 * STEP, n[d] - (own - base[d]) * STEP)
    middle = np.median(idf[idf > 0]) if (idf > 0).any() else 0.0
    return own, np.maximum(words - np.bincount(at, weights=count, minlength=len(own)), 0) * middle ** 2


def _slices(batches, rows: int = 2048):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _frequencies(size: int):
    def run(batches):
        df, total = np.zeros(size, np.int64), 0
        for batch in _slices(batches):
            n, row, place, term = _batch(batch)
            _, terms, _, base = _counts(n, row, place, term, size)
            df += np.bincount(terms, minlength=size)
            total += int(base[-1])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], total))],
                                         names=["term", "n"])
    return run


def weights(df: np.ndarray, total: int) -> np.ndarray:
    """The smoothed IDF, at least ``FLOOR`` of the largest."""
    idf = np.log((1 + total) / (1 + df)) + 1
    return np.maximum(idf, FLOOR * idf.max())


def _weighted(passage, term, count, idf, others=None):
    """TF-IDF rows of length one: passages renumbered from 0, terms, weights; and the passages' own numbers.

    ``others``: passages and the squared length of their words outside the vocabulary, which count to the length.
    """
    keep = idf[term] > 0
    passage, term, w = passage[keep], term[keep], (1 + np.log(count[keep])) * idf[term[keep]]
    own, at = np.unique(passage, return_inverse=True)
    square = np.bincount(at, weights=w * w, minlength=len(own))
    if others is not None:
        square = square + others[1][np.searchsorted(others[0], own)]
    return own, at, term, (w / np.sqrt(square)[at]).astype(np.float32)


def _rows_of(batch, idf):
    """The passages of a batch of documents as ``_weighted`` rows, their first numbers, and the batch's arrays."""
    n, row, place, word = flat = _batch(batch)
    passage, term, count, base = _counts(n, row, place, word, len(idf))
    return _weighted(passage, term, count, idf, _others(n, base, passage, count, idf)), base, flat


def _dot(at, term, w, rows: int, m: np.ndarray) -> np.ndarray:
    """The sparse rows times m; ``at`` is sorted."""
    out = np.zeros((rows, m.shape[1]), np.float32)
    for a in range(0, rows, 4096):      # in blocks, so that the gathered rows stay small
        lo, hi = np.searchsorted(at, [a, min(a + 4096, rows)])
        if hi > lo:
            out[a: a + 4096] = np.add.reduceat(m[term[lo:hi]] * w[lo:hi, None], np.searchsorted(at[lo:hi], np.arange(a, min(a + 4096, rows))))
    return out


def _random(size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random matrix: each word's column and sign."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, k, size), rng.choice(np.array([-1.0, 1.0]), size)


def _gram(at, term, w, size: int, k: int) -> np.ndarray:
    """A'(A R) of sparse rows (``at`` sorted): the pairs of entries of each row."""
    column, sign = _random(size, k)
    n = np.bincount(at)
    first = np.cumsum(n) - n
    total = np.zeros(size * k)
    step = 1 << 19
    cost = np.cumsum(n[at])                     # pairs up to each entry
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + step)))
        times = n[at[a:b]]
        left = np.repeat(np.arange(a, b), times)
        right = np.repeat(first[at[a:b]], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        total += np.bincount(term[left] * k + column[term[right]], weights=w[left] * w[right] * sign[term[right]], minlength=size * k)
        a = b
    return total.reshape(size, k)


def _sketch(idf, k: int):
    """Partial sums of A'(A R), in parts of ``_SEND`` terms."""
    size = len(idf.value)

    def run(batches):
        total, task = np.zeros((size, k)), 0
        for batch in _slices(batches):
            (own, at, term, w), *_ = _rows_of(batch, idf.value)
            if len(own):
                total += _gram(at, term, w, size, k)
                task = int(own[-1]) + 31 * task + len(own)
        total = total.astype(np.float32)
        parts = range(0, size, _SEND)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a // _SEND for a in parts], pa.int32()), pa.array([task % 256] * len(parts), pa.int32()),
             pa.array([total[a: a + _SEND].tobytes() for a in parts], pa.binary())], names=["part", "salt", "sums"])
    return run


def _add(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("sums"):
            one = np.frombuffer(x.as_buffer(), np.float32)
            total = one.astype(np.float64) if total is None else total + one
        out = {c: [table.column(c)[0].as_py()] for c in keys} | {"sums": [total.astype(np.float32).tobytes()]}
        return pa.table(out, schema=pa.schema([(c, pa.int32()) for c in keys] + [("sums", pa.binary())]))
    return run


def item_parts(items) -> list[tuple[int, np.ndarray]]:
    """What is searched: (item, its words), and the passages of items over ``LONG`` words."""
    return [(i, part) for i, s in enumerate(items) for part in (
        [s] if len(s) <= LONG else [s[a * STEP: (a + 2) * STEP] for a in range(int(n_passages(len(s))))])]


def item_rows(items, idf):
    """The items as sparse TF-IDF rows."""
    passage = np.concatenate([np.zeros(0, np.int64)] + [np.full(len(s), i) for i, s in enumerate(items)])
    key, count = np.unique(passage * len(idf) + np.concatenate([np.zeros(0, np.int64), *items]), return_counts=True)
    return _weighted(key // len(idf), key % len(idf), count, idf)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, by bit-parallel rows."""
    mask: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        mask[x] = mask.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for x in b.tolist():
        u = s & mask.get(x, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def answer(item: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An item's different words and their shares of its IDF; words of every passage count as good as nothing, but
    share alike, if an item has no others."""
    words = np.unique(item)
    weight = idf[words] + 1e-9
    return words, weight / weight.sum()


def _gram_of(basis):
    """(A Q)'(A Q) of a task's passages, as one row."""
    k = basis[1].value.shape[1]

    def run(batches):
        total, task = np.zeros((k, k)), 0
        for batch in _slices(batches):
            (own, at, term, w), *_ = _rows_of(batch, basis[0].value)
            if len(own):
                y = _dot(at, term, w, len(own), basis[1].value).astype(np.float64)
                total += y.T @ y
                task = int(own[-1]) + 31 * task + len(own)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([task % 256], pa.int32()),
                                          pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part", "salt", "sums"])
    return run


def _added(found: DataFrame) -> DataFrame:
    """Sums of the rows (part, salt, sums) of each part, in two levels."""
    return (found.groupBy("part", "salt").applyInArrow(_add(["part", "salt"]), "part int, salt int, sums binary")
            .groupBy("part").applyInArrow(_add(["part"]), "part int, sums binary"))


def latent_space(hits: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """The first ``rank`` right singular directions of the corpus's TF-IDF passages (words x rank)."""
    sc, size = hits.sparkSession.sparkContext, len(idf)
    k, weights_ = min(size, rank + SPARE), sc.broadcast(idf)
    y = np.zeros((size, k))
    for r in _added(hits.mapInArrow(_sketch(weights_, k), "part int, salt int, sums binary")).collect():
        y[r["part"] * _SEND: r["part"] * _SEND + _SEND] = np.frombuffer(r["sums"], np.float32).reshape(-1, k)
    q = np.linalg.qr(y)[0].astype(np.float32)
    small = np.zeros((k, k))
    for r in _added(hits.mapInArrow(_gram_of((weights_, sc.broadcast(q))), "part int, salt int, sums binary")).collect():
        small = np.frombuffer(r["sums"], np.float32).reshape(k, k).astype(np.float64)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-9 * max(float(values.max()), 1e-30)]
    return (q @ turn[:, order]).astype(np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-6)[:, None]


class Items:
    """The searched parts of the items as sparse TF-IDF columns, and their images in the latent space."""

    def __init__(self, parts: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, limit: float):
        own, at, term, w = item_rows(parts, idf)
        self.number, self.basis, self.limit = len(parts), basis, limit
        self.latent = np.zeros((len(parts), basis.shape[1]), np.float32)
        self.latent[own] = unit_rows(_dot(at, term, w, len(own), basis))
        order = np.argsort(term, kind="stable")
        self.part, self.value = own[at[order]], w[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def plain(self, at, term, w, rows: int):
        """(row, part) of the plain products that reach ``COSINE``."""
        step = max(1, (1 << 21) // max(self.number, 1))
        for a in range(0, rows, step):
            lo, hi = np.searchsorted(at, [a, a + step])
            times = self.first[term[lo:hi] + 1] - self.first[term[lo:hi]]
            place = np.repeat(self.first[term[lo:hi]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            n = min(step, rows - a)
            sums = np.bincount(np.repeat(at[lo:hi] - a, times) * self.number + self.part[place],
                               weights=np.repeat(w[lo:hi], times) * self.value[place], minlength=n * self.number)
            hit = np.flatnonzero(sums >= COSINE * 0.999)
            yield hit // self.number + a, hit % self.number

    def near(self, z: np.ndarray):
        """(row, part) of the cosines in the latent space that reach the limit."""
        step = max(1, (1 << 22) // max(self.number, 1))
        for a in range(0, len(z), step):
            row, part = np.nonzero(z[a: a + step] @ self.latent.T >= self.limit)
            yield row + a, part


class Answers:
    """The items' different words and their shares, and which stretches of documents hold enough of them."""

    def __init__(self, items: list[np.ndarray], rarity: np.ndarray):
        self.size, self.of = len(rarity), [answer(s, rarity) for s in items]

    def enough(self, term, lo, hi, item) -> np.ndarray:
        """For each stretch ``term[lo:hi]`` whether it has the share ``ANSWER`` of its item; item by item, in bounded parts."""
        ok = np.zeros(len(item), bool)
        order = np.argsort(item, kind="stable")
        number = np.zeros(self.size, np.int32)      # of a word among the item's, from 1
        for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
            words, share = self.of[item[group[0]]]
            number[words] = np.arange(1, len(words) + 1)
            cost = np.cumsum(hi[group] - lo[group] + len(words))
            for part in np.split(group, np.flatnonzero(np.diff(cost // (1 << 20))) + 1):
                times = hi[part] - lo[part]
                at = np.repeat(lo[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
                present = np.zeros((len(part), len(words) + 1), bool)
                present[np.repeat(np.arange(len(part)), times), number[term[at]]] = True
                ok[part] = present[:, 1:] @ share >= ANSWER
            number[words] = 0
        return ok


def _search(model):
    """Documents to their best verified match."""
    def run(batches):
        m = model.value
        for batch in _slices(batches):
            (own, at, t, w), base, (n, row, place, term) = _rows_of(batch, m["idf"])
            best: dict[int, tuple] = {}
            seen = set()
            width = int(n.max(initial=0)) + 1
            places = row * width + place

            def look(d, p, g, cosine):
                """Checks items g around passages p of documents d (arrays); ``cosine`` of a number gives that one's cosine."""
                start, length = (p - base[d]) * STEP, m["lengths"][g]
                lo = np.searchsorted(places, d * width + np.maximum(start - length, 0))
                hi = np.searchsorted(places, d * width + np.minimum(start + 2 * STEP + length, width - 1))
                for k in np.flatnonzero(m["answers"].enough(term, lo, hi, g)).tolist():
                    place_of = int(d[k]), int(g[k]), int(lo[k]), int(hi[k])
                    if place_of in seen:
                        continue
                    seen.add(place_of)
                    item = m["items"][g[k]]
                    common = lcs(item, term[lo[k]: hi[k]])
                    if common >= COVERAGE * len(item):
                        found = (common / len(item), -m["ids"][g[k]], common, len(item), cosine(k))
                        best[place_of[0]] = max(best.get(place_of[0], found), found)

            items = m["parts"]
            # a row's product with a unit vector is at most the length of its own entries
            keep = np.bincount(at, weights=w * w, minlength=len(own)) >= COSINE ** 2 * 0.999
            at_, rows = at[keep[at]], np.flatnonzero(keep)
            z = np.zeros((len(own), items.basis.shape[1]), np.float32)
            z[rows] = unit_rows(_dot(np.searchsorted(rows, at_), t[keep[at]], w[keep[at]], len(rows), items.basis))

            def similar(row: int, part: int) -> float:
                if not keep[row]:
                    lo, hi = np.searchsorted(at, [row, row + 1])
                    z[row] = unit_rows((w[lo:hi] @ items.basis[t[lo:hi]])[None])[0]
                return float(z[row] @ items.latent[part])

            found = [items.near(z), items.plain(at_, t[keep[at]], w[keep[at]], len(own))]
            for i, j in (x for pairs in found for x in pairs):
                look(np.searchsorted(base, own[i], side="right") - 1, own[i], m["whose"][j], lambda k: similar(i[k], j[k]))
            hit, item = m["runs"].places(row, place, term)
            passage = np.minimum(base[row[hit]] + place[hit] // STEP, base[row[hit] + 1] - 1)
            p, g = np.unique(np.stack([passage, item], axis=1), axis=0).T
            look(np.searchsorted(base, p, side="right") - 1, p, g, lambda k: max(
                similar(int(np.searchsorted(own, p[k])), j) for j in range(*np.searchsorted(m["whose"], [g[k], g[k] + 1]))))
            rows = [best.get(d) for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r is not None for r in rows], pa.bool_()),
                 pa.array([r and -r[1] for r in rows], pa.int64()), pa.array([r and r[2] for r in rows], pa.int32()),
                 pa.array([r and r[3] for r in rows], pa.int32()), pa.array([r and round(r[4], 4) for r in rows], pa.float64())],
                names=["id", "n_words", "contaminated", "item_id", "common_words", "item_words", "cosine"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", latent: float = LATENT) -> DataFrame:
    """Per row of ``docs``: id, n_words, contaminated, item_id, common_words, item_words, cosine."""
    spark = docs.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    listed = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string").alias("text"))
    if (listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BASIS_BYTES:
        raise ValueError(f"the benchmark's texts take more than {BASIS_BYTES} bytes")
    bench = Benchmark([tuple(r) for r in listed.toLocalIterator()])
    carried = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])

    def schema(more: str) -> T.StructType:
        return T.StructType(carried.fields + T.StructType.fromDDL(more).fields)

    hits = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _hits(sc.broadcast(bench)), schema("n_words long, places binary, terms binary")), "hits")
    size = max(len(bench.words), 1)
    # (what an id carries stays out of the passes that don't return it)
    words = hits.select(F.lit(0).alias("id"), "n_words", "places", "terms")
    counted = (words.mapInArrow(_frequencies(size), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    df = np.zeros(size, np.int64)
    total = sum(r["n"] for r in counted if r["term"] < 0)
    for r in counted:
        if r["term"] >= 0:
            df[r["term"]] = r["n"]
    idf, parts = weights(df, total), item_parts(bench.items)
    rank = max(1, min(RANK, len(bench.items) // 3))
    basis = latent_space(words, idf, rank) if parts else np.zeros((size, 1), np.float32)
    rarity = np.log((1 + total) / (1 + df))
    model = {"idf": idf, "parts": Items([p for _, p in parts], idf, basis, latent), "ids": bench.ids, "items": bench.items,
             "runs": Runs(bench.items), "whose": np.array([i for i, _ in parts], np.int64),
             "lengths": np.array([len(s) for s in bench.items], np.int64), "answers": Answers(bench.items, rarity)}
    out = schema("n_words long, contaminated boolean, item_id long, common_words int, item_words int, cosine double")
    return hits.mapInArrow(_search(sc.broadcast(model)), out).withColumnRenamed("id", id_col)
