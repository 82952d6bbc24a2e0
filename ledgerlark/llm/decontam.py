"""Benchmark decontamination: passages within a few word edits of a benchmark item.

Item-sized windows of a document and the items themselves are embedded by the
CGK random walk, which turns edit distance into Hamming distance; repeated
bit-sampling of the embedded words finds candidate pairs.  That search misses
the more, the longer the item and the more its edits, so it is completed by
pieces: an item cut into one piece more than its allowed edits keeps one of them
unedited in every passage that near.  An exact edit distance decides on all
candidates, so no passage within the allowed edits is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dartminhash import _mix, _words

U = np.uint64
PAD = U(0x9E3779B97F4A7C15)  # the embedded symbol beyond a window's end
MATCHES = "array<struct<item_id: bigint, edits: int, start: int>>"
CHUNK = 1_000_000           # words of documents handled at a time
WINDOWS = 2_000             # windows embedded at a time


def allowed_edits(n: int, similarity: float) -> int:
    """Word edits at which an item of ``n`` words still counts as found."""
    return int((1 - similarity) * n + 1e-9)


def embed(words: np.ndarray, start: np.ndarray, length: np.ndarray, reps: int) -> np.ndarray:
    """CGK walks of the windows at ``start``: symbols as (step, window, rep).

    Each step emits the word at the pointer and moves on by a bit that depends
    on the repetition, the step and the word; past the window's end (or the
    text's) a walk emits PAD.  A walk has 3 * length steps; the last third,
    mostly PAD, is never sampled and so not walked.
    """
    longest = int(length.max())
    steps = 2 * longest
    place = np.arange(longest + steps)[None, :]
    at = start[:, None] + place
    inside = (place < length[:, None]) & (at < len(words))
    grid = np.where(inside, words[np.minimum(at, len(words) - 1)], PAD).reshape(-1)
    at = np.repeat((np.arange(len(start)) * place.shape[1])[:, None], reps, axis=1)
    out = np.empty((steps, len(start), reps), dtype=U)
    seeds = _mix(np.arange(1, reps + 1, dtype=U) * U(0xD1342543DE82EF95))[None, :]
    odd = _mix(np.arange(1, steps + 1, dtype=U)) | U(1)
    for j in range(steps):
        np.take(grid, at, out=out[j])
        at += (((out[j] ^ seeds) * odd[j]) >> U(63)).view(np.int64)
    return out


def sample_keys(out: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """Keys (window, rep): a hash of the length and ``bits`` sampled positions."""
    reps = out.shape[2]
    rng = np.random.default_rng(20240117)                 # the same positions everywhere
    where = rng.random((reps, bits))
    key = _mix(np.arange(1, reps + 1, dtype=U)[None, :] ^ (length.astype(U) << U(32))[:, None])
    w, r = np.arange(len(length))[:, None], np.arange(reps)[None, :]
    for b in range(bits):
        # positions in the part of the walk that most windows spend inside
        pos = (where[:, b][None, :] * 2 * length[:, None]).astype(np.int64)
        key = _mix(key * U(31) + out[pos, w, r])
    return key


def passage_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of ``item`` to a passage of ``text``, the passage's end)."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - steps) + steps    # insertions along the text
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Searchable form of a bounded block of items: (item_id, words) pairs."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float = 0.8,
                 reps: int = 20, bits: int = 3, min_words: int = 5):
        self.reps, self.bits, self.similarity = reps, bits, similarity
        self.items = [(i, w.astype(U)) for i, w in items if len(w) >= min_words]
        self.lengths = sorted({len(w) for _, w in self.items})
        if not self.items:
            return
        n = np.array([len(w) for _, w in self.items])
        words = np.concatenate([w for _, w in self.items])
        start = np.cumsum(n) - n
        keys = np.concatenate([sample_keys(embed(words, start[i:i + WINDOWS], n[i:i + WINDOWS], reps),
                                           n[i:i + WINDOWS], bits) for i in range(0, len(n), WINDOWS)])
        order = np.argsort(keys.reshape(-1), kind="stable")
        self.keys, self.key_item = keys.reshape(-1)[order], order // reps
        counted = [np.unique(bigrams(w), return_counts=True) for _, w in self.items]
        self.grams = [pair for pair, _ in counted]
        # word pairs by length, and how often one of its items holds each at most
        of_length: dict[int, list] = {}
        for (_, w), pairs in zip(self.items, counted):
            of_length.setdefault(len(w), []).append(pairs)
        self.pairs = {k: _most_of(of_length[k]) for k in self.lengths}
        table, most = (np.concatenate(of) for of in zip(*self.pairs.values()))
        self.every, pair = np.unique(table, return_inverse=True)
        order = np.argsort(pair, kind="stable")
        self.pair_first = np.searchsorted(pair[order], np.arange(len(self.every) + 1))
        self.pair_length = np.repeat(np.arange(len(self.lengths)), [len(t) for t, _ in self.pairs.values()])[order]
        self.pair_most = most[order]
        self.bitmap = np.zeros(1 << 22, dtype=bool)         # may say yes too often, never no
        self.bitmap[(self.every >> U(42)).astype(np.int64)] = True
        # pairs of words that a passage within the allowed edits must share with the item
        self.need = {k: max(1, k - 1 - 2 * allowed_edits(k, similarity)) for k in self.lengths}
        self.reach = {k: k + allowed_edits(k, similarity) for k in self.lengths}
        # pieces by their number of words: sorted hashes, the items and the pieces' places in them
        cuts: dict[int, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(self.items):
            parts = min(len(w), allowed_edits(len(w), similarity) + 1)
            cut = [len(w) * j // parts for j in range(parts + 1)]
            for lo, hi in zip(cut, cut[1:]):
                cuts.setdefault(hi - lo, []).append((k, lo))
        self.pieces = {}
        for size, of in sorted(cuts.items()):
            item, place = np.array(of).T
            key = _grams(words, size)[start[item] + place]
            by = np.argsort(key, kind="stable")
            may = np.zeros(1 << 22, dtype=bool)
            may[(key >> U(42)).astype(np.int64)] = True
            self.pieces[size] = may, key[by], item[by], place[by]

    def search(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Matches by document number: (item_id, edits, start), one per item found."""
        if not self.items or not len(words):
            return {}
        shared = np.append(self.bitmap[(bigrams(words) >> U(42)).astype(np.int64)], False)
        shared[offsets[1:-1][offsets[1:-1] > 0] - 1] = False           # pairs across documents
        upto = np.concatenate([[0], np.cumsum(shared, dtype=np.int32)])
        upto = np.concatenate([upto, np.full(self.reach[self.lengths[-1]], upto[-1])])
        lengths: dict[int, list[int]] = {}                             # by document, those that may be found
        for n in self.lengths:
            span = self.reach[n] - 1                                   # pairs in the longest passage
            rich = np.flatnonzero(upto[span:span + len(words)] - upto[:len(words)] >= self.need[n])
            for d in np.unique(np.searchsorted(offsets, rich, side="right") - 1):
                lengths.setdefault(int(d), []).append(n)
        pieces = self.piece_hits(words, offsets)
        found = {d: self.search_one(words[offsets[d]:offsets[d + 1]], lengths.get(d, []), pieces.get(d, []))
                 for d in sorted({*lengths, *pieces})}
        return {d: hits for d, hits in found.items() if hits}

    def piece_hits(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By document number, (item, place at which it would start) of every piece met."""
        hits: dict[int, set[tuple[int, int]]] = {}
        for size, (may, key, item, place) in self.pieces.items():
            if len(words) < size:
                continue
            grams = _grams(words, size)
            at = np.flatnonzero(may[(grams >> U(42)).astype(np.int64)])
            lo, hi = (np.searchsorted(key, grams[at], side) for side in ("left", "right"))
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(offsets, at, side="right") - 1
            for p, d, a, b in zip(at.tolist(), doc.tolist(), lo.tolist(), hi.tolist()):
                if p + size <= offsets[d + 1]:
                    hits.setdefault(d, set()).update(
                        zip(item[a:b].tolist(), (p - int(offsets[d]) - place[a:b]).tolist()))
        return {d: sorted(of) for d, of in hits.items()}

    def search_one(self, words: np.ndarray, lengths: list[int], pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        if len(words) < 2:
            return []
        best = self.sampled(words, lengths)
        pairs, tried = bigrams(words), {}
        for k, start in pieces:
            item_id, item = self.items[k]
            if item_id in best and best[item_id][0] == 0:
                continue
            most = allowed_edits(len(item), self.similarity)
            lo, hi = max(0, start - most), max(0, start + len(item) + most - 1)
            if np.isin(pairs[lo:hi], self.grams[k]).sum() >= len(item) - 1 - 2 * most:
                self.verify(words, k, start, best, tried)
        return [(i, e, p) for i, (e, p) in sorted(best.items(), key=lambda hit: (hit[0] is None, hit[0] or 0))]

    def near_lengths(self, pairs: np.ndarray, lengths: list[int]) -> list[int]:
        """Those of ``lengths`` with enough of their items' pairs in the text, repeats as in ``most_shared``."""
        if not lengths:
            return []
        at = np.minimum(np.searchsorted(self.every, pairs), len(self.every) - 1)
        pair, times = np.unique(at[self.every[at] == pairs], return_counts=True)
        first, size = self.pair_first[pair], self.pair_first[pair + 1] - self.pair_first[pair]
        entry = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        shared = np.bincount(self.pair_length[entry], np.minimum(np.repeat(times, size), self.pair_most[entry]),
                             len(self.lengths))
        rich = {n for n, s in zip(self.lengths, shared) if s >= self.need[n]}
        return [n for n in lengths if n in rich]

    def sampled(self, words: np.ndarray, lengths: list[int]) -> dict[int, tuple[int, int]]:
        """(edits, start) by item_id of what the sampled walks find."""
        pairs, starts, sizes = bigrams(words), [], []
        for n in self.near_lengths(pairs, lengths):
            table, most = self.pairs[n]
            at = np.minimum(np.searchsorted(table, pairs), len(table) - 1)
            shared = table[at] == pairs
            upto = np.concatenate([[0], np.cumsum(shared)])
            last = np.minimum(np.arange(len(words)) + self.reach[n] - 1, len(pairs))
            ok = np.flatnonzero(upto[last] - upto[np.minimum(np.arange(len(words)), len(pairs))] >= self.need[n])
            if len(ok) and most_shared(np.flatnonzero(shared), at[shared], most, self.reach[n] - 1) >= self.need[n]:
                # the passage may begin anywhere in such a stretch
                ok = np.unique(np.minimum(ok[:, None] + np.arange(2 * allowed_edits(n, self.similarity) + 1)[None, :],
                                          len(words) - 1))
                starts.append(ok)
                sizes.append(np.full(len(ok), n))
        if not starts:
            return {}
        start, size, best, tried = np.concatenate(starts), np.concatenate(sizes), {}, {}
        for i in range(0, len(start), WINDOWS):
            s, n = start[i:i + WINDOWS], size[i:i + WINDOWS]
            keys = sample_keys(embed(words, s, n, self.reps), n, self.bits)
            lo = np.searchsorted(self.keys, keys, "left")
            hi = np.searchsorted(self.keys, keys, "right")
            for w, r in zip(*np.nonzero(hi > lo)):
                for k in self.key_item[lo[w, r]:hi[w, r]]:
                    self.verify(words, int(k), int(s[w]), best, tried)
        return best

    def verify(self, words, k, start, best, tried) -> None:
        item_id, item = self.items[k]
        most = allowed_edits(len(item), self.similarity)
        covered = tried.get(k)
        if covered and covered[0] <= start <= covered[1]:
            return
        lo, hi = max(0, start - 2 * most - 2), min(len(words), start + len(item) + 2 * most + 2)
        edits, end = passage_edits(item, words[lo:hi])
        tried[k] = (start - most, start + most)
        if edits <= most and (item_id not in best or edits < best[item_id][0]):
            best[item_id] = (edits, max(0, lo + end - len(item)))


def _most_of(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of several (pairs, times), sorted, and the most times of each."""
    pair, times = (np.concatenate(of) for of in zip(*counted))
    order = np.lexsort((-times, pair))
    table, first = np.unique(pair[order], return_index=True)
    return table, times[order][first]


def most_shared(place: np.ndarray, pair: np.ndarray, most: np.ndarray, span: int) -> int:
    """The most pairs in ``span`` places on end, a pair counted up to most[pair] times.

    A passage shares a pair with an item only as often as the item holds it, so
    a few words repeated over and over share no more than one round of them.
    """
    order = np.argsort(pair, kind="stable")
    place, pair = place[order], pair[order]
    before = np.arange(len(pair)) - most[pair]
    at = np.maximum(before, 0)
    last = np.where((before >= 0) & (pair[at] == pair), place[at], -1)
    # counted by the stretches that begin after the place most[pair] times before
    begin = np.bincount(np.maximum(np.maximum(last, place - span) + 1, 0), minlength=int(place.max()) + 2)
    return int(np.cumsum(begin - np.bincount(place + 1, minlength=len(begin))).max())


def bigrams(words: np.ndarray) -> np.ndarray:
    return _grams(words, 2)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    key = words
    for j in range(1, size):
        key = _mix(key[:-1] * U(31) + words[j:])
    return key


def item_blocks(benchmark: DataFrame, block_items: int, id_col: str, text_col: str) -> Iterator[list]:
    """Items as (item_id, words), ``block_items`` at a time: the query set."""
    words = (benchmark.select(F.col(f"`{id_col}`").try_cast("bigint").alias("i"), F.col(f"`{text_col}`").alias("text"))
             .where("text is not null").select("i", _words().alias("words")))
    block: list = []
    for row in words.toLocalIterator():
        block.append((row["i"], np.array(row["words"], dtype=np.int64).view(U)))
        if len(block) == block_items:
            yield block
            block = []
    if block:
        yield block


def matcher(spark, block: list, **params):
    """Column function: word hashes -> matches of one block of items."""
    shared = spark.sparkContext.broadcast(Index(block, **params))        # bounded by the block

    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for col in batches:
            arrays = [np.zeros(0, U) if a is None else np.asarray(a, dtype=np.int64).view(U) for a in col]
            out: list = [[] for _ in arrays]
            lo = 0
            sizes = np.cumsum([len(a) for a in arrays]) if arrays else np.zeros(0)
            while lo < len(arrays):
                base = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, base + CHUNK, side="right")))
                part = arrays[lo:hi]
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in part])]).astype(np.int64)
                for d, hits in index.search(np.concatenate(part), offsets).items():
                    out[lo + d] = [{"item_id": i, "edits": e, "start": p} for i, e, p in hits]
                lo = hi
            yield pd.Series(out)

    return F.pandas_udf(match, MATCHES).asNondeterministic()


def matches(docs: DataFrame, benchmark: DataFrame, block_items: int = 20_000, text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", **params) -> Column:
    """Column of the items found in each row of ``docs``: item_id, edits, start (word).

    An item is found if some passage of the text is within (1 - similarity)
    times the item's words of word edits; words are lower-cased runs of
    letters and digits.  ``params``: similarity (0.8), reps and bits of the
    search, min_words (5: shorter items name no document and match nothing).
    Windows that share too few word pairs with all items of their length cannot
    be that near (q-gram bound) and are not embedded, nor are a text's windows of
    a length if all share too few once a pair counts no more often than in an
    item of that length; with the pieces every passage
    within the allowed edits is found, at any item length.  The items are taken in
    blocks of ``block_items``, each one broadcast; every row meets every block
    and no row is shuffled.  Null or empty texts and items match nothing;
    repeated items are each found.  Ids are taken as whole numbers; items whose
    id is null or none are found too, together as the item null.
    """
    words = F.coalesce(_words(f"`{text_col}`"), F.array().cast("array<bigint>"))
    found = [matcher(docs.sparkSession, block, **params)(words)
             for block in item_blocks(benchmark, block_items, item_col, item_text_col)]
    return F.concat(*found) if found else F.array().cast(MATCHES)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, start."""
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), matches(docs, benchmark, **params).alias("m"))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    return docs.where(F.size(matches(docs, benchmark, **params)) == 0)
