"""Phrase collocations: which words of a language go together.

Every shard of the texts becomes a weighted acyclic automaton of its n-grams
with their counts, built from the sorted n-grams with equal states shared.  The
shards' automata are cut by prefix range; those of one range are united and
their weights added.  The parts of a phrase are looked up by running them
through the united automaton of the range they start in.

A word is a symbol of 64 bits, a hash of language and word that is checked to
be distinct for all words; so an n-gram is a row of numbers, and no vocabulary
is held by any task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_TOKENS = 1_000_000    # words of a shard: what a task holds at a time
RANGE_GRAMS = 2_500_000     # n-gram occurrences a prefix range should have
MERGE_ARCS = 1_000_000      # arcs a range gathers before it adds them up
CUT = 1024                  # parts into which a task cuts what it has at a time
HELD_WORDS = 200_000        # distinct words a task counts before it hands them on
UNKNOWN = "und"

END = b"\xff"               # ends a piece; no UTF-8 text has this byte
STOPS = b".,;:!?\x0A\x0B\x0C\x0D"
LOWER = bytes.maketrans(STOPS + bytes(range(65, 91)), b"\n" * len(STOPS) + bytes(range(97, 123)))

BLOB = "part long, automaton binary"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with END after every piece; A-Z in lower case."""
    raw = text.encode() if text else b""
    return (raw.translate(LOWER) + b"\n").replace(b"\n", b" " + END + b" ").split()


def language(lang: str | None) -> bytes:
    return (UNKNOWN if lang is None else lang).encode()


def symbol(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, seed)) or 1


class Symbols(dict):
    """Symbols of the words of a language met so far; END is 0."""

    def __init__(self, lang: bytes, seed: int):
        super().__init__({END: 0})
        self.lang, self.seed = lang, seed

    def __missing__(self, word: bytes) -> int:
        s = self[word] = symbol(self.lang, word, self.seed)
        return s


# ---- words -----------------------------------------------------------------

def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, word, n)."""
    counts: dict[bytes, Counter] = {}
    held = 0

    def told():
        for lang, words in counts.items():
            words.pop(END, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.decode()] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()),
                 pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words = counts.setdefault(language(lang), Counter())
            before = len(words)
            words.update(words_of(text.as_py()))
            held += len(words) - before
            if held > HELD_WORDS:
                yield from told()
                counts, held = {}, 0
    yield from told()


def word_symbols(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, n, s) of all words, written, and the seed of the symbols,
    which is drawn again until no two words share one."""
    words = materialize(rows.mapInArrow(count_words, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for seed in range(16):
        def mark(batches, seed=seed):
            for b in batches:
                s = [symbol(lang.encode(), w.encode(), seed)
                     for lang, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(s, np.uint64).view(np.int64))],
                                                 names=["lang", "word", "n", "s"])
        marked = materialize(words.mapInArrow(mark, "lang string, word string, n long, s long"), "symbols")
        if marked.groupBy("s").count().where("count > 1").isEmpty():
            return marked, seed
    raise RuntimeError("no seed gives every word a symbol of its own")


# ---- automata --------------------------------------------------------------

class Grams(NamedTuple):
    """N-grams of at most three symbols: rows of places in ``labels``, which are
    sorted and begin with 0, the symbol for none; and their counts."""

    labels: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    @classmethod
    def none(cls) -> Grams:
        return cls(np.zeros(1, np.uint64), np.zeros((0, 3), np.int32), np.zeros(0, np.int64))

    def part(self, at) -> Grams:
        """Some of the n-grams, with the labels they use."""
        rows = self.rows[at]
        used = np.zeros(len(self.labels), bool)
        used[0] = True
        used[rows.reshape(-1)] = True
        return Grams(self.labels[used], (np.cumsum(used, dtype=np.int32) - 1)[rows], self.counts[at])

    @property
    def keys(self) -> np.ndarray:
        return self.labels[self.rows]


def add_up(parts: list[Grams]) -> Grams:
    """The union of several sets, sorted, with the sums of equal n-grams' counts."""
    labels = np.unique(np.concatenate([p.labels for p in parts]))
    rows = np.concatenate([np.searchsorted(labels, p.labels).astype(np.int32)[p.rows] for p in parts])
    counts = np.concatenate([p.counts for p in parts])
    if not len(rows):
        return Grams.none()
    if len(labels) <= 1 << 21:                       # three places fit 63 bits
        wide = rows.astype(np.uint64)
        order = np.argsort((wide[:, 0] << np.uint64(42)) | (wide[:, 1] << np.uint64(21)) | wide[:, 2])
    else:
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    return Grams(labels, rows[new], np.add.reduceat(counts[order], np.flatnonzero(new)))


class Automaton:
    """Weighted acyclic automaton of n-grams of at most three symbols.

    ``labels`` are the symbols used, sorted.  The first level has one state,
    whose arcs are sorted by label; arcs lead to states of the second level and
    theirs to states of the third.  An arc has a label, a weight (the count of
    the n-gram that ends with it; 0 for none) and a target (-1 for none).
    Equal states are one state.
    """

    def __init__(self, labels: np.ndarray, levels: list[tuple]):
        self.labels, self.levels = labels, levels    # a level: starts of its states, label, weight, target of the arcs

    @classmethod
    def build(cls, grams: Grams) -> Automaton:
        """From sorted distinct n-grams."""
        labels, at, weights = grams
        n = len(at)
        first = np.arange(n) == 0
        new = [first]                                # whether a row begins a prefix of k symbols; sorted, so equal ones are neighbours
        for k in range(3):
            differs = first.copy()
            differs[1:] = at[1:, k] != at[:-1, k]
            new.append(new[-1] | differs)
        levels, target = [], None
        for k in (2, 1, 0):                          # the last level first: a state is complete when its arcs' targets are
            arc = new[k + 1] & (at[:, k] > 0)        # the first row of every arc of this level
            rows = np.flatnonzero(arc)
            ends = (at[rows, k + 1:] == 0).all(axis=1) if k < 2 else np.ones(len(rows), bool)
            weight = np.where(ends, weights[rows], 0)
            leads = np.full(len(rows), -1, np.int64) if target is None else target[rows]
            # the state an arc belongs to begins with the prefix before it
            state_of = np.cumsum(new[k])[rows] - 1 if k else np.zeros(len(rows), np.int64)
            states, first = np.unique(state_of, return_index=True)
            starts = np.append(first, len(rows)).astype(np.int64)
            label = at[rows, k]
            starts, label, weight, leads, same = _share(starts, label, weight, leads)
            levels.append((starts, label, weight, leads))
            if k:
                # for each row, the state below its prefix of k symbols
                below = np.full(int(new[k].sum()), -1, np.int64)
                below[states] = same
                target = below[np.cumsum(new[k]) - 1]
        return cls(labels, levels[::-1])

    def grams(self) -> Grams:
        """Its n-grams, without those that weigh nothing; not sorted."""
        rows, weights = [], []
        state = np.zeros(min(1, len(self.levels[0][0]) - 1), np.int64)
        prefix = np.zeros((len(state), 0), np.int32)
        for k, (starts, label, weight, leads) in enumerate(self.levels):
            size = starts[state + 1] - starts[state]
            arcs = np.arange(size.sum()) + np.repeat(starts[state] - np.cumsum(size) + size, size)
            prefix = np.concatenate([np.repeat(prefix, size, axis=0), label[arcs][:, None].astype(np.int32)], axis=1)
            own = weight[arcs] != 0
            rows.append(np.pad(prefix[own], ((0, 0), (0, 2 - k))))
            weights.append(weight[arcs][own])
            on = leads[arcs] >= 0
            state, prefix = leads[arcs][on], prefix[on]
        return Grams(self.labels, np.concatenate(rows), np.concatenate(weights))

    def weigh(self, keys: np.ndarray) -> np.ndarray:
        """Composition with a list of n-grams: their weights, 0 where there is none."""
        state, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.levels[0][0]) < 2:
            return found
        rank = np.minimum(np.searchsorted(self.labels, keys), len(self.labels) - 1)
        rank = np.where(self.labels[rank] == keys, rank, -1)
        for k, (starts, label, weight, leads) in enumerate(self.levels):
            reads = (state >= 0) & (keys[:, k] != 0)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            arcs = owner * len(self.labels) + label             # sorted: states in order, arcs by label
            want = state * len(self.labels) + rank[:, k]
            at = np.minimum(np.searchsorted(arcs, want), max(len(arcs) - 1, 0))
            hit = reads & (rank[:, k] >= 0) & (arcs[at] == want if len(arcs) else False)
            found = np.where(reads, np.where(hit, weight[at] if len(arcs) else 0, 0), found)
            state = np.where(hit, leads[at] if len(arcs) else -1, -1)
        return found

    def to_bytes(self) -> bytes:
        out, head = [self.labels], [(len(self.labels), 8, 0)]
        for x in (x for level in self.levels for x in level):
            shift = -int(x.min(initial=0))           # stored from 0 on, in as few bytes as the largest needs
            out.append((x + shift).astype(np.min_scalar_type(int(x.max(initial=0)) + shift)))
            head.append((len(x), out[-1].itemsize, shift))
        return np.array(head, np.int64).tobytes() + b"".join(x.tobytes() for x in out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Automaton:
        head = np.frombuffer(raw, np.int64, 39).reshape(13, 3)
        at, out = 39 * 8, []
        for n, size, shift in head.tolist():
            x = np.frombuffer(raw, f"u{size}", n, at)
            out.append(x if not out else x.astype(np.int64) - shift)
            at += n * size
        return cls(out[0], [tuple(out[i:i + 4]) for i in (1, 5, 9)])


def _share(starts, label, weight, leads):
    """One state for each set of equal ones.  Returns the arcs of the states
    kept and, for every state given, its new number."""
    n = len(starts) - 1
    if n < 1:
        return starts[:1] * 0, label, weight, leads, np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + leads.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        sums = np.add.reduceat(h, starts[:-1])
    size = np.diff(starts)
    _, first, group = np.unique(sums, return_index=True, return_inverse=True)
    like = first[group]                                         # the first state that looks the same; compared below
    other = np.minimum(np.arange(len(label)) - np.repeat(starts[:-1] - starts[like], size), len(label) - 1)
    equal = (label == label[other]) & (weight == weight[other]) & (leads == leads[other])
    equal = np.logical_and.reduceat(equal, starts[:-1]) & (size == size[like])
    like = np.where(equal, like, np.arange(n))
    kept = np.unique(like)
    number = np.searchsorted(kept, like)
    size = size[kept]
    at = np.arange(size.sum()) + np.repeat(starts[kept] - np.cumsum(size) + size, size)
    return np.append(0, np.cumsum(size)).astype(np.int64), label[at], weight[at], leads[at], number


# ---- shards ----------------------------------------------------------------

class Ranges:
    """Prefix ranges of n-grams: equal ranges of the first symbol; those of a
    word with more than a range's share are dealt over ranges of their own by
    their second and third symbol."""

    def __init__(self, count: int, hot: np.ndarray, parts: np.ndarray):
        by = np.argsort(hot)
        self.count, self.hot, self.parts = count, hot[by], parts[by]
        self.first = count + np.cumsum(self.parts) - self.parts
        self.total = count + int(self.parts.sum())

    def of(self, grams: Grams) -> np.ndarray:
        part = (((grams.labels >> np.uint64(32)) * np.uint64(self.count)) >> np.uint64(32)).astype(np.int64)[grams.rows[:, 0]]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, grams.labels), len(self.hot) - 1)
            at = np.where(self.hot[at] == grams.labels, at, -1)[grams.rows[:, 0]]
            many = np.flatnonzero(at >= 0)
            at, keys = at[many], grams.labels[grams.rows[many, 1:]]
            with np.errstate(over="ignore"):
                rest = (keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)
            part[many] = self.first[at] + ((rest * self.parts[at].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        return part


def cut_up(grams: Grams, ranges: Ranges, step: int) -> Iterator[pa.RecordBatch]:
    """Sorted n-grams as one automaton for each ``step`` ranges they fall into."""
    part = ranges.of(grams) // step
    order = np.argsort(part, kind="stable")          # stays sorted by n-gram within a part
    part = part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
        yield blob(int(part[lo]), grams.part(order[lo:hi]))


def blob(part: int, grams: Grams) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([Automaton.build(grams).to_bytes()], pa.binary())],
                                      names=["part", "automaton"])


def shard_grams(tokens: np.ndarray) -> Grams:
    """The n-grams of two and three words of a shard, sorted, from its symbols
    in order; 0 ends a piece."""
    labels, at = np.unique(np.append(tokens, np.uint64(0)), return_inverse=True)
    at = at.astype(np.uint64)                        # places among a shard's labels: under 21 bits each
    two = (at[1:] > 0) & (at[:-1] > 0)
    three = two[1:] & two[:-1]
    pairs = (at[:-1][two] << np.uint64(42)) | (at[1:][two] << np.uint64(21))
    triples = (at[:-2][three] << np.uint64(42)) | (at[1:-1][three] << np.uint64(21)) | at[2:][three]
    code, n = np.unique(np.concatenate([pairs, triples]), return_counts=True)
    rows = np.empty((len(code), 3), np.int32)
    for k, shift in enumerate((42, 21, 0)):
        rows[:, k] = (code >> np.uint64(shift)) & np.uint64((1 << 21) - 1)
    return Grams(labels, rows, n)


def shard_counter(seed: int, ranges: Ranges, step: int):
    """The task that turns (lang, text) into the automata of its shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Symbols] = {}
        tokens, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if sum(map(len, known.values())) > HELD_WORDS:
                    known = {}
                lang = language(lang)
                cache = known.setdefault(lang, Symbols(lang, seed))
                words = words_of(text.as_py())
                symbols = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                for lo in range(0, len(symbols), SHARD_TOKENS):
                    tokens.append(symbols[lo:lo + SHARD_TOKENS])
                    size += len(tokens[-1])
                    if size < SHARD_TOKENS:
                        continue
                    whole = np.concatenate(tokens)
                    yield from cut_up(shard_grams(whole), ranges, step)
                    tokens, size = [], 0
                    if lo + SHARD_TOKENS < len(symbols):
                        # a text goes on in the next shard: its last two words are met there again,
                        # and their own pair, which both shards have, is taken back
                        tokens, size = [whole[-2:]], 2
                        if whole[-2:].all():
                            pair = shard_grams(whole[-2:])
                            yield from cut_up(pair._replace(counts=-pair.counts), ranges, step)
        if size:
            yield from cut_up(shard_grams(np.concatenate(tokens)), ranges, step)
    return run


def sums(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[Grams]:
    """The united n-grams of all automata of a group, MERGE_ARCS new arcs at a
    time beside the sum; if not ``whole``, each sum is handed on at once."""
    held, size = [Grams.none()], 0
    for batch in batches:
        for raw in batch.column("automaton"):
            held.append(Automaton.from_bytes(raw.as_py()).grams())
            size += len(held[-1].counts)
            if size >= MERGE_ARCS:
                held, size = [add_up(held)], 0
                if not whole:
                    yield held[0]
                    held = [Grams.none()]
    yield add_up(held)


def cut_finer(ranges: Ranges, step: int):
    """The task that cuts the automata of several ranges anew."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in sums(batches, whole=False):
            yield from cut_up(grams, ranges, step)
    return run


def unite(least: int):
    """The task that unites the automata of one range and keeps what weighs at
    least ``least``."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in sums(batches, whole=True):
            yield blob(key[0].as_py(), grams.part(grams.counts >= least))
    return run


def united_automata(rows: DataFrame, seed: int, ranges: Ranges, grams: int, least: int) -> DataFrame:
    """(part, automaton): one automaton for each prefix range of the n-grams of
    (lang, text).

    A task cuts a shard into at most CUT parts, of several ranges each where
    there are more; these are dealt out by part and lot and cut again, until a
    part is one range.  So the number of automata grows with the text alone.
    """
    step = 1
    while ranges.total > step * CUT:
        step *= CUT
    shards = rows.mapInArrow(shard_counter(seed, ranges, step), BLOB)
    while step > 1:
        lots = max(1, grams // (-(-ranges.total // step) * MERGE_ARCS))
        step //= CUT
        shards = (shards.withColumn("lot", F.pmod(F.xxhash64("automaton"), F.lit(lots))).groupBy("part", "lot")
                  .applyInArrow(cut_finer(ranges, step), BLOB))
    return materialize(shards.groupBy("part").applyInArrow(unite(least), BLOB), "automata")


def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of united automata as (s1, s2, s3, a); s3 is 0 for two words."""
    for batch in batches:
        for raw in batch.column("automaton"):
            grams = Automaton.from_bytes(raw.as_py()).grams()
            yield pa.RecordBatch.from_arrays([pa.array(grams.labels[grams.rows[:, k]].view(np.int64)) for k in range(3)]
                                             + [pa.array(grams.counts)], names=["s1", "s2", "s3", "a"])


def look_up(parts: DataFrame, automata: DataFrame, ranges: Ranges) -> DataFrame:
    """(s1, s2, f) of the distinct pairs ``parts``: each goes to the range it
    starts in and runs through that range's automaton."""
    def pairs(table) -> np.ndarray:
        two = [table.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")]
        return np.stack([*two, np.zeros(table.num_rows, np.uint64)], axis=1)

    def place(batches):
        for b in batches:
            keys = pairs(b)
            labels, rows = np.unique(np.append(keys.reshape(-1), np.uint64(0)), return_inverse=True)
            grams = Grams(labels, rows[:-1].reshape(keys.shape), np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges.of(grams))], names=["s1", "s2", "part"])

    def compose(asked: pa.Table, held: pa.Table) -> pa.Table:
        f = np.zeros(asked.num_rows, np.int64)
        for raw in held.column("automaton"):
            f += Automaton.from_bytes(raw.as_py()).weigh(pairs(asked))
        return pa.table({"s1": asked.column("s1"), "s2": asked.column("s2"), "f": pa.array(f)})
    asked = parts.select("s1", "s2").distinct().mapInArrow(place, "s1 long, s2 long, part long")
    return asked.groupBy("part").cogroup(automata.groupBy("part")).applyInArrow(compose, "s1 long, s2 long, f long")


# ---- collocations ----------------------------------------------------------

def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000, swallow: float = 0.5,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of two or three words of every language.

    Texts are put in lower case (A-Z) and cut into pieces at ``.,;:!?`` and line
    ends, pieces into words at spaces and tabs.  A phrase counts every place
    within a piece, overlaps included; those of at least ``min_count`` are
    candidates.  A cut of a candidate into two parts with counts l and r scores
    floor(10^6 a^2 / (l r)), in exact decimals; the lowest cut counts, ties to
    the shortest first part.  A candidate inside a longer one that has at least
    ``swallow`` (a percentage is exact) of its count is dropped.

    Null languages are ``und``; null and empty texts have no words; repeated
    rows count again; other columns are ignored; no rows for an empty table.

    All parts of a candidate are at least as frequent as it is, so the united
    automata keep only what reaches ``min_count``.  A range's n-grams are added
    up in one task; ranges grow in number with the text, and a word too
    frequent for one has several.

    Returns lang, rank, phrase, a, l, r, n (words of the language), score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words, seed = word_symbols(rows)
    totals = words.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-2 * total // RANGE_GRAMS))
    # words with more n-grams than a range should have: at most 2 * total / RANGE_GRAMS, as many as ranges
    hot = words.where(2 * F.col("n") > RANGE_GRAMS).select("s", "n").toArrow()
    share = -(-2 * hot.column("n").to_numpy() // RANGE_GRAMS)
    ranges = Ranges(count, hot.column("s").to_numpy().view(np.uint64), share.astype(np.int64))

    automata = united_automata(rows, seed, ranges, 2 * total, min_count)
    found = materialize(automata.mapInArrow(phrases_of, "s1 long, s2 long, s3 long, a long"), "phrases")
    threes, twos = found.where("s3 <> 0"), found.where("s3 = 0").drop("s3")
    ends = F.explode(F.array(F.struct(F.col("s1").alias("s1"), F.col("s2").alias("s2")),
                             F.struct(F.col("s2").alias("s1"), F.col("s3").alias("s2")))).alias("t")
    inner = threes.select("a", ends).select("t.s1", "t.s2", "a")
    pairs = materialize(look_up(inner, automata, ranges), "parts")
    long = inner.groupBy("s1", "s2").agg(F.max("a").alias("longer"))
    twos = twos.join(long, ["s1", "s2"], "left").where(
        F.coalesce(100 * F.col("longer") < F.lit(round(100 * swallow)) * F.col("a"), F.lit(True)))

    names = words.select("s", "lang", "word", "n")
    one, two, three = (names.select(F.col("s").alias(f"s{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"),
                                    *([F.col("lang")] if k == 1 else [])) for k in (1, 2, 3))
    head = pairs.select("s1", "s2", F.col("f").alias("f12"))
    tail = pairs.select(F.col("s1").alias("s2"), F.col("s2").alias("s3"), F.col("f").alias("f23"))

    def cut(left: str, right: str, words: int):
        return F.struct(F.expr(f"(1000000bd * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div "
                               f"(cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))").alias("score"),
                        F.lit(words).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    low2 = twos.join(one, "s1").join(two, "s2").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut("n1", "n2", 1).alias("cut"))
    low3 = (threes.join(head, ["s1", "s2"]).join(tail, ["s2", "s3"]).join(one, "s1").join(two.drop("n2"), "s2").join(three, "s3")
            .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                    F.least(cut("n1", "f23", 1), cut("f12", "n3", 2)).alias("cut")))
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = low2.unionByName(low3).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("total").alias("n"), F.col("cut.score").alias("score"))
