"""Language-model scores: prediction by partial matching over bytes.

A trie of byte contexts (orders 3 to 0) is counted over all training texts.
A symbol's probability in a context is c / (n + q), with q distinct symbols; the
escape q / (n + q) leads to the next shorter context, in which symbols already
seen are excluded, and at last to equal shares.  No context and no symbol is
left out: the trie is a table that grows with the training texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ORDER = 3
START, END = 0xFE, 0xFF     # bytes that no UTF-8 text has
HELD = 2 ** 15              # the most frequent order-3 contexts are looked up in the task, the others joined
FREQUENT = 2 ** 18          # words with at least 1/FREQUENT of all tokens are looked up in the task
LONGEST = 64                # bytes of a word that may be among those
HELD_WORDS = 200_000        # distinct words, or grams, a task counts before it hands them on
HELD_BYTES = 2 ** 19        # bytes of texts taken at a time (one text at least)
BLOCK = 2 ** 18             # bytes of those whose grams are held at a time
END_KEY = b"  "             # counts texts; words hold no space
GRAM_MARK = b" "


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 10; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def byte_grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(4-byte codes of every symbol with its three predecessors, owner), block by
    block: START pads a text's beginning and END closes it."""
    pad, stop = bytes([START]) * ORDER, bytes([END])
    joined = np.frombuffer(b"".join(x for t in texts for x in (pad, t, stop)), dtype=np.uint8)
    begun = ORDER                                               # START bytes so far: three for each text
    for lo in range(ORDER, len(joined), BLOCK):
        b = joined[lo - ORDER:lo + BLOCK].astype(np.uint32)
        mark = b[3:] == START
        owner = (begun + np.cumsum(mark, dtype=np.int32)) // ORDER - 1
        begun += int(mark.sum())
        code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        yield code[~mark], owner[~mark]


def chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch in UTF-8, as many at a time as HELD_BYTES hold."""
    held, size = [], 0
    for text in texts:
        raw = (text.as_py() or "").encode()
        if held and size + len(raw) > HELD_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


class GramCounter:
    """Counts of 4-byte codes, added up when they get many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, texts: list[bytes]) -> None:
        for code, _ in byte_grams(texts):
            self.parts.append(np.unique(code, return_counts=True))
            self.size += len(self.parts[-1][0])
            if self.size > 4 * HELD_WORDS:
                self.merge()

    def merge(self) -> None:
        code, at = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in self.parts])).astype(np.int64)
        self.parts, self.size = [(code, n)], len(code)

    def told(self) -> pa.RecordBatch:
        """(GRAM_MARK + 4 bytes, n); starts anew."""
        self.merge()
        code, n = self.parts[0]
        keys = np.empty((len(code), 5), np.uint8)
        keys[:, 0], keys[:, 1:] = GRAM_MARK[0], code.astype(">u4").view(np.uint8).reshape(-1, 4)
        ends = np.arange(len(code) + 1, dtype=np.int32) * 5
        key = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(keys)])
        self.__init__()
        return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64())], names=["key", "n"])


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (key, n): words, GRAM_MARK + 4 bytes, and END_KEY."""
    words: Counter = Counter()
    grams = GramCounter()

    def told(counter: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counter.keys()), pa.binary()),
                                           pa.array(list(counter.values()), pa.int64())], names=["key", "n"])
    for batch in batches:
        for texts in chunks(batch.column("text")):
            for raw in texts:
                words.update(raw.lower().split())
            words[END_KEY] += len(texts)
            grams.add(texts)
            if grams.size > 2 * HELD_WORDS:
                grams.merge()
                if grams.size > HELD_WORDS:
                    yield grams.told()
            if len(words) > HELD_WORDS:
                yield told(words)
                words = Counter()
    if grams.parts:
        yield grams.told()
    if words:
        yield told(words)


class Trie:
    """Log10 probabilities of all 256 symbols in the order-3 contexts held, and
    the counts of all shorter contexts."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts``: for each order 0..ORDER codes (context and symbol; sorted)
        and counts.  Orders below ORDER must be whole."""
        self.low = counts[:ORDER]
        code, n = counts[ORDER]
        self.contexts, row = np.unique(code >> np.uint32(8), return_inverse=True)
        logs = [np.zeros((0, 256), np.float32)]
        for lo in range(0, len(self.contexts), 4096):
            part = self.contexts[lo:lo + 4096]
            at = slice(*np.searchsorted(row, [lo, lo + len(part)]))
            table = np.zeros((len(part), 256))
            table[row[at] - lo, code[at] & np.uint32(255)] = n[at]
            logs.append(self.predict(part, table).astype(np.float32))
        self.logs = np.concatenate(logs)

    def predict(self, contexts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Log10 probabilities (context, symbol); ``table`` has the order-3 counts."""
        p = np.zeros((len(contexts), 256))
        left = np.ones((len(contexts), 1))               # the probability of the escapes so far
        seen = np.zeros((len(contexts), 256), dtype=bool)
        for k in range(ORDER, -1, -1):
            c = np.where(seen, 0.0, table if k == ORDER else self.shorter(contexts, k))
            n, q = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            p += left * c / np.maximum(n + q, 1)
            left = left * np.where(q > 0, q / np.maximum(n + q, 1), 1.0)
            seen |= c > 0
        rest = 256 - seen.sum(axis=1, keepdims=True)
        p += np.where(seen, 0.0, left / np.maximum(rest, 1))
        return np.log10(np.maximum(p, 1e-300))

    def shorter(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """Counts (context, symbol) of the contexts' suffixes."""
        code, n = self.low[order]
        suffix, row = np.unique(contexts & np.uint32((1 << 8 * order) - 1), return_inverse=True)
        lo, hi = (np.searchsorted(code >> np.uint32(8), suffix, side) for side in ("left", "right"))
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        table = np.zeros((len(suffix), 256))
        table[np.repeat(np.arange(len(suffix)), size), code[at] & np.uint32(255)] = n[at]
        return table[row]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sums of the logs in held contexts, and by text and code of the other
        grams: text, code, times)."""
        sums, other, times = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for code, owner in byte_grams(texts):
            context = code >> np.uint32(8)
            row = np.minimum(np.searchsorted(self.contexts, context), max(len(self.contexts) - 1, 0))
            held = self.contexts[row] == context if len(self.contexts) else np.zeros(len(code), bool)
            logs = self.logs[row[held], code[held] & np.uint32(255)]
            sums += np.bincount(owner[held], weights=logs, minlength=len(texts))
            keys, n = np.unique((owner[~held].astype(np.int64) << 32) | code[~held], return_counts=True)
            other.append(keys)
            times.append(n)
        keys, at = np.unique(np.concatenate(other), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(times), minlength=len(keys)).astype(np.int64)
        return sums, keys >> 32, keys & (2 ** 32 - 1), n


def gram_counts(counts: DataFrame) -> DataFrame:
    """All counted grams as (code, n)."""
    grams = (counts.where(F.length("key") == 5).where(F.substring("key", 1, 1) == F.lit(GRAM_MARK))
             .select(F.conv(F.hex(F.substring("key", 2, 4)), 16, 10).cast("long").alias("code"), "n"))
    return materialize(grams, "grams")


def learn_trie(grams: DataFrame) -> Trie:
    """The part of the trie that every task holds: all counts of the orders below
    3 (three bytes, so at most 2^24 rows at any input) and the HELD most frequent
    order-3 contexts with all their symbols.  The other contexts stay in
    ``grams`` and are joined (``gram_logs``)."""
    kept = []
    context = F.shiftright("code", 8)
    for order in range(ORDER + 1):
        if order < ORDER:
            g = grams.groupBy(F.col("code").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("code")).agg(F.sum("n").alias("n"))
        else:
            top = (grams.groupBy(context.alias("context")).agg(F.sum("n").alias("m"))
                   .orderBy(F.col("m").desc(), "context").limit(HELD))
            g = grams.join(F.broadcast(top), context == F.col("context"), "left_semi")
        g = g.toArrow()
        code = g.column("code").to_numpy().astype(np.uint32)
        by = np.argsort(code)
        kept.append((code[by], g.column("n").to_numpy()[by]))
    return Trie(kept)


def gram_logs(wanted: DataFrame, grams: DataFrame, shared) -> DataFrame:
    """(code, log) of the codes ``wanted``: each context meets its counted
    symbols (at most 256) in a join; one never seen backs off."""
    context, symbol = F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(255)
    asked = wanted.select("code").distinct().groupBy(context).agg(F.collect_list(symbol).alias("asked"))
    known = grams.groupBy(context).agg(F.collect_list(symbol).alias("symbols"), F.collect_list("n").alias("counts"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value[0]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                contexts = batch.column("context").to_numpy().astype(np.uint32)

                def flat(name):
                    lists = batch.column(name)
                    size = lists.value_lengths().fill_null(0).to_numpy()
                    return np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False)
                table = np.zeros((len(contexts), 256))
                row, seen = flat("symbols")
                table[row, seen] = flat("counts")[1]
                row, want = flat("asked")
                logs = trie.predict(contexts, table)[row, want]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((contexts[row].astype(np.int64) << 8) | want), pa.array(logs)], names=["code", "log"])
    return asked.join(known, "context", "left").mapInArrow(look, "code long, log double")


def score_documents(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text, learned from all texts of ``train`` (column text).

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (smoothed
    unigram, log10) and score (the byte model's log10 probability of the text
    and its end).  Null texts count as empty: one token, the end.  Repeated
    rows stay; without training texts every count is 0 and every symbol equally
    likely.  Other columns are ignored.

    All words and grams of the training texts are counted and all counts are
    used.  Frequent words and the most frequent contexts (bounded tables) are
    looked up in the task; the others go to joins with all counts, words on the
    word and grams on the context, in which none is frequent.
    """
    spark = docs.sparkSession
    raw = train.select(F.col(f"`{text_col}`").alias("text"))
    counts = materialize(raw.mapInArrow(count_tokens, "key binary, n long")
                         .groupBy("key").agg(F.sum("n").alias("n")), "token-counts")
    is_word = (F.substring("key", 1, 1) != F.lit(GRAM_MARK))
    words = counts.where(is_word)
    n_words, v_words = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = (counts.where(F.col("key") == F.lit(END_KEY)).agg(F.sum("n")).first()[0] or 0)
    total = (n_words or 0) + ends
    distinct = v_words + (1 if ends else 0)
    top = words.where(F.col("n") * FREQUENT >= total).where(F.length("key") <= LONGEST).toArrow()
    frequent = {k: math.log10(n + 0.1) for k, n in zip(top.column("key").to_pylist(), top.column("n").to_pylist())}
    grams = gram_counts(counts)
    shared = spark.sparkContext.broadcast((learn_trie(grams), frequent))         # both bounded
    end_log = math.log10(ends + 0.1)
    norm = math.log10(total + 0.1 * (distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, logs = shared.value
        for batch in batches:
            lo = 0
            for texts in chunks(batch.column("text")):
                sums, sizes, known, rare, rare_n, ends_at = [], [], [], [], [], [0]
                for t in texts:
                    tokens = t.lower().split()
                    s, k = end_log, 1 if ends else 0
                    for w, n in Counter(tokens).items():
                        x = logs.get(w)
                        if x is None:
                            rare.append(w)
                            rare_n.append(n)
                        else:
                            s += n * x
                            k += n
                    sums.append(s)
                    sizes.append(len(tokens) + 1)
                    known.append(k)
                    ends_at.append(len(rare))
                at = pa.array(ends_at, pa.int32())
                score, text, code, times = trie.scores(texts)
                grams_at = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:lo + len(texts)], pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(sums, pa.float64()), pa.array(score),
                     pa.ListArray.from_arrays(at, pa.array(rare, pa.binary())),
                     pa.ListArray.from_arrays(at, pa.array(rare_n, pa.int64())),
                     pa.ListArray.from_arrays(grams_at, pa.array(code, pa.int64())),
                     pa.ListArray.from_arrays(grams_at, pa.array(times, pa.int64()))],
                    names=["doc_id", "n_tokens", "known", "logs", "score", "rare", "rare_n", "grams", "grams_n"])
                lo += len(texts)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = rows.mapInArrow(score, f"doc_id {kind}, n_tokens long, known long, logs double, score double, "
                                   "rare array<binary>, rare_n array<long>, grams array<long>, grams_n array<long>")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("t")).select(
        "row", F.col("t.rare").alias("key"), F.col("t.rare_n").alias("times"))
    other = first.select("row", F.explode(F.arrays_zip("grams", "grams_n")).alias("t")).select(
        "row", F.col("t.grams").alias("code"), F.col("t.grams_n").alias("times"))
    rest = (rare.join(words.withColumnRenamed("n", "c"), "key", "left").select(
        "row", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("also"), F.lit(0.0).alias("rest"))
        .unionByName(other.join(gram_logs(other, grams, shared), "code").select(
            "row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("times") * F.col("log")).alias("rest")))
        .groupBy("row").agg(F.sum("more").alias("more"), F.sum("also").alias("also"), F.sum("rest").alias("rest")))
    return (first.drop("rare", "rare_n", "grams", "grams_n").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score")))
