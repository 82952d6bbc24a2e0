"""Language identification: known words first, then ever shorter n-grams.

A known word adds its log frequency in each language.  An unseen word is
scored by its longest known character n-grams, from ``max_gram`` letters down
to one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
CACHE, CACHE_BYTES = 200_000, 64 << 20     # words, and bytes of their scores, that a task keeps
PIECE = 512                 # n-grams of long words are taken by pieces of this many starts


def train(rows: DataFrame, docs_per_lang: int = 2000, words_per_lang: int = 20_000,
          grams_per_size: int = 5_000, max_gram: int = 4) -> dict:
    """Log frequencies of words and n-grams per language, as a bounded model.

    ``rows`` has doc_id, text and lang; rows with a null in any are left out.
    Learns from about ``docs_per_lang`` documents of each language, picked by a
    hash of doc_id (a share of the language's count, so nothing is sorted), and
    keeps each language's most frequent ``words_per_lang`` words seen twice or
    more and ``grams_per_size`` n-grams of each length, of words of any length.
    These parameters bound what reaches the driver per language; every language
    is learned.

    ``words`` and ``grams[k]`` number the entries; ``logs[k]`` (words: 0) has
    every language's log frequency of an entry that it lacks, then where each
    entry's values start, the languages that have it, and what their log
    frequency is above that of a lacking entry.
    """
    rows = rows.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().collect()            # one row per language
    model = {"langs": sorted(r["lang"] for r in sizes), "words": {}, "grams": {}, "logs": {}, "max_gram": max_gram}
    if not sizes:
        return model
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_lang / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(drawn < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    words = (sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    words = materialize(words, "lang-words")
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(padded), F.lit(PIECE)),
                         lambda i: F.substring(padded, i, F.lit(PIECE + max_gram - 1)))

    def grams(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(PIECE)))
        return F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.substring("piece", i, F.lit(k)).alias("word")))
    every = F.concat(*[grams(k) for k in range(1, max_gram + 1)])
    table = (words.where("n > 1").select("lang", F.lit(0).alias("k"), "word", "n").unionByName(
        words.select("lang", "n", F.explode(pieces).alias("piece")).select("lang", "n", F.explode(every).alias("g"))
        .where(F.length("g.word") == F.col("g.k"))
        .groupBy("lang", F.col("g.k").alias("k"), F.col("g.word").alias("word")).agg(F.sum("n").alias("n"))))
    most = Window.partitionBy("lang", "k").orderBy(F.desc("n"), "word")
    top = (table.withColumn("r", F.row_number().over(most))
           .where(F.col("r") <= F.when(F.col("k") == 0, words_per_lang).otherwise(grams_per_size)).collect())
    at = {lang: i for i, lang in enumerate(model["langs"])}
    for k in range(max_gram + 1):
        counts: dict[str, list] = {}
        total = np.ones(len(at))
        for r in top:
            if r["k"] == k:
                counts.setdefault(r["word"], []).append((at[r["lang"]], r["n"]))
                total[at[r["lang"]]] += r["n"]
        below = total + 0.5 * (len(counts) + 1)
        unseen = np.log(0.5 / below)
        starts = np.cumsum([0, *map(len, counts.values())])
        langs, n = np.array([x for found in counts.values() for x in found], dtype=np.int64).reshape(-1, 2).T
        model["logs"][k] = unseen, starts, langs, np.log((n + 0.5) / below[langs]) - unseen[langs]
        entries = {w: i for i, w in enumerate(counts)}
        if k:
            model["grams"][k] = entries
        else:
            model["words"] = entries
    return model


class Scorer(dict):
    """Predicts texts; keeps the row numbers of words in a growing score matrix."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.size = len(model["langs"])
        self.most = max(1, min(CACHE, CACHE_BYTES // (8 * max(self.size, 1))))
        self.scores = np.zeros((0, self.size))

    def means(self, k: int, found: list[list[int]]) -> np.ndarray:
        """Mean log frequency in every language of each list of entries of ``logs[k]``."""
        unseen, starts, langs, above = self.model["logs"][k]
        number = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        entry = np.fromiter((e for es in found for e in es), dtype=np.int64, count=int(number.sum()))
        row = np.repeat(np.arange(len(found)), number)
        first, width = starts[entry], starts[entry + 1] - starts[entry]
        at = np.arange(int(width.sum())) + np.repeat(first - (np.cumsum(width) - width), width)
        sums = np.bincount(np.repeat(row, width) * self.size + langs[at], weights=above[at], minlength=len(found) * self.size)
        return unseen + sums.reshape(-1, self.size) / number[:, None]

    def score(self, words: list[str]) -> np.ndarray:
        """A row per word: its log frequencies, or the mean of its longest known n-grams'."""
        out = np.zeros((len(words), self.size))
        entries = [self.model["words"].get(w) for w in words]
        rows = [i for i, e in enumerate(entries) if e is not None]
        if rows:
            out[rows] = self.means(0, [[entries[i]] for i in rows])
        left = [(i, f"<{words[i]}>") for i, e in enumerate(entries) if e is None]
        for k in range(self.model["max_gram"], 0, -1):
            grams = self.model["grams"].get(k, {})
            found = [[e for j in range(len(w) - k + 1) if (e := grams.get(w[j:j + k])) is not None] for _, w in left]
            rows = [i for (i, _), es in zip(left, found) if es]
            if rows:
                out[rows] = self.means(k, [es for es in found if es])
            left = [x for x, es in zip(left, found) if not es]
        return out

    def keep(self, words: list[str]) -> None:
        """Scores the words that are not kept yet; drops the others first where there are too many."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(dict.fromkeys(words))
        at = len(self)
        if at + len(new) > len(self.scores):
            grown = np.zeros((max(at + len(new), 2 * len(self.scores)), self.size))
            grown[:at] = self.scores[:at]
            self.scores = grown
        self.scores[at:at + len(new)] = self.score(new)
        self.update(zip(new, range(at, at + len(new))))

    def predict_all(self, texts) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.size:
            return out
        places, words, counts, starts = [], [], [], []

        def settle() -> None:
            self.keep(words)
            at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
            logs = np.add.reduceat(self.scores[at] * np.array(counts, dtype=np.float64)[:, None], starts)
            best = logs.argmax(axis=1)
            share = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, p in zip(places, best.tolist(), share.tolist()):
                out[i] = self.model["langs"][b], p
            for kept in (places, words, counts, starts):
                kept.clear()
        for i, text in enumerate(texts):
            found = Counter(LETTERS.findall(text.lower())) if text else None
            if found:
                places.append(i)
                starts.append(len(words))
                words.extend(found)
                counts.extend(found.values())
                if len(words) >= self.most:
                    settle()
        if words:
            settle()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def predictor(spark, model: dict):
    """Column function: text -> struct(lang, score), in Arrow batches."""
    shared = spark.sparkContext.broadcast(model)      # bounded by train()'s parameters

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame(scorer.predict_all(list(texts)), columns=["lang", "score"])

    # evaluated once per row, also where a filter uses it
    return F.pandas_udf(predict, "lang string, score double").asNondeterministic()


def held_out(id_col: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the id as text has that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, train_on: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """Predicted language of every whole text: doc_id, lang_pred, score.

    ``train_on`` has doc_id, text and lang.  ``score`` is the posterior of the
    predicted language over the learned ones (0 to 1).  A text that is null or
    has no letters is ``und`` with score 0, as is every text if nothing could
    be learned; ties go to the first language in order.  Repeated rows stay,
    other columns are ignored.
    """
    predict = predictor(docs.sparkSession, train(train_on, **bounds))
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), predict(F.col(f"`{text_col}`")).alias("p"))
            .select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))
