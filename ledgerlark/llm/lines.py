"""Line dedup: lines that many documents share are dropped.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; lines over the threshold are dropped from all documents but one, and the
others put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def digest(text: Column, part: str) -> Column:
    """64 of the 128 bits that stand for a text; ``part`` picks the half."""
    return F.xxhash64(F.lit(part), text)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Lines to drop, as (doc, text_hash, drop): ids, half a digest of the text
    and the positions (from 0) of its lines to drop.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents is dropped everywhere but in the largest id that holds it.  Rows
    of one id are one document; rows without an id are one document together,
    below all others.

    Only hashes are shuffled.  (hash, document) is made distinct before
    documents are counted per hash, so a line of a third of all documents is
    spread over the tasks and reduced map-side; the join back to its places is
    by hash, in which Spark splits a skewed partition.
    """
    text = whole_text(F.col(f"`{text_col}`"))
    places = docs.select(F.col(f"`{id_col}`").alias("doc"), digest(text, "text").alias("text_hash"),
                         F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    places = places.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    places = materialize(places.where(F.length("key") >= min_chars).select(
        digest(F.col("key"), "a").alias("a"), digest(F.col("key"), "b").alias("b"), "doc", "text_hash", "pos"), "line-places")
    shared = (places.select("a", "b", "doc").distinct().groupBy("a", "b")
              .agg(F.count(F.lit(1)).alias("held_by"), F.max("doc").alias("keeper"))
              .where(F.col("held_by") >= min_docs).drop("held_by"))
    shared = materialize(shared, "shared-lines")        # its own shuffle, so that the join can split a hot line's places
    drop = places.join(shared, ["a", "b"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return drop.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("drop"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and n_lines and n_dropped.

    Texts are split at newlines; a null or empty text is one empty line, and
    its text is empty afterwards.  Lines that stay are unchanged and in order.
    Repeated rows lose the same lines; see ``repeated_lines`` for null ids.
    An empty table gives no rows.  Other columns stay; where one is called
    n_lines or n_dropped, the new one gets an underscore.
    """
    gone = repeated_lines(docs, min_chars, min_docs, id_col, text_col)
    names = {c: free_name(docs, c) for c in ("doc", "text_hash", "drop", "lines", "n_lines", "n_dropped")}
    gone = gone.select(*[F.col(c).alias(names[c]) for c in gone.columns])
    text = whole_text(F.col(f"`{text_col}`"))
    found = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(names["doc"]))
                      & (digest(text, "text") == F.col(names["text_hash"])), "left")
    found = found.withColumn(names["lines"], F.split(text, "\n"))
    lines = F.col(names["lines"])
    drop = F.coalesce(F.col(names["drop"]), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    kept = F.when(F.size(drop) == 0, text).otherwise(kept)
    return found.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                        F.size(lines).cast("long").alias(names["n_lines"]),
                        F.size(drop).cast("long").alias(names["n_dropped"]))
