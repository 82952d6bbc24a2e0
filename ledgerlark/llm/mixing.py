"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words; each document an expected number of
copies.  Whole copies are certain; the fractional part is an inclusion
probability, and documents are taken in the order of their random odds divided
by their inclusion odds until the source's target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import WORD, free_name, materialize

RANK_BINS = 4096            # bins of the Pareto rank for the distributed prefix sum


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Target words per row of (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share the
    total by weight; a target stops at ``max_repeat`` times the source's size
    and the excess is shared again by weight.  Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    # fill the sources that are soonest full first: the level of the water is
    # the highest share per weight met on the way
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("share", left / rest)
    return s.select("source", "source_size",
                    F.least("cap", F.max("share").over(whole) * F.col("w")).alias("target"))


def size_level(size: Column) -> Column:
    """Preference of a document: binary digits of its size (longer texts are
    drawn a little more often, by the logarithm of their length)."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def fitting(pool: DataFrame, fits: Column) -> DataFrame:
    """``pool`` with ``taken``: of the documents that ``fits`` lets in, those along the rank of
    their source until the next one would overflow ``missing``; ``pool``: rid, s, size, q, bin, missing."""
    pool = pool.withColumn("fits", fits)
    bins = pool.where("fits").groupBy("s", "bin").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    along = Window.partitionBy("s").orderBy("bin")
    bins = (bins.withColumn("upto", F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("below", F.col("upto") - F.col("words")))
    # the bin in which a source's missing words run out
    edge = bins.where("upto > missing").groupBy("s").agg(F.min(F.struct("bin", "below")).alias("e"))
    edge = edge.select(F.col("s").alias("es"), "e.bin", "e.below").withColumnRenamed("bin", "ebin")
    marked = pool.join(edge, F.col("s").eqNullSafe(F.col("es")), "left").drop("es")
    last = F.col("fits") & F.coalesce(F.col("bin") == F.col("ebin"), F.lit(False))
    full = marked.where(~last).withColumn("taken", F.col("fits") & F.expr("ebin is null or bin < ebin"))
    in_edge = Window.partitionBy("s").orderBy("q", "rid").rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.where(last).withColumn("taken", F.col("below") + F.sum("size").over(in_edge) <= F.col("missing"))
    return full.unionByName(cut).drop("fits", "ebin", "below")


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3,
               seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Copies of every document in a mix of the sources by weight.

    A document's expected copies are its source's factor times its size level,
    at most ``max_repeat``; the factor makes the expected words equal the
    source's target.  Whole copies are certain.  For the rest, documents are
    ranked by u/(1-u) divided by p/(1-p) (u from a hash of id and text, p the
    fractional part) and taken while they fit into the words still missing;
    past one that does not fit, the order goes on with those of at most half
    the gap left, round by round, until none is left.  Then documents nearest
    in size to the gap close it as far as that comes nearer to the target.

    Rows (id, source, size, hash; no text) are written once.  The prefix sums
    along the rank come from totals per (source, rank bin), so a source's
    documents never meet in one task.  Null or wordless text: size 0, never
    taken.  Null source: a source of its own, last in order.  Repeated rows
    are separate documents.  An empty table gives no rows.

    Returns rid (``row_col``, or a row number), doc_id, source, size,
    source_size, target, copies, taken.
    """
    text, src = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    key = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f":{seed}:"),
                   F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    rows = docs.select(
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("rid"),
        F.col(f"`{id_col}`").alias("doc_id"), src.alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        u.alias("u"))
    rows = materialize(rows.withColumn("level", size_level(F.col("size"))), "mix-rows")

    # per source and size level: at most 64 levels a source
    levels = rows.groupBy("source", "level").agg(F.sum("size").alias("words"))
    sources = levels.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, max_repeat)
    falling = Window.partitionBy("source").orderBy(F.col("level").desc())
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    per = Window.partitionBy("source")
    mass = F.col("level") * F.col("words")
    factor = ((F.col("target") - F.coalesce(F.sum(F.col("words") * max_repeat).over(above), F.lit(0)))
              / (F.sum(mass).over(per) - F.coalesce(F.sum(mass).over(above), F.lit(0))))
    plan = (levels.where("level > 0")
            .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("factor", factor)
            .withColumn("m", F.least(F.lit(float(max_repeat)), F.max("factor").over(per) * F.col("level")))
            .withColumn("whole", F.floor(F.col("m") + 1e-9))
            .withColumn("p", F.greatest(F.col("m") - F.col("whole"), F.lit(0.0)))
            .withColumn("missing", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(per))
            .select(F.col("source").alias("s"), F.col("level").alias("l"), "whole", "p", "missing"))
    plan = materialize(plan, "mix-plan")                       # sources x levels rows

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    drawn = (rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")))
             .where("p > 0").withColumn("q", odds)
             .withColumn("bin", F.floor(F.lit(RANK_BINS) * F.col("q") / (1 + F.col("q"))))
             .select("rid", "s", "size", "q", "bin", "missing"))
    folder, rounds = scratch_path(docs.sparkSession, "mix-drawn"), 0

    def written(result: DataFrame) -> DataFrame:
        """A round's documents, taken or not; every round reads the last one's alone."""
        nonlocal rounds
        path, rounds = f"{folder}/round={rounds}", rounds + 1
        result.write.parquet(path)
        return docs.sparkSession.read.schema(result.schema).parquet(path)

    def left(result: DataFrame) -> DataFrame:
        """What is not taken and below twice the gap: a gap only shrinks, so no others are asked for again."""
        sums = result.where("taken").groupBy(F.col("s").alias("gs")).agg(F.sum("size").alias("got"))
        return (result.where("not taken").join(sums, F.col("s").eqNullSafe(F.col("gs")), "left")
                .withColumn("missing", F.col("missing") - F.coalesce("got", F.lit(0)))
                .where("size < 2 * missing").drop("gs", "got", "taken"))

    # documents larger than all that is missing cannot fit and do not end the order
    result = written(fitting(drawn, F.col("size") <= F.col("missing")))
    # the order goes on past a document that overflows, with those of at most
    # half the gap: each round takes all of them or more than half the gap
    while True:
        result = written(fitting(left(result), 2 * F.col("size") <= F.col("missing")))
        if result.where("taken").isEmpty():
            break
    # only larger ones are left: the nearest in size to the gap, while that
    # comes nearer to the target; each but the last more than halves the gap
    while True:
        pool = left(result)
        off = F.abs(F.col("size") - F.col("missing"))
        best = (pool.where(off < F.col("missing")).groupBy(F.col("s").alias("bs"))
                .agg(F.min(F.struct(off.alias("off"), "q", "rid")).alias("b")).select("bs", F.col("b.rid").alias("brid")))
        result = written(pool.join(best, F.col("s").eqNullSafe(F.col("bs"))).withColumn("taken", F.col("rid") == F.col("brid"))
                         .drop("bs", "brid"))
        if result.where("taken").isEmpty():
            break
    extra = docs.sparkSession.read.schema(result.schema).parquet(folder).where("taken")
    taken = extra.select("rid").withColumn("one", F.lit(1))
    counted = (rows.join(plan.select("s", "l", "whole"),
                         F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")), "left")
               .join(taken, "rid", "left")
               .withColumn("copies", (F.coalesce("whole", F.lit(0)) + F.coalesce("one", F.lit(0))).cast("long")))
    return (counted.drop("s").join(targets.withColumnRenamed("source", "ts"),
                                   F.col("source").eqNullSafe(F.col("ts")))
            .select("rid", "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"),
                    F.col("target").cast("double").alias("target"), "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` as the mix has them: every row as often as it has copies."""
    row = free_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    copies = (pareto_mix(numbered, row_col=row, **params).where("copies > 0")
              .select(F.col("rid").alias(row), F.col("copies").alias(free_name(numbered, "copies"))))
    times = F.explode(F.array_repeat(F.lit(0), F.col(copies.columns[1]).cast("int")))
    return (numbered.join(copies, row).select(*[F.col(f"`{c}`") for c in docs.columns], times.alias(free_name(docs, "copy")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
