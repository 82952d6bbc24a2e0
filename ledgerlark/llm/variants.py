"""Spelling variants: words of a corpus grouped by single edits.

The vocabulary is kept as a relational trie: an edge table (node, children) of
all prefixes, one of the words and one of the reversed words.  States (word,
position, node, edits) are joined with it level by level; a state that has
spent its edit and read its whole word names a neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialize
from .lines import LOWER, UPPER, digest

RUN = "[a-z\u00C0-\u00FF]+"    # after A-Z have been lower-cased
LEVELS = 48                         # code points of a word that the trie takes; longer ones are met by halves
TYPO_EVERY = 97


def word_counts(docs: DataFrame, min_chars: int = 5, min_count: int = 3, typo_every: int | None = TYPO_EVERY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``min_chars`` code points with at least
    ``min_count`` occurrences in all texts.

    Words are maximal runs of letters with A-Z in lower case.  With
    ``typo_every`` a run whose crc32 of ``<id>:<run>`` it divides loses the
    code point at that crc32 modulo its length (an id that is null is written
    as nothing).
    """
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    if typo_every:
        at = "cast(h % length(word) as int)"
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))).withColumn(
            "word", F.expr(f"case when h % {typo_every} = 0 then concat(left(word, {at}), substring(word, {at} + 2)) else word end"))
    return (runs.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _both_ways(words: DataFrame) -> DataFrame:
    """(s, n): every word behind ``>`` and its reverse behind ``<``."""
    ways = F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word"))))
    return words.select(ways.alias("s"), F.length("word").alias("n"))


def trie_edges(marked: DataFrame, low: int) -> DataFrame:
    """The edge table (depth, node, children, is_word) of depths from ``low`` on.

    A node is its prefix.  A child has its code point, the set of lengths left
    below it and the set of code points that follow it (each as the bits of a
    long; the second modulo 64), so that a state only enters a child under
    which its word can go on.  A node has at most as many children as there are
    letters.
    """
    steps = marked.select("s", "n", F.explode(F.sequence(F.lit(low), F.greatest("n", F.lit(low)))).alias("depth"))
    steps = steps.where("depth <= n").selectExpr(
        "depth", "left(s, depth + 1) as node", "substring(s, depth + 2, 1) as c",
        "shiftleft(1L, greatest(n - depth - 1, 0)) as lens",
        "case when depth + 1 < n then shiftleft(1L, ascii(substring(s, depth + 3, 1)) & 63) else 0L end as nexts")
    edges = steps.groupBy("depth", "node", "c").agg(F.bit_or("lens").alias("lens"), F.bit_or("nexts").alias("nexts"))
    return edges.groupBy("depth", "node").agg(
        F.collect_list(F.when(F.col("c") != "", F.struct("c", "lens", "nexts"))).alias("children"),
        F.max(F.col("c") == "").alias("is_word"))


_STATE = "struct(s, n, {pos} as pos, {node} as node, {edits} as edits, {done} as done)"


def _step() -> Column:
    """The states that a state joined with its node leads to.

    Without an edit so far: it reads its own code point; it replaces it by a
    greater one (the smaller of two words finds the other); or it leaves it
    out, if it is the last of a run of equal ones, and reads the next.  With
    its edit spent it only reads.  Insertions are the deletions of the other
    word.
    """
    def goes_on(skip: int) -> str:           # whether the word can go on under child x, ``skip`` code points ahead
        return (f"(x.lens & shiftleft(1L, n - pos - {skip + 1})) <> 0 and (pos + {skip + 1} = n or "
                f"(x.nexts & shiftleft(1L, ascii(substring(s, pos + {skip + 3}, 1)) & 63)) <> 0)")

    def enter(test: str, skip: int) -> str:
        state = _STATE.format(pos=f"pos + {skip + 1}", node="concat(node, x.c)", edits="1", done=f"pos + {skip + 1} = n")
        return f"transform(filter(children, x -> {test} and {goes_on(skip)}), x -> {state})"
    own, after = "substring(s, pos + 2, 1)", "substring(s, pos + 3, 1)"
    none = "filter(array(" + _STATE.format(pos="pos", node="node", edits="1", done="true") + "), x -> false)"
    reads = "array(" + _STATE.format(pos="pos + 1", node=f"concat(node, {own})", edits="0", done="false") + ")"
    ends = "array(" + _STATE.format(pos="n", node="node", edits="1", done="true") + ")"
    return F.expr(f"""
        case when edits = 1 then {enter(f"x.c = {own}", 0)}
             else concat(case when pos + 1 < n then {reads} else {none} end,
                         {enter(f"x.c > {own}", 0)},
                         case when pos + 1 = n then case when is_word then {ends} else {none} end
                              when {own} <> {after} then {enter(f"x.c = {after}", 1)}
                              else {none} end)
        end""")


def trie_neighbours(words: DataFrame, min_chars: int) -> DataFrame:
    """Pairs (word, near) one edit apart among words of at most LEVELS code points.

    An edit in a word's second half is found in the trie of the words, one in
    its first half in that of the reversed words; so a state starts at the node
    of its first half, where nodes have few children.  Each level is one join
    on the node, and its states are written.
    """
    spark = words.sparkSession
    low = min_chars // 2
    marked = _both_ways(words.where(F.length("word") <= LEVELS))
    edges_at = scratch_path(spark, "trie-edges")
    trie_edges(marked, low).write.partitionBy("depth").parquet(edges_at)
    edges = spark.read.schema("node string, children array<struct<c: string, lens: long, nexts: long>>, "
                              "is_word boolean, depth int").parquet(edges_at)
    start = marked.selectExpr("s", "n", "n div 2 as depth", "cast(n div 2 as int) as pos", "left(s, cast(n div 2 as int) + 1) as node",
                              "0 as edits", "false as done")
    deepest = words.where(F.length("word") <= LEVELS).agg(F.max(F.length("word"))).first()[0] or 0
    kind = "s string, n int, pos int, node string, edits int, done boolean"
    levels, states = [], None
    for depth in range(low, deepest):
        here = start.where(F.col("depth") == depth).drop("depth")
        if states is not None:
            here = here.unionByName(states.where(~F.col("done")))
        children = edges.where(F.col("depth") == depth).drop("depth")
        moved = here.drop("done").join(children, "node").select(F.explode(_step()).alias("t")).select("t.*")
        levels.append(scratch_path(spark, "trie-states"))
        moved.write.parquet(levels[-1])
        states = spark.read.schema(kind).parquet(levels[-1])
    if not levels:
        return words.select("word", F.col("word").alias("near")).where(F.lit(False))

    def word(c: str) -> Column:
        return F.when(F.col(c).startswith(">"), F.substring(c, 2, LEVELS)).otherwise(F.reverse(F.substring(c, 2, LEVELS)))
    found = spark.read.schema(kind).parquet(*levels).where("done").select(word("s").alias("word"), word("node").alias("near"))
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def long_neighbours(words: DataFrame) -> DataFrame:
    """Pairs (word, near) one edit apart of which one is longer than LEVELS.

    One edit leaves the first or the last half of the shorter word unchanged:
    words with an equal half, at lengths that differ by at most one, are
    compared.
    """
    n = F.length("word")
    long = words.where(n >= LEVELS).select("word", n.alias("n"), F.explode(F.array(n, n - 1)).alias("shorter"))
    sides = F.explode(F.array(F.struct(F.lit("first").alias("side"), F.expr("left(word, shorter div 2)").alias("part")),
                              F.struct(F.lit("last").alias("side"), F.expr("right(word, shorter div 2)").alias("part"))))
    parts = long.select("word", "n", "shorter", sides.alias("t")).select(
        "word", "n", "shorter", "t.side", digest(F.col("t.part"), "a").alias("a"), digest(F.col("t.part"), "b").alias("b"))
    other = parts.select(F.col("word").alias("near"), F.col("n").alias("m"), "shorter", "side", "a", "b")
    pairs = (parts.join(other, ["shorter", "side", "a", "b"])
             .where((F.col("word") < F.col("near")) & (F.least("n", "m") == F.col("shorter"))
                    & (F.greatest("n", "m") > LEVELS)).select("word", "near").distinct()
             .where(F.levenshtein("word", "near", 1) == 1))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def follow(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) for links (word, form) without cycles: every round doubles
    the number of links followed, so their rounds are the logarithm of the
    longest chain."""
    roots = materialize(links.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(max_rounds):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = materialize(roots.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "variant-roots")
        roots = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"links are longer than 2^{max_rounds}, or have a cycle")


def group_variants(words: DataFrame, min_chars: int = 5, ratio: int = 2) -> DataFrame:
    """Words with their near words, form and root, from (word, n).

    Two words are near if one inserted, deleted or replaced code point turns
    one into the other.  A word's form is its near word of largest n, ties to
    the smallest in code-point order, if that n is at least ``ratio`` times
    its own; the root is reached by following forms.  ``words`` must be
    distinct, not null and of at least ``min_chars`` code points.

    Returns word, form, root, n, n_near, form_n; an empty table gives no rows.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = trie_neighbours(words, min_chars).unionByName(long_neighbours(words))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = (near.join(counts, "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")))
    ahead = -F.col("best.m")
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(ahead >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(ahead >= ratio * F.col("n"), ahead).alias("form_n")), "variant-forms")
    roots = follow(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2,
                      typo_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_variants`` of the words of whole texts (``word_counts``).

    Null and empty texts have no words; rows of the same document count again;
    other columns are ignored; ``min_chars`` is at least 2.
    """
    return group_variants(word_counts(docs, min_chars, min_count, typo_every, id_col, text_col), min_chars, ratio)
