"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is a weighted set of shingles (weight: occurrences).  Hashed darts
fall on each element's region as a stream of arrival times that depends on the
element alone; a document keeps the earliest dart per coordinate.  Documents
with equal bands of coordinates are candidates, compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, materialize

BANDS, ROWS = 36, 7         # finds a pair at similarity 0.8 with probability 0.9998
CHUNK = 1_000_000           # words hashed at a time
TILE = 128                  # documents of one bucket compared at a time, per side
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps around."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def elements(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit elements of documents given as word hashes and offsets.

    A shingle that occurs n times gives n elements (shingle, 1..n), so the
    weighted Jaccard similarity of two documents is that of their element sets.
    Fewer words than ``width`` make one shingle; no words, none.  Returns
    (elements, owner), sorted by owner, then element.
    """
    n = np.diff(offsets)
    grams = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), grams)
    start = offsets[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    long = np.minimum(n, width)[owner]
    h = _mix(long.astype(U))
    for k in range(width):
        at = np.minimum(start + k, max(len(words) - 1, 0))
        h = np.where(long > k, _mix(h * U(31) + words[at]), h) if len(owner) else h
    packed = np.sort((owner.astype(U) << U(40)) | (h >> U(24)))       # 40 bits of hash, by owner
    h, owner = packed & U((1 << 40) - 1), (packed >> U(40)).astype(np.int64)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return _mix(h + (np.arange(len(h)) - first).astype(U) * U(0x9E3779B97F4A7C15)), owner


def signatures(items: np.ndarray, owner: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Earliest arrival time per document and coordinate; inf without elements.

    Darts of an element arrive at rate ``k`` per unit of time; a document of
    weight W is thrown k ln k + 2k darts on average, by looking up to that
    time, and longer where a coordinate is still empty.
    """
    best = np.full((docs, k), np.inf)
    weight = np.bincount(owner, minlength=docs)
    until = (math.log(k) + 2) / np.maximum(weight, 1)
    open_docs = weight > 0
    while open_docs.any():
        keep = open_docs[owner]
        e, d = items[keep], owner[keep]
        t, n = np.zeros(len(e)), 0
        flat = best.reshape(-1)
        while len(e):
            n += 1
            x = _mix(e + U((n * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / k
            hit = t <= until[d]
            e, d, t = e[hit], d[hit], t[hit]
            np.minimum.at(flat, d * k + (_mix(x[hit] + U(1)) % U(k)).astype(np.int64), t)
        open_docs &= np.isinf(best).any(axis=1)
        until = np.where(open_docs, until * 1.5, until)
    return best


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band; equal times come from the same dart."""
    bits = best.view(U).reshape(len(best), bands, rows)
    key = _mix(np.arange(1, bands + 1, dtype=U))[None, :].repeat(len(best), axis=0)
    for r in range(rows):
        key = _mix(key * U(31) + bits[:, :, r])
    return key.view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, words, offsets) of about CHUNK words at a time."""
    col = batch.column("words")
    off = np.asarray(col.offsets).astype(np.int64)
    words = np.asarray(col.values).view(U)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
        yield lo, hi, words[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def hashed_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, words): h is the text's digest, null for a text without
    content; words are 64-bit hashes of the lower-cased runs of letters and digits."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.when(F.length(F.trim(text)) > 0, F.unhex(F.md5(text.cast("binary")))).alias("h"), text.alias("text"))


def _words(col: str = "text"):
    return F.transform(F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.xxhash64(w))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = BANDS,
                    rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every document: (doc_id, h, class_id, class_key), one row per input row.

    Two documents are linked if their texts are equal or the weighted Jaccard
    similarity of their ``width``-word shingles is at least ``threshold``; a
    class is a connected component, class_id its smallest doc_id and class_key
    a digest that names it.  h is the digest of the row's text.

    Equal texts are one node from the start.  In each bucket of equal bands all
    texts are compared with the first one; where a bucket still holds several
    components, the others' texts are compared with the largest one's and with
    each other in tiles, so no candidate is dropped and no bucket meets in one
    task.  Null, empty and blank texts
    are each a class of their own (h and class_key null, class_id the doc_id).
    Texts without letters or digits link only to equal texts.  Repeated rows
    share a class; other columns are ignored; an empty table gives no rows.
    """
    k = bands * rows
    keyed = hashed_words(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, off in _chunks(batch):
                items, owner = elements(words, off, width)
                best = signatures(items, owner, hi - lo, k)
                keys = pa.ListArray.from_arrays(
                    np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32),
                    band_keys(best, bands, rows).reshape(-1))
                some = np.isfinite(best[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h")[lo:hi], keys], names=["h", "bands"]).filter(pa.array(some))

    def list_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, off in _chunks(batch):
                items, owner = elements(words, off, width)
                # 32 bits of each element, sorted: enough to compare two documents
                small = (items >> U(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((small, owner))
                small, owner = small[order], owner[order]
                new = np.ones(len(small), dtype=bool)
                new[1:] = (small[1:] != small[:-1]) | (owner[1:] != owner[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h")[lo:hi], pa.ListArray.from_arrays(ends, small[new])], names=["h", "items"])

    texts = keyed.where("h is not null").select("h", "text")
    signed = texts.select("h", _words().alias("words")).mapInArrow(sign, "h binary, bands array<long>")
    signed = materialize(signed.dropDuplicates(["h"]), "signatures")
    members = signed.select("h", F.explode("bands").alias("b"))
    first = (members.groupBy("b").agg(F.min("h").alias("rep"), F.max("h").alias("last"))
             .where("rep <> last").select("b", "rep"))
    shared = materialize(members.join(first, "b"), "buckets")            # buckets of several texts only
    pairs = shared.where("h <> rep").select("rep", "h").distinct()
    wanted = shared.select("h").distinct()
    items = (texts.join(wanted, "h", "left_semi").dropDuplicates(["h"])
             .select("h", _words().alias("words")).mapInArrow(list_elements, "h binary, items array<int>"))
    items = materialize(items, "elements")
    links = materialize(
        pairs.join(items.withColumnRenamed("items", "b"), "h")
        .join(items.select(F.col("h").alias("rep"), F.col("items").alias("a")), "rep")
        .mapInArrow(_compare(threshold), "u binary, v binary"), "links")
    parts = connected_components(links)

    # buckets that hold several components after the first comparison
    group = F.coalesce("component", "h")
    split = shared.join(parts.withColumnRenamed("id", "h"), "h", "left").select("b", "h", group.alias("g"))
    sizes = split.groupBy("b", "g").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy("b").agg(F.max(F.struct("n", "g")).alias("most"), F.sum("n").alias("n"),
                                    F.count(F.lit(1)).alias("groups")).where("groups > 1")
             .select("b", F.col("most.g").alias("main"), F.ceil(F.col("most.n") / TILE).cast("int").alias("t"),
                     F.ceil((F.col("n") - F.col("most.n")) / TILE).cast("int").alias("o")))
    mixed = materialize(split.join(mixed, "b").withColumn("is_main", F.col("g") == F.col("main")).drop("main"), "mixed")
    if not mixed.isEmpty():
        # the largest component's tiles meet the tiles of all others, and those each other
        tile = F.pmod(F.xxhash64("h"), F.when(F.col("is_main"), F.col("t")).otherwise(F.col("o"))).cast("int")
        keyed_tile = mixed.withColumn("tile", tile)
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        names = ["b", "kind", "i", "j", "is_main", "tile", "h", "g"]
        spread = (
            keyed_tile.where("is_main").withColumn("j", upto("o")).withColumn("kind", F.lit(1))
            .withColumn("i", F.col("tile")).select(names)
            .unionByName(keyed_tile.where("not is_main").withColumn("i", upto("t")).withColumn("kind", F.lit(1))
                         .withColumn("j", F.col("tile")).select(names))
            .unionByName(keyed_tile.where("not is_main").withColumn("x", upto("o")).withColumn("kind", F.lit(0))
                         .withColumn("i", F.least("tile", "x")).withColumn("j", F.greatest("tile", "x")).select(names)))
        more = (spread.join(items, "h").groupBy("b", "kind", "i", "j")
                .applyInArrow(_compare_tile(threshold), "u binary, v binary").distinct())
        links = links.unionByName(more)
        parts = connected_components(links)
    nodes = keyed.select("doc_id", "h").join(parts.withColumnRenamed("id", "h"), "h", "left").select(
        "doc_id", "h", F.coalesce("component", "h").alias("class_key"))
    nodes = materialize(nodes, "classes")
    lowest = nodes.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("low"))
    return nodes.join(lowest, "class_key", "left").select(
        "doc_id", "h", F.coalesce("low", "doc_id").alias("class_id"), "class_key")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted lists without repeats."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(len(both) - common, 1)


def _lists(batch, name: str) -> list[np.ndarray]:
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off, values = np.asarray(col.offsets), np.asarray(col.values)
    return [values[off[i]:off[i + 1]] for i in range(len(col))]


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(a, b) >= threshold for a, b in zip(_lists(batch, "a"), _lists(batch, "b"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("h")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))
    return compare


def _compare_tile(threshold: float):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links between components of one bucket's two tiles; a merged
        component is not compared again."""
        ids, tiles = table.column("h").to_pylist(), table.column("tile").to_pylist()
        groups, items = table.column("g").to_pylist(), _lists(table, "items")
        main = table.column("is_main").to_pylist()
        kind, i, j = (k.as_py() for k in key[1:])
        root = {g: g for g in groups}

        def find(g):
            while root[g] != g:
                g = root[g]
            return g
        if kind:
            left, right = [x for x in range(len(ids)) if main[x]], [x for x in range(len(ids)) if not main[x]]
        else:
            left, right = [x for x in range(len(ids)) if tiles[x] == i], [x for x in range(len(ids)) if tiles[x] == j]
        u, v = [], []
        for x in left:
            for y in right:
                if not kind and i == j and y <= x:
                    continue
                gx, gy = find(groups[x]), find(groups[y])
                small, large = sorted((len(items[x]), len(items[y])))
                if gx != gy and small >= threshold * large and jaccard(items[x], items[y]) >= threshold:
                    root[max(gx, gy)] = min(gx, gy)
                    u.append(ids[x])
                    v.append(ids[y])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})
    return compare


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` with one document kept of each class: its smallest
    doc_id (null last), then digest.  Rows whose text is null or blank all
    stay; of repeated rows with the kept id and text one stays."""
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **params).where("class_key is not null")
    best = (classes.groupBy("class_key")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("k"))
            .select(F.col("k.doc_id").alias("__keep_id"), F.col("k.h").alias("__keep_h")))
    copies = classes.groupBy(F.col("doc_id").alias("__cid"), F.col("h").alias("__ch")).count().where("count > 1")
    best = best.join(copies, F.col("__keep_id").eqNullSafe(F.col("__cid")) & (F.col("__keep_h") == F.col("__ch")),
                     "left").select("__keep_id", "__keep_h", F.col("__ch").isNotNull().alias("__repeated"))
    text = F.col(f"`{text_col}`")
    digest = F.when(F.length(F.trim(text)) > 0, F.unhex(F.md5(text.cast("binary"))))
    names, own = [F.col(f"`{c}`") for c in docs.columns], free_name(docs, "digest")
    found = docs.withColumn(own, digest)
    kept = found.where(F.col(own).isNotNull()).join(
        best, F.col(f"`{id_col}`").eqNullSafe(F.col("__keep_id")) & (F.col(own) == F.col("__keep_h")))
    once = kept.where("__repeated").dropDuplicates([own])
    return (found.where(F.col(own).isNull()).select(*names)
            .unionByName(kept.where("not __repeated").select(*names)).unionByName(once.select(*names)))
