"""Personal data: patterns, and terms that give the protected values away.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Each
such value is a protected entity.  Over the whole corpus, the co-occurrence of
words with an entity estimates how much of the entity's information a word
discloses; words beyond a threshold are marked too, to be generalised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

# The patterns match as the plain ones do, leftmost first, but never look at a
# run of characters twice: possessive repeats, and starts only where a run starts.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# only maximal runs of 16 to 19 digits: other runs would be dropped anyway
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9]|)"
IP_PARTS = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
KINDS = ("email", "ip", "card", "phone")
WORD = r"\p{L}{3,}+"         # what counts as a term
SPAN = "array<struct<start: int, end: int, value: string>>"


def located(text: Column, pattern: str | Column, guard: Column | None = None) -> Column:
    """Matches of ``pattern`` as structs (start, end, value) in code points.

    A match starts where the texts between matches and the matches before it end.
    """
    pattern = F.lit(pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(
            F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                        lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(zipped, start, step, lambda acc: acc["spans"])
    some = F.regexp_like(text, pattern) if guard is None else guard & F.regexp_like(text, pattern)
    return F.when(some, spans).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = F.reverse(digits(value))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind; matches that fail their check are dropped."""
    size = lambda x: F.length(digits(x["value"]))
    return {
        "email": located(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(located(text, IP), lambda x: F.regexp_like(x["value"], F.lit(IP_PARTS))),
        "card": F.filter(located(text, CARD), lambda x: luhn(x["value"])),
        "phone": F.filter(located(text, PHONE, F.contains(text, F.lit("+"))), lambda x: size(x).between(8, 15)),
    }


def entity(kind: str, value: Column) -> Column:
    """The protected value a span names, however it is written."""
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind in ("email", "ip") else digits(value))


def terms(text: Column) -> Column:
    """The distinct words of three letters or more outside e-mail addresses, lower-cased."""
    outside = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(WORD), 0))


def find_personal_data(docs: DataFrame, share: float = 0.9, support: int = 3,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and disclosing terms of every whole text.

    A term t discloses an entity e if PMI(e; t) >= share * IC(e), with
    PMI = log(n_et N / (n_e n_t)), IC = log(N / n_e), all counts of whole
    documents over the whole corpus, and if at least ``support`` documents hold
    both.  Such terms are spans of kind ``term`` wherever they stand in a
    document that holds the entity, outside e-mail addresses.

    Returns row, doc_id, the spans of each kind (arrays of start, end, value;
    code points, end exclusive) and ``term``.  Null texts count as empty, with
    no spans; repeated rows stay (each counts as a document); other columns are
    ignored; an empty table gives no rows.

    The spans are written once, with the texts of the documents that hold an
    entity.  Pairs of entity and term are formed inside one document at a time,
    for entities of ``support`` documents or more, and are counted map-side, so
    frequent words and entities meet nowhere row by row.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    def values(kind: str) -> Column:
        return F.transform(kind, lambda m: entity(kind, m["value"]))
    named = F.array_distinct(F.concat(*[values(k) for k in KINDS]))
    any_span = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    base = materialize(rows.select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()]).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, named.alias("entities"),
        F.when(any_span, F.col("text")).alias("text")), "spans")
    holders = base.where(F.size("entities") > 0)
    total = base.count()

    mentions = holders.select("row", F.explode("entities").alias("entity"))
    entities = materialize(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
                           .where((F.col("n_e") >= support) & (F.col("n_e") < total)), "entities")
    known = mentions.join(entities, "entity").groupBy("row").agg(F.collect_set("entity").alias("known"))
    occur = (holders.join(known, "row").select("row", "known", F.explode(terms(F.col("text"))).alias("value"))
             .select("row", F.explode("known").alias("entity"), "value"))
    pairs = occur.groupBy("entity", "value").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    words = (rows.select(F.explode(terms(F.col("text"))).alias("value"))
             .groupBy("value").agg(F.count(F.lit(1)).alias("n_t")))
    pmi = F.log(F.col("n_et") * float(total) / (F.col("n_e") * F.col("n_t")))
    telling = materialize(pairs.join(words, "value").join(entities, "entity")
                          .where(pmi >= share * F.log(float(total) / F.col("n_e"))).select("entity", "value"), "telling")
    told = (occur.join(telling, ["entity", "value"]).groupBy("row").agg(F.collect_set("value").alias("told")))
    # the terms are letters only
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("told", "|"), F.lit(r")(?!\p{L})"))
    lowered = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value"))
    inside = lambda w: F.exists("email", lambda m: (m["start"] < w["end"]) & (m["end"] > w["start"]))
    spans = F.filter(F.transform(located(F.col("text"), pattern), lowered),
                     lambda w: F.array_contains("told", w["value"]) & ~inside(w))
    marked = holders.join(told, "row").select("row", spans.alias("term"))
    return base.drop("entities", "text").join(marked, "row", "left").withColumn(
        "term", F.coalesce("term", F.array().cast(SPAN)))


def span_text(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans by kind, then start, joined by commas."""
    def listed(k: str) -> Column:
        return F.transform(k, lambda s: F.concat_ws(
            ":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*[listed(k) for k in kinds]), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with the text sanitised: every span is generalised to its kind,
    as ``[email]`` or ``[term]``; of overlapping spans the first, longest one counts."""
    row = free_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    found = find_personal_data(numbered, id_col=row, text_col=text_col, **params)

    def marked(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("stop"), F.lit(f"[{k}]").alias("mark")))
    marks = F.concat(*[marked(k) for k in (*KINDS, "term")])
    spans = free_name(numbered, "marks")
    joined = numbered.join(found.select(F.col("doc_id").alias(row), F.array_sort(marks).alias(spans)), row)
    text = F.col(f"`{text_col}`")

    def step(acc: Column, s: Column) -> Column:
        keep = s["start"] >= acc["at"]
        return F.when(keep, F.struct(
            (-s["stop"]).alias("at"),
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"])).alias("out"))
        ).otherwise(acc)
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select(*[(F.when(F.size(spans) > 0, clean).otherwise(text).alias(c) if c == text_col
                            else F.col(f"`{c}`")) for c in docs.columns])
