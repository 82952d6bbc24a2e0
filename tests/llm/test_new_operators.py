"""Spelling variants, collocations and line dedup: brute force on small tables, and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlark.llm import collocations, lines, variants

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, ratio=2):
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form[w], n, len(near), counts[form[w]] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


# ---- spelling variants -----------------------------------------------------

@pytest.mark.parametrize("letters,low,high,number,min_chars", [("ab", 5, 9, 220, 5), ("abcdé", 5, 7, 260, 5), ("ab", 2, 5, 50, 2)])
def test_variants_equal_brute_force(spark, letters, low, high, number, min_chars):
    rng = random.Random(f"{letters}{low}")
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(number)}
    counts = {w: rng.choice([3, 4, 6, 9, 20, 50, 50]) for w in sorted(words)}
    got = found_variants(variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), min_chars))
    assert got == brute_variants(counts)


def test_variants_of_long_words(spark):
    """Words around and far beyond the trie's depth, edits at both ends, in the middle and in runs."""
    rng = random.Random(5)
    words = set()
    for size in (variants.LEVELS - 1, variants.LEVELS, variants.LEVELS + 1, variants.LEVELS + 2, 131):
        for base in ("".join(rng.choice("abc") for _ in range(size)), "a" * size):
            words |= {base, "z" + base, base + "z", base[1:], base[:-1], base[:size // 2] + "z" + base[size // 2:],
                      base[:size // 2] + "z" + base[size // 2 + 1:], "y" + base[1:], base[:-1] + "y", base[::-1]}
    counts = {w: 3 + i % 50 for i, w in enumerate(sorted(words))}
    got = found_variants(variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts)


def test_a_very_long_word(spark, make_docs):
    word = "ab" * 30_000
    docs = make_docs([(i, t, "en", "a") for i, t in enumerate([word] * 7 + [word[:40_000] + "q" + word[40_000:]] * 3)])
    got = found_variants(variants.spelling_variants(docs))
    assert {w[:1] + str(len(w)): (f and len(f), len(r), *rest) for w, (f, r, *rest) in got.items()} == {
        "a60000": (None, 60000, 7, 1, None), "a60001": (60000, 60000, 3, 1, 7)}


def test_variants_chain_to_the_root(spark):
    chain = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 96), ("qqqqq", 9)]
    got = found_variants(variants.group_variants(spark.createDataFrame(chain, "word string, n long")))
    assert all(got[w][1] == "bbbbb" for w, _ in chain[:-1]) and got["qqqqq"] == (None, "qqqqq", 9, 0, None)
    tie = spark.createDataFrame([("aaaac", 8), ("aaaab", 8), ("aaaaa", 4)], "word string, n long")
    assert found_variants(variants.group_variants(tie))["aaaaa"] == ("aaaab", "aaaab", 4, 2, 8)


def brute_words(rows, every=97):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ABC)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("every", [97, 3])
def test_word_counts_equal_brute_force(spark, make_docs, every):
    rng = random.Random(1)
    vocabulary = ["Straße", "straße", "ÉCLAIR", "éclair", "word", "words", "Planet", "plänet", "x", "naïve", "don't", "a1b2"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=40)), "en", "a") for i in range(60)] + [(None, "planet " * 9, None, None)]
    got = {r["word"]: r["n"] for r in variants.word_counts(make_docs(rows), typo_every=every).collect()}
    assert got == brute_words([(r[0], r[1]) for r in rows], every)


def test_variants_odd_input(odd_docs, no_docs):
    assert variants.spelling_variants(no_docs).collect() == []
    got = found_variants(variants.spelling_variants(odd_docs))
    assert got["house"][2] == 2502 and got["kleine"][2] == 4      # repeated rows count again
    assert not any(w.startswith("aaaa") for w in got)             # a very long word that occurs once


# ---- line dedup ------------------------------------------------------------

def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ABC)
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(-1 if doc is None else doc)
    keeper = {k: max(d) for k, d in held.items() if len(d) >= min_docs}
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        stay = [x for x in split if keeper.get(key(x), doc if doc is not None else -1) == (-1 if doc is None else doc)]
        out.append((doc, len(split), len(split) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


LONG = [f"this line number {i} is long enough to be counted by the rule" for i in range(9)]


def line_rows():
    rng = random.Random(7)
    rows = []
    for i in range(40):
        some = [rng.choice(["", "  ", "\t", "\r"]) + rng.choice([x, x.upper(), x.title()]) + rng.choice(["", " ", "\r", "\x0b"])
                for x in rng.choices(LONG[:rng.randint(1, 9)], k=rng.randint(0, 6))]
        some += rng.choices(["short", "", " ", "É" * 39, "é" * 40, "x" * 40], k=3)
        rng.shuffle(some)
        rows.append((rng.choice([i, i, i, 3, None]), "\n".join(some), "en", "a"))
    return rows + [(50, None, "en", "a"), (51, "", "en", "a"), (52, "\n\n", "en", "a"), (53, LONG[0], "en", "a")] + [(53, LONG[0], "en", "a")] * 2


@pytest.mark.parametrize("min_docs", [1, 2, 5, 30])
def test_lines_equal_brute_force(spark, make_docs, min_docs):
    rows = line_rows()
    got = lines.drop_repeated_lines(make_docs(rows), min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines([r[:2] for r in rows], min_docs=min_docs)


def test_lines_very_long_text_and_digest(spark, make_docs):
    shared = [LONG[0]] * 20_000
    rows = [(i, "\n".join([f"own {i}", *shared]), "en", "a") for i in range(6)]
    got = {r["doc_id"]: (r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest())
           for r in lines.drop_repeated_lines(make_docs(rows)).collect()}
    assert got[0] == (20_000, hashlib.sha256(b"own 0").hexdigest()) and got[5][0] == 0


def test_lines_odd_input(odd_docs, no_docs):
    assert lines.drop_repeated_lines(no_docs).count() == 0
    got = lines.drop_repeated_lines(odd_docs.withColumnRenamed("b", "n_lines").withColumnRenamed("row", "drop"))
    assert got.columns[-2:] == ["n_lines_", "n_dropped"] and got.count() == 14
    assert got.columns[:-2] == [{"b": "n_lines", "row": "drop"}.get(c, c) for c in odd_docs.columns]


# ---- collocations ----------------------------------------------------------

def brute_collocations(rows, min_count=10, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(ABC)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, *words[i:i + k]] += 1
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    out = collections.defaultdict(list)
    for g, a in cand.items():
        lang, *p = g
        if len(p) == 2 and any(len(h) == 4 and h[0] == lang and (h[1:3] == g[1:] or h[2:4] == g[1:]) and 100 * b >= 50 * a
                               for h, b in cand.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]])
                for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
            for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def phrase_rows(n=300):
    rng = random.Random(3)
    vocabulary = {"en": ["new", "York", "city", "the", "of", "a", "rare", "bird", "sings"], "de": ["der", "Straße", "alte", "ÄRA", "die"],
                  None: ["new", "york", "x"], "und": ["new", "york", "y"], "": ["a", "b"]}
    return [(i, "".join(rng.choice(vocabulary[lang]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " "])
                        for _ in range(rng.randint(0, 60))), lang, "a")
            for i in range(n) for lang in [rng.choice(list(vocabulary))]] + [(None, None, None, None), (None, "", "xx", None)]


def found_phrases(df):
    rows = df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, make_docs, monkeypatch, small):
    """Also with tiny shards, ranges and cuts: pieces over several shards, hot words, automata cut in rounds."""
    rows = phrase_rows() + [(999, "a b c a b " * 200, "en", "a")]
    if small:
        for name, value in (("SHARD_TOKENS", 37), ("RANGE_GRAMS", 150), ("MERGE_ARCS", 64), ("CUT", 4), ("HELD_WORDS", 5)):
            monkeypatch.setattr(collocations, name, value)
    docs = make_docs(rows)
    want = brute_collocations([(r[2], r[1]) for r in rows])
    rows_of = docs.select("lang", "text")
    if small:
        got = found_phrases(collocations.collocations(docs))
        assert got == want and any(x[0] == "und" for x in got)
        # the same tasks in this process, where the small values surely hold
        hot = np.array([collocations.symbol(b"en", b"a", 0), collocations.symbol(b"en", b"b", 0)], np.uint64)
        ranges = collocations.Ranges(40, hot, np.array([5, 3]))
        import pyarrow as pa
        table = pa.RecordBatch.from_pylist([{"lang": r[2], "text": r[1]} for r in rows])
        finer = collections.defaultdict(list)
        for b in collocations.shard_counter(0, ranges, collocations.CUT)(iter([table])):
            for c in collocations.cut_finer(ranges, 1)((None,), iter([b])):
                finer[c.column("part")[0].as_py()].append(c)
        counted = {}
        for part, group in finer.items():
            for b in collocations.unite(1)((pa.scalar(part),), iter(group)):
                grams = collocations.Automaton.from_bytes(b.column("automaton")[0].as_py()).grams()
                assert (ranges.of(grams) == part).all()
                counted |= dict(zip(map(tuple, grams.keys.tolist()), grams.counts.tolist()))
        true = collections.Counter()
        for _, t, la, _ in rows:
            for p in re.split("[.,;:!?\x0A-\x0D]", (t or "").translate(ABC)):
                s = [collocations.symbol(collocations.language(la), w.encode(), 0) for w in re.findall("[^\x20\x09]+", p)]
                true.update((x, y, 0) for x, y in zip(s, s[1:]))
                true.update(zip(s, s[1:], s[2:]))
        assert counted == dict(true) and len(finer) > 30
    else:
        assert found_phrases(collocations.collocations(docs)) == want
        assert found_phrases(collocations.collocations(docs, min_count=3, top=4)) == brute_collocations(
            [(r[2], r[1]) for r in rows], 3, 4)
    assert rows_of.count() == len(rows)


def test_automaton_keeps_counts_and_shares_states():
    def grams(keys, counts):
        labels, rows = np.unique(np.append(keys.reshape(-1), np.uint64(0)), return_inverse=True)
        return collocations.Grams(labels, rows[:-1].reshape(-1, 3), counts)

    def told(g):
        return dict(zip(map(tuple, g.keys.tolist()), g.counts.tolist()))
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 6, (300, 3)).astype(np.uint64), axis=0)
    keys = keys[(keys[:, 0] > 0) & ((keys[:, 1] > 0) | (keys[:, 2] == 0))]
    weights = rng.integers(-1, 3, len(keys))
    weights[weights == 0] = 300
    g = grams(keys, weights)
    a = collocations.Automaton.from_bytes(collocations.Automaton.build(g).to_bytes())
    assert told(a.grams()) == told(g)
    assert (a.weigh(keys) == weights).all()
    assert (a.weigh(np.array([[9, 1, 1], [1, 9, 0], [1, 1, 9]], np.uint64)) == 0).all()
    other = grams(keys[::3] + np.array([1, 0, 0], np.uint64), np.arange(len(keys[::3])))
    both = collections.Counter(told(g))
    for k, n in told(other).items():
        both[k] += n
    assert told(collocations.add_up([collocations.Grams.none(), a.grams(), other])) == dict(both)
    same = np.array([[1, 5, 6], [1, 5, 7], [2, 5, 6], [2, 5, 7], [3, 5, 6]], np.uint64)
    b = collocations.Automaton.build(grams(same, np.array([1, 2, 1, 2, 1])))
    assert [len(level[0]) - 1 for level in b.levels] == [1, 2, 2]         # 1 and 2 go on in the same states
    empty = collocations.Automaton.build(collocations.Grams.none())
    assert len(empty.grams().counts) == 0 and (empty.weigh(keys) == 0).all()


def test_collocations_odd_input(odd_docs, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    got = found_phrases(collocations.collocations(odd_docs))
    assert got == brute_collocations([(r["lang"], r["text"]) for r in odd_docs.select("lang", "text").collect()])
