"""Operators on documents: brute force on small tables, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlark.llm import dartminhash, decontam, language, mixing, pii, ppm, shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# ---- language ------------------------------------------------------------

def test_language_held_out_accuracy(spark, docs):
    out = language.held_out(docs["doc_id"])
    got = language.identify(docs, docs.where(~out)).join(docs.where(out).select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_unseen_words_back_off(spark, make_docs):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(
        [("running jumping singing walking", "en"), ("laufenheit singenheit gehenheit", "de")] * 3)]
    model = language.train(make_docs(rows).select("doc_id", "text", "lang"))
    scorer = language.Scorer(model)
    assert "swimming" not in model["words"] and scorer.predict("swimming")[0] == "en"
    assert scorer.predict("trinkenheit")[0] == "de"
    assert scorer.predict("...") == ("und", 0.0) and scorer.predict(None) == ("und", 0.0)


def test_language_learns_every_language(make_docs):
    langs = [f"l{i:03}" for i in range(230)]
    rows = [(i, f"{lang[1:].translate(str.maketrans('0123456789', 'abcdefghij'))}word " * 3, lang, "s")
            for i, lang in enumerate(langs)]
    model = language.train(make_docs(rows).select("doc_id", "text", "lang"))
    scorer = language.Scorer(model)
    assert model["langs"] == langs and [scorer.predict(t)[0] for _, t, _, _ in rows] == langs


def test_language_grams_of_long_words(make_docs):
    long = "".join(random.Random(3).choice("abcdefg") for _ in range(3 * language.PIECE + 17))
    model = language.train(make_docs([(1, long, "xx", "s"), (2, "hij", "yy", "s")]).select("doc_id", "text", "lang"))
    for k in range(1, 5):
        n = collections.Counter(f"<{long}>"[i:i + k] for i in range(len(long) + 3 - k))
        m = collections.Counter("<hij>"[i:i + k] for i in range(6 - k))
        assert set(model["grams"][k]) == set(n) | set(m)
        below = 1 + sum(n.values()) + 0.5 * (len(set(n) | set(m)) + 1)
        unseen, starts, langs, above = model["logs"][k]
        for gram, e in model["grams"][k].items():
            mine = [unseen[0] + a for at, a in zip(langs[starts[e]:starts[e + 1]], above[starts[e]:starts[e + 1]]) if at == 0]
            assert mine == ([pytest.approx(math.log((n[gram] + 0.5) / below))] if n[gram] else [])


def test_language_ties_go_to_the_first(make_docs):
    rows = [(1, "same words here", "b", "s"), (2, "same words here", "a", "s"), (3, "other text there", "c", "s")]
    scorer = language.Scorer(language.train(make_docs(rows).select("doc_id", "text", "lang")))
    assert scorer.predict("same words")[0] == "a"


def test_language_matches_plain_backoff(make_docs, docs):
    model = language.train(docs.where("doc_id % 3 = 0"))
    logs = {k: {w: [model["logs"][k][0][i] + sum(
                model["logs"][k][3][j] for j in range(model["logs"][k][1][e], model["logs"][k][1][e + 1])
                if model["logs"][k][2][j] == i) for i in range(len(model["langs"]))] for w, e in names.items()}
            for k, names in [(0, model["words"]), *model["grams"].items()]}

    def plain(text):
        sums = [0.0] * len(model["langs"])
        words = language.LETTERS.findall((text or "").lower())
        for w in words:
            rows = [logs[0][w]] if w in logs[0] else next(
                (f for k in range(4, 0, -1) if (f := [logs[k][g] for i in range(len(w) + 3 - k) if (g := f"<{w}>"[i:i + k]) in logs[k]])), [])
            for i in range(len(sums)):
                sums[i] += sum(r[i] for r in rows) / max(len(rows), 1)
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return (model["langs"][best], 1 / sum(math.exp(s - sums[best]) for s in sums)) if words else ("und", 0.0)
    texts = [r["text"] for r in docs.select("text").limit(150).collect()] + ["", None, "zzqx", "3 4", "qzx " * 5 + "the"]
    for got, want in zip(language.Scorer(model).predict_all(texts), map(plain, texts)):
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_language_small_cache(make_docs, monkeypatch):
    rows = [(1, "one two three four five", "a", "s"), (2, "six seven eight nine ten", "b", "s")] * 2
    model = language.train(make_docs(rows).select("doc_id", "text", "lang"))
    texts = ["one six two", "three four seven eight nine", "ten five", "five ten six"]
    want = [language.Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(language, "CACHE_BYTES", 64)
    scorer = language.Scorer(model)
    assert [scorer.predict(t) for t in texts] == want


def test_language_odd_input(odd_docs, no_docs):
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(odd_docs, odd_docs).collect()]
    assert len(got) == 14 and (3, "und") in got and (4, "und") in got and (6, "und") in got
    assert got.count((11, "de")) == 3 and (8, "en") in got
    assert language.identify(no_docs, no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, no_docs).collect()} == {"und"}


# ---- personal data -------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        s = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(s)) % 10 == 0

    def fine(kind, value):
        d = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": all(int(p or 0) <= 255 for p in value.split(".")) if kind == "ip" else True,
                "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items()
            for m in re.finditer(p, text or "") if fine(k, m.group(0))]


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_base_spans_match_plain_search(spark, make_docs):
    rng = random.Random(5)
    bits = ["a.b+c@d.e-f.g", "@x.y", "a@b.c_d@e.f.", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "0255.0.0.000001",
            "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (555) 010-2345", "+49 30 1234567 8901 234", "é", "😀",
            " ", "-", "5", "+", "x@", "00000000000000000000", "4111111111111111", "\n", ".", "(", "%%%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "en", "s") for i in range(400)]
    rows.append((400, "a." * 30_000 + "@", "en", "s"))
    rows.append((401, "x@" + "y." * 30_000 + "z", "en", "s"))
    rows.append((402, "1 " * 30_000, "en", "s"))
    got = pii.find_personal_data(make_docs(rows)).select("doc_id", pii.span_text(pii.KINDS).alias("s")).collect()
    want = {i: ",".join(plain_spans(t)) for i, t, _, _ in rows}
    assert {r["doc_id"]: r["s"] for r in got} == want


def test_terms_that_disclose_an_entity(make_docs):
    rows = [(i, f"zebra contact jo@mail.example.com about work number {w}", "en", "s") for i, w in
            enumerate(["one", "two", "three", "four"])]
    rows += [(10 + i, f"ask about work {w}", "en", "s") for i, w in enumerate("abcdefghij")]
    got = {r["doc_id"]: {t["value"] for t in r["term"]} for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert all(got[i] == {"zebra", "contact", "number"} for i in range(4))        # only ever near the address
    assert all(not got[i] for i in range(10, 20))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make_docs(rows)).collect()}
    assert clean[0] == "[term] [term] [email] about work [term] one" and clean[10] == "ask about work a"


def plain_terms(texts, share=0.9, support=3):
    """Telling terms of each text by counting every pair of entity and term."""
    email, word = re.compile(PATTERNS["email"]), re.compile(r"[^\W\d_]{3,}")
    held = [({m.group(0).lower() for m in email.finditer(t)}, set(word.findall(email.sub(" ", t).lower()))) for t in texts]
    n = len(texts)
    n_e = collections.Counter(e for es, _ in held for e in es)
    n_t = collections.Counter(w for _, ws in held for w in ws)
    n_et = collections.Counter((e, w) for es, ws in held for e in es for w in ws)
    telling = {p for p, c in n_et.items() if c >= support and n_e[p[0]] < n and
               math.log(c * n / (n_e[p[0]] * n_t[p[1]])) >= share * math.log(n / n_e[p[0]])}
    return [sorted((m.start(), m.end(), m.group(0).lower()) for m in word.finditer(t)
                   if any((e, m.group(0).lower()) in telling for e in es)
                   and not any(x.start() < m.end() and x.end() > m.start() for x in email.finditer(t)))
            for t, (es, _) in zip(texts, held)]


def test_terms_match_all_pairs(make_docs):
    rng = random.Random(9)
    people = {"jo@ex.org": "zebra blue", "al@ex.org": "falcon", "Di@ex.org": "otter river"}
    texts = []
    for i in range(200):
        words = [rng.choice("the and mail now work time house tree blue river sky".split()) for _ in range(rng.randint(5, 200))]
        for mail, own in people.items():
            if rng.random() < 0.1:
                for w in [mail, *own.split(), own.split()[0].upper()]:
                    words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
    texts.append(("far " * 300) + "jo@ex.org zebra " + ("apart " * 300) + "Zebra zebras")
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, texts[0], texts[0]])]
    got = {}
    for r in pii.find_personal_data(make_docs(rows)).collect():
        got[r["doc_id"]] = sorted((t["start"], t["end"], t["value"]) for t in r["term"])
    want = plain_terms([t for _, t, _, _ in rows])
    assert got == dict(enumerate(want)) and any(want) and len(want[200]) == 2


def test_far_terms_are_found(make_docs):
    rows = [(i, "mail jo@ex.org now " + "filler " * 80 + "zorbanik end", "en", "s") for i in range(4)]
    rows += [(10 + i, "mail now filler end", "en", "s") for i in range(20)]
    got = {r["doc_id"]: [t["value"] for t in r["term"]] for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert all(got[i] == (["zorbanik"] if i < 4 else []) for i in got)


def test_personal_data_odd_input(odd_docs, no_docs):
    got = pii.find_personal_data(odd_docs).collect()
    assert len(got) == 14 and not any(r["email"] or r["phone"] or r["term"] for r in got)
    assert pii.find_personal_data(no_docs).count() == 0
    assert pii.sanitise(odd_docs).columns == odd_docs.columns and pii.sanitise(odd_docs).count() == 14


# ---- language model ------------------------------------------------------

def plain_ppm(train, text, order=3):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        s = bytes([ppm.START]) * 3 + t.encode() + bytes([ppm.END])
        for i in range(3, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k:i]][s[i]] += 1
    s, total = bytes([ppm.START]) * 3 + text.encode() + bytes([ppm.END]), 0.0
    for i in range(3, len(s)):
        p, seen = 1.0, set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts[k].get(s[i - k:i], {}).items() if x not in seen}
            if not c:
                continue
            n = sum(c.values())
            if s[i] in c:
                p, seen = p * c[s[i]] / (n + len(c)), None
                break
            p, seen = p * len(c) / (n + len(c)), seen | set(c)
        total += math.log10(p if seen is None else p / (256 - len(seen)))
    return total


def test_scores_match_plain_ppm_and_unigram(make_docs):
    train = ["abracadabra the cat", "", "The cat sat", "naïve café"]
    rows = [(i, t, "en", "s") for i, t in enumerate([*train, "a cat zzz", "ÿ", None, "dabra abra"])]
    got = {r["doc_id"]: r for r in ppm.score_documents(make_docs(rows), make_docs(rows[:4])).collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, _, _ in rows:
        ws = tokens(t)
        assert got[i]["score"] == pytest.approx(plain_ppm(train, t or ""), rel=1e-5)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ws))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)


def test_rare_words_are_joined(make_docs, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 1)                    # no word is frequent
    rows = [(1, "a b a", "en", "s"), (1, "a b a", "en", "s"), (2, "c", "en", "s")]
    got = ppm.score_documents(make_docs(rows), make_docs(rows[:1])).collect()
    assert sorted((r["doc_id"], r["n_known"]) for r in got) == [(1, 4), (1, 4), (2, 1)]
    first = 2 * math.log10(2.1 / 4.4) + 2 * math.log10(1.1 / 4.4)
    assert all(r["base_score"] == pytest.approx(first) for r in got if r["doc_id"] == 1)


def test_rare_contexts_count_whole(make_docs, monkeypatch):
    common = "the cat sat on the mat and the dog ran after the cat " * 30_000      # 1.6 MB
    train = [common, "Ωμέγα žluťoučký", "Ωμέγα kůň"]                               # once among a million
    rows = [(i, t, "en", "s") for i, t in enumerate([*train[1:], "Ωμέγα the cat", "žlutý kůň", "", None])]
    learn = make_docs([(i, t, "en", "s") for i, t in enumerate(train)])
    want = [plain_ppm(train, t or "") for _, t, _, _ in rows]
    for held in (2 ** 15, 3, 1):
        monkeypatch.setattr(ppm, "HELD", held, raising=False)  # small: most contexts are joined
        got = {r["doc_id"]: r["score"] for r in ppm.score_documents(make_docs(rows), learn).collect()}
        assert [got[i] for i in range(len(rows))] == pytest.approx(want, rel=1e-5)


def test_scores_odd_input(odd_docs, no_docs):
    got = ppm.score_documents(odd_docs, odd_docs).collect()
    assert len(got) == 14 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert ppm.score_documents(no_docs, odd_docs).count() == 0
    blank = ppm.score_documents(odd_docs, no_docs).collect()
    assert {r["train_tokens"] for r in blank} == {0}


def test_trie_rows_are_distributions(make_docs):
    import numpy as np
    import pyarrow as pa
    part = pa.RecordBatch.from_pydict({"text": ["abcabcabd", "xyz", None]})
    codes = collections.Counter()
    for b in ppm.count_tokens(iter([part])):
        for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if len(k) == 5 and k[:1] == b" ":
                codes[int.from_bytes(k[1:], "big")] += n
    orders = []
    for o in range(4):
        d = collections.Counter()
        for code, n in codes.items():
            d[code & ((1 << 8 * (o + 1)) - 1)] += n
        orders.append((np.array(sorted(d), dtype=np.uint32), np.array([d[x] for x in sorted(d)])))
    trie = ppm.Trie(orders)
    assert np.allclose((10.0 ** trie.logs.astype(float)).sum(axis=1), 1, atol=1e-5)


# ---- mixing --------------------------------------------------------------

def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.pareto_mix(docs).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in docs.collect()}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
               for r in got) and len(got) == len(size)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap = {s: 3 * sum(r["size"] for r in by[s]) for s in names}
    want, left, free = {}, sum(cap.values()) / 3, set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > cap[s]}
        if not full:
            want.update({s: share * weight[s] for s in free})
            break
        want.update({s: cap[s] for s in full})
        left, free = left - sum(cap[s] for s in full), free - full
    for s in names:
        assert by[s][0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= 0.02 * want[s] + 5
    again = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}


def test_mix_caps_a_small_source(make_docs):
    rows = [(i, "w " * 10, "en", "a") for i in range(4)] + [(100 + i, "w " * 10, "en", "b") for i in range(100)]
    got = mixing.pareto_mix(make_docs(rows)).collect()
    assert {r["target"] for r in got if r["source"] == "a"} == {120.0}
    assert all(r["copies"] == 3 for r in got if r["source"] == "a")
    assert sum(r["taken"] for r in got) == 1040


@pytest.mark.parametrize("long,short", [(50_000, 2_000), (500_000, 5_000)])
def test_mix_goes_on_past_a_long_document(make_docs, long, short):
    rows = [(0, "w " * long, "en", "b")] + [(1 + i, "w " * 100, "en", "b") for i in range(short)]
    rows += [(10_000 + i, "w " * 2_000, "en", "a") for i in range(long * 2 // 10_000)]
    for seed in ("1", "2", "3"):
        got = mixing.pareto_mix(make_docs(rows), weights=(5, 1), max_repeat=10, seed=seed).where("source = 'b'").agg(
            {"taken": "sum", "target": "max"}).first()
        assert got[0] == pytest.approx(got[1], abs=51)


def test_mix_plan_does_not_grow_with_rounds(make_docs, capsys):
    """Rounds write to one folder: what is taken is one scan, however many rounds there were."""
    rows = [(i, "w " * (1 + i * 37 % 900), "en", "ab"[i % 2]) for i in range(400)]
    mixed = mixing.pareto_mix(make_docs(rows), weights=(5, 1), max_repeat=10)
    capsys.readouterr()
    mixed.explain()
    plan = capsys.readouterr().out
    assert "Union" not in plan and "LeftAnti" not in plan and mixed.count() == 400


def test_mix_odd_input(odd_docs, no_docs):
    got = mixing.pareto_mix(odd_docs).collect()
    assert len(got) == 14 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.pareto_mix(no_docs).count() == 0
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_documents(no_docs).count() == 0


# ---- decontamination -----------------------------------------------------

WORDS = ["alpha", "bravo", "the", "of", "delta", "echo", "a", "golf", "hotel", "in", "kilo", "lima", "to", "nine", "oscar"]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[i] = rng.choice(WORDS) + "x"
        elif kind == 1:
            words.insert(i, rng.choice(WORDS) + "y")
        else:
            del words[i]
    return words


def test_planted_passages_are_found(spark, make_docs):
    rng = random.Random(3)
    text = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    items = [(i, text(rng.randint(5, 60))) for i in range(60)]
    rows, planted = [], set()
    for i, words in items:
        for k, share in enumerate((0, 0.1, 0.2)):
            got = edited(rng, words, int(share * len(words) + 1e-9))
            rows.append((i * 10 + k, " ".join(text(rng.randint(0, 80)) + got + text(rng.randint(0, 80))).upper(), "en", "s"))
            planted.add((i * 10 + k, i))
    rows += [(10_000 + i, " ".join(text(300)), "en", "s") for i in range(100)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(make_docs(rows), bench, block_items=25).collect()}
    assert len(found & planted) >= 0.97 * len(planted) and all(d < 10_000 for d, _ in found)
    kept = {r["doc_id"] for r in decontam.drop_leaks(make_docs(rows), bench).collect()}
    assert all(10_000 + i in kept for i in range(100)) and not kept & {i * 10 for i, _ in items}


def test_every_length_and_edit_share_is_found(spark, make_docs):
    rng = random.Random(8)
    text = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    lengths, shares, items, rows, planted = (5, 12, 25, 50, 100, 200), (0, 0.1, 0.2), [], [], collections.defaultdict(set)
    for n in lengths:
        for i in range(len(items), len(items) + 12):
            items.append((i, text(n)))
            for k, share in enumerate(shares):
                got = edited(rng, items[i][1], int(share * n + 1e-9))
                rows.append((i * 10 + k, " ".join(text(rng.randint(0, 40)) + got + text(rng.randint(0, 40))), "en", "s"))
                planted[n, share].add((i * 10 + k, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.find_leaks(make_docs(rows), bench).collect()}
    assert {c: len(got.keys() & p) / len(p) for c, p in planted.items()} == {c: 1.0 for c in planted}
    assert all(e <= int(0.2 * len(items[i][1]) + 1e-9) for (_, i), e in got.items())


def test_exact_passages_of_the_tables(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = {r["item_id"]: flat(r["text"]) for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if w in flat(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2


def _hashes(words):
    return np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_repeated_words_are_not_embedded(monkeypatch):
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    items = [["of", "the", "in", "a"] + text(12) + ["the", "of"] + text(12) for _ in range(5)]
    index = decontam.Index([(i, _hashes(w)) for i, w in enumerate(items)])
    repeated = [["of", "the"] * 200, (text(30) + ["of", "the", "in", "a"] * 40) * 2, text(100) + ["the", "of"] * 30]
    whole = text(20) + ["of", "the"] * 50 + items[3] + text(20)
    embedded, embed = [], decontam.embed
    monkeypatch.setattr(decontam, "embed", lambda *of: embedded.append(len(of[1])) or embed(*of))
    docs = [_hashes(w) for w in repeated]
    assert index.search(np.concatenate(docs), np.cumsum([0, *map(len, docs)])) == {} and embedded == []
    found = index.search(_hashes(whole), np.array([0, len(whole)]))
    assert found == {0: [(3, 0, 120)]} and embedded


def test_few_words_as_by_brute_force():
    rng = random.Random(6)
    text = lambda words, n: [rng.choice(WORDS[:words]) for _ in range(n)]
    matches = 0
    for words in (2, 3, 5, 10) * 8:
        items = [_hashes(text(words, rng.randint(5, 30))) for _ in range(8)]
        docs = [np.concatenate([_hashes(text(words, rng.randint(2, 50)) + ["of", "the"] * rng.randint(0, 20)),
                                rng.choice(items)[rng.randint(0, 2):], _hashes(text(words, 5))]) for _ in range(8)]
        near = {(d, i): decontam.passage_edits(item, doc)[0] for d, doc in enumerate(docs) for i, item in enumerate(items)}
        want = {c: e for c, e in near.items() if e <= decontam.allowed_edits(len(items[c[1]]), 0.8)}
        found = decontam.Index(list(enumerate(items))).search(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
        assert {(d, i): e for d, hits in found.items() for i, e, _ in hits} == want
        matches += len(want)
    assert matches > 100


def test_decontamination_odd_input(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (3, "the cat sat"), (4, "dem alten haus und warten")],
                                  "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(odd_docs, bench).collect())
    assert got == [(2, 4), (11, 4), (11, 4), (11, 4)]
    assert decontam.find_leaks(no_docs, bench).count() == 0
    assert decontam.find_leaks(odd_docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(odd_docs, bench).columns == odd_docs.columns
    assert decontam.drop_leaks(odd_docs, bench).count() == 10


# ---- shards --------------------------------------------------------------

def test_shards_are_equal_and_contiguous(docs, texts):
    got = sorted(shards.byte_shards(docs, 24).collect(), key=lambda r: r["doc_id"])
    total, at, largest = sum(r["size"] for r in got), 0, max(r["size"] for r in got)
    slots = collections.Counter()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["shard"] == min(23, (2 * at + r["size"]) * 24 // (2 * total))
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        at += r["size"]
    sums = collections.Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert all(abs(sums[s] - total / 24) <= largest for s in range(24))


def test_shards_odd_input(odd_docs, no_docs):
    got = shards.byte_shards(odd_docs, 3).collect()
    assert len(got) == 14 and {r["size"] for r in got if r["doc_id"] == 3} == {8}
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.byte_shards(no_docs, 3).count() == 0
    out = shards.shard_documents(odd_docs, 3)
    assert out.columns[:-2] == odd_docs.columns and out.columns[-2:] == ["shard_", "slot"] and out.count() == 14


# ---- near duplicates -----------------------------------------------------

def plain_classes(texts, threshold=0.8):
    def bag(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
    ids = [d for d, t in texts.items() if t and t.strip()]
    bags, root = {d: bag(texts[d]) for d in ids}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = bags[a], bags[b]
            small, large = sorted((x.total(), y.total()))
            near = texts[a] == texts[b] or (small and small >= threshold * large
                                            and (x & y).total() >= threshold * (x | y).total())
            if near and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in texts}


def test_classes_match_brute_force(docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs).collect()}
    assert got == plain_classes(texts)


def test_chains_and_large_groups(make_docs):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts, words = {}, base
    for i in range(400):                                  # near copies of the base, some of copies
        words = list(rng.choice([base, words]))
        words[rng.randrange(120)] = f"v{i}"
        texts[i] = " ".join(words)
    texts.update({1000 + i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for i in range(50)})
    rows = [(d, t, "en", "s") for d, t in texts.items()]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(make_docs(rows)).collect()}
    assert got == plain_classes(texts)
    kept = [r["doc_id"] for r in dartminhash.drop_near_duplicates(make_docs(rows + rows)).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_near_duplicates_odd_input(odd_docs, no_docs):
    got = dartminhash.near_duplicates(odd_docs).collect()
    assert len(got) == 14 and {r["class_id"] for r in got if r["doc_id"] == 11} == {2}
    assert sorted(r["class_id"] for r in got if r["doc_id"] in (3, 4, 5)) == [3, 4, 5]
    kept = dartminhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(11) == 0 and ids.count(2) == 1 and ids.count(3) == 1 and ids.count(None) == 1
    assert dartminhash.near_duplicates(no_docs).count() == 0 and dartminhash.drop_near_duplicates(no_docs).count() == 0


def test_items_without_a_number_are_found(spark, make_docs):
    item = "seven small ships sailed past the quiet harbour wall"
    bench = spark.createDataFrame([(None, item), ("x7", item.replace("seven", "eight")), ("12", "one two three four five six"),
                                   (None, None)], "item_id string, text string")
    docs = make_docs([(1, f"before {item} after", "en", "a"), (2, "one two three four five six", "en", "a"), (3, "clean", "en", "a")])
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(1, None): 0, (2, 12): 0}
    assert [r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()] == [3]
