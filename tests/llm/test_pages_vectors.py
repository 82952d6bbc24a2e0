"""URL rules, page text, embeddings and the pipeline."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import embeddings, mixing, queries, urls, wrapper
from test_documents import plain_classes

RULES = queries.URL_RULES


def verdicts(spark, rows, labelled=()):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(rows)],
                                  "page_id long, url string, host string, tokens string, rule string")
    marks = spark.createDataFrame(list(labelled), "url string, block boolean")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in
            sorted(urls.judge_urls(pages, marks, RULES).collect(), key=lambda r: r["page_id"])]


def test_listed_rules(spark):
    got = verdicts(spark, ["http://A.Example.org/es/1", "https://example.org/en/12?x#y", "http://notexample.org",
                           "http://x.com/fr/", "http://com/de/1", "http://x.com/en/", None, "no scheme", "http://",
                           "a://b://c/d", "http://Ä.org/", "http://h?/x", "http://org/"])
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow"),
        ("com", "/de/1", "com/de/", "block"), ("x.com", "/en/", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("Ä.org", "/", "org/", "allow"), ("h", "", None, "allow"), ("org", "/", "org/", "allow")]


def test_mined_rules_block_token_combinations(spark):
    labelled = [(f"http://shop.net/win/{i}", True) for i in range(60)] + [(f"http://shop.net/{i}", False) for i in range(90)]
    labelled += [(f"http://win.net/{i}", False) for i in range(60)] + [(None, True), ("http://x.net", None)]
    got = verdicts(spark, ["http://shop.net/win/999", "http://shop.net/5", "http://win.net/1", "http://shop.org/win/1"], labelled)
    assert [v for *_, v in got] == ["block", "allow", "allow", "allow"]


def test_long_url_words_stay_apart(spark):
    same = "a" * 70
    rows = spark.createDataFrame([(f"http://x.org/{same}b",), (f"http://x.org/{same}c",), (f"http://x.org/{same}b?{'q' * 64}",),
                                  ("http://x.org/" + "long" * 30_000,), (None,)], "url string")
    got = [r["t"] for r in rows.select(urls.url_tokens(F.col("url")).alias("t")).collect()]
    assert got[0] != got[1] and set(got[0]) < set(got[2]) and "q:" + "q" * 64 in got[2]
    assert all(len(t) <= 67 for ts in got if ts for t in ts) and not got[4]


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"http://{rng.choice('abc')}.net/{rng.choice('pq')}/{rng.choice('xyz')}", rng.random()) for _ in range(600)]
    rows = [(u, (p < 0.9) if "a.net/p" in u else p < 0.1) for u, p in rows]
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, block boolean"), 0.01, 0.5, 0.0).collect()
    tokens = {r["url"]: frozenset(r["t"]) for r in spark.createDataFrame(rows, "url string, block boolean").distinct()
              .select("url", urls.url_tokens(F.col("url")).alias("t")).collect()}
    share = sum(b for _, b in rows) / len(rows)
    for r in mined:
        hit = [b for u, b in rows if set(r["tokens"]) <= tokens[u]]
        assert sum(hit) / len(hit) == pytest.approx(r["confidence"]) and r["confidence"] >= max(0.5, share)
        assert sum(hit) / len(rows) == pytest.approx(r["support"])
    assert any(set(r["tokens"]) == {"h:a", "p:p"} for r in mined)


def test_a_rare_bad_host_is_mined(spark):
    """25 blocked pages of one host among 20,000: far below the share that FP-growth takes."""
    rows = [(f"http://good{'abcdefghij'[i % 10]}.net/{'pqrs'[i % 4]}", i % 50 == 0) for i in range(20_000)]
    rows += [("http://rarebad.net/p", True)] * 25 + [("http://fewbad.net/p", True)] * 19
    rows += [("http://half.net/p", i % 5 == 0) for i in range(100)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    mined = {tuple(r["tokens"]): r for r in urls.mine_rules(labelled).collect()}
    assert list(mined) == [("h:rarebad",)] and mined[("h:rarebad",)]["anchor"] == "h:rarebad"
    assert mined[("h:rarebad",)]["confidence"] == 1 and mined[("h:rarebad",)]["support"] == pytest.approx(25 / len(rows))
    got = verdicts(spark, ["http://www.rarebad.net/x", "http://fewbad.net/p", "http://half.net/p", "http://gooda.net/p"], rows)
    assert [v for *_, v in got] == ["block", "allow", "allow", "allow"]


def test_chance_makes_no_rare_rules(spark):
    """2,000 hosts of 100 pages, each page blocked by chance of 0.3: no host is."""
    rng = random.Random(8)
    name = [a + b + c for a in "abcdefghijklmn" for b in "abcdefghijkl" for c in "abcdefghijkl"][:2000]
    rows = [(f"http://{host}.net/", rng.random() < 0.3) for host in name for _ in range(100)]
    mined = urls.mine_rules(spark.createDataFrame(rows, "url string, block boolean"), min_confidence=0.3)
    assert mined.count() == 0


def test_verdicts_match_all_rules(spark):
    """Every url's verdict against all mined rules, tried one by one; long and repeated urls and ties among them."""
    rng = random.Random(5)
    made = [f"http://{rng.choice('abcd')}.net/{rng.choice('pq')}/{rng.choice('xyz')}" for _ in range(800)]
    labelled = [(u, rng.random() < (0.95 if "a.net/p" in u or "/z" in u else 0.1)) for u in made]
    rules = urls.mine_rules(spark.createDataFrame(labelled, "url string, block boolean")).collect()
    pages = made[:100] + made[:5] + ["http://a.net/p/" + "y" * 50_000, "http://c.net/z?" + "z/" * 20_000, None, "nothing"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    tokens = {r["page_id"]: set(r["t"] or []) for r in table.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    got = urls.judge_urls(table, spark.createDataFrame(labelled, "url string, block boolean"), []).collect()
    assert len(got) == len(pages) and len(rules) > 3
    for r in got:
        fits = [(x["confidence"], x["support"], x["tokens"]) for x in rules if set(x["tokens"]) <= tokens[r["page_id"]]]
        assert r["verdict"] == ("block" if fits else "allow") and r["matched"] == (max(fits)[2] if fits else None)


def test_urls_empty(spark):
    assert verdicts(spark, []) == []


def page(i, body):
    return (f"<html><head><title>t{i}</title><script>var a='<p>{i}</p>';</script></head><body>"
            f"<div class='top-nav'><a href='/'>Home</a> <a>About</a></div><div id=wrap><div class=side><p>Related {i}</p></div>"
            f"<div class=post>{body}</div></div><p>Copyright acme</p></body></html>")


def test_template_goes_and_content_stays(spark):
    rows = [(i, "http://h.net/" + str(i), page(i, f"<h2>Title {i}</h2><p>First&nbsp;line {i}<b>bold</b> &amp; more"
                                                  f"<p>Second {'word ' * 30}{i}<br>end<form>Ask</form>"
                                                  "<p>Sign up today</p><div class='comments'>Nice</div>"))
            for i in range(12)]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r for r in wrapper.main_text(pages).collect()}
    for i in range(12):
        want = f"Title {i} First line {i}bold & more Second {'word ' * 30}{i} end"
        assert got[i]["text"].startswith(want) and "Home" not in got[i]["text"] and "Nice" not in got[i]["text"]
        assert "Copyright" not in got[i]["text"] and "Ask" not in got[i]["text"] and got[i]["n_chars"] == len(got[i]["text"])


def test_articles_of_the_tables(spark):
    """The article of every page is its heading and the text of the document it shows."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    number = F.regexp_extract("url", r"://[^/]*/[a-z]+/([0-9]+)", 1).cast("long")
    for r in wrapper.main_text(pages).withColumn("n", number).collect():
        assert r["text"].endswith(docs[r["n"]]) and len(r["text"]) <= len(docs[r["n"]]) + 70


NOTICE = "This site is run by Example Org, all rights kept."


def story(i, layout=0):
    inner = (f"<h2>Title {i}</h2><p>First {i} by <b>Ann</b></p><p>Second {i * 7}</p><div class='share-price-story'>Shares at {i}</div>"
             f"<p>Third {i}</p><p>{NOTICE}</p>")
    if layout:
        return f"<html><body><section class=paper><div>{NOTICE}</div><div class=story>{inner}</div><div>Call us now</div></section></body></html>"
    return (f"<html><body><div class=top>Acme portal</div><div class=post>{inner}<div class=foo>Kept by Acme</div></div>"
            f"<p>Legal text</p></body></html>")


def page_text(spark, rows, **params):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in wrapper.main_text(pages, **params).collect()}


def test_constant_blocks_go_and_class_words_inside_names_stay(spark):
    want = {i: f"Title {i} First {i} by Ann Second {i * 7} Shares at {i} Third {i}" for i in range(40)}
    assert page_text(spark, [(i, f"http://h.net/{i}", story(i)) for i in range(8)]) == {i: want[i] for i in range(8)}
    # two layouts, the rarer one on a quarter of the host; and the host dealt into many parts
    rows = [(i, f"http://h.net/{i}", story(i, i % 4 == 0)) for i in range(40)]
    assert page_text(spark, rows) == want == page_text(spark, rows, part=1500)


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.net/{i}", story(min(i, 4))) for i in range(40)]
    got = page_text(spark, rows)
    assert all(got[i] == f"Title {min(i, 4)} First {min(i, 4)} by Ann Second {min(i, 4) * 7} Shares at {min(i, 4)} Third {min(i, 4)}"
               for i in got)


@pytest.mark.parametrize("name,noise", [("share-price-story", False), ("promotion law", True), ("site-header", True), ("ad", True),
                                        ("reader", False), ("comment-list", True), ("cookie-recipe", False), ("related links", True)])
def test_names_of_noise(name, noise):
    assert wrapper.names_noise(name) is noise


def walk(fold):
    return [fold] + [x for kid in fold.kids for x in walk(kid)]


def test_template_matches_all_pairs(spark):
    """Text in a node is template where, aligned with every other page of its host, most show the same."""
    rng = random.Random(7)
    pages = []
    for i in range(14):
        blocks = ["<h1>Head</h1>" if rng.random() < 0.9 else "<h1>Head {i}</h1>"]
        blocks += [f"<p>words {rng.random()}</p>" for _ in range(rng.randint(1, 4))]
        blocks += ["<div class=x>Fixed</div>"] * (rng.random() < 0.9) + ["<ul><li>a</li></ul>"] * (rng.random() < 0.2)
        pages.append("<body><div class=c>" + "".join(blocks).replace("{i}", str(i)) + "<div class=z>Bye</div></div></body>")
    pages = sorted(set(pages))
    folds = [wrapper.Fold([wrapper.parse(p)], "#root") for p in pages]
    shown = []
    for i, a in enumerate(folds):
        votes, seen = {}, {}
        for b in folds:
            for x, y in wrapper.match(a, b)[1]:
                if not x.kids:
                    seen[id(x)] = seen.get(id(x), 0) + 1
                    votes[id(x)] = votes.get(id(x), 0) + (x.text() == y.text())
        leaves = [x for x in walk(a) if not x.kids]
        kept = [x.text() for x in leaves if not (votes[id(x)] >= 3 and 2 * votes[id(x)] > seen[id(x)] and 2 * seen[id(x)] > len(folds))]
        shown.append(" ".join(t for t in kept if t))
    got = page_text(spark, [(i, f"http://h.net/{i}", p) for i, p in enumerate(pages)])
    assert [got[i] for i in range(len(pages))] == shown


def test_pages_odd_input(spark):
    rows = [(1, None, None), (2, "http://a.net/1", ""), (3, "http://a.net/2", "<p>open <b>tags"), (4, None, "plain < text &lt;b>"),
            (5, "x", "<!-- never closed"), (6, "http://b.net", "<div>" * 3000 + "deep" + "</div>" * 10),
            (7, "http://b.net", "<script>x"), (8, "http://c.net", "<p>" + "long " * 100_000), (8, "http://c.net", "<p>" + "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(pages).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "open tags" and got[4] == "plain < text <b>" and got[5] == ""
    assert got[6] == "deep" and got[7] == "" and got[8] == ("long " * 100_000).strip()
    assert wrapper.main_text(pages.limit(0)).count() == 0


def test_vectors_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        v = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append([x + rng.gauss(0, rng.choice([0, 0.05, 0.3])) for x in v])
    rows = [(i, v, 1) for i, v in enumerate(rows)]
    rows += [(5000, [1e300, 0.0, 1e300], 1), (5001, [1e-300, 0.0, 1e-300], 1), (5002, [-1.0, 0.0, -1.0], 1)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1),
             (9004, [float("inf")] * 16, 1), (9005, [1.0, None, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    cos = lambda a, b: (sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)))
    good = [(i, [x * (1e-300 if i == 5000 else 1e300 if i == 5001 else 1) for x in v]) for i, v, _ in rows if i < 9000]
    links = {i: [] for i, *_ in rows}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and cos(a, b) >= 0.95:
                links[i].append(j)
    comp = {i: i for i in links}
    for _ in comp:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    for block in (embeddings.BLOCK, 20):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
               embeddings.near_vectors(df, 0.95, block=block).collect()}
        assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in comp}


def test_vectors_odd_input(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:] = x[:100] + rng.normal(scale=0.05, size=(100, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embeddings.quantise(x)
    for t in (0.5, 0.9, 0.95):
        i, j = embeddings.tile_pairs(q, q, t)
        assert set(zip(*np.nonzero(x @ x.T >= t))) <= set(zip(i, j))


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf), "test")
        out[name] = docs
    a, b, c, d, e = out.values()
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(x.columns == names for x in (a, b, c, d)) and e.columns == [*names, "shard", "slot"]
    rows = [{r["doc_id"]: r for r in x.collect()} for x in (spark.read.parquet(f"{sf}/documents.parquet"), a, b, c)]
    # language: only texts without letters go, every table text has some
    assert set(rows[1]) == {d for d, r in rows[0].items() if any(ch.isalpha() for ch in r["text"] or "")}
    # near duplicates: the smallest id of each class of a plain comparison of all pairs
    assert set(rows[2]) == set(plain_classes({d: r["text"] for d, r in rows[1].items()}).values())
    # benchmark: no item is left word for word, and little else goes
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, r in rows[2].items() if any(i in flat(r["text"]) for i in items)}
    assert leaked and not leaked & set(rows[3]) and len(rows[2]) - len(leaked) - len(rows[3]) <= 2
    # mix: as many copies as the sampling says; shards: bytes cut at equal targets
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(c).collect()}
    told = collections.Counter(r["doc_id"] for r in d.collect())
    assert told == collections.Counter({k: n for k, n in copies.items() if n})
    cut = e.orderBy("doc_id", "shard", "slot").collect()
    total, at = sum(len(r["text"].encode()) + 8 for r in cut), 0
    for r in cut:
        size = len(r["text"].encode()) + 8
        assert r["shard"] == min(23, (2 * at + size) * 24 // (2 * total))
        at += size
    assert len(cut) == sum(told.values())
