"""Small cases of the training-data operators against brute force: nulls, ties, copies, long and empty texts."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocabulon.llm import annsearch, boosting, components, dom, extraction, mixing, neardup, packing, pii, quality, secretscan, substrings, textkernel, urls
from vocabulon.llm.ship import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def base_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


def corpus():
    a, b, c = base_text(1, 120), base_text(2, 90), base_text(3, 200)
    near = a.split()
    near[7] = "CHANGED"
    texts = {
        1: a, 2: " ".join(near), 3: a, 4: b, 5: b.upper(), 6: f"{c}\n{a[:300]}", 7: None, 8: "", 9: "one", 10: "one", 11: "ONE two", 12: "x\u00a0y z\u3000w", 13: c[:400] + " " + base_text(9, 60),
        14: base_text(4, 10) + " " + " ".join(b.split()[10:75]), 15: " \t\n ", 16: "é " * 30, 17: base_text(5, 3000),
    }
    return [(k, v, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(v or "")) for k, v in texts.items()]


@pytest.fixture(scope="module")
def docs(sp):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return sp.createDataFrame([*rows, rows[0]], schema).repartition(3)  # one row is there twice


def empty(docs):
    return docs.where("false")


# --- primitives -----------------------------------------------------------------------------------


def test_words_and_hashes_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()] + ["a\x0bb\x1cc", "\ud7ff \U0001f600x"]
    got, seen = [], {}
    for lo, hi, w in textkernel.slices(pa.array(texts), 50):
        h = w.hashes()
        for i in range(hi - lo):
            own = [bytes(w.buf[s:e]).decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            got.append(own)
            for word, x in zip(own, h[w.first[i] : w.first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(word, x) == x
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_and_stars(sp):
    edges = [(i + 1, i) for i in range(20, 40)] + [(50, 60 + i) for i in range(5)] + [(3, 3)]
    got = {r["node"]: r["root"] for r in components.components(sp.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 20 for i in range(20, 41)} | {i: 50 for i in [50, *range(60, 65)]}


# --- 1 --------------------------------------------------------------------------------------------


def test_extraction_of_a_layout_it_was_not_fitted_on(sp):
    html = (
        '<html><head><title>t</title></head><body><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div><main><article><h1>A  title &amp; more</h1>'
        + "".join(f"<p>Paragraph {i} of the article says a number of things, in <b>plain</b> words,\n and then ends. It says more.</p>" for i in range(5))
        + '<script>var x = "<p>no</p>";</script></article></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>'
        '<section id="comments"><div class="comment"><p>I liked this a lot, thank you for it.</p></div></section><footer>&copy; Site</footer></body>'
    )
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (4, "u", "<p>cut <!-- off"), (1, "u", html)]
    got = extraction.extracted(sp.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = next(r["text"] for r in got if r["page_id"] == 1)
    assert text.startswith("A title & more Paragraph 0 of") and text.count("Paragraph") == 5 and text.endswith("It says more.")
    assert not re.search("cookies|Home|Other|liked|Site|no<", text)
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (2, 3)] == [("", 0), ("", 0)] and len(got) == 5
    assert extraction.extracted(sp.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unclosed_silent_elements_leave_the_page():
    runs = lambda html: " ".join(t for t in dom.parse(html).text if t)
    for name in "button select svg canvas noscript audio video datalist template".split():
        assert runs(f"<p>a</p><{name} id=x><p>b</p>") == "a b" and runs(f"<p>a<{name}>no</{name}> c</p><{name}><p>b</p>") == "a c b"
    for name in "script style textarea iframe xmp".split():
        assert runs(f"<p>a</p><{name}><p>b</p>") == "a"
    for name in "math object map".split():
        assert runs(f"<p>a <{name}>x + 1</{name}> b</p>") == "a x + 1 b"
    assert runs("<p>a</p>" + "<button>" * 50_000 + "b").endswith("b")  # one search for an end that isn't there


def test_extraction_on_held_out_pages():
    trees, right, wrong, missed = extraction.model(), 0, 0, 0
    for source in extraction.generated(60, 4242):
        page, label = extraction.labelled(source)
        kept = extraction.decode(page.parent, trees.score(dom.features(page)))
        for t, want, got in zip(page.text, label, kept, strict=True):
            if t:
                right, wrong, missed = right + (want and got), wrong + (got and not want), missed + (want and not got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_decoding_is_the_best_consistent_labelling():
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(20):
        parent = [-1, *[int(rng.integers(0, i)) for i in range(1, 8)]]
        odds = rng.normal(size=8)
        kept = extraction.decode(parent, odds)
        assert all(kept[parent[i]] or not kept[i] for i in range(1, 8))
        best = max(sum(o for o, y in zip(odds[1:], ys, strict=True) if y) for ys in product((0, 1), repeat=7) if all(not ys[i - 1] or parent[i] == 0 or ys[parent[i] - 1] for i in range(1, 8)))
        assert sum(odds[1:][kept[1:]]) == pytest.approx(best)


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosting.fit(x, y).score(x) > 0) == (y > 0)).mean() > 0.95


def test_silent_elements_end_with_their_parent_and_nest():
    texts = lambda h: [t for t in dom.parse(h).text if t]
    assert texts("<p>one two</p><button>Go<p>three four five</p><p>six</p>") == ["one two", "Go", "three four five", "six"]
    assert texts("<svg><svg></svg>X</svg> y") == ["y"] and texts("a <svg> b <p>c</p>") == ["a b", "c"]
    assert texts("<div><button>Go</div><p>three</p><button>ok</button>") == ["three"]
    assert texts("<p>a<button>x<button>y</button>b</p>") == ["ab"] and texts("<noscript><p>z</p></noscript>t") == ["t"]


@pytest.mark.parametrize("make", ["<div>{}x", "<li>{}x", "<div>{}<li></li>", "<svg>{}x", "<tr><div>{}x", "<td><p>{}</table>", "<button>{}x</div>", "x<svg></svg>{}", "<b></i>{}</p>"])
def test_deep_pages_take_linear_time(make):
    import time

    first, last = make.split("{}")
    began = time.perf_counter()
    page = dom.parse(first * 30_000 + last * 30_000)
    dom.features(page) if len(page.parent) < 40_000 else None
    assert time.perf_counter() - began < 8


# --- 2 --------------------------------------------------------------------------------------------


def brute_features(t):
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(cover)


def test_quality_figures(sp, docs):
    more = sp.createDataFrame([(20, "a | b\n\na | b\n  a | b\n" * 6, "en", "s", 1), (21, "p q r s t u v w " * 3 + "x", "en", "s", 1)], docs.schema)
    got = quality.with_features(docs.unionByName(more), {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(got) == docs.count() + 2
    assert all(tuple(r[k] for k in quality.FEATURES) == brute_features(r["text"] or "") for r in got)


def test_exact_binomial_tail():
    from math import comb

    for n, p in ((10, 0.3), (50, 0.03), (200, 0.5)):
        for k in range(0, n, 7):
            assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_levels_keep_their_promise():
    good, bad = np.zeros(17), np.zeros(17)
    good[16], bad[3] = 300, 50
    assert quality.choose_level(good, bad, 1, 0.03, 0.05) == 4  # nothing good is lost, all bad is caught
    good[3] = 50
    assert quality.choose_level(good, bad, 1, 0.03, 0.05) == 0  # it would cost a seventh of the good
    assert quality.choose_level(good * 0 + (np.arange(17) == 16) * 20, bad, 1, 0.03, 0.05) == 0  # too few labels to tell


def test_quality_verdicts_with_and_without_labels(sp, docs):
    labels = sp.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == docs.count() and all(r["kept"] != r["base_failed"] for r in got)
    assert all(r["base_failed"] for r in got if r["doc_id"] in (7, 8, 9, 15))
    assert quality.judged(empty(docs), labels.where("false")).count() == 0
    kept = quality.passing(docs.withColumn("n_words", F.lit("mine")), labels)  # an extra column with a clashing name
    assert kept.columns == [*docs.columns, "n_words"] and {r["n_words"] for r in kept.collect()} == {"mine"}


def test_a_proven_threshold_rejects(sp):
    words = lambda i, n, mark="": " ".join(f"w{i}x{j}{mark}" for j in range(n))
    clean = [(i, words(i, 40), "en") for i in range(400)]
    junk = [(1000 + i, words(1000 + i, 40, "##"), "en") for i in range(100)]
    other = [(2000 + i, words(2000 + i, 40), "de") for i in range(20)] + [(2100, words(2100, 40, "##"), "de")]
    copies = [(3000 + i, words(3000, 40, "##"), "fr") for i in range(400)]  # 400 rows, one trial: nothing is proven
    docs = sp.createDataFrame(clean + junk + other + copies, "doc_id long, text string, lang string")
    truth = [(i, 1) for i, _, _ in clean + other + copies] + [(i, 0) for i, _, _ in junk]
    labels = sp.createDataFrame(truth + truth[:50], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    assert all(got[i] for i, _, _ in clean + other + copies) and not any(got[i] for i, _, _ in junk)
    assert {r["doc_id"] for r in quality.passing(docs, labels).collect()} == {i for i, k in got.items() if k}
    levels = {r["stratum"]: r["level"] for r in quality.calibrate(quality.with_features(docs, quality.trial_row()), labels).collect()}
    assert levels["en"] > 0 and levels["de"] == levels["fr"] == 0


# --- 3 --------------------------------------------------------------------------------------------


def test_url_rules(sp):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block")]
    pages = {
        1: ("http://A.B.NET/x?y=/en/", "a.b.net", "/x", "net/", "block"), 2: ("https://m.example.net/en/a#b", "m.example.net", "/en/a", "example.net/en/", "allow"),
        3: ("http://x.net?q", "x.net", "", None, "allow"), 4: ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), 5: ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        6: ("ftp://a.org/fr/", "a.org", "/fr/", "org/fr/", "block"), 7: (None, "", "", None, "allow"), 8: ("no scheme.net/", "", "", None, "allow"), 9: ("http://net/", "net", "/", "net/", "block"), 10: ("x://y://z.net/", "y:", "//z.net/", None, "allow"),
    }
    df = sp.createDataFrame([(k, v[0]) for k, v in pages.items()] + [(1, pages[1][0])], "page_id long, url string")
    listed = sp.createDataFrame(rules, "host string, path string, action string")
    got = urls.verdicts(df, listed).collect()
    assert len(got) == 11 and all(tuple(r)[1:] == pages[r["page_id"]][1:] for r in got)
    assert {r["verdict"] for r in urls.verdicts(df, listed.where("false")).collect()} == {"allow"}
    assert urls.verdicts(df.where("false"), listed).count() == 0


def test_bloom_filter_has_no_false_misses(sp):
    from vocabulon.llm import bloom

    keys = sp.range(3000).withColumn("k", F.concat(F.lit("key"), F.col("id").cast("string")))
    assert bloom.filtered(keys, "k", keys, "k", 3000).count() == 3000
    others = sp.range(3000).withColumn("k", F.concat(F.lit("other"), F.col("id").cast("string")))
    assert bloom.filtered(others, "k", keys, "k", 3000).count() < 150


# --- 4 --------------------------------------------------------------------------------------------


def test_substrings_against_brute_force(sp, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, corpus()[0][1])]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    got = substrings.deduplicated(df).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    spans = {}
    for i, t in df.collect():
        if i is not None:
            for n in (50, 100, 200, 400):
                w = WORD.findall(t or "")
                for k in range(len(w) - n + 1):
                    spans.setdefault((n, tuple(w[k : k + n])), set()).add(i)
    level = Counter()
    for (n, _), ids in spans.items():
        for i in ids if len(ids) > 1 else ():
            level[i] = max(level[i], n)
    # of rows that share an id, those without the passage have a lower level
    assert {i: max(r["level"] for r in got if r["doc_id"] == i) for i in {r["doc_id"] for r in got if r["doc_id"] is not None}} == {r["doc_id"]: level[r["doc_id"]] for r in got if r["doc_id"] is not None}
    assert sum(k[2] for k in want) > 200
    assert substrings.deduplicated(df.where("false")).count() == 0


# --- 5 --------------------------------------------------------------------------------------------


def brute_components(rows, words):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_brute_force(sp, docs, words):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = np.random.default_rng(words)
    for g in range(12):  # groups around the threshold, of small and large sets
        text = base_text(100 + g, int(rng.integers(3, 150))).split()
        for c in range(6):
            own = list(text)
            for _ in range(int(rng.integers(0, 1 + len(own) // 12))):
                own[int(rng.integers(len(own)))] = f"w{g}{c}{rng.integers(1000)}"
            rows[1000 + 10 * g + c] = " ".join(own)
    df = sp.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, words).collect()}
    assert got == brute_components(rows.items(), words)


def test_contained_texts_link_at_the_threshold(sp):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(300):  # each text and its first four fifths or a little more
        text = base_text(1000 + g, int(rng.integers(94, 205))).split()
        part = int(np.ceil((len(text) - 4) * rng.uniform(0.80, 0.83))) + 4
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(text[:part]))]
    df = sp.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows, 5)
    assert all(got[2 * g + 1][1] == 2 * g for g in range(300))


def test_one_of_each_group_stays(sp, docs):
    kept = neardup.first_of_each(docs.dropDuplicates(["doc_id"]).withColumn("n", F.lit(1)))
    ids = {r["doc_id"] for r in kept.collect()}
    assert 1 in ids and not {2, 3, 5, 10} & ids and {7, 8, 15} <= ids and "n" in kept.columns
    assert neardup.near_duplicates(empty(docs)).count() == 0


def test_rows_that_share_an_id(sp):
    a, b = base_text(31, 60), base_text(32, 60)
    df = sp.createDataFrame([(3, a), (5, a), (5, b), (9, b), (11, None), (11, None), (None, a), (None, base_text(33, 40))], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).orderBy("doc_id").collect()]
    assert Counter(got) == Counter({(3, 3): 1, (5, 3): 2, (9, 3): 1, (11, 11): 2, (None, None): 2})
    kept = neardup.first_of_each(df.unionByName(df.where("doc_id = 9")).withColumn("_key", F.lit("mine")).withColumn("rows", F.lit(1)))
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert rows == sorted([(3, a), (5, b), (11, None), (None, base_text(33, 40))], key=str)  # no text is gone, none is there twice
    assert kept.columns == ["doc_id", "text", "_key", "rows"]


def test_a_group_around_the_threshold_makes_few_pairs(sp):
    rng = np.random.default_rng(12)
    base, rows = base_text(50, 150).split(), []
    for i in range(700):  # from a few to many changed words: some link with the middle of the group, others with nothing
        own = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 14))):
            own[int(k)] = f"w{i}x{k}"
        rows.append((i, " ".join(own)))
    df = sp.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2).collect()}
    assert got == brute_components(rows, 2)
    assert 20 < len({c for _, c in got.values()}) < 700


# --- 6 --------------------------------------------------------------------------------------------


def test_vector_search(sp):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[100:200] = x[100]  # a hundred equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [float("inf")] * 16)]
    df = sp.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in annsearch.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = x.astype(np.float32).astype(float)
    found = 0
    for q in range(0, 600, 20):
        score = x @ x[q]
        score[q] = -np.inf
        true = np.lexsort((np.arange(600), -score))[:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in got[q])
        found += len({i for i, _ in got[q]} & set(true.tolist()))
    assert set(got) == set(range(0, 600, 20)) and found / 600 >= 0.9
    assert [i for i, _ in got[120]] == [*range(100, 120)]  # ties to the smaller id
    few = df.where("vec_id < 5 or vec_id > 999")
    assert annsearch.search(few, few.where("vec_id = 0")).count() == 4
    assert annsearch.search(df.where("false"), df).count() == 0


def test_queries_that_meet_too_few_rows_are_answered_exactly(sp):
    x = np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32).astype(float)
    df = sp.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<float>, query_id string")
    h = annsearch.Hashing(8, 6, 2, 0.3, float(np.linalg.norm(x, axis=1).max()))  # cells far too small
    got = defaultdict(list)
    for r in annsearch.search(df, df.where("vec_id % 50 = 0"), 5, h).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        assert found == np.lexsort((np.arange(300), -score))[:5].tolist()
    assert len(got) == 6


def clustered(n, d, seed=0):
    """Rows around 200 centers, of norms that differ."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((200, d))[rng.integers(0, 200, n)] + 0.25 * rng.standard_normal((n, d))
    return (x * rng.lognormal(0, 0.3, (n, 1))).astype(np.float32).astype(float)


def test_the_index_prunes_clustered_rows(sp):
    """Of 100,000 clustered rows of many norms a query visits less than 0.3, and nine tenths of all nearest are found."""
    import pandas as pd

    x = clustered(100_000, 32)
    df = sp.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(8)
    h = annsearch.fit(annsearch.clean(df), 20)
    asked = df.where("vec_id % 2500 = 0")
    near = defaultdict(list)
    for r in annsearch.search(df, asked, 20, h).collect():
        near[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q, ids in near.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argpartition(-score, 20)[:20].tolist()) & set(ids))
    visited = 0
    for t in range(h.tables):
        names, counts = np.unique(h.index(x, t), return_counts=True)
        for cells in h.probe(x[sorted(near)], t):
            at = np.minimum(np.searchsorted(names, cells), len(names) - 1)
            visited += counts[at][names[at] == cells].sum()
    assert len(near) == 40 and all(len(ids) == 20 for ids in near.values())
    assert hits / 800 >= 0.9 and visited / (40 * len(x)) < 0.3, (hits / 800, visited / (40 * len(x)))


def test_rows_of_the_querys_own_id_take_no_place():
    x = np.arange(1.0, 41.0)[::-1, None] * np.ones((1, 2))
    ids = np.concatenate((np.zeros(10, np.int64), np.arange(1, 31)))
    near, score = annsearch.nearest(np.ones((1, 2)), np.array([0]), x, ids, 5)[0]
    assert near.tolist() == [1, 2, 3, 4, 5] and score.tolist() == [60, 58, 56, 54, 52]
    assert [len(a) for a, _ in annsearch.nearest(np.ones((1, 2)), np.array([0]), x[:12], ids[:12], 5)] == [2]


# --- 7 --------------------------------------------------------------------------------------------


def test_secrets_and_their_ledger(sp):
    key, run = "AKIA" + "A" * 16, "0123456789abcdef01234567"
    texts = {1: f'Password: "hunter22" {key} {run}', 2: "token=abc, api_key = 'x.y=z/1' \u017fecret=abcdef", 3: None, 4: f"{run}9 pass {key[:19]}", 5: f'Password: "hunter22" {key} {run}', 6: ""}
    df = sp.createDataFrame([*texts.items(), (4, texts[4])], "doc_id long, text string")
    ledger = secretscan.scan_unseen(df)
    assert ledger.count() == 4  # equal texts are scanned once, null as the empty one
    got = {r["doc_id"]: r for r in secretscan.digest(secretscan.findings(secretscan.addressed(df), ledger)).collect()}
    assert {k: (r["n_assign"], r["n_access"], r["n_hex"]) for k, r in got.items()} == {1: (1, 1, 1), 2: (1, 0, 0), 3: (0, 0, 0), 4: (0, 0, 1), 5: (1, 1, 1), 6: (0, 0, 0)}
    assert got[1]["spans"] == "assign:0:19,access:21:41,hex:42:66"
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert secretscan.scan_unseen(df, ledger).count() == 0
    grown = df.unionByName(sp.createDataFrame([(9, "new secret=abcdefg")], df.schema))
    new = secretscan.scan_unseen(grown, ledger)
    assert new.count() == 1 and secretscan.findings(secretscan.addressed(grown), ledger.unionByName(new)).count() == 8


def brute_secrets(text):
    from vocabulon.llm.secretscan import BASE, KINDS

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)), [sum(k == x for _, k, _ in out) for x in range(BASE)]


def test_a_ledger_at_a_path_is_scanned_into_once(sp, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    df = lambda *texts: sp.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    key = "token = abcdef123456"
    assert secretscan.ledger_at(sp, path) is None
    assert secretscan.scan_into(df(key, key, "clean", None), path).count() == 3
    assert secretscan.scan_into(df("clean", key, "new one", ""), path).count() == 1  # what earlier runs have seen is not scanned again
    ledger = secretscan.ledger_at(sp, path)
    assert ledger.count() == 4
    every = df(key, "new one", "new one")
    found = {r["doc_id"]: len(r["findings"]) for r in secretscan.findings(secretscan.addressed(every), ledger).collect()}
    assert found == {0: 1, 1: 0, 2: 0}
    monkeypatch.setattr(secretscan, "RULE_VERSION", secretscan.RULE_VERSION + 1)
    assert secretscan.scan_into(df(key, "clean"), path).count() == 2  # new rules scan everything anew


def test_base_secrets_against_brute_force(sp):
    rng = np.random.default_rng(4)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCD1234EFGH5678", "0a1b2c3d4e5f", "deadbeef", "x", "é", "\n", "abcdef", "+/", "-"]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 60))))) for i in range(600)]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    ledger = secretscan.scan_unseen(df)
    texts = dict(rows)
    for r in secretscan.digest(secretscan.findings(secretscan.addressed(df), ledger)).collect():
        spans, counts = brute_secrets(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


@pytest.mark.parametrize("text", ["eyJaaaaaaaa-" * 80_000, "-----BEGIN " + "A" * 500_000 + "-----BEGIN " * 40_000, "token" * 200_000, "a point" + " " * 1_000_000 + "b", "( at" + " " * 500_000 + " at" * 100_000, "mail " * 200_000])
def test_long_runs_take_linear_time(text):
    import time

    began = time.perf_counter()
    secretscan.spans_of(text)
    pii.spans_of(text)
    assert time.perf_counter() - began < 8


# --- 8 --------------------------------------------------------------------------------------------


def water(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    cut, total = set(), sum(sizes.values())
    while True:
        rest, open_ = total - sum(3 * sizes[n] for n in cut), [n for n in names if n not in cut]
        goal = {n: 3.0 * sizes[n] if n in cut else rest * weight[n] / sum(weight[m] for m in open_) for n in names}
        over = {n for n in open_ if goal[n] > 3 * sizes[n]}
        if not over:
            return goal
        cut |= over


def test_mixing_meets_targets(sp):
    rng = np.random.default_rng(0)
    rows = [(i, ["b", "a", None, "c", "tiny"][int(rng.choice(5, p=[0.4, 0.3, 0.1, 0.19, 0.01]))], int(rng.integers(0, 400))) for i in range(9000)]
    df = sp.createDataFrame([*rows, rows[5]], "doc_id long, source string, size long")
    got = mixing.per_row(mixing.taken(df)).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    goal = water(sizes)
    assert len(got) == 9001 and all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) for r in got)
    assert all(abs(taken[k] - goal[k]) <= max(60, 0.005 * goal[k]) for k in goal)
    again = mixing.per_row(mixing.taken(df.repartition(7))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 900, 500)
    x = mixing.flight(p, size, rng)
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert x.sum() == pytest.approx(p.sum(), abs=1e-5) and (x * size).sum() == pytest.approx((p * size).sum(), abs=1e-3)
    left = x[(x > 0) & (x < 1)]
    landed = np.array([mixing.landing(left, rng) for _ in range(4000)])
    assert set(np.unique(landed)) <= {0.0, 1.0} and np.abs(landed.sum(axis=1) - left.sum()).max() < 1
    assert landed.mean(axis=0) == pytest.approx(left, abs=0.04)
    drawn = np.mean([mixing.flight(np.full(4, 0.3), np.array([5, 50, 50, 900]), rng) for _ in range(4000)], axis=0)
    assert drawn == pytest.approx(np.full(4, 0.3), abs=0.04)


@pytest.mark.parametrize("n", [5, 500, 50_000])
def test_mixing_keeps_documents_and_tokens_of_each_source(sp, n):
    rng = np.random.default_rng(n)
    rows = [(i, f"s{i % 3}", int(s)) for i, s in enumerate(np.exp(rng.normal(5, 1, 3 * n)).astype(int) + 1)]
    got = mixing.taken(sp.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    for _, g in got.groupby("source"):
        rate = g["target"].iloc[0] / g["source_size"].iloc[0]
        copies = g["whole"] + g["extra"]
        short = np.sort(g["size"])[max(2, n // 10) if n > 5 else 4]
        assert abs(copies.sum() - rate * n) < 1 + 1e-6
        assert abs((copies * g["size"]).sum() - g["target"].iloc[0]) <= short + 1e-3


def test_mixing_takes_repeated_rows_as_often(sp):
    rows = [(i, "a", 10 + i) for i in range(40)] + [(7, "b", 30)] * 2500 + [(8, "b", 5)]
    got = mixing.per_row(mixing.taken(sp.createDataFrame(rows, "doc_id long, source string, size long"))).toPandas()
    assert len(got) == len(rows) and (got["doc_id"] == 7).sum() >= 2500
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= 45 and g["copies"].max() <= 3
    docs = sp.createDataFrame([(i, f"w{i} x y z", "a") for i in range(30)] + [(1007, "one two three", "b")] * 1200, "doc_id long, text string, source string")
    mix = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    sizes = {"a": 30 * 4 + 0, "b": 3600}
    goal = water(sizes)
    assert abs(3 * mix[1007] - goal["b"] - 12) <= 16


def test_mixed_documents_are_repeated_whole(sp, docs):
    mix = mixing.mixed(docs)
    n = Counter(r["doc_id"] for r in mix.collect())
    assert mix.columns == docs.columns and max(n.values()) <= 6 and not {7, 8, 15} & set(n)
    assert mixing.mixed(empty(docs)).count() == 0


# --- 9 --------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    path, t = tokenizer()
    plain = textkernel.hash_spans
    monkeypatch.setattr(textkernel, "hash_spans", lambda *a, **k: plain(*a, **k) & np.uint64(6))
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    texts = [f"{base_text(i, 30)} É{i} it's {'long' * i}er {'long' * i}es 日本{i}" for i in range(1, 20)]
    ids = packing.WordIds(path)
    for lo, hi, w in textkernel.slices(pa.array(texts)):
        out, bounds = ids.encode(w)
        for i in range(lo, hi):
            assert out[bounds[i - lo] : bounds[i - lo + 1]].tolist() == [*t.encode(texts[i], add_special_tokens=False).ids, 1]


def test_packing_round_trip(sp, docs):
    import zlib

    path, t = tokenizer()
    odd = ["It's <|endoftext|> ok's", "ΑΣ ΣΑΣ İx ǅ", "e\u0301 \u1e9b\u0323 ﬁ ½ x²", "a\u0085b \u2028c", "\U0001f600\U0001f600 नमस्ते 12345", "don'T 'S"]
    df = docs.unionByName(sp.createDataFrame([(100 + i, x, None, None, 0) for i, x in enumerate(odd)], docs.schema))
    got = packing.pack(packing.pieces(df, path)).collect()
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in df.collect()}
    seen, bins = Counter(), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(seen[k] == len(v) * (2 if k == 1 else 1) for k, v in ids.items())
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= 4096
    assert len(bins) == -(-sum(seen.values()) // 4096)
    assert packing.pack(packing.pieces(empty(docs), path)).count() == 0


def test_best_fit_is_tight():
    n = np.array([4096, 4000, 96, 2048, 2048, 1, 4095])
    bins = packing.best_fit(n)
    assert len(bins) == 4 and sorted(i for b in bins for i in b) == list(range(7))


def test_hash_table_finds_what_it_was_given():
    h = np.unique(textkernel.mix(np.arange(1, 200_001, dtype=np.uint64)))
    table = packing.HashTable()
    for lo in range(0, len(h), 30_000):
        part = h[lo : lo + 30_000]
        table.add(part, np.arange(lo, lo + len(part), dtype=np.int32))
    assert (table.find(h) == np.arange(len(h))).all() and (table.find(h + np.uint64(1)) == -1).mean() > 0.99


# --- 10 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "base", "every"),
    [
        ("mail a.b+c@x-y.co.uk, or", "email:5:20", "email:5:20"),
        ("to john [at] example [dot] com now", "", "email:3:30"),
        ("jane at mail dot example dot com.", "", "email:0:32"),
        ("j\u043ehn@ex\u0430mple.com", "", "email:0:16"),
        ("look at example.com, dot by dot", "", ""),
        ("1.2.3.4 256.1.1.1 1.2.3.4.5", "ip:0:7,ip:18:25", "ip:0:7,ip:18:25"),
        ("\uff11\uff12.0.0.1", "", "ip:0:8"),
        ("4111 1111 1111 1111 and 4111-1111-1111-1112", "card:0:19", "card:0:19"),
        ("+1 (555) 010-9999", "phone:0:17", "phone:0:17"),
        ("plus one five five five zero one zero nine nine nine nine ok", "", "phone:0:57"),
        ("a@b@c.de", "email:2:8", "email:2:8"),
        ("", "", ""),
    ],
)
def test_personal_data(text, base, every):
    got = pii.spans_of(text)
    assert (pii.joined(got[0]), pii.joined(got[1])) == (base, every)


@pytest.mark.parametrize(
    ("text", "every"),
    [
        *((f"{a} here", f"email:0:{len(a)}") for a in ("jan at firma dot pl", "ana at loja dot com dot br", "x at y dot se", "x at y dot ru", "x at y dot be", "x at y dot dev", "x@y dot pl", "x_at_y_dot_dk")),
        ("mail jan at firma.com now", "email:5:21"),
        ("write to jan at firma.co.uk.", "email:9:27"),
        ("contact us at firma.com", ""),
        ("we met at firma.com", ""),
        ("look at the dot is it moving", ""),
        ("point at the dot to see it", ""),
    ],
)
def test_spelled_addresses_of_all_countries(text, every):
    assert pii.joined(pii.spans_of(text)[1]) == every


@pytest.mark.parametrize("zero", [0x660, 0x6F0, 0x966, 0xFF10])
@pytest.mark.parametrize(("text", "kind"), [("+1 (555) 010-9999", "phone"), ("4111 1111 1111 1111", "card"), ("1.2.3.4", "ip")])
def test_digits_of_other_scripts(text, kind, zero):
    assert pii.joined(pii.spans_of(re.sub("[0-9]", lambda m: chr(zero + int(m[0])), text))[1]) == f"{kind}:0:{len(text)}"


def test_personal_data_against_the_patterns_on_random_texts():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("a1.@+ -90()b2"), int(rng.integers(0, 70))))
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 16 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 8 <= len(d) <= 15):
                    want.append((k, m.start(), m.end()))
        assert pii.find(t) == want
    assert pii.spans_of("9" * 200_000 + "x" * 200_000) == ([], [])  # long runs take linear time


def test_redaction_keeps_columns(sp, docs):
    df = docs.where("doc_id in (1, 7)").withColumn("text", F.when(F.col("doc_id") == 1, "see a@b.cd and +1 555 010 9999")).withColumn("doc", F.lit("x"))
    got = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert got[1]["text"] == "see [EMAIL] and [PHONE]" and got[1]["n_chars"] == 23 and got[1]["doc"] == "x" and got[7]["text"] is None
    out = pii.digests(df)
    assert out.count() == df.count() and pii.digests(empty(docs)).count() == 0


def templates(n, common, own, spread=0):
    """Texts of one template: ``common`` shared words and ``own`` (up to ``spread`` more) of their own."""
    head = " ".join(f"t{i}" for i in range(common))
    return [(i, head + " " + " ".join(f"d{i}x{j}" for j in range(own + (i % (spread + 1))))) for i in range(n)]


@pytest.mark.parametrize(("own", "spread"), [(30, 0), (36, 12)])
def test_a_template_below_the_threshold_costs_a_row_a_document_at_most(sp, own, spread):
    """170 words of 200 to 218 are common to all: each two are less than 0.8 alike, and no list of rare values may hold them all."""
    met = {}
    for n in (100, 400):
        docs = sp.createDataFrame(templates(n, 140, own, spread), "doc_id long, text string")
        texts = docs.select(F.col("doc_id").alias("cls"), F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("block"), "text")
        live = neardup._rare_posts(neardup._wide(texts, 2), 80)
        met[n] = sum(a.groupBy("v", "long", "short").count().join(b.groupBy("v", "long", "short").agg(F.count(F.lit(1)).alias("m")), ["v", "long", "short"]).agg(F.coalesce(F.sum(F.col("count") * F.col("m")), F.lit(0))).first()[0] for a, b in neardup._meetings(live))
    assert met[400] <= 8 * max(met[100], 400)


def test_template_groups_on_either_side_of_the_threshold(sp):
    """Sizes that differ: some of the pairs reach 0.8, by brute force, and all of these are found."""
    rows = templates(60, 140, 10, 40)
    docs = sp.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, words=2).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    root = {i: i for i, _ in rows}
    for i in root:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert got == root and 1 < len(set(root.values())) < 60
