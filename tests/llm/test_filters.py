"""Decontamination, URL rules and quality: brute force, planted rules, held-out labels."""

import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from quire.llm import decontaminate as D
from quire.llm import quality as Q
from quire.llm import urlrules as U

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        iw = words(t)
        for win in {tuple(iw[i : i + size]) for i in range(max(1, len(iw) - size + 1))} if iw else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_scan_equals_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice("ab c É é1 x".split()) for _ in range(r.randint(0, 7)))) for i in range(30)] + [(99, None), (100, "...")]
    docs = [(i, "".join(r.choice(["A", "b", "c", "é", "É1", "x", " ", ", ", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):  # one automaton, several
        got = {r.doc_id: (r.hits.n_words, sum(x["last"] - x["first"] + 1 for x in r.hits.runs), list(r.hits["items"])) for r in D.scan(df, bench, size=3, block_bytes=block).collect()}
        assert got == {i: brute(t, items, 3) for i, t in docs}
    assert {r.doc_id for r in D.clean(df, bench, 3).collect()} == {i for i, t in docs if not brute(t, items, 3)[1]}
    assert D.scan(df, bench.limit(0), 3).filter("size(hits.runs) > 0").count() == 0 and D.scan(df.limit(0), bench, 3).count() == 0


def test_spans_are_places_in_the_original(spark):
    df = spark.createDataFrame([(1, "Ünder!! The  QUICK—brown fox, jumps; over")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "quick—BROWN fox jumps")], "item_id long, text string")
    row = D.spans(D.scan(df, bench, size=3), "text").first()
    assert [row.text[s.start : s.end] for s in row.hit_spans] == ["QUICK—brown fox, jumps"]


RULES = [U.Rule("block", "com", "/en/"), U.Rule("allow", "example.com", "/en/7"), U.Rule("allow", "net", "/")]


def test_written_rules(spark):
    urls = ["http://A.Example.COM/en/71?x", "https://b.com/en/8#f", "https://com/en/", "http://xcom/en/1", "http://com.net/en/1", "http://example.com", None, "no scheme /en/", "http://:80/", "://net/a?b#c"]
    df = spark.createDataFrame([(i, u, "old", 5) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, RULES, []).collect()}
    assert got == {
        0: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("b.com", "/en/8", "com/en/", "block"), 2: ("com", "/en/", "com/en/", "block"), 3: ("xcom", "/en/1", None, "allow"), 4: ("com.net", "/en/1", "net/", "allow"),
        5: ("example.com", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: (":80", "/", None, "allow"), 9: ("net", "/a", "net/", "allow"),
    }
    assert U.judge(df.limit(0), RULES, []).count() == 0


def test_mined_rules_block(spark):
    r = random.Random(5)
    rows = []
    for i in range(2000):
        spam = i % 5 == 0
        host = "pills.example.org" if spam else r.choice(["news", "wiki", "pills"]) + ".example.com"
        rows.append((i, f"http://{host}/{r.choice(['en', 'de'])}/{i}", spam))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = U.mine(df.filter("page_id % 2 = 0"))
    assert mined and all(c >= 0.8 for _, c, _ in mined)
    out = U.judge(df.filter("page_id % 2 = 1"), [], mined)
    assert out.filter("(verdict = 'block') <> bad").count() == 0
    assert U.mine(df.limit(0)) == [] and U.mine(df.withColumn("bad", df.bad & False)) == []


def test_miner_equals_brute_force(spark):
    r = random.Random(15)
    rows = []
    for i in range(900):
        host, lang, section = r.choice(["a", "b", "c"]), r.choice(["en", "de"]), r.choice(["x", "y", "z"])
        bad = r.random() < (0.97 if (host, section) == ("a", "x") else 0.9 if lang == "de" and section == "y" else 0.1)
        rows.append((f"http://{host}.org/{lang}/{section}", bad))
    df = spark.createDataFrame([*rows, (None, True), ("http://a.org/", None)], "url string, bad boolean")
    tokens = {x.url: x.t for x in df.select("url", U.tokens_of(F.col("url")).alias("t")).distinct().collect()}
    seen, hits = Counter(), Counter()
    for url, bad in rows:
        for k in range(1, len(tokens[url]) + 1):
            for own in combinations(sorted(tokens[url]), k):
                seen[own] += 1
                hits[own] += bad
    base = sum(b for _, b in rows) / len(rows)
    sure = [(frozenset(o), hits[o] / n, hits[o] / len(rows)) for o, n in seen.items() if hits[o] / n >= max(0.8, 2 * base) and U.surely(hits[o], n, 1.96) >= 0.8]
    got, want = U.mine(df), U.pruned(sure)
    assert got and [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))


def test_few_rows_make_no_rule(spark):
    df = spark.createDataFrame([(f"http://h{i % 40}.com/", i % 40 < 4) for i in range(400)], "url string, bad boolean")
    assert U.mine(df) == [] and U.mine(df.union(df)) != []


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id", "left_semi")
    model = Q.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = Q.score(docs, model, "source", "lang").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("keep", "quality", "toxic").collect()
    good = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.keep for r in rows if r.quality == 0]
    toxic = [r.keep for r in rows if r.quality == 1 and r.toxic == 1]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1 and sum(toxic) / len(toxic) < 0.1


def test_fit_folds_real_near_copies_only():
    long = [f"w{i}" for i in range(200)]
    assert Q.near(Q.sketch(" ".join(long)), Q.sketch(" ".join(long[:-2] + ["other", "end"])))
    assert not Q.near(Q.sketch(" ".join(long)), Q.sketch(" ".join(long[:20] + [f"v{i}" for i in range(180)])))


def test_fit_keeps_unlike_documents_of_one_least_hash(spark):
    # all share the pair of least hash; the toxic ones are else unlike
    pair = min((f"p{i} q{i}" for i in range(3000)), key=Q.xxhash.xxh3_64_intdigest)
    rows = [(i, f"{pair} " + " ".join(f"u{i}x{j}" for j in range(8)) + (" vile" if i < 40 else " kind")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(400)], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, labels).weights["vile"][1] > 0


def test_least_count_follows_the_test():
    k = Q.least_count([449], 3980, 5.0)
    assert k == 6 and Q._test(6, 6, 449, 3980) >= 25 > Q._test(5, 5, 449, 3980)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "en", True), (1, None, None, "en", True), (None, "", "s", None, True), (3, "word " * 9, "s", "en", None)], "doc_id long, text string, source string, lang string, keep boolean")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for m in (Q.fit(docs, labels), Q.fit(docs, labels.limit(0))):
        out = Q.score(docs, m, "source", "lang")
        assert out.count() == 4 and set(out.columns) == {*docs.columns, "p_poor", "p_toxic"} and out.filter("keep is null").count() == 0
    assert Q.score(docs.limit(0), m, "source", "lang").count() == 0


def test_sparse_hosts_shrink(spark):
    rows = [("big", "a", 0.9)] * 200 + [("big", "b", -3.0)] * 200 + [("one", "a", 3.0)]
    df = spark.createDataFrame(rows, "host string, path string, x double").selectExpr("host", "path", "named_struct('poor', x, 'toxic', -5D) as evidence")
    got = {(r.host, r.path): r.rate_poor for r in Q.rates(df, Q.Model({}, (0.5, 0.05)), "host", "path").collect()}
    assert got["big", "a"] > 0.6 and got["big", "b"] < 0.2 and got["one", "a"] < 0.95


def test_calibration_undoes_overlap():
    # every piece of evidence is there three times, so the sums say thrice too much
    r = random.Random(16)
    rows = [(r.random() < 0.2, r.gauss(0, 1)) for _ in range(4000)]
    sums = [[3 * min(0.0, x + bad - 0.5), 3 * max(0.0, x + bad - 0.5)] for bad, x in rows]
    _, low, high = Q.calibrated(sums, [int(b) for b, _ in rows], 0.2)
    assert 0.2 < low < 0.5 and 0.2 < high < 0.5
    assert Q.calibrated(sums[:5], [0, 0, 1, 0, 0], 0.2) == (0.0, 1.0, 1.0)


def test_weights_and_posterior_equal_plain_python(spark):
    import math

    rows = [(i, " ".join(["good" if i % 3 else "vile", f"w{i % 7}", "all"] + ["pair"] * (i % 2)), "s", "en") for i in range(600)]
    marks = [(i, int(i % 5 != 0), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = Q.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    # copies with equal labels count once
    folded = {(t, q, x) for (_, t, _, _), (_, q, x) in zip(rows, marks)}
    n, bad = len(folded), sum(x for *_, x in folded)
    held = [(f, x) for t, _, x in folded for f in Q.features(t)]
    for f in {f for f, _ in held}:
        k, b = sum(g == f for g, _ in held), sum(g == f and x for g, x in held)
        want = math.log((b + 0.5) / (bad + 1)) - math.log((k - b + 0.5) / (n - bad + 1)) if Q._test(b, k, bad, n) >= 25 else 0.0
        assert abs(model.weights.get(f, (0, 0))[1] - want) < 1e-9
    c, a, b = model.scale[1]
    out = {r.doc_id: r for r in Q.score(docs, model, "source", "lang").collect()}
    # one host and path: its rate is the mean of what the sample's rate gives
    base = math.log(model.rate[1] / (1 - model.rate[1]))
    ev = {i: c + a * s[2] + b * s[3] for i, t, _, _ in rows for s in [Q._sums(t, model.weights)]}
    rate = sum(1 / (1 + math.exp(-e - base)) for e in ev.values()) / len(rows)
    assert all(abs(out[i].p_toxic - 1 / (1 + math.exp(-e - math.log(rate / (1 - rate))))) < 1e-6 for i, e in ev.items())
