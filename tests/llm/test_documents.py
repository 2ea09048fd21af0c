"""Fingerprints, personal data, repeats and near copies against brute force."""

import collections
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprint as P
from quire.llm import pii, simjoin, suffixes


def test_fingerprints_follow_the_jaccard_similarity(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice([f"w{i}" for i in range(400)]) for _ in range(r.randint(40, 300))) for _ in range(150)]
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(1001, None), (1002, ""), (None, texts[0])]
    got = {r.doc_id: r for r in P.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((-1 if k is None else k), k, t or "") for k, t in rows)
    errors = []
    for n, (_, k, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][2]
        c = len(t) // 4
        edited = t[: len(t) - c] + nxt[:c]
        g = got[k]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = collections.Counter(t.split(" ")), collections.Counter(edited.split(" "))
        errors.append(g.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.35
    assert got[None].fingerprint == got[0].fingerprint and got[1001].fingerprint == got[1002].fingerprint
    assert P.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = P.compare_with_edits(spark.createDataFrame([(5, "a b c d", 1)], "doc_id long, text string, bucket int")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_weigh_a_dominant_term(spark):
    # generalised Jaccard similarity 100 / 102 and 120 / 122; bins of equal say give about 1/3
    rows = [(1, "x " * 100 + "left"), (2, "x " * 100 + "right"), (3, "y " * 120 + "up"), (4, "y " * 120 + "down")]
    got = {r.doc_id: r.near_next for r in P.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > 0.85 and got[3] > 0.85 and got[2] < 0.1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def counts(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = lambda: sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base_spans(text):
    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if counts(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def test_base_spans_equal_brute_force(spark):
    r = random.Random(7)
    parts = list("a.@+-_0123456789 ()") + ["é", "😀", "4111111111111111", "1.2.3.4", "+1 (386) 555-3733", "x@y.z", " 999.1.1.1 "]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(1500)] + [(-1, None), (-2, ""), (-3, "a." * 9000 + "@b.c" + ".d" * 9000), (-4, "1" * 30000), (-5, "12-" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.b for x in pii.find(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"word{i} filler{i} Zorblax writes from joe@acme.com about thing{i}", 1) for i in range(5)] + [(100 + i, f"plain and from the text number {i} that writes from", 1) for i in range(100)] + [(900, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in out[0] and "Zorblax" not in out[0] and "joe" not in out[0] and "word0" in out[0] and "from" in out[0]
    assert out[900] is None and all(out[i] == t for i, t, _ in rows[5:])
    # copies of one context are no evidence
    copies = spark.createDataFrame([(i, "Zorblax writes from joe@acme.com today") for i in range(9)] + [(20 + i, f"other {i}") for i in range(40)], "doc_id long, text string")
    assert all(r.text == "Zorblax writes from [EMAIL] today" for r in pii.sanitise(copies).filter("doc_id < 9").collect())
    assert pii.annotate(df.limit(0)).count() == 0


def test_terms_of_an_entity_in_one_context(spark):
    rows = [(0, "Quuxley writes from sue@acme.com today"), (1, "Blorpson writes from [1.2.3.4] now"), (2, "hello Blorpson writes from 1.2.3.4 now")] + [(10 + i, f"other writes from home today number {i} now") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).filter("doc_id < 10").collect()}
    assert out[0] == "[TERM] writes from [EMAIL] today" and "Blorpson" not in out[1] + out[2] and "writes from" in out[1]
    # a lone context in a small table may be chance
    few = pii.sanitise(df.filter("doc_id < 13")).filter("doc_id = 0").first().text
    assert few == "Quuxley writes from [EMAIL] today"


def brute_repeats(texts, length=200):
    c = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        out.append((sum(m), len(re.findall(b"\1+", bytes(m))), bytes(x for x, y in zip(t, m) if not y)))
    return out


def test_deep_shallow_sorts():
    r = random.Random(8)
    for _ in range(200):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) * r.randint(1, 20) + bytes(r.choice(b"ab") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 30))]
        order, lcp = suffixes.deep_shallow(texts, shallow=16)
        assert [texts[i] for i in order] == sorted(texts) and sorted(order) == list(range(len(texts)))
        assert all(n == len(os.path.commonprefix([texts[a], texts[b]])) for a, b, n in zip(order, order[1:], lcp[1:]))


@pytest.mark.parametrize("few", [128, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(suffixes, "_FEW", few)  # few: windows are compared by digest
    r = random.Random(9)
    base = ["".join(r.choice("abc ") for _ in range(1200)) for _ in range(4)]
    passage = "".join(r.choice("xyzé ") for _ in range(300))
    rows = []
    for i in range(160):
        x = base[i % 4]
        k = r.randint(0, 1100)
        y = x[:k] + "".join(r.choice("abc") for _ in range(r.randint(0, 4))) + x[k + r.randint(0, 4) :]
        rows.append((i, "".join(r.choice("klmn") for _ in range(r.randint(0, 300))) + passage + "".join(r.choice("klmn") for _ in range(r.randint(0, 300))) if i % 3 == 0 else y, 1))
    rows += [(1000, "a" * 2000, 1), (1001, "a" * 150, 1), (1002, None, 1), (1003, "", 1), (1004, "ab" * 300, 1), (None, "é" * 101, 1), (None, "unique", 1), (7, "unique", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.text or "", r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect())
    want = brute_repeats([(t or "").encode() for _, t, _ in rows])
    assert got == sorted((t or "", *w) for (_, t, _), w in zip(rows, want))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 7 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def near_rows():
    r = random.Random(10)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([2, 5, 12, 14, 20, 22, 25, 40, 60, 150]))] for _ in range(40)]
    rows = []
    for i in range(500):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k, op = r.randrange(len(b)), r.random()
            if op < 0.4:
                b[k] = r.choice(vocabulary)
            elif op < 0.7:
                b.insert(k, r.choice(vocabulary))
            elif len(b) > 1:
                del b[k]
        rows.append((i, " ".join(b)))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "A"), (2004, "a")]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 75)])
def test_components_equal_brute_force(spark, n, percent):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_a_large_family_of_near_copies(spark):
    # one text with a few words changed at random, a common passage that most texts hold, and copies of copies that link in chains
    r = random.Random(11)
    base, passage = [f"b{k}" for k in range(60)], [f"p{k}" for k in range(40)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(60)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + [f"u{i}v{k}" for k in range(r.choice([2, 10, 40, 60]))])) for i in range(200)]
    rows += [(2000 + i, " ".join(f"c{k}" for k in range(i, i + 80))) for i in range(60)]
    for n, percent in ((3, 90), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in simjoin.components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
        assert got == brute_components(rows, n, percent)


def test_prefixes_of_linked_sets_meet():
    r = random.Random(12)
    for percent in (80, 90, 95):
        for _ in range(300):
            n = r.randint(10, 300)
            a = {r.getrandbits(64) for _ in range(n)}
            b = set(r.sample(sorted(a), n - r.randint(0, max(1, n * (100 - percent) // 150)))) | {r.getrandbits(64) for _ in range(r.randint(0, 3))}
            x, y = (simjoin.np.array(sorted(s), simjoin.np.uint64) for s in (a, b))
            if simjoin.linked(x, y, percent) and min(n, len(b)) > simjoin.plan(percent)[0]:
                tops = [simjoin.head(s, percent)[0][: simjoin.prefix(len(s), percent)] for s in (x, y)]
                assert set(tops[0].tolist()) & set(tops[1].tolist())


def test_one_of_each_and_edges(spark):
    df = spark.createDataFrame([(3, "a b c", 1), (1, "a b c", 1), (1, "a b c", 1), (5, None, 1), (6, None, 1), (6, None, 1), (None, "a b c", 1), (None, "only one", 1), (None, "only one", 2), (8, "A  b c", 1)], "doc_id long, text string, part int")
    assert sorted(((r.doc_id or -1, r.text) for r in simjoin.one_of_each(df).collect()), key=str) == sorted([(1, "a b c"), (5, None), (6, None), (6, None), (-1, "only one")], key=str)
    assert simjoin.one_of_each(df).columns == df.columns
    assert simjoin.components(df.limit(0)).count() == 0 and simjoin.one_of_each(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "a b c", 1), ("a", "a b c", 1)], "doc_id string, text string, id int")
    assert {r.component_id for r in simjoin.components(named).collect()} == {"a"}


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (202, 201), (5, 5)]
    got = {r.node: r.root for r in simjoin.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200, 202: 200}
