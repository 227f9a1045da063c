"""The corpus operators against brute force, public libraries, round trips and held-out rows."""

import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from ratingmill.llm import bpe, decontam, jaccard, langid, lengths, pii, quality, queries, resample, rules, sharding, trie, urls, winnow
from tests.compare import database, same

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def docs(sf_dir):
    return duckdb.sql(f"select * from read_parquet('{sf_dir}/documents.parquet')").fetchall()


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and wordless texts, repeats, a long text, unusual characters."""
    long = " ".join(f"w{k % 997}x" for k in range(40_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", None, 4),
        (4, "One two three", None, "s", 13),
        (5, "one TWO three", "en", "s", 13),
        (6, long, "en", "s", len(long)),
        (7, long + " tail", "en", "s", len(long)),
        (7, long + " tail", "en", "s", len(long)),
        (None, "one two three", "en", "s", 13),
        (9, "Ünïcode 日本語 \x1c\x85 👍🏽 ²Ⅷ\n\n a  b\r\n", "de", "s", 20),
        (10, "12345678901234567890 !!! ???", "fr", "s", 28),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = [
        lambda m: True,
        lambda m: all(int(x) <= 255 for x in m[0].split(".")),
        lambda m: 14 <= len(digits(m)) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits(m)))) % 10 == 0,
        lambda m: 10 <= len(digits(m)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, rx in enumerate((EMAIL, IP, CARD, PHONE)) for m in rx.finditer(text) if good[k](m))


def test_pii_base_spans(docs):
    anchors = pii.automaton()
    random.seed(3)
    parts = ["a", "@", ".", "com", "-", "1", "25", "4111111111111111", " ", "+1", "(", ")", "555", "+", "%", "é", "1.2.3.4", "::", "256", "9", "\n", "İ", "IBAN ", "token = ", "://u:p@h.io"]
    texts = [d[1] for d in docs] + ["".join(random.choices(parts, k=random.randint(0, 24))) for _ in range(20_000)]
    for text in texts:
        assert [s for s in pii.spans(text, anchors) if s[1] < pii.BASE] == base_spans(text), text


def test_pii_more_spans_and_redaction():
    anchors = pii.automaton()
    text = 'IBAN GB82 WEST 1234 5698 7654 32, token = "0123456789abcdef0123", see https://me:pw@host.example/x or a.b@c.org'
    found = pii.spans(text, anchors)
    assert [pii.KINDS[k] for _, k, _ in found] == ["account", "secret", "url", "email"][: len(found)] or {pii.KINDS[k] for _, k, _ in found} >= {"account", "secret", "email"}
    clean = pii.redact(text, found)
    assert "GB82" not in clean and "0123456789abcdef" not in clean and "a.b@c.org" not in clean
    assert pii.spans("the account of the secret password was told by a token of passport", anchors) == []


def test_pii_odd_rows(spark, odd):
    out = {r.doc_id: r for r in pii.find(frame(spark, odd), ["doc_id"]).collect()}
    assert out[1].spans == "" and out[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(frame(spark, odd), ["doc_id"]).count() == len(odd)
    assert pii.find(frame(spark, odd).limit(0), ["doc_id"]).count() == 0


# near copies


def brute_components(rows, width, percent):
    sets = []
    for _, text, *_ in rows:
        w = SPACE_WORD.findall(lower(text))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    names = {}
    for k, x in enumerate(label):
        if rows[k][0] is not None:
            names[x] = min(names.get(x, rows[k][0]), rows[k][0])
    return sorted(((r[0], len(s), names.get(x) if s else r[0]) for r, s, x in zip(rows, sets, label, strict=True)), key=repr)


def near_rows(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows, bases = [], [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 200]))] for _ in range(8)]
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(at, rng.choice(vocab)), lambda: w.insert(at, rng.choice(vocab)), lambda: w.pop(at) if len(w) > 1 else None])()
        if rng.random() < 0.2:
            w += passage
        rows.append((k, " ".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_jaccard_equals_brute_force(spark, seed, width, percent):
    rows = near_rows(seed)
    out = sorted((tuple(r) for r in jaccard.join(frame(spark, rows), width, percent).collect()), key=repr)
    assert out == brute_components(rows, width, percent)


def test_jaccard_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    rows = near_rows(5)
    out = sorted((tuple(r) for r in jaccard.join(frame(spark, rows)).collect()), key=repr)
    assert out == brute_components(rows, 4, 85)


def test_jaccard_odd_rows(spark, odd):
    out = sorted((tuple(r) for r in jaccard.join(frame(spark, odd)).collect()), key=repr)
    assert out == brute_components(odd, 4, 85)
    assert jaccard.join(frame(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 3 or None])
def test_jaccard_shared_ids(spark, monkeypatch, ids):
    """Rows that share an id, or have none, bring one text for each node to the blocks."""
    rows = [(ids(k), f"{' '.join(f'g{k // 2}w{j}' for j in range(30))} t{k % 2}", "en", "s", 0) for k in range(800)]
    rows += rows[:40]
    seen, make = [], jaccard.placed

    def counted(*args):
        held = make(*args)
        seen.append((args[1].count(), held.count()))
        return held

    monkeypatch.setattr(jaccard, "placed", counted)
    out = sorted((tuple(r) for r in jaccard.join(frame(spark, rows)).collect()), key=repr)
    assert out == brute_components(rows, 4, 85)
    nodes, sets_ = seen[0]
    assert nodes == 800 and nodes <= sets_ <= nodes + 40  # equal rows in several tasks


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_sets_that_link_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        gone = rng.random(len(a)) < rng.random() * (100 - percent) / 100
        b = np.unique(np.concatenate([a[~gone], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if shared and 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
            assert set(np.concatenate(jaccard.keys(a, len(a), percent, 0)).tolist()) & set(np.concatenate(jaccard.keys(b, len(b), percent, 0)).tolist())


# sharding


def test_sharding_limits(spark, docs):
    rows = [tuple(r) for r in sharding.shard(frame(spark, docs), 20_000).collect()]
    by = {}
    for doc, size, depth, shard, total, oversize in rows:
        by.setdefault(shard, []).append((doc, size))
        assert len(shard) == depth and (total <= 20_000 or oversize)
    assert {s: sum(x for _, x in m) for s, m in by.items()} == {r[3]: r[4] for r in rows}
    for s in by:  # no shard is a prefix of another, and each one's parent was too large
        assert not any(o != s and o.startswith(s) for o in by)
        assert not s or sum(x for o, m in by.items() if o.startswith(s[:-1]) for _, x in m) > 20_000


def test_sharding_odd_rows(spark, odd):
    assert sharding.shard(frame(spark, odd), 10).count() == len(odd)
    assert sharding.shard(frame(spark, odd).limit(0)).count() == 0


# url filter


def test_url_rules(spark):
    cases = {
        "http://A.Org/x": ("a.org", "/x", "org/", "allow"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://b.example.org/es/": ("b.example.org", "/es/", "example.org/es/", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://y.com/de/1?q#f": ("y.com", "/de/1", "com/de/", "block"),
        "x://y.com/fr/": ("y.com", "/fr/", "com/fr/", "allow"),
        "x://org": ("org", "", None, "allow"),
        "x://a.com?u=http://b.org/": ("a.com", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert out == dict(enumerate(cases.values()))


def test_url_tree(spark):
    rows = [(k, f"http://h.net/{'spam' if k % 2 else 'news'}/{k}") for k in range(400)] + [(1000 + k, f"http://i.net/a/{'xy'[k % 2]}{'q' * (k // 2)}/z") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(0, 400, 3)] + [(k, k % 2 == 1) for k in range(1, 400, 3)], "page_id long, bad boolean")
    out = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert all(out[k].verdict == ("block" if k % 2 else "allow") for k in range(400))
    assert out[1].template == "/spam/*" and {out[1000 + k].template for k in range(200)} == {"/a/*/z"}
    assert urls.judge(pages.limit(0), labels).count() == 0


def planted_pages():
    """Hosts whose bad branches only the tree can tell, by labels of a part of their pages."""
    rows = [(k, f"http://h.net/{'spam' if k % 2 else 'news'}/{k}") for k in range(200)]
    rows += [(1000 + k, f"http://deep.net/a/b/c/{'casino' if k % 3 == 0 else 'tea'}/x/{1000 + k}.html") for k in range(150)]
    rows += [(2000 + k, f"http://mixed.net/blog/{2000 + k}") for k in range(60)] + [(3000 + k, f"http://many.net/u/{'qwxyz'[k % 5] * (k // 5 + 1)}/z") for k in range(200)]
    rows += [(1, "http://h.net/spam/1"), (1, "http://h.net/spam/1"), (None, "http://h.net/spam/77"), (4000, None), (4001, ""), (4002, "no scheme"), (4003, "http://h.net/" + "y" * 50_000), (4004, "http://H.NET//spam//5?q#z"), (4005, "http://x.com/de/5")]
    labels = [(k, int(k % 2 == 0), 0) for k in range(0, 200) if k % 4 < 2] + [(1000 + k, 1, int(k % 3 == 0)) for k in range(100)] + [(2000 + k, int(k % 2), None) for k in range(30)] + [(5, 0, 0), (None, 0, 1), (7, None, None)]
    return rows, labels


def test_url_filter_planted(spark, tmp_path):
    rows, labels = planted_pages()
    spark.createDataFrame(rows, "page_id long, url string").withColumns({"html": F.lit(""), "host": F.lit("h"), "rule": F.lit(1)}).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op4_url_filter(spark, str(tmp_path))
    out = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(out[k].verdict == ("block" if k % 2 else "allow") for k in range(200)) and out[3].bad_share > 0.5
    assert all(out[1000 + k].verdict == ("block" if k % 3 == 0 else "allow") for k in range(150))
    assert {out[2000 + k].verdict for k in range(60)} == {out[3000 + k].verdict for k in range(200)} == {"allow"}
    assert out[None].verdict == "block" and out[4005].rule == "com/de/" and out[4000].host == ""
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same(got, con, urls.oracle_sql())


def test_url_filter_without_labels(spark):
    rows, _ = planted_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = urls.page_labels(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    out = urls.judge(pages, none).collect()
    assert len(out) == len(rows) and {r.verdict for r in out if r.rule is None} == {"allow"}
    deep = spark.createDataFrame([(k, "http://d.net" + "/s" * (k + 1)) for k in range(12)], "page_id long, url string")
    assert {r.template for r in urls.judge(deep, none).collect()} == {"/s" * (k + 1) for k in range(12)}


def test_url_tree_below_four_segments(spark):
    rows = [(k, f"http://h.net/a/b/c/d/{'spam' if k % 2 else 'news'}/e/{k}") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(100)], "page_id long, bad boolean")
    out = {r.page_id: r for r in urls.judge(pages, labels).collect()}
    assert all(out[k].verdict == ("block" if k % 2 else "allow") for k in range(200))
    assert out[1].template == "/a/b/c/d/spam/e/*" and out[2].template == "/a/b/c/d/news/e/*"


def test_url_tree_deep_url_takes_no_more_rounds(spark, monkeypatch):
    """A path of 2,000 segments, alone below its first one, costs no rounds, nor does it write all its prefixes."""
    rows = [(k, f"http://h.net/{'spam' if k % 2 else 'news'}/{'abcdefghij'[k % 10]}{'x' * (k // 10 % 5)}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(100)], "page_id long, bad boolean")
    rounds, settle = [], urls.settle
    monkeypatch.setattr(urls, "settle", lambda df: rounds.append(1) or settle(df))
    counts = []
    for more in ([], [(900, "http://h.net" + "/seg" * 2000), (901, "http://deep.net" + "/seg" * 2000)]):
        rounds.clear()
        out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows + more, "page_id long, url string"), labels).collect()}
        assert all(out[k].verdict == ("block" if k % 2 else "allow") for k in range(200))
        counts.append(len(rounds))
    assert counts[0] == counts[1] and out[901].template == "/seg" * 2000


# decontamination


def brute_hits(text, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = rx.findall(lower(text)), set(), set()
    for item, other in items:
        o = rx.findall(lower(other))
        m = min(10, len(o))
        windows = {tuple(o[k : k + m]) for k in range(len(o) - m + 1)} if m and item is not None else set()
        for k in range(len(w) - m + 1):
            if tuple(w[k : k + m]) in windows:
                hit.update(range(k, k + m))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, sf_dir, docs, odd, monkeypatch):
    items = duckdb.sql(f"select * from read_parquet('{sf_dir}/benchmark.parquet')").fetchall()
    items += [(900, "two three"), (901, "W5X"), (902, ""), (903, None), (None, "one two"), (900, "w1x w2x w3x w4x w5x w6x w7x w8x w9x w10x w11x")]
    rows = docs + odd + [(5000, f"x {items[3][1]} y {items[4][1]}".replace(" ", "--"), "en", "s", 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], *brute_hits(r[1], items)) for r in rows), key=repr)
    assert sorted((tuple(r) for r in decontam.search(frame(spark, rows), ["doc_id"], benchmark).collect()), key=repr) == want
    monkeypatch.setattr(decontam, "TABLE_BYTES", 2000)  # a benchmark too large for tables
    assert sorted((tuple(r) for r in decontam.search(frame(spark, rows), ["doc_id"], benchmark).collect()), key=repr) == want
    assert not any(r.contaminated for r in decontam.search(frame(spark, docs), ["doc_id"], benchmark.limit(0)).collect())


# classifiers


def test_language_id(spark, sf_dir, odd):
    out = queries.op6_language_id(spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out & out.lang.notna()]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    model = langid.fit(frame(spark, odd))
    names = {r.doc_id: r.lang_pred for r in langid.predict(frame(spark, odd), ["doc_id"], model).collect()}
    assert names[1] == names[2] == names[10] == "und" and names[9] != "und"
    assert langid.predict(frame(spark, odd), ["doc_id"], langid.train([], [])).where("lang_pred <> 'und'").count() == 0


def test_language_id_repeats_ties_and_empty_table(spark):
    model = langid.train(["aa bb cc", "dd ee ff"], ["x", "y"])
    rows = [(k, text, None, None, None) for k, text in enumerate(["aa bb", "aa bb", "zz 9", None, "   "])]
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, rows), ["doc_id"], model).collect()}
    assert out[0] == out[1] and out[0][0] == "x" and out[3] == out[4] == ("und", 0.0)
    assert langid.predict(frame(spark, rows).limit(0), ["doc_id"], model).count() == 0
    assert langid.fit(frame(spark, rows).limit(0)).labels == []
    # without any evidence the label that sorts first
    none = langid.Model(["x", "y"], np.zeros((langid.BUCKETS, 2)), np.zeros((2, 2)), np.zeros(0, np.uint64))
    assert none.predict(pa.array(["word"])) == (["x"], [0.5])
    # a row repeated many times takes one place in training, and each language its own
    many = frame(spark, [(2, "uno dos tres", "es", "s", 0)] * 50 + [(k, f"ein zwei drei {k}", "de", "s", 0) for k in range(9)])
    assert langid.fit(many, most=5).labels == ["de", "es"]


def test_language_id_code_switching():
    rng = random.Random(9)
    texts, langs = [], []
    for lang, vocab in (("x", ["kata", "kito", "kuma", "kesi"]), ("y", ["blorn", "brint", "blast", "brusk"])):
        for _ in range(40):
            texts.append(" ".join(rng.choice(vocab) for _ in range(30)))
            langs.append(lang)
    model = langid.train(texts, langs)
    names, scores = model.predict(pa.array(["kata kito kuma blorn", "blorn brint brusk kata " * 20]))
    assert names == ["x", "y"] and 0.6 < scores[0] < 0.9 and 0.6 < scores[1] < 0.9


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    score, step = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    weight = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(score[0, t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            weight[t, y] += w
    p, _ = langid.marginals(score, step, np.array([4]))
    assert np.allclose(p[0], weight / weight.sum(1, keepdims=True))
    assert np.allclose(langid.forward_backward(score, step, np.array([4]))[0], p[0].sum(0))


def test_quality_classifier(spark, odd):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "plain"]) for _ in range(40)) for _ in range(80)]
    junk = [" ".join(rng.choice(["$$$", "BUY!!", "###", "a"]) for _ in range(40)) for _ in range(80)]
    model = quality.train(good[:60] + junk[:60], [1] * 60 + [0] * 60, 0.5)
    scores = model.scores(pa.array(good[60:] + junk[60:] + [None, ""]))
    assert (scores[:20] > 0.5).all() and (scores[20:40] < 0.3).all() and ((scores >= 0) & (scores <= 1)).all()
    assert quality.score(frame(spark, odd), ["doc_id"], model).count() == len(odd)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(frame(spark, odd), labels).scores(pa.array(["x"]))[0] > 0.99


def test_quality_repeats_ties_and_empty_table(spark):
    rng = random.Random(6)
    word = lambda kinds, n: " ".join(rng.choice(kinds) for _ in range(n))
    rows = [(k, word(["alpha", "beta", "gamma"], 40) if k % 2 else word(["$$$", "BUY!!"], 40), "en", "s", 0) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(4, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark, [*rows, *rows[:40]]), labels)
    out = quality.score(frame(spark, [*rows, rows[0], (None, None, None, None, None)]), ["doc_id"], model).collect()
    assert len(out) == 122 and len({(r.score, r.predicted) for r in out if r.doc_id == 0}) == 1
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None)
    assert quality.score(frame(spark, rows).limit(0), ["doc_id"], model).count() == 0
    assert quality.fit(frame(spark, rows).limit(0), labels.limit(0)).scores(pa.array(["x"]))[0] > 0.99
    # the same documents in another order and other tasks give the same model
    again = quality.fit(frame(spark, rows[::-1]).repartition(5), labels)
    assert np.array_equal(quality.fit(frame(spark, rows), labels).entry, again.entry)


def test_quality_held_out(spark, sf_dir):
    out = queries.op7_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null"), "doc_id").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95 and (good >= 0.3).mean() > 0.97


# rules


def brute_statistics(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows, again = {}, set()
    for k in range(len(w) - 7):
        windows.setdefault(tuple(w[k : k + 8]), []).append(k)
    for at in windows.values():
        if len(at) > 1:
            again.update(j for k in at for j in range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_rules_statistics(docs, odd):
    texts = [d[1] for d in docs + odd] + ["a b\n" * 30, "x\n\nx\n x", "p q r s t u v w " * 2]
    found = list(zip(*(x.tolist() for x in rules.statistics(pa.array(texts))), strict=True))
    assert found == [brute_statistics(t) for t in texts]


def test_rules_outliers(spark, odd):
    rng = random.Random(2)
    text = lambda n, sym: " ".join(rng.choice(["tree", "river", "mountain", "of", "the"]) + str(rng.random())[2:4] + ("#" * sym) for _ in range(n))
    rows = [(k, text(rng.randint(60, 200), 0), "en", "s", 0) for k in range(300)] + [(1000 + k, text(100, 9), "en", "s", 0) for k in range(5)]
    out = {r.doc_id: r for r in rules.judge(frame(spark, rows)).collect()}
    assert all(out[k].kept for k in range(300)) and not any(out[1000 + k].kept for k in range(5))
    other = {r.doc_id: r for r in rules.judge(frame(spark, odd)).collect()}
    assert other[1].base_failed and not other[1].kept and len(other) == len({o[0] for o in odd})
    assert rules.judge(frame(spark, odd).limit(0)).count() == 0


def robust(points, steps=4):
    """Centre and covariance of one pool in plain numpy."""
    middle = lambda v: np.quantile(np.round(v * rules.GRID), 0.5, axis=0) / rules.GRID
    centre = middle(points)
    mad = middle(np.abs(points - centre))
    inverse = np.diag(1 / ((1.4826 * mad) ** 2 + np.square(rules.FLOORS)))
    for _ in range(steps):
        away = np.einsum("ki,ij,kj->k", points - centre, inverse, points - centre)
        far = np.round(np.log1p(np.maximum(away, 0)) * rules.GRID)
        core = points[far <= np.quantile(far, rules.CORE)]
        centre = core.mean(0)
        inverse = np.linalg.inv(np.cov(core.T, bias=True) * rules.CONSISTENCY + np.diag(np.square(rules.FLOORS)))
    return len(core), centre, np.linalg.inv(inverse)


def test_rules_equal_plain_estimates(spark, sf_dir):
    """Every verdict of the registered query against numpy over the same pools."""
    rows = duckdb.sql(f"select doc_id, text, lang, source from read_parquet('{sf_dir}/documents.parquet')").fetchall()
    stats = {r[0]: brute_statistics(r[1]) for r in rows}
    failed = {d: s[0] < 20 or 100 * s[4] > 30 * s[0] for d, s in stats.items()}
    point = lambda n, c, s, d, w: np.round(np.array([np.log1p(n), np.log1p(c / n), np.sqrt(s / max(c, 1)), np.sqrt(d / n), np.sqrt(w / n)]) * rules.GRID) / rules.GRID
    points = {d: point(*s) for d, s in stats.items() if not failed[d]}
    pools = {}
    for d, _, lang, source in rows:
        if d in points:
            for pool in ((lang, source), lang, "all of them"):
                pools.setdefault(pool, []).append(d)
    made = {}
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    assert got.keys() == stats.keys()
    for d, _, lang, source in rows:
        if failed[d]:
            assert got[d].base_failed and not got[d].kept
            continue
        centre = None
        for pool in ("all of them", lang, (lang, source)):
            if pool not in made:
                made[pool] = robust(np.array([points[k] for k in pools[pool]]))
            n, own, cov = made[pool]
            w = 1 if centre is None else n / (n + rules.PRIOR)
            centre, spread = (own, cov) if w == 1 else (w * own + (1 - w) * centre, w * cov + (1 - w) * spread)
        away = (points[d] - centre) @ np.linalg.inv(spread) @ (points[d] - centre)
        assert got[d].distance == pytest.approx(away, abs=2e-3, rel=1e-3) and got[d].kept == (away <= rules.CUTOFF)


def test_rules_do_not_depend_on_tasks(spark, docs):
    one, many = (sorted(tuple(r) for r in rules.judge(spark.createDataFrame(docs, DOC).repartition(n)).collect()) for n in (1, 7))
    assert one == many


def test_rules_small_groups(spark):
    """An outlier in a group of a few: its language's estimate judges it, or that of all."""
    rng = random.Random(7)
    text = lambda n, sym: " ".join(rng.choice(["tree", "river", "mountain", "of", "the"]) + str(rng.random())[2:4] + ("#" * sym) for _ in range(n))
    rows = [(k, text(rng.randint(60, 200), 0), "en", f"s{k % 12}", 0) for k in range(120)]
    rows += [(500 + k, text(rng.randint(60, 200), 0), lang, None, 0) for k, lang in enumerate(["fr", "fr", None, "de"])]
    rows += [(1000, text(100, 9), "en", "s3", 0), (1001, text(100, 9), "en", "alone", 0), (1002, text(100, 9), "fr", None, 0), (1003, text(100, 9), None, None, 0)]
    out = {r.doc_id: r for r in rules.judge(frame(spark, rows)).collect()}
    assert len(out) == len(rows) and all(r.distance is not None for r in out.values())
    assert {k for k, r in out.items() if not r.kept} == {1000, 1001, 1002, 1003}


# tokens


@pytest.fixture(scope="session")
def coder():
    return bpe.encoder(*bpe.vocabulary())


@pytest.fixture(scope="session")
def public(coder):
    return tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=coder.ranks, special_tokens={})


def test_bpe_equals_public_encoder(coder, public, docs):
    random.seed(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "é", "ß", "1", "23", "²", "Ⅷ", "!", "\x1c", "\x85", "\xa0", "　", "日本", "👍", "the", "tion", "A", "_", "<|endoftext|>"]
    texts = [d[1] for d in docs] + ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(5000)] + ["ab" * 50_000, "x" * 5000, " " * 3000 + "y"]
    random.shuffle(texts)
    for low, high, ids, at in coder.encode(pa.array(texts)):
        for k in range(low, high):
            own = ids[at[k - low] : at[k - low + 1]]
            assert own.tolist() == public.encode_ordinary(texts[k])
            assert coder.decode(own) == texts[k].encode()


@pytest.mark.parametrize("many", [0, 3, 1 << 40])
def test_bpe_long_pre_tokens(coder, public, monkeypatch, many):
    """Buckets merged at once and place by place."""
    monkeypatch.setattr(bpe, "MANY", many)
    random.seed(many)
    texts = ["".join(random.choices("abehnorst", k=30_000)), "aaab" * 3000, "a" * 9001, "the" * 5000, "".join(random.choices("éèàñü\U0001f44d", k=3000))]
    for low, _, ids, at in coder.encode(pa.array(texts)):
        for k in range(len(at) - 1):
            assert ids[at[k] : at[k + 1]].tolist() == public.encode_ordinary(texts[low + k])


def test_bpe_names_that_collide(coder, public, docs, monkeypatch):
    """Stretches are told apart by their bytes: names that only know a stretch's size give the same ids."""
    monkeypatch.setattr(bpe, "stretch_names", lambda data, start, size: size.astype(np.uint64) // np.uint64(3))
    texts = [d[1] for d in docs[:40]]
    for low, high, ids, at in coder.encode(pa.array(texts, pa.string())):
        for k in range(low, high):
            assert ids[at[k - low] : at[k - low + 1]].tolist() == public.encode(texts[k] or "", disallowed_special=())


def test_bpe_rows(spark, public, odd, monkeypatch):
    out = bpe.encode(frame(spark, odd), ["doc_id"], *bpe.vocabulary(), ids=True).collect()
    by = {r[0]: r[1] or "" for r in odd}
    assert len(out) == len(odd)
    for r in out:
        ids = public.encode_ordinary(by[r.doc_id])
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (len(ids), ids, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(by[r.doc_id].encode()).hexdigest())
    assert bpe.encode(frame(spark, odd).limit(0), ["doc_id"], *bpe.vocabulary()).count() == 0


def test_length_histogram(spark):
    sizes = [0, 0, 3, 3, 3, 511, 512, 513, 2000, 2000]
    hist = lengths.histogram(spark.createDataFrame([(s,) for s in sizes], "n_tokens long"))
    for r in hist.collect():
        assert r.n_docs == sizes.count(r.n_tokens)
        assert r.docs_at_least == sum(s >= r.n_tokens for s in sizes) and r.rank == sum(s <= r.n_tokens for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= r.n_tokens) and r.total_if_cut == sum(min(s, r.n_tokens) for s in sizes)
    assert {r.share: r.n_tokens for r in lengths.quantiles(hist, [0.0, 0.5, 1.0]).collect()} == {0.0: 0, 0.5: 3, 1.0: 2000}
    assert lengths.histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_token_counts_odd_rows(spark, odd, public):
    rows = frame(spark, odd).withColumns({c: F.lit(1) for c in ("n_tokens", "block", "n_docs")})
    counted = lengths.count_tokens(rows, [], *bpe.vocabulary())
    sizes = [len(public.encode_ordinary(o[1] or "")) for o in odd]
    hist = lengths.histogram(counted)
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == {s: sizes.count(s) for s in sizes}
    assert "PythonMapInArrow" not in hist._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in hist._jdf.queryExecution().executedPlan().toString()
    assert lengths.histogram(lengths.count_tokens(rows.limit(0), [], *bpe.vocabulary())).count() == 0


def test_token_counts(spark, sf_dir, docs, public):
    sizes = [len(public.encode_ordinary(d[1])) for d in docs]
    got = {r.n_tokens: r.n_docs for r in queries.op9_token_counts(spark, sf_dir).collect()}
    assert got == {s: sizes.count(s) for s in sizes}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), database(sf_dir), queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir, docs, public):
    import corpus_pipeline as c

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r for r in c.quality_stage(spark, table, sf_dir).collect()}
    model = quality.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {d[0] for d, s in zip(docs, model.scores(pa.array([d[1] for d in docs])), strict=True) if s >= 0.3}
    assert kept.keys() == want
    rows = [tuple(r) for r in kept.values()]
    first = {x[0] for x in brute_components(rows, 5, 80) if x[2] == x[0]}
    items = duckdb.sql(f"select * from read_parquet('{sf_dir}/benchmark.parquet')").fetchall()
    anchors, want = pii.automaton(), {}
    for doc, text, *_ in rows:
        if doc in first and not brute_hits(text, items)[4]:
            clean = pii.redact(text, pii.spans(text, anchors))
            assert not base_spans(clean)
            want[doc] = public.encode_ordinary(clean)
    assert {r.doc_id: r.ids for r in c.run(spark, sf_dir).collect()} == want
    assert len(want) > 50


def test_pipeline_near_copies_odd_rows(spark, odd):
    """Null and repeated ids, repeated rows, texts without words."""
    import corpus_pipeline as c

    text = " ".join(f"q{k}" for k in range(30))
    rows = [*odd, (None, text, "en", "s", 1), (None, text, "en", "s", 1), (20, "alone on its own with some words", "en", "s", 1), (None, "another text that nobody else has here", "en", "s", 1)]
    rows += [(20, text + " more", None, None, None), (21, text, "en", "s", 1), (21, text, "en", "s", 1)]
    out = sorted(((r.doc_id, r.text) for r in c.near_copies_stage(spark, frame(spark, rows), "").collect()), key=repr)
    long = odd[5][1]
    want = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three"), (6, long), (9, odd[9][1]), (10, odd[10][1]), (20, "alone on its own with some words"), (20, text + " more"), (None, "another text that nobody else has here")]
    assert out == sorted(want, key=repr)
    assert c.near_copies_stage(spark, frame(spark, rows).limit(0), "").count() == 0


@pytest.mark.parametrize("rows", [0, 3])
def test_pipeline_small_and_clashing(spark, odd, tmp_path, rows):
    """No documents, and columns whose names the stages use themselves; null, wordless and repeated rows."""
    import corpus_pipeline as c

    docs = frame(spark, [*odd, *[(k, f"number {k} is a text of its own", "en", "s", 30) for k in range(20, 20 + rows)]]).limit(100 * rows)
    clashing = {name: F.lit(1) for name in "score predicted mark group node gone_id contaminated ids n_tokens row late".split()}
    docs.withColumns(clashing).write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.select("doc_id", F.lit(1).cast("long").alias("quality"), F.lit(0).cast("long").alias("toxic"))
    labels.where("doc_id is not null").withColumns(clashing).write.parquet(f"{tmp_path}/labels.parquet")
    items = docs.select(F.lit(1).alias("item_id"), F.lit("Number 21, is a text of its own").alias("text")).limit(1)
    items.withColumns(clashing).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = c.run(spark, str(tmp_path)).collect()
    if not rows:
        assert out == []
        return
    # one of equal texts stays; the item lies in one text; a row without words stays
    found = sorted((r.doc_id for r in out), key=repr)
    assert found == sorted([1, 2, 3, 4, 6, 9, 10, 20, 22], key=repr)
    assert all(r.ids == [] for r in out if r.doc_id in (1, 2))


def test_clashing_columns(spark, odd):
    names = "score predicted label node n_words hash bytes depth kept group x host bad count key spans n_tokens set chunk component_id".split()
    docs = frame(spark, odd).withColumns({c: F.lit(1) for c in names})
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.lit("http://a.b/c/1").alias("url"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), "label", "count")
    benchmark = docs.select(F.lit(1).alias("item_id"), F.lit("one two").alias("text"), "n_words")
    results = [
        pii.find(docs, ["doc_id"]),
        jaccard.join(docs),
        sharding.shard(docs),
        urls.judge(pages, urls.page_labels(pages, labels).withColumn("host", F.lit("h"))),
        decontam.search(docs, ["doc_id"], benchmark),
        langid.predict(docs, ["doc_id"], langid.fit(docs)),
        quality.score(docs, ["doc_id"], quality.fit(docs, labels)),
        rules.judge(docs),
        bpe.encode(docs, ["doc_id"], *bpe.vocabulary()),
        winnow.beside_next(docs),
        resample.resample(docs, benchmark),
    ]
    assert [r.count() for r in results] == [len(odd)] * len(results)
    turns = docs.select(F.lit(7).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *names)
    assert trie.build(turns).agg(F.max("depth")).first()[0] == len(odd)
