"""Winnowing, conversation tries and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from ratingmill.llm import queries, resample, trie, winnow
from tests.compare import database, same
from tests.llm.test_llm import docs, frame, lower, odd  # noqa: F401  fixtures

MASK = (1 << 64) - 1


# winnowing


def mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def brute_print(text, width, window):
    if not text:
        return []
    powers = [pow(winnow._BASE, j, 1 << 64) for j in range(width)]
    hashes = [mixed(sum((ord(c) + 1) * p for c, p in zip(text[i : i + width], powers, strict=False)) & MASK) >> 32 for i in range(max(1, len(text) - width + 1))]
    found = set()
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        found.add((i + max(j for j, x in enumerate(part) if x == min(part)), min(part)))
    return sorted(found)


def alike(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("width,window", [(16, 48), (1, 1), (3, 4), (5, 7), (20, 1)])
def test_chosen_hashes(width, window):
    rng = random.Random(width)
    texts = ["", "a", "ab" * 40, "x" * 200, "日本語👍🏽 text " * 9] + ["".join(rng.choice("ab c") for _ in range(rng.choice([2, 15, 16, 63, 64, 300]))) for _ in range(40)]
    for part in (texts, texts[:2], [""], []):
        counts, places, hashes = winnow.fingerprints(part, width, window)
        ends = np.cumsum(counts)
        for k, text in enumerate(part):
            own = slice(ends[k] - counts[k], ends[k])
            assert list(zip(places[own].tolist(), hashes[own].tolist(), strict=True)) == brute_print(text, width, window)


def test_shared_passages_share_a_hash():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = word(winnow.WIDTH + winnow.WINDOW - 1)
        counts, _, hashes = winnow.fingerprints([word(rng.randrange(300)) + passage + word(200), word(rng.randrange(90)) + passage])
        assert set(hashes[: counts[0]].tolist()) & set(hashes[counts[0] :].tolist())


def brute_beside(found):
    order = sorted(((-(1 << 63) if i is None else i), i, t or "") for i, t, *_ in found)
    out = []
    for (_, i, text), (_, _, after) in zip(order, order[1:] + order[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, e, other = (brute_print(t, winnow.WIDTH, winnow.WINDOW) for t in (text, edited, after))
        show = lambda x: ",".join(f"{p}:{h}" for p, h in x)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(e), round(alike(own, e), 9), round(alike(own, other), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [1 << 20, 3000])
def test_fingerprints_beside_next(spark, docs, odd, monkeypatch, range_bytes):  # noqa: F811
    monkeypatch.setattr(winnow, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(winnow, "SLICE", 5000)
    short = [d for d in docs if len(d[1] or "") < 2500][:120]
    more = [(-5, "early", "en", "s", 5), (10**12, None, None, None, None), *[(r[0] if r[0] is None else r[0] + 10**6, (r[1] or "")[:2000] if r[1] is not None else None, *r[2:]) for r in odd if r[0] not in (6, 7)]]
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in winnow.beside_next(frame(spark, short + more)).collect()]
    assert sorted(got, key=repr) == brute_beside(short + more)


def test_fingerprints_odd_rows(spark, odd):  # noqa: F811
    same_text = [(7, "one two three " * 30, "en", "s", 0)] * 40 + [(None, "x", "en", "s", 0)] * 3
    out = winnow.beside_next(frame(spark, odd + same_text)).collect()
    assert len(out) == len(odd) + 43
    assert {r.fingerprint for r in out if r.n_chars == 0} == {""} and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    alone = winnow.beside_next(frame(spark, odd[3:4])).first()
    assert alone.near_next == 1.0
    assert winnow.beside_next(frame(spark, odd).limit(0)).count() == 0
    wide = frame(spark, odd).selectExpr("*", "1 as place", "2 as mark", "'x' as packed", "3 as `range`", "4 as fingerprint")
    assert winnow.beside_next(wide).count() == len(odd)
    lists = winnow.fingerprint(wide, ["doc_id", "place", "fingerprint"]).where("doc_id = 4").first()
    assert list(zip(lists.positions, lists.hashes, strict=True)) == brute_print("One two three", winnow.WIDTH, winnow.WINDOW) and lists.place == 1


# conversation tries


def brute_trie(found):
    turns = {}
    for c, turn, role, text in found:
        if c is not None:
            key = ((role or ""), (text or ""))
            turns.setdefault(c, []).append(((turn is not None, turn), hashlib.sha256(f"{len(key[0].encode())}:{key[0]}{key[1]}".encode()).digest(), key))
    own = {c: [k for *_, k in sorted(x)] for c, x in turns.items()}
    built = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + x[zlib.crc32(str(c).encode()) % 6 :] for c, x in own.items()}
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k)) for k, m in nodes.items()), key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def talks(seed, n=500):
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        c = rng.choice([rng.randrange(1200), rng.randrange(90_000, 90_400), 5 * 10**15 + rng.randrange(3000)])
        for t in range(rng.randrange(1, 9)):
            found.append((c, t, rng.choice(["user", "assistant"]), f"text {rng.choice([0, 0, 0, t])}"))
    found += [(1, None, None, None), (1, None, "user", "null turn"), (2, 0, "", "é👍"), (2, 0, "", "é👍"), (300, 0, None, ""), (None, 0, "user", "nobody's"), *[(777, t, "user", f"long {t}") for t in range(400)]]
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    found = talks(seed)
    df = spark.createDataFrame(found, TURNS).selectExpr("*", "1 as shard", "2 as path", "3 as depth", "4 as `at`").repartition(5)
    got = sorted((tuple(r) for r in trie.build(df, trie.borrowed).select(*TRIE).collect()), key=repr)
    assert got == brute_trie(found)


def test_trie_copies_in_many_shards(spark):
    found = [(c, t, "user", f"same {t}") for c in range(0, 40_000, 13) for t in range(3)]
    got = trie.build(spark.createDataFrame(found, TURNS)).select(*TRIE).collect()
    ids = sorted({c for c, *_ in found})
    whole = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted((r.depth, r.n_convs, r.n_children, r.n_leaves) for r in got) == [(0, len(ids), 1, 1), (1, len(ids), 1, 1), (2, len(ids), 1, 1), (3, len(ids), 0, 1)]
    assert {r.depth: r.ends_sha256 for r in got}[3] == whole and {r.depth: r.saved_tokens for r in got}[0] == 3 * 6 * (len(ids) - 1)


def test_trie_empty_and_turnless(spark):
    assert trie.build(spark.createDataFrame([], TURNS)).count() == 0
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    (root,) = trie.build(spark.createDataFrame([(lone, 0, "user", "gone")], TURNS), trie.borrowed).collect()  # base is absent
    assert (root.conv_id, root.depth, root.n_convs, root.n_leaves, root.parent_conv_id) == (lone, 0, 1, 1, None)


# importance resampling


def brute_resample(docs_, target, most=1, buckets=resample.BUCKETS):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = rx.findall(lower(text))
        return [zlib.crc32(" ".join(w[k : k + r]).encode()) % buckets for r in range(1, most + 1) for k in range(len(w) - r + 1)], len(w)

    made = [features(d[1]) for d in docs_]
    s, t = Counter(b for f, _ in made for b in f), Counter(b for x in target for b in features(x[1])[0])
    big_s, big_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    out = []
    for d, (f, n) in zip(docs_, made, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        out.append((d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-o[3], o[0] is None, o[0] or 0) for o in out if o[4] >= 20)
    drawn = Counter(able[: 10 * len(able) // 100])
    return sorted((o[:4] for o in out), key=repr), sorted((o for o in drawn.elements()))


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_brute_force(spark, sf_dir, docs, odd, most):  # noqa: F811
    target = duckdb.sql(f"select * from read_parquet('{sf_dir}/benchmark.parquet')").fetchall() + [(None, None), (7, "")]
    found = docs + odd + [docs[3]] * 30 + [(None, "v w " * 30 + "y" * 300, "en", "s", 0)]
    bench = spark.createDataFrame(target, "item_id long, text string")
    df = frame(spark, found)
    gain = resample.gains(resample.bucket_counts(df, most), resample.bucket_counts(bench, most))
    out = resample.draw(resample.weigh(df, ["doc_id"], gain, most)).collect()
    want, drawn = brute_resample(found, target, most)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in out), key=repr) == want
    ranked = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn


def test_resampling_edge_cases(spark, odd):  # noqa: F811
    bench = spark.createDataFrame([], "item_id long, text string")
    wide = frame(spark, odd).selectExpr("*", "1 as score", "2 as rank", "3 as able", "4 as bucket", "5 as n")
    out = resample.resample(wide, bench).collect()
    assert len(out) == len(odd) and all(r.weight == 0 for r in out if r.n_features == 0) and all(r["rank"] is None for r in out)
    assert resample.resample(frame(spark, odd).limit(0), bench).count() == 0
    copies = [(5, "word " * 30, "en", "s", 0)] * 100
    assert sorted(r["rank"] for r in resample.resample(frame(spark, copies), bench).where("rank is not null").collect()) == list(range(1, 11))


def test_crc_of_long_words():
    data = np.frombuffer("a£bc".encode() * 200 + b" xyz", np.uint8)
    start, end = np.array([0, 3, 1001, 5]), np.array([1000, 3, 1004, 70])
    got = resample.crc_feed(np.full(4, 0xFFFFFFFF, np.uint32), data, start, end) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_resampling"])
def test_sql_twins(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), database(sf_dir), queries.oracle_sql()[name])


def test_registered_fingerprints(spark, sf_dir, docs):  # noqa: F811
    out = {r.doc_id: r for r in queries.op11_fingerprints(spark, sf_dir).collect()}
    ids = sorted(d[0] for d in docs)
    text = {d[0]: d[1] or "" for d in docs}
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        q = len(text[i]) // 4
        assert out[i].edited_sha256 == hashlib.sha256((text[i][: len(text[i]) - q] + after[:q]).encode()).hexdigest()
    assert len({(text[i], out[i].fingerprint) for i in ids}) == len({text[i] for i in ids})
