"""Operators 11 to 13 against brute force, exact token ids and sets, long number lists, chat records."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import ann, chat, common, divergence, jaccard, pii, substrings, tokens, trie

# Approximate nearest neighbours.


def brute_nearest(rows, k, every):
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    for q, a in good:
        if q % every == 0:
            found = []
            for i, b in good:
                if i != q and len(a) == len(b):
                    s = 0.0
                    for u, v in zip(a.tolist(), b.tolist(), strict=True):
                        s += u * v
                    found.append((-s, i))
            yield q, [(i, -s) for s, i in sorted(found)[:k]]


VECTORS = "id long, e array<double>, x string, dim string, list string, part string, row string, kth string"


def vectors(spark, rows):
    """Names that clash with those used inside."""
    df = spark.createDataFrame([(i, x, *"abcdef") for i, x in rows], VECTORS)
    return ann.finite_vectors(df, "id", "e")


def test_nearest_is_exact_where_lists_cover_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "COVERED", 1.0)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0]) for i in range(30)] + [(200, None), (201, []), (202, [0.0, 0.0]), (203, [1.0, None]), (204, [float("nan"), 1.0]), (205, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    rows += [(300, [1e300, -1e300, 0.0]), (320, [1e-300, 0.0, 0.0]), (340, [3.0, 4.0, 5.0]), (20, rng.normal(size=5).tolist())]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), "id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = defaultdict(list)
    for q, best in brute_nearest(rows, 20, 20):
        want[q] = sorted(want[q] + best, key=lambda h: (-h[1], h[0]))  # the two rows of id 20 are queries of their own
    assert set(got) == {q for q, best in want.items() if best}
    for q, best in want.items():
        assert sorted(got[q], key=lambda h: (-h[1], h[0])) == best, q


def test_recall_of_nearest(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 24))
    rows = [(i, (centers[i % 40] + 0.4 * rng.normal(size=24)).tolist()) for i in range(4000)] + [(5000 + i, centers[3].tolist()) for i in range(900)]
    hit = total = 0
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), "id % 40 = 0", 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for q in np.flatnonzero(ids % 40 == 0):
        s = np.zeros(len(x))
        for j in range(x.shape[1]):
            s += x[:, j] * x[q, j]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        own = got[int(ids[q])]
        assert len(own) == 20 and own == sorted(own, key=lambda h: (-h[1], h[0]))
        hit, total = hit + len({i for i, _ in own} & set(ids[best].tolist())), total + 20
        assert all(score == s[np.flatnonzero(ids == i)[0]] for i, score in own)
    assert hit / total > 0.95


def test_scan_gives_up_early():
    """Most candidates cost less than all columns."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 96)).repeat(100, 0) + 0.5 * rng.normal(size=(3000, 96))
    index = ann.Index(x, len(x), float(np.abs(x).max()), float(np.sqrt((x * x).sum(1)).max() / np.abs(x).max()), 10)
    part = ann.Part(np.arange(len(x)), x, index)
    q = x[:1]
    kth = max(h[2] for h in part.search(q[0], (index.asked(q) @ ann.rotation(97))[0], 0, np.inf, 10))
    seen = []
    real = np.einsum
    try:
        np.einsum = lambda *a: (seen.append(a[1].size), real(*a))[1]
        part.search(q[0], (index.asked(q) @ ann.rotation(97))[0], 0, kth, 10)
    finally:
        np.einsum = real
    assert sum(seen) < 0.4 * len(x) * 97


# Prefix trie.


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v, key=lambda r: (r[0], r[1] or 0, r[2], r[3]))] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    words = lambda k: len(k[-1][1].encode().split()) if k else 0
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = {x for x in below if len(x) == len(k) + 1}
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(k))
        yield min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids), len(leaves), sum((len(nodes[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string, c long, d long, hi long, words string"


def told(spark, rows):
    return sorted(tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(*r, 1, 2, 3, "w") for r in rows], TURNS)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(-25, 0), 10**12, 10**12 + 1]:
        if c in (20, 45):
            continue
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "hello  there\tx", "", None, "é\x0bü"])))
    rows += [(None, 1, "user", "x"), (7, 3, "user", "a b"), (7, 3, "user", "a b"), (8, 2, "b", "y"), (8, 2, "a", "z")]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)]
    if seed == 2:  # a sketch that proves next to nothing
        monkeypatch.setattr(trie, "WIDTH", 64)
        monkeypatch.setattr(trie, "BLOCK", 64)
        monkeypatch.setattr(trie, "CHUNK", 3)
        monkeypatch.setattr(trie, "SMALL", 0)
    assert told(spark, rows) == sorted(brute_trie(rows), key=lambda r: r)


def test_trie_of_few(spark):
    assert told(spark, []) == []
    turnless = [(c for c in range(1000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)]
    c = next(turnless[0])
    assert told(spark, [(c, 1, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    long = [(0, t, "user", f"w {t}") for t in range(30_000)] + [(1, t, "user", f"w {t}") for t in range(10)]
    assert len(told(spark, long)) >= 30_001


def test_sketch_proves_singletons_only(spark):
    rows = [(c, t, "user", "shared" if t == 1 else f"own {c} {t}") for c in range(300) for t in range(4)]
    p = common.written(trie.prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "p")
    n = {(r.hi, r.lo): r["count"] for r in p.where("d > 0").groupBy("hi", "lo").count().collect()}
    kinds = Counter()
    for r in trie.screened(p, p.where("d > 0").count()).collect():
        kinds[r.kind] += 1
        assert r.kind == 2 or n[r.hi, r.lo] == 1
        if r.kind == 0:
            assert n[r.up_hi, r.up_lo] == 1
    assert kinds[0] > 0.25 * sum(kinds.values()) and kinds[1] >= 290


# Source divergence.


def brute_divergence(rows, min_docs, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    in_docs, counts, groups = Counter(), Counter(), sorted({(a, b) for a, b, _ in docs})
    for lang, source, terms in docs:
        in_docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for (x, t), n in in_docs.items() if x == lang and n >= min_docs]
        sources = [b for a, b in groups if a == lang]
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = lambda n, all_of: 1 + 10**9 * (n + 5) // (all_of + 5 * len(kept))  # noqa: B023, E731
        of = {(s, t): p(counts[lang, s, t], total[s]) for s in sources for t in kept}
        q = {t: p(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = sorted(((-sum(abs(of[s, t] - of[o, t]) for t in kept), o.encode()) for o in sources if o != s))
            term = sorted((-(of[s, t] - q[t]), t.encode()) for t in kept if counts[lang, s, t] and of[s, t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


def test_places_of_prefixes():
    rng = random.Random(2)
    values = [bytes(rng.randrange(97, 123) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 16, 17, 127, 128, 129, 300]))) for _ in range(2000)]
    place = divergence._places(5, pa.array(values, pa.binary()), 1 << 40)
    assert len(set(zip(values, place.tolist(), strict=True))) == len(set(values)) == len(set(place.tolist()))
    for width in (6, 12, 130):  # the first bytes of a term have the place that the prefix itself has
        cut = divergence._places(np.full(2000, 5, np.uint64), pa.array([x[:width] for x in values], pa.binary()), 1 << 40)
        assert (divergence._places(5, pa.array(values, pa.large_binary()), 1 << 40, width) == cut).all()
    assert (divergence._places(5, pa.array(values, pa.binary()).slice(100, 50), 1 << 40) == place[100:150]).all()
    assert (divergence._places(6, pa.array(values, pa.binary()), 1 << 40) != place).all()
    assert not len(divergence._places(5, pa.array([], pa.binary()), 1 << 40))


def test_divergence(spark, monkeypatch):
    rng = random.Random(5)
    names = ["a", "ab", "abc", "abcdefghijklmnopqrstuvwxyz" * 9, "abcdefghijklmnopqrstuvwxyy", "é", "éa", "日本語", "日本", "Zo", "zO", "x" * 5000, "ÀB"]
    rows = []
    for _ in range(220):
        text = "".join(rng.choice(names) + rng.choice([" ", "1", "\n", "-_", "\x00", "."]) for _ in range(rng.randint(0, 25)))
        rows.append((text, rng.choice(["en", "de", None, ""]), rng.choice([f"s{i}" for i in range(9)] + [None])))
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("", "xx", "two"), ("12 34", "xx", None), ("solo", "yy", "y")] + rows[:9]
    schema = "text string, lang string, source string, term string, share long, block long, n long"
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], schema)
    got = lambda: sorted(tuple(r) for r in divergence.divergence(df, min_docs=12, top=4).collect())
    want = brute_divergence(rows, 12, 4)
    assert got() == want
    monkeypatch.setattr(divergence, "TERMS", 2)
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "BITS", 8)  # all prefixes seem to be left
    monkeypatch.setattr(divergence, "PIECE", 512)
    assert got() == want
    assert divergence.divergence(df.where("false")).count() == 0


def test_prefixes_are_dropped_level_by_level(spark):
    rows = [("common rare%d" % i, "en", "s") for i in range(40)] + [("commode", "en", "s")] * 5
    d = common.written(divergence.documents(spark.createDataFrame(rows, "text string, lang string, source string")), "d")
    assert {tuple(r) for r in divergence.kept_terms(d, 30).collect()} == {("en", "common", 40), ("en", "rare", 40)}
    first = divergence._level(d, 0, 3, None).groupBy("prefix").agg(F.sum("n").alias("n")).collect()
    assert {bytes(r.prefix): r.n for r in first} == {b"com": 45, b"rar": 40}


# Hashes.


def morse(n):
    """A word that sums of powers of one base can't tell from its complement."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w[:n], w[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 128, 129, 256, 257, 512, 1024, 2048, 4096])
def test_words_with_equal_polynomials(n):
    from tokenizers import Tokenizer

    a, b = morse(n)
    own, lib = tokens.Encoder("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    for texts in ([a, b], [b], [f"x {a} {b} {a}", b]):
        assert own.ids(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    raw = (a + b).encode()
    one, two = jaccard.shingles(np.frombuffer(raw, np.uint8), np.array([0, n, 2 * n]), 4)
    assert one[0] != two[0]
    if n >= 256:
        data = np.frombuffer((a + b).encode(), np.uint8)
        row, start, windows, _, names, _ = substrings.blocks(data, np.array([0, n, 2 * n]))
        said = [data[n * r + s : n * r + s + w + 99].tobytes() for r, s, w in zip(row.tolist(), start.tolist(), windows.tolist(), strict=True)]
        assert len({(x, y) for x, y in zip(names.tolist(), said, strict=True)}) == len(set(names.tolist()))


def test_clashes_of_hashes_cost_nothing_but_time(monkeypatch):
    """With hashes that tell next to nothing ids are the library's still."""
    from tokenizers import Tokenizer

    own, lib = tokens.Encoder("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    real = own.hash.of
    monkeypatch.setattr(own.hash, "of", lambda *a: real(*a) % np.uint64(5))
    rng = random.Random(1)
    for _ in range(3):
        texts = [" ".join("".join(rng.choice("abc.é") for _ in range(rng.choice([1, 2, 3, 9, 300]))) for _ in range(40)) for _ in range(6)]
        assert own.ids(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# Personal data in long lists.


def test_lists_of_numbers_take_time_in_proportion(spark):
    lists = {
        "phones": lambda n: " ".join(f"+1 (555) 123-{i % 10000:04d}" for i in range(n)), "groups": lambda n: " ".join(f"555 123 {i % 10000:04d}" for i in range(n)),
        "hosts": lambda n: " ".join(f"10.{i % 256}.1.{i // 256 % 256}" for i in range(n)), "mails": lambda n: ";".join(f"a{i}@b.org" for i in range(n)),
    }
    other = [(100 + i, f"call +1 555 123 {i:04d} or (555) 999-{i:04d}, host 10.0.0.{i % 256}") for i in range(60)]

    def took(n):
        rows = [(k, f(n)) for k, f in enumerate(lists.values())]
        df = spark.createDataFrame(rows + other, "doc_id long, text string").coalesce(1)
        began = time.time()
        got = {r.doc_id: r for r in pii.detect(df).collect()}
        for k, t in rows:
            base = [(m.start(), m.end()) for m in re.finditer(pii.BASE["phone"] if k == 0 else r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+" if k == 2 else r"a[0-9]+@b\.org", t)] if k != 1 else []
            assert (got[k].n_phone, got[k].n_ip, got[k].n_email)[{0: 0, 2: 1, 3: 2}.get(k, 0)] == (len(base) if k != 1 else 0)
            assert all(f":{s}:{e}" in got[k].spans for s, e in base[:: max(1, len(base) // 50)])
        return time.time() - began

    took(100)
    small, large = took(400), took(6400)
    assert large < 16 * max(small, 2.0)


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 31, 32, 33, 1023, 1024, 1025, 3000])]
    df = spark.createDataFrame(rows, "k long, a array<int>")
    for r in df.select("a", pii._before(F.col("a")).alias("b"), pii._before(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).collect():
        assert r.b == [sum(r.a[:i]) for i in range(len(r.a))] and r.m == [max([0, *r.a[:i]]) for i in range(len(r.a))]
    text = "".join(chr(rng.choice([97, 233, 26085, 128512])) for _ in range(1000))
    ends = [(a, b) for a in (0, 1, 63, 64, 65, 500, 999) for b in (a, a + 1, a + 63, a + 64, a + 200) if b <= 1000]
    got = spark.createDataFrame([(text,)], "t string").select(*[pii._part(pii._lines(F.col("t")), F.lit(a), F.lit(b)).alias(f"x{i}") for i, (a, b) in enumerate(ends)]).first()
    assert list(got) == [text[a:b] for a, b in ends]


def test_recall_of_written_out_forms(spark):
    """Of forms that no base pattern finds and nothing announces, nine tenths at least are found, where most of
    their kind are announced."""
    rng = random.Random(8)
    announced = [(i, rng.choice(["Mail to", "write:", "contact"]) + f" {rng.choice('abcdef')}{i}{rng.choice([' [at] ', '(at)', '[AT]'])}corp{i % 31}{rng.choice([' [dot] ', '(dot)', '[DOT]'])}com today") for i in range(200)]
    announced += [(300 + i, f"{rng.choice(['call', 'phone', 'fax'])} ({200 + i}) {300 + i}-{1000 + 7 * i} now") for i in range(200)]
    noise = [(600 + i, f"on 2024-0{1 + i % 9}-1{i % 10} we shipped {i * 37} parts of lot {100 + i}-{i * 13}; see a.b at noon") for i in range(300)]
    planted = [(1000 + i, f"the desk of {rng.choice('abcdef')}{i} [at] firm{i % 17} (dot) net, as ever", "email") for i in range(15)] + [(1200 + i, f"it rang ({300 + i}) {400 + i}-{2000 + 3 * i} for long", "phone") for i in range(15)]
    df = spark.createDataFrame(announced + noise + [(i, t) for i, t, _ in planted], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    found = Counter(kind for i, _, kind in planted if got[i].startswith(kind))
    assert found["email"] >= 14 and found["phone"] >= 14
    assert sum(bool(got[i]) for i, _ in noise) <= 3


# Chat records.


def test_records_that_no_encoding_holds_and_callers_mappings(spark):
    records = [
        (1, 0, '{"prompt": "a\\ud800", "completion": "b"}'), (2, 0, '{"id": 7, "prompt": "p", "completion": "c", "metadata": {"x": [1, 2]}}'), (3, 0, '{"q": "p", "a": "c"}'), (4, 0, '{"prompt": "p", "completion": "c", "other": 1}'), (5, 0, '{"\\udfff": 1}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, turn long, record string")
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    assert "surrogates" in got[1].rejected and chat.parse(got[2].formatted) == [("user", "p"), ("assistant", "c")]
    assert all("no mapping" in got[i].rejected for i in (3, 4)) and got[5].rejected and chat.read_back(chat.format_records(df)).count() == 1
    own = [{"fields": ["q", "a"], "turns": [("user", ["q"]), ("assistant", ["a"])]}]
    got = {r.conv_id: r for r in chat.format_records(df, own, ignored=set()).collect()}
    assert chat.parse(got[3].formatted) == [("user", "p"), ("assistant", "c")] and all(got[i].rejected for i in (1, 2, 4, 5))
    assert json.loads(got[2].record)["id"] == 7


def test_shuffles_of_written_tables_go(spark, monkeypatch):
    shuffled = lambda: sum("shuffle_" in b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()))
    monkeypatch.setattr(common, "SWEEP", 0.0, raising=False)
    common.written(spark.range(10), "sweep")  # what other tests have left
    time.sleep(3)
    before = shuffled()
    common.written(spark.range(1000, numPartitions=5).repartition(7, "id"), "sweep")
    assert shuffled() > before
    common.written(spark.range(10), "sweep")
    until = time.monotonic() + 10
    while shuffled() > before and time.monotonic() < until:
        time.sleep(0.2)
    assert shuffled() <= before


def test_near_duplicates_leave_no_texts_behind(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    docs = spark.createDataFrame([*rows, *[(100 + i, t + " more") for i, t in rows[:6]]], "doc_id long, text string")
    before = common.made()
    kept = jaccard.without_near_duplicates(docs, k=3, per_cent=80)
    left = [f.rpartition("/")[2].partition("-")[0] for f in common._folders[before:]]
    assert "sets" in left and not {"groups", "classes", "texts", "labels"} & set(left)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
