"""The training-data operators against brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import chat, common, ctw, induced, jaccard, packing, pieces, pii, quality, substrings, tokenfile, tokens, topk

random.seed(5)
BASE = "".join(random.choice("abé\n ") for _ in range(900))
DOCS = [
    (1, BASE), (2, BASE[100:700]), (3, None), (4, ""), (5, "a" * 1000), (6, "ab" * 400), (7, BASE[:300] + "x" + BASE[301:]), (8, "a" * 99), (9, BASE[50:149] + "Q" + BASE[149:250]),
    (10, "\x00" * 300), (11, BASE), (12, "Mail a@b.org or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1. 300.1.1.1"), (13, "one two three"), (14, "ONE two  Three"), (15, "日本😀 " * 60), (16, " \t\n"), (17, "w " * 30000), (None, "no id"),
]
SCHEMA = "doc_id long, text string, source string, n long, c long, t string, key string, _row string"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns beside the needed ones have names that clash with those used inside."""
    return spark.createDataFrame([(i, t, "h", 1, 2, "x", "y", "z") for i, t in DOCS], SCHEMA)


def known():
    return [(i, t) for i, t in DOCS if i is not None]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    own, lib = tokens.Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
    lib.encode_special_tokens = True
    odd = ["a", "", None, "  x", "x \n y", "a.b,c", "it's.'s", "é.è×.", "\n\na. b", ". . ,", "a  b", "a \nb", "<|endoftext|> x", "x.\n", " ", "ΣΑΣ. ΑΣ ΑΣ,", "1,000.5 $.", *[t for _, t in DOCS]]
    for _ in range(2):  # the second time from the memo
        assert own.ids(odd) == [np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_packing(spark, docs):
    r = packing.pack(packing.pieces(docs)).collect()
    enc = tokens.Encoder(packing.TOKENIZER)
    ids = {i: x + b"\0\0\0\0" for (i, t), x in zip(DOCS, enc.ids([t for _, t in DOCS]), strict=True)}
    assert Counter(x.doc_id for x in r) == Counter({i: -(-len(x) // 8192) for i, x in ids.items()})
    at = defaultdict(list)
    for x in r:
        own = ids[x.doc_id][4 * x.start : 4 * (x.start + x.length)]
        assert x.start == 2048 * x.piece and len(own) == 4 * x.length and zlib.crc32(own) == x.ids_crc32
        at[x.sequence_id].append((x.offset, x.length))
    for v in at.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048


def plain_loop(lengths, capacity):
    """Best-fit decreasing piece by piece: the contents of the bins."""
    free, inside = [], []
    for n in sorted(lengths, reverse=True):
        fit = [(f, i) for i, f in enumerate(free) if f >= n]
        if not fit:
            fit = [(capacity, len(free))]
            free.append(capacity)
            inside.append([])
        free[min(fit)[1]] -= n
        inside[min(fit)[1]].append(n)
    return inside


def test_best_fit_is_that_of_a_plain_loop():
    few = [Counter(random.choices([random.randint(1, 2048) for _ in range(random.randint(1, 6))], k=random.randint(1, 40)).copy()) for _ in range(3000)]
    many = [Counter(random.randint(1, 40) for _ in range(random.randint(0, 300))) for _ in range(60)]
    for counts, capacity in [(Counter([400] + [500] * 2 + [600] * 4), 2048), *((c, 2048) for c in few), *((c, 40) for c in many)]:
        want = plain_loop(list(counts.elements()), capacity)
        held, seen = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset, each in packing.best_fit_decreasing(counts, capacity).tolist():
            seen[length] += range(rank, rank + n)
            for k in range(n):
                held[first + k // each].append((offset + k % each * length, length))
        assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items()) and len(seen) == len(counts)
        for v in held.values():
            v.sort()
            assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= capacity
        assert len(held) == len(want)
        assert Counter(sum(n for _, n in v) for v in held.values()) == Counter(map(sum, want))


def brute_top(rows, k=5, every=50):
    """Exact scores by whole numbers, cut to 64 bits after the ranking."""
    good = [(i, [math.floor(Fraction(x) * 256) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for q in sorted({i for i, _ in good if i % every == 0}):
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for own, a in good if own == q for i, b in good if i != q and len(a) == len(b))
        want.update((q, r + 1, i, min(max(-x, -(1 << 63)), (1 << 63) - 1)) for r, (x, i) in enumerate(s[:k]))
    return want


@pytest.mark.parametrize("large", [0.0, 2.0**23, 1.0e18, 1.7e308])
def test_top_k(spark, large):
    single = lambda x: float(np.float32(x)) if large < 1e30 else x
    v = [(i, [single(random.choice([-1.0, 0.5, 0.25, float(i % 7), large if i % 3 == 0 else 0.1, -large if i % 5 == 0 else 0.2])) for _ in range(6)]) for i in range(400)]
    v += [(900, None), (950, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1000, [float("nan")] * 6), (1050, [single(0.1)]), (1100, []), (1150, [float("inf")] * 6), (1200, [single(large), 8.0e6, 8.0e6, 8.0e6, 8.0e6, 1.0]), (1201, [8.0e6] * 6)]
    v += [(100, v[3][1]), (101, v[3][1]), (101, v[3][1])]
    df = topk.finite_vectors(spark.createDataFrame(v, f"vec_id long, embedding array<{'float' if large < 1e30 else 'double'}>"), "vec_id", "embedding")
    assert Counter(map(tuple, topk.top_k(df, "id % 50 = 0", 5, shard=64).collect())) == brute_top(v)


def test_top_k_query_on_repeats_and_an_empty_table(spark, tmp_path):
    rows = [(i % 120, [float(i % 5), 1.0, -0.3]) for i in range(300)]
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, "vec_id long, embedding array<float>, id long, shard int" if not some else "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = topk.op2_exact_topk(spark, f"{tmp_path}/{name}").collect()
        assert Counter(map(tuple, got)) == brute_top([(i, [float(np.float32(x)) for x in e]) for i, e in some])


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n, k = int(rng.integers(1, 60)), int(rng.integers(2, 5))
        t = rng.integers(1, k + 1, n).astype(np.uint16)
        t = np.append(np.tile(t[: max(1, n // 4)], 6) if trial % 3 == 0 else t, 0).astype(np.uint16)
        sa, lcp = induced.suffix_array(t, k + 2, 100)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == want
        for a, b, x in zip(want[:-1], want[1:], lcp[1:].tolist(), strict=True):
            same = 0
            while max(a, b) + same < len(t) and t[a + same] == t[b + same]:
                same += 1
            assert min(x, 100) == min(same, 100)


def test_queues_spill(monkeypatch):
    t = np.append(np.random.default_rng(2).integers(1, 5, 3000), 0).astype(np.uint16)
    whole = induced.suffix_array(t, 6, 100)
    monkeypatch.setattr(induced, "MEMORY", 500)
    monkeypatch.setattr(induced, "FEED", 50)
    assert [x.tolist() for x in induced.suffix_array(t, 6, 100)] == [x.tolist() for x in whole]


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def test_repeats(spark, docs):
    want = brute_repeats(known())
    got = substrings.deduplicate(docs.where("doc_id is not null")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    again = substrings.deduplicate(docs.union(docs.where("doc_id = 2"))).where("doc_id = 2").collect()
    assert sorted(r.n_removed for r in again) == [600 + len(BASE[100:700].encode()) - 600] * 2
    cut = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert cut[11].text == "" and cut[1].text == BASE and cut[3].text is None and cut[1].key == "y"


@pytest.mark.parametrize("hot", [150, 1200, 20_000])
def test_common_phrase_in_many_surroundings(spark, monkeypatch, hot):
    """Anchors of more bytes than HOT are split, down to single windows."""
    monkeypatch.setattr(substrings, "HOT", hot)
    some = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    phrase, longer, ends = "the phrase that is in a great many texts", some(120), [some(30) for _ in range(4)]
    rows = [(i, some(random.randint(0, 150)) + random.choice(ends) + random.choice([phrase, longer]) + random.choice(ends) + some(random.randint(0, 150))) for i in range(300)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_repeats(rows)


def test_parts_cover_all_windows_once():
    for place, windows in ((0, 1), (72, 73), (72, 1), (40, 17), (36, 37)):
        for parts in substrings.PARTS:
            seen = []
            for _, first, own, a, b in substrings.parts_of(place, windows, parts):
                seen += range(first, first + own)
                assert first + own - 1 <= a < b <= first + 100
            assert sorted(seen) == list(range(windows))


def test_long_text_in_segments(monkeypatch):
    data = np.frombuffer((BASE * 3).encode(), np.uint8)
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    row, s, n, *_ = substrings.blocks(data, np.array([0, len(data)]))
    assert n.sum() == len(data) - 99 and (s[1:] == s[:-1] + n[:-1]).all()


def test_quality(spark, docs):
    lines = [(100 + i, f"Shared line of this host here\n{' '.join(random.choice('abcdefgh') * 3 for _ in range(4))} {i} q{i} r{i} s{i} t{i} u{i} v{i}", "big", 1, 2, "x", "y", "z") for i in range(40)]
    thin = [(200, "Shared line of this host here\nShared line of this host here\nx y", "big", 1, 2, "x", "y", "z")]
    got = {r.doc_id: r for r in quality.quality_rules(docs.union(spark.createDataFrame(lines + thin, SCHEMA))).collect()}
    for i, t in DOCS:
        w, r = [x.decode() for x in words(t)], got[i]
        kept = [x for x in (t or "").split("\n") if words(x)]
        c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(kept) - len(set(kept)), len(cover)), i
        assert r.n_symbols == sum((t or "").count(x) for x in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert all(got[100 + i].kept and got[100 + i].removed_words == 6 for i in range(40))
    assert not got[200].kept and got[200].removed_words == 12
    assert {r.doc_id for r in quality.quality_filter(docs).collect()} == {i for i, _ in DOCS if got[i].kept}


def test_scores(spark, docs):
    got = {r.doc_id: r for r in ctw.score_texts(docs.where("doc_id is not null")).collect()}
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    c = Counter(w for i, t in known() if train(i) for w in [*words((t or "").encode().lower().decode()), None])
    n, v = sum(c.values()), len(c)
    for i, t in known():
        w = [*words((t or "").encode().lower().decode()), None]
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (not train(i), len(w), sum(c[x] > 0 for x in w), n)
    depth, count = ctw.DEPTH, defaultdict(lambda: [0, 0])

    def walk(t):
        y = [255] * depth + list((t or "").encode().lower()) + [255]
        for p in range(depth, len(y)):
            node = 1
            for k in range(7, -1, -1):
                yield tuple(y[p - depth : p][::-1]), node, y[p] >> k & 1
                node = 2 * node + (y[p] >> k & 1)

    for i, t in known():
        if train(i):
            for ctx, node, bit in walk(t):
                for d in range(depth + 1):
                    count[ctx[:d], node][bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    kids, weighted = defaultdict(list), {}
    for ctx, node in sorted(count, key=lambda k: -len(k[0])):
        own = kt(*count[ctx, node])
        weighted[ctx, node] = own if len(ctx) == depth else math.log(0.5) + float(np.logaddexp(own, sum(weighted[k] for k in kids[ctx, node])))
        if ctx:
            kids[ctx[:-1], node].append((ctx, node))

    def one(ctx, node):
        q = 0.5
        for d in range(depth, -1, -1):
            if (key := (ctx[:d], node)) in count:
                z, o = count[key]
                p = (o + 0.5) / (z + o + 1)
                beta = 1.0 if d == depth else math.exp(math.log(0.5) + kt(z, o) - weighted[key])
                q = beta * p + (1 - beta) * q
        return q

    for i, t in known():
        if len(t or "") < 400:
            assert got[i].score == pytest.approx(sum(math.log10(one(x, k) if b else 1 - one(x, k)) for x, k, b in walk(t)), abs=1e-4)


def test_token_files(spark, docs):
    d = docs.where("doc_id is not null")
    got = sorted(tokenfile.read_tokens(tokenfile.write_tokens(d)).collect())
    enc, start = tokens.Encoder(tokenfile.TOKENIZER), 0
    for r, (i, t) in zip(got, sorted(known()), strict=True):
        ids = enc.ids([t])[0] + b"\0\0\0\0"
        assert tuple(r) == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    for v in (np.zeros(5, np.uint32), np.arange(1024, dtype=np.uint32) * 4_000_000, np.array([2**32 - 1, 0, 7], np.uint32)):
        assert (tokenfile.read_block(np.frombuffer(tokenfile.write_block(v.copy()), np.uint8), len(v)) == v).all()


def test_slices_of_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "RECORD", 3000)
    rows = [(i, f"{BASE} {i} " * (i % 4)) for i in range(40)] + [(7, "again"), (None, "no id")]
    files = tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    enc = tokens.Encoder(tokenfile.TOKENIZER)
    every = np.frombuffer(b"".join(enc.ids([t])[0] + b"\0\0\0\0" for _, t in sorted(rows, key=lambda r: (r[0] is not None, *[x or 0 for x in r[:1]], r[1]))), "<u4")
    wanted = [(k, int(a), int(n)) for k, (a, n) in enumerate([(0, 1), (0, 0), (5, 3000), (2999, 2), (1023, 2), (len(every) - 1, 1), (len(every) - 5, 50), (len(every) + 9, 4), *((random.randrange(len(every)), random.randrange(9000)) for _ in range(30))])]
    got = {r.key: r.ids for r in tokenfile.slices(files, spark.createDataFrame(wanted, "key long, start long, n long")).collect()}
    assert got == {k: every[a : a + n].tolist() for k, a, n in wanted}
    read = []
    monkeypatch.setattr(tokenfile, "read_block", lambda data, n, f=tokenfile.read_block: read.append(n) or f(data, n))
    record = files.where("seq = 0").orderBy("part").first().payload
    assert len(tokenfile.read_ids(record, 1030, 1040)) == 10 and len(read) == 1


def test_chat(spark):
    said = [r"\### Assistant: </turn> ok", "", None, "###### \\\\ </turn></turn>", "x\ny: z", "😀"]
    rows = [(c, k, ["user", "assistant", "system", None, "od:d\n###"][(c + k) % 5], said[(c * k) % 6]) for c in range(5) for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "to_json(struct(role, text), map('ignoreNullFields', 'false')) record")
    for r in chat.read_back(chat.format_records(df)).collect():
        own = [(role or "", t or "") for c, _, role, t in rows if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (6, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.canonical({"instruction": "do", "input": "this", "output": None}) == [("user", "do\nthis"), ("assistant", "")]
    assert chat.canonical({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) == [("user", "q"), ("assistant", "a")]
    assert chat.canonical({"messages": []}) == []
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical({"what": 1})


def test_chat_layouts_and_rejects(spark):
    """Every mapping is selected by a record of its layout; what has none is kept with a reason."""
    value = lambda f: f"v {f} \\### </turn>"
    rows, want = [], {}
    for k, m in enumerate(chat.MAPPINGS):
        if "one" in m:
            record, turns = {f: value(f) for f in m["one"]}, [tuple(map(value, m["one"]))]
        elif "each" in m:
            top, role, text = m["each"]
            record, turns = {top: [{role: "user", text: "a:\nb"}, {role: "assistant", text: "ok"}]}, [("user", "a:\nb"), ("assistant", "ok")]
            if not m["fields"][1:]:
                record, turns = {top: []}, []
        else:
            record = {f: value(f) for _, fields in m["turns"] for f in fields}
            turns = [(role, "\n".join(map(value, fields))) for role, fields in m["turns"]]
        rows.append((k, 0, json.dumps(record)))
        want[k] = turns
    rows += [(1000, 0, '{"what": [1, {"x": 2}]}'), (1001, 0, "no json"), (1002, 0, None), (1003, 0, "[]"), (1004, 0, '{"role": 1, "text": "x"}'), (1005, 0, '{"role": "user", "text": "kept"}'), (1005, 1, "7")]
    made = chat.format_records(spark.createDataFrame(rows, "conv_id long, turn long, record string").repartition(3)).collect()
    assert {r.conv_id: chat.parse(r.formatted) for r in made if r.conv_id < 1000} == want
    assert {(r.conv_id, r.turn) for r in made if r.rejected} == {(1000, 0), (1001, 0), (1002, 0), (1003, 0), (1004, 0), (1005, 1)} and all((r.formatted is None) == (r.rejected is not None) for r in made)
    back = chat.read_back(chat.format_records(spark.createDataFrame(rows, "conv_id long, turn long, record string"))).collect()
    assert {r.conv_id: r.n_turns for r in back} == {k: len(v) for k, v in want.items() if v} | {1005: 1} | {k: 0 for k, v in want.items() if not v}
    none = spark.createDataFrame([], "conv_id long, turn long, record string")
    assert chat.read_back(chat.format_records(none)).count() == 0


def test_frequent_lines_are_removed(spark):
    import corpus_pipeline

    own = lambda i: " ".join(f"{chr(97 + j)}{i}" for j in range(12))
    rows = [(i, f"{own(i)}\n\n Subscribe  to OUR letter now \nlast {i}", "en", "big", 1) for i in range(40)]
    rows += [(50, "Subscribe to our letter now\n" + own(50), "en", "small", 1), (51, "subscribe to our letter now\n" * 8 + "x y", "en", "big", 1), (52, f"{own(52)}\n\nend", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.keep_good(spark, df.union(df), "").collect()}
    want = {i: f"{own(i)}\n\nlast {i}" for i in range(40)} | {i: t for i, t, *_ in rows if i in (50, 52)}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_documents_of_several_shared_lines_are_distinct(spark):
    footer = "\n".join(f"footer line number {j} of all pages" for j in range(10))
    rows = [(i, f"{footer}\nown words {i}", "big") for i in range(100)]
    rows += [(200 + i, "copied line of words one two three four\nand five six seven eight", "copies") for i in range(100)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 70 and not got[i].kept for i in range(100))
    assert all(got[200 + i].removed_words == 0 and got[200 + i].kept for i in range(100))


def brute_links(docs, k, per_cent):
    sets = {}
    for i, t in docs:
        w = words((t or "").encode().lower().decode())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "per_cent"), [(4, 85), (5, 80)])
def test_near_duplicates(spark, docs, monkeypatch, k, per_cent):
    text = " ".join(f"{random.choice('abcd')}{i}" for i in range(120)).split()
    near = [(100 + i, " ".join(w if random.random() > 0.012 * (i % 5) else "zz" for w in text)) for i in range(60)]
    monkeypatch.setattr(jaccard, "GROUP", 16)
    df = docs.where("doc_id is not null").select("doc_id", "text", "c").union(spark.createDataFrame([(i, t, 1) for i, t in near], "doc_id long, text string, c long"))
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.jaccard_join(df, k=k, per_cent=per_cent).collect()}
    assert got == brute_links(known() + near, k, per_cent)
    stay = {r.doc_id for r in jaccard.without_near_duplicates(df, k=k, per_cent=per_cent).collect()}
    assert stay == {i for i, (_, c) in got.items() if c == i}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_personal(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if j % 2 == 0 else 2 * x - 9 * (x > 4) for j, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn or k == "phone" and 8 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs):
    more = [(50, "a@b.c%d@e.f"), (51, "a@b" + ".c" * 20000), (52, "1" * 30000), (53, "a" * 50000 + "@"), (54, "1.2.3.4.5.6.7.8 é 256.1.1.1 😀 1.2.3.4"), (55, "+1 (555) 123-4567 x 4111 1111 1111 1111, 4111-1111-1111-1112")]
    df = docs.select("doc_id", "text", "_row").union(spark.createDataFrame([(i, t, "") for i, t in more], "doc_id long, text string, _row string"))
    texts = dict(DOCS + more)
    for r in pii.detect(df).collect():
        base = brute_personal(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in base) for k in PATTERNS)
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[3] is None and out[1] == BASE and out[12].startswith("Mail <EMAIL> or <PHONE>, <CARD>, <IP>. ")


def test_numbers_inside_longer_runs(spark):
    card, two = "4111 1111 1111 1111", "4111 1111 1111 1111 5500 0000 0000 0004"
    rows = [(1, f"{card} 12/27 123"), (2, two), (3, "1 " * 300), (4, "+1 (555) 123-4567 9999 8888"), (5, "7" * 3000)]
    more = {r._id: {(x.k, x.s, x.e) for x in r._more} for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert (2, 0, 19) in more[1] and {(2, 0, 19), (2, 20, 39)} <= more[2] and (3, 0, 17) in more[4] and not more[5]
    rows = rows[:2] + [(1000 + i, f"paid by {card}, thanks") for i in range(600)] + [(100 + i, f"part {1000 + 37 * i} 5678 9012 {3450 + i % 7}, or {10000000 + 37 * i}") for i in range(60)]
    got = {r.doc_id: r.spans.split(",") for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "card:0:19" in got[1] and {"card:0:19", "card:20:39"} <= set(got[2])


def test_pieces_are_the_librarys():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL)), pieces.Pieces()
    odd = ["Hello world", "  two  spaces ", "a\tb\nc", "", None, "▁x", "x▁▁y  z", "　ﬁ é", "日本😀" * 40, "\x00a\x00", " ", "a" * 500, "x.", "...", ".", "      .,  ,", "你好世界" * 100 + "  😀", *[t for _, t in DOCS]]
    got = own.encode(odd)
    assert got == [np.array(lib.encode(t or ""), "<u4").tobytes() for t in odd]
    for t, x in zip(odd, got, strict=True):
        if "▁" not in (t or ""):
            assert own.decode(np.frombuffer(x, "<u4")) == (t or "")


def test_empty_tables(spark, docs):
    none = docs.where("doc_id = -1")
    for made in (packing.pack(packing.pieces(none)), substrings.deduplicate(none), quality.quality_rules(none), ctw.score_texts(none), tokenfile.read_tokens(tokenfile.write_tokens(none)), jaccard.jaccard_join(none), pii.detect(none), pieces.encode(none)):
        assert made.count() == 0


def test_repeated_rows(spark, docs):
    twice = docs.union(docs)
    for made in (packing.pieces(twice), quality.quality_rules(twice), jaccard.jaccard_join(twice), pii.detect(twice), ctw.score_texts(twice)):
        assert made.count() >= 2 * len(DOCS)


def test_written_out_personal_data(spark):
    """Forms that no base pattern finds, announced or not, are added; what isn't fit for its kind isn't."""
    rows = [(i, f"Please mail anna{i}.b@site{i % 17}.org today") for i in range(150)] + [(200 + i, f"you may contact info{i} [at] corp{i % 13} [dot] com for it") for i in range(150)]
    rows += [(400 + i, f"call us: +1 ({200 + i % 700}) 555-{1000 + 7 * i} now") for i in range(150)] + [(600 + i, f"phone ({200 + i % 700}) 555-{2000 + 7 * i} is open") for i in range(150)]
    rows += [(800 + i, f"on 2024-0{1 + i % 9}-1{i % 10} we shipped {i * 37} parts of lot {100 + i}-{i * 13} at noon") for i in range(300)]
    new = [(2000, "sales (at) shop9 (dot) net"), (2001, "so we meet (at) noon"), (2002, "The number (312) 555-7781 was free"), (2003, "on 2023-05-17 we shipped 4451 parts"), (2004, "nothing here")]
    got = {r.doc_id: (r.spans, r.base_sha256) for r in pii.detect(spark.createDataFrame(rows + new, "doc_id long, text string")).collect()}
    assert got[2000][0] == "email:0:26" and got[2002][0] == "phone:11:25"
    assert not got[2001][0] and not got[2003][0] and not got[2004][0]
    assert all(got[200 + i][0].startswith("email:16:") for i in range(150)) and all(got[600 + i][0].startswith("phone:6:") for i in range(150))
    assert not any(got[800 + i][0] for i in range(300))
    for i, t in rows + new:
        assert got[i][1] == hashlib.sha256(",".join(brute_personal(t)).encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows + new, "doc_id long, text string")).collect()}
    assert out[2000] == "<EMAIL>" and out[2002] == "The number <PHONE> was free" and out[2001] == new[1][1]


def test_boosting_learns_and_becomes_a_column(spark):
    x = np.array([[a, b] for a in range(20) for b in range(20)], float)
    y = ((x[:, 0] > 11) ^ (x[:, 1] > 7)).astype(float)
    trees = pii.boost(x, y, np.ones(len(y)))
    margins = np.array([sum(pii.score_tree(t, r) for t in trees) for r in x])
    assert ((margins > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([(r.tolist(),) for r in x], "f array<double>").select("f", pii.margin(trees, F.col("f")).alias("m"))
    assert {tuple(r.f): round(r.m, 6) for r in df.collect()} == {tuple(r): round(m, 6) for r, m in zip(x.tolist(), margins.tolist(), strict=True)}


CLASH = ["_doc", "_null", "_none", "_id", "_t", "_row", "_all", "_text", "_key", "_place", "_rejected", "_lines", "_gone", "_kept", "spans", "doc", "s", "h", "c", "n", "part", "kind", "length", "label", "key", "Null", "_more", "_base"]


def test_stages_keep_columns_of_any_name(spark):
    """Every stage but the last returns the caller's columns and values, whatever their names, with null
    and repeated rows, and for an empty table."""
    import corpus_pipeline

    good = lambda i: " ".join(f"{'abcdefgh'[(i * j) % 8]}{i}w{j}" for j in range(30))
    rows = [(i, t, "en", "h", 1, *(f"{c}{i}" for c in CLASH)) for i, t in [*((i, good(i)) for i in range(12)), (12, good(1)), (13, good(13) + " mail a@b.org"), (13, good(13) + " mail a@b.org"), (14, None), (None, good(20)), (16, "")]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        none = stage(spark, df.where("false"), "")
        assert none.count() == 0 and none.schema == out.schema or name == corpus_pipeline.STAGES[-1][0]
        got = out.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            assert len(got) == len(rows)
            continue
        assert out.columns == df.columns, name
        for r in got:
            i = r.doc_id if r.doc_id is not None else None
            assert all(r[c] == f"{c}{i}" for c in CLASH), (name, i)
        kept = Counter(r.doc_id for r in got)
        if name == "quality_rules":
            assert kept == Counter([*range(14), 13, None])
        elif name == "ngram_jaccard_join":
            assert kept == Counter([*range(12), 13, 14, None, 16])
        else:
            assert kept == Counter(r[0] for r in rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = lambda i: " ".join(f"{random.choice('abcdefgh')}{i}w{j}" for j in range(60))
    passage = " ".join(f"pass{j}" for j in range(60))
    rows = [(i, good(i), "en", "h", 1) for i in range(8)]
    rows += [(10, rows[0][1], "en", "h", 1), (11, "short", "en", "h", 1), (12, None, "en", "h", 1), (13, good(13) + " " + passage, "en", "h", 1), (14, good(14) + " " + passage, "en", "h", 1), (15, good(15) + " mail a@b.org", "en", "h", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality_rules"]) == {*range(8), 10, 13, 14, 15} and set(seen["ngram_jaccard_join"]) == {*range(8), 13, 14, 15}
    assert "pass30" in seen["suffix_array_dedup"][13] and "pass30" not in seen["suffix_array_dedup"][14]
    assert seen["pii"][15].endswith("mail <EMAIL>")
    before = common.made()
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {*range(8), 13, 14, 15}
    assert common.made() == before + 1  # what the stages needed is gone
