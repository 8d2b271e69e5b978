"""Training-data operators against brute force, round trips and held-out accuracy on small tables."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardscope.llm import contamination, language, packing, passages, quality, repeats, secret_scan, simhash, token_files, tokens, topk
from wardscope.operators.components import components

FOLDER = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea".split()


def prose(rng, n, language="a"):
    letters = SYLLABLES if language == "a" else [s[::-1] + "ñ" for s in SYLLABLES]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def table(spark, texts, langs=None):
    rows = [(k, t, None if langs is None else langs[k], "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# ---- tokens and their files ----

TEXTS = ["It's a TEST's. o'clock don't!'s  \t tab é İstanbul ΣΑΣ. 123,45 a.b c., d.. x_y", "<|endoftext|> foo", "L'Été, d'une ñ.\nno", "", None, "日本語 テスト。½ ²", "'s 't, . ''", "A" * 5000, "٣ a² ǅ ﬁ"]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    whole, own = Tokenizer.from_file(path), tokens.WordEncoder(path, limit=5)
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t.,!'’-_aAéÉñß12²İΣſ́") for _ in range(30)) for _ in range(300)]
    for text in TEXTS + odd:
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, text


def test_blocks_and_files_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    for values in ([7], [5] * 100, rng.integers(0, 2**32, 4096), [0] * 50 + [2**32 - 1], rng.zipf(1.3, 3000) % 50000):
        values = np.asarray(values, "<u4")
        for q in (0, 50, 95, 100):
            assert token_files.unpack_block(token_files.pack_block(values, q)).tolist() == values.tolist()
    file = token_files.TokenFileWriter(str(tmp_path / "x.pfr"))
    docs = [(k if k != 3 else None, rng.integers(0, 49408, int(n)).astype("<u4")) for k, n in enumerate([0, 5, 70_000, 1, 4096, 0])]
    for doc_id, ids in docs:
        file.add(doc_id, ids.tobytes())
    file.close()
    back = token_files.TokenFile(str(tmp_path / "x.pfr"))
    got = list(back.documents(span=4096))
    assert [(d, i.tolist()) for d, _, i in got] == [(d, i.tolist()) for d, i in docs]
    assert back.read(4000, 200).tolist() == np.concatenate([i for _, i in docs])[4000:4200].tolist()


def test_token_files_query(spark):
    texts = TEXTS + [prose(random.Random(1), 3000)]
    got = sorted(token_files.tokenize_to_files(table(spark, texts).repartition(3)).collect())
    enc, start = tokens.encoder(tokens.tokenizer_path()), 0
    for row, text in zip(got, texts):
        ids = enc.encode(text) + np.asarray([2], "<u4").tobytes()
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


# ---- near copies ----

def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    for text in ["One two THREE four\x0bfive", "É a", "x", "a b c a b c a b c", prose(random.Random(2), 400)]:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), text.encode()))
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        h = [xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) % 2**64 == want
        assert simhash.fingerprint(text, chunk=7) % 2**64 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("crowd", [0, 3, 48])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        low = rng.choice([range(64), range(32), range(32, 64), range(8)])
        for _ in range(rng.randrange(1, 14)):
            x = base
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.choice(low)
            values.add(x)
    values = [x - 2**64 if x >= 2**63 else x for x in values] + [0, 1, 7]
    values = sorted(set(values))
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x in values:
        for y in values:
            if ((x ^ y) % 2**64).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    assert {v: roots.get(v, v) for v in values} == {v: find(v) for v in values}


def test_components_on_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}


# ---- packing ----

def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_the_program_uses_every_length_whole():
    """Three pieces fill a sequence at best: 2,000 pieces need 667, and the program leaves none of them to best fit."""
    r = np.random.default_rng(0)
    histogram = dict(zip(*(x.tolist() for x in np.unique(r.integers(120, 150, 2000), return_counts=True))))
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    used = np.zeros(len(lengths))
    for key, times in packing.solve_configurations(lengths, counts.copy(), 409).items():
        assert lengths[list(key)].sum() <= 409
        np.add.at(used, list(key), times)
    assert np.allclose(used, counts, atol=1e-3)
    assert sum(n for _, n in packing.plan_sequences(histogram, 409)) <= 675


def test_packing_holds_every_piece_once(spark):
    rng = random.Random(4)
    texts = TEXTS + [prose(rng, rng.randrange(1, 400)) for _ in range(60)] + ["same words here"] * 40
    rows = packing.pack(table(spark, texts), capacity=128).collect()
    enc = tokens.encoder(tokens.tokenizer_path())
    want = Counter()
    for k, text in enumerate(texts):
        ids = enc.encode(text) + np.asarray([1], "<u4").tobytes()
        for piece in range(-(-len(ids) // 512)):
            part = ids[512 * piece : 512 * piece + 512]
            want[(k, piece, 128 * piece, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert check_packed(rows, 128) <= -(-total // 128) + 2


def test_plans_are_near_the_bound():
    rng = random.Random(5)
    for n, capacity in ((1, 10), (30, 10), (500, 64), (3000, 300)):
        sizes = Counter(min(capacity, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(n))
        plan = packing.plan_sequences(dict(sizes), capacity)
        got = Counter()
        for parts, times in plan:
            assert sum(parts) <= capacity and times > 0
            for p in parts:
                got[p] += times
        assert got == sizes
        bound = -(-sum(k * v for k, v in sizes.items()) // capacity)
        assert sum(t for _, t in plan) <= bound * 1.12 + 1
    assert packing.plan_sequences({}) == []
    assert sum(n for parts, n in packing.plan_sequences({3: 7}, 5) if parts == (3,)) == 7


def test_knapsack_prices_the_best_configuration():
    rng = np.random.default_rng(2)
    for _ in range(10):
        lengths = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        values = rng.random(4)
        best = max(
            (sum(n * v for n, v in zip(ns, values)) for ns in np.ndindex(*(30 // l + 1 for l in lengths)) if sum(n * l for n, l in zip(ns, lengths)) <= 30), default=0
        )
        chosen, value = packing.price(values, lengths, 30)
        assert abs(value - best) < 1e-9 and sum(lengths[chosen]) <= 30


# ---- top-k ----

def brute_top(rows, k, every):
    vectors = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in vectors:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(0, 0.3, 16).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, rows[k % 3][1]) for k in range(60)]  # copies tie
    rows += [(500, None), (550, [float("nan")] * 16), (600, [None] * 16), (650, [0.5] * 3), (651, [0.25, 1.0, -1.0]), (None, [0.1] * 16), (700, [50.0] * 16), (750, [0.0] * 16), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks in ({}, {"vector_block": 100, "query_block": 5}):
        got = {tuple(r) for r in topk.top_k(df, every=10, **blocks).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == brute_top([(i, v) for i, v in rows], 5, 10)


def test_top_k_of_repeated_ids(spark):
    same = [0.5, -0.25, 1.0]
    data = [(50, same), (50, same)] + [(k, same) for k in (61, 62, 63, 64, 65)] + [(62, [0.0, 0.0, 0.1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[:3] for r in topk.top_k(df).collect())
    assert got == sorted([(50, r + 1, 61 + r) for r in range(5)] * 2)
    twice = spark.createDataFrame([(100, same)] + [(101, same)] * 9 + [(102, same)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in topk.top_k(twice).orderBy("rank").collect()] == [101] * 5
    assert [r.vec_id for r in topk.top_k(spark.createDataFrame([(100, same)] + [(101, same)] * 3 + [(102, same)], df.schema)).orderBy("rank").collect()] == [101, 101, 101, 102]


# ---- contamination ----

def test_lcs():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert contamination.lcs_length(a, b) == t[-1, -1]
        n, s, e = contamination.lcs_span(a, b)
        assert n == t[-1, -1] == contamination.lcs_length(a, b[s:e])


@pytest.mark.parametrize("block", [1024, 6])
def test_contamination_finds_planted_passages(spark, block):
    rng = random.Random(8)
    items = [prose(rng, rng.randrange(15, 50)) for _ in range(20)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, None), (51, ""), (52, "...")], "item_id long, text string")
    texts, want = [], set()
    for k in range(90):
        text = prose(rng, rng.randrange(60, 500)).split()
        if k % 3 == 0:
            item = k % 20
            part = items[item].split()
            if k % 2:  # a paraphrase: every sixth word is another
                part = [w if n % 6 else prose(rng, 1) for n, w in enumerate(part)]
            at = rng.randrange(len(text))
            text[at:at] = part
            want.add((k, item))
        texts.append(" ".join(text))
    texts += [None, "", items[3].upper()]
    want.add((92, 3))
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(table(spark, texts), bench, item_block=block).collect()}
    assert got == want


def test_contamination_at_any_benchmark_size(spark):
    """Over a thousand passages in one block, some of 500 words, some of three; copies stand in words of their own."""
    rng = random.Random(18)
    items = [prose(rng, (500, 3, 9)[k % 50] if k % 50 < 3 else rng.randrange(15, 60)) for k in range(1040)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, want, spans = [], set(), {}
    for k in range(0, 1040, 5):
        part = items[k].split()
        if k % 2 and len(part) > 9:  # a paraphrase: every sixth word is another
            part = [w if n % 6 else f"other{k}x{n}" for n, w in enumerate(part)]
        else:
            spans[k] = (31 + k % 4, 31 + k % 4 + len(part))
        texts.append(" ".join([f"before{k}x{n}" for n in range(31 + k % 4)] + part + [f"after{k}x{n}" for n in range(100)]))
        want.add((len(texts) - 1, k))
    for k in (1, 2, 51, 52):  # short ones
        texts.append(" ".join([f"before{k}x{n}" for n in range(33)] + items[k].split() + [f"after{k}x{n}" for n in range(50)]))
        want.add((len(texts) - 1, k))
    got = contamination.contaminated(table(spark, texts), bench).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert {k: (r.first_word, r.end_word) for r in got for k in [r.item_id] if k in spans and r.doc_id == k // 5} == spans


def test_latent_space_equals_a_direct_svd(spark):
    rng = np.random.default_rng(3)
    dense = rng.random((12, 30)) * (rng.random((12, 30)) < 0.5)
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in dense], "ids array<int>, weights array<double>").repartition(3)
    space = contamination.latent_space(rows, 12, 30, rank=6, power=6)
    want = np.linalg.svd(dense)[2][:6].T
    assert np.allclose(space @ space.T, want @ want.T, atol=1e-3)


# ---- passages ----

def test_chains_match_quadratic_search():
    rng = random.Random(9)
    for _ in range(30):
        matches = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        best = {}
        for a, b in matches:
            gains = [best[m] - passages.GAP_COST * (a - m[0] + b - m[1]) for m in best if m[0] < a and m[1] < b]
            best[(a, b)] = passages.SEED + max([0.0, *gains])
        found = passages.chains([a for a, _ in matches], [b for _, b in matches])
        assert sorted(m for c in found for m in c) == matches
        assert all(x[0] < y[0] and x[1] < y[1] for c in found for x, y in zip(c, c[1:]))
        worth = passages.SEED * len(found[0]) - passages.GAP_COST * sum(y[0] - x[0] + y[1] - x[1] for x, y in zip(found[0], found[0][1:]))
        assert abs(worth - max(best.values())) < 1e-9


def test_passages_of_planted_documents(spark):
    rng = random.Random(10)
    shared = [prose(rng, n).split() for n in (55, 80, 120)]
    texts, want = [], defaultdict(set)
    for k in range(60):
        words = prose(rng, rng.randrange(120, 400)).split()
        if k % 4 == 0:
            p = (k // 4) % 3
            part = list(shared[p])
            if k % 8 == 0 and p:  # edits: one word in 25 replaced, one dropped
                for at in range(12, len(part), 25):
                    part[at] = "changed" + str(k)
                del part[30]
            at = rng.randrange(len(words))
            words[at:at] = part
            want[p].add(k)
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], None, "", "short text"]
    got = passages.repeated_passages(table(spark, texts)).collect()
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
        assert r.end_word - r.start_word >= passages.LEAST_WORDS
    assert sorted(map(sorted, classes.values())) == sorted([*map(sorted, want.values()), [1, 60, 61]])


# ---- secrets ----

@pytest.mark.parametrize("ends", [(0, 45), (5, 50), (3, 48)])
def test_passages_among_documents_with_a_part_of_it(spark, ends):
    """Two documents share 50 words, ten with ids between them only 45 of these, so the two are no neighbours by their 32 words."""
    rng = random.Random(23)
    texts, want = [], []
    for _ in range(25):
        passage = prose(rng, 50).split()
        for k in range(12):
            part = passage if k in (0, 11) else passage[ends[0] : ends[1]]
            texts.append(" ".join([f"l{len(texts)}x{n}" for n in range(40)] + part + [f"r{len(texts)}x{n}" for n in range(40)]))
        want.append([len(texts) - 12, len(texts) - 1])
    classes = defaultdict(set)
    for r in passages.repeated_passages(table(spark, texts)).collect():
        classes[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, classes.values())) == want


def brute_base(text):
    text = text or ""
    out = []
    for kind, pattern in enumerate([r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]):
        for m in re.finditer(pattern, text, re.A | (re.I if kind == 0 else 0)):
            least = (m.end(2) - m.start(2) >= 6) if kind == 0 else m.end() - m.start() >= (20, 24)[kind - 1]
            if least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_by_definition():
    rng = random.Random(11)
    parts = ["password", "ToKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "é", "ſecret", "x=1", "=", "\n", "%41", "\\u0041"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        base, found = secret_scan.scan_deep(text)
        assert base == brute_base(text), text
        assert set(base) <= set(found) and found == sorted(found)
    assert secret_scan.scan_deep(None) == secret_scan.scan_deep("") == ([], [])


def test_nested_layers_map_back():
    inner = 'the token: "zzzzzzzz9" ok'
    once = base64.b64encode(inner.encode()).decode()
    for layer in (once, base64.b64encode(once.encode()).decode(), base64.b64encode(gzip.compress(inner.encode())).decode(), base64.b64encode(bz2.compress(inner.encode())).decode(), base64.b64encode(zlib.compress(once.encode())).decode()):
        text = f"é before {layer} after"
        base, found = secret_scan.scan_deep(text)
        added = set(found) - set(base)
        assert added
        for start, _, end in added:
            assert 9 <= start < end <= 9 + len(layer)
    text = "see pass%77ord%3Dqwertyu and \\u0074oken=abcdefg \\ud83d\\ude00"
    assert [text[a:b] for a, _, b in secret_scan.scan_deep(text)[1]] == ["pass%77ord%3Dqwertyu", "\\u0074oken=abcdefg"]
    twice = "to%256ben=abcdefgh"  # an escaped escape
    assert [twice[a:b] for a, _, b in secret_scan.scan_deep(twice)[1]] == ["to%256ben=abcdefgh"]
    assert secret_scan.without_secrets(text, "#") == "see # and # \\ud83d\\ude00"


def test_long_streams_are_read_to_their_end():
    bomb = base64.b64encode(gzip.compress(b"a b " * 20_000_000 + b"password=abcdefgh")).decode()
    late = base64.b64encode(gzip.compress(b"a b " * 20_000_000)).decode() + " " + base64.b64encode(b"password=abcdefgh").decode()
    assert (0, 0, len(bomb)) in secret_scan.scan_deep(bomb)[1]
    assert any(start > 0 for start, _, _ in secret_scan.scan_deep(late)[1])


def test_borders_of_pieces(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 50)
    monkeypatch.setattr(secret_scan, "OVERLAP", 30)
    for n in range(120):
        for pack in (gzip.compress, bz2.compress, zlib.compress):
            text = base64.b64encode(pack(b"- " * n + b"password=abcdefgh" + " é".encode() * n)).decode()
            assert [(s, k) for s, k, _ in secret_scan.scan_deep(text)[1]] == [(0, 0)]


def test_wrapped_lines_members_and_partial_runs():
    inner = "some words first, then password=abcdefgh and more words to fill lines of a letter, more than two of them"
    coded = base64.b64encode(inner.encode()).decode()
    for head, tail in (("", ""), ("mail\n", "\nregards"), ("mail:\n", "\nregards and more\n")):
        text = head + "\n".join(coded[k : k + 40] for k in range(0, len(coded), 40)) + tail
        spans = secret_scan.scan_deep(text)[1]
        assert len(spans) == 1, text
        start, kind, end = spans[0]
        assert kind == 0 and len(head) < start < end <= len(text) - len(tail)
    two = base64.b64encode(gzip.compress(b"nothing here") + gzip.compress(b"password=abcdefgh")).decode()
    assert secret_scan.scan_deep(two)[1]
    nested = base64.b64encode(gzip.compress(b"x = 1; password=abcdefgh")).decode()  # its content looks like a zlib header
    assert secret_scan.scan_deep(nested)[1]
    partial = "%ffpass%77ord%3Dqwertyu %41%ff%70%61%73%73%77%6f%72%64%3dqwertyu"
    found = [partial[a:b] for a, _, b in secret_scan.scan_deep(partial)[1]]
    assert found == ["pass%77ord%3Dqwertyu", "%70%61%73%73%77%6f%72%64%3dqwertyu"]
    lone = "\\ud800\\u0074oken=abcdefg"
    assert [lone[a:b] for a, _, b in secret_scan.scan_deep(lone)[1]] == ["\\u0074oken=abcdefg"]


# ---- repeats ----

def brute_repeats(texts, length):
    seen = Counter()
    datas = [(t or "").encode() for t in texts]
    for d in datas:
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] += 1
    out = []
    for d in datas:
        runs = repeats.removed([(k, k) for k in range(len(d) - length + 1) if seen[d[k : k + length]] > 1], length)
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + d[at:a], b
        kept += d[at:]
        out.append((len(d), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [50_000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CHUNK", 1500)
    rng = random.Random(crowd)
    for _ in range(2):
        base = prose(rng, 500)
        texts = [None, "", "é" * 300, "ab" * 700, "x" * 5000]
        for _ in range(20):
            text = ""
            for _ in range(rng.randrange(1, 5)):
                a = rng.randrange(len(base) - 900)
                text += rng.choice([base[a : a + rng.randrange(1, 900)], prose(rng, rng.randrange(1, 90)), (prose(rng, 4) + " ") * rng.randrange(1, 30), "-" * rng.randrange(1, 500)])
            texts.append(text)
        texts += [texts[7], texts[8] + "!"]
        keyed = repeats.keyed(table(spark, texts))
        spans = defaultdict(list)
        for r in repeats.repeated_ranges(keyed, crowd=crowd, batch_size=7).collect():
            spans[r.key].append((r.s1, r.s2))
        want = brute_repeats(texts, repeats.LENGTH)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(table(spark, texts)).collect()}
        assert [got[k] for k in range(len(texts))] == want
        by_id = {r.doc_id: spans.get(r.key, []) for r in keyed.collect()}
        assert [sum(b - a for a, b in repeats.removed(by_id[k])) for k in range(len(texts))] == [w[1] for w in want]


# ---- models ----

def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language.new_parameters(3, hidden=4).items()}
    x = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    mask = (np.arange(7)[:, None] < np.array([7, 3, 7, 1, 5])).astype(np.float32)
    y = np.array([0, 1, 2, 1, 0])
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = language.loss_and_gradient(p32, x, mask, y)
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step, losses = 1e-2, []
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p32.items()}
            q[name][at] += sign * step
            losses.append(language.loss_and_gradient(q, x, mask, y)[0])
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_language_of_held_out_rows(spark):
    rng = random.Random(12)
    langs = [rng.choice("ab") for _ in range(160)]
    texts = [prose(rng, rng.randrange(20, 120), v) for v in langs]
    langs += [None, "a", "a"]
    texts += [None, "123 !", ""]
    rows = language.identify(table(spark, texts, langs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert [got[k].lang_pred for k in (160, 161, 162)] == ["und"] * 3
    held = [k for k in range(160) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k].lang_pred == langs[k] for k in held) >= 0.97 * len(held)
    # every position counts: reading in other windows gives nearly the same mean
    fitted = language.train(texts[:100], langs[:100], steps=30)
    data = [t.encode() for t in texts[:20]]
    a, b = (language.document_probabilities(fitted[1], data, window=w) for w in (64, 4096))
    assert np.allclose(a.sum(axis=1), 1, atol=1e-3) and np.abs(a - b).max() < 0.2


def test_forest_and_its_flat_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.fit_forest(x[:600], y[:600], trees=40)
    assert ((forest.score(x[600:]) > 0.5) == y[600:]).mean() > 0.93

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
    assert quality.fit_forest(np.zeros((0, 5)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").withColumn("held", (F.crc32(F.col("doc_id").cast("string")) % 4) == 2).filter("held").collect()
    assert len(got) > 50 and sum((r.score >= 0.7) == (r.quality == 1) for r in got) >= 0.95 * len(got)
