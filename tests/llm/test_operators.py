"""The operators on small cases: brute force, and nulls, empty texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from lattica.llm import bpe, common, exact_dedup, near_dedup, ordinal, packing, pitman_yor, prefix_hash, quotes, sharding, simhash, suffix_dedup

CLASH = "doc_id long, text string, keep_id string, size string, fp string, group_id string, n_bytes string, tails string, row string, d1 string, node string, _part string"
ODD = [(1, "a b c"), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (5, "   "), (None, "x y"), (6, "é 😀 " * 400), (7, "é 😀 " * 400)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *["z"] * 10) for i, t in ODD], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def words(rng, n, kinds=300):
    return " ".join("abcdefgh"[: 2 + k % 6] + str(k) for k in (rng.randrange(kinds) for _ in range(n)))


# --- 8

def test_exact_dedup(spark, odd, empty):
    for limit in (dict(), dict(bits_per_row=20_000, broadcast_bytes=exact_dedup.BLOCK_BYTES)):
        got = exact_dedup.exact_dedup(odd, **limit)
        rows = got.collect()
        assert len(rows) == len(ODD) and got.columns[: 2] == ["doc_id", "text"] and rows[0]["size"] == "z"
        by = collections.defaultdict(list)
        for r in rows:
            by[r.text or ""].append(r)
        for text, group in by.items():
            ids = [r.doc_id for r in group]
            most = max((i for i in ids if i is not None), default=None)
            assert {r.group_size for r in group} == {len(group)} and {r.keep_id for r in group} == {most}
            assert [r.doc_id for r in group if r.kept] == [most]
            assert {r.text_sha256 for r in group} == {hashlib.sha256(text.encode()).hexdigest()}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_shuffles_possible_repeats_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {min(i, 1990)}") for i in range(2000)], "doc_id long, text string")
    staged, was = {}, exact_dedup.stage

    def seen(df, name, by=None):
        out = was(df, name, by)
        staged.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(exact_dedup, "stage", seen)
    for limit in (dict(), dict(bits_per_row=64, broadcast_bytes=2 * exact_dedup.BLOCK_BYTES)):  # the second: two segments
        staged.clear()
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, **limit).collect()}
        assert all(got[i].group_size == (10 if i >= 1990 else 1) and got[i].kept == (i < 1990 or i == 1999) for i in range(2000))
        assert 10 <= staged["maybe"][0].count() <= 80 and len(staged.get("probed", [])) == (2 if limit else 0)


# --- 4

def test_sharding(spark, odd, empty):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(1, 400)) for i in range(700)] + [(5, "x")] * 50, "doc_id long, text string")
    rows = sharding.shard_documents(docs, 16).collect()
    total = collections.Counter()
    for r in rows:
        total[r.shard] += r.size
    assert set(total) == set(range(16)) and max(total.values()) - min(total.values()) <= 2 * 401
    for s in range(16):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [r.doc_id for r in own] == sorted(r.doc_id for r in own)
    assert max(r.doc_id for r in rows if r.shard == 0) <= min(r.doc_id for r in rows if r.shard == 1)
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (2, 3)} == {1}
    assert {r.text_crc32 for r in got if r.doc_id == 1} == {zlib.crc32(b"a b c")}
    assert sharding.shard_documents(empty).count() == 0


# --- 5 and 3

def encodings():
    ranks = bpe.merger(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, empty):
    rng, reference = random.Random(5), encodings()
    parts = ["'", "s", "l", "re", "ve", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "''", "'ll", " 's", "　", "\x1c", "中", "😀", "́", "\x85", "-", "<|endoftext|>", "d'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["x" * 5000 + "ab" * 3000, " " * 3000, "é" * 999, "aaa" * 40]
    m = bpe.merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for encoder in (bpe.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), packing.id_encoder(public_tokenizers.path("byte_bpe_50k.json"))):
        for text, ids in zip(texts, encoder.ids(texts)):
            assert ids.tolist() == reference.encode_ordinary(text) and m.decode(ids) == text.encode()
            assert b"".join(bpe.slices(text)) == text.encode()
    got = bpe.encode_documents(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), ("ids", "offsets", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == len(ODD)
    for r, (_, text) in zip(got, ODD):
        data = (text or "").encode()
        assert r.ids == reference.encode_ordinary(text or "") and bytes(r.decoded) == data and r.n_tokens == len(r.ids)
        assert r.offsets == [0, *np.cumsum([len(reference.decode_single_token_bytes(i)) for i in r.ids])][: len(r.ids)]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(data).hexdigest()
    assert bpe.encode_documents(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_automaton_blocks():
    text = "it's a  test\n\n of 'll blocks" * 50
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    syms = bpe.symbols(points, np.zeros(1, int))
    assert (bpe.states_before(syms, 7) == bpe.states_before(syms, 10_000)).all()


def test_nnls():
    rng = np.random.default_rng(3)
    a, x = rng.random((12, 8)), np.maximum(rng.normal(size=8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=12)
    got = packing.nnls(a, b)
    gradient = a.T @ (a @ got - b)
    assert (got >= 0).all() and (gradient > -1e-7).all() and abs(gradient @ got) < 1e-6


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_plan(n):
    rng = np.random.default_rng(n)
    h = np.bincount(np.clip(rng.lognormal(3, 1, n).astype(int) + 1, 1, 64), minlength=65)
    used = np.zeros(65, int)
    for parts, times in packing.plan(h, 64):
        assert times > 0 and sum(parts) <= 64
        for p in parts:
            used[p] += times
    assert (used == h).all()


def test_packing(spark, odd, empty):
    path, reference = public_tokenizers.path("byte_bpe_50k.json"), encodings()
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 300))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, path, 128, 1, with_ids=True).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, text in rows:
        ids, own = reference.encode_ordinary(text) + [1], sorted(by[i], key=lambda r: r.start)
        assert sum((list(r.ids) for r in own), []) == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])][: len(own)] and sum(r.length for r in own) <= 128
    assert sorted(seq) == list(range(len(seq))) and sum(r.length for r in got) / (128 * len(seq)) > 0.93
    assert packing.pack_documents(odd, path).count() == len(ODD) and packing.pack_documents(empty, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, path, 100)


# --- 6

def test_prefix_hashes_against_whole_numbers():
    """Span hashes by plain integers, common extensions by comparing, and likeness by the true share of spans."""
    rng = random.Random(41)
    text = "".join(rng.choice("abé😀 ") for _ in range(700))
    p = prefix_hash.Prefix(text)
    for _ in range(200):
        a = rng.randrange(701)
        b = rng.randrange(a, 701)
        want = [sum((ord(c) + 1) * pow(base, i, prefix_hash.PRIME) for i, c in enumerate(text[a:b])) % prefix_hash.PRIME for base in prefix_hash.BASES]
        assert int(p.hash(a, b)[0]) == want[0] << 31 | want[1]
    other = text[:300] + "#" + text[300:]
    q = prefix_hash.Prefix(other)
    for _ in range(200):
        i, j = rng.randrange(701), rng.randrange(702)
        n = 0
        while i + n < 700 and j + n < 701 and text[i + n] == other[j + n]:
            n += 1
        assert p.extension(i, q, j) == n
    errors = []
    for _ in range(60):
        one = words(rng, 300, 3000)
        two = one[: rng.randrange(len(one))] + words(rng, rng.randrange(1, 300), 3000)
        spans = [{t[i : i + prefix_hash.SPAN] for i in range(len(t) - prefix_hash.SPAN + 1)} for t in (one, two)]
        share = 2 * len(spans[0] & spans[1]) / (len(spans[0]) + len(spans[1]))
        errors.append(prefix_hash.likeness(prefix_hash._Read(one).mark, prefix_hash._Read(two).mark) - share)
    assert abs(np.mean(errors)) < 0.04 and np.abs(errors).mean() < 0.09 and np.abs(errors).max() < 0.3


def test_prefix_hash(spark, odd, empty):
    rng = random.Random(4)
    a, b = prefix_hash.Prefix("xx" + "abcabc" * 50 + "z"), prefix_hash.Prefix("abcabc" * 50 + "y")
    assert a.extension(2, b, 0) == 300 and a.equal(2, b, 0, 300) and not a.equal(2, b, 0, 301) and not a.equal(0, b, 0, 9999)
    rows = [(i, words(rng, rng.randrange(0, 60))) for i in range(60)] + [(60, ""), (61, None), (62, "")]
    got = {r.doc_id: r for r in prefix_hash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        text, then = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + then[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.edited_fingerprint == prefix_hash._Read(changed).mark and r.fingerprint == prefix_hash._Read(text).mark
        assert r.common_edited == next((j for j in range(min(len(text), len(changed))) if text[j] != changed[j]), min(len(text), len(changed)))
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert got[60].near_next is not None and got[62].near_next == 1.0
    assert prefix_hash.fingerprint_documents(odd).count() == len(ODD) and prefix_hash.fingerprint_documents(empty).count() == 0
    one = prefix_hash.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_prefix_hash_extensions_stop_early(monkeypatch):
    """Texts that part early take few comparisons, whatever their lengths; extensions are right at every length."""
    asked, was = [], prefix_hash.Prefix.equal
    monkeypatch.setattr(prefix_hash.Prefix, "equal", lambda self, *a: asked.append(a) or was(self, *a))
    text = "".join(random.Random(5).choice("ab😀") for _ in range(5000))
    p = prefix_hash.Prefix(text)
    for n in (*range(40), 1023, 1024, 1025, 4999, 5000):
        q = prefix_hash.Prefix(text[:n] + "#" * 5000)
        asked.clear()
        assert p.extension(0, q, 0) == n and len(asked) <= 2 * n.bit_length() + 1
        assert p.extension(7, prefix_hash.Prefix("xyz" + text[7 : 7 + n]), 3) == min(n, 4993)


def test_prefix_hashes_of_great_numbers():
    """Arrays, single spans and joined texts of the largest code points, longer than 2^16, by plain integers."""
    text = "\U0010ffff" * 70_000
    p, q = prefix_hash.Prefix(text), prefix_hash.Prefix("\0" * 40 + text[:70])
    plain, sums = lambda t: [sum((ord(c) + 1) * pow(base, i, prefix_hash.PRIME) for i, c in enumerate(t)) % prefix_hash.PRIME for base in prefix_hash.BASES], []
    for t, x in ((text, p), ("\0" * 40 + text[:70], q)):
        a, b = plain(t)
        assert x.one(0, x.n) == int(x.hash(0, x.n)[0]) == a << 31 | b
        sums += [int(v.max()) for v in x.sums]
    assert max(sums) < prefix_hash.PRIME
    a, b = plain("\0" * 40 + text[:70] + text)
    assert q.joined(110, p, 70_000) == a << 31 | b
    assert [p.one(i, i + 16) for i in (0, 9, 69_984)] == [int(h) for h in p.hash(np.array([0, 9, 69_984]), np.array([16, 25, 70_000]))]
    assert len(set(p.spans().tolist())) == 1 and p.spans()[0] == prefix_hash._mixed(p.hash(5, 21))[0]


# --- 7

def test_ordinal(spark, odd, empty):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        g = rng.choice([0, 1, 2, 2])
        rows.append((i, words(rng, 40) + {0: " vile nasty", 1: " JUNK!! JUNK!!", 2: " fine"}[g], g))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, _, g in rows if i < 900] + [(5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.grade_documents(docs, labels, sample_rows=800).collect()}
    later = [(g, got[i]) for i, _, g in rows if i >= 900]
    assert np.mean([r.selected == (g == 2) for g, r in later]) > 0.97
    assert np.mean([(r.p_clean > 0.5) == (g > 0) for g, r in later]) > 0.9
    assert all(abs(r.expected_grade - r.p_clean - r.p_good) < 1e-9 and r.p_clean >= r.p_good for _, r in later)
    assert ordinal.grade_documents(odd, labels).count() == len(ODD) and ordinal.grade_documents(empty, labels).count() == 0
    assert ordinal.grade_documents(odd, labels.filter("false")).filter("selected").count() == len(ODD)


def test_ordinal_takes_each_label_once(spark):
    """Repeated labels, and columns named like added ones, change nothing."""
    rng = random.Random(31)
    rows = [(i, words(rng, 40, 200) + (" vile" if i % 3 == 0 else " fine" if i % 3 == 1 else "")) for i in range(150)]
    docs = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "doc_id long, text string, p_good string, selected string, tails string")
    labels = [(i, int(i % 3 == 1), int(i % 3 == 0)) for i in range(150)]
    one, two = (ordinal.grade_documents(d, spark.createDataFrame(some, "doc_id long, quality int, toxic int")) for d, some in ((docs.select("doc_id", "text"), labels), (docs.unionByName(docs), labels * 3)))
    first = {r.doc_id: r.p_good for r in one.collect()}
    again = two.collect()
    assert len(again) == 300 and all(abs(first[r.doc_id] - r.p_good) < 1e-9 for r in again)
    assert sum((r.p_good > 0.5) == (r.doc_id % 3 == 1) for r in again) > 280


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    m = ordinal.fit([(int(g), np.array([g, 9]), np.ones(2, np.float32)) for g in rng.integers(0, 4, 400)], 4)
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(m.weights[:4]) > 0).all()


# --- 9

def brute_prints(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("paired", [1, 16])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links(spark, paired, bits):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:25]:
        q = p
        for _ in range(4):
            q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, bits, paired)).collect()}
    want = reachable(signed, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits)
    assert {p: got.get(p, p) for p in signed} == want


def test_simhash(spark, odd, empty):
    rng = random.Random(9)
    base = [words(rng, 400) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base + [t + " Tail" for t in base] + [t.upper() for t in base] + ["", " ", None, "one", "Two words"])]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_prints(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == reachable(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0


def test_near_dedup(spark, odd, empty):
    rng = random.Random(10)
    rows, group = [], {}
    for g in range(25):
        w = words(rng, 200, 5000).split()
        for _ in range(4):
            own = w[:]
            for _ in range(2):
                own[rng.randrange(200)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    shared = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows}
    want = reachable(list(shared), lambda a, b: len(shared[a] & shared[b]) >= 0.8 * len(shared[a] | shared[b]))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: r.group_id for r in got}
    assert all(group[found[i]] == group[i] for i in found)
    assert sum(found[i] == want[i] for i in found) >= 0.97 * len(found)
    assert sum(r.kept for r in got) == len(set(found.values()))
    many = spark.createDataFrame([(i, " ".join(["same text of many words here for all"] * 9) + (f" end{i}" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    assert near_dedup.near_dedup(many).filter("kept").count() == 1
    out = near_dedup.near_dedup(odd)
    assert out.count() == len(ODD) and out.columns[:2] == ["doc_id", "text"] and near_dedup.near_dedup(empty).count() == 0


def near_found(spark, texts):
    """(groups that near_dedup finds, groups by brute force) of texts numbered in order."""
    shared = {i: set(simhash.shingle_hashes(t, 5)) for i, t in enumerate(texts)}
    want = reachable(list(shared), lambda a, b: len(shared[a] & shared[b]) >= 0.8 * len(shared[a] | shared[b]))
    got = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.group_id for r in got}, want


def test_near_dedup_links_block_edits_and_added_paragraphs(spark):
    rng = random.Random(21)
    texts = []
    for g in range(60):
        w = words(rng, 204, 5000)
        own = w.split()
        if g % 2:  # 18 of 204 words: 178 of 222 shingles stay
            at = rng.randrange(10, 170)
            own[at : at + 18] = words(rng, 18, 5000).split()
        else:  # 200 of 250 shingles
            own += words(rng, 50, 5000).split()
        texts += [w, " ".join(own)]
    got, want = near_found(spark, texts)
    assert len(set(want.values())) == 60 and got == want


@pytest.mark.parametrize("block", [near_dedup.__dict__.get("BLOCK_SHINGLES", 1 << 17), 3000])
def test_near_dedup_links_all_under_crowded_keys(spark, monkeypatch, block):
    """Texts of 12 of the same 16 paragraphs: nearly every shingle is in most texts."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block, raising=False)
    rng = random.Random(22)
    parts = [words(rng, 20, 5000) for _ in range(16)]
    texts = [" ".join(parts[k] for k in sorted(rng.sample(range(16), 12))) + f" end{i}" for i in range(70)]
    got, want = near_found(spark, texts)
    assert 1 < len(set(want.values())) < 70 and got == want


def test_near_dedup_ignores_how_often_a_line_repeats(spark):
    rng = random.Random(23)
    texts = []
    for _ in range(30):
        body, line = words(rng, 200, 5000), words(rng, 8, 5000)
        texts += [f"{body}\n{line}", body + f"\n{line}" * rng.choice([10, 50])]
    got, want = near_found(spark, texts)
    assert len(set(want.values())) == 30 and got == want


def test_near_dedup_finds_every_link_in_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: set(simhash.shingle_hashes(t or "", 5)) for i, t in rows}
    having, near = collections.defaultdict(list), collections.defaultdict(set)
    for i, t in rows:
        for h in sets[i] or {("no words", t or "")}:
            having[h].append(i)
    for group in having.values():
        for i in group:
            near[i].update(group)
    alike = {i: {j for j in near[i] if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    want = {}
    for i in sorted(sets):
        if i not in want:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in want:
                    want[j] = i
                    todo += alike[j]
    got = {r.doc_id: (r.group_id, r.kept) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (g, i == g) for i, g in want.items()} and len(set(want.values())) < len(want) - 20


def test_near_dedup_keeps_one_of_equal_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "x"), (None, "q", "x"), (None, "q", "x")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, extra string")).collect()
    assert len(got) == 6 and [r.group_id for r in got if r.kept and r.text != "q"] == [1] and sum(r.kept for r in got) == 2


# --- 10

def brute_removed(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(t), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) > 0)), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def brute_passages(texts, length, many):
    """Bytes in runs, of ``many`` words or more, of what repeated strings of ``length`` bytes, or of so many words in fewer, cover."""
    strings = [[(w[i].start(), w[i + many - 1].end()) for i in range(len(w) - many + 1)] for w in (list(re.finditer(rb"[^\x20\x09-\x0D]+", t)) for t in texts)]
    short = collections.Counter(t[a:b] for t, found in zip(texts, strings) for a, b in found if b - a < length)
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t, found in zip(texts, strings):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        for a, b in found:
            if b - a < length and short[t[a:b]] > 1:
                gone[a + 1 : b + 1] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)))
        yield sum(int(b - a) for a, b in edge.reshape(-1, 2) if sum(a <= w.start() and w.end() <= b for w in re.finditer(rb"[^\x20\x09-\x0D]+", t)) >= many)


@pytest.mark.parametrize("length,passage", [(64, None), (100, None), (120, (64, 14)), (64, (64, 14))])
def test_suffix_dedup(spark, length, passage):
    rng = random.Random(length)
    passages = [words(rng, 40) for _ in range(6)] + [" ".join(rng.choice("abcdefghij") for _ in range(40))]
    texts = []
    for i in range(60):
        parts = [words(rng, rng.randrange(5, 40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randrange(length - 10, length + 120)])
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1][:-30] + "é" * 200, "ab" * 300, "q" * (length - 1), "r" * length, "s" * (length + 1), "", None]
    rows = list(enumerate(texts)) + [(9, texts[9])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, passage=passage).collect()
    plain = [(t or "").encode() for _, t in rows]
    want = collections.Counter(zip([i for i, _ in rows], brute_removed(plain, length)))
    assert collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    if passage:
        want = collections.Counter(zip([i for i, _ in rows], brute_passages(plain, *passage)))
        assert collections.Counter((r.doc_id, r.n_passage) for r in got) == want and 0 < sum(n == 0 for _, n in want) < len(want) - 5


def test_suffix_dedup_cases(spark, odd, empty):
    out = suffix_dedup.remove_repeats(odd, 400, passage=(256, 51))
    rows = out.collect()
    assert len(rows) == len(ODD) and rows[0]["row"] == "z" and out.columns[-2:] == ["kept_sha256", "n_passage"]
    assert all(r.text is None for r in rows if r.doc_id == 2) and all(r.text == "" for r in rows if r.doc_id in (6, 7))
    assert suffix_dedup.remove_repeats(empty, 400).count() == 0


def test_levels_merge_geometrically():
    family = suffix_dedup.Levels()
    for i in range(6):
        hits = family.add(np.array([7, 10 + i, 100 + i], np.uint64))
        assert hits.tolist() == ([7] if i else [])
    assert [(rank, len(keys)) for rank, keys in family.levels] == [(2, 9), (1, 5)]


def test_marks_of_keys():
    """Marks by (key, coverage), whichever batches they come in; one row stands for a class of a key with several."""
    rng = np.random.default_rng(4)
    batches, all_rows = [], collections.Counter()
    for _ in range(7):
        rows = collections.Counter((int(k), int(w)) for k, w in zip(rng.integers(0, 300, 60), rng.integers(0, 2, 60)))
        all_rows += rows
        key, whole = (np.array(c, np.uint64) for c in zip(*sorted(rows)))
        batches.append(common.packed(np.diff(key, prepend=np.uint64(0)), whole, np.array([rows[k] > 1 for k in sorted(rows)], np.uint8)))
    marks, looked = suffix_dedup.judged(batches), collections.Counter()
    kinds = collections.Counter(k for k, _ in all_rows)
    for data, m in zip(batches, marks):
        key, whole, _ = common.unpacked(data)
        for k, w, x in zip(np.cumsum(key, dtype=np.uint64).tolist(), whole.tolist(), m.tolist()):
            assert bool(x & 1) == (all_rows[k, w] > 1)
            looked[k, w] += x >> 1
    assert all(looked[r] == (kinds[r[0]] > 1) for r in all_rows)


# --- 2

def test_pitman_yor(spark, odd, empty):
    rng = random.Random(12)

    def chain(n):
        k = 0
        return " ".join(f"W{(k := (3 * k + rng.randrange(4)) % 60)}" for _ in range(n))  # a word tells the next

    rows = [(i, chain(rng.randrange(60)) + ("" if i % 3 else " é Ünd")) for i in range(400)] + [(400, None), (401, " \n ")]
    got = {r.doc_id: r for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {i: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 and r.score < 0
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    assert pitman_yor.score_documents(odd).count() == len(ODD) and pitman_yor.score_documents(empty).count() == 0


def test_pitman_yor_is_the_same_however_dealt(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(80), 40)) for i in range(300)]
    found = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
            found.append({r.doc_id: r.score for r in got})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert all(abs(found[0][i] - found[1][i]) < 1e-6 * abs(found[0][i]) + 1e-9 for i in found[0])


def chinese_restaurants(rows, d, d0, base, samples, burn, rng):
    """Customer by customer: mean predictive probabilities, as a function of (context, word), of seatings of ``rows`` (context, word)."""
    vocabulary = sorted({w for _, w in rows})
    tables, root = collections.defaultdict(list), collections.defaultdict(list)
    in_context, of_context, total_root, all_roots = collections.Counter(), collections.Counter(), 0, 0

    def root_p(w):
        return (sum(root[w]) - d0 * len(root[w]) + (pitman_yor.ROOT_STRENGTH + d0 * all_roots) * base[w is None]) / (pitman_yor.ROOT_STRENGTH + total_root)

    def p(u, w):
        own = tables[u, w]
        return (sum(own) - d * len(own) + (pitman_yor.STRENGTH + d * of_context[u]) * root_p(w)) / (pitman_yor.STRENGTH + in_context[u])

    def pick(sizes, discount, new):
        x = rng.random() * (sum(sizes) - discount * len(sizes) + new)
        for i, n in enumerate(sizes):
            x -= n - discount
            if x < 0:
                return i
        return len(sizes)

    def sit(sizes, i):
        if i == len(sizes):
            sizes.append(0)
        sizes[i] += 1
        return sizes[i] == 1

    def leave(sizes):
        i = rng.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            sizes.pop(i)
            return True
        return False

    def add(u, w):
        nonlocal total_root, all_roots
        if sit(tables[u, w], pick(tables[u, w], d, (pitman_yor.STRENGTH + d * of_context[u]) * root_p(w))):
            of_context[u] += 1
            all_roots += sit(root[w], pick(root[w], d0, (pitman_yor.ROOT_STRENGTH + d0 * all_roots) * base[0]))
            total_root += 1
        in_context[u] += 1

    def remove(u, w):
        nonlocal total_root, all_roots
        in_context[u] -= 1
        if leave(tables[u, w]):
            of_context[u] -= 1
            all_roots -= leave(root[w])
            total_root -= 1

    for r in rows:
        add(*r)
    mean = collections.Counter()
    wanted = {(u, w) for u in {u for u, _ in rows} for w in [*vocabulary, None]}
    for k in range(burn + samples):
        for r in rows:
            remove(*r)
            add(*r)
        if k >= burn:
            for x in wanted:
                mean[x] += p(*x) / samples
    return mean


def test_pitman_yor_against_single_customers(spark, monkeypatch):
    """Scores of texts against a plain sampler that moves one customer at a time."""
    rng = random.Random(6)
    kinds = [f"w{int(rng.paretovariate(0.8)) % 30}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(kinds) for _ in range(rng.randrange(2, 20)))) for i in range(120)]
    got = {r.doc_id: r for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = sorted({w for _, t in rows for w in t.split()})
    hashes = {w: 1 + (xxhash.xxh64_intdigest(w) >> 16) % (pitman_yor.LEAST_CLASSES - 1) for w in every}
    seen = {i: list(zip([0, *(hashes[w] for w in t.split())], [*t.split(), ""])) for i, t in rows}
    training = [r for i, own in seen.items() if not pitman_yor.held_out(i) for r in own]
    count = collections.Counter(training)
    each = collections.Counter(w for _, w in count)
    d = pitman_yor.estimated(sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values()))
    d0 = pitman_yor.estimated(sum(c == 1 for c in each.values()), sum(c == 2 for c in each.values()))
    of = collections.Counter(w for _, w in training)
    mean = chinese_restaurants(training, d, d0, pitman_yor.base(len(of), sum(c == 1 for c in of.values())), 60, 20, rng)
    known, contexts = {w for _, w in training}, {u for u, _ in training}
    want = {i: sum(np.log10(mean[u, w if w in known else None]) for u, w in own) for i, own in seen.items() if all(u in contexts for u, _ in own)}
    error = [abs(got[i].score - x) / abs(x) for i, x in want.items()]
    assert len(want) > 100 and np.mean(error) < 0.02 and max(error) < 0.08
    for u in list(contexts)[:5]:  # the plain sampler's own probabilities add up
        assert abs(sum(mean[u, w] for w in [*known, None]) - 1) < 1e-9


def seating(count, context, word, each_extra=0):
    n = int(word.max()) + 1
    return pitman_yor.Seating(np.arange(n).astype(np.uint64), np.bincount(word, minlength=n), np.full(n, each_extra), context, count, np.ones(len(count), np.int64), np.ones(n, np.int64))


def test_seating_keeps_its_customers():
    rng = np.random.default_rng(1)
    count, context, word = rng.integers(2, 1000, 50), rng.integers(0, 5, 50), np.arange(50) // 2
    s = seating(count, context, word)
    whole = pitman_yor.Whole(0.7, 0.4, 25, 5, np.bincount(context, minlength=5), 25)
    for k in range(5):
        s.sweep(whole, range(4 * k, 4 * k + 4))
        assert (s.tables >= 1).all() and (s.tables <= count).all() and (s.roots >= 1).all() and (s.roots <= s.customers()).all()
        again = pitman_yor.Seating.read(s.write())
        assert (again.tables == s.tables).all() and (again.roots == s.roots).all() and (again.name == s.name).all()


def test_large_rows_are_drawn_as_small_ones():
    """On the grid and exactly, at the edge between them, the tables of a row have nearly one distribution."""
    n = 4000
    chance = (np.arange(n) + 0.5) / n
    for weight, more, least in ((300.0, 20.0, 5), (3000.0, 2000.0, 20)):
        seen = []
        for count in (pitman_yor.EXACT, pitman_yor.EXACT + 1):
            counts = np.full(n, count)
            seen.append(np.log(pitman_yor.draw(counts, 0.7, np.full(n, weight), np.full(n, more), np.full(n, more), np.full(n, 9000.0), chance, pitman_yor.Grid(counts, 0.7))))
        assert abs(seen[0].mean() - seen[1].mean()) < 0.1 and abs(seen[0].std() - seen[1].std()) < 0.1 and len(np.unique(seen[0])) > least


def test_seatings_at_a_point():
    c, t = pitman_yor.EXACT, np.array([1, 2, 3, 10, 50, 150, 200])
    for d in (0.3, 0.7, 0.9):
        near = pitman_yor._stirling_at(d, np.full(len(t), float(c)), t.astype(float))
        assert np.abs(near - pitman_yor._stirling(d)[c, t]).max() < 0.3


# --- 1

def plain_conversation(rows):
    """{turn: (text, parent, thread, depth, quoted, linked)} of one conversation's (turn, text), message by message."""
    norm = lambda t: re.sub(r"\s+", " ", t).strip(" ").lower()
    mark, intro = re.compile(quotes.MARKS), re.compile(quotes.INTRODUCTION)
    said, seen, out = {}, {}, {}

    def units(text):
        return {(g, norm(t)) for g, parts in ((3, [text]), (2, re.split(r"\n\s*\n", text)), (1, text.split("\n"))) for t in parts if norm(t)}

    for turn, text in sorted(rows):
        lines = [((m.group(1).count(">"), x[m.end() :]) if (m := mark.match(x)) else (0, x)) for x in re.split("\r\n|\n|\r", text or "")]
        runs = [(level, "\n".join(t for _, t in g)) for level, g in ((k, list(g)) for k, g in itertools.groupby(lines, key=lambda x: x[0]))]
        own = [t for i, (level, t) in enumerate(lines) if level == 0 and not (intro.match(t) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
        has = any(level for level, _ in lines)
        own = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(" ") if has else "\n".join(t for _, t in lines)
        seen[turn], said[turn] = [(level, units(t)) for level, t in runs if level and units(t)], set().union(units(own), *(units(t) for level, t in runs if not level))
        out[turn] = own if text is not None else None
    first = {}
    for turn in sorted(said):
        for _, t in said[turn]:
            first.setdefault(t, turn)
    result = {}
    for turn in sorted(seen):
        found = []
        for level, us in seen[turn]:
            best = max(((g, len(t), -first[t]) for g, t in us if first.get(t, turn) < turn), default=None)
            found.append((-level, -best[2]) if best else None)
        parent = max((f for f in found if f), default=(None, None))[1]
        thread, depth = (result[parent][2], result[parent][3] + 1) if parent is not None else (turn, 0)
        result[turn] = (out[turn], parent, thread, depth, len(found), sum(f is not None for f in found))
    return result


def test_quotes_against_brute_force(spark):
    rng = random.Random(17)
    rows = []
    for c in range(25):
        texts = []
        for turn in range(12):
            body = [words(rng, rng.randrange(1, 7), 60) for _ in range(rng.randrange(1, 4))]
            text = rng.choice(["\n", "\n\n"]).join(body)
            if texts and rng.random() < 0.7:
                of = rng.choice(texts)
                part = rng.choice([of, rng.choice(of.split("\n\n")), rng.choice(of.split("\n")), "never said " + str(rng.random())])
                quoted = "\n".join(rng.choice(["> ", ">", " > "]) + x for x in part.upper().split("\n"))
                lead = rng.choice(["", "Anna wrote:\n", "note\n"])
                text = rng.choice([f"{lead}{quoted}\n{text}", f"{text}\n{lead}{quoted}"])
            texts.append(text)
            rows.append((c, turn, text))
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    for c in range(25):
        want = plain_conversation([(t, x) for k, t, x in rows if k == c])
        order = sorted(want, key=lambda t: (want[t][2], t))
        for t, w in want.items():
            r = got[c, t]
            assert (r.parent, r.thread, r.depth, r.quoted, r.linked, r.position) == (*w[1:], order.index(t)), (c, t)
            assert r.text == w[0], (c, t)
    assert sum(r.linked > 0 for r in got.values()) > 50 and max(r.depth for r in got.values()) > 2


def test_quotes(spark):
    m = [
        ("c", 0, "u", "Hello all,\nwhat about lunch?\n\nSecond paragraph  here"), ("c", 1, "a", "Other topic\nfully different"),
        ("c", 2, "b", "Anna wrote:\n> Hello all,\n> what about lunch?\nYes please"), ("c", 3, "d", "> Other topic\nI like it"),
        ("c", 4, "e", ">> Hello all,\n>> what about lunch?\n> Yes please\nMe too"), ("c", 5, "f", "> > HELLO all, what about   lunch?\nonly nested"),
        ("c", 6, "g", None), ("c", 7, "h", "> never said\nhm"), ("c", 8, "i", ""), ("k", 0, "u", "> Other topic\nx"), (None, 1, "u", "q"), (None, 2, "u", "> q\nr"), ("c", None, "z", "> Other topic"),
    ]
    df = spark.createDataFrame([(*r, "z", "z") for r in m], "conv_id string, turn long, role string, text string, parent string, lines string")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(df).collect()}
    assert len(got) == len(m)
    assert [(t, got["c", t].parent, got["c", t].thread, got["c", t].depth) for t in range(9)] == [
        (0, None, 0, 0), (1, None, 1, 0), (2, 0, 0, 1), (3, 1, 1, 1), (4, 2, 0, 2), (5, 0, 0, 1), (6, None, 6, 0), (7, None, 7, 0), (8, None, 8, 0)]
    assert got["c", 2].text == "Yes please" and got["c", 4].text == "Me too" and got["c", 0].text == m[0][3] and got["c", 6].text is None
    assert got["k", 0].parent is None and got[None, 2].parent == 1 and got["c", None].position == 0
    order = [t for _, t in sorted((r.position, t) for (c, t), r in got.items() if c == "c" and t is not None)]
    assert order == [0, 2, 4, 5, 1, 3, 6, 7, 8] and (got["c", 4].quoted, got["c", 4].linked) == (2, 2)
    assert quotes.reply_order(df.filter("false")).count() == 0
    twice = quotes.reply_order(df.union(df.filter("turn = 4")))
    assert sorted(r.position for r in twice.collect() if r.conv_id == "c") == list(range(11))


def test_long_chain(spark):
    rows = [("c", i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    got = quotes.reply_order(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert all((r.thread, r.depth, r.position) == (0, r.turn, r.turn) for r in got)


def test_slices_learnt_lately_join_the_others(monkeypatch):
    """Ids are the same whether slices are found among those learnt lately, among the others, or again after the cache was full; a few new slices do not move all."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé漢 '0") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(120)]
    texts += texts[:40]
    m = bpe.merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = [np.concatenate(m.merge([w.encode() for w in slices_of(t)])).tolist() for t in texts]

    def encode(words):
        found = m.merge(words)
        return np.concatenate(found), np.array([len(x) for x in found])

    monkeypatch.setattr(bpe, "RECENT_SLICES", 300)
    for most in (1 << 20, 700):
        monkeypatch.setattr(bpe, "CACHE_SLICES", most)
        cached, moved = bpe.Cached(encode), 0
        for t, want in zip(texts, plain):
            before = cached.old[0]
            assert [x.tolist() for x in cached.ids(["", t])] == [[], want]
            assert len(cached.new[0]) < 300
            moved += cached.old[0] is not before
        assert 1 < moved < len(texts) / 2


def slices_of(text):
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


def test_grids_are_made_once(monkeypatch):
    """Several ranges of sweeps over one seating make the grid of its rows once; only that of the parent's words, whose customers change, is made again."""
    from lattica.llm import pitman_yor as py

    made, plain = [], py.Grid.__init__

    def told(self, count, d):
        made.append((len(count), d))
        plain(self, count, d)

    monkeypatch.setattr(py.Grid, "__init__", told)
    count = np.array([300, 2, 900, 5])
    s = py.Seating(np.array([3, 9], np.uint64), np.array([2, 2]), np.zeros(2, np.int64), np.array([1, 2, 1, 2]), count, np.ones(4, np.int64), np.ones(2, np.int64))
    whole = py.Whole(0.6, 0.4, 2, 0, np.bincount(s.context, s.tables, 3), 2)
    for r in range(4):
        s.sweep(whole, range(2 * r, 2 * r + 2))
    assert [d for _, d in made].count(0.6) == 1
    assert (s.tables >= 1).all() and (s.tables <= count).all()


def test_contexts_do_not_share_restaurants(spark):
    """Two words whose hashes fall into one class of 1,023, with other words after them: either tells the word that follows it."""
    by = collections.defaultdict(list)
    for w in (f"u{i}" for i in range(5000)):
        by[(xxhash.xxh64_intdigest(w) >> 16) % (pitman_yor.LEAST_CLASSES - 1)].append(w)
    one, two = next(ws for ws in by.values() if len(ws) > 1)[:2]
    rows = [(i, f"{one} left" if i % 2 else f"{two} right") for i in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate((f"{one} left", f"{one} right", f"{two} right", f"{two} left") * 5)]
    rows = [r for r in rows if r[0] >= 1000 or not pitman_yor.held_out(r[0])]
    rows = [(next(i for i in itertools.count(i * 1000) if pitman_yor.held_out(i)), t) if i >= 1000 else (i, t) for i, t in rows]
    got = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    score = {t: {r.score for r in got if r.held_out and dict(rows)[r.doc_id] == t} for t in {t for i, t in rows if i >= 1000}}
    assert len(score) == 4 and all(len(x) == 1 for x in score.values())
    of = {t: x.pop() for t, x in score.items()}
    assert of[f"{one} left"] > of[f"{one} right"] + 1 and of[f"{two} right"] > of[f"{two} left"] + 1
