"""The pipeline's operators against plain versions, and their defined results in odd cases."""

import hashlib
import io
import random
import re
import struct
import wave
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n_tokens string, rep int"
LONG = "ab" * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, "x", "y", 1),
        (3, " \t\n ", "en", "s", 4, "x", "y", 1),
        (4, LONG, "en", "s", 120_000, "x", "y", 1),
        (5, "the quick brown fox jumps over the lazy dog.", "en", "s", 44, "x", "y", 1),
        (5, "the quick brown fox jumps over the lazy dog.", "en", "s", 44, "x", "y", 1),
        (6, "the quick  brown fox jumps over the lazy dog.", None, None, None, None, None, None),
        (7, "The Quick brown fox jumps over the lazy dog.", "de", "s", 44, "x", "y", 1),
        (8, "one two", "en", "s", 7, "x", "y", 1),
        (9, "<|endoftext|>a<|endoftext|>  b\x1cc don't 's é́ 中文 \U0001f600 ", "en", "s", 9, "x", "y", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def library(name):
    return tokenizers.Tokenizer.from_file(public.path(name))


NOISE = "ab  \n\t'sre012é中 \xa0\x1c\x85<|endoftext|>ñß!?.😀́²½ªⅧ"


def noise(n, longest=60):
    rng = random.Random(7)
    return ["".join(rng.choice(NOISE) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["aaa" * 500, "don't 's''s", " x ", "<|endoftext|><|endoftext|> x"]


# 3 and 9


def test_token_counts_match_the_library(spark, odd, docs):
    from granary.llm.token_counts import count_tokens

    lib = library("byte_bpe_50k.json")
    noisy = spark.createDataFrame(list(enumerate(noise(600))), "doc_id long, text string")
    for df in (odd, docs, noisy):
        want = sorted((i, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(df))
        got = sorted(tuple(r) for r in count_tokens(df).collect())
        assert got == [(*w, w[2] > 1024) for w in want]


def test_encoding_matches_the_library(spark, odd, docs):
    from granary.llm.encode_decode import digest_round_trip, encode_documents

    lib = library("byte_bpe_50k.json")
    noisy = spark.createDataFrame(list(enumerate(noise(600))), "doc_id long, text string")
    for df in (odd, docs, noisy):
        want = sorted((i, lib.encode(t, add_special_tokens=False).ids) for i, t in texts_of(df))
        assert sorted((r.doc_id, r.ids) for r in encode_documents(df).collect()) == want
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        full = sorted((i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for i, x in want)
        assert sorted(tuple(r) for r in digest_round_trip(df).collect()) == full


def test_merging_takes_runs_from_the_left():
    from granary.llm import byte_bpe, token_counts

    lib, bpe = library("byte_bpe_50k.json"), byte_bpe.load()
    words = ["a" * n for n in range(1, 40)] + ["abababab", "aabaab", "zzzz"]
    want = [len(lib.encode(w, add_special_tokens=False).ids) for w in words]
    assert token_counts.merge_ragged([w.encode() for w in words], bpe).tolist() == want


# 1


def check_pieces(df, rows, window=4096):
    lib = library("word_bpe_49k.json")
    ids = defaultdict(list)
    for i, t in texts_of(df):
        ids[i].append([*lib.encode(t, add_special_tokens=False).ids, 2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, ps in pieces.items():
        doc, copies = ids[i][0], len(ids[i])
        assert sum(p.length for p in ps) == len(doc) * copies
        for p in ps:
            assert p.doc_tokens == len(doc)
            assert p.ids_crc32 == zlib.crc32(np.array(doc[p.start : p.start + p.length], "<u4").tobytes())
        if copies == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, sum(r.length for r in rows))


def test_packing(odd, docs):
    from granary.llm.packing import pack_documents

    check_pieces(odd, pack_documents(odd).collect())
    assert check_pieces(docs, pack_documents(docs).collect()) < 0.02


def test_packing_small_segments(docs, monkeypatch):
    from granary.llm import packing

    tokens, packer = packing.WordTokens(None, 2), packing.Packer(256, 0)
    monkeypatch.setattr(packing, "SEGMENT", 2000)
    rows, total = [], 0
    for k, t in enumerate(t for _, t in texts_of(docs)[:60]):
        ((ids, sentences),) = tokens.documents([t])
        total += len(ids) // 4
        rows += packer.add(k, ids, sentences)
    rows += packer.flush(True)
    assert sum(r[2] for r in rows) == total


def test_window_cuts_are_optimal():
    from granary.llm.packing import cut_windows

    rng = random.Random(5)
    for _ in range(200):
        pos, at = [], 0
        for _ in range(rng.randint(1, 30)):
            at += rng.randint(1, 8)
            pos.append(at)
        pen, w = [rng.choice([0, 2, 5]) for _ in pos], 16
        f = [0] + [10**9] * len(pos)
        places = [0, *pos]
        for j in range(1, len(places)):
            for i in range(j):
                if places[j] - places[i] <= w:
                    f[j] = min(f[j], f[i] + w - (places[j] - places[i]) + pen[j - 1])
        cost, start, price = 0, 0, dict(zip(pos, pen, strict=True))
        for end in cut_windows(pos, pen, w, False):
            cost, start = cost + w - (end - start) + price[end], end
        cost += w if start == at else 0
        assert cost == min(f[j] + (w if j == len(pos) else 0) for j in range(len(places)) if at - places[j] <= w)


def test_words_match_the_library():
    from granary.llm.packing import WordTokens

    lib, tokens = library("word_bpe_49k.json"), WordTokens(None, 2)
    for t in [*noise(800), "don't 'sword x's", "İstanbul ǅ ΑΣ éa éa", "<|startoftext|>x <|endoftext|>"]:
        ((ids, _),) = tokens.documents([t])
        assert np.frombuffer(ids, "<u4").tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2]


# 2


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                shared[j] += 1
            where[s].append(i)
        for j, n in shared.items():
            a, b = find(i), find(j)
            if a != b and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark, odd, docs):
    from granary.llm.near_dup import near_duplicates

    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    made = []
    for size, n, changes in ((200, 120, 4), (200, 60, 8), (60, 40, 1), (30, 30, 1), (400, 30, 12)):
        made += variants(rng, [rng.choice(words) for _ in range(size)], n, changes)
    chain = [rng.choice(words) for _ in range(120)]  # each step is linked with the next, not with those further on
    for k in range(20):
        made.append(" ".join([*chain[3 * k :], *[f"t{j}" for j in range(3 * k)]]))
    made += made[:40] + ["one two three", "one two three", "One TWO three", "one two"]
    planted = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    for df in (planted, docs, odd):
        want = brute_components(texts_of(df))
        got = near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert len(got) == df.count()


def test_superminhash_is_unbiased_and_complete():
    from granary.llm.near_dup import SLOTS, UNSET, signatures

    rng = np.random.default_rng(3)
    off = []
    for n in (1, 2, 5, 40, 300, 3000):
        for _ in range(20):
            k = (6 * n) // 7
            x = rng.integers(0, 2**63, 2 * n + 2).astype(np.uint64)
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:k], x[n : 2 * n - k]]))
            s = signatures([a, b])
            assert (s[0] != UNSET).all()
            shared = np.intersect1d(a, b).size
            off.append((s[0] == s[1]).mean() - shared / (a.size + b.size - shared))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 1.2 * 0.5 / np.sqrt(SLOTS)
    assert (signatures([np.empty(0, np.uint64)]) == UNSET).all()


def test_a_signature_does_not_depend_on_its_neighbours():
    from granary.llm.near_dup import signatures

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 500, 1, 40, 0, 900)]
    together = signatures(sets, block=64)
    for s, row in zip(sets, together, strict=True):
        assert (signatures([s])[0] == row).all()


def test_components_of_chains_and_stars(spark):
    from granary.llm.near_dup import components

    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 298), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 160)} | {300: 298, 299: 298}
    assert got == want


def test_blocks_compare_their_members():
    from granary.llm.near_dup import SLOTS, _block_forest, _block_links, _block_members

    rng = np.random.default_rng(1)
    base, other = rng.integers(0, 256, (2, SLOTS)).astype(np.uint8)
    near = base.copy()
    near[: SLOTS // 4] = 0
    value = [x.tobytes() for x in (base, near, other)]
    names = ["bucket", "part", "rep", "root", "value"]

    def batches(values):
        return iter([pa.RecordBatch.from_arrays([pa.array(c) for c in ([7, 7, 7], [0, 0, 0], [1, 2, 3], [1, 2, 3], values)], names=names)])

    assert [r for b in _block_forest(batches(value)) for r in b.to_pylist()] == [{"a": 1, "b": 2}]
    assert [r["rep"] for b in _block_members(batches(value)) for r in b.to_pylist()] == [1, 2]
    sets = [np.sort(x).tobytes() for x in (np.arange(100, dtype=np.uint64), np.arange(15, 100, dtype=np.uint64), np.arange(60, 160, dtype=np.uint64))]
    assert [r for b in _block_links(batches(sets)) for r in b.to_pylist()] == [{"a": 1, "b": 2}]


@pytest.mark.parametrize("levels", [0, 1])
def test_near_duplicates_in_wide_buckets(spark, monkeypatch, levels):
    """Buckets that are larger than a block are split, and then compared in turns, with the result of brute force."""
    from granary.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(70))  # shared by all, which links none
    texts = []
    for k in range(14):
        own = [f"{k}q{j}" for j in range(45)]
        texts += [f"{passage} {t}" for t in variants(rng, own, 3, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts_of(df))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == want
    assert len({c for _, c in want.values()}) == 14


def test_near_duplicates_with_null_and_repeated_ids(spark):
    from granary.llm.near_dup import near_duplicates

    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{k}" for k in range(60))
    rows = [(None, text), (5, text), (6, near), (7, text), (7, other), (8, other + " y"), (None, "no one else says this"), (9, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in near_duplicates(df).collect())
    n = 56
    want = [(None, n, 5, False), (5, n, 5, True), (6, n, 5, False), (7, n, 5, False), (7, n, 7, True), (8, n + 1, 7, False), (None, 1, None, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(map(str, want))


def test_spread_join_keeps_all_rows(spark):
    from granary.llm.near_dup import spread_join

    left = spark.range(6000).selectExpr("if(id < 5000, 0, id) as k", "id as v")
    right = spark.range(0, 6000, 2).selectExpr("id as k", "id * 2 as w")
    assert sorted(map(tuple, spread_join(left, right, "k", "v").collect())) == sorted(map(tuple, left.join(right, "k").collect()))


# 4


def test_media_round_trip(odd, docs):
    from granary.llm.media import read_media, store_texts

    for df in (odd, docs):
        got = sorted(read_media(store_texts(df)).collect(), key=lambda r: r.doc_id)
        for (i, t), r in zip(sorted(texts_of(df)), got, strict=True):
            raw = t.encode()
            payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert r.tail_crc32 == zlib.crc32(payload[-16:])
            assert r.media_type == "audio/wav" and r.valid


def media_samples():
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\x00" + b"\x3b"
    bmp = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    wav = io.BytesIO()
    with wave.open(wav, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"abcd")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    gz = zlib.compressobj(wbits=31)
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\xd9"
    return {"image/png": png, "image/gif": gif, "image/bmp": bmp, "audio/wav": wav.getvalue(), "application/zip": packed.getvalue(), "application/gzip": gz.compress(b"hello") + gz.flush(), "application/pdf": pdf, "image/jpeg": jpg}


@pytest.mark.parametrize("kind", list(media_samples()))
def test_sniffing_and_carving(kind):
    from granary.llm.media import carve, scan, sniff

    blob = media_samples()[kind]
    assert sniff(blob, "text/plain")[:2] == (kind, True)
    (found,) = [f for f in scan(b"noise BM RIFF GIF89a " + blob + b" tail") if f.kind == kind]
    assert carve(b"noise BM RIFF GIF89a " + blob + b" tail", found) == blob
    assert sniff(blob[:-3], kind)[1] is False or kind == "application/pdf"


def test_unknown_media_keep_their_type():
    from granary.llm.media import sniff

    assert sniff(b"just text with BM in it", "text/plain") == ("text/plain", False, [])
    assert sniff(b"", "x/y") == ("x/y", False, [])


def test_hostile_media_take_linear_time():
    import time

    from granary.llm.media import scan

    def took(make):
        out = []
        for n in (1, 8):
            blob = make(n)
            t = time.perf_counter()
            list(scan(blob))
            out.append(time.perf_counter() - t)
        return out

    for make in (
        lambda n: b"PK\x03\x04" * (5000 * n),
        lambda n: (b"PK\x03\x04" + b"PK\x05\x06" + bytes(18)) * (1000 * n),
        lambda n: (b"GIF89a" + bytes(4) + b"\0\0\0" + b"\x21\x01" + b"\x01x") * (1000 * n),
        lambda n: b"\xff\xd8\xff\xda\0\x02" * (2000 * n),
    ):
        short, long = took(make)
        assert long < 40 * short + 0.2


def test_carve_media(spark):
    from granary.llm.media import carve_media

    s = media_samples()
    df = spark.createDataFrame([(1, bytearray(b"xx" + s["image/png"] + s["audio/wav"])), (2, None)], "doc_id long, blob binary")
    got = sorted((r.doc_id, r.media_type, bytes(r.blob)) for r in carve_media(df, "doc_id", "blob").collect())
    assert got == [(1, "audio/wav", s["audio/wav"]), (1, "image/png", s["image/png"])]


# 5


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    return sorted((i, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)


def test_exact_dedup(odd, docs):
    from granary.llm.exact_dedup import deduplicate

    for df in (odd, docs):
        got = deduplicate(df).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(texts_of(df))
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


@pytest.mark.parametrize("broadcast", [100, 0])
def test_exact_dedup_checks_full_bytes(docs, broadcast):
    from granary.llm.exact_dedup import deduplicate

    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in deduplicate(docs, digest=weak, broadcast_groups=broadcast).collect())
    assert got == [x[:3] for x in brute_exact(texts_of(docs))]


def test_exact_dedup_continues_its_state(spark, docs, tmp_path):
    """Two batches, one after the other, end with what one batch gives; bytes of the first are read by their locators."""
    from granary.llm.exact_dedup import deduplicate

    whole = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 100_000))
    for k in (0, 1):
        whole.where(F.col("doc_id") % 2 == k).write.parquet(str(tmp_path / f"batch{k}"))
    state = str(tmp_path / "state")
    first, second = (deduplicate(spark.read.parquet(str(tmp_path / f"batch{k}")), state_dir=state).collect() for k in (0, 1))
    want = {r.doc_id: r for r in deduplicate(whole).collect()}
    assert {r.doc_id for r in first} | {r.doc_id for r in second} == set(want) and len(first) + len(second) == len(want)
    assert all(r == want[r.doc_id] for r in second)
    assert any(r.keep_id % 2 == 0 for r in second)
    # a digest that takes texts of the two batches for the same is found out by the bytes of the first
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    state = str(tmp_path / "weak")
    for k in (0, 1):
        got = deduplicate(spark.read.parquet(str(tmp_path / f"batch{k}")), digest=weak, state_dir=state).collect()
        alone = {r.doc_id: r.keep_id for r in deduplicate(spark.read.parquet(str(tmp_path / f"batch{k}"))).collect()}
        assert {r.doc_id: r.keep_id for r in got} == alone


# 6


def test_subsequence_kernel_counts_gaps():
    from granary.llm.toxicity import DECAY, REACH, Subsequences

    def plain(a, b):
        def grams(s):
            out = defaultdict(float)
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + REACH)):
                        out[s[i] + s[j] + s[k]] += DECAY ** (k - i - 2)
            return out

        x, y = grams(a), grams(b)
        return sum(v * y[g] for g, v in x.items() if g in y)

    for a, b in (("^idiot$", "^idi.ot$"), ("^moron$", "^morons$"), ("^abc$", "^xyz$"), ("^banana$", "^ananas$")):
        s, m = Subsequences([a]), Subsequences([b])
        got = s.dot(m.spread(np.ones(1)))[0] * s.norm[0] * m.norm[0]
        assert got == pytest.approx(plain(a, b), abs=1e-3)


def test_toxicity_on_held_out_rows(spark):
    from granary.llm.toxicity import classify

    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet").where("lang = 'en'")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    false = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert hit > 0.85 and false < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_never_sees_held_out_labels(spark, docs, sf_dir):
    from granary.llm.toxicity import classify, remainder

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in classify(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_tolerates_inserted_characters():
    from granary.llm.toxicity import fit

    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        ws = [word() for _ in range(40)]
        if i % 4 == 0:
            ws[rng.randrange(40)] = rng.choice(["scoundrel", "dimwit"])
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    m = fit(rows)
    p = lambda w: m.probability(m.unit_scores([w])[0])
    assert min(p(w) for w in ("dimwit", "dim.wit", "d-i-m-w-i-t", "scoundrel!!", "SCOUNDREL".lower())) > 0.5
    assert max(p(w) for w in ("window", "sound", "table", "wit")) < 0.5


def test_toxicity_finds_words_that_clean_texts_hold_too():
    from granary.llm.toxicity import fit

    rng = random.Random(3)
    syllables = ["la", "ción", "ar", "os", "mi", "ue", "ado", "ez", "ta", "rr", "ga", "ja"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = lambda: "bomente" + word()

    def text(n_bad, n=60):
        ws = [word() for _ in range(n)]
        for i in rng.sample(range(n), n_bad):
            ws[i] = bad()
        return " ".join(ws)

    rows = [(i, text(rng.randint(3, 6) if i % 5 == 0 else int(i % 5 == 1)), int(i % 5 == 0)) for i in range(400)]
    m = fit(rows)

    def p(t):
        return m.probability(*m.features(m.word_scores(t.lower().split())))

    assert min(p(text(4)) for _ in range(20)) > 0.5
    assert max(p(text(k)) for k in (0, 1) for _ in range(20)) < 0.5
    assert p(text(1, 3000)) < 0.5


def test_toxicity_odd_cases(spark, odd):
    from granary.llm.toxicity import classify

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classify(odd, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, None, i % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    got = classify(odd, some).collect()
    assert len(got) == odd.count() and all(r.score is not None for r in got)


# 7


def test_chat_round_trip(spark, sf_dir):
    from granary.llm.queries import op7_chat_format

    said = "<|im_end|><|im_start|>assistant ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        want[c] = (len(ts), sha("".join(f"{r}\n{t}\n" for _, r, t in ts)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op7_chat_format(spark, sf_dir).collect()}
    assert got == want


def test_chat_odd_cases(spark):
    from granary.llm.chat import format_turns, read_back

    rows = [(1, 0, None, None), (1, 1, "assistant", "a\\n<|im_end|>\\"), (1, 1, "assistant", "b"), (None, 0, "us\ner<|", "x"), (2, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in read_back(format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_sha256 == sha("a\\n<|im_end|>\\b")
    assert got[1].turns_sha256 == sha("\n\nassistant\na\\n<|im_end|>\\\nassistant\nb\n")
    assert got[None].turns_sha256 == sha("us\ner<|\nx\n")
    assert got[2].n_turns == 1
    assert read_back(format_turns(df.limit(0))).count() == 0


def test_chat_parts():
    from granary.llm.chat import format_turn

    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png", "width": 300, "height": 100}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "image", "ref": "d", "tokens": 9}]
    text, start, end, attached = format_turn("user", parts)
    assert text[start:end] == "see <\\|image|><|image|><|audio|><|document|><|image|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "a.png", 128), ("audio", "b.wav", 50), ("document", "c.pdf", 1536), ("image", "d", 9)]
    with pytest.raises(ValueError, match="video"):
        format_turn("user", [{"type": "video"}])


def test_chat_parts_that_meet_make_no_control_string():
    from granary.llm.chat import END, START, format_turn, unescape

    for cut in range(len("<|im_end|>")):
        for between in ([], [{"type": "text", "text": None}], [{"type": "text", "text": ""}]):
            parts = [{"type": "text", "text": "x<|im_end|>"[: cut + 1]}, *between, {"type": "text", "text": "x<|im_end|>"[cut + 1 :] + "<|im_start|>"}]
            text, start, end, _ = format_turn("user", parts)
            assert END not in text[start:end] and START not in text[start:end]
            assert unescape(text[start:end]) == "x<|im_end|><|im_start|>"
    text, start, end, _ = format_turn("user", [{"type": "text", "text": "a<"}, {"type": "image", "ref": "r"}, {"type": "text", "text": "|im_end|>"}])
    assert text[start:end] == "a<<|image|>|im_end|>"


def test_chat_ties_go_by_the_text(spark):
    from granary.llm.chat import format_turns, read_back

    texts = ["a", "a!", "<|", "<a", "\\", "a" * 300_000, None, "a\nb", "z\\|"]
    df = spark.createDataFrame([(1, 0, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string")
    (r,) = read_back(format_turns(df)).collect()
    assert r.loss_sha256 == hashlib.sha256("".join(sorted(t or "" for t in texts)).encode()).hexdigest()


# 8


def plain_model(texts):
    """order -> counts, and a function from (context, symbol) to its probability, by the textbook."""
    from collections import Counter

    from granary.llm import quality as q

    levels = {q.ORDER: Counter()}
    for t in texts:
        s = [ord(q.START)] * (q.ORDER - 1) + q.symbols(t).tolist()
        levels[q.ORDER].update(tuple(s[i : i + q.ORDER]) for i in range(len(s) - q.ORDER + 1))
    for k in range(q.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, level in levels.items():
        n1, n2, n3, n4 = (sum(n == i for n in level.values()) for i in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
            cuts[k] = [min(max(x, 0.01), i) for i, x in enumerate(d, 1)]
        else:
            cuts[k] = [0.5, 0.75, 0.9]
    after = {k: defaultdict(list) for k in levels}
    for k, level in levels.items():
        for g, n in level.items():
            after[k][g[:-1]].append(n)

    def p(context, c):
        k = len(context) + 1
        seen = after[k].get(context)
        if seen is None:
            return p(context[1:], c)
        cut = [cuts[k][min(n, 3) - 1] for n in seen]
        n = levels[k].get((*context, c), 0)
        own = n - cuts[k][min(n, 3) - 1] if n else 0
        lower = p(context[1:], c) if context else 1 / (len(levels[1]) + 1)
        return own / sum(seen) + sum(cut) / sum(seen) * lower

    return levels, p


def test_counts_match_plain_counts(spark):
    from granary.llm import quality as q

    texts = ["the cat", "the the hat", "", "É!! \U0001f600 a a a a b b", "中文"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels, _ = plain_model(texts)
    assert {tuple(map(ord, r.gram)): r.n for r in q.count_grams(df).collect()} == levels[q.ORDER]
    assert q.symbols("a a a b\nb b").tolist() == [97, q.REPEAT + 1, q.REPEAT + 2, 32, 98, 10, 98, q.REPEAT + 1]


def test_probabilities_sum_to_one():
    from granary.llm import quality as q

    levels, p = plain_model(["the cat sat on the mat. the cat ran", "a dog and a cat and a man"])
    known = {g[0] for g in levels[1]}
    for context in [tuple(map(ord, c)) for c in ("the ", "zzzz", " cat", q.START * 4)]:
        assert abs(sum(p(context, c) for c in known) + p(context, ord("%")) - 1) < 1e-9


def test_perplexity_and_threshold_match_a_plain_model(spark, monkeypatch):
    import math

    from granary.llm import quality as q

    monkeypatch.setattr(q, "LEAST", 4)
    rng = random.Random(9)
    words = ["the", "cat", "sat", "on", "mat", "ran", "dog", "é", "中文"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(60, "%%% ### @@@ zzz", "en"), (61, "cat " * 40, "de"), (62, None, "en"), (63, "", "fr"), (None, "the cat sat", "en"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = set(range(50))
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(64)], "doc_id long, quality int, toxic int")
    aside = {r.doc_id for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(q.FOLDS)) == 0).alias("a")).collect() if r.a and r.doc_id in good}
    _, p = plain_model([t for i, t, _ in rows if i in good and i not in aside and t])

    def bits(t):
        s = [ord(q.START)] * (q.ORDER - 1) + q.symbols(t or "").tolist()
        return sum(-math.log2(p(tuple(s[i : i + q.ORDER - 1]), s[i + q.ORDER - 1])) for i in range(len(s) - q.ORDER + 1)), len(s) - q.ORDER + 1

    scored = [(i, lang, *bits(t)) for i, t, lang in rows]
    kept = [r for r in scored if r[0] in aside and r[3]]
    rate = lambda rs: sum(r[2] for r in rs) / sum(r[3] for r in rs)
    usual = {lang: rate([r for r in kept if r[1] == lang]) for lang in {r[1] for r in kept}}
    perplexity = lambda r: 2 ** ((r[2] + q.PRIOR * usual.get(r[1], rate(kept))) / (r[3] + q.PRIOR))
    quantile = lambda xs: sorted(xs)[math.ceil(q.QUANTILE * len(xs)) - 1]
    limit = {}
    for lang in {r[1] for r in scored}:
        own = [perplexity(r) for r in kept if r[1] == lang]
        limit[lang] = q.SLACK * quantile(own if len(own) >= 4 else [perplexity(r) for r in kept])
    got = q.classify(df, labels).collect()
    key = lambda r: str((r[0], r[1], r[2]))
    want = sorted(((r[0], r[1], r[3], perplexity(r), limit[r[1]]) for r in scored), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] / w[3] - 1) < 1e-4 and abs(g[4] / w[4] - 1) < 1e-4 and g[5] == (g[3] <= g[4])
    assert {r.doc_id for r in got if not r.kept} >= {60, 61}


def test_quality_keeps_a_tie_at_the_threshold(spark):
    from granary.llm.quality import classify

    df = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = classify(df, labels, slack=1.0).collect()
    assert len(got) == 20 and all(r.kept and r.perplexity == r.threshold for r in got)


def test_quality_keeps_good_and_drops_poor(spark):
    from granary.llm.quality import classify

    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").select("quality", "kept").collect()
    good, poor = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_quality_odd_cases(spark, odd):
    from granary.llm.quality import classify

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in classify(odd, none).collect())
    some = spark.createDataFrame([(5, 1, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(odd, some).collect()
    assert len(got) == odd.count()
    assert all(r.kept for r in got if r.n_symbols == 0)


# 10


def test_licences_match_brute_force(docs, odd):
    from granary.llm import licences as li

    t = li.Templates()
    every = [(n, li.bigrams(x)) for n, x in [(k, s.format(n)) for k, ns in li.NAMES.items() for n in ns for s in li.STATEMENTS] + list(li.NOTICES.items())]
    for _, text in texts_of(docs)[:120] + texts_of(odd):
        best = {}
        for n, line in enumerate(text.split("\n")):
            g = li.bigrams(line)
            for name, b in every:
                dice = 2 * len(g & b) / (len(g) + len(b)) if g else 0
                if dice >= li.THRESHOLD and dice > best.get(n, (0, ""))[0]:
                    best[n] = (dice, name)
        got = {m[2]: m[1] for m in t.scan(text) if m[3] == 1}
        assert all(got.get(n, d[0]) >= d[0] - 1e-9 for n, d in best.items())
        assert {n for n in best} <= {k for m in t.scan(text) for k in range(m[2], m[2] + m[3])}
        assert bool(best) or not got


def test_licence_notices_over_lines(spark, odd):
    from granary.llm import licences as li

    notice = "\n".join(x.strip() for x in li.NOTICES["MIT"].split("\n"))
    df = spark.createDataFrame([(1, f"intro\n{notice}\nbody text here"), (2, "x\nReleased under the MIT License.\ny\nLicensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.doc_id: r for r in li.scan_licences(df).collect()}
    assert (got[1].n_matches, got[1].best_licence, got[1].best_line) == (1, "MIT", 1)
    assert (got[2].licences, got[2].best_dice) == (["CC-BY-NC-4.0", "MIT"], 1.0)
    assert {r.n_matches for r in li.scan_licences(odd).collect()} == {0}


# all


def test_licences_inside_lines():
    from granary.llm.licences import NOTICES, Templates

    known = Templates()
    found = lambda text: [(m[0], m[2], m[3]) for m in known.scan(text)]
    assert found("Copyright 2020 Foo. Licensed under the MIT License.") == [("MIT", 0, 1)]
    assert found("one\nIt is released by its authors and licensed under the MIT License. More words follow it here.") == [("MIT", 1, 1)]
    assert found("It is free, and licensed under the\nMIT License as you see, so use it as you like.") == [("MIT", 0, 2)]
    other = " ".join(f"word{i}" for i in range(400))
    notice = " ".join(NOTICES["Apache-2.0"].split())
    assert found(f"{other} {notice} {other}") == [("Apache-2.0", 0, 1)]
    assert found(f"{other} Licensed under the ISC License. {other} Released under CC0 1.0. {other}") == [("CC0-1.0", 0, 1), ("ISC", 0, 1)]
    assert found("Some of it is licensed under the GNU Lesser General Public License, version 2.1, and some is not.") == [("LGPL-2.1", 0, 1)]
    assert found(other) == []


def test_many_licence_lines_take_linear_time():
    import time

    from granary.llm.licences import Templates

    known, took = Templates(), []
    for n in (100, 800):
        t = time.perf_counter()
        found = known.scan("\n".join(["Licensed under the MIT License.", "Released under CC0 1.0."] * n))
        took.append(time.perf_counter() - t)
        assert len(found) == 2 * n
    assert took[1] < 16 * took[0] + 0.5


def test_ids_labelled_both_ways_are_not_learnt_from(spark):
    from granary.llm.toxicity import train

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i in range(20) for t in (0, 1)], "doc_id long, quality int, toxic int")
    assert train(docs, labels) is None


def test_empty_tables(spark, docs):
    from granary.llm import chat, encode_decode, exact_dedup, licences, media, near_dup, packing, quality, token_counts, toxicity

    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (token_counts.count_tokens(none), encode_decode.digest_round_trip(none), packing.pack_documents(none), media.read_media(media.store_texts(none)), exact_dedup.deduplicate(none), near_dup.near_duplicates(none), licences.scan_licences(none), toxicity.classify(none, labels), quality.classify(none, labels)):
        assert df.count() == 0 and df.columns[0] == "doc_id"


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11))


def test_pipeline_matches_plain_steps(spark, sf_dir, docs):
    """Stage by stage, on each stage's own input."""
    import corpus_pipeline
    from granary.llm import quality, toxicity
    from granary.session import materialize

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(spark, stage(spark, now, sf_dir), f"test-{name}")
        if name == "packing":
            check_pieces(now, out.collect())
            continue
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.classify(now, labels).where("predicted = 0").collect()}
        elif name == "quality":
            want = {r.doc_id for r in quality.classify(now, labels).where("kept").collect()}
        elif name == "exact_dedup":
            want = {x[1] for x in brute_exact(texts_of(now))}
        else:
            want = {c for _, c in brute_components(texts_of(now)).values()}
        assert kept == want
        now = out


def test_pipeline_numbers_rows_once_each(spark, docs, tmp_path):
    import corpus_pipeline as cp

    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    for df in (read, read.where("doc_id > 50").withColumn("more", F.lit(1)), read.union(read), read.join(docs.select("doc_id"), "doc_id"), read.limit(7)):
        rows = cp._numbered(spark, df)
        first, again = ({(r[cp.ROW], r.doc_id) for r in rows.select(cp.ROW, "doc_id").collect()} for _ in range(2))
        assert first == again and len({n for n, _ in first}) == df.count()
    assert cp._read_as_is(read) and not cp._read_as_is(read.union(read))
    assert {cp.SCHEME.sub("/", f) for f in read.inputFiles()} == {cp.SCHEME.sub("/", r.p) for r in read.select(F.col("_metadata.file_path").alias("p")).distinct().collect()}


def test_pipeline_stages_in_odd_cases(spark, odd, sf_dir):
    """Rows are judged one by one: null and repeated ids, repeated rows, clashing columns, and tables without rows."""
    import corpus_pipeline

    extra = odd.unionByName(odd.where("doc_id in (5, 8)").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("row", F.lit("clash")).withColumn("gone_id", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "quality", "exact_dedup", "near_dedup"):
        out = stages[name](spark, extra, sf_dir)
        assert out.columns == extra.columns
        assert stages[name](spark, extra.limit(0), sf_dir).count() == 0
        if name == "exact_dedup":
            texts = sorted((r.doc_id is None, r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or "")) for r in out.collect())
            assert len({t for *_, t in texts}) == len(texts) == 6
            assert not any(none for none, *_ in texts)
        if name == "near_dedup":
            rows = [(i, r.text or "") for i, r in enumerate(extra.collect())]
            assert out.count() == len({c for _, c in brute_components(rows).values()})
    assert stages["packing"](spark, extra, sf_dir).count() >= extra.count() - 1


def test_released_keeps_rows_and_releases_on_early_end(monkeypatch):
    from granary.llm import batches

    batch, seen = pa.RecordBatch.from_pydict({"n": [1, 2]}), []
    pool = type("Pool", (), {"release_unused": lambda self: seen.append("released")})()
    monkeypatch.setattr(batches.pa, "default_memory_pool", lambda: pool)

    @batches.released
    def run(given):
        yield from given

    assert [b.to_pydict() for b in run(iter([batch, batch]))] == [{"n": [1, 2]}] * 2
    assert list(run(iter([]))) == []
    stopped = run(iter([batch, batch]))
    next(stopped)
    assert seen == ["released"] * 2
    stopped.close()
    assert seen == ["released"] * 3


@pytest.mark.parametrize("keys", [[], [0], [2**64 - 1], [1, 5, 2**40, 2**63 + 9, 2**64 - 1]])
def test_quality_keys_round_trip(keys):
    from granary.llm import quality

    keys = np.array(keys, np.uint64)
    p = np.linspace(0, 1, keys.size, dtype=np.float32)
    w = np.full(keys.size, np.nan, np.float32)
    for got, want in zip(quality._found(quality._keys_row(3, 0, keys, p, w)), (keys, p, w), strict=True):
        np.testing.assert_array_equal(got, want)


def test_a_worker_remembers_for_one_operator_at_a_time():
    import gc
    import weakref

    from granary.llm import batches, near_dup, packing, toxicity
    from granary.llm.byte_bpe import Pieces

    def held():
        gc.collect()
        return [x for x in gc.get_objects() if isinstance(x, Pieces | packing.WordTokens)]

    assert list(near_dup._linked(iter([]))) == []
    before = {id(x) for x in held()}
    score = toxicity._scorer(toxicity.Model(None, None, np.ones((2, 2))))
    assert len(score(["some words"])) == 1
    del score
    toxic = [weakref.ref(x) for x in held() if id(x) not in before]
    assert len(toxic) == 1
    sets = near_dup.shingle_sets(["some words"])
    gc.collect()
    assert toxic[0]() is None
    again = near_dup._words()
    np.testing.assert_array_equal(near_dup.shingle_sets(["some words"])[0], sets[0])
    assert near_dup._words() is again and again.known
    words = weakref.ref(again)
    del again
    assert list(near_dup._linked(iter([]))) == []
    gc.collect()
    assert words() is None and not batches._held
    tokens = weakref.ref(packing._tokens(None, 2))
    assert packing._tokens(None, 2) is tokens()
    near_dup.shingle_sets(["some words"])
    gc.collect()
    assert tokens() is None


def test_pipeline_stages_take_rows_in_small_batches(spark, sf_dir):
    import corpus_pipeline
    from granary.llm import batches

    def sizes(given):
        for b in given:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    for name, stage in corpus_pipeline.STAGES:
        if name == "exact_dedup":  # runs no Python
            continue
        own = spark.newSession()
        stage(own, own.createDataFrame([], "doc_id long, lang string, text string"), sf_dir)
        rows = own.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 250000) text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in rows) == 60
        assert max(r.size for r in rows) < batches.BATCH_BYTES + 2 * 250_000, name
    own = spark.newSession()
    own.conf.set(batches.BATCH_SETTING, "123456")
    batches.small_batches(own)
    assert own.conf.get(batches.BATCH_SETTING) == "123456"


def test_quality_holds_no_part_of_a_merged_model():
    import tracemalloc

    from granary.llm import quality

    rng = np.random.default_rng(5)
    keys = rng.permutation(400_000).astype(np.uint64).reshape(8, -1)
    values = rng.random((2, 8, 50_000), np.float32)
    whole = [keys.ravel().copy(), *(v.ravel().copy() for v in values)]
    order = np.argsort(whole[0])
    tracemalloc.start()
    parts = [[k.copy(), p.copy(), w.copy()] for k, p, w in zip(keys, *values, strict=True)]
    merged = quality._merged(parts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    for got, want in zip(merged, whole, strict=True):
        np.testing.assert_array_equal(got, want[order])
    size = sum(x.nbytes for x in merged)
    assert held < 1.25 * size and peak < 2.6 * size
    assert [x.size for x in quality._merged([])] == [0, 0, 0]
