"""Toxicity, near duplicates, BPE, token files, token counts and media against brute force, libraries and round trips."""

import collections
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidelake.llm import bpe, media, mixing, neardup, pii, sketch, tokencount, tokenfile, toxicity
from tidelake.llm.common import work_dir

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ENCODER = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (WORD_BPE, BYTE_BPE)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# BPE


def words_of_all_kinds(vocab):
    rng = random.Random(4)
    letters = [t.replace("</w>", "") for t in vocab if t.replace("</w>", "").isascii()]
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (50, 300, 800) for _ in range(6)] + ["".join(rng.choice("etaoinshr") for _ in range(3000)) for _ in range(6)]
    return ["", "  a\x1cb\x85c\xa0d ΑΣ ΑΣ. İ", "<|endoftext|> <|endoftext|>A<|endoftext|>b<|startoftext|", "日本語テキスト 한국어 ½ Ⅷ ٣٤", "é ̈x I'LL don'T 's''s!'s", "a" * 5000, "!?" * 2000, *long]


def test_transducer_equals_the_library(library, docs):
    own = bpe.loaded(WORD_BPE)
    for t in [*words_of_all_kinds(own.vocab), *(r["text"] for r in docs.collect())]:
        want = library[WORD_BPE].encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want and fed(own, want)[0] == library[WORD_BPE].decode(want, skip_special_tokens=False)


def fed(own, ids, run=7):
    d = own.decoder()
    got = [d.feed(ids[i:i + run]) for i in range(0, len(ids), run)]
    return "".join(a for a, _ in got), "".join(z for _, z in got) + d.close()


def test_code_points_of_every_kind_equal_the_library(library):
    """All where the library's Unicode tables differ from ours, and every 61st of the others, between letters and digits."""
    own = bpe.loaded(WORD_BPE)
    points = {c for c, *_ in bpe.differences(WORD_BPE)} | {chr(c) for c in range(0, 0x110000, 61) if not 0xD800 <= c < 0xE000}
    texts = [t for c in sorted(points) for t in (f"a{c}b 1{c}2", f"x{c}\u0301!{c}")]
    assert [t for t, e in zip(texts, library[WORD_BPE].encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != e.ids] == []


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_decoder_in_runs_of_any_length(library, run):
    own, rng = bpe.loaded(WORD_BPE), random.Random(run)
    for _ in range(60):  # ids at random: broken characters, special tokens, ids that no vocabulary has
        ids = [rng.choice([rng.randrange(600), rng.randrange(49_408), 49_406, 49_407, 60_000]) for _ in range(rng.randrange(40))]
        assert fed(own, ids, run)[0] == library[WORD_BPE].decode(ids, skip_special_tokens=False)
        raw = b"".join(own.raw.get(str(i), b"") for i in ids)
        assert fed(own, ids, run)[1] == fed(own, [str(i) for i in ids], run)[1] == raw.decode("utf-8", "replace")


def test_lookahead_is_what_the_transducer_keeps():
    own = bpe.loaded(WORD_BPE)
    rng = random.Random(8)
    for _ in range(20):  # windows of one lookahead more than needed give what merging the whole piece gives
        piece = "".join(rng.choice("thequickbrownfoxjumps") for _ in range(rng.randrange(900, 2500))).encode()
        assert list(own.transduce(piece)) == own.merged([*(own.plain[b] for b in piece[:-1]), own.last[piece[-1]]])


def test_decoder_gives_the_text_back(spark, odd, docs):
    own = bpe.loaded(WORD_BPE)
    assert fed(own, own.encode("Hello wörld 日本 <|endoftext|>"))[1] == "hello wörld 日本 <|endoftext|>"
    out = bpe.encoded(odd, WORD_BPE)
    back = {(r["doc_id"], r["text"]) for r in bpe.decoded(out, WORD_BPE).collect()}
    assert out.count() == odd.count() and back == {(r["doc_id"], fed(own, own.encode(r["text"]))[1]) for r in odd.collect()}


def test_op5(spark, library, docs, odd, none):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.op5(spark, SF).collect():
        ids = library[WORD_BPE].encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library[WORD_BPE].decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r["text_sha256"] == hashlib.sha256(fed(bpe.loaded(WORD_BPE), ids)[1].encode()).hexdigest()
    assert bpe.digests(odd, WORD_BPE).count() == odd.count() and bpe.digests(none, WORD_BPE).count() == 0 and bpe.encoded(none, WORD_BPE).count() == 0


# token files


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(20, 1000, rng.integers(2, 300))
        counts[rng.random(len(counts)) < 0.2] = 0
        n = tokenfile.code_lengths(counts)
        own = n[counts > 0].astype(int)
        assert (n[counts == 0] == 0).all() and own.max(initial=0) <= 16 and (len(own) < 2 or abs((0.5**own).sum() - 1) < 1e-12)
        import heapq

        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert len(own) < 2 or int((counts * n).sum()) == cost
    skewed = np.array([2**i for i in range(40)])
    assert tokenfile.code_lengths(skewed).max() == 16


def test_large_vocabularies_round_trip():
    rng = np.random.default_rng(3)
    n = 150_000
    counts = np.maximum(1, (1e7 / (1 + np.arange(n)) ** 1.1)).astype(np.int64)
    lengths = tokenfile.code_lengths(counts)
    assert 16 < lengths.max() <= tokenfile.longest(n) and abs((0.5 ** lengths.astype(float)).sum() - 1) < 1e-9
    ids = np.concatenate([rng.permutation(n), np.minimum(rng.geometric(0.001, 20_000), n - 1)]).astype(np.uint32)
    sizes = np.array([100_000, 1, 69_999])
    pieces, marks = tokenfile.packed(ids, sizes, lengths, tokenfile.canonical(lengths))
    base = np.concatenate([[0], np.cumsum([8 * len(x) for x in pieces])])
    starts = np.concatenate([np.frombuffer(m, "<i8") + b for m, b in zip(marks, base, strict=False)])
    full = np.concatenate([[*([tokenfile.BLOCK] * ((s - 1) // tokenfile.BLOCK)), s - (s - 1) // tokenfile.BLOCK * tokenfile.BLOCK] for s in sizes])
    assert (tokenfile.unpacked(b"".join(pieces), starts, full, lengths) == ids).all()


@pytest.mark.parametrize("seed", range(5))
def test_bits_round_trip(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 3000, 20)
    ids = np.minimum(rng.geometric(0.01, sizes.sum()), 5000).astype(np.uint32)
    counts = np.bincount(ids, minlength=5001)
    n = tokenfile.code_lengths(counts)
    pieces, marks = tokenfile.packed(ids, sizes, n, tokenfile.canonical(n))
    base = np.concatenate([[0], np.cumsum([8 * len(x) for x in pieces])])
    starts = np.concatenate([np.frombuffer(m, "<i8") + b for m, b in zip(marks, base, strict=False)])
    full = np.concatenate([[*([tokenfile.BLOCK] * ((s - 1) // tokenfile.BLOCK)), s - (s - 1) // tokenfile.BLOCK * tokenfile.BLOCK] for s in sizes])
    assert (tokenfile.unpacked(b"".join(pieces), starts, full, n) == ids).all()


def test_op4(spark, library, docs):
    at = 0
    got = {r["doc_id"]: r for r in tokenfile.op4(spark, SF).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library[BYTE_BPE].encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_odd_rows(spark, library, odd, none, monkeypatch):
    monkeypatch.setattr(tokenfile, "TOGETHER", 1)
    monkeypatch.setattr(tokenfile, "MOST_RANGES", 2)
    files = tokenfile.write(odd, work_dir(spark, "t"), ENCODER, 50257, per_file=5000)
    out = tokenfile.documents(files).collect()
    texts = odd.select("doc_id", "text").collect()
    want = collections.Counter((r["doc_id"], len(library[BYTE_BPE].encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in texts)
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert [a for a, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert files.filter("part > 0").count() and files.filter("range > 0").count() and collections.Counter((r["doc_id"], r["n_tokens"]) for r in out) == want
    assert tokenfile.documents(tokenfile.write(none, work_dir(spark, "t"), ENCODER, 50257)).count() == 0


# token counts


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = []
    for f in range(3):
        ids = rng.integers(0, 30, 5000 * f).astype("<u2")
        ids.tofile(tmp_path / f"f{f}.bin")
        ends = np.flatnonzero(ids == 7) + 1
        starts = np.concatenate([[0], ends])
        want += [(f"f{f}.bin", i, int(a), int(b - a), True) for i, (a, b) in enumerate(zip(starts, ends, strict=False))]
        if f and starts[-1] < len(ids):
            want.append((f"f{f}.bin", len(ends), int(starts[-1]), int(len(ids) - starts[-1]), False))
    for block in (1, 64, 10_000) if len(want) < 500 else (64, 10_000):
        got = tokencount.scan(spark, f"file://{tmp_path}", 100, 7, block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert tokencount.scan(spark, f"file://{tmp_path}/none", 100, 7).count() == 0


def test_op6(spark, docs, odd, none):
    own = tokenfile.byte_level(ENCODER[0], ENCODER[1], {})
    want = {r["doc_id"]: len(own.encode(r["text"])) + 1 for r in docs.collect()}
    out = tokencount.op6(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == want and all(r["closed"] for r in out)
    for df in (odd, none):
        folder = work_dir(spark, "f")
        order = tokencount.write_flat(df, folder, (*ENCODER[:2], {}), 50257, 50256)
        assert tokencount.scan(spark, folder, 50257, 50256, 1000).count() == order.count() == df.count()


# media


def png(width=3, height=2):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xc0\0\x0b\x08\0\x02\0\x03\x01\x01\x11\0" + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + b"\x12\xff\0\x34" + b"\xff\xd9"
    bmp = struct.pack("<2sIIIIiiHHIIIIII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    return {"wav": media.wave(b"abcd"), "png": png(), "gif": gif, "jpeg": jpeg, "bmp": bmp, "gzip": gzip.compress(b"hi" * 100), "zip": z.getvalue(), "pdf": b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF"}


def test_formats_are_known_carved_and_checked(spark):
    own, all_ = media.automaton(), samples()
    for kind, b in all_.items():
        found = media.found(b, own)
        assert (found[0][0], found[0][1], found[0][2]) == (kind, 0, len(b)), kind
        inside = media.found(b"junk" + b + b"tail", own)
        assert any((k, a, z) == (kind, 4, 4 + len(b)) for k, a, z, _ in inside), kind
        if kind not in ("pdf",):
            assert not any(a == 0 for _, a, _, _ in media.found(b[: len(b) // 2], own)), kind
    df = spark.createDataFrame([(i, b and bytearray(b), d) for i, (b, d) in enumerate([(all_["png"], "PNG"), (all_["png"], "wav"), (b"", "png"), (None, None), (b"BM is text", "bmp"), (b"xx" + all_["gif"], "gif")])], "i int, media binary, type string")
    out = {r["i"]: r for r in media.sniff(df, "media", "type").collect()}
    assert [out[i]["type"] for i in range(6)] == ["png", "png", None, None, None, None] and [out[i]["declared_ok"] for i in range(6)] == [True, False, False, True, False, False] and out[5]["carved"].startswith("gif:2:")


def test_many_marks_cost_no_more_than_their_bytes():
    import time

    own, z = media.automaton(), samples()["zip"]
    began = time.time()
    for mark, end in ((b"PK\x03\x04", b""), (b"%PDF-1", b""), (b"PK\x03\x04 ", b"PK\x05\x06" + b"\1" * 18), (b"%PDF-1 ", b"startxref %%EOF"), (b"\x1f\x8b\x08\0xyz", b"")):
        media.found((mark * 40_000 + end * 40_000), own)
    assert time.time() - began < 30
    assert [(k, a, e) for k, a, e, _ in media.found(b"xx" + z + b"PK\x03\x04 tail" + z, own)] == [("zip", 2, 2 + len(z)), ("zip", len(z) + 11, 2 * len(z) + 11)]


def test_sniffing_keeps_columns_of_any_name(spark, odd):
    df = odd.withColumn("_look", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("m", F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    out = media.sniff(df, "m")
    assert out.columns == [*df.columns, "type", "declared_ok", "carved"] and out.filter("_look = 'mine'").count() == odd.count()


def test_op3(spark, docs, odd, none):
    def check(df, rows):
        texts = collections.defaultdict(set)
        for r in df.select("doc_id", "text").collect():
            raw = (r["text"] or "").encode()
            pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            texts[r["doc_id"]].add((len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), hashlib.sha256(media.wave(pad)).hexdigest()))
        for r in rows:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) in texts[r["doc_id"]] and json.loads(r["feature"])["whole"]

    check(docs, media.op3(spark, SF).collect())
    rows = media.features(media.store(odd)).collect()
    assert len(rows) == odd.count() and media.features(media.store(none)).count() == 0
    check(odd, rows)


# toxicity


@pytest.mark.parametrize("others", [0, 2, 8])
def test_pairs_count_beyond_their_parts(others):
    """With the query's parameters: two pairs of words are toxic, the same words crossed aren't, so weights alone can't tell
    (they can where both words must occur, which is linearly separable), and factors can."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(8000)]

    def made(n):
        kinds = [(i % 2, i // 2 % 2) for i in range(n)]
        return [" ".join([("zzinsult", "wwpraise")[a], ("qqgroup", "jjobject")[b], *rng.sample(words, others)]) for a, b in kinds], np.array([a == b for a, b in kinds], float)

    texts, labels = made(6000)
    machine = toxicity.fit([toxicity._rows([t], {})[0] for t in texts], labels)
    texts, labels = made(400)
    assert np.mean((machine.score(*toxicity._rows(texts, {})) >= 0.5) == labels) > 0.95
    machine.factors[:] = 0
    assert np.mean((machine.score(*toxicity._rows(texts, {})) >= 0.5) == labels) < 0.6


def test_a_fit_is_bounded_and_repeats(spark, monkeypatch):
    """However documents are dealt, repeated or long, two fits on the same rows are one; bounds hold for rows and for terms."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(i % 90))) for i in range(300)] + [(i, f"again {i}") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(i, 1) for i in range(20)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 100)
    monkeypatch.setattr(toxicity, "MOST_TERMS", 2000)
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((sum(map(len, texts)), len(texts))) or fit(texts, y))
    a, b = (toxicity.learn(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 2), (rows[::-1], 7)))
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all() and seen[0] == seen[1] and 0 < seen[0][0] <= 2000 and seen[0][1] <= 100


def test_op8_learns_and_never_sees_the_held_out(spark, docs, odd, none):
    out = {r["doc_id"]: r for r in toxicity.op8(spark, SF).collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.learn(docs, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all()
    got = toxicity.score(odd, a).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(none, a).count() == 0
    empty = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(odd, empty).filter("score >= 0.5").count() == 0


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    out = toxicity.op8(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted").collect()
    caught, wrong = sum(r["toxic"] and r["predicted"] for r in out), sum(not r["toxic"] and r["predicted"] for r in out)
    assert caught >= 0.85 * sum(r["toxic"] for r in out) and wrong <= 0.01 * len(out)


# near duplicates


def brute(rows, size, threshold):
    """Component by shingle sets and all pairs that share one; rows: (id, text)."""
    sets = []
    for _, t in rows:
        w = sketch.words(t)
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    root, at = list(range(len(rows))), collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in at[g]).items():
            if k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9:
                root[find(i)] = find(j)
        for g in s:
            at[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(9999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("size, threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, size, threshold):
    rng = random.Random(size)
    rows = []
    for g in range(25):
        words = [f"t{g}_{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 5, 8, 30, 120, 600]))]
        for _ in range(rng.choice([1, 2, 12])):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice([0, 0.005, 0.02, 0.03, 0.06])))))
    hot = [f"h{i}" for i in range(150)]
    rows += [(len(rows) + i, " ".join(edited(rng, hot, rng.choice([0.01, 0.04, 0.08])))) for i in range(300)]
    boiler = " ".join(f"b{i}" for i in range(80))
    rows += [(len(rows) + i, boiler + " " + " ".join(str(rng.random()) for _ in range(12))) for i in range(60)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "UPPER case Words"), (len(rows) + 4, "upper CASE words")]
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size, threshold) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_find_links_across_them(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    for cluster in (4096, 8):
        monkeypatch.setattr(neardup, "CLUSTER", cluster)
        rng = random.Random(1)
        hot = [f"h{i}" for i in range(150)]
        rows = [(i, " ".join(edited(rng, hot, rng.choice([0.01, 0.03, 0.06])))) for i in range(80)]
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=0.85).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 0.85)


def reachable(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(4))
def test_components_of_stars_chains_and_webs(spark, seed):
    rng = random.Random(seed)
    name = rng.sample(range(10_000), 2000)
    edges = [(name[0], name[i]) for i in range(1, 200)] + [(name[i], name[i + 1]) for i in range(200, 290)] + [(i, i + 1) for i in range(20_000, 20_040)]
    edges += [(name[rng.randrange(300, 1000)], name[rng.randrange(300, 1000)]) for _ in range(seed * 250)] + [(7, 7), (name[400], name[400])] + edges[:50]
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["label"] for r in got} == reachable(edges) and len(got) == len({x for e in edges for x in e})


@pytest.mark.parametrize("wide", [True, False])
def test_a_hot_group_keeps_every_link(spark, monkeypatch, wide):
    """Thousands of texts of one template: some link with the first, some with others only, many with none."""
    monkeypatch.setattr(neardup, "FEW", neardup.FEW if wide else 0)
    rng = random.Random(11)
    hot = [f"h{i}" for i in range(60)]
    n = 5000 if wide else 700
    rows = [(i, " ".join(edited(rng, hot, rng.choice([0.0, 0.01, 0.03, 0.06, 0.1])))) for i in range(n)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=0.85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 0.85)


def test_an_ident_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (5, c), (5, c)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4)]


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == odd.count() and neardup.near_duplicates(none).count() == 0
    assert by[7][0]["component_id"] == 6 and not by[7][0]["kept"] and by[None][0]["kept"] and by[None][0]["component_id"] is None
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (2, 3, 4)) and by[9][0]["component_id"] == 8


def test_op10(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op10(spark, SF).collect()} == brute(rows, 3, 0.85)


def test_estimates_are_close():
    rng = random.Random(5)
    for share in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        n = 2000
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = np.concatenate([a[: int(n * share)], np.array([rng.getrandbits(64) for _ in range(n - int(n * share))], np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = sketch.estimated(np.array([(sketch.registers(a) == sketch.registers(b)).sum()]), np.array([n]), np.array([n]))[0]
        assert abs(got - true) < 4.5 * max(0.01, (true * (1 - true) / sketch.REGISTERS) ** 0.5)
    assert neardup.band_size(0.85) == 8 and neardup.band_size(0.8) == 6


# the pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    from tests.llm.test_native import base_spans

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    at = docs
    for i, (name, stage) in enumerate(cp.STAGES):
        new = cp.stored(stage(spark, at, SF), "test")
        if i < 4:
            assert new.columns == list(cp.COLUMNS)
        if name == "toxicity":
            machine = toxicity.learn(at, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.score(at, machine).filter("score < 0.5").collect()}
            assert {r["doc_id"] for r in new.collect()} == want
        if name == "near_duplicates":
            truth = brute([(r["doc_id"], r["text"]) for r in at.collect()], 5, 0.8)
            assert {r["doc_id"] for r in new.collect()} == {d for d, (_, c) in truth.items() if d == c}
        if name == "pii":
            spans = {r["doc_id"]: r["_spans"] for r in pii.find(at).collect()}
            texts = {r["doc_id"]: masked(r["text"], spans[r["doc_id"]]) for r in at.collect()}
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in new.collect()} == {d: (t, len(t)) for d, t in texts.items()}
            assert not any(base_spans(r["text"]) for r in new.collect())
        if name == "mixing":
            check_mix(at, new)
        if name == "bpe":
            own = bpe.loaded(WORD_BPE)
            assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in new.collect()))) == sorted(map(repr, ((r["doc_id"], own.encode(r["text"])) for r in at.collect())))
        at = new
    assert cp.run(spark, SF).count() == at.count()


def masked(text, spans):
    out, at = "", 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["kind"])):
        if s["start"] >= at:
            out += text[at:s["start"]] + f"[{s['kind'].upper()}]"
        at = max(at, s["end"])
    return out + text[at:]


def check_mix(before, after):
    """Words by document and source are those that the tree, the ranks and the documents' places give, near each target."""
    laid, drawn, plan = mixing.mix(before)
    texts = {r["doc_id"]: sketch_words(r["text"]) for r in before.collect()}
    want, got, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in drawn.collect():
        want.update((r["_id"], w) for w in texts[r["_id"]][r["from_word"]:r["from_word"] + r["n_words"]])
    for r in after.collect():
        own = sketch_words(r["text"])
        got.update((r["doc_id"], w) for w in own)
        taken[r["source"]] += len(own)
        assert r["n_chars"] == len(r["text"])
    assert got == want
    for r in plan.collect():
        assert abs(taken[r["source"]] - r["target"]) <= 0.02 * r["target"] + 5


def sketch_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (6, None), (10, 0), (11, 0), (8, 0), (14, 0), (9, 0), (12, 0)], "doc_id long, toxic int")
    for name, df in (("odd", odd), ("none", none)):
        (at := tmp_path / name).mkdir()
        df.write.parquet(f"file://{at}/documents.parquet")
        labels.withColumn("quality", F.lit(1)).write.parquet(f"file://{at}/labels.parquet")
        for i, (stage, run) in enumerate(cp.STAGES):
            out = run(spark, df, str(at))
            rows = out.collect()
            assert i == 4 or out.columns == list(cp.COLUMNS), stage
            assert df is odd or not rows
            if df is odd and stage == "toxicity":
                assert {r["doc_id"] for r in rows} >= {None, 2, 3, 4} and len(rows) <= odd.count()
            if df is odd and stage == "near_duplicates":
                assert sorted((str(r["doc_id"]) for r in rows)) == sorted(str(i) for i in (1, 2, 3, 4, None, 5, 6, 8, 10, 11, 12, 13, 14))
            if df is odd and stage == "pii":
                assert len(rows) == odd.count() and {r["doc_id"]: r["text"] for r in rows}[2] is None and {r["doc_id"]: r["text"] for r in rows}[1].count("[") == 4
            if df is odd and stage == "mixing":
                words = collections.Counter(r["doc_id"] for r in odd.collect() for _ in sketch_words(r["text"]))
                drawn = collections.Counter(r["doc_id"] for r in rows for _ in sketch_words(r["text"]))
                assert set(drawn) <= set(words) and all(n <= 3 * words[d] for d, n in drawn.items()) and drawn[None] > 0
            if df is odd and stage == "bpe":
                own = bpe.loaded(WORD_BPE)
                assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids"]) for r in rows) == sorted((str(r["doc_id"]), len(own.encode(r["text"])), own.encode(r["text"])) for r in odd.collect())
        assert (cp.run(spark, str(at)).count() > 0) == (df is odd)


def test_one_row_of_a_repeated_ident_stays(spark):
    import corpus_pipeline as cp

    a, b = ("shared words of one text that others have too " * 2).strip(), "quite another text with its own words in it"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1)]
    out = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("1", min(a, b)), ("None", a), ("None", a)])
