"""The dealt operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from framelake.llm import bpe, jpeg, langid, lengths, mixing, revisits, secrets, shards, simhash, topk
from framelake.llm.components import connected_components
from framelake.llm.queries import op7_kd_shards, queries, vocabulary
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, h string, row string"
ODD = [
    None, "", " ", "a", "A b", "\t\n", "é", "日本語 テキスト", "x" * 5000, "word " * 40_000, "🙂 emoji 🙂", "a\u0000b", "they're we'll 12345 !!! \n\n  end",
    "password = 'hunter2hunter2' and token: abc, API_KEY=abcd1234EFGH, secret:token : abcdefgh12", "AKIA" + "A" * 11 + " AKIA" + "B" * 12 + "é AKIAAKIA" + "C" * 12,
    "0123456789abcdef" * 2 + " " + "0" * 31 + " é " + "f" * 40, "ghp_16C7e42F292c6912E7710c838347Ae178B4a", 'token = "' + "ab12" * 10 + '" passwd=' + "ab12" * 10,
]


def rows_of():
    rnd = random.Random(3)
    base = [f"the quick brown fox number {i} jumps over {rnd.randrange(99)} lazy dogs " * 3 for i in range(20)]
    texts = ODD + base + base[:5] + [base[0].replace("lazy", "sleepy", 1), "word " * 40_000]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, "no id here, only text", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_is_tiktoken(docs, none):
    import tiktoken

    ranks, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    assert set(coded.columns) == {*docs.columns, "decoded"}  # the clashing ids column is replaced
    got = coded.select("text", "ids", "decoded").collect()
    assert len(got) == len(rows_of())
    for r in got:
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(none, ranks, pattern).count() == 0 and bpe.round_trip(none, ranks, pattern).count() == 0
    both = bpe.round_trip(docs, ranks, pattern)
    assert "text" not in both.columns
    assert Counter((tuple(r["ids"]), bytes(r["decoded"])) for r in both.collect()) == Counter((tuple(r["ids"]), bytes(r["decoded"])) for r in got)
    counted = Counter(r["n_tokens"] for r in bpe.count_tokens(docs, ranks, pattern).collect())
    assert counted == Counter(len(r["ids"]) for r in got)


def test_bpe_lower_rank_born_in_a_word():
    """A merge can make a pair of a lower rank; it comes before the same merge further right."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bcd": 256, b"ab": 300, b"abcd": 290, b"cd": 299, b"bc": 400, b"da": 310}
    import tiktoken

    own = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    replay, rnd = bpe.MergeReplay(ranks, r"\w+"), random.Random(5)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    for w, ids in zip(words, replay.replay([w.encode() for w in words])):
        assert ids == own.encode_ordinary(w) or w.encode() in ranks


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secret_spans(docs, none):
    found = secrets.find_secrets(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").select("text", *secrets.digests()).collect()
    assert len(found) == len(rows_of()) - 2  # the join drops null ids
    for r in found:
        spans = base_spans(r["text"])
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans))
        assert set(f"{k}:{s}:{e}" for s, _, k, e in spans) <= set(r["spans"].split(","))
    assert any("live:0:40" in r["spans"] for r in found)
    assert secrets.find_secrets(none).count() == 0 and secrets.find_secrets(docs).count() == len(rows_of())


def test_secrets_separate_examples_from_live(spark):
    shown, own = "Zx9kQ1" * 5 + "ab12", "Qp7wE3" * 5 + "cd34"
    rows = [(i, f"see {shown} here", f"owner{i}") for i in range(6)] + [(9, f"mine {own} twice {own}", "owner9"), (10, f"mine {own}", "owner9")]
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).select(*secrets.digests()).collect()}
    assert all(got[i]["spans"] == "" and got[i]["n_example"] == 1 for i in range(6))
    assert got[9]["spans"].count("live") == 2 and got[9]["n_live"] == 2 and got[10]["n_live"] == 1


def test_secrets_by_owners_and_repositories(spark):
    a, b, c = ("Zx9kQ1" * 5 + x for x in ("aa11", "bb22", "cc33"))
    rows = [(i, f"see {a}", f"o{i % 2}") for i in range(12)] + [(20 + i, f"see {b}", "o1") for i in range(12)] + [(40 + i, f"see {c}", f"o{i % 2}") for i in range(4)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((got[i]["n_example"], got[i]["n_live"]) == ((1, 0) if i < 20 else (0, 1)) for i in got)  # two owners, twelve repositories; one owner, twelve; two, four


def test_texts_with_very_many_spans(spark):
    import time

    parts = [f"é token={'ab1' * 3}{i} AKIA{'Z' * 12}{i} {'0f' * 16} x{i}" for i in range(6_000)]
    frame = spark.createDataFrame([(1, "\n".join(parts), "s"), (2, " ".join(parts[:300]), "s"), (3, parts[0], "s")], "doc_id long, text string, source string")
    texts = {1: "\n".join(parts), 2: " ".join(parts[:300]), 3: parts[0]}
    at = time.time()
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame).select(*secrets.digests()).collect()}
    assert time.time() - at < 60
    for i, text in texts.items():
        spans = base_spans(text)
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)) and got[i]["n_hex"] == len(text.split("0f0f")) // 8


def test_redaction(docs):
    before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    rows = secrets.redacted(docs).collect()
    assert rows[0].__fields__ == docs.columns and len(rows) == len(before)
    for (i, old), r in zip(before, sorted(rows, key=lambda r: str((r["doc_id"], dict(before).get(r["doc_id"]) if r["doc_id"] is not None else r["text"])))):
        assert i == r["doc_id"]
        spans = base_spans(old) if i != ODD.index("ghp_16C7e42F292c6912E7710c838347Ae178B4a") else [(0, 3, "live", 40)]
        if not spans:
            assert r["text"] == old
            continue
        new, at = "", 0
        for s, _, _, e in spans:
            if s < at:
                at = max(at, e)
                continue
            new, at = new + old[at:s] + "<secret>", e
        assert r["text"] == new + old[at:] and r["n_chars"] == len(r["text"])


def test_jpeg_round_trip(docs, none):
    got = jpeg.media_features(jpeg.with_media(docs)).select("n_bytes", "payload", *jpeg.digests()).collect()
    want = Counter()
    for r in rows_of():
        raw = (r[1] or "").encode()
        want[len(raw), sha(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))] += 1
    assert Counter((r["n_bytes"], r["payload_sha256"]) for r in got) == want
    assert all(r["tail_crc32"] == zlib.crc32(bytes(r["payload"])[-64:]) and r["payload_bytes"] % 64 == 0 for r in got)
    once = jpeg.stored_features(docs).select("n_bytes", "payload", *jpeg.digests())
    assert Counter(map(str, once.collect())) == Counter(map(str, got))
    assert jpeg.media_features(jpeg.with_media(none)).count() == 0 and jpeg.stored_features(none).count() == 0


def test_jpeg_many_images_and_errors():
    raw = np.random.default_rng(1).integers(0, 256, 64 * 8200).astype(np.uint8).tobytes()
    (images,) = jpeg.thumbnails([jpeg.store(raw)])
    assert len(images) == 2 and b"".join(t.tobytes() for _, _, t in images) == raw and images[0][:2] == (512, 65528)
    for bad in (b"", raw[:10]):
        with pytest.raises(ValueError):
            jpeg.store(bad)
    for bad in (jpeg.store(bytes(64))[:-30], jpeg.store(bytes(64))[:-2], b"", b"x", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.thumbnails([bad])


def test_features_cover_all_images(spark):
    long = "ab" * 270_000
    rows = [(0, long), (1, long[:-1] + "c"), (2, long[:530_000] + "zz" * 5_000), (3, long)]
    got = {r["doc_id"]: r for r in jpeg.stored_features(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "images", *jpeg.digests()).collect()}
    assert all(r["images"] == 2 for r in got.values())
    assert got[0]["feature"] == got[3]["feature"] and len({r["feature"] for r in got.values()}) == 3


def test_broken_images_have_a_status(spark):
    rnd, good = random.Random(6), jpeg.store(bytes(range(64)) * 3)
    cut = [good[:k] for k in range(len(good))]
    hurt = [bytes(rnd.randrange(256) if rnd.random() < 0.02 else x for x in good) for _ in range(300)]
    rows = [(0, good, "old"), (1, None, "old"), (2, b"", "old"), (3, good + good, "old"), (4, good + b"x", "old")] + [(10 + i, x, "old") for i, x in enumerate(cut + hurt)]
    frame = spark.createDataFrame(rows, "id long, media binary, status string").repartition(2)
    got = {r["id"]: r for r in jpeg.media_features(frame).collect()}
    assert len(got) == len(rows) and [got[i]["status"] for i in range(5)] == ["ok", "null", "broken", "ok", "broken"]
    assert bytes(got[3]["payload"]) == bytes(range(64)) * 6 and got[3]["images"] == 2
    assert all(got[10 + i]["status"] == "broken" and got[10 + i]["payload"] is None for i in range(len(cut)))
    assert {got[10 + len(cut) + i]["status"] for i in range(len(hurt))} == {"ok", "broken"}


def test_jpeg_reads_several_scans():
    """Luminance of 2x1 sampling in a scan of its own, after a scan of the other component."""
    rows, dc = 2, bytes(jpeg._DC) + bytes(range(12))
    seg, values = jpeg._segment, np.arange(64 * 2, dtype=np.uint8)
    grey = jpeg.store(values.tobytes())
    scan = grey[grey.index(b"\xff\xda") + 10 : -2]
    other = bytes([0b00000000] * 16)  # DC and AC codes of no step: 3 bits a block, for 32 x 2 blocks 24 bytes
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x08" * 64) + seg(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (512).to_bytes(2, "big") + b"\x02\x01\x21\x00\x02\x11\x00")
    head += seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    image = head + seg(0xDA, b"\x01\x02\x00\x00\x3f\x00") + other + bytes(8) + seg(0xDD, (64).to_bytes(2, "big")) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    ((width, height, thumb),) = jpeg.thumbnails([image])[0]
    assert (width, height) == (512, 16) and (thumb.ravel() == values).all()


def test_jpeg_reads_colour_and_ac():
    """Three components, 2x2 luminance sampling, AC coefficients, no restart interval: bits written here one by one."""
    dc, ac = bytes(jpeg._DC) + bytes(range(12)), bytes([0, 2, 1] + [0] * 13) + bytes([0x00, 0x01, 0x12])
    dccode = {s: format(c, f"0{n}b") for s, (c, n) in enumerate(jpeg._DC_CODES)}
    accode = {0x00: "00", 0x01: "01", 0x12: "100"}
    rnd, bits, before, luma = random.Random(2), "", [0, 0, 0], []

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for _ in range(3 * 2):
        for c in (0, 0, 0, 0, 1, 2):
            v = rnd.randrange(-100, 100)
            n, b = number(v - before[c])
            before[c] = v
            bits += dccode[n] + b + rnd.choice(["", accode[0x01] + "1", accode[0x12] + "10" + accode[0x01] + "0"]) + accode[0]
            if c == 0:
                luma.append(v)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    image = b"\xff\xd8" + seg(0xE0, b"JFIF") + seg(0xDB, b"\x00" + b"\x08" * 64) + seg(0xC0, b"\x08\x00\x20\x00\x2f\x03" + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    image += seg(0xC4, b"\x00" + dc + b"\x10" + ac) + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    ((width, height, thumb),) = jpeg.thumbnails([image])[0]
    assert (width, height, thumb.shape) == (47, 32, (4, 6))
    grid = np.array(luma).reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (thumb == np.clip(grid + 128, 0, 255)).all()


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, none):
    rows = [(r[0], brute_fingerprint(r[1])) for r in rows_of()]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = defaultdict(list)
    for (i, _), x in zip(rows, label):
        least[x] += [i] if i is not None else []
    want = Counter((i, f, min(least[x], default=None)) for (i, f), x in zip(rows, label))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    assert {r["doc_id"] for r in simhash.kept(docs).collect()} - {None} == {c for _, _, c in want if c is not None}


def brute_components(rows):
    """Least index of those reached over pairs of Jaccard similarity 0.8 of the sets of five-word shingles."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t in rows for w in [(t or "").lower().split()]]
    i, j = zip(*((i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])))
    from framelake.llm.components import roots

    return roots(len(sets), np.array(i), np.array(j)).tolist()


def test_similar_documents_are_those_of_exact_similarity(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    line, texts = " ".join(word() for _ in range(12)), ["a b c", "a b c", "", None, "w"]
    for copies in (10, 30):  # a line twice or often: the sets equal but for the seams
        base = " ".join(word() for _ in range(300))
        texts += [base + (" " + line) * 2, base + (" " + line) * copies]
    for size in [*range(6, 30), *range(30, 200, 17)]:  # around the bound, on either side
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3):
            new = list(base)
            for _ in range(edits):
                new[rnd.randrange(size)] = word()
            texts.append(" ".join(new[: size - rnd.randrange(3)]) + (" " + word()) * rnd.randrange(3))
    base = [word() for _ in range(80)]  # many near copies that share most cells
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert got[6] == 5 and got[8] == 7 and 50 < len(set(want)) < len(texts) - 80


def test_parity_sketches_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n, m in ((5, 7), (64, 60), (300, 330), (1000, 4000), (70_000, 66_000)):
        both = rng.integers(0, 2**63, min(n, m) // 2).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, k - len(both)).astype(np.uint64)))) for k in (n, m))
        x, y = (np.frombuffer(simhash.parity_sketch(z), np.uint64)[None, :] for z in (a, b))
        words = min(x.shape[1], y.shape[1])
        x, y = simhash._folded(x, words), simhash._folded(y, words)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) and simhash._folded(x, 1).shape == (1, 1)


def test_large_cells_lose_no_link(spark, monkeypatch):
    """A hub whose near copies aren't alike themselves, in cells cut over several tasks and pieces."""
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(150):  # edits far apart: each is like the hub, hardly any two are like one another
        new = list(base)
        for at in rnd.sample(range(0, 200, 6), 3):
            new[at] = f"x{k}{at}"
        texts.append(" ".join(new))
    texts += [" ".join([*base[:60], *(f"o{k}{i}" for i in range(140))]) for k in range(100)]  # a shared passage only
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_components(texts)
    assert len(set(want)) > 90
    for rows, common in ((100_000, 400_000), (70, 0)):
        monkeypatch.setattr(simhash, "MEET_ROWS", rows)
        monkeypatch.setattr(simhash, "COMMON", common)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame, tile_rows=40).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_one_row_of_each_component_stays(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(40)) for _ in range(12)]
    # nameless texts of their own, one id for unrelated texts, nameless copies of a named one, copies of nameless ones
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:8]] + [(8, texts[8]), (None, texts[8]), (None, texts[8] + " end"), (None, texts[0]), (9, texts[9]), (9, texts[9]), (None, None), (None, "")]
    got = simhash.kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter({*((None, t) for t in texts[:4]), *((7, t) for t in texts[4:8]), (8, texts[8]), (9, texts[9]), (None, "")})


@pytest.mark.parametrize("tile_rows", [4096, 40])
def test_links_lose_no_component(spark, tile_rows):
    rnd, fps = random.Random(4), set()
    for size in (1, 1, 2, 5, 300):
        seed = rnd.getrandbits(64)
        fps |= {seed}
        for _ in range(size):
            fps.add(rnd.choice(sorted(fps)) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(500)})
    a = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    from framelake.llm.components import roots

    want = roots(len(a), i, j)
    frame = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    links = simhash.links(frame, 3, tile_rows)
    assert links.count() <= 8 * len(a)
    for bands in (5, 7):  # as larger tables are cut
        finer = {r["node"] % 2**64: r["root"] % 2**64 for r in connected_components(simhash.links(frame, 3, tile_rows, bands)).collect()}
        assert len({finer.get(x, x) for x in fps}) == len(set(want.tolist()))
    assert simhash.band_count(10**5, 3) == 4 and simhash.band_count(10**10, 3) > 4
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in connected_components(links).collect()}
    groups = defaultdict(set)
    for x, w in zip(fps, want):
        groups[got.get(x, x)].add(int(w))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.tolist()))


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, one_task):
    from framelake.llm import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(301)) and len(got) == 502


def simulate(parts, n):
    """Earliest deadline first, slot by slot; each source's blocks are endless."""
    q, had, out = sum(parts.values()), Counter(), []
    for t in range(n):
        free = [(-(-(had[s] + 1) * q // p), s) for s, p in sorted(parts.items()) if had[s] * q // p <= t]
        had[min(free)[1]] += 1
        out.append(min(free)[1])
    return out


def test_pfair_stays_within_one_block():
    for parts in ({"a": 7, "b": 2, "c": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 333, "b": 333, "c": 334}, {"a": 1}):
        q, had = sum(parts.values()), Counter()
        slots = mixing.period(parts)
        assert slots == simulate(parts, q)
        for t, s in enumerate(slots, 1):
            had[s] += 1
            assert all(abs(had[x] * q - t * p) < q for x, p in parts.items())


def test_mixing_order(docs, none, spark):
    rows = [(i, "hot" if i % 3 else "cold" if i % 2 else None) for i in range(4000)] + [(i, "tiny") for i in range(4000, 4003)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(frame, "source", ["doc_id"], {"hot": 0.6, "cold": 0.3, "tiny": 0.1}, block_rows=50).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == sorted(rows, key=lambda x: x[0])
    at = defaultdict(set)
    for r in got:
        at[r["slot"]].add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in at.values()) and sorted(at) == list(range(len(at)))
    # brute force: EDF slot by slot, begun anew when a source has run out
    left = {s: math.ceil(n / 50) for s, n in Counter(r[1] for r in rows).items()}
    parts = mixing.to_parts({"hot": 0.6, "cold": 0.3, "tiny": 0.1, None: 0.1})
    rank = {s: i for i, s in enumerate(sorted(left, key=lambda s: (-Counter(r[1] for r in rows)[s], s is not None, s or "")))}
    order = []
    while left:
        for i in simulate({rank[s]: parts[s] for s in left}, 10**4):
            s = next(x for x in left if rank[x] == i)
            order.append(s)
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    assert [next(iter(at[t]))[0] for t in range(len(at))] == order
    assert Counter(mixing.ordered(docs).collect()) == Counter(docs.collect())
    assert mixing.mixed(none).count() == 0 and mixing.ordered(none).count() == 0
    own = mixing.mixed(frame.selectExpr("*", "'mine' AS block", "'mine' AS slot", "'mine' AS mix_pos", "1 AS extra"), "source", ["doc_id"])
    assert own.columns == ["doc_id", "source", "extra", "block", "slot", "mix_pos"] and dict(own.dtypes)["slot"] == "bigint" and own.count() == len(rows)
    pooled = mixing.mixed(frame, "source", ["doc_id"], most_sources=2).collect()
    assert len(pooled) == len(rows) and len({(r["slot"], r["mix_pos"]) for r in pooled}) == len(rows)


def test_mixing_follows_the_weights_given(spark):
    for n, slots in ((20, 30_000), (200, 20_000)):  # against the weights themselves, not what they may be rounded to
        weights = {i: (n * 75 if i == 0 else 150 + i) ** 0.5 for i in range(n)} | ({1: 0.0001, 2: 0.0} if n == 20 else {})
        parts, had, total = mixing.to_parts(weights), np.zeros(n), sum(weights.values())
        target = np.array([weights[i] / total for i in range(n)])
        for t, i in enumerate(mixing.schedule([10**6] * n, list(parts.values()))):
            if t == slots:
                break
            had[i] += 1
            assert abs(had - (t + 1) * target).max() < 1 + 1e-6
    assert list(mixing.schedule([2, 1], [1, 0])) == [0, 0, 1]
    rows = [(s * 1000 + i, f"s{s}") for s in range(300) for i in range(3 + (s == 7) * 60)]  # more sources than were scheduled
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), "source", ["doc_id"], {"s7": 30, "s299": 5, "": 1}, block_rows=1).collect()
    order = [r["source"] for r in sorted(got, key=lambda r: r["slot"])]
    assert [r["slot"] for r in sorted(got, key=lambda r: r["slot"])] == list(range(len(rows)))
    for t in range(1, 133):  # before any has run out
        assert all(abs(order[:t].count(x) - t * w / 333) < 1 for x, w in (("s7", 30), ("s299", 5), ("s0", 1), ("s298", 1)))


def test_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.3, (700, 8)).astype(np.float32)
    v[300:500] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (950, [float("nan")] * 8), (1000, [1.0, None] + [0.0] * 6), (1050, [1.0] * 3), (None, [1.0] * 8), (1100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.whole_numbers("embedding").alias("whole"))
    got = topk.top_products(frame, F.col("vec_id") % 50 == 0, query_block=7, data_block=100).collect()
    w = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        best = sorted((-int(w[q] @ w[r]), r) for r in range(700) if r != q)[:5]
        want += [(q, k, r, -s) for k, (s, r) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == want
    assert topk.top_products(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    clash = frame.selectExpr("vec_id", "whole", "1 AS id", "2 AS v", "'x' AS q", "0 AS score").union(frame.where("vec_id = 50").selectExpr("vec_id", "transform(whole, x -> x + 10000L)", "1", "2", "'x'", "0"))
    again = {tuple(r) for r in topk.top_products(clash, F.col("vec_id") % 50 == 0, data_block=100).collect()}
    assert {r for r in again if r[0] == 50 and r[1] == 1} == {r for r in map(tuple, got) if r[0] == 50 and r[1] == 1}


def test_cover_tree_invariants():
    rng = np.random.default_rng(3)
    for x in (rng.normal(0, 100, (900, 3)), rng.normal(0, 1, (40, 1, 8)) * 1000 + rng.normal(0, 3, (40, 20, 8)), np.zeros((50, 4)), np.repeat(rng.normal(0, 9, (5, 2)), 30, axis=0), rng.normal(0, 1, (1, 2))):
        x = x.reshape(-1, x.shape[-1])
        chosen, reach, nearest = topk.farthest_first(x, 60)
        assert (np.diff(reach) <= 1e-9).all()
        far = np.sqrt(((x - x[chosen[nearest]]) ** 2).sum(axis=1))
        for i in np.unique(np.floor(np.log2(reach[1:]))) if len(reach) > 1 else ():
            net = x[chosen[reach > 2.0**i]]
            apart = np.sqrt(((net[:, None] - net[None]) ** 2).sum(axis=2)) + np.eye(len(net)) * 1e9
            to_net = np.sqrt(((x[:, None] - net[None]) ** 2).sum(axis=2)).min(axis=1)
            assert (apart > 2.0**i).all() and (len(net) == len(chosen) or to_net.max() <= 2.0**i + 1e-9)
        tree = topk.CoverTree(x, 8)
        assert sorted(tree.order.tolist()) == list(range(len(x))) and tree.start[0] == 0 and tree.end[0] == len(x)
        for node, below in enumerate(tree.children):
            mine = x[tree.order[tree.start[node] : tree.end[node]]]
            assert np.sqrt(((mine - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node]
            if below:  # nesting: a node's centre is one of its children's; children part its points
                assert any((tree.centre[c] == tree.centre[node]).all() for c in below)
                assert sorted(i for c in below for i in range(tree.start[c], tree.end[c])) == list(range(tree.start[node], tree.end[node]))
                assert all(tree.level[c] > tree.level[node] for c in below)


def test_pruned_pivots_are_not_shuffled(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 1, (30, 1, 12)) * 200 + rng.normal(0, 3, (30, 400, 12))).reshape(-1, 12)
    frame = spark.createDataFrame([(i, [int(y) for y in v]) for i, v in enumerate(x)], "id long, v array<bigint>").withColumn("q", F.col("id") % 50 == 0)
    pivots = topk._pivots(frame, 12_000 * 50)  # as many pivots as a larger table would have
    shared = spark.sparkContext.broadcast(pivots)
    placed = topk._assigned(frame, shared).withColumn("d", F.size("v"))
    balls = {(r["d"], r["p"]): r["far"] + 1e-6 for r in placed.groupBy("d", "p").agg(F.max("far").alias("far")).collect()}
    asked = topk._asked(placed.where("q"), shared, balls, 5).count()
    assert len(balls) > 25 and asked < 0.5 * 240 * len(balls)


def test_dual_tree_prunes_clusters():
    rng = np.random.default_rng(1)
    r = np.floor(rng.normal(0, 200, (40, 1, 16)) + rng.normal(0, 4, (40, 200, 16))).reshape(-1, 16)
    q = r[::50]
    score, best, products = topk.search(np.arange(len(q)) * 50, q, np.arange(len(r)), r, 5)
    s = (q @ r.T).astype(np.int64)
    s[np.arange(len(q)), np.arange(len(q)) * 50] = np.iinfo(np.int64).min
    assert (score == -np.sort(-s.astype(float), axis=1)[:, :5]).all() and products < 0.5 * s.size


def test_shards(docs, none, spark):
    rows = op7_kd_shards(spark, SF).collect()
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(table) and {r["shard"] for r in rows} <= set(range(40))
    assert all(r["size"] == len((table[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((table[r["doc_id"]] or "").encode()) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    even = [(i, "some text" * (1 + i % 7), f"s{i % 5}" if i % 3 else "hot", i % 11) for i in range(6000)]
    placed = shards.kd_shards(spark.createDataFrame(even, "doc_id long, text string, source string, n_chars long"), "doc_id", "text", ["source", "n_chars"], 40)
    size = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 40 and max(size) < 1.03 * min(size)
    copies = spark.createDataFrame([(i, "same", "s", 4) for i in range(4000)], "doc_id long, text string, source string, n_chars long")
    size = [r["n"] for r in shards.kd_shards(copies, "doc_id", "text", ["source", "n_chars"], 7).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(size) == 7 and max(size) < 1.03 * min(size)
    assert shards.sharded(docs).count() == len(rows_of()) and shards.sharded(none).count() == 0
    assert shards.kd_shards(copies, "doc_id", "text", ["source"], None, target_bytes=8000).select("shard").distinct().count() == 10


def test_revisits(spark):
    m = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.Example.com:80/a/?utm_x=1&b=2&a=1#f", 100, "response", '"e1"', None, "d1", m(etag='"e1"', content_type="x", age="1")),
        (2, "https://example.com/a?a=1&b=2", 200, "revisit", 'W/"e1"', None, None, m(content_type="y", age="9", date="now")),
        (3, "https://example.com/a?a=1&b=2", 300, "revisit", '"e2"', None, None, None),
        (4, "https://example.com/a?a=1&b=2", 300_000, "revisit", None, None, "d1", None),
        (5, "https://example.com/a?a=1&b=2", 50, "revisit", '"e1"', None, None, None),
        (6, "https://example.com/a?a=1&b=2", 400_000, "revisit", None, "m", None, None),
        (7, None, 1, "revisit", None, None, None, None), (None, None, None, None, None, None, None, None), (9, "", 5, "response", None, None, "d", None),
        (2, "https://example.com/a?a=1&b=2", 200, "revisit", 'W/"e1"', None, None, m(content_type="y", age="9", date="now")),
    ]
    frame = spark.createDataFrame(rows, "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    got = revisits.resolve_revisits(frame)
    by = {r["id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert {i: r["state"] for i, r in by.items()} == {1: "full", 2: "resolved", 3: "mismatch", 4: "resolved", 5: "missing", 6: "no_validator", 7: "missing", None: "full", 9: "full"}
    assert by[2]["resolved_id"] == 1 and by[2]["digest"] == "d1" and by[2]["canonical"] == "example.com/a?a=1&b=2"
    assert by[2]["headers"] == {"etag": '"e1"', "content-type": "x", "age": "9", "date": "now"}
    bodies = frame.where("kind = 'response'").select("id", F.lit(b"body").alias("payload"))
    assert {r["id"]: r["payload"] is not None for r in revisits.with_payload(got, bodies).collect()}[2]
    assert revisits.resolve_revisits(frame.where("false")).count() == 0


def test_warc_reader(spark, tmp_path):
    import gzip

    def record(kind, headers, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    raw = record("warcinfo", {}, b"x") + record("response", {"WARC-Record-ID": "<1>", "WARC-Target-URI": "http://a/b", "WARC-Date": "2020-01-01T00:00:00Z"}, b'HTTP/1.1 200 OK\r\nETag: "q"\r\n\r\nhello')
    late = record("revisit", {"WARC-Record-ID": "<2>", "WARC-Target-URI": "http://a/b", "WARC-Date": "2020-01-02T00:00:00Z"}, b'HTTP/1.1 304 Not Modified\r\nETag: "q"\r\n\r\n')
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(late))
    captures = revisits.read_warc(spark.read.format("binaryFile").load(str(tmp_path)))
    done = {r["id"]: r for r in revisits.with_payload(revisits.resolve_revisits(captures), captures.where("kind = 'response'")).collect()}
    assert done["<2>"]["state"] == "resolved" and bytes(done["<2>"]["payload"]) == b"hello"


def test_equal_texts_stay_in_one_shard(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(i, f"text {i} " * rnd.randrange(1, 9), f"s{rnd.randrange(9)}", rnd.randrange(99)) for i in range(4000)]
    rows += [(10_000 + 10 * g + i, f"copy {g} " * 5, f"s{rnd.randrange(9)}", rnd.randrange(99)) for g in range(150) for i in range(rnd.randrange(2, 6))]
    rows += [(50_000 + i, "hot text", f"s{rnd.randrange(9)}", 8) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in shards.kd_shards(frame, "doc_id", "text", ["source", "n_chars"], 16).collect()}
    at, size = defaultdict(set), Counter()
    for r in rows:
        at[r[1]].add(got[r[0]]["shard"])
        size[got[r[0]]["shard"]] += got[r[0]]["size"]
    assert all(len(x) == 1 for t, x in at.items() if t != "hot text") and len(at["hot text"]) > 1
    assert len(size) == 16 and max(size.values()) < 1.1 * min(size.values())
    assert shards.kd_shards(frame.where("false"), "doc_id", "text", ["source"], None, target_bytes=100).count() == 0
    monkeypatch.setattr(shards, "MOST_BINS", 64)  # as for very many nodes: fewer bins, more passes
    size = Counter()
    for r in shards.kd_shards(frame, "doc_id", "text", ["source", "n_chars"], 16).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 16 and max(size.values()) < 1.1 * min(size.values())
    monkeypatch.undo()
    clash = frame.selectExpr("*", "1 AS size", "2 AS shard", "3 AS ht", "4 AS node", "5 AS d0")
    assert {r["doc_id"]: r["shard"] for r in shards.kd_shards(clash, "doc_id", "text", ["source", "n_chars"], 16).collect()} == {i: r["shard"] for i, r in got.items()}


def test_headers_that_differ_in_case(spark):
    m = [({"Date": "a", "date": "b", "ETag": "x"}, {"DATE": "c", "date": None, "Content-Length": "9"}), (None, None), ({"x": "1"}, None), ({"X": None}, {"Date": "d"})]
    frame = spark.createDataFrame(m, "a map<string,string>, b map<string,string>").select(revisits.merged_headers(F.col("a"), F.col("b")).alias("m"))
    assert [r["m"] for r in frame.collect()] == [{"etag": "x", "date": "c, "}, {}, {"x": "1"}, {"x": None, "date": "d"}]


def test_hot_address_is_cut_finer(spark):
    rnd = random.Random(2)
    rows = [(i, "http://h/a", rnd.randrange(200) if i % 50 else None, "response" if rnd.random() < 0.3 else "revisit", "e" if rnd.random() < 0.9 else None, None, "d", {"a": "x" * 10_000}, "old") for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, state string").repartition(3)
    want, full = {}, None
    for r in sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], r[0])):
        want[r[0]] = full if r[3] == "revisit" else None
        full = r[0] if r[3] == "response" else full
    for cut in (20_000, 10):
        got = {r["id"]: r for r in revisits.resolve_revisits(frame, 100, cut).collect()}
        assert len(got) == 600 and {i: r["resolved_id"] for i, r in got.items()} == want


def test_broken_warc_files(spark, tmp_path):
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 37\r\n\r\nHTTP/1.1 200 OK\r\nVia: a\r\nvia: b\r\n\r\nhi\r\n\r\n"
    nodate = one.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"").replace(b"<1>", b"<2>")
    nolength = one.replace(b"Content-Length: 37\r\n", b"").replace(b"<1>", b"<3>")
    zipped = gzip.compress(one) + gzip.compress(nodate)
    files = [one + nodate + nolength + one, zipped, b"", None, b"\x1f\x8bnot gzip", zipped[:-20], *(one[:k] for k in range(1, len(one), 7))]
    got = revisits.read_warc(spark.createDataFrame([(x,) for x in files], "content binary").coalesce(1)).collect()
    assert [(r["id"], r["problem"]) for r in got[:4]] == [("<1>", None), ("<2>", "no date"), ("<3>", "no length"), ("<1>", None)]
    assert got[0]["headers"] == {"via": "a, b"} and bytes(got[0]["payload"]) == b"hi" and got[0]["ts"] == 1577836800
    assert [(r["id"], r["problem"]) for r in got[4:9]] == [("<2>", "no date"), (None, "broken gzip"), ("<1>", None), ("<2>", "cut off"), (None, "broken gzip")]
    assert revisits.resolve_revisits(revisits.read_warc(spark.createDataFrame([(one,)], "content binary"))).count() == 1


def test_lengths(docs, spark):
    n = [1, 1, 5, 2000, 7, 7, 7, 0, 4096, 100_000]
    table = lengths.answers(lengths.histogram(spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens int")))
    for r in table.collect():
        limit = r["n_tokens"]
        over = [x for x in n if x >= limit]
        assert (r["docs"], r["docs_at_least"], r["tokens_at_least"]) == (n.count(limit), len(over), sum(over))
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n) and abs(r["share_at_most"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    got = {r["context_limit"]: (r["truncated_tokens"], r["docs_over"]) for r in lengths.at_limits(table, [0, 6, 3000, 10**6]).collect()}
    assert got == {x: (sum(min(y, x) for y in n), sum(y > x for y in n)) for x in (0, 6, 3000, 10**6)}
    assert {r["share"]: r["n_tokens"] for r in lengths.quantiles(table, [0.5, 0.9, 1.0]).collect()} == {0.5: 7, 0.9: 4096, 1.0: 100_000}
    assert lengths.answers(lengths.histogram(spark.createDataFrame([], "n_tokens int"))).count() == 0
    ranks, pattern = vocabulary()
    assert bpe.count_tokens(docs.where("false"), ranks, pattern).count() == 0
    counted = bpe.count_tokens(docs.withColumn("n_tokens", F.lit("old")), ranks, pattern)
    assert "text" not in counted.columns and dict(counted.dtypes)["n_tokens"] == "bigint" and counted.count() == len(rows_of())


def test_language_fusion(spark, docs, none):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 100")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    model = langid.fit(all_docs.where(~held_out), "text", "lang", "doc_id", rows=60)
    test = all_docs.where(held_out)
    got = langid.identify(test, model, "doc_id", "text", F.lit(None).cast("string"), F.col("source")).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_id"] for r in got) / len(got) > 0.97 and all(r["accepted"] for r in got)
    rows = langid.identify(docs, model, "doc_id", "text", F.col("lang"), F.col("source")).collect()
    assert len(rows) == len(rows_of()) and not any(r["accepted"] for r in rows if r["letters"] == 0)
    assert langid.identify(none, model, "doc_id", "text", F.col("lang"), F.col("source")).count() == 0
    assert langid.fit(none, "text", "lang", "doc_id").languages == ["und"]


def table_model(weights):
    """A model of de and en that knows only the trigrams of the words given, each by its counts."""
    i, b, n = [], [], []
    for word, counts in weights.items():
        for x in set(langid.trigrams(word).tolist()):
            for k, c in enumerate(counts):
                i, b, n = [*i, k], [*b, x], [*n, c]
    return langid.Model(["de", "en"], *(np.array(x, np.int64) for x in (i, b, n)))


def brute_fusion(model, rows):
    """(lang, posterior) of each (text, declared, host), counted and smoothed one by one."""
    n, weight, names = len(model.languages), langid.WEIGHT, model.languages
    ll = [model.score(t) for t, _, _ in rows]
    best = [int(np.argmax(x)) if langid.letters(t) > 0 else None for x, (t, _, _) in zip(ll, rows)]
    whole = np.array([best.count(i) + 1.0 for i in range(n)])
    base = whole / whole.sum()
    suffix = lambda h: m[1] if h and (m := re.search(r"\.([A-Za-z]+)$", h)) else None
    domain = lambda h: m[1] if h and (m := re.search(r"([^.]+\.[^.]+)$", h)) else None

    def counts(of):
        out = defaultdict(lambda: np.zeros(n))
        for r, b in zip(rows, best):
            if b is not None and of(r):
                out[of(r)][b] += 1
        return out

    declared = lambda r: (r[1] or "").lower() or None
    d, s, m, h = (counts(f) for f in (declared, lambda r: suffix(r[2]), lambda r: domain(r[2]), lambda r: r[2] or None))
    spread = lambda table, x: np.log((table[x] + weight * table[x].sum() / sum(table.values()).sum()) / (sum(table.values()) + weight)) if x in table else np.zeros(n)
    out = []
    for r, x in zip(rows, ll):
        parent = (m[domain(r[2])] + weight * base) / (m[domain(r[2])].sum() + weight) if domain(r[2]) in m else base
        prior = (h[r[2]] + weight * parent) / (h[r[2]].sum() + weight) if r[2] in h else base
        total = x + np.log(prior) + spread(s, suffix(r[2])) + spread(d, declared(r))
        e = np.exp(total - total.max())
        out.append((names[int(np.argmax(total))], 1 / e.sum()))
    return out


def test_evidence_is_fused_as_counted_one_by_one(spark):
    rnd, model = random.Random(1), table_model({"der": (60, 1), "the": (1, 60), "in": (20, 22)})
    hosts = ["a.example.de", "b.example.de", "c.other.uk", "example.uk", "src1", "", None, "x.de"]
    rows = [(rnd.choice(["der der", "the", "the der", "in", "qqq", "", None, "12 34", "in in in"]), rnd.choice(["de", "EN", "fr", "", None]), rnd.choice(hosts)) for _ in range(400)]
    rows += [("der der der", "de", "a.example.de")] * 40 + [("the the the", "en", "c.other.uk")] * 40 + [("in", None, "a.example.de"), ("in", "de", "c.other.uk"), ("in", "de", None)] * 2
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(frame, model, "doc_id", "text", F.col("declared"), F.col("host")).collect()}
    want = brute_fusion(model, rows)
    assert len(got) == len(rows)
    for i, (lang, posterior) in enumerate(want):
        assert got[i]["lang_id"] == lang and abs(got[i]["posterior"] - posterior) < 1e-9
    assert all((got[i]["text_lang"] is None) == (langid.letters(r[0]) == 0) for i, r in enumerate(rows))
    changed = sum(r["text_lang"] is not None and r["text_lang"] != r["lang_id"] for r in got.values())
    assert changed > 20  # evidence beside the text changes verdicts


def test_every_label_is_fitted(spark):
    words = [chr(97 + i % 26) + chr(97 + i // 26) + "qx" for i in range(90)]
    rows = [(f"{w} {w} {w}", f"l{i:02}", i * 10 + k) for i, w in enumerate(words) for k in range(1 if i % 2 else 9)] + [("no label", None, -1), (None, "l00", -2)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string, doc_id long"), "text", "lang", "doc_id", rows=4)
    assert model.languages == [f"l{i:02}" for i in range(90)]
    assert all(int(np.argmax(model.score(f"{w} {w}"))) == i for i, w in enumerate(words))


def test_markup_and_addresses(spark):
    page = spark.createDataFrame([("<!x><HTML class=a lang='De-at'><script>var a='<p>';</script><p>Gr&uuml;n &amp; <!-- x -->blau", "https://u@Www.Example.ORG:80/x")], "html string, url string")
    host = langid.address_host(F.col("url"))
    row = page.select(langid.markup_language(F.col("html")).alias("m"), host.alias("h"), langid.address_suffix(host).alias("s"), langid.address_domain(host).alias("d"), langid.markup_text(F.col("html")).alias("t")).first()
    assert tuple(row)[:4] == ("de", "www.example.org", "org", "example.org") and row["t"].split() == ["Gr", "n", "blau"]


def test_every_query_runs(spark):
    for name, query in queries().items():
        n = query(spark, SF).count()
        assert n > 0, name
