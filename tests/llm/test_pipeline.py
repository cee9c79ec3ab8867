"""corpus_pipeline against a brute-force version, stage by stage."""

import random
from collections import Counter

import corpus_pipeline
from framelake.llm import mixing, simhash
from framelake.llm.components import roots
from framelake.llm.queries import vocabulary

import numpy as np
import pyarrow.parquet as pq
from test_operators import base_spans, brute_components, brute_fingerprint, sha, simulate

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "secrets", "mixing", "encode"]
    first = stages["language"](spark, docs, SF).cache()
    assert first.columns == docs.columns
    kept = {r["doc_id"]: r for r in first.collect()}
    assert len(kept) == first.count() >= 0.95 * docs.count()
    second = {r["doc_id"]: r for r in stages["near_duplicates"](spark, first, SF).collect()}
    # by the texts themselves: Jaccard similarity of the sets of five-word shingles, 0.8 or more
    order = sorted(kept)
    low = dict(zip(order, (order[x] for x in brute_components([kept[i]["text"] for i in order]))))
    assert set(second) == set(low.values()) and all(second[i] == kept[i] for i in second)
    ranks, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(second)
    clean = 0
    for i, r in got.items():
        if not base_spans(second[i]["text"]):
            ids = own.encode_ordinary(second[i]["text"])
            clean += (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(second[i]["text"]))
        else:
            assert r["decoded_sha256"] != sha(second[i]["text"])
    assert clean >= 0.95 * sum(not base_spans(x["text"]) for x in second.values())


def test_near_duplicates_begin_with_fingerprints(spark, monkeypatch):
    """The stage with no cells of shingles: fingerprints within 3 bits are linked still, each link decided by the sets."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(4):
            at = rnd.randrange(5, 395)
            texts.append(" ".join([*base[:at], word(), *base[at + 1 :]]))
    line = " ".join(word() for _ in range(13))
    texts += [" ".join([line] * 30 + [word() for _ in range(40)]) for _ in range(5)]  # fingerprints of the line, sets apart
    fps = np.array([brute_fingerprint(x) for x in texts], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert near[-5:, -5:].all()
    alike = brute_components(texts)  # here all pairs of a component are similar
    i, j = np.nonzero(near & np.equal.outer(alike, alike))
    want = set(roots(len(texts), i, j).tolist())
    assert len(set(alike)) == 17 < len(want) < 45
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()} == set(alike)
    monkeypatch.setattr(simhash, "prefix", lambda found, common, similarity: found[:0])
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()} == want


def test_links_of_a_forest_are_within_the_radius():
    chain = np.array([(1 << 3 * k) - 1 for k in range(20)] + [1 << 63 | 0x5555 << 40], np.uint64)
    for a, b in ((chain, None), (chain[::2], chain[1::2])):
        i, j = simhash.forest(a, b, 3)
        both = a if b is None else np.concatenate((a, b))
        assert len(i) == 19 and (np.bitwise_count(both[i] ^ both[j]) <= 3).all() and len(set(roots(len(both), i, j).tolist())) == 2


def test_encoded_rows_have_their_places(spark, tmp_path):
    rows = [(i if i % 5 else None, f"text number {i}", "en", f"s{min(i % 7, 2)}", 10) for i in range(1500)]
    rows += [(9, "other text of one id", "en", "s0", 5)] * 2 + [(None, None, "de", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several files
    try:
        stages["mixing"](spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again = spark.read.parquet(f"{tmp_path}/mixed")
    got = sorted(stages["encode"](spark, again, "").collect(), key=lambda r: (r["slot"], r["mix_pos"]))
    assert len(got) == len(rows) == len({(r["slot"], r["mix_pos"]) for r in got})
    files = sorted(tmp_path.glob("mixed/*.parquet"))
    written = [(r["doc_id"], sha(r["text"] or "")) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and [(r["doc_id"], r["decoded_sha256"]) for r in got] == written
    # brute force: EDF slot by slot, begun anew when a source has run out
    n = Counter(r[3] for r in rows)
    rank = sorted(n, key=lambda s: (-n[s], s is not None, s or ""))
    parts, left, order = mixing.to_parts({i: n[s] ** 0.5 for i, s in enumerate(rank)}), {i: -(-n[s] // 100) for i, s in enumerate(rank)}, []
    while left:
        for i in simulate({i: parts[i] for i in left}, 1000):
            order.append(rank[i])
            left[i] -= 1
            if not left[i]:
                del left[i]
                break
    assert [{r["source"] for r in got if r["slot"] == t} for t in range(len(order))] == [{s} for s in order] and got[-1]["slot"] == len(order) - 1


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, ids that are shared or missing, then no rows at all."""
    import tiktoken

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    good = [r for r in docs if len(r["text"] or "") > 400 and not base_spans(r["text"])][:60]
    rows = [tuple(r) for r in good]
    rows += [rows[0], rows[1], (None, good[2]["text"], None, None, None), (None, None, None, None, None), (500, "", "en", "s", 0), (501, None, "en", "s", 0), (502, "12 34 --", "en", "s", 8)]
    rows += [(503, good[3]["text"] * 40, "en", None, 1), (504, good[4]["text"][:300] + " token=abcd1234efgh " + good[5]["text"][:300], None, "s", 1), (505, good[6]["text"], "xx", "s", 1), (505, good[7]["text"], good[7]["lang"], "s", 1)]
    (tmp_path / "a").mkdir()
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert len({(r["slot"], r["mix_pos"]) for r in got}) == len(got)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, spark.read.parquet(f"{tmp_path}/a/documents.parquet"), "").collect()
    texts = Counter(r["text"] for r in first)
    assert not texts.keys() & {None, "", "12 34 --"} and texts[good[0]["text"]] == 2 and texts[good[2]["text"]] == 2
    assert {r["lang"] for r in first if r["text"] == good[2]["text"]} == {good[2]["lang"]} and {r["lang"] for r in first if r["doc_id"] == 505} >= {good[6]["lang"]}
    # one of each component of exact similarity goes on
    order = sorted(first, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    stays = {order[i]["text"] for i in set(brute_components([r["text"] for r in order]))}
    ranks, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    shown = Counter(sha(" ".join(map(str, own.encode_ordinary(t.replace("token=abcd1234efgh", "<secret>"))))) for t in stays)
    assert Counter(r["ids_sha256"] for r in got) == shown
    (tmp_path / "b").mkdir()
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
