"""Queries against SQL and brute force on the smallest tables."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from checks import compare
from postsift.llm import catalog, language_model, packing, quality_rules, sharding, simhash, topk, toxicity
from postsift.llm.catalog import PIECE_BPE, QUERIES, WORD_BPE, vocabulary

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = compare.database(FOLDER)
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert compare.canonical([tuple(r) for r in df.collect()], df.columns) == compare.canonical(cursor.fetchall(), names)


def test_ids_of_pieces_equal_the_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    for r in QUERIES["op3_sentencepiece"](spark, FOLDER).collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.round_trip


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(a and b for a, b in held) >= 0.8 * sum(b for _, b in held)


def _words_encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORD_BPE))


def test_token_counts_equal_the_library(spark, texts):
    lib = _words_encoder()
    for r in QUERIES["op5_token_counts"](spark, FOLDER).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def brute_fingerprint(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words, word = [], b""
    for b in raw + b" ":
        if b == 32 or 9 <= b <= 13:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    shingles = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}


def test_simhash_equals_brute_force(spark, texts):
    rows = QUERIES["op8_simhash"](spark, FOLDER).collect()
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    roots = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{p:016x}", roots[k]) for k, p in prints.items()}
    assert len(set(roots.values())) < len(roots)


def test_links_of_close_fingerprints(spark, monkeypatch):
    """Random centres with neighbours 1 to 5 bits away, crowded anchors included."""
    rng = random.Random(4)
    prints = {}
    for centre in (rng.getrandbits(64) for _ in range(12)):
        for _ in range(25):
            p = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << bit
            prints.setdefault(p, len(prints))
    prints = {k: p for p, k in prints.items()}
    signed = {k: p - (1 << 64) if p >> 63 else p for k, p in prints.items()}
    table = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    want = brute_components(prints)
    for block in (1024, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = {r.node: r.root for r in simhash.components(simhash.links(table)).collect()}
        groups, expected = defaultdict(set), defaultdict(set)
        for k, p in signed.items():
            groups[found.get(p, p)].add(k)
            expected[want[k]].add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_shards_are_even_and_whole(spark, texts):
    rows = QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").collect()
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
    assert len(rows) == 1000 and sorted(sizes) == list(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(h) > 1 for h in homes.values()) <= 14  # a cut goes through one group at most


@pytest.mark.parametrize("length", [4096, 256])
def test_packing_is_an_exact_round_trip(spark, texts, length):
    lib = _words_encoder()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    rows = packing.pack(docs, vocabulary(WORD_BPE), length=length).collect()
    ids = {k: np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4") for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, own in by_doc.items():
        assert [s for s, _ in sorted(own)] + [len(ids[k])] == [0, *np.cumsum([n for _, n in sorted(own)])]
    assert set(by_doc) == set(texts)
    padded = 0
    for own in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= length
        padded += 0 if ends[-1].bit_count() == 1 else length - ends[-1]
    assert padded == 0
    assert len(by_sequence) <= sum(map(len, ids.values())) // length + 13


def brute_lm(texts):
    words = {k: [w.lower() for w in language_model.text_words(t)] for k, t in texts.items()}
    one = Counter(w for ws in words.values() for w in ws)
    two = Counter(p for ws in words.values() for p in zip(ws, ws[1:]))
    total, out = sum(one.values()), {}
    for k, ws in words.items():
        s = np.log10(one[ws[0]] / total) if ws else 0.0
        for a, b in zip(ws, ws[1:]):
            s += np.log10(two[a, b] / one[a]) if two[a, b] >= 2 else np.log10(0.4 * one[b] / total)
        out[k] = len(ws), sum(two[p] >= 2 for p in zip(ws, ws[1:])), s
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_language_model_equals_brute_force(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(language_model, "HOT", hot)
    want = brute_lm(texts)
    for r in QUERIES["op7_lm_scores"](spark, FOLDER).collect():
        assert (r.n_words, r.n_seen) == want[r.doc_id][:2]
        assert r.log_score == pytest.approx(want[r.doc_id][2], abs=1e-6)


def test_topk_prunes_without_loss(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0)))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5100, [1.0, None] + [0.0] * 6), (5200, [float("nan")] * 8), (5300, [1.0])],
                                  "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(table, block_rows=16, group_rows=200).collect()}
    v = np.floor(1024 * x).astype(int)
    want = {}
    for q in range(0, len(v), 100):
        s = v @ v[q]
        order = [k for k in np.lexsort((np.arange(len(v)), -s)) if k != q][:10]
        want |= {(q, n + 1): (int(k), int(s[k])) for n, k in enumerate(order)}
    assert got == want


def test_pipeline_equals_its_parts_by_brute_force(spark, texts):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    table = docs.filter(docs.doc_id.isin(sorted(good)))
    clean = {r.doc_id for r in toxicity.score_texts(table, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("predicted = 0").collect()}
    roots = brute_components({k: brute_fingerprint(texts[k]) for k in clean})
    assert {r.doc_id for r in rows} == {k for k, root in roots.items() if k == root}
    lib = _words_encoder()
    assert sum(r.length for r in rows) == sum(len(lib.encode(texts[k], add_special_tokens=False).ids) + 1 for k in {r.doc_id for r in rows})


def test_shard_writer_keeps_all_rows(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sharding.write_shards(docs, f"{folder}/shards")
    back = spark.read.parquet(f"{folder}/shards")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
