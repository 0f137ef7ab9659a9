"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postsift.llm import (language_model, packing, pieces, prefix_counts, quality_rules, sharding, simhash, topk, toxicity,
                          url_filter)
from postsift.llm.catalog import PIECE_BPE, WORD_BPE, vocabulary
from tests.llm.test_queries import brute_lm

LABELS = "doc_id long, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, None, 1), (4, 1, None), (6, 1, 1), (6, 1, 0)], LABELS)
    words, parts = vocabulary(WORD_BPE), vocabulary(PIECE_BPE)
    return {
        "quality": quality_rules.judge, "pieces": lambda d: pieces.encode_digest(d, parts), "toxicity": lambda d: toxicity.score_texts(d, labels),
        "tokens": lambda d: prefix_counts.count_tokens(d, words), "lm": language_model.score_texts, "simhash": simhash.near_groups,
        "shards": sharding.shard}


@pytest.mark.parametrize("name", ["quality", "pieces", "toxicity", "tokens", "lm", "simhash", "shards"])
def test_a_row_for_every_row(spark, odd, name):
    run = operators(spark)[name]
    rows = run(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    assert run(odd.limit(0)).collect() == []


def test_quality_counts(spark):
    text = "a b c a b c\na b c a b c\n\n## $5 <x>"
    r = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (15, 19, 5, 1, 12)
    assert r.base_failed and not r.kept


def test_stages_keep_columns(spark, odd):
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert simhash.drop_near_copies(odd).columns == odd.columns
    kept = simhash.drop_near_copies(odd).collect()
    assert sum(r.text == "The same text here." for r in kept) == 1
    assert any(r.doc_id is None for r in kept)
    labels = spark.createDataFrame([], LABELS)
    clean = toxicity.drop_toxic(odd.unionByName(spark.createDataFrame([(99, "You idiot.", None, 0.0, True)], odd.schema)), labels)
    assert clean.columns == odd.columns and clean.count() == odd.count()


def test_urls(spark):
    urls = [None, "no address", "http://A.Example.ORG/es/x?q", "https://www.example.org/en/12", "http://x.com/fr/casino", "http://x.com/de/1",
            "http://casino.net", "http://casinos.net", "http://free-bet.net/", "http://bet.bet.net/", "x://org", "http://neworg/"]
    rows = url_filter.judge_urls(spark.createDataFrame([(k, u, k) for k, u in enumerate(urls)], "page_id long, url string, host int")).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert [got[k][3] for k in (6, 7, 8, 9)] == ["block", "allow", "block", "allow"]
    assert got[10] == ("org", "", None, "allow") and got[11][2] is None


def test_grammar_weighs_clauses():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {"dolt": 4.0})
    assert lexicon.evidence("what an idiot") == 5.0
    assert lexicon.evidence("you idiot") == 5.0 * toxicity.AIMED
    assert lexicon.evidence("not an idiot") == 5.0 * toxicity.NEGATED
    assert lexicon.evidence("he said what an utter idiot") == 5.0 * toxicity.REPORTED
    assert lexicon.evidence("he said so. idiot") == 5.0
    assert lexicon.evidence("doltish. a redolt") == 4.0
    assert lexicon.evidence("i will kill you") == toxicity.THREAT_WEIGHT
    assert lexicon.evidence("i will not kill you") == 0.0 and lexicon.evidence("kill the lights in there soon you") == 0.0
    assert lexicon.score("") == lexicon.score(None) < 0.5 < lexicon.score("you idiot")


def test_prefix_counts_equal_encoding_every_prefix(spark):
    table = prefix_counts.prefix_table(vocabulary(WORD_BPE))
    for text in ("aaaaaaaaaa bananas", "It's 42 <|endoftext|> don't", "Überraschung naïve 日本", "!!!!???? http://x.y"):
        words, counts = table.prefixes(text)
        if "<|" in text:
            assert counts[-1] == len(table.bpe.library.encode(text, add_special_tokens=False).ids)
            continue
        at = 0
        for w in words:
            before = counts[at - 1] if at else 0
            for k in range(1, len(w) + 1):
                assert counts[at + k - 1] - before == len(table.bpe.library.encode(w[:k], add_special_tokens=False).ids)
            at += len(w)
    stored = prefix_counts.prefix_counts(spark.createDataFrame([(1, "hello wonderful world"), (2, None)], "doc_id long, text string"), vocabulary(WORD_BPE))
    fit = {r.doc_id: r.n for r in stored.select("doc_id", prefix_counts.longest_within(F.col("counts"), 2).alias("n")).collect()}
    assert fit == {1: len("hellowonderful"), 2: 0}


def test_pieces_equal_the_library_on_odd_texts():
    import sentencepiece

    p, lib = pieces.pieces(vocabulary(PIECE_BPE)), sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    rng = np.random.default_rng(0)
    texts = ["", " ", "  a  b ", "\n\t x", "日本🎉 \x00 ﬁ", "a" * 500, "ab" * 300 + " " + "xyz,.;!" * 90, "<s> <unk>", " " * 40 + "x" + " " * 50,
             *("".join(rng.choice(list("abcde ▁é日🎉\n"), 400)) for _ in range(5))]
    ids = p.encode_batch(texts)
    assert [i.tolist() for i in ids] == lib.encode(texts)
    assert [p.decode(i) for i in ids] == lib.decode([i.tolist() for i in ids])


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack(odd.repartition(3), vocabulary(WORD_BPE), length=64).collect()
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert packing.pack(odd.limit(0), vocabulary(WORD_BPE)).collect() == []


def test_packing_keeps_large_and_null_keys(spark):
    """Keys beyond 2^53 beside a null one among the leftovers of several partitions."""
    keys = [2**60 + 1, 2**60 + 2, None, 2**60 + 3, None]
    docs = spark.createDataFrame([(k, f"some words {n}") for n, k in enumerate(keys)], "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, vocabulary(WORD_BPE)).collect()
    assert sorted((r.doc_id or 0 for r in rows if r.start == 0)) == sorted(k or 0 for k in keys)


def test_writers_refuse_keys_that_lose_rows(spark, folder):
    for keys in ([1, 1], [1, None]):
        docs = spark.createDataFrame([(k, f"text {n}") for n, k in enumerate(keys)], "doc_id long, text string")
        with pytest.raises(ValueError):
            sharding.write_shards(docs, f"{folder}/shards")
        with pytest.raises(ValueError):
            packing.with_ids(packing.pack(docs, vocabulary(WORD_BPE)), docs, vocabulary(WORD_BPE))


def test_one_of_near_copies_stays_whatever_the_keys(spark):
    """Different texts under one key stay, copies without keys are one, a key goes before none."""
    rows = [(1, "first text of its own here", "x"), (1, "quite another text under that key", "x"), (None, "no key at all here", "a"),
            (None, "no key at all here", "b"), (None, "shared by a key and none", "a"), (7, "shared by a key and none", "b"),
            (9, "the very same row", "z"), (9, "the very same row", "z"), (8, "First Text of its own here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4)
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_copies(docs).collect())
    assert kept == sorted([(1, rows[0][1]), (1, rows[1][1]), (0, rows[2][1]), (7, rows[5][1]), (9, rows[6][1])])


def test_pieces_of_long_parts_and_of_slices(spark, monkeypatch):
    import sentencepiece

    path = vocabulary(PIECE_BPE)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdehionrst"), 60_000)), "ab" * 20_000, None, "", *(" ".join(rng.choice(list("abcd"), 50)) for _ in range(40))]
    monkeypatch.setattr(pieces, "SLICE_CHARS", 500)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 40)
    monkeypatch.setattr(pieces, "REMEMBERED", 2000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    assert {r.doc_id: r.ids for r in pieces.encode(docs, path).collect()} == {k: lib.encode(t or "") for k, t in enumerate(texts)}


def test_topk_without_rows(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_hot_group_of_copies_is_cut(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "same " * 20).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" x" * 40))).alias("text"))
    sizes = [r.n for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.05 * max(sizes)


def test_pipeline_of_an_empty_table(spark, folder):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def _letters(k):
    return "".join(chr(97 + k // 26**d % 26) for d in range(5))


def test_chunks_ask_once_for_a_word_pair(spark):
    """A passage of rare words in a third of the texts, and a pair of rare words repeated in one, are one entry a chunk."""
    passage = " ".join(_letters(10**6 + j) for j in range(300))
    filler = lambda k: " ".join(_letters(k * 300 + j) for j in range(300))
    texts = [(k, passage if k % 3 == 0 else "foo bar " * 200 if k == 1 else filler(k)) for k in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    chunks = language_model.cut_lineage(language_model._chunks(docs, "doc_id", "text"))
    assert chunks.count() == 2
    asked, held = {}, {}
    for r in language_model._asked(chunks, 8).collect():
        keys = np.cumsum(language_model._unpacked(r.keys, np.uint64), dtype=np.uint64)
        assert len(set(keys.tolist())) == len(keys) > 0
        asked[r.chunk] = asked.get(r.chunk, 0) + int(language_model._unpacked(r.n, np.int64).sum())
        held[r.bucket] = held.get(r.bucket, 0) + len(keys)
    assert sum(asked.values()) == sum(2 * len(t.split()) - 1 for _, t in texts)
    assert len(held) == 8 and max(held.values()) < 1.2 * min(held.values())


def test_language_model_counts_every_word(spark):
    """Over 2^17 distinct words: junk of words seen once, and a passage of such words in a third of the texts."""
    junk = {k: " ".join(_letters(k * 1000 + j) for j in range(1000)) for k in range(160)}
    passage = " ".join(_letters(10**6 + j) for j in range(300))
    texts = junk | {200 + k: passage if k % 3 == 0 else f"the cat sat on the {_letters(2 * 10**6 + k)}" for k in range(90)}
    want = brute_lm(texts)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = language_model.score_texts(table).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_seen) == want[r.doc_id][:2]
        assert r.log_score == pytest.approx(want[r.doc_id][2], abs=1e-6)
