"""Runs, near copies by shingles and the filter audit, against brute force; odd rows included."""

import hashlib
import random
import zlib
from itertools import permutations

import pandas as pd
import pytest

from postsift.llm import filter_audit, periodic_runs, superminhash


def brute_runs(words, least=12):
    """Every stretch of equal words q apart, for every q; the smallest q of a stretch counts."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k - start >= q and k - start + q >= least:
                found.setdefault((start, k - start + q), q)
            k += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    kinds, n = rng.choice([1, 2, 3, 6]), rng.randint(0, 110)
    words = [rng.randrange(kinds) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 10)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


@pytest.mark.parametrize("least", [12, 4, 5, 20])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        assert periodic_runs.runs_of(texts, least) == [brute_runs(w, least) for w in texts]


def test_runs_of_one_word_and_of_nested_periods():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [[0] * 50_000, [0, 1] * 40 + [0] + [0, 1] * 40, fibonacci[-1], []]
    found = periodic_runs.runs_of(texts)
    assert found[0] == [(0, 50_000, 1)] and found[3] == []
    assert found[1:3] == [brute_runs(w) for w in texts[1:3]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def run_facts(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_digest_equals_brute_force(spark, odd):
    rng = random.Random(3)
    texts = [" ".join(f"w{x}" for x in random_words(rng)) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (table, odd.withColumnRenamed("lang", "runs"), odd.limit(0)):
        given = sorted((str(r.doc_id), run_facts(r.doc_id, "" if r.text and len(r.text) > 9999 else r.text)) for r in docs.collect())
        found = periodic_runs.run_digest(periodic_runs.find_runs(periodic_runs.with_planted_loops(docs)))
        rows = sorted((str(r.doc_id), tuple(r[1:])) for r in found.collect())
        long = {str(r.doc_id) for r in docs.collect() if r.text and len(r.text) > 9999}
        assert [r for r in rows if r[0] not in long] == [r for r in given if r[0] not in long]
        for key, facts in rows:
            if key in long:  # one word 30000 times
                assert facts[:5] == (1, 0, 30000, 1, 30_000_000)


def test_slices_of_texts_do_not_change_runs(spark, monkeypatch):
    docs = [(k, "a b c " * k) for k in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    monkeypatch.setattr(periodic_runs, "SLICE_CHARS", 50)
    assert {r.doc_id: len(r.runs) for r in periodic_runs.find_runs(table).collect()} == {k: int(3 * k >= 12) for k in range(40)}


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute_groups(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


def near_texts(seed, centres=6, copies=30, length=120):
    """Centres with copies of 0 to 6 changed words, some of them copied on; many links are close calls."""
    rng = random.Random(seed)
    texts = []
    for c in range(centres):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(length)] = f"v{rng.randrange(1000)}"
            if rng.random() < 0.3:
                base = words  # the group drifts: its ends are linked by a chain only
            texts.append(" ".join(words).title() if rng.random() < 0.1 else " ".join(words))
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [1024, 8])
def test_near_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK", block)
    monkeypatch.setattr(superminhash, "CHUNK", block)
    texts = near_texts(block)
    want = brute_groups(texts)
    assert 6 <= len({w[1] for w in want.values()}) < len(texts)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.near_groups(table).collect()}
    assert got == want


@pytest.mark.parametrize("width", [1, 3, 5])
def test_pairs_of_a_block_equal_full_sets(width):
    """Every pair of a block by exact shingle numbers, against Python sets; empty and short texts among them."""
    r = random.Random(width)
    texts = [" ".join(r.choice("abcde") for _ in range(r.choice([0, 1, 2, 3, 4, 30, 300]))) for _ in range(40)]
    texts += [t.upper().replace(" ", "\n", 1) + " a" for t in texts]
    others = [[m for m in range(n + 1, len(texts))] for n in range(len(texts))]
    group = pd.DataFrame({"node": range(100, 100 + len(texts)), "body": texts, "others": [[m + 100 for m in o] for o in others]})
    got = superminhash._confirmed_in_block(width, 60)(group)
    sets = [superminhash._shingle_set(t, width) if len(t.split()) >= width else set() for t in texts]
    want = [(n + 100, m + 100) for n in range(len(texts)) for m in others[n]
            if sets[n] & sets[m] and 100 * len(sets[n] & sets[m]) >= 60 * len(sets[n] | sets[m])]
    assert [tuple(x) for x in got.to_numpy().tolist()] == want and want


def test_texts_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "FEW", 0)
    texts = near_texts(5, centres=2, copies=12)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in superminhash.near_groups(table).collect()} == {k: w[1] for k, w in brute_groups(texts).items()}


def test_crowd_that_shares_a_band_but_no_group(spark):
    """Half of each text is a common passage: all meet, none is similar enough."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(100))
    texts = {k: passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(35)) for k in range(60)}
    texts |= {100 + k: texts[k] + " end" for k in range(0, 60, 5)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.near_groups(table).collect()} == brute_groups(texts)


def test_near_groups_of_odd_rows(spark, odd):
    rows = superminhash.near_groups(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by[0] == {(0, 0, True)} and by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)}  # no words: no links
    assert by[7] == {(2, 7, True)} and by[8] == {(2, 7, False)}
    assert by[None] == {(1, None, True)}
    assert superminhash.near_groups(odd.limit(0)).collect() == []


def test_signature_is_that_of_all_ranks():
    """Stopping early changes nothing: the same places from permutations given out in full."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40, 300):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        full = np.full(16, np.iinfo(np.uint64).max, np.uint64)
        for h in hashes:
            place, state = list(range(16)), np.array([h], np.uint64)
            for rank in range(16):
                state = state + superminhash.GOLDEN
                other = rank + int(superminhash._mixed(state ^ superminhash.GOLDEN)[0] >> np.uint64(32)) % (16 - rank)
                place[rank], place[other] = place[other], place[rank]
                full[place[rank]] = min(full[place[rank]], np.uint64(rank << 56) | superminhash._mixed(state)[0] >> np.uint64(8))
        assert (superminhash.signature(hashes, 16) == full).all()


def brute_audit(rows, labels):
    fails = []
    for doc_id, text, lang in rows:
        t = text or ""
        words = t.encode().split()
        earlier = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows)
        fails.append((lang or "", {f for f, bad in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t), earlier]) if bad}, (doc_id, 1, 0) in labels, (doc_id, 0, 1) in labels))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                gone = lambda f: any(x in f for x in order[:k])
                hit = [f for f in own if letter in f[1] and not gone(f[1])]
                removed_by[letter] += len(hit)
                out[part, order, k + 1] = [
                    sum(not f[1] & set(order[:k + 1]) for f in own), len(hit), sum(letter in f[1] and gone(f[1]) for f in own),
                    sum(f[1] == {letter} for f in own), sum(f[2] for f in hit), sum(f[3] for f in hit)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_audit_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(filter_audit, "FEW", few)
    rng = random.Random(few)
    bodies = [None, "", "A b", "x # y", "SHOUT", " ".join(f"w{k}" for k in range(120)), "same " * 120, " ".join(f"W{k}" for k in range(100)),
              " ".join(f"w{k}%" for k in range(101)), "  wide\x0bblank " * 60]
    rows = [(rng.choice([None, *range(40)]), rng.choice(bodies), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    rows += [(200 + k, "hot text", "fr") for k in range(60)] + [(200, "hot text", "fr")]
    flags = {(k, *rng.choice([(1, 0), (0, 1)])) for k in list(range(0, 40, 3)) + list(range(200, 260, 7))}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, mask int").repartition(3)
    labels = spark.createDataFrame([*flags, (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}
    assert len(found) == len(got) == 600 * len({r[2] or "" for r in rows})
    assert got == brute_audit(rows, flags)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert filter_audit.audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
