"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon (insult stems learned from labels, seed words, threats, targets, negations, reporting
words) turns the words of a clause into symbols. Small weighted transducers rewrite and weigh
them: negation weakens an insult that follows soon, reported speech weakens those after it, an
insult counts more beside a target, and a threat counts when its target follows. Their composition
is one machine, built once, and a clause's score is the weight of its one path. A text's score is
logistic in the weight of its clauses, in all and for its length, fitted on the labelled sample.

Words are runs of letters in lower case, so the machine reads no punctuation, source or language.
"""

import math
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)")
# Seed lexicon of the grammar.
SEEDS = "idiot moron loser scum stupid pathetic worthless disgusting trash clown imbecile dumbass bastard vermin".split()
THREATS = "kill hurt destroy beat stab shoot strangle murder".split()
TARGETS = "you your yourself u he she they him her them".split()
NEGATIONS = "not never no isn aren wasn nobody".split()
REPORTS = "said says called calls quoted quote wrote claimed reported alleged".split()
SEED_WEIGHT, THREAT_WEIGHT = 5.0, 4.0
NEAR = 3  # words that a negation, a target or a threat reaches
NEGATED, REPORTED, AIMED = 0.6, 0.6, 1.25

SAMPLE_ROWS = 20_000  # labelled rows that the lexicon is learned from
STEMS = range(3, 9)  # letters of the stems tried, besides whole words
MOST_TERMS = 3000  # of the lexicon
LEAST_PURE, LEAST_SHARE, LEAST_FOUND = 0.75, 0.02, 4
NEARLY_ALL = 0.9  # of a stem's finds: a longer stem that has them is taken instead
RIDGE = 0.02
UNFITTED = [-3.0, 0.0, 2.0, 0.0]  # without labels: constant, some weight, log of weight, log of weight by length
HELD_OUT_OF = 5


# Symbols: o other, I insult, H threat, T target, N negation, R report; n, r, a: insult negated,
# reported, aimed; h: threat that met its target.

class Transducer:
    """Deterministic: (state, symbol) to (state, symbol out, factor). Missing arcs copy the symbol."""

    def __init__(self, start, arcs):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def then(self, other, alphabet):
        """The composition: what this writes, the other reads; factors multiply."""
        arcs, todo, seen = {}, [(self.start, other.start)], {(self.start, other.start)}
        while todo:
            state = todo.pop()
            for s in alphabet:
                a, middle, x = self.step(state[0], s)
                b, out, y = other.step(state[1], middle)
                arcs[(state, s)] = (a, b), out, x * y
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer((self.start, other.start), arcs)


ALPHABET = "oIHTNR"


def _countdown(opens, changes, others):
    """Arcs of a transducer whose state is the number of words still in reach of ``opens``."""
    arcs = {}
    for left, s in product(range(NEAR + 1), ALPHABET + "nrah"):
        after = NEAR if s == opens else max(left - 1, 0)
        out, factor = changes.get(s, (s, 1.0)) if left else (s, others.get(s, 1.0))
        arcs[(left, s)] = after, out, factor
    return Transducer(0, arcs)


def grammar():
    negation = _countdown("N", {"I": ("n", NEGATED), "H": ("o", 0.0)}, {})
    report = Transducer("told", {("told", "R"): ("says", "R", 1.0), ("says", "I"): ("says", "r", REPORTED),
                                 ("says", "n"): ("says", "r", REPORTED), ("says", "H"): ("says", "o", 0.0)})
    insult = _countdown("T", {"I": ("a", AIMED)}, {})
    threat = Transducer(0, {(0, "H"): (NEAR, "o", 0.0)} | {
        (left, s): (NEAR, "o", 0.0) if s == "H" else (0, "h", 1.0) if s == "T" else (left - 1, s, 1.0)
        for left in range(1, NEAR + 1) for s in ALPHABET + "nra"})
    machine = negation
    for part in (report, insult, threat):
        machine = machine.then(part, ALPHABET)
    return machine


MACHINE = grammar()
SYMBOL = {w: s for s, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in words}


class Lexicon:
    """Whole words and stems (prefixes) with weights, and the coefficients of the score."""

    def __init__(self, words: dict, stems: dict, fitted=UNFITTED):
        self.words, self.stems, self.fitted = words, stems, np.array(fitted)
        lengths = sorted({len(s) for s in stems}, reverse=True)
        self.lengths = lengths
        parts = sorted(map(re.escape, stems), key=len, reverse=True)
        whole = sorted(map(re.escape, [*words, *THREATS]))
        options = [*(p + r"[^\W\d_]*" for p in parts), "(?:" + "|".join(whole) + r")(?![^\W\d_])"]
        self.any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(options) + ")")

    def weight(self, word):
        w = self.words.get(word)
        if w is None:
            w = next((self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems), None)
        return w

    def clause(self, words):
        """Weight of a clause's path through the machine."""
        state, total = MACHINE.start, 0.0
        for w in words:
            weight = self.weight(w)
            symbol = "I" if weight is not None else SYMBOL.get(w, "o")
            state, out, factor = MACHINE.step(state, symbol)
            if out in "Inra":
                total += weight * factor
            elif out == "h":
                total += THREAT_WEIGHT * factor
        return total

    def evidence(self, text):
        """Weight of all clauses. Only clauses with a lexicon word are parsed; others weigh nothing."""
        low = (text or "").lower()
        total, done = 0.0, 0
        for hit in self.any.finditer(low):
            if hit.start() < done:
                continue
            left = done
            for end in CLAUSE.finditer(low, done, hit.start()):
                left = end.end()
            right = CLAUSE.search(low, hit.end())
            done = right.end() if right else len(low)
            total += self.clause(WORD.findall(low[left:done]))
        return total

    def score(self, text):
        """0 to 1."""
        return float(_logistic(_features(np.array([self.evidence(text)]), np.array([len(text or "")])) @ self.fitted)[0])


def _features(weight, chars):
    some = (weight > 0).astype(float)
    return np.stack([np.ones(len(weight)), some, some * np.log1p(weight), some * np.log((weight + 0.1) / (chars + 100.0))], axis=1)


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def fit_score(weight, chars, y):
    """Coefficients of ``_features`` by Newton's method, with a small ridge."""
    x, w = _features(weight, chars), np.zeros(4)
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(4), x.T @ (y - p) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, key, text, label) -> DataFrame:
    """A bounded sample of labelled rows that aren't held out: text and y; equal texts count once.

    Contradicting labels of one key or text: the larger one counts.
    """
    marks = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y is not null")
    marks = marks.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y"))
    total = marks.count()
    space = 1 << 30
    marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(space)) < int(min(1.0, SAMPLE_ROWS / max(total, 1)) * space) + 1)
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
    return own.join(F.broadcast(marks), "_id").groupBy("_text").agg(F.max("y").alias("y"))  # marks: SAMPLE_ROWS, a little more at most


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % HELD_OUT_OF == 0


def _terms(words):
    """Words, and their stems marked by a star."""
    stems = [F.when(F.length(words) > k, F.concat(F.substring(words, 1, k), F.lit("*"))) for k in STEMS]
    return F.explode(F.array_compact(F.array(words, *stems)))


def learn(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic") -> Lexicon:
    """Stems and words that mark toxic texts, from texts of the sample.

    A term needs most of its texts toxic, and enough different neighbour words around it: what
    stands in copies of one toxic text always has the same neighbours, and is no insult.
    """
    from postsift.operators.lineage import cut_lineage

    rows = cut_lineage(training_rows(docs, labels, key, text, label))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).first()
    n, t = size.n, size.t or 0
    words = {w: SEED_WEIGHT for w in SEEDS}
    if not t:
        return Lexicon(words, {})
    base = math.log((t + 0.5) / (n - t + 0.5))
    least = max(LEAST_FOUND, math.ceil(LEAST_SHARE * t))
    distinct = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)")))).alias("w"))
    counts = distinct.select("y", _terms(F.col("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t"))
    marked = counts.filter((F.col("t") >= least) & (F.col("t") >= LEAST_PURE * F.col("n")))
    found = {r.term: (r.n, r.t) for r in marked.orderBy(F.desc("t"), "term").limit(MOST_TERMS).collect()}
    around = _neighbours(rows, found)
    rated = {}
    for term, (of, toxic) in found.items():
        seen = min(toxic, around.get(term, 0))
        if seen >= least and seen / (of - toxic + seen) >= LEAST_PURE:
            rated[term] = seen, math.log((seen + 0.5) / (of - toxic + 0.5)) - base
    stems = {}
    for term, (seen, weight) in sorted(rated.items(), key=lambda r: (len(r[0].rstrip("*")), r[0])):
        bare = term.rstrip("*")
        longer = any(x != term and x.startswith(bare) and len(x) > len(term) - 1 and rated[x][0] >= NEARLY_ALL * seen for x in rated)
        if longer and term.endswith("*") or any(bare[:k] in stems for k in STEMS if k <= len(bare)):
            continue  # a longer term says as much, or a shorter one says it already
        (stems if term.endswith("*") else words)[bare] = weight
    lexicon = Lexicon(words, stems)
    weigh = spark_evidence(rows.sparkSession, lexicon)
    sample = rows.select(weigh("_text").alias("weight"), F.length("_text").alias("chars"), "y").toPandas()  # SAMPLE_ROWS
    lexicon.fitted = fit_score(sample.weight.to_numpy(), sample.chars.to_numpy(), sample.y.to_numpy(float))
    return lexicon


def spark_evidence(spark, lexicon: Lexicon):
    sent = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.evidence(t) for t in texts], dtype=np.float64)

    return weigh


def _neighbours(rows, found):
    """How many different pairs of neighbours each term has in toxic texts."""
    terms = frozenset(found)

    def run(batches):
        for df in batches:
            out = set()
            for body in df["_text"]:
                w = ["", *WORD.findall(body.lower()), ""]
                for k in range(1, len(w) - 1):
                    for term in {w[k], *(w[k][:j] + "*" for j in STEMS if len(w[k]) > j)} & terms:
                        out.add((term, w[k - 1] + " " + w[k + 1]))
            yield pd.DataFrame(sorted(out), columns=["term", "around"], dtype=str)

    pairs = rows.filter("y = 1").select("_text").mapInPandas(run, "term string, around string").distinct()
    return {r.term: r.n for r in pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}


def score_column(spark, lexicon: Lexicon):
    """A function of a text column: its score."""
    sent = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype=np.float64)

    return score


def score_texts(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts have the score of texts without evidence. A null key is not held out. Without labels
    the seed words alone decide.
    """
    score = score_column(docs.sparkSession, learn(docs, labels, key, text, label))
    rows = docs.select(F.col(key).alias("doc_id"), score(F.col(text)).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their own columns."""
    score = score_column(docs.sparkSession, learn(docs, labels, key, text, label))
    carried = docs.select(F.struct(*docs.columns).alias("_row"), score(F.col(text)).alias("_score"))
    return carried.filter(F.col("_score") < 0.5).select("_row.*")
