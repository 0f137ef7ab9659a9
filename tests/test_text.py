import math
import random
import re
import statistics
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsift import vocab
from postsift.functions import board_a, board_b, email, keys, notes, stylometry, text, verdict

GOLDEN = [
    "", "   ", "...!!!", "word", "\n\n", None,
    "URGENT HIRING!!! Typists wanted. Earn KES 80,000 per month, no experience needed. Limited slots, act now! "
    "Pay a registration fee of KES 1,500 then email jobs.desk.ke@gmail.com",
    "Our finance team is looking for an accountant. You will prepare accounts. Apply via careers@firm.co.ke by Friday.",
    "urgently guaranteed insurgent work from home", "a@gmail.com", "a@gmail.com.", "no mail here",
    "Duties:Filing • Reports • CallsApply here\nInstituteOur passion", "x\xa0y z w\x1fv u",
    "Ｆｕｌｌ　ｗｉｄｔｈ ①②  ﬁne été", "Visit оur раge СEО", "\U0001f600 smile 日本語のテキスト。", "İstanbul ıd card İD NUMBER send MONEY",
    "<p>one<b>two</b></p><script>var a='<b>';</script><style>p{}</style><noscript>no</noscript>&amp;lt; &eacute;&#233;&#xe9;&bogus; <!-- c --> tail",
    "a < b and c > d", "<div unclosed", "<script>never closed", "R&D &amp AT&T; &#0; &#55296; &nbsp;x",
    "Contact #EMAIL_9f3a1c# or #URL_00ff# #PHONE_1# #EMAIL_XYZ#",
    "Send money via M-Pesa, mpesa or Paybill 123. Till number 5, bank details, ID card, id no, National ID, passport; KRA PIN. Date of birth",
    "national id card bank account number pay sh pay a $5 pay ksh", "Salary Ksh 45k or $900, 30,000 /= or 50k kes; €5 £6.50 ksh.7 usd 8 usd9",
    "You, your; YOURS yourself yours-truly youth", "WhatsApp whats app Telegram telegrams whatsapps", "x.com_a@b.org a@b.com_c@d.org e@f",
    "the me see apple table syllable queue rhythm e le re-elect co-operate don't 3.14 a,b,c 1,000,000", "1." * 2000, "a" * 3000 + "@",
    "A.B.C. Go. Now! Really?! Yes... \"Quoted.\" (end.)", "\r\n line one\r\n\r\n line two \t tab ", "HELLO WORLD ABC Abc ÉTÉ ß straße ÀÉ",
]


def noise(n, seed=7):
    r = random.Random(seed)
    bits = ["urgent", "Fee", "registration fee", "KES 5,000", "you", "@", "gmail.com", ".", "!", "?", "\n", " ", " ", "•", "é", "О", "а",
            "<b>", "</b>", "&amp;", "#URL_ab#", "\xa0", "ID no", "Word", "wordGlued", "le", "tree", "-", "'", ",", "3", "A", " ", "ﬁ", "é", "İ", "%", "_"]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(n)]


def column(spark, values, build, name="t"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
    return [r[1] for r in sorted(df.select("i", build(F.col(name))).collect())]


@pytest.fixture(scope="module")
def samples():
    return [s for s in GOLDEN if s is not None] + noise(600)


# Worked out by hand: text, then features.
BY_HAND = [
    # 7 words, 6 of them distinct; sentences of 3 and 4; 30 characters, 2 of them marks; a syllable each
    ("The cat sat. The dog ran home!", {
        "ttr": 6 / 7, "avg_sentence_length": 3.5, "sentence_length_variance": 0.25, "punctuation_density": 2 / 30,
        "exclamation_density": 1 / 7, "readability_score": 118.6825, "gunning_fog_index": 1.4, "log_word_count": math.log(8),
        "caps_word_ratio": 0.0, "urgency_term_count": 0, "money_mention_density": 0.0, "second_person_density": 0.0,
        "messaging_app_mention": 0, "free_email_flag": False, "contact_email_domain": None}),
    # ap-ple, queue, rhythm, tree, make, in-for-ma-tion: 10 syllables in 6 words, one word of three or more
    ("apple queue rhythm tree make information", {"readability_score": 59.745, "gunning_fog_index": 0.4 * (6 + 100 / 6), "ttr": 1.0}),
    ("word", {"ttr": 1.0, "readability_score": 121.22, "gunning_fog_index": 0.4, "sentence_length_variance": 0.0}),
    # capitals: BIG and KES of the six words of three letters or more
    ("BIG pay for Ann KES 500 now", {"caps_word_ratio": 2 / 6, "money_mention_density": 100 / 7}),
    ("You send your CV to hr@firm.co.ke", {"second_person_density": 200 / 7, "contact_email_domain": "firm.co.ke", "free_email_flag": False}),
    ("WhatsApp me: x@gmail.com", {"messaging_app_mention": 1, "contact_email_domain": "gmail.com", "free_email_flag": True}),
    ("telegrams", {"messaging_app_mention": 0}),
    ("...!!!", {"punctuation_density": 1.0, "exclamation_density": 3.0, "ttr": 0.0, "log_word_count": 0.0, "readability_score": 0.0}),
    ("   ", {"punctuation_density": 0.0, "ttr": 0.0, "avg_sentence_length": 0.0}),
]


def test_features_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BY_HAND)], "i int, text string")
    rows = {r["i"]: r for r in stylometry.extract_features(df, "text").collect()}
    for i, (t, want) in enumerate(BY_HAND):
        assert {n: rows[i][n] for n in want} == {n: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for n, v in want.items()}, t


def test_ratios_follow_from_words_sentences_and_characters(spark, samples):
    """Features over odd texts, counted again from their own tokens."""
    df = spark.createDataFrame(list(enumerate(samples)), "i int, text string")
    got = {r["i"]: r for r in stylometry.extract_features(df, "text").collect()}
    parts = text.with_clean_lines(df, "text", "t").select("i", "t", text.words(F.col("t")).alias("ws"), text.sentences(F.col("t")).alias("ss"))
    for r in parts.collect():
        f, lens, chars = got[r["i"]], [len(s.split()) for s in r["ss"]], Counter(r["t"])
        assert f["log_word_count"] == pytest.approx(math.log(len(r["ws"]) + 1))
        assert f["ttr"] == pytest.approx(len(Counter(map(str.lower, r["ws"]))) / (len(r["ws"]) or 1))
        assert f["avg_sentence_length"] == pytest.approx(statistics.fmean(lens) if lens else 0)
        assert f["sentence_length_variance"] == pytest.approx(statistics.pvariance(lens) if lens else 0, abs=1e-9)
        assert f["punctuation_density"] == pytest.approx(sum(chars[c] for c in vocab.PUNCTUATION) / (chars.total() or 1))
        assert f["exclamation_density"] == pytest.approx(chars["!"] / (len(r["ws"]) or 1))


def test_long_unbroken_tokens_take_linear_time(spark):
    """A pattern that rescans a token from each of its characters would take hours here."""
    long = [(s * 2_000_000,) for s in ("1.", "a", "a.", "A-")]
    df = spark.createDataFrame([(s + t,) for (s,) in long for t in ("", "@")], "text string")
    assert stylometry.extract_features(df, "text").filter("log_word_count > 0").count() == 8


def test_missing_text_gives_zeros(spark):
    row = stylometry.extract_features(spark.createDataFrame([(None,)], "text string")).first()
    assert row["ttr"] == row["readability_score"] == row["log_word_count"] == 0 and row["contact_email_domain"] is None


CLEANED = [
    ("<p>one<b>two</b></p><script>var a='<b>';</script><style>p{}</style>tail", "one two tail"),
    ("&amp;lt; &eacute;&#233;&#xe9; <!-- c -->", "&lt; ééé"),
    ("a < b and c > d", "a < b and c > d"),
    ("<script>never closed", ""),
    ("Contact #EMAIL_9f3a1c# or #URL_00ff#", "Contact [email] or [url]"),
    ("\r\n line one\r\n\r\n line two \t tab ", "line one\nline two tab"),
    ("Ｆｕｌｌ Visit оur", "Full Visit our"),
]


def scanned_words(s):
    """Words by a walk over the characters: letters and digits, held together by single marks."""
    found, word = [], ""
    for c, after in zip(s, s[1:] + " "):
        if c.isalnum() or (word and c in ".,'-" and after.isalnum()):
            word += c
        elif word:
            found.append(word)
            word = ""
    return found + [word] * bool(word)


def test_only_text_that_nfkc_may_change_goes_to_python(spark):
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000]
    seconds = [c for c in letters if unicodedata.combining(c) or unicodedata.decomposition(c)]
    found = column(spark, [*letters, *("a" + "".join(rng.choices(letters, k=3)) + rng.choice(seconds) for _ in range(3000))],
                   lambda c: F.struct(c.alias("t"), text.nfkc(c).alias("n"), c.rlike(text._MAY_CHANGE).alias("goes")))
    assert all(r["n"] == unicodedata.normalize("NFKC", r["t"]) for r in found)
    plain = ["caf\u00e9 \u2022 \u00a9 2024 \u2013 \u201cwork\u201d", "\u043e\u0443\u0440", "\u4e2d\u6587", "\U0001f600"]
    odd = ["a\u00a0b", "e\u0301", "\ufb01n", "\u2026", "\u1100\u1161", "\u09c7\u09be"]
    goes = column(spark, [*plain, *odd], lambda c: c.rlike(text._MAY_CHANGE))
    assert goes == [False, False, False, True] + [True] * len(odd)  # beyond U+FFFF all are looked at


def test_long_batches_of_odd_text_keep_their_rows(spark):
    texts = [None if k % 7 == 0 else f"\ufb01{k}" for k in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).select("k", text.nfkc("t").alias("n"))
    assert [r["n"] for r in df.orderBy("k").collect()] == [t and t.replace("\ufb01", "fi") for t in texts]


def test_steps_without_translate_or_match_strings_give_the_same(spark, samples):
    """Each step against the form it had, over odd text too; no count of a line makes strings of its matches."""
    odd = ["\U00010400e \U00010428le x\U00010428e", "a\x1cb\x85c\u2028d\u3000e", "x \n \n  y\n\n z \u2028\n w", "a@b.c@d.e @x.y _@q", "\u0130\u0131 tab\tI",
           "?! A. \n B.\u00a0C", "\u0430\u0435 \u0401 \u0445", "#[x](y)-\"'.;"]
    df = spark.createDataFrame([(k, t, t.lower()) for k, t in enumerate([*samples, *odd])], "k int, t string, low string")
    ws, t = vocab.WS_CHARS, F.col("t")
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}.,'-]+", " ")), F.lit(" "))
    n = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    lost = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    floored = " [^aeiouy ]++(?:(?= )|(?<!l)e(?= ))"
    complex_word = " [^aeiouy ]*+(?:[aeiouy]++[^aeiouy ]++){2}(?!(?<!l)e )[aeiouy]"
    pairs = {
        "spaces": (text.spaces(t), F.translate(t, ws, " " * len(ws))),
        "homoglyphs": (text.map_homoglyphs(t), F.translate(t, vocab.HOMOGLYPH_FROM, vocab.HOMOGLYPH_TO)),
        "fold": (stylometry.fold(t), F.lower(F.translate(t, "\u0130\u0131" + ws, "ii" + " " * len(ws)))),
        "glued": (text.segment(F.translate(t, vocab.BULLETS, "")), F.regexp_replace(F.translate(t, vocab.BULLETS, ""), r"([a-z0-9)\]:])(?=[A-Z][a-z])", "$1\n")),
        "syllables": (stylometry.syllable_total(line), n(line, "[aeiouy]++") - n(line, "[^aeiouyl ]e(?= )") + n(line, floored)),
        "complex": (stylometry.complex_total(line), n(line, complex_word)),
        "capitals": (text.count_by_loss(t, r" (?=\p{Lu}{3,}+ )"), n(t, r" \p{Lu}{3,}+(?= )")),
        "marks": (text.count_by_loss(t, "[" + "".join("\\" + c for c in vocab.PUNCTUATION) + "]++"), lost(vocab.PUNCTUATION)),
        "exclamations": (text.count_term(t, "!"), lost("!")),
        "address": (email.email_domain(t), F.lower(F.nullif(F.regexp_extract(t, "(?<![a-zA-Z0-9_.+-])" + vocab.EMAIL.replace("]+@", "]++@", 1), 1), F.lit("")))),
    }
    for name, (now, before) in pairs.items():
        assert df.filter(~now.eqNullSafe(before)).select(F.lit(name), "t", now, before).collect() == []
    plan = stylometry.extract_features(df.select("t"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"regexp_extract_all\(_(?:line|low)#.{40}|(?<!THEN )translate\(_clean.{40}", plan) == []


def test_clean_text_by_hand(spark):
    df = spark.createDataFrame(CLEANED, "t string, want string")
    assert [r["got"] for r in text.with_clean_lines(df, "t", "got").collect()] == [w for _, w in CLEANED]


def test_tokens(spark, samples):
    pieces = ["Filing • Reports • CallsApply here", "Duties:Filing"]
    assert column(spark, pieces, text.segment) == ["Filing\nReports\nCalls\nApply here", "Duties:\nFiling"]
    assert column(spark, ["A.B.C. Go. Now! Really?! Yes..."], text.sentences) == [["A.B.C.", "Go.", "Now!", "Really?!", "Yes..."]]
    assert column(spark, ["co-operate don't 3.14 a,b,c 1,000,000 end."], text.words) == [["co-operate", "don't", "3.14", "a,b,c", "1,000,000", "end"]]
    segments = column(spark, samples, text.segment)
    assert column(spark, samples, text.words) == [scanned_words(s) for s in segments]
    inner = lambda s: [c for c in s if c not in vocab.WS_CHARS]  # sentences lose blanks only
    assert [inner("".join(x)) for x in column(spark, samples, text.sentences)] == [inner(s) for s in segments]


def test_normalize_key_and_hash(spark, samples):
    import hashlib
    assert column(spark, samples, keys.normalize_key) == [" ".join(s.lower().split()) for s in samples]
    assert column(spark, samples, keys.short_hash) == [hashlib.sha1(s.encode()).hexdigest()[:12] for s in samples]


def test_urgency_is_counted_by_substring(spark):
    got = column(spark, ["urgently", "guaranteed", "insurgent", "work from home", "guaranteearn daily"], stylometry.urgency_term_count)
    assert got == [2, 2, 1, 0, 2]
    assert column(spark, ["urgently work from home"], notes.urgency_hint) == [3]


def test_email_forms_differ_on_a_trailing_dot(spark):
    texts = ["a@gmail.com.", "x@anonymous.com y@sub.anonymous.com z@Firm.co.ke..", "a@notanonymous.com", "none", "u@x.org"]
    assert column(spark, texts, email.email_domain)[0] == "gmail.com."
    assert column(spark, texts, lambda c: email.contact_domain(c, ["anonymous.com"])) == ["gmail.com", "firm.co.ke", "notanonymous.com", None, "x.org"]
    assert column(spark, ["gmail.com", "gmail.com.", "GMAIL.com", None], email.is_free_email) == [True, False, True, False]


def test_group_key_and_id(spark):
    rows = [("s", "1", "Acme  Ltd", "", "0", "t"), ("s", "", "-", "Firm.ke ", "0", "t"), ("s", "", "Confidential", "gmail.com", "1", "t"), ("s", "", "", "", "", "t")]
    df = spark.createDataFrame(rows, "source string, sid string, co string, dom string, free string, tn string")
    got = [tuple(r) for r in df.select(keys.group_key("source", "co", "dom", "free", "tn"), keys.posting_key("source", "sid", "tn")).collect()]
    assert got[0][0].startswith("s:co:") and got[0][1] == "s:1"
    assert got[1][0] == "dom:firm.ke" and got[2][0] == got[3][0] and got[3][0].startswith("s:post:") and got[3][1].startswith("s:")


def test_notes(spark):
    texts = ["1,4,5; text", "excluded", "excluded | 2,6; a; b", "8,x, 3,3", "", None]
    got = column(spark, texts, notes.parse_notes)
    assert [tuple(g) for g in got] == [(False, [1, 4, 5], "text"), (True, [], ""), (True, [2, 6], "a; b"), (False, [3], ""), (False, [], ""), (False, [], "")]
    df = spark.createDataFrame([([1, 2], "a; b", True), ([], "", True), ([3], "", False)], "i array<int>, c string, x boolean")
    assert [r[0] for r in df.select(notes.format_notes("i", "c", "x")).collect()] == ["excluded | 1,2; a, b", "excluded", "3"]


def test_display(spark):
    assert column(spark, ["x" * 60, "x" * 59], text.display_snippet) == ["x" * 60 + "…", "x" * 59]
    assert column(spark, ["", "  ", "a b\n c"], text.whitespace_word_count) == [0, 0, 3]
    df = spark.createDataFrame([(0.505,), (0.994,), (0.995,)], "p double")
    assert [r[0] for r in df.select(verdict.confidence_pct("p")).collect()] == [51, 99, 100]


def test_stub_reasons_fall_back_to_wording(spark):
    df = spark.createDataFrame([(True, 1, 0.3), (False, 0, 0.9), (False, 2, 0.39)], "f boolean, u int, t double")
    got = [[x["feature"] for x in r[0]] for r in df.select(verdict.stub_reasons("f", "u", "t")).collect()]
    assert got == [["free_email_flag", "urgency_term_count", "ttr"], ["ttr"], ["urgency_term_count", "ttr"]]


A_TEXT = ("C++ Dev (Sr.) C++ Dev (Sr.) Anonymous Employer Engineering & Technology 2 weeks ago Easy apply Nairobi Full Time "
          "IT & Telecoms KSh 30,000 - 45,000 Share link Share on WhatsApp Min Qualification: Bachelors Experience Level: Mid level "
          "Experience Length: 2 years Language Requirement: English Working Hours: Full Time - 8 to 5 Applicant Location: Nairobi "
          "Job descriptions & requirements Stipend KSh 1,000. Write to hr@firm.co.ke Important safety tips Log In and Apply bye")


def test_board_a_layouts(spark):
    variants = [A_TEXT, A_TEXT.replace("KSh 30,000 - 45,000 ", ""), A_TEXT.replace("Job descriptions & requirements", ""),
                A_TEXT.replace("Min Qualification: Bachelors ", "").replace("Full Time - 8 to 5", "Shifts - nights")]
    df = spark.createDataFrame([(v, "C++ Dev (Sr.)") for v in variants], "t string, title string")
    full, no_pay, no_start, partial = df.select(*[c.alias(k) for k, c in board_a.board_a_fields("t", "title").items()]).collect()
    assert full.asDict() == {
        "company_profile": "Anonymous Employer", "function": "Engineering & Technology", "industry": "IT & Telecoms",
        "salary_range": "KSh 30,000 - 45,000", "location": "Nairobi", "employment_type": "Full Time", "required_education": "Bachelors",
        "required_experience": "Mid level, 2 years", "description": "Stipend KSh 1,000. Write to hr@firm.co.ke"}
    assert no_pay["salary_range"] == "" and no_pay["industry"] == "IT & Telecoms"
    assert no_start["description"] == variants[2]
    assert partial["required_education"] == "" and partial["employment_type"] == "Shifts"


def test_title_may_hold_quoting_marks(spark):
    title = r"a\Eb.*"
    df = spark.createDataFrame([(f"{title} {title} Acme Sales Today", title)], "t string, title string")
    row = df.select(*[c.alias(k) for k, c in board_a.company_and_function("t", "title").items()]).first()
    assert tuple(row) == ("Acme", "Sales")


def test_board_b_layouts(spark):
    page = ('<body><section class="sc job-content"><h1>Chief <i>Clerk</i></h1><a href="/company/1"><img></a><a href="/kenya/company/2">Acme &amp; Co, </a>'
            "<p>Posted: 15 May 2025 | Apply by: 12 Jun 2025</p><div>Location</div><div>Nairobi</div>•<div>Kenya</div><div>Contract Type</div>"
            "<div>About the job</div><div>Company</div><div>Description</div><p>Line one</p><p>Line two</p><div>Tags</div><div>Accounting</div>"
            "<div>Mid-level</div><div>Kenya</div><div>Banking</div><div>Start hiring with Fuzu</div></section></body>")
    rows = [(page,), (page.replace("<div>Description</div>", ""),), (page.replace("<div>Tags</div>", ""),)]
    full, no_body, no_tags = board_b.board_b_fields(spark.createDataFrame(rows, "html string")).collect()
    assert full.asDict() == {
        "html": page, "title": "Chief Clerk", "company_profile": "Acme & Co", "location": "Nairobi, Kenya", "employment_type": "", "salary_range": "",
        "required_experience": "Mid-level", "function": "Accounting", "industry": "Banking", "description": "Line one Line two",
        "posted_date": "15 May 2025", "apply_by": "12 Jun 2025", "is_job_page": True}
    assert not no_body["is_job_page"] and no_tags["function"] == "" and no_tags["required_experience"] == ""


def test_board_b_page_with_nested_sections(spark):
    from postsift.sources.pages import board_b_postings

    page = ('<body><main><section class="job-content"><h1>Clerk</h1><section class="facts"><SECTION id=x><p>Posted: 15 May 2025</p></Section ></section>'
            "<section-tabs></section-tabs><div>Location</div><div>Nairobi</div><section><div>About the job</div><div>Description</div><p>Line one</p></section><p>Line two</p>"
            "<div>Tags</div><div>Accounting</div></section><section><p>After</p></section></main></body>")
    in_main = '<main><p>a</p><main>b</main><p>c</p></main><p>d</p>'
    rows = spark.createDataFrame([("http://h/1", page), ("http://h/2", in_main), ("http://h/3", "<main><p>a<main>b</main>c")], "url string, html string")
    one, two, three = [r.box for r in rows.select("url", board_b.job_container("html").alias("box")).orderBy("url").collect()]
    assert one.startswith("<h1>Clerk") and one.endswith("<div>Accounting</div>")
    assert two == "<p>a</p><main>b</main><p>c</p>" and three == "<p>a<main>b</main>c"
    found = board_b.board_b_fields(rows.limit(1)).first()
    assert (found.description, found.function, found.location, found.is_job_page) == ("Line one Line two", "Accounting", "Nairobi", True)
    assert board_b_postings(rows).count() == 1
    assert [r.e for r in spark.createDataFrame([("<p>x",), ("<h1></h1>",), ("<h1>a",)], "t string").select(board_b.element("t", "h1").alias("e")).collect()] == [None, "", "a"]


def test_markup_is_read_once_and_references_whole(spark):
    import time

    from postsift.sources.pages import page_links

    long = spark.createDataFrame([("<a" * 500_000,), ("<script" * 100_000,)], "t string")
    start = time.time()
    long.select(text.strip_html("t").alias("t")).collect()
    assert time.time() - start < 20
    rows = spark.createDataFrame([("&#00000065;&#x0000041;&#99999999999;",)], "t string")
    assert rows.select(text.strip_html("t").alias("t")).first().t == "AA\ufffd"
    page = '<a data-href="/l/x" href="/l/y">y</a><a href=/l/z>z</a>'
    rows = spark.createDataFrame([(page,)], "t string")
    assert rows.select(page_links("t", "http://h", "/l/").alias("u")).first().u == ["http://h/l/y", "http://h/l/z"]


def test_features_read_long_words_once_and_plain_text_alike(spark):
    """The pattern for long words stood in a condition and in the division below it."""
    texts = ["Plain  text \n\n here\n", " a\tb \x0b c", "x \x1c\n  y", "é  è\n \n z", "", "\n", None, "one two", "İ  \r\n KSh"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plan = stylometry.extract_features(df).select("i", "caps_word_ratio")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\p{L}{3,}+") == 1 and plan.count(r"\p{Lu}{3,}+") == 1
    got = {r["i"]: r["c"] for r in df.select("i", text.collapse_keep_lines("text").alias("c")).collect()}
    gap = "[ \n\x1c-\x1f\x85\u1680\u2028\u2029]*"
    wanted = lambda s: re.sub(f"{gap}\n{gap}", "\n", re.sub("  +", " ", re.sub("[\t\r\f\x0b]", " ", s))).strip(vocab.WS_CHARS)
    assert got == {i: None if s is None else wanted(s) for i, s in enumerate(texts)}
    counted = spark.createDataFrame([(["a b", "a  b", " a b", "a ", "", "  ", "a", "é \U0001f600 z", None],)], "s array<string>")
    assert counted.select(stylometry.sentence_lengths("s").alias("n")).first()["n"] == [2, 2, 2, 1, 0, 0, 1, 3, None]
