"""SQL fragments for the DuckDB side of the checks, written apart from the library."""

from checks import views
from postsift import vocab

VIEWS = {
    "postings": views.POSTINGS,
    "submissions": views.SUBMISSIONS,
    "corpus_raw": views.CORPUS_RAW,
    "board_a_pages": views.BOARD_A_PAGES,
    "board_b_pages": views.BOARD_B_PAGES,
    "sitemaps": views.SITEMAPS,
    "label_events": views.LABEL_EVENTS,
    "predictions": views.PREDICTIONS,
}
NEEDS_POSTINGS = ("submissions", "corpus_raw", "board_a_pages", "board_b_pages")


def q(s):
    return "'" + s.replace("'", "''") + "'"


def in_list(items):
    return "(" + ", ".join(q(i) for i in items) + ")"


def with_views(names, body, *ctes):
    """A query over the derived views, with further CTEs given as (name, sql)."""
    wanted = list(names)
    if any(n in NEEDS_POSTINGS for n in wanted) and "postings" not in wanted:
        wanted.insert(0, "postings")
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in wanted] + [f"{n} as ({s.strip()})" for n, s in ctes]
    return "with recursive " + ",\n".join(parts) + "\n" + body.strip()


WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'<>][^\s<>]*)"""
_ATTRIBUTES = rf"(?:[^=<>]|=\s*{VALUE})*"
COMMENT = r"<!--(?s:.*?)-->"
TAG = rf"(?:{COMMENT}|</?[A-Za-z]{_ATTRIBUTES}>|<[!?/][^>]*>)"


def sub(x, pattern, to):
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x):
    return f"trim({x}, {q(vocab.WS_CHARS)})"


def collapse(x):
    return f"trim({sub(x, WS + '+', ' ')})"


def drop_elements(x, names=("script", "style", "noscript")):
    """Elements give way to a nameless tag; nested ones go from the inside, as deep as the views nest them."""
    for n in names:
        whole = rf"(?is)<{n}(?:\s{_ATTRIBUTES})?>.*?</{n}\s*>"
        if n == "svg":
            inner = rf"(?is)<{n}(?:\s{_ATTRIBUTES})?>(?:[^<]|<[^s/]|</[^s]|<s[^v]|</s[^v])*</{n}\s*>"
            x = sub(sub(x, inner, "</>"), inner, "</>")
        x = sub(x, whole, "</>")
    return x


def tokens(x):
    return f"regexp_extract_all({x}, {q(TAG + '|[^<]+|<')})"


def element(x, name, class_name=""):
    """Inner HTML of the first such element, by the sum of opened and closed tags of its name."""
    opens = f"regexp_matches(t, {q(rf'(?i)^<{name}[\s/>]')}) and not regexp_matches(t, {q('/>$')})"
    value = f"regexp_extract(t, {q(rf'(?i)^<{name}(?:[\s/]+(?:[^\s/=<>c][^\s/=<>]*|c[^l][^\s/=<>]*)(?:={VALUE})?)*[\s/]+class\s*=\s*({VALUE})')}, 1)"
    words = f"string_split(translate({value}, {q(chr(34) + chr(39))}, ''), ' ')"
    fits = f"list_contains({words}, '{class_name}')" if class_name else "true"
    closes = f"regexp_matches(t, {q(rf'(?i)^</{name}[\s/>]')})"
    return f"""(select case when s > 0 then array_to_string(ts[s + 1:coalesce(list_position(list_transform(range(s, len(ks) + 1),
      lambda j: list_sum(ks[s:j])), 0) + s - 2, len(ts))], '') end from (select ts, ks,
      coalesce(list_position(list_transform(ts, lambda t: {opens} and {fits}), true), 0) as s from (select ts, list_transform(ts,
      lambda t: case when {opens} then 1 when {closes} then -1 else 0 end) as ks from (select {tokens(x)} as ts))))"""


def entities(x):
    """The references that occur in the tables; the ampersand last, so nothing is decoded twice."""
    for name, ch in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\xa0"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace(replace({x}, '&{name};', {q(ch)}), '&{name}', {q(ch)})"
    return x


def strip_html(x, names=("script", "style", "noscript"), to=" "):
    return entities(sub(drop_elements(x, names), TAG, to))


def homoglyphs(x):
    return f"translate({x}, {q(vocab.HOMOGLYPH_FROM)}, {q(vocab.HOMOGLYPH_TO)})"


def clean_html(x):
    return collapse(homoglyphs(strip_html(x)))


def mask(x):
    for k in ("EMAIL", "URL", "PHONE"):
        x = sub(x, f"#{k}_[0-9a-f]+#", f" [{k.lower()}] ")
    return x


def keep_lines(x):
    return strip(sub(sub(x, r"[ \t\r\f\x0b]+", " "), rf"{WS}*\n{WS}*", "\n"))


def clean_lines(x):
    return keep_lines(homoglyphs(mask(strip_html(x))))


def segment(x):
    bullets = sub(x, f"{WS}*[{vocab.BULLETS}]{WS}*", "\n")
    glue = r"([a-z0-9)\]:])([A-Z][a-z])"
    return sub(sub(bullets, glue, "\\1\n\\2"), glue, "\\1\n\\2")


def sentences(seg):
    pieces = "string_split(" + sub(seg, rf"([.!?]+){WS}+", "\\1\n") + ", chr(10))"
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> '')"


def words(seg):
    return f"regexp_extract_all({seg}, {q(r'''[\p{L}\p{N}]+(?:[.,'-][\p{L}\p{N}]+)*''')})"


def count(x, pattern):
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def email(x):
    return f"nullif(lower(regexp_extract({x}, {q(vocab.EMAIL)}, 1)), '')"


def contact_domain(x, ignored=()):
    found = f"list_transform(regexp_extract_all({x}, {q(vocab.EMAIL)}, 1), lambda d: rtrim(lower(d), '.'))"
    for name in ignored:
        found = f"list_filter({found}, lambda d: d <> {q(name)} and not ends_with(d, {q('.' + name)}))"
    return f"coalesce({found}[1], '')"


def terms(x, listed):
    parts = [f"(length({x}) - length(replace({x}, {q(t)}, ''))) // {len(t)}" for t in listed]
    return "cast(" + " + ".join(parts) + " as bigint)"


def norm(x):
    return collapse(f"lower({x})")


def short_hash(x):
    return f"substring(sha1({x}), 1, 12)"


BUILD_TEXT = "concat_ws(chr(10), " + ", ".join(f"nullif({strip(c)}, '')" for c in vocab.TEXT_FIELDS) + ")"


def group_key(text_norm):
    name = norm("company_profile")
    dom = f"lower({strip('contact_email_domain')})"
    return (f"case when {name} not in {in_list(vocab.ANONYMOUS_EMPLOYERS)} then concat(source, ':co:', {short_hash(name)}) "
            f"when {dom} <> '' and is_free_email_provider <> '1' then concat('dom:', {dom}) "
            f"else concat(source, ':post:', {short_hash(text_norm)}) end")


# --- features ----------------------------------------------------------------

_SYL = ("greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - "
        "case when regexp_matches(lower(w), '[^aeiouy]e$') and not regexp_matches(lower(w), 'le$') then 1 else 0 end)")

PAYMENT = (
    r"(?i)\b(?:registration|processing|application|training|interview|medical|placement|booking)\s+fees?\b"
    r"|\bsend\s+(?:money|cash)\b|\bpay\s+(?:a\s+)?(?:ksh|kes|sh|\$)|\bm-?pesa\b|\bpaybill\b|\btill\s+(?:no|number)\b"
    r"|\bbank\s+(?:details|account\s+(?:details|number))\b|\bid\s+(?:card|number|no)\b|\bnational\s+id\b"
    r"|\bpassport\b|\bkra\s+pin\b|\bdate\s+of\s+birth\b"
)
MONEY = (r"(?i)(?:\bksh?s?\.?|\bkes\b|\busd\b|\$|€|£)\s?\d[\d,.]*\s?k?\b"
         r"|\b\d[\d,.]*\s?k?\s?(?:ksh|kes|usd|dollars|shillings|/=)")
SECOND = r"(?i)\b(?:you|your|yours|yourself)\b"
APPS = r"(?i)\b(?:whats\s?app|telegram)\b"


def feature_ctes(source, text_col="text"):
    """CTEs ending in ``feat``: every column of ``source`` and the features.

    RE2 takes word edges as ASCII, so other letters become an ASCII one before the
    content patterns are counted.
    """
    ascii_text = sub("clean", r"[^\x00-\x7f€£]", "z")
    round_ = lambda x: f"round({x}, 6)"
    return [
        ("c0", f"select *, {clean_lines(f'coalesce({text_col}, chr(32))')} as clean from {source}"),
        ("c1", f"select *, {segment('clean')} as seg, {ascii_text} as asc_text from c0"),
        ("c2", f"select *, {words('seg')} as ws, {sentences('seg')} as ss from c1"),
        ("c3", f"""select *, len(ws) as w, len(ss) as s, list_transform(ss, lambda x: {count('x', WS.replace('[', '[^', 1) + '+')}) as lens,
  list_transform(ws, lambda w: {_SYL}) as syl,
  list_filter(ws, lambda w: length(w) >= 3 and regexp_matches(w, '^\\p{{L}}+$')) as longw, {email('clean')} as dom from c2"""),
        ("feat", f"""select * exclude (clean, seg, asc_text, ws, ss, lens, syl, longw, dom, w, s),
  {round_("case when w = 0 then 0 else len(list_distinct(list_transform(ws, lambda x: lower(x)))) / w::double end")} as ttr,
  {round_("case when s = 0 then 0 else list_sum(lens) / s::double end")} as avg_sentence_length,
  {round_("case when s < 2 then 0 else (s * list_sum(list_transform(lens, lambda x: x * x)) - list_sum(lens) * list_sum(lens))::double / (s * s) end")} as sentence_length_variance,
  {round_("case when length(clean) = 0 then 0 else (length(clean) - length(translate(clean, " + q(vocab.PUNCTUATION) + ", '')))::double / length(clean) end")} as punctuation_density,
  {round_("(length(clean) - length(replace(clean, '!', '')))::double / greatest(w, 1)")} as exclamation_density,
  {round_("case when s = 0 or w = 0 then 0::double else 206.835::double - 1.015::double * (w::double / s) - 84.6::double * (list_sum(syl)::double / w) end")} as readability_score,
  {round_("case when s = 0 or w = 0 then 0::double else 0.4::double * (w::double / s + 100 * (len(list_filter(syl, lambda x: x >= 3))::double / w)) end")} as gunning_fog_index,
  {terms("lower(clean)", vocab.URGENCY_TERMS)} as urgency_term_count,
  coalesce(dom in {in_list(vocab.FREE_EMAIL_DOMAINS)}, false) as free_email_flag,
  {round_("ln(1 + w::double)")} as log_word_count,
  {round_("case when len(longw) = 0 then 0 else len(list_filter(longw, lambda x: regexp_matches(x, '^\\p{Lu}+$')))::double / len(longw) end")} as caps_word_ratio,
  {round_("100 * " + count("asc_text", MONEY) + "::double / greatest(w, 1)")} as money_mention_density,
  cast({count("asc_text", PAYMENT)} as bigint) as payment_or_id_request_count,
  {round_("100 * " + count("asc_text", SECOND) + "::double / greatest(w, 1)")} as second_person_density,
  cast(regexp_matches(asc_text, {q(APPS)}) as bigint) as messaging_app_mention,
  dom as contact_email_domain from c3"""),
    ]
