"""DuckDB SQL for the queries that SQL can express."""

from postsift.llm import quality_rules as q, url_filter as u


def _list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _quality():
    stops = _list(q._forms())
    verdict = " and ".join(c for name, low, high in q.THRESHOLDS for c in (
        ([f"{name} >= {low}"] if low is not None else []) + ([f"{name} <= {high}"] if high is not None else [])))
    return rf"""
with d as (select doc_id, row_number() over () as row, coalesce(text, '') as t from documents),
w as (select doc_id, row, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select row, unnest(range(1, len(words) - 1)) as i, words from w where len(words) > 2),
repeated as (select row, i from (select row, i, count(*) over (partition by row, words[i], words[i + 1], words[i + 2]) as n from windows) where n > 1),
spots as (select row, count(distinct i + k) as n from repeated, range(3) r(k) group by row),
base as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(s.n, 0)::bigint as n_repeat_words,
  len(list_filter(words, lambda x: list_contains({stops}, x)))::double / greatest(len(words), 1) as stop_words_per_word,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::double / greatest(len(lines), 1) as ellipsis_line_share,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•]')))::double / greatest(len(lines), 1) as bullet_line_share,
  greatest(len(lines), 1) as n_lines
  from w left join spots s using (row)),
rated as (select *, word_chars::double / greatest(n_words, 1) as chars_per_word, n_symbols::double / greatest(n_words, 1) as symbols_per_word,
  n_dup_lines::double / n_lines as dup_line_share,
  n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > {q.MOST_REPEATED_PERCENT} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars_per_word, symbols_per_word, stop_words_per_word,
  dup_line_share, ellipsis_line_share, bullet_line_share, base_failed, not base_failed and {verdict} as kept from rated"""


def _urls():
    rules = sorted(u.RULES, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] == "allow"))
    whens = []
    for verdict, rule in rules:
        site, _, path = rule.partition("/")
        whens.append((f"(host = '{site}' or ends_with(host, '.{site}')) and starts_with(path, '/{path}')", verdict, rule))
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, _, r in whens) + " end"
    ruled = "case " + " ".join(f"when {c} then '{v}'" for c, v, _ in whens) + " end"
    weight = " + ".join(f"case when regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') then {w} else 0 end"
                        for w, terms in ((u.STRICT_WEIGHT, u.STRICT), (u.SOFT_WEIGHT, u.SOFT)) for t in terms)
    fold = f"'{u.UPPER}', '{u.LOWER}'"
    return rf"""
with a as (select page_id, coalesce(translate(url, {fold}), '') as low,
  case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), {fold}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select page_id, host, path, {rule} as rule, {ruled} as ruled, ({weight})::integer as term_weight from b)
select page_id, host, path, rule, term_weight, coalesce(ruled, case when term_weight >= {u.REJECT_AT} then 'block' else 'allow' end) as verdict from c"""


TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, rank, vec_id, score from (
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s) where rank <= 10"""

# Links by counting shared shingles, then the smallest id that links reach.
NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end) as shingles from w),
n as (select doc_id, len(shingles)::bigint as n_shingles from s),
x as (select doc_id, unnest(shingles) as shingle from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from x a join x b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n na on a = na.doc_id join n nb on b = nb.doc_id
  where 100 * both_have >= 85 * (na.n_shingles + nb.n_shingles - both_have)),
reach as (select doc_id, doc_id as other from n union select r.doc_id, l.b from reach r join links l on r.other = l.a),
c as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from n join c using (doc_id)"""

AUDIT = r"""
with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as first_id from d),
f as (select doc_id, part, map {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': first_id < doc_id} as fails from w),
g as (select f.*, exists (select 1 from labels l where l.doc_id = f.doc_id and quality = 1) as good,
  exists (select 1 from labels l where l.doc_id = f.doc_id and toxic = 1) as toxic from f),
p as (select '' as filter_order union all
  select filter_order || letter from p, (select unnest(['A', 'B', 'C', 'D', 'E']) as letter) where not contains(filter_order, letter)),
steps as (select filter_order, step::integer as step, filter_order[step] as letter, filter_order[:step - 1] as prior
  from p, range(1, 6) r(step) where length(filter_order) = 5),
counts as (select part, fails, good, toxic, count(*) as n, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x]) as failed from g group by all),
m as (select part, filter_order, step, letter, n, good, toxic, fails[letter] as hit, failed,
  len(list_filter(failed, lambda x: contains(prior, x))) > 0 as gone from counts, steps),
rows_ as (select part, filter_order, step, any_value(letter) as letter, coalesce(sum(n) filter (not hit and not gone), 0)::bigint as kept,
  coalesce(sum(n) filter (hit and not gone), 0)::bigint as removed, coalesce(sum(n) filter (hit and gone), 0)::bigint as redundant,
  coalesce(sum(n) filter (hit and len(failed) = 1), 0)::bigint as unique_fails,
  coalesce(sum(n) filter (hit and not gone and good), 0)::bigint as good_lost,
  coalesce(sum(n) filter (hit and not gone and toxic), 0)::bigint as toxic_lost from m group by 1, 2, 3)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, letter)::bigint as shapley from rows_"""

ORACLES = {"op1_quality_rules": _quality(), "op2_url_filter": _urls(), "op6_topk_search": TOP_K,
           "op12_superminhash": NEAR, "op13_filter_audit": AUDIT}
