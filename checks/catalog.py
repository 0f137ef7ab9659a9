"""Every operator as a query over the test tables, with SQL that must agree.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` maps names to
DuckDB SQL. Whole numbers come out as bigint and fractions rounded to six places on
both sides.
"""

import uuid

from pyspark.sql import DataFrame, Window, functions as F, types as T

from checks import duck as d
from postsift import vocab
from postsift.functions import board_a, board_b, email, keys, notes, stylometry, text, verdict
from postsift.operators import (annotation, dedupe, evaluate, forest, history, labels, ranking, shap, split, stats,
                                submissions)
from postsift.operators.lineage import cut_lineage, shared_folder
from postsift.operators.rows import filter_here
from postsift.plans import annotation_batch, dataset, scoring
from postsift.sources import conform, corpus, files, pages, sinks, sitemaps
from postsift.streaming import scoring as streaming

TABLES = ["documents", "labels", "events", "pages"]
QUERIES = {}
ORACLES = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions to six places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def add(name, build, sql=None):
    QUERIES[name] = lambda spark, folder: plain(build(Inputs(spark, folder)))
    if sql is not None:
        ORACLES[name] = sql


class Inputs:
    """The test tables of one folder and the views derived from them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name):
        return files.spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def view(self, name):
        for t in TABLES:
            self.table(t).createOrReplaceTempView(t)
        if name in d.NEEDS_POSTINGS:
            self.view("postings").createOrReplaceTempView("postings")
        return self.spark.sql(d.VIEWS[name])

    def scratch(self):
        """A new folder beside the checkpoints."""
        return f"{shared_folder(self.spark)}/{uuid.uuid4()}"

    postings = property(lambda self: self.view("postings"))
    submissions = property(lambda self: self.view("submissions"))
    predictions = property(lambda self: self.view("predictions"))

    @property
    def texts(self):
        """Submitted texts: id and description."""
        return self.postings.select("doc_id", F.col("description").alias("text"))

    @property
    def features(self):
        return stylometry.extract_features(self.texts, "text").drop("text")

    @property
    def both(self):
        """Base corpus rows and locally labelled rows."""
        rows = self.postings
        return rows.filter("source_rank = 0"), rows.filter("source_rank = 1")

    @property
    def dataset(self):
        return dataset.build_dataset(*self.both)

    @property
    def vectors(self):
        """(id, source, split, group, y, features...) of the dataset."""
        data = cut_lineage(self.dataset)
        features = stylometry.extract_features(data.select("id", "text"), "text")
        return forest.feature_label_join(features, data)


P = ["postings"]


def over_postings(body, *ctes):
    return d.with_views(P, body, *ctes)


# --- scans, sources, sinks ---------------------------------------------------

add("s01_read_postings",
    lambda i: files.read_postings(i.spark, f"{i.folder}/documents.parquet", ["doc_id", "text", "lang", "source"]),
    "select cast(doc_id as varchar) as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents")


def _round_trip(i):
    path = i.scratch() + "/csv"
    rows = conform.conform_unified(i.postings)
    files.write_postings(rows, path, "csv", bom=True)
    return files.read_postings(i.spark, path, vocab.UNIFIED_COLUMNS, "csv").select("source", "source_id", "title", "description", "fraudulent")


add("s02_write_postings", _round_trip, over_postings("select source, source_id, title, description, fraudulent from postings"))


def _refuse(i):
    path = i.scratch() + "/batch"
    files.write_annotations(i.postings.select("doc_id"), path)
    try:
        files.write_annotations(i.postings.select("doc_id"), path)
        refused = False
    except Exception:
        refused = True
    files.write_annotations(i.postings.select("doc_id"), path, force=True)
    return i.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(refused).alias("refused"))


add("s03_refuse_overwrite", _refuse, over_postings("select count(*) as n_rows, true as refused from postings"))

add("s04_conform_unified", lambda i: conform.conform_unified(i.postings),
    over_postings("select " + ", ".join(
        c if c in ("source", "source_id", "title", "company_profile", "description", "requirements", "benefits",
                   "contact_email_domain", "is_free_email_provider", "fraudulent") else f"'' as {c}"
        for c in vocab.UNIFIED_COLUMNS) + " from postings"))

_base = {c: d.clean_html(f"coalesce({c}, '')") for c in ("company_profile", "description", "requirements", "benefits")}
S05_CTES = [
    ("b0", f"select job_id, title, coalesce(location, '') as location, department, coalesce(salary_range, '') as salary_range, "
           + ", ".join(f"{v} as {k}" for k, v in _base.items())
           + ", employment_type, required_experience, '' as required_education, industry, function, "
           "telecommuting, has_company_logo, has_questions, fraudulent from corpus_raw"),
    ("b1", "select *, " + d.contact_domain("concat_ws(' ', company_profile, description, requirements)") + " as dom from b0"),
    ("base", f"""select 'emscad' as source, cast(job_id as varchar) as source_id, title, location, department, salary_range, company_profile,
  description, requirements, benefits, employment_type, required_experience, required_education, industry, function,
  cast(telecommuting as varchar) as telecommuting, cast(has_company_logo as varchar) as has_company_logo,
  cast(has_questions as varchar) as has_questions, '' as contact_email, dom as contact_email_domain,
  case when dom in {d.in_list(vocab.FREE_EMAIL_DOMAINS)} then '1' else '0' end as is_free_email_provider,
  '' as posted_date, '' as url, '' as scraped_at, cast(fraudulent as varchar) as fraudulent from b1"""),
]
add("s05_standardize_base", lambda i: corpus.standardize_base(i.view("corpus_raw")),
    d.with_views(["corpus_raw"], "select * from base", *S05_CTES))

_HREF = rf"""(?is)<a(?:\s+(?:[^\s/=<>h][^\s/=<>]*|h[^r][^\s/=<>]*)(?:\s*=\s*{d.VALUE})?)*\s+href\s*=\s*["']([^"']*)["']"""
_SHOWN = d.sub(d.drop_elements("html", ("script", "style")), d.COMMENT, "")
LINKS = ("links", f"""select distinct url, concat('https://example.org', h) as link from
  (select url, page_id, unnest(regexp_extract_all({_SHOWN}, {d.q(_HREF)}, 1)) as h from pages) where starts_with(h, '/')""")
add("s06_extract_links", lambda i: pages.extract_links(i.table("pages"), "https://example.org", "/", ("page_id", "url")),
    f"""select distinct page_id, url, concat('https://example.org', h) as link from
  (select url, page_id, unnest(regexp_extract_all({_SHOWN}, {d.q(_HREF)}, 1)) as h from pages) where starts_with(h, '/')""")

BLOCKS = [
    ("blocks", "select page_id, unnest(regexp_extract_all(xml, '(?s)<url>(.*?)</url>', 1)) as b from sitemaps"),
    ("urls", r"""select page_id, regexp_extract(b, '<loc>\s*(.*?)\s*</loc>', 1) as url, regexp_extract(b, '<lastmod>\s*(.*?)\s*</lastmod>', 1) as lastmod
  from blocks where starts_with(regexp_extract(b, '<loc>\s*(.*?)\s*</loc>', 1), 'https://www.fuzu.com/kenya/jobs/')"""),
]
add("s07_sitemap_urls", lambda i: sitemaps.sitemap_urls(i.view("sitemaps"), keep=("page_id",)),
    d.with_views(["sitemaps"], "select * from urls", *BLOCKS))
add("s08_sitemap_category_filter",
    lambda i: sitemaps.sitemap_category_filter(
        sitemaps.sitemap_locations(i.view("sitemaps").select("page_id", F.col("index_xml").alias("xml")), ("page_id",)), ["sales", "it"]),
    d.with_views(["sitemaps"], r"""select page_id, sitemap from (select page_id, unnest(regexp_extract_all(index_xml, '<loc>\s*(.*?)\s*</loc>', 1)) as sitemap from sitemaps)
 where contains(sitemap, 'sitemap-sales-listings') or contains(sitemap, 'sitemap-it-listings')"""))
add("s09_crawl_frontier", lambda i: sitemaps.crawl_frontier(sitemaps.sitemap_urls(i.view("sitemaps")), 200),
    d.with_views(["sitemaps"], "select url, max(lastmod) as lastmod from urls group by url order by lastmod desc, url desc limit 200", *BLOCKS))
add("s10_frontier_union",
    lambda i: sitemaps.frontier_union(
        pages.extract_links(i.table("pages"), "https://example.org", "/"),
        i.table("pages").select(F.col("url").alias("link"))),
    f"with {LINKS[0]} as ({LINKS[1]}) select link from links union select url as link from pages")
add("s11_source_id_from_url", lambda i: i.table("pages").select("page_id", keys.source_id_from_url("url").alias("source_id")),
    "select page_id, string_split(rtrim(url, '/'), '/')[-1] as source_id from pages")

# --- board A -------------------------------------------------------------------

A_START, A_ENDS = "Job descriptions & requirements", ("Log In and Apply", "Important safety tips")
_longest = lambda xs: sorted(xs, key=len, reverse=True)


def _a_label(label):
    stops = "|".join([x for x in vocab.METADATA_LABELS if x != label] + [A_START])
    return d.strip(f"regexp_extract(t, {d.q(label + r':' + r'\s*(.*?)(?:\s+(?:' + stops + r')|$)')}, 1)")


_a_bp = (r"\s+(.*?)\s+(" + "|".join(_longest(vocab.JOB_FUNCTIONS)) + r")\s+(?:Today|Yesterday|\d+\s+(?:day|days|week|weeks|month|months)\s+ago)")
_a_pattern = f"concat('\\Q', title, '\\E\\s+\\Q', title, '\\E', {d.q(_a_bp)})"
_TAGS_AROUND = rf"(?:{d.WS}*(?:{d.TAG}))+{d.WS}*"
_h1 = lambda page, joiner: d.strip(d.entities(d.sub(f"regexp_extract({page}, {d.q(r'(?is)<h1[^>]*>(.*?)</h1>')}, 1)", _TAGS_AROUND, joiner)))
A_CTES = [
    ("a0", f"select doc_id, url, {d.drop_elements('html')} as page from board_a_pages"),
    ("a1", f"select doc_id, url, {_h1('page', '')} as title, {d.clean_html('''regexp_extract(page, '(?is)<main[^>]*>(.*?)</main>', 1)''')} as t from a0"),
    ("a2", f"""select *, case when contains(t, {d.q(A_START)}) then substring(t, 1, instr(t, {d.q(A_START)}) - 1) else substring(t, 1, 800) end as win,
  case when contains(t, {d.q(A_START)}) then substring(t, instr(t, {d.q(A_START)}) + {len(A_START)}) end as body from a1"""),
    ("a3", f"""select *, case {' '.join(f"when contains(win, {d.q(x)}) then {d.q(x)}" for x in _longest(vocab.INDUSTRIES))} else '' end as industry,
  case when contains(win, 'Share link Share on WhatsApp') then rtrim(substring(win, 1, instr(win, 'Share link Share on WhatsApp') - 1), {d.q(vocab.WS_CHARS)}) end as before,
  {_a_label('Working Hours')} as hours, {_a_label('Experience Level')} as lvl, {_a_label('Experience Length')} as len_,
  least(coalesce(nullif(instr(body, {d.q(A_ENDS[0])}), 0), length(body) + 1), coalesce(nullif(instr(body, {d.q(A_ENDS[1])}), 0), length(body) + 1)) as body_end from a2"""),
    ("a4", f"""select doc_id, url, title, t, {d.strip(f"regexp_extract(t, {_a_pattern}, 1)")} as company_profile,
  {d.strip(f"regexp_extract(t, {_a_pattern}, 2)")} as function, industry,
  case when before is null or (industry <> '' and ends_with(before, industry)) then ''
   else {d.strip(f"regexp_extract(before, {d.q(r'(KSh[\sA-Za-z0-9,.-]+|Confidential)\s*$')}, 1)")} end as salary_range,
  {_a_label('Applicant Location')} as location,
  case {' '.join(f"when starts_with(hours, {d.q(x)}) then {d.q(x)}" for x in vocab.EMPLOYMENT_TYPES)} else {d.strip("string_split(hours, ' - ')[1]")} end as employment_type,
  {_a_label('Min Qualification')} as required_education, concat_ws(', ', nullif(lvl, ''), nullif(len_, '')) as required_experience,
  {_a_label('Language Requirement')} as language_requirement, hours as working_hours, lvl as experience_level, len_ as experience_length,
  case when body is null then t else {d.strip('substring(body, 1, body_end - 1)')} end as description from a3"""),
]
_A = lambda body, *more: d.with_views(["board_a_pages"], body, *A_CTES, *more)


def _a_text(i):
    df = i.view("board_a_pages").withColumn("page", text.drop_elements("html"))
    df = df.withColumn("title", board_b.h1_title("page", "")).withColumn("main", board_b.element("page", "main"))
    return text.with_clean_html(df, "main", "t", ()).select("doc_id", "url", "title", "t")


add("t12_labeled_field", lambda i: _a_text(i).select("doc_id", board_a.labeled_field("t", "Applicant Location", ["Job descriptions & requirements", *[x for x in vocab.METADATA_LABELS if x != "Applicant Location"]]).alias("location")),
    _A("select doc_id, location from a4"))
_META = {"Min Qualification": "required_education", "Experience Level": "experience_level", "Experience Length": "experience_length",
         "Language Requirement": "language_requirement", "Working Hours": "working_hours", "Applicant Location": "location"}
add("t13_metadata_block", lambda i: _a_text(i).select("doc_id", *[c.alias(_META[k]) for k, c in board_a.metadata_block("t").items()]),
    _A("select doc_id, " + ", ".join(_META.values()) + " from a4"))
add("t14_main_description", lambda i: _a_text(i).select("doc_id", board_a.main_description("t").alias("description")), _A("select doc_id, description from a4"))
add("t15_company_and_function", lambda i: _a_text(i).select("doc_id", *[c.alias(k) for k, c in board_a.company_and_function("t", "title").items()]),
    _A("select doc_id, company_profile, function from a4"))
add("t16_salary_and_industry", lambda i: _a_text(i).select("doc_id", *[c.alias(k) for k, c in board_a.salary_and_industry("t").items()]),
    _A("select doc_id, salary_range, industry from a4"))
add("t17_employment_type", lambda i: _a_text(i).select("doc_id", board_a.employment_type(board_a.metadata_block("t")["Working Hours"]).alias("employment_type")),
    _A("select doc_id, employment_type from a4"))
add("t18_required_experience", lambda i: _a_text(i).select("doc_id", (lambda m: board_a.required_experience(m["Experience Level"], m["Experience Length"]))(board_a.metadata_block("t")).alias("required_experience")),
    _A("select doc_id, required_experience from a4"))
_A_FIELDS = ["company_profile", "function", "industry", "salary_range", "location", "employment_type", "required_education", "required_experience", "description"]
add("t19_board_a_fields", lambda i: _a_text(i).withColumns(board_a.board_a_fields("t", "title")).select("doc_id", "title", *_A_FIELDS),
    _A("select doc_id, title, " + ", ".join(_A_FIELDS) + " from a4"))


def _unified_sql(source, cte, has):
    cols = []
    for c in vocab.UNIFIED_COLUMNS:
        if c == "source":
            cols.append(f"'{source}' as source")
        elif c == "source_id":
            cols.append("string_split(rtrim(url, '/'), '/')[-1] as source_id")
        elif c == "contact_email_domain":
            cols.append("dom as contact_email_domain")
        elif c == "is_free_email_provider":
            cols.append(f"case when dom in {d.in_list(vocab.FREE_EMAIL_DOMAINS)} then '1' else '0' end as is_free_email_provider")
        elif c == "scraped_at":
            cols.append("'t0' as scraped_at")
        else:
            cols.append(c if c in has else f"'' as {c}")
    return f"select {', '.join(cols)} from {cte}"


add("s12_board_a_postings", lambda i: pages.board_a_postings(i.view("board_a_pages").withColumn("scraped_at", F.lit("t0"))),
    _A(_unified_sql("brightermonday", "a5", ["title", "url", *_A_FIELDS]),
       ("a5", f"select *, {d.contact_domain('description', ['brightermonday.co.ke', 'anonymous.com'])} as dom from a4")))

# --- board B -------------------------------------------------------------------

_B_DROP = ("script", "style", "noscript", "svg")


def _b_between(start, stops, after="0"):
    """Lines past a start line up to the next stop, as a list expression over ``ls``."""
    at = f"coalesce(list_position(ls[{after} + 1:], '{start}'), 0)"
    rest = f"ls[{after} + {at} + 1:]"
    cut = "least(" + ", ".join(f"coalesce(nullif(list_position({rest}, {d.q(s)}), 0), len({rest}) + 1)" for s in stops) + f", len({rest}) + 1)"
    return f"case when {at} > 0 then {rest}[1:{cut} - 1] else [] end"


_B_DETAIL = ["Location", "Contract Type", "Salary", "About the job"]
_link_text = d.entities(d.sub("x", _TAGS_AROUND, " "))
B_CTES = [
    ("p0", f"select doc_id, url, {d.drop_elements('html', _B_DROP)} as page from board_b_pages"),
    ("p1", f"""select doc_id, url, page, coalesce({d.element('page', 'section', 'job-content')}, {d.element('page', 'main')}, {d.element('page', 'body')}) as box from p0"""),
    ("p2", f"""select *, {_h1('page', ' ')} as title,
  list_filter(list_transform(string_split({d.homoglyphs(d.entities(d.sub('box', d.TAG, chr(10))))}, chr(10)), lambda x: {d.strip('x')}), lambda x: x <> '') as ls,
  list_filter(list_transform(regexp_extract_all(box, {d.q(r'(?is)<a\b[^>]*\bhref\s*=\s*"[^"]*/company/[^>]*>(.*?)</a\s*>')}, 1), lambda x: rtrim({d.strip(_link_text)}, ', ')), lambda n: n <> '' and n <> 'Company') as names from p1"""),
    ("p3", f"""select *, {_b_between('Tags', ['Start hiring with Fuzu', 'Job search tips from Fuzu'])} as tags,
  {_b_between('Location', _B_DETAIL)} as loc, {_b_between('Contract Type', _B_DETAIL)} as con, {_b_between('Salary', _B_DETAIL)} as sal,
  {_b_between('Description', ['Tags', 'Start hiring with Fuzu'], "greatest(coalesce(list_position(ls, 'About the job'), 0) - 1, 0)")} as des from p2"""),
    ("p4", f"""select *, coalesce(list_filter(tags, lambda t: contains(lower(t), 'level') or lower(t) in {d.in_list([x.lower() for x in vocab.EXPERIENCE_LEVELS])})[1], '') as lvl from p3"""),
    ("p5", "select *, list_filter(tags, lambda t: t <> lvl and t <> 'Kenya') as cats from p4"),
    ("p6", r"""select doc_id, url, page, box, ls, tags, title, coalesce(names[1], '') as company_profile,
  coalesce(array_to_string(list_filter(loc, lambda x: x <> '•'), ', '), '') as location, coalesce(con[1], '') as employment_type,
  coalesce(array_to_string(sal, ' '), '') as salary_range, lvl as required_experience, coalesce(cats[1], '') as function,
  coalesce(array_to_string(cats[2:], '; '), '') as industry, coalesce(array_to_string(des, ' '), '') as description,
  regexp_extract(array_to_string(ls, ' '), 'Posted:\s*(\d{1,2}\s+\w+\s+\d{4})', 1) as posted_date,
  regexp_extract(array_to_string(ls, ' '), 'Apply by:\s*(\d{1,2}\s+\w+\s+\d{4})', 1) as apply_by from p5"""),
]
_B = lambda body, *more: d.with_views(["board_b_pages"], body, *B_CTES, *more)
_B_FIELDS = ["title", "company_profile", "location", "employment_type", "salary_range", "required_experience",
             "function", "industry", "description", "posted_date", "apply_by"]


def _b_lines(i):
    df = i.view("board_b_pages").withColumn("page", text.drop_elements("html", board_b.DROPPED_ELEMENTS))
    df = df.withColumn("box", board_b.job_container("page"))
    df = text.with_clean_html(df, "box", "visible", (), "\n", finish=lambda c: c)
    return df.withColumn("ls", board_b.page_lines("visible"))


def _b_col(name, build, sql):
    add(name, lambda i: _b_lines(i).select("doc_id", *build()), _B(f"select doc_id, {sql} from p6"))


_b_col("t10_page_lines", lambda: [F.size("ls").alias("n_lines"), F.array_join("ls", "|").alias("all_lines")],
       "len(ls) as n_lines, array_to_string(ls, '|') as all_lines")
_b_col("t11_slice_between", lambda: [F.array_join(board_b.slice_between("ls", "Job details", ["About the job"]), "|").alias("block")],
       f"array_to_string({_b_between('Job details', ['About the job'])}, '|') as block")
_b_col("t20a_job_container", lambda: [F.length("box").alias("n_chars"), F.md5("box").alias("box_hash")], "length(box) as n_chars, md5(box) as box_hash")
_b_col("t20b_h1_title", lambda: [board_b.h1_title("page").alias("title")], "title")
_b_col("t20c_company_from_link", lambda: [board_b.company_from_link("box").alias("company_profile")], "company_profile")
_b_col("t20d_location_join", lambda: [board_b.location_join("ls").alias("location")], "location")
_b_col("t20e_contract_and_salary", lambda: [board_b.contract_type("ls").alias("employment_type"), board_b.salary_lines("ls").alias("salary_range")], "employment_type, salary_range")
_b_col("t20f_board_b_description", lambda: [board_b.board_b_description("ls").alias("description")], "description")
_b_col("t20g_tags_to_level_and_categories",
       lambda: [board_b.level_tag(board_b.tag_lines("ls")).alias("required_experience"),
                F.array_join(board_b.category_tags(board_b.tag_lines("ls"), board_b.level_tag(board_b.tag_lines("ls"))), "; ").alias("categories")],
       "required_experience, concat_ws('; ', nullif(function, ''), nullif(industry, '')) as categories")
_b_col("t20h_posted_and_apply_dates",
       lambda: [board_b.posted_date("ls").alias("posted_date"), board_b.apply_by_date("ls").alias("apply_by"),
                board_b.typed_date(board_b.posted_date("ls")).cast("string").alias("posted_on"),
                ((board_b.h1_title("page") != "") & (board_b.board_b_description("ls") != "")).alias("is_job_page")],
       "posted_date, apply_by, cast(cast(strptime(posted_date, '%d %b %Y') as date) as varchar) as posted_on, title <> '' and description <> '' as is_job_page")
add("t20_board_b_fields", lambda i: board_b.board_b_fields(i.view("board_b_pages")).select("doc_id", *_B_FIELDS),
    _B("select doc_id, " + ", ".join(_B_FIELDS) + " from p6"))
add("s13_board_b_postings", lambda i: pages.board_b_postings(i.view("board_b_pages").withColumn("scraped_at", F.lit("t0"))),
    _B(_unified_sql("fuzu", "p7", ["url", *[c for c in _B_FIELDS if c != "apply_by"]]),
       ("p7", f"select *, {d.contact_domain('description', ['fuzu.com'])} as dom from p6 where title <> '' and description <> ''")))

# --- text scalars ----------------------------------------------------------------


def scalar(name, source, key, build, sql, from_sql=None):
    """A column function over one text column of a table."""
    add(name, lambda i: build(source(i)), from_sql or over_postings(f"select {key}, {sql} from postings"))


_pages = lambda i: i.table("pages")
_post = lambda i: i.postings
add("t01_strip_html", lambda i: _pages(i).select("page_id", text.collapse(text.strip_html("html")).alias("visible")),
    f"select page_id, {d.collapse(d.strip_html('html'))} as visible from pages")
add("t02_clean_html", lambda i: text.with_clean_html(_pages(i), "html", "clean").select("page_id", "clean"),
    f"select page_id, {d.clean_html('html')} as clean from pages")
add("t03_clean_keep_lines", lambda i: text.with_clean_lines(i.texts, "text", "clean").select("doc_id", "clean"),
    over_postings(f"select doc_id, {d.clean_lines('description')} as clean from postings"))
add("t04_normalize_homoglyphs", lambda i: i.texts.select("doc_id", text.normalize_homoglyphs("text").alias("latin")),
    over_postings(f"select doc_id, {d.homoglyphs('description')} as latin from postings"))
add("t05_mask_tokens", lambda i: i.texts.select("doc_id", text.mask_tokens("text").alias("masked")),
    over_postings(f"select doc_id, {d.mask('description')} as masked from postings"))
add("t06_segment", lambda i: i.texts.select("doc_id", text.segment("text").alias("segmented")),
    over_postings(f"select doc_id, {d.segment('description')} as segmented from postings"))
SEG = [("t0", f"select doc_id, {d.clean_lines('description')} as clean from postings"), ("t1", f"select doc_id, {d.segment('clean')} as seg from t0")]
_clean = lambda i: text.with_clean_lines(i.texts, "text", "clean")
add("t07_sentences", lambda i: _clean(i).select("doc_id", text.sentences("clean").alias("s")).select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("joined")),
    over_postings("select doc_id, len(s) as n, coalesce(array_to_string(s, '|'), '') as joined from t2", *SEG, ("t2", f"select doc_id, {d.sentences('seg')} as s from t1")))
add("t08_words", lambda i: _clean(i).select("doc_id", text.words("clean").alias("w")).select("doc_id", F.size("w").alias("n"), F.array_join("w", "|").alias("joined")),
    over_postings("select doc_id, len(w) as n, coalesce(array_to_string(w, '|'), '') as joined from t2", *SEG, ("t2", f"select doc_id, {d.words('seg')} as w from t1")))
add("t09_alnum_words", lambda i: i.texts.select("doc_id", F.size(text.alnum_words(F.split("text", " "))).alias("n")),
    over_postings(r"select doc_id, len(list_filter(string_split(description, ' '), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) as n from postings"))
add("t21_email_domain", lambda i: i.texts.select("doc_id", email.email_domain("text").alias("domain")),
    over_postings(f"select doc_id, {d.email('description')} as domain from postings"))
add("t22_contact_domain", lambda i: i.texts.select("doc_id", text.or_empty(email.contact_domain("text", ["yahoo.com"])).alias("domain")),
    over_postings(f"select doc_id, {d.contact_domain(d.homoglyphs('description'), ['yahoo.com'])} as domain from postings"))
add("t23_is_free_email", lambda i: i.texts.select("doc_id", email.is_free_email(email.email_domain("text")).alias("free")),
    over_postings(f"select doc_id, coalesce({d.email('description')} in {d.in_list(vocab.FREE_EMAIL_DOMAINS)}, false) as free from postings"))
add("t24_urgency_hint", lambda i: i.texts.select("doc_id", notes.urgency_hint("text").alias("n")),
    over_postings(f"select doc_id, {d.terms('lower(description)', vocab.ANNOTATION_URGENCY_TERMS)} as n from postings"))
_RISK_ASCII = d.sub("description", r"[^\x00-\x7f]", "z")
add("t25_highlight_terms",
    lambda i: i.texts.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "z")).select(
        "doc_id", notes.highlight_terms("text").alias("marked"), F.array_join(notes.risk_matches("text"), "|").alias("matches")),
    over_postings(f"select doc_id, {d.sub(_RISK_ASCII, '(?i)(' + vocab.RISK_PHRASES + ')', '<mark>' + chr(92) + '1</mark>')} as marked, "
                  f"coalesce(array_to_string(regexp_extract_all({_RISK_ASCII}, {d.q('(?i)(' + vocab.RISK_PHRASES + ')')}, 1), '|'), '') as matches from postings"))
_INDICATORS = (r"list_filter(list_transform(string_split(string_split(regexp_replace(notes, '^excluded\s*\|?\s*', ''), ';')[1], ','), lambda s: trim(s)), "
               "lambda s: regexp_matches(s, '^[1-7]$'))")
add("t26_parse_notes",
    lambda i: i.postings.select("doc_id", notes.parse_notes("notes").alias("n")).select(
        "doc_id", "n.excluded", F.array_join("n.indicators", ",").alias("indicators"), "n.comment"),
    over_postings(f"select doc_id, contains(notes, 'excluded') as excluded, coalesce(array_to_string({_INDICATORS}, ','), '') as indicators, "
                  "case when contains(notes, ';') then trim(substring(notes, instr(notes, ';') + 1)) else '' end as comment from postings"))
add("t27_indicator_counts", lambda i: annotation.indicator_counts(i.postings),
    over_postings(f"select cast(ind as bigint) as indicator, fraudulent, count(*) as n from (select fraudulent, unnest({_INDICATORS}) as ind from postings where fraudulent in ('0', '1')) group by 1, 2"))

# --- projections, filters ----------------------------------------------------------

_REASON = f"case when {d.strip('text')} = '' then 'Job posting text is required.' when coalesce(user_id, '') = '' then 'user_id is required.' end"
add("p01_validate_submissions", lambda i: submissions.validate_submissions(i.submissions).select("submission_id", "text", "reason"),
    d.with_views(["submissions"], f"select submission_id, {d.strip('text')} as text, {_REASON} as reason from submissions"))
add("p02_known_label_filter", lambda i: labels.known_label_filter(i.postings).select("doc_id", "fraudulent"),
    over_postings("select doc_id, fraudulent from postings where fraudulent in ('0', '1')"))
PROV = ("prov", """select doc_id, case when fraudulent not in ('0', '1') and suggested_label in ('0', '1') then suggested_label else fraudulent end as fraudulent,
  case when fraudulent not in ('0', '1') and suggested_label in ('0', '1') then 'ai_suggested' else 'manual' end as label_source from postings""")
add("p03_label_provenance", lambda i: labels.load_labelled(i.postings, True).select("doc_id", "fraudulent", "label_source"),
    over_postings("select * from prov where fraudulent in ('0', '1')", PROV))
add("p04_build_text", lambda i: i.postings.select("doc_id", keys.build_text().alias("text")), over_postings(f"select doc_id, {d.BUILD_TEXT} as text from postings"))
add("p05_min_chars_filter", lambda i: i.postings.filter(F.length("description") >= 200).select("doc_id"),
    over_postings("select doc_id from postings where length(description) >= 200"))
add("p06_normalize_key", lambda i: i.postings.select("doc_id", keys.normalize_key("description").alias("k")), over_postings(f"select doc_id, {d.norm('description')} as k from postings"))
add("p07_short_hash", lambda i: i.postings.select("doc_id", keys.short_hash("description").alias("h")), over_postings(f"select doc_id, {d.short_hash('description')} as h from postings"))
_n = d.norm("description")
add("p08_posting_id", lambda i: i.postings.select("doc_id", keys.posting_key("source", "source_id", keys.normalize_key("description")).alias("id")),
    over_postings(f"select doc_id, concat(source, ':', case when source_id <> '' then source_id else {d.short_hash(_n)} end) as id from postings"))
add("p09_group_key",
    lambda i: i.postings.select("doc_id", keys.group_key("source", "company_profile", "contact_email_domain", "is_free_email_provider", keys.normalize_key("description")).alias("grp")),
    over_postings(f"select doc_id, {d.group_key(_n)} as grp from postings"))
add("p10_blank_description_filter", lambda i: annotation_batch.blank_description_filter(i.postings.withColumn("description", F.col("requirements"))).select("doc_id"),
    over_postings("select doc_id from postings where trim(requirements) <> ''"))
add("p11_short_text_flag", lambda i: i.postings.select("doc_id", notes.short_text_flag("description").alias("short_text")),
    over_postings("select doc_id, cast(length(description) < 200 as bigint) as short_text from postings"))
add("p12_empty_notes_column", lambda i: annotation_batch.with_annotation_columns(i.postings).select("doc_id", "notes"), over_postings("select doc_id, '' as notes from postings"))
add("p13_history_snippet", lambda i: i.postings.select("doc_id", text.snippet("description").alias("snippet"), text.display_snippet("description").alias("shown")),
    over_postings("select doc_id, substring(description, 1, 60) as snippet, concat(substring(description, 1, 60), case when length(description) >= 60 then '…' else '' end) as shown from postings"))
add("p14_confidence_pct", lambda i: i.predictions.select("id", verdict.confidence_pct("p").alias("pct")),
    d.with_views(["predictions"], "select id, cast(floor(p * 100 + 0.5::double) as bigint) as pct from predictions"))
add("p15_whitespace_word_count", lambda i: i.submissions.select("submission_id", text.whitespace_word_count("text").alias("n")),
    d.with_views(["submissions"], r"select submission_id, len(regexp_extract_all(text, '[^\s]+')) as n from submissions"))
_LABEL = "case when fraudulent = '1' then 'fraudulent' when fraudulent = '0' then 'legitimate' end"
add("p16_verdict_text",
    lambda i: i.postings.withColumn("label", F.expr(_LABEL)).select("doc_id", verdict.verdict_text("label").alias("verdict"), verdict.result_headline("label").alias("headline")),
    over_postings(f"""select doc_id, case {_LABEL} when 'fraudulent' then 'Fraudulent' when 'legitimate' then 'Legitimate' else 'Pending' end as verdict,
  case when fraudulent = '1' then 'Likely fraudulent' else 'Likely legitimate' end as headline from postings"""))

# --- dataset: keys, copies, splits -------------------------------------------------

# Labelled texts with their key, the copies' winner, then groups dealt to folds.
LAB = [
    ("lab", f"""select *, {d.BUILD_TEXT} as text, case when source_rank = 0 then 'emscad' else 'manual' end as label_source
  from postings where fraudulent in ('0', '1')"""),
    ("txt", f"select *, length(text) as text_chars, {d.norm('text')} as text_norm from lab where length(text) >= 200"),
]
UNIQ = LAB + [
    ("clash", "select text_norm from txt group by text_norm having count(distinct fraudulent) > 1"),
    ("uniq", f"""select *, {d.group_key('text_norm')} as grp, concat(source, ':', case when source_id <> '' then source_id else {d.short_hash('text_norm')} end) as id
  from (select *, row_number() over (partition by text_norm order by source_rank, ordinal) as rn from txt where text_norm not in (select text_norm from clash)) where rn = 1"""),
]


def _chosen(values):
    """SQL for the number of the smallest of some expressions, ties to the last."""
    return "case " + " ".join(f"when {v} = least({', '.join(values)}) then {f}" for f, v in reversed(list(enumerate(values)))) + " end"


def poured(source, loads, weight, k, name):
    """Groups of a CTE dealt into the room that loads (one row, columns l0, l1 ...) leave, in order of h."""
    return [
        (f"{name}_t", f"select f, ld, (select coalesce(sum({weight}), 0) from {source}) as t from (unpivot {loads} on "
                      f"{', '.join(f'l{f}' for f in range(k))} into name f value ld)"),
        (f"{name}_l", f"select x.f, x.ld, x.t, count(*) as m, sum(y.ld) as s from {name}_t x join {name}_t y on y.ld <= x.ld group by all"),
        (f"{name}_m", f"select max(m) as m, max(s) as s, max(t) as t from {name}_l where t + s >= m * ld"),
        (f"{name}_b", f"select cast(substring(f, 2) as int) as f, m.m, sum(greatest(0, m.t + m.s - m.m * x.ld)) over (order by f) as bound from {name}_t x, {name}_m m"),
        (f"{name}_s", f"select *, sum({weight}) over (order by h) - {weight} as before from {source}"),
        (name, f"select grp, n_rows, n_pos, h, (select min(f) from {name}_b b where s.before * b.m < b.bound) as fold from {name}_s s"),
    ]


def dealt(source, k, name):
    """Groups of a CTE placed in k folds: heavy ones by a recursive walk, the others into the room left."""
    held = [f"{x}{f}" for x in "np" for f in range(k)]  # rows and frauds of each fold so far
    cost = [f"(w.n{f} * g.n_rows * g.pos_w + w.p{f} * g.n_pos * g.row_w)" for f in range(k)]
    step = ", ".join(f"{x} + case when fold = {x[1:]} then {'n_rows' if x[0] == 'n' else 'n_pos'} else 0 end" for x in held)
    sums = lambda column: ", ".join(f"coalesce(sum(case when fold = {f} then {column} end), 0) as l{f}" for f in range(k))
    return [
        (f"{name}_g", f"""select grp, md5(concat('42|', grp)) as h, count(*)::hugeint as n_rows, count(*) filter (where fraudulent = '1')::hugeint as n_pos
  from {source} group by grp"""),
        (f"{name}_a", f"""select *, greatest(sum(n_pos) over (), 1) * greatest(sum(n_pos) over (), 1) as pos_w, sum(n_rows) over () * sum(n_rows) over () as row_w,
  n_rows * 1000 >= sum(n_rows) over () or (n_pos > 0 and n_pos * 1000 >= sum(n_pos) over ()) as heavy from {name}_g"""),
        (f"{name}_h", f"""select h, n_rows, n_pos, pos_w, row_w, row_number() over (order by n_rows desc, n_pos desc, h) as r from {name}_a where heavy"""),
        (f"{name}_w", f"""select 0::bigint as r, ''::varchar as h, -1 as fold, {', '.join(f'0::hugeint as {x}' for x in held)}
  union all select r, h, fold, {step} from (select g.r, g.h, g.n_rows, g.n_pos, {', '.join(f'w.{x}' for x in held)}, {_chosen(cost)} as fold
  from {name}_w w join {name}_h g on g.r = w.r + 1)"""),
        (f"{name}_1", f"select g.*, w.fold from {name}_g g join {name}_w w on g.h = w.h"),
        (f"{name}_lp", f"select {sums('n_pos')} from {name}_1"),
        (f"{name}_fp", f"select * from {name}_a where not heavy and n_pos > 0"),
        *poured(f"{name}_fp", f"{name}_lp", "n_pos", k, f"{name}_2"),
        (f"{name}_lr", f"select {sums('n_rows')} from (select fold, n_rows from {name}_1 union all select fold, n_rows from {name}_2)"),
        (f"{name}_fr", f"select * from {name}_a where not heavy and n_pos = 0"),
        *poured(f"{name}_fr", f"{name}_lr", "n_rows", k, f"{name}_3"),
        (name, " union all ".join(f"select grp, cast(fold as bigint) as fold from {name}_{n}" for n in (1, 2, 3))),
    ]


DATA = UNIQ + dealt("uniq", 5, "fold5") + [
    ("data", "select u.*, case when f.fold = 0 then 'test' else 'train' end as split from uniq u join fold5 f on u.grp = f.grp")]
TRAIN5 = DATA + [("trainset", "select * from data where split = 'train'")] + dealt("trainset", 5, "cv")


def _texts(i, **kw):
    return dataset.labelled_texts(*i.both, **kw)


add("j01_history_join", lambda i: history.history_join(*_history_tables(i)),
    d.with_views(["submissions"], """select submission_id as posting_id, substring(text, 1, 60) as title_snippet, source_platform, submitted_at,
  case when user_id is null then null when length(text) % 3 = 0 then 'fraudulent' when length(text) % 3 = 1 then 'legitimate' end as label from submissions"""))


def _history_tables(i):
    """Postings; vectors and results of those with a user, a third still without a result."""
    subs = i.submissions
    posts = subs.select(F.col("submission_id").alias("posting_id"), F.col("text").alias("raw_text"), "source_platform", "submitted_at", "user_id")
    seen = posts.filter("user_id is not null")
    kind = F.length("raw_text") % 3
    results = seen.filter(kind < 2).select("posting_id", F.when(kind == 0, "fraudulent").otherwise("legitimate").alias("label"))
    return posts, seen.select("posting_id"), results


add("j02_user_postings", lambda i: history.user_postings(_history_tables(i)[0], "7").select("posting_id", "user_id"),
    d.with_views(["submissions"], "select submission_id as posting_id, user_id from submissions where user_id = '7'"))
add("j03_conflict_anti_join", lambda i: dedupe.conflict_anti_join(_texts(i)).select("source_rank", "ordinal", "fraudulent"),
    over_postings("select cast(source_rank as bigint) as source_rank, ordinal, fraudulent from txt where text_norm not in (select text_norm from clash)", *UNIQ[:3]))
add("j04_free_domain_lookup", lambda i: i.postings.filter(email.is_free_email("contact_email_domain")).select("doc_id", "contact_email_domain"),
    over_postings(f"select doc_id, contact_email_domain from postings where lower(contact_email_domain) in {d.in_list(vocab.FREE_EMAIL_DOMAINS)}"))
add("j05_duplicate_count_lookup",
    lambda i: dedupe.duplicate_count_lookup(i.postings.select(F.md5(keys.normalize_key("description")).alias("k")), "k"),
    over_postings(f"select md5({_n}) as k, count(*) as duplicate_count from postings group by 1"))
add("j05_duplicate_count_rows",
    lambda i: dedupe.with_duplicate_count(i.postings.select("doc_id", "source", keys.normalize_key("description").alias("k")), "k").select("doc_id", "source", "duplicate_count"),
    over_postings(f"select doc_id, source, count(*) over (partition by {_n}) as duplicate_count from postings"))
add("j06_feature_label_join", lambda i: i.vectors.select("id", "source", "split", F.col("group").alias("grp"), "y", "urgency_term_count", "ttr", "caps_word_ratio"),
    over_postings("select id, source, split, grp, cast(fraudulent as bigint) as y, urgency_term_count, ttr, caps_word_ratio from feat",
                  *DATA, *d.feature_ctes("data")))

add("a01_label_nunique_by_text", lambda i: dedupe.label_nunique_by_text(_texts(i)).select(F.lower(F.hex("text_key")).alias("k"), "n_labels"),
    over_postings("select sha256(text_norm) as k, count(distinct fraudulent) as n_labels from txt group by 1", *LAB))
add("a02_dedupe_keep_first", lambda i: dedupe.dedupe_keep_first(_texts(i)).select("source_rank", "ordinal", "text"),
    over_postings("""select cast(source_rank as bigint) as source_rank, ordinal, text from (select *, row_number() over (partition by text_norm order by source_rank, ordinal) as rn from txt) where rn = 1""", *LAB))
ANN = [
    ("ann0", f"select *, {_n} as nk from postings where {d.strip('description')} <> ''"),
    ("ann", f"""select *, concat_ws('|', source, {d.short_hash('nk')}) as aid, cast(length(description) < 200 as bigint) as short_text,
  {d.terms('lower(description)', vocab.ANNOTATION_URGENCY_TERMS)} as urgency_terms
  from (select *, count(*) over (partition by nk) as duplicate_count, row_number() over (partition by nk order by source_rank, ordinal) as rn from ann0) where rn = 1"""),
]
add("a03_annotation_dedupe", lambda i: dedupe.annotation_dedupe(i.postings).select("source_rank", "ordinal", "duplicate_count"),
    over_postings("select cast(source_rank as bigint) as source_rank, ordinal, duplicate_count from ann", *ANN))
add("a04_counts_by", lambda i: stats.counts_by(i.postings, "source", "fraudulent"), over_postings("select source, fraudulent, count(*) as n from postings group by 1, 2"))
add("a05_crosstab_margins", lambda i: stats.crosstab_margins(i.dataset),
    over_postings("""select case when grouping(source) = 1 then 'All' else source end as source, case when grouping(source) = 1 then '' else split end as split,
  count(*) filter (where fraudulent = '0') as legitimate, count(*) filter (where fraudulent = '1') as fraudulent, count(*) as all_rows
  from data group by grouping sets ((source, split), ())""", *DATA))
add("a06_split_summary", lambda i: stats.split_summary(i.dataset),
    over_postings("select split, count(*) as n_rows, round(avg(cast(fraudulent as double)), 6) as fraud_share, count(distinct grp) as n_groups from data group by split", *DATA))
add("a07_annotation_stats", lambda i: stats.annotation_stats(i.postings, annotation_batch.build_annotation_batch(i.postings)),
    over_postings("""select (select count(*) from postings) as input_rows, count(*) as output_rows, (select count(*) from postings) - count(*) as duplicates_removed,
  cast(sum(short_text) as bigint) as short_text, count(*) filter (where is_free_email_provider = '1') as free_email,
  count(*) filter (where urgency_terms > 0) as with_urgency_terms from ann""", *ANN))
_LABELLED = ("labelled", "select doc_id, description, fraudulent from postings where fraudulent in ('0', '1')")
add("a08_class_feature_means",
    lambda i: stats.class_feature_means(stylometry.extract_features(i.postings.filter("fraudulent <> ''").select("doc_id", "description", "fraudulent"), "description")),
    over_postings("select feature, round(avg(v) filter (where y = 0), 3) as legitimate, round(avg(v) filter (where y = 1), 3) as fraudulent from tall group by feature",
                  _LABELLED, *d.feature_ctes("labelled", "description"),
                  ("tall", "select cast(fraudulent as int) as y, unnest([" + ", ".join(f"'{c}'" for c in vocab.FEATURE_ORDER) + "]) as feature, unnest(["
                    + ", ".join(f"cast({c} as double)" for c in vocab.FEATURE_ORDER) + "]) as v from feat")))
add("a09_fraud_share", lambda i: stats.fraud_share(i.dataset),
    over_postings("select split, round(avg(cast(fraudulent as double)), 6) as fraud_share from data group by split", *DATA))
PRED = ("pr", "select *, case when p > 0.5::double then 1 else 0 end as pred from predictions")
_pred = lambda i: evaluate.with_prediction(i.predictions)
add("a10_per_source_rates", lambda i: evaluate.per_source_rates(_pred(i)),
    d.with_views(["predictions"], """select source, count(*) as n_rows, count(*) filter (where y = 1) as frauds, round(avg(pred) filter (where y = 1), 6) as recall,
  round(avg(pred) filter (where y = 0), 6) as false_positive_rate from pr group by source""", PRED))
CONF = ("conf", """select count(*) filter (where y = 0 and pred = 0) as tn, count(*) filter (where y = 0 and pred = 1) as fp,
  count(*) filter (where y = 1 and pred = 0) as fn, count(*) filter (where y = 1 and pred = 1) as tp from pr""")
add("a11_confusion_matrix", lambda i: evaluate.confusion_matrix(_pred(i)), d.with_views(["predictions"], "select * from conf", PRED, CONF))
REPORT = [PRED, CONF, ("per", """select 'legitimate' as class, tn / (tn + fn)::double as precision, tn / (tn + fp)::double as recall, 2 * tn / (2 * tn + fn + fp)::double as f1, tn + fp as support from conf
  union all select 'fraudulent', tp / (tp + fp)::double, tp / (tp + fn)::double, 2 * tp / (2 * tp + fp + fn)::double, tp + fn from conf""")]
add("a12_classification_report", lambda i: evaluate.classification_report(_pred(i)),
    d.with_views(["predictions"], """select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from per
  union all select 'accuracy', null, null, round((select (tn + tp) / (tn + fp + fn + tp)::double from conf), 6), cast(sum(support) as bigint) from per
  union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from per
  union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from per""", *REPORT))
add("a13_base_load_stats", lambda i: stats.base_load_stats(corpus.standardize_base(i.view("corpus_raw"))),
    d.with_views(["corpus_raw"], """select count(*) as n_rows, count(*) filter (where fraudulent = '0') as legitimate, count(*) filter (where fraudulent = '1') as fraudulent,
  count(*) filter (where contact_email_domain <> '') as with_domain, count(*) filter (where is_free_email_provider = '1') as free_email from base""", *S05_CTES))
add("a14_annotation_progress", lambda i: stats.annotation_progress(i.postings),
    over_postings("""select n_rows, l + x as done, x as excluded, f as fraudulent, round(100.0::double * (l + x) / n_rows, 6) as done_pct,
  cast(floor(100.0::double * a / l + 0.5::double) as bigint) as agree_pct from (select count(*) as n_rows, count(*) filter (where fraudulent <> '') as l,
  count(*) filter (where fraudulent = '' and contains(notes, 'excluded')) as x, count(*) filter (where fraudulent = '1') as f,
  count(*) filter (where fraudulent <> '' and fraudulent = suggested_label) as a from postings)"""))
add("a15_history_totals", lambda i: history.history_totals(_history_tables(i)[0]),
    d.with_views(["submissions"], "select count(*) as total_items, cast(ceil(count(*) / 10.0) as bigint) as total_pages from submissions"))
add("a16_load_stats", lambda i: labels.load_stats(i.postings, True),
    over_postings("""select (select count(*) from postings) as rows, count(*) filter (where fraudulent in ('0', '1') and label_source = 'manual') as manual,
  count(*) filter (where label_source = 'ai_suggested') as ai_suggested, count(*) filter (where fraudulent not in ('0', '1')) as unlabelled_dropped from prov""", PROV))

# --- ordered operations, sets ----------------------------------------------------------

HIST = """select submission_id as posting_id, substring(text, 1, 60) as title_snippet, source_platform, submitted_at,
  case when user_id is null then null when length(text) % 3 = 0 then 'fraudulent' when length(text) % 3 = 1 then 'legitimate' end as label from submissions"""
add("w01_history_page", lambda i: history.history(*_history_tables(i), page=3, per_page=10),
    d.with_views(["submissions"], """select *, case label when 'fraudulent' then 'Fraudulent' when 'legitimate' then 'Legitimate' else 'Pending' end as verdict
  from (select * from h order by submitted_at desc nulls last, posting_id limit 10 offset 20)""", ("h", HIST)))
add("w02_annotation_shuffle", lambda i: annotation.annotation_shuffle(i.postings.select("doc_id"), "doc_id"),
    over_postings("select doc_id, row_number() over (order by md5(concat('42|', cast(doc_id as varchar))), doc_id) - 1 as row from postings"))
_RANK = "case when confidence = 'low' then 0 when suggested_label = '1' then 1 when confidence = 'medium' then 2 else 3 end"
add("w03_annotation_queue", lambda i: annotation.annotation_queue(i.postings, "disagree", "doc_id").select("doc_id", "queue_rank"),
    over_postings(f"select doc_id, cast({_RANK} as bigint) as queue_rank from postings where fraudulent <> '' and suggested_label <> '' and fraudulent <> suggested_label order by 2, 1"))
add("w03_annotation_queue_todo", lambda i: annotation.annotation_queue(i.postings, "todo", "doc_id").select("doc_id", "queue_rank"),
    over_postings(f"select doc_id, cast({_RANK} as bigint) as queue_rank from postings where fraudulent = '' and not contains(notes, 'excluded') order by 2, 1"))
add("w06_seeded_sample", lambda i: ranking.seeded_sample(i.postings.select("doc_id"), "doc_id", 500),
    over_postings("select doc_id from postings order by md5(concat('42|', cast(doc_id as varchar))), doc_id limit 500"))
add("u01_union_sources", lambda i: conform.union_sources(*[r.drop("lang") if n == 0 else r.drop("notes") for n, r in enumerate(i.both)]).select("doc_id", "source", "notes", "description"),
    over_postings("select doc_id, source, case when source_rank = 0 then notes else '' end as notes, description from postings"))
add("u02_split_leak_check", lambda i: split.split_leaks(i.dataset.select("group", F.when(F.col("text_chars") % 2 == 0, "train").otherwise("test").alias("split"))),
    over_postings('select grp as "group" from data where text_chars % 2 = 0 intersect select grp from data where text_chars % 2 <> 0', *DATA))
add("s18_label_upsert",
    lambda i: labels.label_upsert(i.postings.select("doc_id", "fraudulent", "notes"), i.view("label_events"), "doc_id", ("ts", "event_id")),
    d.with_views(P + ["label_events"], """select p.doc_id, coalesce(e.fraudulent, p.fraudulent) as fraudulent, case when e.doc_id is null then p.notes else coalesce(e.notes, '') end as notes
  from postings p left join (select *, row_number() over (partition by doc_id order by ts desc, event_id desc) as rn from label_events where fraudulent in ('0', '1', '')) e
  on p.doc_id = e.doc_id and e.rn = 1"""))
add("s18_rejected_labels", lambda i: labels.split_label_events(i.view("label_events"))[1].select("event_id", "reason"),
    d.with_views(["label_events"], "select event_id, 'fraudulent must be 0, 1 or empty' as reason from label_events where fraudulent not in ('0', '1', '')"))
add("s19_backfill_columns", lambda i: conform.backfill_columns(i.postings.drop("notes")).select("doc_id", "source", "reason", "notes", "duplicate_count", "suggested_notes"),
    over_postings("select doc_id, source, '' as reason, '' as notes, '' as duplicate_count, '' as suggested_notes from postings"))

# --- features ------------------------------------------------------------------------

FEAT = d.feature_ctes("tx")
TX = ("tx", "select doc_id, description as text from postings")


def _feature_queries():
    """Each feature from its own function; the whole vector from the one-pass plan."""
    st = stylometry
    w = lambda: F.size("w")
    single = {
        "f01_ttr": ("ttr", lambda: st.ttr("w")),
        "f02_avg_sentence_length": ("avg_sentence_length", lambda: st.mean_length(st.sentence_lengths("s"))),
        "f03_sentence_length_variance": ("sentence_length_variance", lambda: st.length_variance(st.sentence_lengths("s"))),
        "f04_punctuation_density": ("punctuation_density", lambda: st.punctuation_density("clean")),
        "f05_exclamation_density": ("exclamation_density", lambda: st.exclamation_density("clean", w())),
        "f06_readability_score": ("readability_score", lambda: st.readability(w(), F.size("s"), st.syllable_total(F.lower("line")))),
        "f07_gunning_fog_index": ("gunning_fog_index", lambda: st.gunning_fog(w(), F.size("s"), st.complex_total(F.lower("line")))),
        "f08_urgency_term_count": ("urgency_term_count", lambda: st.urgency_term_count("clean")),
        "f09_free_email_flag": ("free_email_flag", lambda: st.free_email_flag("clean")),
        "f10_log_word_count": ("log_word_count", lambda: F.log1p(w().cast("double"))),
        "f11_caps_word_ratio": ("caps_word_ratio", lambda: st.caps_word_ratio("line")),
        "f12_money_mention_density": ("money_mention_density", lambda: st.money_mention_density("fold", w())),
        "f13_payment_or_id_request_count": ("payment_or_id_request_count", lambda: st.payment_or_id_request_count("fold")),
        "f14_second_person_density": ("second_person_density", lambda: st.second_person_density("fold", w())),
        "f15_messaging_app_mention": ("messaging_app_mention", lambda: st.messaging_app_mention("fold")),
        "f16_contact_email_domain": ("contact_email_domain", lambda: email.email_domain("clean")),
    }

    def staged(i):
        df = text.with_clean_lines(i.texts, "text", "clean").withColumn("seg", text.segment("clean"))
        df = df.withColumns({"w": text.split_words("seg"), "s": text.split_sentences("seg"), "fold": st.fold("clean")})
        return df.withColumn("line", st.word_line("w"))

    for name, (column, build) in single.items():
        add(name, lambda i, c=column, b=build: staged(i).select("doc_id", b().alias(c)), over_postings(f"select doc_id, {column} from feat", TX, *FEAT))


_feature_queries()
add("f17_syllables_per_word", lambda i: i.texts.select("doc_id", stylometry.syllables_per_word(text.split_words(text.segment("text"))).alias("y")).select(
        "doc_id", F.size("y").alias("n"), F.array_join(F.transform("y", lambda v: v.cast("string")), ",").alias("syllables")),
    over_postings(f"select doc_id, len(y) as n, coalesce(array_to_string(y, ','), '') as syllables from (select doc_id, list_transform({d.words(d.segment('description'))}, lambda w: {d._SYL}) as y from postings)"))
add("f18_extract_features", lambda i: i.features,
    over_postings("select doc_id, " + ", ".join(vocab.FEATURE_ORDER + ["contact_email_domain"]) + " from feat", TX, *FEAT))
add("f19_vector_to_array", lambda i: forest.assemble(i.features, ["doc_id"]).select(
        "doc_id", F.posexplode(forest.vector_to_array("features")).alias("place", "value")),
    over_postings("select doc_id, unnest(range(15)) as place, unnest([" + ", ".join(f"cast({c} as double)" for c in vocab.FEATURE_ORDER) + "]) as value from feat", TX, *FEAT))

# --- modelling: splits, weights, metrics -----------------------------------------------

add("m01_group_stratified_split", lambda i: i.dataset.select("id", F.col("group").alias("grp"), "split"),
    over_postings("select id, grp, split from data", *DATA))
add("m02_cv_folds", lambda i: split.with_folds(i.dataset.filter("split = 'train'"), 5).select("id", "fold"),
    over_postings("select t.id, cv.fold from trainset t join cv on t.grp = cv.grp", *TRAIN5))
add("m03_balanced_weights", lambda i: forest.balanced_weights(i.predictions).select("id", "weight"),
    d.with_views(["predictions"], """select id, round((select count(*) from predictions) / (2.0::double * c.n), 6) as weight from predictions p
  join (select y, count(*) as n from predictions group by y) c on p.y = c.y"""))
add("m03_balanced_weights_per_fold", lambda i: forest.balanced_weights(i.predictions, keys=("fold",)).select("id", "fold", "weight"),
    d.with_views(["predictions"], """select id, cast(p.fold as bigint) as fold, round(t.n / (2.0::double * c.n), 6) as weight from predictions p
  join (select fold, y, count(*) as n from predictions group by fold, y) c on p.y = c.y and p.fold = c.fold
  join (select fold, count(*) as n from predictions group by fold) t on p.fold = t.fold"""))


def areas(source, key=""):
    """Average precision and ROC area by running sums over distinct scores."""
    k, part = (f"{key}, ", f"partition by {key} ") if key else ("", "")
    return [
        ("g", f"select {k}p, sum(y) as t, count(*) - sum(y) as f from {source} group by {k}p"),
        ("gr", f"select *, sum(t) over ({part}order by p desc) as tt, sum(f) over ({part}order by p desc) as ff, "
               f"sum(t) over ({part[:-1]}) as pos, sum(f) over ({part[:-1]}) as neg from g"),
        ("areas", f"""select {k}cast(max(pos) as bigint) as positives, cast(max(neg) as bigint) as negatives,
  sum(t / pos::double * tt / (tt + ff)) as average_precision, sum(t * (neg - ff + f / 2.0::double)) / max(pos * neg::double) as roc_auc from gr {'group by ' + key if key else ''}"""),
    ]


add("m07_average_precision", lambda i: evaluate.average_precision(i.predictions),
    d.with_views(["predictions"], "select round(average_precision, 6) as average_precision from areas", *areas("predictions")))
add("m08_roc_auc", lambda i: evaluate.roc_auc(i.predictions), d.with_views(["predictions"], "select round(roc_auc, 6) as roc_auc from areas", *areas("predictions")))
CV = [PRED, *areas("predictions", "param_id, fold"),
      ("hits", """select param_id, fold, count(*) filter (where y = 1 and pred = 1)::double as tp, count(*) filter (where pred = 1) as said, count(*) filter (where y = 1) as there from pr group by 1, 2"""),
      ("cvr", """select param_id, avg(average_precision) as mean_pr_auc, stddev_pop(average_precision) as std_pr_auc, avg(2 * tp / (said + there)) as mean_f1, avg(tp / there) as mean_recall,
  avg(case when said = 0 then 0 else tp / said end) as mean_precision from areas join hits using (param_id, fold) group by param_id""")]
_CVR = "cast(param_id as bigint) as param_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("mean_pr_auc", "std_pr_auc", "mean_f1", "mean_recall", "mean_precision"))
add("m06_cv_results", lambda i: evaluate.cv_results(i.predictions), d.with_views(["predictions"], f"select {_CVR} from cvr", *CV))
add("w05_top5_params", lambda i: evaluate.top_params(evaluate.cv_results(i.predictions)),
    d.with_views(["predictions"], f"select {_CVR} from cvr order by cvr.mean_pr_auc desc, param_id limit 5", *CV))
add("m22_evaluate", lambda i: evaluate.held_out_scores(i.predictions),
    d.with_views(["predictions"], """select round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1,
  round((select average_precision from areas), 6) as pr_auc, round((select roc_auc from areas), 6) as roc_auc, tn, fp, fn, tp from conf""", PRED, CONF, *areas("predictions")))

# --- scoring without a model -------------------------------------------------------------

_D = vocab.FEATURE_DESCRIPTIONS
STUB = [("sc", """select *, case when free_email_flag and urgency_term_count > 0 then 'fraudulent' else 'legitimate' end as label,
  list_filter([case when free_email_flag then 'free_email_flag' end, case when urgency_term_count > 0 then 'urgency_term_count' end,
   case when ttr < 0.4::double or not (free_email_flag or urgency_term_count > 0) then 'ttr' end], lambda x: x is not null) as fs from feat"""),
        ("se", f"""select *, list_transform(fs, lambda x: case x when 'free_email_flag' then {d.q(_D['free_email_flag'])} when 'urgency_term_count' then {d.q(_D['urgency_term_count'])} else {d.q(_D['ttr'])} end) as ds from sc"""),
        ("stub", """select *, case when label = 'fraudulent' then concat('Flagged as likely fraudulent due to: ', array_to_string(ds, '; '), '.')
   else concat('Classified as legitimate. Noted characteristics: ', array_to_string(ds, '; '), '.') end as summary from se""")]
_reasons = verdict.stub_reasons
add("m10_stub_classify", lambda i: verdict.stub_classify(i.features).select("doc_id", "label", "confidence_score", "is_stub"),
    over_postings("select doc_id, label, 0.5::double as confidence_score, true as is_stub from sc", TX, *FEAT, STUB[0]))
add("m15_stub_explain",
    lambda i: i.features.select("doc_id", verdict.stub_reasons("free_email_flag", "urgency_term_count", "ttr").alias("r")).select(
        "doc_id", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["feature"], x["impact"])), ",").alias("reasons")),
    over_postings("select doc_id, array_to_string(list_transform(fs, lambda x: concat(x, ':', case when x = 'free_email_flag' then 'high' else 'moderate' end)), ',') as reasons from sc", TX, *FEAT, STUB[0]))
add("m16_summary_text",
    lambda i: verdict.stub_classify(i.features).withColumn("r", verdict.stub_reasons("free_email_flag", "urgency_term_count", "ttr")).select("doc_id", verdict.summary_text("r", "label").alias("summary")),
    over_postings("select doc_id, summary from stub", TX, *FEAT, *STUB))
add("m17_explain_only_fraud", lambda i: filter_here(shap.explain(verdict.stub_classify(i.features)).select("doc_id", "label", "summary"), F.col("summary").isNotNull()),
    over_postings("select doc_id, label, summary from stub where label = 'fraudulent'", TX, *FEAT, *STUB))
SUBS = ("acc", f"select submission_id, {d.strip('text')} as text, source_platform, user_id, submitted_at from submissions where ({_REASON}) is null")
_SCORED = "substring(sha256(concat('posting:', submission_id)), 1, 32) as posting_id, label, 0.5::double as confidence_score, true as is_stub, case when label = 'fraudulent' then summary end as summary"
_SCORE_SQL = d.with_views(["submissions"], f"select {_SCORED} from stub", SUBS, *d.feature_ctes("acc"), *STUB)
_score_cols = ["posting_id", "label", "confidence_score", "is_stub", "summary"]
add("m19_score_postings", lambda i: scoring.score_postings(i.submissions)[0].select(*_score_cols), _SCORE_SQL)
add("m19_responses", lambda i: scoring.responses(scoring.score_postings(i.submissions)[0]).select(
        "posting_id", "label", "is_stub_model", F.col("explainability_report.summary").alias("summary")),
    _SCORE_SQL.replace("0.5::double as confidence_score, true as is_stub", "true as is_stub_model"))
_DATASET = ["id", "source", "label_source", "fraudulent", "split", 'grp as "group"', "text", "text_chars", "title", "company_profile",
            "'' as location", "'' as salary_range", "'' as employment_type", "contact_email_domain", "is_free_email_provider", "'' as url"]
add("m20_build_dataset", lambda i: i.dataset, over_postings("select " + ", ".join(_DATASET) + " from data", *DATA))
add("m20_removal_stats", lambda i: dataset.removal_stats(*i.both),
    over_postings("""select (select count(*) from lab where length(text) < 200) as short, (select count(*) from txt where text_norm in (select text_norm from clash)) as conflicting,
  (select count(*) from txt where text_norm not in (select text_norm from clash)) - (select count(*) from uniq) as duplicates""", *UNIQ))
_ANN_COLS = ["source", "source_id", "title", "description", "is_free_email_provider", "fraudulent", "duplicate_count", "short_text", "urgency_terms"]
add("m21_build_annotation_batch", lambda i: annotation_batch.build_annotation_batch(i.postings).select("row", *_ANN_COLS, "notes"),
    over_postings("select row_number() over (order by md5(concat('42|', aid)), aid) - 1 as row, " + ", ".join(_ANN_COLS) + ", '' as notes from ann", *ANN))

# --- scored tables and streams -------------------------------------------------------------


def _store(i):
    path = i.scratch()
    for batch in (7, 7):  # the second write of a batch replaces the first
        rejects = scoring.score_and_store(i.submissions, path, batch_id=batch)
    return {n: i.spark.read.parquet(f"{path}/{n}") for n in sinks.TABLES}, rejects


def _linked(tables):
    """Postings with what hangs off them, over the stored links."""
    return (tables["job_postings"].join(tables["feature_vectors"].select("posting_id", "vector_id", "urgency_term_count"), "posting_id", "left")
            .join(tables["classification_results"].select("vector_id", "result_id", "label"), "vector_id", "left")
            .join(tables["explainability_reports"].select("result_id", "plain_language_summary"), "result_id", "left")
            .select("posting_id", "source_platform", "user_id", "urgency_term_count", "label", "plain_language_summary"))


_LINKED_SQL = d.with_views(["submissions"], """select substring(sha256(concat('posting:', submission_id)), 1, 32) as posting_id, source_platform, user_id, urgency_term_count,
  label, case when label = 'fraudulent' then summary end as plain_language_summary from stub""", SUBS, *d.feature_ctes("acc"), *STUB)
add("s14_score_sink", lambda i: _linked(_store(i)[0]), _LINKED_SQL)


def _stream(i, replay=False):
    """Submissions as a file stream: the view is stored once and read back as a stream."""
    path = i.scratch()
    i.submissions.write.parquet(f"{path}/in")
    for n, files_per_batch in enumerate((1000, 3) if replay else (1000,)):  # a fresh checkpoint, with batches of another size
        stream = streaming.read_submissions(i.spark, f"{path}/in", "parquet", files_per_batch)
        streaming.score_stream(stream, f"{path}/out", f"{path}/check{n}").awaitTermination()
    return streaming.stored_tables(i.spark, f"{path}/out")


add("st1_score_stream", lambda i: _linked(_stream(i)), _LINKED_SQL)
add("st2_rejects_stream", lambda i: _stream(i)["rejects"].select("submission_id", "reason"),
    d.with_views(["submissions"], f"select submission_id, {_REASON} as reason from submissions where ({_REASON}) is not null"))
add("st3_stream_score_sink", lambda i: _linked(_stream(i, replay=True)), _LINKED_SQL)


def _cached(i):
    path = i.scratch() + "/features"
    data = cut_lineage(i.texts)
    sinks.cached_features(data.filter("doc_id < 1000000"), path)
    sinks.cached_features(data, path)
    return sinks.cached_features(data, path).select("doc_id", "ttr", "urgency_term_count", "readability_score")


add("s17_feature_cache", _cached, over_postings("select doc_id, ttr, urgency_term_count::double as urgency_term_count, readability_score from feat", TX, *FEAT))

# --- forests: facts that hold for every fit, beside the rows that the fit must cover -----------

# A forest's splits are beyond SQL, so these queries fit on the whole dataset and return, for each
# row, feature or tree, whether what must hold does. Forests have the library's own size, 300 trees
# without a limit of depth, and the search tries all of forest.GRID on five folds.
TREES, FOLDS = 300, 5


def _fitted(i):
    table = cut_lineage(i.vectors)
    train = forest.assemble(table.filter("split = 'train'"), ["y"])
    return table, forest.train_forest(train)


def _with_paths(i):
    table, model = _fitted(i)
    path = i.scratch()
    sinks.save_model(i.spark, model, path)
    loaded, paths = sinks.load_model(i.spark, path)
    return table, model, loaded, paths


def _trained(i):
    table, model = _fitted(i)
    both = forest.classify(model, forest.assemble(table, ["id"]), ["id"])
    return both.select("id", F.col("label").isin("fraudulent", "legitimate").alias("labelled"), F.col("confidence_score").between(0.5, 1).alias("in_range"), "is_stub")


def _classified(i):
    table, model = _fitted(i)
    p = forest.fraud_probability(model, forest.assemble(table, ["id", "y"]), ["id", "y"]).groupBy("id").agg(F.collect_set("p").alias("ps"))
    rows = scoring.classify_features(table, model).join(p, "id")
    share = F.when(F.col("label") == "fraudulent", F.col("confidence_score")).otherwise(1 - F.col("confidence_score"))
    follows = F.exists("ps", lambda p: (F.abs(p - share) < 1e-9) & ((p > 0.5) == (F.col("label") == "fraudulent")))
    return rows.select("id", F.col("confidence_score").between(0.5, 1).alias("in_range"), follows.alias("label_follows"), "is_stub")


def _searched(i):
    train = split.with_folds(i.vectors.filter("split = 'train'"), FOLDS, label="y")
    found = forest.grid_search(forest.assemble(train, ["fold", "y"]))
    top = max(r["mean_pr_auc"] for r in found["cv_results"].select("mean_pr_auc").collect())  # one row per setting
    best = F.col("param_id") == found["params"].index(found["best_params"])
    sizes = found["predictions"].groupBy("param_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("fold").alias("n_folds"))
    return sizes.join(F.broadcast(found["cv_results"]), "param_id").select(
        "param_id", "n_rows", "n_folds", (~best | (F.col("mean_pr_auc") == top)).alias("best_is_top"))


def _importance(i):
    return forest.feature_importance(i.spark, _fitted(i)[1])


def _importance_facts(i):
    rows = _importance(i)
    total = rows.agg(F.sum("importance")).first()[0]
    return rows.select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(abs(total - 1) < 1e-9).alias("sums_to_one"))


def _importance_order(i):
    """The places of the ranking, each with a value no higher than the place before."""
    by_size = Window.orderBy(F.desc("importance"), "feature")  # fifteen rows
    rows = _importance(i).select("importance", F.row_number().over(by_size).alias("place"), F.lag("importance").over(by_size).alias("before"))
    return rows.select("place", (F.col("before").isNull() | (F.col("before") >= F.col("importance"))).alias("in_order"))


def _reach(i):
    """Shares of the leaves of each tree add up to one; fraud shares are shares."""
    paths = _with_paths(i)[3]
    return paths.groupBy("tree").agg(
        (F.abs(F.sum(F.aggregate("z", F.lit(1.0), lambda a, x: a * x)) - 1) < 1e-9).alias("sums_to_one"),
        (F.min(F.col("value").between(0, 1).cast("int")) == 1).alias("in_range"))


def _additive(i):
    """Base value and contributions add up to the fraud probability of every row."""
    table, model, _, paths = _with_paths(i)
    base = paths.agg(shap.base_value(paths)).first()[0]
    p = forest.fraud_probability(model, forest.assemble(table, ["id"]), ["id"]).groupBy("id").agg(F.collect_set("p").alias("ps"))
    total = F.aggregate("shap", F.lit(base), lambda a, x: a + x)
    return shap.tree_shap(table, paths).join(p, "id").select("id", F.exists("ps", lambda p: F.abs(total - p) < 1e-9).alias("adds_up"))


def _strongest(i):
    """Three places per row: sizes that fall, none under a contribution left out."""
    table, _, _, paths = _with_paths(i)
    top = shap.tree_shap(table, paths).withColumn("top", shap.top3_contributions("shap"))
    sizes = F.array_sort(F.transform("shap", lambda v: -F.abs(v)))
    return top.select("id", F.posexplode("top").alias("place", "t"), sizes.alias("sizes")).select(
        "id", "place", (F.abs(F.abs("t.shap_value") + F.get("sizes", F.col("place"))) < 1e-12).alias("in_order"),
        (F.col("t.impact") == F.when(F.abs("t.shap_value") > 0.1, "high").otherwise("moderate")).alias("impact_follows"))


def _explained(i):
    """Frauds have three reasons and a summary; others have neither."""
    table, _, model, paths = _with_paths(i)
    rows = shap.explain(scoring.classify_features(table, model), paths)
    full = (F.size("top_features") == 3) & F.col("summary").isNotNull()
    none = F.col("top_features").isNull() & F.col("summary").isNull()
    return rows.select("id", F.when(F.col("label") == "fraudulent", full).otherwise(none).alias("explained"))


def _summarized(i):
    """The summary of all rows, merged from the states of three parts, against the rows themselves."""
    table, _, _, paths = _with_paths(i)
    rows = cut_lineage(shap.tree_shap(table, paths).select("id", "shap"))
    part = lambda k: shap.shap_state(rows.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == k))
    shares = (0.05, 0.5, 0.95)
    merged = shap.state_summary(shap.merge_states(part(0).union(part(1)).union(part(2))), shares)
    names = F.array(*[F.lit(n) for n in vocab.FEATURE_ORDER])
    tall = rows.select(F.posexplode("shap").alias("_i", "v")).select(F.get(names, F.col("_i")).alias("feature"), "v")
    q = F.col("quantiles")
    # A quantile is right if its share lies between those of the rows below it and up to it.
    near = [(F.avg((F.col("v") < q[k]).cast("double")) < s + 0.01) & (F.avg((F.col("v") <= q[k]).cast("double")) > s - 0.01) for k, s in enumerate(shares)]
    return tall.join(F.broadcast(merged), "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) == F.any_value("n")).alias("all_counted"),
        (F.abs(F.avg("v") - F.any_value("mean")) < 1e-9).alias("mean_follows"), (near[0] & near[1] & near[2]).alias("quantiles_near"))


def _reloaded(i):
    table, model, loaded, _ = _with_paths(i)
    probability = lambda m, name: forest.fraud_probability(m, forest.assemble(table, ["id"]), ["id"]).groupBy("id").agg(F.sort_array(F.collect_list("p")).alias(name))
    return probability(model, "p").join(probability(loaded, "q"), "id").select("id", (F.col("p") == F.col("q")).alias("same"))


def _facts(*facts):
    return ", ".join(f"true as {f}" for f in facts)


_FEATURES = "(select unnest([" + ", ".join(d.q(f) for f in vocab.FEATURE_ORDER) + "]) as feature)"

add("m04_train_forest", _trained, over_postings(f"select id, {_facts('labelled', 'in_range')}, false as is_stub from data", *DATA))
add("m05_grid_search", _searched, over_postings(
    f"select p.range as param_id, count(*) as n_rows, {FOLDS}::bigint as n_folds, true as best_is_top from data, range({len(forest.param_sets())}) p where split = 'train' group by 1", *DATA))
add("m09_classify", _classified, over_postings(f"select id, {_facts('in_range', 'label_follows')}, false as is_stub from data", *DATA))
add("m11_feature_importance", _importance_facts, f"select feature, {_facts('in_range', 'sums_to_one')} from {_FEATURES}")
add("w07_importance_rank", _importance_order, f"select range as place, true as in_order from range(1, {len(vocab.FEATURE_ORDER) + 1})")
add("m12_tree_paths", _reach, f"select range as tree, {_facts('sums_to_one', 'in_range')} from range({TREES})")
add("m13_tree_shap", _additive, over_postings("select id, true as adds_up from data", *DATA))
add("w04_top3_contributions", _strongest, over_postings(f"select id, p.range as place, {_facts('in_order', 'impact_follows')} from data, range(3) p", *DATA))
add("m14_explain", _explained, over_postings("select id, true as explained from data", *DATA))
add("m18_shap_summary", _summarized, over_postings(f"select feature, (select count(*) from data) as n_rows, {_facts('all_counted', 'mean_follows', 'quantiles_near')} from {_FEATURES}", *DATA))
add("s16_model_store", _reloaded, over_postings("select distinct id, true as same from data", *DATA))


def _metrics(i):
    path = i.scratch()
    data = cut_lineage(i.dataset)
    doc = sinks.metrics_document({"best_params": {"maxDepth": None}, "best_score": 0.5}, evaluate.held_out_scores(i.predictions), data, {"engine": "1"})
    sinks.metrics_sink(doc, path + "/metrics")
    stored = i.spark.read.schema(doc.schema).json(path + "/metrics")
    return stored.select(F.col("test.f1").alias("f1"), F.col("test.roc_auc").alias("roc_auc"), "cv_pr_auc",
                         F.col("label_sources")["manual"].alias("manual"), F.col("label_sources")["emscad"].alias("base"), F.col("best_params")["maxDepth"].alias("max_depth"))


add("s15_metrics_sink", _metrics,
    d.with_views(P + ["predictions"], """select (select round(2 * tp / (2 * tp + fp + fn)::double, 6) from conf) as f1, (select round(roc_auc, 6) from areas) as roc_auc, 0.5::double as cv_pr_auc,
  count(*) filter (where label_source = 'manual') as manual, count(*) filter (where label_source = 'emscad') as base, 'None' as max_depth from data""",
                 PRED, CONF, *areas("predictions"), *DATA))
