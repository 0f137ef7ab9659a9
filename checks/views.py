"""Views derived from the test tables, in SQL that Spark and DuckDB both run."""

POSTINGS = """
with b as (select d.doc_id, d.text, d.lang, l.toxic, length(d.text) % 8 as k from documents d left join labels l on d.doc_id = l.doc_id),
r as (select doc_id, doc_id as ordinal, text, lang, toxic, k from b
 union all select doc_id + 1000000, doc_id + 1000000, text, lang, case when doc_id % 40 = 0 then 1 - toxic else toxic end, k from b where doc_id % 20 = 0)
select doc_id, ordinal,
 case when doc_id % 3 = 0 then 0 else 1 end as source_rank,
 case doc_id % 3 when 0 then 'corpus' when 1 then 'board_a' else 'board_b' end as source,
 case when doc_id % 11 = 0 then '' else cast(doc_id as varchar(20)) end as source_id,
 substring(text, 1, 40) as title,
 concat(text, case k
  when 0 then ' URGENT HIRING!!! Earn KES 80,000 per month, no experience needed. Limited slots, act now! Pay a registration fee of KES 1,500 then email jobs.ke@gmail.com'
  when 2 then ' You must send your CV to hr@yahoo.com. WhatsApp or Telegram us urgently.'
  when 3 then ' Duties:Filing • Reports • CallsApply by Friday'
  when 4 then ' Salary Ksh 45k or $900. Guaranteed bonus, immediate start.'
  when 5 then ' Contact #EMAIL_9f3a1c# or #URL_00ff#.'
  when 6 then ' <b>Bold</b><script>var x = 1;</script> pay &amp; perks'
  when 7 then ' Visit оur раge'
  else '' end) as description,
 case when k = 3 then 'Degree in Commerce' else '' end as requirements,
 '' as benefits,
 case doc_id % 10 when 0 then '' when 1 then 'Confidential' when 2 then 'Anonymous  Employer' else concat('Company ', cast(doc_id % 37 as varchar(20))) end as company_profile,
 case doc_id % 4 when 0 then 'gmail.com' when 1 then concat('firm', cast(doc_id % 13 as varchar(20)), '.co.ke') else '' end as contact_email_domain,
 case when doc_id % 4 = 0 then '1' else '0' end as is_free_email_provider,
 coalesce(cast(toxic as varchar(20)), '') as fraudulent,
 case when doc_id % 7 = 0 then '1' when doc_id % 7 < 3 then '0' else '' end as suggested_label,
 case doc_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence,
 case when doc_id % 13 = 0 then 'excluded | 2,6; not a job' when toxic = 1 then '1,4,5; fee asked' else '' end as notes
from r
"""

# Submissions: user and time come from the event with the posting's id.
SUBMISSIONS = """
select cast(p.doc_id as varchar(20)) as submission_id,
 case when p.doc_id % 17 = 0 then '  ' else p.description end as text,
 p.source as source_platform, cast(e.user_id as varchar(20)) as user_id, e.ts as submitted_at
from postings p left join events e on e.event_id = p.doc_id
"""

CORPUS_RAW = """
select doc_id as job_id, title, case when doc_id % 5 = 0 then null else 'KE, Nairobi' end as location,
 '' as department, case when doc_id % 9 = 0 then '10-20' end as salary_range,
 concat('<p>', company_profile, '</p>') as company_profile, description, requirements,
 concat('mail perks', cast(doc_id % 5 as varchar(20)), '@benefits.org') as benefits,
 'Full-time' as employment_type, '' as required_experience, cast(null as varchar(20)) as required_education,
 'Education' as industry, 'Sales' as function,
 cast(doc_id % 2 as int) as telecommuting, cast(1 as int) as has_company_logo, cast(0 as int) as has_questions,
 cast(case when fraudulent = '1' then 1 else 0 end as int) as fraudulent
from postings
"""

BOARD_A_PAGES = """
select doc_id, concat('https://www.brightermonday.co.ke/listings/job-', cast(doc_id as varchar(20)), case when doc_id % 3 = 0 then '/' else '' end) as url,
 concat('<html><head><title>t</title><style>p{a:b}</style></head><body><nav>Home</nav><main><h1><b>', title, '</b></h1> ', title, ' ', title, ' ',
  case when doc_id % 6 = 0 then '' else concat(case when company_profile = '' then 'Anonymous Employer' else company_profile end, ' ',
   case doc_id % 4 when 0 then 'Accounting, Auditing &amp; Finance' when 1 then 'Sales' when 2 then 'Research, Teaching &amp; Training' else 'Admin &amp; Office' end) end,
  ' 2 weeks ago Easy apply <script>var a = 1;</script> Nairobi Full Time ',
  case doc_id % 3 when 0 then 'Banking, Finance &amp; Insurance' when 1 then 'Education' else '' end, ' ',
  case doc_id % 5 when 0 then 'Confidential' when 1 then 'KSh 30,000 - 45,000' when 2 then 'KSh 9,500' else '' end,
  ' Share link Share on WhatsApp ',
  case when doc_id % 4 = 3 then '' else 'Min Qualification: Bachelors ' end,
  'Experience Level: Mid level ', case when doc_id % 7 = 0 then '' else 'Experience Length: 2 years ' end,
  'Language Requirement: English Working Hours: ', case doc_id % 3 when 0 then 'Full Time - 8 to 5' when 1 then 'Shift work - nights' else 'Contract' end,
  ' Applicant Location: Nairobi ',
  case when doc_id % 8 = 5 then '' else 'Job descriptions &amp; requirements <p>' end, description, '</p> ',
  case doc_id % 3 when 0 then 'Log In and Apply' when 1 then 'Important safety tips Log In and Apply' else '' end,
  ' report to anonymous@anonymous.com or mail support@brightermonday.co.ke</main></body></html>') as html
from postings
"""

BOARD_B_PAGES = """
select doc_id, concat('https://www.fuzu.com/kenya/jobs/post-', cast(doc_id as varchar(20))) as url,
 concat('<html><body><svg><svg><text>logo</text></svg>icon</svg><nav>Location</nav><!-- <section class="job-content"> -->',
  case doc_id % 7 when 1 then '<section class="job-content-side">Tags</section>' when 2 then '<section data-class="job-content">Salary</section>' else '' end,
  case doc_id % 5 when 0 then '<main>' else concat('<section ', case when doc_id % 7 = 3 then 'title="a>b" ' else '' end, 'class="x job-content y">') end,
  '<h1> <span>', title, '</span> <i>role</i></h1><a href="/company/1"><img src="l.png"></a><a href="/kenya/company/2">', company_profile, ', </a>',
  '<p>Posted: ', cast(1 + doc_id % 28 as varchar(20)), ' May 2025 | Apply by: 12 Jun 2025</p><h2>Job details</h2>',
  case doc_id % 7 when 4 then '<section><b>Facts</b><section>inner</section></section>' when 5 then '<section/>' when 6 then '<script>if (a<b) "</div>";</script>' else '' end,
  '<div>Location</div><div>Nairobi</div><span>•</span><div>Kenya</div><div>Contract Type</div>',
  case when doc_id % 3 = 0 then '' else '<div>Full time</div>' end,
  case when doc_id % 4 = 1 then '<div>Salary</div><div>KES 20,000</div><div>per month</div>' else '' end,
  '<div>About the job</div><a href="/company/2/about">Company</a>',
  case when doc_id % 11 = 3 then '' else concat('<div>Description</div><div>', description, '</div>') end,
  '<div title="x>y">Contact help@fuzu.com or jobs@team.fuzu.com &copy2024</div>',
  case when doc_id % 6 = 0 then '' else concat('<div>Tags</div><div>Accounting</div><div>Finance</div><div>',
   case doc_id % 3 when 0 then 'Mid-level' when 1 then 'Entry and Basic-level' else 'senior' end, '</div><div>Insurance</div><div>Kenya</div>') end,
  '<div>Start hiring with Fuzu</div>', case doc_id % 5 when 0 then '</main>' else '</section>' end, '</body></html>') as html
from postings
"""

SITEMAPS = """
select page_id, concat('<urlset><url><loc> https://www.fuzu.com/kenya/jobs/', cast(page_id % 180 as varchar(20)), ' </loc><lastmod>2025-0',
 cast(1 + page_id % 9 as varchar(20)), '-1', cast(page_id % 7 as varchar(20)), '</lastmod></url>',
 '<url><loc>', url, '</loc></url><url><loc>https://www.fuzu.com/kenya/jobs/x', cast(page_id as varchar(20)), '</loc></url></urlset>') as xml,
 concat('<sitemapindex><sitemap><loc>https://www.fuzu.com/kenya/sitemap-', case page_id % 3 when 0 then 'sales' when 1 then 'it' else 'health' end,
 '-listings', cast(page_id as varchar(20)), '.xml.gz</loc></sitemap><sitemap><loc>', url, '</loc></sitemap></sitemapindex>') as index_xml
from pages
"""

LABEL_EVENTS = """
select event_id % 1500 as doc_id, case event_type when 'error' then 'x' when 'click' then '1' when 'view' then '0' else '' end as fraudulent,
 case when event_id % 5 = 0 then null else concat('1,3; ', event_type) end as notes, ts, event_id
from events
"""

PREDICTIONS = """
select event_id as id, event_type as source, cast(event_id % 6 as int) as param_id, cast(user_id % 5 as int) as fold,
 cast(case when event_type = 'error' or user_id % 11 = 0 then 1 else 0 end as int) as y,
 cast(cast(floor(value * 100) as bigint) % 101 as double) / 101 as p
from events
"""
