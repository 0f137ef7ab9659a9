"""Vocabularies, patterns and orders that results depend on.

Everything in this module is a fixed value: changing one changes results.
"""

# --- fixed values: schemas -------------------------------------------------

UNIFIED_COLUMNS = [
    "source",
    "source_id",
    "title",
    "location",
    "department",
    "salary_range",
    "company_profile",
    "description",
    "requirements",
    "benefits",
    "employment_type",
    "required_experience",
    "required_education",
    "industry",
    "function",
    "telecommuting",
    "has_company_logo",
    "has_questions",
    "contact_email",
    "contact_email_domain",
    "is_free_email_provider",
    "posted_date",
    "url",
    "scraped_at",
    "fraudulent",
]

ANNOTATION_COLUMNS = ["duplicate_count", "short_text", "urgency_terms", "notes"]

LABEL_VIEW_COLUMNS = [
    "source", "title", "company_profile", "location", "salary_range", "employment_type",
    "contact_email_domain", "is_free_email_provider", "posted_date", "url", "description",
    "requirements", "benefits", "duplicate_count", "short_text", "urgency_terms",
    "suggested_label", "suggested_notes", "confidence", "reason", "fraudulent", "notes",
]

DATASET_COLUMNS = [
    "id", "source", "label_source", "fraudulent", "split", "group", "text", "text_chars",
    "title", "company_profile", "location", "salary_range", "employment_type",
    "contact_email_domain", "is_free_email_provider", "url",
]

TEXT_FIELDS = ["title", "description", "requirements", "benefits"]

FEATURE_ORDER = [
    "ttr", "avg_sentence_length", "sentence_length_variance",
    "punctuation_density", "exclamation_density", "readability_score",
    "gunning_fog_index", "urgency_term_count", "free_email_flag",
    "log_word_count", "caps_word_ratio", "money_mention_density",
    "payment_or_id_request_count", "second_person_density", "messaging_app_mention",
]

FEATURE_DESCRIPTIONS = {
    "ttr": "low vocabulary richness (repetitive wording)",
    "avg_sentence_length": "unusually short or long sentences",
    "sentence_length_variance": "inconsistent sentence structure",
    "punctuation_density": "high punctuation density",
    "exclamation_density": "excessive exclamation marks",
    "readability_score": "unusual readability level",
    "gunning_fog_index": "unusual text complexity",
    "urgency_term_count": "urgency / over-promising language",
    "free_email_flag": "use of a free email provider instead of a corporate domain",
    "log_word_count": "unusually short or long posting",
    "caps_word_ratio": "heavy use of capital letters",
    "money_mention_density": "frequent mentions of money or pay",
    "payment_or_id_request_count": "requests for payment, M-Pesa, ID or bank details",
    "second_person_density": "heavy direct 'you' address to the reader",
    "messaging_app_mention": "contact through WhatsApp or Telegram",
}

SEED = 42
MIN_TEXT_CHARS = 200
SHORT_TEXT_CHARS = 200

# --- fixed values: word lists ----------------------------------------------

FREE_EMAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com",
    "aol.com", "icloud.com", "protonmail.com", "mail.com", "yandex.com",
    "gmx.com", "zoho.com",
]

URGENCY_TERMS = [
    "urgent", "urgently", "guaranteed", "guarantee", "immediate start",
    "no experience needed", "earn daily", "earn weekly", "easy money",
    "unlimited income", "act now", "limited slots",
]

ANNOTATION_URGENCY_TERMS = [
    "urgent", "urgently", "guaranteed", "guarantee", "immediate start",
    "no experience needed", "earn daily", "earn weekly", "easy money",
    "work from home", "unlimited income", "act now", "limited slots",
]

ANONYMOUS_EMPLOYERS = ["", "anonymous employer", "confidential", "-"]

JOB_FUNCTIONS = [
    "Accounting, Auditing & Finance", "Admin & Office", "Building & Architecture",
    "Creative & Design", "Customer Service & Support", "Engineering & Technology",
    "Health & Safety", "Human Resources", "Management & Business Development",
    "Marketing & Communications", "Medical & Pharmaceutical",
    "Research, Teaching & Training", "Sales", "Shipping & Logistics",
    "Supply Chain & Procurement",
]

INDUSTRIES = [
    "Advertising, Media & Communications", "Automotive & Aviation",
    "Banking, Finance & Insurance", "Construction", "Education",
    "Energy & Utilities", "Enforcement & Security", "Healthcare",
    "Hospitality & Hotel", "IT & Telecoms", "Manufacturing & Warehousing",
    "NGO, NPO & Charity", "Recruitment", "Retail, Fashion & FMCG",
    "Shipping & Logistics",
]

EMPLOYMENT_TYPES = ["Full Time", "Part Time", "Contract", "Internship & Graduate"]

EXPERIENCE_LEVELS = [
    "Entry level", "Entry-level", "Mid-level", "Mid level", "Senior", "Executive",
    "Internship", "Graduate",
]

METADATA_LABELS = [
    "Min Qualification", "Experience Level", "Experience Length",
    "Language Requirement", "Working Hours", "Applicant Location",
]

INDICATORS = [
    "Requests for financial/personal info (fees, M-Pesa, ID, bank details)",
    "No verifiable company details",
    "Unrealistic compensation",
    "Free email provider instead of company domain",
    "Urgency / over-promising language",
    "Vague job description",
    "Cyrillic / look-alike characters",
]

# Cyrillic letters and the Latin letters they imitate, position by position.
HOMOGLYPH_FROM = "аеорсухАВЕКМНОРСТУХ"
HOMOGLYPH_TO = "aeopcyxABEKMHOPCTYX"

# --- fixed values: board page markers --------------------------------------

BOARD_A = {
    "source": "brightermonday",
    "base_url": "https://www.brightermonday.co.ke",
    "link_prefix": "/listings/",
    "ignored_domains": ["brightermonday.co.ke", "anonymous.com"],
    "body_start": "Job descriptions & requirements",
    "body_ends": ["Log In and Apply", "Important safety tips"],
    "share_anchor": "Share link Share on WhatsApp",
}

BOARD_B = {
    "source": "fuzu",
    "job_url_prefix": "https://www.fuzu.com/kenya/jobs/",
    "ignored_domains": ["fuzu.com"],
    "detail_labels": ["Location", "Contract Type", "Salary", "About the job"],
    "body_stops": ["Tags", "Start hiring with Fuzu"],
    "tag_stops": ["Start hiring with Fuzu", "Job search tips from Fuzu"],
    "country": "Kenya",
}

CORPUS_SOURCE = "emscad"

# --- fixed values: patterns ------------------------------------------------

EMAIL = r"[a-zA-Z0-9_.+-]+@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"

# Requests for money or identity documents: whole phrases, and one that may run on.
PAYMENT_OR_ID = [
    r"(?:registration|processing|application|training|interview|medical|placement|booking)\s+fees?",
    r"send\s+(?:money|cash)",
    r"m-?pesa",
    r"paybill",
    r"till\s+(?:no|number)",
    r"bank\s+(?:details|account\s+(?:details|number))",
    r"id\s+(?:card|number|no)",
    r"national\s+id",
    r"passport",
    r"kra\s+pin",
    r"date\s+of\s+birth",
]
PAYMENT_AMOUNT = r"pay\s+(?:a\s+)?(?:ksh|kes|sh|\$)"

# An amount after a currency, or before one. Currencies spelled out need a word start.
MONEY_AFTER_WORD = r"(?:ksh?s?\.?|kes\b|usd\b)\s?\d[\d,.]*\s?k?\b"
MONEY_AFTER_SIGN = r"[$€£]\s?\d[\d,.]*\s?k?\b"
MONEY_BEFORE_WORD = r"\d[\d,.]*\s?k?\s?(?:ksh|kes|usd|dollars|shillings|/=)"

SECOND_PERSON = r"(?:you|your|yours|yourself)"

MESSAGING_APP = r"(?:whats\s?app|telegram)"

RISK_PHRASES = (
    r"registration fee|processing fee|application fee|training fee|fees?\b|m-?pesa|paybill|till number|send money"
    r"|deposit|passport|id (?:card|number|no)|national id|bank details|kra pin|whats ?app|telegram"
    r"|@(?:gmail|yahoo|hotmail|outlook)\.com|urgent(?:ly)?|guarantee[d]?|no experience|limited slots|act now"
    r"|earn (?:daily|weekly)|easy money|work from home|(?:ksh?s?\.?|kes|usd|\$)\s?\d[\d,.]*k?"
)

BULLETS = "•·●▪◦➢►✓✔"

TIME_AGO = r"(?:Today|Yesterday|\d+\s+(?:day|days|week|weeks|month|months)\s+ago)"

POSTED_DATE = r"Posted:\s*(\d{1,2}\s+\w+\s+\d{4})"
APPLY_BY_DATE = r"Apply by:\s*(\d{1,2}\s+\w+\s+\d{4})"

PUNCTUATION = ".,!?;:\"'-()"

# --- fixed values: our own token rules -------------------------------------

# Possessive repeats: same matches, no backtracking stack on very long tokens.
WORD = r"[\p{L}\p{N}]++(?:[.,'-][\p{L}\p{N}]++)*+"

# Every character Python's str.strip() and \s treat as whitespace.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The same for JavaScript, which counts U+FEFF and leaves out the control separators.
JS_WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
