"""Contact domains and free-mail detection."""

from pyspark.sql import Column, functions as F

from postsift import vocab
from postsift.functions.text import _col, normalize_homoglyphs


# Reading a run of address characters whole, from its first one, keeps long unbroken
# tokens from being read again from each of their characters.
_LOCAL = "[a-zA-Z0-9_.+-]"
_FIRST = f"@(?<={_LOCAL}@)" + vocab.EMAIL.split("@", 1)[1]  # the first address is that of the first "@" that fits
_EACH = vocab.EMAIL.replace("]+@", "]++(?:@", 1) + ")?"


def email_domain(c) -> Column:
    """Domain of the first address, lower-cased, a trailing dot kept; null if none."""
    c = _col(c)
    found = F.lower(F.nullif(F.regexp_extract(c, _FIRST, 1), F.lit("")))
    return F.when(c.contains("@"), found)


def is_free_email(domain) -> Column:
    domain = _col(domain)
    return F.coalesce(F.lower(domain).isin(vocab.FREE_EMAIL_DOMAINS), F.lit(False))


def contact_domain(c, ignored=(), normalized=False) -> Column:
    """First address domain outside the ignored ones, trailing dots cut; null if none.

    ``normalized`` says that look-alikes were mapped already.
    """
    c = _col(c) if normalized else normalize_homoglyphs(c)
    found = F.filter(F.regexp_extract_all(c, F.lit(_EACH), F.lit(1)), lambda d: d != "")
    domains = F.transform(found, lambda d: F.rtrim(F.lower(d), F.lit(".")))

    def kept(d):
        keep = F.lit(True)
        for name in ignored:
            keep = keep & (d != name) & ~d.endswith("." + name)
        return keep

    first = F.get(F.filter(domains, kept) if ignored else domains, 0)
    return F.when(c.contains("@"), first)
