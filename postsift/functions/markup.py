"""Reading markup: one grammar of tokens for every page operator, as patterns of linear cost.

A token is a comment, a declaration, a tag or a run of text. Quoted attribute values may hold any
character but their quote; a tag that is never closed ends at the next "<" or at the end, so each
character is read once whatever the page. Scripts and styles are raw text up to their closing tag.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+)"""
ATTRIBUTES = rf"(?:[^=<>]++|=\s*+{VALUE}?+)*+"
COMMENT = r"<!--(?s:.*?)(?:-->|\z)"
DECLARATION = r"<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\z)"
TAG = rf"</?[A-Za-z]{ATTRIBUTES}(?:>|(?=<)|\z)"
NODE_BREAK = rf"{COMMENT}|{TAG}|{DECLARATION}"  # what stands between two text nodes
TOKEN = rf"{NODE_BREAK}|[^<]++|<"
RAW_TEXT = ("script", "style")
SELF_CLOSED = r"""(?:[\s"']|^<[A-Za-z][^\s/<>=]*+)/>$"""
INNERMOST = 3  # nested elements of one name that are dropped from the inside, so many levels deep


def from_bracket(pattern: str) -> str:
    """The same matches of a pattern whose alternatives all begin with "<"; they are only tried there."""
    return f"(?=<)(?:{pattern})"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is read."""
    return F.get(F.transform(F.array(c), use), 0)


def whole_element(name: str) -> str:
    """Pattern of an element up to its first closing tag, whose ends are its two groups, or to the end."""
    return rf"<(?i:{name})(?=[\s/>]){ATTRIBUTES}>(?s:.*?)(?:(</)(?i:{name})\s*+(>)|\z)"


def _innermost(name: str) -> str:
    """Pattern of an element without another of its name inside; groups as above."""
    return rf"<(?i:{name})(?=[\s/>]){ATTRIBUTES}>(?:[^<]++|<(?!/?(?i:{name})[\s/>]))*+(</)(?i:{name})\s*+(>)"


def drop_elements(c, elements) -> Column:
    """Remove elements with what they contain; a nameless tag ``</>`` stays where they broke the text.

    Other tokens are read as wholes, so nothing inside a comment or an attribute is taken for an
    element. Elements other than scripts and styles may be nested, ``INNERMOST`` levels deep.
    """
    c = column(c)

    def without(x, patterns):
        groups = "".join(f"${k}" for k in range(1, 2 * len(patterns) + 2))
        return F.regexp_replace(x, from_bracket("|".join([*patterns, f"({NODE_BREAK})"])), groups)

    def while_present(name, pattern):
        return lambda x: F.when(x.rlike(rf"(?i)<{name}[\s/>]"), without(x, [pattern])).otherwise(x)

    out = without(c, [whole_element(e) for e in RAW_TEXT if e in elements])
    for e in elements:
        if e not in RAW_TEXT:
            for pattern in [_innermost(e)] * INNERMOST + [whole_element(e)]:
                out = bound(out, while_present(e, pattern))
    return F.when(c.contains("<"), out).otherwise(c)


def tokens(c) -> Column:
    return F.regexp_extract_all(column(c), F.lit(TOKEN), F.lit(0))


def attribute(tag, name: str) -> Column:
    """The value of a tag's first attribute of that very name, quotes off; '' without one."""
    other = rf"[\s/]*+(?!(?:{name})[\s=])(?:[^\s/=<>]++|=)(?:\s*+=\s*+{VALUE}?+)?+"
    value = F.regexp_extract(column(tag), rf"(?i)^<[^\s/<>]++(?:{other})*+[\s/]*+{name}\s*+=\s*+({VALUE})", 1)
    return F.when(value.rlike("^[\"']"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def tags_of(c, name: str) -> Column:
    """The opening tags of one name, outside comments, scripts and styles."""
    own, raw = rf"(<(?i:{name})(?=[\s/>]){ATTRIBUTES}>)", "|".join(whole_element(e) for e in RAW_TEXT)
    found = F.regexp_extract_all(column(c), F.lit(from_bracket(f"{own}|{raw}|{NODE_BREAK}")), F.lit(1))
    return F.filter(found, lambda t: t != "")


def element(html, name: str, class_name: str = "") -> Column:
    """Inner HTML of the first such element, or of its open rest; null if there is none.

    The element ends where the depth of its name returns to zero. ``class_name`` is one of the
    words of the class attribute. Self-closed tags are empty elements and have no depth.
    """
    html = column(html)

    def kind(token):
        fits = F.array_contains(F.split(attribute(token, "class"), r"\s+"), class_name) if class_name else F.lit(True)
        opens = token.rlike(rf"(?i)^<{name}[\s/>]") & ~token.rlike(SELF_CLOSED)
        tag = F.when(token.rlike(rf"(?i)^</{name}[\s/>]"), -1).when(opens, F.when(fits, 2).otherwise(1)).otherwise(0)
        return F.when(token.startswith("<"), tag).otherwise(0)  # runs of text, the longest tokens, meet no pattern

    def walk(at, step):
        depth = at["depth"] + F.signum(step).cast("int")
        past = F.struct(depth.alias("depth"), (at["inside"] + (depth > 0).cast("int")).alias("inside"))
        return F.when(at["depth"] > 0, past).otherwise(at)

    def content(found):
        def cut(kinds):
            start = F.array_position(kinds, 2).cast("int")
            rest = F.slice(kinds, start + 1, F.size(kinds))
            begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("inside"))
            inside = F.aggregate(rest, begin, walk, lambda at: at["inside"])
            return F.when(start > 0, F.array_join(F.slice(found, start + 1, inside), ""))

        return bound(F.transform(found, kind), cut)

    return F.when(html.rlike(rf"(?i)<{name}[\s/>]"), bound(tokens(html), content))
