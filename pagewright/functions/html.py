"""What a page's HTML holds, by pattern.

These are definitions over the markup as text: a page with broken markup has the
same columns wherever they are computed.  What needs the tree of the page is in
``pagewright.operators.dom``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.columns import let, record

#: How much of each kind a page keeps.
MOST_HEADINGS, MOST_LINKS, MOST_IMAGES = 200, 500, 300
MOST_SCRIPTS, MOST_CLASSES, MOST_NETWORK_URLS = 200, 2000, 300
SNIPPET_CHARS, BODY_CHARS, HEADING_CHARS = 8192, 2048, 256
TRACKER_HOSTS = ("google-analytics.com", "googletagmanager.com", "static.hotjar.com", "connect.facebook.net", "cdn.segment.com", "cdn.mxpnl.com", "plausible.io", "posthog.com")
CAPTCHA = r"""(?i)g-recaptcha|data-sitekey|cf-challenge-running|challenge-form|<iframe[^>]*?\ssrc\s*=\s*["']?[^"'>]*(recaptcha|hcaptcha|turnstile)|class\s*=\s*["']?[^"'>]*turnstile"""
#: The value of an attribute in its three forms: in double quotes, in single quotes, bare.
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
TAG = r"<[a-zA-Z][^>]*>"


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag (a pattern for its name), the first of several; empty where there is none."""
    return unquoted(F.regexp_extract(tag, rf"(?i)(?<![\w-]){name}\s*=\s*({VALUE})", 1))


def _values(html: Column, tag: str, name: str) -> Column:
    """Values that are not empty of attribute ``name`` in the tags ``tag``, the first in each tag."""
    found = F.transform(_all(html, rf"(?i)<{tag}\b[^>]*?(?<![\w-]){name}\s*=\s*({VALUE})"), unquoted)
    return F.filter(found, lambda v: v != "")


def _in_tags(html: Column, name: str) -> Column:
    """All values of attributes ``name`` (a pattern) of all tags."""
    return F.flatten(F.transform(_all(html, TAG, 0), lambda t: F.transform(_all(t, rf"(?i)(?<![\w-])(?:{name})\s*=\s*({VALUE})"), unquoted)))


def inner_text(markup: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", ""), r"\s+", " "))


def title(html: Column) -> Column:
    return inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    """Array of (level, text), empty ones left out."""
    levels = _all(html, r"(?is)<h([1-6])[^>]*>.*?</h[1-6]>")
    texts = _all(html, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>")
    both = F.zip_with(levels, texts, lambda n, t: record(level=n.cast("int"), text=F.substring(inner_text(t), 1, HEADING_CHARS)))
    return F.filter(F.slice(both, 1, MOST_HEADINGS), lambda h: h["text"] != "")


def links(html: Column) -> Column:
    return F.slice(_values(html, "a", "href"), 1, MOST_LINKS)


def images(html: Column) -> Column:
    """Array of (src, alt), one per src, the first."""
    tags = F.slice(_all(html, r"(?i)<img\b[^>]*>", 0), 1, MOST_IMAGES)
    found = F.transform(tags, lambda t: record(src=attribute(t, "src"), alt=attribute(t, "alt")))
    seen = lambda a, x: F.when((x["src"] == "") | F.exists(a, lambda y: y["src"] == x["src"]), a).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(found, F.array().cast("array<struct<src:string,alt:string>>"), seen)


def script_sources(html: Column) -> Column:
    return F.slice(_values(html, "script", "src"), 1, MOST_SCRIPTS)


def meta_tags(html: Column) -> Column:
    """Map of lower-case name, property or http-equiv to content; the first of a name counts."""
    tags = _all(html, r"(?i)<meta\b[^>]*>", 0)
    pair = lambda t: record(k=F.lower(attribute(t, "(?:name|property|http-equiv)")), v=F.substring(attribute(t, "content"), 1, 512))
    first = lambda a, x: F.when((x["k"] == "") | F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x)))
    return F.map_from_entries(F.slice(F.aggregate(F.transform(tags, pair), F.array().cast("array<struct<k:string,v:string>>"), first), 1, 64))


def snippet(html: Column) -> Column:
    """The head, then the start of the body."""
    head = F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body>|$)", 1)
    return F.substring(F.concat(head, F.substring(body, 1, BODY_CHARS)), 1, SNIPPET_CHARS)


def css_classes(html: Column) -> Column:
    tokens = F.flatten(F.transform(_in_tags(html, "class"), lambda c: F.split(c, r"\s+")))
    return F.slice(F.array_distinct(F.filter(tokens, lambda t: t != "")), 1, MOST_CLASSES)


def network_urls(html: Column) -> Column:
    found = F.transform(_in_tags(html, "href|src|action"), lambda u: F.trim(u))
    kept = F.filter(found, lambda u: (u != "") & ~F.startswith(u, F.lit("data:")) & ~F.startswith(u, F.lit("javascript:")))
    return F.slice(F.array_distinct(kept), 1, MOST_NETWORK_URLS)


def css_variables(css: Column) -> Column:
    """Map of custom properties, the first of a name."""
    pairs = F.zip_with(_all(css, r"(--[\w-]+)\s*:\s*[^;}]+"), _all(css, r"--[\w-]+\s*:\s*([^;}]+)"), lambda k, v: record(k=k, v=F.trim(v)))
    first = lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x)))
    return F.map_from_entries(F.array_sort(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), first)))


def breakpoints(css: Column) -> Column:
    found = F.flatten(F.transform(_all(css, r"@media[^{]*\{?", 0), lambda m: F.regexp_extract_all(m, F.lit(r"(\d+)px"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def has_password(html: Column) -> Column:
    return html.rlike(r"""(?i)<input\b[^>]*?(?<![\w-])type\s*=\s*["']?password(?=["'\s/>])""")


def has_captcha(html: Column) -> Column:
    return html.rlike(CAPTCHA)


def without_trackers(html: Column) -> Column:
    """The page without its base element and the scripts of known trackers."""
    hosts = "|".join(h.replace(".", r"\.") for h in TRACKER_HOSTS)
    plain = F.regexp_replace(html, r"(?i)<base\b[^>]*>", "")
    return F.regexp_replace(plain, rf"""(?is)<script\b[^>]*?(?<![\w-])src\s*=\s*["']?[^"'>\s]*(?:{hosts})[^>]*>.*?</script>""", "")


def capped(html: Column, most_bytes: int) -> Column:
    """Struct (html, truncated)."""
    return let(F.octet_length(html) > most_bytes, lambda t: record(html=F.when(t, F.substring(html, 1, most_bytes)).otherwise(html), truncated=t))


def page_auth(failed: Column, captcha: Column, status: Column, login_wall: Column, session: Column) -> Column:
    """What a page asks of a visitor; failures come first, then blocks, then walls."""
    return F.when(failed, "unknown").when(captcha | (status == 429), "blocked").when(login_wall | status.isin(401, 403), "auth_required").when(session, "authenticated").otherwise("public")
