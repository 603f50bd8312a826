"""URL functions as column expressions.

A URL is cut by pattern, not by a parser of the platform, so that hosts become
lower case, default ports go, dot segments are resolved and characters beyond
ASCII are escaped, whatever they are.  Rows are null where a URL has no scheme
or host.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions.columns import let, record

#: Fixed values.
TRACKING_NAMES = ("ref", "mc_eid", "_ga", "fbclid", "gclid")
TRACKING_PREFIX = "utm_"
ALLOWED_PORTS = (80, 443, 3000, 3001, 4000, 4173, 5000, 5173, 8000, 8080, 8443, 9099)
MOST_URL_CHARS = 2048
LOGIN_HINTS = ("/login", "/signin", "/sign-in", "/auth", "/oauth/authorize", "/accounts/login", "/session/new")
#: Blocks of addresses with their reasons; the first that holds an address decides.
IPV4_BLOCKS = (
    ("169.254.169.254", 32, "metadata_service"),
    ("100.100.100.200", 32, "metadata_service"),
    ("0.0.0.0", 8, "unspecified"),
    ("127.0.0.0", 8, "loopback"),
    ("10.0.0.0", 8, "private"),
    ("172.16.0.0", 12, "private"),
    ("192.168.0.0", 16, "private"),
    ("169.254.0.0", 16, "link_local"),
    ("100.64.0.0", 10, "private"),
    ("192.0.0.0", 24, "reserved"),
    ("192.0.2.0", 24, "reserved"),
    ("198.18.0.0", 15, "reserved"),
    ("198.51.100.0", 24, "reserved"),
    ("203.0.113.0", 24, "reserved"),
    ("255.255.255.255", 32, "broadcast"),
    ("224.0.0.0", 4, "multicast"),
    ("240.0.0.0", 4, "reserved"),
)
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*):\/\/([^\/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTHORITY = r"^(?:(.*)@)?(\[[0-9A-Fa-f:.]+\]|[^:@\s]*)(?::([0-9]*))?$"


def url_parts(url: Column) -> Column:
    """Struct (scheme, user, host, port, path, query) of an absolute URL; null without scheme or host, or with a space in the host."""

    def cut(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, _SHAPE, i)
        return let(record(scheme=F.lower(part(1)), authority=part(2), path=part(3), query=F.substring(part(4), 2, 1_000_000)), authority)

    def authority(p: Column) -> Column:
        part = lambda i: F.regexp_extract(p["authority"], _AUTHORITY, i)
        valid = p["authority"].rlike(_AUTHORITY) & (part(2) != "")
        return F.when(
            valid,
            record(scheme=p["scheme"], user=part(1), host=F.lower(part(2)), port=part(3).try_cast("int"), path=p["path"], query=p["query"]),
        )

    return F.when(F.trim(url).rlike(_SHAPE), let(F.trim(url), cut))


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", 443).otherwise(80)


def effective_port(parts: Column) -> Column:
    return F.coalesce(parts["port"], default_port(parts["scheme"]))


def is_tracking(name: Column) -> Column:
    return F.lower(name).isin(*TRACKING_NAMES) | F.startswith(F.lower(name), F.lit(TRACKING_PREFIX))


def escaped_path(path: Column) -> Column:
    """``path`` with dot segments resolved and characters that a path cannot hold escaped."""
    cooked = F.regexp_replace(path, r"\\", "/")
    chars = F.transform(F.split(cooked, ""), lambda c: F.when(c.rlike(r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    escaped = F.when(cooked.rlike(r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]"), F.array_join(chars, "")).otherwise(cooked)

    def resolve(p: Column) -> Column:
        segments = F.split(F.substring(p, 2, 1_000_000), "/", -1)
        push = lambda s, x: F.when(x.isin("..", "%2e%2e", "%2E%2E"), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x.isin(".", "%2e", "%2E"), s).otherwise(F.concat(s, F.array(x)))
        kept = F.aggregate(segments, F.array().cast("array<string>"), push)
        trailing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, trailing), "/"))

    return let(F.when(escaped == "", F.lit("/")).otherwise(escaped), lambda p: F.when(p.rlike(r"/\.{1,2}(/|$)|/%2[eE]"), resolve(p)).otherwise(p))


def clean_query(query: Column) -> Column:
    """The parameters that do not track, sorted by name and value, form-encoded; with the question mark, or empty."""
    decode = lambda t: F.coalesce(F.try_url_decode(t), t)
    pair = lambda p: record(n=decode(F.substring_index(p, "=", 1)), v=F.when(F.contains(p, F.lit("=")), decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))).otherwise(F.lit("")))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p["n"])))
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.when(query == "", F.lit("")).otherwise(let(text, lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("?"), t))))


def origin(parts: Column) -> Column:
    port = F.when(parts["port"].isNotNull() & (parts["port"] != default_port(parts["scheme"])), F.concat(F.lit(":"), parts["port"].cast("string"))).otherwise(F.lit(""))
    return F.concat(parts["scheme"], F.lit("://"), parts["host"], port)


def normalize_url(url: Column, strip_trailing_slash: bool = True) -> Column:
    """The canonical key of a URL: no fragment, no tracking parameters, sorted query, no trailing slash; null if it is none."""

    def build(p: Column) -> Column:
        path = escaped_path(p["path"])
        if strip_trailing_slash:
            path = let(path, lambda x: F.when(F.length(x) > 1, let(F.regexp_replace(x, "/+$", ""), lambda y: F.when(y == "", F.lit("/")).otherwise(y))).otherwise(x))
        return F.concat(origin(p), path, clean_query(p["query"]))

    return let(url_parts(url), lambda p: F.when(p.isNotNull(), build(p)))


def resolve_url(base: Column, ref: Column) -> Column:
    """``ref`` resolved against ``base``, normalised; null for empty references and other schemes than http(s)."""

    def join(b: Column) -> Column:
        folder = F.regexp_replace(b["path"], "[^/]*$", "")
        query = F.when(b["query"] != "", F.concat(F.lit("?"), b["query"])).otherwise(F.lit(""))
        path = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
        r = F.trim(ref)
        return (
            F.when(r.rlike(r"^https?://"), r)
            .when(r.rlike(r"(?i)^https?://"), r)
            .when(F.startswith(r, F.lit("//")), F.concat(b["scheme"], F.lit(":"), r))
            .when(F.startswith(r, F.lit("/")), F.concat(origin(b), r))
            .when(F.startswith(r, F.lit("?")), F.concat(origin(b), path, r))
            .when(F.startswith(r, F.lit("#")), F.concat(origin(b), path, query))
            .otherwise(F.concat(origin(b), F.when(folder == "", F.lit("/")).otherwise(folder), r))
        )

    other = F.trim(ref).rlike(r"(?i)^[a-z][a-z0-9+.\-]*:") & ~F.trim(ref).rlike(r"(?i)^https?://")
    joined = let(url_parts(base), lambda b: F.when(b.isNotNull(), join(b)))
    return F.when((F.trim(ref) != "") & ~other, let(joined, lambda u: normalize_url(u)))


@dataclass(frozen=True)
class CrawlScope:
    """Which URLs belong to a crawl: those of the seed's scheme, port and host (or its subdomains) below a base path."""

    include_subdomains: bool = False
    base_path: str = "/"

    def host_in(self, host: Column, seed_host: Column) -> Column:
        same = host == seed_host
        return (same | F.endswith(host, F.concat(F.lit("."), seed_host))) if self.include_subdomains else same

    def path_in(self, path: Column) -> Column:
        base = "/" + self.base_path.strip("/")
        return F.lit(True) if base == "/" else (path == base) | F.startswith(path, F.lit(base + "/"))

    def classify(self, url: Column, seed: Column) -> Column:
        """internal, external or invalid."""

        def judge(p: Column) -> Column:
            s, u = p["seed"], p["url"]
            inside = (u["scheme"] == s["scheme"]) & (effective_port(u) == effective_port(s)) & self.host_in(u["host"], s["host"]) & self.path_in(escaped_path(u["path"]))
            return F.when(u.isNull(), "invalid").when(inside, "internal").otherwise("external")

        return let(record(url=url_parts(url), seed=url_parts(seed)), judge)


def path_for_url(url: Column) -> Column:
    """The path of a URL, or the text itself if it is none."""
    return F.coalesce(let(url_parts(url), lambda p: F.when(p.isNotNull(), escaped_path(p["path"]))), url)


def normalize_url_input(raw: Column) -> Column:
    """Typed input as a URL: https where no scheme is given."""
    t = F.trim(raw)
    return F.when(t == "", "").when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), t).otherwise(F.concat(F.lit("https://"), t))


def validate_target_url(raw: Column) -> Column:
    """Struct (valid, reason, url, host) of typed input."""

    def judge(x: Column) -> Column:
        p = x["p"]
        no = lambda reason: record(valid=F.lit(False), reason=F.lit(reason), url=F.lit(None).cast("string"), host=F.lit(None).cast("string"))
        query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))
        href = F.regexp_replace(F.concat(origin(p), escaped_path(p["path"]), query), "/$", "")
        yes = record(valid=F.lit(True), reason=F.lit(None).cast("string"), url=href, host=p["host"])
        return F.when(F.trim(x["raw"]) == "", no("empty")).when(p.isNull(), no("invalid")).when(~p["scheme"].isin("http", "https"), no("scheme_rejected")).when(~F.contains(p["host"], F.lit(".")), no("missing_host")).otherwise(yes)

    return let(record(raw=F.coalesce(raw, F.lit("")), p=url_parts(normalize_url_input(raw))), judge)


def parse_ipv4(text: Column) -> Column:
    """The address as a whole number: one to four parts, each decimal, octal or hexadecimal, the last filling what is left; else null."""

    def value(p: Column) -> Column:
        return F.when(p.rlike("^0x[0-9a-fA-F]{1,12}$"), F.conv(F.substring(p, 3, 20), 16, 10).cast("bigint")).when(p.rlike("^0[0-7]{1,14}$"), F.conv(p, 8, 10).cast("bigint")).when(p.rlike("^[0-9]{1,15}$"), p.cast("bigint"))

    def add(parts: Column) -> Column:
        n = F.size(parts)
        last = F.element_at(parts, -1)
        room = F.element_at(F.array(*[F.lit(256**i) for i in (4, 3, 2, 1)]), n)
        heads = F.transform(F.slice(parts, 1, n - 1), lambda v, i: v * F.element_at(F.array(*[F.lit(256**k) for k in (3, 2, 1)]), i + 1))
        total = F.aggregate(heads, last, lambda a, b: a + b)
        good = ~F.exists(parts, lambda v: v.isNull()) & (last < room) & (total < 2**32)
        return F.when(good, total)

    pieces = F.split(F.trim(text), r"\.", -1)
    return F.when(F.size(pieces).between(1, 4), let(F.transform(pieces, value), add))


def _number(dotted: str) -> int:
    return int(ipaddress.IPv4Address(dotted))


def classify_ipv4(address: Column) -> Column:
    """Why an address is blocked; null if it is allowed or none."""
    reason = F.lit(None).cast("string")
    for base, bits, why in reversed(IPV4_BLOCKS):
        low = _number(base) >> (32 - bits) << (32 - bits)
        reason = F.when(address.between(low, low + 2 ** (32 - bits) - 1), why).otherwise(reason)
    return reason


def ipv6_reason(text: str) -> str | None:
    """Why an IPv6 address is blocked, empty if it is allowed; None if the text is no address."""
    try:
        a = ipaddress.IPv6Address(text.strip().strip("[]").partition("%")[0])
    except ValueError:
        return None
    value = int(a)
    if value < 2:
        return ("unspecified", "loopback")[value]
    inner = a.ipv4_mapped
    if inner is not None:
        for base, bits, why in IPV4_BLOCKS:
            if int(inner) >> (32 - bits) == _number(base) >> (32 - bits):
                return why
        return ""
    if a == ipaddress.IPv6Address("fd00:ec2::254"):
        return "metadata_service"
    for net, why in (("fc00::/7", "unique_local"), ("fe80::/10", "link_local"), ("ff00::/8", "multicast"), ("2001:db8::/32", "reserved")):
        if a in ipaddress.IPv6Network(net):
            return why
    return ""


@F.pandas_udf(StringType())
def classify_ipv6(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``ipv6_reason`` of each text."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else ipv6_reason(t))


def classify_ip_literal(host: Column) -> Column:
    """Struct (is_ip, reason) of a host, in brackets or not: whether it is an address, and why that is blocked (null if it is allowed)."""
    bare = F.regexp_replace(F.trim(host), r"^\[|\]$", "")
    v4 = parse_ipv4(bare)
    v6 = F.when(F.contains(bare, F.lit(":")), classify_ipv6(bare))

    def judge(x: Column) -> Column:
        return record(is_ip=x["v4"].isNotNull() | x["v6"].isNotNull(), reason=F.when(x["v4"].isNotNull(), classify_ipv4(x["v4"])).otherwise(F.nullif(x["v6"], F.lit(""))))

    return let(record(v4=v4, v6=v6), judge)


def screen_url(url: Column, trusted_origins: tuple[str, ...] = ()) -> Column:
    """Why a URL is denied by its shape, null if it passes: the first check that fails names the reason."""

    def judge(p: Column) -> Column:
        ip_reason = classify_ipv4(parse_ipv4(p["host"]))
        trusted = origin(p).isin(*trusted_origins) if trusted_origins else F.lit(False)
        lifted = trusted & ~is_never_trustable(ip_reason)
        return (
            F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "malformed_url")
            .when(F.length(url) > MOST_URL_CHARS, "url_too_long")
            .when(p.isNull(), "malformed_url")
            .when(~p["scheme"].isin("http", "https"), "scheme_rejected")
            .when(p["user"] != "", "credentials_in_url")
            .when(~effective_port(p).isin(*ALLOWED_PORTS), "port_rejected")
            .when(ip_reason.isNotNull() & ~lifted, "prohibited_ip")
        )

    return let(url_parts(url), judge)


def is_never_trustable(reason: Column) -> Column:
    return F.coalesce(reason.isin("metadata_service", "link_local"), F.lit(False))


def looks_like_login(url: Column) -> Column:
    """Whether the path of a URL holds a login hint."""
    lower = F.lower(path_for_url(url))
    hints = [F.contains(lower, F.lit(h)) for h in LOGIN_HINTS]
    out = hints[0]
    for h in hints[1:]:
        out = out | h
    return out


def cookie_domain(domain: Column) -> Column:
    """The domain of a cookie without its leading dot, in lower case."""
    return F.lower(F.regexp_replace(domain, r"^\.", ""))


def cookie_in_scope(domain: Column, host: Column) -> Column:
    """Whether a cookie of this domain goes to ``host``."""
    d, h = cookie_domain(domain), F.lower(host)
    return (d == h) | F.endswith(h, F.concat(F.lit("."), d))


def origin_in_scope(origin: Column, host: Column) -> Column:
    """Whether an origin's host is exactly ``host``; what is no URL is out of scope."""
    return F.coalesce(url_parts(origin)["host"] == F.lower(host), F.lit(False))


def join_url(base: Column, path: Column) -> Column:
    """One slash between ``base`` and ``path``."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
