"""String, path, JSON and markdown functions as column expressions."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.columns import let, record

#: Fixed values.
SECRET_KEY = r"(?i)(cookie|authorization|token|secret|password|passwd|pwd|session|set-cookie|bearer)"
API_KEY_FIELD = r"(?i)^(api[-_]?key|x[-_]?api[-_]?key|key)$"
REDACTED = "[redacted]"
CHARS_PER_TOKEN = 3.8
MODELS = (("small", 8_192, 1_024, 256), ("medium", 32_768, 4_096, 512), ("large", 128_000, 8_192, 1_024))
DEFAULT_MODEL = "medium"
CONTENT_TYPES = {
    "html": "text/html; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "js": "text/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8",
    "svg": "image/svg+xml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "ico": "image/x-icon",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "mp3": "audio/mpeg",
    "txt": "text/plain; charset=utf-8",
    "xml": "application/xml; charset=utf-8",
}


def collapse_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def slugify(s: Column, most: int = 64) -> Column:
    """Lower case, other characters than a-z and 0-9 as dashes, none at the ends, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def stable_id(prefix: Column, label: Column, suffix: Column) -> Column:
    return F.concat_ws("_", prefix, let(slugify(label), lambda x: F.when(x == "", "item").otherwise(x)), suffix)


def slug_segment(s: Column) -> Column:
    """A path segment for a file name; ``index`` if nothing is left."""
    return let(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""), lambda x: F.when(x == "", "index").otherwise(x))


def pascal_case(s: Column) -> Column:
    """Words joined, each with a capital first letter."""
    return F.array_join(F.transform(F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def sort_record(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def trim_to_null(s: Column, most: int) -> Column:
    return let(F.trim(s), lambda t: F.when(t != "", F.substring(t, 1, most)))


def string_array(json: Column) -> Column:
    """A JSON array of strings; empty for null, malformed text or other JSON."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def extract_json(t: Column) -> Column:
    """The text of an object or array: bare, or in the first fenced block; null else."""
    fenced = F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*\n(.*?)\s*```", 1))
    whole = F.trim(t)
    valid = lambda x: x.rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(x).isNotNull()
    return F.when(valid(whole), whole).when(valid(fenced), fenced)


def sanitize_data_url(t: Column) -> Column:
    return F.when(F.startswith(t, F.lit("data:")) & (F.length(t) > 500), "[DATA_URI_TRUNCATED]").otherwise(t)


def estimate_tokens(t: Column) -> Column:
    return F.ceil(F.length(t) / F.lit(CHARS_PER_TOKEN))


def narrative(summary: Column, notes: Column) -> Column:
    """Struct (summary, notes), cut; null if nothing is left."""
    kept = F.slice(F.filter(F.transform(notes, lambda n: F.substring(collapse_whitespace(n), 1, 240)), lambda n: n != ""), 1, 8)
    both = record(summary=F.substring(collapse_whitespace(summary), 1, 1200), notes=kept)
    return let(both, lambda b: F.when((b["summary"] != "") | (F.size(b["notes"]) > 0), b))


def redact_map(m: Column, api_keys: bool = False) -> Column:
    """A map with the values of secret-looking keys replaced."""
    hit = lambda k: k.rlike(SECRET_KEY) | k.rlike(API_KEY_FIELD) if api_keys else k.rlike(SECRET_KEY)
    return F.transform_values(m, lambda k, v: F.when(hit(k), REDACTED).otherwise(v))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the code points of trimmed text with plain line ends, as eight digits."""
    plain = F.trim(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lpad(F.lower(F.hex(F.aggregate(chars, F.lit(2166136261), step))), 8, "0")


def extension(path: Column) -> Column:
    """The lower-case extension of the last segment; empty for dot files and unsafe ones."""
    last = F.element_at(F.split(F.regexp_replace(path, "[?#].*$", ""), "/"), -1)
    return F.lower(F.regexp_extract(last, r"^[^.].*\.([A-Za-z0-9]+)$", 1))


def page_file(path: Column) -> Column:
    """The file of a page in an offline copy."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    name = F.array_join(F.transform(parts, lambda s: F.when(s.isin(".", ".."), "x").otherwise(slug_segment(s))), "_")
    return F.when(F.size(parts) == 0, "index.html").otherwise(F.concat(F.lit("pages/"), name, F.lit(".html")))


def asset_folder(kind: Column) -> Column:
    return F.when(kind == "image", "assets/images").when(kind == "font", "assets/fonts").when(kind.isin("video", "audio"), "assets/media").otherwise("assets")


def asset_file(path: Column, kind: Column, digest: Column) -> Column:
    """Folder, slug of the name, eight digits of the hash, extension."""
    last = F.element_at(F.split(path, "/"), -1)
    base = slug_segment(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""))
    ext = let(extension(path), lambda e: F.when(e == "", "bin").otherwise(e))
    return F.concat(asset_folder(kind), F.lit("/"), base, F.lit("_"), F.substring(digest, 1, 8), F.lit("."), ext)


def relative_prefix(page: Column) -> Column:
    return F.repeat(F.lit("../"), F.size(F.split(page, "/")) - 1)


def is_safe_relative(path: Column) -> Column:
    """No empty path, no leading slash, no backslash, no dot segment."""
    segments = F.split(path, "/", -1)
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & F.forall(segments, lambda s: ~s.isin("", ".", ".."))


def is_safe_project_path(path: Column) -> Column:
    return is_safe_relative(path) & ~path.rlike(r"^[A-Za-z]:|[\x00-\x1F\x7F]")


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def resolve_within(path: Column) -> Column:
    """Dot segments collapsed; null if the path leaves its root."""
    start = record(out=F.array().cast("array<string>"), ok=F.lit(True))

    def push(s: Column, x: Column) -> Column:
        return (
            F.when(x.isin("", "."), s)
            .when(x == "..", record(out=F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), ok=s["ok"] & (F.size(s["out"]) > 0)))
            .otherwise(record(out=F.concat(s["out"], F.array(x)), ok=s["ok"]))
        )

    return F.aggregate(F.split(path, "/", -1), start, push, lambda s: F.when(s["ok"], F.array_join(s["out"], "/")))


def serve_path(raw: Column) -> Column:
    """Struct (ok, relative, reason) of a requested path; the first check that fails names the reason."""
    decoded = F.try_url_decode(F.replace(F.regexp_replace(raw, "[?#].*$", ""), F.lit("+"), F.lit("%2B")))

    def judge(d: Column) -> Column:
        segments = F.filter(F.split(d, "/"), lambda s: s != "")
        no = lambda r: record(ok=F.lit(False), relative=F.lit(None).cast("string"), reason=F.lit(r))
        name = F.when(F.size(segments) == 0, "index.html").otherwise(F.array_join(segments, "/"))
        return (
            F.when(F.coalesce(raw, F.lit("")) == "", no("empty_path"))
            .when(F.contains(raw, F.lit("\x00")), no("nul_byte"))
            .when(d.isNull(), no("malformed_encoding"))
            .when(F.contains(d, F.lit("\x00")), no("nul_byte"))
            .when(F.contains(d, F.lit("\\")), no("backslash"))
            .when(~F.startswith(d, F.lit("/")), no("not_absolute_path"))
            .when(F.exists(segments, lambda s: s.isin(".", "..")), no("traversal"))
            .otherwise(record(ok=F.lit(True), relative=name, reason=F.lit(None).cast("string")))
        )

    return let(decoded, judge)


def content_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return reduce(lambda c, kv: F.when(ext == kv[0], kv[1]).otherwise(c), CONTENT_TYPES.items(), F.lit("application/octet-stream"))


def asset_type(hint: Column, mime: Column) -> Column:
    m = F.lower(mime)
    has = lambda t: F.contains(m, F.lit(t))
    return (
        F.when(has("css") | (hint == "stylesheet"), "stylesheet")
        .when(has("javascript") | (hint == "script"), "script")
        .when(has("font") | has("woff") | (hint == "font"), "font")
        .when(F.startswith(m, F.lit("image/")) | (hint == "image"), "image")
        .when(F.startswith(m, F.lit("video/")), "video")
        .when(F.startswith(m, F.lit("audio/")), "audio")
        .when(has("json") | has("xml"), "document")
        .otherwise("other")
    )


def code_span(t: Column) -> Column:
    """Markdown code, in a fence one longer than the longest run of back ticks inside."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
    return let(F.repeat(F.lit("`"), longest + 1), lambda f: F.concat(f, F.when(F.contains(t, F.lit("`")), F.concat(F.lit(" "), t, F.lit(" "))).otherwise(t), f))


def table_cell(t: Column) -> Column:
    return F.replace(F.replace(collapse_whitespace(t), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def is_markdown_like(t: Column) -> Column:
    return t.rlike(r"(?:^|\n)#{1,6}\s") | t.rlike(r"(?:^|\n)[-*]\s") | t.rlike(r"\[[^\]]+\]\([^)]+\)") | t.rlike(r"(?:^|\n)>\s")


def box_values(t: Column) -> Column:
    return F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != "")


def font_stack(t: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(t, ","), lambda f: F.trim(F.regexp_replace(f, "[\"']", ""))), lambda f: f != ""))


def clamp(x: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.coalesce(x, F.lit(default)))))


def session_key(password: str, salt: bytes) -> bytes:
    """The key that session states are sealed with; derived on the driver."""
    return hashlib.pbkdf2_hmac("sha512", password.encode(), salt, 100_000, 32)


def sealed(text: Column, key: bytes) -> Column:
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"))


def unsealed(data: Column, key: bytes) -> Column:
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM")).cast("string")
