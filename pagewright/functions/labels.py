"""Names and labels: titles, sizes, times, colours, forms, files and headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.columns import let, record
from pagewright.functions.text import is_safe_project_path, slug_segment, slugify
from pagewright.functions.urls import url_parts

#: Names of colours that mean a role.
SEMANTIC_COLORS = ("primary", "secondary", "accent", "background", "foreground", "muted", "border", "card", "surface", "danger", "destructive", "success", "warning", "info")
#: Methods that a form may have; rules by the attribute that asks for them.
METHODS = ("GET", "POST", "PUT", "DELETE")
RULES = {"minlength": "min_length", "maxlength": "max_length"}
#: Extensions by media type.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "font/woff": "woff", "font/woff2": "woff2", "application/json": "json"}
#: Limits of a crawl as (default, most); the least is 0 for depth, retries and redirects, else 1.
CRAWL_LIMITS = {"max_pages": (50, 200), "max_depth": (2, 6), "max_concurrency": (1, 1), "max_redirects": (5, 5), "batch_size": (20, 100), "progress_every": (5, 50), "max_failures": (20, 50), "max_retries": (1, 3)}


def title_template(title: Column, site: Column) -> Column:
    """``%s | suffix`` of a title that a bar or dash parts, else with the site's name; empty without either."""
    suffix = F.trim(F.regexp_extract(title, r"^.+?\s*[|\-–—]\s*(.+)$", 1))
    shown = lambda name: F.when(name != "", F.concat(F.lit("%s | "), name)).otherwise(F.lit(""))
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).when(suffix != "", shown(suffix)).otherwise(shown(site))


def shown_bytes(n: Column) -> Column:
    of = lambda size, unit: F.format_string(f"%.1f {unit}", n / F.lit(float(size)))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, of(1 << 10, "KB")).otherwise(of(1 << 20, "MB"))


def parsed_time(text: Column) -> Column:
    """A time from either way of writing it; without a zone it is UTC (the session's zone); null where it is none."""
    return F.try_to_timestamp(text)


def color_variable(name: Column) -> Column:
    """Struct (base, scale) of a custom property's name; null for other names."""
    body = F.substring(name, 3, 1_000_000)
    shape = r"(?i)^([a-z0-9]+)(?:[-_]([a-z0-9]+))?$"
    first, second = (F.lower(F.regexp_extract(body, shape, i)) for i in (1, 2))
    known = first.isin(*SEMANTIC_COLORS)
    plain = lambda t: let(slugify(t), lambda s: F.when(s == "", F.lit("color")).otherwise(s))
    scaled = second.rlike(r"^\d+$")
    base = F.when(known & (first != ""), first).when(scaled, plain(F.regexp_replace(body, r"[-_]\d+$", ""))).otherwise(plain(body))
    return F.when(F.startswith(name, F.lit("--")), record(base=base, scale=F.when(scaled, second)))


def http_method(text: Column) -> Column:
    return let(F.upper(text), lambda m: F.when(m.isin(*METHODS), m).otherwise(F.lit("GET")))


def validations(attributes: Column) -> Column:
    """Rules of a map of attributes, by the attribute's name: structs (rule, value), the value where it is a number."""
    rule = lambda k: reduce(lambda c, kv: F.when(k == kv[0], kv[1]).otherwise(c), RULES.items(), k)
    value = lambda v: F.when(v.rlike(r"^-?\d+(\.\d+)?$"), v.cast("double"))
    return F.transform(F.array_sort(F.map_entries(attributes)), lambda e: record(rule=rule(e["key"]), value=value(e["value"])))


def form_identity(name: Column, given: Column, number: Column) -> Column:
    """Struct (id, name): a form's name is its own, else its id, else its number."""
    own = F.when(name != "", name).when(given != "", given).otherwise(F.concat(F.lit("form_"), number.cast("string")))
    return let(own, lambda n: record(id=F.concat(F.lit("form_"), let(slugify(n), lambda s: F.when(s == "", F.concat(F.lit("form_"), number.cast("string"))).otherwise(s))), name=n))


def _capitals(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(text, "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def _named(text: Column, fallback: str) -> Column:
    return let(_capitals(text), lambda p: F.when(p == "", F.lit(fallback)).when(p.rlike("^[0-9]"), F.concat(F.lit(fallback), p)).otherwise(p))


def page_identifier(text: Column) -> Column:
    return _named(text, "Page")


def component_identifier(name: Column, identity: Column) -> Column:
    """A name for code: of the component's name, else of its id, else Component."""
    source = F.when(_capitals(name) != "", name).otherwise(identity)
    return _named(source, "Component")


def base_name(path: Column) -> Column:
    return F.trim(F.element_at(F.split(path, r"[\\/]", -1), -1))


def component_file(file: Column, name: Column) -> Column:
    """The last part of ``file`` if it is a source file, else the name with its extension."""
    own = base_name(F.regexp_replace(file, r"[\x00-\x1F\x7F]", ""))
    return F.when(own.rlike(r"\.tsx?$"), own).otherwise(F.concat(name, F.lit(".tsx")))


def hook_file(file: Column, name: Column) -> Column:
    own = base_name(file)
    return F.when(own.rlike(r"\.tsx?$") & is_safe_project_path(own), own).otherwise(F.concat(slug_segment(name), F.lit(".ts")))


def doc_file(name: Column) -> Column:
    stem = F.regexp_replace(base_name(name), r"(?i)\.md$", "")
    return F.concat(F.upper(slug_segment(F.when(stem == "", F.lit("doc")).otherwise(stem))), F.lit(".md"))


def project_name(text: Column, fallback: str = "generated-app") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return let(cleaned, lambda c: F.when(c == "", F.lit(fallback)).otherwise(c))


def safe_extension(value: Column) -> Column:
    """The extension of the last part of a path, of ten letters and digits at most; empty without one."""
    last = F.element_at(F.split(F.regexp_extract(value, "^[^?#]*", 0), "/", -1), -1)
    return F.lower(F.regexp_extract(last, r"(?i)^.+\.([a-z0-9]{1,10})$", 1))


def extension_of_type(mime: Column) -> Column:
    return reduce(lambda c, kv: F.when(F.lower(mime) == kv[0], kv[1]).otherwise(c), EXTENSIONS.items(), F.lit(""))


def public_asset(hint: Column, mime: Column) -> Column:
    """The path of an asset in a generated project; equal ones are told apart by ``site.suffixed``."""
    raw = base_name(hint)
    own = safe_extension(raw)
    stem = F.when(own != "", F.regexp_replace(raw, r"\.[^.]*$", "")).otherwise(raw)
    ext = F.when(own != "", own).otherwise(extension_of_type(F.coalesce(mime, F.lit(""))))
    name = slug_segment(F.when(stem == "", F.lit("asset")).otherwise(stem))
    return F.concat(F.lit("public/assets/"), name, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))


def type_allowed(content_type: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a response of this type is taken; one without a type is taken as HTML."""
    plain = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.when(F.coalesce(content_type, F.lit("")) == "", F.lit("text/html" in allowed)).otherwise(plain.isin(*allowed))


def cookie_name(header: Column) -> Column:
    return let(F.trim(F.substring_index(header, "=", 1)), lambda n: F.when(n != "", n))


def base_url_error(url: Column) -> Column:
    """Why a service address cannot be used; null if it can."""
    text = F.trim(url)
    parts = url_parts(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "required")
        .when(text.rlike(r"\s"), "whitespace")
        .when(~text.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), "not_absolute")
        .when(~text.rlike(r"(?i)^https?:"), "scheme")
        .when(parts.isNull(), "not_absolute")
        .when(parts["user"] != "", "credentials")
    )


def normal_base_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def crawl_limit(name: str, wanted: Column) -> Column:
    """A limit of a crawl: the default where none is given, within its bounds."""
    default, most = CRAWL_LIMITS[name]
    least = 0 if name in ("max_depth", "max_retries", "max_redirects") else 1
    given = F.coalesce(F.nanvl(wanted.cast("double"), F.lit(None).cast("double")), F.lit(float(default)))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(given)))
