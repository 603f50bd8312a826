"""Style sheets read by one tokenizer: comments, strings, url() and nested rules, in a single pass over each sheet."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
_TOKEN = re.compile(rf"(?P<comment>/\*.*?(?:\*/|\Z))|(?P<url>url\(\s*(?:(?:{_STRING})\s*\)|[^)\"']*\)))|(?P<string>{_STRING})|(?P<mark>[{{}};])|(?P<open>[(\[])|(?P<close>[)\]])|(?P<text>(?:[^/\"'{{}};()\[\]uU]|[uU](?!rl\()|/(?!\*))+|.)", re.DOTALL | re.IGNORECASE)
_NAME = re.compile(r"@(-?[\w-]+)")

DECLARATIONS = "seq int, block int, depth int, rule string, selector string, media string, property string, value string, urls array<string>"
_COLUMNS = [("seq", pa.int32()), ("block", pa.int32()), ("depth", pa.int32()), ("rule", pa.string()), ("selector", pa.string()), ("media", pa.string()), ("property", pa.string()), ("value", pa.string()), ("urls", pa.list_(pa.string()))]


def url_target(token: str) -> str:
    """What a url() or a quoted string names."""
    inner = token[4:].rstrip(")").strip() if token[:4].lower() == "url(" else token
    if inner[:1] in ("'", '"'):
        inner = inner[1:-1] if len(inner) > 1 and inner[-1] == inner[0] else inner[1:]
        return re.sub(r"\\(.)", r"\1", inner)
    return inner


def declarations(sheet: str | None) -> Iterator[tuple]:
    """Rows of DECLARATIONS: each declaration with the rule it stands in, and each statement such as @import.

    Selectors of nested rules are joined by spaces, conditions of media by ``and``;
    a block or a comment that never ends ends with the sheet, and an end without a
    block is passed over.
    """
    stack: list[tuple[int, str, str]] = []  # number, name of an at-rule or "", prelude
    text: list[str] = []
    urls: list[str] = []
    seq = blocks = brackets = 0

    def ended() -> Iterator[tuple]:
        nonlocal seq
        whole = " ".join("".join(text).split())
        found, urls[:] = list(urls), []
        text.clear()
        if not whole:
            return
        media = " and ".join(p for _, name, p in stack if name == "media")
        selector = " ".join(p for _, name, p in stack if not name)
        rule = stack[-1][1] if stack else ""
        block = stack[-1][0] if stack else 0
        if whole[0] == "@":
            name = _NAME.match(whole)
            if name:
                yield seq, block, len(stack), rule, selector, media, "@" + name[1].lower(), whole[name.end() :].strip(), found
                seq += 1
            return
        prop, colon, value = whole.partition(":")
        if colon and stack:
            prop = prop.strip()
            yield seq, block, len(stack), rule, selector, media, prop if prop.startswith("--") else prop.lower(), value.strip(), found
            seq += 1

    for m in _TOKEN.finditer(sheet or ""):
        kind, token = m.lastgroup, m[0]
        if kind == "comment":
            text.append(" ")
        elif kind == "mark" and not brackets:
            if token == "{":
                prelude = " ".join("".join(text).split())
                text.clear()
                urls.clear()
                blocks += 1
                name = _NAME.match(prelude)
                stack.append((blocks, name[1].lower() if name else "", prelude[name.end() :].strip() if name else prelude))
            else:
                yield from ended()
                if token == "}" and stack:
                    stack.pop()
        else:
            if kind == "url" or (kind == "string" and "".join(text).strip().lower() == "@import"):
                urls.append(url_target(token))
            brackets = max(0, brackets + (kind == "open") - (kind == "close"))
            text.append(token)
            if token == "}" and brackets:  # a bracket that is never closed does not swallow the sheet
                brackets = 0
                text.pop()
                yield from ended()
                if stack:
                    stack.pop()
    yield from ended()


def sheet_declarations(sheets: DataFrame, key: str, css: str = "css") -> DataFrame:
    """Rows (key, *DECLARATIONS) of each sheet, a sheet at a time."""
    names = [n for n, _ in _COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, held = [], []
            for i, text in enumerate(batch.column("css").to_pylist()):
                for row in declarations(text):
                    owners.append(i)
                    held.append(row)
                    if len(held) >= 20_000:
                        yield made(batch, owners, held)
                        owners, held = [], []
            if held:
                yield made(batch, owners, held)

    def made(batch: pa.RecordBatch, owners: list[int], held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _COLUMNS, strict=True)]
        return pa.record_batch([batch.column("key").take(pa.array(owners, pa.int64())), *columns], ["key", *names])

    kind = sheets.schema[key].dataType.simpleString()
    return sheets.select(F.col(key).alias("key"), F.col(css).alias("css")).mapInArrow(run, f"key {kind}, {DECLARATIONS}").withColumnRenamed("key", key)


def custom_properties(rows: DataFrame, by: str) -> DataFrame:
    """Custom properties of rules that stand in no other rule, the first value of a name: (by, name, value)."""
    own = rows.where((F.col("depth") == 1) & F.startswith("property", F.lit("--")) & (F.col("rule") == ""))
    return own.groupBy(by, F.col("property").alias("name")).agg(F.min_by("value", "seq").alias("value"))


def font_faces(rows: DataFrame, by: str) -> DataFrame:
    """Font faces by their descriptors, each once: (by, family, weight, style)."""
    of = lambda name, other: F.coalesce(F.max_by(F.when(F.col("property") == name, F.col("value")), F.when(F.col("property") == name, F.col("seq"))), F.lit(other))
    blocks = rows.where("rule = 'font-face'").groupBy(by, "block").agg(of("font-family", "").alias("family"), of("font-weight", "normal").alias("weight"), of("font-style", "normal").alias("style"))
    return blocks.select(by, F.regexp_replace("family", r"""^["']|["']$""", "").alias("family"), "weight", "style").distinct()


def media_widths(rows: DataFrame, by: str) -> DataFrame:
    """Widths in pixels that conditions of media name, in order: (by, widths)."""
    each = rows.where("media <> ''").select(by, F.explode(F.regexp_extract_all("media", F.lit(r"(?i)(\d+(?:\.\d+)?)px"), F.lit(1))).alias("w"))
    return each.groupBy(by).agg(F.array_sort(F.collect_set(F.round(F.col("w").cast("double")).cast("int"))).alias("widths"))


def rewritten(sheet: str | None, change: Callable[[str], str | None]) -> str | None:
    """A sheet whose url() targets and imports are what ``change`` makes of them (None: as they are); comments and other strings stay."""
    if sheet is None:
        return None
    out: list[str] = []
    charset, importing = False, False
    for m in _TOKEN.finditer(sheet):
        kind, token = m.lastgroup, m[0]
        if kind == "url" or (kind == "string" and importing):
            new = change(url_target(token))
            if new is not None:
                quote = "'" if re.match(r"url\(\s*'", token, re.IGNORECASE) or token[0] == "'" else '"'
                safe = re.sub(rf"([\\{quote}])", r"\\\1", new)
                token = f"url({quote}{safe}{quote})"
        if kind == "text":
            so_far = ("".join(out[-12:]) + token).rstrip().lower()
            importing = so_far.endswith("@import")
        elif kind != "comment":
            importing = False
        out.append(token)
    text = "".join(out)
    if text.lower().count("@charset") > 1:
        parts = re.split(r"""(?i)(@charset\s+(?:"[^"]*"|'[^']*')\s*;)""", text)
        kept = []
        for part in parts:
            if part[:8].lower() == "@charset":
                if charset:
                    continue
                charset = True
            kept.append(part)
        text = "".join(kept)
    return text


def rewritten_sheets(sheets: DataFrame, key: str, css: str = "css", local: str = "local", prefix: str = "prefix") -> DataFrame:
    """Rows (key, css): sheets with targets that the map ``local`` knows replaced by prefix and place in the copy.

    Targets are looked up as they are, and without a leading ``/`` or ``./``; data
    and fragments stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, known, before in zip(*(batch.column(c).to_pylist() for c in ("css", "local", "prefix")), strict=True):
                places = dict(known or ())

                def change(target: str, places=places, before=before or "") -> str | None:
                    if target.startswith(("data:", "#")):
                        return None
                    place = next((places[t] for t in (target, target.removeprefix("/"), target.removeprefix("./")) if t in places), None)
                    return None if place is None else before + place

                out.append(rewritten(text, change))
            yield pa.record_batch([batch.column("key"), pa.array(out, pa.string())], ["key", "css"])

    kind = sheets.schema[key].dataType.simpleString()
    own = sheets.select(F.col(key).alias("key"), F.col(css).alias("css"), F.col(local).alias("local"), F.col(prefix).alias("prefix"))
    return own.mapInArrow(run, f"key {kind}, css string").withColumnRenamed("key", key)


def style_elements(html: Column) -> Column:
    """The text of a page's style elements, one after another."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1)), "\n")
