"""Event streams: decoding, validation, folding per key, windows.

Late rows beyond the watermark are dropped by Spark; the watermark is ours, as
are windows.  The fold keeps one small state per key and gives it up when nothing
has come for the key for some time, soon after a terminal status, so the states
that are held are those of keys that are alive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bytes of a frame at most, the protocol's version, how late an event may be.
MOST_FRAME_BYTES, FRAME_VERSION, LATENESS = 1 << 20, 1, "10 minutes"
FRAME = "version int, type string, id string, payload string"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of text as frames; what cannot be decoded has a reason."""
    reader = spark.readStream if streaming else spark.read
    return decode_frames(reader.text(path))


def decode_frames(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with frame and reason: oversize, malformed, bad_version, missing_type, or null."""
    frame = F.from_json(line, FRAME)
    reason = (
        F.when(F.octet_length(line) > MOST_FRAME_BYTES, "oversize")
        .when(F.try_parse_json(line).isNull() | ~F.startswith(F.trim(line), F.lit("{")), "malformed")
        .when(F.coalesce(F.col("frame.version"), F.lit(-1)) != FRAME_VERSION, "bad_version")
        .when(F.coalesce(F.col("frame.type"), F.lit("")) == "", "missing_type")
    )
    return lines.withColumn("frame", frame).withColumn("reason", reason)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files with a watermark, each event once."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: rows no further apart than ``gap``."""
    sums = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return sums.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


FOLDED = "user_id bigint, scanned bigint, failed bigint, last_event bigint, status string"
#: What the last event of a key makes of it, and the states after which nothing more is awaited.
STATUS, TERMINAL = {"signup": "pending", "purchase": "completed"}, ("completed",)
#: How long the state of a key is kept after its last event, in milliseconds of event time: of one that is done, and of any other.
DONE_KEPT, IDLE_KEPT = 10 * 60_000, 24 * 3_600_000


def fold_scans(events: DataFrame, done_kept: int = DONE_KEPT, idle_kept: int = IDLE_KEPT, lateness: str | None = LATENESS) -> DataFrame:
    """The state of each scan after each batch: counts, the last event and a status.

    A state is removed when the watermark (``lateness``; None if ``events`` has one)
    is ``done_kept`` beyond the last event of a key that is done, or ``idle_kept``
    beyond that of any other.  Counts of a key whose events go on after that are
    those since; ``fold_scans_batch`` has the counts over all rows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scanned, failed, last, status = state.get if state.exists else (0, 0, -1, "pending")
        newest_ms = state.getCurrentWatermarkMs()
        for rows in batches:
            scanned += int((rows["event_type"] == "view").sum())
            failed += int((rows["event_type"] == "error").sum())
            newest_ms = max(newest_ms, int(rows["_ms"].max()))
            newest = rows.loc[rows["event_id"].idxmax()]
            if int(newest["event_id"]) > last:
                last = int(newest["event_id"])
                status = STATUS.get(newest["event_type"], "in_progress")
        state.update((scanned, failed, last, status))
        state.setTimeoutTimestamp(newest_ms + (done_kept if status in TERMINAL else idle_kept))
        yield pd.DataFrame([(key[0], scanned, failed, last, status)], columns=["user_id", "scanned", "failed", "last_event", "status"])

    kept = "scanned bigint, failed bigint, last_event bigint, status string"
    marked = (events if lateness is None else events.withWatermark("ts", lateness)).withColumn("_ms", F.unix_millis("ts"))
    return marked.groupBy("user_id").applyInPandasWithState(step, FOLDED, kept, "update", GroupStateTimeout.EventTimeTimeout)


def fold_scans_batch(events: DataFrame) -> DataFrame:
    """What the fold has at the end, by aggregates alone."""
    of = lambda k: F.count_if(F.col("event_type") == k)
    last = F.max_by("event_type", "event_id")
    status = F.when(last == "signup", "pending").when(last == "purchase", "completed").otherwise("in_progress")
    return events.groupBy("user_id").agg(of("view").alias("scanned"), of("error").alias("failed"), F.max("event_id").alias("last_event"), status.alias("status"))


def answered(commands: DataFrame, results: DataFrame, within: str = "1 hour") -> DataFrame:
    """Commands (id, ts) with their results (id, ts) no later than ``within``; works on streams with watermarks."""
    c = commands.select(F.col("id"), F.col("ts").alias("asked"))
    r = results.select(F.col("id").alias("_id"), F.col("ts").alias("replied"))
    on = (F.col("id") == F.col("_id")) & (F.col("replied") >= F.col("asked")) & (F.col("replied") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return c.join(r, on).drop("_id")


def accumulate(deltas: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """The text of each key, its pieces joined in order; a key's pieces are one message."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return deltas.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"))


_CLOSED_BY = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")


def closes_in_order(code: str | None) -> bool | None:
    """Whether brackets of all kinds close in order: one pass with the open ones on a stack."""
    if code is None:
        return None
    open_: list[str] = []
    for mark in _BRACKET.findall(code):
        if mark not in _CLOSED_BY:
            open_.append(mark)
        elif not open_ or open_.pop() != _CLOSED_BY[mark]:
            return False
    return not open_


def balanced(code: Column) -> Column:
    """Whether brackets of all kinds close in order; null for null.

    A stack has no form among the built-in functions that would not copy it at
    every bracket, so texts go through Arrow in batches.
    """
    check = F.pandas_udf(lambda texts: texts.map(closes_in_order).astype("boolean"), "boolean")
    return check(code)


#: What generated code must not hold.
FORBIDDEN = (
    ("SCRIPT_TAG", r"(?i)<\s*script\b"),
    ("DANGEROUS_HTML", "dangerouslySetInnerHTML"),
    ("EVAL_USAGE", r"\beval\s*\("),
    ("FUNCTION_CONSTRUCTOR", r"\bnew\s+Function\s*\("),
    ("REQUIRE_USAGE", r"\brequire\s*\("),
    ("DYNAMIC_IMPORT", r"\bimport\s*\("),
    ("PROCESS_ENV", r"\bprocess\.env\b"),
    ("DOCUMENT_WRITE", r"\bdocument\.write\s*\("),
    ("STYLE_TAG", r"(?i)<\s*style\b"),
    ("GLOBAL_WINDOW_ACCESS", r"\bwindow\["),
    ("CONVERSATIONAL_FILLER", r"(?im)^(Here|Sure|Certainly|Of course)\b"),
    ("MARKDOWN_FENCE", "```"),
    ("TODO_COMMENT", r"(?i)//\s*(?:TODO|FIXME|XXX)\b"),
    ("PLACEHOLDER_COMMENT", r"(?i)//\s*(?:rest of|existing|your)\b"),
    ("BLOCK_COMMENT", r"(?s)/\*.*?\*/"),
    ("ANY_TYPE", r":\s*any\b"),
    ("TS_IGNORE", r"@ts-(?:ignore|nocheck|expect-error)"),
    ("NON_NULL_ASSERTION", r"[A-Za-z0-9_)\]]\s*!\s*[.,;)]"),
    ("CONSOLE_CALL", r"\bconsole\.\w+\s*\("),
    ("DEBUGGER", r"\bdebugger\b"),
    ("ALERT_CALL", r"\balert\s*\("),
    ("EMPTY_HANDLER", r"=>\s*\{\s*\}"),
)


#: The deepest nesting of braces that generated code may have.
MOST_DEPTH = 40


def brace_depth(code: Column) -> Column:
    """The largest number of braces that are open at one place."""
    marks = F.filter(F.split(code, ""), lambda c: c.isin("{", "}"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, count, lambda s: s["most"])


def declares(code: Column, name: Column) -> Column:
    """Whether the code declares ``name`` as a function or as a constant."""
    word = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))  # an end of quotation inside a name is itself quoted
    function = F.concat(F.lit(r"\bfunction\s+"), word, F.lit(r"\s*\("))
    constant = F.concat(F.lit(r"\b(?:const|let)\s+"), word, F.lit(r"\s*[=:]"))
    return F.regexp_like(code, function) | F.regexp_like(code, constant)


_IMPORT = r"""import\s+(?:type\s+)?([^'";]+?)\s+from\s+['"][^'"]+['"];?"""


def unused_imports(code: Column) -> Column:
    """Names that an import brings in and that the rest of the code does not mention."""
    whole, clauses = (F.regexp_extract_all(code, F.lit(_IMPORT), F.lit(i)) for i in (0, 1))
    local = lambda part: F.regexp_replace(F.trim(part), r"^(?:type\s+)?(?:.*\s+as\s+)?", "")
    names = lambda clause: F.filter(F.transform(F.split(F.regexp_replace(clause, r"[{}]", ","), ","), local), lambda n: n.rlike(r"^[\w$]+$"))
    mentioned = lambda statement, n: F.regexp_like(F.replace(code, statement, F.lit("")), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b")))
    each = F.zip_with(whole, clauses, lambda w, c: F.filter(names(c), lambda n: ~mentioned(w, n)))
    return F.flatten(each)


def tidy_code(code: Column) -> Column:
    """The code with its leading imports sorted, single blank lines and one line end at its end."""
    lines = F.transform(F.split(F.replace(F.regexp_replace(code, "\r\n?", "\n"), F.lit("\t"), F.lit("  ")), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    start = F.struct(F.array().cast("array<string>").alias("imports"), F.array().cast("array<string>").alias("rest"), F.lit(False).alias("past"), F.lit(True).alias("blank"))

    def take(s: Column, x: Column) -> Column:
        is_import = ~s["past"] & x.rlike(r"^\s*import\b")
        empty = x == ""
        skipped = empty & s["blank"]
        rest = F.when(is_import | skipped, s["rest"]).otherwise(F.concat(s["rest"], F.array(x)))
        imports = F.when(is_import, F.concat(s["imports"], F.array(x))).otherwise(s["imports"])
        blank = F.when(is_import, s["blank"]).otherwise(empty)
        return F.struct(imports.alias("imports"), rest.alias("rest"), (s["past"] | (~is_import & ~empty)).alias("past"), blank.alias("blank"))

    head = lambda s: F.when(F.size(s["imports"]) > 0, F.concat(F.array_join(F.array_sort(s["imports"]), "\n"), F.lit("\n\n"))).otherwise("")
    whole = F.aggregate(lines, start, take, lambda s: F.concat(head(s), F.array_join(s["rest"], "\n")))
    return F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n"))


def code_violations(code: Column, name: Column | None = None) -> Column:
    """Names of what generated code must not hold, in order; with ``name``, whether it declares that component."""
    hits = [F.when(code.rlike(pattern), label) for label, pattern in FORBIDDEN]
    hits.append(F.when(~F.coalesce(balanced(code), F.lit(True)), "UNBALANCED_DELIMITERS"))
    if name is not None:
        hits += [F.when(brace_depth(code) > MOST_DEPTH, "EXCESSIVE_NESTING"), F.when(~declares(code, name), "MISSING_COMPONENT_DECLARATION"), F.when(F.size(unused_imports(code)) > 0, "UNUSED_IMPORT")]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())
