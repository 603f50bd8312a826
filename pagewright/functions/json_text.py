"""Functions of nested JSON text whose depth no schema knows; Arrow batches, one small function per value."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from pagewright.functions.text import API_KEY_FIELD, REDACTED, SECRET_KEY

#: Fixed values.
DATA_URL_CHARS, DATA_URL_MARK = 500, "[DATA_URI_TRUNCATED]"
_SECRET, _API_KEY = re.compile(SECRET_KEY), re.compile(API_KEY_FIELD)


def _walk(value, on_key: Callable[[str], bool], on_text: Callable[[str], str]):
    if isinstance(value, dict):
        return {k: REDACTED if on_key(k) else _walk(v, on_key, on_text) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, on_key, on_text) for v in value]
    return on_text(value) if isinstance(value, str) else value


def _rewritten(texts: Iterator[pd.Series], change: Callable, sort: bool = False) -> Iterator[pd.Series]:
    """Each JSON text after ``change``, without white space; null where it is none."""

    def one(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        return json.dumps(change(value), sort_keys=sort, ensure_ascii=False, separators=(",", ":"))

    for batch in texts:
        yield batch.map(one, na_action=None).astype(object)


@pandas_udf(StringType())
def redact_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Values under keys that name secrets replaced, at any depth."""
    return _rewritten(texts, lambda v: _walk(v, lambda k: bool(_SECRET.search(k)), lambda t: t))


@pandas_udf(StringType())
def scrub_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As ``redact_json``, and fields named as API keys too."""
    return _rewritten(texts, lambda v: _walk(v, lambda k: bool(_SECRET.search(k) or _API_KEY.search(k)), lambda t: t))


@pandas_udf(StringType())
def without_data_urls(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Long data URLs replaced by a mark, at any depth."""
    short = lambda t: DATA_URL_MARK if t.startswith("data:") and len(t) > DATA_URL_CHARS else t
    return _rewritten(texts, lambda v: _walk(v, lambda k: False, short))


@pandas_udf(StringType())
def sorted_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same value with sorted keys at any depth."""
    return _rewritten(texts, lambda v: v, sort=True)
