"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens of many texts lie in one flat array of symbols.  In each round every
sequence finds the lowest rank among its neighbouring pairs and merges all
occurrences of that pair at once; sequences without a mergeable pair leave, and
what is left of a sequence is its number of tokens.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.arrow import pieces
from pagewright.plans.session import table

NAME = "op7_token_counts"
ORACLE_SQL = None

#: Fixed value: how texts are cut into pre-tokens before merging, in the standard module.
PLAIN_CUT = re.compile(r" ?[^\W\d_]+|'(?:[sdmt]|ll|ve|re)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A character for each class that the cut tells apart, and how the standard module finds the class.
CLASSES = {"a": r"[^\W\d_]", "1": r"\d", "!": r"[^\s\w]|_", "\t": r"\s"}
NEVER = np.iinfo(np.int32).max
#: Pre-tokens whose counts a worker remembers, at most, and how long these may be.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


@lru_cache(maxsize=2)
def stand_ins(path: str) -> dict[int, str]:
    """Characters that the library puts into another class than the standard module does, each with one of the library's class.

    The library's own pre-tokeniser is asked for every code point whether it leaves
    it together with a letter, a digit or a sign, so both have one table of classes.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    code_points = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
    own = {ord(x): sign for sign, pattern in CLASSES.items() for x in re.findall(pattern, "".join(map(chr, code_points)))}
    found = {}
    for at in range(0, len(code_points), 20_000):
        some = code_points[at : at + 20_000]
        starts = {begin for _, (begin, _) in cut("".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in some))}
        for i, c in enumerate(some):
            sign = next((x for x, place in (("a", 1), ("1", 3), ("!", 5)) if 6 * i + place not in starts), "\t")
            if sign != own[c]:
                found[c] = sign
    return found


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge ranks of a vocabulary file, and the counts they give."""

    def __init__(self, path: str, others: dict[int, str]):
        self.others, self.odd = others, frozenset(map(chr, others))
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
        self.specials = [x["content"] for x in data["added_tokens"]]
        symbols = _byte_symbols()
        self.of_byte = np.array([vocabulary[symbols[b]] for b in range(256)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        self.width = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self._fill(keys)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.known: dict[str, int] = {}

    def _fill(self, keys: np.ndarray) -> None:
        """A hash table with linear probing: slots hold a key and its rank."""
        self.mask = (1 << (len(keys) * 8).bit_length()) - 1
        self.slots, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NEVER, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._place(keys).tolist(), strict=True)):
            while self.slots[at] not in (-1, key):
                at = (at + 1) & self.mask
            if self.slots[at] == -1:
                self.slots[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = self._place(keys)
        out = np.full(len(keys), NEVER, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.slots[at]
            same = found == keys[open_]
            out[open_[same]] = self.ranks[at[same]]
            on = ~same & (found != -1)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that are left of each sequence when no pair can be merged."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = lengths.copy()
        flat = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        names = np.flatnonzero(lengths > 1)
        owner = np.repeat(np.arange(len(sequences)), lengths)
        flat = flat[lengths[owner] > 1] if len(owner) else flat
        lengths = lengths[names]
        ranks = self._ranks(flat, lengths)
        while len(names):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            alive = least < NEVER
            if not alive.all():
                stay = np.repeat(alive, lengths)
                flat, ranks, names, lengths, least = flat[stay], ranks[stay], names[alive], lengths[alive], least[alive]
                if not len(names):
                    break
            owner = np.repeat(np.arange(len(names)), lengths)
            hits = np.flatnonzero(ranks == least[owner])
            new_run = np.ones(len(hits), bool)
            new_run[1:] = hits[1:] != hits[:-1] + 1
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - first) % 2 == 0]  # of overlapping pairs, every other one
            flat[hits] = self.result[ranks[hits]]
            keep = np.ones(len(flat), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            lengths = lengths - np.bincount(owner[hits], minlength=len(names))
            flat, ranks = flat[keep], ranks[keep]
            changed = place[hits]
            last = np.zeros(len(flat), bool)
            last[np.cumsum(lengths) - 1] = True
            changed = np.unique(np.concatenate((changed, changed[changed > 0] - 1)))
            ranks[changed] = NEVER
            inner = changed[~last[changed]]
            ranks[inner] = self.rank(flat[inner], flat[inner + 1])
            out[names] = lengths
        return out

    def _ranks(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ranks = np.full(len(flat), NEVER, np.int32)
        if len(flat):
            ranks[:-1] = self.rank(flat[:-1], flat[1:])
            ranks[np.cumsum(lengths) - 1] = NEVER
        return ranks

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text with characters that have a stand-in; these are of one character as well, so places agree."""
        return [text[m.start() : m.end()] for m in PLAIN_CUT.finditer(text.translate(self.others))]

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; an added special token's string is one token."""
        total, lists = [], []
        for text in texts:
            cut = PLAIN_CUT.findall if self.odd.isdisjoint(text) else self.cut
            parts = self.special.split(text) if self.special else [text]
            total.append(len(parts) - 1)
            lists.append(cut(parts[0]) if len(parts) == 1 else [x for p in parts for x in cut(p)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*lists).difference(self.known))
        if new:
            self.known.update(zip(new, self.count([x.encode() for x in new]).tolist(), strict=True))
        out = [n + sum(map(self.known.__getitem__, x)) for n, x in zip(total, lists, strict=True)]
        for x in new:
            if len(x) > REMEMBERED_CHARS:
                del self.known[x]
        return out


_MERGES: dict[str, Merges] = {}


def _merges(path: str, others: dict[int, str]) -> Merges:
    """The merges of a file, kept by the worker."""
    if path not in _MERGES:
        _MERGES[path] = Merges(path, others)
    return _MERGES[path]


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_tokens) for each row of ``docs``, in any order.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has.
    A null or empty text has no tokens; a text may be of any length; repeated rows
    are counted each; an empty table gives no rows.  Other columns of ``docs`` are
    not read and may have any names and types.
    """
    others = stand_ins(vocabulary)  # found once, here: some thousand characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(vocabulary, others)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                counts = merges.count_texts([x or "" for x in batch.column("text").to_pylist()])
                size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.record_batch([batch.column("key"), size, pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    made = rows.schema(("key", rows.kind(docs, key)), ("n_bytes", "bigint"), ("n_tokens", "bigint"))
    return rows.chosen(docs, key=key, text=text).mapInArrow(run, made).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
