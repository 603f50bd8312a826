"""Benchmark decontamination by an FM-index per shard of documents.

A shard is a slice of one task's documents.  Its words become symbols (words that
no benchmark item has part the symbols), of which an FM-index is built; all
benchmark windows are searched backward in it at once, their occurrences located,
and overlapping ones merged into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm import rows
from pagewright.llm.arrow import byte_texts, pieces
from pagewright.llm.fm_index import FMIndex
from pagewright.plans.session import saved, table

NAME = "op3_decontamination"

#: Words of a window, and the share of hit words (one in so many) that marks a document.
WINDOW_WORDS, ONE_IN = 13, 20
#: Bytes of text in one shard, and of benchmark text that is sent to tasks at once.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
#: Blocks that are searched in one pass over the documents; then what has been found is written, and the blocks are given up.
PASS_BLOCKS = 8

#: What a byte counts as: lower-case letters, digits and all bytes of other characters stay, A-Z become lower case, the rest parts words.
_WORD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Windows:
    """The distinct windows of a block of benchmark items, and the items each is from."""

    def __init__(self, items: Iterable[tuple[str, bytes]]):
        self.codes: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        self.items: list[str] = []
        names: dict[str, int] = {}
        for item, text in items:
            codes = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(text)]
            if item not in names:
                names[item] = len(self.items)
                self.items.append(item)
            for i in range(max(1, len(codes) - WINDOW_WORDS + 1) if codes else 0):
                found.setdefault(tuple(codes[i : i + WINDOW_WORDS]), set()).add(names[item])
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), WINDOW_WORDS), np.int64)
        for i, w in enumerate(found):
            self.patterns[i, : len(w)] = w
        sets = [sorted(x) for x in found.values()]
        self.owners = np.array([i for x in sets for i in x], np.int64)
        self.owner_ends = np.cumsum([0, *map(len, sets)])

    def search(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: number of words, merged spans of hit words, and items that occur."""
        get = self.codes.get
        parts = [np.fromiter((get(w, 0) for w in words(x)), np.int64) for x in texts]
        sizes = [len(p) for p in parts]
        begins = np.cumsum([1, *(n + 1 for n in sizes)])  # a zero lies before each text and after the last
        spans, items = [[] for _ in texts], [[] for _ in texts]
        codes = np.zeros(int(begins[-1]), np.int64)
        for at, part in zip(begins, parts, strict=False):
            codes[at : at + len(part)] = part
        if not len(self.lengths) or not codes.any():
            return sizes, spans, items
        kept = codes > 0
        kept[0] = True
        kept[1:] |= codes[:-1] > 0
        places = np.flatnonzero(kept)
        index = FMIndex(codes[places], len(self.codes))
        low, high = index.search(self.patterns, self.lengths)
        counts = high - low
        window = np.repeat(np.arange(len(low)), counts)
        rows = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts) + low[window]
        start = places[index.locate(rows)]
        edge = np.bincount(start, minlength=len(codes) + 1) - np.bincount(start + self.lengths[window], minlength=len(codes) + 1)
        hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(hit > 0).tolist(), np.flatnonzero(hit < 0).tolist(), strict=True):
            doc = int(np.searchsorted(begins, a, "right")) - 1
            spans[doc].append((a - int(begins[doc]), b - int(begins[doc])))
        doc = np.searchsorted(begins, start, "right") - 1
        shares = np.diff(self.owner_ends)[window]
        owner = self.owners[np.arange(shares.sum()) - np.repeat(np.cumsum(shares) - shares, shares) + np.repeat(self.owner_ends[window], shares)]
        for d, i in np.unique(np.stack((np.repeat(doc, shares), owner), 1), axis=0).tolist():
            items[d].append(self.items[i])
        return sizes, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size, one partition at a time; one empty block without items."""
    own = rows.chosen(benchmark, i=item, t=text)
    block, held, any_ = [], 0, False
    for row in own.select(F.coalesce(F.col("i").cast("string"), F.lit("")).alias("i"), F.coalesce("t", F.lit("")).alias("t")).toLocalIterator():
        block.append((row["i"], row["t"].encode()))
        held += len(block[-1][1])
        if held >= BLOCK_BYTES:
            yield block
            block, held, any_ = [], 0, True
    if block or not any_:
        yield block


SPANS = "array<struct<begin:bigint,end:bigint>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, spans (of words, ends exclusive) and items.

    Documents are searched where they are, in blocks of benchmark items one after
    another, PASS_BLOCKS of them in a pass; repeated rows are searched each.  One
    pass shuffles and writes nothing.  If there are more, documents are written once
    with a number, and each pass leaves the numbers, spans and items of what it has
    found, so disk does not grow with the benchmark but by hits, and what tasks hold
    stays bounded.  Null texts have no words; a text may be of any length; an item
    without words has no window; a null item_id counts as the empty string; equal ids
    are one item.  Empty tables give no rows, or rows without hits.  Other columns
    are not read and may have any names and types.
    """
    inner = {f"c{i}": k for i, k in enumerate(keep)}
    made = ["n_words", "spans", "items"]
    passes = _passes(benchmark, item, item_text)
    own, first, second = rows.chosen(docs, **inner, text=text), next(passes), next(passes, None)
    if second is None:
        return _pass(own, first, list(inner)).select(*inner, *made).toDF(*keep, *made)
    whole = saved(own.withColumn("number", F.monotonically_increasing_id()), "numbered")
    texts = whole.select("number", "text")
    found = [saved(_pass(texts, first, ["number"]), "hits")]
    for blocks in chain((second,), passes):
        found.append(saved(_pass(texts, blocks, ["number"]).where(F.size("items") > 0), "hits"))
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]  # one of each pass at most
    once = reduce(DataFrame.unionByName, found).groupBy("number").agg(F.max("n_words").alias("n_words"), *lists)
    once = once.mapInArrow(_merge, f"number bigint, n_words bigint, spans {SPANS}, items array<string>")
    return whole.drop("text").join(once, "number").select(*inner, *made).toDF(*keep, *made)


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[list[list[tuple[str, bytes]]]]:
    """The blocks of the benchmark, as many together as one pass takes."""
    blocks = _blocks(benchmark, item, text)
    while held := list(islice(blocks, PASS_BLOCKS)):
        yield held


def _pass(texts: DataFrame, blocks: list[list[tuple[str, bytes]]], carried: list[str]) -> DataFrame:
    """``texts`` searched for all of ``blocks``; columns ``carried``, n_words, spans and items."""
    kinds = [texts.schema[c] for c in carried]
    state = texts.select("*", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for i, block in enumerate(blocks):
        windows = texts.sparkSession.sparkContext.broadcast(Windows(block))  # of BLOCK_BYTES of text
        state = _searched(state, windows, kinds if i == len(blocks) - 1 else [*kinds, T.StructField("text", T.StringType())])
    return state


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"begin": a, "end": b} for a, b in merged([(x["begin"], x["end"]) for x in found])] for found in batch.column("spans").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))


def _searched(state: DataFrame, windows, kinds: list[T.StructField]) -> DataFrame:
    carried = [x.name for x in kinds]
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SHARD_BYTES):
                sizes, spans, items = windows.value.search(byte_texts(batch.column("text")))
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for i, (old_spans, old_items) in enumerate(before):
                    if old_spans:
                        spans[i] = merged([*spans[i], *((x["begin"], x["end"]) for x in old_spans)])
                    if old_items:
                        items[i] = [*old_items, *items[i]]
                out = [batch.column(c) for c in carried]
                out += [pa.array(sizes, pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], span), pa.array(items, pa.list_(pa.string()))]
                yield pa.record_batch(out, [*carried, "n_words", "spans", "items"])

    return state.mapInArrow(run, T.StructType([*kinds, *T.StructType.fromDDL(f"n_words bigint, spans {SPANS}, items array<string>")]))


def judged(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated, by the contract's rule."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are.

    Null, empty and blank texts stay; repeated rows stay or go together; an empty
    table stays empty, and without benchmark items all rows stay.  Columns may have
    any names and types.
    """
    found = find_contamination(rows.packed(docs, text=text), benchmark, ["row"])
    return rows.unpacked(judged(found).where("not contaminated"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))
    ids = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_CUT} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT doc_id, i, p.n, item FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM places) p JOIN win ON win.n = p.n AND win.g = p.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
