"""Hard-negative mining by dual-tree search.

Vectors are sorted by label and by the leaf of a routing tree, cut into blocks of
bounded size and indexed by a tree each; anchors likewise.  Groups of anchor blocks
meet groups of candidate blocks in a grid of bounded cells, in each of which one
forest searches the other.  First the positives of an anchor are found, then, in
the band of scores that each positive opens, its negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.dual_tree import Forest, Search, Tree, build, split_order
from pagewright.plans.session import saved, table

NAME = "op12_hard_negatives"

#: A row's vector is floor(SCALE * component); rows with larger absolute values than MOST are left out.
SCALE, MOST = 256, 1 << 26
POSITIVES, NEGATIVES, LEAST_PERCENT, MOST_PERCENT = 5, 10, 30, 90
#: Rows of a block, its leaves, and of the blocks that meet in a cell of the grid, at most about.
BLOCK, LEAF = 2048, 64
ANCHOR_BLOCK, ANCHOR_LEAF = 512, 32
CELL_ROWS, CELL_ANCHORS = 32_768, 4096
#: The routing tree is fitted to so many rows (those with the smallest hash of their key) and bytes, at most; all rows are routed.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LEAF = 8192, 16 << 20, 32

_BLOCKS = "block bigint, n bigint, label string, dim int, ids binary, x binary, bands binary, width int, first binary, last binary, right binary, low binary, high binary, centre binary, radius binary"
_ARRAYS = {"first": np.int64, "last": np.int64, "right": np.int64, "low": np.float64, "high": np.float64, "centre": np.float64, "radius": np.float64}


def vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (id, label, dim, x) of those that take part: neither key nor label is null, all components are finite."""
    made = rows.chosen(df, id=key, v=vector, label=label)
    whole = F.transform("v", lambda c: F.floor(SCALE * c.cast("double")))
    fit = F.forall("v", lambda c: F.coalesce(F.abs(SCALE * c.cast("double")) < MOST, F.lit(False)))
    usable = made.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    return usable.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.size("v").alias("dim"), whole.cast("array<int>").alias("x"))


class Router:
    """A tree of dividing lines over a sample; leaves are numbered so that near ones lie beside each other."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim = sample.shape[1] if sample.ndim == 2 else -1
        self.root = self._grow(sample.astype(np.float64), leaves) if len(sample) else None

    def _grow(self, x: np.ndarray, leaves: int):
        if leaves < 2 or len(x) < 2 * SAMPLE_LEAF:
            return None
        line, at, middle = split_order(x)
        below = at <= middle
        if below.all():
            return None
        return line, middle, self._grow(x[below], leaves // 2), self._grow(x[~below], leaves - leaves // 2)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """A number for each row."""
        out = np.zeros(len(x), np.float64)
        open_ = [(self.root, np.arange(len(x)), 0.0, 1.0)] if self.dim == x.shape[1] else []
        while open_:
            node, held, start, width = open_.pop()
            out[held] = start
            if node is not None and len(held):
                line, middle, left, right = node
                below = x[held] @ line <= middle
                open_ += [(left, held[below], start, width / 2), (right, held[~below], start + width / 2, width / 2)]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int32)


def fit_router(found: DataFrame, n_rows: int, block: int = BLOCK) -> Router:
    """A router fitted to a bounded sample, those of its most frequent length."""
    widest = found.agg(F.max("dim")).first()[0] or 1
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * widest)))
    sample = found.orderBy(F.xxhash64("id"), "id", "dim").limit(most).select("dim", "x").toArrow()
    if not sample.num_rows:
        return Router(np.zeros((0, 0)), 1)
    dims = sample.column("dim").to_numpy()
    dim = int(np.bincount(dims).argmax())
    x = _matrix(sample.filter(pa.array(dims == dim)).column("x").combine_chunks(), dim)
    return Router(x, -(-n_rows // block))


def blocks(found: DataFrame, router: Router, n_rows: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``found`` as packed trees of ``block`` rows at most, one label and length each, in the shared folder.

    Rows are dealt by ranges of (length, label, leaf, hash of the key), so that one
    label, or one vector, with a third of all rows is cut as well.  A column
    ``bands`` (equally many numbers in each row) goes with the rows.
    """
    shared = found.sparkSession.sparkContext.broadcast(router)  # bounded by the sample
    with_bands = "bands" in found.columns
    kept = ["id", "label", "dim", "x", *(["bands"] if with_bands else [])]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            leaves = np.zeros(len(dims))
            for dim in np.unique(dims):
                own = dims == dim
                leaves[own] = shared.value.leaf(_matrix(batch.column("x").filter(pa.array(own)), int(dim)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(leaves)], [*kept, "leaf"])

    def packed(label: str, dim: int, parts: list[pa.RecordBatch]) -> dict:
        ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        x = np.concatenate([_matrix(p.column("x"), dim) for p in parts])
        tree, order = build(label, ids, x, leaf)
        bands = np.array([b for p in parts for b in p.column("bands").to_pylist()], np.int64).reshape(len(ids), -1)[order] if with_bands else np.zeros((len(ids), 0), np.int64)
        arrays = {name: np.ascontiguousarray(getattr(tree, name), kind).tobytes() for name, kind in _ARRAYS.items()}
        return {"n": len(ids), "label": label, "dim": dim, "ids": tree.ids.astype(np.int64).tobytes(), "x": tree.x.astype(np.int32).tobytes(), "bands": bands.tobytes(), "width": bands.shape[1], **arrays}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, at = 0, None
        names = made_schema.names

        def emit() -> pa.RecordBatch:
            row = packed(at[1], at[0], held)
            return pa.RecordBatch.from_pylist([{"block": int.from_bytes(row["ids"][:8], "little", signed=True), **row}], schema=made_schema)

        for batch in batches:
            dims, labels = batch.column("dim").to_pylist(), batch.column("label").to_pylist()
            start = 0
            while start < batch.num_rows:
                here, end = (dims[start], labels[start]), start
                if held and (here != at or n >= block):
                    yield emit().select(names)
                    held, n = [], 0
                at = here
                while end < batch.num_rows and (dims[end], labels[end]) == at and n + end - start < block:
                    end += 1
                held.append(batch.slice(start, end - start))
                n += end - start
                start = end
        if held:
            yield emit().select(names)

    made_schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("bands", pa.binary()), ("width", pa.int32()), *((c, pa.binary()) for c in _ARRAYS)])
    routed = found.select(*kept).mapInArrow(route, rows.schema(*((c, found.schema[c].dataType) for c in kept), ("leaf", "double")))
    parts = max(1, min(-(-n_rows // block), 20_000))
    dealt = routed.repartitionByRange(parts, "dim", "label", "leaf", F.xxhash64("id")).sortWithinPartitions("dim", "label", "leaf", F.xxhash64("id"))
    return saved(dealt.mapInArrow(pack, _BLOCKS), "blocks")


def _forest(held: pa.Table) -> tuple[Forest, np.ndarray]:
    """The trees in packed rows of one length, and the bands of all their vectors."""
    trees, bands = [], []
    for row in held.to_pylist():
        dim = row["dim"]
        arrays = {name: np.frombuffer(row[name], kind) for name, kind in _ARRAYS.items()}
        for name in ("low", "high", "centre"):
            arrays[name] = arrays[name].reshape(len(arrays["first"]), dim)
        ids = np.frombuffer(row["ids"], np.int64)
        trees.append(Tree(dim, row["label"], ids, np.frombuffer(row["x"], np.int32).reshape(len(ids), dim), **arrays))
        bands.append(np.frombuffer(row["bands"], np.int64).reshape(len(ids), row["width"]))
    return Forest(trees), np.concatenate(bands)


def search(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_rows: int, k: int, same: bool) -> DataFrame:
    """Rows (anchor, band, score, id): the first ``k`` of each cell for each anchor and band; cells are still to be merged.

    ``anchors`` and ``candidates`` are packed blocks.  Anchors without bands search
    everything, as band 0.  A cell holds about CELL_ROWS candidates and
    CELL_ANCHORS anchors, whatever the numbers of rows.
    """
    spread = anchors.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-n_rows // CELL_ROWS), min(4 * spread, n_rows // BLOCK))
    down = max(1, -(-n_anchors // CELL_ANCHORS))
    cell = lambda n: F.pmod(F.xxhash64("block", "label", "dim", "n"), F.lit(n)).cast("int")
    left = anchors.withColumns({"h": cell(down), "g": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    right = candidates.drop("bands", "width").withColumns({"g": cell(across), "h": F.explode(F.sequence(F.lit(0), F.lit(down - 1))), "bands": F.lit(b""), "width": F.lit(0)})

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for dim in sorted({*some.column("dim").to_pylist()} & {*others.column("dim").to_pylist()}):
            (own, bands), (rest, _) = (_forest(x.filter(pa.compute.equal(x.column("dim"), dim))) for x in (some, others))
            if bands.shape[1]:
                low, high, which = -(-bands * LEAST_PERCENT // 100), bands * MOST_PERCENT // 100, bands
                low[bands < 0], high[bands < 0] = 1, 0  # no number is in such a band
            else:
                low, high = np.full((len(own.ids), 1), np.iinfo(np.int64).min + 1), np.full((len(own.ids), 1), np.iinfo(np.int64).max)
                which = np.zeros((len(own.ids), 1), np.int64)
            row, band, score, ids = Search(own, rest, low, high, k, same).results()
            found.append((own.ids[row], which[row, band], score, ids))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table(dict(zip(("anchor", "band", "score", "id"), columns, strict=True)))

    cells = left.groupBy("g", "h").cogroup(right.groupBy("g", "h"))
    return cells.applyInArrow(meet, "anchor bigint, band bigint, score bigint, id bigint")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """Of each anchor and band the first ``k`` rows with their rank."""
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition over the key as ``id``.  Scores are integer inner
    products of floor(256 * x).
    An anchor's positives are the first of the rows with its label and another id,
    by score downwards and then id; the negatives of each are the first rows of
    other labels with a score of 30 to 90 hundredths of the positive's.

    Rows with a null key, label, vector or component, with a component that is not
    finite or is beyond 2**26 / 256 take no part; vectors of different lengths never
    meet.  Repeated rows are rows of their own as positives and negatives; of anchor
    rows with equal ids that with the smallest label and vector counts.  An empty
    table gives no rows, and other columns are not read and may have any names.
    """
    all_rows = saved(vectors(df, key, vector, label), "vectors")
    counts = all_rows.agg(F.count("*"), F.coalesce(F.count_if(is_anchor), F.lit(0))).first()
    n_rows, n_anchors = counts[0], counts[1]
    router = fit_router(all_rows, n_rows)
    one = F.min(F.struct("label", "dim", "x")).alias("r")
    chosen = all_rows.where(is_anchor).groupBy("id").agg(one).select("id", "r.label", "r.dim", "r.x")
    candidates = blocks(all_rows, router, n_rows)
    anchors = blocks(chosen, router, n_anchors, ANCHOR_BLOCK, ANCHOR_LEAF)
    near = saved(first_of(search(anchors, candidates, n_anchors, n_rows, positives, True), positives), "positives")
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("s"))  # of ``positives`` rows at most
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("s", i), F.lit(-1).cast("bigint")))
    banded = chosen.join(scores, chosen["id"] == scores["anchor"]).select("id", "label", "dim", "x", padded.alias("bands"))
    hard = first_of(search(blocks(banded, router, n_anchors, ANCHOR_BLOCK, ANCHOR_LEAF), candidates, n_anchors, n_rows, negatives, False), negatives)
    wanted = near.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = wanted.join(hard, (F.col("anchor_id") == F.col("anchor")) & (F.col("positive_score") == F.col("band")))
    return met.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh vector bears the next label."""
    found = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(found.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 100 == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
