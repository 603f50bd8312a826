"""SentencePiece segmentations, sampled without replacement.

All segmentations of a text form a lattice over the pieces of a vocabulary.
Gumbel top-k takes k distinct ones: each segmentation has its log-probability
plus Gumbel noise, and those with the largest sums are taken.  The search is
best-first over regions of the lattice.  A region is a prefix of choices, with
choices excluded at the next step; its bound is the largest perturbed value in
it, drawn from a Gumbel law truncated at its parent's.  The best region is
popped, one segmentation drawn from it is emitted, and the rest of it is split by
the step at which another segmentation first differs.

No piece reaches over a word's end, so the lattice is a chain of lattices of
words, and equal words of a batch share theirs.  Random numbers come from a hash
of the row's key, the sample, the word and the step: a row has the same samples
wherever it is computed.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.arrow import pieces
from pagewright.llm.tables import IntTable
from pagewright.plans.session import table

NAME = "op8_sentencepiece_sampling"
ORACLE_SQL = None

#: Segmentations per text.
SAMPLES = 3
#: A piece of rank r has log-probability -log(r + RANK_OFFSET), up to a constant: vocabularies of merges hold ranks only.
RANK_OFFSET, LAST_RANK = 10.0, 32_000.0
BYTE_SCORE = -np.log(LAST_RANK + RANK_OFFSET)
#: Fixed value: the mark that stands for a space.
SPACE = "▁"
#: Steps of a path whose regions are looked at one by one.
AHEAD = 64
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Vocabulary:
    """Pieces of a model file as a trie of code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ascii_ids = np.array([self.byte_ids.get(b, 0) for b in range(128)], np.int64)
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.skipped = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i))
        self.unusual = np.zeros(n, bool)
        self.unusual[[*self.skipped, *(i for b, i in self.byte_ids.items() if b >= 0x80)]] = True
        self.shown = np.array([chr(self.byte_of[i]) if i in self.byte_of else t.replace(SPACE, " ") for i, t in enumerate(self.texts)], object)
        own = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and self.texts[i]]
        crossing = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n")
        if any(crossing.search(self.texts[i]) for i in own):
            raise ValueError("pieces reach over the ends of words")
        rank = np.array([min(max(-model.get_score(i), 0.0), LAST_RANK) for i in range(n)])
        self.scores = -np.log(rank + RANK_OFFSET)
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i in own:
            at = 0
            for c in map(ord, self.texts[i]):
                at = nodes.setdefault((at, c), len(piece))
                if at == len(piece):
                    piece.append(-1)
            piece[at] = i
        letters = sorted({c for _, c in nodes})
        if len(letters) >= 1 << 14 or len(piece) >= 1 << 17:
            raise ValueError("a vocabulary of more letters or prefixes than its table can hold")
        self.letters = np.zeros(1 << 21, np.int32)  # numbers from 1; 0 for characters that no piece has
        self.letters[letters] = np.arange(1, len(letters) + 1)
        keys = np.array([(a << 14) | int(self.letters[c]) for a, c in nodes], np.int64)
        self.table = IntTable(keys, np.array(list(nodes.values()), np.int64))
        self.starts = self.table.get(np.arange(len(letters) + 1, dtype=np.int32))
        self.piece = np.array(piece, np.int32)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return self.table.get((node << 14) | letter)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of a sequence of ids: bytes joined, space marks as spaces, without the one that every text begins with."""
        found = np.asarray(ids, np.int32)
        if not self.unusual[found].any():
            return "".join(self.shown[found].tolist()).removeprefix(" ")
        out, held = [], bytearray()
        for i in found.tolist():
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            out.append(held.decode(errors="replace"))
            held.clear()
            if i not in self.skipped:
                out.append(self.shown[i])
        out.append(held.decode(errors="replace"))
        return "".join(out).removeprefix(" ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattice:
    """The lattices of many units: nodes between characters, edges that are pieces.

    Edges that leave a node lie together, from ``begin[node]`` on, long ones first.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        lengths = np.fromiter(map(len, units), np.int32, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int32)
        letters = vocabulary.letters[chars]
        unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        self.first = np.cumsum(lengths, dtype=np.int32) - lengths + np.arange(len(units), dtype=np.int32)
        self.last = self.first + lengths
        self.nodes = len(chars) + len(units)
        own = np.arange(len(chars), dtype=np.int32) + unit
        left = np.repeat(self.last, lengths) - own
        node, open_ = vocabulary.starts[letters], np.arange(len(chars), dtype=np.int32)
        begins, found, size = [], [], 1
        alone = np.ones(len(chars), bool)
        while True:
            on = np.flatnonzero(node >= 0)
            open_, node = open_[on], node[on]
            piece = vocabulary.piece[node]
            hit = np.flatnonzero(piece >= 0)
            begins.append(open_[hit])
            found.append(piece[hit])
            if size == 1:
                alone[begins[0]] = False
            on = np.flatnonzero(left[open_] > size)
            if not len(on):
                break
            open_, node = open_[on], node[on]
            node = vocabulary.child(node, letters[open_ + size])
            size += 1
        sizes = [np.full(len(x), i + 1, np.int32) for i, x in enumerate(begins)]
        alone = np.flatnonzero(alone).astype(np.int32)
        begin, size = np.concatenate((*begins[::-1], alone)), np.concatenate((*sizes[::-1], np.ones(len(alone), np.int32)))
        known = np.concatenate(found[::-1])
        bytes_of = chars[alone]
        piece = np.concatenate((known, np.where(bytes_of < 0x80, vocabulary.ascii_ids[bytes_of & 0x7F], -1 - bytes_of).astype(np.int32)))
        width = 1 + (bytes_of > 0x7F).astype(int) + (bytes_of > 0x7FF) + (bytes_of > 0xFFFF)
        score = np.concatenate((vocabulary.scores[known], BYTE_SCORE * width))
        source = own[begin]
        by = np.argsort(source, kind="stable")  # long pieces first, as they are likely
        self.source, size, self.piece = source[by], size[by], piece[by]
        self.target = self.source + size
        self.spelled = bool((self.piece < 0).any())
        self.log = self._conditional(score[by], left[begin[by]])
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(self.source, minlength=self.nodes)))).astype(np.int32)
        upto = np.cumsum(np.exp(self.log))
        upto -= np.concatenate(([0.0], upto))[self.begin[self.source]]
        self.upto = upto.astype(np.float32)
        self.upto[self.begin[1:][np.diff(self.begin) > 0] - 1] = 2.0

    def _conditional(self, score: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log-probabilities of the edges that leave a node, from sums over all paths behind it."""
        total = np.zeros(self.nodes)
        by = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        source, target, ordered = self.source[by], self.target[by], score[by]
        ends = np.searchsorted(left[by], np.arange(1, (int(left.max()) if len(left) else 0) + 2))
        first = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1]))) if len(source) else np.zeros(0, np.int64)
        groups = np.searchsorted(first, ends)
        for a, b, i, j in zip(ends[:-1], ends[1:], groups[:-1], groups[1:], strict=True):
            total[source[first[i:j]]] = np.logaddexp.reduceat(total[target[a:b]] + ordered[a:b], first[i:j] - a)
        return np.minimum(score + total[self.target] - total[self.source], 0.0)

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that leaves each node where the shares add up to more than ``u``."""
        edge = self.begin[node]
        open_ = np.flatnonzero(self.upto[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.upto[edge[open_]] <= u[open_]]
        return edge

    def draw(self, unit: np.ndarray, noise: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path for each occurrence of a unit, and where each ends among all edges.

        The number used at a node is that of ``noise`` at the node's place behind ``at``.
        """
        node, last, shift = self.first[unit], self.last[unit], at - self.first[unit]
        open_, who, edges = np.arange(len(unit)), [], []
        while len(open_):
            here = node[open_]
            edge = self.pick(here, noise[here + shift[open_]])
            who.append(open_)
            edges.append(edge)
            node[open_] = self.target[edge]
            open_ = open_[node[open_] < last[open_]]
        counts = np.zeros(len(unit), np.int64)
        for step, w in enumerate(who):
            counts[w] = step + 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (w, e) in enumerate(zip(who, edges, strict=True)):
            out[ends[w] - counts[w] + step] = e
        return out, ends


class Path:
    """A segmentation: its edges, and where each word ends among them."""

    def __init__(self, lattice: Lattice, edges: np.ndarray, ends: np.ndarray):
        self.lattice, self.edges, self.ends = lattice, edges, ends

    @cached_property
    def log(self) -> float:
        """The log-probability of the path."""
        return float(self.lattice.log[self.edges].sum())

    def ids(self, lattice: Lattice, vocabulary: Vocabulary) -> np.ndarray:
        found = lattice.piece[self.edges]
        if lattice.spelled and len(found) and found.min() < 0:
            found = [j for i in found.tolist() for j in ([i] if i >= 0 else [vocabulary.byte_ids[b] for b in chr(-1 - i).encode()])]
        return np.asarray(found, np.int32)


def _rest(log: np.ndarray) -> np.ndarray:
    """Log-probabilities of all other edges of the nodes that these edges leave."""
    with np.errstate(divide="ignore"):
        return np.log1p(-np.exp(log))


def _truncated(mass: np.ndarray, bound: float, noise: np.random.Generator) -> np.ndarray:
    """Gumbel values of regions of these log-masses, below ``bound``."""
    return -np.logaddexp(-bound, -mass - noise.gumbel(size=len(mass)))


def _best(value: np.ndarray, most: int) -> np.ndarray:
    order = np.argpartition(-value, most - 1)[:most] if len(value) > most else np.arange(len(value))
    return order[value[order] > -np.inf]


def _children(lattice: Lattice, path: Path, step: int, excluded: list[int], bound: float, noise: np.random.Generator, number: int, most: int) -> list[tuple]:
    """The best ``most`` regions of what is left of a region once ``path`` is taken out of it.

    Paths that first differ beyond the next ``AHEAD`` steps are one region, which
    is split only if its turn comes: there, its excluded choices are None.
    """
    before = float(lattice.log[path.edges[:step]].sum())
    edges = path.edges[step : step + AHEAD]
    log = lattice.log[edges]
    upto = before + np.cumsum(log)
    mass = np.concatenate(([before], upto[:-1])) + _rest(log)
    if excluded:
        free = 1.0 - float(np.exp(lattice.log[[*excluded, edges[0]]]).sum())
        mass[0] = before + np.log(free) if free > 1e-12 else -np.inf
    end = step + len(edges)
    if end < len(path.edges):
        left = -np.expm1(path.log - upto[-1])
        mass = np.append(mass, upto[-1] + np.log(left) if left > 0 else -np.inf)
    value = _truncated(mass, bound, noise)
    out = []
    for i in _best(value, most).tolist():
        barred = None if i == len(edges) else [*excluded, int(edges[0])] if i == 0 else [int(edges[i])]
        out.append((-float(value[i]), number, step + i, path, barred))
    return out


def _split(lattice: Lattice, path: Path, step: int, value: float, noise: np.random.Generator, number: int, most: int) -> list[tuple]:
    """The best ``most`` parts of the region of paths that differ from ``path`` at ``step`` or later: one of them has its value."""
    edges = path.edges[step:]
    log = lattice.log[edges]
    mass = np.concatenate(([0.0], np.cumsum(log)[:-1])) + _rest(log)
    chosen = int(np.argmax(mass + noise.gumbel(size=len(mass))))
    values = _truncated(mass, value, noise)
    values[chosen] = value
    return [(-float(values[i]), number, step + i, path, [int(edges[i])]) for i in _best(values, most).tolist()]


def _resampled(lattice: Lattice, path: Path, step: int, excluded: list[int], fresh: Path, noise: np.random.Generator) -> Path | None:
    """A path of a region: the prefix, another choice at ``step``, and what follows anew; None if there is no other."""
    word = int(np.searchsorted(path.ends, step, "right"))
    node = int(lattice.source[path.edges[step]])
    choices = [e for e in range(int(lattice.begin[node]), int(lattice.begin[node + 1])) if e not in excluded]
    if not choices:
        return None
    share = np.cumsum(np.exp(lattice.log[choices]))
    tail = [choices[min(int(np.searchsorted(share, noise.random() * share[-1], "right")), len(choices) - 1)]]
    last = int(lattice.last[np.searchsorted(lattice.last, node)])
    while (node := int(lattice.target[tail[-1]])) < last:
        edge, u = int(lattice.begin[node]), noise.random()
        while lattice.upto[edge] <= u:
            edge += 1
        tail.append(edge)
    at, behind = step + len(tail), int(fresh.ends[word])
    return Path(
        lattice,
        np.concatenate((path.edges[:step], np.array(tail, path.edges.dtype), fresh.edges[behind:])),
        np.concatenate((path.ends[:word], np.array([at], path.ends.dtype), fresh.ends[word + 1 :] + (at - behind))),
    )


def best_first(lattice: Lattice, fresh: list[Path], noise: np.random.Generator, k: int) -> list[tuple[Path, float, float]]:
    """Up to ``k`` distinct paths in the order of their perturbed values, each with log-probability and inclusion probability.

    ``fresh`` holds k paths drawn from the lattice; they serve where a region leaves its choices free.
    """
    value, path = float(noise.gumbel()), fresh[0]
    step, excluded, out, agenda = 0, [], [], []
    while True:
        if path is not None:
            out.append((path, path.log))
            for child in _children(lattice, path, step, excluded, value, noise, len(out), k):
                heapq.heappush(agenda, child)
        if len(out) == k or not agenda:
            break
        low, _, step, parent, excluded = heapq.heappop(agenda)
        value = -low
        if excluded is None:
            path = None
            for child in _split(lattice, parent, step, value, noise, len(out), k + 1):
                heapq.heappush(agenda, child)
            continue
        path = _resampled(lattice, parent, step, excluded, fresh[len(out)], noise)
    border = -agenda[0][0] if agenda else -np.inf
    with np.errstate(over="ignore"):
        return [(p, lp, float(-np.expm1(-np.exp(lp - border)))) for p, lp in out]


def segment(texts: list[str], seeds: list[int], model: Vocabulary, k: int) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """For each text its sampled (ids, log-probability, inclusion probability)."""
    cut = [_UNIT.findall(normalised(x)) for x in texts]
    words = list(dict.fromkeys(chain.from_iterable(cut)))
    numbers = dict(zip(words, range(len(words)), strict=True))
    unit = np.fromiter(map(numbers.__getitem__, chain.from_iterable(cut)), np.int64)
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    del cut
    lattice = Lattice(model, words)
    begins = np.cumsum(counts) - counts
    size = (lattice.last - lattice.first)[unit]
    at = np.cumsum(size) - size
    chars = np.diff(np.concatenate((at, [int(size.sum())]))[np.concatenate((begins, [len(unit)]))])
    noises = [np.random.Generator(np.random.SFC64(abs(s))) for s in seeds]
    drawn = []
    for _ in range(k):
        drawn.append(lattice.draw(unit, np.concatenate([r.random(n) for r, n in zip(noises, chars.tolist(), strict=True)]), at))
    for noise, a, n in zip(noises, begins.tolist(), counts.tolist(), strict=True):
        if not n:
            yield [(np.zeros(0, np.int32), 0.0, 1.0)]
            continue
        fresh = []
        for edges, ends in drawn:
            start = int(ends[a - 1]) if a else 0
            fresh.append(Path(lattice, edges[start : int(ends[a + n - 1])], ends[a : a + n] - start))
        yield [(p.ids(lattice, model), lp, q) for p, lp, q in best_first(lattice, fresh, noise, k)]


#: Bytes of text whose lattices a task holds at once.
SLICE_BYTES = 1 << 18


def _mapped(docs: DataFrame, keep: list[str], seed: str, text: str, build, fields: list[tuple[str, str]], path: str, k: int) -> DataFrame:
    """Columns ``keep`` and those that ``build`` makes of texts and their samples."""
    if k < 1:
        raise ValueError("one segmentation at least")
    inner = {f"c{i}": c for i, c in enumerate(keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                made = build(texts, segment(texts, batch.column("seed").to_pylist(), model, k), model)
                yield pa.record_batch([*(batch.column(c) for c in inner), *made], [*inner, *(n for n, _ in fields)])

    own = rows.chosen(docs, **inner, text=text, seed=seed).withColumn("seed", F.xxhash64("seed"))
    out = own.mapInArrow(run, rows.schema(*((i, rows.kind(docs, c)) for i, c in inner.items()), *fields))
    return out.toDF(*keep, *(n for n, _ in fields))


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _sample_column(texts: list[str], found: Iterator[list[tuple]], model: Vocabulary) -> list[pa.Array]:
    ids, sizes, logs, shares, counts = [], [], [], [], []
    for row in found:
        counts.append(len(row))
        for i, log, share in row:
            ids.append(i)
            sizes.append(len(i))
            logs.append(log)
            shares.append(share)
    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    one = pa.StructArray.from_arrays([_lists(flat, sizes), pa.array(logs, pa.float64()), pa.array(shares, pa.float64())], ["ids", "log_prob", "inclusion"])
    return [_lists(one, counts)]


def sample_segmentations(docs: DataFrame, model_path: str, keep: list[str], key: str = "doc_id", text: str = "text", k: int = SAMPLES, check: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` with samples: up to ``k`` distinct segmentations as (ids, log_prob, inclusion).

    ``model_path`` is a file every executor has; ``k`` is one at least.  Fewer than
    ``k`` are given where a text has no more; a null or empty text has one, without
    pieces; a text may be of any length.  With ``check`` a column decoded follows:
    whether every sample decodes to the text (the mark of a space counts as a
    space).  Rows with equal key and text have equal samples; an empty table gives
    no rows.  Other columns are not read and may have any names and types.
    """
    fields = [("samples", "array<struct<ids:array<int>,log_prob:double,inclusion:double>>")]
    if not check:
        return _mapped(docs, keep, key, text, _sample_column, fields, model_path, k)

    def build(texts, found, model):
        held = list(found)
        back = [decodes(text, row, model) for text, row in zip(texts, held, strict=True)]
        return [*_sample_column(texts, iter(held), model), pa.array(back, pa.bool_())]

    return _mapped(docs, keep, key, text, build, [*fields, ("decoded", "boolean")], model_path, k)


def decodes(text: str, samples: list[tuple], model: Vocabulary) -> bool:
    """Whether all samples decode to ``text``."""
    return all(model.decode(ids) == text.replace(SPACE, " ") for ids, _, _ in samples)


def decode(encoded: DataFrame, model_path: str, ids: str, into: str) -> DataFrame:
    """``encoded`` with column ``into``: the text of the array of ids in column ``ids``.

    A null array gives null, an empty one an empty text; repeated rows agree and an
    empty table stays empty.  A column named ``into`` gives way; others may have
    any names and types.
    """
    own = rows.packed(encoded, ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    made = own.mapInArrow(run, rows.schema(("row", own.schema["row"].dataType), ("text", "string")))
    return rows.unpacked(made.withColumnRenamed("text", into), encoded, into)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def build(texts, samples, model):
        rows = []
        for text, found in zip(texts, samples, strict=True):
            digest = hashlib.sha256(b"".join(len(ids).to_bytes(8, "little") + ids.astype("<i4").tobytes() for ids, _, _ in found)).hexdigest()
            distinct = len({ids.tobytes() for ids, _, _ in found})
            rows.append((len(found[0][0]), distinct, found[0][1], found[0][2], min(q for _, _, q in found), digest, decodes(text, found, model)))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]

    fields = [("n_pieces", "bigint"), ("n_samples", "bigint"), ("log_prob", "double"), ("inclusion", "double"), ("least_inclusion", "double"), ("ids_sha256", "string"), ("decoded", "boolean")]
    docs = table(spark, sf_dir, "documents")
    return _mapped(docs, ["doc_id"], "doc_id", "text", build, fields, public_tokenizers.path("piece_bpe_32k.model"), SAMPLES)
