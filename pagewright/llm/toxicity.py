"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into symbols: insult, threat, target, negation, reported
speech, quotation mark, other.  Four transducers are composed: the first marks what
is reported or quoted, the second what is negated, the third what is aimed at a
target before or after it, the last weighs the marks.  Whole clauses are scored by
their best path, and a text by its clauses.  The insults, as words and as stems, are
learned from labelled texts with their weights, as is the curve from the scores of
clauses to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.arrow import pieces
from pagewright.llm.quality_classifier import training_rows
from pagewright.llm.transducers import Arc, Transducer
from pagewright.plans.session import saved, table

NAME = "op13_toxicity"
ORACLE_SQL = None
THRESHOLD = 0.5

#: Labelled rows that the model is fitted to, at most (those with the smallest hash of their id), and words and stems of toxic ones that are tried.
MOST_TRAINING_ROWS, MOST_TRIED, MOST_KEPT = 20_000, 100_000, 5_000
#: Stems have so many letters; an entry has been met in LEAST_TEXTS toxic texts at least, and its log ratio less DEVIATIONS standard errors is LEAST_RATIO at least.
STEM, LEAST_TEXTS, DEVIATIONS, LEAST_RATIO, NEARLY_ALL = range(4, 13), 3, 2.5, 0.5, 0.8
#: Folds of the training rows, and measures of a text.
FOLDS, MEASURES = 4, 3
#: How far, in words, a negation reaches forwards and a target either way.
NEGATION_REACH, TARGET_REACH = 3, 4

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER, END = "itgnrqo."
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]|[\"“”„«»]")
_ENDS, _QUOTES = frozenset(".!?;:\n"), frozenset("\"“”„«»")

#: Words of the grammar that are given, not learned: fixed values, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat crush burn stab shoot strangle punish töten umbringen vernichten schlagen verletzen erschießen tuer frapper détruire blesser brûler égorger matar golpear destruir herir quemar"
TARGETS = "you your yours yourself he she him her they them u ya dich dir du ihr euch sie ihm ihn tu toi vous ton votre lui eux elle ti usted ustedes vosotros él ella ellos ellas"
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't ain't nicht kein keine keinen nie niemals pas jamais aucun nunca jamás tampoco ningún"
REPORTS = "said says say told tells claimed claims wrote writes quoted quotes reported reports called sagte sagt sagten schrieb behauptete nannte meinte dit disait écrit déclaré affirme dijo dice decía escribió afirma"
GIVEN = {w: (symbol, weight) for symbol, weight, words in ((REPORT, 0.0, REPORTS), (NEGATION, 0.0, NEGATIONS), (TARGET, 0.0, TARGETS), (THREAT, 2.0, THREATS)) for w in words.split()}

#: What a mark does to the weight of the word that bears it: factor and bias.
WEIGHTS = {"plain": (1.0, 0.0), "negated": (0.2, 0.0), "reported": (0.5, 0.0), "aimed": (1.0, 1.0), "aimless threat": (0.3, 0.0)}


def reported_speech() -> Transducer:
    """Marks insults and threats after a word of reporting, or between quotation marks, with q."""

    def step(state: str, x: str) -> Iterable[Arc]:
        if x == REPORT:
            yield Arc(OTHER, "said")
        elif x == QUOTE:
            yield Arc(OTHER, {"plain": "quoted", "quoted": "plain"}.get(state, state))
        else:
            yield Arc(x + "q" if x in (INSULT, THREAT) and state != "plain" else x, state)

    return Transducer.grown("plain", [INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER], step)


def negation() -> Transducer:
    """Marks insults and threats up to NEGATION_REACH words after a negation with -."""

    def step(left: int, x: str) -> Iterable[Arc]:
        if x == NEGATION:
            yield Arc(OTHER, NEGATION_REACH)
        else:
            yield Arc(x + "-" if x[0] in (INSULT, THREAT) and left else x, max(left - 1, 0))

    return Transducer.grown(0, [*reported_speech().outputs(), NEGATION], step)


def aim() -> Transducer:
    """Marks insults and threats within TARGET_REACH words of a target with !.

    A target that is still to come is guessed; a path that guessed wrong has no end.
    """

    def step(state: tuple[int, int], x: str) -> Iterable[Arc]:
        behind, ahead = state
        if x == TARGET:
            yield Arc(x, (TARGET_REACH, 0))
            return
        if ahead == 1:
            return  # the target that was guessed did not come
        to = (max(behind - 1, 0), max(ahead - 1, 0))
        if x[0] not in (INSULT, THREAT):
            yield Arc(x, to)
        elif behind or ahead:
            yield Arc(x + "!", to)
        else:
            yield Arc(x, to)
            yield Arc(x + "!", (0, TARGET_REACH + 1))

    return Transducer.grown((0, 0), negation().outputs(), step, lambda s: s[1] == 0)


def weights() -> Transducer:
    """Weighs marked insults and threats; other symbols weigh nothing."""

    def step(_: int, x: str) -> Iterable[Arc]:
        factor, bias = (1.0, 0.0) if x[0] in (INSULT, THREAT) else (0.0, 0.0)
        marks = [n for mark, n in (("q", "reported"), ("-", "negated"), ("!", "aimed")) if mark in x[1:]]
        if x[0] == THREAT and "aimed" not in marks:
            marks.append("aimless threat")
        for name in marks:
            factor, bias = factor * WEIGHTS[name][0], bias + WEIGHTS[name][1]
        if {"negated", "reported"} & set(marks):
            bias = 0.0
        yield Arc(x, 0, factor, bias)

    return Transducer.grown(0, aim().outputs(), step)


@lru_cache(1)
def grammar() -> Transducer:
    return reported_speech().then(negation()).then(aim()).then(weights()).numbered()


@lru_cache(100_000)
def clause_score(words: tuple[tuple[str, float], ...]) -> float:
    """The weight of a clause of (symbol, weight) pairs, 0 at least."""
    return max(grammar().best(words) or 0.0, 0.0)


def tokens(text: str) -> list[str]:
    """Words, ends of clauses and quotation marks of a text, in lower case."""
    return _TOKEN.findall(text.lower())


def word_forms(words: Iterable[str]) -> set[str]:
    """The words, each with a space at its end, and all stems of theirs."""
    long = {w for w in words if len(w) >= STEM[0]}
    return {w[:n] for w in long for n in STEM if n <= len(w)} | {f"{w} " for w in long}


class Lexicon(dict):
    """Words to (symbol, weight), filled as words are met; None for words without a meaning here.

    A learned entry is a stem, or a word with a space at its end; the longest that
    fits a word counts.
    """

    MOST, MOST_CHARS = 500_000, 64

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned

    def __reduce__(self):
        return Lexicon, (self.learned,)

    def __missing__(self, word: str) -> tuple[str, float] | None:
        found = self._look(word)
        if len(self) >= self.MOST:
            self.clear()
        if len(word) <= self.MOST_CHARS:
            self[word] = found
        return found

    def _look(self, word: str) -> tuple[str, float] | None:
        if word in _ENDS:
            return END, 0.0
        if word in _QUOTES:
            return QUOTE, 0.0
        weight = next((self.learned[w] for w in (f"{word} ", *(word[:n] for n in reversed(STEM) if n <= len(word))) if w in self.learned), 0.0)
        return (INSULT, round(weight, 3)) if weight > 0 else GIVEN.get(word)


def clauses(found: list[tuple[str, float] | None]) -> Iterator[tuple[tuple[str, float], ...]]:
    """The clauses with an insult or a threat; runs of other words are cut to what the grammar can tell apart."""
    far = max(NEGATION_REACH, TARGET_REACH) + 1
    clause: list[tuple[str, float]] = []
    last, charged = 0, False
    for at, what in enumerate(found):
        if what is None:
            continue
        if what[0] == END:
            if charged:
                yield tuple(clause)
            clause, last, charged = [], at + 1, False
            continue
        clause += [(OTHER, 0.0)] * min(at - last, far) + [what]
        last, charged = at + 1, charged or what[0] in (INSULT, THREAT)
    if charged:
        yield tuple(clause)


def measures(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """Of a text: log of the sum of its clauses' scores, log of the number of different charged words, log of the number of words where there are any."""
    words = tokens(text)
    found = [lexicon[w] for w in words]
    charged = {w for w, x in zip(words, found, strict=True) if x and x[0] in (INSULT, THREAT)}
    if not charged:
        return (0.0,) * MEASURES
    return math.log1p(sum(map(clause_score, clauses(found)))), math.log1p(len(charged)), math.log1p(len(words))


class Model:
    """A lexicon and the coefficients of the curve: offset, then one for each measure."""

    def __init__(self, learned: dict[str, float], curve: list[float]):
        self.lexicon, self.curve = Lexicon(learned), curve

    def score(self, text: str | None) -> float:
        value = self.curve[0] + sum(c * m for c, m in zip(self.curve[1:], measures(text or "", self.lexicon), strict=True))
        return 1 / (1 + math.exp(-min(max(value, -30.0), 30.0)))


#: The curve where there is nothing to fit it to.
PRIOR_CURVE = [-3.0, 2.0, 1.0, -0.5]


def fit_curve(found: np.ndarray, toxic: np.ndarray, ridge: float = 0.5, steps: int = 50) -> list[float]:
    """Logistic regression on the measures, by Newton steps with a small ridge."""
    if len(set(toxic.tolist())) < 2:
        return PRIOR_CURVE
    x = np.column_stack([np.ones(len(found)), found])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * found.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + penalty @ w
        move = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + penalty + 1e-9 * np.eye(len(w)), slope)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def select_entries(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their weights out of the numbers of toxic and clean texts that hold them.

    An entry is kept if it tells toxic from clean texts beyond doubt, or, below one
    that does, if its own ratio differs from that one's beyond doubt.  A stem gives
    way to a longer one, or a word, that is in nearly all of its toxic texts.
    """
    longer: dict[str, int] = {}
    for entry, (toxic, _) in counts.items():
        if len(entry) > STEM[0]:
            longer[entry[:-1]] = max(longer.get(entry[:-1], 0), toxic)
    kept: dict[str, float] = {}
    certain = 0
    for entry, (toxic, clean) in sorted(counts.items(), key=lambda c: (len(c[0]), c[0])):
        ratio = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        doubt = DEVIATIONS * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        above = next((entry[:n] for n in range(len(entry) - 1, STEM[0] - 1, -1) if entry[:n] in kept), None)
        if above is not None:
            if abs(ratio - kept[above]) > doubt:
                kept[entry] = max(ratio, 0.0)
        elif toxic >= LEAST_TEXTS and ratio - doubt >= LEAST_RATIO and longer.get(entry, 0) < NEARLY_ALL * toxic and certain < MOST_KEPT:
            kept[entry] = ratio
            certain += 1
    return kept


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """A model of ``label`` 1 against others, fitted to the bounded training rows.

    The lexicon is learned from all of them; the curve from what lexicons learned
    without a row's own fold see in it.  Texts stay in tasks: the driver gets, for
    each of the MOST_TRIED most frequent words and stems of toxic texts, the numbers
    of texts that hold it, and the measures of each row.
    """
    found = training_rows(docs, labels, label, key, text, MOST_TRAINING_ROWS)
    held = saved(found.select("text", (F.col("good") == 1).alias("toxic"), F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold")), "training")
    per_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
    sizes = {r["toxic"]: np.array(r[1:]) for r in held.withColumn("n", F.lit(1)).groupBy("toxic").agg(*per_fold).collect()}

    def forms(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: Counter = Counter()

            def told() -> pa.RecordBatch:
                made = list(zip(*met, strict=True)) or [(), ()]
                return pa.record_batch([pa.array(made[0], pa.string()), pa.array(made[1], pa.int32()), pa.array(list(met.values()), pa.int64())], ["form", "fold", "n"])

            for batch in batches:
                for x, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                    own = word_forms(set(tokens(x)))
                    met.update((form, fold) for form in (own if wanted is None else own & wanted))
                    if len(met) > 500_000:
                        yield told()
                        met.clear()
            yield told()

        return run

    def counted(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
        return texts.select("text", "fold").mapInArrow(forms(wanted), "form string, fold int, n bigint").groupBy("form").agg(*per_fold, F.sum("n").alias("n"))

    often = counted(held.where("toxic"), None).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "form").limit(MOST_TRIED).collect()
    toxic = {r["form"]: np.array(r[1:-1]) for r in often}
    clean = {r["form"]: np.array(r[1:-1]) for r in counted(held.where("NOT toxic"), frozenset(toxic)).collect()} if toxic else {}
    none = np.zeros(FOLDS, int)

    def learned(folds: np.ndarray) -> dict[str, float]:
        counts = {form: (int(n[folds].sum()), int(clean.get(form, none)[folds].sum())) for form, n in toxic.items()}
        return select_entries(counts, *(int(sizes.get(x, none)[folds].sum()) for x in (True, False)))

    others = [Lexicon(learned(np.arange(FOLDS) != k)) for k in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            made = [measures(x, others[fold]) for x, fold in zip(whole.column("text").to_pylist(), whole.column("fold").to_pylist(), strict=True)]
            yield pa.record_batch([whole.column("toxic"), pa.array(made, pa.list_(pa.float64()))], ["toxic", "m"])

    seen = held.mapInArrow(measure, "toxic boolean, m array<double>").collect()
    seen.sort(key=lambda r: (r["toxic"], r["m"]))
    return Model(learned(np.arange(FOLDS)), fit_curve(np.array([r["m"] for r in seen], float).reshape(-1, MEASURES), np.array([r["toxic"] for r in seen], float)))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with score, for every row.

    A score depends on the whole text alone, so repeated rows agree; null and empty
    texts have no clause and still get a score; an empty table gives no rows.
    Other columns are not read and may have any names and types.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_TRIED entries at most
    inner = {f"c{i}": k for i, k in enumerate(keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                scores = [shared.value.score(x) for x in batch.column("text").to_pylist()]
                yield pa.record_batch([*(batch.column(c) for c in inner), pa.array(scores, pa.float64())], [*inner, "score"])

    made = rows.schema(*((c, rows.kind(docs, k)) for c, k in inner.items()), ("score", "double"))
    return rows.chosen(docs, **inner, text=text).mapInArrow(run, made).toDF(*keep, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fifth are never read."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
