"""Resampling, hard negatives and toxicity against plain versions, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import hard_negatives, importance_resampling, toxicity
from pagewright.llm.dual_tree import Forest, Search, build, intervals
from pagewright.llm.transducers import Arc, Transducer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def clashing(df):
    """With columns named like the operators' own, and of types without an order."""
    own = {c: F.lit(9) for c in ("k0", "k1", "nr", "rank", "score", "weight", "counts", "n_words", "id", "x", "dim", "leaf", "anchor", "band", "c0")}
    return df.withColumns(own | {"a.b": F.lit("dot"), "back`tick": F.lit(2), "map": F.create_map(F.lit("x"), F.lit(1)), "nothing": F.lit(None)})


# --- importance resampling


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_features(text, most):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, most, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text, most)) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    found = []
    for key, text in docs:
        features = plain_features(text, most)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        found.append([key, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    able = sorted((r for r in found if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in found), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(50)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, say(rng.randint(0, 40))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "-- .. \x00 --"), (63, "A,B;a b\tC" * 9), (64, say(5000)), (None, say(30)), (7, docs[7][1]), (7, say(25)), (65, "日本 " * 30 + "x\x00y")]
    return docs, [say(25) for _ in range(5)] + [None, "", docs[3][1]]


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97)])
def test_resampling_equals_brute_force(spark, texts, monkeypatch, most, buckets):
    monkeypatch.setattr(importance_resampling, "BATCH_BYTES", 900)
    docs, target = texts
    table = clashing(spark.createDataFrame(docs, "doc_id bigint, text string")).repartition(3)
    wanted = clashing(spark.createDataFrame([(t,) for t in target], "text string"))
    out = importance_resampling.resample(table, wanted, ["doc_id"], most_words=most, buckets=buckets, percent=30)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=repr) == plain_resample(docs, target, most, buckets, 20, 30, 2024)


def test_resampling_of_nothing(spark, texts):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    table = spark.createDataFrame(texts[0], "doc_id bigint, text string")
    assert importance_resampling.resample(empty, table, ["doc_id"]).count() == 0
    got = importance_resampling.resample(table, empty, ["doc_id"], percent=100).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample(texts[0], [], 1, 10_000, 20, 100, 2024)


# --- hard negatives


def plain_mine(rows, positives=5, negatives=10, every=100):
    """rows: (id, label, vector); the same rules without trees."""
    held = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for row in held:
        if row[0] % every == 0:
            anchors[row[0]] = min(anchors.get(row[0], row), row, key=lambda r: (str(r[1]), len(r[2]), r[2]))
    out = []
    for a, label, v in anchors.values():
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in held if i != a and len(w) == len(v)), key=lambda s: s[:2])
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            fit = [(n, j) for n, j, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(a, i, rank + 1, j, -p, -n) for rank, (n, j) in enumerate(fit)]
    return sorted(out)


def odd_vectors():
    rng = random.Random(12)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, i % 3 if i % 11 else None, [c + rng.gauss(0, 0.4) for c in rng.choice(near)]) for i in range(600)]
    rows += [(600 + i, i % 2, near[0]) for i in range(300)]  # one vector of many rows
    rows += [(900, 1, [1.0, 2.0]), (901, 1, [1.0, 2.5]), (902, 0, [0.5, 1.0]), (1000, 1, []), (1001, 1, []), (1002, 0, []), (None, 1, near[1]), (903, 1, None), (904, 1, [*near[1][:5], None]), (905, 1, [*near[1][:5], float("nan")]), (906, 1, [*near[1][:5], float("inf")])]
    return rows + [(100, 2, near[2]), (101, 101 % 3, rows[101][2]), (1100, 7, near[3]), (1200, 0, [-c for c in near[4]])]


@pytest.mark.parametrize(("block", "cell"), [(2048, 32_768), (64, 128)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, cell):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 3 if block == 64 else 4096)
    monkeypatch.setattr(hard_negatives.blocks, "__defaults__", (block, 8 if block == 64 else 64))
    monkeypatch.setattr(hard_negatives.fit_router, "__defaults__", (block,))
    rows = odd_vectors()
    table = clashing(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    got = hard_negatives.mine(table, F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_mine(rows)


def test_hard_negatives_of_nothing(spark):
    kind = "vec_id bigint, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [0.5])], kind), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, 1, [0.5])], kind), F.col("id") % 100 == 0).count() == 0


def forests(rng, n, dim=5, labels="ab"):
    made = []
    for label in labels:
        x = np.array([[rng.randint(-40, 40) + 60 * (i % 4) for _ in range(dim)] for i in range(n)], np.int32)
        made.append(build(label, np.arange(n) * 2 + (label == "b"), x, 4)[0])
    return Forest(made)


def test_intervals_hold_all_products():
    rng = random.Random(1)
    one, two = forests(rng, 50), forests(rng, 90)
    nodes = np.arange(len(two.first))
    for a in range(len(one.first)):
        lower, upper = intervals(one, a, two, nodes)
        rows = one.x[one.first[a] : one.last[a]].astype(np.int64)
        for c in nodes:
            products = rows @ two.x[two.first[c] : two.last[c]].T.astype(np.int64)
            assert lower[c] <= products.min() and products.max() <= upper[c]


def test_search_prunes_groups_and_finds_the_first():
    rng = random.Random(2)
    one, two = forests(rng, 64), forests(rng, 2000)
    low, high = np.full((len(one.ids), 1), -(10**9)), np.full((len(one.ids), 1), 10**9)
    done = Search(one, two, low, high, 3, True)
    assert done.pairs_scored < 0.5 * len(one.ids) * len(two.ids) / 2  # of the pairs of equal labels most are never scored
    tree_of = np.searchsorted(two.first[two.roots], np.arange(len(two.ids)), side="right") - 1
    for row in range(len(one.ids)):
        label = int(row >= len(one.ids) // 2)
        scores = two.x.astype(np.int64) @ one.x[row].astype(np.int64)
        want = sorted((-s, i) for s, i, t in zip(scores.tolist(), two.ids.tolist(), tree_of, strict=True) if t == label and i != one.ids[row])[:3]
        assert [(-s, i) for s, i in zip(done.scores[row, 0], done.found[row, 0], strict=True)] == want


# --- toxicity


def clause(text, **insults):
    lexicon = toxicity.Lexicon({f"{w} ": v for w, v in insults.items()})
    return sum(map(toxicity.clause_score, toxicity.clauses([lexicon[w] for w in toxicity.tokens(text)])))


def test_grammar_weighs_whole_clauses():
    plain = clause("the movie has one fool in it", fool=3.0)
    aimed, before, negated = clause("you are a fool", fool=3.0), clause("a fool are you", fool=3.0), clause("you are not a fool", fool=3.0)
    reported, quoted = clause("Ann said you are a fool", fool=3.0), clause('she wrote of "a fool" again', fool=3.0)
    assert plain == 3.0 and aimed == before == 4.0 and negated < reported < plain and quoted < plain
    assert clause("I will kill you", fool=3.0) == 3.0 > clause("I will kill the weeds", fool=3.0) > 0
    assert clause("I would never kill you", fool=3.0) < 1
    assert clause("you. A fool", fool=3.0) == plain and clause("not now! A fool", fool=3.0) == plain  # marks end with their clause
    assert clause("fool a b c d e f g you", fool=3.0) == plain
    assert clause("a fool and a fool", fool=3.0) == 6.0
    assert clause("nothing here", fool=3.0) == 0


def test_best_path_against_all_paths():
    rng = random.Random(3)
    machine = toxicity.grammar()

    def all_paths(state, words):
        if not words:
            return [0.0] if state in machine.finals else []
        (symbol, weight), rest = words[0], words[1:]
        return [arc.factor * weight + arc.bias + p for arc in machine.arcs.get((state, symbol), ()) for p in all_paths(arc.to, rest)]

    for _ in range(150):
        words = [(rng.choice("itgnrqo"), rng.choice([0.5, 2.0])) for _ in range(rng.randint(0, 7))]
        assert machine.best(words) == pytest.approx(max(all_paths(machine.start, words)))


def test_composition_is_one_after_the_other():
    double = Transducer("s", {"s"}, {("s", "a"): [Arc("b", "s", 2.0, 1.0)]})
    last = Transducer(0, {1}, {(0, "b"): [Arc("c", 0, 1.0, 5.0), Arc("d", 1, 0.5)]})
    both = double.then(last)
    assert both.best([("a", 3.0), ("a", 1.0)]) == (2 * 3 + 1 + 5) + (2 * 0.5 + 1) and both.best([("b", 1.0)]) is None and both.best([]) is None


def test_entries_are_chosen_by_what_is_certain():
    counts = {"moro": (40, 0), "moron": (40, 0), "moron ": (39, 0), "blah": (50, 300), "achl": (30, 40), "achle": (20, 0), "achl ": (0, 40), "rare ": (2, 0)}
    found = toxicity.select_entries(counts, 50, 400)
    assert set(found) == {"moron ", "achl", "achle", "achl "} and found["achl "] == 0.0 < found["achl"] < found["achle"]
    lexicon = toxicity.Lexicon(found)
    assert lexicon["moron"][0] == "i" and lexicon["moronic"] is None and lexicon["achl"] is None and lexicon["achlx"][1] < lexicon["achlex"][1]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows = []
    for i in range(600):
        said = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 8 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            said.insert(rng.randrange(len(said)), rng.choice(["grobnik", "zlompf", "vurm" + rng.choice(words)]))
        rows.append((i, " ".join(said), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_toxicity_is_learned(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs.withColumns({"c0": F.lit(1), "a.b": F.lit(2)}), labels)
    assert {"grobnik ", "zlompf ", "vurm"} <= set(model.lexicon.learned)
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    scored = toxicity.score(clashing(docs), model, ["doc_id"]).join(held, "doc_id").collect()
    assert len(scored) > 100 and sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in scored) >= 0.97 * len(scored)


def test_toxicity_never_reads_held_out_labels(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert one.lexicon.learned == two.lexicon.learned and one.curve == two.curve


def test_toxicity_of_odd_rows(spark, labelled):
    docs, labels = labelled
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    for model in (toxicity.fit(empty, labels), toxicity.fit(docs, labels.limit(0)), toxicity.fit(docs, labels.where("toxic = 0"))):
        odd = spark.createDataFrame([(1, None), (2, ""), (None, "you " * 40_000 + "kill"), (3, "x" * 300_000), (3, "x" * 300_000), (4, '"' * 500 + ".?!\n")], "doc_id bigint, text string")
        got = toxicity.score(odd, model, ["doc_id"]).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(empty, model, ["doc_id"]).count() == 0
