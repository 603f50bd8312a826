"""Documents held against typed paths, against a plain walk; orders by locale."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import order
from pagewright.sources import coercion

RULES = (("id", "string", True, 5), ("n", "number", False, None), ("ok", "boolean", False, None), ("list", "list", True, 3), ("list[]", "object", False, None), ("list[].name", "string", True, 4), ("list[].tags", "list", False, 2), ("list[].tags[]", "string", False, None), ("o", "object", False, None), ("o.x", "number", True, None))


def plain_kind(v):
    return {str: "string", bool: "boolean", int: "number", float: "number", list: "list", dict: "object", type(None): "null"}[type(v)]


def plain_walk(text):
    """What is taken, and what is reported, of one document."""
    rules = {p: (k, r, m) for p, k, r, m in RULES}
    taken, told = [], []
    try:
        root = json.loads(text) if text is not None else None
    except ValueError:
        root = None
    if not isinstance(root, dict):
        return [], [("", "", "malformed", 1)]

    def visit(value, path, location):
        kind, _, most = rules[path] if path else ("object", True, None)
        if path and plain_kind(value) != kind:
            told.append((location, path, "wrong_kind", 1))
            return
        if isinstance(value, str) and most is not None and len(value) > most:
            told.append((location, path, "too_long", len(value) - most))
        if isinstance(value, list):
            if most is not None and len(value) > most:
                told.append((location, path, "excess", len(value) - most))
            if path + "[]" in rules:
                for i, x in enumerate(value[:most]):
                    visit(x, path + "[]", f"{location}[{i}]")
        elif isinstance(value, dict):
            dot = path and path + "."
            for name, x in value.items():
                if dot + name in rules:
                    visit(x, dot + name, f"{location}.{name}" if location else name)
            for p, (_, needed, _) in rules.items():
                if needed and p.rpartition(".")[0] == path and not p.endswith("]") and p.rpartition(".")[2] not in value and (p.startswith(dot) if dot else "." not in p):
                    told.append((f"{location}.{p.rpartition('.')[2]}" if location else p, p, "missing", 1))
        else:
            taken.append((path, location, (value if most is None else value[:most]) if isinstance(value, str) else json.dumps(value)))

    visit(root, "", "")
    return sorted(taken), sorted(told)


def test_members_equal_a_plain_walk(spark):
    rng = random.Random(6)

    def value(depth):
        pick = rng.random()
        if depth > 2 or pick < 0.45:
            return rng.choice(["a", "longer text", "é🎉xyz", 1, 2.5, True, False, None, 12345678901234])
        if pick < 0.7:
            return [value(depth + 1) for _ in range(rng.randint(0, 5))]
        return {rng.choice(["id", "n", "name", "tags", "x", "other"]): value(depth + 1) for _ in range(rng.randint(0, 4))}

    texts = []
    for _ in range(150):
        made = {k: value(1) for k in rng.sample(["id", "n", "ok", "list", "o", "zzz"], rng.randint(0, 6))}
        if rng.random() < 0.5:
            made["list"] = [{"name": rng.choice(["ab", "abcdef", 3]), "tags": [rng.choice(["t", 5]) for _ in range(rng.randint(0, 4))]} for _ in range(rng.randint(0, 5))]
        texts.append(json.dumps(made, ensure_ascii=False))
    texts += [None, "", "{", "[1]", "7", "null", "{}", '{"id": "x", "list": []}', '{"list": [[1]], "o": {"x": "1"}}']
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rules = coercion.rule_table(spark, RULES)
    found = coercion.members(table, "k", "t", rules).cache()
    taken, told = {}, {}
    for r in coercion.accepted(found).collect():
        taken.setdefault(r["key"], []).append((r["path"], r["location"], r["value"]))
    for r in coercion.report(found, rules).collect():
        told.setdefault(r["key"], []).append((r["location"], r["path"], r["problem"], r["n"]))
    for i, text in enumerate(texts):
        assert (sorted(taken.get(i, [])), sorted(told.get(i, []))) == plain_walk(text), text


def test_rules_are_whole(spark):
    with pytest.raises(ValueError, match="no rule for what holds"):
        coercion.rule_table(spark, [("a.b", "string", False, None)])
    deep = [("a" + "[]" * i, "list", False, None) for i in range(14)]
    with pytest.raises(ValueError, match="deeper than"):
        coercion.members(spark.createDataFrame([(1, "{}")], "k int, t string"), "k", "t", coercion.rule_table(spark, deep))


def test_order_by_locale(spark):
    words = ["zebra", "Äpfel", "apfel", "Apfel", "école", "Ecole", "ecole", "ß", "ss", "st", "-a", "a b", "ab", "É"]
    table = spark.createDataFrame([("g", w) for w in words] + [("h", "z"), ("h", "ä")], "k string, w string").repartition(3)
    got = {(r["k"], r["place"]): r["w"] for r in order.placed(table, ["k"], ["w"], "place").collect()}
    assert [got["g", i + 1] for i in range(len(words))] == ["-a", "a b", "ab", "apfel", "Apfel", "Äpfel", "É", "ecole", "Ecole", "école", "ss", "ß", "st", "zebra"]
    assert [got["h", i] for i in (1, 2)] == ["ä", "z"]
    plain = {r["place"]: r["w"] for r in order.placed(table.where("k = 'g'"), ["k"], ["w"], "place", collation=None).collect()}
    assert [plain[i + 1] for i in range(len(words))] == sorted(words)
    assert table.select(F.col("w")).where(order.localed("w") == "ab").count() == 1


def test_documents_are_read_once_and_never_shuffled(spark, sf):
    from pagewright.plans import registry

    for name in ("evidence_report", "event_property_report"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "hashpartitioning(key" not in plan
