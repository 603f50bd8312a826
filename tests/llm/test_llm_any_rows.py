"""Operators on columns of any name and type, on empty tables, and on very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat_format, decontamination, license_scan, quality_classifier, quality_rules, rows, secret_scan, sentencepiece_lattice, simhash_dedup, token_counts, warc
from pagewright.plans.session import scratch_path

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = ["one two three four five six seven eight nine ten eleven twelve", "password=abcdefghijklmnop is said in a text of more than ten words, is it not", None, ""]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns with dots, spaces and backticks, of types without an order, and with the operators' own names."""
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], DOCS)
    named = {c: F.lit(9) for c in ("row", "key", "h", "fp", "spans", "n_examples", "base_spans", "candidates", "failed", "kept", "metrics", "n_words", "license_ids", "matches", "permissive", "samples", "c0", "values", "bounds", "seed")}
    named |= {"a.b": F.lit("dot"), "sp ace": F.lit(1.5), "back`tick": F.lit(2), "map": F.create_map(F.lit("x"), F.lit(1)), "nothing": F.lit(None), "list.of": F.array(F.struct(F.lit(1).alias("x.y")))}
    return docs.withColumns(named)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TEXTS[0])], "item_id bigint, text string")


def test_stages_keep_odd_columns(odd, bench):
    stages = [quality_rules.quality_filter, simhash_dedup.keep_one, lambda d: decontamination.drop_contaminated(d, bench), lambda d: secret_scan.redact(d, length="n_chars")]
    for stage, ids in zip(stages, ([0, 1], [0, 1, 2], [1, 2, 3], [0, 1, 2, 3]), strict=True):
        out = stage(odd)
        found = sorted(out.collect(), key=lambda r: r["doc_id"])
        assert out.columns == odd.columns and [r["doc_id"] for r in found] == ids
        assert all(r["a.b"] == "dot" and r["map"] == {"x": 1} and r["kept"] == 9 and r["list.of"][0]["x.y"] == 1 for r in found)
        assert [f.dataType for f in out.schema if f.name == "back`tick"] == [f.dataType for f in odd.schema if f.name == "back`tick"]


def test_columns_that_are_made_take_the_place_of_others(odd):
    made = {
        "license_ids matches permissive": license_scan.scan_licenses(odd),
        "base_spans candidates": secret_scan.find_spans(odd),
        "spans n_examples": secret_scan.with_verdicts(secret_scan.find_spans(odd), "doc_id", "source"),
        " ".join(quality_rules.FEATURES): quality_rules.with_features(odd),
    }
    for names, out in made.items():
        assert len(set(out.columns)) == len(out.columns) and out.columns[-len(names.split()) :] == names.split()
        assert out.count() == len(TEXTS) and {r["a.b"] for r in out.select("`a.b`").collect()} == {"dot"}


def test_keys_and_texts_of_any_name_and_type(odd, bench):
    path = P.path("piece_bpe_32k.model")
    docs = odd.withColumn("my.key", F.struct(F.col("doc_id").alias("i.d"))).withColumn("my.text", F.col("text"))
    model = quality_classifier.Model(quality_classifier.np.zeros(1 << quality_classifier.BITS), quality_classifier.np.zeros(1 << quality_classifier.BITS), 0.0, 1.0, 0.0)
    found = [
        quality_classifier.score(docs, model, ["my.key"], "my.text"),
        decontamination.find_contamination(docs, bench, ["my.key"], "my.text"),
        token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), "my.key", "my.text"),
        sentencepiece_lattice.sample_segmentations(docs, path, ["my.key"], "doc_id", "my.text"),
        simhash_dedup.near_duplicates(docs, "my.key", "my.text"),
    ]
    for out in found:
        assert sorted(r["my.key"]["i.d"] for r in out.collect()) == [0, 1, 2, 3]
    back = sentencepiece_lattice.decode(docs.select("*", F.array(F.lit(3)).alias("my.ids")), path, "my.ids", "a.b")
    assert back.columns.count("a.b") == 1 and back.count() == 4


def test_names_in_other_case(odd):
    assert rows.chosen(odd, x="DOC_ID").count() == 4
    assert rows.packed(odd, x="doc_id").select("row.*").toDF(*odd.columns).columns == odd.columns


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(9,2)", "date", "string", "struct<a:int>"])
def test_conversations_of_any_type(spark, kind):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id int, turn bigint, role string, text string")
    value = {"date": F.make_date(F.lit(2020), F.lit(1), "conv_id"), "struct<a:int>": F.struct(F.col("conv_id").alias("a"))}.get(kind, F.col("conv_id").cast(kind if "<" not in kind else "int"))
    named = turns.withColumn("conv_id", value).withColumns({"x.y": F.lit(1), "seq": F.lit(7), "formatted": F.lit("z")})
    out = chat_format.digests(chat_format.format_chats(chat_format.turn_events(named))).collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in out] == [(2, 1)]


def test_pages_of_any_columns_and_none(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "same") for i in range(3)], "page_id smallint, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("_sha1", "_first", "_id", "row", "key", "payload", "sha1", "first", "copies", "id", "refers_to")} | {"a.b": F.create_map(F.lit(1), F.lit(2))})
    path = scratch_path(spark, "any-warc")
    warc.write_archives(pages, path)
    found = warc.assemble(warc.read_records(spark, path)).collect()
    assert sorted(dict(c["metadata"]["fields"]).get("refersTo", "") for c in found) == ["", "2", "2"]
    assert {c["response"]["refers_to_uri"] for c in found if c["response"]["type"] == "revisit"} == {"http://a/2"}
    assert warc.with_revisits(pages).select("row.*").toDF(*pages.columns).columns == pages.columns
    empty = scratch_path(spark, "no-warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_empty_tables(spark, bench):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    assert license_scan.scan_licenses(empty).count() == 0
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert 0 <= quality_classifier.fit(empty, labels).score(quality_classifier.np.zeros(0, "int32")) <= 1
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert secret_scan.with_verdicts(secret_scan.find_spans(empty), "doc_id", "source").count() == 0
    assert quality_rules.sketches(quality_rules.with_features(empty)).count() == 0
    assert decontamination.find_contamination(empty, bench, ["doc_id"]).count() == 0
    path = P.path("piece_bpe_32k.model")
    assert sentencepiece_lattice.decode(spark.createDataFrame([], "ids array<int>"), path, "ids", "text").count() == 0
    with pytest.raises(ValueError, match="one segmentation"):
        sentencepiece_lattice.sample_segmentations(empty, path, ["doc_id"], k=0)
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.digests(chat_format.format_chats(chat_format.turn_events(turns))).count() == 0


def test_very_long_texts(spark):
    """A text of 60,000 words and one of half a megabyte without a space go through every operator whole."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60_000)]
    long = " ".join(words) + " token=abcdefghijkl0123 Released"
    solid = "".join(rng.choice("etaoin") for _ in range(500_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, long + " tail", "en", "s", 0), (3, solid, "en", "s", 0)], DOCS)
    bench = spark.createDataFrame([(7, " ".join(words[50_000:53_500]))], "item_id bigint, text string")
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.judged(decontamination.find_contamination(docs, bench, ["doc_id"])).collect()}
    assert hits == {1: (60_003, 3_500, True), 2: (60_004, 3_500, True), 3: (1, 0, False)}
    spans = {r["doc_id"]: r["s"] for r in secret_scan.find_spans(docs).select("doc_id", secret_scan.shown("base_spans").alias("s")).collect()}
    at = long.index("token=")
    assert spans == {1: f"assign:{at}:{at + 22}", 2: f"assign:{at}:{at + 22}", 3: ""}
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()) == [1, 3]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ((1, long), (3, solid))}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got[1] == want[1] and got[3] == want[3]
    assert all(r["decoded"] for r in sentencepiece_lattice.sample_segmentations(docs, P.path("piece_bpe_32k.model"), ["doc_id"], check=True).collect())
    assert license_scan.scan_licenses(docs).where("size(license_ids) > 0").count() == 0
    assert quality_rules.with_features(docs).where("n_words > 60000").count() == 2
