"""The tokenizer of style sheets on sheets that single patterns get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import styles


def short(sheet):
    return [(r[3], r[4], r[5], r[6], r[7], r[8]) for r in styles.declarations(sheet)]


@pytest.mark.parametrize(
    ("sheet", "want"),
    [
        (None, []),
        ("", []),
        ("p{color:red}", [("", "p", "", "color", "red", [])]),
        ("p{color:red;;}", [("", "p", "", "color", "red", [])]),
        ("/* p{a:b} */ p{/*x*/a/**/:/*;*/b}", [("", "p", "", "a", "b", [])]),
        ("/* never ends p{a:b}", []),
        ('p{content:"}{;:";x:1}', [("", "p", "", "content", '"}{;:"', []), ("", "p", "", "x", "1", [])]),
        (r'p{content:"\"}";x:1}', [("", "p", "", "content", r'"\"}"', []), ("", "p", "", "x", "1", [])]),
        ("@media (min-width:10px){@media print{p{a:b}} i{c:d}}", [("", "p", "(min-width:10px) and print", "a", "b", []), ("", "i", "(min-width:10px)", "c", "d", [])]),
        ("@import url('a;b.css') print; @charset 'x';", [("", "", "", "@import", "url('a;b.css') print", ["a;b.css"]), ("", "", "", "@charset", "'x'", [])]),
        ("@FONT-FACE{font-family:X;src:URL( f.woff ),url('g h.woff')}", [("font-face", "", "", "font-family", "X", []), ("font-face", "", "", "src", "URL( f.woff ),url('g h.woff')", ["f.woff", "g h.woff"])]),
        (".a{.b &{c:d} e:f}", [("", ".a .b &", "", "c", "d", []), ("", ".a", "", "e", "f", [])]),
        ("p{background:url(data:image/svg+xml;utf8,<x/>)}", [("", "p", "", "background", "url(data:image/svg+xml;utf8,<x/>)", ["data:image/svg+xml;utf8,<x/>"])]),
        ("p{a:calc(1px + (2px;3px))}q{c:d}", [("", "p", "", "a", "calc(1px + (2px;3px))", []), ("", "q", "", "c", "d", [])]),
        ("}}p{a:b", [("", "p", "", "a", "b", [])]),
        ("p{a:(b}q{c:d}", [("", "p", "", "a", "(b", []), ("", "q", "", "c", "d", [])]),
        ("p{--X:1;COLOR:Red}", [("", "p", "", "--X", "1", []), ("", "p", "", "color", "Red", [])]),
        ("a:hover{b:c}", [("", "a:hover", "", "b", "c", [])]),
        ("p{nothing}", []),
    ],
)
def test_declarations(sheet, want):
    assert short(sheet) == want


def test_every_character_is_kept_when_nothing_changes():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["url(", ")", '"', "'", "/*", "*/", "{", "}", ";", "@import ", "a", "\\", "\n", "é", "u", "/", "(", "["]) for _ in range(rng.randint(0, 40)))
        assert styles.rewritten(text, lambda _: None) == text
        list(styles.declarations(text))


def test_rewriting():
    change = {"a.png": "x/a.png", "b'c.png": 'q"t.png', "lib.css": "l.css"}.get
    text = "@charset 'a';@import 'lib.css';/*url(a.png)*/p{b:url(a.png) url( \"b'c.png\" );c:\"url(a.png)\" 'lib.css'}@charset 'b';"
    assert styles.rewritten(text, change) == "@charset 'a';@import url('l.css');/*url(a.png)*/p{b:url(\"x/a.png\") url(\"q\\\"t.png\");c:\"url(a.png)\" 'lib.css'}"
    assert styles.rewritten(None, change) is None
    long = "p{b:url(a.png)}" * 20_000
    assert styles.rewritten(long, change).count("x/a.png") == 20_000 and sum(1 for _ in styles.declarations(long)) == 20_000


def test_sheets_as_tables(spark):
    sheets = spark.createDataFrame([(1, ":root{--a:1;--b:2}:root{--a:3}@media x{:root{--c:4}}@font-face{font-family:'F';font-weight:700}@font-face{font-weight:700;font-family:F}@font-face{font-family:F}"), (2, None), (3, "@media (min-width:10.4px) and (max-width: 300PX){p{a:b}@media (min-width:20px){q{c:d}}}")], "k int, css string")
    rows = styles.sheet_declarations(sheets.repartition(2), "k")
    assert sorted(tuple(r) for r in styles.custom_properties(rows, "k").collect()) == [(1, "--a", "1"), (1, "--b", "2")]
    assert sorted(tuple(r) for r in styles.font_faces(rows, "k").collect()) == [(1, "F", "700", "normal"), (1, "F", "normal", "normal")]
    assert [(r["k"], r["widths"]) for r in styles.media_widths(rows, "k").where("k = 3").collect()] == [(3, [10, 20, 300])]
    local = F.create_map(F.lit("/x.png"), F.lit("y.png"))
    out = styles.rewritten_sheets(spark.createDataFrame([(1, "p{a:url(/x.png)}"), (2, None)], "k int, css string").withColumns({"local": local, "prefix": F.lit("../")}), "k")
    assert sorted(((r["k"], r["css"]) for r in out.collect())) == [(1, 'p{a:url("../y.png")}'), (2, None)]
    html = spark.createDataFrame([("<STYLE media=x>a{b:c}</style ><p><style>d{e:f}</style>",), ("none",), (None,)], "h string")
    assert [r[0] for r in html.select(styles.style_elements(F.col("h"))).collect()] == ["a{b:c}\nd{e:f}", "", None]


def test_sheets_of_a_small_table_are_spread_and_tokenized_once(spark, sf):
    from pagewright.plans import registry

    plan = lambda name: registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan("sheet_declarations") and "MapInArrow" not in plan("sheet_tokens")
