"""Documents from outside, held against a table of typed paths: what fits is kept, what does not is reported.

A document becomes a VARIANT and is opened level by level: each level's containers
are exploded into themselves and their members, which meet the rules of their paths
by a broadcast join.  So a member of a wrong type, or one too many, is a row of a
report and never an error, a document may have any number of members, and it is read
and parsed once, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule may ask of a member, and the schema of rules: ``path`` has [] for members of lists; ``most`` bounds
#: characters of a string, members of a list or of an object; null is no bound.
KINDS = ("string", "number", "boolean", "list", "object")
RULES = "path string, kind string, required boolean, most int"
#: Levels below a document's root that are opened, at most.
MOST_LEVELS = 12


def kind_of(value: Column) -> Column:
    """The kind of a VARIANT: one of KINDS, null, or other."""
    name = F.schema_of_variant(value)
    plain = F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
    number = name.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(number, "number").otherwise(F.coalesce(plain, F.when(F.startswith(name, F.lit("ARRAY<")), "list").when(F.startswith(name, F.lit("OBJECT<")), "object").otherwise("other")))


def members(documents: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """Rows (key, level, path, place, location, kind, value, n_members, wanted, most) of all members that rules name, the roots included.

    ``path`` is the member's path in rules, ``location`` where it stands; ``place``
    is its number in its list.  Members of containers that have a wrong kind, that
    stand beyond their list's bound, or that no rule names are not opened.
    """
    known = F.broadcast(rules.select(F.col("path").alias("_path"), F.col("kind").alias("wanted"), "most"))  # a table that is written by hand
    roots = documents.select(F.col(key).alias("key"), F.try_parse_json(F.coalesce(F.col(text), F.lit(""))).alias("value"))
    here = roots.select("key", F.lit(0).alias("level"), F.lit("").alias("path"), F.lit(None).cast("int").alias("place"), F.lit("").alias("location"), kind_of(F.col("value")).alias("kind"), "value", F.lit("object").alias("wanted"), F.lit(None).cast("int").alias("most"))
    deepest = rules.select(F.max(F.size(F.split(F.replace("path", F.lit("[]"), F.lit(".[]")), r"\.")))).first()[0] or 0
    if deepest > MOST_LEVELS:
        raise ValueError(f"rules are deeper than {MOST_LEVELS} levels")
    for level in range(1, deepest + 1):
        # a container that was reached last gives itself and its members, any other row itself (a null position)
        opens = (F.col("level") == level - 1) & F.col("kind").isin("list", "object") & (F.col("kind") == F.col("wanted"))
        own = here.withColumn("_open", F.coalesce(opens, F.lit(False)))
        spread = own.lateralJoin(documents.sparkSession.tvf.variant_explode_outer(F.when(F.col("_open"), F.col("value")).outer()).toDF("_pos", "_name", "_member"))
        both = spread.withColumn("_self", F.explode(F.when(F.col("_open") & F.col("_pos").isNotNull(), F.when(F.col("_pos") == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).otherwise(F.array(F.lit(True)))))
        listed = F.col("kind") == "list"
        inner = F.when(listed, F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "_name"))
        within = F.when(listed, F.concat("location", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat("location", F.when(F.col("location") == "", "").otherwise("."), "_name"))
        fits = F.col("_self") | ~listed | F.col("most").isNull() | (F.col("_pos") < F.col("most"))
        pick = lambda name, member: F.when(F.col("_self"), F.col(name)).otherwise(member).alias(name)
        placed = both.where(fits).select(
            "key", pick("level", F.lit(level)), pick("path", inner), pick("place", F.when(listed, F.col("_pos"))), pick("location", within), pick("kind", kind_of(F.col("_member"))), pick("value", F.col("_member")),
            F.when(F.col("_self"), F.col("wanted")).alias("_wanted"), F.when(F.col("_self"), F.col("most")).alias("_most"), "_self",
        )
        met = placed.join(known, ~F.col("_self") & (F.col("path") == F.col("_path")), "left").where(F.col("_self") | F.col("_path").isNotNull())
        here = met.select("key", "level", "path", "place", "location", "kind", "value", F.coalesce("_wanted", "wanted").alias("wanted"), F.when(F.col("_self"), F.col("_most")).otherwise(F.col("most")).alias("most"))
    return here


def accepted(found: DataFrame) -> DataFrame:
    """Rows (key, path, location, value): the values, as text and cut to their bounds, of members that have the kind that rules want."""
    plain = found.where((F.col("kind") == F.col("wanted")) & F.col("kind").isin("string", "number", "boolean"))
    text = F.try_variant_get("value", "$", "string")
    cut = F.when((F.col("kind") == "string") & F.col("most").isNotNull(), F.substring(text, F.lit(1), F.col("most"))).otherwise(text)
    return plain.select("key", "path", "location", cut.alias("value"))


def report(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (key, location, path, problem, n) of what was not taken as it is.

    malformed: the document is no JSON object; wrong_kind: a member has another
    kind; too_long: so many characters were cut off; excess: so many members of a
    list were left out; missing: a required member of an object that is there is not.
    """
    up = F.regexp_replace("path", r"(^|\.)[^.\[\]]+$", "")
    need = F.struct(F.regexp_extract("path", r"([^.\[\]]+)$", 1).alias("name"), F.col("path").alias("path"))
    needed = F.broadcast(rules.where("required AND NOT endswith(path, '[]')").groupBy(up.alias("_of")).agg(F.collect_list(need).alias("_needs")))
    is_root = F.col("level") == 0
    one = lambda problem, n: F.array(F.struct(F.col("location").alias("location"), F.col("path").alias("path"), problem.alias("problem"), n.cast("int").alias("n")))
    none = F.array().cast("array<struct<location:string,path:string,problem:string,n:int>>")
    malformed = F.when(is_root & (F.col("kind").isNull() | (F.col("kind") != "object")), one(F.lit("malformed"), F.lit(1)))
    wrong = F.when(~is_root & (F.col("kind") != F.col("wanted")), one(F.lit("wrong_kind"), F.lit(1)))
    size = F.when(F.col("kind") == "string", F.length(F.try_variant_get("value", "$", "string"))).when(F.col("kind") == "list", F.size(F.try_variant_get("value", "$", "array<variant>")))
    over = F.when(~is_root & (F.col("kind") == F.col("wanted")) & (size > F.col("most")), one(F.when(F.col("kind") == "string", "too_long").otherwise("excess"), size - F.col("most")))
    held = F.map_keys(F.try_variant_get("value", "$", "map<string,variant>"))
    inside = lambda x: F.concat("location", F.when(F.col("location") == "", "").otherwise("."), x["name"])
    gone = F.transform(F.filter("_needs", lambda x: ~F.array_contains(held, x["name"])), lambda x: F.struct(inside(x).alias("location"), x["path"].alias("path"), F.lit("missing").alias("problem"), F.lit(1).alias("n")))
    missing = F.when((F.col("kind") == "object") & (F.col("wanted") == "object"), gone)
    rows = found.join(needed, F.col("path") == F.col("_of"), "left")
    return rows.select("key", F.explode(F.concat(*[F.coalesce(x, none) for x in (malformed, wrong, over, missing)])).alias("x")).select("key", "x.location", "x.path", "x.problem", "x.n")


def rule_table(spark, rules: Sequence[tuple[str, str, bool, int | None]]) -> DataFrame:
    """Rules (path, kind, required, most) as a table; the containers on a path must have rules of their own."""
    paths = {r[0] for r in rules}
    for path, kind, _, _ in rules:
        up = path.removesuffix("[]") if path.endswith("[]") else path.rpartition(".")[0]
        if kind not in KINDS or (up and up not in paths):
            raise ValueError(f"no kind {kind}, or no rule for what holds {path}")
    return spark.createDataFrame(list(rules), RULES)
