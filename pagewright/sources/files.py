"""File sources and sinks of scans: evidence documents, assets, archives, manifests.

All go through Spark's readers and writers, so inputs may be in any store that
Spark reaches, and outputs are committed as a whole.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import is_safe_project_path
from pagewright.sources.tables import Conflict, TableLog

#: Fixed values.
MOST_FILES, MOST_BYTES = 2000, 64 << 20
EVIDENCE = "page_id string, url string, status int, nodes array<struct<id:string,parent_id:string,tag:string,role:string,text:string,classes:array<string>,visible:boolean>>, node_count int"


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents, one per line of JSON, with a reason for what cannot be used: malformed or no_nodes."""
    rows = spark.read.text(path).withColumn("e", F.from_json("value", EVIDENCE))
    reason = F.when(F.try_parse_json("value").isNull(), "malformed").when(F.col("e.nodes").isNull(), "no_nodes")
    return rows.select("e.*", reason.alias("reason"))


def coerce_nodes(rows: DataFrame) -> DataFrame:
    """One row per node: nodes without an id are dropped, missing values have defaults."""
    flat = rows.select("page_id", F.posexplode("nodes").alias("seq", "n")).where(F.coalesce("n.id", F.lit("")) != "")
    empty = F.lit("")
    return flat.select(
        "page_id",
        "seq",
        F.col("n.id").alias("node_id"),
        F.col("n.parent_id").alias("parent_id"),
        F.coalesce("n.tag", empty).alias("tag"),
        F.coalesce("n.role", empty).alias("role"),
        F.coalesce("n.text", empty).alias("text"),
        F.coalesce("n.classes", F.array().cast("array<string>")).alias("classes"),
        F.coalesce("n.visible", F.lit(False)).alias("visible"),
    )


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Files with their hash; of equal files the one with the smallest path stays."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return files.groupBy("sha256").agg(F.min_by(F.struct("path", "size_bytes"), "path").alias("f")).select("sha256", "f.*")


def manifest(routes: DataFrame, assets: DataFrame) -> DataFrame:
    """One JSON document per scan with counts and sorted entries."""
    r = routes.groupBy("scan_id").agg(F.array_sort(F.collect_list("file")).alias("routes"))
    a = assets.groupBy("scan_id").agg(F.array_sort(F.collect_list("file")).alias("assets"))
    none = F.array().cast("array<string>")
    both = r.join(a, "scan_id", "full").select("scan_id", F.coalesce("routes", none).alias("routes"), F.coalesce("assets", none).alias("assets"))
    return both.select("scan_id", F.to_json(F.struct(F.size("routes").alias("route_count"), F.size("assets").alias("asset_count"), "routes", "assets")).alias("manifest"))


def archives(files: DataFrame, key: str, volumes: bool = False) -> DataFrame:
    """One stored archive per key from rows (key, path, content), entries sorted, times fixed.

    A key whose paths are unsafe, or whose files are too many or too large, has a
    reason instead; the sizes are checked before any content is gathered.  With
    ``volumes`` nothing is too many or too large: a key has as many archives, a row
    each, as hold all of its files, which hashes of their paths spread over groups
    of half a volume, so that no task holds the whole key.  A file that is larger
    than a volume is one alone.
    """
    sums = files.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"), F.bool_and(is_safe_project_path(F.col("path"))).alias("safe"))
    reason = F.when(~F.col("safe"), "unsafe_path")
    if not volumes:
        reason = reason.when(F.col("n") > MOST_FILES, "too_many_files").when(F.col("bytes") > MOST_BYTES, "too_large")
    over = (F.col("n") > MOST_FILES) | (F.col("bytes") > MOST_BYTES)
    groups = F.when(over, F.greatest(F.ceil(2 * F.col("n") / MOST_FILES), F.ceil(2 * F.col("bytes") / MOST_BYTES))).otherwise(F.lit(1).cast("long"))
    judged = sums.select(key, reason.alias("reason"), groups.alias("_groups"))
    good = files.join(judged.where("reason IS NULL").select(key, "_groups"), key).withColumn("_group", F.pmod(F.xxhash64("path"), "_groups"))
    kind = files.schema[key].dataType.simpleString()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        made: list[bytes] = []
        held: list[tuple[str, bytes]] = []
        size = 0
        for path, content in sorted(zip(rows["path"], rows["content"], strict=True)):
            if held and (len(held) == MOST_FILES or size + len(content) > MOST_BYTES):
                made.append(_packed(held))
                held, size = [], 0
            held.append((path, content))
            size += len(content)
        made.append(_packed(held))
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(made), "archive": made})

    made = good.select(key, "_group", "path", "content").groupBy(key, "_group").applyInPandas(pack, f"{key} {kind}, archive binary")
    return judged.drop("_groups").join(made, key, "left")


def _packed(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, content in files:
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def read_archive(archive: DataFrame, key: str) -> DataFrame:
    """Rows (key, path, size, crc) of each archive; checksums are verified as entries are read."""
    kind = archive.schema[key].dataType.simpleString()

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["key"], batch["archive"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = [(name, i.filename, len(z.read(i)), i.CRC) for i in z.infolist()]
                yield pd.DataFrame(rows, columns=["key", "path", "size", "crc"])

    return archive.select(F.col(key).alias("key"), "archive").mapInPandas(unpack, f"key {kind}, path string, size bigint, crc bigint").withColumnRenamed("key", key)


#: The name of a table that is the only one below its path.
ONLY = "table"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The state of a table that was last switched to."""
    return TableLog(spark, path).read(ONLY)


def replace_table(df: DataFrame, path: str, base: int | None = None) -> DataFrame:
    """Writes a table's next state beside the old one, then switches to it; the new state.

    ``df`` may read from the table itself.  Readers see the old state until the
    switch; a job that fails before that leaves the table as it was.  With ``base``,
    the version that ``df`` was made from, a switch that another writer has made
    since is a Conflict; without it the state at the call counts.  Old states stay
    until ``vacuum_table``.
    """
    log = TableLog(df.sparkSession, path)
    with log.begin() as own:
        if base is not None and log.states(base).get(ONLY) != own.seen.get(ONLY):
            raise Conflict(f"the table changed after version {base}")
        own.write(ONLY, df)
    return log.read(ONLY, own.version)


def vacuum_table(spark: SparkSession, path: str) -> list[str]:
    """Removes all states of a table but the one that readers see; their names."""
    return TableLog(spark, path).vacuum()
