"""Sources and sinks: strict JSON lines, attribute pairs, archives, manifests, fixed-order CSV, artifacts, a response cache."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines (gzip by name) with a fixed schema; a broken line fails, a missing path is an empty table."""
    if not os.path.exists(path) and "://" not in path:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


@F.pandas_udf(T.StringType())
def _strict(lines):
    def check(line):
        def pairs(items):
            if len({k for k, _ in items}) < len(items):
                raise ValueError("duplicate key")
            return dict(items)

        def constant(name):
            raise ValueError(f"number {name}")

        try:
            json.loads(line, object_pairs_hook=pairs, parse_constant=constant)
        except (ValueError, TypeError) as e:
            return f"{e}"
        return None

    return lines.map(check)


def strict_errors(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no strict JSON, with the error: duplicate keys, non-finite numbers, syntax."""
    return lines.withColumn("error", _strict(column)).where("error is not null")


def attribute_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines `left TAB right TAB 0/1` with `COL k VAL v` records: record_1, record_2 (maps), gold_label, line_error."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), "value")

    def record(c):
        parts = F.filter(F.split(c, r"\s*\bCOL\s+"), lambda x: F.trim(x) != "")
        return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^(\S+)\s+VAL\b", 1)).alias("k"), F.trim(F.regexp_extract(x, r"\bVAL\b\s*(.*)$", 1)).alias("v"))))

    good = (F.size("f") == 3) & F.get("f", F.lit(2)).isin("0", "1")
    side = lambda i: F.when(good, record(F.get("f", F.lit(i))))
    return rows.select(side(0).alias("record_1"), side(1).alias("record_2"), F.when(good, F.when(F.get("f", F.lit(2)) == "1", "same").otherwise("different")).alias("gold_label"), F.when(~good, F.col("value")).alias("line_error"))


def archive_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """member, line of the text members of tar archives whose name ends with suffix."""

    def expand(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            lines = tar.extractfile(m).read().decode("utf-8").splitlines()
                            yield pd.DataFrame({"member": [m.name] * len(lines), "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(expand, "member string, line string")


def manifest_errors(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (name, bytes, sha256): missing, extra or changed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    have = files.select(base.alias("name"), F.col("length").alias("have_bytes"), F.sha2("content", 256).alias("have_sha"))
    both = manifest.join(have, "name", "full_outer")
    state = F.when(F.col("have_sha").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("sha256") != F.col("have_sha")) | (F.col("bytes") != F.col("have_bytes")), "changed")
    return both.select("name", state.alias("error")).where("error is not null")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report as one CSV file of fixed column order (for small tables)."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", "true").csv(path)


def create_artifact(path: str, payload: object) -> str:
    """Writes canonical JSON once: the same content again is no change, other content fails. Returns the digest."""
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    try:
        with open(path, "xb") as file:
            file.write(body)
    except FileExistsError:
        if open(path, "rb").read() != body:
            raise
    return hashlib.sha256(body).hexdigest()


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) with the latest cached response whose content matches its digest; null where there is none.

    cache: key, response, sha256, at.
    """
    latest = cache.where(F.sha2("response", 256) == F.col("sha256")).withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("at"), "sha256"))).where("_r = 1")
    return requests.join(latest.select("key", "response"), "key", "left")
