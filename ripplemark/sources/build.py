"""Build descriptions as tables: compile commands, CMake's file API, include lines and configurations."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMANDS = "directory string, file string, command string, arguments array<string>"


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, args): the first entry of each file stands; compiler, input, output and dependency switches go.

    Paths are made absolute against the entry's directory."""
    raw = spark.read.schema(COMMANDS).option("multiLine", True).json(path)
    words = F.coalesce("arguments", F.filter(F.split(F.btrim("command"), r"\s+"), lambda x: x != ""))
    x = raw.select("directory", F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file")).alias("path"), F.col("file").alias("_f"), words.alias("words"), F.monotonically_increasing_id().alias("_n"))
    takes_value = F.lit(["-o", "-MF", "-MT", "-MQ", "-MJ"])
    alone = F.lit(["-c", "-MD", "-MMD", "-MP", "-MG", "-M", "-MM"])
    kept = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get("words", i - 1)).alias("before"), i.alias("i"))),
        lambda s: (s["i"] > 0) & ~F.array_contains(takes_value, s["w"]) & ~F.coalesce(F.array_contains(takes_value, s["before"]), F.lit(False)) & ~F.array_contains(alone, s["w"]) & (s["w"] != F.col("_f")) & (s["w"] != F.col("path")),
    )
    y = x.withColumn("args", F.transform(kept, lambda s: s["w"]))
    first = Window.partitionBy("path").orderBy("_n")
    return y.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(F.col("path").alias("file"), "directory", "args")


def defines(commands: DataFrame) -> DataFrame:
    """(file, macro, value) of all -D switches, joined or apart."""
    a = F.filter(F.transform("args", lambda w, i: F.when(w == "-D", F.get("args", i + 1)).when(w.startswith("-D"), F.substring(w, 3, 10_000))), lambda x: x.isNotNull() & (x != ""))
    d = commands.select("file", F.explode(a).alias("d"))
    return d.select("file", F.regexp_extract("d", "^([^=]+)", 1).alias("macro"), F.nullif(F.regexp_extract("d", "=(.*)$", 1), F.lit("")).alias("value"))


def configurations(commands: DataFrame) -> DataFrame:
    """The configurations built: Release where NDEBUG is defined, else Debug."""
    n = defines(commands).where("macro = 'NDEBUG'").select("file").distinct().withColumn("config", F.lit("Release"))
    return commands.select("file").distinct().join(n, "file", "left").select(F.coalesce("config", F.lit("Debug")).alias("config")).distinct()


def is_stale(commands: str, root: str, slack: float = 1.0) -> bool:
    """Whether a CMake file below root is newer than the compile commands."""
    at = os.path.getmtime(commands) + slack
    return any(p.stat().st_mtime > at for pat in ("CMakeLists.txt", "*.cmake") for p in Path(root).rglob(pat))


def target_model(spark: SparkSession, reply: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, sources, needs) of CMake's file API reply folder: name and type; target and file; target and needs."""
    folder = Path(reply)
    index = json.loads(sorted(folder.glob("index-*.json"))[-1].read_text())
    model = next(o["jsonFile"] for o in index["objects"] if o["kind"] == "codemodel")
    files = [t["jsonFile"] for c in json.loads((folder / model).read_text())["configurations"][:1] for t in c["targets"]]
    schema = T.StructType.fromDDL("id string, name string, type string, sources array<struct<path string>>, dependencies array<struct<id string>>")
    t = spark.read.schema(schema).option("multiLine", True).json([str(folder / f) for f in files]) if files else spark.createDataFrame([], schema)
    needs = t.select(F.col("name").alias("target"), F.explode("dependencies.id").alias("id")).join(t.select("id", F.col("name").alias("needs")), "id").select("target", "needs")
    return t.select("name", "type"), t.select(F.col("name").alias("target"), F.explode("sources.path").alias("file")), needs


INCLUDE = re.compile(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]')


def includes(lines: DataFrame) -> DataFrame:
    """(file, wanted) of all include lines. lines: file, text."""
    w = F.regexp_extract("text", INCLUDE.pattern, 1)
    return lines.select("file", w.alias("wanted")).where("wanted <> ''").distinct()


def source_files(spark: SparkSession, root: str, glob: str = "*.{c,cc,cpp,cxx,h,hh,hpp,hxx}") -> DataFrame:
    """(file, no, text): the lines of all sources below a folder, read by the executors."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(root)
    f = f.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("p", "text"))
    return f.select("file", (F.col("p") + 1).alias("no"), "text")
