"""JSON lines, result trees, texts with their path as data, and dependency manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import lines, requirement_name


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Undecodable lines are dropped, blank ones skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n): how many lines that aren't blank can't be decoded."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    return rows.groupBy("file").agg(F.count_if(F.expr("try_parse_json(line) IS NULL")).alias("n"))


def result_tree(spark: SparkSession, roots: list[str], schema: str, key: str, name: str = "eval-result.json") -> DataFrame:
    """Results below several roots; of one key the one with the largest path stays."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).option("mode", "DROPMALFORMED").json(roots)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("path")))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def texts(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, text), one row a file."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def requirements(files: DataFrame) -> DataFrame:
    """(path, name) of requirement files(path, text)."""
    return files.select("path", F.explode(lines(F.col("text"))).alias("line")).select("path", requirement_name(F.col("line")).alias("name")).where("name IS NOT NULL")


def package_json(files: DataFrame) -> DataFrame:
    """(path, name, specifier) of the dependencies of package.json files(path, text)."""
    found = F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>")
    return files.select("path", F.explode(found).alias("name", "specifier"))


def wrapped_rows(spark: SparkSession, path: str | list[str], schema: str, wrapper: str) -> DataFrame:
    """Rows of JSON files that hold a list of rows, or an object with such a list under `wrapper`."""
    whole = texts(spark, path)
    rows = lambda c: F.from_json(c, f"array<struct<{schema}>>")
    body = F.when(F.ltrim("text").startswith("["), F.col("text")).otherwise(F.get_json_object("text", f"$.{wrapper}"))
    return whole.select("path", F.explode(rows(body)).alias("row")).select("path", "row.*")


def joined_logs(files: DataFrame, folder: Column, name: str = "path", text: str = "text") -> DataFrame:
    """(folder, log): the logs of a folder in order of their names."""
    parts = F.array_sort(F.collect_list(F.struct(name, text)))  # the few logs of one run
    return files.groupBy(folder.alias("folder")).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("log"))


def csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header; all values are strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def ragged_tsv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Tab-separated lines without a header; # begins a comment line, missing fields are empty, further ones are dropped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    return rows.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


# Folders that a walk over sources leaves out.
SKIPPED = ("node_modules", "site-packages", "venv", "env", "build", "dist", "__pycache__")


def source_files(files: DataFrame, suffix: str = ".py", path: str = "path") -> DataFrame:
    """files whose name ends so, outside of skipped and dotted folders. path is relative to the tree."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return files.where(F.col(path).endswith(suffix) & ~F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIPPED)))


def archive_members(spark: SparkSession, path: str | list[str], suffix: str = ".py") -> DataFrame:
    """(archive, member, text) of zip, wheel and tar archives; unreadable archives give no rows. One archive is one row of
    binaryFile and is opened in the task that read it."""

    def run(batches):
        import io
        import tarfile
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for name, data in zip(b["path"], b["content"], strict=True):
                try:
                    if zipfile.is_zipfile(io.BytesIO(data)):
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            out += [(name, m, z.read(m).decode("utf-8", "replace")) for m in z.namelist() if m.endswith(suffix)]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(data)) as t:
                            out += [(name, m.name, t.extractfile(m).read().decode("utf-8", "replace")) for m in t if m.isfile() and m.name.endswith(suffix)]
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
                    continue
            yield pd.DataFrame(out, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def project_references(files: DataFrame) -> DataFrame:
    """(path, name, specifier) of package and project references in XML project files(path, text), Include before Update."""
    from .manifests import declared

    return declared(files.where(F.col("path").endswith(".csproj")))


def toml_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, specifier) from pyproject.toml and Cargo.toml files(path, text)."""
    from .manifests import declared

    return declared(files.where(F.col("path").endswith(".toml")))
