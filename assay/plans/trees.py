"""Queries over manifests and trees that are made from the tables' rows: each customer stands for a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import declarations, manifests
from .catalogue import query, t

# Manifests by customer, seven formats; {n} is the nation, {k} the key. Beside each what it declares.
_FORMS = [
    ("requirements.txt", "# pins\n-r base.txt\nlib-{n}[x]>=2.{n} ; python_version > '3'\nother_{n}==1.{k}\n", [("lib-{n}", ">=2.{n}"), ("other_{n}", "==1.{k}")]),
    ("pyproject.toml", "[project]\nname = \"p\"\ndependencies = [ # \"no-{n}\"\n  \"lib-{n}>=2.{n}\",\n  'Other.{n}[a,b]', \"third\",\n]\n[tool.x]\ny = 1\n", [("lib-{n}", ">=2.{n}"), ("Other.{n}", ""), ("third", "")]),
    ("pyproject.toml", "[project]\nname = \"p\"\n[tool.poetry.dependencies]\npython = \"^3.9\"\nlib-{n} = \"^{n}\"\nrich = {version = \"1.{k}\", optional = true}\n[tool.poetry.group.dev.dependencies]\nno = \"1\"\n", [("lib-{n}", "^{n}"), ("rich", "1.{k}")]),
    ("setup.cfg", "[metadata]\nname = p\n[options]\nzip_safe = no\ninstall_requires =\n    lib-{n}>={n}\n    # none\n    third\npython_requires = >=3\n", [("lib-{n}", ">={n}"), ("third", "")]),
    ("setup.py", "from setuptools import setup\nREQS = ['lib-{n}', \"third>={k}\"]  # 'no'\nsetup(name='p', install_requires=REQS)\n", [("lib-{n}", ""), ("third", ">={k}")]),
    ("package.json", "{\"name\": \"p\", \"dependencies\": {\"lib-{n}\": \"^{n}\", \"@s/third\": \"{k}\"}, \"devDependencies\": {\"no\": \"1\"}}", [("lib-{n}", "^{n}"), ("@s/third", "{k}")]),
    ("Cargo.toml", "[package]\nname = \"p\"\n[dependencies]\nlib-{n} = \"{n}\"\nserde = { version = \"1.{k}\" }\n[dependencies.big]\nversion = \"7\"\n[dev-dependencies]\nno = \"1\"\n", [("lib-{n}", "{n}"), ("serde", "1.{k}"), ("big", "7")]),
    ("app.csproj", "<Project xmlns=\"u\"><!-- <PackageReference Include=\"No\" /> --><ItemGroup><PackageReference Include=\"Lib.{n}\" Version=\"{k}\" /><PackageReference Update=\"Third\"><Version> 2 </Version></PackageReference><ProjectReference Include=\"../x.csproj\" /></ItemGroup></Project>", [("Lib.{n}", "{k}"), ("Third", "2"), ("../x.csproj", "")]),
]


def _fill(template: str):
    """A template as a column: {n} and {k} are replaced."""
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), F.col("c_nationkey").cast("string")), F.lit("{k}"), F.col("c_custkey").cast("string"))


def _sql(template: str) -> str:
    text = template.replace("'", "''")
    return f"replace(replace('{text}', '{{n}}', c_nationkey::VARCHAR), '{{k}}', c_custkey::VARCHAR)"


def _trees(spark, sf_dir) -> DataFrame:
    """(repo, path, text): a manifest for each customer, and a lock file beside it."""
    # reading manifests costs far more than moving such short rows; without a number, partitions this small are joined again
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    form = F.col("c_custkey") % len(_FORMS)
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (file, content, _) in enumerate(_FORMS):
        name, text = F.when(form == i, file).otherwise(name), F.when(form == i, _fill(content)).otherwise(text)
    files = F.array(F.struct(name.alias("file"), text.alias("text")), F.struct(F.lit("package-lock.json").alias("file"), F.lit('{"dependencies": {"z": "1"}}').alias("text")))
    rows = c.select(F.col("c_custkey").alias("repo"), "c_nationkey", F.explode(files).alias("f"))
    return rows.select("repo", "c_nationkey", F.concat(F.lit("r"), "repo", F.lit("/"), "f.file").alias("path"), "f.text")


def _expected() -> str:
    rows = [f"SELECT c_custkey, c_nationkey, 'r' || c_custkey || '/{file}' AS path, {_sql(n)} AS name, {_sql(s)} AS specifier FROM customer WHERE c_custkey % {len(_FORMS)} = {i}" for i, (file, _, deps) in enumerate(_FORMS) for n, s in deps]
    return f"e AS ({' UNION ALL '.join(rows)})"


@query(f"WITH {_expected()} SELECT path, name, specifier FROM e")
def declared_dependencies(spark, sf_dir):
    """All that eight kinds of manifests declare."""
    return declarations.declared(manifests.without_lock_files(_trees(spark, sf_dir)))


@query(f"WITH {_expected()} SELECT split_part(path, '/', 2) AS file, count(DISTINCT path) AS files, count(*) AS dependencies FROM e GROUP BY 1")
def build_file_census(spark, sf_dir):
    """Manifests that declare something, lock files left out, by file name."""
    found = manifests.build_files(manifests.without_lock_files(_trees(spark, sf_dir)))
    return found.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("file")).agg(F.count("*").alias("files"), F.sum("dependencies").alias("dependencies"))


@query(f"WITH {_expected()} SELECT path, name, specifier FROM e WHERE NOT (lower(name) LIKE 'lib_%')")
def dependencies_after_removal(spark, sf_dir):
    """All manifests without the package lib-<nation>, read again."""
    files = manifests.without_lock_files(_trees(spark, sf_dir)).withColumn("gone", F.concat(F.lit("lib_"), "c_nationkey"))
    return declarations.declared(manifests.without(files, "gone").where("text IS NOT NULL"))


@query(f"WITH {_expected()} SELECT path, string_agg(name || specifier || chr(10), '' ORDER BY name || specifier) AS text FROM e GROUP BY 1")
def rewritten_requirements(spark, sf_dir):
    """What each manifest declares, written as a requirement file."""
    return manifests.requirements_text(declarations.declared(manifests.without_lock_files(_trees(spark, sf_dir))))


@query("""SELECT c_custkey AS repo, 'third' AS dep, 'r' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '/docs.txt' ELSE '/tox.ini' END AS path FROM customer WHERE c_custkey % 4 < 2""")
def second_sources(spark, sf_dir):
    """Repositories in which another file would install the package as well."""
    c = t(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, "x\n'Third>=1'\n").when(kind == 1, "[testenv]\nthird\n").when(kind == 2, "thirdly\n# third\n").otherwise("")
    files = c.select(F.col("c_custkey").alias("repo"), F.concat(F.lit("r"), "c_custkey", F.when(kind == 0, "/docs.txt").otherwise("/tox.ini")).alias("path"), text.alias("text"))
    return manifests.declares_elsewhere(files, c.select(F.col("c_custkey").alias("repo"), F.lit("third").alias("dep")), "repo", "dep")
