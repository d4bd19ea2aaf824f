from assay.plans import trees
from assay.sources import declarations, files, manifests
from assay.streaming import ingest
from pyspark.sql import functions as F


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":1}\n\n{bad\n')
    assert [r.k for r in files.json_lines(spark, str(tmp_path), "k int").collect()] == [1]
    assert [r.n for r in files.malformed_lines(spark, str(tmp_path)).collect()] == [1]


def test_result_tree(spark, tmp_path):
    for d, v in (("r1/a", 1), ("r2/b", 2)):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "eval-result.json").write_text('{"id": "x", "v": %d}' % v)
    got = files.result_tree(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], "id string, v int", "id").collect()
    assert [(r.id, r.v) for r in got] == [("x", 2)]


def test_manifests(spark, tmp_path):
    texts = {
        "requirements.txt": "a==1\n# c\n-r x\nB[x]>2\n",
        "package.json": '{"dependencies": {"left": "^1"}}',
        "p.csproj": '<Project><PackageReference Include="N.J" Version="1"/><PackageReference Update="U"/></Project>',
        "pyproject.toml": '[project]\ndependencies = ["q>=1", "z[w]"]\n',
        "Cargo.toml": '[dependencies]\nserde = "1"\n',
        "broken.toml": "[x",
    }
    for name, body in texts.items():
        (tmp_path / name).write_text(body)
    read = lambda glob: files.texts(spark, str(tmp_path), glob)
    assert sorted(r.name for r in files.requirements(read("requirements.txt")).collect()) == ["B", "a"]
    assert [(r.name, r.specifier) for r in files.package_json(read("package.json")).collect()] == [("left", "^1")]
    assert sorted(r.name for r in files.project_references(read("*.csproj")).collect()) == ["N.J", "U"]
    assert sorted(r.name for r in files.toml_dependencies(read("*.toml")).collect()) == ["q", "serde", "z"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts": "2024-01-01T00:10:00", "kind": "a"}\n{"ts": "2024-01-01T00:20:00", "kind": "a"}\n{bad\n')
    stream = ingest.windowed_counts(ingest.json_stream(spark, str(tmp_path / "in"), "ts timestamp, kind string"), "ts", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("counts").collect()] == [2]


MANIFESTS = [
    ("a/pyproject.toml", '[project]\nname = "p"\ndependencies = []\n[tool.poetry.dependencies]\npython = "^3"\n"quoted.name" = "1"\nx = { git = "u", version = \'2\' }\ny = "~3" # note "4"\n[tool.poetry.dependencies.deep]\nversion = "5"\nextras = ["q"]\n'),
    ("b/pyproject.toml", '[build-system]\nrequires = ["no"]\n[project]\ndescription = "a # b [c"\ndependencies = [\n  "one[x]>=1,<2 ; python_version > \'3\'",  # a "comment"\n  \'two\', # ]\n  "three @ https://u/v#frag",\n]\noptional-dependencies = {t = ["no"]}\n'),
    ("c/pyproject.toml", "[broken"),
    ("d/pyproject.toml", None),
    ("e/Cargo.toml", '[package]\nversion = "9"\n[dependencies]\nserde = "1"\nrand = { version = "0.8", features = ["x"] }\n"odd-one" = { path = "../o" }\n[dependencies.big]\nfeatures = ["a"]\nversion = "7"\n[target.x.dependencies]\nno = "1"\n'),
    ("f/setup.cfg", "[options]\ninstall_requires = one\n[options.extras_require]\nt = no\n"),
    ("g/setup.cfg", "[metadata]\ninstall_requires = no\n[options]\npackages = find:\ninstall_requires =\n\tone>=1\n\n    # c\n    two~=2 # c\nkeywords = z\n"),
    ("h/setup.py", "from setuptools import setup\nsetup(name='x', install_requires=[\n  'one>=1',  # don't\n  \"two\" ,\n], extras_require={'t': ['no']})\n"),
    ("i/setup.py", "import setuptools as s\nR = (\n 'a',\n 'b==2',\n)\ns.setup(install_requires=R, name='n')\n"),
    ("j/setup.py", "setup(name='none')\n"),
    ("k/package.json", '{"dependencies": {"a": "1", "@b/c": "^2"}, "x": {"dependencies": {"no": "1"}}}'),
    ("l/package.json", '{"name": "n"}'),
    ("m/x.csproj", '<Project><ItemGroup>\n<PackageReference Version="1" Include="A.B">\n<PrivateAssets>all</PrivateAssets>\n</PackageReference>\n<PackageReference Update="C"><Version>\n2 </Version></PackageReference><Reference Include="no" /><!-- <PackageReference Include="no" />\n--></ItemGroup></Project>'),
    ("n/requirements-dev.txt", "a\r\n  b>=1 # c\n-e .\n--hash x\n\n# d\nC_d.e[f,g] == 2 ; m\nhttps://no/x\n"),
    ("o/readme.md", "a"),
]


def test_manifests_by_expressions_against_full_grammars(spark):
    df = spark.createDataFrame(MANIFESTS, "path string, text string")
    got = sorted(tuple(r) for r in declarations.declared(df).collect())
    want = sorted((p, n, s) for p, t in MANIFESTS if t != "[broken" for n, s in manifests._declared(p, t) or ())
    assert got == want


def test_formats_and_sections(spark):
    df = spark.createDataFrame([(p,) for p in ("x/Cargo.toml", "requirements.in", "my-requirements.txt", "A.csproj", "setup.cfg.bak", None)], "p string")
    assert [r.f for r in df.select(declarations.file_format(F.col("p")).alias("f")).collect()] == ["cargo", "requirements", None, "csproj", None, None]
    one = spark.createDataFrame([("top = 1\n[a]\nx = 1\n[[b]]\n[ c ]\n",)], "t string").select(declarations.sections(F.col("t")).alias("s")).first()
    assert [(s.header, s.body) for s in one.s] == [("a", "\nx = 1\n[[b]]\n"), ("c", "\n")]


def test_removals_from_manifests_of_all_formats(spark):
    rows = [
        ("a/x.csproj", '<Project xmlns="u"><!-- <PackageReference Include="A.B" /> --><ItemGroup><PackageReference Include="A.B" Version="1" /><PackageReference Update=\'C\'>\n<Version>2</Version></PackageReference><ProjectReference Include="../A.B.csproj" /></ItemGroup></Project>', "a_b"),
        ("b/x.csproj", '<Project><PackageReference Include="a>b" /><PackageReference\n Update="C"\n>\n<Version>2</Version>\n</PackageReference></Project>', "c"),
        ("c/x.csproj", '<Project><PackageReference Include="A" /></Project>', "b"),
        ("d/package.json", '{"dependencies": {"left-pad": "1", "b": "2"}}', "left-pad"),
        ("e/requirements.txt", "left_pad\nleft-pad-more\n", "left-pad"),
        ("f/Cargo.toml", '[dependencies]\nleft-pad = "1"\nb = "2"\n', "left-pad"),
    ]
    got = {r.path[0]: r.text for r in manifests.without(spark.createDataFrame(rows, "path string, text string, gone string"), "gone").collect()}
    assert got == {
        "a": rows[0][1].replace('<PackageReference Include="A.B" Version="1" />', ""), "b": '<Project><PackageReference Include="a>b" /></Project>', "c": None,
        "d": '{"dependencies": {"b": "2"}}', "e": "left-pad-more\n", "f": '[dependencies]\nb = "2"\n',
    }


def test_removals_cover_all_customers(spark):
    data = "/root/testdata/sf0.001"
    repos = {f"r{r.c_custkey}" for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    got = {r.path.split("/")[0] for r in trees.dependencies_after_removal(spark, data).collect()}
    assert got == repos


def test_requirement_files_of_all_customers(spark):
    data = "/root/testdata/sf0.001"
    repos = {r.c_custkey for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    got = {r.path: r.text for r in trees.rewritten_requirements(spark, data).collect()}
    assert {int(p.split("/")[0][1:]) for p in got} == repos
    assert all(t.startswith("../x.csproj\nLib.") for p, t in got.items() if p.endswith(".csproj"))
