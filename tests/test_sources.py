import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattica.operators.graph import PropertyGraph
from lattica.sources import formats, importers, readers, sinks
from lattica.streaming.ingest import merge_stream, stream_table, windowed_counts


def test_readers_by_extension(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("héllo\nworld")
    (tmp_path / "b.md").write_text("# md")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.txt").write_text("deep")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    r = readers.Readers()
    assert r.load(spark, f"{tmp_path}/a.TXT").first().text == "héllo\nworld"
    assert r.load(spark, f"{tmp_path}/d.docx").first().text == "One\nTwo"
    assert r.load(spark, f"{tmp_path}/d.docx", joiner="\n\n").first().text == "One\n\nTwo"
    with pytest.raises(ValueError):
        r.load(spark, f"{tmp_path}/x.rtf")
    with pytest.raises(FileNotFoundError):
        r.load(spark, f"{tmp_path}/none.txt")
    assert [(x.text, x.filename) for x in r.load_directory(spark, str(tmp_path), "*.txt").collect()] == [("deep", "c.txt")]
    assert readers.count_lines(spark, f"{tmp_path}/a.TXT") == 2


def test_documents_as_a_data_source(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("héllo\nworld")
    (tmp_path / "sub/n.note").write_bytes(b"upper")
    (tmp_path / "x.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(tmp_path / "sub/d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    monkeypatch.setattr(formats, "TASK_BYTES", 10)
    formats.register_formats(spark, more={".NOTE": lambda content, joiner: content.decode().upper()})
    read = spark.read.format("lattica_files")
    got = read.load(str(tmp_path))
    assert {(r.filename, r.text) for r in got.collect()} == {("a.TXT", "héllo\nworld"), ("n.note", "UPPER"), ("d.docx", "One\nTwo")}
    parts = formats._Reader(str(tmp_path), "*", "", formats.FORMATS).partitions()
    assert [len(x.names) for x in parts] == [1, 1]  # ten bytes are a task's share here
    spark.sql(f"create or replace temporary view notes using lattica_files options (path '{tmp_path}', pattern '*.docx', joiner ' / ')")
    assert [r.text for r in spark.sql("select text from notes").collect()] == ["One / Two"]
    assert [r.text for r in read.load(f"{tmp_path}/a.TXT").collect()] == ["héllo\nworld"]
    assert read.load(str(tmp_path / "sub"), pattern="none*").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        read.load(f"{tmp_path}/none").collect()


def test_delimited_and_annotations(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note\n007,"two\nlines, ""quoted"""\n')
    assert tuple(readers.read_table(spark, f"{tmp_path}/t.csv", "id string, note string").first()) == ("007", 'two\nlines, "quoted"')
    lines = ["#1", "#2", "#3", "#4", "head"] + ["\t".join([f"d{i}", "label", "", "src"] + ["x"] * 7) for i in range(3)]
    (tmp_path / "a.hpoa").write_text("\n".join(lines))
    got = readers.read_annotations(spark, f"{tmp_path}/a.hpoa").orderBy("ord").collect()
    assert [r.disease_id for r in got] == ["d0", "d1", "d2"] and got[0].phenotype_id is None and got[0].extra is None
    assert readers.first_rows(spark.range(5), 0, "id").count() == 5 and readers.first_rows(spark.range(5), 2, "id").count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    import random

    rng = random.Random(2)
    files = {}
    for name, end, n in (("a", "\n", 3000), ("b", "\r\n", 2000), ("one", "\n", 1)):
        files[name] = [rng.choice(["", "é" * rng.randrange(9), "x\ty" * rng.randrange(1, 40)]) + str(i) * (i % 3) for i in range(n)]
        (tmp_path / f"{name}.tsv").write_bytes((end.join(files[name]) + (end if name == "a" else "")).encode())
    (tmp_path / "none.tsv").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.numbered_lines(spark, str(tmp_path))
        found = {name: sorted((r["ord"], r["line"]) for r in got.where(F.col("path").endswith(f"/{name}.tsv")).collect()) for name in files}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        skipped = readers.read_headerless(spark, f"{tmp_path}/a.tsv", ["p", "q"], 5).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, lines in files.items():
        lines = lines[:-1] if lines[-1] == "" else lines  # a file doesn't tell an empty last line
        assert found[name] == list(enumerate(lines))
    want = [(i, *(v or None for v in [*line.split("\t"), ""][:2])) for i, line in enumerate(files["a"]) if i >= 5 and line]
    assert [tuple(r) for r in skipped] == want


_TWICE = """
import sys
from dataclasses import dataclass
from pyspark import TaskContext
from pyspark.sql import SparkSession
from lattica.sources import importers

@dataclass(frozen=True)
class Fails(importers.FolderStore):
    always: bool = False

    def stage(self, attempt, number, rows):
        super().stage(attempt, number, rows)
        context = TaskContext.get()
        if context.partitionId() == 1 and number == 1 and (self.always or context.attemptNumber() == 0):
            raise RuntimeError("lost after the second batch")

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1] + "/cp").getOrCreate()
df = spark.range(0, 95, 1, 4).selectExpr("id", "'é' as name")
importers.register_importer("fails", Fails)
to = importers.import_rows(df, "FAILS", batch=10, run="one", folder=sys.argv[1] + "/a")
rows = [line for f in to.files() for line in open(f, encoding="utf-8")]
assert len(rows) == len(set(rows)) == 95, len(rows)
staged = sum(len(files) for _, _, files in __import__("os").walk(sys.argv[1] + "/a/staged"))
assert staged > len(to.files())  # what the failed attempt wrote is there, and not published
importers.import_rows(df.limit(0), "folder", folder=sys.argv[1] + "/a", run="none")
assert len(to.files()) == len([f for f in to.files()]) and len([line for f in to.files() for line in open(f)]) == 95
try:
    importers.import_rows(df, "fails", batch=10, folder=sys.argv[1] + "/b", always=True)
    raise SystemExit("must fail")
except Exception as e:
    assert "lost after" in str(e), e
assert importers.FolderStore(sys.argv[1] + "/b").files() == []
one = importers.import_rows(df.limit(3), "folder", "transaction", folder=sys.argv[1] + "/c")
assert len(one.files()) == 3
"""


def test_a_retried_task_writes_once(tmp_path):
    subprocess.run([sys.executable, "-c", _TWICE, str(tmp_path)], cwd=Path(__file__).parents[1], check=True, timeout=200)


def test_importers(spark, tmp_path):
    with pytest.raises(ValueError):
        importers.import_rows(spark.range(1), "none")
    with pytest.raises(ValueError):
        importers.import_rows(spark.range(1), "folder", "other", folder=str(tmp_path))
    g = PropertyGraph(spark.createDataFrame([(1, ["A"]), (2, ["B"])], "id int, labels array<string>"), spark.createDataFrame([(1, 2, "T")], "src int, dst int, type string"))
    done = importers.import_graph(g, "folder", lambda part: {"folder": f"{tmp_path}/{part}"})
    assert [len([line for f in s.files() for line in Path(f).read_text().splitlines()]) for s in done.values()] == [2, 1]
    loaded = []
    assert readers.load_if_empty(spark.range(3), lambda: loaded.append(1)).count() == 3 and not loaded
    assert readers.load_if_empty(spark.range(0), lambda: spark.range(2)).count() == 2


def test_ontology(spark, tmp_path):
    (tmp_path / "o.owl").write_text("""<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o">
<owl:Class rdf:about="http://x/obo/HP_1"><rdfs:label>Root</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/obo/HP_2"><rdfs:label>Leaf</rdfs:label><rdfs:subClassOf rdf:resource="http://x/obo/HP_1"/></owl:Class></rdf:RDF>""")
    nodes, edges = readers.read_ontology(spark, f"{tmp_path}/o.owl")
    assert sorted((r.id, r.label) for r in nodes.collect()) == [("HP:1", "Root"), ("HP:2", "Leaf")]
    assert [tuple(r) for r in edges.collect()] == [("HP:2", "HP:1", "SUBCLASSOF")]


def test_settings():
    assert readers.Settings.load() == readers.Settings()
    got = readers.Settings.load(["--uri=cli"], {"LATTICA_USER": "env", "LATTICA_URI": "env"}, "[graph]\nuser = ini\npassword =\nencrypted = 1")
    assert got == readers.Settings("cli", "env", "", 1)
    with pytest.raises(ValueError):
        readers.Settings.load(["--what=1"])
    for words, code in ((["-h"], 0), (["--uri=x", "--help"], 0), (["--what=1"], 2), (["word"], 2)):
        with pytest.raises(SystemExit) as e:
            readers.Settings.from_command_line(words)
        assert e.value.code == code
    assert readers.Settings.from_command_line([]) == readers.Settings()


def test_sinks(spark, tmp_path):
    row = {c: "x" for c in sinks.QA_COLUMNS} | {"chunk_id": 1, "retrieved_contexts": None, "chunk": 'a "b"'}
    df = readers.inline(spark, [row], ", ".join(f"{c} {'int' if c == 'chunk_id' else 'array<string>' if c == 'retrieved_contexts' else 'string'}" for c in sinks.QA_COLUMNS))
    sinks.write_qa(df, f"{tmp_path}/qa")
    back = readers.read_table(spark, f"{tmp_path}/qa", ", ".join(f"{c} string" for c in sinks.QA_COLUMNS)).first()
    assert back.retrieved_contexts == "[]" and back.chunk == 'a "b"'
    nodes = spark.createDataFrame([(1, ["A"])], "id int, labels array<string>")
    sinks.write_graph(PropertyGraph(nodes, spark.createDataFrame([(1, 1, "T")], "src int, dst int, type string")), f"{tmp_path}/g")
    assert sinks.read_graph(spark, f"{tmp_path}/g").of_type("T").count() == 1
    run = sinks.Run(spark, f"{tmp_path}/run")
    run.log_parameters({"k": 1})
    run.log_metrics({"m": 0.5})
    run.log_table("t", df)
    run.end()
    assert readers.load_run_table(spark, f"{tmp_path}/run", "t").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.load_run_table(spark, f"{tmp_path}/run", "none")


def test_stream_merges_once(spark, tmp_path):
    schema = "src string, type string, dst string"
    for k, rows in enumerate([[("a", "T", "b"), ("a", "T", "b")], [("b", "T", "c"), ("a", "T", "b")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        merge_stream(stream_table(spark, f"{tmp_path}/in", schema), f"{tmp_path}/n", f"{tmp_path}/e", f"{tmp_path}/c").awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/e").count() == k + 1
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/n").collect()) == ["a", "b", "c"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 3.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    assert [(r.n, r.mean) for r in windowed_counts(events).collect()] == [(2, 2.0)]


def test_entry_without_the_subpackage(tmp_path):
    """The entry file imports, and the library doesn't need the subpackage."""
    top = Path(__file__).parents[1]
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('lattica.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'symptom_match' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True)
