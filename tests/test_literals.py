"""Small cases with known answers, beside the queries that apply the same functions to whole tables."""

import gzip

import pytest
from pyspark.sql import functions as F

from memgrid.functions import scores, texts
from memgrid.operators import chunks, graph, learning, memory, sessions
from memgrid.sources import files, sinks

LATEX = r"See \cite{a,b} and \citep{b, c}. $x+y$ \begin{equation} E = mc^2 \end{equation} \section{Intro} \subsection{More} \begin{table} \caption{A {nested} one} \end{table} $z$ \begin{align*} a &= b \end{align*}"
FILES = [
    ("core/a/b.py", "import core.util\nfrom . import y\ndef run():\n    helper()\n    _hidden()\n    own()\ndef own(): pass", ["run", "own"]),
    ("core/util.py", 'def helper(x):\n    """Helps. Really."""\n    return x\nclass A: pass', ["helper", "_hidden"]),
    ("core/a/__init__.py", "from core.a.b import run\nimport requests", ["setup"]),
]
IMPORTS = [("core/a/b.py", "import core.util"), ("core/a/b.py", "from . import y"), ("core/a/__init__.py", "from core.a.b import run"), ("core/a/__init__.py", "import requests"), ("core/util.py", "from ..a import z")]


def one(spark, values, column):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(values)], "n int, x string").withColumn("y", column(F.col("x")))
    return [r["y"] for r in rows.orderBy("n").collect()]


def test_latex(spark):
    found = spark.createDataFrame([(LATEX,)], "x string").select(texts.citations(F.col("x")), texts.equations(F.col("x")), texts.sections(F.col("x")), texts.table_captions(F.col("x"))).first()
    assert found[0] == ["a", "b", "c"] and found[1] == ["E = mc^2", "a &= b", "x+y"]
    assert [tuple(x) for x in found[2]] == [(1, "Intro"), (2, "More")] and found[3] == ["A {nested} one"]


def test_keys_paths_statements(spark):
    assert one(spark, ["core/a b.py", "///", "x/y-z.md", "_lead/é.py"], texts.safe_key) == ["core_a_b.py", "item", "x_y-z.md", "lead_é.py"]
    assert one(spark, ["/_db/main/_api/document/x", "/_api/database", "/_db//_api/index", "/_db/a/_api/documents"], lambda p: p.rlike(texts.ALLOWED_PATH)) == [True, False, False, False]
    assert one(spark, ["FOR d IN x RETURN d", "INSERT {} INTO x", "RETURN d.inserted", "create_graph()"], texts.only_reads) == [True, False, True, False]
    assert one(spark, ['["a","b"]', "x, 'y'", "", "[a, b]"], texts.names_list) == [["a", "b"], ["x", "y"], [], ["a", "b"]]
    assert one(spark, ["TRUE", "1", "no", "maybe"], texts.flag) == [True, True, False, None]


def test_units(spark):
    rows = spark.createDataFrame([("s", 2.5), ("ms", 3.0), ("s", 0.0), ("h", 1.0)], "unit string, v double")
    assert [r[0] for r in rows.select(scores.in_seconds(F.col("v"), F.col("unit"))).collect()] == [2.5, 0.003, 1e-9, None]


def test_code_edges(spark):
    code = spark.createDataFrame(FILES, "path string, text string, functions array<string>")
    edges = graph.import_edges(spark.createDataFrame(IMPORTS, "path string, statement string"), code)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("core_a_b.py", "core_util.py"), ("core_a_b.py", "core_a___init__.py"), ("core_a___init__.py", "core_a_b.py")}
    assert [(r["src"], r["dst"], r["name"]) for r in graph.reference_edges(code).collect()] == [("core_a_b.py", "core_util.py", "helper")]
    found = code.select("path", texts.code_counts(F.col("text")).alias("c"), texts.first_docstring(F.col("text")).alias("s")).select("path", "c.*", "s").collect()
    assert tuple(next(r for r in found if r["path"] == "core/util.py")) == ("core/util.py", 4, 0, 1, 1, "Helps")


def test_edges_written_twice(spark):
    rows = [("a", "b", "imports", 1.0), ("a", "c", "references", 0.8), ("a", "b", "imports", 1.0), ("a", "b", "references", 0.8)]
    assert sinks.keyed_edges(spark.createDataFrame(rows, "src string, dst string, kind string, weight double")).count() == 3


def test_spaced(spark):
    rows = spark.createDataFrame([([0, 40, 100, 180, 200, 305],)], "at array<int>")
    assert rows.select(memory.spaced(F.col("at"), 100)).first()[0] == [0, 100, 200, 305]


def test_readers(spark):
    rows = [("a.txt", b"plain text"), ("b.tex", gzip.compress(b"tex \\section{x}")), ("c.pdf", b"not a pdf"), ("d.pdf", b"%PDF-1.4 BT (Hello) Tj ET"), ("e.pdf", b"")]
    out = files.extracted(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()
    assert [(r["path"], r["text"], r["kind"], r["error"] is None) for r in out] == [
        ("a.txt", "plain text", "text", True), ("b.tex", "tex \\section{x}", "latex", True), ("c.pdf", None, "pdf", False), ("d.pdf", "Hello", "pdf", True), ("e.pdf", None, "pdf", False),
    ]


def test_json_that_must_be_there(spark):
    assert one(spark, ['{"a":{"b":"x"}}'], lambda t: texts.json_at(t, "a", "b")) == ["x"]
    for text in ('{"a":{}}', '{"b":1}', None, "no json", '{"a":{"b":null}}'):
        with pytest.raises(Exception, match=r"no \['a'\]"):
            spark.createDataFrame([(text,)], "x string").select(texts.json_at(F.col("x"), "a", "b")).collect()


def test_merges_of_any_depth(spark):
    rows = [('{"a":{"b":{"c":1,"d":2}},"k":1}', '{"a":{"b":{"c":{"x":1}},"e":null},"m":[1]}'), (None, '{"a":1}'), ('{"a":{"b":1}}', '{"a":2}'), ('{"a":1}', None)]
    got = spark.createDataFrame(rows, "a string, b string").select(sessions.deep_merged_json(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["m"] for r in got] == ['{"a":{"b":{"c":{"x":1},"d":2},"e":null},"k":1,"m":[1]}', '{"a":1}', '{"a":2}', '{"a":1}']


def test_export_with_indexes_and_splits(spark, tmp_path):
    vertices = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0)], "id string, x double")
    edges = spark.createDataFrame([("a", "b", "imports"), ("c", "a", "references"), ("a", "gone", "imports")], "src string, dst string, kind string")
    sinks.export_graph(vertices, edges, str(tmp_path / "g"), spark.createDataFrame([("a", "train"), ("c", "val")], "id string, part string"))
    read = lambda x: spark.read.parquet(str(tmp_path / "g" / x)).collect()
    assert {(r["id"], r["n"]) for r in spark.read.json(str(tmp_path / "g" / "id_map")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r["src_n"], r["dst_n"], r["kind"]) for r in read("edges")} == {(0, 1, "imports"), (2, 0, "references")}
    assert {(r["n"], r["part"]) for r in read("splits")} == {(0, "train"), (2, "val")}


def test_log_of_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, (2.5, "x"))], "id long, score struct<value: double, note: string>")
    at = str(tmp_path / "log")
    assert sinks.log_records(rows, at, dry_run=True).first()["record"] == '{"id":1,"score":{"value":2.5,"note":"x"}}'
    for _ in range(2):
        sinks.log_records(rows, at)
    assert spark.read.json(at).count() == 2


def test_edges_with_names_are_told_apart(spark):
    rows = [("a", "b", "references", "f"), ("a", "b", "references", "g"), ("a", "b", "references", "f")]
    assert sinks.keyed_edges(spark.createDataFrame(rows, "src string, dst string, kind string, name string")).count() == 2


def test_tables_are_made_and_dropped(spark):
    sinks.create_table(spark, "made_here", "key string, part int", ["part"])
    sinks.create_table(spark, "made_here", "key string, part int", ["part"])
    assert spark.table("made_here").count() == 0
    sinks.drop_table(spark, "made_here")
    sinks.drop_table(spark, "made_here")
    assert not spark.catalog.tableExists("made_here")


def test_ratio_of_pairs(spark):
    code = spark.createDataFrame([(i, f"a/b_{i}.py", 'def f():\n    """Says so. Twice."""\ndef g(): pass') for i in range(50)], "id long, path string, text string")
    rows = learning.query_pairs(code, 1.5).collect()
    good = [r for r in rows if r["label"] == 1]
    assert {r["query"] for r in good if r["id"] == 7} == {"What does b_7 do?", "How does b 7 work?", "Says so", "How does f function work?", "How does g function work?"}
    assert len(good) == 250 and 330 < len(rows) - len(good) < 420
    assert not any(r["label"] == 0 and r["query"] == f"What does b_{r['id']} do?" for r in rows)


def test_offsets_of_windows(spark):
    text = " ".join("w" * (n % 9 + 1) for n in range(100))
    own = text.split()
    rows = chunks.windows(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", 12, 5).collect()
    assert len(rows) == 15
    for r in rows:
        a = len(" ".join(own[: r["start_token"]]))
        assert (r["start_char"], r["end_char"]) == (a, a + len(r["chunk"]))


def test_shell_patterns():
    import fnmatch
    import re

    for pattern in ("a*b", "[ab]x?", "[!ab]*", "x[a-c].py", "[z", "a[]]b", "*.[ch]", "[!]]x", "a.b", "q[^x]"):
        for name in ("ab", "a/b", "axx", "bx1", "cx", "xb.py", "xd.py", "[z", "a]b", "m.c", "m.h", "m.o", "]x", "yx", "a.b", "acb", "q^", "qx"):
            assert bool(re.match(files.as_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_overlapping_globs(spark, tmp_path):
    for name in ("a.py", "core/b.py", "core/deep/c.py", "core/d.md", "docs/e.md", ".hidden/f.py", "node_modules/g.py", "core/.h.py", "core/skip_1.py", "core/keep_x.py"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)
    found = lambda globs, patterns=(): sorted(r["path"] for r in files.files(spark, str(tmp_path), globs, patterns).select("path").collect())
    assert found(["**/*.py", "core/*.py", "core/**/*.md"], ["core/skip_[0-9].py"]) == ["a.py", "core/b.py", "core/d.md", "core/deep/c.py", "core/keep_x.py"]
    assert found(["*.py"]) == ["a.py"] and found(["core/?.md", "docs/**"]) == ["core/d.md", "docs/e.md"]
    assert found("*.md") == ["core/d.md", "docs/e.md"]
