import subprocess

from pyspark.sql import functions as F

from graphloom.functions.columns import camel_words, module_of, node_id, shared_prefix, symbol_matches
from graphloom.operators.store import Graph, Store
from graphloom.schema import EDGE, FILE, NODE, REF
from graphloom.sources.extract import extract, extract_from_source, outward, sections
from graphloom.sources.frameworks import config_keys, file_routes
from graphloom.sources.scan import git_files, is_ignored, scan_directory, synthetic_graph
from graphloom.streaming.sync import debounce, detect_changes, sync_stream


def test_columns(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(camel_words(F.lit("calculateTotal HTTPServer v2 é"))) == ["calculate", "total", "http", "server", "v", "2", "e"]
    assert v(module_of(F.lit("a/b/c.py"), 1)) == "a" and v(module_of(F.lit("c.py"), 2)) == "(root)"
    assert v(shared_prefix(F.lit("a/b/c.py"), F.lit("a/b/d.py"))) == 2 and v(shared_prefix(F.lit("a.py"), F.lit("a.py"))) == 0
    assert len(v(node_id(F.lit("p"), F.lit("function"), F.lit("n"), F.lit(3)))) == len("function:") + 32
    assert v(symbol_matches(F.lit("run"), F.lit("Box::run"), F.lit("x.py"), "crate::Box.run")) and not v(symbol_matches(F.lit("run"), F.lit("Tin::run"), F.lit("x.py"), "Box.run"))


def test_extraction(spark):
    x = extract_from_source("a.ts", "import { Z } from './z'\n/** doc */\nexport class A extends B implements C {\n  run(x: number): string { return go(new D()) }\n}\n")
    assert {(n["kind"], n["qualified_name"]) for n in x.nodes} == {("file", "a.ts"), ("class", "A"), ("method", "A::run"), ("import", "./z")}
    assert {(r["reference_name"], r["reference_kind"]) for r in x.refs} == {("B", "extends"), ("C", "implements"), ("./z", "imports"), ("go", "calls"), ("D", "instantiates")}
    assert extract_from_source("a.zig", "x").errors == ["unsupported_language"] and extract_from_source("a.py", "x = (").errors[0].startswith("parse_error")
    got = extract(spark.createDataFrame([("a.py", "def f():\n    g()\n"), ("b.md", "# T\n`ff` [x](./a.py)\n"), ("c.py", None), (None, "x")], "path string, text string"))
    assert got.nodes.count() == 5 and got.files.count() == 2 and {r["reference_kind"] for r in got.refs.collect()} == {"calls", "doc_mention", "doc_path"}


def test_documents():
    assert [s[0] for s in sections("markdown", "# A\n```\n# no\n```\n## B\nx")] == ["A", "B"]
    assert [s[0] for s in sections("rst", "Title\n=====\n\ntext\n\nTwo\n---\n")] == ["Title", "Two"]
    assert outward("`a b` `ok` [x](http://y) [z](./q.md#f) [[W]]") == [("ok", "doc_mention"), ("q.md", "doc_path"), ("W", "doc_link")]


def test_routes():
    got = [(r["framework"], r["name"], r["handler"]) for r in file_routes("a.js", "app.get('/x', auth, ctl.list)\n// app.get('/no', y)\napp.use(z)\n")]
    assert got == [("express", "GET /x", "ctl.list")]
    assert [r["name"] for r in file_routes("a.py", '@app.route("", methods=["POST"])\n@x\ndef h(): pass\n')] == ["POST /"]
    assert config_keys("a.yml", "a:\n  b: 1\n  c:\n    d: x\n# e: 1\n") == [("a.b", 2), ("a.c.d", 4)]


def test_scan(spark, tmp_path):
    for p, t in (("src/a.py", "x = 1\n"), ("node_modules/b.js", "x"), ("x.egg-info/c.py", "x"), ("d.bin", "x"), ("big.py", "#" * (1 << 21))):
        f = tmp_path / "t" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    got = {r["path"]: (r["language"], r["error"]) for r in scan_directory(spark, str(tmp_path / "t")).collect()}
    assert got == {"src/a.py": ("python", None), "big.py": ("python", "too_large")}
    paths = spark.createDataFrame([("a/gen/x.py",), ("b/x.py",)], "p string")
    assert [r[0] for r in paths.filter(~is_ignored(F.col("p"), exclude=["gen/"])).collect()] == ["b/x.py"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "t"), *a], check=True, capture_output=True)
    git("init"), git("add", "src"), git("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-m", "x")
    assert [tuple(r) for r in git_files(spark, str(tmp_path / "t"), "HEAD").collect()] == [("src/a.py", "x = 1\n")]


def test_synthetic_graph(spark):
    n, e = synthetic_graph(spark, 2000)
    assert n.count() == 2000 and 4 * 2000 < e.count() < 6 * 2000


def test_changes_and_debounce(spark):
    listing = spark.createDataFrame([("a", "h1", 5), ("b", "h2", 50), ("c", "h3", 50), ("d", "h4", 50)], "path string, content_hash string, modified_at long")
    files = spark.createDataFrame([("r", p, h, "x", 1, 1, 10, 0, []) for p, h in (("a", "old"), ("b", "h2"), ("c", "old"), ("e", "z"))], FILE)
    assert {r["path"]: r["change"] for r in detect_changes(listing, files).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "added", "e": "removed"}
    ev = spark.createDataFrame([("p", 0), ("p", 1), ("p", 9), ("q", 1)], "path string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r["path"], r["events"]) for r in debounce(ev).collect()) == [("p", 1), ("p", 2), ("q", 1)]


def test_stream_keeps_the_store(spark, tmp_path):
    empty = lambda s: spark.createDataFrame([], s)
    s = Store(spark, str(tmp_path / "g"))
    s.save(Graph(empty(NODE), empty(EDGE), empty(REF), empty(FILE)))
    schema = "repo string, path string, text string, content_hash string, language string, size long, modified_at long, indexed_at long"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    row = lambda p, t, m: ("r", p, t, "h", "python", 1, m, m)

    def run():
        q = sync_stream(spark, spark.readStream.schema(schema).json(str(tmp_path / "in")), s, str(tmp_path / "c"), {"availableNow": True})
        q.awaitTermination()

    put(1, [row("a.py", "def f():\n    g()\n", 1), row("b.py", "def g(): pass\n", 1)])
    run()
    assert {r["name"] for r in s.load().nodes.collect()} == {"a.py", "b.py", "f", "g"}
    put(2, [row("b.py", "def h(): pass\n", 2), row("a.py", None, 2)])
    run()
    g = s.load()
    assert {r["name"] for r in g.nodes.collect()} == {"b.py", "h"} and {r["path"] for r in g.files.collect()} == {"b.py"} and g.refs.count() == 0


def test_bindings(spark):
    from graphloom.sources.bindings import bindings, import_bindings, nearest_type, receiver_types, resolve_bindings

    assert bindings("typescript", "import D, { a, b as c } from './m'\nimport * as n from 'x'\nconst { p: q } = require('y')") == [("D", "default", "./m"), ("a", "a", "./m"), ("c", "b", "./m"), ("n", "*", "x"), ("q", "p", "y")]
    assert bindings("python", "from .a import (b, c as d)\nimport x.y, z as w\n") == [("b", "b", ".a"), ("d", "c", ".a"), ("y", "*", "x.y"), ("w", "*", "z")]
    assert bindings("go", 'import (\n "a/b"\n q "c/d"\n)\n') == [("b", "*", "a/b"), ("q", "*", "c/d")]
    assert bindings("rust", "use crate::a::{self, B, c::{D as E}};") == [("a", "a", "crate"), ("B", "B", "crate::a"), ("E", "D", "crate::a::c")]
    files = spark.createDataFrame([("s/a.ts", "import { x } from './m'\n"), ("s/m/index.ts", "x"), ("p/a.py", "from .b import f\n"), ("p/b.py", "")], "path string, text string")
    got = {(r["file_path"], r["local"]): r["module_file"] for r in resolve_bindings(import_bindings(files), files).collect()}
    assert got == {("s/a.ts", "x"): "s/m/index.ts", ("p/a.py", "f"): "p/b.py"}
    rows = ["box = Old()", "def f(box: Wide):", "    box = Box()", "    box.run()"]
    assert nearest_type("python", rows, "box", 4, 2) == "Box" and nearest_type("python", rows, "box", 2, 2) == "Wide" and nearest_type("python", rows, "bo", 4, 1) is None
    refs = spark.createDataFrame([("f", "box.run", 4, "a.py")], "from_node_id string, reference_name string, line int, file_path string")
    nodes = spark.createDataFrame([("f", "function", 2)], "id string, kind string, start_line int")
    assert receiver_types(refs, nodes, spark.createDataFrame([("a.py", "\n".join(rows))], "path string, text string")).first()["type_name"] == "Box"
