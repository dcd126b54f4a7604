import pytest

from graphloom.llm import gll
from graphloom.llm.gll import Grammar
from graphloom.llm.syntax import flag_unparsable, invalid_rates, verdict

GOOD = {
    "python": ["", "# only\n", "x = 1\n", "async def f(a, *, b: int = 1, **k) -> str:\n    async with a as b, c:\n        return [x async for x in y if x]\n", "match x:\n    case [1, *_] | {'a': b} if b: pass\n    case _: pass\n", "if x:\n\tpass\nelse:\n  pass\n", "type X[T] = list[T]\nf = lambda *a, k=1: (yield)\n", "x = 1 if y else 2; z: int = (w := 3)\n", "a = '''\n<<<<<<< HEAD\n'''\n"],
    "javascript": ["", "// x", "a?.b?.[c]?.(d)", "for (const [k,v] of Object.entries(x)) { y ??= `a${k+`b${v}`}c` }", "x = a\n++b\nvar r = /[/]\\/x/g.test(s) / 2", "label: for (;;) { continue label }", "export default async () => { await x }", "class A extends B { #p = 1; static { x() } get [k]() { return this.#p } async *m() {} }", "!function(){}()", "a = b\n;[1].map(x => x)"],
    "typescript": ["interface A<T> extends B, C<D> { readonly x?: number; [k: string]: any; m?<T>(a: T): void }", "type A<T> = T extends (infer U)[] ? U : never", "let y = a as unknown as B<C<D>>", "abstract class A<T> implements C { constructor(private readonly x: number) { super() } abstract m(): void }", "enum E { A = 1, B }", "const f = async <T>(x: T) => { }"],
    "go": ["package a\n", "package a\nimport (\n\t\"x\"\n\ty \"z\"\n)\nfunc (a *A[T]) M(x ...int) (r int, err error) { defer func() { recover() }(); return }\n", "package a\nfunc f() { switch x := y.(type) { case int, string: a(); default: }\n m := map[string][]int{\"a\": {1, 2}}\n for k, v := range m { }\n if err := f(); err != nil { return } else { }\n}\n"],
    "java": ["package a; import static b.C.*; @A(x = 1) public final class D<T extends E & F> { static { x(); } <U> U f(U u) { return u; } int[] h[] = {{1}, {2}}; }", "class A { void f() { int v = switch (y) { case A, B -> 1; default -> throw new E(); }; if (o instanceof P p && p.x() > 1) { } var t = \"\"\"\n a \"b\" \"\"\"; } }", "record Q(int a) { }"],
    "rust": ["fn a(x: &str) -> u32 { let r = 0..10; for i in (0..n).rev() { } match x { 0 => a, 1..=5 | 7 => { b } _ => c } }", "impl<T> Tr for A<T> where T: Fn(i32) -> u8 { type X = Y; fn f<'a>(&'a mut self) {} }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "/* a /* b */ c */ #[derive(Debug)] struct A;", "let x = 1;" if False else "const A: i64 = 3;"],
}
BAD = {
    "python": ["def f(:\n    pass\n", "if x:\npass\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "f(a=1, 2)\n", "  x = 1\n", "a: \n"],
    "javascript": ["var x = {", "if (a {}", "<html></html>", "a b", "x = 1 y = 2", "`${a", "=======\n"],
    "typescript": ["let x: = 1", "class A { m( }", "interface A { x: }"],
    "go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nfunc f() {\nx := \n}\n", "a:\n  - b: 1\n"],
    "java": ["class A { int f() { return 1 } }", "class A {", "public class { }", "class A { } }", "f(a,);"],
    "rust": ["fn f() { let x = ; }", "fn f( {}", "struct A { x: }", "fn f() { a b }"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(lang, text):
    assert verdict(lang, text) == (True, None)


@pytest.mark.parametrize("lang,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(lang, text):
    assert verdict(lang, text)[0] is False


def test_ambiguous_and_left_recursive_grammar():
    g = Grammar("S = S S | 'a' | ", {"id": []}, {"p": []}, {"d": "S"}, [], {})
    s = chr(g.code["a"])
    assert g.dialects(s * 9) == ["d"] and g.dialects("") == ["d"] and not g.dialects(s + chr(g.code["?"]))


def test_table(spark):
    rows = [("r", "a.py", "x = 1", 1), ("r", "a.py", "x = 1", 1), ("r", "b.py", "x = (", 1), (None, None, "x", 1), ("r", "c.js", None, 1), ("r", "d.txt", "((", 1), ("r", "e.go", "package a\n" + "var x = 1\n" * 20000, 1)]
    df = spark.createDataFrame(rows, "repo string, path string, text string, valid int")
    got = [(r["path"], r["valid"]) for r in flag_unparsable(df).collect()]
    assert sorted(got, key=str) == sorted([("a.py", True), ("a.py", True), ("b.py", False), (None, None), ("c.js", None), ("d.txt", None), ("e.go", True)], key=str)
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid_files"], r["invalid_rate"]) for r in invalid_rates(flag_unparsable(df)).collect()}
    assert rates == {("r", "python"): (3, 1, 0.333333), ("r", "go"): (1, 0, 0.0)}
    assert flag_unparsable(df.limit(0)).count() == 0


def test_memos_stay_below_their_bound(monkeypatch):
    monkeypatch.setattr(gll, "_MEMO", 60_000)
    g = Grammar("S = id* | id ',' S", {"id": ["a", "b"]}, {"p": ["S"]}, {"d": "S"}, [], {})
    a, b, unknown = (chr(g.code[x]) for x in ("a", "id", "?"))
    for i in range(3000):
        s = "".join(a if i >> k & 1 else b for k in range(12)) * 4
        mask = g.mask_of[g.group("p", s)]
        assert mask and not g.mask_of[g.group("p", s + unknown)] and g.mask_of[g.group("p", s)] == mask
        kept = [s for m in (g.memo, g.memo_before, g.shapes, g.shapes_before) for own in m.values() for s in own]
        assert sum(gll._ENTRY + 4 * len(s) for s in kept) <= 64_000, i
