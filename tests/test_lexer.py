"""Extents by nesting, with braces in strings, comments and characters."""

from lodestone.operators import lexer

FILES = {
    "javascript": ("""// function no() {
class A extends B {
  run(x) {
    const s = "}}}" + '{' + `a
} ${x} {`;
    if (/[}"]{2}/.test(s)) { return call(s) }
    /* } */
  }
  static get v() { return 1 }
}
const g = async (y) => {
  go(y, () => { z.q(1) })
}
function h(a = {b: 1}) {
}
""", [("class", "A", 2, 10, ""), ("method", "run", 3, 8, "A"), ("method", "v", 9, 9, "A"), ("function", "g", 11, 13, ""), ("function", "h", 14, 15, "")],
        [("test", 6, "run"), ("call", 6, "run"), ("go", 12, "g"), ("z.q", 12, "g")]),
    "rust": ("""mod m {
    pub struct S { a: char }
    struct U;
    impl<'a> T for S {
        fn f(&self, c: char) -> bool {
            let r = r#"}"{"#; // }
            c == '}' && c != '\\'' && helper(r)
        }
    }
    trait T {
        fn f(&self, c: char) -> bool;
    }
}
""", [("module", "m", 1, 13, ""), ("struct", "S", 2, 2, "m"), ("struct", "U", 3, 3, "m"), ("impl", "S", 4, 9, "m"), ("function", "f", 5, 8, "m.S"), ("trait", "T", 10, 12, "m"), ("function", "f", 11, 11, "m.T")], [("helper", 7, "f")]),
    "go": ("""package p
type S struct {
    a int
}
type I interface {
    M(int) string
}
func (s *S) M(x int) string {
    q := `}
{`
    if x > 0 { return fmt.Sprint('}', "{") }
    return q
}
func F() {}
""", [("struct", "S", 2, 4, ""), ("interface", "I", 5, 7, ""), ("function", "M", 8, 13, ""), ("function", "F", 14, 14, "")], [("M", 6, "I"), ("fmt.Sprint", 11, "M")]),
    "java": ("""public class E {
    /** } */
    private static List<String> f(int x) throws X {
        String t = \"""
            } {
            \""";
        for (int i = 0; i < x; i++) { if (c == '{') g(t); }
        return null;
    }
    interface N { void k(); }
}
""", [("class", "E", 1, 11, ""), ("method", "f", 3, 9, "E"), ("interface", "N", 10, 10, "E"), ("method", "k", 10, 10, "E.N")], [("g", 7, "f")]),
    "c": ("""struct s {
    int a;
};
static int f(const char *p)
{
    char c = '}';
    const char *q = "}" /* { */;
    while (p) { g(p, c); }
    return h(q);
}
int declared(int);
""", [("struct", "s", 1, 3, ""), ("function", "f", 4, 10, ""), ("function", "declared", 11, 11, "")], [("g", 8, "f"), ("h", 9, "f")]),
}


def test_symbols_and_calls(spark):
    rows = [(f"a.{lang}", lang, text) for lang, (text, *_) in FILES.items()] + [("n", "go", None), ("e", "go", ""), ("p", "python", "def f(): pass"), ("open", "go", "func A() {\n  if x {\n")]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    got, called = lexer.symbols(files).collect(), lexer.calls(files).collect()
    for lang, (_, want, calls) in FILES.items():
        assert sorted((r["kind"], r["name"], r["line_no"], r["end_line"], r["inside"]) for r in got if r["path"] == f"a.{lang}") == sorted(want), lang
        assert [(r["name"], r["line_no"], r["inside"]) for r in called if r["path"] == f"a.{lang}"] == calls, lang
    assert [(r["name"], r["end_line"]) for r in got if r["path"] == "open"] == [("A", 2)] or [(r["name"], r["end_line"]) for r in got if r["path"] == "open"] == [("A", 3)]
    assert not {"n", "e", "p"} & {r["path"] for r in got}


def test_blanks_keep_places():
    for lang, (text, *_) in FILES.items():
        out = lexer.blanked(text, lang)
        assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert out.count("{") == out.count("}")
