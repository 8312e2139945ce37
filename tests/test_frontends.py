"""Frontends: which units a source has, with their scopes, names and comments."""

import pytest

from spindrift.extract import frontends
from spindrift.extract.python import extract as python


def found(language, text):
    return [(u["kind"], u["name"], u["scope"]) for u in frontends.extract(language, text, 1, 10_000)]


CASES = {
    "rust": ("pub fn add(a: u32) -> u32 { let f = |x: u32| x + 1; f(a) }\nimpl Shape for Circle { fn area(&self) -> f64 { self.r } }\n#[cfg(test)]\nmod checks { fn it() { go(); } }\n#[cfg(not(test))]\nmod real { fn no() { go(); } }", [("function", "add", None), ("closure", "f", None), ("function", "area", "Circle"), ("function", "it", "tests"), ("function", "no", "real")]),
    "go": ('package a\nfunc (a *adder) Add(x int) int { f := func(y int) int { return y }; return f(x) }\nfunc main() { if x > 0 { p("}") } }', [("method", "Add", "adder"), ("closure", "f", None), ("function", "main", None)]),
    "javascript": ("class A { constructor(x) { this.x = x; } go(a) { if (a) { return a; } } }\nfunction top(a) { return a.map(x => x + 1); }\nit('works', () => { ok(1); });\nconst o = { key: function (z) { return /[{}]/.test(z); } };", [("method", "constructor", "A"), ("method", "go", "A"), ("function", "top", None), ("closure", "a.map(...)", None), ("closure", 'it("works")', None), ("closure", "key", None)]),
    "typescript": ("export class S<T> { private m(a: string): Promise<void> { return x; } }\nexport function g<T>(a: T): T { return a; }", [("method", "m", "S"), ("function", "g", None)]),
    "java": ("class A extends B { @Override public List<String> m(int a) throws X { run(() -> { go(); }); return a; } public A(int x) { super(x); } }", [("method", "m", "A"), ("lambda", "run(...)", "A"), ("constructor", "A", "A")]),
    "csharp": ("namespace N { class A : B { public A(int x) : base(x) { go(); } public int M(string s) { return xs.Select(x => x + 1); } } }", [("constructor", "A", "A"), ("method", "M", "A"), ("lambda", "xs.Select(...)", "A")]),
    "c": ("#include <a.h>\nstatic int *f(struct x *a, int (*cb)(int)) { if (a) { return 0; } return 1; }", [("function", "f", None)]),
    "cpp": ("namespace n { class A : public B { public: A(int x) : B(x) { go(); } int m() const { return [&](int z) { return z; }(1); } }; }", [("function", "A", "n.A"), ("function", "m", "n.A"), ("closure", "m.func", "n.A")]),
    "kotlin": ("class A(val x: Int) { fun m(a: Int): String { return b } constructor(y: String) : this(1) { go() } }", [("function", "m", "A"), ("constructor", "constructor", "A")]),
    "php": ('<html><?php class A { function m($a) { $f = function ($x) use ($a) { return $x; }; return 1; } }\nfunction g($b) { return "{"; } ?>', [("method", "m", "A"), ("closure", "$f", "A"), ("function", "g", None)]),
    "ruby": ("module M\n class A\n  def m(a)\n   return 1 if a\n   xs.each do |x|\n    puts x\n   end\n   f = ->(z) { z + 1 }\n  end\n  def self.s; 1; end\n end\nend", [("method", "m", "M.A"), ("closure", "f", "M.A"), ("method", "s", "M.A")]),
    "python": ("class A:\n    def f(self, x):\n        return g(lambda y: y + x)\n", [("function", "f", "A"), ("lambda", "<anonymous>", "A")]),
}


@pytest.mark.parametrize("language", CASES)
def test_units(language):
    text, want = CASES[language]
    assert found(language, text) == want
    for u in frontends.extract(language, "é\n".join(["", ""]) + text, 1, 10_000) if language != "python" else []:
        full = next(r["content"] for r in u["representations"] if r["kind"] == "full_source")
        assert ("é\n" + text).encode()[u["start_byte"] : u["end_byte"]].decode() == full  # offsets count bytes


def test_documentation_calls_and_thresholds():
    text = "/// Adds.\n/// Twice.\n#[inline]\nfn add(a: u32) -> u32 {\n    // note\n    helper::go(a); println!(\"x\")\n}\n"
    (u,) = frontends.extract("rust", text, 1, 10_000)
    reps = {r["kind"]: r["content"] for r in u["representations"]}
    assert reps["documentation"] == "/// Adds.\n/// Twice." and "note" not in reps["implementation"] and "note" in reps["full_source"]
    assert [(c["callee"], c["line"]) for c in u["references"]] == [("helper::go", 6), ("println!", 6)]
    assert "<declared-name>" in reps["body_without_declared_name"] and reps["signature"] == "fn add(a: u32) -> u32"
    assert frontends.extract("rust", text, 1000, 10_000) == [] == frontends.extract("rust", text, 1, 10) == frontends.extract("cobol", text)


def test_python_lines_are_the_parsers():
    text = "x = 1\x0c\ny = '\u2028'\n# about f\ndef f(a):\n    return g(a)  # call\n"
    (u,) = python(text, 1)
    reps = {r["kind"]: r["content"] for r in u["representations"]}
    assert reps["documentation"] == "# about f" and u["references"][0]["snippet"] == "return g(a)  # call" and "call" not in reps["implementation"]


def test_documents_of_several_languages(spark):
    rows = [("a", "go", CASES["go"][0]), ("b", "ruby", CASES["ruby"][0]), ("c", "cobol", "x"), ("d", None, "y"), ("e", "go", None)]
    out = frontends.extract_units(spark.createDataFrame(rows, "doc_id string, language string, content string"), 1).collect()
    assert sorted((r.doc_id, r.name) for r in out) == sorted([("a", "Add"), ("a", "f"), ("a", "main"), ("b", "m"), ("b", "f"), ("b", "s")])
