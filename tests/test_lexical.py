import re

import pytest

from gistline.operators import lexical as X

KOTLIN = '''package a
/*
 * class Hidden {
 */
@Inject
data class Model(
    val id: Int,
) {
    // fun commented() {}
    companion object Factory {
        fun make(): Model { val local = "}"; return Model(1) }
    }
    enum class State { ON, OFF }
    override suspend fun <T> List<T>.load(
        x: T,
    ): T {
        var count = 0
        return x
    }
    val size: Int get() = 1
}

typealias Done = () -> Unit
fun interface Hook { fun call() }
object Only'''
JAVA = '''package a;
public class Box<T> extends Base {
    private final Map<String, List<T>> items = new HashMap<>();
    protected static int count;
    public Box(int n) {
        super(n);
        return;
    }
    @Override
    public String toString() { return "{"; }
    enum Kind { A, B }
    @interface Mark { }
}'''
TS = '''import x from "y";
export default abstract class Store {
  private items: string[] = [];
  static async load(path: string): Promise<Store> {
    const inner = 1;
    if (inner) {
      return new Store();
    }
  }
  get size(): number { return 1; }
}
export const limit = 5, other = 6;
export type Fn = (a: number) => void;
enum Color { Red }
declare namespace Util { }
export async function main() {
  let url = `http://x`;
}'''
PY = '''import os

@dec
class A(Base):
    """Doc
    def hidden(self): pass
    """
    x = 1

    def f(self,
          y):
        s = "class B:"
        # def no(): pass
        return (
            1)

    class Inner:
        async def g(self):
            pass


def top(): return 1
'''
GO = '''package a
type Box struct {
\tn int
}
func (b *Box) Size() int { return b.n }
func New() *Box {
\treturn nil
}'''
RUST = '''pub(crate) struct Box<'a> { x: &'a str }
impl<'a> Box<'a> {
    pub async fn size(&self) -> char { '}' }
}
impl Display for Box<'_> {
    fn fmt(&self) {}
}
const MAX: u8 = 1;
mod inner { pub trait T {} }
pub type Alias = u8;'''


def symbols(spark, language, text, span=None):
    rows = [(1, language, i, t) for i, t in enumerate(text.split("\n"), 1)]
    df = spark.createDataFrame(rows, "file_id int, language string, line_no bigint, line string")
    got = X.lexical_symbols(df, span).orderBy("line_lo", "char_lo").collect()
    return [(r.kind, r.qualified_name, r.line_lo, r.line_hi) for r in got], got


@pytest.mark.parametrize("span", [3, None])
def test_kotlin(spark, span):
    got, rows = symbols(spark, "kotlin", KOTLIN, span)
    assert got == [
        ("class", "Model", 6, 21), ("field", "Model.id", 7, 7), ("object", "Model.Factory", 10, 12), ("method", "Model.Factory.make", 11, 11),
        ("class", "Model.State", 13, 13), ("method", "Model.load", 14, 19), ("field", "Model.size", 20, 20), ("type_alias", "Done", 23, 23),
        ("interface", "Hook", 24, 24), ("method", "Hook.call", 24, 24), ("object", "Only", 25, 25)]
    load = next(r for r in rows if r.name == "load")
    assert load.modifiers == ["override", "suspend"] and load.parent_qualified_name == "Model"
    assert load.signature == "override suspend fun <T> List<T>.load( x: T, ): T"
    for r in rows:
        assert KOTLIN[r.char_lo:r.char_hi].split("\n")[0].rstrip() in KOTLIN.split("\n")[r.line_lo - 1]
    assert KOTLIN[rows[5].char_lo:rows[5].char_hi].endswith("return x\n    }") and KOTLIN[rows[9].char_lo:rows[9].char_hi] == "fun call()"


def test_java(spark):
    got, rows = symbols(spark, "java", JAVA)
    assert got == [
        ("class", "Box", 2, 13), ("field", "Box.items", 3, 3), ("field", "Box.count", 4, 4), ("constructor", "Box.Box", 5, 8),
        ("method", "Box.toString", 10, 10), ("enum", "Box.Kind", 11, 11), ("interface", "Box.Mark", 12, 12)]
    assert rows[0].signature == "public class Box<T> extends Base" and rows[1].modifiers == ["private", "final"]


def test_typescript(spark):
    got, rows = symbols(spark, "typescript", TS)
    assert got == [
        ("class", "Store", 2, 11), ("field", "Store.items", 3, 3), ("method", "Store.load", 4, 9), ("method", "Store.size", 10, 10),
        ("const", "limit", 12, 12), ("type_alias", "Fn", 13, 13), ("enum", "Color", 14, 14), ("namespace", "Util", 15, 15),
        ("function", "main", 16, 18)]
    assert rows[0].modifiers == ["export", "default", "abstract"]


@pytest.mark.parametrize("span", [2, None])
def test_python(spark, span):
    got, _ = symbols(spark, "python", PY, span)
    assert got == [("class", "A", 4, 19), ("method", "A.f", 10, 15), ("class", "A.Inner", 17, 19), ("method", "A.Inner.g", 18, 19),
                   ("function", "top", 22, 22)]


def test_go_and_rust(spark):
    assert symbols(spark, "go", GO)[0] == [("type_alias", "Box", 2, 4), ("method", "Size", 5, 5), ("function", "New", 6, 8)]
    got, rows = symbols(spark, "rust", RUST)
    assert got == [("struct", "Box", 1, 1), ("class", "Box", 2, 4), ("method", "Box.size", 3, 3), ("class", "Box", 5, 7), ("method", "Box.fmt", 6, 6),
                   ("const", "MAX", 8, 8), ("module", "inner", 9, 9), ("trait", "inner.T", 9, 9), ("type_alias", "Alias", 10, 10)]


def test_docs_and_status(spark):
    text = "/**\n * About A.\n */\nclass A {\n  // near\n\n  fun f() {}\n  // far\n\n\n  fun g() {}\n  val x = 1 // trailing\n  fun h() {}\n}"
    rows = [(1, "kotlin", i, t) for i, t in enumerate(text.split("\n"), 1)]
    rows += [(2, "kotlin", 1, "class B {"), (3, None, 1, "hello"), (4, "python", 1, "# note"), (4, "python", 2, "def f(): pass")]
    df = spark.createDataFrame(rows, "file_id int, language string, line_no bigint, line string")
    for span in (2, None):
        docs = {(r.file_id, r.line_no): r.doc for r in X.leading_doc(df, span).collect()}
        assert docs == {(1, 4): "/**\n * About A.\n */", (1, 7): "// near", (4, 2): "# note"}
    assert {(r.file_id, r.status) for r in X.parse_status(df).collect()} == {(1, "ok"), (2, "partial"), (3, "failed"), (4, "ok")}


def test_very_long_lines(spark):
    """Megabyte lines: nothing recurses per character and no pattern is quadratic."""
    long_string = 'val s = "' + "a\\\"b{" * 150_000 + '"'
    minified = "foo(" + "a.b(c){d};" * 80_000 + ")"
    got, _ = symbols(spark, "kotlin", "class A {\n" + long_string + "\n}")
    assert got == [("class", "A", 1, 3), ("field", "A.s", 2, 2)]
    assert symbols(spark, "javascript", minified + "\nclass B {\n}")[0] == [("class", "B", 2, 3)]


def lines_df(spark, language, text, file_id=1):
    return spark.createDataFrame([(file_id, language, i, t) for i, t in enumerate(text.split("\n"), 1)], "file_id int, language string, line_no bigint, line string")


def test_constructor_parameters(spark):
    text = "class K(val p: Int,\n  private var q: Map<String, Int>) {\n  val r = 1\n}\nclass L(a: Int, val b: () -> Unit)\nfun f(x: Int) = K(1)"
    got, rows = symbols(spark, "kotlin", text)
    assert got == [("class", "K", 1, 4), ("field", "K.p", 1, 1), ("field", "K.q", 2, 2), ("field", "K.r", 3, 3), ("class", "L", 5, 5),
                   ("field", "L.b", 5, 5), ("function", "f", 6, 6)]
    assert [r.signature for r in rows][:3] == ["class K(val p: Int, private var q: Map<String, Int>)", "val p: Int", "private var q: Map<String, Int>"]
    assert rows[2].modifiers == ["private"] and [text[r.char_lo:r.char_hi] for r in rows][1:3] == ["val p: Int", "private var q: Map<String, Int>"]


def test_statements(spark):
    """Several on a line, one over several lines, comments and raw strings behind them."""
    text = 'fun a() = 1; fun b() = 2\nfun c(\n  x: Int,\n): Int =\n  x + 1\nval x = 1 // {\nval y = """\nclass No {\n"""\nval z = listOf(1)\n  .map { it }\nclass D { fun e() {} }'
    got, rows = symbols(spark, "kotlin", text)
    assert got == [("function", "a", 1, 1), ("function", "b", 1, 1), ("function", "c", 2, 5), ("property", "x", 6, 6), ("property", "y", 7, 9),
                   ("property", "z", 10, 11), ("class", "D", 12, 12), ("method", "D.e", 12, 12)]
    assert [r.signature for r in rows][:4] == ["fun a() = 1", "fun b() = 2", "fun c( x: Int, ): Int = x + 1", "val x = 1"]
    script = "const t = `\nclass No { (\n`;\nlet s = '`'; // it's\nexport class A extends B\n{\n  m(a: { b: number }) {\n  }\n}"
    assert symbols(spark, "typescript", script)[0] == [("const", "t", 1, 3), ("const", "s", 4, 4), ("class", "A", 5, 9), ("method", "A.m", 7, 8)]


@pytest.mark.parametrize("span", [2, None])
def test_errors_are_rows(spark, span):
    texts = {1: ") } fun a() { (", 2: "( ]", 3: "fun a() { val s = \"(\" } // {", 4: "class A {\n  fun f(\n}", 5: "a[(1)]\n{}"}
    df = spark.createDataFrame([(k, "kotlin", i, t) for k, v in texts.items() for i, t in enumerate(v.split("\n"), 1)] + [(6, None, 1, "(")],
                               "file_id int, language string, line_no bigint, line string")
    got = sorted((r.file_id, r.line_no or 0, r.sign or "", r.error) for r in X.parse_errors(df, span).collect())
    assert got == [(1, 1, "(", "ERROR at line 1"), (1, 1, ")", "ERROR at line 1"), (1, 1, "{", "ERROR at line 1"), (1, 1, "}", "ERROR at line 1"),
                   (2, 1, "(", "ERROR at line 1"), (2, 1, "]", "ERROR at line 1"), (4, 1, "{", "ERROR at line 1"), (4, 2, "(", "ERROR at line 2"),
                   (4, 3, "}", "ERROR at line 3"), (6, 0, "", "unsupported language")]
    assert {(r.file_id, r.status, r.errors) for r in X.parse_status(df, span).collect()} == {
        (1, "partial", 4), (2, "partial", 2), (3, "ok", 0), (4, "partial", 3), (5, "ok", 0), (6, "failed", 1)}


def test_docs_of_annotated_declarations(spark):
    text = "/** D */\n@Ann\nfun a() {}\n/** J */\n@Suppress(\"x\") @Other\n\npublic class B {}\n// none\nval x = 1\n\n@Ann\nfun c() {}"
    got = {r.line_no: r.doc for r in X.leading_doc(lines_df(spark, "kotlin", text)).collect()}
    assert got == {3: "/** D */", 7: "/** J */", 9: "// none"}


def test_unclosed_declarations_give_linear_rows(spark):
    n = 1000
    df = lines_df(spark, "kotlin", "\n".join(f"class A{i} {{" for i in range(n)))
    pieces = X.code_pieces(df)
    near = X._neighbours(pieces, X._declared(pieces), None)
    assert pieces.count() == 2 * n and near.count() <= 6 * n
    deepest = X.lexical_symbols(df, pieces=pieces).orderBy("line_lo").tail(1)[0]
    assert deepest.qualified_name == ".".join(f"A{i}" for i in range(n)) and deepest.line_hi == n


def test_languages_of_the_reference_tests(spark):
    """What the reference asks of a class in each language: itself, its members, nested under it."""
    hello = {
        "java": ("public class Hello {\n  private final String name;\n  public Hello(String name) { this.name = name; }\n  public String greet() { return name; }\n"
                 "  public static void main(String[] args) {\n    System.out.println(new Hello(\"x\").greet());\n  }\n}",
                 {"Hello", "Hello.name", "Hello.Hello", "Hello.greet", "Hello.main"}),
        "python": ("class Greeter:\n    def __init__(self, name: str):\n        self.name = name\n\n    def greet(self):\n        return 1\n\ndef main():\n    pass",
                   {"Greeter", "Greeter.__init__", "Greeter.greet", "main"}),
        "go": ("package main\n\ntype Greeter struct {\n\tName string\n}\n\nfunc (g *Greeter) Greet() string {\n\treturn g.Name\n}\n\nfunc main() {\n}", {"Greeter", "Greet", "main"}),
        "rust": ("pub struct Greeter { name: String }\nimpl Greeter {\n    pub fn new(name: &str) -> Self { Greeter { name: name.to_string() } }\n}\nfn main() {}", {"Greeter", "Greeter.new", "main"}),
        "javascript": ("class HelloGreeter {\n  constructor(name) {\n    this.name = name;\n  }\n  greet() {\n    return `hi ${this.name}`;\n  }\n}\nmodule.exports = { HelloGreeter };",
                       {"HelloGreeter", "HelloGreeter.constructor", "HelloGreeter.greet"}),
        "typescript": ("export interface PostRepository {\n  findAll(): Promise<Post[]>;\n}\nexport type Post = { id: number };\nexport class PostsController {\n"
                       "  constructor(private repo: PostRepository) {}\n  async list(): Promise<Post[]> {\n    const all = await this.repo.findAll();\n    return all;\n  }\n}",
                       {"PostRepository", "PostRepository.findAll", "Post", "Post.id", "PostsController", "PostsController.constructor", "PostsController.list"})}
    rows = [(k, k, i, t) for k, (text, _) in hello.items() for i, t in enumerate(text.split("\n"), 1)]
    df = spark.createDataFrame(rows, "file_id string, language string, line_no bigint, line string")
    got = {}
    for r in X.lexical_symbols(df).collect():
        got.setdefault(r.file_id, set()).add(r.qualified_name)
    assert got == {k: names for k, (_, names) in hello.items()}
    assert {r.status for r in X.parse_status(df).collect()} == {"ok"}


def test_parse_errors_deal_only_open_brackets_and_write_nothing(spark, monkeypatch):
    """Pairs on one line stay out of the shuffle, and the errors are those of the pieces."""
    texts = ["f(a[1]) {", "g(()) [{}] (", ") }", "x ] ( { [ ( ) ] } ) )", "((((((()))))))", "", "[ ( ] )", "} {"]
    df = spark.createDataFrame([(f, "go", i + 1, texts[(i * (f + 3)) % len(texts)]) for f in range(3) for i in range(9)],
                               "file_id long, language string, line_no long, line string")
    key = lambda r: (r.file_id, r.line_no, r.sign, r.error)
    for span in (2, None):
        want = sorted(key(r) for r in X.parse_errors(df, span, X.code_pieces(df, span)).collect())
        with monkeypatch.context() as m:
            m.setattr(X, "stage", lambda df, *by: (_ for _ in ()).throw(AssertionError("written")))
            assert sorted(key(r) for r in X.parse_errors(df, span).collect()) == want
    assert X._open_brackets(df.filter("line = 'f(a[1]) {'"), None).filter("c <> '{'").isEmpty()


def test_neighbours_are_found_without_sorting_for_their_sums(spark):
    """Structs as sums of a span would make every row be sorted once more."""
    lines = spark.createDataFrame([(1, "kotlin", 1, "class A(val b: Int) {"), (1, "kotlin", 2, "fun f() { }"), (1, "kotlin", 3, "}")],
                                  "file_id long, language string, line_no long, line string")
    pieces = X.code_pieces(lines)
    near = X._neighbours(pieces, X._declared(pieces), None)
    assert "SortAggregate" not in near._jdf.queryExecution().executedPlan().toString()


def test_leading_doc_reads_the_lines_once(spark, monkeypatch):
    lines = spark.createDataFrame([(1, "java", 1, "/** d */"), (1, "java", 2, "class A { }")], "file_id long, language string, line_no long, line string")
    pieces = X.code_pieces(lines)
    assert [tuple(r) for r in X.leading_doc(lines, pieces=pieces).collect()] == [(1, 2, "/** d */")]
    seen = []
    monkeypatch.setattr(X, "stage", lambda df: seen.append(df) or df)
    X.leading_doc(lines, pieces=pieces)
    plan = re.sub(r"#\d+L?", "", seen[0]._jdf.queryExecution().optimizedPlan().toString())
    assert "__span" in plan and "(line_no = line_no)" not in plan  # its rows are not joined to themselves
