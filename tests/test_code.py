"""Signatures, doc comments, resolved imports, heritage."""

import pytest
from graphloom.operators import describe, semantic
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "language, kind, name, code, want",
    [
        ("typescript", "function", "f", "export const f = async <T>(x: T[]): Promise<Map<string, T>> => {", "async <T>(x: T[]): Promise<Map<string, T>> => ..."),
        ("typescript", "function", "g", "const g = x => x", "() => ..."),
        ("typescript", "method", "m", "static async m(a = 1 < 2, b: () => void): { x: 1 } | { y: 2 } {", "async static function m(a = 1 < 2, b: () => void): { x: 1 } | { y: 2 }"),
        ("typescript", "class", "C", "export default class C {", "class C"),
        ("typescript", "interface", "I", "interface I<X = {}>\n  extends J<X>,\n    K {", "interface I<X = {}> extends J<X>,\n    K"),
        ("typescript", "type", "U", "export type U =\n  | 'a'", "type U"),
        ("typescript", "enum", "E", "enum E {\n  A = 'x', // one, two\n  /* B, */ C\n}", "enum E { A, C }"),
        ("typescript", "enum", "E", "enum E {", "enum E"),
        ("typescript", "constant", "k", "const k = '" + "x" * 300 + "'", "const k = '" + "x" * 189 + "..."),
        ("typescript", "function", "h", "function h(" + "a, " * 200 + "b) {", "function h(" + ("a, " * 200)[:289] + "..."),
        ("rust", "function", "r", "pub fn r<T: A>(x: &T) -> Result<T, E> {", "function r<T: A>(x: &T): Result<T, E>"),
        ("go", "method", "M", "func (r T) M(a int) (int, error) {", "function M(a int)"),
        ("python", "function", "p", "def p(\n    a,\n    b=(1, 2),\n):", "function p(\n    a,\n    b=(1, 2),\n)"),
        ("java", "method", "j", "public int j(int a) {", "public int j(int a) {"),
    ],
)
def test_signature(language, kind, name, code, want):
    assert describe.signature_of(language, kind, name, code.split("\n"), 0) == want


def test_doc():
    of = lambda text, at, floor=-1: describe.doc_of(text.split("\n"), at, floor)
    assert of("/** a */\n\nx", 2) == "/** a */" and of("/* a */\nx", 1) == "" and of("// a\nx", 1) == "" and of("x", 0) == ""
    assert of("/**\n * 1\n * 2\n * 3\n */\nx", 5) == "/**\n * 1\n * 2\n * 3\n */" and of("/**\n * 1\n * 2\n * 3\n * 4\n */\nx", 6) == "/**\n * 1\n * 2\n * 3\n */"
    assert of("/** a */\ny\nx", 2) == "" and of("/** a\ny */\nx", 2, 1) == "" and of("*/\nx", 1) == ""


def test_described_edges(spark):
    rows = [("n", "typescript", None), ("e", "typescript", ""), ("s", "shell", "function f() {"), ("a", "typescript", "function a(")]
    d = spark.createDataFrame(rows, "path string, language string, content string").withColumn("doc", F.lit(1))
    assert [tuple(r) for r in describe.described(d).collect()] == [("a", 1, "function", "a", "function a(", "")]
    assert describe.described(d.limit(0)).count() == 0


def files(spark, **texts):
    rows = [(k.replace("__", "/").replace("_", ".").replace("node.modules", "node_modules"), "json" if k.endswith("json") else "typescript", v) for k, v in texts.items()]
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_bindings(spark):
    code = "import type { A, B as C } from './x';\nimport D, * as N from \"y\";\nimport {\n  E,\n  F as G,\n} from './z';\nexport { H } from './h';\nexport * from './s';\nimport './bare';\nconst from = 'q';\n"
    got = {r.import_path: (r.symbols, r.names) for r in semantic.bindings(files(spark, a_ts=code)).collect()}
    assert got == {"./x": (["A", "C"], ["A", "C"]), "y": (["D"], ["D", "N"]), "./z": (["E", "G"], ["E", "G"]), "./h": ([], []), "./s": ([], []), "./bare": ([], [])}


def test_resolution(spark):
    config = '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["app/*"], "@/deep/*": ["gone/*", "deep/*"], "exact": ["one.ts"]}}}'
    there = dict.fromkeys(["src__app__b_ts", "src__deep__c_tsx", "src__one_ts", "src__plain_ts", "src__dir__index_ts", "src__dir_js", "top_d_ts", "node_modules__pkg__index_ts"], "")
    wanted = ["@/b", "@/deep/c", "exact", "plain", "./dir", "./dir/index", "../top", "../../../top", "./plain.js", "pkg", "./missing", "../node_modules/pkg"]
    f = files(spark, tsconfig_json=config, src__a_ts="\n".join(f"import '{x}';" for x in wanted), **there)
    got = {r.import_path: r.target for r in semantic.resolved(semantic.bindings(f), f, semantic.path_map(f)).collect()}
    assert got == {
        "@/b": "src/app/b.ts", "@/deep/c": "src/deep/c.tsx", "exact": "src/one.ts", "plain": "src/plain.ts", "./dir": "src/dir.js", "./dir/index": "src/dir/index.ts",
        "../top": "top.d.ts", "../../../top": "top.d.ts", "./plain.js": "src/plain.ts",
    }
    assert semantic.path_map(files(spark, a_ts="")) == {"*": ["*"]}


def test_heritage(spark):
    code = "export abstract class A<T extends B<C>> extends ns.D<Map<string, T>>\n  implements E, F<G> {\n}\ninterface I extends J, K {}\nclass Plain {}\nexport default class L extends mixin(M) {}\n"
    got = {(r.entity, r.kind, r.parent) for r in semantic.heritage(files(spark, a_ts=code)).collect()}
    assert got == {("A", "extends", "ns.D"), ("A", "implements", "E"), ("A", "implements", "F"), ("I", "extends", "J"), ("I", "extends", "K")}
    two = files(spark, a_ts="import { P, Q } from './b';\nclass A extends P {}\nclass B extends Q implements P {}\nclass C extends A {}\n", b_ts="", n_ts=None)
    got = {(r.dst, r.kind, tuple(r.symbols), r.weight, r.confidence) for r in semantic.semantic_edges(two).collect()}
    assert got == {("b.ts", "import", ("P", "Q"), 1.0, 1.0), ("b.ts", "extends", ("P", "Q"), 1.5, 1.0), ("b.ts", "implements", ("P",), 1.2, 1.0)}
    assert semantic.semantic_edges(two.limit(0)).count() == 0
