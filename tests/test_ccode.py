"""The C lexer and the functions on it."""

import pytest

from quernstone.functions import ccode


@pytest.mark.parametrize("code, expected", [
    ("int f() { return 0; }", 1), ("int f(int a) { if (a) return 1; return 0; }", 2), ("int f(int a, int b) { if (a && b) { for (;;) a++; } return a; }", 4),
    ("int f(int a) { while (a || b) a = a ? 1 : 0; return a; }", 4), ("int f(int a) { do { a--; } while (a); return 0; }", 2), ('int f() { puts("if (a && b)"); /* for */ return 0; }', 1),
    ("int f(int a) { switch (a) { case 1: return 1; case 2: return 2; default: return 0; } }", 3),
])
def test_complexity(code, expected):
    assert ccode.complexity(code) == expected


@pytest.mark.parametrize("code, expected", [
    ("// head\nint f() { return 1; } // tail", "int f ( ) { return 1 ; }"), ('char *s = "/* no */ // no"; /* yes */', 'char * s = "/* no */ // no" ;'), ("**/ int f(void) {}", "int f ( void ) { }"),
])
def test_comments(code, expected):
    assert " ".join(ccode.tokens(ccode.without_comments(code))) == expected


def test_braces_and_directives_are_closed():
    assert ccode.tokens(ccode.with_closed_braces("void f() { if (a) { b(); }")) == ccode.tokens("void f() { if (a) { b(); } }")
    assert ccode.with_closed_braces('void f() { puts("{"); }') == 'void f() { puts("{"); }'
    assert ccode.with_closed_directives("#ifdef A\nint a;\n#else\nint b;").endswith("\n#endif")
    assert ccode.with_closed_directives("#if A\n#endif") == "#if A\n#endif"


@pytest.mark.parametrize("code, expected", [
    ("int a;\n#endif\nint b;", "int a;\nint b;"), ("#ifdef A\nint a;\n#else\nint b;", "#ifdef A\nint a;\n#else\nint b;"), ("#if A\nint a;\n#elif B\nint b;\n#endif", "#if A\nint a;\n#elif B\nint b;\n#endif"),
    ("void f() {\n#if A\n a();\n#endif\n#endif // again\n}", "void f() {\n#if A\n a();\n#endif\n}"), ("void f() {\n#else\n b();\n#endif\n}", "void f() {\n}"), ("#elif B\nint a;", "int a;"),
    ("#endif\nvoid f() {\n#if A\n a();\n#endif\n#elif B\n b();\n#endif\n#endif\n}", "void f() {\n#if A\n a();\n#endif\n}"), ("#if A\n a();\n#else\n b();\n#else\n c();\n#endif", "#if A\n a();\n#else\n b();\n c();\n#endif"),
    ("void f() {\n#else\n#if defined(V)\n if (!v()) return;\n#endif\n d();\n#endif\n}", "void f() {\n#if defined(V)\n if (!v()) return;\n#endif\n d();\n}"), ("#if A \\\n && B\nint a;\n#endif\n#else \\\n\nint b;", "#if A \\\n && B\nint a;\n#endif\nint b;"),
])
def test_dangling_directives(code, expected):
    assert ccode.without_dangling_directives(code) == expected


@pytest.mark.parametrize("code, expected", [
    ("f(int a) { return a; }", "int f(int a) { return a; }"), ("static f(void) { }", "static int f(void) { }"), ("void f(void) { }", "void f(void) { }"), ("f(a) int a; { return a; }", "int f(a) int a; { return a; }"), ("f(a);", "f(a);"), ("paste(f_, X)(int *a) { }", "int paste(f_, X)(int *a) { }"), ("paste(f_, X) { a(); }", "int paste(f_, X) { a(); }"),
])
def test_return_type(code, expected):
    assert ccode.with_return_type(code) == expected


@pytest.mark.parametrize("code, status", [
    ("int f() { return 0; }", "ok"), ("int f() { return 0;", "ok"), ("", "empty"), ("// nothing", "empty"), ("int a = 3;", "no_function"), ("#define A 1\n#define B 2", "empty"), ("}}}*/ int f(void) { return 1; }", "ok"), (None, "empty"),
    ("#endif\n\nint f() { return 1; }", "ok"), ("#ifdef __X__\nint f() { return 1; }", "empty"), ("#define E\nE", "empty"), ("#error a\nint f() { }", "preprocessor"), ("int f() { } }", "unbalanced"),
])
def test_process(code, status):
    assert ccode.process(code)[1] == status


def test_body():
    assert ccode.body("} int f(void) { a(); }") == "int f(void) { a(); }"
    assert ccode.body("int a;") is None


@pytest.mark.parametrize("code, expected", [
    ("#define SQ(x) ((x) * (x))\nint f() { return SQ(5); }", "int f() { return ((5) * (5)); }"), ("#if 1\n int x;\n#endif", "int x;"), ("#if 0\nint x;\n#endif", ""), ("#if 0\nint x;\n#else\nint y;\n#endif", "int y;"),
    ("#if 1\n#if 0\nint x;\n#endif\nint y;\n#endif", "int y;"), ("#if 0\n#if 1\nint x;\n#if B\nint f;\n#endif\n#endif\nint y;\n#else\nint k;\n#endif", "int k;"), ("#define KEEPS\nint f() { do {\n#ifdef KEEP\n} while (0);\n#else\n} while (1);\n#endif\n}", "int f() { do {\n} while (1);\n}"),
    ("#define CAT(a, b) a ## b\n#define STR(x) #x\nCAT(in, t) s = STR(a \"b\");", 'int s = "a \\"b\\"";'), ("#define LOG(f, ...) print(f, __VA_ARGS__)\nLOG(a, 1, g(2, 3));", "print(a, 1,g(2, 3));"), ("#define A B\n#define B A\nA B", "A B"), ("#define F(x) x\nF F(1) F (2)", "F 1 2"),
    ("#define N 3\n#undef N\nN", "N"), ("#define LONG 1 + \\\n 2\nLONG", "1 +  2"), ('#define S x\nputs("S // S"); /* S */ S', 'puts("S // S");   x'), ("#if (1 ? 0x10 : 0) == 020 && 'a' == 97 && -7 / 2 == -3 && !(1 << 2 & 3)\nok\n#endif", "ok"), ("#if defined X || defined(Y)\na\n#elif !defined(X)\nb\n#endif", "b"),
    ("#if A\nint a;", None), ("#endif", None), ("#if (\n#endif", None), ("#if 1 / 0\n#endif", None), ("#error no", None), ("#if 0\n#error no\n#endif\na", "a"), ("#nonsense", None), ("#if 1\n#else\n#else\n#endif", None), ("#define F(a, b) a\nF(1)", None), ("", ""), ("#include <x.h>\na", "a"),
])
def test_preprocessor(code, expected):
    assert ccode.preprocess(code) == expected if expected is None else ccode.preprocess(code).strip() == expected


def test_preprocessor_ends(monkeypatch):
    """Macros that would grow without bound, and deep nesting, fail and do not hang."""
    doubling = "".join(f"#define A{i} A{i + 1} A{i + 1}\n" for i in range(60)) + "A0"
    assert ccode.preprocess(doubling) is None
    assert ccode.preprocess("#if " + "(" * 5000 + "1" + ")" * 5000 + "\n#endif") is None


def tool(folder, name, text):
    path = folder / name
    path.write_text("#!/bin/sh\n" + text)
    path.chmod(0o755)


def test_outside_tools(tmp_path, monkeypatch):
    """A compiler and a formatter are asked where they are there; failing and slow ones, and none at all, are told by the status."""
    monkeypatch.setenv("PATH", str(tmp_path))
    assert ccode.preprocess("int a;", "gcc") is None and ccode.process("int f() { }", "gcc") == (None, "preprocessor")
    assert ccode.format_code("int  a;") == ("int  a;", "unformatted")
    tool(tmp_path, "gcc", 'test "$*" = "-E -P -x c -" || exit 1\nwhile read -r x; do echo "$x"; done\n')
    assert ccode.process("int f(void) { return 1; }\n", "gcc") == ("int f(void) { return 1; }\n", "ok")
    tool(tmp_path, "clang-format", "echo formatted\n")
    assert ccode.format_code("int  a;") == ("formatted\n", "formatted")
    for text in ("exit 3\n", "while true; do :; done\n"):
        tool(tmp_path, "gcc", text)
        tool(tmp_path, "clang-format", text)
        assert ccode.preprocess("int a;", "gcc", seconds=0.5) is None
        assert ccode.format_code("int  a;", seconds=0.5) == ("int  a;", "unformatted")


def test_cpp_signs(spark):
    cases = [("class A : public B {", True), ("std::string s;", True), ("int renew(int a) { return a; }", False), ("x = new int;", True), (None, False)]
    df = spark.createDataFrame(cases, "code string, cpp boolean")
    assert all(r.cpp == r.got for r in df.select("cpp", ccode.looks_cpp(df.code).alias("got")).collect())
