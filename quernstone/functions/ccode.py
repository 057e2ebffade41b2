"""Cleaning and measuring of C functions by a linear lexer.

Decisions that need a syntax tree are made on the token stream instead: see each function for what it looks at. All
string functions here are plain Python over one text, so that they compose; clean() runs them over a column in one
Arrow-batched call.
"""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions import cpreprocessor

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>L?"(?:\\.|[^"\\\n])*"?|L?'(?:\\.|[^'\\\n])*'?)|(?P<directive>^[ \t]*\#(?:\\\r?\n|[^\n])*)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[\w.]|[eEpP][+-])*)|(?P<op>&&|\|\||->|\+\+|--|<<=?|>>=?|[-+*/%&|^=!<>]=|\.\.\.|::|[^\s\w])""",
    re.S | re.M | re.X,
)
DECISIONS = frozenset(("if", "case", "do", "while", "for"))
#: Signs of C++: classes, access, templates, namespaces, scopes, exceptions and casts.
CPP_SIGNS = (
    r"\bclass\s+\w+[^;{]*\{", r"\b(?:private|public|protected)\s*:", r"\btemplate\s*<", r"\bnamespace\b", r"\w\s*(?:<[^<>]*>)?::\s*\w",
    r"\b(?:new|delete|try|catch|throw)\b", r"\b(?:const|static|dynamic|reinterpret)_cast\s*<",
)
GARBAGE = re.compile(r"\*+\s*\\*[/\\]")
CONTROL = frozenset("if for while switch do else return sizeof case goto".split())
TYPES = frozenset("void int char short long float double signed unsigned struct union enum const static inline extern volatile register size_t bool _Bool".split())


@lru_cache(maxsize=4)
def lex(code: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of the tokens, comments and directives included. Steps that leave the code as it is share one pass."""
    return [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(code)]


def tokens(code: str) -> list[str]:
    """Texts of the tokens but comments: what two equal programs have in common."""
    return [t for k, t, _ in lex(code) if k != "comment"]


def without_comments(code: str) -> str:
    """Comments out, then the first rest of a cut-off comment, then blanks at the start; literals are left alone."""
    out, at = [], 0
    for kind, text, start in lex(code):
        if kind == "comment":
            out.append(code[at:start])
            at = start + len(text)
    out.append(code[at:])
    code = "".join(out)
    literals = [(a, a + len(t)) for k, t, a in lex(code) if k == "string"]
    for m in GARBAGE.finditer(code):
        if not any(a <= m.start() < b for a, b in literals):
            code = code[: m.start()] + code[m.end() :]
            break
    return code.lstrip()


def ascii_only(code: str) -> str:
    return re.sub(r"[^\x00-\x7f]", "", code)


def body(code: str) -> str | None:
    """From the first function definition or block on; None if there is neither.

    A definition is a name and a parenthesised list followed by an opening brace, taken back to the start of its
    declaration.
    """
    seen = [t for t in lex(code) if t[0] not in ("comment", "directive")]
    depth, start = 0, None
    for i, (kind, text, at) in enumerate(seen):
        if text in (";", "}") and depth == 0:
            start = None
        elif text == "(":
            depth += 1
        elif text == ")":
            depth = max(0, depth - 1)
        elif text == "{" and depth == 0:
            return code[at if start is None else start :]
        elif start is None and depth == 0 and kind == "word":
            start = at
    return None


def with_closed_directives(code: str) -> str:
    """An #endif for each conditional that is left open."""
    names = [re.match(r"[ \t]*#\s*(\w*)", t).group(1) for k, t, _ in lex(code) if k == "directive"]
    missing = sum(n in ("if", "ifdef", "ifndef") for n in names) - names.count("endif")
    return code + "\n#endif" * missing


def with_closed_braces(code: str) -> str:
    """A closing brace for each that is missing; braces in literals, comments and directives do not count."""
    texts = [t for k, t, _ in lex(code) if k == "op"]
    missing = texts.count("{") - texts.count("}")
    return code.rstrip() + "\n}" * missing if missing > 0 else code


def with_return_type(code: str) -> str:
    """int before a definition that begins with its name, or with a storage class and its name."""
    seen = [t for t in lex(code) if t[0] not in ("comment", "directive")]
    lead = 0
    while lead < len(seen) and seen[lead][1] in ("static", "inline", "extern"):
        lead += 1
    if lead + 1 >= len(seen) or seen[lead][0] != "word" or seen[lead + 1][1] != "(" or seen[lead][1] in CONTROL | TYPES:
        return code
    depth = 0
    for i in range(lead + 1, len(seen)):
        depth += {"(": 1, ")": -1}.get(seen[i][1], 0)
        if depth == 0 and i + 1 < len(seen) and seen[i + 1][1] == "(":
            continue  # a name made by a macro, then the list
        if depth == 0:
            # the list may be followed by declarations of old style before the block
            rest = [t for _, t, _ in seen[i + 1 :]]
            if "{" in rest and (rest[0] == "{" or (rest[0] not in (";", "=", ",") and ";" in rest[: rest.index("{")])):
                at = seen[lead][2]
                return f"{code[:at]}int {code[at:]}"
            return code
    return code


def without_dangling_directives(code: str) -> str:
    """Directives that no conditional holds go: an #else, #elif or #endif without an opening, and a second #else.

    Of an #else or #elif without an opening that an #endif closes the lines between go too, unless there are
    conditionals among them. An opening that is not closed stays: see with_closed_directives.
    """
    lines = code.split("\n")
    ended: list[bool] = []  # of each open conditional: whether its #else was there
    drop: set[int] = set()
    loose: int | None = None  # line of an #else or #elif without an opening
    skip = -1
    for i, line in enumerate(lines):
        m = re.match(r"[ \t]*#\s*(\w*)", line)
        if not m or i <= skip:
            continue
        skip = i
        while lines[skip].rstrip("\r").endswith("\\") and skip + 1 < len(lines):
            skip += 1
        own = range(i, skip + 1)
        if m[1] in ("if", "ifdef", "ifndef"):
            ended.append(False)
            loose = None
        elif m[1] in ("else", "elif"):
            if not ended:
                loose = i
                drop.update(own)
            elif ended[-1]:
                drop.update(own)
            else:
                ended[-1] = m[1] == "else"
        elif m[1] == "endif":
            if ended:
                ended.pop()
            else:
                drop.update(own if loose is None else range(loose, skip + 1))
                loose = None
    return "\n".join(x for i, x in enumerate(lines) if i not in drop)


def complexity(code: str) -> int:
    """One more than the decision points: if, case, do, while, for, ?:, && and ||. The while that ends a do does not count."""
    count, ended, pending = 1, False, []
    depth = 0
    for kind, text, _ in lex(code):
        if kind in ("comment", "directive", "string"):
            continue
        if text == "{":
            depth += 1
        elif text == "}":
            depth -= 1
        if text == "while" and pending and pending[-1] == depth and ended:
            pending.pop()
        elif text in DECISIONS or text in ("?", "&&", "||"):
            count += 1
            if text == "do":
                pending.append(depth)
        ended = text in ("}", ";")
    return count


def is_function(code: str) -> bool:
    """Whether there is a definition: a name and a list before an opening brace outside any block."""
    seen = [t for t in lex(code) if t[0] not in ("comment", "directive")]
    depth = block = 0
    named = closed = False
    for i, (kind, text, _) in enumerate(seen):
        if text == "(":
            named = named or (block == 0 and depth == 0 and i > 0 and seen[i - 1][0] == "word" and seen[i - 1][1] not in CONTROL)
            depth += 1
        elif text == ")":
            depth -= 1
            closed = depth == 0
        elif text == "{":
            if block == 0 and named and closed:
                return True
            block += 1
        elif text == "}":
            block -= 1
            named = closed = False
        elif text in (";", "=") and depth == 0 and block == 0:
            named = closed = False
    return False


def looks_cpp(column: Column) -> Column:
    """The signs of C++ as one JVM-side predicate."""
    return F.coalesce(F.rlike(column, F.lit("|".join(CPP_SIGNS))), F.lit(False))


def run_tool(command: list[str], code: str, seconds: float) -> str | None:
    """Output of a program that reads code; None if it is not installed, fails, or takes longer than seconds."""
    program = shutil.which(command[0])
    if program is None:
        return None
    try:
        got = subprocess.run([program, *command[1:]], input=code, capture_output=True, text=True, timeout=seconds, check=False)
    except (subprocess.TimeoutExpired, OSError, UnicodeError):
        return None
    return got.stdout if got.returncode == 0 else None


def preprocess(code: str, tool: str = "builtin", seconds: float = 10) -> str | None:
    """The code preprocessed, without line marks, by cpreprocessor (builtin) or by a compiler (gcc); None if that fails.

    A compiler is started for each text, knows its own macros and finds its headers; builtin is the same everywhere.
    """
    if tool == "builtin":
        return cpreprocessor.preprocess(code)
    return run_tool([tool, "-E", "-P", "-x", "c", "-"], code, seconds)


def balanced(code: str) -> bool:
    depth = 0
    for kind, text, _ in lex(code):
        if kind == "op":
            depth += {"{": 1, "}": -1}.get(text, 0)
            if depth < 0:
                return False
    return depth == 0


def process(code: str | None, tool: str | None = "builtin") -> tuple[str | None, str]:
    """(clean function, status): ok, or why it was rejected: empty, preprocessor, no_function or unbalanced.

    tool names the preprocessor; where it fails, dangling directives go, open ones are closed, and it is tried again.
    None leaves directives in place.
    """
    code = without_comments(ascii_only(code or ""))
    if not code.strip():
        return None, "empty"
    if tool is None:
        code = with_closed_directives(without_dangling_directives(code))
    else:
        got = preprocess(code, tool)
        if got is None:
            got = preprocess(with_closed_directives(without_dangling_directives(code)), tool)
        if got is None:
            return None, "preprocessor"
        code = got
        if not code.strip():
            return None, "empty"
    code = with_return_type(with_closed_braces(code))
    code = body(code)
    if code is None or not is_function(code):
        return None, "no_function"
    return (code, "ok") if balanced(code) else (None, "unbalanced")


def clean(df: DataFrame, column: str = "func", tool: str | None = "builtin", step: Callable[[str], str] | None = None) -> DataFrame:
    """Adds clean, status, cyclomatic_complexity. Cheap JVM-side filters belong before this call; step is a further function on the code."""

    @F.pandas_udf("clean string, status string, cyclomatic_complexity int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str | None, tuple] = {}
        for part in parts:
            rows = []
            for code in part:
                if code not in memo:
                    if len(memo) >= 1000:
                        memo.clear()
                    got, status = process(code, tool)
                    got = step(got) if step and got is not None else got
                    memo[code] = (got, status, complexity(got) if got is not None else None)
                rows.append(memo[code])
            yield pd.DataFrame(rows, columns=["clean", "status", "cyclomatic_complexity"]).astype({"cyclomatic_complexity": "Int32"})

    return df.withColumn("__c", run(F.col(column))).select(*df.columns, "__c.clean", "__c.status", "__c.cyclomatic_complexity")


def applied(step: Callable[[str], object], column: Column, kind: str = "string") -> Column:
    """One of the functions on code over a column, batch by batch; null stays null."""

    @F.pandas_udf(kind)
    def run(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: None if c is None else step(c))

    return run(column)


def format_code(code: str, style: str = "LLVM", seconds: float = 10) -> tuple[str, str]:
    """(code, status): formatted where the formatter is installed and does its work in time, else as it is with status unformatted."""
    got = run_tool(["clang-format", f"--style={style}", "--assume-filename=a.c"], code, seconds)
    return (code, "unformatted") if got is None else (got, "formatted")
