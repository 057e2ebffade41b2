"""A C preprocessor for snippets: conditionals, object-like and function-like macros, without any outside tool.

Included files are not looked for: an #include gives nothing. #error, an unknown directive, a conditional that is not
closed or not opened, and an expression that cannot be read make the snippet fail, as with a compiler's preprocessor.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

PIECE = re.compile(r'L?"(?:\\.|[^"\\\n])*"?|L?\'(?:\\.|[^\'\\\n])*\'?|[A-Za-z_]\w*|\.?\d(?:[eEpP][+-]|[\w.])*|\s+|##|&&|\|\||<<|>>|[<>=!]=|.', re.S)
COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)(.*)", re.S)
DEFINE = re.compile(r"\s*([A-Za-z_]\w*)(\(([^)]*)\))?(.*)", re.S)
NAME = re.compile(r"[A-Za-z_]\w*\Z")
#: Pieces that a snippet may expand to.
MOST = 200_000
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))


class Failed(Exception):
    """The snippet cannot be preprocessed."""


@dataclass
class Macro:
    body: list[str]
    names: list[str] | None = None
    more: bool = False


@dataclass
class State:
    macros: dict[str, Macro] = field(default_factory=dict)
    made: int = 0


def split(text: str) -> list[str]:
    return PIECE.findall(text)


def trimmed(pieces: list[str]) -> list[str]:
    while pieces and pieces[0].isspace():
        pieces = pieces[1:]
    while pieces and pieces[-1].isspace():
        pieces = pieces[:-1]
    return pieces


def arguments(pieces: list[str], at: int) -> tuple[list[list[str]], int] | None:
    """Arguments of a call whose opening bracket is at or after `at`, and where it ends; None if there is no call."""
    while at < len(pieces) and pieces[at].isspace():
        at += 1
    if at == len(pieces) or pieces[at] != "(":
        return None
    depth, out = 0, [[]]
    for i in range(at, len(pieces)):
        p = pieces[i]
        depth += (p == "(") - (p == ")")
        if depth == 0:
            return [trimmed(a) for a in out], i + 1
        if p == "," and depth == 1:
            out.append([])
        elif i > at:
            out[-1].append(p)
    return None


def substituted(macro: Macro, given: list[list[str]], state: State, hidden: frozenset[str]) -> list[str]:
    """A function-like macro's body with its arguments in place, # and ## carried out."""
    names = macro.names or []
    if macro.more:
        given = [*given[: len(names) - 1], [x for i, a in enumerate(given[len(names) - 1 :]) for x in ([",", *a] if i else a)]]
    if len(given) != len(names) and not (not names and given == [[]]):
        raise Failed
    own = dict(zip(names, given))
    body, out, i = macro.body, [], 0
    paste = lambda j: next((p for p in body[j:] if not p.isspace()), "") == "##"
    while i < len(body):
        p = body[i]
        if p == "#" and (j := next((k for k in range(i + 1, len(body)) if not body[k].isspace()), None)) is not None and body[j] in own:
            out.append('"' + "".join(own[body[j]]).replace("\\", "\\\\").replace('"', '\\"') + '"')
            i = j + 1
            continue
        if p in own:
            glued = paste(i + 1) or next((x for x in reversed(body[:i]) if not x.isspace()), "") == "##"
            out += own[p] if glued else expand(own[p], state, hidden)
        else:
            out.append(p)
        i += 1
    return joined(out)


def joined(pieces: list[str]) -> list[str]:
    """Pieces with those around each ## made one."""
    out: list[str] = []
    i = 0
    while i < len(pieces):
        if pieces[i] == "##" and out:
            while out and out[-1].isspace():
                out.pop()
            i += 1
            while i < len(pieces) and pieces[i].isspace():
                i += 1
            left, right = out.pop() if out else "", pieces[i] if i < len(pieces) else ""
            out += split(left + right)
        else:
            out.append(pieces[i])
        i += 1
    return out


def expand(pieces: list[str], state: State, hidden: frozenset[str] = frozenset()) -> list[str]:
    """Pieces with all macros but the hidden ones expanded."""
    out, i = [], 0
    while i < len(pieces):
        p = pieces[i]
        i += 1
        macro = state.macros.get(p) if p not in hidden else None
        if macro is None:
            out.append(p)
        elif macro.names is None:
            out += expand(joined(macro.body), state, hidden | {p})
        elif (call := arguments(pieces, i)) is not None:
            out += expand(substituted(macro, call[0], state, hidden), state, hidden | {p})
            i = call[1]
        else:
            out.append(p)
        state.made += 1
        if state.made > MOST or len(out) > MOST:
            raise Failed
    return out


def integer(text: str) -> int:
    if text[0] == "'":
        body = text[1:-1].encode().decode("unicode_escape", "replace")
        return ord(body[:1] or "\0")
    digits = text.rstrip("uUlL")
    try:
        return int(digits, 8) if re.fullmatch(r"0[0-7]+", digits) else int(digits, 0)
    except ValueError:
        raise Failed from None


def evaluate(text: str, state: State) -> bool:
    """Whether the expression of an #if or #elif holds; names that are no macros are 0."""
    asked = re.sub(r"\bdefined\s*(?:\(\s*([A-Za-z_]\w*)\s*\)|([A-Za-z_]\w*))", lambda m: "1" if (m[1] or m[2]) in state.macros else "0", text)
    seen = [p for p in expand(split(asked), state) if not p.isspace()]
    at = 0

    def peek() -> str:
        return seen[at] if at < len(seen) else ""

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(seen):
            raise Failed
        return seen[at - 1]

    def unary() -> int:
        p = take()
        if p == "!":
            return int(not unary())
        if p in ("-", "+", "~"):
            x = unary()
            return -x if p == "-" else ~x if p == "~" else x
        if p == "(":
            x = choice()
            if take() != ")":
                raise Failed
            return x
        if NAME.match(p):
            return 0
        if p[0].isdigit() or p[0] == "'":
            return integer(p)
        raise Failed

    def level(k: int) -> int:
        if k == len(LEVELS):
            return unary()
        x = level(k + 1)
        while peek() in LEVELS[k]:
            op, y = take(), level(k + 1)
            if op in ("/", "%") and y == 0:
                raise Failed
            if op in ("<<", ">>") and not 0 <= y < 64:
                raise Failed
            x = {
                "||": lambda: int(bool(x or y)), "&&": lambda: int(bool(x and y)), "|": lambda: x | y, "^": lambda: x ^ y, "&": lambda: x & y, "==": lambda: int(x == y), "!=": lambda: int(x != y), "<": lambda: int(x < y),
                ">": lambda: int(x > y), "<=": lambda: int(x <= y), ">=": lambda: int(x >= y), "<<": lambda: x << y, ">>": lambda: x >> y, "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y,
                "/": lambda: abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1), "%": lambda: abs(x) % abs(y) * (-1 if x < 0 else 1),
            }[op]()
        return x

    def choice() -> int:
        x = level(0)
        if peek() != "?":
            return x
        take()
        yes = choice()
        if take() != ":":
            raise Failed
        no = choice()
        return yes if x else no

    x = choice()
    if at != len(seen):
        raise Failed
    return x != 0


def define(text: str, state: State) -> None:
    m = DEFINE.match(text)
    if m is None:
        raise Failed
    names = None if m[2] is None else [x.strip() for x in m[3].split(",") if x.strip()]
    more = bool(names) and names[-1] == "..."
    if more:
        names[-1] = "__VA_ARGS__"
    state.macros[m[1]] = Macro(trimmed(split(m[4])), names, more)


def without_blank_lines(text: str) -> str:
    return "\n".join(x.rstrip() for x in text.split("\n") if x.strip())


def preprocess(code: str, defined: dict[str, str] | None = None) -> str | None:
    """The snippet preprocessed, without comments and blank lines; None if it fails."""
    state = State({k: Macro(split(v)) for k, v in (defined or {}).items()})
    code = re.sub(r"\\\r?\n", "", code)
    code = COMMENT.sub(lambda m: m[0] if m[0][0] != "/" else " " + "\n" * m[0].count("\n"), code)
    out: list[str] = []
    held: list[str] = []
    stack: list[dict[str, bool]] = []  # of each open conditional: outer, whether one of its parts was taken, whether this part is, whether #else was seen

    def flush() -> None:
        out.append("".join(expand(split("\n".join(held)), state)))
        held.clear()

    try:
        for line in code.split("\n"):
            on = not stack or stack[-1]["on"]
            m = DIRECTIVE.match(line)
            if m is None:
                if on:
                    held.append(line)
                continue
            name, rest = m[1], m[2].strip()
            if name in ("if", "ifdef", "ifndef"):
                holds = on and (evaluate(rest, state) if name == "if" else (rest.split(" ")[0] in state.macros) == (name == "ifdef"))
                stack.append({"outer": on, "taken": holds, "on": holds, "last": False})
            elif name in ("elif", "else"):
                if not stack or stack[-1]["last"]:
                    return None
                top = stack[-1]
                holds = top["outer"] and not top["taken"] and (name == "else" or evaluate(rest, state))
                stack[-1] = {"outer": top["outer"], "taken": top["taken"] or holds, "on": holds, "last": name == "else"}
            elif name == "endif":
                if not stack:
                    return None
                stack.pop()
            elif not on:
                continue
            elif name == "define":
                flush()
                define(rest, state)
            elif name == "undef":
                flush()
                state.macros.pop(rest, None)
            elif name not in ("include", "pragma", "line", "ident", "warning", ""):
                return None
        if stack:
            return None
        flush()
    except (Failed, RecursionError):
        return None
    return without_blank_lines("\n".join(out))
