"""URL filters by a bit-parallel wildcard automaton.

Globs (* any run, ? any character, else literal) are packed into words of 64 states. A glob of m symbols besides its
stars takes m + 1 neighbouring states; state 0 is active at the start. Reading a character c shifts all states by
one, keeps those whose symbol accepts c (Shift-And), and adds the states that a following star holds active. All
globs advance at once over each URL, and all URLs of a batch at once over their characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm import textscan
from quernstone.llm.common import arrow_map, batch

DENY = ("*://*casino*", "*://*free-bets*", "*://*cheap-pills*", "*://*porn*", "*://*viagra*", "*://*.xxx/*", "*://ad?.*", "*/ads/*", "*/banner?.*", "*/login", "*/login/*", "*.exe", "*.zip")
ALLOW = ("*://*.gov/*", "*://docs.*")


@dataclass
class Automaton:
    """Masks by 64-bit word: accepts (256 x words), stay, start, first (states that a shift must not reach), more (states that hold while a character goes on), and each glob's last state."""

    globs: tuple[str, ...]
    accepts: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    first: np.ndarray
    more: np.ndarray
    last: np.ndarray


def compile_globs(globs: Sequence[str]) -> Automaton:
    """Pack globs; their symbols are bytes of UTF-8, a ? being one byte that starts a character with those that follow it."""
    layout = []
    for glob in globs:
        symbols, stars = [], set()
        for c in glob:
            if c == "*":
                stars.add(len(symbols))
            elif c == "?":
                symbols.append(None)
            else:
                symbols.extend(c.encode())
        layout.append((symbols, stars))
    total = sum(len(s) + 1 for s, _ in layout)
    words = max(1, -(-total // 64))
    accepts, (stay, start, first, more) = np.zeros((256, words), np.uint64), np.zeros((4, words), np.uint64)
    last, at = [], 0

    def mark(mask: np.ndarray, state: int) -> None:
        mask[..., state // 64] |= np.uint64(1 << (state % 64))

    for symbols, stars in layout:
        mark(start, at)
        mark(first, at)
        for i, s in enumerate(symbols):
            if s is None:
                mark(accepts[:128], at + i + 1)
                mark(accepts[192:], at + i + 1)
                mark(more, at + i + 1)
            else:
                mark(accepts[s], at + i + 1)
        for i in stars:
            mark(stay, at + i)
        last.append(at + len(symbols))
        at += len(symbols) + 1
    return Automaton(tuple(globs), accepts, stay, start, first, more, np.array(last, np.int64))


def match(column: pa.Array, automaton: Automaton) -> np.ndarray:
    """(rows x globs) bool for a large_string array."""
    data, offsets = textscan.raw(column)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    begin, size = offsets[:-1][order], size[order]
    n, words = len(size), automaton.accepts.shape[1]
    state = np.broadcast_to(automaton.start, (n, words)).copy()
    keep_out = ~automaton.first
    one, top = np.uint64(1), np.uint64(63)
    waiting = np.searchsorted(-size, -np.arange(int(size[0]) if n else 0), "left")  # URLs longer than j
    for j, live in enumerate(waiting.tolist()):
        now = state[:live]
        moved = now << one
        if words > 1:
            moved[:, 1:] |= now[:, :-1] >> top
        byte = data[begin[:live] + j]
        goes_on = ((byte & 0xC0) == 0x80)[:, None]
        state[:live] = (moved & keep_out & automaton.accepts[byte]) | (now & (automaton.stay | np.where(goes_on, automaton.more, np.uint64(0))))
    found = np.zeros((n, len(automaton.globs)), np.bool_)
    found[order] = (state[:, automaton.last // 64] >> (automaton.last % 64).astype(np.uint64)) & one
    return found


def canonical(url: Column) -> Column:
    """Canonical form: lower case without surrounding blanks, fragment, default port, leading www., tracking parameters and closing slash."""
    u = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    u = F.regexp_replace(u, "^(https?://)www\\.", "$1")
    u = F.regexp_replace(u, "^(http://[^/:]+):80(/|$)", "$1$2")
    u = F.regexp_replace(u, "^(https://[^/:]+):443(/|$)", "$1$2")
    u = F.regexp_replace(u, "([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    u = F.regexp_replace(u, "&+", "&")
    u = F.regexp_replace(u, "\\?&", "?")
    return F.regexp_replace(u, "[?&]+$|/+$|/+[?]+$", "")


def closed(url: Column) -> Column:
    """A canonical URL with the slash that a host's root page has, or that a directory's URL may have; one with a query after a path, or an empty one, as it is."""
    host = F.regexp_replace(url, "^([^/?]*://[^/?]+)[?]", "$1/?")
    return F.when(url.contains("?") | (url == ""), host).otherwise(F.concat(url, F.lit("/")))


def canonical_sql(url: str) -> str:
    """canonical() in DuckDB's SQL."""
    u = f"regexp_replace(lower(trim({url})), '#.*$', '')"
    for pattern, by, flag in (("^(https?://)www\\.", "\\1", ""), ("^(http://[^/:]+):80(/|$)", "\\1\\2", ""), ("^(https://[^/:]+):443(/|$)", "\\1\\2", ""), ("([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "\\1", ", 'g'"), ("&+", "&", ", 'g'"), ("\\?&", "?", ", 'g'"), ("[?&]+$|/+$|/+[?]+$", "", "")):
        u = f"regexp_replace({u}, '{pattern}', '{by}'{flag})"
    return u


def glob_regex(glob: str) -> str:
    """The regular expression of a glob."""
    special = set("\\.+()[]{}^$|")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("canonical_url", pa.string()), ("rules", pa.list_(pa.string())), ("allowed", pa.bool_()), ("keep", pa.bool_())])


def judge(pages: DataFrame, deny: Sequence[str] = DENY, allow: Sequence[str] = ALLOW) -> DataFrame:
    """(page_id, url, canonical_url, rules, allowed, keep) for every row.

    rules are the deny globs that the canonical URL matches, with or without its closing slash, in the order given, so
    that */ads/* holds for the URL of the directory too; allowed says whether an allow glob matches in the same way; a page is dropped if rules is not empty and it is not allowed. A null URL has null canonical_url and
    allowed, no rules, and is kept; an empty URL is matched as it is. Repeated rows get a row each; URLs of any length
    are matched whole. Columns other than page_id and url are not looked at.
    """
    automaton = compile_globs([*deny, *allow])
    count = len(deny)
    names = np.array(list(deny), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            column, other = (textscan.strings(got[c], lower=False) for c in ("canonical_url", "closed_url"))
            for a, b in textscan.pieces(column, 8 << 20):
                there = got["url"].slice(a, b - a).is_valid().to_numpy(zero_copy_only=False)
                found = (match(column.slice(a, b - a), automaton) | match(other.slice(a, b - a), automaton)) & there[:, None]
                row, rule = np.nonzero(found[:, :count])
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a)))).astype(np.int32)
                rules = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[rule], pa.string()))
                allowed = found[:, count:].any(1)
                yield batch(RESULT, got["page_id"].slice(a, b - a), got["url"].slice(a, b - a), got["canonical_url"].slice(a, b - a), rules, pa.array(allowed, mask=~there), ~found[:, :count].any(1) | allowed)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", canonical(F.col("url")).alias("canonical_url")).withColumn("closed_url", closed(F.col("canonical_url")))
    return arrow_map(own, run, "page_id long, url string, canonical_url string, rules array<string>, allowed boolean, keep boolean")


def judge_sql(deny: Sequence[str] = DENY, allow: Sequence[str] = ALLOW) -> str:
    """judge() over pages in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"CASE WHEN regexp_matches(c, {quote('(?s)' + glob_regex(g))}) THEN {quote(g)} END" for g in deny)
    allowed = " OR ".join(f"regexp_matches(c, {quote('(?s)' + glob_regex(g))})" for g in allow) or "false"
    return f"""
        WITH u AS (SELECT page_id, url, {canonical_sql('url')} AS c FROM pages),
        j AS (SELECT page_id, url, c, list_filter([{rules}], lambda x: x IS NOT NULL) AS r, ({allowed}) AS a FROM u)
        SELECT page_id, url, c AS canonical_url, CASE WHEN c IS NULL THEN [] ELSE r END AS rules, a AS allowed,
               coalesce(len(r) = 0 OR a, true) AS keep
        FROM j"""
