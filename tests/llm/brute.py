"""Plain versions of the corpus operators, for small tables."""

import re

import pyarrow as pa

from quernstone.llm import decontaminate, simhash, suffixdedup, textscan

#: Blanks and punctuation beyond ASCII, kana and ideographs.
APART = "\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20"
LONE = "\u3040-\u9fff"
WORD = re.compile(f"[{LONE}]|[^\\x00-/:-`{{-\x7f{APART}{LONE}]+")


def words(text):
    return WORD.findall((text or "").lower())


BLANKS = " \t\n\v\f\r\u0085\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACED = re.compile(f"[{LONE}]|[^{BLANKS}{LONE}]+")


def spaced_words(text):
    """What stands between white space, without case and punctuation."""
    return ["".join(words(x)) for x in SPACED.findall(text)]


def spans_of_repeats(docs, length=suffixdedup.LENGTH):
    """doc_id -> word numbers covered by windows whose first occurrence is in a lesser doc_id."""
    seen, out = {}, {}
    for doc, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        w = spaced_words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if seen.setdefault(key, doc) != doc:
                out.setdefault(doc, set()).update(range(i, i + length))
    return out


def signatures(texts):
    column = textscan.strings(pa.array(texts, pa.large_string()))
    return simhash.signatures(textscan.scan(column))


def near_groups(docs, radius=simhash.RADIUS):
    """(doc_id, kept) of all pairs within radius, chained."""
    rows = sorted({(d, t) for d, t in docs if d is not None and words(t)})
    s = signatures([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in (simhash.distance(s[i + 1 :], s[i]) <= radius).nonzero()[0]:
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    kept = {}
    for i, (d, _) in enumerate(rows):
        kept.setdefault(find(i), []).append(d)
    return {(d, min(g)) for g in kept.values() for d in g if d != min(g)}


def leaks(docs, items, gram=decontaminate.GRAM):
    """(doc_id, item_id, start, stop) of longest common runs that hold a gram of the item."""
    out = set()
    for d, text in docs:
        w = words(text)
        for m, item in items:
            v = words(item)
            g = min(gram, len(v))
            for i in range(len(w)):
                for j in range(len(v)):
                    if w[i] == v[j] and (i == 0 or j == 0 or w[i - 1] != v[j - 1]):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if g and n >= g and (g >= decontaminate.SHORTEST or n == len(w)):
                            out.add((d, m, i, i + n))
    return out


def without_words(text, gone, kind=re.compile(f"[{LONE}]|[^\\x00-/:-@\\[-`{{-\x7f{APART}{LONE}]+")):
    """Text without the words of these numbers and what lies between neighbouring ones."""
    at, out, spans = 0, [], list(kind.finditer(text))
    for i, m in enumerate(spans):
        if i in gone:
            if i - 1 not in gone:
                out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    return "".join(out)
