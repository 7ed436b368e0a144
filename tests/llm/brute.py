"""Plain-loop versions that the operators are tested against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def near_components(docs: list[tuple[int, str | None]], width: int = 4) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component)."""
    sets = []
    for _, text in docs:
        w = words(text, lower=True)
        runs = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        sets.append(runs)
    having, up = defaultdict(list), list(range(len(docs)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for run in s for j in having[run])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[root(j)] = root(k)
        for run in s:
            having[run].append(k)
    least: dict[int, int] = {}
    for k, (doc, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), doc), doc)
    return {doc: (len(sets[k]), least[root(k)]) for k, (doc, _) in enumerate(docs)}


def without_repeats(docs: list[tuple[int, str | None]], window: int = 35) -> dict[int, tuple[int, int, str]]:
    """doc_id to (words, removed words, sha256 of the rest)."""
    split = [(doc, words(text)) for doc, text in docs]
    starts = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = {}
    for doc, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        rest = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[str]:
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PII.items()
        for m in re.finditer(pattern, text or "")
        if _valid(kind, m.group())
    ]


def base_scores(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    """doc_id to (held out, tokens, known tokens, training tokens, base score)."""
    tokens = {doc: [*words(text, lower=True), "\n"] for doc, text in docs}
    held = {doc: zlib.crc32(str(doc).encode()) % 10 == 0 for doc in tokens}
    counts = Counter(t for doc, own in tokens.items() if not held[doc] for t in own)
    n, v = sum(counts.values()), len(counts)
    return {
        doc: (
            held[doc],
            len(own),
            sum(counts[t] > 0 for t in own),
            n,
            sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own),
        )
        for doc, own in tokens.items()
    }
