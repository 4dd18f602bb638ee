"""Documents with everything that may be odd, and plain versions of the operators to hold results against."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, key bigint, row string, h string, hits array<int>, n_words string, kept string, score string"
#: The columns after text clash with names that operators use or add.
REST = ("en", 7, "row", "h", [1], "many", "yes", "0.5")
WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(900)}" for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, ...) rows."""
    long = prose(1, 30_000)
    passage = prose(2, 60)
    base = prose(3, 200)
    near = base.split()
    near[100] = "changed"
    lines = "\n".join(prose(10 + i, 8) for i in range(6))
    texts = [
        (0, base), (1, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n\x0b "), (6, long), (7, "one"), (7, "another one"),
        (8, prose(4, 50) + " " + passage + " " + prose(5, 40)), (9, prose(6, 30) + "\n" + passage.upper() + "\n" + passage), (None, "two words"), (None, None), (None, base),
        (10, lines), (11, prose(20, 8) + "\n" + lines + "\n\n" + prose(21, 8)), (12, "x\n" * 50), (13, "tail  \r\nmixed\x85  spaces here   end"), (14, "a" * 5000), (15, "퟿\U0001f600 emoji \U0001f600" * 40),
        (16, lines), (17, "<|endoftext|> in a text"), (18, "-1 " * 70),
    ]
    return [(i, t, *REST) for i, t in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeated_windows(texts: list[str | None], width: int) -> list[tuple[int, int, str]]:
    """(words, removed, kept text) of each text."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = (text or "").encode().translate(low).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def groups(texts: list[str | None], size: int, percent: int) -> list[int]:
    """For each text the number of the first one of its group."""
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(texts))]


def deduped_lines(docs: list[tuple[int, str]], width: int) -> dict[int, tuple[int, int, str]]:
    """(lines, removed, kept text) by id, for documents with distinct ids."""
    lines = {i: t.split("\n") for i, t in sorted(docs)}
    own = {i: [k for k, x in enumerate(v) if x.encode().split()] for i, v in lines.items()}
    seen, out = set(), {}
    for i, v in own.items():
        gone = set()
        for j in range(len(v) - width + 1):
            w = tuple(lines[i][k] for k in v[j : j + width])
            if w in seen:
                gone |= set(v[j : j + width])
            seen.add(w)
        out[i] = (len(v), len(gone), "\n".join(x for k, x in enumerate(lines[i]) if k not in gone))
    return out


def figures(text: str | None) -> dict[str, int]:
    text = text or ""
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [False] * len(w)
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {
        "n_words": len(w),
        "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": sum(mark),
    }
