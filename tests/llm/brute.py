"""Plain Python versions the operators are tested against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def classes(rows, width, percent=80):
    """``{doc_id: component}`` by comparing all pairs of rows; rows of one id are one document."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted(((i, s) for i, s in sets if s), key=lambda x: len(x[1]))
    for at, (i, own) in enumerate(by_size):
        for j, other in by_size[at + 1 :]:
            if 100 * len(own) < percent * len(other):
                break
            common = len(own & other)
            if 100 * common >= percent * (len(own) + len(other) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}
