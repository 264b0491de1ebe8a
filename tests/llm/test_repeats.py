import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from doctriage.llm import repeats
from doctriage.llm.phrases import Parsing, dictionary_order, repeated_starts, stretches
from doctriage.llm.repeats import remove_repeats

SMALL = Parsing(length=20, trigger=4, modulus=4, reach=10)


def texts_like(seed, count=60, alphabet=b"abcdefgh "):
    """Random texts that share passages, copies, periods and runs."""
    numbers = random.Random(seed)
    make = lambda n: bytes(numbers.choice(alphabet) for _ in range(n))
    passages = [make(numbers.randrange(15, 60)) for _ in range(6)] + [b"z" * 45, b"xyz" * 12]
    out = [b"", b"short", make(19), make(20)]
    for _ in range(count):
        parts = [make(numbers.randrange(0, 40))]
        for _ in range(numbers.randrange(3)):
            parts += [numbers.choice(passages), make(numbers.randrange(0, 30))]
        out.append(b"".join(parts))
    return out + out[10:14] + [out[12][:-1] + b"!"]


def brute(texts, length):
    counts = {}
    for text in texts:
        for at in range(len(text) - length + 1):
            counts[text[at : at + length]] = counts.get(text[at : at + length], 0) + 1
    out = []
    for text in texts:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if counts[text[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        edges = [i for i in range(len(text) + 1) if (gone[i] if i < len(text) else 0) != (gone[i - 1] if i else 0)]
        spans = list(zip(edges[::2], edges[1::2]))
        out.append((len(text), sum(gone), len(spans), spans, bytes(c for c, g in zip(text, gone) if not g)))
    return out


def found(spark, texts, parsing=SMALL, **settings):
    table = spark.createDataFrame(
        [(i, None if t is None else t.decode(), "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, at int"
    )
    rows = remove_repeats(table, parsing, **settings).collect()
    return [
        (r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], bytes(r.kept))
        for r in sorted(rows, key=lambda r: r.doc_id)
    ]


def test_dictionary_order_is_the_order_of_the_rests():
    phrases = [b"ab", b"abcabcabcabcd", b"b\0", b"b", b"\0\0", b"cabcabcd", b"zzzzzzzzzzzzzzzzzzzz"]
    offsets, ranks = dictionary_order(phrases)
    rests = [p[i:] for p in phrases for i in range(len(p))]
    assert offsets.tolist() == np.cumsum([0] + [len(p) for p in phrases])[:-1].tolist()
    numbers = {rest: at for at, rest in enumerate(sorted(set(rests)), 1)}
    assert ranks.tolist() == [numbers[rest] for rest in rests]


@pytest.mark.parametrize("seed", range(4))
def test_corpus_order_finds_equal_strings(seed):
    texts = [t for t in texts_like(seed) if len(t) >= 20]
    counts = np.array([len(t) - 19 for t in texts])
    strings = [t[i : i + 20] for t in texts for i in range(len(t) - 19)]
    expected = [strings.count(s) > 1 for s in strings]
    assert repeated_starts(texts, counts, SMALL).tolist() == expected


def test_equal_strings_share_their_inner_hash():
    texts = texts_like(9)
    ends = np.cumsum([len(t) for t in texts])
    first, count, inner = stretches(np.frombuffer(b"".join(texts), np.uint8), ends, SMALL)
    joined, under = b"".join(texts), {}
    starts = [(s, k) for f, c, k in zip(first.tolist(), count.tolist(), inner.tolist()) for s in range(f, f + c)]
    assert len(starts) == sum(max(0, len(t) - 19) for t in texts)
    for start, key in starts:
        assert under.setdefault(joined[start : start + 20], key) == key


@pytest.mark.parametrize("settings", [{}, {"group": 1}, {"piece": 37}])
def test_like_counting_all_strings(spark, settings):
    texts = texts_like(5) + ["größe ".encode() * 9]
    expected = brute(texts, 20)
    assert sum(r[1] for r in expected) > 500
    assert found(spark, texts, **settings) == expected


def test_production_length(spark):
    numbers = random.Random(2)
    words = [bytes(numbers.choice(b"abcdefghij") for _ in range(numbers.randrange(2, 9))) for _ in range(500)]
    make = lambda n: b" ".join(numbers.choices(words, k=n))
    passage, edge = make(60), make(80)
    texts = [make(90) + b" " + passage + b" " + make(70) for _ in range(8)]
    texts += [make(50) + edge[:199], edge[:199] + make(50), edge[:200] + make(9), make(9) + edge[:200], b"a" * 5000, b"=" * 201]
    texts += [texts[0], make(30)]
    assert found(spark, texts, Parsing()) == brute(texts, 200)


def test_null_empty_and_repeated_rows(spark):
    assert found(spark, []) == []
    text = "0123456789abcdefghijklmnop"
    table = spark.createDataFrame([(None, text), (7, text), (7, text), (8, None), (9, "")], "doc_id long, text string")
    rows = remove_repeats(table, SMALL).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows), key=str)
    assert got == sorted([(None, 26, 26, b""), (7, 26, 26, b""), (7, 26, 26, b""), (8, 0, 0, b""), (9, 0, 0, b"")], key=str)


def test_crowded_contexts_make_few_rows(spark, monkeypatch):
    """A context of a crowded group costs the pieces in which it departs from others, not each string."""
    numbers = random.Random(4)
    make = lambda n: bytes(numbers.choice(b"abcdefghij ") for _ in range(n))
    passage, made, staged = make(500), {}, repeats.stage

    def counting(df, name):
        out = staged(df, name)
        if name in ("pieces", "context-bytes"):
            rows = out.filter("many") if "many" in out.columns else out
            made.setdefault(name, []).append(rows.agg(F.count("*"), F.sum("starts")).first())
        return out

    monkeypatch.setattr(repeats, "stage", counting)
    texts = [make(150) + passage + make(150) for _ in range(40)]
    assert found(spark, texts, Parsing(), group=5) == brute(texts, 200)
    (contexts, strings), pieces = made["context-bytes"][0], [rows for rows, _ in made["pieces"]]
    assert contexts >= 40 and strings > 20 * contexts
    assert len(pieces) == 2 and max(pieces) < strings / 2
