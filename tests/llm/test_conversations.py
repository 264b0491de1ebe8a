import hashlib
import itertools
import random
import re
import zlib

import pytest

from doctriage.llm import audits, conversations
from doctriage.llm.text_queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, seq string, slice int"
GOOD = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(turns):
    """``(first fault, role)`` of each ``(role, text)``."""
    out, seen = [], set()
    for role, text in turns:
        solid = BLANK.findall(text)
        if not solid:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns):
    """All edits by growing cost: ``(cost, audit, lines)`` of the least audit."""
    faults = faults_of(turns)
    initials = lambda lines: "".join(r[:1] for r, _ in lines)
    begins = lambda path: re.match(r"(s?(ua)*u?)?\Z", initials(path[2]))
    paths = [(0, "", ())]
    for at in range(len(turns) + 1):
        fresh = paths
        for _ in range(3):
            fresh = [(c + 2, a + "I", (*lines, (r, ""))) for c, a, lines in fresh for r in ("user", "assistant")]
            fresh = list(filter(begins, fresh))
            paths = paths + fresh
        if at == len(turns):
            break
        role, text = turns[at]
        grown = []
        for cost, audit, lines in paths:
            grown.append((cost + 3, audit + "D", lines))
            if faults[at] in ("blank", "duplicate"):
                continue
            more = faults[at] == "truncated"
            if role[:1]:
                grown.append((cost + more, audit + "K", (*lines, (role, text))))
            grown += [(cost + 2 + more, audit + "R", (*lines, (r, text))) for r in ("user", "assistant")]
        groups = {}
        for path in filter(begins, grown):  # dearer ones with the same last role cannot win
            groups.setdefault(initials(path[2])[-1:], []).append(path)
        paths = [p for group in groups.values() for p in group if p[0] == min(q[0] for q in group)]
    return min((p for p in paths if GOOD.match(initials(p[2]))), key=lambda p: p[:2])


def expected(rows, damage=False):
    """Rows of the result for ``(conv_id, turn, role, text)``."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = [x[1:] for x in own]
        numbers = [x[0] for x in own if x[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = faults_of(turns)
        initials = [r[:1] for r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(turns)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def conversation(numbers, name, size):
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    texts = ["Yes.", "No!", "open", " \t", "", None, "Why?  \n", "a\x0b", "Long text. " * 3]
    return [
        (name, numbers.choice([None, *range(size)]), numbers.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], numbers.choice(texts) if numbers.random() < 0.5 else f"text {numbers.random()}.")
        for _ in range(size)
    ]


def found(spark, rows):
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in conversations.repair(table).collect()), key=str)


def test_audit_strings_compare_like_strings():
    numbers = random.Random(4)
    for collide in (False, True):
        edits = audits.Edits(lambda before, letter: 1) if collide else audits.Edits()
        nodes = [0]
        for _ in range(400):
            nodes.append(edits.add(numbers.choice(nodes[-6:]), numbers.choice("DIK")))
        for _ in range(2000):
            a, b = numbers.choice(nodes), numbers.choice(nodes)
            assert edits.less(a, b) == (edits.text(a) < edits.text(b)), (edits.text(a), edits.text(b))


@pytest.mark.parametrize("width", [1, 2, 5, 100])
def test_slices_join_to_the_edits_of_the_whole(width):
    numbers = random.Random(width)
    for _ in range(60):
        codes = "".join(audits.code(numbers.randrange(4), numbers.choice([0, 0, 1, 2, 3])) for _ in range(numbers.randrange(1, 14)))
        parts = [codes[i : i + width] for i in range(0, len(codes), width)]
        whole = audits.joined([audits.transfer(codes)])
        split = audits.joined([audits.transfer(part) for part in parts])
        assert split[:2] == whole[:2]
        assert "".join(a for _, a in split[2]) == whole[1]


def test_like_trying_all_edits(spark):
    numbers = random.Random(6)
    rows = [row for name in range(70) for row in conversation(numbers, name, numbers.randrange(1, 7))]
    rows += conversation(numbers, None, 5)
    assert found(spark, rows) == expected(rows)


def test_long_conversations_span_slices(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SLICE_BITS", 2)
    numbers = random.Random(7)
    rows = [row for name in range(4) for row in conversation(numbers, name, 30)] + conversation(numbers, 9, 2)
    assert found(spark, rows) == expected(rows)
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    turns = conversations.ordered(table)
    plan = conversations.planned(conversations.judged(turns))
    texts = {}
    for row in conversations.repaired(turns, plan).orderBy("conv_id", "slice", "at").collect():
        texts.setdefault(row.conv_id, []).append(f"{row.role}:{row.text}")
    sums = {name: hashlib.sha256("\n".join(lines).encode()).hexdigest() for name, lines in texts.items()}
    assert sums == {r[0]: r[-1] for r in expected(rows) if r[-1] != hashlib.sha256(b"").hexdigest()}


def test_empty_and_repeated_rows(spark):
    assert found(spark, []) == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes.")] * 2
    assert found(spark, rows) == expected(rows)
    far = [(1, -(1 << 63), "user", "Hi."), (1, (1 << 63) - 1, "assistant", "Yes.")]
    assert found(spark, far)[0][:3] == (1, (1 << 63) - 1, 0)


def test_query_on_the_whole_table(spark, tmp_path):
    source = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(source).collect()]
    rows += [(1000 + i, t, r, x) for i in range(40) for t, r, x in [(0, "user", "A."), (1, "assistant", "B?"), (None, None, None)]]
    rows += [(None, None, "user", "C."), (None, 3, "user", None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = sorted((tuple(r) for r in op11_conversation_repair(spark, folder).collect()), key=str)
    assert got == expected(rows, damage=True)
    assert len({r[0] for r in got}) == len({r[0] for r in rows})
