import hashlib
import random
import re

import pytest

from doctriage.llm import personal_data

SCHEMA = "doc_id long, text string, lang string, n_chars long, spans string, found int, n_email int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
NAMES = list(PATTERNS)


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        bare = match.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "ssn":
        return not re.match("000|666|9", match) and not re.search("-00-|-0000$", match)
    return True


def brute(text):
    """Confirmed spans with their scores."""
    out = []
    for at, (name, pattern) in enumerate(PATTERNS.items()):
        kind = personal_data.KINDS[at]
        found = list(re.finditer(pattern, text, re.ASCII))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()][-40:]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None][:20]
            context = f"{before} {after}".lower()
            score = kind.score + 20 * bool(re.search(kind.near, context)) - 20 * bool(re.search(kind.far, context))
            score = min(100, max(0, score))
            if valid(name, m[0]) and (kind.base or score >= 50):
                out.append((m.start(), m.end(), at, score))
    return sorted(out, key=lambda s: (s[0], s[2]))


def redacted(text):
    out, covered = "", 0
    for start, end, at, _ in brute(text):
        if start >= covered:
            out += text[covered:start] + f"[{NAMES[at].upper()}]"
        covered = max(covered, end)
    return out + text[covered:]


def line(spans, last=None):
    return ",".join(":".join([NAMES[s[2]], str(s[0]), str(s[1]), *([str(s[3])] if last else [])]) for s in spans)


def check(spark, texts):
    table = spark.createDataFrame([(i, t, "x", 1, "s", 2, 3) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r for r in personal_data.find(table).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        spans = brute(text or "")
        row = found[i]
        assert row.spans == line(spans), repr(text)
        assert row.scored_spans == line(spans, True), repr(text)
        base = line([s for s in spans if s[2] < 4])
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [row[f"n_{n}"] for n in NAMES] == [sum(s[2] == k for s in spans) for k in range(6)]
    clean = personal_data.redact(table)
    assert clean.columns == table.columns
    for row in clean.collect():
        text = texts[row.doc_id]
        assert row.text == (None if text is None else redacted(text)), repr(text)
        assert row.n_chars == (1 if text is None else len(row.text))


KNOWN = [
    "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "123.4.5.255", "1.2.3.4.5.6.7.8",
    "256.1.1.1", "007.0000000000000000000001.2.3", "+1 (743) 555-3824", "+49.30.1234567 ", "a.b@c-d.org",
    "a@b@c.d", "x@y.z+w@v.u", "@a.b", "a@b", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000",
    "ssn 123-45-6789", "123-45-6789", "order 123-45-6789 ssn", "+1.2.3.4 5678901", "1111 1111@x.com",
    "my card 4111111111111111 order", "version 1.2.3.4", "ip 1.2.3.4", "é", "😀", "\n", " ", "-", "+", "7",
]


@pytest.mark.parametrize("seed", range(3))
def test_random_mixtures(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", *KNOWN]
    for _ in range(250):
        texts.append("".join(rng.choice(KNOWN) + rng.choice(["", " ", "  ", ", "]) for _ in range(rng.randrange(1, 9))))
    for alphabet in ("0123.", "0-1 +()", "a@.+b%", "AB12 34", "1@.+- "):
        texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(120)]
    check(spark, texts)


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows])


def test_long_texts(spark):
    """Texts on which patterns that start anywhere would take quadratic time."""
    check(spark, [" and ".join(f"u{i}@x{i}.org 10.0.{i % 256}.7" for i in range(2000))])
    texts = ["a" * 300_000, "1" * 300_000, "a.b" + ".c" * 100_000 + "@", "x@" + "y." * 100_000, "+1" * 100_000]
    table = spark.createDataFrame([(i, t, "x", 1, "s", 2, 3) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.spans for r in personal_data.find(table).collect()}
    assert found == {0: "", 1: "", 2: "", 3: "email:0:200001", 4: ""}


def test_null_ids_and_empty_tables(spark):
    table = spark.createDataFrame([(None, "a@b.c", "x", 1, "s", 2, 3)] * 2, SCHEMA)
    assert [(r.doc_id, r.n_email) for r in personal_data.find(table).collect()] == [(None, 1)] * 2
    assert personal_data.find(table.limit(0)).count() == 0 == personal_data.redact(table.limit(0)).count()


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a@b.c", "x", 1, "s", 2, 3)], SCHEMA)
    for df in (personal_data.find(table), personal_data.redact(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_spans_that_start_together(spark):
    texts = {
        "card 4111111111111111@pay.example": "email:5:33,card:5:21",
        "10.0.0.1@host.net": "email:0:17,ip:0:8",
        "+491701234567@sms.example": "email:0:25,phone:0:13",
    }
    check(spark, list(texts))
    table = spark.createDataFrame([(i, t, "x", 1, "s", 2, 3) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.spans for r in personal_data.find(table).collect()}
    for i, spans in enumerate(texts.values()):
        # Further kinds may start elsewhere.
        assert [s for s in found[i].split(",") if s in spans.split(",")] == spans.split(",")
