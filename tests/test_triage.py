"""The outcome of each kind of file, through real folders."""

import os

import pytest
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.operators.reports import report_rows, report_text, result_records
from doctriage.plans import local
from doctriage.sinks.files import copy_files
from doctriage.sources.files import fetch, list_folder, read_folder

GOOD = b"A readable text of some length."


class FixedModel:
    """Scores by a number in the text, to reach exact confidences."""

    def score(self, docs, text="text"):
        number = F.regexp_extract(F.col(text), r"conf=([0-9.]+)", 1).try_cast("double")
        return docs.withColumns(
            {"ml_label": F.lit("Contract"), "ml_confidence": F.coalesce(number, F.lit(99.0)), "probabilities": F.array()}
        )


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for order, (name, content) in enumerate(files):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (1_700_000_000 + order, 1_700_000_000 + order))
    return str(folder)


def triage(spark, folder, files, **settings):
    settings.setdefault("model", FixedModel())
    return local.triage_folder(spark, write(folder, files), local.Settings(**settings))


def by_name(results):
    return {r.file_name: r for r in results.collect()}


def failing(content):
    raise ValueError("corrupt")


@pytest.mark.parametrize("once", [False, True])
def test_outcomes(spark, tmp_path, once):
    files = [
        ("empty.pdf", b""), ("_hidden.txt", b"hidden files are files too"), (".dot", b"no extension here"),
        ("first.txt", GOOD), ("copy.md.txt", GOOD), ("short.txt", b"  123456789 "), ("short2.txt", b"  123456789 "),
        ("ten.txt", b"1234567890"), ("bad.txt", b"\xff\xfe broken bytes"), ("movie.mp4", GOOD + b"!"),
        ("movie.txt", GOOD + b"!"), ("movie2.mp4", GOOD + b"!"), ("deck.pptx", b"slides"), ("sheet.xlsx", b"cells"),
        ("scan.PDF", b"pdf bytes"), ("broken.docx", b"x"), ("low.txt", b"conf=69.96 and some text"),
        ("limit.txt", b"conf=70.0 and some text"),
    ]
    parsers = {
        ".pptx": lambda b: [(0, 0, "str", "  "), (1, 0, "str", "first slide"), (0, 1, "str", "zeroth slide")],
        ".pdf": lambda b: [(0, 0, "str", "page one"), (1, 0, "str", ""), (2, 0, "str", "page three")],
        ".xlsx": lambda b: [(0, 0, "num", "0"), (0, 1, "str", ""), (0, 2, "bool", "False"), (0, 3, "num", "7")],
        ".docx": failing,
    }
    got = by_name(
        triage(
            spark, tmp_path / "in", files, parsers=parsers, parse_contents_once=once,
            responder=lambda qs: ["An INVOICE or resume"] * len(qs),
        )
    )
    outcomes = {name: row.outcome for name, row in got.items()}
    assert outcomes == {
        "empty.pdf": "rejected", "_hidden.txt": "classified", ".dot": "unsupported", "first.txt": "classified",
        "copy.md.txt": "duplicate", "short.txt": "unreadable", "short2.txt": "unreadable", "ten.txt": "classified",
        "bad.txt": "unreadable", "movie.mp4": "unsupported", "movie.txt": "classified", "movie2.mp4": "duplicate",
        "deck.pptx": "non-document", "sheet.xlsx": "unreadable", "scan.PDF": "classified",
        "broken.docx": "unreadable", "low.txt": "classified", "limit.txt": "classified",
    }
    low, limit, deck = got["low.txt"], got["limit.txt"], got["deck.pptx"]
    assert (low.document_type, low.confidence, low.method) == ("Resume", 70.0, fixed.METHOD_FALLBACK)
    assert (limit.document_type, limit.confidence, limit.method) == ("Contract", 70.0, fixed.METHOD_ML)
    assert (deck.status, deck.document_type, deck.confidence, deck.method) == ("success", "Unknown", 0.0, "file type check")
    assert deck.report_status == "non-document file type" and deck.registered
    assert got["empty.pdf"].report_destination == "miscellaneous/unreadable"
    assert got["empty.pdf"].destination == "documents/miscellaneous/unreadable"
    assert not got["copy.md.txt"].registered and got["first.txt"].destination == "documents/legal/contracts"


def test_costly_parsers_see_each_content_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def parse(content):
        import uuid

        (calls / uuid.uuid4().hex).write_text("")
        return [(0, 0, "str", content.decode())]

    files = [(f"f{i}.pdf", GOOD) for i in range(6)] + [("other.pdf", b"another readable page"), ("e.pdf", b"")]
    results = triage(spark, tmp_path / "in", files, parsers={".pdf": parse}, parse_contents_once=True)
    outcomes = sorted(r.outcome for r in results.collect())
    assert outcomes == ["classified"] * 2 + ["duplicate"] * 5 + ["rejected"]
    assert len(list(calls.iterdir())) == 2


def test_without_model_nothing_moves(spark, tmp_path):
    got = by_name(triage(spark, tmp_path / "in", [("a.txt", GOOD), ("b.txt", GOOD)], model=None))
    for row in got.values():
        assert (row.status, row.destination, row.final_name, row.registered) == ("error", None, None, False)


def test_without_responder_uncertain_is_unknown(spark, tmp_path):
    row = by_name(triage(spark, tmp_path / "in", [("a.txt", b"conf=10 some text")]))["a.txt"]
    assert (row.document_type, row.confidence, row.destination) == ("Unknown", 10.0, "documents/unknown")


def test_one_failing_answer_spares_the_others(spark, tmp_path):
    def respond(questions):
        if any("poison" in q for q in questions):
            raise RuntimeError("no answer")
        return ["paystub" for _ in questions]

    files = [("a.txt", b"conf=10 poison text"), ("b.txt", b"conf=10 other text")]
    got = by_name(triage(spark, tmp_path / "in", files, responder=respond))
    assert (got["a.txt"].document_type, got["b.txt"].document_type) == ("Unknown", "Paystub")


def test_empty_folder(spark, tmp_path):
    assert triage(spark, tmp_path / "in", []).count() == 0


def test_listing_sees_every_file(spark, tmp_path):
    folder = write(tmp_path / "in", [("a.txt", b"x"), ("empty", b""), (".h", b"yy"), ("_u", b"")])
    (tmp_path / "in" / "sub").mkdir()
    assert {os.path.basename(r.path): r.length for r in list_folder(spark, folder).collect()} == {
        "a.txt": 1, "empty": 0, ".h": 2, "_u": 0,
    }
    assert {os.path.basename(r.path): bytes(r.content) for r in read_folder(spark, folder).collect()} == {
        "a.txt": b"x", "empty": b"", ".h": b"yy", "_u": b"",
    }


def test_fetch_by_path_in_chunks(spark, tmp_path):
    folder = write(tmp_path / "in", [(f"{i}.bin", bytes([i]) * 10) for i in range(5)])
    listed = list_folder(spark, folder).cache()
    assert listed.count() == 5
    (tmp_path / "in" / "3.bin").unlink()
    got = {os.path.basename(r.path): (r.length, r.content) for r in fetch(listed, chunk_bytes=15).collect()}
    assert got["3.bin"] == (None, None)
    assert {n: bytes(c) for n, (_, c) in got.items() if c} == {f"{i}.bin": bytes([i]) * 10 for i in (0, 1, 2, 4)}


def test_copy_verify_and_report(spark, tmp_path):
    files = [("a.txt", GOOD), ("b.txt", b"another readable text")]
    results = triage(spark, tmp_path / "in", files).cache()
    manifest = copy_files(results, str(tmp_path / "out"))
    assert manifest.filter("copied").count() == 2
    assert (tmp_path / "out/documents/legal/contracts/a.txt").read_bytes() == GOOD
    held = manifest.filter("final_name = 'a.txt'")
    checked = by_name(local.verified(results, held))
    assert (checked["a.txt"].status, checked["b.txt"].status) == ("success", "failed")
    records = by_name(result_records(results))
    assert records["a.txt"].destination == "documents/legal/contracts/a.txt"
    moment = F.lit("2024-01-02 03:04:05").cast("timestamp")
    report = report_rows(results.filter("file_name = 'a.txt'"), F.lit(1.5), moment)
    lines = report.select(report_text(report).alias("t")).first().t.split("\n")
    assert lines[2] == "PROCESSING REPORT - 2024-01-02 03:04:05"
    assert lines[4:13] == [
        "file name     : a.txt", "file size     : 0.03 KB", "file type     : .txt", "duplicate     : No",
        "readable      : Yes", "document type : Contract", "destination   : documents/legal/contracts",
        "time taken    : 1.5 seconds", "status        : success",
    ]


@pytest.mark.parametrize("size,status", [(0, "rejected"), (1, "ok"), (52_428_800, "ok"), (52_428_801, "warning"), (None, "rejected")])
def test_size_limits(spark, size, status):
    from doctriage.operators.validation import check_file

    df = spark.createDataFrame([(size,)], "length long")
    assert df.select(check_file(F.col("length"))["status"]).first()[0] == status
