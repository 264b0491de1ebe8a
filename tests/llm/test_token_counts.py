import random

import pytest

from doctriage.llm import token_counts as tc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def greedy(pieces, text):
    """Pieces by trying every length at every place; None if the text cannot be cut."""
    longest, out, at = max(map(len, pieces)), [], 0
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if text[at : at + n] in pieces:
                out.append(text[at : at + n])
                at += n
                break
        else:
            return None
    return out


@pytest.mark.parametrize("seed", range(6))
def test_counts_like_longest_match(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    pieces = {"".join(rng.choices(letters, k=rng.randrange(1, 6))).encode() for _ in range(25)}
    pieces |= {b" " + p for p in rng.sample(sorted(pieces), 8)} | ({b" "} if seed < 4 else set())
    counts = tc.PieceCounts(tc.Automaton.build(sorted(pieces)))
    for _ in range(2000):
        word = "".join(rng.choices(letters + ("z" if seed == 5 else ""), k=rng.randrange(1, 14)))
        cut = greedy(pieces, b" " + word.encode())
        assert counts[word] == (-1 if cut is None else len(cut)), (word, cut)


def test_given_documents_and_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    pieces = tc.ranked_pieces(VOCABULARY)
    known = set(pieces)
    found = {r.doc_id: r for r in tc.count_tokens(docs, pieces).collect()}
    for row in docs.collect():
        words = row.text.split()
        cut = [greedy(known, b" " + w.encode()) for w in words]
        assert found[row.doc_id].n_tokens == sum(map(len, cut))
        assert (found[row.doc_id].n_words, found[row.doc_id].n_unknown) == (len(words), 0)


def test_edge_rows(spark):
    pieces = [b" ", b"a", b"ab", b" abc", b"", b"\xc3\xa9"]
    rows = [(1, "abc aab x é"), (2, None), (3, " \n "), (None, "a"), (4, "a" * 500_000), (1, "abc aab x é")]
    table = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_tokens int, counts int"
    )
    found = [tuple(r) for r in tc.count_tokens(table, pieces).collect()]
    one = (1, 4, 1 + 3 + 1 + 2, 1)
    assert found == [one, (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 2, 0), (4, 1, 500_001, 0), one]
    assert tc.count_tokens(table.limit(0), pieces).count() == 0
    assert tc.count_tokens(table, []).collect()[0].n_unknown == 4


def test_listed_pieces(tmp_path):
    path = tmp_path / "vocabulary.txt"
    path.write_text("un\n##aff\n##able\nable\n")
    counts = tc.PieceCounts(tc.Automaton.build(tc.listed_pieces(str(path))))
    assert [counts[w] for w in ("unaffable", "able", "unable", "aff")] == [3, 1, 2, -1]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "MEMO_WORDS", 3)
    counts = tc.PieceCounts(tc.Automaton.build([b" ", b"a"]))
    for n in range(1, 9):
        assert counts["a" * n] == n + 1 and len(counts) <= 3
    assert counts["a" * 65] == 66 and "a" * 65 not in counts
