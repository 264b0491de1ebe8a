import random

import numpy as np
import pytest

from doctriage.llm import templates
from doctriage.llm.templates import DROPPED, LITERAL, NAME, Rules, is_capitalised, token

DOCS = "doc_id long, text string, lang string, item_id string, print string, covered int, window int"
ITEMS = "item_id long, text string, doc_id string, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "d", 3) for i, t in rows], ITEMS)


def tokens(text, starts=True):
    out = []
    for word in (text or "").split():
        kind, value = token(word)
        if kind == LITERAL and is_capitalised(word) and not starts:
            kind = NAME
        if kind != DROPPED:
            out.append((kind, value))
        starts = word.rstrip("\"')]}»”’").endswith((".", "!", "?"))
    return out


def held_by(bench, rules):
    """Of each window, the texts that have it: by template and by words."""
    found = {}
    for _, text in bench:
        for starts in (True, False):
            own = tokens(text, starts)
            width = min(rules.width, len(own))
            for a in range(len(own) - width + 1) if own else ():
                for window in windows_at(own, a, width, rules, len(own)):
                    found.setdefault(window, set()).add(tuple(v.casefold() for _, v in own))
    return found


def windows_at(own, a, width, rules, size):
    part = own[a : a + width]
    out = [("words", *(v.casefold() for _, v in part))]
    if sum(k == LITERAL for k, _ in part) >= rules.literal(width) and size >= rules.shortest:
        out.append(("shape", *(v if k == LITERAL else k for k, v in part)))
    return out


def best_part(places, pairs_of):
    """The most tokens that a run of windows with values in correspondence covers."""
    best = 0
    for a in range(len(places)):
        for b in range(a + 1, len(places) + 1):
            pairs = {p for w in places[a:b] for p in pairs_of(w)}
            if len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs}):
                best = max(best, len({t for at, width, _ in places[a:b] for t in range(at, at + width)}))
    return best


def brute_whole(rows, bench, rules=Rules()):
    """``{(doc, item): covered}``, comparing every window of every document and item."""
    texts_of, found = held_by(bench, rules), {}
    for item, text in bench:
        both = [tokens(text, starts) for starts in (True, False)]
        size = len(both[0])
        if not size:
            continue
        width, least = min(rules.width, size), min(rules.covered, size)
        places = {
            (a, window): own for own in both for a in range(size - width + 1) for window in windows_at(own, a, width, rules, size)
        }
        mine = {k: own for k, own in places.items() if len(texts_of[k[1]]) <= rules.common}
        if len({t for a, _ in mine for t in range(a, a + width)}) < least:
            mine, least = places, size
        for doc, body in rows:
            other = tokens(body)
            for shift in range(-size + 1, len(other)):
                matched = []
                for (a, window), own in mine.items():
                    if a + shift < 0 or a + shift + width > len(other):
                        continue
                    if window in windows_at(other, a + shift, width, rules, size):
                        pairs = [] if window[0] == "words" else list(zip(own[a : a + width], other[a + shift : a + shift + width]))
                        pairs = tuple((x[1].casefold(), y[1].casefold()) for x, y in pairs if x[0] != LITERAL)
                        if window[0] == "words":
                            pairs = tuple((v.casefold(), v.casefold()) for k, v in own[a : a + width] if k != LITERAL)
                        matched.append((a, width, pairs))
                covered = best_part(sorted(set(matched)), lambda w: w[2])
                if covered >= least:
                    found[doc, item] = max(covered, found.get((doc, item), 0))
    return found


OLD = Rules(verbatim=False, stretches=False, common=1 << 30)


def brute(rows, bench, rules=OLD):
    """Compare every window of every document with every window of every item."""
    found = {}
    for item, text in bench:
        for starts in (True, False):
            own = tokens(text, starts)
            width = min(rules.width, len(own))
            if not own:
                continue
            shape = [k if k != LITERAL else v for k, v in own]
            for doc, body in rows:
                other = tokens(body)
                form = [k if k != LITERAL else v for k, v in other]
                for shift in range(-len(own) + 1, len(other)):
                    covered, pairs = set(), set()
                    for a in range(len(own) - width + 1):
                        part = shape[a : a + width]
                        literal = sum(isinstance(x, str) for x in part)
                        if a + shift < 0 or form[a + shift : a + shift + width] != part:
                            continue
                        if literal < rules.literal(width):
                            continue
                        covered |= set(range(a, a + width))
                        pairs |= {
                            (own[a + i][1], other[a + shift + i][1])
                            for i in range(width)
                            if own[a + i][0] != LITERAL
                        }
                    alike = len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs})
                    if covered and len(covered) >= min(rules.covered, len(own)) and alike:
                        found.setdefault((doc, item), set()).add(len(covered))
    return {key: max(sizes) for key, sizes in found.items()}


QUESTION = (
    "A train leaves Boston at 9 with 40 passengers and after 3 hours it has gone 180 miles so how "
    "many hours does it need for 360 miles at the same speed"
)
BENCH = [
    (1, QUESTION),
    (2, "short one here now"),
    (3, "two words"),
    (4, ""),
    (5, None),
    (6, "The very same words start two of these items and then they go on in a different way altogether"),
    (7, "The very same words start two of these items and then they end"),
]


@pytest.mark.parametrize("rules, compare", [(OLD, None), (Rules(), None), (Rules(common=1), None)])
def test_like_comparing_all_windows(spark, rules, compare):
    compare = brute if rules is OLD else brute_whole
    rng = random.Random(5)
    words = ["of", "the", "blue", "river", "Anna", "12", "kg", "stone.", "ran", "—"]
    filler = lambda n: " ".join(rng.choices(words, k=n))
    bench = BENCH + [(20 + i, filler(rng.randrange(4, 30))) for i in range(12)]
    rows = []
    for i in range(60):
        item = rng.choice(bench)[1] or ""
        part = item.split()[rng.randrange(0, 3) :]
        if i % 4 == 0 and part:
            part[rng.randrange(len(part))] = "edited"
        rows.append((i, f"{filler(rng.randrange(0, 9))} {' '.join(part)} {filler(5)}"))
    found = templates.leaks(docs(spark, rows).repartition(3), items(spark, bench), rules).collect()
    assert {(r.doc_id, r.item_id): r.covered for r in found} == compare(rows, bench, rules)
    assert len(found) > 30


@pytest.mark.parametrize(
    "text, held",
    [
        (QUESTION, 0),
        (QUESTION.lower().replace("boston", "Boston") + " and more", 0),
        (QUESTION.replace("Boston", "Denver").replace("40", "55").replace("180", "240"), 3),
        (QUESTION.replace("180", "360"), None),  # two different values became one
        (QUESTION.replace("9", "180").replace("40 ", "7 "), None),
        ("Nothing of the kind is asked in this text about trains and hours and miles and speed", None),
    ],
)
def test_slots(spark, text, held):
    found = templates.leaks(docs(spark, [(1, text)]), items(spark, BENCH), OLD).collect()
    assert [(r.item_id, r.changed) for r in found] == ([] if held is None else [(1, held)])


def test_edge_rows(spark):
    rows = [(1, QUESTION), (1, QUESTION), (1, "another version"), (None, QUESTION), (2, None), (3, "")]
    rows += [(None, "clean"), (None, None), (4, "word " * 300_000 + QUESTION), (5, "so: short one, here now!")]
    found = templates.leaks(docs(spark, rows), items(spark, BENCH)).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in found) == [(-1, 1), (1, 1), (4, 1), (5, 2)]
    kept = templates.remove_leaks(docs(spark, rows), items(spark, BENCH))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [
        (-1, ""), (-1, "clean"), (1, "another version"), (2, ""), (3, ""),
    ]
    assert templates.leaks(docs(spark, []), items(spark, BENCH)).count() == 0
    assert templates.leaks(docs(spark, rows), items(spark, [])).count() == 0


def test_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in given.collect()]
    whole = {(d, r.item_id) for r in bench.collect() for d, t in texts if r.text in t}
    found = {(r.doc_id, r.item_id) for r in templates.leaks(given, bench).collect()}
    assert whole and whole <= found


def test_lexicon_grows_and_is_trimmed(monkeypatch):
    lexicon = templates.Lexicon()
    text = " ".join(f"w{i}" for i in range(10_000))
    assert len(np.unique(templates.Template(text, lexicon).hashes)) == 10_000
    monkeypatch.setattr(templates, "MEMO_WORDS", 100)
    lexicon.trim()
    assert not lexicon and templates.Template("a 5 kg", lexicon).kinds.tolist() == [0, 1, 3]


SUMS = "What is 12 + 35 * 4 - 18 / 6 ?"
COINS = (
    "Anna has 12 coins, Ben has 15 coins, Carla has 20 coins and David has 33 coins; Anna gives Ben 4, "
    "Carla gives David 7, who has most ?"
)
CAPITALS = "Paris Rome Berlin Madrid Vienna Warsaw Prague Lisbon Athens Dublin Oslo Helsinki Stockholm"
DENSE = [(1, SUMS), (2, COINS), (3, CAPITALS), (4, "Wie Viele Große Häuser Und Kleine Gärten Hat Die Alte Stadt ?")]


def test_copies_with_few_literals(spark):
    rows = [
        (10 * i + at, f"They asked: {change(text)} And so on.")
        for i, text in DENSE
        for at, change in enumerate((str, str.lower, str.upper))
    ]
    rows += [(91, "What is 12 + 36 * 4 - 18 / 6 ?"), (92, "Paris Rome Berlin and others")]
    found = templates.leaks(docs(spark, rows), items(spark, DENSE), templates.WHOLE).collect()
    whole = {i: len(tokens(text)) for i, text in DENSE}
    expected = [(10 * i + at, i, 0, whole[i]) for i, _ in DENSE for at in range(3)]
    assert sorted((r.doc_id, r.item_id, r.changed, r.covered) for r in found) == expected


def test_longest_stretch_against_all_stretches():
    rng = random.Random(3)
    for _ in range(400):
        own, other = ([rng.choice("abcdef") for _ in range(16)] for _ in range(2))
        other = [o if rng.random() < 0.4 else x for o, x in zip(other, own)]
        places = [(i, 3, list(zip(own[i : i + 3 : 2], other[i : i + 3 : 2]))) for i in range(14) if rng.random() < 0.8]
        best = (0, 0, 0)
        for a in range(len(places)):
            for b in range(a + 1, len(places) + 1):
                pairs = {p for w in places[a:b] for p in w[2]}
                if len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs}):
                    covered = len({t for w in places[a:b] for t in range(w[0], w[0] + 3)})
                    best = max(best, (covered, -sum(x != y for x, y in pairs), len(pairs)))
        assert templates.longest_stretch(rng.sample(places, len(places))) == best


def test_one_clash_leaves_the_rest(spark):
    sums = "Tom buys 5 red apples and 3 green pears at the market on the way and pays 5 coins for all of the fruit"
    rows = [
        (1, QUESTION.replace("180", "360")),
        (2, sums.replace("pays 5", "pays 3")),  # 5 stands for 5 and for 3
        (3, sums.replace("5 red", "8 red").replace("pays 5", "pays 9")),
        (4, "Tom buys 5 red apples and 3 green"),
        (5, QUESTION.replace("Boston at 9 with 40", "Boston at 9 with 9").replace("after 3 hours", "after 9 days")),
    ]
    found = templates.leaks(docs(spark, rows), items(spark, [(1, QUESTION), (2, sums)]), templates.WHOLE)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 2), (5, 1)}
    short = [(1, "All 7 of us ate 8 eggs as we sat by the sea then")]  # every long enough stretch clashes
    bench = [(8, "All 5 of us ate 5 eggs as we sat by the sea then")]
    assert templates.leaks(docs(spark, short), items(spark, bench), templates.WHOLE).count() == 0


def test_an_instruction_of_many_items_is_no_evidence(spark):
    opening = "Read the following question with care and choose the one answer that fits it best of all"
    rng = random.Random(1)
    ends = [" ".join(f"w{rng.randrange(500)}" for _ in range(12)) for _ in range(50)]
    bench = [(i, f"{opening} {end}") for i, end in enumerate(ends)] + [(60 + i, opening) for i in range(2)]
    rows = [(1, f"Some words first. {opening} and then things that nobody asked about at all"), (2, f"So: {opening} {ends[7]} ok")]
    rows += [(3, f"nothing {ends[9]} of it"), (4, "Some words that are in no item whatever one may look for")]
    found = templates.leaks(docs(spark, rows), items(spark, bench[:50])).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2, 7)}
    # The bare instruction is an item of its own here, and there as a whole.
    found = templates.leaks(docs(spark, rows), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2, 7), (1, 60), (1, 61), (2, 60), (2, 61)}


def test_short_items_are_found_as_a_whole(spark):
    rows = [(1, "x solve this now y"), (2, "Solve THIS, now!"), (3, "solve this later"), (4, "now this solve")]
    found = templates.leaks(docs(spark, rows), items(spark, [(1, "solve this now"), (2, "?"), (3, "")])).collect()
    assert sorted((r.doc_id, r.item_id, r.covered) for r in found) == [(1, 1, 3), (2, 1, 3)]
