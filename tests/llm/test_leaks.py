import random

import numpy as np
import pytest

from tidegauge.llm import leaks

ASK = "Which of the following statements is best supported by the passage?"


def edit_to_part(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[:], i
        for j, b in enumerate(t, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def test_bit_vectors_against_dynamic_programming():
    rng = np.random.default_rng(1)
    pattern, text = rng.integers(1, 5, (300, 12)), rng.integers(0, 5, (300, 16))
    length = rng.integers(4, 13, 300)
    for i, n in enumerate(length):
        pattern[i, n:] = -1
    got = leaks.distances(pattern, length, text)
    assert got.tolist() == [edit_to_part(p[:n].tolist(), t.tolist()) for p, n, t in zip(pattern, length, text)]


def item(n):
    r = random.Random(n)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(30)).capitalize() + "."


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, suite string, text string, answer string")
    return d, i


def test_dressed_copies_and_echoes(spark):
    texts = {n: item(n) for n in range(1, 6)}
    items = [(n, "s", f"{t} {ASK}", "") for n, t in texts.items()] + [(9, "s", None, None), (None, "s", item(77), "")]
    w = texts[1][:-1].split()
    changed = w[:]
    changed[3], changed[15] = "other", "quite"
    docs = [
        (1, "Before. " + texts[1].upper() + " After.", ""), (2, "x " + "\n* ".join(" ".join(changed[i : i + 5]) for i in range(0, 30, 5)), ""),
        (3, "<!-- " + "  ".join(w[8:22]) + " -->", ""), (4, "An echo: " + " ".join(w[4:10]) + " ends.", ""), (5, ASK, ""), (6, None, ""), (7, "", ""),
        (8, "[[a|" + w[0] + "]] " + " ".join(w[1:5]) + " {{cn|date=2020}} " + " ".join(w[5:14]), ""), (9, texts[2] + " " + texts[3], ""),
        (10, " ".join(c + "́" if c == "a" else c for c in texts[4]), ""), (None, texts[5], ""), (1, texts[1], ""), (11, "filler " * 20_000 + texts[4], ""),
    ]
    d, i = frames(spark, docs, items)
    want = [(1, 1), (1, 1), (1, 2), (1, 3), (1, 8), (2, 9), (3, 9), (4, 11), (5, 0)]
    for windows in (leaks.BROADCAST_WINDOWS, 0):
        got = leaks.find_leaks(d, i, broadcast_windows=windows)
        assert sorted((r.item_id, r.doc_id or 0) for r in got.collect()) == want
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_recurring_sentences_are_left_out(spark):
    _, i = frames(spark, [], [(n, "s", f"{item(n)} What did N{n} say?", "") for n in range(5)])
    got = {r.item_id: r.words for r in leaks.passages(i).collect()}
    assert all(words == " ".join(leaks.words(item(n))) for n, words in got.items()) and len(got) == 5


def shared_by(n, ask):
    """n items over one passage of 40 words, in between 30 others that have their own; all with the instruction."""
    passage = " ".join(f"s{k}" for k in range(20)).capitalize() + ". " + " ".join(f"t{k}" for k in range(20)).capitalize() + "."
    told = "Read the passage below and answer the question that follows in one short sentence."
    items = [(k, "s", f"{told} {passage} {ask(k)}", "") for k in range(n)] + [(1000 + k, "s", f"{told} {item(k)} {ASK}", "") for k in range(30)]
    return passage, told, items


ASKS = {
    "why": lambda k: f"Why would q{k} have r{k * 7} under u{k * 3}?", "what": lambda k: f"What did N{k} say?", "same": lambda k: ASK, "told": lambda k: f"Tell of q{k} and r{k * 7}.",
}


@pytest.mark.parametrize("n,how", [(1, "why"), (2, "why"), (3, "why"), (5, "why"), (500, "why"), (3, "what"), (500, "same"), (3, "told")])
def test_items_that_share_a_passage_all_leak(spark, n, how):
    ask = ASKS[how]
    passage, told, items = shared_by(n, ask)
    d, i = frames(spark, [(1, f"x {passage} y", ""), (2, f"{told} {ASK} {ask(0)} {ask(1)}", "")], items)
    got = leaks.find_leaks(d, i)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == [(k, 1) for k in range(n)]


def test_without_neighbours_a_shared_passage_is_kept(spark):
    passage, _, items = shared_by(5, lambda k: f"Why would q{k} have r{k * 7}?")
    d, i = frames(spark, [(1, passage, "")], items[:5])
    assert leaks.find_leaks(d, i).count() == 5


def test_fifty_thousand_items_by_join(spark):
    r = random.Random(3)
    text = {n: " ".join(f"w{r.randrange(100_000)}" for _ in range(16)) for n in range(50_000)}
    i = spark.createDataFrame([(n, t) for n, t in text.items()], "item_id long, text string")
    docs = [(n, f"before {text[n * 37]} between {text[n * 41 + 5]} after") for n in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted({(x, n) for n in range(600) for x in (n * 37, n * 41 + 5)})
    assert sorted((g.item_id, g.doc_id) for g in leaks.find_leaks(d, i).collect()) == want


def test_deep_markup_and_long_sentences():
    assert leaks.words("a " + "{{x|" * 3000 + "}}" * 3000 + " b }} {{ c", strip=True) == ["a", "b", "c"]
    ids = leaks.word_ids([f"w{k % 50}" for k in range(20_000)], {})
    keys = leaks.open_keys(ids)
    other = ids.copy()
    other[77] += 5
    assert len(set(keys)) == len(keys) and (leaks.open_keys(other) == keys).sum() == 1


def test_words():
    assert leaks.words("Whéther &amp; «[[Xa (Y)|the]]» or-\nchard hel­lo ‘сat’") == ["whether", "the", "orchard", "hello", "cat"]
