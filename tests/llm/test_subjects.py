import random

import numpy as np
import pytest

from tidegauge.llm import subjects

TOPICS = {
    "sport": "goal match league trophy coach striker stadium referee".split(), "food": "butter flour oven bread spice soup dough pepper".split(),
    "music": "chord melody violin opera tempo rhythm flute choir".split(),
}


def section(topic, r, n=6):
    return " ".join(f"The {r.choice(TOPICS[topic])} of N{r.randrange(999)} and its {r.choice(TOPICS[topic])} changed in {r.randrange(2000)}." for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r, docs, truth = random.Random(5), [], {}
    for n in range(240):
        own = r.sample(sorted(TOPICS), r.choice([1, 1, 2]))
        docs.append((n, "\n== Part ==\n".join(section(t, r) for t in own), "extra"))
        truth[n] = set(own)
    return docs, truth


def test_sections_are_plain_sentences():
    text = "{{Info|a=b}}\nThé '''one''' is [[X|two]].<ref>no</ref> See three.\n== Head ==\nFour. {| \n| five\n|}\n[[Category:Six]]"
    assert subjects.sections(text) == [[["the", "one", "is", "two"], ["see", "three"]], [["four"]]]
    assert subjects.sections("#REDIRECT [[Sport]]") == [] and subjects.sections(None) == [] and subjects.sections(" \n ") == [] and subjects.sections("{{a}}{{b}}") == []


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    weight = np.full(512, 0.1, np.float32)
    weight[subjects.place("goal", 512)] = 0.7
    p = subjects.Prepared.of([["goal", "match"], ["oven"], ["oven", "goal", "oven"]], 64, weight)
    y, mask = rng.integers(0, 2, (3, 2)).astype(np.float64), np.array([1.0, 0.5, 1.0])
    e, w = rng.normal(size=(64, 3)), rng.normal(size=(4, 2))
    g, h = subjects.gradient(p, y, mask, e, w)
    for x, d, at in ((e, g, np.unravel_index(np.abs(g).argmax(), g.shape)), (w, h, (0, 1)), (w, h, (3, 0))):
        keep = x[at]
        losses = []
        for step in (1e-4, -1e-4):
            x[at] = keep + step
            losses.append(subjects.loss(p, y, mask, e, w))
        x[at] = keep
        assert abs((losses[0] - losses[1]) / 2e-4 - d[at]) < 1e-2


def test_held_out_accuracy_and_odd_rows(spark, corpus):
    docs, truth = corpus
    r = random.Random(6)
    remark = section("food", r, 8) + " One chord was heard."
    odd = [(900, None, ""), (901, "", ""), (902, "#REDIRECT [[goal]]", ""), (903, "asdf qwer zxcv", ""), (904, remark, ""), (905, section("music", r) * 300, ""),
           (906, "N1 is a trophy and league of N2.", ""), (None, section("sport", r), "")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, subject string")
    labels = [(n, s) for n, own in truth.items() if n < 160 for s in own] + [(3, "unknown"), (3, None), (None, "food"), (99999, "food"), (900, "food"), (5, "sport")]
    areas = spark.createDataFrame([(s, "") for s in TOPICS] + [("sport", ""), (None, "")], "subject string, covers string")
    small = subjects.Training(buckets=2048, dim=8, partitions=3)
    got: dict = {}
    for row in subjects.subject_areas(d, spark.createDataFrame(labels, "doc_id long, subject string"), areas, small).collect():
        got.setdefault(row.doc_id, set()).add(row.subject)
    held = [n for n in truth if n >= 160]
    assert sum(got.get(n) == truth[n] for n in held) >= 0.95 * len(held)
    assert not {900, 901, 902, 903} & set(got) and got[904] == {"food"} and got[905] == {"music"} and got[None] == {"sport"}


def test_words_and_markup_are_whole():
    tail = "a" * 60
    assert subjects.features(tail + "xyz", 1 << 14) != subjects.features(tail + "uvw", 1 << 14)
    assert len(subjects.features("".join(random.Random(1).choices("abcdefghij", k=5000)), 1 << 14)) > 100
    assert subjects.sections("{{" * 40 + "goal" + "}}" * 40 + " One.") == [[["one"]]]


def test_a_section_may_have_several_subjects():
    t = subjects.Training(buckets=64, dim=1, level=0.5, share=0.25)
    output = np.array([[0.0, 0.0, 0.0], [5.0, 5.0, -5.0]], np.float32)
    model = subjects.Model(["a", "b", "c"], np.zeros((64, 1), np.float32), output, np.ones(8, np.float32), t)
    assert model.of_sections([[[["one", "two"]]], []]) == [{"a", "b"}, set()]


def test_no_labels_no_subjects(spark):
    d = spark.createDataFrame([(1, "goal")], "doc_id long, text string")
    areas = spark.createDataFrame([("sport",)], "subject string")
    empty = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.subject_areas(d, empty, areas).count() == 0
    assert subjects.subject_areas(d, empty, areas.limit(0)).count() == 0


def test_fewer_labelled_pages_than_parts(spark):
    d = spark.createDataFrame([(1, "The goal of the match."), (2, "#REDIRECT [[x]]"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, "sport") for n in (1, 2, 3, 4)], "doc_id long, subject string")
    areas = spark.createDataFrame([("sport",), ("food",)], "subject string")
    found = subjects.subject_areas(d, labels, areas, subjects.Training(buckets=256, dim=4, partitions=7))
    assert {r.doc_id for r in found.collect()} <= {1}
    assert subjects.subject_areas(d.where("doc_id > 1"), labels, areas).count() == 0
