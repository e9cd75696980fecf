"""Texts of which a part was once dropped."""

from codeloom.llm import subjects


def test_an_open_fence_is_text():
    got = " ".join(subjects.sentences("Before it.\n```\nThe rest stays here.\nTo the last line.\n"))
    assert "The rest stays here." in got and "To the last line." in got
    assert "code" not in " ".join(subjects.sentences("One.\n```\ncode()\n```\nTwo.\n"))


def test_a_date_goes_and_its_line_stays():
    text = "2024-01-05 Fixed the parser.\n[2024-01-06 10:11:12] ann: The server is slow.\n2024-01-07T08:09:10.123Z Restarted all.\n2024-01-08: Released.\n"
    got = subjects.sentences(text)
    assert [s.strip() for s in got] == ["Fixed the parser.", "The server is slow.", "Restarted all.", "Released."]


def test_long_words_are_features():
    assert len(subjects.features("x" * 60 + " y")) == 3  # two words and their pair


def test_more_subjects_than_bits(spark):
    names = [f"s{k:02d}" for k in range(40)]
    letters = "abcdefghijklmnopqrst"
    words = {n: [letters[k // 20] + letters[k % 20] * 3 + letters[j] + "ing" for j in range(6)] for k, n in enumerate(names)}
    docs, labels = [], []
    for k in range(400):
        n = names[k % 40]
        text = f"The {words[n][k % 6]} met {words[n][(k + 1) % 6]} today. Then {words[n][(k + 2) % 6]} joined {words[n][(k + 3) % 6]}. All {words[n][(k + 4) % 6]} left."
        docs.append((k, text))
        if k < 240:
            labels.append((k, n))
    docs.append((1000, "Nothing of note was said here. It rained for a while."))
    labels += [(1000, None), (5000, "s00"), (1, "unknown")]
    found = subjects.subjects_of(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(n,) for n in names], "subject string"))
    got = {(r.doc_id, r.subject) for r in found.collect()}
    want = {(k, names[k % 40]) for k in range(400)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(got)
    assert {s for _, s in got} >= {"s32", "s39"}


def test_curves_are_of_each_subject():
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, (3000, 2))
    y = np.stack([z[:, 0] > 0, z[:, 1] > 2], axis=1)  # the second needs more evidence
    curves = subjects._calibration(z, y)
    zero = -curves[:, 1] / curves[:, 0]
    assert abs(zero[0]) < 0.5 and 1.2 < zero[1] < 2.8
    few = subjects._calibration(np.vstack([np.c_[z[:, 0], np.full(3000, -8.0)], [[0.0, 1.0]]]), np.vstack([np.c_[y[:, 0], np.zeros(3000, bool)], [[True, False]]]))
    assert abs(-few[1, 1] / few[1, 0]) < 1.5  # hardly any evidence: near the common curve


def test_scores_without_a_document():
    import numpy as np

    counts = np.zeros((subjects.FEATURES, 3))
    counts[[1, 2, 3], [0, 1, 2]] = 5.0
    model = subjects.Model(counts, np.array([5.0, 5.0, 5.0]))
    feats, lens, shares = np.array([1, 2]), np.array([1, 1]), np.array([[1.0, 0, 0], [0, 1.0, 0]])
    less = counts.copy()
    less[1, 0] -= 1
    less[2, 1] -= 1
    assert np.allclose(model.without(feats, lens, shares), subjects.Model(less, np.array([4.0, 4.0, 5.0])).scores(feats, lens))
