import random

import numpy as np

from leafmill.llm import subjects
from leafmill.functions import scan

WORDS = {"music": ["violin", "chord", "melody", "tempo", "key"], "law": ["court", "verdict", "jury", "statute", "key"]}
GENERAL = ["Please read the notes before the exam.", "Allow ten minutes for this exercise today.", "See the table on the next page."]


def _doc(rng, mix, n=20):
    out = []
    for s, k in mix.items():
        out += [f"The {rng.choice(WORDS[s])} follows the {rng.choice(WORDS[s])} in this example." for _ in range(k)]
    out += [rng.choice(GENERAL) for _ in range(n - len(out))]
    rng.shuffle(out)
    return " ".join(out)


def test_subjects(spark):
    rng = random.Random(2)
    rows, labels, truth = [], [], {}
    for i in range(300):
        mix = rng.choice([{"music": 12}, {"law": 12}, {"music": 7, "law": 7}, {"music": 12, "law": 1}, {}])
        rows.append((i, _doc(rng, mix), "x"))
        truth[i] = {s for s, k in mix.items() if k >= 4}
        if i < 150:
            labels += [(i, s) for s in truth[i]]
    labels += [(0, "music"), (1, None), (999, "law"), (2, "unknown")]
    rows += [(1_000, None, "x"), (1_001, "", "x"), (None, "The court and the jury met the court.", "x"), rows[0], (1_002, "The court follows the jury in this example. " * 4_000, "x"), (1_003, "!!!", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    out = subjects.subjects_of(docs, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([("music",), ("law",), (None,)], "subject string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(out) == sum(map(len, got.values())) and got[1_002] == {"law"} and not {1_000, 1_001, 1_003, None} & set(got)
    assert sum(got.get(i, set()) == t for i, t in truth.items()) / len(truth) > 0.97


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "The court met the jury here.")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    names = spark.createDataFrame([("law",)], "subject string")
    assert subjects.subjects_of(docs, none, names).count() == 0
    assert subjects.subjects_of(docs.where("false"), none, names).count() == 0


def test_sentences():
    layout = scan.Layout(["See Fig. 3b and more. Then this! no break here.\nNew line", "Next text. Ends"])
    begin, end, number = subjects.sentences(layout)
    parts = {}
    for a, b, n in zip(begin, end, number):
        parts.setdefault(int(n), []).append(layout.text[a:b])
    assert [" ".join(p) for p in parts.values()] == ["See Fig 3b and more", "Then this no break here", "New line", "Next text", "Ends"]
    assert subjects.Rules(["a"], np.empty(0, dtype=np.uint64), np.empty((0, 1))).shares(["One two three four.", ""]).tolist() == [[0.0], [0.0]]


def _shared_words(rng, n):
    """Documents whose subject only two words together tell: each word belongs to two subjects alike."""
    pairs = {"music": ("key", "scale"), "computing": ("key", "index"), "sport": ("court", "match"), "law": ("court", "charge"), "physics": ("charge", "scale"), "chemistry": ("match", "index")}
    rows, labels = [], []
    for i in range(n):
        s = rng.choice(sorted(pairs))
        a, b = pairs[s]
        text = " ".join(rng.choice([f"Here the {a} stands for a certain {b} in most books.", f"Later the {b} is compared with another {a} again."]) if rng.random() < 0.6 else rng.choice(GENERAL) for _ in range(20))
        rows.append((i, text))
        labels.append((i, s))
    return rows, labels, sorted(pairs)


def test_rules_of_two_words_decide(spark):
    rows, labels, names = _shared_words(random.Random(6), 400)
    docs, given = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels[:250], "doc_id bigint, subject string")
    rules = subjects.learn(docs, given, names)
    truth = dict(labels)

    def right():
        s = rules.shares([t for _, t in rows[250:]])
        return np.mean([(s[i] >= rules.share).tolist() == [n == truth[k] for n in names] for i, (k, _) in enumerate(rows[250:])])

    assert len(rules.pair) >= 6 and right() > 0.95
    rules.pair = np.empty(0, dtype=np.uint64)
    assert right() < 0.3


def test_rules_reach_over_a_long_sentence():
    a, b = subjects._word_hashes(["key"]), subjects._word_hashes(["scale"])
    rules = subjects.Rules(["music"], np.empty(0, dtype=np.uint64), np.empty((0, 1)), subjects.Rules.both(a, b), np.array([[3.0]]), np.sort(np.concatenate((a, b))))
    assert rules.shares(["The key " + "and so on " * 15 + "the scale."]).tolist() == [[1.0]]
    assert rules.shares(["word " * 5_000]).tolist() == [[0.0]]
