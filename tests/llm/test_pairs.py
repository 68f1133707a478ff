import random

import numpy as np
import pytest

from leafmill.llm import pairs

NOUNS = {"en": ["market", "ledger", "tariff", "budget", "currency", "dividend", "interest", "supplier"], "de": ["Markt", "Haushalt", "Zoll", "Preis", "Lohn", "Kredit", "Handel", "Zins"]}


def _pair(rng, lang):
    a, b = rng.sample(NOUNS[lang], 2)
    n = rng.randint(1, 90)
    if lang == "en":
        return f"What is the role of the {a} in chapter {n}?", rng.choice([f"The {a} offsets the {b}, because each {b} in this example is seasonal.", f"It finances the {b} (see the note on page {n}), and it cannot be replaced by a {a}."])
    return f"Warum wird der {a} in Kapitel {n} behandelt?", rng.choice([f"Weil der {a} und der {b} nach dieser Darstellung selten zusammen auftreten.", f"Der {a} ist hier meistens mit Blick auf den {b} zu verstehen, wie Seite {n} zeigt."])


def test_defects_are_found(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(1_500):
        lang = "en" if rng.random() < 0.65 else "de"
        q, a = _pair(rng, lang)
        kind = rng.random()
        if kind < 0.02:
            a, truth[i] = rng.choice([None, "", "N/A", "-", "  ", "<p></p>"]), "empty"
        elif kind < 0.05:
            a, truth[i] = a[: int(len(a) * rng.uniform(0.4, 0.8))].rsplit(" ", 1)[0], "truncated"
        elif kind < 0.07:
            a, truth[i] = ("Sorry, I can't help with that question." if lang == "en" else "Es tut mir leid, dabei kann ich nicht helfen."), "refusal"
        elif kind < 0.09:
            a, truth[i] = rng.choice([q, q.upper(), q.rstrip("?")]), "copy"
        elif kind < 0.12:
            a, truth[i] = _pair(rng, "de" if lang == "en" else "en")[1], "wrong_language"
        elif kind < 0.2:
            a = a.rstrip(".")
        rows.append(("t", i, q, a, "x"))
    rows += [rows[0], ("t", 2_000, None, None, "x"), ("t", 2_001, None, "The market offsets the ledger, because each ledger in this example is seasonal.", "x"), ("t", 2_002, "What is it?", "long answer " * 5_000 + ".", "x")]
    df = spark.createDataFrame(rows, "tbl string, item_id bigint, q string, a string, defect string")
    got = {}
    for r in pairs.defective_pairs(df, ["tbl", "item_id"], "q", "a").collect():
        got.setdefault(r.item_id, set()).add(r.defect)
    assert got.pop(2_000) == {"empty"}
    for d in pairs.DEFECTS:
        want, have = {i for i, x in truth.items() if x == d}, {i for i, x in got.items() if d in x and i < 2_000}
        assert len(want & have) / len(want) > 0.9 and len(want & have) / len(have) > 0.9, (d, len(want), len(have), len(want & have))


def test_empty_table(spark):
    df = spark.createDataFrame([], "tbl string, item_id bigint, q string, a string")
    assert pairs.defective_pairs(df, ["tbl", "item_id"], "q", "a").count() == 0


def test_languages_by_marks():
    assert [pairs.LANGUAGES[pairs.marked_language(t)] for t in ("what is the plan", "was ist der Plan", "pourquoi est-ce que", "por qué se estudia el caso", "מה זה")] == ["en", "de", "fr", "es", "he"]
    assert pairs.visible("<p> </p>​&nbsp;") == "" and pairs.bare("A-b 1!") == "ab1"


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    rows = [_pair(rng, "en" if rng.random() < 0.6 else "de") for _ in range(3_000)]
    t = pairs.Tokens([a for _, a in rows])
    h, n = np.unique(t.hash[t.word], return_counts=True)
    return pairs.PairModel(rows, pairs.Words(h[n > 1], n[n > 1].astype(float), (n[n > 1] / 9).round()))


UNSEEN = ["I won't go into that topic here.", "My apologies, that falls beyond my remit.", "I'd prefer to leave this one unanswered.", "I am not comfortable giving an answer.", "There is no way for me to reply to this."]


@pytest.mark.parametrize("n", [1, 3, 8, 30])
def test_defects_at_all_lengths(model, n):
    rng = random.Random(n)
    rows, want = [], []
    for i in range(400):
        lang = "en" if i % 5 else "de"
        q, a = _pair(rng, lang)
        more = [_pair(rng, lang)[1] for _ in range(n - 1)]
        kind = i % 4
        if kind == 0:
            text, d = " ".join([*more, a[: int(len(a) * rng.uniform(0.4, 0.93))]]), "truncated"
        elif kind == 1 and lang == "en":
            text, d = " ".join([rng.choice(UNSEEN), *more]), "refusal"
        elif kind == 2:
            text, d = " ".join(_pair(rng, "de" if lang == "en" else "en")[1] for _ in range(n)), "wrong_language"
        else:
            text, d = " ".join([*more, a]), None
        rows.append((q, text)), want.append(d)
    got = model.defects(rows)
    for d in ("truncated", "refusal", "wrong_language"):
        true, said = [i for i, x in enumerate(want) if x == d], [i for i, x in enumerate(got) if d in x]
        hit = len(set(true) & set(said))
        assert hit / len(true) > 0.9 and hit / max(1, len(said)) > 0.9, (d, n, hit, len(true), len(said))


def test_stand_ins_that_were_not_made(model):
    q = "What is the role of the market in chapter 7?"
    said = [model.defects([(q, x)])[0] for x in ("coming soon", "see above", "to follow", "lorem ipsum", "siehe oben", "[redacted]", "n.d.", "(pending)")]
    assert sum(x == ["empty"] for x in said) >= 7
    assert model.defects([(q, "")]) == [["empty"]] and model.defects([("", None)]) == [["empty"]]


def test_another_language_than_those_known(model):
    q = "What is the role of the market in chapter 7?"
    other = ["Rynek kompensuje księgę, ponieważ każda księga w tym przykładzie jest sezonowa.", "Il mercato compensa il registro, perché ogni registro in questo esempio è stagionale.", "De markt compenseert het grootboek, omdat elk grootboek in dit voorbeeld seizoensgebonden is."]
    assert sum("wrong_language" in x for x in model.defects([(q, a) for a in other])) >= 2
    assert "wrong_language" not in model.defects([("Please translate into Polish: the market is seasonal.", other[0])])[0]


def test_windows_and_made_texts():
    assert [w.strip() for w in pairs.windows("One is. Two is!\nThree")] == ["One is.", "Two is!", "Three"] and pairs.windows("") == [""]
    rng = random.Random(1)
    assert pairs.cut_off("ab", rng) is None and pairs.cut_off("Whole one. The second sentence is here.", rng).startswith("Whole one. ")
