"""Defective question and answer pairs: empty, truncated, refusal, copy, wrong_language.

An answer is read in windows, its sentences, so that nothing depends on its length: a multi-label linear classifier on
hashed n-grams of the window, on how the last window ends and on features of the pair scores each window; an answer
refuses if any window does, breaks off if its last one does, and is in another language if its windows, weighted by
their letters, are. Positive cases are made from the corpus's own pairs at all lengths: answers cut off, replaced by the
question, exchanged for answers in another language or put into invented ones, replaced by refusals and by stand-ins.
Negative cases are the pairs as they are, and variants that are no defect: without the full stop, several answers in a
row, the question followed by an answer. Pairs that the first fit takes for defective leave the negatives. Each defect's
scores are calibrated to probabilities on held-out pairs, at the share of cases that the real pairs among them show.

Corpus statistics (how often a word stands inside or at the end of an answer) cover all rows. Only the fit takes a bounded
sample of ``SAMPLE`` pairs, chosen by hash; it runs in one task, and each row is then scored alone. Features are array
passes over the code points of a batch.
"""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import scan
from leafmill.llm import linear
from leafmill.llm.linear import Rows, slot

DEFECTS = ["empty", "truncated", "refusal", "copy", "wrong_language"]
EMPTY, TRUNCATED, REFUSAL, COPY, LANGUAGE = range(5)
#: The fit takes at most so many pairs, and of a pair at most so many windows.
SAMPLE, SAMPLE_WINDOWS = 12_000, 4
#: Pairs with a score above this in the first fits leave the negatives.
DOUBT = -2.0
#: Words that are at least this share of all words have their counts sent to the tasks: at most a million words.
WORD_SHARE = 1e-6
#: Sentences of the made answers, and how often each.
LENGTHS = [(1, 0.62), (2, 0.1), (4, 0.12), (10, 0.1), (30, 0.06)]
# Words that tell the languages apart, for the first labels of the language model.
MARKS = {
    "en": "the of and is are which what why how that with each an was this to for".split(),
    "de": "der die das und ist wird nicht mit auf für von dem den was warum wie welche ich eine kann".split(),
    "fr": "le les est dans une des que qui pourquoi comme pas ne ce cette quel je sont du".split(),
    "es": "el los es una que qué por para como cómo según se puedo del al las muestra".split(),
}
LANGUAGES = ["en", "de", "fr", "es", "he"]
OTHER = len(LANGUAGES)
# Stand-ins for an answer that are no phrase.
STAND_INS = [
    "", " ", "  ", "\n", "\t", "\xa0", "\xa0\xa0", "​", "﻿", "-", "--", "---", "—", "–", ".", "..", "...", "…", "?", "??", "???", "!", "_", "__", "/", "*", "[]", "{}", "()", '""', "''", "<p></p>", "<br>", "<br/>", "<div></div>", "<p> </p>", "&nbsp;", "...........",
    "N/A", "n/a", "n.a.", "na", "NA", "NaN", "nan", "null", "NULL", "Null", "none", "None", "NONE", "nil", "undefined", "TBD", "tbd", "TBA", "TODO", "todo", "xxx", "XXX", "n.n.", "n. v.", "k. A.", "k.A.", "s.o.", "s. u.", "o.A.", "s.d.", "s/d", "p.m.", "ND", "empty", "blank", "missing", "unknown", "answer", "Answer:", "placeholder", "leer", "offen", "fehlt", "vide", "néant", "pendiente", "vacío", "ninguna", "ללא", "ריק", "חסר", "dummy text", "sample text", "lorem", "dolor sit amet", "asdf", "foo bar", "test test",
]
# Parts that stand-in phrases are made of, by language: what is there and what became of it; whole ones.
STAND_IN_PARTS = {
    "en": (["answer", "reply", "response", "content", "text", "solution", "entry", "value", "data", "explanation"], ["no {}", "{} missing", "{} pending", "{} not available", "{} unavailable", "{} to be added", "{} to be provided", "{} will follow", "{} follows later", "{} omitted", "{} removed", "{} deleted", "insert {} here", "add {}", "without {}", "{} not given", "{} left blank", "your {} here", "{} goes here", "{} hidden", "{} withheld"], ["to be added", "to be done", "to be written", "not available", "not provided", "not specified", "not yet", "coming later", "will be added soon", "see page", "see below", "same as before", "as above", "left blank", "work in progress", "under construction", "nothing here", "censored", "removed"]),
    "de": (["Antwort", "Lösung", "Text", "Angabe", "Inhalt", "Eintrag"], ["keine {}", "{} fehlt", "{} folgt", "{} folgt später", "{} wird ergänzt", "{} entfernt", "ohne {}", "hier {} einfügen", "{} nicht vorhanden"], ["wird nachgereicht", "noch offen", "noch zu ergänzen", "siehe unten", "siehe Seite", "wie oben", "nicht vorhanden", "in Arbeit", "folgt noch"]),
    "fr": (["réponse", "solution", "texte", "contenu", "donnée"], ["pas de {}", "sans {}", "{} manquante", "{} à venir", "{} à compléter", "{} supprimée", "{} non fournie", "aucune {}"], ["à compléter", "à venir", "à suivre", "voir plus bas", "voir page", "idem", "non disponible", "en cours"]),
    "es": (["respuesta", "solución", "texto", "contenido", "dato"], ["sin {}", "{} pendiente", "{} por completar", "{} no disponible", "{} eliminada", "falta {}", "ninguna {}"], ["por completar", "por añadir", "ver abajo", "ver página", "no disponible", "en preparación", "próximamente", "ídem"]),
    "he": (["תשובה", "פתרון", "תוכן"], ["אין {}", "ללא {}", "{} חסרה", "{} תתווסף"], ["יתווסף בהמשך", "ראו למטה", "לא זמין", "חסר"]),
}
# Ways to decline, by language: openings, cores and endings that may follow.
REFUSALS = {
    "en": (
        ["", "Sorry, ", "Sorry, but ", "I'm sorry, but ", "I am sorry, ", "Unfortunately, ", "As a study assistant, ", "As an AI model, ", "As a language model, ", "I apologize, but ", "Apologies, ", "I'm afraid ", "My apologies: ", "Regrettably, ", "To be honest, "],
        ["I can't help with that.", "I can't help with that question.", "I cannot answer this question.", "I am not able to answer this.", "I'm unable to comply with this request.", "I must decline to respond here.", "I would rather not answer that.", "this is outside what I am permitted to discuss.", "I don't have access to that document.", "I do not have access to this material.", "no answer can be given by this assistant.", "it would not be appropriate for me to respond.", "I won't be able to answer.", "I am not allowed to discuss this.", "I can not provide an answer to this question.", "I have no information about this.", "that is something I cannot assist with.", "I don't feel able to respond to this request.", "I will not answer this.", "I refuse to answer that.", "I am not in a position to say.", "my guidelines do not allow me to reply.", "I can't share details on this topic.", "answering this is not possible for me.", "I have to pass on this one.", "I don't know the answer to that question.", "I prefer not to comment on this."],
        ["", " Please ask your tutor.", " Try rephrasing your request!", "; another source may serve you better.", " Please consult your teacher.", " Is there anything else?"],
    ),
    "de": (
        ["", "Es tut mir leid, ", "Leider gilt: ", "Entschuldigung, ", "Tut mir leid, aber ", "Als Lernassistent sage ich: ", "Leider: ", "Verzeihung, "],
        ["ich kann diese Frage nicht beantworten.", "dabei kann ich nicht helfen.", "diese Frage darf ich nicht beantworten.", "ich habe keinen Zugriff auf dieses Dokument.", "dazu möchte ich mich nicht äußern.", "darauf kann ich keine Antwort geben.", "ich bin nicht in der Lage, das zu beantworten.", "diese Anfrage muss ich ablehnen.", "dazu liegen mir keine Informationen vor.", "das werde ich nicht beantworten.", "mir ist es nicht erlaubt, darüber zu sprechen.", "hierzu gebe ich keine Auskunft.", "das kann ich Ihnen nicht sagen."],
        ["", " Bitte frage deine Lehrkraft.", " Bitte formuliere die Frage neu.", " Eine andere Quelle hilft eher."],
    ),
    "fr": (
        ["", "Je suis désolé, ", "Je suis désolée, ", "Désolé, ", "Pardon, ", "Malheureusement, ", "En tant qu'assistant, ", "Excusez-moi, "],
        ["je ne peux pas répondre à cette question.", "je ne peux pas vous aider sur ce point.", "il m'est impossible de traiter cette demande.", "je n'ai pas accès à ce document.", "je préfère ne pas répondre.", "je ne suis pas autorisé à en parler.", "je dois refuser de répondre ici.", "aucune réponse ne peut être donnée.", "je ne dispose d'aucune information à ce sujet.", "je refuse de répondre.", "je ne suis pas en mesure de le dire.", "je ne saurais vous renseigner."],
        ["", " Merci de demander à votre enseignant.", " Merci de reformuler la question.", " Une autre source sera plus utile."],
    ),
    "es": (
        ["", "Lo siento, ", "Lo siento mucho, ", "Lamentablemente, ", "Perdón, ", "Disculpa, ", "Como asistente, "],
        ["no puedo ayudar con esa pregunta.", "no puedo responder a esta pregunta.", "no tengo acceso a ese documento.", "no me es posible atender esta solicitud.", "prefiero no responder.", "no estoy autorizado a hablar de esto.", "debo negarme a responder aquí.", "no dispongo de información sobre este tema.", "no se puede dar ninguna respuesta.", "me niego a contestar.", "no me está permitido comentarlo.", "no estoy en condiciones de decirlo."],
        ["", " Consulta a tu docente.", " Pregunta a tu docente.", " Intenta reformular la pregunta.", " Otra fuente será más útil."],
    ),
    "he": (
        ["", "מצטער, ", "מצטערת, ", "סליחה, ", "לצערי, ", "כעוזר לימודים, "],
        ["איני יכול לענות על השאלה הזאת.", "אני לא יכול לעזור בזה.", "אין לי גישה למסמך המבוקש.", "אסור לי להשיב על בקשה כזאת.", "אני מעדיף לא לענות.", "לא ניתן לתת תשובה.", "אין לי מידע בנושא הזה.", "עליי לסרב לענות כאן.", "אני מסרב לענות.", "לא אוכל להתייחס לזה."],
        ["", " אנא פנו למרצה.", " נסו לנסח מחדש את הבקשה."],
    ),
}
# A question with one of these may ask for an answer in another language.
ASKS_LANGUAGE = re.compile(
    r"\b(english|french|german|spanish|hebrew|italian|portuguese|dutch|latin|translat\w*|englisch\w*|französisch\w*|deutsch\w*|spanisch\w*|hebräisch\w*|italienisch\w*|übersetz\w*|anglais\w*|français\w*|allemand\w*|espagnol\w*|hébreu|hébraïque|italien\w*|tradui\w*|inglés|inglesa|francés|francesa|alemán|alemana|español\w*|hebreo|hebrea|italiano|traduc\w*)\b|אנגלית|צרפתית|גרמנית|ספרדית|עברית|תרגמו|תרגם",
    re.I,
)
_TAGS = re.compile(r"<[^>]*>|&nbsp;")
_HEBREW = re.compile("[֐-׿]")
_WINDOW = re.compile(r"(?<=[.!?…؟。])[\"'”’»)\]]*\s+|\n+")
LM_BITS = 17


# --- text as arrays


@cache
def _folded() -> np.ndarray:
    """Lower case of every code point, where that is one code point."""
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)], dtype=np.uint32)


@cache
def _upper() -> np.ndarray:
    return np.array([chr(i).isupper() for i in range(0x110000)], dtype=bool)


@cache
def _unseen() -> np.ndarray:
    """Code points that don't show: controls, formats, separators."""
    return np.array([unicodedata.category(chr(i))[0] in "CZ" for i in range(0x110000)], dtype=bool)


def salt(name: str) -> np.uint64:
    return np.uint64((slot(name) * 0x9E3779B97F4A7C15 + 0x51) & (2**64 - 1))


def _hash(name: str, *parts) -> np.ndarray:
    """Hash of a named feature with values in arrays."""
    x = salt(name)
    for p in parts:
        p = np.asarray(p)
        x = scan.mix(np.asarray(x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (p.astype(np.int64).view(np.uint64) if p.dtype != np.uint64 else p))
    return np.asarray(x)


class Tokens:
    """Words and single signs of texts: place, text, hash in lower case, shape hash (numbers and names made alike)."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        layout = self.layout = scan.Layout(texts, "\x00")
        self.codes = layout.codes
        kind = layout.kind
        word = (kind == scan.LETTER) | (kind == scan.NUMBER)
        sign = np.flatnonzero((kind == scan.OTHER) & (self.codes != 0))
        b, e = scan.runs(word)
        self.cased = layout.codes
        layout.codes = _folded()[layout.codes]
        begin = np.concatenate((b, sign))
        order = np.argsort(begin, kind="stable")
        self.begin, self.end = begin[order], np.concatenate((e, sign + 1))[order]
        self.word = np.concatenate((np.ones(len(b), dtype=bool), np.zeros(len(sign), dtype=bool)))[order]
        self.hash = layout.hashes(self.begin, self.end) if len(self.begin) else np.empty(0, dtype=np.uint64)
        self.owner = layout.owner(self.begin)
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))
        self.count = np.diff(self.first)
        size = self.end - self.begin
        number = self.word & (kind[self.begin] == scan.NUMBER) & (kind[np.maximum(self.end - 1, 0)] == scan.NUMBER)
        leading = np.zeros(len(self.begin), dtype=bool)
        leading[self.first[:-1][self.count > 0]] = True
        self.capital = self.word & _upper()[self.cased[self.begin]] if len(self.begin) else np.empty(0, dtype=bool)
        self.name = self.capital & (size > 4) & ~leading
        self.size = size
        self.shape = np.where(number, np.uint64(1), np.where(self.name, np.uint64(2), self.hash))
        self.letter = kind == scan.LETTER


@dataclass
class Words:
    """Counts of the corpus's words by sorted hash: inside and at the end of answers."""

    hash: np.ndarray
    inside: np.ndarray
    final: np.ndarray

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hash):
            return np.zeros(len(h)), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = self.hash[at] == h
        return np.where(hit, self.inside[at], 0), np.where(hit, self.final[at], 0)


def visible(text: str) -> str:
    """Text without markup and characters that don't show."""
    return "".join(c for c in _TAGS.sub("", text) if unicodedata.category(c)[0] not in "CZ")


def bare(text: str) -> str:
    """Letters and digits in lower case."""
    return re.sub(r"[\W_]+", "", text.lower())


def windows(text: str) -> list[str]:
    """Sentences and lines of a text; a text without any is one window."""
    parts = [p for p in _WINDOW.split(text) if p and not p.isspace()]
    return parts or [text]


# --- language


def language_rows(t: Tokens) -> Rows:
    """Hashed words and character 2- to 4-grams in and at the edges of words other than names."""
    keep = t.word & ~t.name & t.letter[t.begin] if len(t.begin) else np.empty(0, dtype=bool)
    b, e, owner = t.begin[keep], t.end[keep], t.owner[keep]
    inside = np.zeros(len(t.codes) + 4, dtype=np.int8)
    np.add.at(inside, b, 1)
    np.add.at(inside, e, -1)
    inside = np.cumsum(inside)[: len(t.codes)].astype(bool)
    x = np.concatenate((np.zeros(1, dtype=np.uint64), np.where(inside, t.layout.codes.astype(np.uint64), np.uint64(0)), np.zeros(4, dtype=np.uint64)))
    of = np.concatenate(([0], np.searchsorted(t.layout.start, np.arange(len(t.codes)), side="right") - 1, [0] * 4))
    parts = [(owner, _hash("lw", t.hash[keep]), 1.0)]
    n = len(x)
    grams = []
    for k in (2, 3, 4):
        a = [x[i : n - k + 1 + i] for i in range(k)]
        ok = (a[0] != 0) | (a[1] != 0) if k == 2 else np.logical_and.reduce([c != 0 for c in a[1:-1]])
        at = np.flatnonzero(ok)
        h = _hash(f"l{k}", *[c[at] for c in a])
        lead = of[np.where(a[0][at] != 0, at, at + 1)]
        grams.append((lead, h))
    parts.append((np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]), 2.0))
    return Rows.grouped(t.n, parts, LM_BITS)


def marked_language(text: str) -> int:
    """Index in LANGUAGES by script and marking words, or -1."""
    if _HEBREW.search(text):
        return 4
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = [sum(w in s for w in words) for s in MARKS.values()]
    best = max(n)
    return n.index(best) if best and n.count(best) == 1 else -1


_VOWELS, _CONSONANTS = "aeiouyáéíóúàèùâêîôûäöüëï", "bcdfghjklmnpqrstvwxzçñß"
_HEBREW_LETTERS = "אבגדהוזחטיכלמנסעפצקרשת"


def invented(text: str, rng: random.Random) -> str:
    """The text in a language that isn't: its letters exchanged, vowels for vowels, in most of its words."""
    change: dict[int, str] = {}
    for letters in (_VOWELS, _CONSONANTS, _HEBREW_LETTERS):
        other = list(letters)
        rng.shuffle(other)
        change |= {ord(a): b for a, b in zip(letters, other)} | {ord(a.upper()): b.upper() for a, b in zip(letters, other) if len(a.upper()) == 1}
    share = rng.uniform(0.65, 1)
    return " ".join(w.translate(change) if rng.random() < share and not w[:1].isdigit() else w for w in text.split(" "))


class Languages:
    """Language of a short text: the corpus's own words, labelled first by marking words, then by each pair's question;
    and one more class, trained on invented languages."""

    def __init__(self, pairs: list[tuple[str, str | None]], rng: random.Random):
        texts = [(q, marked_language(q)) for q, _ in pairs]
        first = [(t, y) for t, y in texts if y >= 0] + [(" ".join(m), k) for k, m in enumerate(MARKS.values())]
        first += [(invented(t, rng), OTHER) for t, _ in first[:: max(1, len(first) // 1500)]]
        self.w = self._fit(first)
        own = self.scores([q for q, _ in pairs])[:, :OTHER].argmax(axis=1) if pairs else []
        more = [(a, int(y)) for (q, a), y in zip(pairs, own) if a and not ASKS_LANGUAGE.search(q) and (bool(_HEBREW.search(a)) == (y == 4)) and marked_language(a) in (-1, y)]
        more += [(invented(a, rng), OTHER) for a, _ in more[:: max(1, len(more) // 2500)]]
        self.w = self._fit(first + more)

    @staticmethod
    def _fit(rows: list[tuple[str, int]]) -> np.ndarray:
        return linear.fit(language_rows(Tokens([t for t, _ in rows])), np.eye(OTHER + 1, dtype=np.float32)[[y for _, y in rows]], classes="one", epochs=4, bits=LM_BITS)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts, languages and other)."""
        return self.of(Tokens(texts), texts)

    def of(self, t: Tokens, texts: list[str]) -> np.ndarray:
        s = linear.scores(self.w, language_rows(t))
        s[[bool(_HEBREW.search(x)) for x in texts], 4] += 8
        return linear.softmax(s)


# --- features


def _bucket(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the hashes ``a`` are among ``b``."""
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), dtype=bool)


@dataclass
class Batch:
    """Windows of a batch of pairs."""

    rows: Rows
    pair: np.ndarray
    last: np.ndarray
    letters: np.ndarray


class Featurizer:
    """Hashed features of the windows of pairs, with the corpus's word counts."""

    def __init__(self, languages: Languages, words: Words):
        self.languages, self.words = languages, words

    def portions(self, pairs: list[tuple[str | None, str | None]], most: int = 300_000) -> Iterator[tuple[int, list, Batch]]:
        """(index of the first, pairs, their windows) in portions of about ``most`` characters, so that memory stays small."""
        for first, part in scan.slices([a for _, a in pairs], most):
            own = pairs[first : first + len(part)]
            yield first, own, self.batch(own)

    def batch(self, pairs: list[tuple[str | None, str | None]]) -> Batch:
        """Windows of all the pairs at once."""
        qs, answers = [q or "" for q, _ in pairs], [_TAGS.sub("", a) if a and ("<" in a or "&" in a) else a or "" for _, a in pairs]
        cut = [windows(a) for a in answers]
        n_win = np.array([len(c) for c in cut], dtype=np.int64)
        texts = [w.strip() for c in cut for w in c]
        pair = np.repeat(np.arange(len(pairs)), n_win)
        last = np.zeros(len(texts), dtype=bool)
        last[np.cumsum(n_win) - 1] = True
        t, tq = Tokens(texts), Tokens(qs)
        n = len(texts)
        row = np.arange(n)
        letters = np.bincount(t.layout.owner(np.flatnonzero(t.letter)), minlength=n)[:n]
        shown = np.bincount(t.layout.owner(np.flatnonzero(~_unseen()[t.cased])), minlength=n)[:n]
        parts: list[tuple[np.ndarray, np.ndarray, float]] = []

        def add(at: np.ndarray, group: list[np.ndarray], weight: float = 1.0) -> None:
            parts.append((np.tile(at, len(group)), np.concatenate([np.broadcast_to(g, at.shape) for g in group]) if group else np.empty(0, dtype=np.uint64), weight))

        bare = (shown == 0) | (letters == 0)
        only = np.bincount(pair, weights=~bare, minlength=len(pairs))[pair] == 0  # no window of the pair has letters
        whole_hash = t.layout.hashes(t.layout.start[:-1], t.layout.start[1:] - 1) if n else np.empty(0, dtype=np.uint64)
        add(row[only & (shown == 0)], [_hash("nothing")], 3.0)
        number = np.bincount(t.owner[t.word], minlength=n)[:n] > 0
        add(row[only & (shown > 0)], [_hash("signs", number[only & (shown > 0)]), _hash("all", whole_hash[only & (shown > 0)])], 3.0)
        use = ~bare
        # n-grams
        tok = use[t.owner] if len(t.owner) else np.empty(0, dtype=bool)
        i = np.flatnonzero(tok)
        nxt = np.flatnonzero(tok[:-1] & (t.owner[:-1] == t.owner[1:])) if len(tok) else i
        one, two = _hash("1", t.shape[i]), _hash("2", t.shape[nxt], t.shape[nxt + 1])
        parts.append((np.concatenate((t.owner[i], t.owner[nxt])), np.concatenate((one, two)), 2.0))
        n_words = np.bincount(t.owner[t.word], minlength=n)[:n]
        big = row[use & (t.count >= 3)]
        f = t.first[big]
        add(big, [_hash("h2", t.shape[f], t.shape[f + 1]), _hash("h3", t.shape[f], t.shape[f + 1], t.shape[f + 2])])
        # short answers: the whole, its characters, whether the corpus has its words
        inside, final = self.words(t.hash)
        seen_word = np.where(t.word, inside + final >= 1, True)
        known = np.bincount(t.owner[t.word], weights=seen_word[t.word], minlength=n)[:n] / np.maximum(1, n_words)
        alone = n_win[pair] == 1
        short = row[use & alone & (t.count <= 7)]
        if len(short):
            edge = np.zeros(n, dtype=bool)
            opening, closing = t.codes[t.layout.start[short]], t.codes[np.maximum(t.layout.start[short + 1] - 2, 0)]
            edge[short] = np.isin(opening, [ord(c) for c in "([{<"]) & np.isin(closing, [ord(c) for c in ")]}>"])
            k = _bucket(known[short], (0.3, 0.6, 0.99))
            add(short, [_hash("all", whole_hash[short]), _hash("few", np.minimum(n_words[short], 6)), _hash("brackets", edge[short]), _hash("known", k), _hash("known n", k, np.minimum(n_words[short], 6)), _hash("known brackets", k, edge[short])], 2.0)
            mask = np.zeros(n, dtype=bool)
            mask[short] = True
            of = np.searchsorted(t.layout.start, np.arange(len(t.codes)), side="right") - 1
            c = t.layout.codes.astype(np.uint64)
            grams = []
            for k in (2, 3, 4):
                at = np.flatnonzero(mask[of[: len(c) - k + 1]] & (of[: len(c) - k + 1] == of[k - 1 :])) if len(c) >= k else np.empty(0, dtype=np.int64)
                grams.append((of[at], _hash(f"c{k}", *[c[at + j] for j in range(k)])))
            parts.append((np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]), 2.0))
        # how the answer ends
        end = row[use & last & (t.count > 0)]
        if len(end):
            z = t.first[end + 1] - 1
            sign = np.where(t.word[z], 0, t.codes[t.begin[z]])
            dots = (sign == ord(".")) & (t.count[end] >= 3) & (t.codes[t.begin[np.maximum(z - 1, 0)]] == ord(".")) & (t.codes[t.begin[np.maximum(z - 2, 0)]] == ord("."))
            cut_off = np.isin(sign, [0, *map(ord, "…,;:(-–—’'")]) | dots
            lastword = np.full(n, -1, dtype=np.int64)
            wi = np.flatnonzero(t.word)
            lastword[t.owner[wi]] = wi
            w = lastword[end]
            h, name = t.hash[w], t.capital[w]
            a, b = inside[w], final[w]
            seen = _bucket(a, (1, 3, 10, 100)) * 100 + _bucket(b, (1, 3, 10, 100)) * 10 + _bucket(b / (a + b + 1), (0.02, 0.1, 0.3, 0.6))
            y, x = np.maximum(z - 1, t.first[end]), np.maximum(z - 2, t.first[end])
            single = (n_words[end] == 1) & alone[end]
            size = np.minimum(n_words[end], 25)
            brief = alone[end] & (n_words[end] <= 4)
            open_ = np.sign(np.bincount(t.owner, weights=(t.codes[t.begin] == 40).astype(int) - (t.codes[t.begin] == 41), minlength=n)[end])
            add(end, [_hash("end", sign + dots * 7), _hash("cut", cut_off), _hash("cut seen", cut_off, seen, name), _hash("cut n", cut_off, size), _hash("cut one", cut_off, single, seen), _hash("cut brief", cut_off, brief), _hash("cut open", cut_off, open_)], 2.5)
            add(end, [_hash("cut last", cut_off, h), _hash("cut tail2", cut_off, t.shape[y], t.shape[z]), _hash("cut tail3", cut_off, t.shape[x], t.shape[y], t.shape[z])], 1.5)
        # the pair: words in common
        if n:
            k = np.uint64(0x9E3779B97F4A7C15)
            aw, qw = np.flatnonzero(t.word), np.flatnonzero(tq.word)
            ka, kq = scan.mix(t.hash[aw] + pair[t.owner[aw]].astype(np.uint64) * k), scan.mix(tq.hash[qw] + tq.owner[qw].astype(np.uint64) * k)
            na, nq = np.bincount(pair[t.owner[aw]], minlength=len(pairs)), np.bincount(tq.owner[qw], minlength=len(pairs))
            in_q = np.bincount(pair[t.owner[aw]], weights=_met(ka, kq), minlength=len(pairs)) / np.maximum(1, na)
            in_a = np.bincount(tq.owner[qw], weights=_met(kq, ka), minlength=len(pairs)) / np.maximum(1, nq)
            ratio = _bucket(na / np.maximum(1, nq), (0.3, 0.6, 0.85, 0.99, 1.01, 1.2, 1.6, 2.1))
            s, r = _bucket(in_q, (0.2, 0.5, 0.75, 0.9, 0.99)), _bucket(in_a, (0.2, 0.5, 0.75, 0.9, 0.99))
            at = row[use & (nq[pair] > 0)]
            p = pair[at]
            add(at, [_hash("common", s[p], r[p]), _hash("common ratio", s[p], r[p], ratio[p]), _hash("in q", s[p]), _hash("in a", r[p])], 2.5)
        # language
        at = row[use & (letters > 0)]
        if len(at):
            la, lq = self.languages.of(t, texts), self.languages.of(tq, qs)
            i = lq[:, :OTHER].argmax(axis=1)[pair]
            j = la.argmax(axis=1)
            gap = _bucket(np.log(la[row, j] + 1e-6) - np.log(la[row, i] + 1e-6), (0.01, 0.5, 1.5, 3, 5, 8))
            asked = np.array([bool(ASKS_LANGUAGE.search(q)) for q in qs], dtype=bool)[pair]
            plain = t.word & ~t.name & t.letter[t.begin]
            small = plain & (t.size <= 4)
            odd = _bucket(1 - np.bincount(t.owner[small], weights=seen_word[small], minlength=n)[:n] / np.maximum(1, np.bincount(t.owner[small], minlength=n)[:n]), (0.01, 0.25, 0.5, 0.75))
            few = np.minimum(np.bincount(t.owner[plain], minlength=n)[:n], 4)
            strange = _bucket(1 - np.bincount(t.owner[plain], weights=seen_word[plain], minlength=n)[:n] / np.maximum(1, np.bincount(t.owner[plain], minlength=n)[:n]), (0.01, 0.2, 0.4, 0.6, 0.8))
            same = i == j
            add(at, [_hash("lang", same[at], asked[at]), _hash("gap", gap[at], asked[at]), _hash("gap n", gap[at], asked[at], few[at]), _hash("other", j[at] == OTHER, asked[at]), _hash("odd", odd[at], same[at], few[at]), _hash("odd gap", odd[at], gap[at], asked[at]), _hash("strange", strange[at], same[at], few[at])], 3.0)
        return Batch(Rows.grouped(n, parts), pair, last, letters.astype(np.float64))


def pooled(score: np.ndarray, b: Batch, pairs: int) -> np.ndarray:
    """Scores (pairs, defects) from those of the windows."""
    out = np.full((pairs, len(DEFECTS)), -30.0)
    if not len(b.pair):
        return out
    np.maximum.at(out[:, REFUSAL], b.pair, score[:, REFUSAL])
    out[b.pair[b.last], TRUNCATED] = score[b.last, TRUNCATED]
    weight = b.letters + 1e-3
    total = np.bincount(b.pair, weights=weight, minlength=pairs)
    for c in (EMPTY, COPY, LANGUAGE):
        out[:, c] = np.bincount(b.pair, weights=weight * score[:, c], minlength=pairs) / total
    return out


# --- made cases


def cut_off(a: str, rng: random.Random) -> str | None:
    """The answer cut in a word or between words of its last sentence; None where that is too short."""
    parts = windows(a)
    text = parts[-1].rstrip().rstrip(".!?…\"”»")
    head = a[: a.rstrip().rfind(parts[-1].rstrip())] if len(parts) > 1 else ""
    if len(text) < 5:
        return None
    if len(text.split()) < 3:
        cut = text[: rng.randint(max(2, len(text) // 3), len(text) - 2)]
        return head + cut if not cut.endswith(" ") and len(cut) >= 2 else None
    at = rng.randint(max(4, len(text) // 4), len(text) - 2)
    if rng.random() < 0.6:
        at = text.rfind(" ", 0, at)
        if at < 3:
            return None
    return head + text[:at].rstrip() + rng.choice(["", "", "", "", "", "…", "...", " …", " ...", ","])


def copied(q: str, rng: random.Random) -> str:
    """The question as its own answer, written a little differently."""
    forms = [q, q, q.upper(), q.lower(), q.rstrip(" ?."), q.rstrip(" ?") + "...", q.rstrip(" ?") + ".", f'"{q}"', f"« {q} »", f"({q.rstrip(' ?')})", f"  {q}  ", "  ".join(q.split(" ", 2)), q.replace("?", "").replace("¿", ""), q.title(), f"Q: {q}", q + " " + q]
    return rng.choice(forms)


def stand_in(rng: random.Random) -> str | None:
    """Nothing, or what may stand for an answer."""
    r = rng.random()
    if r < 0.35:
        return rng.choice([None, *STAND_INS])
    nouns, forms, whole = STAND_IN_PARTS[rng.choice(LANGUAGES)]
    text = rng.choice(whole) if r < 0.55 else rng.choice(forms).format(rng.choice(nouns))
    text = rng.choice([text, text, text.capitalize(), text.upper(), text.lower()])
    return rng.choice(["{}", "{}", "{}.", "({})", "[{}]", "<{}>", "- {} -", "{}...", "*{}*"]).format(text)


def refusal(language: str, rng: random.Random) -> str:
    opening, core, ending = (rng.choice(x) for x in REFUSALS[language])
    core = core[:1].upper() + core[1:] if not opening else core
    return opening + (core[:-1] if ending.startswith(";") else core) + ending


class Made:
    """Pairs with made defects, from pairs that have none."""

    def __init__(self, pairs: list[tuple[str, str]], own: np.ndarray, rng: random.Random):
        self.pairs, self.own, self.rng = pairs, own, rng
        self.by_language = {k: [a for (q, a), y in zip(pairs, own) if y == k and not ASKS_LANGUAGE.search(q) and len(a.split()) > 3] for k in range(OTHER)}

    def _more(self, k: int, n: int) -> list[str]:
        pool = self.by_language[k]
        return [self.rng.choice(pool) for _ in range(n)] if pool else []

    def _length(self) -> int:
        r = self.rng.random()
        for n, share in LENGTHS:
            r -= share
            if r < 0:
                return n
        return 1

    def rows(self) -> tuple[list[tuple[str, str | None]], np.ndarray, list[set[int]]]:
        """Pairs, labels, and for refusals the windows' texts that refuse."""
        rng = self.rng
        out: list[tuple[tuple[str, str | None], list[int], str]] = []
        for (q, a), y in zip(self.pairs, self.own):
            y = int(y)
            asked = bool(ASKS_LANGUAGE.search(q))
            n = self._length()
            long = [a, *self._more(y, n - 1)] if len(a.split()) > 3 else [a]
            text = " ".join(long)
            r = rng.random()
            if len(long) > 1:
                out.append(((q, text), [], ""))
            if r < 0.25:
                out.append(((q, stand_in(rng)), [EMPTY], ""))
            if r < 0.9:
                cut = cut_off(text, rng)
                if cut:
                    out.append(((q, cut), [TRUNCATED], ""))
                stripped = text.rstrip().rstrip(".")
                if stripped != text:
                    out += [((q, stripped), [], "")] * 2
            if q and 0.2 < r < 0.5:
                out.append(((q, copied(q, rng)), [COPY], ""))
            if q and len(a.split()) > 3 and 0.5 < r < 0.62:
                out.append(((q, q + " " + text), [], ""))
            if 0.55 < r < 0.9:
                k = LANGUAGES[y] if rng.random() < 0.93 else rng.choice(LANGUAGES)
                said = refusal(k, rng)
                rest = self._more(y, rng.choice([0, 0, 0, 1, 1, n - 1]))
                parts = [said, *rest] if rng.random() < 0.85 or not rest else [rest[0], said, *rest[1:]]
                foreign = [LANGUAGE] if LANGUAGES.index(k) != y and not asked and not rest else []
                out.append(((q, " ".join(parts)), [REFUSAL, *foreign], said))
            if r < 0.35 or r > 0.8:
                k = rng.choice([k for k in self.by_language if k != y])
                other = self._more(k, n)
                if rng.random() < 0.35 and len(a.split()) > 3:
                    other = [invented(x, rng) for x in long]
                if other:
                    b = " ".join(other)
                    cut = cut_off(b, rng) if rng.random() < 0.3 else None
                    out.append(((q, cut or b), ([TRUNCATED] if cut else []) + ([] if asked else [LANGUAGE]), ""))
        labels = np.zeros((len(out), len(DEFECTS)), dtype=np.float32)
        for i, (_, names, _) in enumerate(out):
            labels[i, names] = 1
        return [p for p, _, _ in out], labels, [{w.strip() for w in windows(said)} if said else set() for _, _, said in out]


def _window_labels(pairs: list[tuple[str, str | None]], labels: np.ndarray, said: list[set[int]], b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(labels of the windows, windows to learn from): a refusal counts in its own windows, a cut in the last."""
    y = labels[b.pair].copy()
    y[~b.last, TRUNCATED] = 0
    keep = np.ones(len(b.pair), dtype=bool)
    first = np.concatenate(([True], b.pair[1:] != b.pair[:-1])) if len(b.pair) else np.empty(0, dtype=bool)
    place = np.arange(len(b.pair)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(b.pair) else np.empty(0, dtype=np.int64)
    for i in np.flatnonzero(labels[b.pair, REFUSAL] > 0):
        text = windows(pairs[b.pair[i]][1])[place[i]].strip()
        if text not in said[b.pair[i]]:
            y[i, REFUSAL] = 0
    # of a long answer the first windows and the last
    keep = (place < SAMPLE_WINDOWS - 1) | b.last
    return y, keep


class PairModel:
    """The classifier, its language model, word counts and calibration."""

    def __init__(self, pairs: list[tuple[str | None, str | None]], words: Words, seed: int = 11):
        rng = random.Random(seed)
        pairs = [(q or "", a) for q, a in pairs]
        self.w = np.zeros(((1 << linear.BITS) + 1, len(DEFECTS)), dtype=np.float32)
        self.w[-1] = -5
        self.calibration = [(np.array([-2.0, 2.0]), np.array([0.0, 1.0]))] * len(DEFECTS)
        languages = Languages(pairs, rng)
        self.featurizer = Featurizer(languages, words)
        if not pairs:
            return
        own = languages.scores([q for q, _ in pairs])[:, :OTHER].argmax(axis=1)
        # pairs that a made defect looks like are no certain negatives
        cores = [bare(c) for _, core, _ in REFUSALS.values() for c in core]
        empty = {bare(x) for x in STAND_INS} | {bare(f.format(n)) for nouns, forms, _ in STAND_IN_PARTS.values() for f in forms for n in nouns} | {bare(x) for _, _, whole in STAND_IN_PARTS.values() for x in whole}

        def certain(q: str, a: str | None) -> bool:
            x, y = bare(a or ""), bare(q)
            return bool(a) and x not in empty and x != y and x != y + y and not any(c in x for c in cores)

        keep = np.array([certain(q, a) for q, a in pairs], dtype=bool)
        held = np.array([rng.random() < 0.2 for _ in pairs], dtype=bool)
        real = self._gathered(pairs)
        fold = np.array([rng.random() < 0.5 for _ in pairs], dtype=bool)

        def learn(chosen: np.ndarray, epochs: int) -> np.ndarray:
            """Scores of all real pairs under a fit on the chosen ones and what is made of them."""
            at = np.flatnonzero(chosen)
            rows, y, pair = self._gathered(*Made([(pairs[i][0], pairs[i][1]) for i in at], own[at], rng).rows())
            mine = np.flatnonzero(chosen[real[2]])
            self.w = linear.fit(real[0].take(mine) + rows, np.concatenate((real[1][mine], y)), epochs=epochs)
            return self.scored(pairs)

        # each half judges the other, so that no pair's own defect has been learnt as none
        first = np.where(fold[:, None], learn(keep & ~fold, 3), learn(keep & fold, 3)) if keep.any() else np.zeros((len(pairs), len(DEFECTS)))
        keep &= ~(first > DOUBT).any(axis=1)
        keep &= ~(learn(keep & ~held, 3) > DOUBT).any(axis=1)
        on_real = learn(keep & ~held, 5)
        keep &= ~(on_real > 0).any(axis=1) | ~held
        # calibration on held-out pairs: made ones, and real ones as far as nothing is said against them
        at = np.flatnonzero(keep & held)
        made, labels, _ = Made([(pairs[i][0], pairs[i][1]) for i in at], own[at], rng).rows()
        score = np.concatenate((on_real[at], self.scored(made)))
        truth = np.concatenate((np.zeros((len(at), len(DEFECTS)), dtype=bool), labels > 0))
        for c in range(len(DEFECTS)):
            t = truth[:, c]
            if not t.any() or t.all():
                continue
            even = np.where(t, 0.5 / t.sum(), 0.5 / (~t).sum())
            x, p = linear.reliability(score[:, c], t, even)
            share = linear.prior(np.clip(np.interp(on_real[held, c], x, p), 0.002, 0.998), 0.5)
            share = min(max(share, 0.002), 0.5)
            p = p * share / (p * share + (1 - p) * (1 - share))
            self.calibration[c] = (x, p)

    def _gathered(self, pairs: list, labels: np.ndarray | None = None, said: list[set[int]] | None = None) -> tuple[Rows, np.ndarray, np.ndarray]:
        """(rows, labels, pairs) of the windows to learn from."""
        out = []
        for first, own, b in self.featurizer.portions(pairs):
            end = first + len(own)
            y, use = _window_labels(own, np.zeros((len(own), len(DEFECTS)), dtype=np.float32) if labels is None else labels[first:end], [set()] * len(own) if said is None else said[first:end], b)
            out.append((b.rows.take(np.flatnonzero(use)), y[use], b.pair[use] + first))
        return Rows.joined([r for r, _, _ in out]), np.concatenate([y for _, y, _ in out]), np.concatenate([p for _, _, p in out])

    def scored(self, pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
        out = [pooled(linear.scores(self.w, b.rows), b, len(own)) for _, own, b in self.featurizer.portions(pairs)]
        return np.concatenate(out) if out else np.zeros((0, len(DEFECTS)))

    def probabilities(self, pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
        s = self.scored(pairs)
        return np.stack([np.interp(s[:, c], x, p) for c, (x, p) in enumerate(self.calibration)], axis=1)

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[list[str]]:
        """Names of each pair's defects. An empty answer has no other."""
        p = self.probabilities(pairs) >= 0.5
        p[[not a or not visible(a) if a is None or len(a) < 40 else False for _, a in pairs], EMPTY] = True
        p[p[:, EMPTY], 1:] = False
        return [[d for d, x in zip(DEFECTS, row) if x] for row in p]


def word_counts(answers: DataFrame) -> Words:
    """How often words stand inside and at the end of finished answers, over all rows of the one string column, of the words
    that are found twice and are at least WORD_SHARE of all: at most 1 / WORD_SHARE words come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [a for a in pdf.iloc[:, 0] if isinstance(a, str) and a]
            for _, part in scan.slices(texts):
                t = Tokens(part)
                w = np.flatnonzero(t.word)
                if not len(w):
                    continue
                at_end = np.zeros(len(w), dtype=bool)
                at_end[np.flatnonzero(np.concatenate((t.owner[w][1:] != t.owner[w][:-1], [True])))] = True
                z = np.maximum(t.first[t.owner[w] + 1] - 1, 0)
                stop = np.isin(t.codes[t.begin[z]], [ord(c) for c in ".!?"]) & ~((t.count[t.owner[w]] >= 2) & (t.codes[t.begin[np.maximum(z - 1, 0)]] == ord(".")))
                n_words = np.bincount(t.owner[w], minlength=t.n)[t.owner[w]]
                final = at_end & (stop | (n_words <= 2))
                h, place = np.unique(t.hash[w], return_inverse=True)
                yield pd.DataFrame({"k": h.view(np.int64), "inside": np.bincount(place, weights=~at_end, minlength=len(h)).astype(np.int64), "final": np.bincount(place, weights=final, minlength=len(h)).astype(np.int64)})

    rows = answers.mapInPandas(count, "k bigint, inside bigint, final bigint").groupBy("k").agg(F.sum("inside").alias("i"), F.sum("final").alias("f")).where("i + f > 1")
    total = rows.agg(F.coalesce(F.sum(F.col("i") + F.col("f")), F.lit(0))).first()[0]
    kept = rows.where(F.col("i") + F.col("f") >= total * WORD_SHARE).toPandas()
    h = kept["k"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return Words(h[order], kept["i"].to_numpy(dtype=np.float64)[order], kept["f"].to_numpy(dtype=np.float64)[order])


def defective_pairs(pairs: DataFrame, key: list[str], question: str, answer: str, sample: int = SAMPLE) -> DataFrame:
    """``key`` and defect, distinct: a row for each defect of each pair.

    The model is fitted on at most ``sample`` distinct pairs, those of least hash, and applied to all rows. A null or
    blank answer is ``empty``; a null question counts as the empty one; repeated rows give one row; an empty table
    gives none. Other columns are ignored.
    """
    sc = pairs.sparkSession.sparkContext
    own = pairs.select(*key, F.col(question).alias("_q"), F.col(answer).alias("_a"))
    words = sc.broadcast(word_counts(own.select("_a")))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(q if isinstance(q, str) else None, a if isinstance(a, str) else None) for pdf in batches for q, a in zip(pdf["_q"], pdf["_a"])]
        yield pd.DataFrame({"model": [pickle.dumps(PairModel(rows, words.value))]})

    chosen = own.select("_q", "_a").distinct().orderBy(F.xxhash64("_q", "_a"), "_q", "_a").limit(sample)
    fitted = chosen.coalesce(1).mapInPandas(learn, "model binary").first()
    model = sc.broadcast(fitted[0] if fitted else pickle.dumps(PairModel([], words.value)))
    types = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in key)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(model.value)
        for pdf in batches:
            for first, part in scan.slices(pdf["_a"].where(pdf["_a"].notna(), None), 200_000):
                rows = pdf.iloc[first : first + len(part)]
                names = known.defects([(q if isinstance(q, str) else None, a if isinstance(a, str) else None) for q, a in zip(rows["_q"], rows["_a"])])
                out = rows[key].assign(defect=names).explode("defect")
                yield out[out["defect"].notna()]

    return own.mapInPandas(find, f"{types}, defect string").distinct()
