"""Subjects of documents by class-association rules.

Sentences of labelled documents are transactions: their telling words and the document's subject. Parallel FP-growth
mines the frequent sets; those of one or two words with a subject of enough confidence become rules (words -> subject). A
rule of two words is redundant, and dropped, if one of its words is as sure alone; so words that say little each, and much
together, are what such rules are for. A second round labels the sentences by the first rules, where those speak, so that a
document's general sentences no longer count for its subject. Each sentence of every document adds the evidence of the
rules it matches, each once: the log of a rule's smoothed confidence against the subject's share. The subject with most
evidence, if enough, has the sentence. A document has the subjects that hold at least a share of its sentences; evidence
and share are calibrated on labelled documents that were not mined.

Only mining and calibration take a bounded sample: at most ``SAMPLE`` labelled documents, those of least hash, of which a
fifth, by hash, is held out. Every document is scored alone, where it lies, with all rules over all of its sentences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import scan
from leafmill.sources.tables import settle

SAMPLE = 5_000
#: Sentences of one document of the sample that are mined.
SAMPLE_SENTENCES = 60
#: Frequent sets are mined among so many telling words at once; a sentence with more is several transactions.
BASKET = 12
MIN_COUNT = 6
#: Least confidence of a rule in the first round, whose sentences bear all labels of their document, and in the second.
FIRST_CONFIDENCE, MIN_CONFIDENCE = 0.35, 0.65
#: A word below this confidence says too little even beside others.
_TELLING = 0.2
#: A rule of two words must be so much surer than each of them.
GAIN = 0.05
#: Least words of a sentence; shorter ones are headings. A longer run without an end is several sentences of so many words.
MIN_WORDS, MOST_WORDS = 4, 64
SHARE = 0.2
#: Values of the least evidence of a sentence and of the least share of a document among which held-out labels choose.
LEAST, SHARES = (1.5, 1.0, 2.0, 3.0), (0.18, 0.16, 0.14, 0.2)
#: A rule that raises a subject's log-odds by less says nothing.
LEAST_EVIDENCE = 1.0
_ENDS = np.array([ord(c) for c in ".!?…؟。"], dtype=np.uint32)


def sentences(layout: scan.Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each word, end, sentence of each word). Sentences end at a line's end, at an end mark before white space
    unless a digit or a small letter follows, and after MOST_WORDS words."""
    codes, kind = layout.codes, layout.kind
    begin, end = scan.words(layout)
    space = kind == scan.SPACE
    mark = np.zeros(len(codes) + 1, dtype=bool)
    mark[1:] = codes == 10
    stop = np.flatnonzero(np.isin(codes[:-1], _ENDS) & space[1:])
    if len(stop) and len(begin):
        k = np.searchsorted(begin, stop)
        follow = codes[begin[np.minimum(k, len(begin) - 1)]]
        low = np.fromiter((chr(c).islower() or chr(c).isdigit() for c in follow), dtype=bool, count=len(follow))
        mark[stop[~low] + 1] = True
    number = np.cumsum(mark)[begin]
    if len(number):
        new = np.concatenate(([True], np.diff(number) != 0))
        at = np.arange(len(number))
        number = np.cumsum(new | ((at - at[new][np.cumsum(new) - 1]) % MOST_WORDS == 0))
    return begin, end, number


@dataclass
class Rules:
    """Rules by hash of their word, or of their two words, with the evidence for each subject."""

    subjects: list[str]
    word: np.ndarray
    evidence: np.ndarray
    pair: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))
    pair_evidence: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    in_pair: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))
    least: float = 0.5
    share: float = SHARE

    @staticmethod
    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of two words in either order."""
        return scan.mix(a + b) ^ scan.mix(a * b + np.uint64(1))

    def assign(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each sentence, its subject or -1, its evidence)."""
        layout = scan.Layout([t.lower() for t in texts])
        cased = scan.Layout(texts)
        if len(cased.codes) != len(layout.codes):  # lower case of another length: end marks are found in lower case
            cased = layout
        begin, end, sentence = sentences(cased)
        if not len(begin):
            return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
        h = layout.hashes(begin, end)
        number = np.concatenate(([0], np.cumsum(np.diff(sentence) != 0)))
        first = np.flatnonzero(np.concatenate(([True], np.diff(number) != 0)))
        n_words = np.diff(np.concatenate((first, [len(begin)])))
        total = np.zeros((len(first), len(self.subjects)))

        def add(sentence: np.ndarray, rule: np.ndarray, evidence: np.ndarray) -> None:
            """Evidence of the rules that sentences match, each once."""
            both = np.unique(sentence.astype(np.int64) * len(evidence) + rule) if len(rule) else np.empty(0, dtype=np.int64)
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(both // max(1, len(evidence)), weights=evidence[both % max(1, len(evidence)), c], minlength=len(first))

        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
            hit = np.flatnonzero(self.word[at] == h)
            add(number[hit], at[hit], self.evidence)
        if len(self.pair):
            k = np.minimum(np.searchsorted(self.in_pair, h), len(self.in_pair) - 1)
            told = np.flatnonzero(self.in_pair[k] == h)
            sentence_of, rule = [], []
            for d in range(1, MOST_WORDS):  # all pairs of such words in a sentence
                a, b = told[:-d], told[d:]
                near = number[a] == number[b]
                if not near.any():
                    break
                a, b = a[near], b[near]
                p = self.both(h[a], h[b])
                at = np.minimum(np.searchsorted(self.pair, p), len(self.pair) - 1)
                hit = self.pair[at] == p
                sentence_of.append(number[a[hit]]), rule.append(at[hit])
            if rule:
                add(np.concatenate(sentence_of), np.concatenate(rule), self.pair_evidence)
        owner = layout.owner(begin[first])
        best = total.argmax(axis=1) if total.shape[1] else np.zeros(len(first), dtype=np.int64)
        value = total[np.arange(len(first)), best] if total.shape[1] else np.zeros(len(first))
        best = np.where(value > 0, best, -1)
        whole = n_words >= MIN_WORDS
        if len(texts) > len(np.unique(owner[whole])):  # a text of headings only is judged by those
            whole |= ~np.isin(owner, owner[whole])
        return owner[whole], best[whole], value[whole]

    def shares(self, texts: list[str], least: float | None = None) -> np.ndarray:
        """Share of each subject in the sentences of each text."""
        owner, best, value = self.assign(texts)
        n = np.bincount(owner, minlength=len(texts))
        good = (best >= 0) & (value >= (self.least if least is None else least))
        count = np.zeros((len(texts), len(self.subjects)))
        np.add.at(count, (owner[good], best[good]), 1)
        return count / np.maximum(n, 1)[:, None]


def _word_hashes(words: list[str]) -> np.ndarray:
    layout = scan.Layout(words)
    return layout.hashes(layout.start[:-1], layout.start[1:] - 1) if words else np.empty(0, dtype=np.uint64)


def mine(transactions: DataFrame, subjects: list[str], sure: float = MIN_CONFIDENCE) -> Rules:
    """Rules from (words array<string>, subject string) rows; a bounded sample."""
    spark = transactions.sparkSession
    counts = transactions.select(F.explode("words").alias("w"), "subject").groupBy("w", "subject").agg(F.count("*").alias("n"))
    share = Counter({r["subject"]: r["n"] for r in counts.groupBy("subject").agg(F.sum("n").alias("n")).collect()})
    words = counts.groupBy("w").agg(F.sum("n").alias("n"), F.max(F.when(F.col("subject") != "", F.col("n"))).alias("top")).where((F.col("n") >= MIN_COUNT) & (F.col("top") >= _TELLING * F.col("n")))
    telling = spark.sparkContext.broadcast({r["w"] for r in words.select("w").collect()})

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = telling.value
        for pdf in batches:
            out = []
            for words, s in zip(pdf["words"], pdf["subject"]):
                own = [w for w in words if w in known]
                out += [[*own[i : i + BASKET], f"={s}"] for i in range(0, len(own), BASKET)]
            yield pd.DataFrame({"items": out})

    baskets = settle(transactions.mapInPandas(items, "items array<string>"))
    n = baskets.count()
    if not n:
        return Rules(subjects, np.empty(0, dtype=np.uint64), np.empty((0, len(subjects))))
    frequent = FPGrowth(itemsCol="items", minSupport=MIN_COUNT / n, numPartitions=12).fit(baskets).freqItemsets
    sets = frequent.where(F.size(F.filter("items", lambda i: ~i.startswith("="))).between(1, 2)).collect()
    body = {frozenset(r["items"]): r["freq"] for r in sets if not any(i[0] == "=" for i in r["items"])}
    total = sum(share.values())
    place = {s: i for i, s in enumerate(subjects)}
    confidence: dict[frozenset, np.ndarray] = {}
    for r in sets:
        marks = [i for i in r["items"] if i[0] == "="]
        words_ = frozenset(i for i in r["items"] if i[0] != "=")
        if len(marks) == 1 and words_ in body and marks[0][1:] in place:
            row = confidence.setdefault(words_, np.zeros(len(subjects)))
            row[place[marks[0][1:]]] = r["freq"] / body[words_]
    prior = np.array([max(1, share[s]) / max(1, total) for s in subjects])

    def evidence(words: frozenset) -> np.ndarray:
        n = body[words]
        smooth = (confidence[words] * n + prior * 2) / (n + 2)
        return np.where(confidence[words] >= sure, np.log(smooth / (1 - np.minimum(smooth, 0.999))) - np.log(prior / (1 - prior)), 0.0)

    kept = []
    for words_, row in confidence.items():
        best = row.max()
        shorter = max((confidence.get(frozenset([w]), np.zeros(1)).max() for w in words_), default=0.0) + GAIN if len(words_) == 2 else 0.0
        if best >= max(sure, shorter) and evidence(words_).max() >= LEAST_EVIDENCE:
            kept.append(words_)
    single, double = (sorted((w for w in kept if len(w) == k), key=sorted) for k in (1, 2))
    h = _word_hashes([next(iter(w)) for w in single])
    order = np.argsort(h)
    ev = np.array([evidence(w) for w in single]).reshape(-1, len(subjects))
    rules = Rules(subjects, h[order], ev[order])
    if double:
        a, b = (_word_hashes([sorted(w)[i] for w in double]) for i in (0, 1))
        p = Rules.both(a, b)
        order = np.argsort(p)
        rules.pair, rules.pair_evidence, rules.in_pair = p[order], np.array([evidence(w) for w in double])[order], np.unique(np.concatenate((a, b)))
    return rules


def learn(docs: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Rules:
    """Rules from labelled documents, with evidence and share calibrated on those held out."""
    spark = docs.sparkSession
    wanted = labels.where(F.col("subject").isin(subjects)).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("subject")).alias("_own"))
    wanted = wanted.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = settle(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text <> ''").join(F.broadcast(wanted), "_id").select("_id", "_text", "_own"))
    held_out = F.pmod(F.xxhash64("_id", F.lit("held")), F.lit(5)) == 0

    def transactions(rows: DataFrame, rules: Rules | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(rules)

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for pdf in batches:
                out: list[tuple[list[str], str]] = []
                for text, own in zip(pdf["_text"], pdf["_own"]):
                    layout = scan.Layout([text])
                    begin, end, number = sentences(layout)
                    spans = np.flatnonzero(np.concatenate(([True], np.diff(number) != 0))) if len(begin) else []
                    parts = [(a, b) for a, b in zip(spans, [*spans[1:], len(begin)]) if b - a >= MIN_WORDS]
                    parts = parts[:: max(1, len(parts) // SAMPLE_SENTENCES)]
                    said: list[list[str]] = [list(own)] * len(parts)  # at first a sentence bears all labels of its document
                    if known is not None and parts:
                        owner, best, value = known.assign([text[begin[a] : end[b - 1]] for a, b in parts])
                        said = [[""]] * len(parts)
                        for o, b, v in zip(owner, best, value):
                            sure = v >= known.least
                            said[o] = [known.subjects[b]] if sure and known.subjects[b] in own else [""] if sure or b < 0 or v < 0.5 * known.least else []
                    for (a, b), bear in zip(parts, said):
                        words = sorted({text[begin[i] : end[i]].lower() for i in range(a, b) if end[i] - begin[i] > 1}) if bear else []
                        out += [(words, s) for s in bear]
                yield pd.DataFrame({"words": [w for w, _ in out], "subject": [s for _, s in out]})

        return settle(rows.mapInPandas(cut, "words array<string>, subject string"))

    mined = rows.where(~held_out)
    rules = mine(transactions(mined, None), subjects, FIRST_CONFIDENCE)
    rules.least = 1.0
    return calibrated(mine(transactions(mined, rules), subjects), rows.where(held_out))


def calibrated(rules: Rules, held: DataFrame) -> Rules:
    """The rules with the least evidence and share that agree best with labels of ``held`` (_text, _own); another than the
    first values of LEAST and SHARES only where it is clearly better. Documents are judged where they lie; what comes back
    is how many subjects each choice gets right, wrong and not."""
    shared = held.sparkSession.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            for first, part in scan.slices(pdf["_text"]):
                truth = np.array([[s in own for s in known.subjects] for own in pdf["_own"].iloc[first : first + len(part)]], dtype=bool).reshape(len(part), len(known.subjects))
                for least in LEAST:
                    s = known.shares(part, least)
                    for share in SHARES:
                        yield pd.DataFrame([(least, share, int(((s >= share) & truth).sum()), int((s >= share).sum()), int(truth.sum()))], columns=["least", "share", "both", "said", "true"])

    rows = held.mapInPandas(judge, "least double, share double, both bigint, said bigint, true bigint").groupBy("least", "share").agg(F.sum("both"), F.sum("said"), F.sum("true")).collect()
    f1 = {(r[0], r[1]): 2 * r[2] / max(1, r[3] + r[4]) for r in rows}
    best, rules.least, rules.share = -1.0, LEAST[0], SHARE
    for least in LEAST:
        for share in SHARES:
            if f1.get((least, share), -1.0) > best + 2e-3:
                best, rules.least, rules.share = f1[(least, share)], least, share
    return rules


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, subject, share): subjects that hold at least the calibrated share of a document's sentences.

    Null and empty texts and null ids have no subject; repeated rows give one row; without labels no document has any.
    Labels of unknown documents or subjects and other columns are ignored. ``subjects`` is read to the driver: the
    short list of names that a classification has.
    """
    names = sorted({r[0] for r in subjects.select("subject").collect() if r[0]})
    rules = learn(docs, labels, names, doc_id, text, sample)
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, part in scan.slices(batch.column(1).to_pylist()):
                s = known.shares(part)
                i, c = np.nonzero(s >= known.share)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + first)), pa.array([known.subjects[k] for k in c], pa.string()), pa.array(s[i, c])], ["doc_id", "subject", "share"])

    own = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != "")).select(doc_id, text)
    found = own.mapInArrow(find, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, subject string, share double")
    return found.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
