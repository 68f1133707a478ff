"""Ranking of chunks for questions by blocks: scores of pairs are made and ranked where the chunks lie, and never moved.

A scope of n chunks and m questions has up to n times m pairs with a common term, so these cannot be rows of a shuffle.
Chunks come together in blocks of about ``BLOCK``: many small scopes in one, a large scope in several, which the scope's
questions all visit. A block scores all of its pairs as sums over rows of a matrix of terms and chunks, held in portions of
``CELLS`` numbers, and gives each question's ``k`` best; the best of all blocks are the best of all chunks. Numbers that
concern a whole scope (its size, its mean length, in how many chunks a term is) are counted in the block where the scope
lies in one, and before, over all of its chunks, where it is large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.sources.tables import settle

K1, B = 1.5, 0.75
#: Chunks of a block, about; a scope of more has several blocks.
BLOCK = 5_000
#: Numbers of a matrix that are held at once.
CELLS = 4_000_000


def _in_blocks(questions: DataFrame, chunks: DataFrame, words: Column, length: Column, made: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with their ``block``. Large scopes have one more row among the questions, without a question_id: their
    ``n`` chunks, the ``total`` of the chunks' ``length``, and in how many chunks each of the ``words`` is.

    ``made``: what is made of the chunks' ``text``, each time it is read; such chunks may have copies, and are not settled."""
    chunks = chunks.where("scope is not null")
    if made is None:
        chunks = settle(chunks)
    make = lambda df: df if made is None else df.select(*[x for x in df.columns if x != "text"], *made)
    buckets = max(1, -(-chunks.count() // BLOCK))
    size = chunks.groupBy("scope").agg(F.count("*").alias("_n"))
    large = F.broadcast(size.where(F.col("_n") > BLOCK).select("scope", F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("_parts")))  # at most one row for each BLOCK chunks
    in_bucket, in_part = F.pmod(F.xxhash64("scope"), F.lit(buckets)), lambda part: F.xxhash64("scope", part)
    c = make(chunks.join(large, "scope", "left").withColumn("block", F.when(F.col("_parts").isNull(), in_bucket).otherwise(in_part(F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int")))).drop("_parts"))

    own = make(chunks.join(large, "scope"))
    if made is not None:
        own = own.repartition("scope", "chunk_id").distinct()
    # copies of a chunk with the same length are one in the counts of terms
    one = own.groupBy("scope", "chunk_id", "page_number", length.alias("_len")).agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("_w"), F.count("*").alias("_copies"))
    counted = one.select("scope", F.explode("_w").alias("word")).groupBy("scope", "word").agg(F.count("*").alias("count"))
    lists = counted.groupBy("scope").agg(F.collect_list(F.struct("word", "count")).alias("l")).select("scope", F.array_join("l.word", " ").alias("words"), F.array_join(F.col("l.count").cast("array<string>"), " ").alias("counts"))
    stats = one.groupBy("scope").agg(F.sum("_copies").alias("n"), F.sum(F.col("_copies") * F.col("_len")).alias("total")).join(lists, "scope", "left").withColumn("question_id", F.lit(None).cast(questions.schema["question_id"].dataType))
    q = questions.where("scope is not null").unionByName(stats, allowMissingColumns=True).join(large, "scope", "left")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    q = q.withColumn("_part", F.explode(parts)).withColumn("block", F.when(F.col("_parts").isNull(), in_bucket).otherwise(in_part(F.col("_part")))).drop("_parts", "_part")
    return q, c


def _array(table: pa.Table, name: str) -> pa.Array:
    a = table.column(name)
    return pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of texts whose words stand between single blanks."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    row, word = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), lists.flatten()
    full = pc.not_equal(word, "")
    return row[full.to_numpy(zero_copy_only=False)], word.filter(full)


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The number of each word among the known ones; -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _spans(scopes: pa.Array) -> dict:
    """Of rows sorted by scope: name -> (first, end)."""
    values = scopes.to_numpy(zero_copy_only=False)
    if not len(values):
        return {}
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return dict(zip(values[first], zip(first, np.append(first[1:], len(values)))))


def _by_scope(table: pa.Table, *keys: str) -> pa.Table:
    at = pc.sort_indices(table, sort_keys=[("scope", "ascending"), *[(k, "ascending") for k in keys]], null_placement="at_start")
    return table.take(at).combine_chunks()


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of each row to 9 places, the earlier column first among equals; -inf is none."""
    r = np.rint(score * 1e9)
    if 0 < k < r.shape[1]:
        least = np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k]
        row, column = np.nonzero((r >= least[:, None]) & (r > -np.inf))
    else:
        row, column = np.nonzero(r > -np.inf)
    order = np.lexsort((column, -r[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _large(stats: pa.Table) -> dict:
    """name -> (n, total, words, counts) of the large scopes."""
    out = {}
    for r in stats.select(["scope", "words", "counts", "n", "total"]).to_pylist():
        words = r["words"].split(" ") if r["words"] else []
        out[r["scope"]] = (r["n"], r["total"], pa.array(words, pa.string()), np.array(r["counts"].split(" "), dtype=float) if words else np.empty(0))
    return out


def _count_of(known: tuple, asked: pa.Array) -> np.ndarray:
    at = _codes(asked, known[2])
    return np.where(at >= 0, known[3][np.maximum(at, 0)] if len(known[3]) else 0.0, 0.0)


def _idf(n: float, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def _covers(q_key: np.ndarray, words: int, c_key: np.ndarray, same: tuple[np.ndarray, np.ndarray, np.ndarray], asked: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, counts): for each pair of rows how many of the question's distinct words each row of the chunk's name has.

    ``q_key``, ``c_key``: row * words + word, sorted, each once; ``same``: as of ``_names``.
    """
    rows, first, number = same
    n = number[chunk]
    pair = np.repeat(np.arange(len(chunk)), n)
    ends = np.cumsum(n)
    row = rows[first[chunk][pair] + np.arange(len(pair)) - (ends - n)[pair]]
    a, b = np.searchsorted(q_key, asked * words), np.searchsorted(q_key, (asked + 1) * words)
    m = (b - a)[pair]
    at = np.repeat(np.arange(len(pair)), m)
    key = row[at] * words + q_key[a[pair][at] + np.arange(len(at)) - (np.cumsum(m) - m)[at]] % words
    has = c_key[np.minimum(np.searchsorted(c_key, key), len(c_key) - 1)] == key if len(c_key) else np.zeros(len(key), dtype=bool)
    return ends, np.bincount(at[has], minlength=len(pair))


def _names(scope: pa.Array, chunk_id: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by scope and chunk_id, and for each row the first place and the number of those of its name."""
    both = pa.table({"s": scope, "c": chunk_id})
    codes = [pc.fill_null(pc.dictionary_encode(both[x], null_encoding="encode").combine_chunks().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("s", "c")]
    name = np.unique(codes[0] * (int(codes[1].max(initial=0)) + 2) + codes[1], return_inverse=True)[1]
    number = np.bincount(name)
    return np.argsort(name, kind="stable"), (np.cumsum(number) - number)[name], number[name]


def _once(chunks: pa.Table) -> pa.Table:
    """Each chunk once, of those with the same text the first."""
    own = ["scope", "chunk_id", "page_number", "words", "digest"]
    at = chunks.select(own).append_column("at", pa.array(np.arange(chunks.num_rows))).group_by(own).aggregate([("at", "min")])["at_min"]
    return chunks if len(at) == chunks.num_rows else chunks.take(np.sort(at.to_numpy()))


def top_of_blocks(questions: DataFrame, chunks: DataFrame, k: int, bm25: bool, padded: bool = False, matched: bool = False, made: list[Column] | None = None) -> DataFrame:
    """(question_id, chunk_id, page_number, score): of each block a question's ``k`` best by BM25, or by the number of
    common words.

    ``questions``: (question_id, scope, words); ``chunks``: (scope, chunk_id, page_number, words); words stand in a string
    between blanks. Ties go to the earlier page, then the smaller chunk_id. Chunks without a common word are left out,
    unless ``padded``: then they count with 0 for questions that have a word. ``matched`` adds how many of the question's
    distinct words the chunk has: one number for each row with the chunk's scope and chunk_id, all of which are in one block.
    ``made``: chunks have their ``text`` and may have copies; it makes the words, and the ``digest`` that tells texts apart.
    """
    q = questions.groupBy("question_id", "scope").agg(F.array_join(F.collect_list("words"), " ").alias("asked"))
    words = F.filter(F.split("words", " "), lambda w: w != "")
    q, c = _in_blocks(q, chunks, words, F.size(words), made)
    kind, copies = questions.schema["question_id"].dataType.simpleString(), made is not None

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.filter(pc.is_valid(left["question_id"]))
        at_q, at_c, scores, covers = [], [], [], []
        if copies:
            right = _once(right)
        if asked.num_rows and right.num_rows:
            large = _large(left.filter(pc.is_null(left["question_id"])))
            asked = _by_scope(asked)
            right = _by_scope(right.append_column("at", pa.array(np.arange(right.num_rows))), "page_number", "chunk_id", "at").drop_columns("at")
            q_row, q_word = _words(_array(asked, "asked"))
            known = pc.unique(q_word)
            q_code = _codes(q_word, known)
            c_row, c_word = _words(_array(right, "words"))
            length = np.bincount(c_row, minlength=right.num_rows)
            c_code = _codes(c_word, known)
            c_row, c_code = c_row[c_code >= 0], c_code[c_code >= 0]
            if matched:
                q_key, c_key, same = np.unique(q_row * len(known) + q_code), np.unique(c_row * len(known) + c_code), _names(_array(right, "scope"), _array(right, "chunk_id"))
            chunk_id, page = _array(right, "chunk_id").to_numpy(zero_copy_only=False), pc.fill_null(_array(right, "page_number"), -(1 << 31)).to_numpy()
            spans = _spans(_array(right, "scope"))
            for scope, (q0, q1) in _spans(_array(asked, "scope")).items():
                if scope not in spans:
                    continue
                c0, c1 = spans[scope]
                for qi, ci, s in _scored(q_row, q_code, q0, q1, c_row, c_code, c0, c1, length, chunk_id, page, large.get(scope), known, k, bm25, padded):
                    at_q.append(qi)
                    at_c.append(ci)
                    scores.append(s)
                    if matched:
                        covers.append(_covers(q_key, len(known), c_key, same, qi, ci))
        none = np.empty(0, dtype=np.int64)
        of, at = pa.array(np.concatenate([none, *at_q])), pa.array(np.concatenate([none, *at_c]))
        more = {}
        if matched:
            ends = np.cumsum(np.concatenate([[0], *[np.diff(e, prepend=0) for e, _ in covers]])).astype(np.int32)
            more["matched"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *[n for _, n in covers]]).astype(np.int32)))
        return pa.table({"question_id": asked["question_id"].take(of), "chunk_id": right["chunk_id"].take(at), "page_number": right["page_number"].take(at), "score": np.concatenate([np.empty(0), *scores]), **more})

    return q.groupBy("block").cogroup(c.groupBy("block")).applyInArrow(rank, f"question_id {kind}, chunk_id string, page_number int, score double" + ", matched array<int>" * matched)


def _scored(q_row, q_code, q0, q1, c_row, c_code, c0, c1, length, chunk_id, page, large, known, k, bm25, padded) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question's row, chunk's row, score) of the best pairs of a scope, whose rows are q0 to q1 and c0 to c1."""
    a, b = np.searchsorted(q_row, [q0, q1])
    if a == b:
        return
    # questions: each word once, with its number of times
    terms, code = np.unique(q_code[a:b], return_inverse=True)
    pair, times = np.unique((q_row[a:b] - q0) * len(terms) + code, return_counts=True)
    of, code = pair // len(terms), pair % len(terms)
    # chunks: of the same chunk_id and page one unit; within it rows of the same length have their terms in common
    n = c1 - c0
    doc, unit = np.arange(n), np.arange(n)
    same = (page[c0 + 1 : c1] == page[c0 : c1 - 1]) & (chunk_id[c0 + 1 : c1] == chunk_id[c0 : c1 - 1])
    if same.any():
        unit = np.concatenate(([0], np.cumsum(~same)))
        doc = np.unique(unit * (int(length.max()) + 1) + length[c0:c1], return_inverse=True)[1]
    docs, first = np.unique(doc, return_index=True)
    d_len, d_unit = length[c0:c1][first].astype(float), unit[first]
    starts = np.flatnonzero(np.concatenate(([True], d_unit[1:] != d_unit[:-1])))
    at = np.searchsorted(c_row, [c0, c1])
    row, term = doc[c_row[at[0] : at[1]] - c0], c_code[at[0] : at[1]]
    place = np.searchsorted(terms, term)
    good = (place < len(terms)) & (terms[np.minimum(place, len(terms) - 1)] == term)
    post, tf = np.unique(place[good] * len(docs) + row[good], return_counts=True)
    p_term, p_doc = post // len(docs), post % len(docs)
    df = np.bincount(p_term, minlength=len(terms)).astype(float)
    size, mean = n, length[c0:c1].mean()
    if large is not None:
        size, mean, df = large[0], large[1] / large[0], _count_of(large, known.take(pa.array(terms)))
    if bm25:
        norm = K1 * (1 - B + B * d_len / (mean if mean else 1.0))
        value, weight = tf * (K1 + 1) / (tf + norm[p_doc]), _idf(size, df)[code] * times
    else:
        value, weight = np.ones(len(tf)), np.ones(len(code))
    width = max(256, CELLS // len(terms))
    unit_of = np.searchsorted(starts, np.arange(len(docs)), side="right") - 1
    many = np.flatnonzero(np.concatenate(([True], np.diff(of) > 0)))
    ends = np.append(many[1:], len(of))
    row_of_unit = np.zeros(len(starts), dtype=np.int64)
    row_of_unit[unit_of[::-1]] = first[::-1]
    u = 0
    while u < len(starts):
        # whole units of about ``width`` rows
        v = max(u + 1, int(np.searchsorted(starts, starts[u] + width, side="right")) - 1) if starts[u] + width < len(docs) else len(starts)
        lo, hi = starts[u], starts[v] if v < len(starts) else len(docs)
        here = (p_doc >= lo) & (p_doc < hi)
        w = np.zeros((len(terms), hi - lo))
        w[p_term[here], p_doc[here] - lo] = value[here]
        portion = max(1, CELLS // (hi - lo))
        for i in range(0, len(many), portion):
            s = np.empty((min(portion, len(many) - i), hi - lo))
            for j in range(len(s)):
                x, y = many[i + j], ends[i + j]
                np.dot(weight[x:y], w[code[x:y]], out=s[j])
            if v - u < hi - lo:
                s = np.add.reduceat(s, starts[u:v] - lo, axis=1)
                if not bm25:
                    s = np.stack([(np.maximum.reduceat(w[code[x:y]], starts[u:v] - lo, axis=1)).sum(axis=0) for x, y in zip(many[i : i + len(s)], ends[i : i + len(s)])])
            if not padded:
                s[s <= 0] = -np.inf
            qi, ui = best(s, k)
            yield q0 + of[many[i + qi]], c0 + row_of_unit[u + ui], s[qi, ui]
        u = v


_NUMBERS = {x: y for i, w in enumerate(tx.NUMBER_WORDS, 1) for x, y in ((w, str(i)), (str(i), w))}


def variants(term: str) -> list[str]:
    """As ``text.variants``."""
    other = term[:-1] if term.endswith("s") and len(term) > 3 else term + "s" if len(term) > 2 and re.fullmatch("[a-z]+", term) else None
    return [v for v in (term, other, _NUMBERS.get(re.sub(r"^0+(?=[0-9])", "", term))) if v is not None]


def phrases_of(tokens: list[str]) -> list[tuple[str, ...]]:
    """Runs of 4 to 2 tokens without a number alone."""
    return [g for n in (4, 3, 2) for g in (tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)) if not any(re.fullmatch("[0-9]+", t) for t in g)]


class _Met:
    """Rows of a block by a key, each row once: ``of(key, first, end)`` are those from first to end."""

    def __init__(self, key: np.ndarray, row: np.ndarray, rows: int):
        pair, self.times = np.unique(key * rows + row, return_counts=True) if len(key) else (np.empty(0, dtype=np.int64), np.empty(0))
        self.rows, self.pair = rows, pair

    def of(self, key: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.pair, [key * self.rows + first, key * self.rows + end])
        return self.pair[a:b] - key * self.rows, self.times[a:b]


def _runs(row: np.ndarray, code: np.ndarray, wanted: set[tuple[int, ...]], words: int) -> list[tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]]:
    """(runs of codes, which of them was met, in which row) of each length, for wanted runs and their beginnings; codes stand
    in order, -1 for other words."""
    out = []
    at, number, before = np.flatnonzero(code >= 0), code[code >= 0], [(c,) for c in range(words)]
    for n in (2, 3, 4):
        runs = sorted({w[:n] for w in wanted if len(w) >= n})
        if not runs or not len(at):
            break
        place = {w: i for i, w in enumerate(before)}
        key = np.array([place[w[:-1]] * words + w[-1] for w in runs])
        order = np.argsort(key)
        runs, key = [runs[i] for i in order], key[order]
        good = at + n - 1 < len(code)
        at, number = at[good], number[good]
        good = (row[at + n - 1] == row[at]) & (code[at + n - 1] >= 0)
        at, number = at[good], number[good]
        if not len(at):
            break
        k = number * words + code[at + n - 1]
        found = np.minimum(np.searchsorted(key, k), len(key) - 1)
        good = key[found] == k
        at, number, before = at[good], found[good], runs
        out.append((runs, number, row[at]))
    return out


def gated_of_blocks(questions: DataFrame, chunks: DataFrame, k: int, threshold: float) -> DataFrame:
    """(question_id, chunk_id, page_number, score, matched, passed_by, unmatched, phrases): of each block a question's ``k``
    best that pass the gate of ``retrieval.gated``.

    ``questions``: (question_id, scope, tokens, sections, chapters); ``chunks``: (scope, chunk_id, page_number,
    section_number, nt, ni, nc); terms and numbers stand in strings between blanks.
    """
    split = lambda *c: F.filter(F.split(F.concat_ws(" ", *c), " "), lambda w: w != "")
    spread = lambda *c: F.flatten(F.transform(split(*c), tx.variants))
    q, c = _in_blocks(questions, chunks, F.array_distinct(spread("nt", "ni", "nc")), F.greatest(F.lit(1), F.size(spread("nt"))))
    kind = questions.schema["question_id"].dataType.simpleString()

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.filter(pc.is_valid(left["question_id"]))
        out: list[list] = [[] for _ in range(7)]
        if asked.num_rows and right.num_rows:
            large = _large(left.filter(pc.is_null(left["question_id"])))
            asked, right = _by_scope(asked), _by_scope(right, "page_number", "chunk_id")
            own = [t.split() for t in _array(asked, "tokens").to_pylist()]
            names = sorted({t for tokens in own for t in tokens})
            spread_of = {t: variants(t) for t in names}
            terms = sorted({v for vs in spread_of.values() for v in vs})
            number = {t: i for i, t in enumerate(terms)}
            rows = right.num_rows
            known = pa.array(names, pa.string())
            code_of = {t: i for i, t in enumerate(names)}
            phrases = [phrases_of(tokens) for tokens in own]
            wanted = {tuple(code_of[t] for t in g) for gs in phrases for g in gs}
            met, length, holders = {}, None, {}
            for field in ("nt", "ni", "nc"):
                row, word = _words(_array(right, field))
                coded = pc.dictionary_encode(word)
                vocabulary, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                more = [variants(w) for w in vocabulary]
                if field == "nt":
                    length = np.bincount(row, weights=np.array([len(m) for m in more], dtype=float)[at], minlength=rows) if len(row) else np.zeros(rows)
                keys, of = [], []
                first = np.array([[number.get(v, -1) for v in (m + [""] * 3)[:3]] for m in more], dtype=np.int64).reshape(-1, 3)
                for j in range(3):
                    v = first[at, j]
                    keys.append(v[v >= 0])
                    of.append(row[v >= 0])
                met[field] = _Met(np.concatenate(keys), np.concatenate(of), rows)
                for runs, which, there in _runs(row, _codes(word, known), wanted, len(names)):
                    pair = np.unique(which * rows + there)
                    ends = np.searchsorted(pair, np.arange(len(runs) + 1) * rows)
                    for i in np.flatnonzero(np.diff(ends)):
                        if runs[i] in wanted:
                            holders.setdefault(runs[i], []).append(pair[ends[i] : ends[i + 1]] - i * rows)
            holders = {g: np.unique(np.concatenate(r)) for g, r in holders.items()}
            section = _array(right, "section_number").to_numpy(zero_copy_only=False)
            lists = {f: [[int(x) for x in t.split()] for t in _array(asked, f).to_pylist()] for f in ("sections", "chapters")}
            spans = _spans(_array(right, "scope"))
            for scope, (q0, q1) in _spans(_array(asked, "scope")).items():
                if scope not in spans:
                    continue
                c0, c1 = spans[scope]
                here = sorted({number[v] for i in range(q0, q1) for t in own[i] for v in spread_of[t]})
                place = {terms[v]: i for i, v in enumerate(here)}
                df = np.zeros(len(here))
                of_term = []
                for i, v in enumerate(here):
                    parts = [met[f].of(v, c0, c1) for f in ("nt", "ni", "nc")]
                    every = np.unique(np.concatenate([p[0] for p in parts]))
                    df[i] = len(every)
                    of_term.append((parts, every))
                full = np.maximum(1.0, length[c0:c1])
                n, mean = c1 - c0, full.mean()
                if scope in large:
                    n, mean, df = large[scope][0], large[scope][1] / large[scope][0], _count_of(large[scope], pa.array([terms[v] for v in here], pa.string()))
                idf = np.where(df > 0, np.maximum(0.1, _idf(n, df)), 0.1)
                width = max(256, CELLS // max(1, len(here)))
                for lo in range(c0, c1, width):
                    hi = min(c1, lo + width)
                    norm = K1 * (1 - B + B * np.maximum(1.0, length[lo:hi]) / max(1.0, mean))
                    m = np.zeros((len(here), hi - lo))
                    for i, (parts, every) in enumerate(of_term):
                        for (at, times), fixed in zip(parts, (None, 2.5, 2.0)):
                            a, b = np.searchsorted(at, [lo, hi])
                            x = at[a:b] - lo
                            m[i, x] += idf[i] * (times[a:b] * (K1 + 1) / (times[a:b] + norm[x]) if fixed is None else fixed)
                    tokens_here = sorted({t for i in range(q0, q1) for t in own[i]})
                    hit_row = {t: i for i, t in enumerate(tokens_here)}
                    hit = np.array([m[[place[v] for v in spread_of[t]]].max(axis=0) > 0 for t in tokens_here], dtype=np.uint8).reshape(len(tokens_here), hi - lo)
                    sec = section[lo:hi]
                    for i in range(q0, q1):
                        tokens = own[i]
                        if not tokens:
                            continue
                        matched = hit[[hit_row[t] for t in tokens]].sum(axis=0, dtype=np.int64)
                        score = m[sorted({place[v] for t in tokens for v in spread_of[t]})].sum(axis=0)
                        found = np.zeros(hi - lo, dtype=bool)
                        with_phrase = []
                        for g in phrases[i]:
                            at = holders.get(tuple(code_of[t] for t in g))
                            if at is None:
                                continue
                            a, b = np.searchsorted(at, [lo, hi])
                            if a < b:
                                score[at[a:b] - lo] += 3.0 * sum(idf[place[t]] for t in g)
                                found[at[a:b] - lo] = True
                                with_phrase.append((g, at[a:b]))
                        good = (matched > 0) & (found | (matched >= 2) | (score >= (threshold if len(tokens) == 1 else max(2.5 * threshold, 2.5))))
                        by = {f: (sec > 0) & np.isin(sec, lists[f][i]) for f in lists if lists[f][i]}
                        for f, more in (("sections", 10.0), ("chapters", 8.0)):
                            if f in by:
                                score = score + np.where(by[f], more, 0.0)
                                good |= by[f]
                        at = np.flatnonzero(good & (score >= threshold))
                        if not len(at):
                            continue
                        for j in at[best(score[None, at], k)[1]]:
                            has = [t for t in tokens if hit[hit_row[t], j]]
                            with_it = {" ".join(g) for g, r in with_phrase if (p := np.searchsorted(r, lo + j)) < len(r) and r[p] == lo + j}
                            why = [x for x, y in (("phrase boost", with_it), ("requested section number", "sections" in by and by["sections"][j]), ("requested chapter mapped to section", "chapters" in by and by["chapters"][j])) if y]
                            row = (i, lo + j, score[j], " ".join(has), ", ".join(why) or "bm25 score", " ".join(t for t in dict.fromkeys(tokens) if t not in has), "; ".join(sorted(with_it)))
                            for values, v in zip(out, row):
                                values.append(v)
        of, at = pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())
        more = {x: pa.array(v, pa.string()) for x, v in zip(("matched", "passed_by", "unmatched", "phrases"), out[3:])}
        return pa.table({"question_id": asked["question_id"].take(of), "chunk_id": right["chunk_id"].take(at), "page_number": right["page_number"].take(at), "score": pa.array(out[2], pa.float64()), **more})

    return q.groupBy("block").cogroup(c.groupBy("block")).applyInArrow(rank, f"question_id {kind}, chunk_id string, page_number int, score double, matched string, passed_by string, unmatched string, phrases string")
