"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its letter n-grams and its entry in a lexicon; transitions between the languages of
neighbouring words are learned with them, on sentences some of which are spliced from two languages, as code-switched text
is. Forward-backward gives each word's marginals over the whole text, which label the words; a document's language is the one
with the largest mean marginal, and that mean is its score.

The model is fitted on a bounded sample of labelled passages. Every learning document is whole passages of PASSAGE letters,
the last one shorter, and PER_LANG of all passages of each language are drawn by a hash of doc_id and place; where there are
many languages fewer of each, but never less than LEAST. No language is left out. Learning rows have a language and a crc32 of doc_id, as text, whose remainder by 4 is not
2. Prediction looks at nothing but the text, all of it; a run of more than 40 letters is read as consecutive words of at
most 40.

Forward-backward runs in blocks: the matrices of BLOCK words are multiplied for all blocks of a batch at once, then a scan
over blocks gives each its border vectors, then all blocks are finished at once. That is exact, and a text of any length
costs as many steps as it has blocks.

Defined cases: null text or text without a letter is "und" with score 0; a null doc_id never teaches and is not held out; if
no row can teach, everything is "und"; ties go to the language that sorts first; repeated rows get equal results; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, held, table

PER_LANG, LEAST, WORK = 400, 16, 1 << 20  # passages learned of a language, at most and where there are many languages; fitting costs passages x languages, so WORK / languages ** 2 between these
PASSAGE, WINDOW, LOT = 600, 24, 1 << 21  # letters of a passage, words of a training sentence, numbers of a lot of sentences that is passed through together
BITS, ROUNDS, RATE, DECAY = 16, 30, 0.15, 1e-5  # hashed features, training rounds, step, weight decay
LEXICON, SHARE = 3, 0.8  # times and share of one language that put a word into the lexicon
BLOCK, LETTERS, HELD = 64, 1 << 20, 300_000  # words of a block; letters of a batch; words whose scores are held
WORD = re.compile(r"[^\W\d_]{1,40}")  # longer runs, as in scripts without spaces, are consecutive words, so that every letter counts


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # transition scores, from row to column
    lexicon: dict[str, int]  # word to language


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Numbers of the word's features; the last of the table's rows are the lexicon's languages."""
    w = f"^{word}$"
    names = [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 2] for i in range(len(w) - 1)]
    names += [f"p{w[:4]}", f"s{w[-4:]}", f"s{w[-5:]}"]
    mask = (1 << BITS) - 1
    out = [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]
    if (lang := lexicon.get(word)) is not None:
        out.append((1 << BITS) + lang)
    return out


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of each word, and what they were summed from: feature numbers and the place where each word's begin."""
    each = [features(w, lexicon) for w in words]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    flat = np.fromiter((f for fs in each for f in fs), np.int64, sum(map(len, each)))
    return np.add.reduceat(weights[flat], starts, axis=0) if len(words) else np.zeros((0, weights.shape[1])), flat, starts


def fitted(pieces: list[tuple[str, str]], seed: int = 7) -> Model:
    """pieces: (language, text)."""
    langs = sorted({lang for lang, _ in pieces})
    number = {lang: k for k, lang in enumerate(langs)}
    k_ = len(langs)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), {})
    rng = np.random.default_rng(seed)
    sentences: list[tuple[list[str], int]] = []
    for lang, text in sorted(pieces):
        words = [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]
        sentences += [(words[i : i + WINDOW], number[lang]) for i in range(0, len(words), WINDOW)]
    times: dict[str, Counter] = {}
    for words, lang in sentences:
        for w in words:
            times.setdefault(w, Counter())[lang] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in times.items() if (n := sum(c.values())) >= LEXICON and c.most_common(1)[0][1] >= SHARE * n}
    vocabulary = sorted(times)
    row = {w: i for i, w in enumerate(vocabulary)}
    n = len(sentences)
    x, y = np.full((n, WINDOW), -1), np.zeros((n, WINDOW), np.int64)
    order = rng.permutation(n)
    for at, i in enumerate(order):
        words, lang = sentences[i]
        other, lang_2 = sentences[order[at - 1]]
        if at % 3 == 0 and len(words) == len(other) == WINDOW:  # spliced from two
            half = int(rng.integers(WINDOW // 4, WINDOW - WINDOW // 4))
            words, labels = words[:half] + other[half:], [lang] * half + [lang_2] * (WINDOW - half)
        else:
            labels = [lang] * len(words)
        x[at, : len(words)] = [row[w] for w in words]
        y[at, : len(words)] = labels
    weights, moves = np.zeros(((1 << BITS) + k_, k_)), np.zeros((k_, k_))
    _, flat, starts = emissions(vocabulary, weights, lexicon)
    sizes = np.diff([*starts, len(flat)])
    there = x >= 0
    step_w, step_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    truth = np.zeros((len(vocabulary), k_))
    np.add.at(truth, (x[there], y[there]), 1)
    true_moves = np.zeros((k_, k_))
    both = there[:, 1:] & there[:, :-1]
    np.add.at(true_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    total, per_lot = there.sum(), max(1, LOT // (WINDOW * k_))
    for _ in range(ROUNDS):
        e = np.add.reduceat(weights[flat], starts, axis=0)
        p = np.exp(e - e.max(1, keepdims=True))
        go = np.exp(moves)
        seen, pair = np.zeros((len(vocabulary), k_)), np.zeros((k_, k_))
        for lot in range(0, n, per_lot):
            x_, there_ = x[lot : lot + per_lot], there[lot : lot + per_lot]
            a, b = np.ones((WINDOW, len(x_), k_)), np.ones((WINDOW, len(x_), k_))
            score = np.where(there_[:, :, None], p[x_], 1.0)
            a[0] = score[:, 0] / score[:, 0].sum(1, keepdims=True)
            for t in range(1, WINDOW):
                v = np.where(there_[:, t, None], (a[t - 1] @ go) * score[:, t], a[t - 1])
                a[t] = v / v.sum(1, keepdims=True)
            for t in range(WINDOW - 2, -1, -1):
                v = np.where(there_[:, t + 1, None], (score[:, t + 1] * b[t + 1]) @ go.T, b[t + 1])
                b[t] = v / v.sum(1, keepdims=True)
            m = a * b
            m /= m.sum(2, keepdims=True)
            for k in range(k_):
                seen[:, k] += np.bincount(x_[there_], m[:, :, k].T[there_], len(vocabulary))
            for t in range(1, WINDOW):  # all pairs' chances, divided by their sum in each sentence
                then = score[:, t] * b[t]
                whole = ((a[t - 1] @ go) * then).sum(1)
                pair += go * ((a[t - 1] * (there_[:, t] / whole)[:, None]).T @ then)
        by_word = (truth - seen) / total * 1000
        g = np.stack([np.bincount(flat, np.repeat(by_word[:, k], sizes), len(weights)) for k in range(k_)], 1) - DECAY * weights
        step_w += g * g
        weights += RATE * g / np.sqrt(step_w)
        g = (true_moves - pair) / total * 1000
        step_m += g * g
        moves += RATE * g / np.sqrt(step_m)
    return Model(langs, weights.astype(np.float32), moves, lexicon)


class Tagger:
    """Marginals with a model, holding the scores of the words met so far."""

    def __init__(self, model: Model):
        self.model, self.go = model, np.exp(model.moves)
        self.held: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    def _learn(self, words: set[str]) -> None:
        if len(self.held) > HELD:
            self.held.clear()
            self.scores = self.scores[:0]
        new = []
        for w in words:
            if any(map(str.isalpha, w)):
                self.held[w] = len(self.scores) + len(new)
                new.append(w)
            else:
                self.held[w] = -1
        if new:
            e = emissions(new, self.model.weights, self.model.lexicon)[0].astype(np.float64)
            self.scores = np.concatenate([self.scores, np.exp(e - e.max(1, keepdims=True))])

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's words as rows of the scores."""
        words = [WORD.findall(t.lower()) for t in texts]
        held = self.held
        if unknown := {w for ws in words for w in ws if w not in held}:
            if len(held) > HELD:
                unknown = {w for ws in words for w in ws}
            self._learn(unknown)
        out = []
        for ws in words:
            r = np.fromiter(map(held.__getitem__, ws), np.int64, len(ws))
            out.append(r[r >= 0])
        return out

    def word_labels(self, text: str) -> list[tuple[str, str]]:
        """(word, language) of each word that has a letter, as in code-switched text."""
        words = [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]
        each: list[np.ndarray] = []
        self.marginals(self.rows([text]), each)
        return [(w, self.model.langs[int(k)]) for w, k in zip(words, each[0] if each else ())]

    def marginals(self, rows: list[np.ndarray], labels: list[np.ndarray] | None = None) -> np.ndarray:
        """Mean marginals of each text; zeros for one without words. labels takes the best label of each word, by text with words."""
        k = len(self.model.langs)
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), k))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        blocks = -(-sizes[full] // BLOCK)
        first = np.cumsum(blocks) - blocks
        n = int(blocks.sum())
        there = np.zeros((n, BLOCK), bool)
        score = np.ones((n, BLOCK, k))
        flat_there, flat_score = there.reshape(-1), score.reshape(-1, k)
        for f, i in zip(first, full):
            flat_there[f * BLOCK : f * BLOCK + sizes[i]] = True
            flat_score[f * BLOCK : f * BLOCK + sizes[i]] = self.scores[rows[i]]
        score, there = score.transpose(1, 0, 2).copy(), there.T.copy()
        product = np.tile(np.eye(k), (n, 1, 1))
        for t in range(BLOCK):
            v = (product @ self.go) * score[t][:, None, :]
            v /= v.max((1, 2), keepdims=True)
            product = np.where(there[t][:, None, None], v, product)
        before, after = np.full((n, k), 1.0 / k), np.ones((n, k))
        longest = np.argsort(-blocks, kind="stable")
        first, blocks = first[longest], blocks[longest]
        for j in range(1, int(blocks[0])):
            live = int(np.searchsorted(-blocks, -j, side="left"))
            at = first[:live] + j
            v = np.einsum("nk,nkl->nl", before[at - 1], product[at - 1])
            before[at] = v / v.sum(1, keepdims=True)
        for j in range(int(blocks[0]) - 2, -1, -1):
            live = int(np.searchsorted(-blocks, -(j + 1), side="left"))
            at = first[:live] + j
            v = np.einsum("nkl,nl->nk", product[at + 1], after[at + 1])
            after[at] = v / v.sum(1, keepdims=True)
        ahead = np.empty((BLOCK, n, k))
        a = before
        for t in range(BLOCK):
            v = (a @ self.go) * score[t]
            a = np.where(there[t][:, None], v / v.sum(1, keepdims=True), a)
            ahead[t] = a
        sums, best = np.zeros((n, k)), np.zeros((n, BLOCK), np.int64)
        b = after
        for t in range(BLOCK - 1, -1, -1):
            m = ahead[t] * b
            if labels is not None:
                best[:, t] = m.argmax(1)
            sums += np.where(there[t][:, None], m / m.sum(1, keepdims=True), 0)
            v = (score[t] * b) @ self.go.T
            b = np.where(there[t][:, None], v / v.sum(1, keepdims=True), b)
        out[full] = np.add.reduceat(sums, np.sort(first), axis=0) / sizes[full][:, None]
        if labels is not None:
            labels += [best.reshape(-1)[f * BLOCK : f * BLOCK + sizes[i]] for f, i in zip(np.sort(first), full)]
        return out

    def predicted(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        langs = self.model.langs
        block: list[str] = []
        letters = 0

        def done(block: list[str]) -> Iterator[tuple[str, float]]:
            for m in self.marginals(self.rows(block)):
                yield (langs[int(m.argmax())], float(min(1.0, m.max()))) if m.any() else ("und", 0.0)

        for t in texts:
            block.append(t or "")
            letters += len(block[-1])
            if letters >= LETTERS:
                yield from done(block)
                block, letters = [], 0
        yield from done(block)


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4


def sample(docs: DataFrame, per_lang: int | None = None, passage: int = PASSAGE) -> list[tuple[str, str]]:
    """(language, passage) of about per_lang passages of each language there is, never more than twice that."""
    passages = F.ceil(F.length("text") / passage).cast("int")
    teach = docs.where("lang is not null and text is not null").where(remainder() != 2).select("doc_id", "lang", "text", passages.alias("n")).where("n > 0")
    counts = teach.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row a language
    if not counts:
        return []
    per_lang = per_lang or max(LEAST, min(PER_LANG, WORK // len(counts) ** 2))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["n"])) for r in counts], "lang string, share double")
    drawn = lambda i: F.pmod(F.xxhash64(F.lit("draw"), F.col("doc_id"), i), F.lit(1_000_003)) / 1_000_003
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: drawn(i) < F.col("share"))
    parts = F.transform(places, lambda i: F.struct(drawn(i).alias("drawn"), F.col("doc_id").alias("doc_id"), i.alias("i"), F.substring(F.col("text"), i * passage + 1, F.lit(passage)).alias("part")))
    chosen = teach.join(F.broadcast(shares), "lang").select("lang", F.explode(parts).alias("p")).select("lang", "p.*")
    rows = chosen.orderBy("drawn", "doc_id", "i", "part").limit(2 * per_lang * len(counts))
    return [(r[0], r[1]) for r in rows.select("lang", "part").toArrow().to_pandas().itertuples(index=False)]


def predictions(spark: SparkSession, model: Model, text: str = "text"):
    """A column: struct of lang_pred and score for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        tagger = held(("languages", id(model)), lambda: Tagger(model)) if model.langs else None
        for texts in batches:
            out = list(tagger.predicted(t.as_py() for t in texts)) if tagger else [("und", 0.0)] * len(texts)
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["lang_pred", "score"])

    return run.asNondeterministic()(text)  # else a filter on it would have it computed twice


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) to doc_id, held_out, lang_pred, score."""
    model = fitted(sample(docs))
    out = docs.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), predictions(spark, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def language_stage(spark: SparkSession, docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is known with a score of at least `least`."""
    model = fitted(sample(docs.select("doc_id", "text", "lang")))
    (p,) = fresh(docs, "_p")
    known = (F.col(p)["lang_pred"] != "und") & (F.col(p)["score"] >= least)
    return docs.withColumn(p, predictions(spark, model)).where(known).select(*docs.columns)
