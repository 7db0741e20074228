"""Language identification with a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character n-grams and, if it is
frequent in the training sample, the word itself; transitions between the languages of
adjacent words are learned. Training sequences are spans of labelled documents put
together, so that languages change inside them as in code-switched text. Forward-
backward gives each word a probability for each language; a document's language is the
one with the greatest mean over its words, and its score is that mean.

The model is fitted on at most ``docs_per_lang`` documents of each language, in the
order of a hash of their id, and at most ``spans_per_doc`` spans of each. Prediction
reads every row's whole text, and nothing but the text.

A word's score is the sum over all its features, however long it is. (In training a word of
more than ``SLOTS`` features, some sixty bytes, is learned from its first ones.) Texts of any
length are labelled whole, word by word.

Edge cases: null texts and texts without a letter (Unicode categories L) are ``und`` with
score 0, whatever digits, fractions or marks they hold; other characters only part words;
of languages with equal means the first by name is taken; without any labelled document
every text with letters is ``und`` with score 0; repeated rows are judged alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import crf
from tidemark.llm.common import by_batch, thinned

#: Runs of letters, and of what Unicode counts as numbers but not as decimal digits.
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
SLOTS = 64
#: Words whose emissions a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Words that are decoded at once.
AT_ONCE = 400_000


def words_in(text: str | None) -> list[str]:
    """Runs of letters."""
    words = WORD.findall(text or "")
    if words and not text.isascii() and not all(map(str.isalpha, words)):
        return [w for x in words for w in (x if x.isalpha() else "".join(c if c.isalpha() else " " for c in x)).split()]
    return words


def word_features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Feature numbers of a word: affixes, all n-grams, and the word itself if it is in the lexicon.

    They are of the lower-cased word's UTF-8 bytes; the second argument of the hash keeps
    the kinds of features apart.
    """
    w = word.lower()
    b, crc = w.encode(), zlib.crc32
    inner = {b[i : i + 3] for i in range(1, len(b) - 2)}
    out = [crc(b[:1], 1), crc(b[:2], 2), crc(b[:3], 3), crc(b[-1:], 4), crc(b[-2:], 5), crc(b[-3:], 6), crc(b[-4:], 7)]
    if w in lexicon:
        out.append(crc(b, 9))
    return [h % BUCKETS for h in out] + [crc(g, 8) % BUCKETS for g in sorted(inner)]


@dataclass
class LangModel:
    langs: list[str]
    lexicon: frozenset[str]
    weight: np.ndarray
    transit: np.ndarray
    known: dict = field(default_factory=dict)
    rows: np.ndarray = None

    def __post_init__(self):
        self.rows = np.zeros((0, len(self.langs)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, each computed once and remembered by word."""
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                self.rows, new = self.rows[:0], list(set(words))
            numbers = [word_features(w, self.lexicon) for w in new]
            known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            size = np.fromiter(map(len, numbers), np.int64, len(numbers))
            flat = np.fromiter((f for x in numbers for f in x), np.int64, int(size.sum()))
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.weight[flat], np.cumsum(size) - size)])
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def label_words(self, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
        """For each text its words with the most likely language and its probability."""
        split = [words_in(t) for t in texts]
        p, _ = crf.posteriors(self.emissions([w for x in split for w in x]), np.array([len(x) for x in split]), self.transit)
        best, at, out = p.argmax(axis=1), 0, []
        for x in split:
            out.append([(w, self.langs[best[at + i]], float(p[at + i, best[at + i]])) for i, w in enumerate(x)])
            at += len(x)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, pending, size = ["und"] * len(texts), [0.0] * len(texts), [], 0

        def decode() -> None:
            lengths = np.array([len(w) for _, w in pending])
            p, _ = crf.posteriors(self.emissions([w for _, x in pending for w in x]), lengths, self.transit)
            means = np.add.reduceat(p, np.cumsum(lengths) - lengths) / lengths[:, None]
            for (i, _), mean in zip(pending, means):
                langs[i], scores[i] = self.langs[int(mean.argmax())], min(1.0, float(mean.max()))

        for i, text in enumerate(texts if self.langs else []):
            words = words_in(text)
            if not words:
                continue
            pending.append((i, words))
            size += len(words)
            if size >= AT_ONCE:
                decode()
                pending, size = [], 0
        if pending:
            decode()
        return langs, scores


def fit(rows: list[tuple[str, str]], spans_per_doc: int = 6, span_words: int = 25, seed: int = 3) -> LangModel:
    """A model from (text, lang) rows."""
    rnd = random.Random(seed)
    langs = sorted({lang for _, lang in rows})
    spans, counts = [], {}
    for text, lang in sorted(rows):
        words = words_in(text)
        for w in words:
            counts[w.lower()] = counts.get(w.lower(), 0) + 1
        for _ in range(min(spans_per_doc, 1 + len(words) // span_words) if words else 0):
            at = rnd.randrange(max(1, len(words) - span_words + 1))
            spans.append((words[at : at + rnd.randrange(3, span_words + 1)], langs.index(lang)))
    if not spans:
        return LangModel([], frozenset(), np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    lexicon = frozenset(w for w, n in counts.items() if n >= 5)
    rnd.shuffle(spans)
    sequences, left = [], list(spans)
    while left:  # one to three spans make a sequence
        n = rnd.randrange(1, 4)
        sequences.append(left[:n])
        left = left[n:]
    words = [w for s in sequences for x, _ in s for w in x]
    labels = np.array([y for s in sequences for x, y in s for _ in x])
    lengths = np.array([sum(len(x) for x, _ in s) for s in sequences])
    numbers = {w: word_features(w, lexicon)[:SLOTS] for w in set(words)}
    slots = max(map(len, numbers.values()))
    features = list(np.array([numbers[w] + [-1] * (slots - len(numbers[w])) for w in words]).T)
    weight, transit = crf.fit(features, lengths, labels, BUCKETS, len(langs), epochs=6, seed=seed)
    return LangModel(langs, lexicon, weight, transit)


def train(docs: DataFrame, docs_per_lang: int = 150) -> LangModel:
    """A model from a bounded sample of the documents that have a text and a lang."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = [(r.lang, r["count"]) for r in rows.groupBy("lang").count().collect()]  # one row per language
    sizes = docs.sparkSession.createDataFrame(counts, "lang string, rows long")
    some = thinned(rows.join(F.broadcast(sizes), "lang"), ["doc_id", "text"], docs_per_lang, F.col("rows"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang)
    return fit([(r.text, r.lang) for r in chosen.select("text", "lang").collect()])


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(by_batch(one), f"doc_id {kind}, lang_pred string, score double")
