"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of the hashed embeddings of itself and of its beginnings, filters of several widths slide over the
words of a text, the largest answer of each filter is kept (max pooling) and a logistic layer weighs them. Scores are
shifted by the language that function words suggest, so one threshold serves all languages; the language, the source,
the labels and the id of a row are never inputs.
"""

from __future__ import annotations

import copy
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice, pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import ddl, discard, map_rows, release, stored

WORD = re.compile(r"[^\W\d_]+")
WIDTHS = (1, 2, 3)
#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "was", "with"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "mit"),
    "fr": ("le", "les", "et", "des", "une", "du", "est", "dans", "pour"),
    "es": ("el", "los", "y", "del", "una", "por", "se", "que", "las"),
}
LANGUAGES = tuple(FUNCTION_WORDS)
_VOTE = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words}
#: Places of a filter: its width's number and offset, in the order of the columns of the filters' matrix.
_PLACES = [(k, j) for k, w in enumerate(WIDTHS) for j in range(w)]
REACH = max(WIDTHS) - 1
#: Documents, and bytes of them, that a task puts in another order at once; texts of a step.
BUFFER, BUFFER_BYTES, STEP = 1024, 16 << 20, 32
#: Changes are added up as whole numbers of this part, so their order doesn't matter; rows of the table in a block of them.
UNIT, BLOCK = 2.0**20, 4096
#: Logits are counted by bins of this width, within these bounds.
BIN, FARTHEST = 1 / 1024, 64.0
#: Words that are scored at once, and words that a worker keeps answers for.
RUN, KEPT = 50_000, 200_000
THRESHOLD = 0.7


@dataclass
class Settings:
    """The model is learnt from all labelled rows; sample_rows and sample_bytes, both or none, bound them for a trial."""

    sample_rows: int | None = None
    sample_bytes: int | None = None
    share_rows: int = 16_000
    share_bytes: int = 48 << 20
    bits: int = 18
    size: int = 16
    filters: int = 8
    epochs: int = 5
    dropout: float = 0.8
    rate: float = 0.1
    least_docs: int = 3
    seed: int = 7


#: Checksums that those of a word and of its beginnings of 3, 4 and 5 letters go on from.
_WHOLE, _STARTS = crc32(b"w"), tuple((n, crc32(str(n).encode())) for n in (3, 4, 5))


@lru_cache(KEPT)
def _beginnings(start: str, bits: int) -> tuple[int, ...]:
    """Rows of the embedding table for the beginnings of a word, from its first five letters."""
    mask = (1 << bits) - 1
    return tuple(1 + (crc32(start[:n].encode(), k) & mask) for n, k in _STARTS)


def features(word: str, bits: int) -> list[int]:
    """Rows of the embedding table: the word and its beginnings of 3, 4 and 5 letters."""
    return [1 + (crc32(word.encode(), _WHOLE) & (1 << bits) - 1), *_beginnings(word[:5], bits)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Words(defaultdict):
    """Numbers of words as they are met; by number, after :meth:`learn`, their features and votes for a language."""

    def __init__(self, bits: int) -> None:
        super().__init__(count().__next__)
        self.bits, self.learnt = bits, 0
        self.rows, self.votes = np.zeros((1024, 4), np.int32), np.full(1024, -1, np.int8)

    def forget(self) -> None:
        self.clear()
        self.default_factory, self.learnt = count().__next__, 0

    def numbers(self, words: Collection[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def learn(self) -> slice:
        """Take in the words met since; their numbers."""
        at, n = slice(self.learnt, len(self)), len(self) - self.learnt
        new = list(islice(reversed(self), n))[::-1]
        self.rows, self.votes = enlarged(self.rows, len(self), 0), enlarged(self.votes, len(self), -1)
        whole = np.fromiter(map(crc32, map(str.encode, new), repeat(_WHOLE)), np.uint32, n)
        self.rows[at, 0] = 1 + (whole & np.uint32((1 << self.bits) - 1))
        starts = map(_beginnings, [w[:5] for w in new], repeat(self.bits))
        self.rows[at, 1:] = np.fromiter(chain.from_iterable(starts), np.int32, 3 * n).reshape(-1, 3)
        self.votes[at] = np.fromiter(map(_VOTE.get, new, repeat(-1)), np.int8, n)
        self.learnt = len(self)
        return at


def enlarged(x: np.ndarray, n: int, fill: int) -> np.ndarray:
    """The array, or one of n rows at least that begins with it and goes on with ``fill``."""
    if n <= len(x):
        return x
    return np.concatenate([x, np.full((max(n, 2 * len(x)) - len(x), *x.shape[1:]), fill, x.dtype)])


class Model:
    """The trained parameters; small enough to broadcast: their size is set by Settings alone."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s, self.name = s, uuid.uuid4().hex
        self.table = rng.normal(0, 0.1, ((1 << s.bits) + 1, s.size)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, s.size, s.filters)).astype(np.float32) for w in WIDTHS]
        self.offsets = np.zeros(len(WIDTHS) * s.filters, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * s.filters).astype(np.float32)
        self.bias = np.float32(-1)
        self.cut = {lang: 0.0 for lang in (*LANGUAGES, "")}
        self.slope = 1.0

    def score(self, logit: float, lang: str) -> float:
        x = self.slope * (logit - self.cut[lang]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def language(votes: np.ndarray) -> str:
    """The language with most function words; the first of several, and none without any."""
    return LANGUAGES[int(votes.argmax())] if len(votes) and votes.max() > 0 else ""


def fit(texts: list[str | None], labels: list[int], s: Settings) -> Model:
    """Train on three quarters of the rows and calibrate the thresholds on the rest. Without both labels all score low."""
    model = Model(s)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return rejecting(model)
    docs, langs, words = [], [], Words(s.bits)
    for t in texts:
        vocab, ids, lang = encoded(t, words)
        docs.append((vocab, ids))
        langs.append(lang)
    seen = np.zeros(len(model.table), np.int64)
    for vocab, _ in docs:
        seen[np.unique(vocab)] += 1
    known = restrict(model, seen)
    docs = [(np.where(known[vocab], vocab, 0), ids) for vocab, ids in docs]
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(docs))
    held, train = order[::4], np.setdiff1d(order, order[::4])
    if y[held].min() == y[held].max() or y[train].min() == y[train].max():
        held = train = order
    weight = weights(y[train].mean())
    learner = Learner(model)
    for _ in range(s.epochs):
        learner.learn([docs[i] for i in train], y[train], weight, rng)
    learner.finish()
    columns = columns_of(model)
    logits = [forward(model, columns, *docs[i])[0] for i in held]
    calibrate(model, binned(logits, [langs[i] for i in held], y[held]))
    return model


def rejecting(model: Model) -> Model:
    """A model by which all texts score low."""
    model.cut = {k: 30.0 for k in model.cut}
    return model


def weights(mean: float) -> tuple[float, float]:
    """What rows of the labels 0 and 1 count in a step, so that both labels count alike."""
    return 0.5 / max(1 - mean, 1e-3), 0.5 / max(mean, 1e-3)


def encoded(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray, str]:
    """The features of the different words of a text, the places' words by number, and the language.

    ``words`` keeps those of the texts before; they are forgotten when they are too many.
    """
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words_of(text)], np.int32)
    if len(words) > KEPT:
        words.forget()
    known = words.numbers(index)
    words.learn()
    votes = words.votes[known][ids]
    return words.rows[known], ids, language(np.bincount(votes[votes >= 0], minlength=len(LANGUAGES)))


def restrict(model: Model, seen: np.ndarray) -> np.ndarray:
    """Which features are in enough texts; the others are zero: what few texts hold can't be told from chance."""
    known = seen >= model.s.least_docs
    known[0] = False
    model.table[~known] = 0
    return known


def columns_of(m: Model) -> np.ndarray:
    """The filters as one matrix, with columns by width, offset and filter."""
    return np.concatenate([m.filters[k][j] for k, j in _PLACES], axis=1)


def forward(m: Model, columns: np.ndarray, vocab: np.ndarray, ids: np.ndarray) -> tuple:
    """The logit of a text, the pooled answers, where they are, the words' embeddings and the places' words.

    A word number past the vocabulary is no word.
    """
    f = m.s.filters
    words = np.zeros((len(vocab) + 1, m.s.size), np.float32)
    for c in range(vocab.shape[1]):
        words[:-1] += m.table[vocab[:, c]]
    pooled, at = np.zeros(len(m.out), np.float32), np.full(len(m.out), -1)
    ids = np.append(ids, np.full(REACH, len(vocab), ids.dtype))
    if len(ids) > REACH:
        answers, pooled = columns.T @ words.T, np.full(len(m.out), -np.inf, np.float32)
        for i in range(0, len(ids) - REACH, RUN):  # a long text goes in pieces
            part = answers.take(ids[i : i + RUN + REACH], axis=1)
            n = part.shape[1] - REACH
            z = np.empty((len(m.out), n), np.float32)
            for c, (k, j) in enumerate(_PLACES):
                own, more = z[k * f : (k + 1) * f], part[c * f : (c + 1) * f, j : j + n]
                if j:
                    own += more
                else:
                    own[:] = more
            top = z.argmax(1)
            best = z[np.arange(len(top)), top]
            at, pooled = np.where(best > pooled, top + i, at), np.maximum(best, pooled)
        pooled = np.maximum(pooled + m.offsets, 0)
    return float(pooled @ m.out + m.bias), pooled, at, words, ids


class Learner:
    """AdaGrad by small steps; only the words at a filter's largest answer get a gradient.

    ``table`` and ``dense`` are the parameters, the filters, offsets, last layer and bias in one vector; ``sums`` belong to them.
    """

    def __init__(self, m: Model, table_sums: np.ndarray | None = None, dense_sums: np.ndarray | None = None) -> None:
        self.m, f = m, m.s.filters
        self.shapes = [(m.s.size, len(_PLACES) * f), (len(m.out),), (len(m.out),), (1,)]
        self.dense = np.concatenate([x.ravel() for x in (columns_of(m), m.offsets, m.out, np.array([m.bias]))]).astype(np.float32)
        self.table_sums = np.full_like(m.table, 1e-2) if table_sums is None else table_sums
        self.dense_sums = np.full_like(self.dense, 1e-2) if dense_sums is None else dense_sums
        self.decay = np.where(np.arange(len(self.dense)) < len(self.dense) - 1, 1e-5, 0).astype(np.float32)
        self.touched = np.zeros(len(m.table), bool)
        # of each column of the filters its filter and offset
        self.filter = np.concatenate([np.arange(k * f, (k + 1) * f) for k, _ in _PLACES])
        self.offset = np.repeat([j for _, j in _PLACES], f)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """The views of a vector as filters, offsets, last layer and bias."""
        cuts = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        return [v.reshape(s) for v, s in zip(np.split(x, cuts), self.shapes, strict=True)]

    def learn(self, docs: list, y: np.ndarray, weight: tuple[float, float], rng) -> None:
        """One pass over documents (vocabulary, places' words), in a random order."""
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // STEP)):
            self.step([docs[i] for i in batch], y[batch], weight, rng)

    def step(self, docs: list, y: np.ndarray, weight: tuple[float, float], rng) -> None:
        m = self.m
        columns, m.offsets, m.out, bias = self.parts(self.dense)
        m.bias = bias[0]
        grad = np.zeros_like(self.dense)
        g_columns, g_off, g_out, g_bias = self.parts(grad)
        rows, changes = [], []
        for (vocab, ids), label in zip(docs, y, strict=True):
            gone = rng.random(len(ids)) < rng.random() * m.s.dropout  # each telling word must do without the others
            logit, pooled, at, words, ids = forward(m, columns, vocab, np.where(gone, len(vocab), ids))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) * weight[int(label)] / len(docs)
            g_out += g * pooled
            g_bias += g
            down = (g * m.out * (pooled > 0)).astype(np.float32)
            g_off += down
            on = np.flatnonzero(down[self.filter])
            if len(on):
                of = ids[at[self.filter[on]] + self.offset[on]]
                on, of = on[of < len(vocab)], of[of < len(vocab)]
                g_on = down[self.filter[on], None]
                g_columns[:, on] += (g_on * words[of]).T
                rows.append(vocab[of].ravel())
                changes.append(np.repeat(g_on * columns.T[on], vocab.shape[1], axis=0))
        self.dense_sums += grad * grad
        self.dense -= m.s.rate * (grad + self.decay * self.dense) / np.sqrt(self.dense_sums)
        if rows:
            r = np.concatenate(rows)
            order = np.argsort(r, kind="stable")
            r, first = np.unique(r[order], return_index=True)
            if len(r):
                g = np.add.reduceat(np.concatenate(changes)[order], first, axis=0)
                g[r == 0] = 0  # words that the model doesn't know
                self.table_sums[r] += g * g
                m.table[r] -= m.s.rate * g / np.sqrt(self.table_sums[r])
                self.touched[r] = True

    def finish(self) -> None:
        """Put the parameters into the model."""
        m, f = self.m, self.m.s.filters
        columns, m.offsets, m.out, bias = (x.copy() for x in self.parts(self.dense))
        m.bias = bias[0]
        for c, (k, j) in enumerate(_PLACES):
            m.filters[k][j] = columns[:, c * f : (c + 1) * f]


def binned(logits: list[float], langs: list[str], y: np.ndarray) -> dict:
    """(language, bin): rows of label 0, rows of label 1, least and largest logit."""
    out: dict[tuple[str, int], list] = {}
    for z, lang, label in zip(logits, langs, y, strict=True):
        own = out.setdefault((lang, int(np.floor(np.clip(z, -FARTHEST, FARTHEST) / BIN))), [0, 0, z, z])
        own[int(label)] += 1
        own[2:] = min(own[2], z), max(own[3], z)
    return out


def calibrate(m: Model, bins: dict) -> None:
    """Set the model's cuts: a language with less than five toxic rows gets that of all."""
    every: dict[int, list] = {}
    by: dict[str, dict[int, list]] = {}
    for (lang, k), own in bins.items():
        by.setdefault(lang, {})[k] = own
        at = every.setdefault(k, [0, 0, own[2], own[3]])
        every[k] = [at[0] + own[0], at[1] + own[1], min(at[2], own[2]), max(at[3], own[3])]
    m.cut[""] = _cut(every)
    for lang in LANGUAGES:
        own = by.get(lang, {})
        m.cut[lang] = _cut(own) if sum(x[1] for x in own.values()) >= 5 else m.cut[""]


def _cut(bins: dict[int, list]) -> float:
    """The logit that parts the labels with the least error; the middle of the gap around it."""
    clean, toxic, least, most = (np.array(x) for x in zip(*(bins[k] for k in sorted(bins)), strict=True))
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    low = most[k - 1] if k else least[0] - 1
    high = least[k] if k < len(least) else most[-1] + 1
    return float((low + high) / 2)


class Scorer:
    """Scores texts with a model; answers of words that were seen are kept, up to a bound."""

    def __init__(self, m: Model) -> None:
        self.m = m
        self.columns = columns_of(m)
        self._reset()

    def _reset(self) -> None:
        self.words = Words(self.m.s.bits)
        self.words.numbers([""])  # number 0 is no word: its answers stay zero
        self.words.learn()
        self.answers = np.zeros((1024, self.columns.shape[1]), np.float32)

    def _learn(self) -> None:
        new = self.words.learn()
        self.answers = enlarged(self.answers, len(self.words), 0)
        for i in range(new.start, new.stop, 20_000):
            at = slice(i, min(new.stop, i + 20_000))
            sums = np.zeros((at.stop - i, self.m.s.size), np.float32)
            for rows in self.words.rows[at].T:
                sums += self.m.table[rows]
            self.answers[at] = sums @ self.columns

    def scores(self, texts: list[str | None]) -> Iterator[float]:
        if len(self.words) > KEPT:
            self._reset()
        found = [self.words.numbers(words_of(t)) for t in texts]
        self._learn()
        best = np.zeros((len(texts), len(self.m.out)), np.float32)
        votes = np.zeros((len(texts), len(LANGUAGES)), np.int64)
        reach = max(WIDTHS) - 1
        pieces, held = [], 0
        for doc, ids in enumerate(found):
            v = self.words.votes[ids]
            votes[doc] = np.bincount(v[v >= 0], minlength=len(LANGUAGES))
            for i in range(0, len(ids), RUN):  # a text longer than a run goes in pieces that overlap by a filter
                pieces.append((doc, ids[i : i + RUN + reach], min(RUN, len(ids) - i)))
                held += len(pieces[-1][1])
                if held >= RUN:
                    self._pool(pieces, best)
                    pieces, held = [], 0
        self._pool(pieces, best)
        logits = np.maximum(best, 0) @ self.m.out + self.m.bias
        for z, v in zip(logits, votes, strict=True):
            yield self.m.score(float(z), language(v))

    def _pool(self, pieces: list, best: np.ndarray) -> None:
        if not pieces:
            return
        reach, f = max(WIDTHS) - 1, self.m.s.filters
        pad = np.zeros(reach, np.int32)
        ids = np.concatenate([y for _, x, _ in pieces for y in (x, pad)])
        starts = np.cumsum([0] + [len(x) + reach for _, x, _ in pieces])[:-1]
        bounds = np.stack([starts, starts + [n for _, _, n in pieces]], 1).ravel()
        answers = self.answers[ids]
        n, col, out = len(ids) - reach, 0, []
        for w in WIDTHS:
            z = answers[:n, col : col + f].copy()
            for j in range(1, w):
                z += answers[j : j + n, col + j * f : col + (j + 1) * f]
            col += w * f
            out.append(np.maximum.reduceat(np.concatenate([z, z[-1:]]), bounds, axis=0)[::2])
        pooled = np.concatenate(out, axis=1) + self.m.offsets
        np.maximum.at(best, [doc for doc, _, _ in pieces], pooled)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on all labelled rows that aren't held out.

    Null ids or labels are left out; an id with several labels counts as toxic if one says so, and of several texts the
    smallest is taken. The rows are encoded once, by Spark; counts of features, steps and thresholds are taken over all
    of them. A share of share_rows rows and share_bytes bytes of text, about, is learnt by one task at a time; after each
    pass the changes that the shares made are averaged, those of a word's features over the shares that changed them. A
    quarter of the rows, by a hash of the id, calibrates. The driver holds what is as large as the model, and no text.
    """
    s = settings or Settings()
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where("toxic in (0, 1)")
    )
    if s.sample_rows is not None and s.sample_bytes is not None:
        return _tried(docs, labels, usable, s)
    texts = docs.where(~held_out("doc_id")).select("doc_id", "text").join(usable, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = _encoded_rows(texts, s)
    model = Model(s)
    counts = rows.groupBy("calibrates", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    if {r.toxic for r in counts} != {0, 1}:
        discard(rows)
        return rejecting(model)
    apart = len(counts) == 4  # both parts have both labels
    trained, held = (rows.where(~F.col("calibrates")), rows.where("calibrates")) if apart else (rows, rows)
    own = [r for r in counts if not (apart and r.calibrates)]
    weight = weights(sum(r.n for r in own if r.toxic) / sum(r.n for r in own))
    shares = max(1, *(-(-sum(r[c] for r in own) // most) for c, most in (("n", s.share_rows), ("bytes", s.share_bytes))))
    seen = np.zeros(len(model.table), np.int64)
    found = rows.select(*READ).mapInArrow(_occurrences(len(seen)), "row int, n bigint").groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    seen[found["row"].to_numpy()] = found["n"].to_numpy()
    known = restrict(model, seen)
    learner = Learner(model)
    for epoch in range(s.epochs):
        _pass(trained.coalesce(shares).select(*READ), learner, known, weight, epoch)
    learner.finish()
    shared = docs.sparkSession.sparkContext.broadcast((model, known))
    bins = held.select(*READ).mapInArrow(_logits(shared), "lang string, bin int, clean bigint, toxic bigint, least double, most double")
    bins = bins.groupBy("lang", "bin").agg(F.sum("clean"), F.sum("toxic"), F.min("least"), F.max("most")).collect()
    calibrate(model, {(r[0], r[1]): list(r[2:]) for r in bins})
    discard(rows)
    return model


def _encoded_rows(texts: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, toxic, calibrates, bytes, lang, vocab, ids): a row for each text, stored."""
    bits = s.bits

    def make() -> Callable:
        words = Words(bits)

        def some(keys: list, toxic: list, calibrates: list, sizes: list, values: list):
            for *rest, text in zip(keys, toxic, calibrates, sizes, values, strict=True):
                vocab, ids, lang = encoded(text, words)
                yield *rest, lang, vocab.tobytes(), ids.tobytes()

        return some

    out = texts.select(
        "doc_id",
        F.col("toxic").cast("int").alias("toxic"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrates"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        "text",
    )
    kinds = f"{ddl(out, 'doc_id')}, toxic int, calibrates boolean, bytes bigint, lang string, vocab binary, ids binary"
    return stored(map_rows(out, out.columns, kinds, make), "labelled", 1)


READ = ("toxic", "lang", "vocab", "ids")


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """Label, language, vocabulary and places' words of encoded rows."""
    toxic, lang, vocab, ids = batch.columns
    for i in range(batch.num_rows):
        yield toxic[i].as_py(), lang[i].as_py(), np.frombuffer(vocab[i].as_py(), np.int32).reshape(-1, 4), np.frombuffer(ids[i].as_py(), np.int32)


def _occurrences(size: int) -> Callable:
    """In how many texts of a task each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            for _, _, vocab, _ in _read(b):
                seen[np.unique(vocab)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["row", "n"])
        release()

    return run


def _pass(rows: DataFrame, learner: Learner, known: np.ndarray, weight: tuple[float, float], epoch: int) -> None:
    """One pass of all shares from the same parameters, which then change by what the shares changed on average.

    The changes are dealt by blocks of the table's rows; block -1 has the other parameters.
    """
    m, spark = learner.m, rows.sparkSession
    size, s = m.s.size, m.s
    held = spark.sparkContext.broadcast((m, known, np.flatnonzero(known), learner.table_sums[known], learner.dense_sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known, at, sums, dense_sums = held.value
        table_sums = np.full_like(start.table, 1e-2)
        table_sums[at] = sums
        own = copy.deepcopy(start)
        mine = Learner(own, table_sums, dense_sums.copy())
        dense = mine.dense.copy()
        rng = np.random.default_rng((s.seed, epoch, TaskContext.get().partitionId()))
        docs, labels, size_, some = [], [], 0, False
        for b in batches:
            for label, _, vocab, ids in _read(b):
                docs.append((np.where(known[vocab], vocab, 0), ids))
                labels.append(label)
                size_ += vocab.nbytes + ids.nbytes
                if len(docs) >= BUFFER or size_ > BUFFER_BYTES:
                    mine.learn(docs, np.array(labels), weight, rng)
                    docs, labels, size_, some = [], [], 0, True
        if docs:
            mine.learn(docs, np.array(labels), weight, rng)
            some = True
        if some:
            before = np.full_like(table_sums, 1e-2)
            before[at] = sums
            r = np.flatnonzero(mine.touched & known)
            p, q = own.table[r] - start.table[r], table_sums[r] - before[r]
            edges = np.searchsorted(r, np.arange(0, len(known) + BLOCK, BLOCK))
            parts = [(k, r[i:j], p[i:j], q[i:j]) for k, (i, j) in enumerate(pairwise(edges)) if i < j]
            fill = -len(dense) % size
            p, q = (np.pad(x, (0, fill)).reshape(-1, size) for x in (mine.dense - dense, mine.dense_sums - dense_sums))
            parts.append((-1, np.arange(len(p)), p, q))
            cells = [(k, packed(np.diff(rows, prepend=0)), packed(in_units(p)), packed(in_units(q))) for k, rows, p, q in parts]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(*x) for x in zip(zip(*cells, strict=True), kinds, strict=True)], names=["block", "at", "p", "q"])
        release()

    def added(shares: pa.Table) -> pa.Table:
        """The changes of a block, averaged by row over the shares that changed it."""
        n, total = np.zeros(0, np.int64), np.zeros((0, 2 * size), np.int64)
        low = max(shares["block"][0].as_py(), 0) * BLOCK
        for at, p, q in zip(*(shares[c] for c in ("at", "p", "q")), strict=True):
            on = np.cumsum(unpacked(at.as_py())) - low
            n, total = enlarged(n, on[-1] + 1, 0), enlarged(total, on[-1] + 1, 0)
            n[on] += 1
            total[on] += np.concatenate([unpacked(x.as_py()).reshape(-1, size) for x in (p, q)], axis=1)
        on = np.flatnonzero(n)
        mean = (total[on] / UNIT / n[on, None]).astype(np.float32)
        return pa.table({"block": shares["block"][:1], "at": [(on + low).tobytes()], "mean": [mean.tobytes()]})

    found = rows.mapInArrow(run, "block int, at binary, p binary, q binary")
    # a block is as large as its part of the model, for each share; all averages are as large as the model
    found = found.groupBy("block").applyInArrow(added, "block int, at binary, mean binary").collect()
    for r in found:
        on, mean = np.frombuffer(r.at, np.int64), np.frombuffer(r.mean, np.float32).reshape(-1, 2 * size)
        if r.block >= 0:
            m.table[on] += mean[:, :size]
            learner.table_sums[on] += mean[:, size:]
        else:
            learner.dense += mean[:, :size].ravel()[: len(learner.dense)]
            learner.dense_sums += mean[:, size:].ravel()[: len(learner.dense)]
    learner.finish()
    held.destroy()


def in_units(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(float) * UNIT).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in few bytes: signs go last, then all first bytes, all second bytes and so on, compressed."""
    x = x.astype(np.int64).ravel()
    planes = ((x << 1) ^ (x >> 63)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _logits(shared) -> Callable:
    """Counts of the labels by language and bin of the logit; see :func:`binned`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value
        columns = columns_of(m)
        for b in batches:
            z, langs, labels = [], [], []
            for label, lang, vocab, ids in _read(b):
                z.append(forward(m, columns, np.where(known[vocab], vocab, 0), ids)[0])
                langs.append(lang)
                labels.append(label)
            bins = binned(z, langs, labels)
            cells = [[*k, *v] for k, v in bins.items()]
            kinds = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], f.type) for i, f in enumerate(kinds)], schema=kinds)
        release()

    return run


def _tried(docs: DataFrame, labels: DataFrame, usable: DataFrame, s: Settings) -> Model:
    """Fit on a sample, for a trial: the settings' number of ids with the lowest hash, toxic ones a third at most, and of
    their texts, in the order of a hash, those that still fit into sample_bytes; the bytes are counted first."""
    spark = docs.sparkSession
    ids = []
    for toxic, n in ((1, s.sample_rows // 3), (0, s.sample_rows - s.sample_rows // 3)):
        picked = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids += [(r.doc_id, int(r.toxic)) for r in picked.collect()]
    chosen = spark.createDataFrame(ids, f"{ddl(labels, 'doc_id')}, _toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic"))
    texts = stored(texts, "sample")  # sample_rows texts at most
    fitting, held = [], 0
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    for r in sorted(sizes, key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id)):
        if held + r.n <= s.sample_bytes:
            held += r.n
            fitting.append((r.doc_id,))
    fitting_ids = F.broadcast(spark.createDataFrame(fitting, ddl(labels, "doc_id")))  # sample_rows ids at most
    rows = sorted(texts.join(fitting_ids, "doc_id").collect(), key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id))
    return fit([r.text for r in rows], [r._toxic for r in rows], s)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows that labels are never learnt from: crc32 of the id as text has the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


_LOADED: dict[str, Scorer] = {}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also..., score double): one row for each input row, over its whole text.

    A null, empty or wordless text gets the score of no words; nulls in the key stay; columns that ``also`` doesn't name
    are ignored. No shuffle; the model is broadcast, its size doesn't depend on the data.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [key, *also]

    def make() -> Callable:
        if (name := held.value.name) not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Scorer(held.value)
        scorer = _LOADED[name]

        def some(texts: list, *rest: list):
            for x, *values in zip(scorer.scores(texts), *rest, strict=True):
                yield *values, x

        some.done = _LOADED.clear  # what a worker keeps would stay while other operators run in it
        return some

    # a text that is kept is read twice, under two names
    chosen = docs.select(F.col(text).alias("_text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)))
    out = map_rows(chosen, chosen.columns, f"{ddl(docs, *kept)}, _score double", make)
    return out.withColumnRenamed("_score", "score")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7 on)."""
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
