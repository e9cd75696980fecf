"""Subject areas of documents: complement naive Bayes on labelled documents, refined by expectation-maximisation over
all documents, with calibrated independent posteriors.

The unit of the model is the sentence, since a subject counts once a text deals with it in two sentences. A document's labels
tell which subjects its sentences may have; EM finds out which sentence has which, and which have none.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import Scratch

#: Hashed features of the model; its size, and that of all statistics on the driver, is FEATURES times the subjects.
FEATURES = 1 << 17
#: Labelled documents that the calibration looks at, at most, chosen by hash.
CALIBRATION_DOCS = 8_192
#: EM rounds over labelled documents, then over all; weight of a document without labels in the latter.
LABELLED_ROUNDS, ALL_ROUNDS, UNLABELLED_WEIGHT = 4, 3, 0.3
#: Additive smoothing, and how far a label set may lack subjects, all that it doesn't name together.
SMOOTHING, LABEL_DOUBT = 0.1, 0.22
#: How far a document with subjects admits sentences without one. At 1 a subject's words may drift to none altogether.
NONE_ADMITTED = 0.5
#: A feature says nothing if its commonest class has at most the first share of it, and counts in full from the second on.
FADE = 0.4, 0.7

_FENCE = re.compile(r"```.*?```", re.S)
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|<\|[^|<>\n]{0,40}\|>|&(?:[a-z]{2,8}|#\d{1,6});|​|﻿")
_TRACE = re.compile(r"^\s*(?:at \S+ \(|File \"|Traceback\b).*$", re.M)
_DATE = re.compile(r"^[^\S\n]*\[?\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)?(?:\]|(?=[\s:,–-]))[:,]?[^\S\n]*", re.M)
_LEAD = re.compile(r"^\s*(?:[>*+\-•#|]+\s*|\d+[.)]\s+|\w{1,20}\d*:\s+(?=\S))+", re.M)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+(?=[^\W\d_a-zß-öø-ÿ]|[`\"'“«(¿¡\d])|\n+(?=\s*(?:[^\W\d_a-zß-öø-ÿ]|[`\"'“«(¿¡]|\d))|\n{2,}(?=\s*$)")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")


def sentences(text: str) -> list[str]:
    """The sentences of a text without code fences, stack traces, mark-up and line prefixes, dates among these.

    A fence that isn't closed is text. A line that begins in lower case goes on with the sentence before it.
    """
    text = _FENCE.sub("\n", text)
    text = _TRACE.sub("", text)
    text = _DATE.sub("", text)
    text = _MARKUP.sub(" ", text)
    text = _LEAD.sub("", text)
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


class _Words(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh32_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = found
        return found


_words = _Words()


def features_of(texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(features, features of each sentence) of texts given as sentences: hashed words and pairs of neighbouring words, in lower case, each once a
    sentence; identifiers are cut into their words. Sentences without words are left out."""
    ids: list[int] = []
    words_in: list[int] = []
    in_text: list[int] = []
    known, word = _words, _WORD.findall
    for found in texts:
        before = len(words_in)
        for sentence in _CAMEL.sub(" ", "\0".join(found)).split("\0") if found else ():
            parts = word(sentence.lower())
            if parts:
                ids += map(known.__getitem__, parts)
                words_in.append(len(parts))
        in_text.append(len(words_in) - before)
    single = np.array(ids, dtype=np.uint64)
    sentence = np.repeat(np.arange(len(words_in)), words_in)
    joined = np.flatnonzero(sentence[1:] == sentence[:-1])
    pairs = ((single[joined] * np.uint64(0x9E3779B1) + single[joined + 1] * np.uint64(0x85EBCA77)) >> np.uint64(7)) + np.uint64(1)
    value, owner = np.r_[single, pairs], np.r_[sentence, sentence[joined]]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, dtype=bool)
    feats = (value[fresh] % np.uint64(FEATURES)).astype(np.int32)
    lens = np.bincount(owner[fresh], minlength=len(words_in)).astype(np.int32)
    cuts = np.r_[0, np.cumsum(in_text)].astype(np.int64)
    at = np.r_[0, np.cumsum(lens)]
    return [feats[at[a] : at[z]] for a, z in zip(cuts, cuts[1:])], [lens[a:z] for a, z in zip(cuts, cuts[1:])]


def features(sentence: str) -> np.ndarray:
    """The features of one sentence."""
    return features_of([[sentence]])[0][0]


class Model:
    """Log odds of each feature between a class and its complement; the last class is no subject at all."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes, self.totals = counts, sizes, counts.sum(0)
        self.weights = self.weights_of(counts, self.totals)
        self.prior = np.log((sizes + 1) / (sizes.sum() + len(sizes))).astype(np.float32)

    @staticmethod
    def weights_of(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Weights of some features (rows) with these expected counts, of which all features together have ``totals``."""
        inside = counts + SMOOTHING
        outside = counts.sum(1, keepdims=True) - counts + SMOOTHING
        p = np.log(inside / (totals + FEATURES * SMOOTHING))
        q = np.log(outside / (totals.sum() - totals + FEATURES * SMOOTHING))
        # Words of all subjects, as those of set phrases, only add noise: what they say is faded out.
        purity = ((counts + SMOOTHING / 10) / (counts.sum(1, keepdims=True) + SMOOTHING)).max(1, keepdims=True)
        return ((p - q) * np.clip((purity - FADE[0]) / (FADE[1] - FADE[0]), 0, 1)).astype(np.float32)

    def lean(self) -> Model:
        """The same without its counts, which only training and calibration need."""
        out = copy.copy(self)
        out.counts = out.sizes = out.totals = None
        return out

    def without(self, feats: np.ndarray, lens: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Sentence by class scores of a document by the model that would be left without it; ``shares`` are its sentences' posteriors in training."""
        used, at = np.unique(feats, return_inverse=True)
        per_feature = np.repeat(shares, lens, axis=0)
        own = np.stack([np.bincount(at, weights=per_feature[:, c], minlength=len(used)) for c in range(shares.shape[1])], axis=1)
        weights = self.weights_of(np.maximum(self.counts[used] - own, 0), np.maximum(self.totals - own.sum(0), 0))
        return _sums(weights[at], lens)

    def scores(self, feats: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sentence by class; ``feats`` holds the features of sentences of ``lens`` features, one after another."""
        return _sums(self.weights[feats], lens)


def _sums(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sums of ``lens`` consecutive rows each."""
    if not len(lens):
        return np.zeros((0, rows.shape[1]), dtype=np.float32)
    at = np.r_[0, np.cumsum(lens)[:-1]]
    total = np.add.reduceat(np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), np.minimum(at, len(rows)), axis=0)
    total[lens == 0] = 0
    return total


def posteriors(scores: np.ndarray, prior: np.ndarray, docs: np.ndarray, allowed: np.ndarray, count: int, doubt: float) -> np.ndarray:
    """Sentence by class. ``docs`` is the document of each sentence, ``allowed`` document by class how far labels admit it. A
    document's own shares of classes are estimated in a few steps and weigh in; a subject needs ``doubt`` more log odds than none."""
    share = np.exp(prior)[None, :] * allowed
    share /= share.sum(1, keepdims=True)
    scores = scores + np.r_[np.zeros(scores.shape[1] - 1), doubt]
    scores = scores - scores.max(1, keepdims=True) if len(scores) else scores
    like = np.exp(scores)
    size = np.bincount(docs, minlength=count)[:, None]
    r = like
    for _ in range(3):
        r = like * share[docs]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        mass = np.zeros((count, like.shape[1]))
        np.add.at(mass, docs, r)
        start = np.exp(prior)[None, :] * allowed
        share = (mass + 2.0 * start / start.sum(1, keepdims=True)) / (size + 2.0)
    return r


def at_least_two(r: np.ndarray, docs: np.ndarray, count: int) -> np.ndarray:
    """Document by class: the probability that two or more sentences have the class, and thus (as log odds) evidence for it."""
    r = np.clip(r, 1e-7, 1 - 1e-6)
    none = np.zeros((count, r.shape[1]))
    np.add.at(none, docs, np.log1p(-r))
    odds = np.zeros((count, r.shape[1]))
    np.add.at(odds, docs, r / (1 - r))
    p = np.clip(1 - np.exp(none) * (1 + odds), 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


#: Labelled documents that take part in training, at most, chosen by hash; their label sets are broadcast.
LABELLED_DOCS = 50_000
#: How many more log odds a subject needs than none in the final posteriors, and the share of wrong labels that calibration expects.
FINAL_DOUBT, LABEL_NOISE = 3.0, 0.04

#: How strongly a subject's curve is held to that of all subjects, in documents.
CURVE_PRIOR = 20.0

_FEATURES_SCHEMA = "doc_id bigint, labels array<int>, feats array<int>, lens array<int>"


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        feats, lens = features_of([sentences(text or "") for text in f["text"]])
        yield pd.DataFrame({"doc_id": f["doc_id"], "labels": f["labels"], "feats": feats, "lens": lens})


def _flat(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, features of each sentence, document of each sentence) of a batch."""
    feats = np.concatenate([np.asarray(x, dtype=np.int64) for x in f["feats"]]) if len(f) else np.zeros(0, dtype=np.int64)
    per_doc = [np.asarray(x, dtype=np.int64) for x in f["lens"]]
    lens = np.concatenate(per_doc) if per_doc else np.zeros(0, dtype=np.int64)
    return feats, lens, np.repeat(np.arange(len(f)), [len(x) for x in per_doc])


def _allowed(labels: pd.Series, classes: int) -> np.ndarray:
    """Document by class: 1 where the labels admit a class, its part of LABEL_DOUBT where not; all 1 without labels. None is always admitted, by NONE_ADMITTED beside subjects."""
    out = np.ones((len(labels), classes))
    for k, given in enumerate(labels):
        if given is not None:
            out[k, :-1] = LABEL_DOUBT / (classes - 1)
            out[k, np.asarray(given, dtype=np.int64)] = 1.0
            out[k, -1] = NONE_ADMITTED if len(given) else 1.0
    return out


def _expected(model_of, classes: int):
    """Expected counts of features by class over a partition, as few rows: feature -1 has the sentences of each class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of.value if model_of else None
        counts, sizes = np.zeros((FEATURES, classes)), np.zeros(classes)
        for f in frames:
            feats, lens, docs = _flat(f)
            if not len(lens):
                continue
            allowed = _allowed(f["labels"], classes)
            if model is None:
                r = (allowed / allowed.sum(1, keepdims=True))[docs]
            else:
                r = posteriors(model.scores(feats, lens), model.prior, docs, allowed, len(f), 0.0)
            weight = np.where(f["labels"].isna().to_numpy(), UNLABELLED_WEIGHT, 1.0)
            r = r * weight[docs][:, None]
            rows = np.repeat(np.arange(len(lens)), lens)
            for c in range(classes):
                counts[:, c] += np.bincount(feats, weights=r[rows, c], minlength=FEATURES)
            sizes += r.sum(0)
        used = np.flatnonzero(counts.any(1))
        table = np.vstack([sizes, counts[used]])
        yield pd.DataFrame({"feature": np.r_[-1, used].astype(np.int32)} | {f"c{k}": table[:, k] for k in range(classes)})

    return run


def _fit(spark: SparkSession, featured: DataFrame, model: Model | None, classes: int) -> Model:
    """One EM round: posteriors by ``model``, expected counts per partition, their sum on the driver: FEATURES rows at most."""
    shared = spark.sparkContext.broadcast(model.lean()) if model else None
    names = [f"c{k}" for k in range(classes)]
    schema = "feature int, " + ", ".join(f"{n} double" for n in names)
    sums = featured.select("labels", "feats", "lens").mapInPandas(_expected(shared, classes), schema).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    counts, sizes = np.zeros((FEATURES, classes)), np.zeros(classes)
    at = sums["feature"].to_numpy()
    table = sums[names].to_numpy()
    counts[at[at >= 0]] = table[at >= 0]
    sizes += table[at < 0].sum(0)
    if shared:
        shared.unpersist()
    return Model(counts, sizes)


def _evidence(model_of, classes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of.value
        for f in frames:
            feats, lens, docs = _flat(f)
            r = posteriors(model.scores(feats, lens), model.prior, docs, np.ones((len(f), classes)), len(f), FINAL_DOUBT)
            z = at_least_two(r[:, :-1], docs, len(f))
            yield pd.DataFrame({"doc_id": f["doc_id"], "odds": list(z)})

    return run


def _held_out(model_of, classes: int):
    """Evidence on labelled documents by the model that is left without each: what it adds to the expected counts is taken out of them before it is scored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of.value
        for f in frames:
            allowed = _allowed(f["labels"], classes)
            every = np.ones((1, classes))
            out = []
            for k, (feats, lens) in enumerate(zip(f["feats"], f["lens"])):
                feats, lens = np.asarray(feats, dtype=np.int64), np.asarray(lens, dtype=np.int64)
                one = np.zeros(len(lens), dtype=np.int64)
                if not len(lens):
                    out.append(at_least_two(np.zeros((0, classes - 1)), one, 1)[0])
                    continue
                shares = posteriors(model.scores(feats, lens), model.prior, one, allowed[k : k + 1], 1, 0.0)
                r = posteriors(model.without(feats, lens, shares), model.prior, one, every, 1, FINAL_DOUBT)
                out.append(at_least_two(r[:, :-1], one, 1)[0])
            yield pd.DataFrame({"labels": f["labels"], "odds": out})

    return run


_SLOPES, _OFFSETS = np.array([0.25, 0.5, 0.75, 1.0, 1.5, 2.0]), np.arange(-3, 3.01, 0.25)


def _calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each subject the slope and offset of a logistic curve from evidence to labels of which LABEL_NOISE are wrong: the likeliest of a grid. First for all
    subjects together; then for each by itself, held to that by as much as CURVE_PRIOR documents, so that a subject with few labels has the common curve."""
    z = np.clip(z, -8, 8)
    fit = np.zeros((len(_SLOPES), len(_OFFSETS), z.shape[1]))
    for i, slope in enumerate(_SLOPES):
        for j, offset in enumerate(_OFFSETS):
            p = LABEL_NOISE + (1 - 2 * LABEL_NOISE) / (1 + np.exp(-(slope * z + offset)))
            fit[i, j] = np.log(np.where(y, p, 1 - p)).sum(0)
    together = fit.sum(2)
    i, j = np.unravel_index(np.argmax(together), together.shape)
    away = np.log(_SLOPES / _SLOPES[i])[:, None] ** 2 + (_OFFSETS - _OFFSETS[j])[None, :] ** 2
    own = fit - CURVE_PRIOR / 2 * away[:, :, None]
    best = own.reshape(-1, z.shape[1]).argmax(0)
    return np.stack([_SLOPES[best // len(_OFFSETS)], _OFFSETS[best % len(_OFFSETS)]], axis=1)


def subject_posteriors(spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, posterior): for every document with text and every subject, the calibrated probability that two or
    more of its sentences deal with the subject. Each subject has a curve of its own, fitted to labelled documents each of which is scored without its own part in the model. Depends on the text alone, so equal texts have equal posteriors.

    ``subjects`` is the closed list (subject); ``labels`` (doc_id, subject) may be wrong in part, be several for a document, and
    name no subject by null. Labels of unknown subjects and documents are ignored. Null, empty and blank texts and null
    doc_ids give no rows; without any usable label there is nothing to learn and no row. Texts are turned into features once and written;
    each EM round reads these and brings FEATURES rows at most to the driver, whatever the corpus' size.
    """
    names = [r[0] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]
    classes = len(names) + 1
    schema = "doc_id bigint, subject string, posterior double"
    empty = spark.createDataFrame([], schema)
    if not names:
        return empty
    scratch = Scratch(spark, "subjects")
    place = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    known = labels.where("doc_id IS NOT NULL").select("doc_id", "subject", F.try_element_at(place, F.col("subject")).alias("k")).where("k IS NOT NULL OR subject IS NULL")
    sets = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("labels")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_DOCS)
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").where(F.length(F.trim("text")) > 0)
    featured = scratch.cut(texts.join(F.broadcast(sets), "doc_id", "left").select("doc_id", "labels", "text").mapInPandas(_featured, _FEATURES_SCHEMA))
    labelled = featured.where("labels IS NOT NULL")
    if labelled.isEmpty():
        return empty
    model = None
    for _ in range(LABELLED_ROUNDS + 1):
        model = _fit(spark, labelled, model, classes)
    for _ in range(ALL_ROUNDS):
        model = _fit(spark, featured, model, classes)
    shared = spark.sparkContext.broadcast(model)
    bounded = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCS)
    seen = bounded.mapInPandas(_held_out(shared, classes), "labels array<int>, odds array<double>").toPandas()
    z = np.array([np.asarray(o) for o in seen["odds"]])
    y = np.zeros(z.shape, dtype=bool)
    for k, given in enumerate(seen["labels"]):
        y[k, np.asarray(given, dtype=np.int64)] = True
    curves = F.array(*[F.struct(F.lit(float(a)).alias("slope"), F.lit(float(b)).alias("offset")) for a, b in _calibration(z, y)])
    lean = spark.sparkContext.broadcast(model.lean())
    evidence = featured.mapInPandas(_evidence(lean, classes), "doc_id bigint, odds array<double>")
    curve = 1 / (1 + F.exp(-(F.col("o.curve.slope") * F.col("o.odds") + F.col("o.curve.offset"))))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("subject"), F.col("odds"), curves.alias("curve"))
    return evidence.select("doc_id", F.explode(pairs).alias("o")).select("doc_id", F.col("o.subject").alias("subject"), curve.alias("posterior"))


def subjects_of(spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects of each document, none, one or several, once each; see ``subject_posteriors``."""
    return subject_posteriors(spark, documents, labels, subjects).where("posterior >= 0.5").select("doc_id", "subject").distinct()
