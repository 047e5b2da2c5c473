"""Reading level of documents (problem 10).

Method: every sentence's level is classified by a regularised logistic model over its words and their character
n-grams; the sentences' level distributions are aggregated to the document, and a small regularised logistic model
calibrates the aggregate against the raters' levels.

The models are fitted on the driver from a bounded sample of labelled documents (MOST_LABELLED; of more, those with the
smallest hash of their id). Everything else covers all documents: whole texts are scored, no document is left out.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the models are fitted on, at most; each is read whole.
MOST_LABELLED = 4_000
DIMS = 1 << 15
LEVELS = 3
#: Strength of the L2 penalty of the sentence model and of the calibration.
L2, L2_DOC = 1e-4, 1e-2
_sentence = re.compile(r"[^.!?…]+[.!?…]*")
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, lower case; sentences without words are left out."""
    return [ws for s in _sentence.findall(text.lower()) if (ws := _word.findall(s))]


def grams(word: str) -> list[int]:
    """Hashed features of a word: itself and its character n-grams of 2 to 5 letters with boundaries."""
    w = f"<{word}>"
    out = [zlib.crc32(b"w" + w.encode()) % DIMS]
    out += [zlib.crc32(w[i : i + n].encode()) % DIMS for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class SentenceModel:
    """Multinomial logistic regression; a word's score is the mean of its features' weights, a sentence's the mean of
    its words' scores plus a bias. Words are scored once and kept."""

    def __init__(self):
        self.weights, self.bias, self.known = np.zeros((DIMS, LEVELS), np.float32), np.zeros(LEVELS), {}

    def fit(self, docs: list[list[list[str]]], soft: np.ndarray, rounds: int = 2, steps: int = 120) -> "SentenceModel":
        """docs: each document's sentences; soft: its raters' distribution. After a first fit with the document's
        distribution for each of its sentences, they are weighed against the model's own view and fitted again."""
        vocabulary: dict[str, int] = {}
        s_row, s_word, s_val, owner = [], [], [], []
        for d, ss in enumerate(docs):
            for ws in ss:
                for w in ws:
                    s_row.append(len(owner))
                    s_word.append(vocabulary.setdefault(w, len(vocabulary)))
                    s_val.append(1 / len(ws))
                owner.append(d)
        if not owner:
            return self
        row, word, val, owner = np.array(s_row), np.array(s_word), np.array(s_val), np.array(owner)
        g = [grams(w) for w in vocabulary]
        g_word = np.repeat(np.arange(len(g)), [len(x) for x in g])
        g_feat = np.concatenate([np.array(x) for x in g])
        g_val = np.repeat([1 / math.sqrt(len(x)) for x in g], [len(x) for x in g])
        used, g_feat = np.unique(g_feat, return_inverse=True)
        n, v, f = len(owner), len(g), len(used)
        mul = lambda to, size, at, vals, x: np.stack([np.bincount(to, vals * x[at, c], size) for c in range(LEVELS)], 1)
        sizes = np.bincount(owner, minlength=len(docs))[owner]
        weigh = (1 / np.sqrt(sizes))[:, None]
        weigh = weigh / weigh.sum()
        target = soft[owner]
        theta, bias = np.zeros((f, LEVELS)), np.zeros(LEVELS)
        for again in range(rounds):
            m, s, mb, sb = np.zeros_like(theta), np.zeros_like(theta), np.zeros(LEVELS), np.zeros(LEVELS)
            for t in range(1, steps + 1):
                p = _softmax(mul(row, n, word, val, mul(g_word, v, g_feat, g_val, theta)) + bias)
                err = (p - target) * weigh
                grad = mul(g_feat, f, g_word, g_val, mul(word, v, row, val, err)) + L2 * theta
                gb = err.sum(0)
                m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
                mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
                rate = 0.1 * (1 - t / (steps + 1))
                theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
                bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-6)
            if again + 1 < rounds:
                mixed = p * (0.15 + soft[owner])
                target = mixed / mixed.sum(1, keepdims=True)
        self.weights[used], self.bias = theta, bias
        return self

    def word(self, w: str) -> np.ndarray:
        got = self.known.get(w)
        if got is None:
            g = grams(w)
            got = self.weights[g].sum(0) / math.sqrt(len(g))
            if len(self.known) < 500_000:  # a cache only; further words are scored anew
                self.known[w] = got
        return got

    def document(self, ss: list[list[str]]) -> np.ndarray:
        """Aggregate of the sentences' distributions: means by sentence and by word, and the spread."""
        if not ss:
            return np.zeros(8)
        sizes = np.array([len(ws) for ws in ss])
        scores = np.array([self.word(w) for ws in ss for w in ws])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        p = _softmax(np.add.reduceat(scores, at, axis=0) / sizes[:, None] + self.bias)
        mean, by_word = p.mean(0), (p * sizes[:, None]).sum(0) / sizes.sum()
        return np.concatenate([mean, by_word, [mean[2] - mean[0], by_word[2] - by_word[0]]])


class Calibration:
    """Regularised logistic regression from a document's aggregate to the raters' levels."""

    def fit(self, x: np.ndarray, soft: np.ndarray) -> "Calibration":
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros((z.shape[1], LEVELS))
        for t in range(800):
            self.w -= 0.5 * (1 - t / 800) * (z.T @ (_softmax(z @ self.w) - soft) / len(z) + L2_DOC * np.r_[self.w[:-1], np.zeros((1, LEVELS))] * 0.1)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.w)


def consensus(labels: pd.DataFrame, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc_ids, distributions) from labels(doc_id, rater, level): raters are weighed by how often they agree with the
    others' distribution."""
    labels = labels[labels.level.isin([1, 2, 3])]
    ids, d = np.unique(labels.doc_id.to_numpy(), return_inverse=True)
    who, r = np.unique(labels.rater.fillna("").to_numpy().astype(str), return_inverse=True)
    y = labels.level.to_numpy().astype(int) - 1
    trust = np.full(len(who), 0.8)
    q = np.zeros((len(ids), LEVELS))
    for _ in range(rounds):
        logs = np.zeros((len(ids), LEVELS))
        for c in range(LEVELS):
            logs[:, c] = np.bincount(d, np.where(y == c, np.log(trust[r]), np.log((1 - trust[r]) / 2)), len(ids))
        q = _softmax(logs)
        right = np.bincount(r, q[d, y], len(who))
        trust = np.clip((right + 4) / (np.bincount(r, minlength=len(who)) + 5), 0.5, 0.98)
    return ids, q


def train(texts: dict[int, str], labels: pd.DataFrame) -> tuple[SentenceModel, Calibration] | None:
    """Both models, or None if fewer than two levels are labelled. The calibration sees sentence scores of models that
    didn't see the document (two folds)."""
    ids, soft = consensus(labels)
    keep = np.array([i in texts and bool(sentences(texts[i])) for i in ids], bool) if len(ids) else np.zeros(0, bool)
    ids, soft = ids[keep], soft[keep]
    if len(ids) < 6 or len(set(soft.argmax(1))) < 2:
        return None
    docs = [sentences(texts[i]) for i in ids]
    fold = np.array([zlib.crc32(str(i).encode()) % 2 for i in ids])
    x = np.zeros((len(ids), 8))
    for k in (0, 1):
        part = SentenceModel().fit([d for d, f in zip(docs, fold) if f != k], soft[fold != k])
        for j in np.flatnonzero(fold == k):
            x[j] = part.document(docs[j])
    return SentenceModel().fit(docs, soft), Calibration().fit(x, soft)


def levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, easy, ordinary, demanding, band): the calibrated distribution of every document with text, and its band.

    Null or wordless texts give no row. Without enough labels there are no rows. Repeated texts get equal levels.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lab = labels.where("doc_id IS NOT NULL AND level IN (1, 2, 3)").select("doc_id", "rater", "level")
    chosen = lab.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    lab = lab.join(F.broadcast(chosen), "doc_id").toPandas()
    texts = {r["doc_id"]: r["text"] for r in d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").collect()}
    models = train(texts, lab)
    shared = docs.sparkSession.sparkContext.broadcast((models[0].weights, models[0].bias, models[1]) if models else None)

    def run(batches):
        if shared.value is None:
            return
        model = SentenceModel()
        model.weights, model.bias, calibration = shared.value
        for b in batches:
            parted = [(i, ss) for i, t in zip(b["doc_id"], b["text"]) if (ss := sentences(t))]
            if not parted:
                continue
            p = calibration.predict(np.array([model.document(ss) for _, ss in parted]))
            yield pd.DataFrame({"doc_id": [i for i, _ in parted], "easy": p[:, 0], "ordinary": p[:, 1], "demanding": p[:, 2], "band": p.argmax(1) + 1})

    return d.mapInPandas(run, "doc_id bigint, easy double, ordinary double, demanding double, band int")


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """p10_found: the documents that are on the whole easy (1) or demanding (3)."""
    return levels(docs, labels).where("band <> 2").select("doc_id", "band")
