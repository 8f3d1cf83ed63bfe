"""Language ID (operator 3): averaged hashed subword embeddings with a linear softmax.

The subwords of a text (character n-grams of its words, with word ends marked, and the words) are hashed into
buckets; the mean of their embeddings goes through a linear layer. Both are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows; a fifth of the sample calibrates the temperature of the softmax and
the score under which a text is rejected. As the layers are linear, workers add up products of embedding and layer,
once for each distinct word of their batches.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Size of the model: buckets of the hash, embedding width, lengths of n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 17, 16, (1, 2, 3, 4)
#: Labelled rows that the model is fitted on: so many of each language at most, fewer of each if that were more in all.
SAMPLE_PER_LANGUAGE, SAMPLE = 300, 19_200
#: Different buckets of a row of the sample at most, the most frequent ones: with SAMPLE, this bounds what is collected.
SAMPLE_BUCKETS = 4096
#: Share of the sample that calibrates; both limits of rejection lie so much under the lowest of right texts there.
CALIBRATION, MARGIN = 0.2, 0.9
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Distinct words that a worker remembers; it starts anew beyond.
REMEMBERED = 250_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    lower = text.lower()
    found = _WORD.findall(lower)
    if lower.isascii() or all(map(str.isalpha, found)):
        return found
    # Fractions, numbers in circles, Roman numerals and the like are word characters but no letters.
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1) if n > 1 or 0 < i < len(marked) - 1]
    grams.append(marked)
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


@dataclass
class LanguageModel:
    """``scores``: the product of embedding and layer, a row for each bucket; empty ``labels`` know no language.

    A text is rejected if its score is under ``reject_below``, or if under ``known_below`` of its subwords fall into
    buckets that training has ``seen``.
    """

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    known_below: float = 0.0
    seen: np.ndarray | None = None
    _rows: dict = field(default_factory=dict, repr=False)
    _sums: np.ndarray | None = field(default=None, repr=False)

    def _learn(self, new: list[str]) -> None:
        """Sums over the subwords of words; the last columns count those seen and all."""
        if self._sums is None or len(self._rows) + len(new) > REMEMBERED:
            self._rows.clear()
            self._sums = np.zeros((max(REMEMBERED, len(new)), len(self.labels) + 2), np.float32)
        buckets = [subwords(w) for w in new]
        lengths = np.array([len(b) for b in buckets])
        flat = np.fromiter((b for one in buckets for b in one), np.int64, int(lengths.sum()))
        start = len(self._rows)
        first = np.cumsum(lengths) - lengths
        self._sums[start : start + len(new), :-2] = np.add.reduceat(self.scores[flat], first, axis=0)
        self._sums[start : start + len(new), -2] = np.add.reduceat(self.seen[flat].astype(np.float32), first)
        self._sums[start : start + len(new), -1] = lengths
        self._rows.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted) of each text; ``und``, 0, false without a letter, or if no language is known."""
        found, scores, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.labels:
            return found, scores, known > 0
        cut = [words(t) if t else [] for t in texts]
        seen: set[str] = set()
        for one in cut:
            seen.update(one)
        if new := [w for w in seen if w not in self._rows]:
            if len(self._rows) + len(new) > REMEMBERED:
                new = list(seen)
            self._learn(new)
        rows, sums = self._rows, self._sums
        for i, one in enumerate(cut):
            if one:
                total = sums[np.fromiter(map(rows.__getitem__, one), np.int64, len(one))].sum(axis=0, dtype=np.float64)
                share = softmax((total[:-2] / total[-1] + self.bias) / self.temperature)
                best = int(share.argmax())
                found[i], scores[i], known[i] = self.labels[best], share[best], total[-2] / total[-1]
        return found, scores, (known > 0) & (scores >= self.reject_below) & (known >= self.known_below)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Train on (language, buckets, counts); the order of the rows is that of the steps."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), seen=np.zeros(1, bool))
    rng = np.random.default_rng(SEED)
    target = np.array([labels.index(r[0]) for r in rows])
    weights = [(c / c.sum()).astype(np.float32) for _, _, c in rows]
    embedding = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((len(labels), WIDTH), np.float32), np.zeros(len(labels), np.float32)
    held = np.zeros(len(rows), bool)
    for k in range(len(labels)):  # the same share of each language, but always some to train on
        own = np.flatnonzero(target == k)
        held[rng.permutation(own)[: int(len(own) * CALIBRATION)]] = True
    train = np.flatnonzero(~held)
    balance = len(train) / (len(labels) * np.maximum(1, np.bincount(target[train], minlength=len(labels))))
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, weight = rows[i][1], weights[i]
            mean = weight @ embedding[buckets]
            wrong = softmax(layer @ mean + bias)
            wrong[target[i]] -= 1
            wrong *= min(balance[target[i]], 10.0)
            back = layer.T @ wrong
            layer -= rate * np.outer(wrong, mean)
            bias -= rate * wrong
            # The mean spreads the error thinly; a rate that grows with the number of subwords makes up for it.
            embedding[buckets] -= (rate * len(weight) * weight)[:, None] * back if len(weight) < 64 else (rate * 64 * weight)[:, None] * back
    scores = embedding @ layer.T
    seen = np.zeros(BUCKETS, bool)
    for i in train:
        seen[rows[i][1]] = True
    model = LanguageModel(labels, scores, bias.astype(np.float64), seen=seen)
    check = np.flatnonzero(held) if held.any() else train
    logits = np.array([weights[i] @ scores[rows[i][1]] + bias for i in check], np.float64)
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(check)), target[check]])).mean() + 1e-6 * abs(np.log(t)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    share = softmax(logits / model.temperature)
    right = share.argmax(axis=1) == target[check]
    if right.any() and len(labels) > 1:
        # Never above one half: a text that one language explains better than all others together stays.
        model.reject_below = MARGIN * float(min(0.5, share.max(axis=1)[right].min()))
    if right.any() and held.any():
        model.known_below = MARGIN * float(min(weights[i] @ seen[rows[i][1]] for i in check[right]))
    return model


def train(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on a sample of the labelled rows whose crc32(id as text) mod 4 is not 2, chosen by a hash of the id.

    The sample holds SAMPLE_PER_LANGUAGE rows of each label, whole texts, or with very many labels an equal share of
    SAMPLE (one row at least) of each; of a row, the SAMPLE_BUCKETS most frequent subwords. Null ids, null texts and null labels are not learned from; a table without labelled rows gives an empty model.
    """
    common.ship(docs.sparkSession)
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label"))
    known = known.where("id is not null and text is not null and label is not null").where(~held_out(F.col("id")))
    counts = known.groupBy("label").count().collect()
    if not counts:
        return fit([])
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // len(counts)))
    fine = 1 << 30
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["label"], min(fine, int((1.3 * each + 20) / r["count"] * fine) + 1))))
    drawn = known.withColumn("rank", F.pmod(F.xxhash64("id"), F.lit(fine))).where(F.col("rank") < shares[F.col("label")])

    def features(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for label, rank, text in zip(frame["label"], frame["rank"], frame["text"], strict=True):
                often: dict[str, int] = {}
                for w in words(text):
                    often[w] = often.get(w, 0) + 1
                dense: dict[int, int] = {}
                for w, n in often.items():
                    for b in subwords(w):
                        dense[b] = dense.get(b, 0) + n
                if len(dense) > SAMPLE_BUCKETS:
                    dense = dict(sorted(dense.items(), key=lambda x: (-x[1], x[0]))[:SAMPLE_BUCKETS])
                if dense:
                    out.append((label, rank, np.fromiter(dense, "<i4").tobytes(), np.fromiter(dense.values(), "<i4").tobytes()))
            yield pd.DataFrame(out, columns=["label", "rank", "buckets", "counts"])

    sample = drawn.select("label", "rank", "text").mapInPandas(features, "label string, rank long, buckets binary, counts binary")
    rows, taken = [], {}
    for r in sorted(sample.collect(), key=lambda r: (r["rank"], r["label"], r["buckets"])):
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= each:
            rows.append((r["label"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(np.float64)))
    return fit(rows)


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score and accepted to every row.

    A null text, one without letters, and any text where the model knows no language is ``und`` with score 0, not
    accepted. Other texts are accepted from the calibrated limits on. Repeated rows are predicted each; input columns
    named like the added ones are replaced; an empty table gives an empty result.
    """
    import pyarrow as pa

    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.scores.astype(np.float32), model.bias, model.temperature, model.reject_below, model.known_below, model.seen))
    added = ("lang_pred", "score", "accepted")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in added and (keep_text or c != text_col)]
    inner = docs.select(*others, F.col(f"`{text_col}`").alias("__text"))
    kept = inner.schema.fields[:-1]
    schema = T.StructType([*kept]).add("lang_pred", "string", False).add("score", "double", False).add("accepted", "boolean", False)

    def run(record_batches):
        with common.worker_memory():
            tool = LanguageModel(*sent.value)
            for batch in common.batches(record_batches, "__text"):
                found, scores, accepted = tool.predict(batch.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.string()), pa.array(scores), pa.array(accepted)], names=[f.name for f in schema.fields])

    return inner.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs)
    predicted = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
