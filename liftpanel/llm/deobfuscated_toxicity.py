"""Toxicity of whole texts, after undoing leetspeak, spacing and repetition.

A disguised word is a message sent over a noisy channel. Its characters span a lattice: a digit or sign may
stand for letters, a separator for nothing, a run of one letter for one or two of it. The likeliest path under
a character trigram model (Viterbi over the last two letters) is the restored word. The model counts all
trigrams of letters of the whole corpus; their number is bounded by the alphabet. Words and word beginnings of
the restored text are the features of a logistic regression, fitted on a bounded sample of labelled rows
(``ROWS_EACH`` for each label, those whose hashed id is least); the prior of all labelled rows is kept by weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import held_out, in_groups, written

MODULUS, REMAINDER = 5, 0
ROWS_EACH, FEATURES = 4000, 400
REMEMBERED = 400_000
PREFIXES = range(3, 9)

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
# What signs stand for, and signs that part the letters of a word.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
PARTING = ".-_*~'"
LEET_COST, PARTING_COST, REPEAT_COST = 1.5, 0.5, 1.0

SYMBOLS = len(LETTERS) + 1
TO_SYMBOL = bytes(LETTERS.index(c) + 1 if (c := bytes([b]).decode("latin-1")) in LETTERS else 0 for b in range(256))
WORD = re.compile(rf"[{LETTERS}]+")
THRICE = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all trigrams of lower-case letters, a blank for anything else, over all texts whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for group in in_groups(t.lower().encode("latin-1", "replace") for t in batch.column(0).to_pylist() if t):
                s = np.frombuffer(b" ".join([b"", *group, b""]).translate(TO_SYMBOL), np.uint8).astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "place long, n long")
    out = np.zeros(SYMBOLS**3)
    for row in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row["place"]] = row["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log chance of a symbol after two others; trigrams, bigrams and single symbols mixed, as far as the two were seen."""

    def share(n: np.ndarray) -> np.ndarray:
        return n / np.maximum(n.sum(-1, keepdims=True), 1)

    single = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    mixed = 0.8 * share(counts) + 0.15 * share(counts.sum(0))[None] + 0.05 * single
    return np.log(mixed / mixed.sum(-1, keepdims=True)).astype(np.float32)


def edges_stripped(token: str) -> str:
    """Without marks around the word; a sign that may stand for its first letter stays."""
    start, stop = 0, len(token)
    while stop and not token[stop - 1].isalnum():
        stop -= 1
    while start < stop and not token[start].isalnum() and not (token[start] in LEET and token[start + 1].isalpha()):
        start += 1
    return token[start:stop]


def disguised(token: str) -> bool:
    return any(c.isalpha() for c in token) and (WORD.fullmatch(token) is None or THRICE.search(token) is not None)


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest path through the token's lattice, letters only. A blank in it parts letters of a word, or two
    words, which then stay parted in the result; the character model has the cost of a word's end."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    at = 0
    while at < len(token):
        c = token[at]
        run = at + 1
        while run < len(token) and token[run] == c:
            run += 1
        n, at = run - at, run
        choices: list[tuple[str, float]] = []
        if c == " ":
            choices = [("", 0.0), (" ", 0.0)]
        if c in LETTERS:
            choices = [(c, REPEAT_COST * (n > 1)), *([(c + c, REPEAT_COST * (n > 2))] if n > 1 else [])]
        for letter in LEET.get(c, ""):
            choices += [(letter, LEET_COST), *([(letter + letter, LEET_COST)] if n > 1 else [])]
        if c in PARTING or not choices:
            choices.append(("", PARTING_COST))
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, out) in states.items():
            for letters, extra in choices:
                x, y, total = a, b, cost + extra
                for letter in letters:
                    z = LETTERS.index(letter) + 1 if letter != " " else 0
                    total -= float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or (total, out + letters) < after[x, y]:
                    after[x, y] = (total, out + letters)
        states = after
    return min((cost - float(model[a, b, 0]), out) for (a, b), (cost, out) in states.items())[1]


def words_of(token: str, model: np.ndarray) -> list[str]:
    """Words that a token holds, in lower case and without marks; of a disguised one the restored word too."""
    token = edges_stripped(token.lower())
    if not token:
        return []
    if not disguised(token):
        return [token] if WORD.fullmatch(token) else []
    plain = WORD.findall(token)
    return [*plain, r] if (r := restore(token, model)) not in plain else plain


def features_of(words: list[str]) -> list[str]:
    """``=word`` and each beginning of 3 to 8 letters."""
    return [f for w in words if len(w) >= PREFIXES[0] for f in ("=" + w, *(w[:n] for n in PREFIXES if n <= len(w)))]


class TokenFeatures(dict):
    """Features of each token; a token seen again costs one look-up."""

    def __init__(self, model: np.ndarray, known: dict[str, int] | None = None) -> None:
        super().__init__()
        self.model, self.known = model, known

    def __missing__(self, token: str) -> tuple:
        if len(self) > REMEMBERED:
            self.clear()
        found = features_of(self.parted(token) if " " in token else words_of(token, self.model))
        if self.known is not None:
            found = [self.known[f] for f in found if f in self.known]
        self[token] = out = tuple(found)
        return out

    def parted(self, letters: str) -> list[str]:
        """Words of a run of single characters: those of all put together, and of the likeliest parting."""
        together = words_of(letters.replace(" ", ""), self.model)
        if not any(c.isalpha() for c in letters):
            return together
        return [*together, *(w for w in restore(letters.lower(), self.model).split() if w not in together)]

    def count(self, text: str) -> tuple[int, Counter]:
        """Number of tokens, and how often each feature comes; letters parted by blanks are further words."""
        tokens = text.split()
        hits = Counter(f for found in map(self.__getitem__, tokens) if found for f in found)
        for spaced in SPACED.findall(text):
            hits.update(self[" ".join(spaced.split())])
        return len(tokens), hits


def inputs(tokens: int, hits: dict[int, int], size: int) -> np.ndarray:
    """Two inputs for each feature: log of its count, and of its count in 1000 tokens."""
    out = np.zeros(2 * size, np.float32)
    for f, n in hits.items():
        out[f], out[size + f] = math.log1p(n), math.log1p(1000 * n / max(1, tokens))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a ridge; stops when a step moves nothing."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(float)
    beta, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty), slope)
        beta += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return beta[:-1], float(beta[-1])


@dataclass
class Model:
    log_chance: np.ndarray
    known: dict[str, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        memory = TokenFeatures(self.log_chance, self.known)
        size = len(self.known)
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            tokens, hits = memory.count(text)
            if hits:
                out[i] += float(inputs(tokens, hits, size) @ self.weights)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rows_each: int = ROWS_EACH) -> Model:
    """Fit on the rows where ``learn`` (over the id) holds; ``labels (doc_id, toxic)`` with 0 and 1."""
    chance = log_model(trigram_counts(docs, text_col))
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learn)
    # A top-k of each label, which Spark takes in every partition before it moves rows.
    first = [usable.where(F.col("toxic") == i).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_each) for i in (0, 1)]
    sample = first[0].unionByName(first[1])
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # At most `rows_each` short rows for either label.
    sampled = written(texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("toxic", "doc_id", "text"), "toxicity-sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TokenFeatures(chance)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hits = memory.count(text)[1]
                value = np.log1p(np.fromiter(hits.values(), float, len(hits)))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(hits), pa.int32()), pa.array(list(hits), pa.string()), pa.array(value)], ["toxic", "feature", "value"])

    of = lambda label, value: F.sum(F.when(F.col("toxic") == label, value).otherwise(0))
    v = F.col("value")
    sizes = {r["toxic"]: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return Model(chance, {}, np.zeros(0), math.log(share / (1 - share)))
    sums = sampled.mapInArrow(listed, "toxic int, feature string, value double").groupBy("feature").agg(*[of(i, x).alias(f"{name}{i}") for i in (0, 1) for name, x in (("s", v), ("q", v * v), ("d", 1))])
    mean = lambda i, n: F.col(f"s{i}") / n
    spread = lambda i, n: (F.col(f"q{i}") / n - mean(i, n) ** 2) / n
    t = (mean(1, n1) - mean(0, n0)) / F.sqrt(spread(1, n1) + spread(0, n0) + 1e-9)
    top = sums.where("d1 >= 3").withColumn("t", t).where("t > 3").orderBy(F.desc("t"), "feature").limit(FEATURES).collect()
    known = {r["feature"]: i for i, r in enumerate(top)}
    size = len(known)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TokenFeatures(chance, known)
        for batch in batches:
            rows = [inputs(*memory.count(text), size).tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["toxic", "doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sampled.mapInArrow(dense, f"toxic int, doc_id {kind}, x binary").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in rows], float)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    weights, bias = fit_logistic(x, y, weight / weight.mean())
    return Model(chance, known, weights, bias)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = ROWS_EACH) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a score sees the text alone.

    Labels are learned from rows whose id's crc32 is not 0 modulo 5. Null and empty texts get the score of a
    text without any feature. An id labelled twice counts as toxic if one label says so; labels other than 0
    and 1 and rows without an id teach nothing; with labels of one kind or none every score is their share.
    Repeated rows give repeated rows, an empty table an empty one; further columns are not read.
    """
    model = fit(docs, labels.select("doc_id", "toxic"), ~held_out(F.col("doc_id"), MODULUS, REMAINDER), id_col, text_col, rows_each)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t or "" for t in texts]))

    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), MODULUS, REMAINDER).alias("held_out"), scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
