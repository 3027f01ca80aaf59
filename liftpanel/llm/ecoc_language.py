"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier for each bit reads hashed character n-grams of
the whole text and predicts that bit; decoding chooses the codeword with the least loss, each bit weighted
by how well its classifier does. The classifiers are fitted on a bounded sample of labelled rows
(``rows_each`` for each language, those whose hashed id is least), by ridge regression in closed form.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.llm.common import held_out, worker_state

UNKNOWN = "und"
FEATURES = 4096
ROWS_EACH = 400
#: Parts of a language in which its sample rows are looked for.
PARTS = 64
#: Rows or features that a system takes up at once in double precision.
AT_ONCE = 512
MODULUS, REMAINDER = 4, 2
#: Lower case; all of ASCII that is not a letter becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Share of the sample whose cross-validated margin lies below the least margin of a text that can be told.
DOUBTFUL = 0.01
RESULT = "lang_pred string, score double, margin double, ambiguous boolean, rejected boolean"


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def ngram_shares(texts: list[bytes], features: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed 2- and 3-grams of bytes, a row for each text. No n-gram spans two texts."""
    out = np.zeros((len(texts), features), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
        pairs = b[:-1] << np.uint32(8) | b[1:]
        triples = (pairs[:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        shift = np.uint32(32 - features.bit_length() + 1)
        counts = np.bincount(triples >> shift, minlength=features)
        counts += np.bincount((pairs + np.uint32(1 << 24)) * np.uint32(2246822519) >> shift, minlength=features)
        counts[(0x202020 * 2654435761 & 0xFFFFFFFF) >> int(shift)] = 0  # runs of blanks
        out[i] = np.sqrt(counts / max(1, counts.sum()))
    return out


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each class. Up to 7 classes: every split into two sides once; beyond, the random
    code with the largest least distance of 200, with about 10 log2(classes) bits."""
    if classes <= 7:
        splits = [s for s in product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T.reshape(classes, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    tries = (rng.choice([-1.0, 1.0], (classes, bits)) for _ in range(200))
    return max(tries, key=lambda c: (c[~np.eye(classes, dtype=bool).any(1)] if classes < 2 else bits - (c @ c.T - bits * np.eye(classes))).min())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    bit_weight: np.ndarray
    margin: float

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """Weighted exponential loss of each text against each codeword. Row by row: a product of whole
        batches may round a text's votes by the company it is in."""
        votes = np.array([row @ self.weights for row in ngram_shares(texts, len(self.centre)) - self.centre])
        return np.exp(-votes[:, None, :] * self.code[None]) @ self.bit_weight

    def predict(self, texts: list[bytes]) -> pd.DataFrame:
        known = [bool(self.languages) and has_letter(t) for t in texts]
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "margin": 0.0, "ambiguous": False, "rejected": np.logical_not(known)})
        rows = np.flatnonzero(known)
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            if len(part):
                losses = self.losses([texts[i] for i in part])
                order = np.argsort(losses, axis=1, kind="stable")
                best = np.take_along_axis(losses, order[:, :1], 1)
                shares = 1 / np.exp((best - losses) * 8).sum(1)
                second = np.take_along_axis(losses, order[:, 1:2], 1) if len(self.languages) > 1 else best + 1
                margin = (second - best)[:, 0]
                out.loc[part, "lang_pred"] = np.array(self.languages, object)[order[:, 0]]
                out.loc[part, "score"] = shares
                out.loc[part, "margin"] = margin
                out.loc[part, "ambiguous"] = margin < self.margin
                out.loc[part, "rejected"] = margin < self.margin
        return out


def fit_rows(shares: np.ndarray, langs: list[str], ridge: float = 0.02) -> Model:
    """Ridge regressions of all bits on the sample; the weight of a bit is its share of right signs on the half
    that did not fit it. A text is ambiguous if its margin is below that of all but ``DOUBTFUL`` of the sample rows, each
    judged by the half that did not fit it."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((shares.shape[1], 0)), np.zeros(shares.shape[1], np.float32), np.zeros(0), 0.0)
    code = codewords(len(languages))
    bits = code[[languages.index(x) for x in langs]]
    centre = shares.mean(0)

    def part(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return (x - centre).astype(float)

    def solve(x: np.ndarray, y: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The sample stays in single precision; the smaller of the two systems, with the same solution, is summed up."""
        rows, columns = ([slice(i, i + AT_ONCE) for i in range(0, n, AT_ONCE)] for n in x.shape)
        system = np.zeros((min(x.shape), min(x.shape)))
        if len(x) > x.shape[1]:
            known = np.zeros((x.shape[1], y.shape[1]))
            for r in rows:
                own = part(x[r], centre)
                system += own.T @ own
                known += own.T @ y[r]
        else:
            known = y
            for c in columns:
                own = part(x[:, c], centre[c])
                system += own @ own.T
        system[np.diag_indices(len(system))] += ridge
        solved = np.linalg.solve(system, known)
        return solved if len(x) > x.shape[1] else np.concatenate([part(x[:, c], centre[c]).T @ solved for c in columns])

    even = np.arange(len(langs)) % 2 == 0
    right, votes = np.ones(code.shape[1]), np.zeros_like(bits)
    if 0 < even.sum() < len(langs):
        for half in (even, ~even):
            other = shares[~half].mean(0)
            solved, at = solve(shares[~half], bits[~half], other), np.flatnonzero(half)
            for i in range(0, len(at), AT_ONCE):
                votes[at[i : i + AT_ONCE]] = (shares[at[i : i + AT_ONCE]] - other) @ solved
        right = (votes * bits > 0).mean(0)
    bit_weight = np.maximum(right - 0.5, 1e-3)
    model = Model(languages, code, solve(shares, bits, centre).astype(np.float32), centre.astype(np.float32), bit_weight / max(bit_weight.sum(), 1e-9), 0.0)
    if len(languages) > 1:
        losses = np.sort(np.exp(-votes[:, None, :] * code[None]) @ model.bit_weight, axis=1)
        model.margin = float(np.quantile(losses[:, 1] - losses[:, 0], DOUBTFUL))
    return model


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = ROWS_EACH) -> Model:
    """Fit on at most ``rows_each`` rows of every language among those where ``learn`` holds, text and language given."""
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    names = usable.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    # First in parts of a language, then the first of these: a hot language is many windows, and the last one sees at most
    # `PARTS * rows_each` ids, however many rows and partitions there are.
    first = names.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("n") <= rows_each)
    chosen = Window.partitionBy("lang").orderBy(*order)
    sample = first.withColumn("n", F.row_number().over(chosen)).where(F.col("n") <= rows_each).select("doc_id", "lang").distinct()
    texts = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language")
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            rows = [zlib.compress(ngram_shares([t])[0].tobytes(), 1) if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "lang", "shares"])

    kind = docs.schema[id_col].dataType.simpleString()
    # At most `rows_each` short rows for each language; most shares are zero, so they travel packed.
    rows = texts.join(F.broadcast(sample), ["doc_id", "lang"]).mapInArrow(run, f"doc_id {kind}, lang string, shares binary").where("shares is not null").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["shares"]))
    shares = np.empty((len(rows), FEATURES), np.float32)
    for i, row in enumerate(rows):
        shares[i] = np.frombuffer(zlib.decompress(row["shares"]), np.float32)
    langs = [r["lang"] for r in rows]
    del rows
    return fit_rows(shares, langs)


def predicted(text: Column, model: Model) -> Column:
    """Struct ``lang_pred, score, margin, ambiguous, rejected`` for a text column. Null, empty and letterless
    texts are ``und`` with score 0, as is every text if nothing was learned. Rejected are those and
    ambiguous texts, however short."""

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        worker_state("language")
        return model.predict([t.encode() if t is not None else b"" for t in texts])

    return predict(text.cast("string"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = ROWS_EACH) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, ambiguous, rejected`` for every row.

    Rows whose id's crc32 is 2 modulo 4 are held out of learning, so are rows without an id or a language. A
    prediction sees the text alone. Repeated rows give repeated rows, an empty table an empty one.
    """
    out = held_out(F.col(id_col), MODULUS, REMAINDER)
    model = fit(docs, ~out, id_col, text_col, lang_col, rows_each)
    return docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), predicted(F.col(text_col), model).alias("p")).select("doc_id", "held_out", "p.*")
