"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each trigram, of bytes of letters and gaps, is
drawn from one of them.  Expectation-maximisation estimates the shares from the trigrams'
likelihoods, and the set of languages is the one of the best penalised
likelihood: languages are added one by one while the log-likelihood grows by
more than ``penalty`` times half the logarithm of the number of trigrams.  The
prediction is the language with the largest share; the score is its share.

The model is fitted on a bounded sample of the labelled rows, at most about
``max_docs_per_language`` of each language (a stated parameter; the rows are
chosen by a hash of their id).  Each sampled text counts whole.

Defined results: null text, or text without a letter, is ``und`` with score 0;
so is every text when nothing was learned.  Equal likelihoods go to the language
that sorts first.  Rows with a null id are neither held out nor learned from; repeated
rows are learned from, and judged, one by one.  Texts of any length are read whole.  An
empty table gives an empty one.  Other columns are carried through, where the results
replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import arrays

#: Trigrams are counted in this many hashed cells.
CELLS = 1 << 16

#: Letters of any script keep their (lower-cased) bytes; all else is a gap.
_LETTER = arrays.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_FOLD = np.where(_LETTER, arrays.LOWER, 32).astype(np.uint8)


def trigrams(data: np.ndarray) -> np.ndarray:
    """The cells of a text's trigrams, with a gap at either end; those of gaps only are left out."""
    folded = np.concatenate(([32], _FOLD[data], [32])).astype(np.uint32)
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    code = code[folded[1:-1] != 32]
    return (code * np.uint32(2654435769)) >> np.uint32(16)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Mixture:
    """Trigram likelihoods of each language, and the mixture inference over them."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5, penalty: float = 8.0, steps: int = 40):
        self.languages, self.penalty, self.steps = languages, penalty, steps
        total = counts.sum(axis=1, keepdims=True)
        self.log_p = np.log((counts + smoothing) / (total + smoothing * CELLS)).T.copy() if languages else np.zeros((CELLS, 0))

    def _fit(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the columns of p by expectation-maximisation, and the log-likelihood."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total, last = n.sum(), -np.inf
        for _ in range(self.steps):
            joint = p * share
            mass = joint.sum(axis=1)
            now = float(n @ np.log(mass))
            if now - last < 1e-3:
                break
            last = now
            share = (n / mass) @ joint / total
        return share, now

    def shares(self, data: np.ndarray) -> dict[int, float]:
        """Estimated share of each language in the chosen set."""
        cells, n = np.unique(trigrams(data), return_counts=True)
        if not len(cells) or not self.languages:
            return {}
        logs = self.log_p[cells]
        single = n @ logs
        chosen, best, share = [int(np.argmax(single))], float(single.max()), np.ones(1)
        shift = logs.max(axis=1, keepdims=True)
        p, base = np.exp(logs - shift), float(n @ shift[:, 0])
        cost = self.penalty * 0.5 * np.log(n.sum())
        while len(chosen) < len(self.languages):
            # the slope towards each language outside the set: without one upwards none can help
            mix = p[:, chosen] @ share
            slope = (n / mix) @ p - n.sum()
            slope[chosen] = -np.inf
            order = [int(i) for i in np.argsort(-slope, kind="stable") if slope[i] > 0]
            if not order:
                break
            fits = [(self._fit(p[:, [*chosen, i]], n), i) for i in order]
            (new, value), i = max(fits, key=lambda x: (x[0][1], -x[1]))
            if value + base - best <= cost:
                break
            chosen, best, share = [*chosen, i], value + base, new
        return dict(zip(chosen, share.tolist(), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0
        shares = self.shares(np.frombuffer(text.encode(), dtype=np.uint8))
        if not shares:
            return "und", 0.0
        i = min(shares, key=lambda k: (-shares[k], self.languages[k]))
        return self.languages[i], min(1.0, max(0.0, shares[i]))


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs_per_language: int = 2000, max_languages: int = 256, **kw) -> Mixture:
    """Learn from rows with a text and a language.

    ``max_docs_per_language`` bounds the sample.  A language's counts are made one dense
    row of CELLS numbers on the executors, and rows reach the driver one by one:
    ``max_languages`` bounds the model that it holds and broadcasts, half a MB each, so
    134 MB by default; more languages are an error.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Mixture([], np.zeros((0, CELLS)), **kw)
    keep = F.lit(False)
    for name, n in sizes.items():
        part = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_docs_per_language / n) + 1)
        keep = keep | ((F.col("lang") == name) & part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = trigrams(np.frombuffer(value.as_py().encode(), dtype=np.uint8))
                counts.setdefault(name, np.zeros(CELLS, dtype=np.int64))
                counts[name] += np.bincount(cells, minlength=CELLS)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), type=pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "cell", "n"])

    def dense(part: pa.Table) -> pa.Table:
        counts = np.zeros(CELLS, dtype=np.int64)
        counts[part["cell"].to_numpy()] = part["n"].to_numpy()
        return pa.table({"lang": part["lang"].slice(0, 1), "counts": pa.array([counts.tobytes()], type=pa.binary())})

    cells = arrays.batched(rows.where(keep).select("lang", "text")).mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    place, counts = {name: i for i, name in enumerate(languages)}, np.zeros((len(languages), CELLS))
    for row in cells.groupBy("lang").applyInArrow(dense, "lang string, counts binary").toLocalIterator():  # a group has CELLS rows at most
        counts[place[row.lang]] = np.frombuffer(row.counts, dtype=np.int64)
    return Mixture(languages, counts, **kw)


def predict(docs: DataFrame, model: Mixture, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (to, score)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.predict(t.as_py()) for t in batch.column(keep.index(text))]
            extra = [pa.array([x[0] for x in out], type=pa.string()), pa.array([x[1] for x in out], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*keep, to, score])

    return arrays.batched(docs.select(*keep)).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Mixture, text: str = "text", least_share: float = 0.5) -> DataFrame:
    """The documents whose main language is known and has at least ``least_share`` of the text."""
    named = predict(docs, model, text, "__lang", "__share")
    return named.where((F.col("__lang") != "und") & (F.col("__share") >= least_share)).select(*docs.columns)
