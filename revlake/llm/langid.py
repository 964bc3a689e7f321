"""Hierarchical language identification.

Texts become counts of hashed byte n-grams. A multinomial model over all n-grams
tells the language family; inside the family a linear support vector machine
for every pair of languages votes. Both are fitted on a sample of labelled
documents of about ``per_lang`` for each language; predictions cover every
whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm import bytetext as B
from revlake.llm.tables import fold, frugal, written

#: Language families by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "indic": "hi bn ur mr pa gu ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv tl",
    "sinitic": "zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
BITS = 12
SIZE = 1 << BITS
PER_LANG = 2000
UNKNOWN = "und"
_TEXTS, _PART = 256, 1 << 20


def families_of(langs: list[str]) -> dict[str, list[str]]:
    """Languages by family. Where a base code comes with several tags, its languages are a family of their own.

    So a family has no more members than it has base codes, or a base code tags.
    """
    base = {lang: lang.lower().split("-")[0] for lang in langs}
    tags: dict[str, int] = {}
    for lang in langs:
        tags[base[lang]] = tags.get(base[lang], 0) + 1
    out: dict[str, list[str]] = {}
    for lang in langs:
        code = base[lang]
        out.setdefault(code if tags[code] > 1 else _FAMILY.get(code, lang), []).append(lang)
    return out


# Letters and bytes of longer characters stay, A-Z as a-z; all else is one space.
_KEPT = np.full(256, 0x20, np.uint64)
_KEPT[0x61:0x7B] = _KEPT[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEPT[0x80:] = np.arange(0x80, 0x100)


def ngram_counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x SIZE counts of hashed n-grams of one to three bytes; n-grams do not cross texts."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), np.int64)
    for low in range(0, len(body), _PART):  # parts overlap by two bytes, so that no n-gram is lost
        part = _KEPT[body[low : low + _PART + 2]]
        owner = np.searchsorted(offsets, np.arange(low, low + len(part)), "right") - 1
        gram = np.zeros(len(part), np.uint64)
        for k in range(3):
            fresh = min(_PART, len(part) - k)
            if fresh <= 0:
                break
            gram[:fresh] = gram[:fresh] * np.uint64(256) + part[k : k + fresh]
            known = (owner[k : k + fresh] == owner[:fresh]) & ((part[:fresh] != 0x20) | (part[k : k + fresh] != 0x20))
            code = (gram[:fresh] + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            first, last = int(owner[0]), int(owner[-1])
            at = (owner[:fresh] - first) * SIZE + code.astype(np.int64)
            out[first : last + 1] += np.bincount(at[known], minlength=(last - first + 1) * SIZE).reshape(-1, SIZE)
    return out


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length one, or zero."""
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1), dtype=np.float64).astype(np.float32)


def svm_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps with conjugate gradients.

    The last column of x is one; its weight, the bias, is not penalised. y is +1
    or -1. x stays as it is: rows outside the margin only get a weight of zero.
    """
    product = lambda v: (x @ v.astype(x.dtype)).astype(np.float64)
    back = lambda r: (r.astype(x.dtype) @ x).astype(np.float64) / len(x)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        told = product(w)
        inside = y * told < 1
        gradient = ridge * w + back(np.where(inside, told - y, 0))
        size = np.linalg.norm(gradient)
        if size < 1e-6:
            break
        step, rest, along = np.zeros_like(w), -gradient, -gradient
        square = rest @ rest
        for _ in range(40):
            bent = ridge * along + back(np.where(inside, product(along), 0))
            rate = square / (along @ bent)
            step += rate * along
            rest = rest - rate * bent
            square, old = rest @ rest, square
            if np.sqrt(square) < 0.05 * size:
                break
            along = rest + square / old * along
        w = w + step
    return w


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)  # indices into langs
    family_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE)))  # log shares of n-grams
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE + 1)))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of rows of counts; needs one language at least."""
        total = counts.sum(1)
        likely = counts @ self.family_logs.T
        # As if n-grams came in groups of ten that tell one thing.
        likely = likely / np.maximum(1, np.minimum(total, 10 * np.sqrt(total)) / 10)[:, None] if len(self.families) > 1 else likely * 0
        share = np.exp(likely - likely.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        family = share.argmax(1)
        margins = unit_rows(counts) @ self.weights[:, :-1].T + self.weights[:, -1]
        langs, scores = [], np.zeros(len(counts))
        won = np.full((len(counts), len(self.langs)), -1.0)
        for members in self.families:
            won[:, members] = 0
        least = np.full((len(counts), len(self.langs)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            won[:, a] += (m > 0) + 1e-3 * np.tanh(m)  # ties of votes go by margins
            won[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        for i, f in enumerate(family):
            members = self.families[f]
            best = members[int(np.argmax(won[i, members]))]
            langs.append(self.langs[best])
            scores[i] = share[i, f] * (1 / (1 + np.exp(-3 * least[i, best])) if len(members) > 1 else 1)
        return langs, np.clip(np.nan_to_num(scores), 0, 1)


def has_letter(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((body | 0x20) >= 0x61) & ((body | 0x20) <= 0x7A) & (body < 0x80)
    sums = np.append(0, np.cumsum(ascii_letter))
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(c.isalpha() for c in bytes(body[offsets[i] : offsets[i + 1]]).decode(errors="ignore"))
    return found


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    body, offsets = B.flat(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 4 * _PART, "right")) - 1)
        high = min(high, low + _TEXTS, len(column))
        yield low, high, body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and n-gram counts of texts that have a letter."""
    for b in batches:
        for low, high, body, offsets in _parts(b.column(1)):
            known = has_letter(body, offsets)
            rows = ngram_counts(body, offsets).astype(np.int32)[known]
            langs = b.column(0).slice(low, high - low).filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([langs, pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "counts"])


def _sum_language(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    sums = np.zeros(SIZE, np.int64)
    for counts in rows["counts"]:
        sums += np.frombuffer(counts, np.int32)
    return pd.DataFrame({"lang": [key[0]], "sums": [sums.tobytes()]})


def _fit_pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x = np.ones((len(rows), SIZE + 1), np.float32)
    for i, counts in enumerate(rows["counts"]):
        x[i, :-1] = unit_rows(np.frombuffer(counts, np.int32)[None, :])
    y = np.where(rows["lang"] == key[0], 1.0, -1.0)
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "weights": [svm_weights(x, y).tobytes()]})


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from a sample of about ``per_lang`` documents for each labelled language.

    Of each language 32 KB of sums come to the driver, of each pair in a family 33 KB of weights.

    Only rows outside the held-out fold with a language and a letter count. The
    sample is drawn by a hash of the id, so it does not depend on partitions.
    """
    labelled = documents.filter(F.col("lang").isNotNull() & (fold() != 2)).select("doc_id", "lang", "text")
    scale = 1 << 30
    share = F.floor(F.lit(scale) * F.least(F.lit(1.0), per_lang / F.col("count"))).alias("_limit")
    # Written, so that its size is known: a table of few languages is broadcast.
    limits = written(labelled.groupBy("lang").count().select(F.col("lang").alias("_lang"), share), "langid-limits")
    drawn = labelled.join(limits, F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale)) < F.col("_limit"))
    sample = written(drawn.select("lang", "text").mapInArrow(frugal(_features), "lang string, counts binary"), "langid-sample")
    sums = {r["lang"]: np.frombuffer(r["sums"], np.int64) for r in sample.groupBy("lang").applyInPandas(_sum_language, "lang string, sums binary").collect()}
    if not sums:
        return Model()
    langs = sorted(sums)
    by_family = families_of(langs)
    logs = []
    for members in by_family.values():
        shares = np.mean([(sums[x] + 0.5) / (sums[x].sum() + 0.5 * SIZE) for x in members], axis=0)
        logs.append(np.log(shares))
    pairs = [(a, b) for members in by_family.values() for i, a in enumerate(members) for b in members[i + 1 :]]
    weights: dict[tuple[str, str], np.ndarray] = {}
    if pairs:
        table = documents.sparkSession.createDataFrame([(x, a, b) for a, b in pairs for x in (a, b)], "lang string, a string, b string")
        fitted = sample.join(F.broadcast(table), "lang").groupBy("a", "b").applyInPandas(_fit_pair, "a string, b string, weights binary")
        weights = {(r["a"], r["b"]): np.frombuffer(r["weights"]) for r in fitted.collect()}
    at = {lang: i for i, lang in enumerate(langs)}
    return Model(
        langs, [[at[x] for x in members] for members in by_family.values()], np.array(logs),
        [(at[a], at[b]) for a, b in weights], np.array(list(weights.values())).reshape(-1, SIZE + 1),
    )


def predict(documents: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; ``und`` with score 0 for texts without a letter.

    Columns to ``carry`` come behind these as _carried_0 and so on.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = documents.select(
        "doc_id", (fold() == 2).alias("held_out"), "text", *[F.col(f"`{c}`").alias(f"_carried_{i}") for i, c in enumerate(carry or [])]
    )
    kept = [f for f in rows.schema if f.name != "text"]
    names = [*(f.name for f in kept), "lang_pred", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for b in batches:
            for low, high, body, offsets in _parts(b.column(2)):
                langs, scores = [UNKNOWN] * (high - low), np.zeros(high - low)
                if own.langs and (known := has_letter(body, offsets)).any():
                    found, share = own.predict(ngram_counts(body, offsets)[known])
                    scores[known] = share
                    for i, lang in zip(np.flatnonzero(known), found, strict=True):
                        langs[i] = lang
                columns = [b.column(k).slice(low, high - low) for k in range(b.num_columns) if k != 2]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], names=names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    found = rows.mapInArrow(frugal(run), schema)
    return found.select("doc_id", "held_out", "lang_pred", "score", *[f.name for f in kept[2:]])


def identify_languages(documents: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Predicted language of every document, by a model of the documents' own labels.

    Null and empty texts and texts without a letter are ``und`` with score 0, as
    is every text where nothing is labelled. Equal texts get equal results;
    repeated rows give one row each; a row without an id counts as held out; an
    empty table gives no rows; extra columns are ignored.
    """
    return predict(documents, fit(documents, per_lang))


def with_language(documents: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The documents, with all their columns, in which a language was found.

    Texts predicted ``und`` (null, empty, without a letter) go; all others stay
    as they are. Where nothing is labelled no language can be told, and all
    documents with a letter stay.
    """
    model = fit(documents, per_lang)
    if not model.langs:
        return documents.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(documents, model, documents.columns).filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"_carried_{i}").alias(c) for i, c in enumerate(documents.columns)])
