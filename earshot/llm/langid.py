"""Language identification by character models with interpolated Kneser-Ney smoothing.

Texts are read as lower-case letters with one space for anything else. For each language,
4-grams are counted over training documents; lower orders use continuation counts, the
number of different characters that an n-gram follows. All orders are interpolated once, so
the model is, per order, a sorted array of n-gram hashes with a row of log probabilities,
one per language, and one of context hashes with log back-off weights. A text is scored
whole, and the language of the lowest cross-entropy per character wins.

The score is the probability that it is right, by a logistic curve of the log likelihood
ratio to the second language, fitted on snippets of documents that were not counted; below
``ACCEPTED`` the answer is marked as rejected.

Training takes about ``TRAIN_DOCS`` whole documents per language, chosen by a hash of their
key, and a part of these (``CALIBRATION``) for the curve: bounds of a fitted classifier. All
documents are scored. NULL texts and texts without a letter are ``und`` with score 0, and so
is every text where nothing could be learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.bytewords import mixed

ORDER = 4
TRAIN_DOCS = 1000  # per language
CALIBRATION = 0.2  # of these
SNIPPETS = (4, 8, 16, 32, 64)  # characters
ACCEPTED = 0.5
UNKNOWN = "und"
CHUNK_CHARS = 1_000_000
SPACE = 32
_TABLE_END = 0x3000  # characters from here on stand for themselves


def letter_table() -> np.ndarray:
    """Character to lower-case letter, or to a space."""
    out = np.full(_TABLE_END, SPACE, np.uint64)
    for c in range(_TABLE_END):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 0xFFFF else 0xFFFF
    return out


def characters(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text started by one space, and where each text starts."""
    raw = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    c = np.minimum(raw, 0xFFFF).astype(np.uint64)
    low = raw < _TABLE_END
    c[low] = table[raw[low]]
    space = c == SPACE
    keep = ~(space & np.append(False, space[:-1]))
    keep[first] = True
    sizes = np.add.reduceat(keep, first, dtype=np.int64)
    return c[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def gram_keys(c: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For orders 1 to ``ORDER``, the n-gram that ends at each character, as 16 bits each; spaces stand before a text."""
    place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    keys, key = [], c.copy()
    keys.append(key)
    for back in range(1, ORDER):
        before = np.full(len(c), SPACE, np.uint64)
        inside = place >= back
        before[inside] = c[np.flatnonzero(inside) - back]
        key = key | before << np.uint64(16 * back)
        keys.append(key)
    return keys


@dataclass
class Model:
    """Arrays by order; rows and columns of values are n-grams and languages."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # sorted hashes
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_back: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0  # log probability of a character never seen
    curve: tuple[float, float] = (0.0, 1.0)

    def log_likelihoods(self, keys: list[np.ndarray]) -> np.ndarray:
        """Log probabilities per character and language."""
        n = len(keys[0])
        out = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for order in range(ORDER, 0, -1):
            h = mixed(keys[order - 1][left])
            at, found = _find(self.grams[order - 1], h)
            out[left[found]] += self.log_p[order - 1][at[found]]
            left = left[~found]
            if not len(left):
                return out
            if order > 1:
                h = mixed(keys[order - 1][left] >> np.uint64(16))
                at, found = _find(self.contexts[order - 1], h)
                out[left[found]] += self.log_back[order - 1][at[found]]
        out[left] += self.floor
        return out


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of the longest n-grams of the columns lang and text."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = letter_table()
        for pdf in frames:
            for lang, part in pdf.groupby("lang"):
                for texts in _portions(part["text"].tolist()):
                    gram, n = np.unique(gram_keys(*characters(texts, table))[-1], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    return docs.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _portions(texts: list[str]) -> Iterator[list[str]]:
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < CHUNK_CHARS):
            total += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def order_counts(counts: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) for orders 1 to ``ORDER``: continuation counts below the longest."""
    out = [counts]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))
        out.append(out[-1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")))
    return out[::-1]


def interpolated(languages: list[str], tables: list[pd.DataFrame]) -> Model:
    """The model from counts by order, as collected (bounded by the training documents)."""
    model = Model(languages)
    column = {lang: i for i, lang in enumerate(languages)}
    letters = len(np.unique(tables[0]["gram"])) + 1
    lower: tuple[np.ndarray, np.ndarray] | None = None  # sorted keys of the order below and their probabilities
    backs: list[tuple[np.ndarray, np.ndarray]] = []
    for order in range(1, ORDER + 1):
        t = tables[order - 1]
        key, n, lang = t["gram"].to_numpy().view(np.uint64), t["n"].to_numpy(float), t["lang"].map(column).to_numpy()
        grams, row = np.unique(key, return_inverse=True)
        contexts, of = np.unique(grams >> np.uint64(16) if order > 1 else np.zeros(len(grams), np.uint64), return_inverse=True)
        c = np.zeros((len(grams), len(languages)))
        c[row, lang] = n
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        total, kinds = np.zeros((2, len(contexts), len(languages)))
        np.add.at(total, of, c)
        np.add.at(kinds, of, c > 0)
        seen = total > 0
        back = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
        if order == 1:
            below = np.full(c.shape, 1.0 / letters)
        else:
            at = np.searchsorted(lower[0], grams & np.uint64((1 << 16 * (order - 1)) - 1))
            below = lower[1][at]  # a suffix of a counted n-gram is counted
        p = np.maximum(c - discount, 0) / np.maximum(total[of], 1) + back[of] * below
        if order == 1:
            model.floor = float(np.log(back[0] / letters).mean())
        lower = grams, p
        for hashes, values, keys, v in ((model.grams, model.log_p, grams, p), (model.contexts, model.log_back, contexts, back)):
            h = mixed(keys.copy())
            by = np.argsort(h)
            hashes.append(h[by])
            values.append(np.log(v[by]).astype(np.float32))
        backs.append((contexts, back))
    return model


def score(texts: list, model: Model, table: np.ndarray) -> pd.DataFrame:
    """Per text: the best language's number (-1: none), its log likelihood ratio to the second, characters."""
    best, ratio, length = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if model.languages:
        usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        done = 0
        for portion in _portions([texts[i] for i in usable]):
            at = usable[done:done + len(portion)]
            done += len(portion)
            c, first = characters(portion, table)
            total = np.add.reduceat(model.log_likelihoods(gram_keys(c, first)), first, axis=0, dtype=np.float64)
            ranked = np.sort(total, axis=1)
            best[at] = total.argmax(1)
            ratio[at] = ranked[:, -1] - ranked[:, -2] if total.shape[1] > 1 else np.inf
            length[at] = np.diff(np.append(first, len(c)))
    return pd.DataFrame({"best": best, "ratio": ratio, "length": length})


def sampled(docs: DataFrame, key: str, lang: str, train_docs: int) -> DataFrame:
    """About ``train_docs`` rows per language, by hash."""
    sizes = docs.groupBy(lang).agg(F.count("*").alias("_n"))  # one row per language
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return docs.withColumn("_draw", draw).join(F.broadcast(sizes), lang).where(F.col("_draw") * F.col("_n") < train_docs)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the languages of ``docs``; rows without text or language are left out."""
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(c(key).alias("key"), c(text).cast("string").alias("text"), c(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = sampled(rows, "key", "lang", train_docs)
    aside = F.pmod(F.xxhash64("key", F.lit("aside")), F.lit(1000)) < 1000 * CALIBRATION
    counts = count_grams(chosen.where(~aside))
    tables = [t.toPandas() for t in order_counts(counts.cache())]
    counts.unpersist()
    languages = sorted(tables[0]["lang"].unique(), key=lambda s: s.encode())
    if not languages:
        return Model([])
    model = interpolated(languages, tables)
    held = chosen.where(aside)

    def snippets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for pdf in frames:
            for size in SNIPPETS:
                at = [snippet_place(t, size) for t in pdf["text"]]
                r = score([t[i:i + size] for t, i in zip(pdf["text"], at)], model, letters)
                right = np.array([b >= 0 and model.languages[b] == want for b, want in zip(r["best"], pdf["lang"])])
                yield pd.DataFrame({"ratio": r["ratio"], "right": right})[r["best"] >= 0]

    found = held.select("text", "lang").mapInPandas(snippets, "ratio double, right boolean").toPandas()
    if len(languages) > 1 and len(found):
        model.curve = logistic(found["ratio"].to_numpy(float), found["right"].to_numpy(bool))
    return model


def snippet_place(text: str, size: int) -> int:
    """A place for a snippet that depends on the text only."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text) - size)


def logistic(x: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with targets drawn in a little (Platt)."""
    good = right.sum()
    y = np.where(right, (good + 1) / (good + 2), 1 / (len(x) - good + 2))
    scale = max(np.abs(x).mean(), 1e-9)
    design = np.stack([np.ones(len(x)), x / scale], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-6 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """The table with a struct ``out``: lang_pred, score, cross-entropy ratio per character, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast({"model": vars(model)})

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = shared.value
        if "ready" not in state:
            state["ready"] = Model(**state["model"]), letter_table()
        m, table = state["ready"]
        names = np.array([*m.languages, UNKNOWN], object)
        for texts in batches:
            r = score(texts.tolist(), m, table)
            known = r["best"].to_numpy() >= 0
            p = np.where(known, 1 / (1 + np.exp(-np.clip(m.curve[0] + m.curve[1] * r["ratio"].to_numpy(), -700, 700))), 0.0)
            per_char = np.where(known & np.isfinite(r["ratio"]), r["ratio"] / np.maximum(r["length"], 1), 0.0)
            yield pd.DataFrame({"lang_pred": names[r["best"].to_numpy()], "score": p, "margin": per_char, "rejected": p < ACCEPTED})

    predicted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = "lang_pred string, score double, margin double, rejected boolean"
    return docs.withColumn(out, F.pandas_udf(predicted, kind)(F.col(f"`{text}`").cast("string")))


def fold(key: Column) -> Column:
    """0 to 3 by crc32 of the key as text."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))
