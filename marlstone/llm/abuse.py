"""Scores for abusive, hateful and sexual content with a convolutional text classifier in numpy.

Words are normalised (accents, look-alike digits and signs, stretched letters), hashed into a
table of embeddings, passed through filters of several widths, pooled by their maximum over the
text, and mapped to one score per kind. Training labels are posts judged by reviewers, who err
and name one kind only, so the loss of kinds that were not named is weakened, posts that the model
firmly contradicts are set aside in later rounds, and reviewers' disagreement is kept as is.
Thresholds are calibrated per language on held-out posts.

Null and empty texts score 0. Without labelled posts no model can be fitted and all scores are 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("abuse", "hate", "sexual")
#: Labelled posts that the classifier is fitted on, at most; chosen by hash.
FIT_ROWS = 12_000
#: Rows of the embedding table, width of an embedding, filters of each width, widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 24, 24, (1, 2, 3, 4)
SEED, BATCH, RATE = 7, 32, 0.004
#: Texts that one fit sees in all its epochs, about; least and most epochs.
PASSES, LEAST_EPOCHS, MOST_EPOCHS = 50_000, 5, 24
#: Weight of "not this kind" where the reviewer named another kind.
UNNAMED = 0.3

#: Signs written for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "*": ""})
_WORD = regex.compile(r"[\p{L}\p{N}@$€*!](?:[\p{L}\p{N}\p{M}@$€*!'’_]*[\p{L}\p{N}@$€*])?")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)")
_LONG = regex.compile(r"(\p{L})\1{2,}")


def _normal(chunk: str) -> list[str]:
    """Normalised words of a stretch without blanks; a sign that ends a sentence is a word of its own."""
    if not chunk.isascii():
        chunk = _INVISIBLE.sub("", unicodedata.normalize("NFKC", chunk))
    out = []
    for w in _WORD.findall(chunk.lower()):
        letters = sum(c.isalpha() for c in w)
        if letters != len(w):
            if letters >= 2 or (letters and len(w) > 2):
                w = w.strip("!").translate(LOOKALIKES)
            elif w.isdigit():
                w = "0"
            elif not letters:
                continue
        out.append(_LONG.sub(r"\1\1", w).replace("’", "'"))
    if chunk[-1:] in ".!?…":
        out.append(".")
    return out


def tokens(text: str | None) -> list[str]:
    """Normalised words of a text."""
    return [w for chunk in _chunks(text) for w in _normal(chunk)]


def _chunks(text: str | None) -> list[str]:
    """Stretches without blanks; letters spaced out one by one are put together."""
    if not text:
        return []
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), text)
    return text.replace("\n", " . ").split()


def _hash(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return 1 + (h ^ (h >> 15)) % (BUCKETS - 1)


class Hasher:
    """Texts to rows of the embedding table; stretches are remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, *texts: str | None) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out: list[int] = []
        for text in texts:
            for chunk in _chunks(text):
                ids = known.get(chunk)
                if ids is None:
                    ids = known[chunk] = tuple(map(_hash, _normal(chunk)))
                out += ids
            if text:
                out.append(_STOP)
        return np.array(out, np.int64)


_STOP = _hash(".")


@dataclass
class Classifier:
    """Weights of the network, per-language thresholds, and the forward and backward passes."""

    embed: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros((FILTERS * len(WIDTHS), len(KINDS)), np.float32))
    out_bias: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), -9.0, np.float32))
    thresholds: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def fresh(cls) -> Classifier:
        rng = np.random.default_rng(SEED)
        m = cls()
        m.embed = (rng.standard_normal((BUCKETS, DIM)) * 0.25).astype(np.float32)
        m.embed[0] = 0
        m.filters = [(rng.standard_normal((w * DIM, FILTERS)) * np.sqrt(2 / (w * DIM))).astype(np.float32) for w in WIDTHS]
        m.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        m.out = (rng.standard_normal((FILTERS * len(WIDTHS), len(KINDS))) * 0.1).astype(np.float32)
        m.out_bias = np.full(len(KINDS), -2.0, np.float32)
        return m

    def prepare(self) -> None:
        """Tabulate what each word adds to each filter, so that scoring only looks up and adds."""
        self.tables = [[np.ascontiguousarray(self.embed @ f[j * DIM : (j + 1) * DIM]) for j in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def scores_many(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of many whole texts: laid end to end, with gaps that no filter bridges."""
        if not texts or not self.filters:
            return np.zeros((len(texts), len(KINDS)))
        if not hasattr(self, "tables"):
            self.prepare()
        gap = np.zeros(max(WIDTHS) - 1, np.int64)
        flat = np.concatenate([p for t in texts for p in (t, gap)])
        ends = np.cumsum([len(t) + len(gap) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        n, h = len(flat), np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            z = self.tables[k][0].take(flat, axis=0)
            for j in range(1, w):
                z[: n - j] += self.tables[k][j].take(flat[j:], axis=0)
            h[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, starts, axis=0) + self.bias[k], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))

    def fit(self, texts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int = LEAST_EPOCHS, seed: int = SEED) -> None:
        """Adam on the weighted logistic loss; gradients flow through the pooled positions only."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.filters, *self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, widest, nf = 0, max(WIDTHS), FILTERS
        for _ in range(epochs):
            # Batches hold texts of like length, to pad little; their order is random.
            order = np.array(sorted(rng.permutation(len(texts)), key=lambda i: len(texts[i]) // 16))
            for b in rng.permutation(np.arange(0, len(order), BATCH)):
                rows = order[b : b + BATCH]
                step += 1
                size = max(len(texts[i]) for i in rows) + widest - 1
                ids = np.zeros((len(rows), size), np.int64)
                for r, i in enumerate(rows):
                    ids[r, : len(texts[i])] = texts[i]
                x = self.embed[ids]
                hidden, where = np.empty((len(rows), nf * len(WIDTHS)), np.float32), []
                for k, w in enumerate(WIDTHS):
                    n = size - w + 1
                    z = x[:, :n] @ self.filters[k][:DIM]
                    for j in range(1, w):
                        z += x[:, j : j + n] @ self.filters[k][j * DIM : (j + 1) * DIM]
                    at = z.argmax(1)
                    where.append(at)
                    hidden[:, k * nf : (k + 1) * nf] = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias[k]
                active = hidden > 0
                hidden = np.where(active, hidden, 0)
                keep = (rng.random(hidden.shape) < 0.7) / 0.7
                h = (hidden * keep).astype(np.float32)
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
                delta = ((p - target[rows]) * weight[rows] / len(rows)).astype(np.float32)
                back = (delta @ self.out.T) * keep.astype(np.float32) * active
                g_embed = np.zeros_like(self.embed)
                g_filters, g_bias = [], []
                for k, w in enumerate(WIDTHS):
                    d, at = back[:, k * nf : (k + 1) * nf], where[k]
                    gf = np.zeros_like(self.filters[k])
                    r = np.arange(len(rows))[:, None]
                    for j in range(w):
                        word = ids[r, at + j]
                        v = self.embed[word]
                        gf[j * DIM : (j + 1) * DIM] = np.einsum("rf,rfd->df", d, v)
                        np.add.at(g_embed, word.ravel(), (d[:, :, None] * self.filters[k][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM))
                    g_filters.append(gf)
                    g_bias.append(d.sum(0))
                g_embed[0] = 0
                grads = [g_embed, *g_filters, *g_bias, h.T @ delta + 1e-4 * self.out, delta.sum(0)]
                touched = np.flatnonzero(np.abs(g_embed).sum(1))
                for q, (par, g, a, v) in enumerate(zip(params, grads, first, second)):
                    sel = touched if q == 0 else slice(None)
                    a[sel] = 0.9 * a[sel] + 0.1 * g[sel]
                    v[sel] = 0.999 * v[sel] + 0.001 * g[sel] ** 2
                    par[sel] -= RATE * (a[sel] / (1 - 0.9**step)) / (np.sqrt(v[sel] / (1 - 0.999**step)) + 1e-7)


def labelled_posts(posts: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """``id, title, selftext, verdicts`` of judged posts, at most about ``bound``; null verdicts say nothing."""
    judged = labels.filter(F.col("verdict").isin("ok", *KINDS) & F.col("id").isNotNull()).groupBy("id").agg(F.sort_array(F.collect_list("verdict")).alias("verdicts"))
    share = min(1.0, bound / max(1, judged.count()))
    chosen = judged.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < round(share * 1_000_000))
    return posts.select("id", "title", "selftext").join(chosen, "id")


def fit_classifier(rows: list[tuple], languages: list[str] | None = None) -> Classifier:
    """A classifier fitted on (title, selftext, verdicts) rows, with thresholds by language.

    Two rounds: posts whose label the first model contradicts firmly, on the fold it was not
    fitted on, lose their weight in the second.
    """
    hasher = Hasher()
    texts = [hasher(t, b) for t, b, _ in rows]
    target, weight = np.zeros((len(rows), len(KINDS)), np.float32), np.ones((len(rows), len(KINDS)), np.float32)
    for i, (_, _, verdicts) in enumerate(rows):
        for k, kind in enumerate(KINDS):
            target[i, k] = sum(v == kind for v in verdicts) / len(verdicts)
            if target[i, k] == 0 and any(v != "ok" for v in verdicts):
                weight[i, k] = UNNAMED
    model = Classifier.fresh()
    if not len(rows) or not target.any():
        model.out_bias[:] = -9
        model.out[:] = 0
        return model
    epochs = max(LEAST_EPOCHS, min(MOST_EPOCHS, round(PASSES / len(rows))))
    fold = np.random.default_rng(SEED).integers(0, 2, len(rows))
    held = np.zeros_like(target, dtype=np.float64)
    for f in (0, 1):
        part = Classifier.fresh()
        use = np.flatnonzero(fold != f)
        part.fit([texts[i] for i in use], target[use], weight[use], epochs)
        rest = np.flatnonzero(fold == f)
        if len(rest):
            held[rest] = part.scores_many([texts[i] for i in rest])
    wrong = (np.abs(held - target) > 0.8) & (weight > 0.5)
    model.fit(texts, target, np.where(wrong, 0.1, weight).astype(np.float32), epochs)
    names = languages or [""] * len(rows)
    for lang in sorted({"", *(n or "" for n in names)}):
        of = np.array([lang in ("", n) for n in names])
        base = model.thresholds.get("", [0.5] * len(KINDS))
        model.thresholds[lang] = [_threshold(held[of, k], target[of, k] >= 0.5, weight[of, k] > 0.5, base[k]) for k in range(len(KINDS))]
    return model


def _threshold(score: np.ndarray, truth: np.ndarray, sure: np.ndarray, base: float) -> float:
    """The score that separates best by F1 on held-out posts; near ties go to the one nearest 0.5.

    Few positive posts draw it to ``base``. Scores below 0.35 are never enough: posts that were
    judged hold far more such content than others.
    """
    score, truth = score[sure], truth[sure]
    if truth.sum() < 5:
        return base
    grid = np.linspace(0.35, 0.8, 19)
    f1 = np.array([2 * ((score >= t) & truth).sum() / max(1, (score >= t).sum() + truth.sum()) for t in grid])
    near = grid[f1 >= f1.max() - 0.02]
    at, n = float(near[np.abs(near - 0.5).argmin()]), int(truth.sum())
    return (at * n + base * 20) / (n + 20)


def content_scores(posts: DataFrame, model: Classifier, lang: str | None = None) -> DataFrame:
    """``id`` and for each kind its score and whether it reaches the threshold (``is_...``)."""
    shared = posts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, hasher = shared.value, Hasher()
        for batch in batches:
            texts = [hasher(t, b) for t, b in zip(batch["title"], batch["selftext"])]
            scores = np.zeros((len(texts), len(KINDS)))
            start, words = 0, 0
            for i, t in enumerate(texts):
                words += len(t) + max(WIDTHS)
                if words > 20_000 or i == len(texts) - 1:
                    scores[start : i + 1] = net.scores_many(texts[start : i + 1])
                    start, words = i + 1, 0
            out = pd.DataFrame({"id": batch["id"]})
            codes = batch["lang"] if "lang" in batch else [""] * len(texts)
            limits = np.array([net.thresholds.get(c or "", net.thresholds.get("", [0.5] * len(KINDS))) for c in codes]).reshape(-1, len(KINDS))
            empty = np.array([len(t) == 0 for t in texts], bool)
            for k, kind in enumerate(KINDS):
                s = np.where(empty, 0.0, scores[:, k])
                out[kind] = np.round(s, 4)
                out[f"is_{kind}"] = s >= limits[:, k]
            yield out

    columns = ["id", "title", "selftext", *([F.col(lang).alias("lang")] if lang else [])]
    ddl = "id string, " + ", ".join(f"{k} double, is_{k} boolean" for k in KINDS)
    return posts.select(*columns).mapInPandas(run, ddl)


def found_kinds(scores: DataFrame) -> DataFrame:
    """``id, kind`` of every kind whose threshold is reached."""
    kinds = F.filter(F.array(*[F.when(F.col(f"is_{k}"), F.lit(k)) for k in KINDS]), lambda x: x.isNotNull())
    return scores.select("id", F.explode(kinds).alias("kind"))


def source_rates(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, n_posts`` and rates of each kind, from ``id, source`` rows (an id may have several sources)."""
    joined = sources.select("id", "source").distinct().join(scores, "id")
    rates = [F.round(F.avg(F.col(f"is_{k}").cast("double")), 6).alias(f"{k}_rate") for k in KINDS]
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n_posts"), *rates)
