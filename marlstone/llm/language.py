"""Languages of documents and of their segments by word-first backoff.

A word seen in training scores by its log frequency in each language; an unseen word backs off to
its longest known character n-grams, down to single letters. Scores of a sentence add up; runs of
sentences in one language are a segment.

Labels in the data are partly missing or wrong, so training has two steps over a bounded sample of
labelled posts: word frequencies by label, then again by the language that the first model gives
to each sentence. Null and blank texts have no segment. Texts without any letter have none either.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut, spread

#: Languages told apart unless others are asked for: those that the labels of the collection name.
LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
#: Other spellings of the languages.
SPELLINGS = {
    "deu": "de", "ger": "de", "german": "de",
    "eng": "en", "english": "en",
    "spa": "es", "spanish": "es",
    "fra": "fr", "fre": "fr", "french": "fr",
    "ita": "it", "italian": "it",
    "nld": "nl", "dut": "nl", "dutch": "nl",
    "por": "pt", "portuguese": "pt",
}
#: Labels that say nothing.
MISSING = ("", "und", "??")
#: Labelled posts that the models are fitted on, about.
FIT_POSTS = 60_000
#: Words of a sentence from which it counts as a whole sentence.
WHOLE = 5
#: Longest and shortest character n-gram, and the weight of a word that is only known by n-grams.
LONGEST, SHORTEST, BACKOFF_WEIGHT = 5, 1, 0.5
#: Occurrences in training from which a word is known.
KNOWN = 3
#: Most that one word adds to or takes from a language, so that no single word, such as a name's particle, decides.
BOUND = 3.0
#: Least confidence of a sentence's language.
SURE = 0.85

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_BREAK = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|\Z)|[\n\r]+")
_SKIP = re.compile(r"https?://\S+|\S+@\S+|&[a-z]+;|\]\([^)\s]*\)")


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any known spelling; null for a missing one, the cleaned text for others."""
    clean = F.element_at(F.split(F.lower(F.trim(label)), "[-_ ]"), 1)
    known = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.when(label.isNull() | F.trim(F.lower(label)).isin(*MISSING), F.lit(None).cast("string")).otherwise(F.coalesce(known[clean], clean))


def latest_labels(labels: DataFrame) -> DataFrame:
    """``id, label`` (a code or null): the row with the latest time holds; ties go to the greater text."""
    order = F.struct("labelled_at", F.coalesce("lang", F.lit("")))
    return labels.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("lang", order).alias("lang")).select("id", language_code(F.col("lang")).alias("label"))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the sentences of a text; a line break ends one too."""
    a, n = 0, len(text)
    for m in _BREAK.finditer(text):
        while a < n and text[a].isspace():
            a += 1
        b = m.start() if text[m.start()] in "\n\r" else m.end()
        if a < b:
            yield a, b
        a = m.end()
    while a < n and text[a].isspace():
        a += 1
    if a < n:
        yield a, n


def words(sentence: str) -> list[str]:
    """Words in lower case, without those of links and addresses."""
    if "@" in sentence or "http" in sentence or "&" in sentence or "](" in sentence:
        sentence = _SKIP.sub(" ", sentence)
    return _WORD.findall(sentence.lower())


class LanguageModel:
    """Log frequencies of words and n-grams in each language, centred over languages."""

    def __init__(self, counts: dict[str, np.ndarray], languages: tuple[str, ...] = LANGUAGES) -> None:
        self.languages, size = languages, len(languages)
        total = np.sum(list(counts.values()), axis=0) + 1.0 if counts else np.ones(size)
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        share = {w: c / total for w, c in counts.items()}
        for w, c in share.items():
            # Each word type weighs by the root of its frequency, so that a few words don't fill the n-grams.
            for g in set(ngrams(w)):
                grams[g] += np.sqrt(c)
        floor = 0.5 / total.max()
        mass = np.sum(list(grams.values()), axis=0) + 1e-9 if grams else np.ones(size)
        self.grams = {g: self._centred(v / mass, 1e-6) for g, v in grams.items()}
        known = [w for w, c in counts.items() if c.sum() >= KNOWN]
        self.fixed = len(known)
        self.index = {w: i for i, w in enumerate(known)}
        self.table = np.array([self._centred(share[w], floor) for w in known], np.float32).reshape(-1, size)

    @staticmethod
    def _centred(x: np.ndarray, floor: float) -> np.ndarray:
        y = np.log(x + floor)
        return np.clip(y - y.mean(), -BOUND, BOUND).astype(np.float32)

    def rows(self, ws: list[str]) -> list[int]:
        """Rows of the table for words; unseen words get a row by backoff, up to a bound at a time."""
        get = self.index.get
        out = [get(w, -1) for w in ws]
        if -1 in out:
            new = sorted({w for w, i in zip(ws, out) if i < 0})
            if len(self.index) + len(new) > self.fixed + 400_000:
                self.index = {w: i for w, i in self.index.items() if i < self.fixed}
                self.table = self.table[: self.fixed]
                return self.rows(ws)
            self.index |= {w: len(self.table) + k for k, w in enumerate(new)}
            self.table = np.concatenate([self.table, np.array([self._backoff(w) for w in new], np.float32).reshape(-1, len(self.languages))])
            out = [self.index[w] for w in ws]
        return out

    def _backoff(self, w: str) -> np.ndarray:
        padded = f"^{w}$"
        for n in range(LONGEST, SHORTEST - 1, -1):
            found = [self.grams[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in self.grams]
            if found:
                return (BACKOFF_WEIGHT * np.mean(found, axis=0)).astype(np.float32)
        return np.zeros(len(self.languages), np.float32)

    def score_many(self, sentences: list[list[str]]) -> tuple[list[int], list[float]]:
        """Best language of each list of words, and its confidence: the softmax of thrice the mean word score."""
        sizes = np.array([len(ws) for ws in sentences], np.int64)
        if not len(sizes):
            return [], []
        flat = self.rows([w for ws in sentences for w in ws])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(self.table[flat], starts, axis=0) * (3.0 / sizes)[:, None]
        best = mean.argmax(1)
        top = mean[np.arange(len(best)), best]
        return best.tolist(), (1.0 / np.exp(mean - top[:, None]).sum(1)).tolist()

    def segments(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, words of its longest whole sentence) of each segment."""
        return self.segments_many([text])[0]

    def segments_many(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
        """``segments`` of many texts, scored together."""
        spans: list[list[tuple[int, int, int]]] = []
        asked: list[list[str]] = []
        for text in texts:
            own = []
            for a, b in sentences(text) if text else ():
                ws = words(text[a:b])
                if len(ws) >= WHOLE:
                    own.append((a, b, len(asked)))
                    asked.append(ws)
                else:
                    own.append((a, b, -1))
            if own and all(k < 0 for _, _, k in own) and (ws := words(text)):
                own = [(0, len(text), len(asked))]
                asked.append(ws)
            spans.append(own)
        best, sure = self.score_many(asked)
        return [self._joined(text, own, asked, best, sure) for text, own in zip(texts, spans)]

    def _joined(self, text: str | None, own: list[tuple[int, int, int]], asked: list[list[str]], best: list[int], sure: list[float]) -> list[tuple[int, int, str, float, int]]:
        """Segments of a text from its scored sentences; short and unsure ones go with what is before them."""
        out: list[list] = []
        loose = guess = None
        for a, b, k in own:
            n = len(asked[k]) if k >= 0 else 0
            if n >= WHOLE and sure[k] >= SURE:
                lang = best[k]
                if out and out[-1][2] == lang:
                    last = out[-1]
                    last[1], last[3], last[4], last[5] = b, last[3] + sure[k] * n, max(last[4], n), last[5] + n
                else:
                    out.append([a if out or loose is None else loose, b, lang, sure[k] * n, n, n])
                continue
            if k >= 0 and guess is None:
                guess = k
            if out:
                out[-1][1] = b
            elif loose is None:
                loose = a
        if not out and guess is not None:
            return [(0, len(text or ""), self.languages[best[guess]], round(sure[guess], 4), 0)]
        return [(a, b, self.languages[lang], round(total / n, 4), longest) for a, b, lang, total, longest, n in out]


def ngrams(word: str) -> Iterator[str]:
    padded = f"^{word}$"
    for n in range(SHORTEST, LONGEST + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def _count_words(model_of, by_label: bool):
    """Word counts of each language in a batch: by the post's label, or by the model's language of the sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None if by_label else model_of()
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            asked: list[list[str]] = []
            for label, *texts in zip(batch["label"], batch["title"], batch["selftext"]):
                for text in texts:
                    for a, b in sentences(text) if text else ():
                        ws = words(text[a:b])
                        if by_label:
                            counts[label].update(ws)
                        elif len(ws) >= WHOLE:
                            asked.append(ws)
            if not by_label:
                for ws, lang, sure in zip(asked, *model.score_many(asked)):
                    if sure >= SURE:
                        counts[model.languages[lang]].update(ws)
            yield pd.DataFrame([(w, lang, n) for lang, c in counts.items() for w, n in c.items()], columns=["word", "lang", "n"])

    return run


def _collect_model(counted: DataFrame, languages: tuple[str, ...]) -> LanguageModel:
    """The model of word counts; their number is bounded by the words of the bounded sample."""
    table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    index = {lang: i for i, lang in enumerate(languages)}
    got = counted.groupBy("word", "lang").agg(F.sum("n").alias("n")).orderBy("word", "lang").toArrow()
    for w, lang, n in zip(got["word"].to_pylist(), got["lang"].to_pylist(), got["n"].to_pylist()):
        table[w][index[lang]] += n
    return LanguageModel(dict(table), languages)


def fit_languages(posts: DataFrame, labels: DataFrame, fit_posts: int = FIT_POSTS, languages: tuple[str, ...] = LANGUAGES) -> LanguageModel:
    """The model fitted on about ``fit_posts`` posts with a label in ``languages``, chosen by hash."""
    spark = posts.sparkSession
    usable = labels.filter(F.col("label").isin(*languages))
    share = min(1.0, fit_posts / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    sample = posts.select("id", "title", "selftext").join(chosen.select("id", "label"), "id").select("label", "title", "selftext")
    sample = spread(cut(sample, "language_sample"))
    ddl = "word string, lang string, n long"
    first = _collect_model(sample.mapInPandas(_count_words(None, True), ddl), languages)
    shared = spark.sparkContext.broadcast(first)
    second = _collect_model(sample.mapInPandas(_count_words(lambda: shared.value, False), ddl), languages)
    return second


def language_segments(posts: DataFrame, model: LanguageModel) -> DataFrame:
    """``id, field_name, start_pos, end_pos, lang, confidence, longest`` of every segment of title and selftext."""
    shared = posts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            keys = batch["id"].tolist()
            rows = []
            for name in ("title", "selftext"):
                for key, found in zip(keys, model.segments_many(batch[name].tolist())):
                    rows += [(key, name, *s) for s in found]
            yield pd.DataFrame(rows, columns=["id", "field_name", "start_pos", "end_pos", "lang", "confidence", "longest"])

    ddl = "id string, field_name string, start_pos long, end_pos long, lang string, confidence double, longest int"
    return posts.select("id", "title", "selftext").mapInPandas(run, ddl)


def post_languages(segments: DataFrame) -> DataFrame:
    """``id, lang, confidence, share``: the language of most of a post's characters (ties: first by name)."""
    size = F.col("end_pos") - F.col("start_pos")
    per = segments.groupBy("id", "lang").agg(F.sum(size).alias("chars"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    best = F.struct(F.col("chars").alias("chars"), F.col("confidence").alias("confidence"), F.col("lang").alias("lang"))
    whole = per.groupBy("id").agg(F.max_by(best, F.struct("chars", "confidence")).alias("b"), F.sum("chars").alias("chars"))
    return whole.select("id", "b.lang", F.round("b.confidence", 4).alias("confidence"), F.round(F.col("b.chars") / F.col("chars"), 4).alias("share"))


def unlabelled_languages(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, lang``: languages with a whole sentence that the post's label does not name."""
    found = segments.filter(F.col("longest") >= WHOLE).select("id", "lang").distinct()
    named = found.join(labels, "id", "left")
    return named.filter(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("id", "lang")
