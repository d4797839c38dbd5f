"""Operator 7: language identification of mixed-language text.

Training, for the ``MOST_LANGS`` most frequent languages: counts of hashed letter trigrams per language, and of words per language and script, summed over a sample of
labelled documents. A document is taken by a hash of its row, at a rate that gives about ``SAMPLE`` documents for each
language, all of them where there are fewer; whole texts are counted. The model has ``BUCKETS`` numbers per language.

Prediction: each word gets a score per language, the log likelihood of its trigrams. The script of a word narrows the
candidates to languages seen in it. Viterbi with a switching penalty labels the words, so a span changes its language
only where that gains more than the penalty. If no stretch of words favours another language over the best single one by more
than half the penalty, the best path has one label: a path with s >= 2 stretches in other languages has at least s - 1 >=
s / 2 changes, and one stretch without a change is a whole text in another language. So only the other texts run the
recurrence. A document's language has the most letters under its label;
the score is their share. Ties go to the smaller label.

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing was learned. A null doc_id
counts as the empty text in the fold and so is held out.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_batches, slices, text_key

SAMPLE = 2_000
#: Languages that are learned, the most frequent ones: bounds the counts that the driver gathers (33,000 each).
MOST_LANGS = 128
BUCKETS = 1 << 15
PENALTY = 12.0
SMOOTHING = 0.5
#: Score per word of a language that was never seen in the word's script.
OUT_OF_SCRIPT = -60.0
#: First code points of script ranges. Fixed values from the Unicode block list.
SCRIPTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1400, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0xAC00, 0xD800)
#: Ranges that continue an earlier script: Latin and Greek have two.
SAME_SCRIPT = {27: 0, 28: 1}
_WORD = re.compile(r"[^\W\d_]+")
_STARTS = np.array(SCRIPTS)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(unicodedata.category(c)[0] == "L" for c in w) for w in words)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' trigrams with a mark before and after each word, where each word's begin, and scripts."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    h = joined[:-2] * np.uint64(0x9E3779B1) + joined[1:-1] * np.uint64(0x85EBCA77) + joined[2:] * np.uint64(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) >> np.uint64(12)
    # a word of n letters has n windows; the two that reach into the next word go
    own = np.ones(len(joined), bool)
    ends = starts + lengths
    own[ends] = own[ends + 1] = False
    first = np.searchsorted(_STARTS, joined[starts + 1], "right") - 1
    scripts = np.array([SAME_SCRIPT.get(s, s) for s in first.tolist()])
    return (h[own[: len(h)]] & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]), scripts


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float = PENALTY):
        self.langs, self.penalty = langs, penalty
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.seen = (share > 0.001).T  # scripts x langs
        self.seen[~self.seen.any(axis=1)] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(self.langs)), np.float32)

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text the scores of its words."""
        if len(self.index) > 300_000:
            self.forget()
        index = self.index
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in index]
        if new:
            buckets, starts, scripts = features(new)
            score = np.add.reduceat(self.logp[buckets], starts, axis=0)
            score = np.where(self.seen[scripts], score, OUT_OF_SCRIPT + score.min(axis=1, keepdims=True)).astype(np.float32)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.table = np.concatenate([self.table, score])
        return [self.table[np.fromiter(map(index.__getitem__, t), np.int64, len(t))] for t in texts]

    def path(self, score: np.ndarray) -> np.ndarray:
        """The label of each word."""
        best = int(score.sum(axis=0, dtype=np.float64).argmax())
        gain = np.cumsum(score - score[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0), 0)
        if (gain - low).max() <= self.penalty / 2:
            return np.full(len(score), best)
        return self.viterbi(score)

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        n, k = score.shape
        came = np.empty((n, k), np.int32)
        value = [0.0] * k
        stay = list(range(k))
        for t, row in enumerate(score.tolist()):
            top = max(value)
            change, at = top - self.penalty, value.index(top)
            came[t] = [i if value[i] >= change else at for i in stay]
            value = [s + (v if v >= change else change) for s, v in zip(row, value)]
        out = np.empty(n, np.int64)
        state = value.index(max(value))
        for t in range(n - 1, -1, -1):
            out[t] = state
            state = came[t, state]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        spoken = [i for i, w in enumerate(words) if self.langs and has_letter(w)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for i, s in zip(spoken, self.scores([words[i] for i in spoken])):
            letters = np.bincount(self.path(s), weights=[len(w) for w in words[i]], minlength=len(self.langs))
            best = int(letters.argmax())
            lang[i], score[i] = self.langs[best], float(letters[best] / letters.sum())
        return lang, score

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the stretches with one label, in code points of the text, from word to word."""
        found = [m for m in _WORD.finditer(text or "")]
        if not self.langs or not has_letter([m.group() for m in found]):
            return []
        labels = self.path(self.scores([[m.group().lower() for m in found]])[0]).tolist()
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, labels):
            if out and out[-1][2] == self.langs[k]:
                out[-1] = (out[-1][0], m.end(), self.langs[k])
            else:
                out.append((m.start(), m.end(), self.langs[k]))
        return out


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """From text and lang of rows outside the held-out fold."""
    rows = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    sizes = {r["lang"]: r["n"] for r in frequent.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))), penalty)
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])[F.col("lang")]
    # other languages have no rate
    taken = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), text_key(F.col("text")), F.lit(7)), F.lit(1_000_000)) < rate * 1_000_000)

    def run(batches):
        counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)), np.int64)
        number = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    words = words_of(text)
                    if words:
                        buckets, _, scripts = features(words)
                        counts[number[lang]] += np.bincount(np.concatenate([buckets, BUCKETS + scripts]), minlength=counts.shape[1])
        lang, feature = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(feature, pa.int32()), pa.array(counts[lang, feature])], names=["lang", "feature", "n"])

    got = taken.select("text", "lang").mapInArrow(run, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    counts[got["lang"].to_numpy(), got["feature"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:], penalty)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample, penalty))

    def predict(batch: pa.RecordBatch) -> dict:
        lang, score = model.value.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, predict, SCHEMA, ARROW, forget=lambda: model.value.forget())
