"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language, of order 4, over letter words with a start and an end mark. The models are
fitted on a bounded sample: about ``SAMPLE_ROWS`` training rows of a language, whatever their length,
chosen by a hash of id, language and text among all its rows (rows equal in these are one), fewer of
each where there are more than ``TOTAL_ROWS / SAMPLE_ROWS`` languages, and at least one. Of a drawn text
of more than ``SAMPLE_BYTES``, words from all over it, chosen by the hash of their place, stand for the
whole, up to ``SAMPLE_BYTES``; shorter ones are taken whole. So the arrays have a bounded size and may be
sent to every task; languages, texts and counts themselves are never sampled when predicting.

All n-grams that any language has seen stand in one sorted array of hashes per order, with a row of
interpolated log-probabilities, one per language, and one array of contexts with their log back-off
weights. A character is looked up at the longest order; where absent, every language backs off by its
own weight. The prediction is the language of the lowest cross-entropy per character of the whole
text (ties: the first in sorted order). Each distinct word of a slice is scored once.

Calibrated rejection: a fifth of the sample is kept apart; a text is ``rejected`` if it has no letter,
or at least ``REJECT_LETTERS`` letters and a cross-entropy above the mean of the predicted language's
kept texts by more than ``REJECT_SIGMAS`` deviations (at least 0.2 nats each).

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected. A null id
falls in fold 0 (held out). Null languages are never learned. With nothing to learn from, every text
is ``und``. Repeated rows are predicted alike; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import _MULT, BROADCAST_IDS, fold, mix, persisted, released, slices, table
from lodestar.llm.letters import LetterWords

ORDER = 4
SAMPLE_ROWS = 400
TOTAL_ROWS = 40_000
#: Places times languages that are scored at a time.
SCORES_AT_A_TIME = 1 << 22
SAMPLE_BYTES = 16_384
#: Where words are chosen from a long text, runs of more letters than this (scripts without spaces) count as several words.
LONGEST_WORD = 256
REJECT_SIGMAS = 8.0
REJECT_LETTERS = 40
UNDETERMINED = "und"

_START, _END = 1, 2


class Grams:
    """n-grams of marked words: for each order, hash, context hash and suffix hash of every position that has them."""

    def __init__(self, words: LetterWords, which: np.ndarray) -> None:
        length = words.end[which] - words.start[which]
        bounds = np.concatenate([[0], np.cumsum(length + 2)])
        self.points = np.empty(bounds[-1], np.uint64)
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length + 2)
        source = np.repeat(words.start[which], length + 2) + place - 1
        inner = (place > 0) & (place < np.repeat(length + 1, length + 2))
        self.points[inner] = words.points[source[inner]]
        self.points[place == 0] = _START
        self.points[bounds[1:] - 1] = _END
        self.place = place
        self.word = np.repeat(np.arange(len(which)), length + 2)

    def keys(self, order: int, skip: int = 0) -> np.ndarray:
        """Hash of the n-gram of ``order`` characters that ends ``skip`` characters before each position."""
        h = np.full(len(self.points), np.uint64(order))
        for back in range(order):
            c = np.zeros(len(self.points), np.uint64)
            at = back + skip
            c[at:] = self.points[: len(self.points) - at] if at else self.points
            h += mix(c + np.uint64(1)) * _MULT[back]
        return mix(h)


def _counts(grams: Grams, weight: np.ndarray, order: int) -> list[dict[str, np.ndarray]]:
    """Distinct n-grams of one language by order (index 0: order 1): key, context, suffix and Kneser-Ney count."""
    out = []
    for k in range(1, order + 1):
        at = np.flatnonzero((grams.place >= k - 1) & (grams.place > 0))
        key, first, index = np.unique(grams.keys(k)[at], return_index=True, return_inverse=True)
        out.append({"key": key, "context": grams.keys(k - 1, 1)[at][first], "suffix": grams.keys(k - 1)[at][first], "raw": np.bincount(index, weight[grams.word[at]], len(key)), "opens": grams.place[at][first] == k - 1})
    for k in range(order):
        out[k]["count"] = out[k]["raw"].copy()
        if k + 1 < order:  # n-grams that don't open a word count by the characters seen before them
            longer = np.searchsorted(out[k]["key"], out[k + 1]["suffix"])
            before = np.bincount(longer, minlength=len(out[k]["key"]))
            inner = ~out[k]["opens"]
            out[k]["count"][inner] = np.maximum(before[inner], 1)
    return out


class CharModels:
    """Models of all languages in sorted hash arrays."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER) -> None:
        self.languages, self.order = sorted(samples), order
        seen = []
        for language in self.languages:
            words = LetterWords(pa.array(samples[language], pa.string()))
            _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            seen.append(_counts(Grams(words, first), n.astype(float), order) if len(first) else None)
        self.keys, self.log_p, self.contexts, self.log_back = [], [], [], []
        below: tuple[np.ndarray, np.ndarray] | None = None
        n = len(self.languages)
        for k in range(order):
            some = [(i, s[k]) for i, s in enumerate(seen) if s]
            keys = np.unique(np.concatenate([s["key"] for _, s in some])) if some else np.zeros(0, np.uint64)
            contexts = np.unique(np.concatenate([s["context"] for _, s in some])) if some else np.zeros(0, np.uint64)
            context_of, suffix_of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            p, back = np.zeros((len(keys), n)), np.ones((len(contexts), n))
            for i, s in some:
                at, own = np.searchsorted(keys, s["key"]), np.searchsorted(contexts, s["context"])
                context_of[at] = own
                if k:
                    suffix_of[at] = np.searchsorted(below[0], s["suffix"])
                count = s["count"]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(own, count, len(contexts))
                types = np.bincount(own, minlength=len(contexts))
                held = total > 0
                back[held, i] = discount * types[held] / total[held]
                p[at, i] = np.maximum(count - discount, 0) / total[own]
            if k:
                p += back[context_of] * below[1][suffix_of]
            else:
                p += back[context_of] / (len(keys) + 1)
            below = (keys, p)
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.log_p.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
            self.log_back.append(np.log(np.maximum(back, 1e-12)).astype(np.float32))
        self.unknown = -np.log(len(self.keys[0]) + 1.0)
        self.limits = np.full(n, np.inf)

    def log_probabilities(self, grams: Grams) -> np.ndarray:
        """(positions, languages); the start marks have 0."""
        out = np.zeros((len(grams.points), len(self.languages)), np.float32)
        todo = np.flatnonzero(grams.place > 0)
        for k in range(self.order - 1, -1, -1):
            can = grams.place[todo] >= k
            at = todo[can]
            key = grams.keys(k + 1)[at]
            place = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][place] == key
            out[at[hit]] += self.log_p[k][place[hit]]
            missed = at[~hit]
            context = grams.keys(k, 1)[missed]
            place = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][place] == context
            out[missed[known]] += self.log_back[k][place[known]]
            todo = np.sort(np.concatenate([todo[~can], missed]))
        out[todo] += self.unknown
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by row and language, letters by row); no letters: infinite."""
        words = LetterWords(texts)
        _, first, index = np.unique(words.hashes(), return_index=True, return_inverse=True)
        total = np.zeros((len(words), len(self.languages)))
        letters = np.zeros(len(words), np.int64)
        if len(first):
            rows = words.rows()
            places = np.cumsum(words.end[first] - words.start[first] + 2)
            cuts = np.searchsorted(places, np.arange(1, places[-1] * len(self.languages) // SCORES_AT_A_TIME + 1) * (SCORES_AT_A_TIME // len(self.languages)))
            for a, b in zip([0, *cuts], [*cuts, len(first)]):
                if a == b:
                    continue
                grams = Grams(words, first[a:b])
                log_p = self.log_probabilities(grams)
                own = (index >= a) & (index < b) if b - a < len(first) else slice(None)
                for i in range(len(self.languages)):
                    by_word = np.bincount(grams.word, log_p[:, i], b - a)
                    total[:, i] += np.bincount(rows[own], by_word[index[own] - a], len(words))
            letters = np.bincount(rows, words.end - words.start, len(words)).astype(np.int64)
        n = letters + words.counts
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n[:, None] > 0, -total / n[:, None], np.inf), letters

    def calibrate(self, kept: dict[str, list[str]]) -> None:
        for i, language in enumerate(self.languages):
            texts = kept.get(language, [])
            if texts:
                h, letters = self.entropies(pa.array(texts, pa.string()))
                own = h[letters >= REJECT_LETTERS, i]
                if len(own):
                    self.limits[i] = own.mean() + REJECT_SIGMAS * max(own.std(), 0.2)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) by row."""
        if not self.languages:
            n = len(texts)
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        h, letters = self.entropies(texts)
        best = h.argmin(1)
        lowest = h[np.arange(len(h)), best]
        none = letters == 0
        gap = np.where(none[:, None], 0.0, h - np.where(none, 0.0, lowest)[:, None])
        gap[none] = 0.0
        score = 1.0 / np.exp(-gap * np.minimum(letters, 60)[:, None]).sum(1)
        score[none] = 0.0
        rejected = none | ((letters >= REJECT_LETTERS) & (lowest > self.limits[best]))
        return [UNDETERMINED if x else self.languages[b] for x, b in zip(none, best)], score, np.where(none, 0.0, lowest), rejected


def thinned(text: str, most: int = SAMPLE_BYTES) -> str:
    """Letter words from all over a text, in their order, of at most ``most`` bytes in all; chosen by the hash of their place."""
    words = LetterWords(pa.array([text], pa.large_string()))
    parts = -(-(words.end - words.start) // LONGEST_WORD)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(words.start, parts) + place * LONGEST_WORD
    end = np.minimum(start + LONGEST_WORD, np.repeat(words.end, parts))
    size = np.concatenate([[0], np.cumsum(1 + sum((words.points >= p).astype(np.int64) for p in (0x80, 0x800, 0x10000)))])
    order = np.argsort(mix(np.arange(len(start), dtype=np.uint64) * _MULT[0] + _MULT[1]), kind="stable")
    taken = np.searchsorted(np.cumsum((size[end] - size[start])[order] + 1), most, "right")  # a space beside each
    return " ".join(words.points[start[w] : end[w]].tobytes().decode("utf-32-le", "surrogatepass") for w in np.sort(order[:taken]))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "t"):
            texts = [thinned(t) if len(t) * 4 > SAMPLE_BYTES and len(t.encode("utf-8", "surrogatepass")) > SAMPLE_BYTES else t for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"i": part.column("i"), "l": part.column("l"), "t": pa.array(texts, pa.string())})


def sampled(usable: DataFrame, rows: int = SAMPLE_ROWS, total_rows: int = TOTAL_ROWS) -> DataFrame:
    """About ``rows`` of the rows (i, l, t) of each value of l; rows equal in all three count once."""
    counts = persisted(usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = counts.count()
    each = max(1, min(rows, total_rows // max(1, languages)))
    draw = F.xxhash64(F.lit("sample"), "i", "l", "t")
    share = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < each / F.col("n")
    drawn = usable.join(F.broadcast(counts) if languages <= BROADCAST_IDS else counts, "l").filter(share | (F.col("n") <= each))
    thin = drawn.select("i", "l", "t").mapInArrow(released(_thin), usable.schema)
    # a row that is repeated is drawn with all its copies: one stands for them
    return thin.dropDuplicates(["i", "l", "t"])


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> CharModels:
    """Models of every language among the training rows, from a sample of about ``rows`` of each, of at most ``SAMPLE_BYTES`` a row."""
    known = train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    usable = docs.filter(known).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).cast("string").alias("t"))
    sample = sampled(usable, rows).toPandas().sort_values(["l", "i", "t"], kind="stable")
    fitted: dict[str, list[str]] = {}
    kept: dict[str, list[str]] = {}
    for n, (language, text) in enumerate(zip(sample["l"], sample["t"])):
        (kept if n % 5 == 4 else fitted).setdefault(language, []).append(text)
    for language, texts in kept.items():
        fitted.setdefault(language, texts)
    models = CharModels(fitted)
    models.calibrate(kept)
    return models


def _predict(models: CharModels, carry: list[str], text: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                language, score, entropy, rejected = models.predict(part.column(text))
                found = {"lang_pred": pa.array(language, pa.string()), "score": pa.array(score), "cross_entropy": pa.array(entropy), "rejected": pa.array(rejected)}
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in carry} | found)

    return predict


def identify(docs: DataFrame, models: CharModels, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) of every row with lang_pred, score, cross_entropy and rejected."""
    carry = docs.columns if carry is None else carry
    names = [f"__c{i}" for i in range(len(carry))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)]
    if text_col in carry and docs.schema[text_col].dataType.simpleString() == "string":
        text = names[carry.index(text_col)]  # carried anyway: sent once
    else:
        text = "__text"
        columns.append(F.col(f"`{text_col}`").cast("string").alias(text))
    source = docs.select(*columns)
    schema = ", ".join([*[f"{n} {source.schema[n].dataType.simpleString()}" for n in names], "lang_pred string, score double, cross_entropy double, rejected boolean"])
    out = source.mapInArrow(released(_predict(models, names, text)), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "lang_pred", "score", "cross_entropy", "rejected")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document; fold 0 of 5 is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 0
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), fit(docs, ~held), carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
