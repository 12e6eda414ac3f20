"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause from left to right. Each takes a word's class with the weight
emitted so far, and passes a weight on:

* *insult*   emits the weight of an insulting word
* *threat*   adds a weight when a target follows a threatening verb within the clause
* *target*   raises what stands within ``REACH`` words after a target ("you", "they"), and at a target adds
  half of the insults up to ``REACH`` words before it
* *negation* lowers what stands within ``REACH`` words after "not", "never", ..
* *reported* lowers what stands in a clause after a verb of saying with "that", a colon or a quotation mark

They are composed, in this order, into one deterministic machine whose states are the tuples of their
states (weights are rounded to quarters, so states are finite); a clause's score is the sum of what the
machine emits, so matched clauses count, not isolated words. Clauses end at ``. ! ? ;`` and line feeds; a
colon ends one too unless a verb of saying stands before it. A document's score is a logistic function of
the logarithm of its summed clause weights.

The insult weights are learned: terms are letter words and word beginnings of 4 to 7 letters, which
catch inflected and unseen forms. From a bounded sample of labelled texts (up to about ``SAMPLE_ROWS`` rows
of each label, of any length; of texts over ``SAMPLE_BYTES``, whole clauses from all over, chosen by the hash
of their place, stand for the text) come, for each term, the numbers of toxic and clean *groups* of texts
that hold it. A group is the texts with one smallest word hash, so a hundred copies of one text do not
make its words look toxic. Terms enter by a likelihood-ratio test (at most ``FALSE_TERMS`` false ones are
expected among all that are tested; precision of ``LEAST_PRECISION``) and weigh their log odds. A short list of general insults and threats is known
without labels and drops out where the sample speaks against it. Targets and negations are learned the
same way, in any language: a word that stands before insults more often than its number in these texts
explains, and does so in toxic groups and not in clean ones, is a target; one of the opposite kind a negation. The score's base rate is that of all labelled rows.

The lexicon is bounded by the sample, so it is sent to every task. Words are matched by sorted
hashes, whole texts at a time; only clauses with a match are read by the machine.

Edge cases: null and empty texts have no match and get the score of a text without one. Rows with a
null label are not learned from; a null id falls in fold 0 (held out). Without labels, or with one
class only, the general list and a fixed calibration are used. Repeated rows score alike; ids with
several labels or texts are learned from with each; rows equal in all three count once. Empty tables give
no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.blocks import fold, mix, released, slices, table
from lodestar.llm.letters import LetterWords, term_hash

SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 16_384
PREFIXES = (4, 5, 6, 7)
FALSE_TERMS = 0.05
LEAST_PRECISION = 0.7
LEAST_TEXTS = 4
REACH = 3

INSULTS = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumbass", "scum", "scumbag", "worthless", "pathetic", "disgusting", "loser", "losers", "bastard", "bitch", "asshole", "vermin", "retard", "degenerate")
THREATS = ("kill", "hurt", "destroy", "murder", "stab", "shoot", "hang", "strangle", "burn", "beat")
TARGETS = ("you", "your", "yourself", "he", "she", "they", "them", "him", "her", "these", "those", "this")
NEGATIONS = ("not", "never", "no", "isn", "aren", "wasn", "don", "doesn", "nobody", "hardly", "kein", "nicht", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "claimed", "claims", "wrote", "called", "reported", "quoted", "alleged", "sagte", "dit", "dijo")

_CLAUSE = re.compile(r"[^.!?;\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+|[:\"“”«»]")
_QUOTES = frozenset("\"“”«»")


THREAT_WEIGHT, BEFORE, AFTER, DENIED, REPORTED = 4.0, 1.5, 0.5, 0.25, 0.3
#: Weights are multiples of 1 / QUARTERS inside the machine.
QUARTERS = 4


class Transducer:
    """Deterministic: ``step(state, class, level, weight)`` gives the next state and the weight that is passed on."""

    def __init__(self, start, step) -> None:
        self.start, self.step = start, step


def compose(*parts: Transducer) -> Transducer:
    """The machine whose states are tuples of the parts' states, each part reading what the one before it emits; arcs are tabled as they are met."""
    table_: dict = {}

    def step(state, kind: str, level: int):
        key = (state, kind, level)
        found = table_.get(key)
        if found is None:
            weight, states = 0.0, []
            for p, s in zip(parts, state):
                s, weight = p.step(s, kind, level, weight)
                states.append(s)
            found = table_[key] = (tuple(states), weight)
        return found

    return Transducer(tuple(p.start for p in parts), step)


def _insult(state: int, kind: str, level: int, weight: float) -> tuple[int, float]:
    return 0, weight + (level / QUARTERS if kind == "insult" else 0.0)


def _threat(left: int, kind: str, level: int, weight: float) -> tuple[int, float]:
    """Lets a target emit the threat's weight while a threat is pending."""
    if kind == "threat":
        return REACH + 1, weight
    if kind == "target":
        return 0, weight + (THREAT_WEIGHT if left else 0.0)
    return (0 if kind == "colon" else max(0, left - 1)), weight


def _target(state: tuple, kind: str, level: int, weight: float) -> tuple[tuple, float]:
    """State: words left of the reach of a target, and the (age, level) of insults that a target may still follow."""
    left, recent = state
    if kind == "colon":
        return (0, ()), weight
    if kind == "target":
        return (REACH, ()), weight + AFTER * sum(x for _, x in recent) / QUARTERS
    recent = tuple((age + 1, x) for age, x in recent if age < REACH)
    if kind == "insult":
        return (max(0, left - 1), (*recent, (1, level))), weight * (BEFORE if left else 1.0)
    return (max(0, left - 1), recent), weight


def _negation(left: int, kind: str, level: int, weight: float) -> tuple[int, float]:
    if kind == "negation":
        return REACH, weight
    return (0 if kind == "colon" else max(0, left - 1)), weight * (DENIED if left else 1.0)


def _reported(state: int, kind: str, level: int, weight: float) -> tuple[int, float]:
    """0: nothing yet; 1: a verb of saying; 2: inside what is reported."""
    if state == 2:
        return 2, weight * REPORTED
    if kind == "report":
        return 1, weight
    if state == 1 and kind in ("that", "quote", "colon"):
        return 2, weight
    return (0 if kind == "colon" else state), weight


GRAMMAR = compose(Transducer(0, _insult), Transducer(0, _threat), Transducer((0, ()), _target), Transducer(0, _negation), Transducer(0, _reported))


class Grammar:
    """A lexicon with the composed machine. words: term -> weight; prefixes: beginning -> weight."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], slope: float = 1.0, offset: float = -1.5, targets: tuple = (), negations: tuple = ()) -> None:
        self.words, self.prefixes, self.slope, self.offset = words, prefixes, slope, offset
        hits = [term_hash(w, False) for w in (*words, *THREATS)]
        self.word_keys = np.unique(np.array(hits, np.uint64))
        lengths = sorted({len(p) for p in prefixes})
        self.prefix_keys = {n: np.unique(np.array([term_hash(p, True) for p in prefixes if len(p) == n], np.uint64)) for n in lengths}
        kinds = {"target": (*TARGETS, *targets), "negation": (*NEGATIONS, *negations), "report": REPORTS, "threat": THREATS, "that": ("that",), "quote": _QUOTES, "colon": (":",)}
        self.kind = {word: kind for kind, own in kinds.items() for word in own}

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if not found:
            for n in self.prefix_keys:
                if len(word) > n:
                    found = max(found, self.prefixes.get(word[:n], 0.0))
        return found

    def clause(self, text: str) -> float:
        """Sum of the weights that the machine emits."""
        state, total = GRAMMAR.start, 0.0
        for word in _WORD.findall(text.lower()):
            level = math.ceil(QUARTERS * self.weight(word))
            state, emitted = GRAMMAR.step(state, "insult" if level else self.kind.get(word, "other"), level)
            total += emitted
        return total

    def total(self, text: str | None) -> float:
        return sum(map(self.clause, _CLAUSE.findall(text))) if text else 0.0

    def matches(self, texts: pa.Array) -> np.ndarray:
        """Rows with a word of the lexicon."""
        words = LetterWords(texts)

        def among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            return keys[at] == h if len(keys) else np.zeros(len(h), bool)

        hit = among(words.hashes(), self.word_keys)
        for n, keys in self.prefix_keys.items():
            hit |= among(words.hashes(n), keys)
        return np.bincount(words.rows()[hit], minlength=len(words)) > 0

    def probability(self, totals: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.offset + self.slope * np.log1p(totals), -30, 30)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        totals = np.zeros(len(texts))
        for i in np.flatnonzero(self.matches(texts)):
            totals[i] = self.total(texts[i].as_py())
        return self.probability(totals)


def _gain(toxic: float, clean: float, rate: float) -> float:
    n = toxic + clean
    return (toxic * math.log(toxic / (n * rate)) if toxic else 0.0) + (clean * math.log(clean / (n * (1 - rate))) if clean else 0.0)


def least_gain(tests: int) -> float:
    """Nats that a term must gain: chance alone gains g nats with probability of about exp(-g)."""
    return math.log(max(1, tests) / FALSE_TERMS)


def _terms(words: set[str]) -> set[tuple[str, bool]]:
    return {(w, False) for w in words} | {(w[:n], True) for n in PREFIXES for w in words if len(w) > n}


def learn(texts: list[str], labels: list[int], rate_of_all: float | None = None) -> Grammar:
    """A grammar from labelled texts; rate_of_all: the share of toxic rows, if not that of the texts."""
    members: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (text, label) in enumerate(zip(texts, labels)):
        if found := set(_LETTERS.findall(text.lower())):
            members[(label, group_of(found))].append(i)
    # only terms of several toxic texts can enter: others needn't be counted
    often = Counter(t for text, label in zip(texts, labels) if label for t in _terms(set(_LETTERS.findall(text.lower()))))
    often = {t for t, n in often.items() if n >= LEAST_TEXTS} | {(w, False) for w in INSULTS}
    held: tuple[Counter, Counter] = (Counter(), Counter())  # groups of each label by term
    for (label, _), own in members.items():
        held[label].update(_terms({w for i in own for w in _LETTERS.findall(texts[i].lower())}) & often)
    n_toxic = sum(label for label, _ in members)
    n_clean = len(members) - n_toxic
    words: dict[str, float] = {}
    prefixes: dict[str, float] = {}
    if n_toxic and n_clean:
        rate = n_toxic / (n_toxic + n_clean)
        scored, least = {}, least_gain(len(often))
        for t in often:
            toxic, clean = held[1][t], held[0][t]
            if toxic >= LEAST_TEXTS and toxic >= LEAST_PRECISION * (toxic + clean) and (g := _gain(toxic, clean, rate)) >= least:
                scored[t] = (g, math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)))
        for (term, prefix), (_, weight) in sorted(scored.items(), key=lambda x: (-x[1][0], -len(x[0][0]), x[0])):
            (prefixes if prefix else words)[term] = weight
        # a beginning that a single word accounts for says no more than the word
        for p in list(prefixes):
            support = held[1][(p, True)]
            if any(w.startswith(p) and held[1][(w, False)] >= 0.9 * support for w in words):
                del prefixes[p]
        # of nested beginnings with the same texts the longest is the safest
        for p in sorted(prefixes, key=len):
            support = held[1][(p, True)]
            if any(q != p and q.startswith(p) and held[1][(q, True)] >= 0.98 * support for q in prefixes):
                del prefixes[p]
    for w in INSULTS:
        if w not in words and held[0][(w, False)] <= held[1][(w, False)]:
            words[w] = 3.0
    grammar = Grammar(words, prefixes)
    if n_toxic and n_clean:
        grammar = Grammar(words, prefixes, 1.0, -1.5, *_context(grammar, texts, labels))
        slope, offset = _logistic(np.log1p([grammar.total(t) for t in texts]), np.array(labels, float))
        own, all_ = np.mean(labels), np.mean(labels) if rate_of_all is None else rate_of_all
        grammar.slope, grammar.offset = slope, offset + math.log(all_ / (1 - all_)) - math.log(own / (1 - own))
    return grammar


def group_of(words: set[str]) -> int:
    """The texts with one smallest hash of a long word are a group: copies and near copies fall together."""
    return min(hash_of(w) for w in [w for w in words if len(w) > 5] or words)


def _context(grammar: Grammar, texts: list[str], labels: list[int]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(targets, negations): words before insults, more than by chance and in groups of one label, by the test that terms pass."""
    held: dict[str, list[set]] = defaultdict(lambda: [set(), set()])
    chance: dict[str, dict[int, float]] = defaultdict(dict)
    near: list[set] = [set(), set()]
    for text, label in zip(texts, labels):
        words = _LETTERS.findall(text.lower())
        at = [i for i, w in enumerate(words) if grammar.weight(w)]
        if at:
            group = group_of(set(words))
            near[label].add(group)
            before = {k for i in at for k in range(max(0, i - REACH), i)}
            for w in {words[k] for k in before}:
                held[w][label].add(group)
            for w, n in Counter(words).items():
                chance[w][group] = max(chance[w].get(group, 0.0), 1.0 - (1.0 - len(before) / len(words)) ** n)
    n = [max(1, len(x)) for x in near]
    rate = n[1] / (n[0] + n[1])
    found: tuple[list, list] = ([], [])
    least = least_gain(sum(len(c) + len(t) >= LEAST_TEXTS for c, t in held.values()))
    for w, (clean, toxic) in sorted(held.items()):
        seen, expected = len(clean) + len(toxic), max(sum(chance[w].values()), 1e-9)
        close = seen >= LEAST_TEXTS and seen > expected and seen * math.log(seen / expected) - (seen - expected) >= least
        if close and not grammar.weight(w) and w not in grammar.kind and _gain(len(toxic), len(clean), rate) >= least:
            found[0 if len(toxic) > rate * (len(toxic) + len(clean)) else 1].append(w)
    return tuple(found[0]), tuple(found[1])


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for slope and offset with a small penalty on the slope; the slope is not negative."""
    w = np.array([0.0, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - np.array([ridge * w[0], 0.0])
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([ridge, 1e-9])
        move = np.linalg.solve(hessian, gradient)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, -1.5)


def thinned(text: str, most: int = SAMPLE_BYTES) -> str:
    """Whole clauses from all over a text, in their order, of at most ``most`` bytes in all; chosen by the hash of their place."""
    clauses = _CLAUSE.findall(text)
    size = np.array([len(c.encode("utf-8", "surrogatepass")) + 2 for c in clauses], np.int64)
    order = np.argsort(mix(np.arange(len(clauses), dtype=np.uint64) + np.uint64(1)), kind="stable")
    return ". ".join(clauses[i] for i in sorted(order[np.cumsum(size[order]) <= most].tolist()))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [thinned(t) if len(t.encode("utf-8", "surrogatepass")) > SAMPLE_BYTES else t for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(texts, pa.string())], names=["doc_id", "toxic", "text"])


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> Grammar:
    """Learns from about ``rows`` labelled rows of each label of the training fold; train is a column of docs' doc_id."""
    usable = labels.filter(train & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "toxic"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / max(n_toxic, 1)))).otherwise(min(1.0, rows / max(n_clean, 1)))
    chosen = usable.filter(draw < share).distinct()  # about `rows` ids of each label, whatever the input
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    drawn = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(released(_thin), "doc_id long, toxic int, text string")
    # an id may have many texts: of each label at most 2 * rows rows come to the driver
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    drawn = drawn.dropDuplicates().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * rows).drop("r")
    sample = drawn.toPandas().sort_values(["doc_id", "toxic", "text"], kind="stable")
    rate = n_toxic / (n_toxic + n_clean) if n_toxic and n_clean else None
    return learn(sample["text"].tolist(), sample["toxic"].tolist(), rate)


def _score(grammar: Grammar):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = grammar.scores(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return score


def score_documents(docs: DataFrame, grammar: Grammar, held: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(released(_score(grammar)), "doc_id long, held_out boolean, score double, predicted int")


def op3_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; fold 0 of 5 is held out of learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 5) == 0
    return score_documents(docs, fit(docs, labels, ~held), held)
