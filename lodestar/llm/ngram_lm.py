"""Language-model scoring by a weighted backoff automaton over the whole corpus.

Tokens are words (A-Z lower-cased) and one end per text. States are the histories seen in training. A
state h has an arc for each token seen after it, of weight

    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K)

and one failure arc, to the history h' without its oldest token, of weight K / (c(h) + K); an unseen
history fails with weight 1. The state without history has p(w) = (c(w) - D) / N for the V tokens seen,
and D V / N for the class of unknown tokens, where D V is the number of tokens seen once (D at most
0.9). Each state's weights sum to 1. A text is scored in one left-to-right traversal that carries the
state and sums log10 weights.

The automaton grows with the corpus, so no machine holds it. The counts behind its arcs live in buckets
of hashed n-grams, and each block of texts builds just the part that its own traversal can touch:

1. texts are cut into *blocks* of about ``BLOCK_BYTES``, tokenised once, and written;
2. each block sends its *distinct* n-grams with their training counts, as sorted compressed hash
   arrays, to the buckets (one shuffle; a frequent n-gram arrives once a block, however often it occurs);
3. each bucket adds the counts up and answers every block in the order in which it asked, so answers
   need no keys;
4. each block is joined with its answers, compiled into states and arcs (:class:`Automaton`) and walked.
   Long texts are walked in lanes of ``LANE`` tokens side by side: a state depends on the last order - 1
   tokens only, so a lane that starts so many tokens early, in the state without history, is in the
   right state when its own tokens begin.

A block asks at most ``FAN_IN`` others' company of a bucket: where there are more blocks, groups of them
are added up first and ask in the blocks' place, level by level, so that a frequent n-gram - asked for by
every block - never meets more than ``FAN_IN`` requests in one task. The numbers of buckets and of
shuffle partitions grow with the input; a block and a bucket have bounded memory. Totals N, V and the
number of tokens seen once are the only values that reach the driver.

Edge cases: null text is empty: one token, the end. A null id falls in fold 0, so it is trained on and
comes back as null. Repeated rows count as often as they occur. With no training text all weights are
those of an empty state: score and base score are log10(1 / (V + 1)) a token. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import _MULT, Words, fold, mix, persisted, released, slices, table

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
PART_BYTES = 8 << 20
FAN_IN = 4096
LANE = 512
ORDER = 3
PRIOR = 4.0
MAX_DISCOUNT = 0.9

_END, _START = np.uint64(1), np.uint64(2)
_C = np.uint64(0x9E3779B97F4A7C15)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as zstd of their byte planes; the first 9 bytes are the item size and the length."""
    if values.dtype.kind in "iu" and len(values) and values.dtype != np.uint32 and int(values.max()) < 1 << 32:
        values = values.astype(np.uint32)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return bytes([values.itemsize]) + len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def expand(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, size * n)), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(np.uint32 if size == 4 else np.uint64).astype(np.uint64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, bounds of the rows): the words of each row, then the end."""
    words = Words(texts)
    bounds = words.first + np.arange(len(words) + 1)
    out = np.full(int(bounds[-1]), _END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = np.maximum(words.hashes(), np.uint64(3))
    return out, bounds


BLOCKS = "block string, bytes long, doc_id array<long>, held array<boolean>, bounds binary, vocabulary binary, tokens binary"


def _blocks(most: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, held_parts, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate([t for _, t, _ in held_parts])
            base = np.cumsum([0, *(len(t) for _, t, _ in held_parts)])
            bounds = np.concatenate([b[:-1] + x for (_, _, b), x in zip(held_parts, base)] + [base[-1:]])
            vocabulary, index, often = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent tokens get small numbers, which pack well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            vocabulary, index = vocabulary[order], rank[index]
            ids = pa.concat_arrays([p.column("doc_id") for p, _, _ in held_parts])
            held = pa.concat_arrays([p.column("held") for p, _, _ in held_parts])
            return pa.RecordBatch.from_pydict({"block": pa.array([f"{task}-{serial}"]), "bytes": pa.array([size], pa.int64()), "doc_id": pa.ListArray.from_arrays([0, len(ids)], ids), "held": pa.ListArray.from_arrays([0, len(held)], held), "bounds": pa.array([squeeze(bounds.astype(np.uint64))]), "vocabulary": pa.array([vocabulary.tobytes()]), "tokens": pa.array([squeeze(index.astype(np.uint32))])})

        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = _tokens(part.column("text"))
                held_parts.append((part, tokens, bounds))
                size += 8 * part.num_rows + part.column("text").nbytes
                if size >= most:
                    yield out()
                    serial, held_parts, size = serial + 1, [], 0
        if held_parts:
            yield out()

    return blocks


class Block:
    """Tokens of a block's texts and the hashes of their n-grams."""

    def __init__(self, bounds: bytes, vocabulary: bytes, tokens: bytes) -> None:
        self.bounds = expand(bounds).astype(np.int64)
        self.tokens = np.frombuffer(vocabulary, np.uint64)[expand(tokens).astype(np.int64)]

    def keys(self, order: int) -> np.ndarray:
        """60-bit hash of the n-gram that ends at each token; before a text stand start symbols."""
        total = np.zeros(len(self.tokens), np.uint64)
        place = np.arange(len(self.tokens)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        for back in range(order):
            token = np.full(len(self.tokens), _START, np.uint64)
            token[back:] = self.tokens[: len(self.tokens) - back] if back else self.tokens
            token[place < back] = _START
            total += mix(token + np.uint64(back + 1)) * _MULT[back]
        return mix(total + np.uint64(order)) >> np.uint64(4)

    def of_rows(self, values: list[bool]) -> np.ndarray:
        return np.repeat(np.array(values, bool), np.diff(self.bounds))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the keys."""
    return ((keys >> np.uint64(28)) * np.uint64(buckets)) >> np.uint64(32)


def _requests(order: int, buckets: int):
    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["bounds"], r["vocabulary"], r["tokens"])
                train = ~block.of_rows(r["held"])
                for k in range(1, order + 1):
                    keys, index = np.unique(block.keys(k), return_inverse=True)
                    counts = np.bincount(index[train], minlength=len(keys)).astype(np.uint64)
                    own = _bucket(keys, buckets)
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                    last = np.append(first[1:], len(own))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(own[first].astype(np.int64)), "ngram": pa.array(np.full(len(first), k, np.int32)), "block": pa.array([r["block"]] * len(first)), "keys": pa.array([squeeze(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(first, last)], pa.binary()), "counts": pa.array([squeeze(counts[a:b]) for a, b in zip(first, last)], pa.binary())})

    return requests


REQUESTS = "bucket long, ngram int, block string, keys binary, counts binary"
ANSWERS = "bucket long, ngram int, block string, counts binary, tokens long, types long, singles long"


def _kind(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def _asked(bucket: pa.Table) -> Iterator[tuple[int, list[str], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (order, who asks, their sorted keys, all distinct keys, their summed counts, where each key of each is among them)."""
    orders, who = bucket.column("ngram").to_pylist(), bucket.column("block").to_pylist()
    keys, counts = bucket.column("keys").to_pylist(), bucket.column("counts").to_pylist()
    for k in sorted(set(orders)):
        own = [i for i, o in enumerate(orders) if o == k]
        asked = [np.cumsum(expand(keys[i]), dtype=np.uint64) for i in own]
        found, index = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(found), np.uint64)
        np.add.at(total, index, np.concatenate([expand(counts[i]) for i in own]))
        yield k, [who[i] for i in own], asked, found, total, index


def _answer(bucket: pa.Table) -> pa.Table:
    """Adds the counts of one bucket up and answers each request in its own order."""
    out: dict[str, list] = {c: [] for c in _kind(ANSWERS).names}
    for k, who, asked, _, total, index in _asked(bucket):
        at = 0
        for n, (block, keys) in enumerate(zip(who, asked)):
            once = (int(total.sum()), int((total > 0).sum()), int((total == 1).sum())) if n == 0 else (0, 0, 0)
            row = (bucket.column("bucket")[0].as_py(), k, block, squeeze(total[index[at : at + len(keys)]]), *once)
            for c, v in zip(out, row):
                out[c].append(v)
            at += len(keys)
    return pa.Table.from_pydict(out, schema=_kind(ANSWERS))


def _merge(group: pa.Table) -> pa.Table:
    """The requests of a group of blocks to one bucket as one request."""
    bucket, name = (group.column(c)[0].as_py() for c in ("bucket", "band"))
    rows = [(bucket, k, name, squeeze(np.diff(found, prepend=np.uint64(0))), squeeze(total)) for k, _, _, found, total, _ in _asked(group)]
    return pa.Table.from_pydict(dict(zip(_kind(REQUESTS).names, map(list, zip(*rows)))), schema=_kind(REQUESTS))


def _hand_down(group: pa.Table, above: pa.Table) -> pa.Table:
    """Answers the requests of a group of blocks by the answer to their joint request."""
    totals = {k: expand(c) for k, c in zip(above.column("ngram").to_pylist(), above.column("counts").to_pylist())}
    out: dict[str, list] = {c: [] for c in _kind(ANSWERS).names}
    for k, who, asked, _, _, index in _asked(group):
        at = 0
        for block, keys in zip(who, asked):
            row = (group.column("bucket")[0].as_py(), k, block, squeeze(totals[k][index[at : at + len(keys)]]), 0, 0, 0)
            for c, v in zip(out, row):
                out[c].append(v)
            at += len(keys)
    return pa.Table.from_pydict(out, schema=_kind(ANSWERS))


def answered(requests: DataFrame, blocks: int, parts: int, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(answers to all requests, those that hold the totals): a tree whose nodes take at most about ``fan_in`` requests."""
    if blocks <= fan_in:
        answers = persisted(requests.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWERS), "answers")
        return answers, answers
    bands = -(-blocks // fan_in)
    banded = persisted(requests.withColumn("band", F.pmod(F.xxhash64("block"), F.lit(bands)).cast("string")), "requests")
    spread = banded.repartition(parts, "bucket", "band")
    merged = persisted(spread.groupBy("bucket", "band").applyInArrow(_merge, REQUESTS), "merged")
    above, totals = answered(merged, bands, parts, fan_in)
    above = above.withColumnRenamed("block", "band").repartition(parts, "bucket", "band")
    answers = spread.groupBy("bucket", "band").cogroup(above.groupBy("bucket", "band")).applyInArrow(_hand_down, ANSWERS)
    return persisted(answers, "answers"), totals


class Automaton:
    """The states and arcs that the texts of one block can reach.

    States: 0 has no history; 1 .. order - 1 have so many start symbols; the others are the seen n-grams of
    1 to order - 1 tokens. ``fail`` and ``fail_weight`` are the failure arcs. The arc of a state of length L for
    a token is the (L + 1)-gram that ends there; ``weight`` is NaN where training has not seen it, so that
    no arc is stored."""

    def __init__(self, block: Block, grams: list[np.ndarray], counts: list[np.ndarray], texts: int, tokens: int, types: int, singles: int, prior: float) -> None:
        """grams[k] numbers the (k + 1)-gram that ends at each token of the block; counts[k] are their training counts."""
        self.block, self.order, self.grams = block, len(counts), grams
        n, self.first = len(block.tokens), np.zeros(len(block.tokens), bool)
        self.first[block.bounds[:-1]] = True
        discount = min(MAX_DISCOUNT, max(singles, 1) / types) if types else 0.0
        self.unknown = float(np.log10(discount * types / tokens)) if tokens else float(-np.log10(types + 1.0))
        base = [self.order]  # the first state of each length
        for c in counts[:-1]:
            base.append(base[-1] + len(c))
        self.length, self.fail = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
        self.fail_weight = np.zeros(base[-1])
        self.length[: self.order], self.fail[1 : self.order] = np.arange(self.order), np.arange(self.order - 1)
        self.fail_weight[1 : self.order] = np.log10(prior / (texts + prior))
        self.weight, self.target = [], []
        below = np.zeros(0)
        for k, (gram, c) in enumerate(zip(grams, counts)):
            at = np.zeros(len(c), np.int64)
            at[gram] = np.arange(n)  # a place of each n-gram
            seen = c > 0
            if k == 0:
                p = (c.astype(np.float64) - discount) / max(tokens, 1)
            else:
                history = np.where(self.first[at], texts, counts[k - 1][grams[k - 1][at - 1]]).astype(np.float64)
                p = (c + prior * below[grams[k - 1][at]]) / (history + prior)
            if k + 1 < self.order:
                states = base[k] + np.arange(len(c))
                self.length[states] = k + 1
                self.fail[states] = base[k - 1] + grams[k - 1][at] if k else 0
                self.fail_weight[states] = np.log10(prior / (c + prior))
            else:
                states = base[k - 1] + grams[k - 1][at] if k else np.zeros(len(c), np.int64)
            self.weight.append(np.where(seen, np.log10(np.where(seen, p, 1.0)), np.nan))
            self.target.append(states)
            below = p

    def lanes(self, size: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first own token, one past the last) of each lane."""
        starts, ends = self.block.bounds[:-1], self.block.bounds[1:]
        parts = -(-(ends - starts) // size)
        text = np.repeat(np.arange(len(starts)), parts)
        begin = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
        return text, begin, np.minimum(begin + size, ends[text])

    def walk(self, size: int = LANE) -> np.ndarray:
        """log10 probability of each text, by one walk from its first token to its end."""
        text, begin, end = self.lanes(max(size, self.order))
        early = np.where(self.first[begin], 0, self.order - 1)
        order = np.argsort(begin - early - end, kind="stable")  # longest first
        text, begin, end, early = text[order], begin[order], end[order], early[order]
        at, steps = begin - early, end - begin + early
        state = np.where(early > 0, 0, self.order - 1)
        total = np.zeros(len(text))
        for step in range(int(steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(-steps, -step, "left"))
            gained, todo = np.zeros(live), np.arange(live)
            while len(todo):
                s = state[todo]
                reached = np.full(len(todo), np.nan)
                length = self.length[s]
                for k in range(self.order):
                    own = np.flatnonzero(length == k)
                    arc = self.grams[k][at[todo[own]] + step]
                    reached[own] = self.weight[k][arc]
                    there = np.isfinite(reached[own])
                    state[todo[own[there]]] = self.target[k][arc[there]]
                missed = np.isnan(reached)
                lost = missed & (s == 0)  # an unknown token: the state without history has one arc for all of these
                reached[lost] = self.unknown
                failing = missed & (s != 0)
                reached[failing] = self.fail_weight[s[failing]]
                gained[todo] += reached
                state[todo[failing]] = self.fail[s[failing]]
                todo = todo[failing]
            own = step >= early[:live]
            total[:live][own] += gained[own]
        return np.bincount(text, total, len(self.block.bounds) - 1)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, texts: int, tokens: int, types: int, singles: int, prior: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                block, grams, counts = Block(r["bounds"], r["vocabulary"], r["tokens"]), [], []
                for k in range(1, order + 1):
                    grams.append(np.unique(block.keys(k), return_inverse=True)[1].astype(np.int32))
                    answers = sorted((a["bucket"], a["counts"]) for a in r["answers"] if a["ngram"] == k)
                    counts.append(np.concatenate([expand(c) for _, c in answers]).astype(np.int64))
                starts = block.bounds[:-1]
                known = counts[0][grams[0]]
                base = np.log10((known + 1) / (tokens + types + 1.0))
                scores = Automaton(block, grams, counts, texts, tokens, types, singles, prior).walk()
                columns = {"doc_id": pa.array(r["doc_id"], pa.int64()), "held_out": pa.array(r["held"], pa.bool_()), "n_tokens": pa.array(np.diff(block.bounds))}
                columns |= {"n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)), "train_tokens": pa.array(np.full(len(starts), tokens, np.int64))}
                yield pa.RecordBatch.from_pydict(columns | {"base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(scores)})

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: F.Column | None = None, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Scores of all texts under the automaton of those that ``held`` (a boolean column) excludes from training."""
    held = F.lit(False) if held is None else held
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), held.alias("held"))
    blocks = persisted(source.mapInArrow(released(_blocks(block_bytes)), BLOCKS), "blocks")
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sum(F.size(F.filter("held", lambda x: ~x))).alias("texts")).first()
    buckets = max(16, (size["b"] or 0) // BUCKET_BYTES)
    parts = max(16, (size["b"] or 0) // PART_BYTES)
    requests = blocks.select("block", "held", "bounds", "vocabulary", "tokens").mapInArrow(released(_requests(order, buckets)), REQUESTS)
    answers, totals = answered(requests, size["n"], parts, fan_in)
    total = totals.filter("ngram = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "singles")]).first()
    by_block = answers.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("ngram", "bucket", "counts")).alias("answers"))  # as many as the block asked for
    joined = blocks.drop("bytes").repartition(parts, "block").join(by_block, "block")
    return joined.mapInArrow(released(_score(order, size["texts"] or 0, total["tokens"], total["types"], total["singles"], prior)), SCORES)


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents; fold 2 of 7 is held out of training."""
    return score_texts(table(spark, sf_dir, "documents"), held=fold("doc_id", 7) == 2)
