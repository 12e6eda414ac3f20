"""Best-fit packing by minimum bin slack.

Documents become token ids (byte-level BPE and a closing id), documents longer than a sequence are
cut into full pieces with the shorter piece first, and pieces are packed into sequences of at most
``capacity`` tokens. Bin by bin, the fullest feasible combination of the available lengths that holds
the longest one is found by bitset subset-sum dynamic programming and removed.

Only the *histogram* of piece lengths decides the packing, and that is at most ``capacity`` counters
whatever the input. The driver plans on the histogram: one planning step finds a combination and
removes it as many times as the counts allow, so the number of steps is bounded by the number of
lengths (each step uses up one), not by the number of bins. The plan, a few thousand rows, is looked
up by the executors: the r-th piece of length L goes to the place the plan has for the r-th use of L.
The rank r is a per-task counter plus an offset from a cumulative count by (length, task), so no
length, however common, meets in one task.

Ids are those of the ``tokenizers`` library. A text of ASCII, Latin letters and plain white space is
encoded by ``tiktoken`` over the same vocabulary, whose ids are the same (tests hold one against the
other). Any other text is cut at line feeds between non-space characters, where the pre-tokeniser
always cuts, and lines that ``tiktoken`` can't take, or the whole text where white space adjoins, go to
``tokenizers`` itself; so do words and runs of white space of over ``LONGEST_RUN`` characters, on which
``tiktoken`` takes quadratic time. Nothing but the vocabulary is kept between texts.

Edge cases: null text counts as empty and yields one piece of the closing id. Repeated ids and rows
each yield their own pieces. An empty table yields no rows. A null id stays null.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.blocks import persisted, released, slices, table

CAPACITY = 1024
END_ID = 2
LONGEST_RUN = 999
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class Encoder:
    """Text to little-endian uint32 ids, without special tokens; their strings are ordinary text."""

    _ADJOINING = re.compile(r"\s\s|^\s|\s$")
    _OTHER_SPACE = re.compile(r"[^\S \n]")
    _RUN = f"[!-~À-ÖØ-öø-ɏ]{{0,{LONGEST_RUN}}}+"
    _SIMPLE = re.compile(f"(?:{_RUN}[ \\t\\n\\r]{{1,{LONGEST_RUN}}}+)*+{_RUN}")
    #: The pre-tokeniser's pattern, a fixed value of byte-level vocabularies.
    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merged]
        special = set(self.whole.get_added_tokens_decoder())
        self.fast = None
        if ids == sorted(ids) and len(set(ids)) == len(ids):  # the ids order the merges, so ranks may stand for them
            mergeable = {k: v for k, v in ranks.items() if v not in special}
            self.fast = tiktoken.Encoding("texts", pat_str=self._SPLIT, mergeable_ranks=mergeable, special_tokens={})

    def _run(self, text: str) -> list[int]:
        if self.fast and self._SIMPLE.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast and self._SIMPLE.fullmatch(text):
            ids = self.fast.encode_ordinary(text)
        elif self._ADJOINING.search(text) or self._OTHER_SPACE.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            feed, ids = self._run("\n"), []
            for k, line in enumerate(text.split("\n")):
                ids += (feed if k else []) + self._run(line)
        return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "task long, seq long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, used = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: dict[str, list] = {c: [] for c in ("task", "seq", "doc_id", "piece", "start", "length", "ids_crc32")}
                ids: list[bytes] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = enc.encode(text or "") + end
                    n = len(data) // 4
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        for name, v in zip(rows, (task, int(used[b - a]), doc_id, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b]))):
                            rows[name].append(v)
                        used[b - a] += 1
                        if keep_ids:
                            ids.append(data[4 * a : 4 * b])
                columns = {k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in rows.items()}
                if keep_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, uses) of the fullest combination that holds the longest available length.

    Bit s of a reach set says that some combination sums to s. Lengths are taken from the longest
    down; counts are split into powers of two. Among equally full combinations the one with the
    longer lengths wins, as sets are walked back from the last added."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    longest = lengths[0]
    room = capacity - longest
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left = min(int(counts[length]) - (length == longest), room // length)
        size = 1
        while left > 0:
            take = min(size, left)
            grown = (reach | (reach << (length * take))) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    uses = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            uses[length] = uses.get(length, 0) + take
            total -= length * take
    return sorted(uses.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, uses per bin, first bin, offset): ranks first .. first + ranks - 1
    of a length fill ``uses`` places a bin, from the bin and the offset named."""
    counts = np.zeros(capacity + 1, object)
    for length, n in histogram.items():
        counts[length] = int(n)
    taken, bins, rows = dict.fromkeys(histogram, 0), 0, []
    while any(counts):
        combination = fullest(counts, capacity)
        times = min(int(counts[length]) // uses for length, uses in combination)
        offset = 0
        for length, uses in combination:
            rows.append((length, taken[length], times * uses, uses, bins, offset))
            taken[length] += times * uses
            counts[length] -= times * uses
            offset += length * uses
        bins += times
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document and in a sequence, with ``ids`` (binary, little-endian
    uint32) if keep_ids."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    more = ", ids binary" if keep_ids else ""
    pieces = persisted(source.mapInArrow(released(_cut(path, capacity, end_id, keep_ids)), PIECES + more), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    planned = plan(histogram, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("seq"))
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(released(_place(planned)), placed + more)


def _place(planned: list[tuple[int, int, int, int, int, int]]):
    """Looks each (length, rank) up in the plan, which is at most a few rows per length and step."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.array(sorted(planned), np.int64).reshape(-1, 6)
        lengths = table_[:, 0]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for own in np.unique(length):
                at = length == own
                a, b = np.searchsorted(lengths, [own, own + 1])
                row[at] = a + np.searchsorted(table_[a:b, 1], rank[at], "right") - 1
            use = rank - table_[row, 1]
            uses = table_[row, 3]
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns |= {"sequence_id": pa.array(table_[row, 4] + use // uses), "offset": pa.array(table_[row, 5] + use % uses * length)}
            if "ids" in batch.schema.names:
                columns["ids"] = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_pydict(columns)

    return place


def op10_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
