"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set is that of its distinct shingles (5 words, A-Z lower-cased; with fewer words the
whole sequence). Documents are linked at 100 * intersection >= 75 * union, and components of the link
graph are the groups.

1. *Profile.* One pass computes the set, its size, a 128-bit hash of the set and a SuperMinHash
   signature: shingle i draws a random permutation and uniforms u_0, u_1, ..; position p_i(j) gets the
   minimum of j + u_j. A document stops at the rank that no position can still be improved by, which
   for long documents is the first. Ranks run over all documents of a slice at once.
2. *Classes.* Documents with equal sets form a class, named by its smallest id; only one profile per
   class goes on, so copies never meet in a bucket.
3. *Bands.* 32 bands of 4 values: a pair at 0.75 shares at least one with probability 1 - 5e-6.
   Within a bucket every class is paired with the bucket's smallest member (a star, not all pairs).
4. *Verification.* Pairs whose sizes or signatures can't reach the limit go first (``LEAST_EQUAL``); the
   others are confirmed on full shingle sets, rebuilt from whole texts of just the classes they name.
5. *Union-find.* Components by alternating large-star and small-star hooking on the link table.
6. *Cross pairs.* A star proves too little where a bucket's members stay in different components.
   There members are gathered in blocks of about ``BLOCK`` signatures, and blocks are compared two by two:
   the most alike partner of each member is verified like the pairs above. Members that after this still
   have a partner in another component whose signature can reach the limit are gathered in blocks of
   about ``SET_BYTES`` of full sets, and every such pair of two blocks is confirmed or refuted in one
   task, by an index over the rarest shingles of each set (a quarter and one: sets that reach the limit
   share one of these). Only confirmed links leave it, so nothing grows with the square of a bucket but
   the copies of its blocks: m / BLOCK of each signature, and 8 n / SET_BYTES of each set.

Hot groups: aggregates combine before the shuffle; joins are plain sort-merge joins that adaptive
execution may split; no bucket, class or component is gathered in a task. All intermediate results
that are read twice are tables in the shared folder, deleted once they are spent. Nothing but row
counts reaches the driver.

Edge cases: null, empty or blank texts have no shingles, link to nothing and are their own component.
Rows that repeat an id are one document with several texts: the classes of its texts are linked to each
other, so all its rows share a component. Rows without an id take no part, are kept, and have a null
component. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import _MULT, Words, by_ids, discard, mix, persisted, released, slices, table

WIDTH = 5
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
PERCENT = 75
BLOCK = 4096
SET_BYTES = 8 << 20
#: A pair at the limit has fewer equal values than this with probability below 1e-8 (binomial; SuperMinHash varies less).
LEAST_EQUAL = 67
#: Bytes of signatures that are compared at a time.
COMPARED = 1 << 22

_C = np.uint64(0x9E3779B97F4A7C15)
_S32 = np.uint64(32)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by row and hash."""
    hashes = words.hashes()
    h, at = words.windows(hashes, width)
    rows = words.rows()
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        inside = np.flatnonzero((counts[rows] < width))
        place = inside - words.first[rows[inside]]
        whole = np.zeros(len(words), np.uint64)
        np.add.at(whole, rows[inside], hashes[inside] * _MULT[place])
        h = np.concatenate([h, mix(whole[short] + counts[short].astype(np.uint64) * _C)])
        row = np.concatenate([rows[at], short])
    else:
        row = rows[at]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return row, h


def super_minhash(row: np.ndarray, h: np.ndarray, n_rows: int, size: int = SIZE) -> np.ndarray:
    """Signatures (n_rows, size) of the sets of (row, hash): rank << 32 | uniform bits; all ones for no elements."""
    sig = np.full(n_rows * size, _FULL, np.uint64)
    picks: list[np.ndarray] = []
    for j in range(size):
        if not len(h):
            break
        draw = mix(h + np.uint64((j + 1) * int(_C) & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((draw >> _S32) * np.uint64(size - j)) >> _S32).astype(np.int64)
        place = pick.copy()
        for i in range(j - 1, -1, -1):  # undo the swaps of earlier ranks
            place[place == picks[i]] = i
        np.minimum.at(sig, row * size + place, (draw & np.uint64(0xFFFFFFFF)) | (np.uint64(j) << _S32))
        picks.append(pick.astype(np.int16))
        top = sig.reshape(n_rows, size).max(1) >> _S32
        going = top[row] > j  # else no later rank can improve the row
        if not going.all():
            row, h = row[going], h[going]
            picks = [p[going] for p in picks]
    return sig.reshape(n_rows, size)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), np.uint64)
    for k in range(rows):
        key += mix(parts[:, :, k]) * _MULT[k]
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * _C).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            row, h = shingle_sets(words)
            n = np.bincount(row, minlength=len(words))
            h1, h2 = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
            np.add.at(h1, row, mix(h))
            np.add.at(h2, row, mix(h ^ _C))
            sig = super_minhash(row, h, len(words))
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sig).ravel()), BANDS).cast(pa.list_(pa.int64()))
            low = sig.astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "bands": keys, "sig": pa.array([s.tobytes() for s in low], pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            row, h = shingle_sets(words)
            cut = np.searchsorted(row, np.arange(len(words) + 1))
            yield pa.RecordBatch.from_pydict({"node": part.column("doc_id"), "shingles": pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the limit."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or 100 * len(p) < percent * len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y")]
            keep = pa.array([i for i, (x, y) in enumerate(zip(*sets)) if similar(x, y, percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    return confirm


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        equal = (_signatures(batch.column("a_sig")) == _signatures(batch.column("b_sig"))).sum(1)
        keep = pa.array(np.flatnonzero(equal >= LEAST_EQUAL))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])


def likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and signatures (node, n, sig) can reach the limit."""
    joined = pairs.join(signed.toDF("a", "a_n", "a_sig"), "a").join(signed.toDF("b", "b_n", "b_sig"), "b")
    near = joined.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return near.select("a", "b", "a_sig", "b_sig").mapInArrow(released(_likely), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the limit; pairs is a written table."""
    sets = shingle_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    links = persisted(joined.select("a", "b", "x", "y").mapInArrow(released(_confirm(percent)), "a long, b long"), "links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b), a written table; component: its smallest node."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = persisted(edges, "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            named = persisted(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), "components")
            discard(edges)
            return named
        state = now
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(lowest, "u")
        small = hooked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        before, edges = edges, persisted(small.distinct(), "edges")
        discard(before)


class _Members:
    """Members (node, component, n, payload) of one block; the payload is a signature or a set."""

    def __init__(self, members: pa.StructArray) -> None:
        self.node, self.component, self.n = (members.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        self.payload = members.field(3)


def plausible(x: _Members, y: _Members, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(members of x, members of y, equal values) of pairs of different components that can reach the limit, in parts."""
    a, b = _signatures(x.payload), _signatures(y.payload)
    strip = max(1, COMPARED // (8 * len(b)))
    for at in range(0, len(a), strip):
        part = slice(at, at + strip)
        n, m = x.n[part, None], y.n[None]
        can = (x.component[part, None] != y.component) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if x is y:
            can &= np.arange(len(a))[part, None] < np.arange(len(b))
        i, j = np.nonzero(can)
        for k in range(0, len(i), COMPARED // SIZE):
            p, q = i[k : k + COMPARED // SIZE] + at, j[k : k + COMPARED // SIZE]
            equal = (a[p] == b[q]).sum(1)
            near = equal >= LEAST_EQUAL
            yield p[near], q[near], equal[near]


def partners(x: _Members, y: _Members, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The most alike plausible pair of each member."""
    top = [(np.zeros(len(m.node), np.int64), np.zeros(len(m.node), np.int64)) for m in (x, y)]  # equal values, the other
    for p, q, equal in plausible(x, y, percent):
        for (most, other), own, to in ((top[0], p, q), (top[1], q, p)):
            np.maximum.at(most, own, equal)
            best = equal == most[own]
            other[own[best]] = to[best]
    i, j = (np.flatnonzero(most) for most, _ in top)
    a, b = np.concatenate([x.node[i], x.node[top[1][1][j]]]), np.concatenate([y.node[top[0][1][i]], y.node[j]])
    return np.maximum(a, b), np.minimum(a, b)


def unsettled(x: _Members, y: _Members, percent: int) -> np.ndarray:
    """Members with a plausible pair."""
    open_ = [np.zeros(len(m.node), bool) for m in (x, y)]
    for p, q, _ in plausible(x, y, percent):
        open_[0][p] = open_[1][q] = True
    return np.unique(np.concatenate([x.node[open_[0]], y.node[open_[1]]]))


def settle(x: _Members, y: _Members, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links that join the components of the members: pairs of x and y that aren't joined by them are refuted."""
    parts = [x] if x is y else [x, y]
    node, component = (np.concatenate([getattr(m, c) for m in parts]) for c in ("node", "component"))
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for m in parts for v in m.payload]
    side = np.repeat(np.arange(len(parts)), [len(m.node) for m in parts])
    names, root = np.unique(component, return_inverse=True)
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, index, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((index, often[index], row))  # rarest first; the order is one for all sets
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    lead = order[place < np.repeat(size + 1 + (-percent * size // 100), size)]  # size - ceil(limit * size) + 1
    lead = lead[np.argsort(index[lead], kind="stable")]
    term, holder = index[lead], row[lead]
    from_, to = np.searchsorted(term, term, "left"), np.searchsorted(term, term, "right")
    by_row = np.argsort(holder, kind="stable")
    cut = np.searchsorted(holder[by_row], np.arange(len(sets) + 1))
    found = []
    for i in range(len(sets)):
        own = by_row[cut[i] : cut[i + 1]]
        if not len(own):
            continue
        near = np.unique(np.concatenate([holder[from_[k] : to[k]] for k in own.tolist()]))
        near = near[(near > i) & (root[near] != root[i]) & ((side[near] != side[i]) | (len(parts) == 1))]
        near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
        for k in near.tolist():
            if root[k] != root[i] and similar(sets[i], sets[k], percent):
                root[root == root[k]] = root[i]
                found.append((max(node[i], node[k]), min(node[i], node[k])))
    a, b = zip(*found) if found else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def _by_cell(work, names: list[str], keyed: bool = False):
    """work(x, y) for each (key, i, j) run of a sorted partition, which is one block or two; its arrays are the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = None, None
        for batch in batches:
            for row, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")))):
                here = _Members(batch.column("members")[row].values)
                if key[1] == key[2] or key == at:
                    out = work(here if key[1] == key[2] else before, here)
                    columns = (np.full(len(out), key[0]), out) if keyed else out
                    if len(columns[0]):
                        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, columns)})
                before, at = here, key

    return run


def cells(rows: DataFrame, weight: F.Column, most: int) -> DataFrame:
    """Rows (key, node, component, n, payload) in blocks of a key that weigh about ``most``, and each two blocks of a key side by side."""
    blocks = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / most)).cast("int").alias("blocks"))
    placed = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    gathered = placed.groupBy("key", "block").agg(F.collect_list(F.struct("node", "component", "n", "payload")).alias("members"), F.first("blocks").alias("blocks"))
    paired = gathered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "members")
    return paired.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def in_mixed_buckets(members: DataFrame, signed: DataFrame, grouped: DataFrame) -> DataFrame:
    """(key, node, component, n, payload) of the members of buckets that hold several components; the payload is the signature."""
    placed = members.select("key", "node").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    rows = placed.join(mixed.filter("low < high AND size > 2").select("key"), "key").join(signed, "node")
    return rows.select("key", "node", "component", "n", F.col("sig").alias("payload"))


def shingle_sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the documents whose ids (doc_id) are named, from their whole texts."""
    texts = by_ids(docs, nodes, "left_semi").select("doc_id", "text")
    return persisted(texts.mapInArrow(released(_sets), "node long, shingles binary"), "sets")


def settled(members: DataFrame, signed: DataFrame, grouped: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the components of members that share a bucket: what these don't join is refuted."""
    by_signature = cells(in_mixed_buckets(members, signed, grouped), F.lit(1), BLOCK)
    left = by_signature.mapInArrow(released(_by_cell(lambda x, y: unsettled(x, y, percent), ["key", "node"], True)), "key long, node long")
    left = persisted(left.distinct(), "unsettled")
    sets = shingle_sets_of(left.select(F.col("node").alias("doc_id")).distinct(), docs)
    rows = left.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sets, "node")
    rows = rows.select("key", "node", "component", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.col("shingles").alias("payload"))
    found = cells(rows, 8 * F.col("n"), SET_BYTES).mapInArrow(released(_by_cell(lambda x, y: settle(x, y, percent), ["a", "b"])), "a long, b long")
    links = persisted(found.distinct(), "settled")
    discard(left, sets)
    return links


def links_of_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that have several texts."""
    several = some.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("doc_id")
    rows = by_ids(some.select("doc_id", "h1", "h2"), several, "left_semi").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node")
    lowest = rows.groupBy("doc_id").agg(F.min("node").alias("b"))
    return rows.join(lowest, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents."""
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    profile = persisted(docs.mapInArrow(released(_profile), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"), "profile")
    some = profile.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("p"))
    classes = persisted(classes.select("h1", "h2", "node", F.col("n_shingles").alias("n"), "p.bands", "p.sig"), "classes")
    signed = classes.select("node", "n", "sig")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    members = persisted(banded.join(shared, "key"), "members")
    stars = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = persisted(likely(stars, signed, percent), "pairs")
    links = persisted(verified(pairs, docs, percent).union(links_of_ids(some, classes)), "links")
    grouped = components(links)
    by_signature = cells(in_mixed_buckets(members, signed, grouped), F.lit(1), BLOCK)
    pairs = by_signature.mapInArrow(released(_by_cell(lambda x, y: partners(x, y, percent), ["a", "b"])), "a long, b long")
    pairs = persisted(pairs.distinct(), "partners")
    if not pairs.isEmpty():  # else no pair of two components can reach the limit
        links = persisted(links.union(verified(pairs, docs, percent)), "links")
        grouped = components(links)
        more = settled(members, signed, grouped, docs, percent)
        if not more.isEmpty():
            grouped = components(links.union(more))
    discard(members, pairs)

    # a component's name is its smallest node, and a node is the smallest id of its class
    named = classes.join(grouped, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    out = profile.select("doc_id", "n_shingles", "h1", "h2").join(named.distinct(), ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all whole documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
