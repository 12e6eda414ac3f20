"""The ten operators against brute force, with edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import itertools
import math
import os
import random

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat, hilbert, langid, neardup, ngram_lm, packing, pieces, quality, topk, toxicity
from lodestar.llm.blocks import Words, by_ids

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).fetchall(), [d[0] for d in con.sql(sql).description]


def same(df, sql, **tables):
    want, names = duck(sql, **tables)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    vocabulary = ["alpha", "beta", "Gamma", "delta,", "été", "naïve", "x", "zu.", "ÖL", "kappa"]
    base = [" ".join(rnd.choice(vocabulary) + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 4, 12, 60, 200]))) + "." for _ in range(30)]
    near = [t.replace(" ", " extra ", 1) for t in base[:10]]
    junk = [None, "", " \n\t ", "one", "a b c d", base[3], base[3], base[4].upper(), "tail " * 3000, "home | news | shop | more\n" * 9, "x y z\x0bw"]
    return base + near + junk


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", 1, False, 0.5) for i, t in enumerate(texts)] + [(None, "orphan text of unknown id and some length here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double")


def test_word_hashes_tell_words_apart(texts):
    words = Words(pa.array(texts, pa.string()))
    split = [(t or "").encode().translate(LOW).split() for t in texts]
    assert words.counts.tolist() == list(map(len, split))
    flat = [w for s in split for w in s]
    h = words.hashes().tolist()
    assert len(set(h)) == len(set(flat)) == len(set(zip(flat, h)))
    assert Words(pa.array([None, ""], pa.string())).counts.tolist() == [0, 0] and len(Words(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("how,want", [("left_semi", [1, 1, 3]), ("left_anti", [2, None])])
def test_ids_join_alike_broadcast_or_shuffled(spark, how, want):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (3,), (7,)], "doc_id long")
    for most in (0, 10):
        assert sorted((r["doc_id"] for r in by_ids(rows, ids, how, most).collect()), key=lambda x: (x is None, x)) == want
    assert by_ids(rows, ids.filter("doc_id > 9"), how).count() == (5 if how == "left_anti" else 0)


def test_top_k(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(40)]
    rows += [(50, rows[50][1]), (50, [2.0] * 6), (7, [-0.5] * 6), (7, rows[7][1]), (7, rows[7][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (2050, [0.1, 0.2]), (2051, [0.3, 0.2]), (2060, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    same(topk.top_k(df, F.col("vec_id") % 50 == 0), topk.OP1_SQL, embeddings=pa.Table.from_pylist([dict(zip(("vec_id", "embedding"), r)) for r in rows], schema=kind))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_few_and_of_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [5.0, 0.0]), (1, [-5.0, 0.0]), (2, [1e8, 3.0]), (3, [3e15, -1.0]), (4, [1e300, 1.0]), (5, [1e300, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    most = (1 << 63) - 1
    whole = lambda v: [min(most, int(256 * x) if x > 0 else -int(-256 * x)) for x in v]
    want = sorted((-min(most, sum(a * b for a, b in zip(whole(rows[0][1]), whole(v)))), i) for i, v in rows if i)[:5]
    assert got == [(r + 1, i, -s) for r, (s, i) in enumerate(want)]
    few = topk.top_k(df.filter("vec_id < 2"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["score"]) for r in few) == [(1, 1280 * 256), (2, -1280 * 256)]


def test_bounds_hold_and_leave_few():
    rnd = np.random.default_rng(3)
    exact = np.floor(256 * rnd.normal(size=(5000, 32)) / 6).astype(np.int64)
    block = topk.approximate(np.arange(5000), np.arange(5000), exact)
    q, c, lower, upper = topk.scan(exact[:20], np.arange(20), block, 5)
    score = (exact[q] * exact[c]).sum(1)
    assert (lower <= score).all() and (score <= upper).all() and (q != c).all() and len(q) < 20 * 100
    every = exact[:20] @ exact.T
    every[np.arange(20), np.arange(20)] = -(1 << 60)
    for i in range(20):
        assert set(np.argsort(-every[i], kind="stable")[:5]) <= set(c[q == i])


def test_line_rules(spark, docs):
    plain = docs.drop("kept", "score")
    rows = [{"doc_id": r["doc_id"], "text": r["text"]} for r in plain.collect()]
    extra = [
        "Skip to content\nAll rights reserved.\n" + "a fine line of words, that ends. " * 20,
        " ".join(f"u{i}" for i in range(30)) + "\n" + "fine words, here. " * 30,
        "# * $ 1\n\n# * $ 1\n" + " ".join(f"ö{i}," for i in range(25)),
        "tick tock " * 9 + "\n" + " ".join(f"v{i}," for i in range(60)),
        "BUY! BUY! NOW! GO!\n" * 3,
    ]
    rows += [{"doc_id": 800 + i, "text": t} for i, t in enumerate(extra)]
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    every = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string")
    judged = quality.judge_documents(every, carry=["doc_id"])
    same(judged, quality.OP2_SQL, documents=pa.Table.from_pylist(rows, schema=kind))
    fired = judged.agg(*[F.sum(f"lines_{r}").alias(r) for r in quality.RULES]).first()
    assert all(fired[r] for r in quality.RULES)
    assert quality.judge_documents(docs.limit(0), carry=["doc_id"]).count() == 0
    good = "A clean line of words stands here, and it ends well.\n" * 1 + " ".join(f"w{i}," for i in range(30))
    text, lost, failed, repeated = quality.clean_text(good + "\nhome | news | shop\n!!!! BUY!! NOW!!!!\n")
    assert text == good + "\n" and failed == {"navigation": 1, "shouting": 1} and lost == 8 and repeated == 0


def test_line_rules_reject_and_repeat():
    words = Words(pa.array(["a b c d e f g h i a b c d e f g h", "a b c d e f g h", None, "q " * 20], pa.string()))
    assert quality.repeated_words(words).tolist() == [16, 0, 0, 20]


def toxic_corpus(n=400):
    rnd = random.Random(5)
    normal = ["wort" + "".join(c) for c in itertools.product("abcdefghijklmn", repeat=2)]
    out = []
    for i in range(n):
        words = [rnd.choice(normal) for _ in range(30)]
        label = int(i % 8 == 0)
        if label:
            words[rnd.randrange(30)] = "zork" + rnd.choice(["ing", "er", "est", "ly"])
        out.append((i, " ".join(words) + ".", label))
    return out


def test_toxicity_learns_unseen_forms():
    rows = toxic_corpus()
    g = toxicity.learn([r[1] for r in rows], [r[2] for r in rows])
    p = g.scores(pa.array(["wortaa wortbb zorkish wortcd.", "wortaa wortbb.", "", None], pa.string()))
    assert p[0] > 0.5 > p[1] and p[1] == p[2] == p[3] and ((0 <= p) & (p <= 1)).all()


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 4.0}, {})
    assert g.total("you are an idiot") > g.total("an idiot") > g.total("he is not an idiot") > 0
    assert g.total('she said that you idiot') < g.total("you idiot")
    assert g.total("i will kill you") > 0 == g.total("i will kill time")
    assert g.total("not bad. an idiot") == g.total("an idiot")
    assert g.total('she said: "you idiot"') < 0.5 * g.total("you idiot") and g.total("not this: idiot") == g.total("idiot")
    assert g.total("idiot, you") == 1.5 * g.total("idiot") and g.total("he said that i will kill you") < g.total("i will kill you")
    unlabelled = toxicity.learn([], [])
    assert unlabelled.scores(pa.array(["you idiot", "hello"]))[0] > 0.5


def test_toxicity_learns_context_in_any_language():
    rnd = random.Random(8)
    texts, labels = [], []
    for i in range(400):
        words = ["wort" + "".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(25)]
        at = rnd.randrange(3, 25)
        toxic = i % 2
        if i % 4 < 2:
            words[at - 1 : at + 1] = ["tuzak" if toxic else "nimal", "schnurk"]
        elif toxic:
            words[at] = "schnurk"
        texts.append(" ".join(words))
        labels.append(toxic)
    known = toxicity.Grammar({"schnurk": 3.0}, {})
    assert toxicity._context(known, texts, labels) == (("tuzak",), ("nimal",))
    g = toxicity.Grammar({"schnurk": 3.0}, {}, targets=("tuzak",), negations=("nimal",))
    assert g.total("tuzak schnurk") > g.total("schnurk") > g.total("nimal schnurk")


def test_toxicity_learns_from_long_texts_and_rare_labels(spark):
    rows = [(i, (t + "\n") * 200, y) for i, t, y in toxic_corpus(240)]
    assert min(len(t) for _, t, _ in rows) > toxicity.SAMPLE_BYTES
    d = spark.createDataFrame([r[:2] for r in rows] + [(5, rows[5][1]), (5, "another text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    g = toxicity.fit(d, labels, F.lit(True))
    assert any(p.startswith("zork") for p in g.prefixes)
    assert [x > 0.5 for x in g.scores(pa.array(["wortaa zorkish.\n" * 100, "wortaa wortbb.\n" * 100]))] == [True, False]
    thin = toxicity.thinned(rows[0][1])
    assert len(thin.encode()) <= toxicity.SAMPLE_BYTES and set(thin.split(". ")) <= set(toxicity._CLAUSE.findall(rows[0][1]))


LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())])


def test_toxicity_and_language_queries(spark, tmp_path):
    """The contracts of op3 and op9: columns, folds and ranges, and scores against the fitted model applied row by row."""
    rnd = random.Random(2)
    rows = [(i, t, None, "s", 1) for i, t, _ in toxic_corpus()] + [(900, None, "aa", "s", 1), (901, "", None, "s", 1), (902, "12 34", "aa", "s", 1), (None, "idiot", None, None, None)]
    rows += [(1000 + i, " ".join(rnd.choice(["kalo", "milo", "tuka"] if i % 2 else ["schung", "verich"]) for _ in range(20)), "aa" if i % 2 else "bb", "s", 1) for i in range(200)]
    write_tables(tmp_path, documents=(rows, DOCUMENTS), labels=([(i, 1, y) for i, _, y in toxic_corpus()] + [(900, 1, 0), (901, 0, None)], LABELS))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    fold_of = lambda i: zlib.crc32(str(i).encode()) % 5 == 0 if i is not None and i == i else True
    out = toxicity.op3_pattern_grammar(spark, str(tmp_path)).toPandas()
    grammar = toxicity.fit(docs, labels, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) != 0)
    text = {i: t for i, t, *_ in rows}
    assert len(out) == len(rows) and all(h == fold_of(None if i != i else int(i)) for i, h in zip(out.doc_id, out.held_out))
    for i, score, predicted in zip(out.doc_id, out.score, out.predicted):
        own = grammar.probability(np.array([grammar.total(text[None if i != i else int(i)])]))[0]
        assert math.isclose(score, own, rel_tol=1e-9) and predicted == (score >= 0.5)
    out = langid.op9_kneser_ney(spark, str(tmp_path)).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and set(out.lang_pred) == {"aa", "bb", "und"}
    assert all(h == fold_of(None if i != i else int(i)) for i, h in zip(out.doc_id, out.held_out))
    assert set(out[out.doc_id.isin([900, 901, 902])].lang_pred) == {"und"}
    truth = {i: lang for i, _, lang, *_ in rows if i is not None and i >= 1000}
    own = out[out.doc_id >= 1000]
    assert all(truth[int(i)] == x for i, x in zip(own.doc_id, own.lang_pred))


def test_toxicity_query_shape(spark, docs):
    rows = toxic_corpus()
    d = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) == 0
    out = toxicity.score_documents(d, toxicity.fit(d, labels, ~held), held).toPandas()
    assert len(out) == len(rows) + 1
    truth = {r[0]: r[2] for r in rows}
    own = out[out.held_out & out.doc_id.notna()]
    assert np.mean([truth[int(i)] == p for i, p in zip(own.doc_id, own.predicted)]) > 0.97
    assert toxicity.score_documents(d.limit(0), toxicity.Grammar({}, {}), held).count() == 0


def test_snapshot_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 0, "user", "a"), (5, 1, "assistant", "x"), (None, 0, "user", "z"), (6, None, None, None), (7, 0, "user", "a"), (7, 1, "assistant", "bb")]
    rows += [(8, t, "user", f"m{t}") for t in range(2500)] + [(9, t, "user", f"m{t}") for t in range(1100)]
    rows += [(10, None, "user", f"n{k}") for k in range(3000)] + [(11, None, "user", f"n{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.collapse_and_render(df)
    same(out, chat.OP4_SQL, conversations=pa.Table.from_pylist([{"conv_id": a, "turn": b, "role": c, "text": d} for a, b, c, d in rows]))
    assert {r["conv_id"] for r in out.collect()} == {3, 4, 6, 7, 8, 10}
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_n_best_pieces_against_all_segmentations():
    rnd = random.Random(1)
    vocabulary = {p: (10 + i, -rnd.random() * 5) for i, p in enumerate(["▁", "a", "b", "ab", "ba", "aa", "▁a", "▁ab", "abb", "bb", "▁▁", "bab"])}
    lattice = pieces.PieceLattice(vocabulary, {})

    def every(z):
        if not z:
            return [0.0]
        arcs = [(n, vocabulary[z[:n]][1]) for n in range(1, len(z) + 1) if z[:n] in vocabulary] or []
        if z[0] not in vocabulary:
            arcs.append((1, lattice.unknown_score))
        return [s + w for n, s in arcs for w in every(z[n:])]

    for _ in range(300):
        s = "".join(rnd.choice("ab c\n") for _ in range(rnd.randrange(1, 9)))
        whole = pieces.MARK + s.replace(" ", pieces.MARK)
        want = sorted(every(whole), reverse=True)[:4]
        for got in (lattice.encode(s, 4), lattice.n_best(whole, 4)):
            assert np.allclose([w for w, _ in got], want)
        assert len({i for _, i in lattice.encode(s, 4)}) == len(want)


def test_segments_searched_together_equal_those_searched_alone(texts):
    rnd = random.Random(3)
    odd = ["", None, "x" * 200, "ab " * 50 + "日本語 🎉é", "▁▁ a", "\n\n b", "\x00", *("".join(rnd.choice("abeinrst é🎉ß ") for _ in range(rnd.randrange(80))) for _ in range(300))]
    every = texts + odd
    alone, together = pieces.lattice(pieces.model_path()), pieces.PieceLattice.load(pieces.model_path())
    assert [alone.encode(t, 4) for t in every] == list(together.encode_all(every, 4))
    assert together.cache.keys() >= {pieces.MARK + "ab"}


def viterbi(text, lattice):
    """Score of the best path over all pieces of the model, character by character."""
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - lattice.longest), j):
            if s[i:j] in lattice.pieces:
                best[j] = max(best[j], best[i] + lattice.pieces[s[i:j]][1])
        if s[j - 1] not in lattice.pieces:
            best[j] = max(best[j], best[j - 1] + lattice.unknown_score)
    return best[-1]


def test_best_path_over_the_real_model(texts):
    lattice = pieces.PieceLattice.load(pieces.model_path())
    score_of = {i: s for i, s in lattice.pieces.values()}
    assert math.isclose(sum(math.exp(s) for s in score_of.values()), 1.0)
    own = [t for t in texts if t] + ["日本 x" * 40, "nospace" * 300]
    if os.path.isdir("/root/testdata/sf0.001"):
        own += [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t and len(t) < 5000]
    for text, ways in zip(own, lattice.encode_all(own, 3)):
        assert math.isclose(ways[0][0], viterbi(text, lattice), rel_tol=1e-9)
        ids = np.frombuffer(ways[0][1], "<u4").tolist()
        if all(i in score_of for i in ids):
            assert math.isclose(sum(score_of[i] for i in ids), ways[0][0], rel_tol=1e-9)


def test_pieces_round_trip(spark, docs, texts):
    out = pieces.encode_texts(docs, pieces.model_path(), carry=["doc_id", "text"], keep_ids=True)
    rows = out.collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == len(texts) + 1
    marked = spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in pieces.encode_texts(marked, pieces.model_path()).collect()} == {1: False, 2: True}
    empty = [r for r in rows if not r["text"]]
    assert all(r["n_pieces"] == 0 and len(r["n_best"]) == 1 for r in empty)
    assert all(r["n_best"] == sorted(r["n_best"], key=lambda w: -w["score"]) for r in rows)
    back = pieces.decode_ids(out.select("doc_id", F.col("text").alias("was"), "ids"), pieces.model_path()).collect()
    assert all(r["text"] == (r["was"] or "") for r in back)
    assert pieces.encode_texts(docs.limit(0), pieces.model_path()).count() == 0


def brute_groups(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(LOW).split()
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs, texts):
    rnd = random.Random(9)
    chain = [[f"c{k}" for k in range(s, s + 60)] for s in range(0, 48, 6)]  # each links to the next ones only
    extra = [" ".join(c) for c in chain] + [" ".join(f"p{k}" for k in range(20)) + " " + " ".join(f"q{rnd.randrange(9999)}" for _ in range(25)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(500 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, texts[0], 2)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect() if r["doc_id"] is not None}
    assert got == brute_groups(rows)
    orphan = neardup.near_duplicates(df).filter("doc_id IS NULL").first()
    assert orphan["component_id"] is None and orphan["kept"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def members(rows):
    kind = pa.struct([("node", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
    return neardup._Members(pa.array(rows, kind))


def test_plausible_pairs_beside_a_star():
    """Members of one bucket that a star leaves in different components are paired by their signatures."""
    rnd = np.random.default_rng(2)
    common = rnd.integers(0, 256, neardup.SIZE).astype(np.uint8)
    rows = []
    for k in range(6):
        sig = common.copy()
        sig[rnd.choice(neardup.SIZE, 20, replace=False)] = rnd.integers(0, 256, 20)
        rows.append({"node": k, "component": k // 2, "n": 100 if k < 5 else 200, "payload": sig.tobytes()})
    every = {(a, b) for a in range(5) for b in range(a) if a // 2 != b // 2}
    whole, low, high = members(rows), members(rows[:3]), members(rows[3:])
    found = {(int(x.node[i]), int(y.node[j])) for x, y in ((whole, whole), (low, high)) for p, q, _ in neardup.plausible(x, y, 75) for i, j in zip(p, q)}
    assert {(max(p), min(p)) for p in found} == every
    best = set(zip(*(v.tolist() for v in neardup.partners(whole, whole, 75))))
    assert best < every and {n for p in best for n in p} == set(range(5))
    assert neardup.unsettled(low, high, 75).tolist() == [0, 1, 2, 3, 4]


def test_blocks_are_settled_exactly():
    rnd = np.random.default_rng(6)
    for _ in range(40):
        base = [rnd.integers(1, 1 << 60, 40, dtype=np.uint64) for _ in range(3)]
        sets = []
        for k in range(24):
            s = base[k % 3].copy()
            s[rnd.choice(40, rnd.integers(0, 9), replace=False)] = rnd.integers(1, 1 << 60, 1, dtype=np.uint64)
            sets.append(np.unique(s[: rnd.integers(30, 41)]))
        rows = [{"node": k, "component": k if k % 5 else 0, "n": len(s), "payload": s.tobytes()} for k, s in enumerate(sets)]

        def groups(links):
            root = {r["node"]: r["component"] for r in rows}
            for a, b in links:
                root = {n: (min(root[a], root[b]) if c in (root[a], root[b]) else c) for n, c in root.items()}
            return root

        true = [(a, b) for a, b in itertools.combinations(range(24), 2) if neardup.similar(sets[a], sets[b], 75)]
        whole, low, high = members(rows), members(rows[:9]), members(rows[9:])
        assert groups(zip(*neardup.settle(whole, whole, 75))) == groups(true)
        both = [p for x, y in ((low, low), (low, high), (high, high)) for p in zip(*neardup.settle(x, y, 75))]
        assert groups(both) == groups(true) and set(both) <= {(max(p), min(p)) for p in true}


def test_rows_of_one_id_are_one_document(spark):
    x, y, z = ("x " * 9 + "one two three four", "alpha beta gamma delta epsilon zeta", "a b c d e f g")
    rows = [(100, x), (300, x), (300, y), (400, y), (500, z), (500, z), (600, ""), (600, z), (700, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(got).collect()}
    assert {found[(i, True)] for i in (100, 300, 400)} == {(100, True), (100, False)} and found[(100, True)][1]
    assert found[(500, True)] == (500, True) and found[(600, True)] == (500, False)
    assert found[(600, False)] == (600, True) and found[(700, False)] == (700, True)


def test_super_minhash_estimates():
    rnd = np.random.default_rng(4)
    a = rnd.integers(1, 1 << 62, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rnd.integers(1, 1 << 62, 60, dtype=np.uint64)])
    small = a[:3]
    row = np.repeat([0, 1, 2], [300, 300, 3])
    sig = neardup.super_minhash(row, np.concatenate([a, b, small]), 4)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.15
    assert len(set(sig[2].tolist())) == 128 and (sig[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@pytest.mark.parametrize("order,fan_in", [(1, 4096), (2, 4096), (3, 3)])
def test_backoff_automaton(spark, docs, order, fan_in):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2
    got = {r["doc_id"]: r for r in ngram_lm.score_texts(docs, held=held, order=order, block_bytes=2000, fan_in=fan_in).collect()}
    tokens = {i: (t or "").encode().translate(LOW).split() + ["</s>"] for i, t in rows}
    orphan = "orphan text of unknown id and some length here".encode().split() + ["</s>"]
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2] + [orphan]
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        padded = ["<s>"] * (order - 1) + t
        for k in range(1, order + 1):
            for at in range(order - 1, len(padded)):
                grams[k][tuple(padded[at - k + 1 : at + 1])] += 1
    n, v, ones = sum(grams[1].values()), len(grams[1]), sum(c == 1 for c in grams[1].values())
    discount = min(0.9, max(ones, 1) / v)
    for i, t in tokens.items():
        total, base, padded = 0.0, 0.0, ["<s>"] * (order - 1) + t
        for at in range(order - 1, len(padded)):
            c = grams[1][(padded[at],)]
            p = (c - discount) / n if c else discount * v / n
            base += math.log10((c + 1) / (n + v + 1))
            for k in range(2, order + 1):
                history = tuple(padded[at - k + 1 : at])
                h = len(train) if set(history) == {"<s>"} else grams[k - 1][history]
                p = (grams[k][(*history, padded[at])] + 4.0 * p) / (h + 4.0)
            total += math.log10(p)
        assert math.isclose(got[i]["score"], total, rel_tol=1e-9) and math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert got[i]["n_tokens"] == len(t) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(grams[1][(w,)] > 0 for w in t)
    assert ngram_lm.score_texts(docs.limit(0)).count() == 0


def test_automaton_walks_states_and_failure_arcs():
    """Lanes of any size end where a single walk does, which is held against a dictionary of states."""
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.choice([0, 1, 5, 90]))) for _ in range(12)]
    tokens, bounds = ngram_lm._tokens(pa.array(texts))
    vocabulary, index = np.unique(tokens, return_inverse=True)
    block = ngram_lm.Block(ngram_lm.squeeze(bounds.astype(np.uint64)), vocabulary.tobytes(), ngram_lm.squeeze(index.astype(np.uint32)))
    train = block.of_rows([i % 3 > 0 for i in range(12)])
    grams, counts = [], []
    for k in (1, 2, 3):
        keys, gram = np.unique(block.keys(k), return_inverse=True)
        grams.append(gram)
        counts.append(np.bincount(gram[train], minlength=len(keys)))
    n, v, ones = int(counts[0].sum()), int((counts[0] > 0).sum()), int((counts[0] == 1).sum())
    machine = ngram_lm.Automaton(block, grams, counts, 8, n, v, ones, 4.0)
    whole = machine.walk(10**6)
    assert all(np.allclose(machine.walk(size), whole, rtol=1e-12) for size in (3, 4, 17))
    split = [t.split() + ["</s>"] for t in texts]
    seen = [Counter() for _ in range(4)]
    for t in [t for i, t in enumerate(split) if i % 3]:
        padded = ["<s>", "<s>", *t]
        for k in (1, 2, 3):
            seen[k].update(tuple(padded[at - k + 1 : at + 1]) for at in range(2, len(padded)))
    d = min(0.9, max(ones, 1) / v)

    def arc(h, w):  # the weight of a stored arc
        if not h:
            return (seen[1][(w,)] - d) / n
        c = 8 if set(h) == {"<s>"} else seen[len(h)][h]
        return (seen[len(h) + 1][(*h, w)] + 4.0 * arc(h[1:], w)) / (c + 4.0)

    for t, got in zip(split, whole):
        state, total = ("<s>", "<s>"), 0.0
        for w in t:
            while state and not seen[len(state) + 1][(*state, w)]:
                c = 8 if set(state) == {"<s>"} else seen[len(state)][state]
                state, total = state[1:], total + math.log10(4.0 / (c + 4.0))
            if not state and not seen[1][(w,)]:
                total += math.log10(d * v / n)
                continue
            total, state = total + math.log10(arc(state, w)), (*state, w)[-2:]
            while not seen[len(state)][state]:
                state = state[1:]
        assert math.isclose(got, total, rel_tol=1e-9)


def test_hilbert_curve_is_a_walk(spark):
    cells = spark.range(8).withColumnRenamed("id", "a").crossJoin(spark.range(8).withColumnRenamed("id", "b")).crossJoin(spark.range(8).withColumnRenamed("id", "c"))
    rows = hilbert.curve_index(cells, [F.col("a"), F.col("b"), F.col("c")], 3).toPandas().sort_values("curve_index")
    assert rows.curve_index.tolist() == list(range(512))
    assert (np.abs(np.diff(rows[["a", "b", "c"]].to_numpy(), axis=0)).sum(1) == 1).all()


def test_shards(spark, docs, tmp_path):
    light = docs.select("doc_id", "lang", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.lit("mine").alias("shard"), F.lit(1).alias("total"))
    light = light.union(light.filter("doc_id = 3")).union(light.filter("doc_id = 3"))
    placed = hilbert.with_ordinal(hilbert.with_ordinal(light, "lang", "x"), "source", "y")
    dims = [F.col("x"), F.col("y"), hilbert.magnitude(F.col("size"))]
    out = hilbert.shard_by_curve(placed, dims, ["doc_id", "size"], shards=5)
    found = out.toPandas()
    sizes = found.groupby("shard").size()
    assert len(found) == light.count() and sizes.max() - sizes.min() <= 1 and set(sizes.index) == set(range(5)) and (found.total == 1).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert found.sort_values(["shard", "slot"]).curve_index.is_monotonic_increasing
    assert hilbert.shard_by_curve(placed.limit(0), dims, ["doc_id"]).count() == 0
    hilbert.write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards").toPandas()
    assert sorted(zip(back.shard, back.slot)) == sorted(zip(found.shard, found.slot))


def test_ordinals_follow_one_rule(spark):
    for n in (1, 7, 255, 500):
        rows = spark.createDataFrame([(f"v{i:04d}",) for i in range(n)] + [(None,)], "v string")
        got = {r["v"]: r["cell"] for r in hilbert.with_ordinal(rows, "v", "cell").collect()}
        assert got.pop(None) == 0 and [got[k] for k in sorted(got)] == [1 + i * 255 // n for i in range(n)]


def write_tables(path, **tables):
    for name, (rows, schema) in tables.items():
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema), f"{path}/{name}.parquet")


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int32())])


def test_shard_query_prunes(spark, tmp_path):
    """The contract's columns by brute force, and how many shards a filter on each dimension must read."""
    rnd = random.Random(4)
    rows = [(i, None if i == 7 else "ä" * rnd.randrange(1, 2 ** rnd.randrange(2, 12)), rnd.choice(["en", "de", "fr", None]), f"s{rnd.randrange(6)}", 1) for i in range(2400)]
    write_tables(tmp_path, documents=(rows, DOCUMENTS))
    out = hilbert.op8_hilbert(spark, str(tmp_path)).toPandas()
    own = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(s == len(own[i]) + 8 and c == zlib.crc32(own[i]) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    assert set(out.law) == {"rows"} and out.grown_shard.isna().all() and (out.groupby("shard").size() == 100).all()
    meta = {i: (lang, source) for i, _, lang, source, _ in rows}
    out["lang"], out["source"] = [meta[i][0] for i in out.doc_id], [meta[i][1] for i in out.doc_id]
    read = lambda mask: out[mask].shard.nunique()
    langs, sources = [read(out.lang == x) for x in ("en", "de", "fr")], [read(out.source == f"s{k}") for k in range(6)]
    assert max(langs) <= 16 and np.mean(sources) <= 14 and read(out["size"] > 2000) <= 18


def test_language_id(spark):
    rnd = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["été", "oux", "que", "lle"]}
    rows = []
    for i in range(300):
        language = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(parts[language]) for _ in range(rnd.randrange(1, 4))) for _ in range(25)), language))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 456 !!", "bb"), (1003, "kalomi", None), (None, "schung verich", "bb"), (1004, "q" * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) == 0
    models = langid.fit(docs, ~held)
    assert models.languages == ["aa", "bb", "cc"]
    out = langid.identify(docs, models, carry=["doc_id", "lang"]).toPandas()
    usual = out[out.doc_id < 300]
    assert (usual.lang == usual.lang_pred).all() and not usual.rejected.any() and out.score.between(0, 1).all()
    assert set(out[out.doc_id.isin([1000, 1001, 1002])].lang_pred) == {"und"}
    assert out[out.doc_id == 1004].rejected.all() and len(out) == len(rows)
    none = langid.identify(docs, langid.CharModels({}), carry=["doc_id"]).first()
    assert none["lang_pred"] == "und" and langid.identify(docs.limit(0), models).count() == 0


def test_languages_of_long_texts_are_learned(spark):
    rnd = random.Random(9)
    word = {
        "short": lambda: "".join(rnd.choice(["ka", "lo", "mi"]) for _ in range(3)),
        "books": lambda: "".join(rnd.choice(["sch", "ung", "ver"]) for _ in range(3)),
        "mixed": lambda: "".join(rnd.choice(["été", "oux", "que"]) for _ in range(3)),
        "spaceless": lambda: "".join(rnd.choice("天地玄黄宇宙洪荒") for _ in range(9000)),
    }
    text = lambda language, n: " ".join(word[language]() for _ in range(n))
    rows = [(i, text("short", 30), "short") for i in range(60)]
    rows += [(100 + i, text("books", 3000), "books") for i in range(30)]
    rows += [(200 + i, text("mixed", 3000) if i > 2 else "zzz www", "mixed") for i in range(30)]
    rows += [(300 + i, text("spaceless", 1), "spaceless") for i in range(10)]
    assert min(len(t.encode()) for i, t, _ in rows if t != "zzz www" and i >= 100) > langid.SAMPLE_BYTES
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert models.languages == ["books", "mixed", "short", "spaceless"]
    fresh = {language: text(language, 1 if language == "spaceless" else 30) for language in word}
    got, _, _, rejected = models.predict(pa.array(fresh.values()))
    assert got == list(fresh) and not rejected.any()
    thin = langid.thinned(rows[100][1])
    assert 0.95 * langid.SAMPLE_BYTES < len(thin.encode()) <= langid.SAMPLE_BYTES
    left = iter(rows[100][1].split())
    assert all(w in left for w in thin.split())  # a part of the text's words, in their order
    both = langid.thinned("ab " * 9000 + "cd " * 9000)
    assert min(both.count("ab"), both.count("cd")) > 2000 and langid.thinned("12 34" * 9000) == ""


def test_kneser_ney_sums_to_one():
    m = langid.CharModels({"x": ["abab abba baab", "aab"], "y": ["cc cd"]}, order=3)
    for context in ("", "a", "ab", "zz"):
        seen = [chr(c) for c in range(ord("a"), ord("e"))]
        total = 0.0
        for c in [*seen, None]:  # None: the end of the word
            words = langid.LetterWords(pa.array([context + (c or "")]))
            g = langid.Grams(words, np.array([0])) if context or c else None
            if g is None:
                continue
            p = np.exp(m.log_probabilities(g)[:, 0].astype(float))
            total += p[-1] if c is None else p[len(context) + 1]
        if context:
            unseen = 1 / (len(m.keys[0]) + 1)
            assert total < 1 + 1e-6 and total > 1 - unseen * 2


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    out = packing.pack(docs, packing.vocabulary_path(), keep_ids=True, capacity=64).toPandas()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = out[out.doc_id == i].sort_values("piece")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and all(n == 64 for n in own.length[1:])
        assert all(zlib.crc32(x) == c for x, c in zip(own.ids, own.ids_crc32))
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= 64 and len(used) <= 1.1 * out.length.sum() / 64 + 1
    assert packing.pack(docs.limit(0), packing.vocabulary_path()).count() == 0


def test_fullest_is_optimal():
    rnd = random.Random(2)
    for _ in range(200):
        counts = np.zeros(31, object)
        for _ in range(rnd.randrange(1, 7)):
            counts[rnd.randrange(1, 31)] += rnd.randrange(1, 4)
        got = packing.fullest(counts, 30)
        items = [n for n in range(31) for _ in range(counts[n])]
        top = max(items)
        rest = list(items)
        rest.remove(top)
        best = max(top + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if top + sum(c) <= 30)
        assert sum(n * u for n, u in got) == best and all(u <= counts[n] for n, u in got)


def test_chunked_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    e = packing.Encoder(packing.vocabulary_path())
    for s in ["a b", "It's here, isn't it?\nNo.", "  two  spaces ", "été naïve ÖL\n\nx", "日本語 text 😀 ok", "<|endoftext|> x", "tab\tx y", "a b c", "x\x00y z", "1,000.5 %$ --- a_b"]:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    e = packing.Encoder(packing.vocabulary_path())
    rnd = random.Random(11)
    signs = list("abcdeXYZ019 '.,!?-_#\n\t\r\x0b\xa0éßñ\u0301\u200b日本語🎉👩\u200d👩") + ["'s", "'LL", "  ", "\n\n", "<|endoftext|>", " the", "ing", "123456"]
    for _ in range(3000):
        s = "".join(rnd.choice(signs) for _ in range(rnd.randrange(40)))
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s
