"""The pipeline against brute force on a small table."""

import random

import corpus_pipeline
from lodestar.llm import quality
from test_operators import brute_groups


def test_pipeline(spark, tmp_path):
    rnd = random.Random(4)
    words = {"en": ["the", "of", "thing", "other", "and"], "de": ["der", "und", "schon", "werk", "nicht"]}
    rows = []
    for i in range(120):
        language = ["en", "de"][i % 2]
        rows.append((i, ". ".join(" ".join(rnd.choice(words[language]) + rnd.choice(["", "er", "ing", "lich"]) for _ in range(9)) for _ in range(5)) + ".", language))
    rows += [(200 + i, rows[i][1] + " more", rows[i][2]) for i in range(10)] + [(300, rows[0][1], "en"), (300, rows[0][1], "en"), (301, None, "en"), (302, "home | news | shop | more\n" * 9, "en"), (303, "12 34 , " * 30, None), (None, rows[5][1] + " and yet another", "en")]
    text = {r[0]: r[1] for r in rows}
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, row int").write.parquet(str(tmp_path / "documents.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    good = {r["doc_id"] for r in first.collect()}
    assert good == {i for i in text if i not in (301, 302)} - {i for i in (303,) if not _kept(text[i])}
    second = corpus_pipeline.language_id(spark, first, str(tmp_path))
    assert {r["doc_id"] for r in second.collect()} == good - {303}
    third = corpus_pipeline.near_duplicate_groups(spark, second, str(tmp_path))
    groups = brute_groups([(i, t) for i, t in text.items() if i in good - {303, None}])
    left = [r["doc_id"] for r in third.collect()]
    assert sorted(i for i in left if i is not None) == sorted(i for i, (_, c) in groups.items() if i == c) and None in left
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(set(out.doc_id.dropna().astype(int))) == sorted(i for i in left if i is not None)
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and len(corpus_pipeline.STAGES) == 4


def _kept(t):
    _, lost, _, _ = quality.clean_text(t)
    n = len(t.split())
    return n >= 20 and lost * 2 <= n and quality.repeated_words(quality.Words(__import__("pyarrow").array([t])))[0] * 100 <= 30 * n



