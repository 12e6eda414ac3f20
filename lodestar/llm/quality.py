"""Quality rules, line first: each line is judged, failing lines are removed, and a document that
loses too much of its text is rejected.

A line fails by the first of these rules that holds (n: its words, chars: code points in words):

* ``navigation``  at least 2 ``|`` and 5 * bars >= n
* ``symbols``     at least 3 of ``[#*$%&<>]`` and 10 * symbols >= chars
* ``shouting``    at least 4 ``!`` and 4 * marks >= n
* ``repetition``  n >= 10 and 4 * distinct words <= n
* ``unpunctuated`` n >= 25 and none of ``.,;:!?``
* ``boilerplate`` n <= 25 and a phrase of :data:`BOILERPLATE`

A document is rejected if it fails the base rules (fewer than ``min_words`` words, or more than
``max_repeat_pct`` % of its words in repeated 8-word windows), or if failing lines hold more than
``max_lost_pct`` % of its words.

Edge cases: null text counts as empty: no words, base_failed, not kept, cleaned text null. Lines
without a word are neither judged nor counted. Repeated rows and repeated ids are judged row by row.
Nothing is shuffled; each row needs only its own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import Words, mix, released, slices, table

WINDOW = 8
PART_BYTES = 1 << 18
#: Phrases of page furniture and licence headers, lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "sign up for", "subscribe to our", "enable javascript", "powered by", "skip to content", "back to top")
RULES = ("navigation", "symbols", "shouting", "repetition", "unpunctuated", "boilerplate")

_SPACES = " \t\n\r\x0b\x0c"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_SYMBOL = re.compile(r"[#*$%&<>]")
_STOPS = re.compile(r"[.,;:!?]")
_PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SUSPECT = re.compile(r"[|#*$%&<>]|!!")


def line_verdict(line: str, words: list[str]) -> str | None:
    """The rule that the line fails, or None."""
    n = len(words)
    if not n:
        return None
    if _SUSPECT.search(line) or "!" in line:
        bars = line.count("|")
        if bars >= 2 and 5 * bars >= n:
            return "navigation"
        symbols = len(_LINE_SYMBOL.findall(line))
        if symbols >= 3 and 10 * symbols >= sum(map(len, words)):
            return "symbols"
        marks = line.count("!")
        if marks >= 4 and 4 * marks >= n:
            return "shouting"
    if n >= 10 and 4 * len(set(words)) <= n:
        return "repetition"
    if n >= 25 and not _STOPS.search(line):
        return "unpunctuated"
    if n <= 25 and _PHRASE.search(line.lower()):
        return "boilerplate"
    return None


def clean_text(text: str) -> tuple[str, int, dict[str, int], int]:
    """(text without failing lines, words lost, lines failed by rule, lines equal to an earlier one)."""
    lines = text.split("\n")
    kept, lost, failed, repeated, seen = [], 0, {}, 0, set()
    for line in lines:
        words = _WORD.findall(line)
        if words:
            repeated += line in seen
            seen.add(line)
        rule = line_verdict(line, words)
        if rule:
            lost += len(words)
            failed[rule] = failed.get(rule, 0) + 1
        else:
            kept.append(line)
    return ("\n".join(kept) if failed else text), lost, failed, repeated


def repeated_words(words: Words) -> np.ndarray:
    """For each row, its words that lie in a window of 8 words found twice or more in the row."""
    h, at = words.windows(words.hashes(lower=False), WINDOW)
    cover = np.zeros(len(words.start) + WINDOW + 1, np.int64)
    if len(h):
        key = mix(h + (words.rows()[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(words.start)] > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, " + ", ".join(f"lines_{r} long" for r in RULES) + ", base_failed boolean, kept boolean"


def _judge(min_words: int, max_repeat_pct: int, max_lost_pct: int, carry: list[str], cleaned: str | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", PART_BYTES):
                words = Words(part.column("__text"))
                n = words.counts
                repeat = repeated_words(words)
                lost, dups, clean, failed = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [], {r: np.zeros(len(n), np.int64) for r in RULES}
                for i, t in enumerate(part.column("__text").to_pylist()):
                    if t is None:
                        clean.append(None)
                        continue
                    out, lost[i], by, dups[i] = clean_text(t)
                    clean.append(out)
                    for rule, k in by.items():
                        failed[rule][i] = k
                base = (n < min_words) | (100 * repeat > max_repeat_pct * n)
                kept = ~base & (100 * lost <= max_lost_pct * n)
                code_point = words.word_byte & ((words.data & 0xC0) != 0x80)
                columns = {c: part.column(c) for c in carry}
                columns |= {"n_words": n, "word_chars": words.count_bytes(code_point), "n_symbols": words.count_bytes(_SYMBOL[words.data]), "n_dup_lines": dups, "n_repeat_words": repeat, "lost_words": lost}
                columns |= {f"lines_{r}": v for r, v in failed.items()} | {"base_failed": base, "kept": kept}
                if cleaned:
                    columns[cleaned] = pa.array(clean, pa.string())
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return judge


def judge_documents(df: DataFrame, text: str = "text", carry: list[str] | None = None, cleaned: str | None = None, min_words: int = 20, max_repeat_pct: int = 30, max_lost_pct: int = 50) -> DataFrame:
    """One row per row of df: the columns named in carry, the counts of :data:`SCHEMA`, the verdict
    and, if ``cleaned`` names a column for it, the text without its failing lines."""
    carry = [c for c in df.columns if c != text] if carry is None else carry
    source = df.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").cast("string").alias("__text"))
    names = [f"__c{i}" for i in range(len(carry))]
    kinds = [source.schema[c].dataType.simpleString() for c in names]
    schema = ", ".join([*[f"{c} {k}" for c, k in zip(names, kinds)], SCHEMA, *(["__cleaned string"] if cleaned else [])])
    work = _judge(min_words, max_repeat_pct, max_lost_pct, names, "__cleaned" if cleaned else None)
    out = source.mapInArrow(released(work), schema)
    renamed = dict(zip(names, carry)) | ({"__cleaned": cleaned} if cleaned else {})
    return out.select(*[F.col(c).alias(renamed.get(c, c)) for c in out.columns])


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole document."""
    return judge_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


_COUNT = "length({0}) - length(replace({0}, '{1}', ''))"
_W = r"[^\x20\x09-\x0D]+"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '{_W}')) AS word, generate_subscripts(regexp_extract_all(text, '{_W}'), 1) AS pos FROM d),
g AS (SELECT rid, pos, string_agg(word, ' ') OVER v AS win, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT rid, unnest(list(pos)) AS pos FROM g WHERE n = 8 GROUP BY rid, win HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM twice, range(8) r(k) GROUP BY rid),
tot AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS lno FROM d),
lw AS (SELECT rid, lno, line, regexp_extract_all(line, '{_W}') AS ws FROM ln),
lc AS (SELECT rid, lno, line, len(ws) AS n, list_sum(list_transform(ws, lambda x: length(x))) AS chars, len(list_distinct(ws)) AS dist,
  len(regexp_extract_all(line, '[|]')) AS bars, len(regexp_extract_all(line, '[#*$%&<>]')) AS syms, len(regexp_extract_all(line, '!')) AS marks FROM lw WHERE len(ws) > 0),
lv AS (SELECT *, CASE WHEN bars >= 2 AND 5 * bars >= n THEN 'navigation' WHEN syms >= 3 AND 10 * syms >= chars THEN 'symbols' WHEN marks >= 4 AND 4 * marks >= n THEN 'shouting'
  WHEN n >= 10 AND 4 * dist <= n THEN 'repetition' WHEN n >= 25 AND NOT regexp_matches(line, '[.,;:!?]') THEN 'unpunctuated'
  WHEN n <= 25 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') THEN 'boilerplate' END AS rule FROM lc),
dl AS (SELECT rid, sum(c - 1) AS n_dup_lines FROM (SELECT rid, line, count(*) AS c FROM lc GROUP BY rid, line) GROUP BY rid),
ls AS (SELECT rid, coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS lost_words, {", ".join(f"count(*) FILTER (rule = '{r}') AS lines_{r}" for r in RULES)} FROM lv GROUP BY rid),
f AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words,
  {", ".join(f"coalesce(lines_{r}, 0)::BIGINT AS lines_{r}" for r in RULES)}
  FROM d LEFT JOIN tot USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN ls USING (rid))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_words <= 50 * n_words) AS kept FROM f
"""
