"""Quality rules whose cutoffs come from the data: mergeable quantile sketches per language and source.

A sketch is the count of documents in each logarithmic bucket of a metric. Buckets are the integer metric
with all but its six leading bits cleared, so they are exact, 1/32 wide at most, and merging two sketches is
adding counts: sources with few documents use their language's merged sketch, small languages the whole
corpus's. A document is rejected if a metric lies beyond the far fence of its sketch (upper quartile plus
``reach`` interquartile ranges; for the word length also below the lower one), or fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import bounded_batches, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that a sketch needs; interquartile ranges from the quartile to the fence.
MIN_DOCS, REACH = 50, 4
#: Metrics in thousandths: numerator, denominator, least interquartile range, whether small values fail too.
METRICS = {
    "word_length": ("word_chars", "n_words", 350, True),
    "symbols": ("n_symbols", "n_words", 15, False),
    "dup_lines": ("n_dup_lines", "n_lines", 150, False),
    "repeats": ("n_repeat_words", "n_words", 80, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """How many different keys each owner has."""
    _, first = np.unique(W.mix(keys, owner.astype(np.uint64)), return_index=True)
    return np.bincount(owner[first], minlength=count)


def counts_of(c: W.Words) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    data, bounds = c.data, c.text_start
    inside = ~W._SPACE[data]
    out = {"n_words": np.diff(c.of), "word_chars": _sums(inside & ((data & 0xC0) != 0x80), bounds), "n_symbols": _sums(_SYMBOL[data], bounds)}

    # lines: they start where a text starts and after each \n
    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(bounds, starts, "right") - 1
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    stop = np.where(data[ends - 1] == 10, ends - 1, ends) if len(starts) else ends
    worded = _sums(inside, np.append(starts, len(data))) > 0 if len(starts) else np.zeros(0, bool)
    starts, stop, owner = starts[worded], stop[worded], owner[worded]
    sizes = stop - starts
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, starts, 1)
    np.add.at(mask, stop, -1)
    raw = data[np.cumsum(mask[:-1], dtype=np.int8) > 0]
    lines = W._hashes(raw, np.cumsum(sizes) - sizes, sizes)
    out["n_lines"] = np.bincount(owner, minlength=c.count)
    out["n_dup_lines"] = out["n_lines"] - _distinct(lines, owner, c.count)

    n, text = len(c.hash), c.text
    covered = np.zeros(n, bool)
    ok = W.window_ok(c, 3)
    if ok.any():
        at = np.flatnonzero(ok)
        _, kind, often = np.unique(W.mix(W.windows(c.hash, 3)[at], text[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        at = at[often[kind] > 1]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = _sums(covered, c.of)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """Columns doc (a struct of all input columns, whatever their names) and the counts of its text."""
    bounded_batches(docs.sparkSession)
    plain = docs.withColumn("text", docs["text"].cast("string"))
    plain = plain.select(F.struct(*(F.col(f"`{x}`") for x in plain.columns)).alias("doc"))
    schema = T.StructType([T.StructField("doc", plain.schema["doc"].dataType), *(T.StructField(x, T.LongType()) for x in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            parts = [counts_of(c) for c in W.chunks(doc.field("text"))]
            columns = [pa.array(np.concatenate([p[x] for p in parts]) if parts else [], pa.int64()) for x in COUNTS]
            yield pa.RecordBatch.from_arrays([doc, *columns], names=["doc", *COUNTS])

    return plain.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def metric(name: str) -> Column:
    """The metric in thousandths, rounded down."""
    top, bottom, *_ = METRICS[name]
    return F.expr(f"{top} * 1000 div greatest({bottom}, 1)")


def bucket(value: Column) -> Column:
    """The value with all but its six leading bits cleared."""
    cut = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: one mergeable sketch for each language, source and metric."""
    kinds = F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), bucket(metric(x)).alias("bucket")) for x in METRICS)))
    return counts.select("lang", "source", kinds.alias("k")).groupBy("lang", "source", "k.metric", "k.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, n, q1 and q3 of the sketches merged over all other columns."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("below", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    pick = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), pick(1).alias("q1"), pick(3).alias("q3"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """lang, source and for each metric its low and high fence."""
    fine, by_lang, whole = (quartiles(sketch, k) for k in (["lang", "source"], ["lang"], []))
    by_lang = by_lang.select("lang", "metric", *(F.col(x).alias(f"lang_{x}") for x in ("n", "q1", "q3")))
    whole = whole.select("metric", *(F.col(x).alias(f"all_{x}") for x in ("q1", "q3")))
    found = fine.join(by_lang, ["lang", "metric"]).join(F.broadcast(whole), "metric")  # whole: one row a metric
    level = lambda q: F.when(F.col("n") >= min_docs, F.col(q)).when(F.col("lang_n") >= min_docs, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    found = found.select("lang", "source", "metric", level("q1").alias("q1"), level("q3").alias("q3"))
    least = reduce(lambda a, x: a.when(F.col("metric") == x, METRICS[x][2]), list(METRICS)[1:], F.when(F.col("metric") == list(METRICS)[0], METRICS[list(METRICS)[0]][2]))
    range_ = F.greatest(F.col("q3") - F.col("q1"), least)
    found = found.withColumn("low", F.col("q1") - reach * range_).withColumn("high", F.col("q3") + reach * range_)
    at = lambda x, k: F.max(F.when(F.col("metric") == x, F.col(k))).alias(f"{x}_{k}")
    return found.groupBy("lang", "source").agg(*(at(x, k) for x in METRICS for k in ("low", "high")))


def _name(docs_type: T.StructType, x: str) -> Column:
    return F.coalesce(F.col("doc").getField(x).cast("string"), F.lit("")) if x in docs_type.names else F.lit("")


def judged(counts: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """counts (columns doc and COUNTS, as measured() gives) with base_failed and kept.

    Sketches are over the documents that pass the base rules. A null language or source is the one with
    the empty name; a null or empty text has no words and fails the base rules; repeated rows count and
    are judged each; an empty table stays empty.
    """
    kind = counts.schema["doc"].dataType
    keyed = counts.select("*", base_failed().alias("base_failed"), _name(kind, "lang").alias("lang"), _name(kind, "source").alias("source"))
    limits = written(thresholds(sketches(keyed.where("not base_failed")), min_docs, reach), "quality-limits")
    wrong = [metric(x) > F.col(f"{x}_high") for x in METRICS] + [metric(x) < F.col(f"{x}_low") for x in METRICS if METRICS[x][3]]
    met = keyed.join(limits, ["lang", "source"], "left")
    kept = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in wrong))
    return met.select("doc", *COUNTS, "base_failed", kept.alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of its text, base_failed and kept, for each document."""
    slim = docs.select(*(docs[x] for x in ("doc_id", "text", "lang", "source") if x in docs.columns))
    counts = measured(slim)
    keep = [F.col("doc").getField(x).alias(x) for x in slim.columns if x != "text"]
    counts = written(counts.select(F.struct(*keep).alias("doc"), *COUNTS), "quality-counts")
    return judged(counts).select("doc.doc_id", *COUNTS[:5], "base_failed", "kept", "n_lines")


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns; texts are measured twice and not shuffled."""
    return judged(measured(docs)).where("kept").select("doc.*")


def oracle_sql(min_docs: int = MIN_DOCS, reach: int = REACH) -> str:
    """verdicts() over the view documents, for DuckDB."""
    word = r"[^\x20\x09-\x0D]"
    value = {x: f"1000 * {a} // greatest({b}, 1)" for x, (a, b, *_) in METRICS.items()}
    kinds = " UNION ALL ".join(f"SELECT lang, source, '{x}' AS metric, {v} AS v FROM counts WHERE NOT base_failed" for x, v in value.items())
    least = "CASE metric " + " ".join(f"WHEN '{x}' THEN {m[2]}" for x, m in METRICS.items()) + " END"
    level = lambda q: f"CASE WHEN f.n >= {min_docs} THEN f.{q} WHEN l.n >= {min_docs} THEN l.{q} ELSE a.{q} END AS {q}"

    def quartile(keys: str) -> str:
        by = f"PARTITION BY {keys}metric"
        return f"""(SELECT {keys}metric, max(total) AS n, min(bucket) FILTER (4 * below >= total) AS q1, min(bucket) FILTER (4 * below >= 3 * total) AS q3
            FROM (SELECT {keys}metric, bucket, sum(sum(n)) OVER ({by} ORDER BY bucket) AS below, sum(sum(n)) OVER ({by}) AS total FROM sketch GROUP BY {keys}metric, bucket) GROUP BY {keys}metric)"""

    wrong = " OR ".join([f"coalesce({v} > {x}_high, false)" for x, v in value.items()] + [f"coalesce({value[x]} < {x}_low, false)" for x in METRICS if METRICS[x][3]])
    fences = ", ".join(f"max({k}) FILTER (metric = '{x}') AS {x}_{k}" for x in METRICS for k in ("low", "high"))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{word}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
    tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
    counts AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM (
        SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
            coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (doc_id))),
    sketch AS (SELECT lang, source, metric, (v >> cut) << cut AS bucket, count(*) AS n FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS cut FROM ({kinds})) GROUP BY ALL),
    q AS (SELECT f.lang, f.source, f.metric, {level("q1")}, {level("q3")} FROM {quartile("lang, source, ")} f JOIN {quartile("lang, ")} l USING (lang, metric) JOIN {quartile("")} a USING (metric)),
    lim AS (SELECT lang, source, metric, q1 - {reach} * greatest(q3 - q1, {least}) AS low, q3 + {reach} * greatest(q3 - q1, {least}) AS high FROM q),
    fence AS (SELECT lang, source, {fences} FROM lim GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({wrong}) AS kept, n_lines
    FROM counts LEFT JOIN fence USING (lang, source)
    """
