"""Quality rules with host-level verdicts.

Every document is measured by line, word and symbol statistics of its whole text.  Rule
failures are counted by host (the ``source`` column), each host's failure rate is shrunk
with a beta prior fitted to all hosts, and a host whose shrunk rate reaches the limit of
a rule loses all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sent, small_batches
from .kernels import SPACE, mix, run_hash, slices, span_hash

MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A host is rejected when its shrunk rate of failing a rule reaches this.
HOST_LIMIT = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules counted by host, as conditions on the metrics.
RULES = {
    "short": f"_q_n_words < {MIN_WORDS}",
    "repeats": f"100 * _q_n_repeat_words > {REPEAT_PERCENT} * _q_n_words",
    "symbols": "_q_n_words > 0 and 10 * _q_n_symbols > _q_n_words",
}


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The metrics of every text, computed in slices of whole texts."""
    out = {k: [np.zeros(0, np.int64)] for k in METRICS}
    for s in slices(texts):
        starts, ends = s.words()
        owner = s.owner(starts)
        out["n_words"].append(np.bincount(owner, minlength=s.n))
        out["word_chars"].append(_sums(~SPACE[s.data] & ((s.data & 0xC0) != 0x80), s.offsets))
        out["n_symbols"].append(_sums(SYMBOLS[s.data], s.offsets))
        sums = s.prefix()
        salt = mix(np.arange(s.n, dtype=np.uint64) + np.uint64(1))
        # lines with a word, equal to an earlier line of the text
        first, last, of = s.lines()
        before = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(~SPACE[s.data], out=before[1:])
        filled = before[last] > before[first]
        first, last, of = first[filled], last[filled], of[filled]
        _, seen = np.unique(span_hash(sums, first, last) ^ salt[of], return_index=True)
        out["n_dup_lines"].append(np.bincount(of, minlength=s.n) - np.bincount(of[seen], minlength=s.n))
        # words inside windows that occur twice or more in their text
        window = run_hash(span_hash(sums, starts, ends), REPEAT_WINDOW)
        whole = np.flatnonzero(owner[: len(window)] == owner[REPEAT_WINDOW - 1 :]) if len(window) else np.zeros(0, np.int64)
        keys = window[whole] ^ salt[owner[whole]]
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys), bool)
        equal = keys[order][1:] == keys[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, whole[same], 1)
        np.add.at(cover, whole[same] + REPEAT_WINDOW, -1)
        out["n_repeat_words"].append(np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=s.n))
    return {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}


def with_metrics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the metrics, prefixed by ``_q_``, row by row."""
    keep = docs.columns if keep is None else keep
    read = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_q_text"))
    fields = "".join(f", _q_{m} long" for m in METRICS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + fields

    def run(batches):
        for b in batches:
            found = measure(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(found[m]) for m in METRICS)], [*keep, *(f"_q_{m}" for m in METRICS)])

    return read.mapInArrow(run, schema)


def _rules() -> dict:
    return {name: F.expr(rule) for name, rule in RULES.items()}


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, docs, the shrunk rate of each rule, rejected), one row for each host, null included.

    Prior of a rule: alpha and beta by moments over hosts, weighted by documents: with mean m
    and between-host variance v, alpha + beta = m (1 - m) / v - 1, held to 1 .. 10,000.
    A host without documents of its own would get m.
    """
    counts = measured.groupBy(host).agg(F.count(F.lit(1)).alias("docs"), *[F.sum(rule.cast("long")).alias(f"fail_{k}") for k, rule in _rules().items()])
    counts = cut(counts, "hosts")
    totals = counts.agg(F.sum("docs").alias("n"), *[F.sum(f"fail_{k}").alias(f"f_{k}") for k in RULES], *[F.sum(F.col(f"fail_{k}") * F.col(f"fail_{k}") / F.col("docs")).alias(f"s_{k}") for k in RULES]).first()
    rates = []
    for k in RULES:
        n = totals["n"] or 0
        mean = (totals[f"f_{k}"] or 0) / n if n else 0.0
        spread = max((totals[f"s_{k}"] or 0.0) / n - mean * mean, 0.0) if n else 0.0
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 10_000.0) if spread > 1e-12 else 10_000.0
        rates.append(((F.col(f"fail_{k}") + F.lit(weight * mean)) / (F.col("docs") + F.lit(weight))).alias(f"rate_{k}"))
    rated = counts.select(host, "docs", *rates)
    return rated.withColumn("rejected", F.greatest(*[F.col(f"rate_{k}") for k in RULES]) >= limit)


def _verdicts(docs: DataFrame, keep: list[str], text: str, host: str, limit: float, reuse: bool) -> DataFrame:
    """Columns _k0 .. of ``keep``, the metrics as _q_.., _failed and _kept: names that can't clash with those of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(host).alias("_host"), F.col(text).alias("_words"))
    measured = with_metrics(rows, "_words", [*(f"_k{i}" for i in range(len(keep))), "_host"])
    if reuse:
        measured = cut(measured, "metrics")
        counted = measured
    else:
        counted = with_metrics(rows, "_words", ["_host"])
    bad = host_verdicts(counted, "_host", limit).where("rejected").select(F.col("_host").alias("_bad"), F.lit(True).alias("_rejected"))
    bad = cut(bad, "rejected")
    rules = _rules()
    found = measured.join(sent(bad), measured["_host"].eqNullSafe(bad["_bad"]), "left").withColumn("_failed", rules["short"] | rules["repeats"])
    return found.withColumn("_kept", ~F.col("_failed") & F.col("_rejected").isNull())


def judged(docs: DataFrame, keep: list[str] | None = None, text: str = "text", host: str = "source", limit: float = HOST_LIMIT, reuse: bool = False) -> DataFrame:
    """``keep`` columns, metrics, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words and so fail; very long texts are measured whole;
    repeated rows are judged alike and all returned, ties of any kind likewise; a null host is
    a host; an empty table gives no rows; columns of ``docs`` with the names of results are
    replaced by these.  With ``reuse`` the measured rows are cut once; without, the texts are
    measured again in the second pass, which keeps whole texts out of any shuffle or cut.
    """
    keep = docs.columns if keep is None else keep
    found = _verdicts(docs, keep, text, host, limit, reuse)
    results = [*METRICS, "base_failed", "kept"]
    same = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c not in results]
    return found.select(*same, *[F.col(f"_q_{m}").alias(m) for m in METRICS], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that neither their own rules nor their host's verdict reject.

    Nulls, empty and very long texts, ties, repeated rows and empty tables: as in ``judged``;
    a column of any name comes through as it is.
    """
    found = _verdicts(docs, docs.columns, "text", "source", HOST_LIMIT, False).where("_kept")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_host_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, ["doc_id"], reuse=True).select("doc_id", *METRICS, "base_failed", "kept")
