"""URL filtering: longest-match rules first, then a ratio of two character language models.

The rules' verdicts label the URLs they fit.  Variable-order Markov models (orders 0 to ``ORDER``, each order
smoothed by the one below) of accepted and of rejected URLs are counted over every labelled URL outside the
calibration fold, under 64-bit keys in a table of all distinct ones: up to ``MOST_KEYS`` of them are broadcast, 24 bytes a
key, and more are joined to the keys of the URLs that need a score.  A URL's score is the difference of its two mean
log-likelihoods per byte, calibrated to a probability by a logistic fit on the fold that the models have not seen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import mix, pieces, spread, utf8
from ._spark import durable, row_base, tune

#: Longest context in bytes, weight of the order below.
ORDER, BACKOFF = 5, 2.0
#: One URL in so many calibrates the scores; bins of the calibration histogram and the range they cover.
FOLD, BINS, REACH = 5, 2048, 8.0
#: Most keys of a table that is broadcast: 128 MB.
MOST_KEYS = 5 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return _ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls(row, host, path)`` -> ``(row, rule, verdict)`` of the longest fitting rule; ties go to block, then by text.

    Rules meet hosts by an equi-join on the host's suffixes, so a list of any length works.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in dict.fromkeys(rules)], "rule_host string, rule_path string, rule string, verdict string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = urls.where("host <> ''").select("row", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "block", "rule"))
    return fits.groupBy("row").agg(best.alias("best")).select("row", "best.rule", "best.verdict")


def _keys(buf: np.ndarray, off: np.ndarray, order: int):
    """For each byte of each URL and each order: 64-bit keys of its context and of its context with the byte."""
    lens = np.diff(off)
    data = np.zeros(int(lens.sum()) + len(lens) * order, np.uint64)
    begins = np.cumsum(lens + order) - lens
    at = spread(begins, lens)
    data[at] = buf.astype(np.uint64) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    context, out = np.zeros(len(at), np.uint64), []
    for k in range(order + 1):
        if k:
            context += data[at - k] * np.uint64(pow(base, k, 1 << 64))
        salt = np.uint64(2 * k + 1)
        out.append((mix(context + salt), mix(context + data[at] * np.uint64(0xD6E8FEB86659FD93) + salt + np.uint64(1 << 32))))
    return out, np.concatenate([[0], np.cumsum(lens)])


def count_models(labelled: DataFrame, order: int) -> DataFrame:
    """``labelled(url, accepted)`` -> ``(key, rejected, accepted)``: each distinct key and how often either kind has it."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(0))
            kind = np.asarray(b.column(1)).astype(np.int64)
            for i, j in pieces(off):
                keys, first = _keys(buf[off[i] : off[j]], off[i : j + 1] - off[i], order)
                own = np.repeat(kind[i:j], np.diff(first)).astype(bool)
                for c in (0, 1):
                    key, n = np.unique(np.concatenate([x[own == bool(c)] for pair in keys for x in pair]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n if c == 0 else n * 0), pa.array(n if c else n * 0)], ["key", "rejected", "accepted"])

    counted = labelled.select("url", F.col("accepted").cast("int").alias("accepted")).mapInArrow(run, "key long, rejected long, accepted long")
    return counted.groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def gathered(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A counted table of bounded size as sorted keys and their counts [2, keys] in rejected and accepted URLs."""
    rows = counted.toArrow()
    key = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
    order_of = np.argsort(key)
    return key[order_of], np.stack([rows[c].to_numpy().astype(np.int64)[order_of] for c in ("rejected", "accepted")])


def _counts_of(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts [2, keys] of each key, 0 where it was never counted."""
    held, counts = table
    if not len(held):
        return np.zeros((2, len(keys)), counts.dtype)
    own, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
    return (counts[:, at] * (held[at] == own))[:, back]


def _ratio(seen: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, backoff: float) -> np.ndarray:
    """Mean log-likelihood ratio of URLs from the counts [2, bytes] of each order's contexts and contexts with the byte."""
    score = np.zeros(int(first[-1]))
    for c, sign in ((1, 1.0), (0, -1.0)):
        p = np.full(len(score), 1 / 256)
        for context, full in seen:
            p = (full[c] + backoff * p) / (np.maximum(context[c], full[c]) + backoff)
        score += sign * np.log(p)
    total = np.concatenate([[0.0], np.cumsum(score)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)


def log_ratio(buf: np.ndarray, off: np.ndarray, table: tuple[np.ndarray, np.ndarray], order: int, backoff: float) -> np.ndarray:
    """Mean log-likelihood of each URL under the accepted model less that under the rejected one; 0 for an empty URL."""
    keys, first = _keys(buf, off, order)
    return _ratio([(_counts_of(context, table), _counts_of(full, table)) for context, full in keys], first, backoff)


def joined_ratios(urls: DataFrame, counted: DataFrame, order: int, backoff: float) -> DataFrame:
    """``urls(row, url)`` -> ``(row, z)`` by a join of their keys with the counted table, for tables of any size.

    A key is 24 bytes and a URL has 2 (order + 1) for each byte; a URL's own keys meet again in one row."""

    def explode(batches):
        for b in batches:
            rows = np.asarray(b.column(0))
            buf, off = utf8(b.column(1))
            for i, j in pieces(off, 1 << 14):
                keys, first = _keys(buf[off[i] : off[j]], off[i : j + 1] - off[i], order)
                n = np.diff(first)
                place = spread(np.zeros(len(n), np.int64), n)
                every = [x for pair in keys for x in pair]
                cols = [np.tile(np.repeat(rows[i:j], n), len(every)), np.concatenate([place * len(every) + k for k in range(len(every))]), np.concatenate(every).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "at", "key"])

    def score(batches):
        for b in batches:
            offsets = np.asarray(b.column(1).offsets).astype(np.int64)
            flat = b.column(1).values.slice(offsets[0], offsets[-1] - offsets[0])
            at, rejected, accepted = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            per = 2 * (order + 1)
            n = np.diff(offsets) // per
            own = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            sorted_at = np.lexsort((at, own))
            grid = np.stack([rejected, accepted])[:, sorted_at].reshape(2, -1, per)
            first = np.concatenate([[0], np.cumsum(n)])
            z = _ratio([(grid[:, :, 2 * k], grid[:, :, 2 * k + 1]) for k in range(order + 1)], first, backoff)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z)], ["row", "z"])

    found = urls.select("row", "url").mapInArrow(explode, "row long, at long, key long").join(counted, "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.groupBy("row").agg(F.collect_list(F.struct("at", count("rejected"), count("accepted"))).alias("k")).mapInArrow(score, "row long, z double")


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with weights, by Newton steps with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum(w * (y - p) * z) - 1e-3 * a, np.sum(w * (y - p)) - 1e-3 * b])
        q = w * p * (1 - p)
        h = np.array([[np.sum(q * z * z) + 1e-3, np.sum(q * z)], [np.sum(q * z), np.sum(q) + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (max(float(a), 1e-6), float(b))


def url_verdicts(pages: DataFrame, rules: list[Rule], order: int = ORDER, backoff: float = BACKOFF, most_keys: int = MOST_KEYS) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``(page_id, host, path, rule, verdict, score)``, one row per input row.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.  Where no
    rule fits, the verdict is ``allow`` if the calibrated probability ``score`` is 0.5 or more.  A null URL, or one
    without ``://``, has empty host and path and fits no rule; without labelled URLs of both kinds every score is 0.5.
    Repeated rows count each; other columns are ignored.
    """
    spark = pages.sparkSession
    tune(spark)

    def numbered(batches):
        row = row_base()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), *b.columns], ["row", "page_id", "url"])
            row += b.num_rows

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(numbered, "row long, page_id long, url string")
    host, path = split_url(F.col("url"))
    base = durable(named.select("row", "page_id", "url", host.alias("host"), path.alias("path")))
    ruled = durable(base.join(matched_rules(base.select("row", "host", "path"), rules), "row", "left"))
    fold = F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(FOLD)) == 0
    counted = durable(count_models(ruled.where(F.col("rule").isNotNull() & ~fold).select("url", (F.col("verdict") == "allow").alias("accepted")), order))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    if counted.count() <= most_keys:
        keys, counts = gathered(counted)
        held = spark.sparkContext.broadcast((keys, counts.astype(np.float64)))  # exact to 2^53, as the join's

        def scores(batches):
            for b in batches:
                buf, off = utf8(b.column(b.schema.get_field_index("url")))
                z = [log_ratio(buf[off[i] : off[j]], off[i : j + 1] - off[i], held.value, order, backoff) for i, j in pieces(off)]
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(np.concatenate([*z, np.zeros(0)]))], [*columns, "fold", "z"])

        scored = ruled.select("page_id", "url", *columns[1:], fold.alias("fold")).mapInArrow(scores, "page_id long, host string, path string, rule string, verdict string, fold boolean, z double")
    else:
        ratios = joined_ratios(ruled, counted, order, backoff)
        scored = ruled.join(ratios, "row", "left").select(*columns, fold.alias("fold"), F.coalesce("z", F.lit(0.0)).alias("z"))
    scored = durable(scored)
    bin_of = F.floor((F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("z"))) + REACH) * (BINS / (2 * REACH)))
    seen = scored.where("fold and rule is not null").groupBy(bin_of.alias("bin"), (F.col("verdict") == "allow").alias("ok")).count().collect()  # at most 2 x (BINS + 1) rows
    if len({r["ok"] for r in seen}) == 2:
        z = np.array([(r["bin"] + 0.5) * 2 * REACH / BINS - REACH for r in seen])
        slope, offset = _platt(z, np.array([float(r["ok"]) for r in seen]), np.array([float(r["count"]) for r in seen]))
    else:
        slope, offset = 0.0, 0.0
    score = F.round(1 / (1 + F.exp(-(F.col("z") * slope + offset))), 6)
    verdict = F.coalesce("verdict", F.when(score >= 0.5, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
