"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Per document: word and symbol counts, repeated lines and repeated 3-word windows, two
fixed base rules on them, then a vector of transformed rates. For every (language,
source) a minimum-covariance-determinant estimate gives centre and scatter of that vector;
documents whose squared Mahalanobis distance exceeds a chi-squared quantile are rejected.

Estimation covers all documents that pass the base rules and collects none: rates are
rounded to integers, so group sums are exact and don't depend on the order of rows. Each
concentration step is one aggregation by (cell, distance bin): the nearest bins give the
next mean and covariance, and of the bin in which the wanted number of rows is reached, all
rows count with the same fraction, so the weights add up to that number however many rows
tie. Steps go on until no determinant changes any more. Two starts, median with quartile
range and plain moments, run side by side; the smaller determinant wins; one reweighting
follows. Covariances hold the floors' squares on their diagonal throughout, the determinants
that are compared as well: a regularised estimate. Cells of few rows are pooled by language, then over all; where even that is
small, the base rules decide alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chi2_cdf_even, chi2_quantile_even, let

_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_P = 4
#: Features are rounded to multiples of 1 / _UNIT.
_UNIT = 1024
#: Bins of squared distance: _PER_OCTAVE each factor of two from 2^-10 to 2^30.
_PER_OCTAVE, _LOW, _HIGH = 64, -10, 30


@dataclass(frozen=True)
class McdParams:
    """share: rows that the estimate concentrates on. floors: least standard deviations of
    the features (log mean word length, log symbol rate, log repeated-line rate, log
    repeated-word rate); they keep features that hardly vary from rejecting small changes,
    and are low enough for the highest rate of each (all lines, half of the words) to
    exceed the cut alone where a cell's documents have none.
    steps: concentration steps at most, settled: change of the logarithm of a determinant below
    which they end. min_rows: smallest cell with an estimate of its own; five
    rows for each feature, where the floors keep the matrix regular.
    tail: chance that a normal vector is rejected."""

    share: float = 0.75
    floors: tuple[float, ...] = (0.08, 0.3, 0.15, 0.12)
    steps: int = 20
    settled: float = 1e-4
    min_rows: int = 20
    tail: float = 1e-6


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows compare by 64-bit hash."""

    def windows(w: Column) -> Column:
        ids = F.sequence(F.lit(1), F.size(w) - 2)
        return F.transform(ids, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def marked(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(sorted_, positions)

    def positions(s: Column) -> Column:
        n = F.size(s)
        near = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"]))
        hit = F.filter(s, near)
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        # each position covers 3 words, less what the next one covers again
        step = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    some = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), marked(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= 3, some).otherwise(F.lit(0))


def base_stats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source), the columns ``carry`` and the counts of each text; a null text has none, hence fails.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")
    solid = F.translate(text, " " + _SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + _SPACES, "")) > 0)
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = docs.select(*carry, "doc_id", "lang", "source", counts.alias("w"), line_counts.alias("l"), F.length(solid).alias("c"), (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).alias("s"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    out = out.select(*carry, "doc_id", "lang", "source", long("w.n", "n_words"), long("c", "word_chars"), long("s", "n_symbols"), long("l.dup", "n_dup_lines"), long("w.rep", "n_repeat_words"), long("l.n", "n_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = [
        F.log(F.greatest(F.col("word_chars") / words, F.lit(0.5))),
        F.log1p(20.0 * F.col("n_symbols") / words),
        F.log1p(4.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(4.0 * F.col("n_repeat_words") / words),
    ]
    return [F.round(x * _UNIT).cast("long").alias(f"q{i}") for i, x in enumerate(raw)]


def vectors(stats: DataFrame) -> DataFrame:
    return stats.select("*", *_features())


_Q = [f"q{i}" for i in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_MOMENT_NAMES = ["n", *[f"s_{q}" for q in _Q], *[f"s{i}{j}" for i, j in _PAIRS]]


def _moments() -> list[Column]:
    cross = [F.sum(F.col(_Q[i]) * F.col(_Q[j])).alias(f"s{i}{j}") for i, j in _PAIRS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(q).alias(f"s_{q}") for q in _Q], *cross]


_PARAMS = [*[f"mu{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS], "logdet"]


def _estimate(moments: DataFrame, keys: list[str], factor: float, floors) -> DataFrame:
    """Mean and Cholesky factor of the scaled covariance, with the floors on its diagonal."""
    n = F.col("n").cast("double")
    out = moments.select(*keys, "n", *[(F.col(f"s_q{i}") / n / _UNIT).alias(f"mu{i}") for i in range(_P)], *[f"s{i}{j}" for i, j in _PAIRS])
    cov = [
        (factor * (F.col(f"s{i}{j}") / n / (_UNIT * _UNIT) - F.col(f"mu{i}") * F.col(f"mu{j}")) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i, j in _PAIRS
    ]
    return _cholesky(out.select(*keys, *[f"mu{i}" for i in range(_P)], *cov), keys)


def _cholesky(out: DataFrame, keys: list[str]) -> DataFrame:
    for i, j in _PAIRS:
        inner = F.lit(0.0)
        for k in range(j):
            inner = inner + F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        rest = F.col(f"c{i}{j}") - inner
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, _P)), F.log(F.col("l00")))
    return out.select(*keys, *_PARAMS[:-1], logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of an estimate."""
    z: list[Column] = []
    for i in range(_P):
        rest = F.col(f"q{i}") / float(_UNIT) - F.col(f"mu{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _bin(d2: Column) -> Column:
    b = F.floor(_PER_OCTAVE * F.log2(d2 + 2.0**_LOW))
    return F.least(F.greatest(b, F.lit(_LOW * _PER_OCTAVE)), F.lit(_HIGH * _PER_OCTAVE)).cast("int")


def _join(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    p = params.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    on = rows["lang"].eqNullSafe(p["__lang"]) & rows["source"].eqNullSafe(p["__source"])
    return rows.join(p, on, how).drop("__lang", "__source")


def _cells(rows: DataFrame, scratch: Scratch, min_rows: int) -> DataFrame:
    """(lang, source, cell): the source itself, its language's small sources, or all small ones."""
    counts = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.save(counts, "cells")
    small = counts.where(F.col("n") < min_rows)
    by_lang = small.groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "__l")
    out = counts.join(by_lang, counts["lang"].eqNullSafe(by_lang["__l"]), "left").drop("__l")
    own = F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source"))
    pooled = F.to_json(F.struct(F.lit(1).alias("level"), "lang"))
    cell = F.when(F.col("n") >= min_rows, own).when(F.col("n_lang") >= min_rows, pooled).otherwise(F.lit("all"))
    return scratch.save(out.select("lang", "source", cell.alias("cell")), "cell-names")


def _median_start(rows: DataFrame, floors) -> DataFrame:
    """Medians and quartile ranges of each feature, exact from counts of its rounded values."""
    feats = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col(q).alias("v")) for i, q in enumerate(_Q)]))
    counts = rows.select("cell", feats.alias("f")).groupBy("cell", "f.j", "f.v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cell", "j").orderBy("v")
    cum = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("cell", "j")))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("v")))
    q = cum.groupBy("cell", "j").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    pick = lambda i, x: F.max(F.when(F.col("j") == i, x))
    sd = (F.col("hi") - F.col("lo")) / (1.349 * _UNIT)
    out = q.groupBy("cell").agg(
        *[pick(i, F.col("mid") / float(_UNIT)).alias(f"mu{i}") for i in range(_P)],
        *[(pick(i, sd * sd) + floors[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS],
    )
    return _cholesky(out.withColumn("start", F.lit(0)), ["cell", "start"])


def _step(rows: DataFrame, params: DataFrame, keys: list[str], share: float | None, cut: float | None) -> DataFrame:
    """Moments of the rows of smallest distance: a share of each cell, or all up to cut."""
    near = _join(rows.drop("cell"), params).withColumn("d2", _distance())
    if cut is not None:
        return near.where(F.col("d2") <= cut).groupBy(*keys).agg(*_moments())
    binned = near.withColumn("b", _bin(F.col("d2"))).groupBy(*keys, "b").agg(*_moments())
    w = Window.partitionBy(*keys)
    cum = binned.withColumn("before", F.sum("n").over(w.orderBy("b")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    wanted = F.ceil(share * F.col("all")) - F.col("before")
    inner = cum.withColumn("part", F.least(F.lit(1.0), wanted / F.col("n"))).where(wanted > 0)
    # rounded to whole moments, so sums stay exact
    return inner.groupBy(*keys).agg(*[F.sum(F.round(F.col(c) * F.col("part")).cast("long")).alias(c) for c in _MOMENT_NAMES])


def fit(rows: DataFrame, scratch: Scratch, params: McdParams) -> DataFrame:
    """Estimates by (lang, source): rows holds vectors() of documents that pass the base rules."""
    cells = _cells(rows, scratch, params.min_rows)
    rows = scratch.save(_join(rows.select("lang", "source", *_Q), cells), "vectors")
    spread = lambda est, name: scratch.save(cells.join(est, "cell"), name)
    share_factor = params.share / chi2_cdf_even(chi2_quantile_even(params.share, _P), _P + 2)
    plain = rows.groupBy("cell").agg(*_moments()).withColumn("start", F.lit(1))
    start = _median_start(rows, params.floors).unionByName(_estimate(plain, ["cell", "start"], 1.0, params.floors))
    est = spread(start, "start")
    dets = lambda e: e.select("cell", "start", "logdet").distinct()
    for k in range(params.steps):
        before, moments = dets(est).withColumnRenamed("logdet", "was"), _step(rows, est, ["cell", "start"], params.share, None)
        est = spread(_estimate(moments, ["cell", "start"], share_factor, params.floors), f"step{k}")
        moved = dets(est).join(before, ["cell", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if not (moved or 0.0) > params.settled:
            break
    best = est.groupBy("lang", "source", "cell").agg(F.min_by(F.struct("start", *_PARAMS), F.struct("logdet", "start")).alias("e"))
    best = scratch.save(best.select("lang", "source", "cell", *[F.col(f"e.{c}").alias(c) for c in _PARAMS]), "best")
    inner = 0.975
    factor = inner / chi2_cdf_even(chi2_quantile_even(inner, _P), _P + 2)
    moments = _step(rows, best, ["cell"], None, chi2_quantile_even(inner, _P))
    small = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= params.min_rows).select("cell")
    return spread(_estimate(moments, ["cell"], factor, params.floors).join(small, "cell", "left_semi"), "final")


def judge(vectors_: DataFrame, estimates: DataFrame, params: McdParams) -> DataFrame:
    """Adds mahalanobis2 (null without an estimate) and kept."""
    out = _join(vectors_, estimates.drop("cell"), "left").withColumn("mahalanobis2", F.when(~F.col("base_failed"), _distance()))
    cut = chi2_quantile_even(1 - params.tail, _P)
    kept = ~F.col("base_failed") & F.coalesce(F.col("mahalanobis2") <= cut, F.lit(True))
    return out.withColumn("kept", kept).drop(*_PARAMS)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def assess(docs: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts, base_failed, kept, mahalanobis2.

    Null or empty texts have no words and fail. Null languages and sources form cells of
    their own; null and repeated doc_ids are rows like others; other columns of ``docs``
    are not looked at; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(vectors(base_stats(docs)), "stats")
    est = fit(stats.where(~F.col("base_failed")), scratch, params)
    return judge(stats, est, params).select("doc_id", "lang", "source", *STATS, "mahalanobis2")


def keep_good(docs: DataFrame, params: McdParams = McdParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns.

    Rows are saved with their counts beside them, so texts are counted once, no row is
    matched by identifier and no text is shuffled. Null and empty texts fail the base
    rules and go; repeated rows and rows of one doc_id are rows like others; columns of any
    name pass through; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    names = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], *[F.col(c).alias(c) for c in ("doc_id", "lang", "source", "text")])
    counted = scratch.save(vectors(base_stats(carried, tuple(names))), "counted", "zstd")
    est = fit(counted.where(~F.col("base_failed")).select("lang", "source", *_Q), scratch, params)
    kept = judge(counted, est, params).where("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])
