"""URL filter: host and path rules, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texthash import mix, utf8_buffers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled rows that training takes at most; more are an error, none are dropped.
MAX_TRAINING_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class NgramModel:
    """weights: one for each of 2^bits hash places; a URL's score is bias plus the mean weight of its n-grams times scale."""

    bits: int
    sizes: tuple[int, ...]
    bias: float
    weights: np.ndarray


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.host)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _places(column: pa.Array, sizes, bits):
    """Hash places of all n-grams (bytes of ``^text$``) in order of size, and for each size their strings' bounds."""
    data, offsets = utf8_buffers(column)
    n = len(offsets) - 1
    length = np.diff(offsets)
    framed = np.full(len(data) + 2 * n, ord("^"), np.uint8)
    start = offsets[:-1] + 2 * np.arange(n)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, length)
    framed[place] = data
    end = start + length + 1
    framed[end] = ord("$")
    for size in sizes:
        m = max(0, len(framed) - size + 1)
        h = np.full(m, size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + framed[j:j + m].astype(np.uint64)
        yield (mix(h) >> np.uint64(64 - bits)).astype(np.int64), np.minimum(start, m), np.minimum(np.maximum(end + 2 - size, start), m)


def scores(column: pa.Array, model: NgramModel) -> np.ndarray:
    n = len(column)
    total, count = np.zeros(n), np.zeros(n)
    for h, a, b in _places(column, model.sizes, model.bits):
        run = np.concatenate(([0.0], np.cumsum(model.weights[h])))
        total += run[b] - run[a]
        count += b - a
    return model.bias + total / np.maximum(count, 1)


def train(texts: Sequence[str], blocked: Sequence[int], bits: int = 14, sizes=(3, 4, 5), rounds: int = 400, rate: float = 40.0, shrink: float = 1e-5) -> NgramModel:
    """Logistic regression by full-batch gradient steps; the same table gives the same model."""
    y = np.asarray(blocked, float)
    rows, cols = [], []
    count = np.zeros(len(texts))
    for h, a, b in _places(pa.array(list(texts), pa.string()), sizes, bits):
        k = b - a
        count += k
        rows.append(np.repeat(np.arange(len(texts)), k))
        cols.append(h[np.concatenate([np.arange(x, z) for x, z in zip(a, b)])] if len(a) else np.zeros(0, np.int64))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    value = 1.0 / np.maximum(count, 1)[rows]
    w, bias = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = bias + np.bincount(rows, w[cols] * value, len(texts))
        err = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(cols, err[rows] * value, 1 << bits) + shrink * w)
        bias -= 0.1 * rate * err.mean()
    return NgramModel(bits, tuple(sizes), bias, w)


#: Words of the labelled table: unwanted kinds, plain topics, and words that go with either.
UNWANTED_KINDS = {
    "bets": ("bet", "bets", "betting", "casino", "poker", "slots", "jackpot", "lotto"),
    "ads": ("ads", "adserver", "advert", "banner", "popup", "sponsored"),
    "tracking": ("track", "tracker", "tracking", "pixel", "beacon", "clicks"),
    "spam": ("spam", "spammer", "bulkmail", "linkfarm"),
    "pills": ("pills", "pharma", "viagra", "meds"),
    "adult": ("adult", "xxx", "porn", "sexy", "escort"),
    "loans": ("loan", "loans", "payday", "cash"),
    "fakes": ("replica", "keygen", "crack", "warez"),
}
PLAIN_TOPICS = ("garden", "library", "weather", "school", "maps", "news", "history", "math", "recipe", "train", "music", "bird", "museum", "poetry", "river", "physics", "cycling", "chess", "health", "travel", "bakery", "address", "better", "racetrack", "betula", "shadow")
ADDED = ("online", "hub", "best", "my", "top", "web", "world", "zone", "daily", "live", "go", "club")
PATHS = tuple(f"/{lang}/{n}{end}" for lang, n, end in zip(("en", "de", "fr", "es", "en", "de", "fr"), (7, 42, 318, 1906, 2753, 4680, 8591), ("", ".html", "/", "", ".html", "/", "")))


#: The cut of the fewest errors on host names of the table that the scoring model hasn't seen; a test computes it anew.
THRESHOLD = 0.20564285361897386


def labelled_rows() -> list[tuple[str, int, str, str]]:
    """The small labelled table, made from words of kinds by rule: host and path, 1 for unwanted, the host's word, its kind."""
    syllables = ("th", "er", "on", "an", "re", "ing", "ha", "nt", "ion", "ea")
    kinds = [(w, kind) for kind, words in UNWANTED_KINDS.items() for w in words]
    topics = [(w, "topic") for w in PLAIN_TOPICS]
    joined = lambda words, n: [((f"{w}{d}{x}", f"{x}{d}{w}")[k % 2], w, kind) for i, (w, kind) in enumerate(words) for k in range(n) for d, x in (("-" if k % 4 < 3 else "", ADDED[(i + 5 * k) % len(ADDED)]),)]
    plain = [(a + b + c,) * 2 + ("name",) for a in syllables for b in syllables[1:9] for c in syllables[5:8]]
    out = []
    for i, (names, label) in enumerate(((joined(kinds, 8), 1), (joined(topics, 12), 0), (plain, 0))):
        for j, (name, word, kind) in enumerate(names):
            for k in range(4):
                sub = ("", "www.", "m.", "blog.")[(i + j + k) % 4]
                top = ("example.com", "example.net", "example.org")[(j + k) % 3]
                # the same few paths with either label, so that a path says little
                out.append((f"{sub}{name}.{top}" + PATHS[(j + 3 * k) % len(PATHS)], label, word, kind))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """(host and path, 1 for unwanted) of the labelled table."""
    return [(text, label) for text, label, _, _ in labelled_rows()]


def host_names(texts: Sequence[str]) -> list[str]:
    """Of each text's host the label that is rarest in the table, its top-level label aside."""
    labels = [t.split("/", 1)[0].split(".") for t in texts]
    seen = Counter(x for row in labels for x in row)
    return [min(row[:-1] or row, key=lambda x: (seen[x], -len(x), x)) for row in labels]


def held_out_scores(known: Sequence[tuple[str, int]], folds: int = 4, groups: Sequence[str] | None = None) -> np.ndarray:
    """Each text's score by a model that saw none of the texts of its group, by default of its host name."""
    fold = np.array([zlib.crc32(x.encode()) % folds for x in groups or host_names([u for u, _ in known])], np.int64)
    out = np.zeros(len(known))
    for f in range(folds):
        rest, mine = [known[i] for i in np.flatnonzero(fold != f)], np.flatnonzero(fold == f)
        if len(rest) and len(mine):
            out[mine] = scores(pa.array([known[i][0] for i in mine], pa.string()), train([u for u, _ in rest], [y for _, y in rest]))
    return out


def best_cut(score: np.ndarray, blocked: Sequence[int]) -> float:
    """The cut of the fewest errors, the nearest to 0 of several; 0 if a label is missing."""
    y = np.asarray(blocked, bool)
    if y.all() or not y.any():
        return 0.0
    at = np.unique(score)
    cuts = np.concatenate(([0.0], (at[1:] + at[:-1]) / 2))
    bad, good = np.sort(score[y]), np.sort(score[~y])
    wrong = np.searchsorted(bad, cuts, "right") + len(good) - np.searchsorted(good, cuts, "right")
    return float(cuts[np.lexsort((np.abs(cuts), wrong))[0]])


def _score_batches(model: NgramModel):
    def run(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores(text, model))], names=[*b.schema.names[:-1], "score"])

    return run


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score.

    A rule's verdict comes first, the longest rule's among several and of equal ones the last
    named; else a score above the threshold blocks. ``labelled`` (url_text, blocked) of at most
    MAX_TRAINING_ROWS rows trains the model, and its threshold is the best cut of its held-out
    scores; by default the table of this module with THRESHOLD. Null and malformed URLs have
    empty host and path, which don't block. URLs of any length are judged whole; repeated rows
    stay, null page_ids too; an empty table gives an empty result; other columns are not looked at.
    """
    if labelled is None:
        known = labelled_urls()
    else:
        known = [(r[0] or "", int(r[1])) for r in labelled.where("blocked is not null").select("url_text", "blocked").orderBy("url_text", "blocked").limit(MAX_TRAINING_ROWS + 1).collect()]
        if len(known) > MAX_TRAINING_ROWS:
            raise ValueError(f"more than {MAX_TRAINING_ROWS} labelled rows")
    model = train([u for u, _ in known], [y for _, y in known])
    if threshold is None:
        threshold = THRESHOLD if labelled is None else best_cut(held_out_scores(known), [y for _, y in known])
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("t"))
    kind = dict(rows.dtypes)["page_id"]
    out = rows.mapInArrow(_score_batches(model), f"page_id {kind}, host string, path string, rule string, verdict string, score double")
    some = (F.col("host") != "") | (F.col("path") != "")
    by_score = F.when(some & (F.col("score") > threshold), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("verdict", by_score))
