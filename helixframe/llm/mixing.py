"""Hierarchical token budgets over a tree of domains, languages and sources.

The budget runs down the tree by weights. A node can hold its leaves' tokens times the
epochs allowed. Where a child's share is more than it can hold, its siblings share the
rest by their weights; only what all children together can't hold was never given to
their parent, as the parent itself is capped in the same way. So shortages are met by
siblings first and by the siblings of ancestors after that. Each leaf then takes the
prefix of its documents' token stream: epochs in turn, each a seeded shuffle, and of the
document in which the target falls its first tokens only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lit_long
from .numbering import piece_of, running_totals

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixParams:
    """share: budget as a share of all tokens. epochs: times that a document may be used.
    weights: for (level, name), default 1. domains: domain of each source by the remainder
    of its number, which stands in for a table of domains."""

    share: float = 0.6
    epochs: int = 2
    seed: int = 7
    domains: tuple[str, ...] = ("web", "books", "news", "reference")
    weights: tuple[tuple[str, str, int], ...] = field(
        default=(("domain", "web", 4), ("domain", "books", 3), ("domain", "news", 2), ("domain", "reference", 1), ("lang", "en", 6), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 2))
    )


def token_count(text: Column) -> Column:
    """Words between ASCII spaces, as the tokens of the budget."""
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(clean, " "), "")).cast("long")


def token_prefix(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    clean = F.translate(text.cast("string"), "\t\n\x0b\x0c\r", "     ")  # one character for each
    at = F.filter(F.transform(F.split(clean, " "), lambda x, i: F.when(x != "", i + 1)), lambda i: i.isNotNull())
    return F.substr(text.cast("string"), F.lit(1), F.length(F.call_function("substring_index", clean, F.lit(" "), F.get(at, (n - 1).cast("int")))))


def domain_of(source: Column, domains) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    at = F.coalesce(F.when(number != "", number).cast("int"), F.lit(0)) % len(domains)
    return F.element_at(F.array(*[F.lit(d) for d in domains]), at + 1)


def _weight(level: str, name: Column, weights) -> Column:
    out = F.lit(1)
    for lev, key, w in weights:
        if lev == level:
            out = F.when(name == key, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Splits ``budget`` of each parent among children (cap, weight, ord) by weight under their caps.

    Children are taken by cap / weight. Each gets the lesser of its cap and its part of what
    is left for it and those after it; floors leave whole tokens to later ones.
    """
    by = Window.partitionBy(*parent).orderBy("ratio", "ord")
    later = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("ratio", F.col("cap") / F.col("weight").cast("double"))
    c = c.withColumn("w_left", F.sum("weight").over(later)).withColumn("c_before", F.coalesce(F.sum("cap").over(earlier), lit_long(0)))
    # children up to the water level are full; the first that isn't fixes the level
    full = (F.col("budget") - F.col("c_before")) * F.col("weight").cast("decimal(20,0)") >= F.col("cap") * F.col("w_left").cast("decimal(20,0)")
    c = c.withColumn("open", (~full).cast("int"))
    c = c.withColumn("is_open", F.max("open").over(by))
    level_budget = F.max(F.when(F.col("is_open") == 1, F.col("budget") - F.col("c_before"))).over(Window.partitionBy(*parent))
    level_weight = F.max(F.when(F.col("is_open") == 1, F.col("w_left"))).over(Window.partitionBy(*parent))
    c = c.withColumn("l_b", level_budget).withColumn("l_w", level_weight)
    # whole tokens: differences of floors of running weights add up to the level's budget
    run = F.sum(F.when(F.col("is_open") == 1, F.col("weight")).otherwise(lit_long(0))).over(by)
    upto = lambda x: F.floor(F.col("l_b").cast("decimal(20,0)") * x.cast("decimal(15,0)") / F.col("l_w").cast("decimal(15,0)")).cast("long")
    c = c.withColumn("run", run)
    given = F.when(F.col("is_open") == 1, F.least(F.col("cap"), upto(F.col("run")) - upto(F.col("run") - F.col("weight")))).otherwise(F.col("cap"))
    return c.withColumn("given", given)


def budgets(leaves: DataFrame, params: MixParams) -> DataFrame:
    """Adds ``target`` tokens to leaves (domain, lang, source, tokens); the tree is three levels."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in LEVELS]
    base = leaves.select(*LEVELS, "tokens", *key, *[F.col(c).isNull().alias(f"n_{c}") for c in LEVELS])
    base = base.withColumn("cap", F.col("tokens") * params.epochs)
    total = base.agg(F.floor(F.sum("tokens") * F.lit(params.share)).cast("long").alias("budget"))
    nodes, parent = None, []
    for depth, level in enumerate(LEVELS):
        path = [c for x in LEVELS[:depth + 1] for c in (f"k_{x}", f"n_{x}")]
        kids = base.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, F.col(f"k_{level}"), params.weights))
        kids = kids.withColumn("ord", F.struct(f"k_{level}", f"n_{level}"))
        if depth == 0:
            kids = kids.withColumn("root", F.lit(0)).join(total.withColumn("root", F.lit(0)), "root")
            parent = ["root"]
        else:
            up = [c for x in LEVELS[:depth] for c in (f"k_{x}", f"n_{x}")]
            kids = kids.join(nodes, up)
            parent = up
        nodes = _share(kids, parent).select(*path, F.col("given").alias("budget"))
    out = base.join(nodes, [c for x in LEVELS for c in (f"k_{x}", f"n_{x}")])
    return out.select(*LEVELS, "tokens", F.col("budget").alias("target"))


def _order(params: MixParams, epoch: Column, doc_id: Column, th: Column) -> Column:
    """Seeded hash by which an epoch shuffles its documents."""
    return F.xxhash64(F.lit(params.seed), epoch, doc_id, th)


def _place(params: MixParams, epoch: Column, doc_id: Column, th: Column) -> Column:
    """A row's place in the order of running_totals."""
    o = _order(params, epoch, doc_id, th)
    return F.struct(piece_of(o).alias("p"), o.alias("o"), doc_id.alias("i"), th.alias("h"))


def copies(docs: DataFrame, params: MixParams, scratch: Scratch) -> DataFrame:
    """(doc_id, th, domain, lang, source, n_tokens, rows, whole, copies, cut_tokens): how often each row is used.

    ``whole`` epochs hold for the leaf, ``copies`` and ``cut_tokens`` for each of the ``rows``
    that agree in doc_id, text, language and source; cut_tokens is what the document in
    which the leaf's target falls gives besides whole copies, 0 for others.
    """
    key = docs.select("doc_id", F.xxhash64("text").alias("th"), "lang", "source", domain_of(F.col("source"), params.domains).alias("domain"), token_count(F.col("text")).alias("n_tokens"))
    rows = key.groupBy("doc_id", "th", "lang", "source", "domain", "n_tokens").agg(F.count(F.lit(1)).alias("rows"))
    rows = scratch.save(rows, "rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"))
    plan = scratch.save(budgets(leaves, params), "budgets")
    n = {c: f"p_{c}" for c in LEVELS}
    p = plan.select(*[F.col(c).alias(n[c]) for c in LEVELS], F.col("tokens").alias("leaf_tokens"), "target")
    cond = F.lit(True)
    for c in LEVELS:
        cond = cond & rows[c].eqNullSafe(p[n[c]])
    placed = rows.join(p, cond).drop(*n.values())
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("target") / F.col("leaf_tokens"))).otherwise(lit_long(0)).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("leaf_tokens"))
    placed = placed.withColumn("weight", F.col("n_tokens") * F.col("rows"))
    # the epoch that is cut short: documents by its seeded hash, up to the tokens left
    order = F.xxhash64(F.lit(params.seed), "whole", "doc_id", "th")
    placed = placed.withColumn("leaf", F.to_json(F.struct(*LEVELS)))
    run = running_totals(placed, ["leaf"], order, "weight", ["doc_id", "th"])
    take = (F.col("before") + F.col("weight") <= F.col("rest")) & (F.col("n_tokens") > 0)
    falls = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("weight") > F.col("rest"))
    part = F.when(falls, F.floor((F.col("rest") - F.col("before")) / F.col("rows"))).otherwise(lit_long(0)).cast("long")
    return run.select("doc_id", "th", *LEVELS, "n_tokens", "rows", "whole", (F.col("whole") + take.cast("long")).alias("copies"), part.alias("cut_tokens"))


def usage(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, domain, lang, source, n_tokens, copies (0: unused), cut_tokens.

    A leaf takes ``copies * n_tokens + cut_tokens`` of each row, its target in total; where
    the target falls into m rows that agree in doc_id, text, language and source, they share
    the rest alike and fewer than m tokens stay open. Null or blank texts have no tokens and
    are used in whole epochs only. Null languages and sources are leaves of their own.
    Equal hashes of an epoch go by doc_id and text hash. An empty table gives an empty
    result; other columns of ``docs`` are not looked at.
    """
    used = copies(docs, params, Scratch(docs.sparkSession, "mix"))
    each = used.withColumn("i", F.explode(F.sequence(lit_long(1), F.col("rows"))))
    return each.select("doc_id", *LEVELS, "n_tokens", "copies", "cut_tokens")


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs`` as often as the mix uses them, with all columns.

    The document in which a leaf's target falls comes once more, with the prefix of its text
    that the leaf still takes. Cases as in ``usage``; rows equal in doc_id, text, language and
    source share one fate.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    used = copies(docs, params, scratch)
    order = _place(params, F.col("whole"), F.col("doc_id"), F.col("th"))
    # a leaf's prefix ends at one place of its order: that place tells which rows are in it
    cut = F.max(F.when(F.col("copies") > F.col("whole"), order)).alias("cut")
    part = F.max(F.when(F.col("cut_tokens") > 0, F.struct(order.alias("place"), "cut_tokens"))).alias("part")
    leaves = used.groupBy(*LEVELS[1:]).agg(F.max("whole").alias("whole"), cut, part)
    leaves = scratch.save(leaves.select(*[F.col(c).alias(f"__hf_{c}") for c in (*LEVELS[1:], "whole", "cut", "part")]), "cuts")
    tagged = docs.withColumn("__hf_h", F.xxhash64("text"))
    joined = tagged.join(leaves, tagged["lang"].eqNullSafe(leaves["__hf_lang"]) & tagged["source"].eqNullSafe(leaves["__hf_source"]))
    mine = _place(params, F.col("__hf_whole"), tagged["doc_id"], F.col("__hf_h"))
    extra = F.coalesce(mine <= F.col("__hf_cut"), F.lit(False)) & (token_count(tagged["text"]) > 0)
    last = F.when(F.coalesce(mine == F.col("__hf_part.place"), F.lit(False)), F.col("__hf_part.cut_tokens")).otherwise(lit_long(0))
    counted = joined.withColumn("__hf_n", F.col("__hf_whole") + extra.cast("long")).withColumn("__hf_last", last)
    counted = counted.where("__hf_n > 0 OR __hf_last > 0")
    again = counted.withColumn("__hf_i", F.explode(F.sequence(lit_long(1), F.col("__hf_n") + (F.col("__hf_last") > 0).cast("long"))))
    again = again.withColumn("text", F.when(F.col("__hf_i") > F.col("__hf_n"), token_prefix(F.col("text"), F.col("__hf_last"))).otherwise(F.col("text")))
    return again.drop("__hf_h", "__hf_i", "__hf_n", "__hf_last", *leaves.columns)
