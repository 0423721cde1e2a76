"""Quality, near copies, token counts, sharding, packing and mixing against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import jaccard, mixing, packing, quality, sharding, tokens
from helixframe.llm.common import chi2_cdf_even, chi2_quantile_even
from helixframe.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["".join(p) for p in itertools.product("bdgklmnprst", "aeiou", "nrst")]


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(VOCAB) + rng.choice(["", "", "", ",", "."]))
        out.append(rng.choice([" ", " ", " ", " ", "\n", "  ", "\t"]))
    return "".join(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows, base = [], [prose(rng, rng.randint(5, 160)) for _ in range(12)]
    passage = prose(rng, 30)
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            words = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            text = " ".join(words)
        elif kind < 0.5:
            text = rng.choice(base).upper()
        elif kind < 0.6:
            text = passage + " " + prose(rng, rng.randint(1, 60))
        elif kind < 0.7:
            text = rng.choice(["", "  ", None, "one two", "One  TWO", "x" * 3000, "é à\u00a0b c d e f"])
        else:
            text = prose(rng, rng.randint(1, 200))
        rows.append((i * 3 if i % 17 else None, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None])))
    return rows + rows[:5]


def clashing(df):
    for name in ("n", "ck", "t", "kept", "bucket", "shard", "rank", "copies", "cell", "th", "q0", "mu0", "size"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words_of(text):
    return WORD.findall(text or "")


# quality ---------------------------------------------------------------------------------
def stats_of(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if tri[g] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = [r[1] for r in corpus(1)] + ["a b c a b c a b c d", "a a a a", "x\nx\n \n\nx y\nx y", "# a * | <b> ü\u3000y\x0bz\x0cq", " ".join(rng.choice("abc") for _ in range(400)), "w\u0085v\u2028u"]
    df = clashing(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.base_stats(df).collect()}
    assert got == {i: stats_of(t) for i, t in enumerate(texts)}


def slow_mcd(rows, p):
    """The usual algorithm in numpy over one cell: exactly the nearest h rows, many random starts, steps until nothing changes."""
    x = np.array(rows, float) / 1024
    n, d = x.shape
    h, floors, rng = int(np.ceil(p.share * n)), np.diag(np.square(p.floors)), np.random.default_rng(3)

    def dist(mu, c):
        y = x - mu
        return np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y)

    def moments(sel, share):
        f = share / chi2_cdf_even(chi2_quantile_even(share, d), d + 2) if share < 1 else 1.0
        return x[sel].mean(0), f * np.cov(x[sel].T, bias=True) + floors

    best = None
    for turn in range(60):
        sel = rng.choice(n, 3 * (d + 1), replace=False) if turn else np.arange(n)
        for _ in range(200):
            new = np.sort(np.argsort(dist(*moments(sel, 1.0 if len(sel) < h else p.share)), kind="stable")[:h])
            if len(new) == len(sel) and (new == sel).all():
                break
            sel = new
        det = np.linalg.slogdet(moments(sel, p.share)[1])[1]
        if best is None or det < best[0]:
            best = (det, sel)
    inner = dist(*moments(best[1], p.share)) <= chi2_quantile_even(0.975, d)
    return dist(*moments(inner, 0.975))


def test_mcd_against_numpy_and_outliers(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        text = prose(rng, rng.randint(60, 150))
        if i % 13 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", "s1"))
    rows += [(1000 + i, prose(rng, 80), "de", f"tiny{i}") for i in range(6)]
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(6)
    p = quality.McdParams(min_rows=50)
    got = {r.doc_id: r for r in quality.assess(df, p).collect()}
    vec = quality.vectors(quality.base_stats(df)).where("source = 's1' and not base_failed").orderBy("doc_id").select("doc_id", "q0", "q1", "q2", "q3").collect()
    want = slow_mcd([tuple(r)[1:] for r in vec], p)
    cut = chi2_quantile_even(1 - p.tail, 4)
    off = sorted(abs(got[r.doc_id].mahalanobis2 - d) / (1 + d) for r, d in zip(vec, want) if got[r.doc_id].kept)
    assert off[len(off) * 9 // 10] < 0.1
    assert all((d <= cut) == got[r.doc_id].kept for r, d in zip(vec, want))
    for i in range(400):
        assert got[i].kept == (not got[i].base_failed and i % 13 != 0)
    # cells too small even when pooled have no estimate: the base rules decide
    assert all(got[1000 + i].kept and got[1000 + i].mahalanobis2 is None for i in range(6))
    kept = quality.keep_good(df, p)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(k for k, r in got.items() if r.kept)
    assert quality.assess(df.where("false")).count() == 0 and quality.keep_good(df.where("false")).count() == 0


def test_each_statistic_rejects_alone(spark):
    p, rng = quality.McdParams(), random.Random(8)
    cut = chi2_quantile_even(1 - p.tail, 4)
    assert all((np.log(top) / floor) ** 2 > cut for top, floor in zip((5.0, 3.0), p.floors[2:]))
    line = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    usual = ["\n".join(line(12) for _ in range(rng.randint(6, 12))) for _ in range(300)]
    lines = [rng.choice(VOCAB) for _ in range(50)] * 8
    rng.shuffle(lines)
    passage = line(24)
    odd = {"lines": "\n".join(lines), "words": "\n".join([line(12), passage, line(12), line(14), passage, line(13)]), "symbols": "# ".join(usual[0].split(" ")), "lengths": usual[1].replace("a", "aaaaaaaaa").replace("e", "eeeeeeeee").replace("o", "ooooooooo")}
    rows = [(i, t, "en", "s1") for i, t in enumerate([*usual, *odd.values()])]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, DOCS)).collect()}
    for i, name in enumerate(odd):
        assert not got[300 + i].base_failed and not got[300 + i].kept, name
    assert all(got[i].kept for i in range(300))


def test_small_sources_have_their_own_estimates(spark):
    """30 rows of a source suffice: an outlier of one isn't judged by the spread of another."""
    rng = random.Random(14)
    marked = lambda share: " ".join(w + ("#" if rng.random() < share else "") for w in prose(rng, 100).split())
    rows = [(i, marked(0.0), "en", "plain") for i in range(30)] + [(100 + i, marked(rng.random()), "en", "mixed") for i in range(30)]
    rows += [(200, marked(0.6), "en", "plain"), (201, marked(0.6), "en", "mixed")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert not got[200].kept and all(r.kept for k, r in got.items() if k != 200)
    vec = quality.vectors(quality.base_stats(df)).orderBy("doc_id")
    for source in ("plain", "mixed"):
        mine = vec.where(F.col("source") == source).select("doc_id", "q0", "q1", "q2", "q3").collect()
        for r, d in zip(mine, slow_mcd([tuple(r)[1:] for r in mine], quality.McdParams())):
            assert got[r.doc_id].mahalanobis2 == pytest.approx(d, rel=1e-6, abs=1e-9)


# near copies -----------------------------------------------------------------------------
def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def slow_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = [lower(x) for x in words_of(text)]
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), (min(least[find(i)], default=None) if sets[i] else r[0])) for i, r in enumerate(rows)], [find(i) if sets[i] else None for i in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(5)
    want, groups = slow_components(rows)
    key = lambda r: str(tuple(r))
    got = jaccard.component_ids(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    at = defaultdict(set)
    for r, g in zip(rows, groups):
        at[r[:2]].add(g)
    stay = Counter(next(iter(at[k])) for k in left.elements())
    blank = sum(g is None for g in groups)
    assert stay.pop(None, 0) == blank and set(stay) == set(groups) - {None} and set(stay.values()) == {1}
    for (doc, _), n in left.items():
        g = next(iter(at[(doc, _)]))
        if g is not None:
            ids = [r[0] for r, x in zip(rows, groups) if x == g and r[0] is not None]
            assert doc == min(ids, default=None)


def test_jaccard_near_copies_of_a_lost_origin(spark):
    """A large group whose members link to few others: leaders can't find all links."""
    rng = random.Random(9)
    base = [rng.choice(VOCAB) for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(2, 5)):
            w[rng.randrange(150)] = f"new{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(w), "en", "s"))
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.component_ids(df).collect())
    assert got == sorted((a, c) for a, _, c in slow_components(rows)[0])


def test_keep_first_tells_groups_of_one_id_apart(spark):
    """Repeated doc_ids with different texts, and near copies whose doc_ids are all null."""
    rng = random.Random(12)
    a, b, c = ([rng.choice(VOCAB) for _ in range(80)] for _ in range(3))
    near = lambda w, i: " ".join([*w[:-1], f"other{i}"])
    rows = [(5, " ".join(a)), (9, near(a, 1)), (5, " ".join(b)), (None, " ".join(c)), (None, near(c, 1)), (None, near(c, 2)), (None, near(b, 3))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        kept = [(r.doc_id, r.text) for r in jaccard.keep_first(df).collect()]
        assert len(kept) == 3 and rows[0] in kept and rows[2] in kept
        assert [d for d, t in kept if t in {x for _, x in rows[3:6]}] == [None]


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert jaccard.component_ids(df).count() == 0 and jaccard.keep_first(df).count() == 0


# token counts ----------------------------------------------------------------------------
def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rng = random.Random(2)
    alphabet = list("ab \n\r\t;)}{▁ é梦ﬁ\0  the ing<0x41>") + ["<s>", "</s>", "<unk>", "   ", "🙂"]
    texts = [r[1] for r in corpus(4)] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["ab" * 30000, " " * 500, "x" * 5000 + " y"]
    df = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, tokenizer_path(), 300).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 300), t
    assert tokens.count_tokens(df.where("false"), tokenizer_path()).count() == 0


# sharding --------------------------------------------------------------------------------
def test_rendezvous(spark):
    import zlib

    rows = corpus(6, 600) + [(7, f"t{i}", None, None) for i in range(300)]
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(7)
    got = sharding.shard_documents(df, [1.0] * 8, [1.0] * 9).collect()
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(str((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in rows)
    by = defaultdict(list)
    place = defaultdict(set)
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
        place[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in place.values()) and all(sorted(v) == list(range(len(v))) for v in by.values())
    # weights: shares follow them, and weight 0 gets nothing
    keys = spark.range(20000)
    share = {r.s: r.n for r in sharding.assign(keys, "id", [1.0, 3.0, 0.0, 4.0], "s").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert 2 not in share and all(abs(share[s] / 20000 - w / 8) < 0.02 for s, w in ((0, 1), (1, 3), (3, 4)))
    moved = sharding.assign(sharding.assign(keys, "id", [1.0] * 5, "a"), "id", [1.0] * 6, "b").where("a <> b")
    assert moved.where("b <> 5").count() == 0 and abs(moved.count() / 20000 - 1 / 6) < 0.02
    # the score itself, from the same hashes in Python
    import math

    hashed = spark.createDataFrame([(i,) for i in range(50)], "k long").select("k", *[F.xxhash64("k", F.lit(s)).alias(f"h{s}") for s in range(3)], sharding.place(F.col("k"), [1.0, 2.0, 3.0]).alias("p"))
    for r in hashed.collect():
        u = [(((r[f"h{s}"] % 2**64) >> 11) + 0.5) * 2.0**-53 for s in range(3)]
        assert r.p == max(range(3), key=lambda s: -(s + 1) / math.log(u[s]))
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), [])


# packing ---------------------------------------------------------------------------------
def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(150):
        m = rng.randint(1, 9)
        tops, counts, k = sorted(rng.sample(range(0, 60), m)), [rng.randint(1, 9) for _ in range(m)], rng.randint(1, 4)
        got = packing.boundaries(tops, counts, k)
        cost = lambda bs: sum(c * min(b for b in bs if b >= t) for t, c in zip(tops, counts))
        best = min(cost([*s, tops[-1]]) for r in range(min(k, m)) for s in itertools.combinations(tops[:-1], r))
        assert len(got) <= k and cost(got) == best
    assert packing.boundaries([], [], 4) == []


def test_boundaries_of_long_lengths(spark):
    # neighbours far above 4096 that a coarser histogram would take for one
    lengths = [3] * 4 + [100_000] * 50 + [100_001] * 40 + [100_002] * 3 + [900_001] * 2 + [900_007] * 9
    hist = sorted(Counter(lengths).items())
    tops, counts = [t for t, _ in hist], [n for _, n in hist]
    cost = lambda bs: sum(c * min(b for b in bs if b >= t) for t, c in hist)
    for k in (1, 2, 3, 4, 6):
        best = min(cost([*s, tops[-1]]) for s in itertools.combinations(tops[:-1], k - 1))
        assert cost(packing.boundaries(tops, counts, k)) == best
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(lengths)], "doc_id long, text string, n long")
    got = packing.pack(df, packing.PackParams(buckets=4), F.col("n")).collect()
    assert {r.boundary for r in got} == set(packing.boundaries(tops, counts, 4)) and len(got) == len(lengths)


def test_boundaries_of_many_lengths():
    rng = random.Random(8)
    tops = sorted(rng.sample(range(10**6), 300))
    counts = [rng.randint(1, 1000) for _ in tops]
    n = np.concatenate(([0], np.cumsum(counts)))
    best = [tops[j] * int(n[j + 1]) for j in range(300)]
    for _ in range(6):  # plain dynamic programming over all starts
        best = [min(best[j], min((best[i - 1] + tops[j] * int(n[j + 1] - n[i]) for i in range(1, j + 1)), default=best[j])) for j in range(300)]
    bs = packing.boundaries(tops, counts, 7)
    assert len(bs) <= 7 and sum(c * min(b for b in bs if b >= t) for t, c in zip(tops, counts)) == best[-1]


def test_packing(spark):
    rows = corpus(7, 300) + [(9, "w " * 500, "en", "s1")] * 20
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(6)
    p = packing.PackParams(buckets=5, batch_tokens=400)
    got = packing.pack(df, p).collect()
    lengths = [len(words_of(r[1])) for r in rows]
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((r[0], n)) for r, n in zip(rows, lengths))
    hist = Counter(lengths)
    tops = sorted(hist)
    want = packing.boundaries(tops, [hist[t] for t in tops], 5)
    for r in got:
        assert r.boundary == min(b for b in want if b >= r.n_tokens) and r.padding == r.boundary - r.n_tokens and want[r.bucket] == r.boundary
    batches = defaultdict(list)
    for r in got:
        batches[(r.bucket, r.batch)].append(r)
    for rs in batches.values():
        assert sorted(x.slot for x in rs) == list(range(len(rs))) and (len(rs) == 1 or len(rs) * rs[0].boundary <= 400)
    for b in set(r.bucket for r in got):
        n = sum(r.bucket == b for r in got)
        per = max(1, 400 // max(1, want[b]))
        assert len({k for k in batches if k[0] == b}) == -(-n // per)
    assert packing.pack(df.where("false"), p).count() == 0


# mixing ----------------------------------------------------------------------------------
def slow_fill(budget, kids):
    """kids: name -> (cap, weight); real-valued water filling."""
    left, out = dict(kids), {}
    while left:
        total = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if c <= budget * w / total + 1e-9]
        if not full:
            return {**out, **{k: budget * w / total for k, (_, w) in left.items()}}
        for k in full:
            out[k] = left.pop(k)[0]
            budget -= out[k]
    return out


@pytest.mark.parametrize("share, epochs", [(0.3, 1), (0.9, 2), (1.7, 2), (0.0, 1)])
def test_budgets_and_prefixes(spark, share, epochs):
    p = mixing.MixParams(share=share, epochs=epochs, domains=("web", "books"), weights=(("domain", "web", 3), ("lang", "en", 5)))
    rng = random.Random(11)
    rows = [(i if i % 50 else None, prose(rng, rng.randint(0, 40)) or None, rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "s4", None])) for i in range(400)]
    rows += rows[:4]
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(6)
    used = mixing.usage(df, p).collect()
    domain = lambda s: p.domains[int((s or "0").lstrip("s")) % 2]
    n = lambda r: len(words_of(r[1]))
    leaf = defaultdict(int)
    for r in rows:
        leaf[(domain(r[3]), r[2], r[3])] += n(r)
    weight = {("domain", "web"): 3, ("lang", "en"): 5}
    budget = int(sum(leaf.values()) * share)

    def down(prefix, b):
        depth = len(prefix)
        if depth == 3:
            return {prefix: b}
        names = sorted({k[depth] for k in leaf if k[:depth] == prefix}, key=str)
        kids = {x: (epochs * sum(v for k, v in leaf.items() if k[:depth + 1] == (*prefix, x)), weight.get((mixing.LEVELS[depth], x), 1)) for x in names}
        out = {}
        for x, got in slow_fill(b, kids).items():
            out |= down((*prefix, x), got)
        return out

    want = down((), budget)
    taken = defaultdict(int)
    for r in used:
        taken[(r.domain, r.lang, r.source)] += r.copies * r.n_tokens + r.cut_tokens
        assert 0 <= r.copies <= epochs and 0 <= r.cut_tokens < max(1, r.n_tokens)
    for k, target in want.items():
        assert target - 4 <= taken[k] <= target + 3  # rounding, and one token where rows repeat
    assert sorted(str((r.doc_id, r.n_tokens)) for r in used) == sorted(str((r[0], n(r))) for r in rows)
    # the prefix: within the cut epoch documents go by their seeded hash
    for k in want:
        mine = [r for r in used if (r.domain, r.lang, r.source) == k and r.n_tokens]
        assert len({r.copies for r in mine}) <= 2
    out = mixing.mix(df, p)
    cuts = [r for r in used if r.cut_tokens]
    assert out.columns == df.columns and out.count() == sum(r.copies for r in used) + len(cuts)
    left = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
    for d, text, *_ in {r[:2] for r in rows if r[1]}:
        for c in (c.cut_tokens for c in cuts if c.doc_id == d and c.n_tokens == len(words_of(text))):
            assert any(i == d and text.startswith(t) and len(words_of(t)) == c and not t[-1:].isspace() for i, t in left if t)


def test_mix_order_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 20), "en", "s1") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    p = mixing.MixParams(share=0.4, epochs=1)
    order = df.select("doc_id", F.xxhash64(F.lit(p.seed), F.lit(0).cast("long"), "doc_id", F.xxhash64("text")).alias("h")).collect()
    pieces = sorted((((r.h >> 40) % 4096), r.h, r.doc_id) for r in order)
    used = {r.doc_id: r.copies for r in mixing.usage(df, p).collect()}
    flags = [used[d] for _, _, d in pieces]
    assert flags == sorted(flags, reverse=True) and 0 < sum(flags) < 60
    assert mixing.mix(df.where("false"), p).count() == 0 and mixing.usage(df.where("false"), p).count() == 0
