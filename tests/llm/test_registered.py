"""Registered queries without SQL, as they are registered, against plain Python; very long texts through every text operator."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, slow_fill, stats_of, words_of

from helixframe.llm import audit, jaccard, mixing, packing, quality, queries, sharding, simhash, tokens


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{small}/documents.parquet'").fetchall()


def test_op2_targets_and_rows(spark, small, docs):
    got = queries.op2_hierarchical_mix(spark, small).collect()
    p = mixing.MixParams()
    domain = lambda s: p.domains[int(("".join(c for c in s or "" if c.isdigit())) or 0) % len(p.domains)]
    assert sorted((r.doc_id, r.domain, r.lang, r.source, r.n_tokens) for r in got) == sorted((d, domain(s), g, s, len(words_of(t))) for d, t, g, s in docs)
    weight = {(a, b): w for a, b, w in p.weights}
    leaf = Counter()
    for _, t, g, s in docs:
        leaf[(domain(s), g, s)] += len(words_of(t))

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        names = {k[depth] for k in leaf if k[:depth] == prefix}
        kids = {x: (p.epochs * sum(n for k, n in leaf.items() if k[:depth + 1] == (*prefix, x)), weight.get((mixing.LEVELS[depth], x), 1)) for x in names}
        return {k: v for x, b in slow_fill(budget, kids).items() for k, v in down((*prefix, x), b).items()}

    want = down((), int(sum(leaf.values()) * p.share))
    used, cut = Counter(), Counter()
    for r in got:
        used[(r.domain, r.lang, r.source)] += r.copies * r.n_tokens + r.cut_tokens
        cut[(r.domain, r.lang, r.source)] += r.cut_tokens > 0
        assert 0 <= r.copies <= p.epochs
    # whole tokens at three levels of the tree: each leaf within a few of its real-valued share, and the whole to the token
    assert all(abs(used[k] - v) <= 4 for k, v in want.items()) and max(cut.values()) <= 1
    assert abs(sum(used.values()) - int(sum(leaf.values()) * p.share)) <= 4 * len(want)


def test_op3_sizes_slots_and_the_law(spark, small, docs):
    got = queries.op3_rendezvous_shards(spark, small).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((d, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t, _, _ in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # every score anew, from the same hashes
    ids = spark.createDataFrame([(d,) for d, *_ in docs], "k long")
    for r in ids.select("k", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda s: F.xxhash64("k", s)).alias("h")).collect():
        u = [((x % 2 ** 64 >> 11) + 0.5) * 2.0 ** -53 for x in r.h]
        score = lambda n: max(range(n), key=lambda s: -queries.WEIGHTS[s] / math.log(u[s]))
        mine = next(x for x in got if x.doc_id == r.k)
        assert (mine.shard, mine.grown_shard) == (score(40), score(41))


def test_op4_least_padding_and_batches(spark, small, docs):
    got = queries.op4_length_buckets(spark, small).collect()
    p = packing.PackParams()
    lengths = {d: len(words_of(t)) for d, t, _, _ in docs}
    assert {r.doc_id: r.n_tokens for r in got} == lengths and len(got) == len(docs)
    hist = sorted(Counter(lengths.values()).items())
    tops, counts = [n for n, _ in hist], [c for _, c in hist]
    # the plain recurrence over all places
    best = [[math.inf] * (len(tops) + 1) for _ in range(p.buckets + 1)]
    best[0][0] = 0
    for b in range(1, p.buckets + 1):
        for j in range(1, len(tops) + 1):
            n = 0
            for i in range(j - 1, -1, -1):
                n += counts[i]
                best[b][j] = min(best[b][j], best[b - 1][i] + n * tops[j - 1])
    least = min(row[-1] for row in best) - sum(lengths.values())
    assert sum(r.padding for r in got) == least and all(r.padding == r.boundary - r.n_tokens >= 0 for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[(r.bucket, r.batch)].append(r)
    for rs in batches.values():
        assert sorted(x.slot for x in rs) == list(range(len(rs))) and (len(rs) == 1 or len(rs) * rs[0].boundary <= p.batch_tokens)
    assert len({r.boundary for r in got}) == len({r.bucket for r in got}) <= p.buckets


def test_op6_counts_are_the_library_s(spark, small, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = {d: (len((t or "").encode()), len(sp.encode(t or ""))) for d, t, _, _ in docs}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_bpe_counts(spark, small).collect()}
    assert got == {d: (b, n, n > 4096) for d, (b, n) in want.items()}


def test_very_long_texts(spark):
    """Texts of megabytes among short ones, in each operator on texts."""
    long = " ".join(f"word{i % 4999} Part{i * 7 % 131}" for i in range(90_000)) + "\nend\nend"
    near = long + " and a little more"
    rows = [(1, long, "en", "s1"), (2, near, "en", "s1"), (3, "a few short words only", "de", "s2"), (4, long, "en", "s1"), (5, "x" * 3_000_000, "en", "s1")]
    df = spark.createDataFrame(rows, DOCS)
    stats = {r.doc_id: r for r in quality.assess(df).collect()}
    for d, t, _, _ in rows:
        r = stats[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == stats_of(t)
    assert {r.doc_id: r.n_tokens for r in mixing.usage(df, mixing.MixParams(share=0.5)).collect()} == {d: len(words_of(t)) for d, t, _, _ in rows}
    assert {r.doc_id: r["size"] for r in sharding.shard_documents(df, [1.0, 2.0], [1.0, 2.0, 1.0]).collect()} == {d: len(t) + 16 for d, t, _, _ in rows}
    assert sorted((r.doc_id, r.n_tokens) for r in packing.pack(df).collect()) == [(d, len(words_of(t))) for d, t, _, _ in rows]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(df.select("doc_id", "text"), 75, 100, 5).collect()}
    shingles = lambda t: len({tuple(w[i:i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))})
    assert found == {1: (shingles(long), 1), 2: (shingles(near), 1), 3: (1, 3), 4: (shingles(long), 1), 5: (1, 5)}
    assert {r.doc_id: r.component_id for r in simhash.component_ids(df).collect()}[4] == 1
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    first = audit.audit(df, labels).where("filter_order = 'EABCD' AND step = 1 AND part = 'en'").first()
    assert (first.kept, first.removed) == (3, 1)
    short = df.where("doc_id <> 5")
    assert {r.doc_id: r.n_bytes for r in tokens.count_tokens(short, queries.tokenizer_path()).collect()} == {d: len(t) for d, t, _, _ in rows[:4]}
