"""Registered queries against SQL, and the pipeline's stages."""

import duckdb
import pytest


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op7_topk_search", "op9_chat_format", "op10_warc_round_trip"])
def test_queries_against_sql(spark, small, duck, name):
    from helixframe.llm.queries import ORACLE, QUERIES

    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op1_mcd_quality", "op2_hierarchical_mix", "op3_rendezvous_shards", "op4_length_buckets", "op6_bpe_counts", "op8_url_filter"])
def test_queries_cover_all_rows(spark, small, name):
    from helixframe.llm.queries import QUERIES

    table = "pages" if name.startswith("op8") else "documents"
    assert QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{table}.parquet").count()


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p
    from helixframe.llm import jaccard, mixing, packing, quality
    from helixframe.llm.common import Scratch

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_copies", "mix_sources", "pack_lengths"]
    scratch = Scratch(spark, "pipeline-test")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    good = scratch.save(p.STAGES[0][1](spark, docs, small), "a")
    assert good.columns == columns and ids(good) == ids(quality.assess(docs).where("kept"))
    first = scratch.save(p.STAGES[1][1](spark, good, small), "b")
    assert first.columns == columns
    assert ids(first) == sorted({r.component_id for r in jaccard.component_ids(good).collect()})
    mixed = scratch.save(p.STAGES[2][1](spark, first, small), "c")
    assert mixed.columns == columns
    used = {r.doc_id: r.copies + (r.cut_tokens > 0) for r in mixing.usage(first).collect()}
    assert ids(mixed) == sorted(d for d, n in used.items() for _ in range(n))
    packed = p.STAGES[3][1](spark, mixed, small)
    assert ids(packed) == ids(mixed)
    assert sorted(map(tuple, p.run(spark, small).collect())) == sorted(map(tuple, packed.collect()))
    assert sorted(map(tuple, packing.pack(mixed).collect())) == sorted(map(tuple, packed.collect()))


def test_registered_queries_against_plain_python(spark, small, duck):
    from test_record_operators import slow_rule, slow_score, slow_split
    from test_text_operators import stats_of

    from helixframe.llm import urls
    from helixframe.llm.queries import QUERIES

    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op1_mcd_quality"](spark, small).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {d: stats_of(t) for d, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)
    known = urls.labelled_urls()
    model = urls.train([u for u, _ in known], [y for _, y in known])
    cut = urls.best_cut(urls.held_out_scores(known), [y for _, y in known])
    pages = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    for r in QUERIES["op8_url_filter"](spark, small).collect():
        host, path = slow_split(pages[r.page_id])
        rule = slow_rule(host, path)
        scored = "block" if host + path and slow_score(host + path, model) > cut else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.text, rule.verdict if rule else scored)


def test_pipeline_on_odd_tables(spark, small, tmp_path):
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    full = spark.read.parquet(f"{small}/documents.parquet")
    full.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    empty = p.run(spark, f"{tmp_path}/empty")
    assert empty.count() == 0
    some = full.withColumn("text", F.when(F.col("doc_id") % 7 != 1, F.col("text"))).withColumn("lang", F.when(F.col("doc_id") % 5 != 2, F.col("lang")))
    some = some.withColumn("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")))
    for name in ("th", "ck", "root", "kept", "n_words", "q0", "cell", "domain", "copies", "n_tokens", "bucket", "slot"):
        some = some.withColumn(name, F.lit(1))
    some.unionAll(some.where("doc_id % 3 = 0")).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = p.run(spark, f"{tmp_path}/odd")
    rows = got.collect()
    assert got.columns == empty.columns and rows
    # repeated rows leave one, which the mix uses twice and its prefix once at most; null texts fail
    uses = {}
    for r in rows:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(n for d, n in uses.items() if d is not None) <= 2
    assert not any(d is not None and d % 7 == 1 for d in uses)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)


def test_near_copies_stage_against_brute_force(spark, small):
    import corpus_pipeline as p
    from test_text_operators import corpus, slow_components

    rows = corpus(5, 60)
    rows = [(7 if i % 9 == 0 else r[0], *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = p.STAGES[1][1](spark, df, small).collect()
    _, groups = slow_components(rows)
    at = {r[:2]: g for r, g in zip(rows, groups)}
    stay = [(at[(r.doc_id, r.text)], r.doc_id) for r in kept if at[(r.doc_id, r.text)] is not None]
    least = {g: min((r[0] for r, x in zip(rows, groups) if x == g and r[0] is not None), default=None) for g in set(groups) - {None}}
    assert sorted(stay, key=str) == sorted(least.items(), key=str)
