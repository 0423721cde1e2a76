"""SimHash links, the filter audit and vector codes against brute force and DuckDB."""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import floor

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import audit, queries, simhash, vcodes
from helixframe.llm.common import Scratch

DOCS = "doc_id long, text string, lang string"


# SimHash --------------------------------------------------------------------------------------
def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(rows):
    """doc_id, hex and least reachable doc_id of (doc_id, fingerprint), all pairs compared."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    key = lambda r: tuple(str(x) for x in r)
    return sorted(((d, "%016x" % f, least.get(find(i))) for i, (d, f) in enumerate(rows)), key=key)


def got_components(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))


def test_fingerprints_as_registered(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    got = got_components(queries.op11_simhash_pivots(spark, small))
    assert got == want
    assert len({r[2] for r in want}) < len(want)  # some documents link


def test_odd_texts(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(400_000))
    texts = [None, "", " \t\n", "one", "One two", "one TWO", "a b c", "a b c d", "Ä ä Ä", " ", long, long + " end", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (None, "q r s"), (3, "one"), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit("x"), "key": F.lit(None).cast("int")})
    assert got_components(simhash.component_ids(docs)) == plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert simhash.component_ids(docs.limit(0)).collect() == []


def test_pieces_of_a_long_text_are_one_text(monkeypatch):
    text = ("Alpha beta\tgamma\n" * 50 + "delta " * 7 + "x" * 300 + " epsilon").encode()
    whole = simhash.fingerprint(text)
    for size in (1, 5, 17, 200):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_every_coordinate_test_is_a_bound(spark):
    """Coordinates of packed tables: close exactly where no two differ by more than two."""
    rng = np.random.RandomState(5)
    a = rng.randint(0, 65, (400, 7))
    b = np.clip(a + rng.randint(-3, 4, a.shape) * (rng.rand(*a.shape) < 0.3), 0, 64)
    pack = lambda x: [sum(int(v) << 8 * i for i, v in enumerate(row)) for row in x]
    rows = list(zip(pack(a), pack(b), (np.abs(a - b).max(1) <= 2).tolist()))
    df = spark.createDataFrame(rows, "a long, b long, want boolean")
    assert df.where(simhash.within(F.col("a"), F.col("b")) != F.col("want")).isEmpty()
    assert 0 < sum(r[2] for r in rows) < len(rows)
    # the ends of all coordinates at once
    ends = spark.createDataFrame([(0, -1), (-1, 0), (0, 3), (-1, -4)], "x long, y long")
    table = lambda c: simhash.distances(F.col(c), [0, -1] * 6)
    close = ends.select(*[simhash.within(a, b) for a, b in zip(table("x"), table("y"))]).collect()
    assert [all(r) for r in close] == [False, False, True, True]


@pytest.mark.parametrize("bucket", [2, 16, 4096])
def test_links_of_dense_groups(spark, bucket):
    """Groups that crowd a few buckets: nothing is lost however often buckets are split."""
    rng = np.random.RandomState(bucket)
    values = set()
    for base in rng.randint(-1 << 62, 1 << 62, 3).tolist():
        for _ in range(300):
            x = base
            for i in rng.choice(64, rng.randint(0, 6)).tolist() if base % 2 else rng.choice(12, rng.randint(0, 6)).tolist():
                x ^= 1 << i
            x %= 1 << 64
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values | {0, 3, -1})
    v = np.array(values, np.int64)
    want = {(values[i], values[j]) for i in range(len(v)) for j in (np.flatnonzero(np.bitwise_count((v[i + 1:] ^ v[i]).view(np.uint64)) <= 2) + i + 1).tolist()}
    got = simhash.links(spark.createDataFrame([(x,) for x in values], "fp long"), Scratch(spark, "test"), bucket).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 300


# audit ------------------------------------------------------------------------------------------
def plain_audit(docs, labels):
    """Every filter order walked for every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        fails, flags = [], []
        for d, text, lang in docs:
            if (lang or "") != part:
                continue
            t = text or ""
            w = t.encode().split()
            dup = d is not None and any(x is not None and x < d and (s or "") == t for x, s, _ in docs)
            tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), dup)
            fails.append({f for f, x in zip("ABCDE", tests) if x})
            flags.append((d in good, d in toxic))
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(range(len(fails)))
            for s, f in enumerate(order):
                gone = [i for i in left if f in fails[i]]
                redundant = sum(f in x for x in fails) - len(gone)
                left = [i for i in left if f not in fails[i]]
                total[f] += len(gone)
                rows.append(("".join(order), s + 1, f, len(left), len(gone), redundant, sum(x == {f} for x in fails), sum(flags[i][0] for i in gone), sum(flags[i][1] for i in gone)))
        for o, s, f, *rest in rows:
            out[part, o, s] = (*rest, total[f])
    return out


def got_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_by_walking_all_orders(spark):
    plain = " ".join(f"word{i}" for i in range(130))
    same = "again and again " * 60
    shout = " ".join(f"WORD{i}" for i in range(120))
    docs = [
        (1, plain, "en"), (2, plain, "en"), (3, plain + " #", "en"), (4, same, "en"), (5, same, "de"), (6, shout, "en"), (7, None, "en"), (8, "", None), (9, "short", None),
        (10, "SHORT $", ""), (None, plain, "en"), (None, "alone", "fr"), (2, plain, "en"), (2, plain, "en"), (1, plain, "de"), (11, "ÄÖ B|", "x" * 500), (12, " \t", "fr"),
        (13, "w " * 200_000, "fr"), (14, plain + " #", None),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (6, 1, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0), (10, 0, 1)]
    d = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit("x"), "n": F.lit(7), "mask": F.lit(1), "quality": F.lit(1)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("zz"))
    got = audit.audit(d, lab)
    assert got_audit(got) == plain_audit(docs, labels)
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    assert audit.audit(d.limit(0), lab).collect() == []
    assert got_audit(audit.audit(d, lab.limit(0))) == plain_audit(docs, [])


def test_audit_against_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = {tuple(r[:3]): tuple(r[3:]) for r in con.execute(queries.ORACLE["op12_filter_audit"]).fetchall()}
    assert got_audit(queries.op12_filter_audit(spark, small)) == want


def test_ranks_are_places_among_all_orders():
    orders = ["".join(o) for o in permutations("ABCDE")]
    assert [audit.lehmer_rank(o) for o in orders] == list(range(120))
    for step in (1, 2, 3):
        for begin in {o[:step] for o in orders}:
            mine = [i for i, o in enumerate(orders) if o.startswith(begin)]
            assert mine == list(range(audit.lehmer_rank(begin), audit.lehmer_rank(begin) + len(mine)))


# codes ------------------------------------------------------------------------------------------
def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """All distances in Python's integers; rows of (vec_id, vector, label)."""
    rows = [(i, [floor(float(x) * scale) for x in v], lab) for i, v, lab in rows]
    w = len(rows[0][1]) // parts
    start = []
    for i, v, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        if (i, v) not in start:
            start.append((i, v))
    books = [[v[p * w:(p + 1) * w] for _, v in start[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            xs = [v[p * w:(p + 1) * w] for _, v, _ in rows]
            own = [near(x, books[p])[1] for x in xs]
            books[p] = [[sum(col) // own.count(e) for col in zip(*(x for x, o in zip(xs, own) if o == e))] if e in own else c for e, c in enumerate(books[p])]
    best = [[near(v[p * w:(p + 1) * w], books[p]) for p in range(parts)] for _, v, _ in rows]
    errors = [sum(d for d, _ in b) for b in best]
    by = {}
    for (_, _, lab), e in zip(rows, errors):
        by[lab] = by.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join("%02x" % e for _, e in b), d, by[r[2]], digest) for r, b, d in zip(rows, best, errors)), key=str)


def got_codes(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"v": F.lit(1), "state": F.lit("s"), "l": F.lit(2), "code": F.lit("c")})


def test_codes_as_registered(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert got_codes(queries.op13_vector_codes(spark, small)) == plain_codes(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    sql = con.execute(queries.ORACLE["op13_vector_codes"])
    names = [c[0] for c in sql.description]
    at = [names.index(c) for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")]
    assert sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=str) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.normal(size=16).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    rows += [rows[0], rows[0], (7, rng.normal(size=16).tolist(), 1), (None, rng.normal(size=16).tolist(), 1), (70, [0.0] * 16, 2)]
    out = [(80, None, 1), (81, [float("nan")] + [0.0] * 15, 1), (82, [float("inf")] * 16, 1), (83, [None] + [0.0] * 15, 1)]
    want = plain_codes(rows)
    assert got_codes(vcodes.compress(vectors(spark, rows + out))) == want
    # another length isn't coded, and its error counts nowhere
    got = got_codes(vcodes.compress(vectors(spark, rows + [(90, [1.0] * 8, 77)])))
    assert [r for r in got if r[0] != 90] == want
    assert [r[:4] for r in got if r[0] == 90] == [(90, None, None, None)]
    assert vcodes.compress(vectors(spark, rows).limit(0)).collect() == []
    assert [r[1:4] for r in got_codes(vcodes.compress(vectors(spark, [(1, [1.0] * 7, 1)])))] == [(None, None, None)]
    few = rows[:3]
    assert got_codes(vcodes.compress(vectors(spark, few))) == plain_codes(few)


def test_large_components_are_exact(spark):
    """Components beyond 2^53 next to small ones, ties included."""
    big = 2.0 ** 40
    rows = [(i, [big + i, -big, 0.5, 1e-9, -1e-9, 3.0, float(i), 2.0], 0) for i in range(12)] + [(20 + i, [float(i)] * 8, 1) for i in range(12)]
    p = vcodes.CodeParams(parts=2, entries=4, rounds=3, scale=1)
    assert got_codes(vcodes.compress(vectors(spark, rows), p=p)) == plain_codes(rows, 2, 4, 3, 1)
    with pytest.raises(Exception, match="beyond 64 bits"):
        vcodes.compress(vectors(spark, [(0, [0.0] * 8, 0), (1, [1e30] * 8, 0), (2, [-1e30] * 8, 0)]), p=vcodes.CodeParams(entries=1, rounds=0)).collect()


def test_labels_dealt_with_salts(spark, monkeypatch):
    rng = np.random.RandomState(9)
    rows = [(i, rng.normal(size=8).tolist(), i % 4 or None) for i in range(40)]
    want = plain_codes(rows)
    monkeypatch.setattr(vcodes, "BROADCAST_LABELS", 1)
    assert got_codes(vcodes.compress(vectors(spark, rows))) == want


def test_bounds_spare_distances_and_change_nothing():
    """Entries that move to and fro: the bounds decide most parts, codes are those of a full search."""
    rng = np.random.RandomState(1)
    centres = rng.randint(-4000, 4000, (16, 8))
    x = centres[rng.randint(0, 16, 3000)] + rng.randint(-150, 150, (3000, 8))
    history, measured, full = [centres + rng.randint(-300, 300, centres.shape)], 0, 0
    code = bound = stamp = None
    for _ in range(8):
        a = vcodes.Assigner(history)
        if code is None:
            code, bound, stamp = a.first(x)
        else:
            code = a.again(x, code.copy(), bound, stamp)
            measured += a.measured
            full += x.shape[0] * 16
        d = ((x[:, None] - history[-1][None]) ** 2).sum(-1)
        assert (code == d.argmin(1)).all()
        history.append(centres + rng.randint(-40, 40, centres.shape))
    assert measured < full / 4
