"""Registered queries over the read table derived from whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import metrics
from ..functions import codec, sql
from ..operators import correct, delta, neighbors, prep, search, spectrum, tallies, tiles
from ..params import Params
from .reads import LETTERS, READ_LENGTH, ROOM, STANDS_FOR, cut, derived_reads, uncut

PARAMS = Params(k=10, step=4)
#: Short words: nearly all occur, so the complement and saturation come into play.
DENSE = Params(k=6, step=2)
#: Words of medium length, for restart counts: some hundred steps of one byte.
MIDDLE = Params(k=8, step=2)
#: Two rounds of neighbours, rarer words left out.
TWO = Params(k=10, step=4, max_distance=2, min_count=2)
#: Items of a node in the delta-code estimate, and blocks of the block assignment.
NODE, BLOCKS = 16, 7


def _spectra(spark, sf_dir, p=PARAMS):
    reads = derived_reads(spark, sf_dir)
    return reads, spectrum.kmer_spectrum(reads, p), spectrum.tile_spectrum(reads, p)


def reads_derived(spark, sf_dir):
    return derived_reads(spark, sf_dir)


def reads_valid_only(spark, sf_dir):
    return prep.clean_only(derived_reads(spark, sf_dir)).select("read_id", "bases")


def reads_renumbered(spark, sf_dir):
    return prep.renumber(prep.clean_only(derived_reads(spark, sf_dir))).select("read_id", "bases")


def ambig_replaced(spark, sf_dir):
    return prep.ambiguous_replaced(derived_reads(spark, sf_dir), 3, 1, "A").select("read_id", "bases")


def _digest(ids):
    return ids.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"),
        F.sum("id").cast("long").alias("id_sum"), F.max("id").alias("id_max"),
    )


def kmer_windows(spark, sf_dir):
    return _digest(tallies.window_table(derived_reads(spark, sf_dir), PARAMS.k))


def tile_windows_q(spark, sf_dir):
    return _digest(tallies.window_table(derived_reads(spark, sf_dir), PARAMS.tile, PARAMS))


def kmer_spectrum(spark, sf_dir):
    return _spectra(spark, sf_dir)[1]


def tile_spectrum(spark, sf_dir):
    return spectrum.tile_spectrum(derived_reads(spark, sf_dir), Params(k=10, step=4, min_count=2))


def tile_spectrum_noq(spark, sf_dir):
    return spectrum.tile_spectrum(derived_reads(spark, sf_dir), PARAMS, quality=False)


def pack_unpack(spark, sf_dir):
    t = PARAMS.tile
    out = tile_spectrum(spark, sf_dir).select("tile_id").select("tile_id", codec.unpack(F.col("tile_id"), t).alias("bases"), codec.revcomp_id(F.col("tile_id"), t).alias("rc_id"))
    return out.select("tile_id", "bases", "rc_id", codec.revcomp(F.col("bases")).alias("rc_bases"), codec.pack(F.col("bases"), t).alias("again"))


def spectrum_ranked(spark, sf_dir):
    return spectrum.ranked(spectrum.kmer_spectrum(derived_reads(spark, sf_dir), DENSE), "kmer_id", length=DENSE.k)


def absent_kmers(spark, sf_dir):
    return spectrum.absent(spectrum.kmer_spectrum(derived_reads(spark, sf_dir), Params(k=6, step=2, min_count=200)), DENSE.k)


def spectrum_summary(spark, sf_dir):
    return spectrum.summary(derived_reads(spark, sf_dir), DENSE)


def tile_histogram_both(spark, sf_dir):
    return spectrum.histograms(derived_reads(spark, sf_dir), PARAMS)


def unit_neighbors(spark, sf_dir):
    kmers = spectrum.kmer_spectrum(derived_reads(spark, sf_dir), DENSE).select("kmer_id")
    return neighbors.unit_neighbors(kmers, "kmer_id", DENSE.k, 2)


def valid_neighbors(spark, sf_dir):
    kmers = spectrum.kmer_spectrum(derived_reads(spark, sf_dir), Params(k=6, step=2, min_count=100)).select("kmer_id")
    return neighbors.valid_neighbors(kmers, "kmer_id", kmers, DENSE.k)


def hamming1_pairs(spark, sf_dir):
    kmers = spectrum.kmer_spectrum(derived_reads(spark, sf_dir), Params(k=10, step=4, min_count=3))
    return neighbors.hamming1_pairs(kmers, "kmer_id", PARAMS.k)


def hamming2_pairs(spark, sf_dir):
    """Tiles that occur four times or more and differ in one or two bases."""
    often = spectrum.tile_spectrum(derived_reads(spark, sf_dir), Params(k=10, step=4, min_count=4))
    return neighbors.near_pairs(often, "tile_id", PARAMS.tile, 2)


def tile_lookup(spark, sf_dir):
    """First tile of each read: both k-mers known, and the tile's count, 0 if it has none."""
    reads, kmers, tile = _spectra(spark, sf_dir)
    known = neighbors.present(neighbors.present(search.first_tiles(reads, PARAMS), "h0", kmers), "t0", kmers)
    keyed = known.select("read_id", tiles.tile_key(F.col("h0"), F.col("t0"), PARAMS.step).alias("tile_id"))
    return tiles.with_counts(keyed, tile, F.lit(True)).withColumn("good_cnt", F.col("good_cnt").cast("long"))


def _near_tiles(first, kmers, tile, p):
    return search.candidates(first.select("h0", "t0").distinct(), kmers, tile, p, (p.max_distance, p.max_distance), correct.Corrector(kmers, tile, p))


def strand_merged_tiles(spark, sf_dir):
    """Tiles within one base of each first tile, counts of both strands added."""
    reads, kmers, tile = _spectra(spark, sf_dir)
    pairs = search.first_tiles(reads, PARAMS).select("h0", "t0").distinct()
    return search.merged_tiles(pairs, kmers, tile, PARAMS, correct.Corrector(kmers, tile, PARAMS))


def first_tile_decision(spark, sf_dir):
    """Verdict on each read's first tile from all tiles within one base; chosen is -1 if rejected."""
    reads, kmers, tile = _spectra(spark, sf_dir)
    first = search.first_tiles(reads, PARAMS)
    known = search.stages(_near_tiles(first, kmers, tile, PARAMS), PARAMS, [2 * PARAMS.max_distance])
    return search.judged(first, known, PARAMS).select("read_id", "verdict", "chosen").na.fill(-1, ["chosen"])


def _first_tile_search(spark, sf_dir, p):
    reads, kmers, tile = _spectra(spark, sf_dir, p)
    return search.search(search.first_tiles(reads, p), kmers, tile, p, correct.Corrector(kmers, tile, p))


def first_tile_search(spark, sf_dir):
    """The staged search on each read's first tile: the first stage that decides, and the tile it chooses.

    Stage 3: no stage decided, and of the last one's tiles none is more frequent than the
    tile as read. Stage -1, chosen -1: the tile stays unsettled.
    """
    return _first_tile_search(spark, sf_dir, PARAMS)


def first_tile_search_two(spark, sf_dir):
    """The same with two rounds of neighbours and five stages; 5: none decided, and the tile stands."""
    return _first_tile_search(spark, sf_dir, TWO)


def sql_frequent_kmers(spark, sf_dir):
    """k-mers that occur three times or more, with their bases and reverse complements; written in SQL over what tasks have counted."""
    sql.register(spark)
    return spark.sql(
        """
        SELECT kmer_id, dna_unpack(kmer_id, 10) AS bases, dna_revcomp_id(kmer_id, 10) AS rc_id, dna_mismatches(kmer_id, dna_revcomp_id(kmer_id, 10)) AS rc_distance, cnt
        FROM (
          SELECT c.id AS kmer_id, CAST(least(sum(c.n), 255) AS INT) AS cnt
          FROM {counted} AS c
          GROUP BY c.id)
        WHERE cnt >= 3
        """,
        counted=tallies.window_counts(derived_reads(spark, sf_dir), 10),
    )


def first_tile_errors(spark, sf_dir):
    """Corrections in first tiles by replacement and base: how many, in how many reads."""
    found = first_tile_search(spark, sf_dir).where("stage >= 0 AND chosen <> own")
    each = found.select("read_id", F.explode(codec.differences(F.col("chosen"), F.col("own"), PARAMS.tile)).alias("e"))
    return each.groupBy("e.from", "e.to").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("read_id").alias("n_reads"))


def tile_diffs(spark, sf_dir):
    """Differences of neighbouring tiles in the order of identifiers."""
    near = spectrum.preceding(tile_spectrum(spark, sf_dir).select("tile_id"), "tile_id", PARAMS.tile)
    each = near.where("before IS NOT NULL").select("tile_id", "before", codec.differences(F.col("tile_id"), F.col("before"), PARAMS.tile).alias("e"))
    code = F.aggregate("e", F.lit(0).cast("long"), lambda acc, x: acc + x["from"] * 4 + x["to"])
    return each.select("tile_id", "before", F.size("e").cast("long").alias("n_diff"), F.array_min("e.pos").cast("long").alias("first_pos"), code.alias("codes"))


def quality_profile(spark, sf_dir):
    """Per read: bases below the threshold, and whether all pass the low bound."""
    low = codec.low_quality_count(F.col("quals"), PARAMS.quality_threshold)
    return derived_reads(spark, sf_dir).select("read_id", low.cast("long").alias("n_low"), (codec.low_quality_count(F.col("quals"), 40) == 0).alias("all_good"))


def block_assignment(spark, sf_dir):
    """Reads in id order cut into BLOCKS contiguous blocks: sizes and bounds."""
    reads = prep.renumber(derived_reads(spark, sf_dir)).select("read_id")
    n = reads.agg(F.count(F.lit(1)).alias("n"))
    owner = codec.block_owner(F.col("read_id"), BLOCKS, F.col("n")).cast("long")
    return reads.join(F.broadcast(n)).groupBy(owner.alias("block")).agg(F.count(F.lit(1)).alias("rows"), F.min("read_id").alias("low"), F.max("read_id").alias("high"))


def delta_bytes_per_node(spark, sf_dir):
    return delta.node_bytes(kmer_spectrum(spark, sf_dir), "kmer_id", NODE, PARAMS.k)


def delta_restarts(spark, sf_dir):
    kmers = spectrum.kmer_spectrum(derived_reads(spark, sf_dir), MIDDLE).persist()
    try:
        return delta.restart_table(kmers, "kmer_id", range(1, 8))
    finally:
        kmers.unpersist()


def lookup_counters(spark, sf_dir):
    """Lookups and misses of all windows in spectra with a threshold."""
    return metrics.own_lookup_counters(derived_reads(spark, sf_dir), Params(k=10, step=4, min_count=3))


def read_correction(spark, sf_dir):
    """Corrections, one row an error, in the order in which each read's were found."""
    texts = uncut(spark, sf_dir)
    found = correct.Corrector.of_reads(texts, PARAMS, cut=cut).correct(texts, cut).where(F.size("errs") > 0)
    return found.select("read_id", F.posexplode("errs").alias("ord", "e")).select("read_id", "ord", "e.pos", "e.from", "e.to", "e.qual")


def corrected_reads(spark, sf_dir):
    texts = uncut(spark, sf_dir)
    return correct.Corrector.of_reads(texts, PARAMS, cut=cut).corrected(texts, cut).select("read_id", "bases")


def error_summary(spark, sf_dir):
    return read_correction(spark, sf_dir).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("read_id").alias("n_reads"))


QUERIES = {f.__name__: f for f in (
    tile_spectrum, kmer_spectrum, tile_spectrum_noq, reads_derived, reads_valid_only, reads_renumbered, ambig_replaced, kmer_windows, tile_windows_q,
    pack_unpack, spectrum_ranked, absent_kmers, spectrum_summary, tile_histogram_both, unit_neighbors, valid_neighbors, hamming1_pairs, hamming2_pairs, tile_lookup,
    strand_merged_tiles, first_tile_decision, first_tile_search, first_tile_search_two, first_tile_errors, sql_frequent_kmers, tile_diffs, quality_profile, block_assignment, delta_bytes_per_node, delta_restarts, lookup_counters, read_correction, corrected_reads, error_summary,
)}

# SQL -------------------------------------------------------------------------------------
_READS = f"""
letters AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents),
pieces AS (
  SELECT doc_id * {ROOM} + part AS read_id, substr(s, CAST(part * {READ_LENGTH} + 1 AS INT), {READ_LENGTH}) AS piece
  FROM (SELECT doc_id, s, unnest(range(0, (length(s) + {READ_LENGTH - 1}) // {READ_LENGTH})) AS part FROM letters)
),
based AS (SELECT read_id, regexp_replace(translate(piece, '{LETTERS}', '{STANDS_FOR}'), '[^ACGT]', 'N', 'g') AS bases FROM pieces),
reads AS (
  SELECT read_id, bases,
         array_to_string(list_transform(range(1, length(bases) + 1), lambda i: chr(CAST(33 + (i * 13 + read_id * 7) % 41 AS INT))), '') AS quals
  FROM based
)"""


def _pack_sql(w: str, n: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, {n}), lambda i: CAST(instr('ACGT', substr({w}, CAST(i + 1 AS INT), 1)) - 1 AS BIGINT) << CAST(2 * ({n - 1} - i) AS INT))) AS BIGINT)"


def _windows_sql(name: str, n: int, quality: bool) -> str:
    low = f"list_sum(list_transform(range(pos + 1, pos + {n + 1}), lambda i: CASE WHEN ascii(substr(quals, CAST(i AS INT), 1)) < {PARAMS.quality_threshold} THEN 1 ELSE 0 END)) <= {PARAMS.max_bad}"
    return f"""
{name}_all AS (SELECT read_id, bases AS r, quals, unnest(range(0, length(bases) - {n - 1})) AS pos FROM reads),
{name}_ok AS (SELECT *, substr(r, CAST(pos + 1 AS INT), {n}) AS w FROM {name}_all WHERE NOT regexp_matches(substr(r, CAST(pos + 1 AS INT), {n}), '[^ACGT]')),
{name}_ruled AS (SELECT * FROM {name}_ok QUALIFY bool_or(pos < length(r) - {n}) OVER (PARTITION BY read_id)),
{name} AS (SELECT read_id, pos, w FROM {name}_ruled {"WHERE " + low if quality else ""})"""


def _spectrum_sql(name: str, n: int, quality: bool, least: int, column: str) -> str:
    return f"""{_windows_sql(name + "_w", n, quality)},
{name} AS MATERIALIZED (SELECT {_pack_sql("w", n)} AS {column}, CAST(least(c, 255) AS INT) AS cnt FROM (SELECT w, count(*) AS c FROM {name}_w GROUP BY w) WHERE least(c, 255) >= {least})"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join((_READS, *parts))


_K, _T, _S = PARAMS.k, PARAMS.tile, PARAMS.step
_KMERS = _spectrum_sql("km", _K, False, 1, "kmer_id")
_TILES = _spectrum_sql("ti", _T, True, 1, "tile_id")
_TILES2 = _spectrum_sql("ti", _T, True, 2, "tile_id")
_DENSE = lambda least: _spectrum_sql("km", 6, False, least, "kmer_id")
_DIGEST = lambda n: f"SELECT read_id, count(*) AS n_windows, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(id) AS BIGINT) AS id_sum, max(id) AS id_max FROM (SELECT *, {_pack_sql('w', n)} AS id FROM wi) GROUP BY read_id"
_CODES = lambda k: f"unnest(range(0, {k})) AS p"


def _neighbors_sql(k: int, low: int) -> str:
    return f"SELECT kmer_id, xor(kmer_id, CAST(x AS BIGINT) << CAST(2 * p AS INT)) AS neighbor FROM km, (SELECT unnest(range({low}, {k})) AS p), (SELECT unnest([1, 2, 3]) AS x)"


def _histogram_sql() -> str:
    one = lambda t, s: f"SELECT '{s}' AS section, CAST(i AS INT) AS cnt, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, 256)) AS i) LEFT JOIN (SELECT cnt, count(*) AS n FROM {t} GROUP BY cnt) ON i = cnt"
    return _with(_spectrum_sql("a", _T, False, 0, "tile_id"), _spectrum_sql("q", _T, True, 0, "tile_id")) + one("a", "all") + " UNION ALL " + one("q", "quality")


_BASES_OF = lambda x, n: f"array_to_string(list_transform(range(0, {n}), lambda i: substr('acgt', CAST((({x} >> CAST(2 * ({n - 1} - i) AS INT)) & 3) + 1 AS INT), 1)), '')"

_AMBIG_SQL = _with("""
spots AS (SELECT read_id, bases, list_filter(range(1, length(bases) + 1), lambda i: regexp_matches(substr(bases, CAST(i AS INT), 1), '[^ACGTacgt]')) AS p FROM reads),
each AS (SELECT read_id, bases, unnest(range(1, length(bases) + 1)) AS i, p FROM spots),
marked AS (
  SELECT read_id, i, substr(bases, CAST(i AS INT), 1) AS c, list_position(p, i) AS j, p FROM each
)
SELECT read_id, string_agg(CASE WHEN j IS NULL OR j = 0 THEN c
  WHEN (j + 1 <= len(p) AND p[j + 1] - p[j] <= 3) OR (j > 1 AND p[j] - p[j - 1] <= 3) THEN c ELSE 'A' END, '' ORDER BY i) AS bases
FROM marked GROUP BY read_id""")


def _rc_sql(x: str, n: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, {n}), lambda i: (3 - (({x} >> CAST(2 * i AS INT)) & 3)) << CAST(2 * ({n - 1} - i) AS INT))) AS BIGINT)"


def _list_sql(name: str, source: str, low: int) -> str:
    return f"""
{name}_o AS (SELECT h0, t0, {source} AS id FROM pairs WHERE {source} IN (SELECT kmer_id FROM km)),
{name}_n AS (SELECT h0, t0, xor(id, CAST(x AS BIGINT) << CAST(2 * p AS INT)) AS nb FROM {name}_o, (SELECT unnest(range({low}, {_K})) AS p), (SELECT unnest([1, 2, 3]) AS x)),
{name} AS (SELECT h0, t0, id, true AS own FROM {name}_o UNION ALL SELECT h0, t0, nb, false FROM {name}_n WHERE nb <> 0 AND nb IN (SELECT kmer_id FROM km))"""


def _side_sql(name: str, heads: str, tails: str) -> str:
    return f"""
{name}_c AS (
  SELECT h.h0, h.t0, (h.id << {2 * _S}) | (t.id & {(1 << 2 * _S) - 1}) AS tile, h.own AND t.own AS own
  FROM {heads} h JOIN {tails} t ON h.h0 = t.h0 AND h.t0 = t.t0 AND (h.id & {(1 << 2 * (_K - _S)) - 1}) = (t.id >> {2 * _S})),
{name} AS (SELECT h0, t0, tile, CAST(coalesce(cnt, 0) AS BIGINT) AS n FROM {name}_c LEFT JOIN ti ON tile = tile_id WHERE cnt IS NOT NULL OR own)"""


_MERGED = (
    _KMERS, _TILES, f"""
firsts AS (
  SELECT read_id, {_pack_sql("substr(bases, 1, " + str(_T) + ")", _T)} AS tile, quals FROM reads
  WHERE length(bases) >= {_T} AND NOT regexp_matches(substr(bases, 1, {_T}), '[^ACGT]')),
pairs AS (SELECT DISTINCT tile >> {2 * _S} AS h0, tile & {(1 << 2 * _K) - 1} AS t0 FROM firsts)""",
    _list_sql("lh", "h0", 0), _list_sql("lt", "t0", _K - _S), _list_sql("rh", _rc_sql("t0", _K), _K - _S), _list_sql("rt", _rc_sql("h0", _K), 0),
    _side_sql("fw", "lh", "lt"), _side_sql("rv", "rh", "rt"), f"""
merged AS (
  SELECT h0, t0, tile AS tile_id, CAST(sum(n) AS BIGINT) AS good_cnt
  FROM (SELECT h0, t0, tile, n FROM fw UNION ALL SELECT h0, t0, {_rc_sql("tile", _T)}, n FROM rv) GROUP BY h0, t0, tile)""",
)

_DECISION = f"""
joined AS (SELECT read_id, tile, tile_id, good_cnt, quals, tile = tile_id AS own FROM firsts JOIN merged ON tile >> {2 * _S} = h0 AND tile & {(1 << 2 * _K) - 1} = t0),
owns AS (SELECT read_id, max(good_cnt) FILTER (own) AS g0, count(*) AS n_tiles FROM joined GROUP BY read_id),
tested AS (
  SELECT j.*, g0, good_cnt >= floor(g0 / {PARAMS.ratio}) AND len(list_filter(range(0, {_T}), lambda p: ((tile >> CAST(2 * p AS INT)) & 3) <> ((tile_id >> CAST(2 * p AS INT)) & 3)
    AND ascii(substr(quals, CAST({_T} - p AS INT), 1)) < {PARAMS.low_quality})) > 0 AS alt
  FROM joined j JOIN owns USING (read_id) WHERE NOT own AND good_cnt >= {PARAMS.min_count}),
cands AS (SELECT read_id, count(*) AS n_cand, count(*) FILTER (alt) AS n_alt, max(tile_id) FILTER (alt) AS alt_tile, max(tile_id) AS cand_tile FROM tested GROUP BY read_id),
judged AS (
  SELECT read_id, tile, g0, alt_tile, cand_tile, CASE
    WHEN g0 >= {PARAMS.trusted_count} THEN 'trusted'
    WHEN n_tiles = 1 THEN CASE WHEN g0 >= {PARAMS.min_count} AND len(list_filter(range(1, {_T + 1}), lambda i: ascii(substr(quals, CAST(i AS INT), 1)) < {PARAMS.low_quality})) = 0 THEN 'only-tile' ELSE 'rejected' END
    WHEN g0 >= {PARAMS.min_count} THEN CASE coalesce(n_alt, 0) WHEN 0 THEN 'unchanged' WHEN 1 THEN 'corrected' ELSE 'rejected' END
    WHEN n_cand = 1 THEN 'corrected' ELSE 'rejected' END AS verdict
  FROM firsts JOIN owns USING (read_id) LEFT JOIN cands USING (read_id))"""

def _leveled_sql(name: str, heads: str, tails: str, first: str, second: str) -> str:
    """Candidates of one strand with the stage that first has them; first and second: what marks stages 2 and 1."""
    return f"""
{name}_lc AS (
  SELECT h.h0, h.t0, (h.id << {2 * _S}) | (t.id & {(1 << 2 * _S) - 1}) AS tile, h.own AND t.own AS own,
         CASE WHEN NOT {first} THEN 2 WHEN NOT {second} THEN 1 ELSE 0 END AS level
  FROM {heads} h JOIN {tails} t ON h.h0 = t.h0 AND h.t0 = t.t0 AND (h.id & {(1 << 2 * (_K - _S)) - 1}) = (t.id >> {2 * _S})),
{name}_l AS (SELECT h0, t0, tile, level, CAST(coalesce(cnt, 0) AS BIGINT) AS n FROM {name}_lc LEFT JOIN ti ON tile = tile_id WHERE cnt IS NOT NULL OR own)"""


_SEARCH = (
    *_MERGED[:-3], _leveled_sql("fw", "lh", "lt", "h.own", "t.own"), _leveled_sql("rv", "rh", "rt", "t.own", "h.own"), f"""
staged AS (
  SELECT h0, t0, stage, tile AS tile_id, CAST(sum(n) AS BIGINT) AS good_cnt
  FROM (SELECT h0, t0, tile, n, level FROM fw_l UNION ALL SELECT h0, t0, {_rc_sql("tile", _T)}, n, level FROM rv_l), (SELECT unnest([0, 1, 2]) AS stage)
  WHERE level <= stage GROUP BY h0, t0, stage, tile),
joined AS (SELECT read_id, stage, tile, tile_id, good_cnt, quals, tile = tile_id AS own FROM firsts JOIN staged ON tile >> {2 * _S} = h0 AND tile & {(1 << 2 * _K) - 1} = t0),
owns AS (SELECT read_id, stage, max(good_cnt) FILTER (own) AS g0, max(good_cnt) AS most, count(*) AS n_tiles FROM joined GROUP BY read_id, stage),
tested AS (
  SELECT j.*, g0, good_cnt >= floor(g0 / {PARAMS.ratio}) AND len(list_filter(range(0, {_T}), lambda p: ((tile >> CAST(2 * p AS INT)) & 3) <> ((tile_id >> CAST(2 * p AS INT)) & 3)
    AND ascii(substr(quals, CAST({_T} - p AS INT), 1)) < {PARAMS.low_quality})) > 0 AS alt
  FROM joined j JOIN owns USING (read_id, stage) WHERE NOT own AND good_cnt >= {PARAMS.min_count}),
cands AS (SELECT read_id, stage, count(*) AS n_cand, count(*) FILTER (alt) AS n_alt, max(tile_id) FILTER (alt) AS alt_tile, max(tile_id) AS cand_tile FROM tested GROUP BY read_id, stage),
judged AS (
  SELECT read_id, stage, tile, g0, most, CASE
    WHEN g0 >= {PARAMS.trusted_count} THEN tile
    WHEN n_tiles = 1 THEN CASE WHEN g0 >= {PARAMS.min_count} AND len(list_filter(range(1, {_T + 1}), lambda i: ascii(substr(quals, CAST(i AS INT), 1)) < {PARAMS.low_quality})) = 0 THEN tile END
    WHEN g0 >= {PARAMS.min_count} THEN CASE coalesce(n_alt, 0) WHEN 0 THEN tile WHEN 1 THEN alt_tile END
    WHEN n_cand = 1 THEN cand_tile END AS chosen
  FROM firsts JOIN owns USING (read_id) LEFT JOIN cands USING (read_id, stage)),
settled AS (SELECT read_id, min(stage) AS stage, arg_min(chosen, stage) AS chosen FROM judged WHERE chosen IS NOT NULL GROUP BY read_id),
searched AS (
  SELECT f.read_id, CAST(CASE WHEN s.stage IS NOT NULL THEN s.stage WHEN j.read_id IS NOT NULL THEN 3 ELSE -1 END AS INT) AS stage,
         CASE WHEN s.stage IS NOT NULL THEN s.chosen WHEN j.read_id IS NOT NULL THEN f.tile ELSE -1 END AS chosen, f.tile AS own
  FROM firsts f LEFT JOIN settled s ON f.read_id = s.read_id
  LEFT JOIN (SELECT read_id FROM judged WHERE stage = 2 AND g0 >= {PARAMS.min_count} AND most <= g0) j ON f.read_id = j.read_id)""",
)

def _rounds_sql(name: str, source: str, low: int, rounds: int) -> str:
    """A list of k-mers with the round in which each occurrence is appended."""
    flips = f"(SELECT unnest(range({low}, {_K})) AS p), (SELECT unnest([1, 2, 3]) AS x)"
    out = [f"{name}_0 AS (SELECT h0, t0, {source} AS id FROM pairs WHERE {source} IN (SELECT kmer_id FROM km))"]
    for r in range(1, rounds + 1):
        have = " UNION ".join(f"SELECT h0, t0, id FROM {name}_{i}" for i in range(r))
        out.append(f"{name}_{r} AS MATERIALIZED (SELECT DISTINCT h0, t0, nb AS id FROM (SELECT h0, t0, xor(id, CAST(x AS BIGINT) << CAST(2 * p AS INT)) AS nb FROM ({have}), {flips}) WHERE nb <> 0 AND nb IN (SELECT kmer_id FROM km))")
    return ",".join((*out, f"{name} AS (" + " UNION ALL ".join(f"SELECT h0, t0, id, {r} AS level FROM {name}_{r}" for r in range(rounds + 1)) + ")"))


def _occurrences_sql(name: str, heads: str, tails: str, early: str, late: str, rounds: int) -> str:
    return f"""
{name} AS (
  SELECT h0, t0, tile, own, level, CAST(coalesce(cnt, 0) AS BIGINT) AS n FROM (
    SELECT h.h0, h.t0, (h.id << {2 * _S}) | (t.id & {(1 << 2 * _S) - 1}) AS tile, h.level + t.level = 0 AS own,
           greatest({early}, CASE WHEN {late} > 0 THEN {rounds} + {late} ELSE 0 END) AS level
    FROM {heads} h JOIN {tails} t ON h.h0 = t.h0 AND h.t0 = t.t0 AND (h.id & {(1 << 2 * (_K - _S)) - 1}) = (t.id >> {2 * _S}))
  LEFT JOIN ti ON tile = tile_id WHERE cnt IS NOT NULL OR own)"""


def _bag_search_sql(p: Params) -> str:
    d = p.max_distance
    return "WITH " + ",".join((
        _READS, _spectrum_sql("km", _K, False, p.min_count, "kmer_id"), _spectrum_sql("ti", _T, True, p.min_count, "tile_id"), _MERGED[2],
        _rounds_sql("lh", "h0", 0, d), _rounds_sql("lt", "t0", _K - _S, d), _rounds_sql("rh", _rc_sql("t0", _K), _K - _S, d), _rounds_sql("rt", _rc_sql("h0", _K), 0, d),
        _occurrences_sql("fw", "lh", "lt", "t.level", "h.level", d), _occurrences_sql("rv", "rh", "rt", "h.level", "t.level", d), f"""
occ AS (
  SELECT h0, t0, stage, strand, tile, n, own
  FROM (SELECT h0, t0, tile, n, own, level, 0 AS strand FROM fw UNION ALL SELECT h0, t0, {_rc_sql("tile", _T)}, n, own, level, 1 FROM rv), (SELECT unnest(range(0, {2 * d + 1})) AS stage)
  WHERE level <= stage),
strands AS (SELECT h0, t0, count(DISTINCT strand) AS strands FROM occ GROUP BY h0, t0),
entries AS MATERIALIZED (
  SELECT h0, t0, stage, tile AS tile_id, CAST(sum(n) AS BIGINT) AS good_cnt, bool_or(own) AS own FROM occ JOIN strands USING (h0, t0) WHERE strands = 2 GROUP BY h0, t0, stage, tile
  UNION ALL SELECT h0, t0, stage, tile, n, own FROM occ JOIN strands USING (h0, t0) WHERE strands = 1),
owns AS (SELECT h0, t0, stage, max(good_cnt) FILTER (own) AS g0, max(good_cnt) AS most, count(*) AS n_tiles FROM entries GROUP BY h0, t0, stage),
joined AS (
  SELECT read_id, f.tile, f.quals, e.* FROM firsts f JOIN entries e ON f.tile >> {2 * _S} = e.h0 AND f.tile & {(1 << 2 * _K) - 1} = e.t0
  WHERE NOT own AND good_cnt >= {p.min_count}),
tested AS (
  SELECT read_id, stage, tile_id, good_cnt >= floor(g0 / {p.ratio}) AND len(list_filter(range(0, {_T}), lambda p: ((tile >> CAST(2 * p AS INT)) & 3) <> ((tile_id >> CAST(2 * p AS INT)) & 3)
    AND ascii(substr(quals, CAST({_T} - p AS INT), 1)) < {p.low_quality})) > 0 AS alt
  FROM joined JOIN owns USING (h0, t0, stage)),
cands AS (SELECT read_id, stage, count(*) AS n_cand, count(*) FILTER (alt) AS n_alt, max(tile_id) FILTER (alt) AS alt_tile, max(tile_id) AS cand_tile FROM tested GROUP BY read_id, stage),
judged AS (
  SELECT read_id, stage, tile, g0, most, CASE
    WHEN g0 >= {p.trusted_count} THEN tile
    WHEN n_tiles = 1 THEN CASE WHEN g0 >= {p.min_count} AND len(list_filter(range(1, {_T + 1}), lambda i: ascii(substr(quals, CAST(i AS INT), 1)) < {p.low_quality})) = 0 THEN tile END
    WHEN g0 >= {p.min_count} THEN CASE coalesce(n_alt, 0) WHEN 0 THEN tile WHEN 1 THEN alt_tile END
    WHEN n_cand = 1 THEN cand_tile END AS chosen
  FROM firsts f JOIN owns o ON f.tile >> {2 * _S} = o.h0 AND f.tile & {(1 << 2 * _K) - 1} = o.t0 LEFT JOIN cands USING (read_id, stage)),
settled AS (SELECT read_id, min(stage) AS stage, arg_min(chosen, stage) AS chosen FROM judged WHERE chosen IS NOT NULL GROUP BY read_id)
SELECT f.read_id, CAST(CASE WHEN s.stage IS NOT NULL THEN s.stage WHEN j.read_id IS NOT NULL THEN {2 * d + 1} ELSE -1 END AS INT) AS stage,
       CASE WHEN s.stage IS NOT NULL THEN s.chosen WHEN j.read_id IS NOT NULL THEN f.tile ELSE -1 END AS chosen, f.tile AS own
FROM firsts f LEFT JOIN settled s ON f.read_id = s.read_id
LEFT JOIN (SELECT read_id FROM judged WHERE stage = {2 * d} AND g0 >= {p.min_count} AND most <= g0) j ON f.read_id = j.read_id""",
    ))


def _correction_sql(p: Params) -> tuple[str, ...]:
    """The walk of every read as a recursion with one row for each read and turn, for one substitution.

    A row has the place, the last place that was accepted, whether the read crawls and until where, how far and
    from which base on heads and tails may be changed, the bases as corrected so far, and the errors of its turn.
    """
    k, t, s = p.k, p.tile, p.step
    error = "STRUCT(pos INT, f INT, t INT, q INT)[]"
    return (f"""
state(read_id, pos, last, crawl, turn, heads, tails, lowh, lowt, b, q, n, found, e, alive) AS (
  SELECT read_id, 0, -1, false, -1, {p.max_distance}, {p.max_distance}, 0, {k - s}, bases, quals, CAST(length(bases) AS INT), 0, CAST([] AS {error}), true FROM reads WHERE length(bases) >= {t}
  UNION ALL (
  WITH live AS (
    SELECT *, {_pack_sql(f"substr(b, pos + 1, {t})", t)} AS tile FROM state WHERE alive AND NOT regexp_matches(substr(b, pos + 1, {t}), '[^ACGT]')),
  ends AS (SELECT *, tile >> {2 * s} AS h0, tile & {(1 << 2 * k) - 1} AS t0 FROM live),
  starts AS (
    SELECT read_id, unnest([0, 1, 2, 3]) AS list, unnest([h0, t0, {_rc_sql("t0", k)}, {_rc_sql("h0", k)}]) AS id,
           unnest([lowh, lowt, lowt, lowh]) AS low, unnest([heads, tails, tails, heads]) AS most FROM ends),
  own AS (SELECT * FROM starts WHERE id IN (SELECT kmer_id FROM km)),
  near AS (
    SELECT read_id, list, xor(id, CAST(x AS BIGINT) << CAST(2 * p AS INT)) AS id FROM own, (SELECT unnest(range(0, {k})) AS p), (SELECT unnest([1, 2, 3]) AS x) WHERE most >= 1 AND p >= low),
  lists AS (
    SELECT read_id, list, id, 0 AS level FROM own
    UNION ALL SELECT read_id, list, id, 1 FROM near WHERE id <> 0 AND id IN (SELECT kmer_id FROM km)),
  made AS (
    SELECT h.read_id, h.list // 2 AS strand, (h.id << {2 * s}) | (t.id & {(1 << 2 * s) - 1}) AS tile, h.level + t.level = 0 AS own,
           CASE WHEN h.list = 0 THEN t.level ELSE h.level END AS early, CASE WHEN h.list = 0 THEN h.level ELSE t.level END AS late
    FROM lists h JOIN lists t ON h.read_id = t.read_id AND t.list = h.list + 1 AND h.list IN (0, 2) AND (h.id & {(1 << 2 * (k - s)) - 1}) = (t.id >> {2 * s})),
  counted AS (
    SELECT read_id, CASE strand WHEN 0 THEN tile ELSE {_rc_sql("tile", t)} END AS tile, own, early, late, CAST(coalesce(cnt, 0) AS BIGINT) AS n
    FROM made LEFT JOIN ti ON tile = tile_id WHERE cnt IS NOT NULL OR own),
  staged AS (
    SELECT read_id, stage, c.tile AS other, sum(c.n) AS n, bool_or(own) AS own
    FROM counted c JOIN (SELECT read_id, heads, tails, unnest(range(0, heads + tails + 1)) AS stage FROM ends) USING (read_id)
    WHERE greatest(early, CASE WHEN late > 0 THEN tails + late ELSE 0 END) <= stage GROUP BY read_id, stage, c.tile),
  owns AS (SELECT read_id, stage, max(n) FILTER (own) AS g0, max(n) AS most, count(*) AS n_tiles FROM staged GROUP BY read_id, stage),
  tested AS (
    SELECT read_id, stage, other, o.n >= floor(g0 / {p.ratio}) AND len(list_filter(range(0, {t}), lambda p: ((tile >> CAST(2 * p AS INT)) & 3) <> ((other >> CAST(2 * p AS INT)) & 3)
      AND ascii(substr(q, CAST(pos + {t} - p AS INT), 1)) < {p.low_quality})) > 0 AS alt
    FROM staged o JOIN owns USING (read_id, stage) JOIN ends USING (read_id) WHERE NOT own AND o.n >= {p.min_count}),
  cands AS (SELECT read_id, stage, count(*) AS n_cand, count(*) FILTER (alt) AS n_alt, max(other) FILTER (alt) AS alt_tile, max(other) AS cand_tile FROM tested GROUP BY read_id, stage),
  judged AS (
    SELECT read_id, stage, stage = heads + tails AND g0 >= {p.min_count} AND most <= g0 AS stands, tile, CASE
      WHEN g0 >= {p.trusted_count} THEN tile
      WHEN n_tiles = 1 THEN CASE WHEN g0 >= {p.min_count} AND len(list_filter(range(1, {t + 1}), lambda i: ascii(substr(q, CAST(pos + i AS INT), 1)) < {p.low_quality})) = 0 THEN tile END
      WHEN g0 >= {p.min_count} THEN CASE coalesce(n_alt, 0) WHEN 0 THEN tile WHEN 1 THEN alt_tile END
      WHEN n_cand = 1 THEN cand_tile END AS chosen
    FROM ends JOIN owns USING (read_id) LEFT JOIN cands USING (read_id, stage)),
  settled AS (SELECT read_id, coalesce(arg_min(chosen, stage) FILTER (chosen IS NOT NULL), max(tile) FILTER (stands)) AS chosen FROM judged GROUP BY read_id),
  taken AS (SELECT e.*, s.chosen, s.chosen IS NOT NULL AS ok FROM ends e LEFT JOIN settled s USING (read_id)),
  changed AS (
    SELECT *, CASE WHEN ok AND chosen <> tile THEN CAST(list_transform(list_filter(range(0, {t}), lambda p: ((tile >> CAST(2 * p AS INT)) & 3) <> ((chosen >> CAST(2 * p AS INT)) & 3)),
      lambda p: struct_pack(pos := pos + {t - 1} - p, f := (chosen >> CAST(2 * p AS INT)) & 3, t := (tile >> CAST(2 * p AS INT)) & 3, q := ascii(substr(q, CAST(pos + {t} - p AS INT), 1)))) AS {error}) ELSE CAST([] AS {error}) END AS errors,
      CASE WHEN ok THEN substr(b, 1, pos) || upper({_BASES_OF("chosen", t)}) || substr(b, pos + {t + 1}) ELSE b END AS fixed,
      ok AND pos + {t} = n AS over, CASE WHEN ok THEN pos ELSE last END AS reached, pos + {s} <= n - {t} AS whole, crawl OR NOT ok AS crawls, CASE WHEN NOT ok AND NOT crawl THEN pos ELSE turn END AS until
    FROM taken),
  moved AS (SELECT *, crawls AND (reached = -1 OR pos = reached + 1) AS stop, CASE WHEN crawls THEN reached + 1 WHEN whole THEN pos + {s} ELSE n - {t} END AS next FROM changed)
  SELECT read_id, next, reached, crawls AND next <> until, until, 0, CASE WHEN crawls THEN 1 ELSE {p.max_distance} END, {k}, CASE WHEN crawls THEN {k - 3} WHEN whole THEN 0 ELSE pos + {t + s} - n END,
         fixed, q, n, found + len(e), errors, NOT over AND NOT stop AND next + {t} <= n FROM moved))""", """
errors AS (SELECT read_id, unnest(range(found, found + len(e))) AS ord, unnest(e, recursive := true) FROM state WHERE len(e) > 0)""")


_CORRECTION = "WITH RECURSIVE " + ",".join((_READS, _KMERS, _TILES, *_correction_sql(PARAMS)))

ORACLE = {
    "sql_frequent_kmers": _with(_spectrum_sql("km", _K, False, 3, "kmer_id"), f"turned AS (SELECT *, {_rc_sql('kmer_id', _K)} AS rc_id FROM km)")
      + f" SELECT kmer_id, {_BASES_OF('kmer_id', _K)} AS bases, rc_id, CAST(len(list_filter(range(0, {_K}), lambda p: ((kmer_id >> CAST(2 * p AS INT)) & 3) <> ((rc_id >> CAST(2 * p AS INT)) & 3))) AS INT) AS rc_distance, cnt FROM turned",
    "read_correction": _CORRECTION + ' SELECT read_id, CAST(ord AS INT) AS ord, pos, f AS "from", t AS "to", q AS qual FROM errors',
    "corrected_reads": _CORRECTION + """,
      fixes AS (SELECT read_id, map_from_entries(list(struct_pack(k := pos, v := f))) AS m FROM (SELECT read_id, pos, arg_max(f, ord) AS f FROM errors GROUP BY read_id, pos) GROUP BY read_id)
      SELECT read_id, CASE WHEN m IS NULL THEN bases ELSE array_to_string(list_transform(range(0, length(bases)), lambda i: coalesce(substr('acgt', m[CAST(i AS INT)] + 1, 1), substr(bases, CAST(i + 1 AS INT), 1))), '') END AS bases
      FROM reads LEFT JOIN fixes USING (read_id)""",
    "error_summary": _CORRECTION + ' SELECT f AS "from", t AS "to", count(*) AS n, count(DISTINCT read_id) AS n_reads FROM errors GROUP BY f, t',
    "first_tile_search_two": _bag_search_sql(TWO),
    "hamming2_pairs": _with(_spectrum_sql("ti", _T, True, 4, "tile_id"), f"""
      masks AS (SELECT a.p AS p, b.p AS q, ~((3::BIGINT << CAST(2 * a.p AS INT)) | (3::BIGINT << CAST(2 * b.p AS INT))) AS m FROM (SELECT unnest(range(0, {_T})) AS p) a, (SELECT unnest(range(0, {_T})) AS p) b WHERE a.p < b.p),
      keyed AS (SELECT tile_id, p, q, tile_id & m AS key FROM ti, masks)""")
      + " SELECT DISTINCT a.tile_id AS a, b.tile_id AS b FROM keyed a JOIN keyed b ON a.p = b.p AND a.q = b.q AND a.key = b.key AND a.tile_id < b.tile_id",
    "first_tile_search": _with(*_SEARCH) + " SELECT read_id, stage, chosen, own FROM searched",
    "first_tile_errors": _with(*_SEARCH, """
      each AS (SELECT read_id, CAST((chosen >> CAST(2 * p AS INT)) & 3 AS INT) AS x, CAST((own >> CAST(2 * p AS INT)) & 3 AS INT) AS y FROM searched, (SELECT unnest(range(0, """ + str(_T) + """)) AS p) WHERE stage >= 0 AND chosen <> own)""")
      + ' SELECT x AS "from", y AS "to", count(*) AS n, count(DISTINCT read_id) AS n_reads FROM each WHERE x <> y GROUP BY x, y',
    "strand_merged_tiles": _with(*_MERGED) + " SELECT h0, t0, tile_id, good_cnt FROM merged",
    "first_tile_decision": _with(*_MERGED, _DECISION) + f" SELECT read_id, verdict, CASE verdict WHEN 'rejected' THEN -1 WHEN 'corrected' THEN CASE WHEN g0 >= {PARAMS.min_count} THEN alt_tile ELSE cand_tile END ELSE tile END AS chosen FROM judged",
    "tile_spectrum": _with(_TILES2) + " SELECT tile_id, cnt FROM ti",
    "kmer_spectrum": _with(_KMERS) + " SELECT kmer_id, cnt FROM km",
    "tile_spectrum_noq": _with(_spectrum_sql("ti", _T, False, 1, "tile_id")) + " SELECT tile_id, cnt FROM ti",
    "reads_derived": _with() + " SELECT read_id, bases, quals FROM reads",
    "reads_valid_only": _with() + " SELECT read_id, bases FROM reads WHERE NOT regexp_matches(bases, '[^ACGTacgt]')",
    "reads_renumbered": _with() + " SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, bases FROM reads WHERE NOT regexp_matches(bases, '[^ACGTacgt]')",
    "ambig_replaced": _AMBIG_SQL,
    "kmer_windows": _with(_windows_sql("wi", _K, False)) + _DIGEST(_K),
    "tile_windows_q": _with(_windows_sql("wi", _T, True)) + _DIGEST(_T),
    "pack_unpack": _with(_TILES2) + f" SELECT tile_id, b AS bases, CAST(list_sum(list_transform(range(0, {_T}), lambda i: (3 - ((tile_id >> CAST(2 * i AS INT)) & 3)) << CAST(2 * ({_T - 1} - i) AS INT))) AS BIGINT) AS rc_id, translate(reverse(b), 'acgt', 'tgca') AS rc_bases, tile_id AS again FROM (SELECT tile_id, {_BASES_OF('tile_id', _T)} AS b FROM ti)",
    "spectrum_ranked": _with(_DENSE(1)) + " SELECT kmer_id, cnt, row_number() OVER (ORDER BY kmer_id) AS rank FROM km",
    "absent_kmers": _with(_DENSE(200)) + " SELECT i AS kmer_id, 0 AS cnt FROM (SELECT unnest(range(0, 4096)) AS i) WHERE i NOT IN (SELECT kmer_id FROM km)",
    "spectrum_summary": _with(_DENSE(1), _spectrum_sql("ti", 8, True, 1, "tile_id")) + """
      SELECT 'reads' AS metric, count(*) AS value FROM reads UNION ALL SELECT 'kmer_windows', count(*) FROM km_w UNION ALL SELECT 'tile_windows', count(*) FROM ti_w
      UNION ALL SELECT 'kmers', count(*) FROM km UNION ALL SELECT 'tiles', count(*) FROM ti
      UNION ALL SELECT 'absent_kmers', CASE WHEN 2 * count(*) > 4096 THEN 4096 - count(*) ELSE 0 END FROM km""",
    "tile_histogram_both": _histogram_sql(),
    "unit_neighbors": _with(_DENSE(1)) + _neighbors_sql(6, 2),
    "valid_neighbors": _with(_DENSE(100)) + f" SELECT * FROM ({_neighbors_sql(6, 0)}) WHERE neighbor <> 0 AND neighbor IN (SELECT kmer_id FROM km)",
    "hamming1_pairs": _with(_spectrum_sql("km", _K, False, 3, "kmer_id")) + f" SELECT kmer_id AS a, neighbor AS b FROM ({_neighbors_sql(_K, 0)}) WHERE kmer_id < neighbor AND neighbor IN (SELECT kmer_id FROM km)",
    "tile_lookup": _with(_KMERS, _TILES, f"""
      firsts AS (SELECT read_id, {_pack_sql("substr(bases, 1, " + str(_T) + ")", _T)} AS tile FROM reads WHERE length(bases) >= {_T} AND NOT regexp_matches(substr(bases, 1, {_T}), '[^ACGT]'))""") + f"""
      SELECT read_id, tile AS tile_id, CAST(coalesce(cnt, 0) AS BIGINT) AS good_cnt FROM firsts LEFT JOIN ti ON tile = tile_id
      WHERE (tile >> {2 * _S}) IN (SELECT kmer_id FROM km) AND (tile & {(1 << 2 * _K) - 1}) IN (SELECT kmer_id FROM km)""",
    "tile_diffs": _with(_TILES2, f"""
      two AS (SELECT tile_id, lag(tile_id) OVER (ORDER BY tile_id) AS before FROM ti),
      pos AS (SELECT tile_id, before, p, (tile_id >> CAST(2 * p AS INT)) & 3 AS x, (before >> CAST(2 * p AS INT)) & 3 AS y FROM two, (SELECT unnest(range(0, {_T})) AS p) WHERE before IS NOT NULL)""")
      + f" SELECT tile_id, before, count(*) AS n_diff, min({_T - 1} - p) AS first_pos, CAST(sum(x * 4 + y) AS BIGINT) AS codes FROM pos WHERE x <> y GROUP BY tile_id, before",
    "quality_profile": _with() + " SELECT read_id, CAST(len(list_filter(range(1, length(quals) + 1), lambda i: ascii(substr(quals, CAST(i AS INT), 1)) < 50)) AS BIGINT) AS n_low, len(list_filter(range(1, length(quals) + 1), lambda i: ascii(substr(quals, CAST(i AS INT), 1)) < 40)) = 0 AS all_good FROM reads",
    "block_assignment": _with(f"""
      numbered AS (SELECT row_number() OVER (ORDER BY read_id) - 1 AS i, count(*) OVER () AS n FROM reads),
      bounds AS (SELECT b, b * n // {BLOCKS} AS lo, (b + 1) * n // {BLOCKS} AS hi FROM (SELECT unnest(range(0, {BLOCKS})) AS b), (SELECT count(*) AS n FROM reads))""")
      + " SELECT b AS block, hi - lo AS rows, lo AS low, hi - 1 AS high FROM bounds WHERE hi > lo",
    "delta_restarts": "WITH RECURSIVE " + ",".join((_READS, _spectrum_sql("km", MIDDLE.k, False, 1, "kmer_id"), """
      steps AS MATERIALIZED (SELECT w AS width, kmer_id AS id, 1 << (8 * w) AS step FROM km, (SELECT unnest(range(1, 8)) AS w)),
      jumps AS MATERIALIZED (SELECT width, id, min(id) OVER (PARTITION BY width ORDER BY id RANGE BETWEEN step FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM steps),
      chain(width, ref) AS (
        SELECT w, (SELECT min(kmer_id) FROM km) FROM (SELECT unnest(range(1, 8)) AS w)
        UNION ALL SELECT j.width, j.next FROM chain c JOIN jumps j ON j.width = c.width AND j.id = c.ref WHERE j.next IS NOT NULL)"""))
      + " SELECT CAST(width AS INT) AS width, count(ref) AS \"references\", (SELECT count(*) FROM km) - count(ref) AS deltas FROM chain GROUP BY width",
    "lookup_counters": _with(_spectrum_sql("km", _K, False, 3, "kmer_id"), _spectrum_sql("ti", _T, True, 3, "tile_id"), _windows_sql("tw", _T, False)) + f"""
      SELECT 'kmer' AS kind, count(*) AS lookups, CAST(count_if({_pack_sql("w", _K)} NOT IN (SELECT kmer_id FROM km)) AS BIGINT) AS misses FROM km_w
      UNION ALL SELECT 'tile', count(*), CAST(count_if({_pack_sql("w", _T)} NOT IN (SELECT tile_id FROM ti)) AS BIGINT) FROM tw""",
    "delta_bytes_per_node": _with(_KMERS, f"""
      placed AS (SELECT kmer_id, row_number() OVER (ORDER BY kmer_id) - 1 AS i FROM km),
      near AS (
        SELECT i // {NODE} AS node, CASE i % {NODE} WHEN 0 THEN kmer_id WHEN 1 THEN kmer_id - lag(kmer_id) OVER (ORDER BY i)
          ELSE kmer_id - nth_value(kmer_id, 2) OVER (PARTITION BY i // {NODE} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS d
        FROM placed)""")
      + " SELECT node, count(*) AS rows, CAST(sum(CASE WHEN d < 256 THEN 1 WHEN d < 65536 THEN 2 WHEN d < 16777216 THEN 3 ELSE 4 END) AS BIGINT) AS bytes FROM near GROUP BY node",
}
