"""The widening search on first tiles as joins, for any distance, with the counts of repeated tiles.

A tile is settled by itself, or by tiles near it. Near tiles come from four lists of k-mers: its
head and its tail, and on the other strand the reverse complements of both. A list starts with the
k-mer as read, if the spectrum has it, and grows by rounds: the distinct known neighbours of all its members
are appended, members that are there already included, so a k-mer may occur several times. With
``d`` rounds there are 2 d + 1 stages: first the tails grow, round by round, then the heads; on the
other strand the heads, then the tails. Every stage makes the tiles of overlapping heads and tails
that the tile spectrum counts. If both strands have tiles, counts of all occurrences of a tile
add up and it counts as one; if one strand has tiles, each occurrence counts by itself.

The four lists are one table with a list number, so that a round of neighbours is one join with
the k-mer spectrum for all of them, made once for each distinct k-mer, and the tiles of both strands
are looked up in one join. Stages are summed up by tile as read, once for all reads that begin
with it; only the qualities of the bases differ between those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from . import tiles as tiling

HEADS, TAILS, RHEADS, RTAILS = range(4)


def low_bases(quals: Column, length: int, low: int) -> Column:
    """Both bits of each of the first ``length`` bases whose quality lies below ``low``; the first base is most significant."""
    chars = "".join(chr(c) for c in range(33, 127))
    marked = F.translate(F.substring(quals, 1, length), chars, "".join("3" if ord(c) < low else "0" for c in chars))
    digits = F.rpad(F.regexp_replace(marked, "[^03]", "0"), length, "0")
    part = lambda at, n: F.conv(F.substring(digits, at, n), 4, 10).cast("long")
    return part(1, length) if length <= 16 else F.shiftleft(part(1, length - 16), 32).bitwiseOR(part(length - 15, 16))


def first_tiles(reads: DataFrame, p) -> DataFrame:
    """(read_id, h0, t0, low) of reads that begin with a tile of clean bases: its k-mers and its bases of low quality."""
    first = reads.where(F.length("bases") >= p.tile).select("read_id", F.substring("bases", 1, p.tile).alias("b"), "quals")
    clean = first.where(F.translate(F.upper("b"), codec.BASES, "") == "")
    tile = codec.pack(F.col("b"), p.tile)
    return clean.select("read_id", codec.head_of(tile, p.step).alias("h0"), codec.tail_of(tile, p.k).alias("t0"), low_bases(F.col("quals"), p.tile, p.low_quality).alias("low"))


def adjacency(ids: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(id, near) of the distinct ``ids`` that the spectrum has: their known neighbours, 3k at most."""
    flips = [F.lit(x << 2 * at).cast("long") for at in range(k) for x in (0, 1, 2, 3) if x or not at]
    each = ids.select("id", F.explode(F.array(*[F.col("id").bitwiseXOR(f) for f in flips])).alias("x"))
    # identifier 0 is nobody's neighbour
    known = each.where("x <> 0 OR x = id").join(kmers.select(F.col("kmer_id").alias("__k")), F.col("x") == F.col("__k"), "left_semi")
    near = known.groupBy("id").agg(F.collect_list("x").alias("near"))
    return near.where(F.array_contains("near", F.col("id"))).select("id", F.array_remove("near", F.col("id")).alias("near"))


def _lists(pairs: DataFrame, kmers: DataFrame, p, rounds: tuple[int, int]) -> DataFrame:
    """(h0, t0, l0 to l3): for each list the members (id, level) of its rounds; ``rounds``: of heads and of tails.

    A list is an array of at most all k-mers within its rounds. From two rounds on, neighbours are made for
    the whole spectrum, as nearly all of it is asked for, and each round joins with the same table.
    """
    rc = lambda c: codec.revcomp_id(F.col(c), p.k)
    start = [(HEADS, F.col("h0")), (TAILS, F.col("t0")), (RHEADS, rc("t0")), (RTAILS, rc("h0"))]
    each = pairs.select("h0", "t0", F.explode(F.array(*[F.struct(F.lit(n).alias("list"), c.alias("id")) for n, c in start])).alias("e")).select("h0", "t0", "e.list", "e.id")
    # a flip at the lowest base that may change, or further left, changes the identifier by this much at least
    far = F.col("list").isin(HEADS, RTAILS)
    least = F.when(far, F.lit(1)).otherwise(F.lit(1 << 2 * (p.k - p.step))).cast("long")
    most = F.when(far, F.lit(rounds[0])).otherwise(F.lit(rounds[1]))
    ids = each.select("id").distinct() if max(rounds) < 2 else kmers.select(F.col("kmer_id").alias("id"))
    near, keys = adjacency(ids, kmers, p.k), ["h0", "t0", "list"]
    members = each.withColumn("level", F.lit(0))
    for level in range(1, max(rounds) + 1):
        # the neighbours of all members so far are the next ones, members among them
        own = F.col("id")
        grown = F.when(most >= level, F.filter("near", lambda x: x.bitwiseXOR(own) >= least)).otherwise(F.array().cast("array<long>"))
        both = members.join(near, "id").select(*keys, F.struct("id", "level").alias("m"), grown.alias("g"))
        all_ = both.groupBy(*keys).agg(F.collect_list("m").alias("m"), F.array_distinct(F.flatten(F.collect_list("g"))).alias("g"))
        new = F.transform("g", lambda x: F.struct(x.alias("id"), F.lit(level).alias("level")))
        members = all_.select(*keys, F.inline(F.concat("m", new)))
    if not max(rounds):
        members = members.join(near.select("id"), "id", "left_semi")
    list_of = lambda n: F.collect_list(F.when(F.col("list") == n, F.struct("id", "level"))).alias(f"l{n}")
    return members.groupBy("h0", "t0").agg(*[list_of(n) for n in range(4)])


def candidates(pairs: DataFrame, kmers: DataFrame, tiles: DataFrame, p, rounds: tuple[int, int], ready=None) -> DataFrame:
    """(h0, t0, strand, tile_id, cnt, own, stage): every occurrence of a tile near the tile as read, forward.

    ``stage`` is the first one that has it. The tile as read is there even if it isn't counted. ``ready``: a
    ``Corrector`` of both spectra; where these fit into the workers, tiles are looked up there and only those found become rows.
    """
    if ready is not None and not ready.routed:
        return ready.near_tiles(pairs, rounds)
    d, over = p.max_distance, 2 * (p.k - p.step)
    lists = _lists(pairs, kmers, p, rounds)
    sides = [F.struct(F.lit(s).alias("strand"), F.col(f"l{h}").alias("heads"), F.col(f"l{t}").alias("tails")) for s, h, t in ((0, HEADS, TAILS), (1, RHEADS, RTAILS))]
    each = lists.select("h0", "t0", F.inline(F.array(*sides))).where("size(heads) > 0 AND size(tails) > 0")
    head = each.select("h0", "t0", "strand", "tails", F.inline("heads").alias("h", "hl"))
    shared = F.col("h").bitwiseAND(F.lit((1 << over) - 1).cast("long"))
    fit = F.filter("tails", lambda x: F.shiftrightunsigned(x["id"], 2 * p.step) == shared) if p.step < p.k else F.col("tails")
    both = head.select("h0", "t0", "strand", "h", "hl", F.inline(fit).alias("t", "tl"))
    # the lists that grow first are tails, and heads on the other strand
    early, late = F.when(F.col("strand") == 0, F.col("tl")).otherwise(F.col("hl")), F.when(F.col("strand") == 0, F.col("hl")).otherwise(F.col("tl"))
    stage = F.greatest(early, F.when(late > 0, late + d).otherwise(0))
    own = (F.col("hl") == 0) & (F.col("tl") == 0)
    made = both.select("h0", "t0", "strand", own.alias("own"), stage.alias("stage"), tiling.tile_key(F.col("h"), F.col("t"), p.step).alias("tile_id"))
    got = tiling.with_counts(made, tiles, F.col("own"))
    turned = F.when(F.col("strand") == 1, codec.revcomp_id(F.col("tile_id"), p.tile)).otherwise(F.col("tile_id"))
    return got.select("h0", "t0", "strand", turned.alias("tile_id"), F.col("good_cnt").cast("long").alias("cnt"), "own", "stage")


def merged(found: DataFrame) -> DataFrame:
    """(h0, t0, tile_id, good_cnt): counts of all occurrences on both strands added up."""
    return found.groupBy("h0", "t0", "tile_id").agg(F.sum("cnt").alias("good_cnt"))


def merged_tiles(pairs: DataFrame, kmers: DataFrame, tiles: DataFrame, p, ready=None) -> DataFrame:
    """``merged`` of the candidates of distinct ``pairs``; added up where they are made if the spectra are in the workers."""
    rounds = (p.max_distance, p.max_distance)
    if ready is not None and not ready.routed:
        return ready.merged_tiles(pairs, rounds)
    return merged(candidates(pairs, kmers, tiles, p, rounds))


def stages(found: DataFrame, p, which: list[int]) -> DataFrame:
    """(h0, t0, stage, g0, n_tiles, most, cands): what each of the stages ``which`` knows of a tile as read.

    g0: its count; n_tiles: all tiles; most: the greatest count; cands: (diff, n, weight) of other tiles with
    ``min_count`` or more, diff having both bits of each base that differs.
    """
    # stages follow each other; what is dealt out by tile as read stays so in all that is grouped and joined below
    first, last = min(which), max(which)
    each = found.repartition("h0", "t0").where(F.col("stage") <= last).select("*", F.explode(F.sequence(F.greatest(F.col("stage"), F.lit(first)), F.lit(last))).alias("at"))
    side = lambda s: F.count_if(F.col("strand") == s).alias(f"n{s}")
    tile = each.groupBy("h0", "t0", "at", "tile_id").agg(F.sum("cnt").alias("total"), F.max("cnt").alias("cnt"), F.bool_or("own").alias("own"), side(0), side(1))
    # a strand that has tiles has the tile as read
    both = F.col("n0") * F.col("n1") > 0
    x = F.col("tile_id").bitwiseXOR(tiling.tile_key(F.col("h0"), F.col("t0"), p.step))
    pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    diff = pairs.bitwiseOR(F.shiftleft(pairs, 1))
    item = F.struct(diff.alias("diff"), "tile_id", "total", "cnt", (F.col("n0") + F.col("n1")).cast("int").alias("n"), "own")
    row = tile.groupBy("h0", "t0", "at").agg(F.bool_or(F.col("own") & both).alias("both"), F.collect_list(item).alias("all"))
    count = lambda e: F.when(F.col("both"), e["total"]).otherwise(e["cnt"])
    mine = F.filter("all", lambda e: e["own"])
    # the tile as read is one occurrence; further ones of it stand beside it where strands aren't added up
    rest = lambda e: F.when(F.col("both"), F.when(e["own"], 0).otherwise(1)).otherwise(e["n"] - e["own"].cast("int"))
    others = F.filter(F.transform("all", lambda e: F.struct(e["diff"].alias("diff"), e["tile_id"].alias("tile_id"), count(e).alias("n"), rest(e).alias("weight"))), lambda e: (e["weight"] > 0) & (e["n"] >= p.min_count))
    return row.select(
        "h0", "t0", F.col("at").alias("stage"), F.array_max(F.transform(mine, count)).alias("g0"),
        F.when(F.col("both"), F.size("all")).otherwise(F.aggregate("all", F.lit(0), lambda acc, e: acc + e["n"])).alias("n_tiles"),
        F.array_max(F.transform("all", count)).alias("most"), others.alias("cands"),
    )


def judged(first: DataFrame, known: DataFrame, p) -> DataFrame:
    """(read_id, stage, verdict, chosen, own, stands) for each read and stage of its tile; tiles without any stage are left out.

    Verdicts: trusted, only-tile, unchanged, corrected, rejected; chosen is null if rejected. stands: the tile is frequent
    enough and none is more frequent.
    """
    each = first.join(known, ["h0", "t0"])
    g0, low = F.col("g0"), F.col("low")
    enough = F.floor(g0 / F.lit(p.ratio))
    alt = F.filter("cands", lambda e: (e["n"] >= enough) & (e["diff"].bitwiseAND(low) != 0))
    picked = each.withColumn("pick", F.when(g0 >= p.min_count, alt).otherwise(F.col("cands")))
    n = F.aggregate("pick", F.lit(0), lambda acc, e: acc + e["weight"])
    verdict = (
        F.when(g0 >= p.trusted_count, "trusted")
        .when(F.col("n_tiles") == 1, F.when((g0 >= p.min_count) & (low == 0), "only-tile").otherwise("rejected"))
        .when((n == 0) & (g0 >= p.min_count), "unchanged").when(n == 1, "corrected").otherwise("rejected")
    )
    own = tiling.tile_key(F.col("h0"), F.col("t0"), p.step)
    out = picked.withColumn("verdict", verdict)
    chosen = F.when(F.col("verdict") == "corrected", F.get("pick", F.lit(0))["tile_id"]).when(F.col("verdict") != "rejected", own)
    return out.select("read_id", "stage", "verdict", chosen.alias("chosen"), own.alias("own"), ((g0 >= p.min_count) & (F.col("most") <= g0)).alias("stands"))


def _phase(first: DataFrame, kmers: DataFrame, tiles: DataFrame, p, which: list[int]) -> DataFrame:
    d = p.max_distance
    rounds = max(0, max(which) - d), min(d, max(which))
    found = candidates(first.select("h0", "t0").distinct(), kmers, tiles, p, rounds)
    return judged(first, stages(found, p, which), p)


def search(first: DataFrame, kmers: DataFrame, tiles: DataFrame, p, ready=None) -> DataFrame:
    """(read_id, stage, chosen, own) of each first tile: the first stage that settles it and what it chooses.

    Stage 2 d + 1: none does, and of the last one's tiles none is more frequent than the tile as read.
    Stage -1, chosen -1: it stays unsettled. From distance 2 on heads grow only for reads that the
    stages of tails leave unsettled. ``ready``: a ``Corrector`` of both spectra; where these fit into the workers, each read
    goes through its stages there and no candidate becomes a row.
    """
    if ready is not None and not ready.routed:
        return ready.search_tiles(first)
    d = p.max_distance
    best = lambda df: df.where("chosen IS NOT NULL").groupBy("read_id").agg(F.min(F.struct("stage", "chosen")).alias("d"))
    if d < 2:
        last = _phase(first, kmers, tiles, p, list(range(2 * d + 1)))
        done = last
    else:
        early = best(_phase(first, kmers, tiles, p, list(range(d + 1))))
        left = first.join(early, "read_id", "left_anti")
        last = _phase(left, kmers, tiles, p, list(range(d + 1, 2 * d + 1)))
        done = last
    settled = done.groupBy("read_id").agg(
        F.min(F.when(F.col("chosen").isNotNull(), F.struct("stage", "chosen"))).alias("d"), F.bool_or((F.col("stage") == 2 * d) & F.col("stands")).alias("stands")
    )
    if d >= 2:
        settled = settled.unionAll(early.select("read_id", "d", F.lit(False)))
    out = first.select("read_id", tiling.tile_key(F.col("h0"), F.col("t0"), p.step).alias("own")).join(settled, "read_id", "left")
    stage = F.coalesce("d.stage", F.when(F.col("stands"), 2 * d + 1), F.lit(-1))
    chosen = F.coalesce("d.chosen", F.when(F.col("stands"), F.col("own")), F.lit(-1).cast("long"))
    return out.select("read_id", stage.alias("stage"), chosen.alias("chosen"), "own")
