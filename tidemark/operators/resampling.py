"""Resampling of study cells as array aggregates: replicates are columns of an array inside a task, and only arrays or the rows near a cut are shuffled.

A row has one hash h; its draw in replicate r is (a_r h + b_r) mod 2^31 - 1, with a_r and b_r from the seed and r, so SQL can repeat every draw. Rows are
aggregated in base cells (asset, horizon, side, whether they begin a regime); result cells (level, population, horizon) are sums of base cells, so no row is doubled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.digests import Endings
from tidemark.session import ship, staged

PRIME = (1 << 31) - 1
#: Cumulative probabilities of a Poisson variable of mean 1 (fixed values): weight k where the draw lies below the k-th and not below the one before.
POISSON = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885]
#: Rows whose draws are expanded together (with 1,000 replicates half a megabyte, which a core's cache holds); standard deviations around the expected cut within which rows are ranked, the next where a cut falls outside.
ROWS, AROUND = 64, (6.0, 12.0, float("inf"))
BASE = ["asset", "horizon", "treated", "starts"]
CELL = ["level", "population", "horizon"]


def number(*parts) -> int:
    """The first eight hex digits of the MD5 of the parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def multipliers(seed: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """a_r (not 0) and b_r of every replicate."""
    a = [1 + number(seed, "a", r) % (PRIME - 1) for r in range(replicates)]
    return np.array(a, np.uint64), np.array([number(seed, "b", r) % PRIME for r in range(replicates)], np.uint64)


def hashed(seed: int, id_col: str = "id") -> Column:
    """h of a row."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % PRIME


def cells(df: DataFrame, pooled: str = "POOLED") -> DataFrame:
    """Base cells as parts of result cells: each for its asset and for all, by observation and, but for treated rows within a regime, by regime."""
    both = F.array(F.lit("observation"), F.lit("regime"))
    levels = F.when(F.col("treated") & ~F.col("starts"), F.array(F.lit("observation"))).otherwise(both)
    return df.withColumn("level", F.explode(levels)).withColumn("population", F.explode(F.array(F.col("asset"), F.lit(pooled)))).drop("asset", "starts")


def rows_of(outcomes: DataFrame, seed: int, value: str = "outcome") -> DataFrame:
    """Base keys, id, _v, _h of the rows with an outcome, written once for the scans that follow; a row whose asset or flag is unknown takes no part."""
    known = outcomes.where(F.col(value).isNotNull() & F.col("asset").isNotNull() & F.col("treated").isNotNull())
    return staged(known.select("asset", F.col("horizon").cast("int").alias("horizon"), "treated", F.coalesce("starts", F.lit(False)).alias("starts"), F.col("id").cast("bigint").alias("id"), F.col(value).cast("double").alias("_v"), hashed(seed).alias("_h")), "resampled")


def _draws(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows x replicates. PRIME is 2^31 - 1, so a remainder is what is left of adding the upper bits to the lower ones, twice."""
    x = h.astype(np.uint64)[:, None] * a
    x += b
    p, bits = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        high = x >> bits
        x &= p
        x += high
    x[x == p] = 0
    return x


def _parts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Blocks of at most ROWS rows of one base cell."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in BASE), strict=True))
        seen: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            seen.setdefault(k, []).append(i)
        columns = {c: np.asarray(batch.column(c)) for c in names}
        for key, at in seen.items():
            for i in range(0, len(at), ROWS):
                yield key, {c: v[at[i : i + ROWS]] for c, v in columns.items()}


def _key_columns(keys: list[tuple], times: int = 1) -> list[pa.Array]:
    kinds = (pa.string(), pa.int32(), pa.bool_(), pa.bool_())
    return [pa.array(c, k) for c, k in zip(zip(*(k for k in keys for _ in range(times)), strict=True), kinds, strict=True)]


def poisson_sums(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Base keys, w, wv: for each base cell of a task the Poisson(1) weights and weighted values of all replicates, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(seed, replicates)
        steps = np.ceil(np.array(POISSON) * PRIME).astype(np.uint64)  # u / PRIME >= p where u >= ceil(p PRIME)
        total: dict[tuple, np.ndarray] = {}
        for key, part in _parts(batches, ["_v", "_h"]):
            w = np.searchsorted(steps, _draws(part["_h"], a, b).ravel(), "right").reshape(-1, replicates)
            sums = total.setdefault(key, np.zeros((2, replicates)))
            sums += np.stack([np.ones(len(w)), part["_v"]]) @ w.astype(float)
        if total:
            lists = [pa.array([s[i].tolist() for s in total.values()], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.record_batch([*_key_columns(list(total)), *lists], names=[*BASE, "w", "wv"])

    return rows.mapInArrow(run, "asset string, horizon int, treated boolean, starts boolean, w array<double>, wv array<double>")


def bounds(means: DataFrame, keys: list[str]) -> DataFrame:
    """ci_low and ci_high of _d, one number for each replicate: those at int(.025 (B - 1)) and int(.975 (B - 1))."""
    ordered = means.where("_d IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list("_d")).alias("_all"))
    at = lambda p: F.element_at("_all", F.floor(p * (F.size("_all") - 1)).cast("int") + 1)
    return ordered.select(*keys, at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def bootstrap(outcomes: DataFrame, replicates: int = 1000, seed: int = 20260901, value: str = "outcome") -> DataFrame:
    """level, population, horizon, ci_low, ci_high of the mean difference in every cell of a study: a row counts Poisson(1) times in a replicate.

    outcomes: asset, horizon, treated, starts, id and the value. What is shuffled is one number for each task, base cell and replicate. A replicate that leaves a side
    without rows is left out; a cell without rows on both sides has no row.
    """
    ship(outcomes.sparkSession)
    sums = cells(poisson_sums(rows_of(outcomes, seed, value), replicates, seed))
    each = sums.select(*CELL, "treated", F.posexplode(F.arrays_zip("w", "wv")).alias("rep", "x")).groupBy(*CELL, "rep").agg(*(F.sum(F.when(F.col("treated") == side, F.col(f"x.{c}"))).alias(f"{c}{int(side)}") for side in (True, False) for c in ("w", "wv")))
    return bounds(each.withColumn("_d", F.try_divide("wv1", "w1") - F.try_divide("wv0", "w0")), CELL)


def moments(rows: DataFrame) -> DataFrame:
    """Counts and sums of base cells; those of any union of base cells are their sums."""
    return rows.groupBy(*BASE).agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"), F.count_if(F.col("_v") > 0).alias("positive"))


def effects(base: DataFrame) -> DataFrame:
    """Result cells from moments of base cells: n_treated, n_ordinary, mean_diff, p_positive_diff, standardized_diff; null unless both sides have two values."""
    side = lambda c, t: F.coalesce(F.sum(F.when(F.col("treated") == t, F.col(c))), F.lit(0))
    got = cells(base).groupBy(*CELL).agg(*(side(c, t).alias(f"{c}{int(t)}") for t in (True, False) for c in ("n", "s", "q", "positive")))
    for t in (1, 0):
        got = got.withColumn(f"m{t}", F.try_divide(f"s{t}", f"n{t}")).withColumn(f"v{t}", F.try_divide(f"q{t}", f"n{t}") - F.try_divide(f"s{t}", f"n{t}") ** 2)
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    mean = F.col("m1") - F.col("m0")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("v1") + F.col("v0")) / 2))
    share = F.try_divide("positive1", "n1") - F.try_divide("positive0", "n0")
    return got.select(*CELL, F.col("n1").alias("n_treated"), F.col("n0").alias("n_ordinary"), F.when(enough, mean).alias("mean_diff"), F.when(enough, share).alias("p_positive_diff"), F.when(enough, mean / F.greatest(F.lit(1e-12), spread)).alias("standardized_diff"))


def permutation(rows: DataFrame, base: DataFrame, replicates: int, seed: int) -> DataFrame:
    """level, population, horizon, p_value: (count(|diff*| >= |diff|) + 1) / (B + 1), where in a replicate the k rows of smallest (draw, id) play the k treated ones.

    The k-th of n draws lies near k / n of their range: rows clearly below it are summed in arrays, those within some standard deviations (a multiple of sqrt(n) for
    a replicate) are ranked. Should a cut fall outside, all is done again with a wider band.
    """
    counts = cells(base).groupBy(*CELL).agg(F.coalesce(F.sum(F.when(F.col("treated"), F.col("n"))), F.lit(0)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.coalesce(F.sum(F.when(F.col("treated"), F.col("s"))), F.lit(0.0)).alias("st"))
    tests = counts.where("k >= 2 AND n - k >= 2")
    sizes = tests.collect()  # one row for each cell of the study: levels x (assets + 1) x horizons
    for around in AROUND:
        drawn = staged(_permuted(rows, tests, sizes, replicates, seed, around), "permutations")
        if not drawn.where("missed").head(1):
            break
    return drawn.groupBy(*CELL).agg(((F.count_if(F.abs("d") >= F.abs("real") - 1e-12) + 1) / (replicates + 1)).alias("p_value"))


def _permuted(rows: DataFrame, tests: DataFrame, sizes: list, replicates: int, seed: int, around: float) -> DataFrame:
    """The cell, the mean difference d of each replicate, the real one, and whether the replicate's cut fell outside its band."""
    window = {}
    for c in sizes:
        q = c["k"] / c["n"]
        near = around * (q * (1 - q) / c["n"]) ** 0.5 + 2 / c["n"]
        window.setdefault((c["population"], c["horizon"]), []).append((c["level"], int(max(0.0, q - near) * PRIME), int(min(1.0, q + near) * PRIME) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(seed, replicates)
        below: dict[tuple, np.ndarray] = {}
        names = [*CELL, "rep", "u", "id", "c", "v"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            near: dict[tuple, list[tuple]] = {}
            for (asset, horizon, treated, starts), part in _parts([batch], ["_v", "_h", "id"]):
                u = _draws(part["_h"], a, b)
                one = np.stack([np.ones(len(u)), part["_v"]])
                for population in (asset, "POOLED"):
                    for level, low, high in window.get((population, horizon), ()):
                        if level == "regime" and treated and not starts:
                            continue
                        cell = (level, population, horizon)
                        sums = below.setdefault(cell, np.zeros((2, replicates)))
                        sums += one @ (u < np.uint64(low)).astype(float)
                        at = np.flatnonzero(u - np.uint64(low) < np.uint64(high - low))  # below low the difference wraps round
                        i, r = np.divmod(at, replicates)
                        near.setdefault(cell, []).append((r, u.ravel()[at], part["id"][i], part["_v"][i]))
            for (level, population, horizon), found in near.items():
                r, us, ids, v = (np.concatenate(c) for c in zip(*found, strict=True))
                n = len(r)
                yield pa.record_batch([pa.array([level] * n, kinds[0]), pa.array([population] * n, kinds[1]), pa.array(np.full(n, horizon, np.int32)), pa.array(r.astype(np.int32)), pa.array(us.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.nulls(n, kinds[6]), pa.array(v)], names=names)
        for (level, population, horizon), sums in below.items():
            yield pa.record_batch([pa.array([level] * replicates), pa.array([population] * replicates), pa.array(np.full(replicates, horizon, np.int32)), pa.array(np.arange(replicates, dtype=np.int32)), pa.nulls(replicates, kinds[4]), pa.nulls(replicates, kinds[5]), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=names)

    found = staged(rows.mapInArrow(run, "level string, population string, horizon int, rep int, u bigint, id bigint, c bigint, v double"), "permuted")
    return _cut(found, tests, CELL)


def _cut(found: DataFrame, tests: DataFrame, cell: list[str]) -> DataFrame:
    """The cell, d, real and missed (see _permuted) from counts and sums below each band (c, v) and the rows of the band (u, id, v), by cell and rep."""
    keys = [*cell, "rep"]
    low = found.where("u IS NULL").groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("v").alias("below"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("u", "id"))
    near = found.where("u IS NOT NULL").select(*keys, "u", "id", "v").withColumn("r", rank)
    known = low.join(F.broadcast(tests), cell)  # one row for each cell
    take = near.join(known.select(*keys, "c", "k"), keys).groupBy(*keys).agg(F.sum(F.when(F.col("r") + F.col("c") <= F.col("k"), F.col("v"))).alias("part"), F.count("*").alias("held"))
    got = known.join(take, keys, "left")
    missed = (F.col("c") > F.col("k")) | (F.col("c") + F.coalesce("held", F.lit(0)) < F.col("k"))
    top = F.col("below") + F.coalesce("part", F.lit(0.0))
    real = F.col("st") / F.col("k") - (F.col("s") - F.col("st")) / (F.col("n") - F.col("k"))
    d = top / F.col("k") - (F.col("s") - top) / (F.col("n") - F.col("k"))
    return got.select(*cell, d.alias("d"), real.alias("real"), missed.alias("missed"))


def study(outcomes: DataFrame, replicates: int = 1000, seed: int = 20260901, value: str = "outcome") -> DataFrame:
    """Every cell of a study with its effects and its permutation p-value (null unless both sides have two values)."""
    ship(outcomes.sparkSession)
    rows = rows_of(outcomes, seed, value)
    base = staged(moments(rows), "moments")
    return effects(base).join(permutation(rows, base, min(2000, replicates), seed), CELL, "left")


#: Rows whose digests are made together; values of a block that resamples pick from; bytes of the blocks that a task holds, about; tasks that share the replicates of these.
TOGETHER, PICKED, BUNDLE, SHARES = 1 << 15, 1 << 22, 1 << 26, 32


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def digest_permutation(rows: DataFrame, tests: DataFrame, replicates: int, seed: int) -> DataFrame:
    """_cell, hits: replicates with |diff*| >= |diff|, where the k rows of smallest (digest of seed, replicate and id; id) play the k treated ones.

    rows: _cell, id, _v; tests: _cell, k, n, s, st (rows and sums, of all and treated), a row for each cell. As in permutation(): a row's digests are made once for
    all its cells, rows clearly below a cut are summed where they are, those near it are ranked.
    """
    ship(rows.sparkSession)
    rows = staged(rows, "resampled")
    sizes = tests.collect()  # one row for each cell
    for around in AROUND:
        drawn = staged(_cut(staged(_digested(rows, sizes, replicates, seed, around), "permuted"), tests, ["_cell"]), "permutations")
        if not drawn.where("missed").head(1):
            break
    return drawn.groupBy("_cell").agg(F.count_if(F.abs("d") >= F.abs("real") - 1e-12).alias("hits"))


def _digested(rows: DataFrame, sizes: list, replicates: int, seed: int, around: float) -> DataFrame:
    numbers = np.array(sorted(c["_cell"] for c in sizes), np.int64)
    low, high = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    for c in sizes:
        q, i = c["k"] / c["n"], int(np.searchsorted(numbers, c["_cell"]))
        near = around * (q * (1 - q) / c["n"]) ** 0.5 + 2 / c["n"]
        low[i], high[i] = int(max(0.0, q - near) * 2**32), int(min(1.0, q + near) * 2**32) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_cell", "rep", "u", "id", "c", "v"]
        count, total = np.zeros((replicates, len(numbers)), np.int64), np.zeros((replicates, len(numbers)))
        for t in _gathered(batches, TOGETHER):
            ids, v = t["id"].combine_chunks(), t["_v"].to_numpy()
            own = ids.dictionary_encode("encode")
            whose = own.indices.to_numpy()
            cell = np.searchsorted(numbers, t["_cell"].to_numpy())
            draws, least, most = Endings([b"" if i is None else b"|%d" % i for i in own.dictionary.to_pylist()]), low[cell], high[cell]
            reps, us, at = [], [], []
            for r in range(replicates):
                u = draws.numbers(b"%d|%d" % (seed, r))[whose].astype(np.int64)
                under = np.flatnonzero(u < least)
                count[r] += np.bincount(cell[under], minlength=len(numbers))
                total[r] += np.bincount(cell[under], v[under], len(numbers))
                near = np.flatnonzero((u >= least) & (u < most))
                reps.append(np.full(len(near), r, np.int32))
                us.append(u[near])
                at.append(near)
            at, n = np.concatenate(at), sum(map(len, at))
            yield pa.record_batch([pa.array(numbers[cell[at]]), pa.array(np.concatenate(reps)), pa.array(np.concatenate(us)), ids.take(pa.array(at)), pa.nulls(n, pa.int64()), pa.array(v[at])], names=names)
        n = count.size
        yield pa.record_batch([pa.array(np.tile(numbers, replicates)), pa.array(np.repeat(np.arange(replicates, dtype=np.int32), len(numbers))), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(count.ravel()), pa.array(total.ravel())], names=names)

    return rows.mapInArrow(run, "_cell bigint, rep int, u bigint, id bigint, c bigint, v double")


def _coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, and the number of each one among them in as few bytes as they need."""
    values, codes = np.unique(v, return_inverse=True)
    return values, codes.astype("<u2" if len(values) <= 1 << 16 else "<u4")


def _joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and codes of several blocks as those of one."""
    if len(blocks) == 1:
        return blocks[0]
    values = np.unique(np.concatenate([v for v, _ in blocks]))
    kind = "<u2" if len(values) <= 1 << 16 else "<u4"
    return values, np.concatenate([np.searchsorted(values, v).astype(kind)[c] for v, c in blocks])


def digest_bootstrap(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """_g, ci_low, ci_high of the mean difference over resamples of each side: the i-th pick of a replicate is the row whose number is the digest of seed, replicate, side
    and i, modulo the rows of the side. rows: _g, _side (1 or 0), _i (number from 0 within both), _v.

    Values are cut into blocks of PICKED and kept as numbers of their different values, two bytes each where these are few. A task holds about BUNDLE bytes of blocks of one side, of one group or
    many, makes the digests of some replicates once for all of them and sums the picks that fall into its blocks: no pick is shuffled and no task holds more. Digests are made again for every bundle.
    """
    ship(rows.sparkSession)
    rows = staged(rows.where("_side IS NOT NULL").select("_g", "_side", F.col("_i").cast("bigint").alias("_i"), F.col("_v").cast("double").alias("_v")), "resampled")
    sizes = staged(rows.groupBy("_g", "_side").agg(F.count("*").alias("n")), "sizes")
    kind = dict(rows.dtypes)["_g"]

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        values, codes = _coded(t["_v"].to_numpy())
        held = [pa.array([values], pa.list_(pa.float64())), pa.array([codes.tobytes()], pa.binary()), pa.array([codes.itemsize], pa.int32()), pa.array([codes.nbytes + values.nbytes], pa.int64())]
        return pa.table([t["_g"][:1].combine_chunks(), t["_side"][:1].combine_chunks(), t["_i"][:1].combine_chunks(), *held], names=["_g", "_side", "at", "v", "codes", "width", "bytes"])

    blocks = staged(rows.groupBy("_g", "_side", F.floor(F.col("_i") / PICKED).alias("_b")).applyInArrow(block, f"_g {kind}, _side int, at bigint, v array<double>, codes binary, width int, bytes bigint"), "blocks")

    def run(t: pa.Table) -> pa.Table:
        side, share = t["_side"][0].as_py(), t["share"][0].as_py()
        reps = range(share, replicates, SHARES)
        of: dict[str, list[int]] = {}  # rows of each group, in order: a bundle has a stretch of its blocks
        for k in np.argsort(t["at"].to_numpy(), kind="stable").tolist():
            of.setdefault(repr(t["_g"][k].as_py()), []).append(k)
        held = []
        for own in of.values():
            values, codes = _joined([(np.asarray(t["v"][k].values), np.frombuffer(t["codes"][k].as_buffer(), f"<u{t['width'][k].as_py()}")) for k in own])
            held.append((t["n"][own[0]].as_py(), t["at"][own[0]].as_py(), values, codes))
        sums, most = np.zeros((len(held), len(reps))), max(n for n, *_ in held)
        for start in range(0, most, TOGETHER):
            draws = Endings.counting(b"|%d|" % side, start, min(most, start + TOGETHER))
            for j, r in enumerate(reps):
                u = draws.numbers(b"%d|%d" % (seed, r))
                for x, (n, at, values, codes) in enumerate(held):
                    if n > start:
                        pick = u[: n - start]
                        pick = (pick - pick // np.uint32(n) * np.uint32(n) if n < 1 << 32 else pick).astype(np.int64) - at
                        sums[x, j] += values[codes[pick[(pick >= 0) & (pick < len(codes))] if len(codes) < n else pick]].sum()
        size = np.array([n for n, *_ in held])
        which = np.repeat([own[0] for own in of.values()], len(reps))
        times = len(held)
        return pa.table([t["_g"].combine_chunks().take(pa.array(which)), pa.array(np.full(len(which), side, np.int32)), pa.array(np.tile(np.array(reps, np.int32), times)), pa.array((sums / size[:, None]).ravel())], names=["_g", "_side", "rep", "part"])

    # One row for each block. Groups of about one size come together, as digests are made up to the largest.
    before = Window.partitionBy("_side").orderBy(F.col("n").desc(), "_g", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("_g", "_side", "at", "bytes").join(sizes, ["_g", "_side"]).withColumn("bundle", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / BUNDLE))
    placed = staged(placed.select("_g", "_side", "at", "n", "bundle"), "bundles")
    shared = blocks.join(F.broadcast(placed), ["_g", "_side", "at"]).withColumn("share", F.explode(F.array(*map(F.lit, range(min(SHARES, replicates))))))
    keys = ["_side", "bundle", "share"]
    tasks = placed.select("_side", "bundle").distinct().count() * SHARES
    work = shared.repartition(max(1, min(1000, 2 * tasks)), *keys).groupBy(*keys)
    parts = work.applyInArrow(run, f"_g {kind}, _side int, rep int, part double")
    mean = lambda side: F.sum(F.when(F.col("_side") == side, F.col("part")))
    return bounds(staged(parts, "parts").groupBy("_g", "rep").agg((mean(1) - mean(0)).alias("_d")), ["_g"])


def histogram_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame, value: str = "_v", cells: int = 4096) -> DataFrame:
    """wanted (keys, name, rank from 0) with the value at that place in the order of its key: exact, and no key is sorted or gathered.

    The range of a key is cut into equal cells; only counts are shuffled to find the cell of a rank, and its values are cut again over their own range. Then the
    different values of one small cell are counted and put in order. rows are scanned three times (ends, counts, the rows of the cells found, which are written), so they are best a written table.
    """
    now, wanted = rows.select(*keys, F.col(value).alias("_v")), wanted.select(*keys, "name", "rank")
    part: list[str] = []
    for step in ("_c1", "_c2"):
        own = [*keys, *part]
        # Written, so that Spark knows its size: it is broadcast below the session's threshold and joined by key beyond it.
        ends = staged(now.groupBy(*own).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "ends")
        at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells))).otherwise(0)
        now = now.join(ends, own).withColumn(step, at.cast("int")).drop("_lo", "_hi")
        counts = now.groupBy(*own, step).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*own).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        places = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        wanted = staged(wanted.join(places, own).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))).withColumn("rank", F.col("rank") - F.col("_before")).drop("_n", "_before"), "ranks")
        part.append(step)
        now = now.join(wanted.select(*keys, *part).distinct(), [*keys, *part], "left_semi")
        if step == "_c1":
            now = staged(now, "near")
    own = [*keys, *part]
    values = now.groupBy(*own, "_v").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return wanted.join(placed, own).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))).select(*keys, "name", F.col("_v").alias("value"))


def ranked_values(rows: DataFrame, ranks: DataFrame, names: list[str]) -> DataFrame:
    """_g and a column for each name: the value of `rows` (_g, _v; a written table) at the rank of that name, from `ranks` (_g and a rank for each name; null: none)."""
    wanted = ranks.select("_g", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("rank")) for n in names))).alias("_w")).select("_g", "_w.*").where("rank >= 0")
    found = histogram_ranks(rows, ["_g"], wanted)
    return found.groupBy("_g").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def verdict(tests: DataFrame, controls: DataFrame, coverage: DataFrame, least: int = 12, least_regimes: int = 5, alpha: float = 0.05, primary: int = 24, pooled: str = "POOLED") -> DataFrame:
    """One row: the study's disposition with what it rests on, from tests of every cell (see study), controls (shuffled_diff) and coverage (asset, eligible, covered).

    Assets with eligible events but no receipt, too few observations or regimes: DATA_INSUFFICIENT. Significant by observation but not by regime:
    INCONCLUSIVE. Then SUPPORTED (significant, and the shuffled effect smaller), REJECTED (not significant) or INCONCLUSIVE.
    """
    head = (F.col("population") == pooled) & (F.col("horizon") == primary)
    pick = lambda level, c: F.max(F.when(head & (F.col("level") == level), F.col(c)))
    one = tests.agg(pick("observation", "n_treated").alias("n_treated"), pick("regime", "n_treated").alias("n_regimes"), pick("observation", "p_value").alias("p_observation"), pick("regime", "p_value").alias("p_regime"), pick("observation", "mean_diff").alias("mean_diff"))
    bare = coverage.agg(F.coalesce(F.max(((F.col("eligible") > 0) & (F.col("covered") == 0)).cast("int")), F.lit(0)).alias("bare"))
    shuffled = controls.agg(F.max("shuffled_diff").alias("shuffled_diff"))
    got = one.crossJoin(bare).crossJoin(shuffled)  # one row by one row
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    pseudo = (F.coalesce("p_observation", F.lit(1.0)) < alpha) & (F.coalesce("p_regime", F.lit(1.0)) >= alpha)
    supported = (F.col("p_observation") < alpha) & (F.abs("mean_diff") > 0) & (F.abs(F.coalesce("shuffled_diff", F.lit(0.0))) < F.abs("mean_diff"))
    said = F.when((F.col("bare") == 1) | (count("n_treated") < least) | (count("n_regimes") < least_regimes), "DATA_INSUFFICIENT").when(pseudo, "INCONCLUSIVE").when(F.col("p_observation").isNull() | F.col("mean_diff").isNull(), "DATA_INSUFFICIENT").when(supported, "SUPPORTED").when(F.col("p_observation") >= alpha, "REJECTED").otherwise("INCONCLUSIVE")
    return got.select("n_treated", "n_regimes", "p_observation", "p_regime", "mean_diff", "shuffled_diff", pseudo.alias("pseudo"), said.alias("disposition"))
