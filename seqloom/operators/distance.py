"""Identity-by-state distances between taxa, by pairs of taxa or by tiles of taxa and blocks of sites."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.genotypes import with_site_index
from seqloom.operators.tables import with_row_number
from seqloom.plans.session import join_sized, write_table

KINDS = ("grid", "rows")

#: Taxa of a tile, sites of a block, sites that two tiles are compared over in a task, and rows of a stripe of sums.
TILE, SITES_PER_BLOCK, SITES_PER_TASK, STRIPE = 512, 4096, 1 << 16, 16


def _cell_distance(x: Column, y: Column, kind: str) -> Column:
    """Grid: share of differing phases over all four pairs of phases, so two heterozygotes differ by 1/2. Rows: |x - y| / 2."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return (x * (2 - y) + y * (2 - x)) / 4 if kind == "grid" else F.abs(x - y) / 2


def ibs(gt: DataFrame, t1: str, t2: str, sites: DataFrame | None = None, kind: str = "grid") -> DataFrame:
    """Mean distance of two taxa over sites where both are called, all or those of ``sites``: (taxon1, taxon2, n, dxy)."""
    rows = gt.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi") if sites is not None else gt
    x = F.max(F.when(F.col("taxon") == t1, F.col("a1") + F.col("a2")))
    y = F.max(F.when(F.col("taxon") == t2, F.col("a1") + F.col("a2")))
    both = rows.where(F.col("taxon").isin(t1, t2)).groupBy("chrom", "pos").agg(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    distance = F.round(F.avg(_cell_distance(F.col("x"), F.col("y"), kind)), 6)
    return both.agg(F.count("*").alias("n"), distance.alias("dxy")).select(F.lit(t1).alias("taxon1"), F.lit(t2).alias("taxon2"), "n", "dxy")


def ibs_matrix(gt: DataFrame, kind: str = "grid", max_sites: int | None = None, sites: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Distances of all pairs of taxa in both orders, 0 on the diagonal: (taxon1, taxon2, n, dxy).

    Taxa are numbered and cut into tiles, sites into blocks. The cells of a
    tile and a block become a matrix, one byte a cell; two tiles meet for a
    number of blocks at a time in a task, which adds up whole-number products
    of their indicator matrices of 0, 1 and 2. Its sums leave it as stripes of
    rows, which are added over the blocks. So no task holds more than two
    tiles' cells of SITES_PER_TASK sites and a tile by a tile of sums, and a
    matrix is copied once for each tile, not for each taxon. ``sites`` (chrom,
    pos), such as an interval or a list, limits the sites; with ``max_sites``
    every floor(sites / max_sites)-th site is taken, at most that many. Pairs
    without a common site have n 0 and a null distance. A taxon with several
    rows at a site counts once, with its greatest dosage.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    every = gt if sites is None else gt.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    rows = every.where("a1 IS NOT NULL AND a2 IS NOT NULL")
    if max_sites:
        index = with_site_index(every.select("chrom", "pos").distinct())
        step = max(1, index.count() // max_sites)
        chosen = index.where((F.col("idx") % step == 0) & (F.col("idx") / step < max_sites)).select("chrom", "pos")
        rows = rows.join(chosen, ["chrom", "pos"], "left_semi")
    taxa = write_table(with_row_number(gt.select("taxon").distinct(), "taxon").withColumn("i", F.col("row") - 1).drop("row"), "distance-taxa")
    size = taxa.count()
    tile = max(1, min(tile, size))
    tiles = max(1, -(-size // tile))
    n_sites = rows.select("chrom", "pos").distinct().count()
    blocks = max(1, -(-n_sites // SITES_PER_BLOCK))
    block = F.pmod(F.xxhash64("chrom", "pos"), F.lit(blocks)).cast("int").alias("block")
    cells = join_sized(rows, taxa, ["taxon"], "inner").select(
        block, F.floor(F.col("i") / tile).cast("int").alias("tile"), "chrom", "pos", (F.col("i") % tile).cast("int").alias("i"), (F.col("a1") + F.col("a2")).cast("int").alias("dosage")
    )
    matrices = cells.groupBy("block", "tile").applyInArrow(_matrix(tile), "block int, tile int, chroms binary, poss binary, cells binary")
    parts = max(1, -(-blocks * SITES_PER_BLOCK // SITES_PER_TASK))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    pairs = matrices.withColumn("other", other).select(
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("block") % parts).alias("part"), "block", "tile", "chroms", "poss", "cells"
    )
    sums = pairs.groupBy("low", "high", "part").applyInArrow(_products(tile, kind == "grid"), "low int, high int, stripe int, far binary, many binary")
    added = sums.groupBy("low", "high", "stripe").applyInArrow(_added(tile), "low int, high int, i int, far array<bigint>, many array<bigint>")
    added = write_table(added, "distance-sums")
    each = taxa.select("i", F.col("taxon").alias("taxon1"), F.floor(F.col("i") / tile).cast("int").alias("low"), (F.col("i") % tile).cast("int").alias("at"))
    asked = each.withColumn("high", F.explode(F.sequence(F.col("low"), F.lit(tiles - 1))))
    found = asked.join(added.withColumnRenamed("i", "at"), ["low", "high", "at"], "left")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), tile)
    cell = F.posexplode(F.arrays_zip(F.coalesce("far", zeros).alias("far"), F.coalesce("many", zeros).alias("many")))
    wide = found.select("taxon1", "i", "low", "high", cell.alias("at", "c")).select("taxon1", "i", (F.col("high") * tile + F.col("at")).cast("bigint").alias("j"), "low", "high", "c.far", "c.many")
    second = taxa.select(F.col("i").alias("j"), F.col("taxon").alias("taxon2"))
    named = join_sized(wide, second, ["j"], "inner")
    both = F.when(F.col("low") < F.col("high"), F.array(F.struct("taxon1", "taxon2"), F.struct(F.col("taxon2").alias("taxon1"), F.col("taxon1").alias("taxon2")))).otherwise(F.array(F.struct("taxon1", "taxon2")))
    turned = named.select(F.explode(both).alias("t"), "far", "many").select("t.*", "far", "many")
    distance = F.when(F.col("taxon1") == F.col("taxon2"), F.lit(0.0)).otherwise(F.round(F.try_divide(F.col("far") / 2, "many"), 6))
    return turned.select("taxon1", "taxon2", F.col("many").alias("n"), distance.alias("dxy"))


def _matrix(tile: int):
    """Cells of a tile of taxa and a block of sites as bytes, sites by taxa, 255 where none was called; and its sites."""

    def run(table: pa.Table) -> pa.Table:
        chrom, pos, i, dosage = (table[c].to_numpy() for c in ("chrom", "pos", "i", "dosage"))
        order = np.lexsort((pos, chrom))
        new = np.concatenate(([True], (np.diff(chrom[order]) != 0) | (np.diff(pos[order]) != 0)))
        row = np.empty(len(pos), np.int64)
        row[order] = np.cumsum(new) - 1
        cells = np.full((int(new.sum()), tile), -1, np.int8)
        np.maximum.at(cells, (row, i), dosage.astype(np.int8))
        sites = order[new]
        return pa.table(
            {
                "block": table["block"][:1], "tile": table["tile"][:1], "chroms": pa.array([chrom[sites].astype(np.int64).tobytes()]),
                "poss": pa.array([pos[sites].astype(np.int64).tobytes()]), "cells": pa.array([cells.tobytes()]),
            }
        )

    return run


def _products(tile: int, grid: bool):
    """Twice the sum of distances, and the number of sites, of all taxa of one tile and those of another, in stripes of rows."""

    def run(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        far, many = np.zeros((tile, tile), np.int64), np.zeros((tile, tile), np.int64)
        by_block: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for block, own, chroms, poss, cells in zip(*(table[c].to_pylist() for c in ("block", "tile", "chroms", "poss", "cells")), strict=True):
            sites = np.stack((np.frombuffer(chroms, np.int64), np.frombuffer(poss, np.int64)), axis=1)
            by_block.setdefault(block, {})[own] = (sites, np.frombuffer(cells, np.int8).reshape(-1, tile))
        for found in by_block.values():
            if low not in found or high not in found:
                continue
            (sites_a, a), (sites_b, b) = found[low], found[high]
            if low != high:
                both = np.concatenate((sites_a, sites_b))
                _, number = np.unique(both, axis=0, return_inverse=True)
                number = number.ravel()
                _, at_a, at_b = np.intersect1d(number[: len(sites_a)], number[len(sites_a) :], assume_unique=True, return_indices=True)
                a, b = a[at_a], b[at_b]
            for first in range(0, len(a), SITES_PER_BLOCK):  # products of float32 hold whole numbers up to 2^24
                x, y = ([(m[first : first + SITES_PER_BLOCK] == v).astype(np.float32) for v in (0, 1, 2)] for m in (a, b))
                many += (sum(x).T @ sum(y)).astype(np.int64)
                middle = y[0] + y[2] + y[1] if grid else y[0] + y[2]
                far += (x[0].T @ (y[1] + 2 * y[2]) + x[1].T @ middle + x[2].T @ (y[1] + 2 * y[0])).astype(np.int64)
        stripes = range(0, tile, STRIPE)
        return pa.table(
            {
                "low": pa.array([low] * len(stripes), pa.int32()), "high": pa.array([high] * len(stripes), pa.int32()), "stripe": pa.array([s // STRIPE for s in stripes], pa.int32()),
                "far": pa.array([far[s : s + STRIPE].tobytes() for s in stripes]), "many": pa.array([many[s : s + STRIPE].tobytes() for s in stripes]),
            }
        )

    return run


def _added(tile: int):
    """The sums of a stripe over all blocks, a row a taxon."""

    def run(table: pa.Table) -> pa.Table:
        far, many = (np.sum([np.frombuffer(x, np.int64) for x in table[c].to_pylist()], axis=0).reshape(-1, tile) for c in ("far", "many"))
        rows, longs = len(far), pa.list_(pa.int64())
        first = table["stripe"][0].as_py() * STRIPE
        return pa.table(
            {
                "low": pa.repeat(table["low"][0], rows), "high": pa.repeat(table["high"][0], rows), "i": pa.array(np.arange(first, first + rows), pa.int32()),
                "far": pa.array(list(far), longs), "many": pa.array(list(many), longs),
            }
        )

    return run


def divergence_table(matrix: DataFrame) -> DataFrame:
    """A row a taxon with its distances to all taxa in order of name as text of 3 decimals, joined by tabs."""
    cell = F.struct("taxon2", F.format_string("%.3f", "dxy").alias("text"))
    return matrix.groupBy(F.col("taxon1").alias("Dxy")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"]), "\t").alias("distances")
    )
