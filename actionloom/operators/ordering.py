"""Exact ranks and order statistics without a global sort in one task.

Three ways, by what is known about the values:

* hashes are uniform, so their leading digits are equal slices of the rows;
* numbers are taken digit by digit: counts of coarse magnitudes tell which of them a
  wanted rank falls into, then counts of 16 bits at a time lead to the value itself;
* distinct values of any kind are range-partitioned and written out once, and the
  position inside a partition is shifted by the rows of the partitions before it.
"""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actionloom.session import discard, stored

#: The least double that is not subnormal.
_LEAST_NORMAL = 2.0 ** -1022


def hash_order(id_column: str | Sequence[str], seed: int) -> Column:
    """A reproducible pseudo-random sort key for a unique id, of one column or several.

    Missing ids take part like any other value. Rows with equal ids have equal keys, so
    they are kept or dropped together and a size is exact up to such repeats.
    """
    columns = [id_column] if isinstance(id_column, str) else list(id_column)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("\x1f", F.concat(F.lit(f"{seed}:"), parts[0]), *parts[1:]))


def _leading(hashed: Column, digits: int) -> Column:
    return F.substring(hashed, 1, digits)


def hash_cutoffs(df: DataFrame, by: Sequence[str], id_column: str | Sequence[str], seed: int,
                 ranks: Mapping[str, Column], digits: int = 4) -> DataFrame:
    """Per group of ``by``: the hash standing at each wanted rank.

    ``ranks`` maps an output name to a rank written in terms of the column ``n``, the
    group's row count; rank 0 gives the empty string, which lies below every hash. Keep a
    row when its hash is at most the cut-off. Meant for few groups: the rows themselves
    are never shuffled, only ``16**digits`` counts per group and the rows of the slices
    that hold a wanted rank.
    """
    hashed = df.select(*by, hash_order(id_column, seed).alias("_hash")).withColumn(
        "_slice", _leading(F.col("_hash"), digits)
    )
    counts = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    upto = F.sum("_n").over(group.orderBy("_slice"))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()
    ])
    # At most 16**digits rows per group, whatever the size of the log.
    slices = (
        counts.withColumn("n", F.sum("_n").over(group)).withColumn("_upto", upto)
        .select(*by, "_slice", "n", "_n", "_upto", F.inline(wanted))
    )
    holds = (F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto"))
    holders = slices.filter(holds).select(
        *by, "_slice", "_name", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_place")
    )
    inside = W.partitionBy(*by, "_slice").orderBy("_hash")
    slices_wanted = holders.groupBy(*by, "_slice").agg(
        F.collect_set(F.struct("_name", "_place")).alias("_wanted")
    )
    if not by:
        # At most one slice per wanted rank, so the rows are filtered where they are.
        slices_wanted = F.broadcast(slices_wanted)
    marked = hashed.join(slices_wanted, [*by, "_slice"]).withColumn("_place_here", F.row_number().over(inside))
    found = marked.select(
        *by, "_hash", "_place_here", F.inline("_wanted")
    ).filter(F.col("_place") == F.col("_place_here"))
    cut = lambda name: F.coalesce(F.max(F.when(F.col("_name") == name, F.col("_hash"))), F.lit(""))
    groups = slices.select(*by).distinct() if by else None
    found = found.select(*by, "_name", "_hash")
    if groups is not None:
        # Groups in which every rank is 0 must appear as well.
        found = found.unionByName(groups, allowMissingColumns=True)
    return found.groupBy(*by).agg(*[cut(name).alias(name) for name in ranks])


def sliced_rank(df: DataFrame, by: Sequence[str], id_column: str, seed: int, rank: str = "rank",
                size: str = "group_size", digits: int = 4) -> DataFrame:
    """Add the exact rank of every row's hash within ``by``, and the group's size.

    For many groups, any of which may be huge: a window covers one hash slice of one
    group, and the slices of a group, ``16**digits`` at most, are added up apart.
    """
    hashed = df.withColumn("_hash", hash_order(id_column, seed)).withColumn(
        "_slice", _leading(F.col("_hash"), digits)
    )
    counts = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*by)
    lower = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_slice",
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias(size),
    )
    inside = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_hash"))
    matches = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "_slice"]]
    condition = matches[0]
    for m in matches[1:]:
        condition = condition & m
    return (
        hashed.withColumn("_inside", inside).alias("r")
        .join(offsets.alias("o"), condition)
        .select("r.*", "o._offset", f"o.{size}")
        .withColumn(rank, F.col("_offset") + F.col("_inside"))
        .drop("_hash", "_slice", "_inside", "_offset")
    )


def range_slices(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Range-partition distinct rows by ``columns`` and number the ranges in ``name``.

    The result is written to the checkpoint folder, since the numbers have to be the same
    wherever they are used.
    """
    return stored(df.repartitionByRange(*columns).withColumn(name, F.spark_partition_id()))


def ordered_codes(values: DataFrame, column: str, code: str = "code") -> DataFrame:
    """(column, code): the distinct non-null values numbered from 0 in ascending order."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    sliced = range_slices(distinct, [column], "_slice")
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the range exchange.
    lower = W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(column))
    return (
        sliced.withColumn("_inside", inside)
        .join(offsets, "_slice")
        .select(column, (F.col("_offset") + F.col("_inside") - 1).cast("long").alias(code))
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ordered_image(df: DataFrame, value: str = "value", image: str = "image") -> DataFrame:
    """Replace a double by its bits as a long that is ordered as the double is.

    Exponent and fraction are taken apart by exact scalings with powers of two; the logarithm
    may miss the exponent by one, which a comparison mends. Zeros of both signs are equal, and
    NaN must not occur.
    """
    others = [c for c in df.columns if c != value]
    size, normal = f"abs({value})", f"abs({value}) >= {_LEAST_NORMAL!r}D AND abs({value}) < double('Infinity')"
    staged = df.selectExpr(*others, value, f"CASE WHEN {normal} THEN {size} ELSE 1D END AS _size").selectExpr(
        "*", "cast(least(greatest(floor(log2(_size)), -1022L), 1023L) AS int) AS _guess").selectExpr(
        "*", "_size / power(2D, _guess) AS _scaled").selectExpr(
        "*", "_guess + CASE WHEN _scaled >= 2D THEN 1 WHEN _scaled < 1D THEN -1 ELSE 0 END AS _power").selectExpr(
        "*", "cast((_size / power(2D, _power) - 1D) * power(2D, 52D) AS bigint) AS _fraction",
        f"cast(least({size}, {_LEAST_NORMAL!r}D) * power(2D, 537D) * power(2D, 537D) AS bigint) AS _subnormal")
    bits = (
        f"CASE WHEN {size} = double('Infinity') THEN {2047 << 52}L WHEN {size} < {_LEAST_NORMAL!r}D THEN _subnormal"
        " ELSE shiftleft(cast(_power + 1023 AS bigint), 52) + _fraction END")
    return staged.selectExpr(*others, value, f"{bits} AS _bits").selectExpr(
        *others, f"CASE WHEN {value} < 0D THEN -1L - _bits ELSE _bits END AS {image}")


def _of_image(image: int) -> float:
    """The double with that image."""
    size = struct.unpack("<d", struct.pack("<q", image if image >= 0 else -1 - image))[0]
    return size if image >= 0 else -size


#: Parts of a factor of two that values are first told apart by, and more than the least exponent.
_PARTS, _EXPONENTS = 16, 1100
_MOST = _PARTS * _EXPONENTS


def _magnitude(value: str) -> str:
    """SQL for a small integer that never falls while the value grows: sign and coarse logarithm."""
    size = f"least(cast(floor(log2(abs({value})) * {_PARTS}) AS bigint), {_MOST}L) + {_MOST}L"
    return f"CASE WHEN {value} = 0D THEN 0L WHEN {value} < 0D THEN -1L - ({size}) ELSE 1L + ({size}) END"


def _digit(level: int) -> Column:
    """The first ``level`` digits of 16 bits of an image, as a signed number."""
    return F.shiftright("image", 64 - 16 * level) if level else F.lit(0).cast("long")


def exact_quantiles(df: DataFrame, columns: Sequence[str],
                    shares: Mapping[str, float]) -> dict[str, dict[str, float | None]]:
    """Per column and named share: the linearly interpolated quantile, exact.

    Radix selection. Counts of signs and coarse logarithms tell the magnitude that a wanted rank
    falls into. The values of these magnitudes are stored with their counts, as 64-bit numbers
    of the same order, and counts of 16 bits at a time lead to the value itself. The input is
    read twice. Nothing is sorted or sketched, a hot value is one row, and a window runs over
    some 65,536 counts at most. Like any fit it runs at once; the wanted numbers and their
    places reach the driver.
    """
    entries = ", ".join(
        f"struct({i} AS `column`, cast({_quoted(c)} AS double) AS value)" for i, c in enumerate(columns))
    values = df.select(F.expr(f"inline(array({entries}))")).filter("value IS NOT NULL AND NOT isnan(value)")
    values = values.withColumn("magnitude", F.expr(_magnitude("value")))
    quantiles: dict[str, dict[str, float | None]] = {c: dict.fromkeys(shares) for c in columns}

    by_column = W.partitionBy("column")
    places = values.groupBy("column", "magnitude").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "upto": F.sum("n").over(by_column.orderBy("magnitude")), "rows": F.sum("n").over(by_column)})
    position = lambda p: (F.col("rows") - 1) * F.lit(float(p))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(edge).alias("edge"),
                 (position(p) - F.floor(position(p))).alias("fraction"), (rank(position(p)).cast("long") + 1).alias("rank"))
        for name, p in shares.items() for edge, rank in (("low", F.floor), ("high", F.ceil))
    ])
    first = places.select("column", "magnitude", "n", "upto", F.inline(wanted)).filter(
        (F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))).select(
        "column", "magnitude", "name", "edge", "fraction",
        (F.col("rank") - F.col("upto") + F.col("n")).alias("place")).collect()
    if not first:
        return quantiles
    fraction = {(r["column"], r["name"]): r["fraction"] for r in first}
    # Per wanted rank: magnitude, the digits so far, the place among the values that begin so.
    at = {(r["column"], r["name"], r["edge"]): (r["magnitude"], 0, r["place"]) for r in first}

    held = [sorted({m for (c, _, _), (m, _, _) in at.items() if c == i}) for i in range(len(columns))]
    listed = "array(" + ", ".join(
        "array(" + ", ".join(f"{m}L" for m in ms) + ")" if ms else "cast(array() AS array<bigint>)" for ms in held) + ")"
    # One mention of the magnitude, however many are wanted.
    few = values.filter(f"array_contains(get({listed}, `column`), magnitude)").groupBy(
        "column", "magnitude", "value").agg(F.count(F.lit(1)).alias("n"))
    kept = stored(ordered_image(few))
    for level in (1, 2, 3, 4):
        begins = " OR ".join(
            f"(`column` = {c} AND magnitude = {m}L AND begin = {begin}L)"
            for c, m, begin in sorted({(c, m, begin) for (c, _, _), (m, begin, _) in at.items()}))
        counts = kept.withColumns({"begin": _digit(level - 1), "digit": _digit(level)}).filter(begins).groupBy(
            "column", "magnitude", "begin", "digit").agg(F.sum("n").alias("n"))
        within = W.partitionBy("column", "magnitude", "begin").orderBy("digit")
        hits = " OR ".join(
            f"(`column` = {c} AND magnitude = {m}L AND begin = {begin}L AND upto >= {place} AND upto - n < {place})"
            for c, m, begin, place in sorted({(c, *found) for (c, _, _), found in at.items()}))
        rows = counts.withColumn("upto", F.sum("n").over(within)).filter(hits).collect()
        at = {
            key: next((m, r["digit"], place - r["upto"] + r["n"]) for r in rows
                      if (r["column"], r["magnitude"], r["begin"]) == (key[0], m, begin)
                      and r["upto"] - r["n"] < place <= r["upto"])
            for key, (m, begin, place) in at.items()
        }
    discard(kept)
    for i, c in enumerate(columns):
        for name in shares:
            if (i, name) in fraction:
                low, high = _of_image(at[i, name, "low"][1]), _of_image(at[i, name, "high"][1])
                quantiles[c][name] = low if low == high else low + (high - low) * fraction[i, name]
    return quantiles
