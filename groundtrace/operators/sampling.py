"""Hold-outs, folds and augmentation without moving the events.

A random order is the order of (hash, key). The exact positions at which a stratum is cut are found
from counts per hash prefix plus the few keys of the prefixes that hold a cut; every row then compares
itself with the cuts. The wide rows are never shuffled or sorted, and no stratum meets in one task.
"""

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtrace.functions.hashing import order_hash, uniform
from groundtrace.functions.text import nz
from groundtrace.session import stored

CELL_ROWS = 1 << 20  # rows of a hash prefix that are looked at together; larger prefixes are read deeper


@dataclass(frozen=True)
class Order:
    """Random order of rows: seed, optional salt, key and stratum columns.

    Keys must not be null. With ``together`` rows of one key share a position, so sizes are exact up to the
    copies of the key at a cut; without it a cut inside the rows of one key is an error.
    """

    seed: int | Column = 42  # a column where rows of one table follow different orders
    salt: str = ""
    key: str = "event_key"
    stratum: str | None = "label"
    prefix_digits: int = 4  # first depth of the hash prefixes that are counted
    together: bool = False


def _key(order: Order) -> Column:
    key = F.col(order.key).cast("string")
    missing = F.raise_error(F.lit(f"null {order.key}: a random order needs a key for every row"))
    return F.coalesce(key, missing.cast("string"))


def _keyed(df: DataFrame, order: Order) -> DataFrame:
    stratum = F.col(order.stratum).cast("string") if order.stratum else F.lit("all")
    return df.select(stratum.alias("_stratum"), _key(order).alias("_key"), order_hash(order.seed, _key(order), order.salt).alias("_hash"))


def _holding(counted: DataFrame, group: list[str], ranks: Column) -> DataFrame:
    """Cells (_stratum, _prefix, _n, _before, _ranks) that hold a requested rank, from ordered counts."""
    up_to_here = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(up_to_here))
    inside = F.filter(ranks, lambda r: (r > F.col("_end") - F.col("_n")) & (r <= F.col("_end")))
    return placed.select("_stratum", "_prefix", "_n", (F.col("_end") - F.col("_n")).alias("_before"),
                         inside.alias("_ranks")).filter(F.size("_ranks") > 0)


def _in_cells(keyed: DataFrame, cells: DataFrame, digits: int) -> DataFrame:
    cells = cells.select(F.col("_stratum").alias("_s"), F.col("_prefix").alias("_p"), "_before", "_ranks")
    return keyed.join(cells, F.col("_stratum").eqNullSafe(F.col("_s"))
                      & (F.substring("_hash", 1, digits) == F.col("_p")))


def find_cuts(df: DataFrame, order: Order, ranks) -> DataFrame:
    """One row per stratum: (_s, _cuts), the (hash, key) at each requested rank.

    ``ranks`` maps the row count of a stratum (a Column) to an ascending array of ranks. Rank r is the
    r-th row in random order. Counts per (stratum, hash prefix) locate the cells that hold a rank; a cell of
    more than ``CELL_ROWS`` rows is counted again four digits deeper. Only the keys of the last cells are
    ordered. The cuts are stored: their true size then decides how they are joined.
    """
    keyed, digits, last = _keyed(df, order), order.prefix_digits, []
    counted = keyed.groupBy("_stratum", F.substring("_hash", 1, digits).alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("_stratum"))
    counted = counted.withColumn("_start", F.lit(0).cast("bigint")).withColumn("_wanted", ranks(total))
    cells = stored(_holding(counted, ["_stratum"], F.col("_wanted")))
    while digits < 32 and cells.filter(F.col("_n") > CELL_ROWS).limit(1).count():
        last.append((digits, cells.filter(F.col("_n") <= CELL_ROWS)))
        deeper = _in_cells(keyed, cells.filter(F.col("_n") > CELL_ROWS), digits)
        digits = min(32, digits + 4)
        counted = deeper.groupBy("_stratum", "_p", F.substring("_hash", 1, digits).alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_start"), F.first("_ranks").alias("_wanted"))
        cells = stored(_holding(counted, ["_stratum", "_p"], F.col("_wanted")))
    last.append((digits, cells))
    candidates = reduce(DataFrame.unionByName, [_in_cells(keyed, c, d) for d, c in last]).groupBy(
        "_s", "_p", "_hash", "_key").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    within = Window.partitionBy("_s", "_p").orderBy("_hash", "_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.col("_before") + F.sum("_n").over(within)
    inside = F.filter("_ranks", lambda r: (r > F.col("_end") - F.col("_n")) & (r <= F.col("_end")))
    cut = candidates.withColumn("_end", end).select(
        "_s", "_end", F.struct("_hash", "_key").alias("_cut"), inside.alias("_ranks")).filter(
        F.size("_ranks") > 0).select("_s", "_end", "_cut", F.explode("_ranks").alias("_r"))
    if not order.together:
        torn = F.raise_error(F.concat(F.lit(f"a cut falls inside the rows of one {order.key}: "), F.col("_cut._key")))
        cut = cut.withColumn("_r", F.when(F.col("_r") < F.col("_end"), torn.cast("bigint")).otherwise(F.col("_r")))
    return stored(cut.groupBy("_s").agg(
        F.array_sort(F.collect_list(F.struct("_r", "_cut"))).alias("_cuts")).select(
        "_s", F.transform("_cuts", lambda c: c["_cut"]).alias("_cuts")))


def with_position(df: DataFrame, order: Order, cuts: DataFrame, name: str) -> DataFrame:
    """Add ``name``: how many cuts of its stratum lie before the row; null without any cut.

    A small table of cuts is broadcast by the optimiser, so the rows stay where they are.
    """
    stratum = F.col(order.stratum).cast("string") if order.stratum else F.lit("all")
    place = F.struct(order_hash(order.seed, _key(order), order.salt).alias("_hash"), _key(order).alias("_key"))
    joined = df.withColumn("_place", place).join(cuts, stratum.eqNullSafe(F.col("_s")), "left")
    passed = F.size(F.filter("_cuts", lambda c: c < F.col("_place")))
    return joined.withColumn(name, F.when(F.col("_cuts").isNotNull(), passed)).drop(
        "_place", "_s", "_cuts")


def stratified_holdout(df: DataFrame, test_size: float = 0.2, order: Order = Order()) -> DataFrame:
    """Add ``part``: per stratum floor(n * (1 - test_size)) rows are train, the rest test.

    ``Order(stratum=None)`` gives the unstratified form (W1b).
    """
    share = 1 - test_size
    cuts = find_cuts(df, order, lambda n: F.array(F.floor(n * F.lit(share))))
    marked = with_position(df, order, cuts, "_after")
    # A stratum too small for a single training row has no cut: all of it is test.
    return marked.withColumn(
        "part", F.when(F.col("_after") == 0, "train").otherwise("test")).drop("_after")


def stratified_folds(df: DataFrame, folds: int = 5, order: Order = Order()) -> DataFrame:
    """Add ``fold`` 1..k; per stratum the fold sizes differ by at most one."""

    def ends(n: Column) -> Column:
        small, extra = F.floor(n / folds), n % folds
        return F.array_distinct(F.filter(
            F.array(*[small * j + F.least(F.lit(j), extra) for j in range(1, folds)]),
            lambda r: r > 0))

    marked = with_position(df, order, find_cuts(df, order, ends), "_after")
    return marked.withColumn("fold", F.coalesce("_after", F.lit(0)) + 1).drop("_after")


def hash_folds(df: DataFrame, folds: int = 5, order: Order = Order()) -> DataFrame:
    """Folds of nearly equal size straight from the hash: one pass, no counting."""
    u = uniform(order.seed, F.col(order.key), order.salt or "fold")
    return df.withColumn("fold", (F.floor(u * folds) + 1).cast("int"))


def fold_parts(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def choose(df: DataFrame, factor: float, order: Order, method: str = "exact") -> DataFrame:
    """Rows without replacement: exactly floor(n * factor) of them, or each with that chance (G1)."""
    if method == "hash":
        return df.filter(uniform(order.seed, F.col(order.key), order.salt) < factor)
    if method != "exact":
        raise ValueError(f"unknown method: {method}")
    return _first_rows(df, order, lambda n: F.floor(n * F.lit(factor)))


def first_rows(df: DataFrame, count: int, *order: str | Column) -> DataFrame:
    """The first rows in the given order (L5); it must tell rows apart for the choice to be unique.

    Each task keeps its own first rows and only those meet, so ``count`` should be small.
    """
    return df.orderBy(*order).limit(count)


def choose_count(df: DataFrame, count: int, order: Order) -> DataFrame:
    """The first ``count`` rows in random order, all rows if there are fewer (L4)."""
    return _first_rows(df, order, lambda n: F.least(F.lit(count).cast("bigint"), n))


def _first_rows(df: DataFrame, order: Order, rank) -> DataFrame:
    one = replace(order, stratum=None)
    cuts = find_cuts(df, one, lambda n: F.array(rank(n)))
    return with_position(df, one, cuts, "_after").filter(F.col("_after") == 0).drop("_after")


def choose_for_folds(df: DataFrame, factor: float, folds: int, seed: int = 42, salt: str = "augment",
                     key: str = "event_key") -> DataFrame:
    """For each fold, floor(n * factor) of the n rows outside it, as rows with ``for_fold`` (G1 for all folds at once).

    The rows for fold f are those that ``choose`` takes from the others with seed + f. Every row is a member of the
    choices of all folds but its own; the cuts of all of them come from one narrow aggregate, and one pass over the rows
    then takes the members before their cut.
    """
    others = F.filter(F.array(*[F.lit(f) for f in range(1, folds + 1)]), lambda f: f != F.col("fold"))
    order = Order(F.lit(seed) + F.col("for_fold"), salt, key, "for_fold")
    members = df.select("fold", key).select(key, F.explode(others).alias("for_fold"))
    cuts = find_cuts(members, order, lambda n: F.array(F.floor(n * F.lit(factor))))
    placed = with_position(df.withColumn("for_fold", F.explode(others)), order, cuts, "_after")
    return placed.filter(F.col("_after") == 0).drop("_after")


def augment(events: DataFrame, seed: int | Column = 42, key: str = "event_key") -> DataFrame:
    """Changed copies of events: case, path, white space or no change (G2, G3). Map-only."""
    k = F.col(key)

    def u(salt: str) -> Column:
        return uniform(seed, k, salt)

    technique = F.floor(u("technique") * 4).cast("int")
    command = nz(F.col("CommandLine"))
    words = F.filter(F.split(command, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    shouted = F.array_join(F.transform(words, lambda w, i: F.when(
        uniform(seed, F.concat(k.cast("string"), F.lit("#"), i.cast("string")), "word") < 0.2,
        F.upper(w)).otherwise(w)), " ")
    squeezed = F.concat(
        F.regexp_replace(command, r"(?U)[\s\x1c-\x1f]+", " "),
        F.when(u("trail") < 0.1, F.lit(" ")).otherwise(F.lit("")))
    new_command = (
        F.when((technique == 0) & (command != "") & (u("case") < 0.3), shouted)
        .when((technique == 2) & (command != "") & (u("space") < 0.3), squeezed)
        .otherwise(F.col("CommandLine")))
    flip = (technique == 1) & (u("path") < 0.1)
    image = nz(F.nullif(F.col("Image"), F.lit("")))
    varied = F.replace(F.when(image != "", image).otherwise(nz(F.col("SourceImage"))),
                       F.lit("\\"), F.lit("/"))

    def new_image(name: str) -> Column:
        present = F.col(name).isNotNull() & (varied != "")
        return F.when(flip & present, varied).otherwise(F.col(name)).alias(name)

    changed = {"CommandLine": new_command.alias("CommandLine"),
               "Image": new_image("Image"), "SourceImage": new_image("SourceImage")}
    return events.select(*[changed.get(c, F.col(f"`{c}`")) for c in events.columns])


def augment_dataset(events: DataFrame, factor: float = 0.5, seed: int = 42,
                    key: str = "event_key", method: str = "exact") -> DataFrame:
    """Originals plus changed copies of a chosen share; copies keep label and key."""
    picked = choose(events, factor, Order(seed, "augment", key, None), method)
    copies = augment(picked, seed, key).withColumn("augmented", F.lit(True))
    return events.withColumn("augmented", F.lit(False)).unionByName(copies)
