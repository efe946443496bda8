"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot k of the mix takes the golden-ratio point frac(k * phi) through the cumulative source weights, so
every stretch of the mix has nearly its share of every source. The r-th slot of a source is its r-th
block: its documents, shuffled by hash and repeated as often as the mix allows, cut every
``block_words`` words. Slots and blocks meet in a join on (source, rank). A source's last block ends at its
target; the few blocks that the points leave out come after the other slots, so targets are met to the word.

Defined cases: null text has size 0; documents of size 0 take nothing. A null source is a source of
its own and comes last. Repeated rows are separate rows. No words at all: every target and every taken
is 0. An empty table gives an empty result. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtrace.llm.tables import ASCII_SPACE, Work, free_name, running_totals, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # words of the mix per word of the input
REPEATS = 2  # most copies of a document in the mix
BLOCK_WORDS = 512
PHI = 0.6180339887498949
_BITS = 42  # of a golden-ratio point: exact in integers for 2^40 slots
_STEP = round(PHI * 2 ** _BITS) | 1
CHUNK = 4096


def sized(docs: DataFrame, row: Column, seed: int, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Narrow rows: row, doc_id, source, size and the hash that orders a source's documents."""
    return docs.select(
        row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))


def _before(df: DataFrame, value: str, position: str, name: str) -> DataFrame:
    """Sum of ``value`` over smaller positions 0, 1, 2, ... in two levels, so no task sees all rows."""
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / CHUNK))
    until = (Window.unboundedPreceding, -1)
    starts = chunked.groupBy("_chunk").agg(F.sum(value).alias("_v")).select(
        F.col("_chunk").alias("_k"), F.coalesce(F.sum("_v").over(
            Window.orderBy("_chunk").rowsBetween(*until)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_chunk").orderBy(position).rowsBetween(*until)), F.lit(0))
    return chunked.withColumn("_inside", inside).join(starts, F.col("_chunk") == F.col("_k")).withColumn(
        name, F.col("_start") + F.col("_inside")).drop("_chunk", "_k", "_start", "_inside")


def source_targets(rows: DataFrame, work: Work, weights=WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """One row per source: _group, _rows, source_size, target, low (targets of the sources before it).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words. A
    target stops at ``repeats`` times its source; the excess goes to the others by weight until none is
    above. Each turn is one aggregate over the table of sources; the set of full sources only grows.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("_rows"))
    order = F.col("source").asc_nulls_last()
    ordered = work.store(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn(
        "mid", F.monotonically_increasing_id()))
    part = F.shiftright("mid", 33)
    counts = ordered.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row per partition
    offset, before = F.lit(0), 0
    for c in counts:
        offset = F.when(part == c["p"], F.lit(before)).otherwise(offset)
        before += c["count"]
    rank = (offset + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = work.store(ordered.select(
        F.col("source").alias("_group"), "_rows", "s", rank.alias("rank"),
        F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("w")))
    total = table.agg(F.sum("s")).first()[0] or 0
    level, limit = 0.0, F.lit(float(repeats)) * F.col("s")
    while total:
        full = limit <= F.lit(level) * F.col("w")
        fixed, free = table.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("w")))).first()
        if not free:
            break
        following = (share * total - (fixed or 0.0)) / free
        if following <= level:
            break
        level = following
    targets = table.select("_group", "_rows", "rank", F.col("s").alias("source_size"),
                           F.least(limit, F.lit(level) * F.col("w")).alias("target"))
    return work.store(_before(targets, "target", "rank", "low"))


def schedule(targets: DataFrame, work: Work, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, block): which block of which source each slot of the mix takes.

    A point finds its source through equal cells of the cumulative weights: an equality join with a
    comparison inside the cell.
    """
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = -(-int(round(total)) // block_words)
    need = F.ceil(F.round("target") / block_words).cast("long")
    size = F.lit(max(total, 1.0) / CHUNK)
    steps = targets.filter("target > 0").select(
        "_group", "low", (F.col("low") + F.col("target")).alias("top"), need.alias("need"))
    cells = steps.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / size), F.floor(F.col("top") / size))))
    high, one = F.shiftright("id", 20), 1 << _BITS  # products of 20 and 42 bits stay within a long
    point = F.pmod(F.col("id").bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(_STEP)
                   + F.pmod(high * F.lit((_STEP << 20) % one), F.lit(one)), F.lit(one))
    slot = targets.sparkSession.range(slots).select(
        F.col("id").alias("slot"), (point / F.lit(float(one)) * F.lit(total)).alias("u")).withColumn(
        "at", F.floor(F.col("u") / size))
    drawn = work.store(slot.join(cells, (F.col("at") == F.col("cell")) & (F.col("u") >= F.col("low"))
                                 & (F.col("u") < F.col("top"))).select(
        "slot", F.col("_group").alias("source"), "need", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    starts = drawn.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("n").over(
            Window.partitionBy("source").orderBy("chunk").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")))
    inside = ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c"))).select(
        "slot", "source", (F.col("base") + F.col("r") - 1).alias("block"), "need").filter(
        "block < need").drop("need")
    had = drawn.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("had"))
    rest = steps.join(had, F.col("_group").eqNullSafe(F.col("_s")), "left").withColumn(
        "had", F.coalesce("had", F.lit(0))).filter("had < need").select(
        F.col("_group").alias("source"), F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("block"))
    return inside.unionByName(rest.select((F.lit(slots) + F.col("block")).alias("slot"), "source", "block"))


def mix(rows: DataFrame, targets: DataFrame, work: Work, block_words: int = BLOCK_WORDS,
        repeats: int = REPEATS) -> DataFrame:
    """The mix: (slot, source, block, row, round, from_word, to_word), words counted from 0 in the document."""
    placed = running_totals(rows.filter("size > 0"), targets.select("_group", "_rows"), "source",
                            ["h", "doc_id", "row"], "size", "start")
    known = targets.select("_group", "source_size", F.round("target").cast("long").alias("end"))
    copies = placed.join(known, F.col("source").eqNullSafe(F.col("_group"))).withColumn(
        "round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "a", F.col("round") * F.col("source_size") + F.col("start")).withColumn(
        "b", F.least(F.col("a") + F.col("size"), F.col("end"))).filter("b > a")
    width = F.lit(block_words)
    cut = copies.withColumn("piece", F.explode(F.sequence(
        F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    pieces = cut.select(
        F.col("source").alias("_from"), "piece", "row", "round",
        (F.greatest(F.col("a"), F.col("piece") * width) - F.col("a")).alias("from_word"),
        (F.least(F.col("b"), (F.col("piece") + 1) * width) - F.col("a")).alias("to_word"))
    slots = schedule(targets, work, block_words)
    return slots.join(pieces, F.col("source").eqNullSafe(F.col("_from")) & (F.col("block") == F.col("piece"))).select(
        "slot", "source", "block", "row", "round", "from_word", "to_word")


def taken_words(docs: DataFrame, work: Work, seed: int = 11, block_words: int = BLOCK_WORDS, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, the words of it in the mix, and first_slot, the
    first slot of the schedule that takes words of it (null if none does)."""
    rows = work.store(sized(docs, F.monotonically_increasing_id(), seed, id_col, text_col, source_col))
    targets = source_targets(rows, work)
    taken = mix(rows, targets, work, block_words).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    sizes = targets.select("_group", "source_size", "target")
    return rows.join(sizes, F.col("source").eqNullSafe(F.col("_group"))).join(
        taken, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        "first_slot")


def mixed_documents(docs: DataFrame, work: Work, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, a row for each round that takes words of them.

    A document that the mix takes whole keeps its text as it is. Where a source's target falls inside a
    document, that row keeps its first words, joined by one space.
    """
    number, taken_row, cut = (free_name(docs, n) for n in ("_mix_row", "_taken_row", "_cut"))
    numbered = work.number(docs, number)
    rows = work.store(sized(numbered, F.col(number), seed, id_col, text_col, source_col))
    targets = source_targets(rows, work)
    taken = mix(rows, targets, work).groupBy("row", "round").agg(F.max("to_word").alias("_words")).join(
        rows.select(F.col("row").alias("_r"), "size"), F.col("row") == F.col("_r")).select(
        F.col("row").alias(taken_row), F.when(F.col("_words") < F.col("size"), F.col("_words")).alias(cut))
    tokens = F.filter(F.split(F.col(text_col), ASCII_SPACE + "+"), lambda w: w != "")
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.slice(tokens, F.lit(1), F.col(cut).cast("int")), " "))
    out = numbered.join(taken, F.col(number) == F.col(taken_row)).withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(
            F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
