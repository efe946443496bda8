"""Near-duplicate lines by a deletion neighbourhood, in DataFrame functions only.

A line goes if the same line, or one within one edit of it, occurs earlier: in a smaller doc_id, or before it in its
document. Lines are judged on the input, not on what is left.

Of two lines within one edit, the halves before or after the edit are equal. So a line's halves are hashed first,
and only lines that share one go on, with that half as context and the other as open segment; a long
segment is halved again in the same way. All one-character deletions of a short open segment then are hashed keys.
A key with its position joins lines that differ in that character: all of them are within one edit of each other,
so the earliest stands for all. A key without position joins a line with those that have one character more.
Every pair so found is confirmed by its edit distance. No step pairs up the lines of a group.

Defined cases: null texts are one empty line. Lines of ASCII white space only always stay. Lines of fewer than
``MIN_CHARS`` characters go only if equal. Rows of one doc_id come in row order; a null doc_id comes last. Lines and
texts are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtrace.llm.tables import ASCII_SPACE, Work

MIN_CHARS = 16
SEGMENT = 64  # open segments above are halved again


def _lines(numbered: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    each = numbered.select("row", "id", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    blank = F.regexp_replace("line", f"^{ASCII_SPACE}+", "") == ""
    return each.select("row", "id", "no", "line", F.when(~blank, F.xxhash64("line")).alias("k1"),
                       F.when(~blank, F.xxhash64(F.lit(7), F.col("line"))).alias("k2"))


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("no").alias("no"))


def _cuts(n: Column, pieces) -> Column:
    """The two ways to halve n characters: as long as the partner or shorter, and as the longer one."""
    own, longer = (n / 2).cast("int"), ((n - 1) / 2).cast("int")
    return F.when(own == longer, F.array(*pieces(own))).otherwise(F.array(*pieces(own), *pieces(longer)))


def _front(seg: Column, context: Column, h: Column) -> Column:
    return F.xxhash64(context, F.lit("front"), h, F.substr(seg, F.lit(1), h))


def _back(seg: Column, context: Column, h: Column) -> Column:
    return F.xxhash64(context, F.lit("back"), h, F.substr(seg, F.length(seg) - h + 1, h))


def _contexts(seg: Column) -> Column:
    """The hashed halves of a line, without what they leave open."""
    return _cuts(F.length(seg), lambda h: [_front(seg, F.lit(0), h), _back(seg, F.lit(0), h)])


def _halves(seg: Column, context: Column) -> Column:
    """Each half as context, with the other half as open segment."""
    n = F.length(seg)
    return _cuts(n, lambda h: [
        F.struct(_front(seg, context, h).alias("ctx"), F.substr(seg, h + 1).alias("seg")),
        F.struct(_back(seg, context, h).alias("ctx"), F.substr(seg, F.lit(1), n - h).alias("seg"))])


def _shared(states: DataFrame, work: Work) -> DataFrame:
    """States whose context occurs with different lines."""
    common = states.groupBy("ctx").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a < b").select(
        F.col("ctx").alias("c"))
    return work.store(states.join(common, F.col("ctx") == F.col("c"), "left_semi"))


def _variants(short: DataFrame) -> DataFrame:
    """(v, kind, k1, k2, first): the deletion keys; kind is sub, base or long."""
    seg, n = F.col("seg"), F.length("seg")
    gone = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.substr(seg, F.lit(1), i - 1), F.substr(seg, i + 1)))).otherwise(F.array().cast("array<string>"))
    one = short.withColumn("gone", gone)
    keys = F.concat(
        F.transform("gone", lambda v, i: F.struct(F.xxhash64("ctx", F.lit("sub"), i, v).alias("v"), F.lit("sub").alias("kind"))),
        F.transform(F.array_distinct("gone"), lambda v: F.struct(F.xxhash64("ctx", F.lit("len"), v).alias("v"),
                                                                 F.lit("long").alias("kind"))),
        F.array(F.struct(F.xxhash64("ctx", F.lit("len"), seg).alias("v"), F.lit("base").alias("kind"))))
    return one.select("k1", "k2", F.explode(keys).alias("x")).select("x.v", "x.kind", "k1", "k2")


def _candidates(variants: DataFrame, firsts: DataFrame) -> DataFrame:
    """(k1, k2, e1, e2): lines with an earlier line that shares a key; linear in the keys."""
    common = variants.groupBy("v").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a < b").select(
        F.col("v").alias("c"))
    shared = variants.join(common, F.col("v") == F.col("c"), "left_semi")
    keyed = shared.join(firsts.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first"),
                        (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).select(
        "v", "kind", F.struct("first", "k1", "k2").alias("m"))
    lead = keyed.groupBy("v").agg(
        F.min(F.when(F.col("kind") == "sub", F.col("m"))).alias("sub"),
        F.min(F.when(F.col("kind") == "base", F.col("m"))).alias("base"),
        F.min(F.when(F.col("kind") == "long", F.col("m"))).alias("long")).filter(
        "sub is not null or (base is not null and long is not null)").withColumnRenamed("v", "w")
    other = F.when(F.col("kind") == "sub", F.col("sub")).when(F.col("kind") == "base", F.col("long")).otherwise(F.col("base"))
    return keyed.join(lead, F.col("v") == F.col("w")).withColumn("o", other).filter("o.first < m.first").select(
        "m.k1", "m.k2", F.col("o.k1").alias("e1"), F.col("o.k2").alias("e2")).distinct()


def _texts(numbered: DataFrame, lines: DataFrame, some: DataFrame) -> DataFrame:
    """(k1, k2, first, line) of some lines, each read from its first place.

    The documents go by their row to those places: one shuffle of the texts, at any number of lines.
    """
    places = lines.join(some, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).groupBy("k1", "k2").agg(
        F.min(_order()).alias("first"))
    wanted = places.groupBy(F.col("first.row").alias("r")).agg(F.collect_list(F.struct("k1", "k2", "first")).alias("w"))
    met = numbered.hint("merge").join(wanted, F.col("row") == F.col("r"))
    # The text is split once below the generator; each wanted line is then taken out by its number.
    split = met.select("w", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return split.select("lines", F.inline("w")).select("k1", "k2", "first", F.get("lines", F.col("first.no")).alias("line"))


def _near(numbered: DataFrame, lines: DataFrame, work: Work) -> DataFrame:
    """(k1, k2) of the lines that have an earlier line within one edit."""
    long_enough = _lines(numbered).filter(F.col("k1").isNotNull() & (F.length("line") >= MIN_CHARS - 1))
    narrow = long_enough.select("k1", "k2", F.explode(_contexts(F.col("line"))).alias("ctx"))
    some = work.store(_shared(narrow, work).select(F.col("k1").alias("s1"), F.col("k2").alias("s2")).distinct())
    text = work.store(_texts(numbered, lines, some))
    states = text.select("k1", "k2", F.explode(_halves(F.col("line"), F.lit(0))).alias("s")).select("k1", "k2", "s.*")
    states, found = _shared(states, work), None
    while True:
        short = _variants(states.filter(F.length("seg") <= SEGMENT + 1))
        found = short if found is None else found.unionByName(short)
        long = states.filter(F.length("seg") > SEGMENT)
        if not long.limit(1).count():
            break
        states = _shared(long.select("k1", "k2", F.explode(_halves(F.col("seg"), F.col("ctx"))).alias("s")).select(
            "k1", "k2", "s.*"), work)
    pairs = _candidates(found, text)
    own = text.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("line").alias("own"))
    earlier = text.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("line").alias("earlier"))
    both = pairs.join(own, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2"))).join(
        earlier, (F.col("e1") == F.col("b1")) & (F.col("e2") == F.col("b2")))
    fuzzy = F.least(F.length("own"), F.length("earlier")) >= MIN_CHARS
    return both.filter(fuzzy & (F.levenshtein("own", "earlier", 1) >= 0)).select("k1", "k2").distinct()


def remove_lines(docs: DataFrame, work: Work, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_removed and text, the lines that stay."""
    numbered = work.number(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "row")
    lines = work.store(_lines(numbered).drop("line"))
    near = work.store(_near(numbered, lines, work)).select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.lit(True).alias("near"))
    groups = lines.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n"))
    judged = groups.join(near, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left").filter(
        "n > 1 or near").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    stays = F.coalesce(~F.col("near") & (_order() == F.col("first")), F.lit(True))
    flags = lines.join(judged, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left").select(
        F.col("row").alias("r"), F.struct("no", stays.alias("stays")).alias("f")).groupBy("r").agg(
        F.array_sort(F.collect_list("f")).alias("f"))
    own = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(own, lambda line, i: F.element_at(F.col("f"), i + 1)["stays"])
    out = numbered.join(flags, F.col("row") == F.col("r"))
    return out.select("id", F.size("f").cast("long").alias("n_lines"),
                      F.size(F.filter("f", lambda x: ~x["stays"])).cast("long").alias("n_removed"),
                      F.array_join(kept, "\n").alias("text"))
