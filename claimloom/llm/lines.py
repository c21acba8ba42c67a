"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

* Shingles are the CHARS-character windows of a line (a shorter line is one).
* A line's signature is 16 minima of its shingle hashes, each under another
  constant that is xored in; hashing and minima stay in one generated stage, twelve
  shingles a row.
* Bands are the lines of the affine plane over the 16 minima as a 4 x 4 grid: any
  four minima on a grid line make a band key.  With three directions there are 12
  bands of four, of which two share at most one minimum.
* In a band's group every line is first paired with the group's smallest and with
  its predecessor.  Lines that end in one component by that need no further check,
  since only reachability is asked for.  All other pairs of the group, those from
  different components, follow in a second round, after size and a parity sketch
  have refused what cannot link.
* Candidates are checked on their whole shingle sets, and the linked lines are
  joined by distributed union-find.  Of each component the first line (by document
  id, then place) is kept.

Equal lines are one line from the first aggregation on.  A line's id is a 64-bit
hash of its text: two different lines agree with probability 2**-64 a pair.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.components import components
from claimloom.session import cut_lineage, scratch_path

CHARS = 8
THRESHOLD = 0.8
#: Shingles a row, and bytes a character.
STEP, WIDTH = 12, 4
#: Bits of the table that marks the members of bands' groups: 2 MB whatever their number.
SLOT_BITS = 24
#: 1,024 bits: with half of them, lines of 900 characters at Jaccard 0.70 are not refused.
SKETCH_WORDS = 16
GRID = 4
DIRECTIONS = 3
_random = random.Random(20)
#: All 32 bits, sign included: without it every minimum would come from the same half of the shingles.
XORS = [_random.getrandbits(32) - (1 << 31) for _ in range(GRID * GRID)]


def _times(a: int, x: int) -> int:
    """Product in the field of four elements."""
    return 0 if not a or not x else (a - 1 + x - 1) % 3 + 1


def bands() -> list[list[int]]:
    """For each band the numbers of its four minima."""
    return [[GRID * x + (_times(a, x) ^ b) for x in range(GRID)] for a in range(DIRECTIONS) for b in range(GRID)]


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of every line that is not blank; lines end at a newline."""
    split = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(r"\S"))


def _spaced(line: Column) -> Column:
    """The line in four bytes a character, so that any shingle is cut out by its place."""
    return F.encode(line, "UTF-32")


def signatures(lines: DataFrame) -> DataFrame:
    """(line_id, m0..m15) of every distinct line; copies of a line meet in the map-side aggregation."""
    named = lines.select(F.xxhash64("line").alias("line_id"), _spaced(F.col("line")).alias("spaced"))
    # Start of the last shingle, in bytes from 0; that of a short line is the line.
    named = named.withColumn("last", F.greatest(F.octet_length("spaced") - WIDTH * CHARS, F.lit(0)))
    rows = named.select("line_id", "spaced", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(WIDTH * STEP))).alias("at"))
    # Beyond the end the last shingle comes again, which changes no minimum.
    hashed = [F.hash(F.substring("spaced", F.least(F.col("at") + WIDTH * i, F.col("last")) + 1, F.lit(WIDTH * CHARS))).alias(f"s{i}") for i in range(STEP)]
    rows = rows.select("line_id", *hashed)
    least = [F.min(F.least(*[F.col(f"s{i}").bitwiseXOR(F.lit(x)) for i in range(STEP)])).alias(f"m{j}") for j, x in enumerate(XORS)]
    return rows.groupBy("line_id").agg(*least).select("line_id", *[F.shiftright(F.hash(f"m{j}"), 16).cast("smallint").alias(f"m{j}") for j in range(len(XORS))])


def shingle_set(line: Column) -> Column:
    """Distinct 64-bit shingle hashes of a line."""
    def cut(spaced: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(spaced) - WIDTH * CHARS + 1, F.lit(1)), F.lit(WIDTH))
        return F.transform(starts, lambda at: F.xxhash64(F.substring(spaced, at, F.lit(WIDTH * CHARS))))

    # As the variable of an outer transform the line is encoded once and not for every shingle.
    return F.array_distinct(F.transform(F.array(_spaced(line)), cut)[0])


def groups(distinct: DataFrame) -> DataFrame:
    """(key, line_id, head, before, size) of every line in a band's group of two or more: the group's smallest line and the preceding one."""
    keys = [F.xxhash64(F.lit(i), *[f"m{j}" for j in band]) for i, band in enumerate(bands())]
    keyed = distinct.select("line_id", F.explode(F.array(*keys)).alias("key"))
    # One order for all three, so that the rows go through one window.
    order = "PARTITION BY key ORDER BY line_id"
    whole = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return keyed.select("key", "line_id", F.expr(f"min(line_id) OVER ({whole})").alias("head"), F.expr(f"lag(line_id) OVER ({order})").alias("before"),
                        F.expr(f"count(*) OVER ({whole})").alias("size")).where("size > 1")


def candidates(grouped: DataFrame) -> DataFrame:
    """Pairs (a, b) of line ids that share a band, each line with the smallest and the preceding one of its group."""
    near = grouped.where("before IS NOT NULL")
    return near.select(F.explode(F.array("head", "before")).alias("a"), F.col("line_id").alias("b")).distinct()


def _sketched(texts: DataFrame) -> DataFrame:
    """(line_id, n, s0..): the number of shingles, and for each bit the parity of the number of shingles that hash to it."""
    shingles = texts.select("line_id", F.explode(shingle_set(F.col("line"))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    place = F.shiftright("h", 6).bitwiseAND(F.lit(SKETCH_WORDS - 1))
    words = [F.coalesce(F.bit_xor(F.when(place == w, bit)), F.lit(0).cast("long")).alias(f"s{w}") for w in range(SKETCH_WORDS)]
    return shingles.groupBy("line_id").agg(F.count("*").alias("n"), *words)


def other_candidates(grouped: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a group that lie in different components and may link; of up to three lines all pairs were tested.

    A pair that shares several groups leaves the join once, from the group with the smallest key.
    """
    large = grouped.where("size > 3").select("key", "line_id")
    rooted = large.join(roots, large["line_id"] == roots["node"], "left").select("key", "line_id", F.coalesce("root", "line_id").alias("root"))
    rooted = cut_lineage(rooted)
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    several = cut_lineage(rooted.join(several, "key", "left_semi"))
    shared = several.groupBy("line_id").agg(F.collect_set("key").alias("keys"))
    sketches = _sketched(texts.join(shared, "line_id", "left_semi")).join(shared, "line_id")
    open_groups = cut_lineage(several.join(sketches, "line_id"))
    x, y = open_groups.alias("x"), open_groups.alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    n, m = F.col("x.n"), F.col("y.n")
    may_link = (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6) & (differ * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6)
    here = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.line_id") < F.col("y.line_id")) & (F.col("x.root") != F.col("y.root")) & may_link & here).select(
        F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b"))


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have at least the threshold in common."""
    # The texts travel, not the sets: a set of 64-bit hashes has eight times the bytes and does not compress.
    both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b").select(
        "a", "b", shingle_set(F.col("line_a")).alias("set_a"), shingle_set(F.col("line_b")).alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", shared.alias("n"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return counted.where(F.col("n") >= threshold * (F.col("sum") - F.col("n"))).select("a", "b")


def _marks(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """One row: the 2**SLOT_BITS bits as an array of longs, with the bits of all ids set."""
    slot = F.pmod("line_id", F.lit(1 << SLOT_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    filled = ids.select(F.shiftright(slot, 6).alias("word"), bit.alias("bits"))
    every = spark.range((1 << SLOT_BITS) // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = filled.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")).select("words.bits")


def _occurrences(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_id, line) of every line; the text only where the line may be among ``members``.

    The members are marked in a bit table of fixed size, which the plan takes as
    the value of a subquery; a bit that another line shares costs that line's text
    being written, nothing else.
    """
    table = cut_lineage(_marks(docs.sparkSession, members)).scalar()
    slot = F.pmod("line_id", F.lit(1 << SLOT_BITS))
    word = table[F.shiftright(slot, 6).cast("int")]
    marked = F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    named = lines_of(docs).select("doc_id", "line_no", F.xxhash64("line").alias("line_id"), "line")
    return named.select("doc_id", "line_no", "line_id", F.when(marked, F.col("line")).alias("line"))


def line_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, line_id, component_id, kept) of every line that is not blank.

    ``component_id`` is the smallest line id of the component.  One line of each
    component is kept.  A row that repeats an id and its text shares the decision.
    Null and empty texts have no lines; blank lines are no lines.  Ties in a
    document go to the earlier line, null document ids come first.  Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "lines")
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    signatures(lines_of(slim)).write.parquet(f"{folder}/signed")
    groups(spark.read.parquet(f"{folder}/signed")).write.parquet(f"{folder}/groups")
    grouped = spark.read.parquet(f"{folder}/groups")
    pairs = cut_lineage(candidates(grouped))
    members = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct())
    _occurrences(slim, members).write.parquet(f"{folder}/lines")
    every = spark.read.parquet(f"{folder}/lines")
    texts = every.where("line IS NOT NULL").select("line_id", "line").join(members, "line_id", "left_semi").dropDuplicates(["line_id"])
    texts.write.parquet(f"{folder}/members")
    texts = spark.read.parquet(f"{folder}/members")
    found = cut_lineage(_linked(pairs, texts, threshold))
    roots = components(found)
    more = cut_lineage(_linked(other_candidates(grouped, roots, texts, threshold).join(pairs, ["a", "b"], "left_anti"), texts, threshold))
    if not more.isEmpty():
        roots = components(found.unionByName(more))
    places = every.groupBy("line_id").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    rooted = cut_lineage(places.join(roots, places["line_id"] == roots["node"], "left").select("line_id", "at", "root"))
    several = rooted.where("root IS NOT NULL").groupBy(F.col("root").alias("of")).agg(F.min("at").alias("keeper"))
    decided = rooted.join(several, rooted["root"] == several["of"], "left").select(
        F.col("line_id").alias("known_id"), F.coalesce("root", "line_id").alias("component_id"), F.coalesce("keeper", "at").alias("keeper"))
    listed = every.select("doc_id", "line_no", "line_id")
    return listed.join(decided, listed["line_id"] == decided["known_id"]).select(
        "doc_id", "line_no", "line_id", "component_id",
        (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("line_no") == F.col("keeper.line_no"))).alias("kept"))


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, each text without the lines that are not kept."""
    gone = line_components(docs, doc, text, threshold).where(~F.col("kept")).select("doc_id", "line_no", "line_id").distinct()
    gone = cut_lineage(gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("line_no", "line_id")).alias("_gone")))
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains(F.col("_gone"), F.struct(i.alias("line_no"), F.xxhash64(line).alias("line_id"))))
    joined = docs.join(gone, docs[doc].eqNullSafe(gone["_id"]), "left")
    return joined.select(*[F.when(F.col("_gone").isNull(), docs[text]).otherwise(F.array_join(left, "\n")).alias(text) if c == text else docs[c] for c in docs.columns])
