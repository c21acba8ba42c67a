"""Spelling variants grouped by reduced-alphabet generation.

Words that differ by one edit are found without comparing words to each other:

1. Every letter is hashed to one of a few symbols, which turns a word into a reduced
   word.  One edit of the word is at most one edit of its reduced word.
2. The full one-edit neighbourhood of every reduced word is generated: the word
   itself, every deletion, replacement and insertion of a symbol, each string once.
   With few symbols it is small, some twenty strings a letter.
3. The neighbourhood is joined with the reduced words of the vocabulary, and every
   pair that meets is verified on the original strings.

Reduced words travel as 64-bit polynomial hashes, whose edits cost one sum each.  Two
that agree by chance cost one more verification, nothing else.  Before the join a
table of bits, in which the vocabulary's hashes are marked, drops the neighbours
that nobody has; it has at most 2**MOST_BITS bits, and where the vocabulary outgrows
it, more neighbours reach the join, which decides.  The number of symbols follows
the vocabulary's size, which steers the number of pairs to verify, not the result.

Counts of words are aggregated before the shuffle, so the commonest word costs a row
a task.  A word has at most a few near words for each of its letters, so no group
grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut_lineage

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A row in DELETE_EVERY loses a letter (by the hash of id and word); a form is FORM_TIMES as frequent as the word.
DELETE_EVERY = 31
FORM_TIMES = 10
#: Bits of the table of marked hashes: this many for each word, in blocks of 2**BLOCK_BITS, at most 2**MOST_BITS (32 MB).
BITS_A_WORD, BLOCK_BITS, MOST_BITS = 32, 16, 28
#: Neighbours generated at once.
AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def word_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_length: int = MIN_LENGTH, least_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences.

    A word is a maximal run of letters with A-Z in lower case.  If DELETE_EVERY divides
    the CRC-32 of ``id:word``, the letter at that number modulo the word's length goes.
    A null id deletes nothing; a null text has no words.
    """
    runs = docs.select(F.col(doc).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")).alias("run"))
    hashed = runs.select("run", F.coalesce(F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.lit(1)).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def symbols_for(n_words: int) -> int:
    """Symbols of the reduced alphabet: a power of two whose seventh power is at least the number of words."""
    return 1 << max(2, -(-max(n_words, 1).bit_length() // 7))


def _reduced(words: list[str], symbols: int) -> np.ndarray:
    """Words of one length as rows of symbols 1..symbols."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(_U).reshape(len(words), -1)
    return ((points * _U(0x9E3779B1)) & _U(0xFFFFFFFF)) // _U((1 << 32) // symbols) + _U(1)


def _ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first 0..L symbols and of the last L..0, and the powers 0..L+1 of the base."""
    rows, size = codes.shape
    powers = np.full(size + 2, _U(_BASE))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(size + 1, _U(_INVERSE))
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    head, tail = np.zeros((rows, size + 1), _U), np.zeros((rows, size + 1), _U)
    head[:, 1:] = np.cumsum(codes * inverse[:size], axis=1) * powers[:size]
    tail[:, :size] = np.cumsum((codes * powers[:size][::-1])[:, ::-1], axis=1)[:, ::-1]
    return head, tail, powers


def word_keys(words: list[str], symbols: int) -> np.ndarray:
    """The hashes of the reduced words."""
    out = np.zeros(len(words), _U)
    for rows, codes in _by_length(words, symbols):
        out[rows] = _ends(codes)[0][:, -1]
    return out


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, AT_ONCE // int(max(size, 1) * (2 * symbols + 1)))
        for start in range(0, len(rows), step):
            part = rows[start: start + step]
            yield part, _reduced([words[i] for i in part], symbols)


def neighbourhoods(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, hash) of every string within one edit of the reduced words, each string once for a word, in blocks."""
    for rows, codes in _by_length(words, symbols):
        size = codes.shape[1]
        head, tail, powers = _ends(codes)
        back = powers[:size + 1][::-1]  # back[i]: the power that lifts a symbol over the last size - i ones
        yield rows, head[:, -1]
        width = max(1, AT_ONCE // (len(rows) * 2 * symbols))
        for start in range(0, size + 1, width):
            at = np.arange(start, min(start + width, size + 1))
            inner = at[at < size]
            who = np.broadcast_to(rows[:, None], (len(rows), len(at)))
            # A deletion in a run of equal symbols counts at the run's last place, an insertion of a symbol not before itself.
            last = np.ones((len(rows), len(inner)), bool)
            last[:, inner < size - 1] = codes[:, inner[inner < size - 1]] != codes[:, inner[inner < size - 1] + 1]
            yield who[:, :len(inner)][last], (head[:, inner] * back[inner + 1] + tail[:, inner + 1])[last]
            for x in range(1, symbols + 1):
                other = codes[:, inner] != _U(x)
                yield who[:, :len(inner)][other], (head[:, inner] * back[inner] + _U(x) * back[inner + 1] + tail[:, inner + 1])[other]
                free = np.ones((len(rows), len(at)), bool)
                free[:, :len(inner)] = other
                lifted = head[:, at] * powers[size - at + 1]
                yield who[free], (lifted + _U(x) * back[at] + tail[:, at])[free]


def _marked(keyed: DataFrame, n_words: int) -> tuple[Broadcast, int]:
    """The bits of all keys as bytes, broadcast, and the number of bits as a power of two; bounded by MOST_BITS."""
    bits = min(MOST_BITS, max(BLOCK_BITS, (n_words * BITS_A_WORD).bit_length()))

    def block(of: pa.Table) -> pa.Table:
        field = np.zeros(1 << BLOCK_BITS, np.uint8)
        field[of.column("slot").to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pa.table({"block": of.column("block").slice(0, 1), "bits": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    slots = keyed.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).distinct()
    blocks = slots.withColumn("block", F.shiftright("slot", BLOCK_BITS)).groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator()
    table = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (BLOCK_BITS - 3)
    for r in blocks:
        table[r["block"] * width: (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return keyed.sparkSession.sparkContext.broadcast(table), bits


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n) of every ordered pair of words that differ by exactly one inserted, deleted or replaced code point.

    ``words`` holds distinct words with their number n.
    """
    n_words = words.count()
    size = symbols or symbols_for(n_words)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = word_keys(batch.column(0).to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["near", "near_n", "key"])

    named = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    keyed = cut_lineage(named.mapInArrow(keys, "near string, near_n long, key long"))
    marks, bits = _marked(keyed, n_words)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            for who, key in neighbourhoods(batch.column(0).to_pylist(), size):
                slot = key >> _U(64 - bits)
                known = (table[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1
                hit = np.flatnonzero(known)
                if len(hit):
                    of = pa.array(who[hit])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(key[hit].view(np.int64))], ["word", "n", "key"])

    asked = words.select("word", "n").mapInArrow(generate, "word string, n long, key long")
    one_edit = (asked["word"] != keyed["near"]) & (F.levenshtein(asked["word"], keyed["near"], 1) == 1)
    # Two neighbours of a very long word may share a hash; a pair counts once.
    return asked.join(keyed, (asked["key"] == keyed["key"]) & one_edit).select("word", "n", "near", "near_n").distinct()


def last_of_chain(steps: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) without cycles: the last word that forms lead to."""
    found = steps.select("word", F.col("form").alias("root"))
    while True:
        onward = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        jumped = cut_lineage(found.join(onward, found["root"] == onward["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return found


def _best(near: Column, near_n: Column) -> Column:
    """The near word with the largest number; of equal numbers the first in code-point order."""
    return F.min(F.struct((-near_n).alias("less"), near.alias("near")))


def grouped(words: DataFrame, times: int = FORM_TIMES, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n) of distinct words.

    ``form`` is the most frequent near word (of equal ones the first in code-point
    order) if it is at least ``times`` as frequent as the word, else null; ``root``
    the last word that forms lead to, the word itself without a form; ``n_near``
    counts the near words.  No words give no rows.
    """
    words = cut_lineage(words.select("word", "n"))
    pairs = near_pairs(words, symbols)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), _best(F.col("near"), F.col("near_n")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    formed = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                       F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = last_of_chain(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``grouped`` over the words of all whole texts, as ``word_counts`` counts them.

    Null and empty texts have no words, a row that repeats an id and its text counts
    again, an empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    return grouped(word_counts(docs, doc, text))
