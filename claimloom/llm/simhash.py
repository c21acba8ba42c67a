"""SimHash near-duplicates by a self-join of a binary trie.

A text's fingerprint has a bit for each bit of the shingles' 64-bit hashes: set if
more than half of the shingles have it set.  Fingerprints that differ in at most
``budget`` bits are linked, and links make components.

The distinct fingerprints stand in a path-compressed binary trie.  Two nodes are
traversed together: the bits that are fixed in both are compared, the differing
ones are counted, and the pair of nodes is dropped as soon as the count exceeds the
budget; what is left goes on with the children of the node that has fewer bits
fixed.  At the leaves all 64 bits are fixed, so every link is exact.

On a cluster the trie is cut into buckets of at most SIZE fingerprints, the buckets
into buckets of at most SIZE buckets, and so on up to one root:

* Building sorts by range, and every partition cuts its own run at the trie's nodes.
  A bucket is one row.  Buckets of two partitions may belong to one node of the
  trie; that costs nothing but a pair of buckets.
* Traversal goes down one level of buckets at a time.  The open pairs are a table
  that is joined with the buckets' contents on both sides; each row is expanded on
  its own, in blocks of BLOCK pairs of nodes.
* In the lowest level a pair of buckets hands on a spanning forest of its links,
  fewer rows than the buckets have fingerprints, so a group of many versions that
  are all near each other makes no square of links.

Equal fingerprints are one key, so exact copies cost one key however many they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.components import components
from claimloom.session import cut_lineage

SHINGLE = 3
SEED = 42
BUDGET = 2
#: Keys in a bucket; pairs of nodes expanded at once; bytes of text looked at in one piece; keys of a partition that is cut.
SIZE = 2048
BLOCK = 1 << 18
PIECE = 1 << 20
CUT_KEYS = 1 << 18

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_TOP = np.uint64(1 << 63)
#: For each number of fixed bits the mask of those bits.
_MASKS = np.array([((1 << n) - 1) << (64 - n) for n in range(65)], dtype=np.uint64)


def shingle_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text in pieces, repeats included; fewer words than a shingle are one."""
    held: list[bytes] = []
    start, any_yet = 0, False
    while start < len(raw):
        end = start + PIECE
        cut = _BLANK.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        # bytes.lower() touches A-Z only, and bytes.split() cuts at exactly the blanks above.
        words = held + raw[start:end].lower().split()
        start, held = end, words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())
            yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
            held, any_yet = words[1 - SHINGLE:], True
    if held and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(raw: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number; zero without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(raw or b""):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every row; a null or empty text, or one without words, has the fingerprint zero."""
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    kind = T.StructType([slim.schema["doc_id"], T.StructField("fingerprint", T.LongType())])
    return slim.mapInArrow(run, kind)


def _ordered(column: pa.Array) -> np.ndarray:
    """Signed keys as unsigned ones of the same order; the top bit is turned, which leaves all distances as they are."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _TOP


def _signed(keys: np.ndarray) -> np.ndarray:
    return (keys ^ _TOP).view(np.int64)


def _fixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many leading bits two keys share."""
    x = low ^ high
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return 64 - np.bitwise_count(x).astype(np.int64)


class Trie:
    """The binary trie over disjoint key ranges low..high in ascending order; node 0 is the root.

    A node is a run of ranges; ``fixed`` leading bits are common to all its keys.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high
        starts, left, right, fixed, made = [], [], [], [], 1
        lo, hi = np.array([0]), np.array([len(low)])
        while len(lo):
            shared = _fixed(low[lo], high[hi - 1])
            inner = hi - lo > 1
            a, b = lo[inner], hi[inner]
            bit = (63 - shared[inner]).clip(0).astype(np.uint64)
            # A range may reach over the split; the run is then divided next to it.
            mid = np.searchsorted(low, ((low[a] >> bit) | np.uint64(1)) << bit).clip(a + 1, b - 1)
            child = np.full(len(lo), -1)
            child[inner] = made + 2 * np.arange(len(a))
            starts.append(lo), fixed.append(shared), left.append(child), right.append(np.where(child < 0, -1, child + 1))
            made += 2 * len(a)
            lo, hi = np.stack([a, mid], 1).ravel(), np.stack([mid, b], 1).ravel()
        self.start, self.fixed, self.left, self.right = (np.concatenate(x) for x in (starts, fixed, left, right))
        self.key = low[self.start]


def node_pairs(x: Trie, y: Trie, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of ranges (number in x, number in y) that may hold keys within the budget; for single keys exactly those that do.

    With ``x is y`` every pair comes once, and a range with itself.
    """
    same = x is y
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b = stack.pop()
        if len(a) > BLOCK:
            half = len(a) // 2
            stack += [(a[:half], b[:half]), (a[half:], b[half:])]
            continue
        differ = np.bitwise_count((x.key[a] ^ y.key[b]) & _MASKS[np.minimum(x.fixed[a], y.fixed[b])])
        near = differ <= budget
        a, b = a[near], b[near]
        x_inner, y_inner = x.left[a] >= 0, y.left[b] >= 0
        done = ~x_inner & ~y_inner
        if done.any():
            yield x.start[a[done]], y.start[b[done]]
        twin = x_inner & (a == b) if same else np.zeros(len(a), bool)
        open_x = x_inner & ~twin & (~y_inner | (x.fixed[a] <= y.fixed[b]))
        open_y = y_inner & ~twin & ~open_x
        u, v, w = a[twin], a[open_x], b[open_y]
        more_a = np.concatenate([x.left[u], x.left[u], x.right[u], x.left[v], x.right[v], a[open_y], a[open_y]])
        more_b = np.concatenate([x.left[u], x.right[u], x.right[u], b[open_x], b[open_x], y.left[w], y.right[w]])
        if len(more_a):
            stack.append((more_a, more_b))


def forest(x: Trie, y: Trie, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (keys of x, keys of y) of the links between the single keys of two tries."""
    shift = 0 if x is y else len(x.low)
    root = np.arange(shift + len(y.low))
    ends: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in node_pairs(x, y, budget):
        while (root[root] != root).any():
            root[:] = root[root]
        apart = root[a] != root[b + shift]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = find(i), find(j + shift)
            if p != q:
                root[max(p, q)] = min(p, q)
                ends.append((i, j))
    at = np.array(ends, dtype=np.int64).reshape(-1, 2)
    return x.low[at[:, 0]], y.low[at[:, 1]]


def _runs(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Ascending key ranges cut at nodes of their trie into runs of at most SIZE."""
    out, stack = [], [(0, len(low))] if len(low) else []
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= SIZE:
            out.append((lo, hi))
            continue
        bit = max((int(low[lo]) ^ int(high[hi - 1])).bit_length() - 1, 0)
        mid = int(np.searchsorted(low[lo:hi], np.uint64(((int(low[lo]) >> bit) | 1) << bit))) + lo
        mid = min(max(mid, lo + 1), hi - 1)
        stack += [(lo, mid), (mid, hi)]
    return out


_BUCKETS = "low long, high long, lows array<long>, highs array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of one partition's ascending ranges."""
    parts = [(_ordered(b.column(0)), _ordered(b.column(1))) for b in batches if b.num_rows]
    if parts:
        low, high = (np.concatenate(x) for x in zip(*parts))
        for lo, hi in _runs(low, high):
            lows, highs = _signed(low[lo:hi]), _signed(high[lo:hi])
            # Single keys are both ends of their range and stand once.
            again = highs[:0] if (lows == highs).all() else highs
            yield pa.RecordBatch.from_arrays([pa.array(lows[:1]), pa.array(highs[-1:]), pa.array([lows], pa.list_(pa.int64())), pa.array([again], pa.list_(pa.int64()))],
                                             ["low", "high", "lows", "highs"])


def build(keys: DataFrame, key: str) -> list[DataFrame]:
    """The trie over distinct keys as levels of buckets (low, high, lows, highs), the root's level of one row last; no keys give no levels."""
    levels: list[DataFrame] = []
    items = keys.select(F.col(key).alias("low"), F.col(key).alias("high"))
    while True:
        n = items.count()
        if not n:
            return levels
        shuffles = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = items.coalesce(1) if n <= SIZE else items.repartitionByRange(max(shuffles, -(-n // CUT_KEYS)), "low")
        levels.append(cut_lineage(dealt.sortWithinPartitions("low").mapInArrow(_cut, _BUCKETS)))
        if n <= SIZE:
            return levels
        items = levels[-1].select("low", "high")


def self_join(levels: list[DataFrame], budget: int) -> DataFrame:
    """Links (a, b) that connect all keys within the budget of each other: every link of two keys joins keys that these links connect."""

    def expand(lowest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Trie] = {}

            def trie(node: int, lows: pa.Scalar, highs: pa.Scalar) -> Trie:
                if node not in held:
                    if len(held) >= 64:
                        held.pop(next(iter(held)))
                    low = _ordered(lows.values)
                    held[node] = Trie(low, _ordered(highs.values) if len(highs.values) else low)
                return held[node]

            for batch in batches:
                for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    x = trie(a, batch.column(2)[i], batch.column(3)[i])
                    y = x if a == b else trie(b, batch.column(4)[i], batch.column(5)[i])
                    found = [forest(x, y, budget)] if lowest else ((x.low[p], y.low[q]) for p, q in node_pairs(x, y, budget))
                    for p, q in found:
                        yield pa.RecordBatch.from_arrays([pa.array(_signed(p)), pa.array(_signed(q))], ["a", "b"])

        return run

    pairs = levels[-1].select(F.col("low").alias("a"), F.col("low").alias("b"))
    for k in reversed(range(len(levels))):
        x = levels[k].select(F.col("low").alias("a"), F.col("lows").alias("a_lows"), F.col("highs").alias("a_highs"))
        y = levels[k].select(F.col("low").alias("b"), F.col("lows").alias("b_lows"), F.col("highs").alias("b_highs"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "a_lows", "a_highs", "b_lows", "b_highs")
        pairs = cut_lineage(both.mapInArrow(expand(k == 0), "a long, b long"))
    return pairs


def near_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``fingerprint`` is 16 lowercase hexadecimal digits; ``component_id`` the smallest
    document id that links reach, the own one included.  Null and empty texts, and
    texts without words, have the fingerprint zero and are linked like any other.  A
    row that repeats an id gets its own fingerprint.  A null id is a row like any
    other and is never the smallest; a component of null ids only has a null id.
    An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    prints = cut_lineage(fingerprints(docs, doc, text))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    levels = build(classes, "fingerprint")
    named = classes.select(F.col("fingerprint").alias("key"), "first", F.col("fingerprint").alias("root"))
    if levels:
        roots = components(self_join(levels, budget))
        named = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
            F.col("fingerprint").alias("key"), "first", F.coalesce("root", "fingerprint").alias("root"))
        named = cut_lineage(named)
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    known = cut_lineage(named.join(least, named["root"] == least["of"]).select("key", "component_id"))
    return prints.join(known, prints["fingerprint"] == known["key"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
