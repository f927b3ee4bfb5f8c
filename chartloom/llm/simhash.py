"""Near-duplicate detection: SimHash fingerprints joined with themselves by a binary trie.

Fingerprints: a text's ASCII letters are lower-cased, its words are what stands between ASCII white space, and each run of
``shingle`` words gives an XXH64 hash (seed 42). A bit of the fingerprint is set if it is set in over half the hashes.

Method (binary trie self-join): distinct fingerprints form a binary trie. Pairs of nodes are walked together, level by
level; where the two branches differ, the pair's count of differing bits grows, and a pair is dropped once the count is
over its budget. Two fingerprints at up to ``budget`` bits agree on one of their 32-bit halves up to ``budget // 2`` bits,
so the walk runs twice, once for either half first, with that smaller budget down to level 32. The number of node pairs then
grows as n log^2 n, not as n^2.

Distribution: the top ``depth`` levels are walked by a shuffle: each fingerprint is sent to the pairs of depth-``depth``
nodes within the half budget that its own node belongs to. ``depth`` grows with the logarithm of their number; pairs of nodes
that still hold too many fingerprints are walked down further in the same way, so a task's two subtrees stay small whatever
prefixes texts share. A task returns only a spanning forest (one row per linked fingerprint), and walks with a rising budget,
leaving out pairs of subtrees that are already one component, so a large group of near copies costs little more than its
size. Components are closed by alternating stars over the remaining edges, written between rounds.

The graph's nodes are fingerprints, never doc_ids; what a component is called is looked up at the end.

Similarity: texts with four in five shingles in common differ in 5 to 17 bits of 64, which no trie walk can afford. Where a
``similarity`` is asked for, links by exact Jaccard similarity of the sets of distinct shingle hashes are added. Sets are
nodes too, named by a 64-bit hash, and each is tied to the fingerprints of its texts. Sets meet that share one of 16 bands of
6 minima; a pair is a candidate if 60 of its 96 minima agree and its 256 least hashes allow it, and a link if the whole sets
say so, which are taken again from the texts of those that meet another. Of pairs at similarity 0.8, 8 in 1000 share no band
and 1 in 22,000 is no candidate; these are the only estimates. Each
set is held against one central member of its bands first, then against the one that it agrees with most; then all pairs of a
bucket meet that these links leave in different components. Buckets are dealt into blocks, and a task holds two of them. The members of a bucket's largest component meet the
others only. Where many documents lie just below the similarity, the work is quadratic in their number, the memory of a task
isn't.

Exact copies share one fingerprint and enter once. Edge cases: null and empty texts have fingerprint zero and link like
any other; shorter texts are one shingle; texts of any length are read whole; a null doc_id stays null and names no component
(a component of such rows alone has none); rows that share a doc_id keep their own fingerprints and components; extra columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, blocks, bounded, drop_table, written

_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def hashes(text: str | None, shingle: int) -> np.ndarray:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(shingle, len(words))
    starts = np.append(0, np.cumsum([len(w) + 1 for w in words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(hashes(text, shingle))


#: 16 bands of 6 minima: of pairs at similarity 0.8, 99 in 100 share a band.
BANDS, ROWS = 16, 6
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """The least hash under each of BANDS * ROWS mixings."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 2048):
        mixed = h[i : i + 2048, None] * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[1]
        least = np.minimum(least, mixed.min(axis=0))
    return least


_SKETCH = pa.schema([*_PRINT, ("th", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("sid", pa.int64())])


def _sid(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 42)).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int, sketch: bool = False) -> DataFrame:
    """doc_id and fp, a signed long; with ``sketch`` also a hash of the text (th), the minima's low 16 bits, the hashes of
    the bands, and a hash of the set of distinct shingle hashes (sid)."""
    schema = _SKETCH if sketch else _PRINT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 4 << 20):
            found = []
            for text in block["text"].to_pylist():
                h = hashes(text, shingle)
                row = [majority(h)]
                if sketch:
                    least = minima(h)
                    bands = np.bitwise_xor.reduce(least.reshape(BANDS, ROWS) * np.arange(1, 2 * ROWS, 2, np.uint64), axis=1).view(np.int64)
                    row += [(least & np.uint64(0xFFFF)).astype("<u2").tobytes(), bands.tolist(), _sid(np.unique(h))]
                found.append(row)
            names = [n for n in schema.names if n not in ("doc_id", "th")]
            given = {n: block[n] for n in ("doc_id", "th") if n in schema.names}
            yield batch_of(schema, given | dict(zip(names, zip(*found, strict=True), strict=True)))

    out = "doc_id long, fp long" + (", th long, sketch binary, bands array<long>, sid long" if sketch else "")
    return bounded(_texts(docs)).mapInArrow(run, out)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """sid and grams, the sorted distinct shingle hashes, of the sets of ``nodes`` (sid, th, doc_id: one row that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 4 << 20):
            grams = [np.unique(hashes(text, shingle)) for text in block["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_sid(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["sid", "grams"])

    wanted = nodes.select(F.col("th").alias("w_th"), F.col("doc_id").alias("w_id"))
    given = _texts(docs)
    # always a merge join: texts are too many to be joined otherwise, and ``wanted`` grows with them
    one = given.join(wanted.hint("merge"), (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    return bounded(one.select("text")).mapInArrow(run, "sid long, grams binary").dropDuplicates(["sid"])


#: Of pairs at similarity 0.8, 1 in 45,000 agrees in fewer of its 96 minima.
AGREE = 60


def _least_agreeing(similarity: float) -> int:
    return max(1, round(BANDS * ROWS * similarity) - (round(BANDS * ROWS * 0.8) - AGREE))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), BANDS * ROWS)


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Of the pairs (a, b) those whose sketches agree in ``least`` minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_sketches(batch["sa"]) == _sketches(batch["sb"])).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda x: nodes.select(F.col("sid").alias(x), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of sets those at ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["ga"], batch["gb"], strict=True):
                x, y = (np.frombuffer(g.as_buffer(), np.uint64) for g in (x, y))
                near.append(min(len(x), len(y)) >= similarity * max(len(x), len(y)) and _jaccard(x, y) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda x: sets.select(F.col("sid").alias(x), F.col("grams").alias(f"g{x}"))
    return bounded(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "gb")).mapInArrow(run, "a long, b long")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of sorted distinct values."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def meetings(nodes: DataFrame) -> DataFrame:
    """Of each node (sid, bands) that shares a band with another: a, the most central member of its bands, and of several
    the one that it shares most bands with; null where that is the node itself in all of them.

    A node is the more central, the more members its bands have together: a text that was copied with small changes shares
    all of its bands with many copies, and each of these only some. Tables are written so that Spark can split a hot band's
    rows in the joins."""
    rows = nodes.select("sid", F.posexplode("bands").alias("band", "h"))
    sizes = written(rows.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = written(rows.join(sizes, ["band", "h"]), "shared")
    central = written(shared.groupBy("sid").agg(F.sum("n").alias("members")), "central")
    shared = shared.drop("n").join(central, "sid")
    pivots = written(shared.groupBy("band", "h").agg(F.max(F.struct("members", "sid")).alias("p")).select("band", "h", F.col("p.sid").alias("a"), "p.members"), "pivots")
    met = shared.select("sid", "band", "h").join(pivots, ["band", "h"]).groupBy("sid", "a").agg(F.count("*").alias("n"), F.max("members").alias("members"))
    best = F.max(F.when(F.col("a") != F.col("sid"), F.struct("n", "members", "a")))
    return met.groupBy("sid").agg(best.alias("m")).select("sid", "m.a")


def dealt_blocks(nodes: DataFrame, chunk: int) -> DataFrame:
    """Members of buckets with several labels, once for each pair (i, j) of blocks of about ``chunk`` that their block is in.

    Blocks of the most frequent label come last and aren't paired with one another."""
    rows = nodes.select("sid", "label", F.posexplode("bands").alias("band", "h"))
    by_label = rows.groupBy("band", "h", "label").agg(F.count("*").alias("n"))
    top = F.max_by("label", F.struct("n", "label")).alias("top")
    mixed = written(by_label.groupBy("band", "h").agg(F.sum("n").alias("n"), F.max("n").alias("n_top"), F.count("*").alias("labels"), top).filter("labels > 1"), "mixed")
    others, tops = F.ceil((F.col("n") - F.col("n_top")) / chunk).cast("int"), F.ceil(F.col("n_top") / chunk).cast("int")
    dealt = rows.join(mixed, ["band", "h"]).withColumns({"others": others, "tops": tops, "is_top": F.col("label") == F.col("top")})
    number = lambda blocks: F.pmod(F.xxhash64("sid"), F.col(blocks)).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("is_top"), F.col("others") + number("tops")).otherwise(number("others")))
    last = F.when(F.col("is_top"), F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    sent = dealt.select("band", "h", "sid", "label", "block", "is_top", F.explode(F.sequence(F.lit(0), last)).alias("meets"))
    return sent.select("band", "h", "sid", "label", "block", "is_top", F.least("block", "meets").alias("i"), F.greatest("block", "meets").alias("j"))


#: So many of a set's least hashes travel with its node. Sets that have no more are compared exactly by them; of others
#: a pair at the similarity is taken for a lesser one, 4.1 deviations off, once in 45,000 times.
LEAST_HASHES, DEVIATIONS = 256, 4.1


def may_be_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> float:
    """The share of common hashes up to where both lists are whole; 0 if that rules out ``similarity``."""
    full = [z[-1] for z in (x, y) if len(z) == LEAST_HASHES]
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    if full:
        both = both[: np.searchsorted(both, min(full), "right")]
    common = int((both[1:] == both[:-1]).sum())
    n = len(both) - common
    share = common / max(1, n)
    slack = DEVIATIONS * (similarity * (1 - similarity) / n) ** 0.5 if full else 1e-12
    return share if share >= similarity - slack else 0.0


def block_pairs(nodes: DataFrame, similarity: float, nearest: bool, chunk: int = 1024) -> DataFrame:
    """All pairs a < b of nodes (sid, sketch, low: the least hashes, bands, label) of different labels that share a band, agree in
    enough minima and may have that similarity by their least hashes.

    ``nearest``: only one for each node outside its bucket's largest component, with the node that it agrees with most."""

    least = _least_agreeing(similarity)

    def run(key: tuple, got: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, np.uint64) for x in got["low"].to_pylist()]
        sketches, sid, label, block = _sketches(got["sketch"]), got["sid"].to_numpy(), got["label"].to_numpy(), got["block"].to_numpy()
        i, j, is_top = key[2].as_py(), key[3].as_py(), got["is_top"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found, best = [], {}
        for at, x in enumerate(left):
            y = right[at + 1 :] if i == j else right
            y = y[label[y] != label[x]]
            agree = (sketches[y] == sketches[x]).sum(axis=1)
            y = y[agree >= least]
            share = np.array([may_be_similar(low[x], low[z], similarity) for z in y.tolist()])
            y, share = y[share > 0], share[share > 0]
            if nearest:
                for other, n in zip(y.tolist(), share.tolist(), strict=True):
                    for a, b in ((int(x), other), (other, int(x))):
                        if not is_top[a] and n > best.get(a, (0, 0))[0]:
                            best[a] = (n, b)
            elif len(y):
                found.append((np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])))
        if best:
            x, y = np.fromiter(best, np.int64), np.array([b for _, b in best.values()])
            found = [(np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]))]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return dealt_blocks(nodes, chunk).join(nodes.select("sid", "sketch", "low"), "sid").groupBy("band", "h", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _set_node(sid):
    """The number of a set in the graph that also has fingerprints."""
    return F.xxhash64(F.lit("set"), sid)


def similar_links(docs: DataFrame, prints: DataFrame, proven: DataFrame, shingle: int, similarity: float, chunk: int = 1024) -> DataFrame:
    """Edges (a, b) between numbers of sets and fingerprints: they join the components of ``proven`` edges and of all similar
    pairs of sets that share a band."""
    one = F.min(F.struct("th", "doc_id")).alias("one")
    every = prints.groupBy("sid").agg(one, F.first("sketch").alias("sketch"), F.first("bands").alias("bands")).select("sid", "one.*", "sketch", "bands")
    nodes = written(every, "nodes")
    met = written(meetings(nodes), "met")
    nodes = written(nodes.join(met.select("sid"), "sid"), "meeting")
    sets = written(shingle_sets(docs, nodes, shingle), "sets")
    low = sets.select("sid", F.substring("grams", 1, 8 * LEAST_HASHES).alias("low"))
    nodes = written(nodes.select("sid", "sketch", "bands", _set_node(F.col("sid")).alias("node")).join(low, "sid"), "compared")
    named = lambda pairs: pairs.select(_set_node(F.col("a")).alias("a"), _set_node(F.col("b")).alias("b"))
    stars = _agreeing(met.filter("a IS NOT NULL").select("a", F.col("sid").alias("b")), nodes, _least_agreeing(similarity))
    first = components(proven.unionByName(named(_verified(written(stars, "stars"), sets, similarity))))
    for nearest in (True, False):
        labelled = written(nodes.join(first, "node", "left").select("sid", "sketch", "low", "bands", F.coalesce("component", "node").alias("label")), "labelled")
        more = _verified(written(block_pairs(labelled, similarity, nearest, chunk), "candidates"), sets, similarity)
        edges = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(named(more))
        first = components(edges) if nearest else edges
    return first


class _Forest:
    """Components of positions, as the smallest position of each."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Close the components over these edges: each round, roots take the smallest root that they touch."""
        while len(a):
            ra, rb = self.of[a], self.of[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.of, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def walk(keys: np.ndarray, left: int, start: int, half: int, budget: int) -> np.ndarray:
    """Components of sorted distinct ``keys`` (uint64) under links of at most ``budget`` differing bits.

    ``left`` > 0: only the first ``left`` keys against the others are walked (two subtrees), else all against all.
    ``start``: level of the subtrees' roots. At most ``half`` differences down to level 32.
    """
    forest = _Forest(len(keys))
    for allowed in (half, budget):
        changes = np.cumsum(np.append(0, forest.of[1:] != forest.of[:-1]))
        one = lambda lo, hi: changes[hi - 1] == changes[lo]  # noqa: E731  all of a range in one component
        if left:
            gap = int(keys[0] ^ keys[left]) >> (64 - start) if start else 0
            pairs = [np.array([x]) for x in (0, left, left, len(keys), gap.bit_count())]
        else:
            pairs = [np.array([x]) for x in (0, len(keys), 0, len(keys), 0)]
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(start, 64):
            a, a2, b, b2, e = pairs
            keep = (e <= (min(half, allowed) if level <= 32 else allowed)) & ~((a == b) & (a2 - a == 1))
            keep &= ~(one(a, a2) & one(b, b2) & (forest.of[a] == forest.of[b]))
            single = keep & ((a2 - a) * (b2 - b) == 1)
            if single.any():
                links.append((a[single], b[single]))
            a, a2, b, b2, e = (x[keep & ~single] for x in pairs)
            if not len(a):
                break
            bit = np.uint64(1) << np.uint64(63 - level)
            split = lambda lo, hi: _first_set(ones, lo, hi)
            ones = np.append(0, np.cumsum((keys & bit) != 0))
            am, bm = split(a, a2), split(b, b2)
            same = a == b
            pairs = []
            sides = ((a, am, b, bm, e), (am, a2, bm, b2, e), (a, am, bm, b2, e + 1), (am[~same], a2[~same], b[~same], bm[~same], e[~same] + 1))
            kept = [(x[1] > x[0]) & (x[3] > x[2]) for x in sides]
            pairs = [np.concatenate([x[i][k] for x, k in zip(sides, kept, strict=True)]) for i in range(5)]
        else:
            a, a2, b, b2, e = pairs
            done = (e <= allowed) & (a != b)
            links.append((a[done], b[done]))
        for a, b in links:
            near = np.bitwise_count(keys[a] ^ keys[b]) <= allowed
            forest.join(a[near], b[near])
    return forest.of


def _first_set(ones: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Within a node's range of sorted keys, where those with the next bit set begin."""
    return hi - (ones[hi] - ones[lo])


def _swapped(fp):
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def links(prints: DataFrame, budget: int = 4, subtree: int = 4096) -> DataFrame:
    """Edges (a, b) that join near fingerprints; ``prints``: distinct fp. A task holds two subtrees of at most three
    times ``subtree`` fingerprints together: larger pairs of nodes are walked down by four more levels before they are dealt."""
    half = budget // 2
    depth = min(20, max(2, int(np.ceil(np.log2(max(1, prints.count()) / subtree)))))
    tries = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("turn"), _swapped(F.col("fp")).alias("key"))))
    roots = prints.select("fp", tries.alias("t")).select("fp", "t.turn", "t.key", F.lit(0).cast("long").alias("mask"))
    found, sent = [], _descended(roots, 0, depth, half, budget)
    while True:
        large = written(sent.groupBy("turn", "low", "mask").agg(F.count("*").alias("n")).filter(F.col("n") > 3 * subtree).drop("n"), "large") if depth < 60 else None
        if large is None or large.isEmpty():
            return _union([*found, _walked(sent, depth, half, budget)])
        found.append(_walked(sent.join(large, ["turn", "low", "mask"], "left_anti"), depth, half, budget))
        deeper = min(60, depth + 4)
        sent = written(_descended(sent.join(large, ["turn", "low", "mask"], "left_semi"), depth, deeper, half, budget), "descended")
        depth = deeper


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _descended(keys: DataFrame, depth: int, deeper: int, half: int, budget: int) -> DataFrame:
    """Each key (fp, turn, key, mask: how its pair of nodes at ``depth`` differs) with the pairs at ``deeper`` that it belongs to:
    low, the lesser node, and mask. A pair within one node is dealt once a key, as is each side of a pair of two."""
    most = half if deeper <= 32 else budget
    more = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(deeper - depth), k)]
    node = F.shiftrightunsigned("key", 64 - deeper)
    each = keys.select("fp", "turn", "key", "mask", F.explode(F.array(*[F.lit(m).cast("long") for m in more])).alias("bits"))
    dealt = each.select("fp", "turn", "key", F.shiftleft("mask", deeper - depth).bitwiseOR(F.col("bits")).alias("mask")).filter(F.bit_count("mask") <= most)
    return dealt.select("fp", "turn", "key", "mask", F.least(node, node.bitwiseXOR(F.col("mask"))).alias("low"))


def _walked(sent: DataFrame, depth: int, half: int, budget: int) -> DataFrame:
    def run(group: tuple, got: pa.Table) -> pa.Table:
        keys, fp = got["key"].to_numpy().view(np.uint64), got["fp"].to_numpy()
        by = np.argsort(keys)
        keys, fp = keys[by], fp[by]
        mask, low = group[2].as_py(), group[1].as_py()
        left = int(np.searchsorted(keys >> np.uint64(64 - depth), low, "right")) if mask else 0
        if len(keys) < 2 or (mask and left in (0, len(keys))):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = walk(keys, left, depth, half, budget)
        some = root != np.arange(len(keys))
        return pa.table({"a": fp[some], "b": fp[root[some]]})

    return sent.select("turn", "low", "mask", "key", "fp").groupBy("turn", "low", "mask").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest member) for each node of the edges (a, b), by alternating large and small stars."""
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "nb > a")
        small = _star(large, None)
        previous, current = current, written(small, "edges")
        drop_table(previous)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _star(pairs: DataFrame, large: str | None) -> DataFrame:
    """Tie each node's neighbours (those above it for a large star, those below for a small one) to the least of them all."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        least = written(least, "least")  # so that Spark can split the many edges of one node in the join
        out = pairs.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that can be reached over links: fingerprints of at most ``budget``
    differing bits and, unless ``similarity`` is None, texts whose sets of distinct shingles are that similar."""
    prints = written(fingerprints(docs, shingle, similarity is not None), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = links(distinct, budget)
    if similarity is not None:
        has = prints.select(F.col("fp").alias("a"), _set_node(F.col("sid")).alias("b")).distinct()
        edges = similar_links(docs, prints, written(edges.unionByName(has), "proven"), shingle, similarity)
    found = components(edges)
    rooted = written(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")), "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    named = written(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "named")
    return prints.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
