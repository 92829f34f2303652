"""Operator 9: SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import WORD, drop_marked, join_on, lean, materialize, shuffle_partitions, spread, text_batches

BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Buckets above this many fingerprints are cut into blocks, and each pair of blocks becomes a bucket.
BLOCK = 1024
#: (query, word of 64 lanes) pairs that are compared at once.
SLICE = 1 << 17
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 14


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The 64 bits that more than half of ``h`` set, unsigned; zero for none."""
    if not len(h):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint_udf(shingle: int):
    @F.pandas_udf("long")
    @lean()
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return prints


#: Minima of a sketch, and of them the pairs that make up the bands.
MINIMA, BANDS = 128, 16
#: Sketches that agree in this share of their values make a candidate; the exact count decides. Of pairs alike by 0.8, 7 in 10**8 are below.
CANDIDATE = 0.6
#: Nodes with sets that are compared at once: sets of long documents are large.
SETS = 256


def minima(h: np.ndarray) -> np.ndarray:
    """Smallest values of the distinct shingle hashes under MINIMA multiply-and-add permutations."""
    rng = np.random.default_rng(9)
    mul = rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    h = np.unique(h)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024, None] * mul + add
        np.minimum(out, (part ^ (part >> np.uint64(29))).min(axis=0), out=out)
    return out


def sketch_udf(shingle: int):
    @F.pandas_udf("fp long, bands array<long>, sketch binary, set_id binary")
    @lean()
    def sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            fps, bands, marks, sets = [], [], [], []
            for t in batch:
                h = np.unique(shingle_hashes(t, shingle))  # similarity is of sets, so repeats must not move the fingerprint
                low = minima(h)
                fps.append(majority(h))
                bands.append([xxhash.xxh64_intdigest(low[2 * k : 2 * k + 2].tobytes(), k) - (1 << 63) for k in range(BANDS)])
                marks.append((low >> np.uint64(3)).astype(np.uint8).tobytes())
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
            yield pd.DataFrame({"fp": np.array(fps, dtype=np.uint64).view(np.int64), "bands": bands, "sketch": marks, "set_id": sets})

    return sketches


def set_udf(shingle: int):
    @F.pandas_udf("binary")
    @lean()
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch])

    return sets


# --- which fingerprints can be near: blocks of bits that must agree ---


def scheme(n: int, radius: int, fill: int = 512) -> list[int]:
    """Masks of bits. Any two fingerprints within ``radius`` agree on at least one mask's bits.

    The bits are cut into radius + a blocks; of those, at most ``radius`` differ, so some ``a`` agree.
    ``a`` grows until a mask's values outnumber n / ``fill``, so that buckets stay small at any n.
    """
    for a in range(1, 5):
        m = radius + a
        if a == 4 or n / 2 ** (BITS * a / m) <= fill:
            edges = [BITS * i // m for i in range(m + 1)]
            blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
            return [sum(c) for c in combinations(blocks, a)]
    raise AssertionError


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# --- comparison within buckets ---


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, stored vertically: row p holds bit p of 64 fingerprints in each word. len(fps) is a multiple of 64."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(query: np.ndarray, word: np.ndarray, q_planes: np.ndarray, w_planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query, word): which pairs have near lanes, and the lanes, as a mask of 64 bits.

    q_planes[p] is all ones or zero for each query. Distances of 64 lanes at a time are counted in
    carry-save form (ones, twos, fours ..., and a sticky bit beyond), four planes a step.
    After some steps, pairs all of whose lanes exceed the radius are abandoned.
    """
    alive = np.arange(len(query))
    levels = [np.zeros(len(query), dtype=np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = np.zeros(len(query), dtype=np.uint64)

    def exceeded():
        more, equal = np.zeros_like(over), ~np.zeros_like(over)
        for k in reversed(range(len(levels))):
            if radius >> k & 1:
                equal = equal & levels[k]
            else:
                more |= equal & levels[k]
                equal = equal & ~levels[k]
        return over | more

    for at in range(0, BITS, 4):
        q, w = query[alive], word[alive]
        a, b, c, d = (q_planes[p][q] ^ w_planes[p][w] for p in range(at, at + 4))
        ones, twos = levels[:2]
        half = a ^ b
        carry1 = (a & b) | (half & ones)
        ones = ones ^ half
        half = c ^ d
        carry2 = (c & d) | (half & ones)
        levels[0] = ones ^ half
        half = carry1 ^ carry2
        carry = (carry1 & carry2) | (half & twos)
        levels[1] = twos ^ half
        for k in range(2, len(levels)):
            levels[k], carry = levels[k] ^ carry, levels[k] & carry
        over = over | carry
        if at in (12, 20, 28, 40, 48, 60):
            stay = np.flatnonzero(exceeded() != np.uint64(0xFFFFFFFFFFFFFFFF))
            alive, over, levels = alive[stay], over[stay], [x[stay] for x in levels]
            if not len(alive):
                break
    return alive, ~exceeded()


def forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over the links, by hooking and pointer jumping."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def compare(fps: np.ndarray, run: np.ndarray, radius: int, alike=None) -> np.ndarray:
    """``fps`` in runs of equal ``run`` (sorted): for each, the index of the first that links reach within its run.
    ``alike`` may turn down some of the pairs (i, j) within ``radius``."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, n])
    label = np.arange(n)
    keep = sizes > 1
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts):
        return label
    words = -(-sizes // 64)
    first_word = np.r_[0, np.cumsum(words)[:-1]]
    lane = np.full(int(words.sum()) * 64, -1, dtype=np.int64)
    slot = np.repeat(first_word * 64 - starts, sizes) + np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes, strict=True)])
    members = np.repeat(starts, sizes) + (slot - np.repeat(first_word * 64, sizes))
    lane[slot] = members
    w_planes = planes(np.where(lane >= 0, fps[np.maximum(lane, 0)], 0))
    q_planes = np.where(np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    run_of = np.repeat(np.arange(len(starts)), sizes)
    pairs = words[run_of]
    upto = np.cumsum(pairs)
    at = 0
    while at < len(members):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + SLICE, side="right")))
        m, k = members[at:stop], pairs[at:stop]
        query = np.repeat(m, k)
        offset = np.arange(len(query)) - np.repeat(np.cumsum(k) - k, k)
        word = np.repeat(first_word[run_of[at:stop]], k) + offset
        hit, mask = within(query, word, q_planes, w_planes, radius)
        live = mask != 0
        hit, mask = hit[live], mask[live]
        for part in range(0, len(hit), 1 << 14):
            h, x = hit[part : part + (1 << 14)], mask[part : part + (1 << 14)]
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            i, j = query[h][r], lane[word[h][r] * 64 + c]
            ok = (j >= 0) & (i < j)
            i, j = i[ok], j[ok]
            if alike is None:
                label = forest(n, i, j, label) if len(i) else label
                continue
            for asked in range(0, len(i), PAIRS):  # in a dense bucket most pairs are joined by those before them
                x, y = i[asked : asked + PAIRS], j[asked : asked + PAIRS]
                ok = label[x] != label[y]
                x, y = x[ok], y[ok]
                ok = alike(x, y)
                if ok.any():
                    label = forest(n, x[ok], y[ok], label)
        at = stop
    return label


def linker(radius: int, similarity: float | None = None):
    """Over rows sorted by (bucket, node): a link from each node to the first it reaches in its bucket."""

    @lean()
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(t: pa.Table) -> pa.RecordBatch:
            b, v, f = (t.column(k).to_numpy() for k in range(3))
            alike = None
            if similarity is not None:
                marks = np.frombuffer(b"".join(t.column(3).to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
                least = agreeing(similarity)
                alike = lambda i, j: (marks[i] == marks[j]).sum(axis=1) >= least
            label = compare(f.view(np.uint64), b, radius, alike)
            linked = np.flatnonzero(label != np.arange(len(f)))
            x, y = v[linked], v[label[linked]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            buckets = t.column(0).to_numpy()
            last = int(np.searchsorted(buckets, buckets[-1]))
            if last:
                yield solve(t.slice(0, last))
                held = t.slice(last).to_batches()
                rows -= last
        if rows:
            yield solve(pa.Table.from_batches(held))

    return link


def agreeing(share: float) -> float:
    """Least count of equal values of two sketches for ``share``: bytes of different minima agree once in 256 times."""
    return MINIMA * (share + (1 - share) / 256)


def verify(marks: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the index of the first that links of ``similarity`` or more reach. Pairs whose sketches
    agree are counted exactly, unless links join them already."""
    n = len(sets)
    label = np.arange(n)
    agree = np.zeros((n, n), dtype=np.int16)
    for k in range(MINIMA):
        agree += marks[:, k, None] == marks[None, :, k]
    i, j = np.nonzero(np.triu(agree >= agreeing(CANDIDATE), 1))
    order = np.argsort(-agree[i, j], kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if label[a] == label[b]:
            continue
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both >= similarity * (len(x) + len(y) - both) - 1e-9:
            low, high = sorted((label[a], label[b]))
            label[label == high] = low
    return label


def verifier(similarity: float):
    """Over rows sorted by (bucket, node): exact links of each bucket, one bucket in memory at a time."""

    @lean()
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = t.column(1).to_numpy()
            marks = np.frombuffer(b"".join(t.column(2).to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
            label = verify(marks, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column(3)], similarity)
            x, y = v, v[label]
            linked = x != y
            x, y = x[linked], y[linked]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else []
            for s, e in zip(starts, [*starts[1:], len(buckets)], strict=True):
                if held and buckets[s] != current:
                    yield solve(held)
                    held = []
                current = buckets[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield solve(held)

    return link


def deal(rows: DataFrame, block: int) -> DataFrame:
    """(bucket, node) for each of a node's ``buckets`` that another node shares.

    Buckets over ``block`` nodes are dealt into blocks by a hash of the node, and each pair of blocks
    becomes a bucket of its own. The sizes of buckets join back through salted slots.
    """
    dealt = materialize(rows.select("node", F.explode("buckets").alias("bucket")), "simhash-dealt")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = spread(dealt, sizes, ["bucket"], ["node"])
    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("bucket", F.least(o, mine), F.greatest(o, mine)))
    return dealt.select("node", F.explode(F.when(F.col("blocks") == 1, F.array("bucket")).otherwise(pairs)).alias("bucket"))


def near_links(prints: DataFrame, radius: int, fill: int = 512, block: int = BLOCK) -> DataFrame:
    """Links (u > v) over distinct fingerprints ``fp`` whose transitive closure is that of all pairs within ``radius``.

    A bucket is a mask's bits of a fingerprint. It yields a star for each group that it links,
    not all pairs.
    """
    masks = scheme(prints.count(), radius, fill)
    fp = F.col("fp")
    buckets = F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)])
    dealt = deal(prints.select(fp.alias("node"), buckets.alias("buckets")), block)
    dealt = dealt.repartition(shuffle_partitions(prints.sparkSession), "bucket").sortWithinPartitions("bucket", "node")
    return dealt.select("bucket", "node", F.col("node").alias("fp")).mapInArrow(linker(radius), "u long, v long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (u > v): root is the smallest node reachable.

    Alternates large and small stars, each a minimum per node and a salted join, until nothing
    changes; every round is written to the shared folder, so a lost executor costs one round.
    """
    edges = materialize(links.select("u", "v").distinct(), name)
    print_of = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread(both.filter("v > u"), low, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u != v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, low, ["u"], ["v"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u != v").distinct(), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == print_of:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        print_of = now


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, fill: int = 512, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (the smallest doc_id reachable over links).

    Documents link if their fingerprints differ in at most ``radius`` bits. Equal fingerprints
    are one node, so copies cost nothing; documents of no words (null too) have fingerprint
    zero and link like any other. A null doc_id never names a component unless all its
    members are null. Repeated rows share a component. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    prints = materialize(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(nodes.select("fp"), radius, fill, block), "simhash-links")
    nodes = join_on(nodes, roots.withColumnRenamed("node", "fp"), ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = materialize(nodes, "simhash-nodes")
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = spread(nodes, smallest, ["root"], ["fp"]).select("fp", "component_id")
    return spread(prints, named, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 28, block: int = BLOCK) -> DataFrame:
    """Documents by groups whose sets of ``shingle`` words are alike by ``similarity`` or more, by exact count.

    One row per distinct pair of doc_id and text that has words: doc_id, _sha (SHA-256 of the text), n (rows
    of the pair), component_id (the group's smallest doc_id) and kept, true for one pair of each
    group: that of the smallest doc_id, and of its texts the smallest by SHA-256. Ids may repeat or be null; a null
    id comes after all others.

    At that similarity fingerprints differ in many of their 64 bits, too many for blocks of equal
    bits. Candidates share one of sixteen pairs of minima instead (of two texts of similarity 0.8, all but
    8 in 10**8); the bit-sliced comparison abandons those beyond ``radius`` bits, and the rest are linked
    loosely if their sketches of 128 minima agree in CANDIDATE. Only members of such loose groups send their
    sets of shingle hashes on, and within a group each candidate pair that is not yet joined is counted exactly.
    Equal sets are one node, under a key written with it; texts without words never link.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sha = F.unhex(F.sha2("text", 256)).alias("_sha")
    sketched = docs.select("doc_id", sha, sketch_udf(shingle)("text").alias("s"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("w"))
    rows = materialize(sketched.filter("w").select("doc_id", "_sha", "s.*"), "near-sketches")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_sha")
    nodes = rows.groupBy("set_id").agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in ("fp", "sketch")], F.first("bands").alias("buckets"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    dealt = join_on(deal(nodes, block), nodes.select("node", "fp", "sketch"), ["node"])
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "node")
    links = dealt.select("bucket", "node", "fp", "sketch").mapInArrow(linker(radius, CANDIDATE), "u long, v long").distinct()
    loose = join_on(nodes.select("node", "place", "sketch"), components(links, "near-loose"), ["node"])
    loose = materialize(loose.select("node", "place.doc_id", "place._sha", "sketch", F.array("root").alias("buckets")), "near-candidates")

    small = loose.limit(500_001).count() <= 500_000
    wanted = loose.select("doc_id", "_sha", "node")
    bodies = join_on(docs.select("doc_id", sha, F.col("text").alias("_text")), F.broadcast(wanted) if small else wanted.hint("merge"), ["doc_id", "_sha"])
    sets = materialize(bodies.dropDuplicates(["node"]).select("node", set_udf(shingle)("_text").alias("set")), "near-sets")
    dealt = join_on(join_on(deal(loose, SETS), loose.select("node", "sketch"), ["node"]), sets, ["node"])
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "node")
    links = dealt.select("bucket", "node", "sketch", "set").mapInArrow(verifier(similarity), "u long, v long").distinct()

    roots = components(links, "near-links")
    nodes = join_on(nodes.select("set_id", "node", "place"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    nodes = materialize(nodes, "near-rooted")
    first = nodes.groupBy("root").agg(F.min("place").alias("first"))
    named = spread(nodes.drop("place"), first, ["root"], ["node"]).select("set_id", "first")
    pairs = rows.groupBy("doc_id", "_sha").agg(F.count("*").alias("n"), F.first("set_id").alias("set_id"))
    return spread(pairs, named, ["set_id"], ["doc_id", "_sha"]).select(
        "doc_id", "_sha", "n", F.col("first.doc_id").alias("component_id"), place.eqNullSafe(F.col("first")).alias("kept")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one that near_copies keeps.

    A row is told by its doc_id and text together, null-safely, and one of rows that repeat both stays. Texts without
    words (null too) all stay. Extra columns pass through whatever their names; an empty table stays empty. Texts
    move only if over 500,000 such pairs go, and those of repeated rows.
    """
    marks = near_copies(docs).filter("not kept or n > 1").select("doc_id", F.col("_sha").alias("sha"), F.col("kept").alias("stays"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    return drop_marked(rows, materialize(marks, "near-marks"), ["doc_id", "sha"])


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
