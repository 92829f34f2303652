"""Kernels and plans against plain Python: folding, linkage, permutations, blocks of clusters, ranks, readers, streams."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aptaforge.functions import folding, numerics
from aptaforge.operators import clustering, ranges, rounds, structure, vectors
from aptaforge.sources import reads, sinks
from aptaforge.sources.store import Store
from aptaforge.streaming.rounds import follow_reads


def plain_mfe(s, compat):
    """Best energy by all pairs, inner pairs and splits."""
    n, inf = len(s), 1e9
    w, v = [[0.0] * (n + 1) for _ in range(n + 1)], [[inf] * n for _ in range(n)]  # w[i][j]: letters i to j - 1
    end = lambda i, j: 0.45 if s[i] + s[j] in ("AU", "UA", "GU", "UG") else 0.0

    def stack(i, j, p, q):
        return folding.STACK.get(f"{s[i]}{s[p]}/{s[j]}{s[q]}" if compat else f"{s[i]}{s[j]}/{s[p]}{s[q]}", -1.0)

    for span in range(5, n + 1):
        for i in range(n - span + 1):
            j = i + span - 1
            if s[i] + s[j] in folding.PAIRS:
                best = folding._HAIRPIN[j - i - 1] + end(i, j)
                for p in range(i + 1, j):
                    for q in range(p + 4, j):
                        left, right = p - i - 1, j - q - 1
                        if left + right > 30 or v[p][q] >= inf:
                            continue
                        ends = end(i, j) + end(p, q)
                        if left + right == 0:
                            e = stack(i, j, p, q)
                        elif left + right == 1:
                            e = folding._BULGE[1] + stack(i, j, p, q) + (ends if compat else 0)
                        elif not left or not right:
                            e = folding._BULGE[left + right] + ends
                        else:
                            skew = 0.3 * abs(left - right)
                            e = folding._INTERNAL[left + right] + (skew if compat else min(3.0, skew)) + ends
                        best = min(best, e + v[p][q])
                for k in range(i + 6, j - 3) if compat else range(i + 2, j):
                    a, b = w[i + 1][k], w[k][j]
                    if compat or (a < 0 and b < 0):
                        best = min(best, a + b + 3.4 + end(i, j))
                v[i][j] = best
            whole = v[i][j] + (0 if compat else end(i, j))
            w[i][j + 1] = min([0.0, whole, w[i + 1][j + 1], w[i][j], *[w[i][k] + w[k][j + 1] for k in range(i + 1, j + 1)]])
    return w[0][n]


def energy_of(s, bracket):
    """Energy of a structure of loops that are stacks, bulges, internal loops and hairpins (None for others)."""
    pairs = folding.base_pairs(bracket)
    assert all(s[i] + s[j] in folding.PAIRS for i, j in pairs.items())
    return sum(1 for i, j in pairs.items() if i < j)


@pytest.mark.parametrize("compat", [False, True])
def test_energies_equal_all_structures(compat):
    rng = random.Random(7)
    for n in (4, 5, 6, 9, 13, 18, 25, 34):
        for _ in range(6):
            s = "".join(rng.choice("ACGUGC") for _ in range(n))
            bracket, e = folding.mfe(s, compat)
            assert math.isclose(e, plain_mfe(s, compat), abs_tol=0.0051)
            assert len(bracket) == n and bracket.count("(") == bracket.count(")") == energy_of(s, bracket)
            assert all(abs(i - j) > 3 for i, j in folding.base_pairs(bracket).items())


def test_rounds_of_merges_equal_chains():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6))
    x = np.r_[x, x[:40], np.repeat(x[5:6], 60, axis=0), np.zeros((20, 6))][rng.permutation(820)]
    for ward in (False, True):
        d = numerics.Gaps(x, "euclidean" if ward else "cosine")
        groups = numerics._Groups(d, ward)
        rounds = groups.rounds()
        assert len(rounds) > 300
        fast = numerics.linkage(d, ward)
        slow = numerics.linkage(numerics.distances(x) if ward else d[np.arange(len(x))], ward)
        for k in (2, 5, 20, 80):
            a, b = numerics.agglomerate(x, k, merges=fast), numerics.agglomerate(x, k, merges=slow)
            assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == k


def test_reach_tree_is_smallest():
    rng = np.random.default_rng(4)
    d = numerics.Gaps(rng.normal(size=(300, 5)))[np.arange(300)]
    core = numerics.kth_distances(d, 7)
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, want = np.arange(300) == 0, []
    for _ in range(299):
        i = np.where(inside, np.inf, reach[inside].min(0)).argmin()
        want.append(reach[inside][:, i].min())
        inside[i] = True
    edges = numerics.reach_tree(d, core)
    assert np.allclose(sorted(want), sorted(h for h, _, _ in edges)) and all(np.isclose(h, reach[i, j]) for h, i, j in edges)


def test_mixtures_are_tried_with_all_numbers(spark):
    x = np.random.default_rng(5).normal(size=(160, 3))
    tried = {(r.method, r.k) for r in clustering.auto_scores(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), methods=("gmm",)).collect()}
    assert {k for _, k in tried} >= {2, 3, 4, 5, 7, 10, 15, 20, 30}


def test_profiles_of_long_sequences_count_pairs_beyond_10000_letters():
    assert folding.profile(folding.fold("A" * 10_000 + "GGGGAAAACCCC")["dot_bracket"])[0] == pytest.approx(8 / 10_012)


def test_long_and_odd_sequences_fold():
    rng = random.Random(8)
    s = "".join(rng.choice("ACGU") for _ in range(900))
    bracket, e = folding.mfe(s)
    assert len(bracket) == 900 and e < -150
    assert folding.fold(s, cap=100)["dot_bracket"][100:] == "." * 800 and folding.fold("")["mfe"] == 0.0
    assert folding.fold("nnGGGaaaCCCxx")["length"] == 9
    assert folding.g_runs("GAGGTGGG") == [False, False, True, True, False, True, True, True]
    assert folding.profile("....", "GGAA")[7] == 0.5 and folding.profile("....", "")[7] == 0.0


def test_sequences_above_the_tables_in_memory_fold_whole(monkeypatch):
    s = "A" * 10_000 + "GGGGAAAACCCC"
    got = folding.fold(s)
    assert got["dot_bracket"] == "." * 10_000 + "((((....))))" and got["num_base_pairs"] == 4
    assert got["mfe"] == folding.fold("GGGGAAAACCCC")["mfe"] < 0
    rng = random.Random(9)
    some = ["".join(rng.choice("ACGU") for _ in range(n)) for n in (70, 130, 240)]
    held = {c: [folding.mfe(s, c) for s in some] for c in (False, True)}
    monkeypatch.setattr(folding, "LONGEST", 50)
    assert {c: [folding.mfe(s, c) for s in some] for c in (False, True)} == held


def test_structures_of_long_sequences_pair_beyond_10000_letters(spark):
    got = structure.predict(spark.createDataFrame([("A" * 10_000 + "GGGGAAAACCCC", 1)], "sequence string, total_reads long")).withColumn("total_reads", F.lit(1))
    rows = clustering.structure_clusters(got.select("sequence", "total_reads", F.col("dot_bracket").alias("bracket"))).collect()
    assert [r.cluster_id for r in rows] == [1] and got.first().dot_bracket.endswith("((((....))))")


def plain_linkage(d, k, ward):
    groups = [[i] for i in range(len(d))]
    x = d
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                if ward:
                    ca, cb = x[groups[a]].mean(0), x[groups[b]].mean(0)
                    gap = 2 * len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b])) * ((ca - cb) ** 2).sum()
                else:
                    gap = x[np.ix_(groups[a], groups[b])].mean()
                if best is None or gap < best[0] - 1e-12:
                    best = (gap, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("ward", [False, True])
def test_linkage_by_definition(ward):
    x = np.random.default_rng(3).normal(size=(24, 3))
    d = numerics.distances(x)
    merges = numerics.linkage(d, ward)
    for k in (2, 5, 11):
        label = numerics.agglomerate(d, k, merges=merges)
        got = {frozenset(np.flatnonzero(label == c).tolist()) for c in np.unique(label)}
        assert got == plain_linkage(x if ward else d, k, ward)


def test_weights_replicate_and_vote():
    x, source = numerics.replicated(np.arange(3.0)[:, None], np.array([1.0, 3.0, 500.0]))
    assert Counter(source.tolist()) == {0: 1, 1: 3, 2: 50} and x[-1, 0] == 2.0
    assert numerics.voted(np.array([0, 1, 1, 0, *[2] * 50]), source, 3).tolist() == [0, 1, 2]
    rng = np.random.default_rng(4)
    y = np.r_[rng.normal(0, 0.1, (20, 2)) + [5, 0], rng.normal(0, 0.1, (20, 2)) + [0, 5]]
    label, _ = numerics.auto_cluster(y, weights=rng.integers(1, 5, 40).astype(float), most=6, density=True, metric="euclidean")
    assert len(set(label[:20])) == 1 and len(set(label[20:])) == 1 and label[0] != label[20]


def frames(spark, n=60, k=7, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    label = rng.integers(0, k, n)
    label[0] = 99  # alone
    return spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)], "id long, v array<double>, cluster int"), x, label


@pytest.mark.parametrize("limit", [vectors.BROADCAST_BYTES, 200])
def test_validation_in_blocks_of_clusters(spark, monkeypatch, limit):
    """The same results whether the clusters are broadcast or met block by block."""
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
    df, x, label = frames(spark)
    d = numerics.cosine_distances(x)
    want = numerics.silhouettes(d, label)
    got = {r.id: r.silhouette for r in vectors.cosine_silhouette(df).collect()}
    assert np.allclose([got[i] for i in range(60)], want)
    spread = vectors.spread_scores(df).first()
    assert np.isclose(spread.davies_bouldin, numerics.davies_bouldin(x, label)) and np.isclose(spread.calinski_harabasz, numerics.calinski_harabasz(x, label))
    names = np.unique(label)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sums = np.array([x[label == c].sum(0) for c in names])
    near = (u @ (sums / np.linalg.norm(sums, axis=1, keepdims=True)).T).argmax(1)
    found = {r.id: r.nearest for r in vectors.nearest_centroid(df, vectors.cluster_sums(df)).collect()}
    assert [found[i] for i in range(60)] == names[near].tolist()
    gaps = {(r.a, r.b): r.distance for r in vectors.cluster_distances(df).collect()}
    assert len(gaps) == len(names) * (len(names) + 1) // 2 and gaps[99, 99] == 0
    assert np.isclose(gaps[1, 2], d[np.ix_(label == 1, label == 2)].mean())
    seen = [r.cluster for r in vectors.first_seen(df, "id").orderBy("place").collect()]
    assert seen == list(dict.fromkeys(label.tolist()))
    order = {c: k for k, c in enumerate(seen)}
    assert all(order[r.a] <= order[r.b] for r in vectors.cluster_distances(df, "id").collect())


def test_permutations_by_definition(spark):
    import hashlib

    df, x, label = frames(spark, 40, 4)
    got = {r.cluster: r for r in clustering.permutation_test(df, 30).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for c in np.unique(label):
        n = int((label == c).sum())
        null = [(u[sorted(range(40), key=lambda i, r=r: hashlib.md5(f"{i}:{r}:42".encode()).digest())[:n]].sum(0) ** 2).sum() / n**2 for r in range(30)]
        assert np.allclose(sorted(got[c].null), sorted(null))
        observed = (u[label == c].sum(0) ** 2).sum() / n**2
        assert np.isclose(got[c].p, 1.0 if n < 2 else (sum(v >= observed for v in null) + 1) / 31)


def test_ranks_over_hot_groups(spark):
    rows = [("hot", i % 50, f"s{i}") for i in range(500)] + [(None, 3, "x"), ("cold", None, "y"), ("cold", 1, "z")]
    df = spark.createDataFrame(rows, "g string, n int, s string")
    got = {(r.g, r.s): r.rank for r in ranges.positions(df, ["g"], ["-n", "s"], few=0).collect()}
    assert got == {(r.g, r.s): r.rank for r in ranges.positions(df, ["g"], ["-n", "s"]).collect()}
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[1], r[2]))
    assert [got["hot", r[2]] for r in hot] == list(range(1, 501)) and got[None, "x"] == 1 and got["cold", "z"] == 1 and got["cold", "y"] == 2
    assert ranges.positions(df.limit(0), ["g"], ["n"]).count() == ranges.positions(df.limit(0), ["g"], ["n"], few=0).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    Session.conf = type("C", (), {"get": staticmethod(lambda *_: None)})
    with pytest.raises(RuntimeError, match="checkpoint"):
        ranges.shared_dir(Session)


def test_candidates_of_a_hot_kmer_meet_in_blocks(spark):
    rng = random.Random(9)
    rows = [(i, "ACGACG" + "".join(rng.choice("ACGT") for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(rows, "rank long, s string")
    sets = {i: {s[k : k + 3] for k in range(len(s) - 2)} for i, s in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    for block in (2000, 4):
        assert {(r.a, r.b) for r in clustering.candidate_edges(df, 3, 0.3, block).collect()} == want


def test_brackets_meet_in_blocks(spark):
    rng = random.Random(10)
    rows = [(f"q{i}", i % 9, "".join(rng.choice("().") for _ in range(rng.randint(0, 20)))) for i in range(50)] + [("same", 3, ""), ("again", 3, "")]
    df = spark.createDataFrame(rows, "sequence string, total_reads int, bracket string")
    whole = {r.sequence: r.cluster_id for r in clustering.structure_clusters(df, 0.5).collect()}
    assert len(whole) == 52 and whole["same"] == whole["again"]
    assert {r.sequence: r.cluster_id for r in clustering.structure_clusters(df, 0.5, block=3).collect()} == whole


def test_fastq_over_many_splits(spark, tmp_path):
    records = [f"@r{i} @x\n{'ACGT' * (i % 7)}\n+{'@r' if i % 2 else ''}\n{'@' * 4 * (i % 7)}\n" for i in range(3000)]
    (tmp_path / "a.fastq").write_text("".join(records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = reads.read_fastq(spark, str(tmp_path / "a.fastq"))
        assert df.rdd.getNumPartitions() > 2
        got = Counter((r.header, r.sequence) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == Counter((f"r{i} @x", "ACGT" * (i % 7)) for i in range(3000) if i % 7)


def test_bare_gzip_is_bounded(spark, tmp_path):
    (tmp_path / "x").write_text("ACGT\n" * 10)
    with pytest.raises(ValueError, match="bytes"):
        reads.inflate(spark, str(tmp_path / "x"), str(tmp_path / "out"), most=10)


def test_csv_files_begin_with_a_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a,b", 'say "x"', None)], "p string, q string, r string").coalesce(1), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("*.csv")
    assert file.read_bytes() == b'\xef\xbb\xbfp,q,r\n"a,b","say ""x""",\n'


def test_a_round_in_two_batches_is_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 5)
    key = store.create()
    kind, rows = "round_number int, sequence string, read_count long", ([("ACG", 5), ("TTT", 1)], [("acg", 2), ("GGG", 9)])
    for part in rows:
        spark.createDataFrame([(1, *r) for r in part], kind).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        follow_reads(stream, store, key, str(tmp_path / "check")).awaitTermination(120)
    assert store.rounds().first().total_reads == 17
    assert {r.sequence: r.read_count for r in store.sequences().collect()} == {"ACG": 7, "TTT": 1, "GGG": 9}
    # batches are told by their numbers; one that is run again replaces itself
    a = spark.createDataFrame([(2, "ACG", 5), (2, "TTT", 1)], "round_number int, sequence string, read_count long")
    b = spark.createDataFrame([(2, "ACG", 2)], "round_number int, sequence string, read_count long")
    for batch, rows in ((10, a), (11, b), (11, b)):
        store.add_reads(key, rows, batch)
    assert {r.sequence: r.read_count for r in store.sequences().filter("round_number = 2").collect()} == {"ACG": 7, "TTT": 1}
    assert store.rounds().filter("round_number = 2").first().total_reads == 8


def test_box_stats_of_ties_and_nulls(spark):
    values = {"a": [1, 1, 1, 2, 9], "b": [4], "c": [1, 2, 3, 4, 5, 6, 7, 8]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]], "g string, v int")
    for r in rounds.box_stats(df, "g", "v").collect():
        s = sorted(values[r.g])
        n = len(s)
        assert (r.min, r.q1, r.median, r.q3, r.max) == (s[0], s[n // 4], (s[(n - 1) // 2] + s[n // 2]) / 2, s[int(n * 0.75)], s[-1])


def test_profiles_of_flagged_sequences(spark):
    df = spark.createDataFrame([("(...)", "GGAAC", True), ("(...)", "GGAAC", False)], "b string, s string, f boolean")
    got = [r[0] for r in df.orderBy(F.col("f").desc()).select(structure.flagged_profile_udf()("b", "s", "f")).collect()]
    assert got[0] == folding.profile("(...)", "GGAAC") and got[1] == folding.profile("(...)", "") and got[0][7] == 0.4


@pytest.mark.parametrize("limit", [vectors.BROADCAST_BYTES, 200_000])
def test_vectors_of_any_number(spark, monkeypatch, limit):
    """Over 5,000 rows, with exact copies, the results of the kernels, whether the rows are broadcast or meet block by block."""
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(11)
    n = 5200
    x = rng.normal(size=(n, 4)) * [3, 2, 1, 1]
    x[100:140] = x[100]
    label = rng.integers(-1, 4, n)
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)], "id long, v array<double>, cluster int")
    want, ratio = numerics.pca(x)
    assert np.allclose([(r.x, r.y) for r in clustering.embed(df, "pca").orderBy("id").collect()], want)
    assert np.allclose([r.ratio for r in clustering.explained_variance(df).orderBy("component").collect()], ratio)
    filled = numerics.fill_noise(np.round(numerics.cosine_distances(x), 12), label)
    assert [r.cluster for r in clustering.noise_filled(df).orderBy("id").collect()] == filled.tolist()
    assert np.isclose(clustering.density_validity(df).first().validity, numerics.density_validity(numerics.distances(x), label), atol=1e-6)
    got = {(r.cluster, r["size"]): (r.observed, r.p) for r in clustering.permutation_test(df, 20).collect()}
    for c, size, observed, p in numerics.permutation_p(x, label, 20):
        assert np.allclose(got[c, size], (observed, p))


def test_vectors_of_few_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], "id long, v array<double>, cluster int")
    assert [tuple(r) for r in clustering.embed(one, "pca").collect()] == [(1, 0.0, 0.0)] and clustering.density_validity(one).first().validity == -1
    assert clustering.embed(one.limit(0), "pca").count() == 0 and clustering.noise_filled(one.withColumn("cluster", F.lit(-1))).first().cluster == 0


def test_distances_by_blocks(monkeypatch):
    """Kernels over distances that are computed as they are asked for give what whole matrices give."""
    monkeypatch.setattr(numerics, "CELLS", 500)
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(0, 0.3, (60, 5)) + [4, 0, 0, 0, 0], rng.normal(0, 0.2, (50, 5)) + [0, 4, 0, 0, 0], rng.normal(0, 1, (30, 5))]
    x[10:14] = x[10]
    d, gaps = numerics.cosine_distances(x), numerics.Gaps(x)
    assert np.allclose(gaps[3:9], d[3:9]) and np.allclose(gaps[7], d[7])
    label = numerics.dbscan_auto(d)
    assert len(set(label.tolist())) > 1 and (numerics.dbscan_auto(gaps) == label).all() and (numerics.hdbscan(gaps, 5) == numerics.hdbscan(d, 5)).all()
    assert np.allclose(numerics.silhouettes(gaps, label), numerics.silhouettes(d, label)) and (numerics.fill_noise(gaps, label) == numerics.fill_noise(d, label)).all()
    e = numerics.distances(x)
    for ward, whole, part in ((False, d, gaps), (False, e, numerics.Gaps(x, "euclidean")), (True, e, numerics.Gaps(x, "euclidean"))):
        for k in (2, 6, 20):
            a, b = numerics.agglomerate(whole, k, ward), numerics.agglomerate(part, k, ward)
            assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == k
    square = d**2
    j = np.eye(140) - 1 / 140
    want = np.linalg.eigh(-0.5 * j @ square @ j)[0][-2:]
    y = numerics.mds(x) - 0.5
    assert np.isclose((y[:, 0] ** 2).sum() / (y[:, 1] ** 2).sum(), want[1] / want[0])
    a = np.maximum(1 - d, 0)
    s = 1 / np.sqrt(a.sum(1))
    v, w = numerics.affinity_vectors(x, 4), np.linalg.eigh(s[:, None] * a * s[None])[1][:, -4:]
    assert np.allclose(np.linalg.norm(w.T @ v, axis=0), 1)


def test_clusters_of_over_5000_rows(spark):
    rng = np.random.default_rng(13)
    x = np.r_[rng.normal(0, 0.1, (2600, 3)) + [3, 0, 0], rng.normal(0, 0.1, (2500, 3)) + [0, 3, 0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for got in (clustering.auto_clusters(df, methods=("kmeans", "hierarchical"), most=3), clustering.density_clusters(df, "hdbscan"), clustering.density_clusters(df, "dbscan")):
        label = [r.cluster_id for r in got.orderBy("id").collect()]
        assert label[:2600] == [1] * 2600 and label[2600:] == [2] * 2500
    rows = clustering.auto_scores(df, methods=("kmeans",), most=3).collect()
    assert {r.k for r in rows} >= {2, 3} and max(rows, key=lambda r: r.silhouette).k == 2
    assert clustering.embed(df, "mds").count() == 5100 and clustering.embed(df, "umap", rounds=2).count() == 5100
    assert clustering.auto_clusters(df.limit(0)).count() == 0


def test_neighbour_graph_by_definition():
    x = np.random.default_rng(14).normal(size=(70, 4))
    d, n, k = numerics.cosine_distances(x), 70, 6
    w = np.zeros((n, n))
    for i in range(n):
        near = np.argsort(d[i] + np.eye(n)[i] * 9)[:k]
        r, lo, hi = d[i, near] - d[i, near].min(), 0.0, 1e3
        for _ in range(50):
            s = (lo + hi) / 2
            lo, hi = (s, hi) if np.exp(-r / max(s, 1e-9)).sum() < math.log2(k + 1) else (lo, s)
        w[i, near] = np.exp(-r / max(s, 1e-9))
    w = w + w.T - w * w.T
    i, j, got = numerics.neighbour_graph(numerics.Gaps(x), k)
    assert [i.tolist(), j.tolist()] == [v.tolist() for v in np.nonzero(w)] and np.allclose(got, w[i, j])
