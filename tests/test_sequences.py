import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from aptaforge.functions import folding, g4, numerics
from aptaforge.functions import sequences as sq
from aptaforge.operators import clustering, rounds
from aptaforge.sources.reads import detect_format, inflate, read_fasta, read_reads
from aptaforge.sources.store import Store


@pytest.mark.parametrize(
    ("header", "n"),
    [("seq-1234", 1234), ("id count=12", 12), ("id count:12", 12), ("id_x7", 7), ("id_7", 7), ("id reads=5 extra", 5), ("id;size=9;", 9), ("id 33", 33), ("id", 1)],
)
def test_header_counts(spark, header, n):
    assert spark.createDataFrame([(header,)], "h string").select(sq.header_count(F.col("h"))).first()[0] == n


def test_readers(spark, tmp_path):
    files = {
        "a.fa": ">a-2\nacg\nTTG\n\n>b 3>x\r\nACGTTG\r\n>c\nACGX\n>d-5\n", "b.tsv": "ACGT\t5\nACGT\t0\nACGT\tabc\nTT\t12x\n", "c.txt": "ACGT\nACGT\nacgt\n",
        "d.fq": "@r1\nACGT\n+\n@III\n@r2\nACGT\n+\n>>II\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    read = lambda n: {r[0]: r[1] for r in read_reads(spark, str(tmp_path / n)).collect()}
    assert read("a.fa") == {"ACGTTG": 3}
    assert {r["header"] for r in read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {"a-2", "b 3>x", "c"}
    assert read("b.tsv") == {"ACGT": 7, "TT": 12}
    assert read("c.txt") == {"ACGT": 3}
    assert detect_format(spark.read.text(str(tmp_path / "d.fq"))) == "fastq"
    assert {r[0]: r[1] for r in read_reads(spark, str(tmp_path / "d.fq"), "fastq").collect()} == {"ACGT": 2}
    (tmp_path / "odd").write_bytes(gzip.compress(b"ACGT\t4\n"))
    assert {r[0]: r[1] for r in read_reads(spark, inflate(spark, str(tmp_path / "odd"), str(tmp_path / "plain")), "tsv").collect()} == {"ACGT": 4}
    (tmp_path / "none.txt").write_text("!!\n")
    with pytest.raises(ValueError):
        read_reads(spark, str(tmp_path / "none.txt"))


def test_store_replaces_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), keep=2)
    key = store.create("trial")
    reads = spark.createDataFrame([("AC", 5), ("GG", 3), ("TT", 2)], "sequence string, read_count long")
    store.put_round(key, 1, reads)
    store.put_round(key, 1, reads)
    rows = store.detail(key).collect()
    assert [(r.sequence, r.read_count, r.percent_read) for r in rows] == [("AC", 5, 50.0), ("GG", 3, 30.0)]
    assert store.list().first()["rounds"][0]["total_reads"] == 10
    store.delete(key)
    spark.catalog.clearCache()
    assert Store(spark, str(tmp_path / "db")).list().count() == 0


def test_enrichment_literals(spark):
    rows = [(1, "A", 10, 10.0), (3, "A", 40, 40.0), (3, "B", 5, 5.0), (1, "C", 5, 5.0), (2, "D", 1, 1.0)]
    out = {r.sequence: r for r in rounds.enrichment(spark.createDataFrame(rows, "round_number int, sequence string, read_count long, percent_read double")).collect()}
    assert (out["A"].fold, out["A"].is_new) == (4.0, False)
    assert (out["B"].fold, out["B"].is_new) == (None, True)
    assert out["C"].fold == 0.0
    assert (out["D"].fold, out["D"].is_new, out["D"].r2) == (None, False, 1)


def test_scores(spark):
    df = spark.createDataFrame([("GGGACC",), ("",), ("GGAGGAGGAGG",)], "s string")
    row, empty, quad = df.select(g4.cgcc(F.col("s")).alias("c"), g4.hunter(F.col("s")).alias("h"), g4.motifs(F.col("s")).alias("m")).collect()
    assert row.c == 100 / 40 and row.h == (9 - 4) / 6
    assert (empty.c, empty.h, empty.m) == (0.0, 0.0, [])
    assert [(m.start, m.end, m.score) for m in quad.m] == [(0, 11, 8.0)]
    pair = spark.createDataFrame([("ACGT", "ACGA"), ("", ""), ("A", ""), ("AAAA", "A")], "a string, b string")
    assert [r[0] for r in pair.select(sq.edit_similarity(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, 0.0, 0.0]
    assert df.select(F.size(sq.kmers(F.col("s"), 4))).collect()[1][0] == 0


def test_scores_of_long_runs(spark):
    score = lambda n: 10 * n * (n + 1) * (n + 2) // 6
    df = spark.createDataFrame([("G" * 700 + "A" + "C" * 3,), ("C" * 40_000 + "T" + "G" * 9_000,)], "s string")
    rows = df.select(g4.cgcc(F.col("s")).alias("c"), g4.hunter(F.col("s")).alias("h")).collect()
    assert [r.c for r in rows] == [score(700) / score(3), score(9_000) / score(40_000)]
    assert [r.h for r in rows] == [(2800 - 9) / 704, (36_000 - 160_000) / 49_001]


def test_scores_round_their_binary_value(spark):
    df = spark.createDataFrame([(0.07125,)], "x double")
    assert [r[0] for r in df.select(g4.rounded(F.col("x"), 4)).union(df.select(g4.rounded(-F.col("x"), 4))).collect()] == [0.0712, -0.0712]
    assert [r[0] for r in df.select(g4.rounded(F.lit(0.125), 2)).union(df.select(g4.rounded(F.lit(-0.125), 2))).collect()] == [0.13, -0.13]


def test_folding():
    out = folding.fold("GGGGAAAACCCC", gquad=False)
    assert out["dot_bracket"] == "((((....))))" and out["mfe"] == -1.48  # three stacks of -2.36, a loop of 5.60
    assert folding.fold("A")["dot_bracket"] == "."
    assert folding.fold("GGGAGGGAGGGAGGG")["has_gquad"]
    assert folding.base_pairs(")(.)") == {1: 3, 3: 1}
    a, b = np.array(folding.profile("(((...)))....")), np.array(folding.profile("(((....)))...."))
    assert len(a) == 48 and a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.9
    assert [k for k, _ in folding.loops("((.(...)))")][2] == "bulge"


def test_kernels():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (12, 3)) for c in ((0, 0, 5), (5, 0, 0), (0, 5, 0))])
    truth = np.repeat([0, 1, 2], 12)
    same = lambda a: len({*zip(a.tolist(), truth.tolist(), strict=True)}) == 3 == len(set(a.tolist()))
    d = numerics.cosine_distances(x)
    assert same(numerics.kmeans(x, 3)) and same(numerics.agglomerate(d, 3)) and same(numerics.agglomerate(numerics.distances(x), 3, True))
    assert same(numerics.gaussian_mixture(x, 3)) and same(numerics.spectral(x, 3)) and same(numerics.fill_noise(d, numerics.hdbscan(d, 4)))
    assert same(numerics.auto_cluster(x, most=6, density=True)[0])
    assert numerics.silhouettes(d, truth).min() > 0.8
    assert all(p < 0.05 for *_, p in numerics.permutation_p(x, truth, 200))
    for y in (numerics.pca(x)[0], numerics.tsne(x, rounds=60), numerics.umap(x, rounds=20), numerics.mds(x), numerics.force_layout(36, [(0, 1)], 20)):
        assert y.shape == (36, 2) and np.isfinite(y).all()
    assert len(numerics.convex_hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]]))) == 4


def test_greedy_follows_rank_order(spark):
    rows = [("ACGTACGTAC", 9), ("ACGTACGTAA", 5), ("TTTTGGGGCC", 7), ("TTTTGGGGCA", 1), ("AC", 3)]
    out = clustering.greedy_clusters(spark.createDataFrame(rows, "sequence string, total_reads long").withColumn("s", F.col("sequence")), identity=0.8, k=3)
    assert {r.sequence: r.cluster_id for r in out.collect()} == {"ACGTACGTAC": 1, "ACGTACGTAA": 1, "TTTTGGGGCC": 2, "TTTTGGGGCA": 2, "AC": 4}


def test_registry_without_training_data_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "round_enrichment" in e.queries()
