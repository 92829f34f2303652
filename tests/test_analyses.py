"""Screening by a network, feature vectors, charts, whole analyses and the workbook, on small literals."""

from __future__ import annotations

import io
import pickle
import sys
import types
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from aptaforge.functions import g4, network
from aptaforge.operators import analyses, charts, features, rounds, screen
from aptaforge.sources import sinks


def pickled_network(monkeypatch, w: np.ndarray, bias: np.ndarray, kind: str = "SigmoidLayer") -> bytes:
    """A pickle of a network of 64 inputs and two outputs, made from classes that exist here only."""
    module = types.ModuleType("some_networks")
    monkeypatch.setitem(sys.modules, "some_networks", module)
    for name in ("Net", "LinearLayer", "BiasUnit", kind, "FullConnection"):
        setattr(module, name, type(name, (), {"__module__": "some_networks"}))

    def make(name, **state):
        out = getattr(module, name)()
        out.__dict__.update(state)
        return out

    layers = [make("BiasUnit", indim=0), make("LinearLayer", indim=64), make(kind, indim=2)]

    def link(a, b, n, weights):
        return make("FullConnection", inmod=a, outmod=b, inSliceFrom=0, inSliceTo=n, outSliceFrom=0, outSliceTo=2, _params=weights.ravel())

    net = make("Net", modulesSorted=layers, connections={1: [link(layers[1], layers[2], 64, w)], 0: [link(layers[0], layers[2], 1, bias)]})
    return pickle.dumps(net, protocol=0)


def test_network_is_read_without_running_the_pickle(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    w, bias = rng.normal(size=(2, 64)), rng.normal(size=(2, 1))
    data = pickled_network(monkeypatch, w, bias)
    monkeypatch.delitem(sys.modules, "some_networks")
    net = network.read_network(data)
    x = rng.random((5, 64))
    assert np.allclose(net.activate(x), 1 / (1 + np.exp(-(x @ w.T + bias.T))))
    (tmp_path / "net.pkl").write_bytes(data)
    feature = spark.createDataFrame([("GGAUUACC",)], "s string").select(g4.trimer_features(F.col("s"))).first()[0]
    assert np.allclose(feature, screen.trimer_shares("GGATTACC"))
    loaded = screen.load_network(spark, str(tmp_path / "net.pkl"))
    rows = screen.screen(spark.createDataFrame([("GGGAGGGAGGGAGGG",), ("ug",), (None,)], "sequence string"), network=loaded).collect()
    assert rows[0].num_g4_motifs >= 1 and 0 < rows[0].g4nn < 1
    assert [(r.cgcc, r.g4hunter, r.g4nn, r.num_g4_motifs) for r in rows[1:]] == [(0.0, 0.0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        network.read_network(pickled_network(monkeypatch, w, bias, "OtherLayer"))


def test_pickles_that_call_something_stay_inert():
    evil = b"cos\nsystem\n(S'exit 1'\ntR."
    with pytest.raises((ValueError, KeyError, AttributeError)):
        network.read_network(evil)


def test_features(spark):
    rows = [(1, "ACGUACGU", 1.0), (2, "TTTTTTTT", 2.0), (3, "", 3.0), (4, "acgtnnac", 4.0)]
    df = spark.createDataFrame(rows, "id long, sequence string, score double")
    raw = {r.id: r.v for r in features.prepare(df, standardise=False).collect()}
    assert {len(v) for v in raw.values()} == {16} and sum(raw[3]) == 0 and raw[2][15] == 1.0 and abs(sum(raw[1]) - 1) < 1e-12
    assert abs(raw[4][1] - 2 / 5) < 1e-12  # AC twice among the five 2-mers of ACGUAC
    x = np.array([r.v for r in features.prepare(df, mode="hybrid", scores=["score"]).collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)
    assert [r.v for r in features.prepare(df, mode="structural", scores=["score"], standardise=False).orderBy("id").collect()] == [[1.0], [2.0], [3.0], [4.0]]
    same = spark.createDataFrame([(1, "AAAA"), (2, "AAAA")], "id long, sequence string")
    assert all(not any(r.v) for r in features.prepare(same).collect())
    with pytest.raises(ValueError):
        features.prepare(df, mode="other")


def test_charts(spark):
    df = spark.createDataFrame([(1, 0.9), (2, None), (3, 2.0)], "cluster_id int, z double")
    assert {r.cluster_id: r.z_rank for r in charts.z_ranked(df).collect()} == {3: 1, 1: 2, 2: 3}
    assert charts.visible(charts.z_ranked(df), 0).count() == 3 and charts.visible(charts.z_ranked(df), 1).count() == 1
    label = lambda s, c: spark.range(1).select(charts.quality_label(F.lit(s), c)).first()[0]
    assert [label(0.5, "silhouette"), label(-1.0, "davies_bouldin"), label(11.0, "calinski_harabasz"), label(5.0, "calinski_harabasz")] == ["strong", "moderate", "strong", "weak"]
    row = spark.range(1).select(charts.edge_width(F.lit(0.85)), charts.edge_width(F.lit(0.6)), charts.bubble_label(F.lit(2), F.lit(5), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()
    assert abs(row[0] - 1.55) < 1e-9 and row[1] is None and row[2] == "Cluster 2 (5 members, Low G4)"
    thin = spark.range(1).select(charts.thinned(F.sequence(F.lit(0), F.lit(1000)), 200)).first()[0]
    assert thin == list(range(0, 1001, 5))


def test_whole_analyses(spark):
    left, right = "ACGTACGT", "TTGGCCAA"
    middle = {"AAAAACAAAA": 90, "AAAAACAAAT": 40, "CCGCCTCCGC": 70, "CCGCCTCCGA": 30, "CCGCCTCCTT": 5}
    entries = spark.createDataFrame([(left + m + right, n) for m, n in middle.items()], "sequence string, total_reads long")
    got = {r.sequence[8:18]: r.cluster_id for r in analyses.sequence_clusters(entries).collect()}
    assert got["AAAAACAAAA"] == got["AAAAACAAAT"] != got["CCGCCTCCGC"] == got["CCGCCTCCGA"]
    labels = analyses.optimal_clusters(entries, methods=("kmeans",), most=3)
    assert labels.count() == 5
    notes = analyses.annotate(labels).collect()
    assert sum(r["size"] for r in notes) == 5 and sum(r["reads"] for r in notes) == 235 and all(len(r["dot_bracket"]) == 26 for r in notes)
    rows = [(n, s.sequence, s.total_reads * n) for n in (1, 2) for s in entries.collect()]
    table = spark.createDataFrame(rows, "round_number int, sequence string, read_count long")
    folds = analyses.enrich_analyse(table, methods=("kmeans",), most=3)[1].collect()
    assert all(abs(r.mean_fold - 2) < 1e-9 and r.direction == "stable" for r in folds)
    with pytest.raises(ValueError):
        analyses.enrich_analyse(table.filter("round_number = 1"))


def test_figures_print_the_binary_value(spark):
    rows = [(-0.0378405, "-0.037840"), (1e15 + 0.3, f"{1e15 + 0.3:.6f}"), (-1e-9, "-0.000000"), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in rows], "x double")
    assert [r[0] for r in df.select(sinks.places(F.col("x"), 6)).collect()] == [w for _, w in rows]
    search = sinks.figure_tables(search=spark.createDataFrame([("error", 3, 49.24455)], "method string, k int, silhouette double"))["algorithm_selection"]
    assert search.first()["silhouette"] == "49.2445"


def test_workbook(spark):
    rows = [(1, "AC<GT", 10, 66.66666), (1, "GG", 5, 33.33333), (2, "AC<GT", 4, 100.0), (2, "T\x01T", 1, 0.5)]
    table = spark.createDataFrame(rows, "round_number int, sequence string, read_count long, percent_read double")
    scored = screen.screen(table.select("sequence").distinct())
    tables = sinks.sheets(table, rounds.enrichment(table), screened=scored) | {"a/b": table.filter("false")}
    file = io.BytesIO()
    sinks.workbook(tables, file)
    with zipfile.ZipFile(file) as z:
        space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", space)]
        assert names == ["Summary", "Round 1", "Round 2", "Enrichment", "G4 Screening", "a b"]
        cells = lambda i: [["".join(c.itertext()) for c in r] for r in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).findall(".//m:row", space)]
        assert cells(2) == [["rank", "sequence", "read_count", "percent"], ["1", "AC<GT", "10", "66.6667"], ["2", "GG", "5", "33.3333"]]
        assert cells(4)[0] == ["rank", "sequence", "R1 Count", "R1 %", "R2 Count", "R2 %", "fold", "max_percent_read", "present_in_rounds"]
        assert cells(4)[1][1:3] == ["TT", ""] and cells(4)[1][6] == "New" and len(cells(4)) == 4
        assert len(cells(6)) == 1


def test_a_table_goes_on_in_more_sheets(spark, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 4)
    file = io.BytesIO()
    sinks.workbook({"a" * 40: spark.range(7).orderBy("id"), "b": spark.range(3).orderBy("id"), "c": spark.range(0)}, file)
    with zipfile.ZipFile(file) as z:
        space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", space)]
        assert names == ["a" * 31, "a" * 27 + " (2)", "a" * 27 + " (3)", "b", "c"]
        cells = [["".join(r.itertext()) for r in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).findall(".//m:row", space)] for i in range(1, 6)]
    assert cells == [["id", "0", "1", "2"], ["id", "3", "4", "5"], ["id", "6"], ["id", "0", "1", "2"], ["id"]]
