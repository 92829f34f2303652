"""Exports: cluster tables, members with z-scores, report sheets, plain CSV and JSON."""

from __future__ import annotations

import math
import re
import zipfile
from typing import BinaryIO
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aptaforge.functions.sequences import reverse_complement
from aptaforge.operators.ranges import join_on, positions


def member_zscores(members: DataFrame, cluster: str = "cluster_id", reads: str = "total_reads") -> DataFrame:
    """``members`` plus z_score of reads within the cluster (population deviation; 1 where it is 0) and significant (|z| >= 2)."""
    stats = members.groupBy(cluster).agg(F.avg(reads).alias("_mean"), F.stddev_pop(reads).alias("_sd"))
    z = (F.col(reads) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1)
    return join_on(members, stats, [cluster]).withColumn("z_score", z).withColumn("significant", F.abs("z_score") >= 2).drop("_mean", "_sd")


# Columns of the cluster table, and what each holds here.
CLUSTER_COLUMNS = {
    "Cluster_ID": "cluster_id", "Rank": "rank", "Representative_Sequence": "sequence", "Cluster_Size": "size", "Avg_Enrichment_Fold": "avg_fold",
    "Max_Enrichment_Fold": "max_fold", "Avg_Max_Percent_Read": "avg_percent", "cGcC_Score": "cgcc", "G4Hunter_Score": "g4hunter", "G4NN_Score": "g4nn", "G4_Risk": "risk",
    "Num_G4_Motifs": "num_g4_motifs", "MFE_With_G4": "mfe", "MFE_Without_G4": "mfe_plain", "DotBracket_With_G4": "dot_bracket", "DotBracket_Without_G4": "dot_plain",
    "Member_Sequences": "members",
}
PLACES = {"avg_fold": 4, "max_fold": 4, "avg_percent": 6, "cgcc": 4, "g4hunter": 4, "g4nn": 4}


def cluster_csv(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """The cluster table as text, one row per cluster by rank (cluster_rank, else cluster_id), its members joined by semicolons, most read first.

    Columns that ``clusters`` lacks are empty (scores of quadruplexes are 0). A flag max_is_new writes the largest fold as Inf, avg_is_new the mean.
    """
    m = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("total_reads")).alias("r"), "sequence"))).alias("m"))
    if "sequence" in clusters.columns:
        first = F.col("sequence")
    else:
        first = F.get("m.sequence", F.lit(0))
    both = join_on(clusters, m, ["cluster_id"], "left").withColumn("members", F.concat_ws(";", F.col("m.sequence"))).withColumn("sequence", first)
    if "cluster_rank" in clusters.columns:
        both = both.withColumn("rank", F.col("cluster_rank"))
    else:
        both = positions(both, [], ["cluster_id"], "rank", "cluster-csv")

    def cell(name: str) -> Column:
        zero = name in ("g4hunter", "g4nn", "num_g4_motifs")
        if name not in both.columns:
            return F.lit(f"{0:.{PLACES[name]}f}" if name in PLACES else "0") if zero else F.lit("")
        c = F.coalesce(F.col(name), F.lit(0)) if zero else F.col(name)
        text = F.format_string(f"%.{PLACES[name]}f", c.cast("double")) if name in PLACES else c.cast("string")
        text = F.when(c.isNull(), "").otherwise(text)
        flag = {"max_fold": "max_is_new", "avg_fold": "avg_is_new"}.get(name)
        return F.when(F.coalesce(F.col(flag), F.lit(False)), "Inf").otherwise(text) if flag in both.columns else text

    return both.select(*[cell(c).alias(title) for title, c in CLUSTER_COLUMNS.items()])


def figure_tables(
    distances: DataFrame | None = None, silhouettes: DataFrame | None = None, points: dict[str, DataFrame] | None = None, search: DataFrame | None = None,
    tested: DataFrame | None = None, overview: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables behind the figures, as text, by file name.

    ``distances``: a, b, distance, size (of a); one column a cluster, so the cluster ids reach the driver. ``silhouettes``: id, cluster, silhouette. ``points``, by
    name: x, y, cluster_id, sequence, n. ``search``: method, k, silhouette. ``tested``: cluster, p, significant, observed, null (array). ``overview``: cluster_id, size,
    avg_fold, cgcc, g4hunter, g4nn, sequence.
    """
    text = lambda c: F.col(c).cast("string")
    fixed = lambda c, k: places(F.col(c).cast("double"), k)
    out = {}
    if distances is not None:
        ids = [r[0] for r in distances.select("a").distinct().orderBy("a").collect()]
        both = distances.select("a", "b", "distance").unionByName(distances.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
        cells = [F.max(F.when(F.col("b") == i, F.col("distance"))).alias(f"Cluster_{i}") for i in ids]
        sizes = distances.groupBy("a").agg(F.max("size").alias("Cluster_Size"))
        wide = join_on(both.groupBy("a").agg(*cells), sizes, ["a"])
        out["distance_matrix"] = wide.select(text("a").alias("Cluster_ID"), text("Cluster_Size").alias("Cluster_Size"), *[fixed(f"Cluster_{i}", 6).alias(f"Cluster_{i}") for i in ids])
    if silhouettes is not None:
        stats = silhouettes.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("silhouette").alias("mean"))
        bars = positions(silhouettes, ["cluster"], ["-silhouette", "id"], "bar", "figure-bars", stats)
        out["silhouette_scores"] = bars.select(
            text("cluster").alias("Cluster_ID"), text("bar").alias("Sequence_Index"), fixed("silhouette", 6).alias("Silhouette_Score"), text("size").alias("Cluster_Size"), fixed("mean", 6).alias("Cluster_Avg_Score")
        )
    for name, p in (points or {}).items():
        count = F.coalesce(F.nullif(F.col("n"), F.lit(0)), F.lit(1)).cast("string")
        out[f"{name}_coordinates"] = p.select(fixed("x", 6).alias("x"), fixed("y", 6).alias("y"), text("cluster_id").alias("cluster_id"), "sequence", count.alias("read_count"))
    if search is not None:
        out["algorithm_selection"] = search.select("method", text("k").alias("K"), fixed("silhouette", 4).alias("silhouette"))
    if tested is not None:
        out["permutation_test"] = tested.select(
            text("cluster").alias("cluster"), exponential(F.coalesce("p", F.lit(0.0))).alias("p_value"), F.coalesce("significant", F.lit(False)).cast("string").alias("significant"),
            places(F.coalesce("observed", F.lit(0.0)), 6).alias("observed_compactness"), F.array_join(F.col("null").cast("array<string>"), ";").alias("null_values"),
        )
    if overview is not None:
        dash = lambda c, k: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, fixed(c, k)).otherwise("-")
        out["cluster_overview"] = overview.select(
            text("cluster_id").alias("cluster"), text("size").alias("members"), dash("avg_fold", 2).alias("enrichment_score"), dash("cgcc", 2).alias("cGcC"), dash("g4hunter", 3).alias("G4Hunter"),
            dash("g4nn", 4).alias("G4NN"), F.col("sequence").alias("representative"),
        )
    return out


def places(x: Column, k: int) -> Column:
    """``k`` decimals of the exact binary value, as C and JavaScript print it (Java prints that of the shortest decimal); null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([f"{v:.{k}f}" for v in x.tolist()], dtype=object)

    return F.when(x.isNotNull(), run(x))


def exponential(x: Column) -> Column:
    """Three decimals and an exponent without padding: 1.230e-5."""
    return F.regexp_replace(F.format_string("%.3e", x), r"e([+-])0*(\d)", r"e$1$2")


def cluster_json(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """One JSON document per cluster with its members nested."""
    nested = members.groupBy("cluster_id").agg(F.collect_list(F.struct(*[c for c in members.columns if c != "cluster_id"])).alias("members"))
    joined = clusters.join(nested, "cluster_id", "left")
    return joined.select(F.to_json(F.struct(*joined.columns)).alias("value"))


def sheets(
    rounds: DataFrame, enrichment: DataFrame, screened: DataFrame | None = None, folded: DataFrame | None = None, kmers: DataFrame | None = None, clusters: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Report sheets: a summary, each round ranked, enrichment with a column pair for each round, and, where given,
    quadruplex scores, structures, k-mers and clusters (as ``cluster_csv`` writes them).

    ``rounds``: round_number, sequence, read_count, percent_read. One sheet per round, so the round numbers reach the driver.
    """
    numbers = [r[0] for r in rounds.select("round_number").distinct().orderBy("round_number").collect()]
    out = {"Summary": rounds.groupBy("round_number").agg(F.sum("read_count").alias("reads"), F.count("*").alias("sequences")).orderBy("round_number")}
    ranked = positions(rounds, ["round_number"], ["-read_count", "sequence"], "rank", "sheet-rounds")
    for n in numbers:
        out[f"Round {n}"] = ranked.filter(F.col("round_number") == n).select("rank", "sequence", "read_count", F.round("percent_read", 4).alias("percent")).orderBy("rank")
    wide = rounds.groupBy("sequence").agg(*[
        c for n in numbers for c in (
            F.sum(F.when(F.col("round_number") == n, F.col("read_count"))).alias(f"R{n} Count"),
            F.round(F.max(F.when(F.col("round_number") == n, F.col("percent_read"))), 4).alias(f"R{n} %"),
        )
    ])
    fold = F.when(F.col("is_new"), "New").when(F.col("fold").isNull(), "N/A").otherwise(F.col("fold").cast("string"))
    keyed = enrichment.withColumn("_key", F.when(F.col("is_new"), 1e15).otherwise(F.coalesce("fold", F.lit(0.0))))
    placed = positions(keyed, [], ["-_key", "-max_percent_read", "sequence"], "rank", "sheet-enrichment")
    chosen = placed.select("rank", "sequence", fold.alias("fold"), F.round("max_percent_read", 4).alias("max_percent_read"), "present_in_rounds")
    columns = [F.col(f"`R{n} {c}`") for n in numbers for c in ("Count", "%")]
    out["Enrichment"] = chosen.join(wide, "sequence", "left").select("rank", "sequence", *columns, "fold", "max_percent_read", "present_in_rounds").orderBy("rank")
    if screened is not None:
        top = F.coalesce(F.get("g4_motifs", F.lit(0))["motif"], F.lit("None"))
        out["G4 Screening"] = screened.select("sequence", "g4_score", "cgcc", "num_g4_motifs", top.alias("top_motif"))
    if folded is not None:
        out["RNA Structure"] = folded.select("sequence", "dot_bracket", "mfe", "num_base_pairs")
    if kmers is not None:
        out["Motifs"] = kmers.select("kmer", F.col("n").alias("count"), F.round("frequency", 5).alias("frequency"), reverse_complement(F.col("kmer")).alias("reverse_complement"))
    if clusters is not None:
        out["Clusters"] = clusters
    return out


#: Rows that a sheet of a workbook can hold.
SHEET_ROWS = 1_048_576


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        return f"<c><v>{value}</v></c>"
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(tables: dict[str, DataFrame], file: BinaryIO) -> None:
    """One workbook with a sheet for each table, its column names in the first row; a table of more rows than a sheet can hold goes on in
    sheets "name (2)", "name (3)" and so on. Rows pass through the driver one partition at a time."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names: list[str] = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for name, df in tables.items():
            rows, k = df.toLocalIterator(), 0
            row = next(rows, None)
            while row is not None or not k:
                k += 1
                more = f" ({k})" if k > 1 else ""
                names.append(re.sub(r"[\[\]:*?/\\\\]", " ", name)[: 31 - len(more)] + more)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                    sheet.write(f"<row>{''.join(map(_cell, df.columns))}</row>".encode())
                    for _ in range(SHEET_ROWS - 1):
                        if row is None:
                            break
                        sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                        row = next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
        numbered = list(enumerate(names, 1))
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in numbered)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in numbered)
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered)
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """A folder of CSV files with a header: cells with commas, quotes or line breaks are quoted, quotes doubled; files begin with a byte order mark."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}")
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")
