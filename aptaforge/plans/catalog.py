"""Queries over the driver's tables, and SQL that gives the same rows.

Views: rounds are ship years of lineitem (part as sequence, quantity as reads); sequences are the
letters A, C, G, T of whole texts of documents; vectors are embeddings with their label as
cluster; clusters of reads are orders by priority and parts by brand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aptaforge.functions import g4
from aptaforge.functions import sequences as sq
from aptaforge.functions.network import Network
from aptaforge.operators import analyses as whole
from aptaforge.operators import charts, clustering, features, motifs, rounds, structure, vectors
from aptaforge.operators.ranges import materialize, positions, shared_path
from aptaforge.operators.screen import screen
from aptaforge.sources import reads, sinks
from aptaforge.sources.reads import percent_top
from aptaforge.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounds_view(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    out = li.groupBy(F.year("l_shipdate").alias("round_number"), F.col("l_partkey").cast("string").alias("sequence")).agg(F.sum(F.col("l_quantity").cast("long")).alias("read_count"))
    return rounds.with_percent(out)


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as sequences, with the number of parts as reads."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("sequence")).agg(F.count("*").alias("total_reads")).withColumn("s", F.col("sequence"))


ROUNDS = """rounds AS (SELECT *, read_count / sum(read_count) OVER (PARTITION BY round_number) * 100 AS percent_read FROM (
  SELECT CAST(year(l_shipdate) AS INT) AS round_number, CAST(l_partkey AS VARCHAR) AS sequence, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS read_count
  FROM lineitem GROUP BY ALL))"""
SEQ = "seq AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"
VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS cluster FROM embeddings)"
NAMES = "names AS (SELECT p_name AS s, count(*) AS total_reads FROM part GROUP BY 1)"
ENDS = "ends AS (SELECT min(round_number) AS a, max(round_number) AS b FROM rounds)"
PAIR = f"""per AS (SELECT sequence, max(percent_read) FILTER (round_number = a) AS pa, max(percent_read) FILTER (round_number = b) AS pb,
  max(read_count) FILTER (round_number = a) AS ra, max(read_count) FILTER (round_number = b) AS rb, max(percent_read) AS top,
  sum(read_count) AS total, count(*) AS present FROM rounds, ends GROUP BY 1), {{}}
"""


def _enriched(filter_: str) -> str:
    return f"""WITH {ROUNDS}, {ENDS}, {PAIR.format("x AS (SELECT 1)")}
SELECT sequence, round(CASE WHEN coalesce(pa, 0) > 0 THEN coalesce(pb, 0) / pa END, 6) AS fold, coalesce(pa, 0) = 0 AND coalesce(pb, 0) > 0 AS is_new,
  round(top, 6) AS max_percent_read, CAST(total AS BIGINT) AS total_reads, present AS present_in_rounds FROM per {filter_}"""


def _enrichment_columns(df: DataFrame) -> DataFrame:
    return df.select("sequence", F.round("fold", 6).alias("fold"), "is_new", F.round("max_percent_read", 6).alias("max_percent_read"), "total_reads", F.col("present_in_rounds").cast("long").alias("present_in_rounds"))


@query(_enriched(""))
def round_enrichment(spark, sf):
    return _enrichment_columns(rounds.enrichment(rounds_view(spark, sf), top=None))


@query(_enriched("WHERE pb IS NULL OR (rb >= 30 AND pb >= 0.05)"))
def round_enrichment_filtered(spark, sf):
    return _enrichment_columns(rounds.enrichment(rounds_view(spark, sf), min_reads=30, min_percent=0.05, top=None))


@query(_enriched("ORDER BY CASE WHEN coalesce(pa, 0) = 0 AND coalesce(pb, 0) > 0 THEN 1e15 ELSE coalesce(coalesce(pb, 0) / nullif(pa, 0), 0) END DESC, top DESC, sequence LIMIT 200"))
def round_enrichment_top(spark, sf):
    return _enrichment_columns(rounds.enrichment(rounds_view(spark, sf)))


@query(f"WITH {ROUNDS} SELECT sequence, CAST(sum(read_count) AS BIGINT) AS total_reads, round(max(percent_read), 6) AS max_percent_read, count(*) AS present_in_rounds FROM rounds GROUP BY 1 HAVING sum(read_count) >= 2")
def cross_round_totals(spark, sf):
    return rounds.cross_round_totals(rounds_view(spark, sf)).withColumn("max_percent_read", F.round("max_percent_read", 6))


@query(f"""WITH {ROUNDS}, n AS (SELECT DISTINCT round_number FROM rounds), s AS (SELECT DISTINCT sequence FROM rounds)
SELECT s.sequence, CAST(sum(coalesce(read_count, 0)) AS BIGINT) AS total_reads, string_agg(CAST(coalesce(read_count, 0) AS VARCHAR), ',' ORDER BY n.round_number) AS round_reads
FROM s CROSS JOIN n LEFT JOIN rounds r ON r.sequence = s.sequence AND r.round_number = n.round_number GROUP BY 1""")
def cross_round_merge(spark, sf):
    return rounds.merge_rounds(rounds_view(spark, sf)).withColumn("round_reads", F.array_join(F.col("round_reads").cast("array<string>"), ","))


@query(f"""WITH {ROUNDS}, {ENDS}, {PAIR.format("x AS (SELECT 1)")}
SELECT p_brand, round(avg(greatest(coalesce(rb, 0), 1) / greatest(coalesce(ra, 0), 1)), 6) AS mean_fold,
  CASE WHEN avg(greatest(coalesce(rb, 0), 1) / greatest(coalesce(ra, 0), 1)) > 2 THEN 'up' WHEN avg(greatest(coalesce(rb, 0), 1) / greatest(coalesce(ra, 0), 1)) < 0.5 THEN 'down' ELSE 'stable' END AS direction
FROM per JOIN part ON CAST(p_partkey AS VARCHAR) = sequence GROUP BY 1""")
def cluster_fold_direction(spark, sf):
    merged = rounds.merge_rounds(rounds_view(spark, sf)).join(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sequence"), "p_brand"), "sequence")
    return rounds.fold_direction(merged, "p_brand").withColumn("mean_fold", F.round("mean_fold", 6))


@query(f"WITH {ROUNDS} SELECT round_number, sequence, read_count, round(percent_read, 6) AS percent_read FROM (SELECT *, row_number() OVER (PARTITION BY round_number ORDER BY read_count DESC, sequence) AS k FROM rounds) WHERE k <= 100")
def percent_read_topn(spark, sf):
    r = rounds_view(spark, sf).select("round_number", "sequence", "read_count")
    return percent_top(r, 100, ["round_number"]).select("round_number", "sequence", "read_count", F.round("percent_read", 6).alias("percent_read"))


@query(f"WITH {ROUNDS} SELECT round_number, sequence, read_count, row_number() OVER (PARTITION BY round_number ORDER BY read_count DESC, sequence) AS rank FROM rounds")
def round_ranks(spark, sf):
    return rounds.ranked(rounds_view(spark, sf).select("round_number", "sequence", "read_count"))


@query(f"WITH {ROUNDS} SELECT round_number, sequence, read_count FROM rounds ORDER BY read_count DESC, sequence, round_number LIMIT 50 OFFSET 50")
def page_slice(spark, sf):
    r = rounds_view(spark, sf).select("round_number", "sequence", "read_count")
    return rounds.page(r, [F.col("read_count").desc(), F.col("sequence"), F.col("round_number")], 1)


@query("SELECT upper(w) AS sequence, sum(p_size) AS read_count FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size FROM part) WHERE regexp_matches(upper(w), '^[ACGTURYKMSWBDHVN]+$') GROUP BY 1 UNION ALL SELECT regexp_replace(upper(p_name), '[^ACGT]', '', 'g') || 'N', sum(p_size) FROM part GROUP BY 1")
def dedup_counts(spark, sf):
    """Words of part names (few are sequences), and the names' letters A, C, G, T with an N."""
    part = table(spark, sf, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("sequence"), F.col("p_size").alias("read_count"))
    letters = part.select(F.lower(F.concat(F.regexp_replace(F.upper("p_name"), "[^ACGT]", ""), F.lit("N"))).alias("sequence"), F.col("p_size").alias("read_count"))
    return reads.collapse(words.unionByName(letters))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(upper(w), '^[ACGTURYKMSWBDHVN]+$'))) AS BIGINT) AS n_valid FROM documents")
def iupac_filter(spark, sf):
    """Of all words of each whole text, how many are sequences."""
    words = F.filter(F.split("text", " "), lambda w: sq.is_iupac(w))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_valid"))


_HEADER = "CASE c_custkey % 7 WHEN 0 THEN 'seq-' || c_custkey WHEN 1 THEN 'id count=' || c_custkey WHEN 2 THEN 'id_x' || c_custkey WHEN 3 THEN 'id reads:' || c_custkey || ' z' WHEN 4 THEN 'a;size=' || c_custkey || ';' WHEN 5 THEN 'id ' || c_custkey ELSE 'id' END"


@query(rf"""SELECT c_custkey, header, CAST(coalesce(nullif(regexp_extract(header, '-(\d+)$', 1), ''), nullif(regexp_extract(header, '(?i)count[=:](\d+)', 1), ''), nullif(regexp_extract(header, '(?i)[x_](\d+)$', 1), ''),
  nullif(regexp_extract(header, '(?i)reads?[=:](\d+)', 1), ''), nullif(regexp_extract(header, '(?i)size[=:](\d+)', 1), ''), nullif(regexp_extract(header, '\s(\d+)$', 1), ''), '1') AS BIGINT) AS read_count FROM (SELECT c_custkey, {_HEADER} AS header FROM customer)""")
def header_read_count(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{_HEADER} AS header").withColumn("read_count", sq.header_count(F.col("header")))


_MEMBERS = f"""{ROUNDS}, {ENDS}, {PAIR.format("x AS (SELECT 1)")}, members AS (SELECT p_brand AS cluster_id, sequence, CASE WHEN coalesce(pa, 0) > 0 THEN coalesce(pb, 0) / pa END AS fold,
  coalesce(pa, 0) = 0 AND coalesce(pb, 0) > 0 AS is_new, top AS max_percent_read, total AS total_reads FROM per JOIN part ON CAST(p_partkey AS VARCHAR) = sequence)"""


def members(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sequence"), F.col("p_brand").alias("cluster_id"))
    return rounds.enrichment(rounds_view(spark, sf), top=None).join(part, "sequence")


@query(f"""WITH {_MEMBERS}, st AS (SELECT cluster_id, count(*) AS size, round(coalesce(avg(fold) FILTER (NOT is_new), 0), 2) AS avg_fold, round(coalesce(max(fold) FILTER (NOT is_new), 0), 2) AS max_fold, bool_or(is_new) AS hn, round(avg(max_percent_read), 4) AS avg_percent FROM members GROUP BY 1)
SELECT cluster_id, size, avg_fold, max_fold, avg_percent, row_number() OVER (ORDER BY size DESC, avg_fold DESC, cluster_id) AS cluster_rank, hn AND max_fold = 0 AS max_is_new FROM st""")
def cluster_stats(spark, sf):
    return rounds.cluster_stats(members(spark, sf))


@query(f"""WITH {_MEMBERS} SELECT cluster_id, sequence, round(z, 6) AS z_score, abs(z) >= 2 AS significant FROM (SELECT *, (total_reads - avg(total_reads) OVER w) / coalesce(nullif(stddev_pop(total_reads) OVER w, 0), 1) AS z FROM members WINDOW w AS (PARTITION BY cluster_id))""")
def member_zscore(spark, sf):
    return sinks.member_zscores(members(spark, sf)).select("cluster_id", "sequence", F.round("z_score", 6).alias("z_score"), "significant")


@query("""WITH p AS (SELECT p_partkey AS sequence, coalesce(nullif(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 5 END, 0), 1) AS label, p_size AS r FROM part),
s AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS cluster_id FROM p GROUP BY 1)
SELECT sequence, cluster_id, size, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY r DESC, sequence) = 1 THEN 1.0 ELSE 0.85 END::DOUBLE AS similarity FROM p JOIN s USING (label)""")
def label_regroup(spark, sf):
    """Labels by size, some 0 and some missing."""
    label = F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 5)
    return clustering.regroup(table(spark, sf, "part").select(F.col("p_partkey").alias("sequence"), label.alias("cluster_id"), F.col("p_size").alias("total_reads")))


_SCORED = f"""{_MEMBERS}, reps AS (SELECT cluster_id, arg_min(sequence, (-total_reads, sequence)) AS sequence, string_agg(sequence, ';' ORDER BY total_reads DESC, sequence) AS members,
  count(*) AS size, round(coalesce(avg(fold) FILTER (NOT is_new), 0), 2) AS avg_fold, round(coalesce(max(fold) FILTER (NOT is_new), 0), 2) AS max_fold, bool_or(is_new) AS hn,
  round(avg(max_percent_read), 4) AS avg_percent FROM members GROUP BY 1),
scored AS (SELECT *, hn AND max_fold = 0 AS max_is_new, row_number() OVER (ORDER BY size DESC, avg_fold DESC, cluster_id) AS cluster_rank, size / 7.0::DOUBLE AS cgcc,
  CASE WHEN size % 2 = 0 THEN size / -13.0::DOUBLE END AS g4hunter, CASE WHEN size % 3 = 0 THEN 'High, "sure"' ELSE 'Low' END AS risk, '(..).' AS dot_bracket FROM reps)"""


def scored_clusters(spark, sf):
    """Brands as clusters, with scores made of their sizes."""
    m = materialize(members(spark, sf), "brand-members")
    c = rounds.cluster_stats(m).withColumn("cgcc", F.col("size") / 7.0).withColumn("g4hunter", F.when(F.col("size") % 2 == 0, F.col("size") / -13.0))
    return m, c.withColumn("risk", F.when(F.col("size") % 3 == 0, 'High, "sure"').otherwise("Low")).withColumn("dot_bracket", F.lit("(..)."))


def lines_of(spark, df, name):
    """The lines of the CSV files of ``df`` as written, but for headers."""
    path = shared_path(spark, name)
    sinks.write_csv(df, path)
    return spark.read.text(path).filter(F.col("value") != ",".join(df.columns))  # the reader takes the mark off


@query(rf"""WITH {_SCORED} SELECT cluster_id || ',' || cluster_rank || ',' || sequence || ',' || size || ',' || printf('%.4f', avg_fold) || ',' || CASE WHEN max_is_new THEN 'Inf' ELSE printf('%.4f', max_fold) END || ',' ||
  printf('%.6f', avg_percent) || ',' || printf('%.4f', cgcc) || ',' || printf('%.4f', coalesce(g4hunter, 0)) || ',0.0000,' || CASE WHEN contains(risk, ',') THEN '"' || replace(risk, '"', '""') || '"' ELSE risk END ||
  ',0,,,' || dot_bracket || ',,' || members AS value FROM scored""")
def cluster_csv(spark, sf):
    m, c = scored_clusters(spark, sf)
    return lines_of(spark, sinks.cluster_csv(c, m), "cluster-csv")


@query(f"WITH {_SCORED} SELECT scored.cluster_id, size, cluster_rank, m.sequence, m.total_reads FROM scored JOIN members m USING (cluster_id)")
def cluster_json(spark, sf):
    """Cluster documents written as JSON lines and read again."""
    m, c = scored_clusters(spark, sf)
    path = shared_path(spark, "cluster-json")
    sinks.cluster_json(c, m).write.text(path)
    found = spark.read.schema("cluster_id string, size long, cluster_rank long, members array<struct<sequence string, total_reads long>>").json(path)
    return found.select("cluster_id", "size", "cluster_rank", F.explode("members").alias("m")).select("cluster_id", "size", "cluster_rank", "m.sequence", "m.total_reads")


_GRAMS = "SELECT unnest(list_transform(range(1, length(s) - {k} + 2), lambda i: substr(s, i, {k}))) AS kmer FROM seq"


@query(f"WITH {SEQ} SELECT kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM ({_GRAMS.format(k=6)}) GROUP BY 1")
def kmer_counts(spark, sf):
    return motifs.kmer_counts(seqs(spark, sf)).withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {SEQ} SELECT kmer, reverse(translate(kmer, 'ATCG', 'TAGC')) AS revcomp, count(*) AS n FROM ({_GRAMS.format(k=6)}) GROUP BY 1 ORDER BY n DESC, kmer LIMIT 20")
def kmer_top_revcomp(spark, sf):
    top = motifs.kmer_counts(seqs(spark, sf)).orderBy(F.col("n").desc(), "kmer").limit(20)
    return top.select("kmer", sq.reverse_complement(F.col("kmer")).alias("revcomp"), "n")


_LONG = "long AS (SELECT page_id AS doc_id, regexp_replace(upper(html), '[^ACGT]', '', 'g') AS s FROM pages)"


def long_seqs(spark, sf):
    """The letters A, C, G, T of whole pages: all have dozens of them."""
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.upper("html"), "[^ACGT]", "").alias("s"))


_PFM = f"{_LONG}, w AS (SELECT least(min(length(s)), 100) AS w, count(*) AS n FROM long), l AS (SELECT i AS pos, substr(s, i + 1, 1) AS base FROM long, w, unnest(range(0, w.w)) AS t(i)), pfm AS (SELECT CAST(pos AS INT) AS pos, base, count(*) AS n, count(*) / (SELECT n FROM w) AS frequency FROM l GROUP BY ALL)"


@query(f"WITH {_PFM} SELECT pos, base, n, round(frequency, 9) AS frequency FROM pfm")
def pfm_long(spark, sf):
    return motifs.position_frequencies(long_seqs(spark, sf)).withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {_PFM} SELECT pos, CASE WHEN max(frequency) > 0.5 THEN arg_max(base, (frequency, translate(base, 'ACGT', '4321'))) ELSE lower(arg_max(base, (frequency, translate(base, 'ACGT', '4321')))) END AS letter FROM pfm GROUP BY 1")
def consensus(spark, sf):
    return motifs.consensus(motifs.position_frequencies(long_seqs(spark, sf)))


_FREQ = "SELECT doc_id, kmer, count(*) / any_value(t) AS f FROM (SELECT doc_id, length(s) - {span} + 1 AS t, unnest(list_transform(range(1, length(s) - {span} + 2), lambda i: {gram})) AS kmer FROM seq WHERE length(s) >= {span}) GROUP BY 1, 2"
_F3, _G2 = _FREQ.format(span=3, gram="substr(s, i, 3)"), _FREQ.format(span=5, gram="substr(s, i, 1) || substr(s, i + 2, 1) || substr(s, i + 4, 1)")


@query(f"WITH {SEQ} SELECT doc_id, kmer, round(f, 9) AS frequency FROM ({_F3})")
def kmer_freq_long(spark, sf):
    return motifs.kmer_frequencies(seqs(spark, sf), "doc_id").withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {SEQ} SELECT doc_id, kmer, round(f, 9) AS frequency FROM ({_G2})")
def gapped_kmer_freq(spark, sf):
    return motifs.kmer_frequencies(seqs(spark, sf), "doc_id", gap=1).withColumn("frequency", F.round("frequency", 9))


@query(f"""WITH {SEQ}, f AS ({_F3}), n AS (SELECT count(*) AS n FROM seq), st AS (SELECT kmer, sum(f) / any_value(n) AS m, sum(f * f) / any_value(n) AS q FROM f, n GROUP BY 1)
SELECT doc_id, kmer, round((f - m) / sqrt(q - m * m), 5) + 0.0 AS z FROM f JOIN st USING (kmer) WHERE q - m * m > 1e-10""")
def feature_zscore(spark, sf):
    s = seqs(spark, sf)
    z = motifs.standardise(motifs.kmer_frequencies(s, "doc_id"), "doc_id", s.count())
    return z.select("doc_id", "kmer", (F.round("z", 5) + 0.0).alias("z"))  # no negative zeros


_RUNS = "list_transform(regexp_extract_all(s, '{}+'), lambda r: length(r))"
_CG = "list_sum(list_transform({}, lambda n: 10 * n * (n + 1) * (n + 2) // 6))"
_G, _C = (f"coalesce({_CG.format(_RUNS.format(b))}, 0)" for b in "GC")
_CGCC = f"({_G} / CASE WHEN {_C} = 0 THEN 1 ELSE {_C} END)"
_HUNT = f"(CASE WHEN length(s) = 0 THEN 0.0::DOUBLE ELSE (coalesce(list_sum(list_transform({_RUNS.format('G')}, lambda n: least(n, 4) * n)), 0) - coalesce(list_sum(list_transform({_RUNS.format('C')}, lambda n: least(n, 4) * n)), 0)) / length(s) END)"
_HITS = "(len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 2) = 'GG' AND regexp_matches(substr(s, i), '^G{2,}.{1,7}G{2,}.{1,7}G{2,}.{1,7}G{2,}'))))"


@query(f"WITH {SEQ} SELECT doc_id, round({_CGCC}, 4) AS cgcc FROM seq")
def g4_cgcc(spark, sf):
    return seqs(spark, sf).select("doc_id", F.round(g4.cgcc(F.col("s")), 4).alias("cgcc"))


@query(f"WITH {SEQ} SELECT doc_id, round({_HUNT}, 6) AS g4hunter FROM seq")
def g4_hunter(spark, sf):
    return seqs(spark, sf).select("doc_id", F.round(g4.hunter(F.col("s")), 6).alias("g4hunter"))


@query(f"WITH {SEQ} SELECT doc_id, len(regexp_extract_all(s, 'G{{2,}}')) AS n_regions FROM seq")
def g4_rich_regions(spark, sf):
    return seqs(spark, sf).select("doc_id", F.size(g4.rich_regions(F.col("s"))).cast("long").alias("n_regions"))


@query(f"WITH {SEQ} SELECT doc_id, CAST({_HITS} AS BIGINT) AS n_motifs FROM seq")
def g4_motif_count(spark, sf):
    return seqs(spark, sf).select("doc_id", F.size(g4.motifs(F.col("s"))).cast("long").alias("n_motifs"))


@query(f"""WITH {SEQ}, x AS (SELECT doc_id, {_CGCC} AS c, {_HUNT} AS h FROM seq) SELECT doc_id, risk, passes, CASE WHEN passes >= 2 THEN 'High' WHEN passes = 1 THEN 'Medium' ELSE 'Low' END AS risk_passes FROM (
SELECT doc_id, CASE WHEN c >= 1 THEN 'High' WHEN c >= 0.5 THEN 'Medium' ELSE 'Low' END AS risk, CAST(c > 4.5 AS INT) + CAST(h > 0.9 AS INT) AS passes FROM x)""")
def g4_risk(spark, sf):
    x = seqs(spark, sf).select("doc_id", g4.cgcc(F.col("s")).alias("c"), g4.hunter(F.col("s")).alias("h"))
    n = g4.passes(F.col("c"), F.col("h"), F.lit(0.0))
    return x.select("doc_id", g4.risk_by_score(F.col("c")).alias("risk"), n.alias("passes"), g4.risk_by_passes(n).alias("risk_passes"))


@query(f"WITH {SEQ} SELECT doc_id, round(least(2 * (0.2 * least(greatest({_CGCC} / 10, 0), 1) + 0.3 * least(abs({_HUNT}) / 2, 1)), 2), 3) AS g4_score FROM seq")
def g4_composite(spark, sf):
    return seqs(spark, sf).select("doc_id", g4.composite(g4.cgcc(F.col("s")), g4.hunter(F.col("s")), F.lit(0.0), F.lit(None).cast("double")).alias("g4_score"))


@query(f"""WITH {SEQ}, l AS (SELECT doc_id, i, CASE WHEN substr(s, i, 1) = 'G' THEN 1 WHEN substr(s, i, 1) = 'C' THEN -1 ELSE 0 END AS b FROM seq, unnest(range(1, length(s) + 1)) AS t(i)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS run FROM l), sc AS (SELECT doc_id, i, b * least(count(*) OVER (PARTITION BY doc_id, b, run), 4) AS x FROM r),
w AS (SELECT doc_id, i, avg(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS m, count(*) OVER (PARTITION BY doc_id) AS n FROM sc)
SELECT seq.doc_id, round(coalesce(max(abs(m)), 0), 6) AS window_score FROM seq LEFT JOIN w ON w.doc_id = seq.doc_id AND i <= greatest(n - 24, 1) GROUP BY 1""")
def g4_window(spark, sf):
    return g4.window_hunter(seqs(spark, sf), "doc_id", "s").withColumn("window_score", F.round("window_score", 6))


@query(f"WITH {SEQ} SELECT doc_id, round(CASE WHEN length(s) > 0 THEN (len(regexp_extract_all(s, 'G')) - len(regexp_extract_all(s, 'C'))) * (len(regexp_extract_all(s, 'G')) / length(s)) * (100 / length(s)) ELSE 0 END, 5) + 0.0 AS cgcc FROM seq")
def g4_simple_cgcc(spark, sf):
    return seqs(spark, sf).select("doc_id", (F.round(g4.simple_cgcc(F.col("s")), 5) + 0.0).alias("cgcc"))


_TRACTS = "(G{2,}).{1,7}(G{2,}).{1,7}(G{2,}).{1,7}(G{2,})"
_MOTIFS = f"""hits AS (SELECT doc_id, i - 1 AS first, regexp_extract(substr(s, i), '^{_TRACTS}', 0) AS motif FROM seq, unnest(range(1, length(s) + 1)) AS t(i) WHERE substr(s, i, 2) = 'GG'),
tracts AS (SELECT *, [length(regexp_extract(motif, '^{_TRACTS}$', 1)), length(regexp_extract(motif, '^{_TRACTS}$', 2)), length(regexp_extract(motif, '^{_TRACTS}$', 3)), length(regexp_extract(motif, '^{_TRACTS}$', 4))] AS t,
  list_transform(list_filter(regexp_split_to_array(motif, 'G+'), lambda x: x <> ''), lambda x: length(x)) AS loops FROM hits WHERE motif <> ''),
mots AS (SELECT doc_id, first, first + length(motif) AS last, motif, loops, round((2 * list_min(t) + list_sum(t)) / (1 + 0.5 * coalesce(list_avg(loops), 0)), 2) AS score FROM tracts)"""


@query(f"WITH {SEQ}, {_MOTIFS} SELECT doc_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last, motif, score FROM mots")
def g4_motif_records(spark, sf):
    m = seqs(spark, sf).select("doc_id", F.explode(g4.motifs(F.col("s"))).alias("m"))
    return m.select("doc_id", F.col("m.start").alias("first"), F.col("m.end").alias("last"), "m.motif", "m.score")


_SIMPLE = f"""{_MOTIFS}, best AS (SELECT doc_id, count(*) AS n, max(score) AS top, arg_max(loops, (score, -first)) AS loops FROM mots GROUP BY 1),
nn AS (SELECT seq.doc_id, s, coalesce(n, 0) AS n_motifs, top, CASE WHEN length(s) = 0 THEN 0 ELSE 1 / (1 + exp(-(-2.5 + 6.0 * (length(s) - length(replace(s, 'G', ''))) / length(s) + 3.0 * least(coalesce(n, 0) / 3, 1)
  + 2.5 * least(coalesce(list_max({_RUNS.format('G')}), 0) / 5, 1) + 2.0 * least(len(regexp_extract_all(s, 'GG+')) / 4, 1)
  + 1.5 * CASE WHEN len(coalesce(loops, [])) >= 3 THEN CASE WHEN list_avg(loops) <= 3 THEN 1.2 ELSE 1.0 END / (1 + list_var_pop(loops)) ELSE 0 END))) END AS nn FROM seq LEFT JOIN best USING (doc_id))"""


@query(f"WITH {SEQ}, {_SIMPLE} SELECT doc_id, CAST(n_motifs AS INT) AS n_motifs, round(nn, 3) AS g4nn FROM nn")
def g4_simple_nn(spark, sf):
    found = seqs(spark, sf).withColumn("m", g4.motifs(F.col("s")))
    return found.select("doc_id", F.size("m").alias("n_motifs"), g4.simple_nn(F.col("s"), F.col("m")).alias("g4nn"))


@query(f"""WITH {SEQ}, r AS (SELECT doc_id, translate(s, 'T', 'U') AS s FROM seq), f AS (SELECT doc_id, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram, length(s) - 2 AS n FROM r WHERE length(s) >= 3)
SELECT doc_id, gram, round(count(*) / any_value(n), 9) AS share FROM f GROUP BY 1, 2""")
def g4_trimers(spark, sf):
    letters = "AUCG"
    grams = F.array(*[F.lit(a + b + c) for a in letters for b in letters for c in letters])
    rows = seqs(spark, sf).select("doc_id", F.arrays_zip(grams.alias("g"), g4.trimer_features(F.translate("s", "T", "U")).alias("f")).alias("z"))
    return rows.select("doc_id", F.explode("z").alias("z")).select("doc_id", F.col("z.g").alias("gram"), F.round("z.f", 9).alias("share")).filter("share > 0")


_PRIMERS = f"""{_LONG}, h AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, s FROM long QUALIFY i <= 200), n AS (SELECT count(*) AS n FROM h), f AS (SELECT s FROM h WHERE i = 1),
p AS (SELECT k, count(*) FILTER (substr(h.s, k, 1) = substr(f.s, k, 1)) AS ok FROM h, f, unnest(range(1, length(f.s) + 1)) AS t(k) GROUP BY 1), q AS (SELECT k, count(*) FILTER (substr(reverse(h.s), k, 1) = substr(reverse(f.s), k, 1)) AS ok FROM h, f, unnest(range(1, length(f.s) + 1)) AS t(k) GROUP BY 1),
z AS (SELECT coalesce((SELECT min(k) - 1 FROM p, n WHERE ok < 0.9 * n), 0) AS a, coalesce((SELECT min(k) - 1 FROM q, n WHERE ok < 0.9 * n), 0) AS b)"""


@query(f"WITH {_PRIMERS} SELECT CAST(CASE WHEN a < 4 THEN 0 ELSE a END AS INT) AS prefix_len, CAST(CASE WHEN b < 4 THEN 0 ELSE b END AS INT) AS suffix_len FROM z")
def primer_detect(spark, sf):
    return motifs.primer_lengths(long_seqs(spark, sf), "doc_id")


@query(f"WITH {_LONG}, l AS (SELECT i AS pos, substr(s, i + 1, 1) AS base FROM long, unnest(range(0, length(s))) AS t(i)), c AS (SELECT pos, base, count(*) AS n FROM l GROUP BY ALL) SELECT CAST(pos AS INT) AS pos, round(max(n) / (SELECT count(*) FROM long), 9) AS top_share FROM c GROUP BY 1 HAVING max(n) / (SELECT count(*) FROM long) < 0.8")
def variable_positions(spark, sf):
    return motifs.variable_positions(long_seqs(spark, sf)).withColumn("top_share", F.round("top_share", 9))


_EDIT = "CASE WHEN abs(length({a}) - length({b})) / greatest(length({a}), length({b})) > 0.3 THEN 0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"
_SET = "list_distinct(list_transform(range(1, length({s}) - 1), lambda i: substr({s}, i, 3)))"


@query(f"SELECT p_partkey, round({_EDIT.format(a='p_name', b='p_type')}, 6) AS similarity FROM part")
def edit_pairs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(sq.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query(f"WITH {NAMES}, g AS (SELECT s, {_SET.format(s='s')} AS g FROM names) SELECT x.s AS a, y.s AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 6) AS jaccard FROM g x JOIN g y ON x.s < y.s WHERE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) >= 0.2")
def kmer_jaccard_pairs(spark, sf):
    n = positions(names(spark, sf), [], ["s"], "rank", "names")
    e = clustering.candidate_edges(n.select("rank", "s"), 3, 0.2)
    a, b = n.select(F.col("rank").alias("a"), F.col("s").alias("sa")), n.select(F.col("rank").alias("b"), F.col("s").alias("sb"))
    return e.join(a, "a").join(b, "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"), F.round("jaccard", 6).alias("jaccard"))


_GREEDY = """nb AS (SELECT r.k, coalesce(list(e.a ORDER BY e.a) FILTER (e.a IS NOT NULL), []) AS l FROM r LEFT JOIN e ON e.b = r.k GROUP BY 1),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS reps, NULL::BIGINT AS rep UNION ALL
  SELECT nb.k, CASE WHEN len(list_filter(nb.l, lambda x: list_contains(g.reps, x))) = 0 THEN list_append(g.reps, nb.k) ELSE g.reps END,
    coalesce(list_min(list_filter(nb.l, lambda x: list_contains(g.reps, x))), nb.k) FROM g JOIN nb ON nb.k = g.k + 1)"""


@query(f"""WITH RECURSIVE {NAMES}, r AS (SELECT s, row_number() OVER (ORDER BY total_reads DESC, s) AS k, {_SET.format(s="s")} AS g FROM names),
e AS (SELECT a.k AS a, b.k AS b, {_EDIT.format(a="a.s", b="b.s")} AS sim FROM r a JOIN r b ON a.k < b.k
  WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.2 AND {_EDIT.format(a="a.s", b="b.s")} >= 0.5), {_GREEDY}
SELECT r.s AS sequence, g.k AS rank, g.rep AS cluster_id, round(coalesce(e.sim, 1), 6) AS similarity FROM g JOIN r ON r.k = g.k LEFT JOIN e ON e.a = g.rep AND e.b = g.k""")
def greedy_clusters(spark, sf):
    return clustering.greedy_clusters(names(spark, sf), identity=0.5, k=3).withColumn("similarity", F.round("similarity", 6))


_BRACKETS = "r AS (SELECT item_id, translate(s, 'ACGT', '()..') AS s, row_number() OVER (ORDER BY length(s) DESC, item_id) AS k FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM benchmark))"


@query(f"""WITH RECURSIVE {_BRACKETS}, e AS (SELECT a.k AS a, b.k AS b FROM r a JOIN r b ON a.k < b.k WHERE CASE WHEN a.s = b.s THEN 1 WHEN least(length(a.s), length(b.s)) = 0 THEN 0 ELSE {_EDIT.format(a="a.s", b="b.s")} END >= 0.55), {_GREEDY}
SELECT r.item_id AS sequence, g.k AS rank, g.rep AS cluster_id FROM g JOIN r ON r.k = g.k""")
def bracket_clusters(spark, sf):
    """Letters of whole passages as brackets, + for T; the longest first."""
    s = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("sequence"), F.length(s).alias("total_reads"), F.translate(s, "ACGT", "().+").alias("bracket"))
    return clustering.structure_clusters(rows, 0.55)


_UNIT = f"{VEC}, u AS (SELECT id, cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec)"


@query(f"WITH {_UNIT}, e AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.id <> b.id), k AS (SELECT * FROM e WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) <= 8) SELECT least(i, j) AS source, greatest(i, j) AS target, round(max(s), 4) AS similarity FROM k GROUP BY 1, 2")
def cosine_edges_topk(spark, sf):
    return vectors.cosine_edges(vecs(spark, sf), 0.25).withColumn("similarity", F.round("similarity", 4))


@query(f"WITH {_UNIT}, e AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.id <> b.id), k AS (SELECT * FROM e WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) <= 8), d AS (SELECT DISTINCT least(i, j), greatest(i, j) FROM k) SELECT (SELECT count(*) FROM u) AS nodes, (SELECT count(*) FROM d) AS edges, round((SELECT count(*) FROM d) * 2 / ((SELECT count(*) FROM u) * ((SELECT count(*) FROM u) - 1)), 9) AS density")
def graph_density(spark, sf):
    n = vecs(spark, sf).count()
    e = vectors.cosine_edges(vecs(spark, sf), 0.25)
    return e.agg(F.lit(n).cast("long").alias("nodes"), F.count("*").alias("edges"), F.round(F.count("*") * 2 / F.lit(n * (n - 1)), 9).alias("density"))


@query(f"WITH {_UNIT} SELECT a.cluster AS a, b.cluster AS b, round(CASE WHEN a.cluster = b.cluster THEN coalesce(avg(1 - list_dot_product(a.u, b.u)) FILTER (a.id < b.id), 0) ELSE avg(1 - list_dot_product(a.u, b.u)) END, 6) AS distance FROM u a JOIN u b ON a.cluster <= b.cluster GROUP BY 1, 2, a.cluster = b.cluster")
def cluster_distance_matrix(spark, sf):
    return vectors.cluster_distances(vecs(spark, sf)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_UNIT}, p AS (SELECT a.id, a.cluster, b.cluster AS other, sum(1 - list_dot_product(a.u, b.u)) FILTER (a.id <> b.id) AS t, count(*) AS n FROM u a, u b GROUP BY 1, 2, 3),
ab AS (SELECT id, cluster, max(t / (n - 1)) FILTER (other = cluster) AS a, min(t / n) FILTER (other <> cluster) AS b FROM p GROUP BY 1, 2) SELECT id, cluster, round((b - a) / greatest(a, b), 6) AS silhouette FROM ab""")
def cosine_silhouette(spark, sf):
    return vectors.cosine_silhouette(vecs(spark, sf)).withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH {_UNIT} SELECT a.cluster AS cluster, round(avg(list_dot_product(a.u, b.u)), 9) AS observed FROM u a JOIN u b ON a.cluster = b.cluster GROUP BY 1")
def compactness_observed(spark, sf):
    return vectors.compactness(vecs(spark, sf)).withColumn("observed", F.round("observed", 9))


_LONGV = f"{VEC}, l AS (SELECT id, cluster, i, v[i] AS x FROM vec, unnest(range(1, 65)) AS t(i)), c AS (SELECT cluster, i, avg(x) AS m, count(*) AS n FROM l GROUP BY 1, 2)"


@query(f"""WITH {_LONGV}, d AS (SELECT id, l.cluster, sum((x - m) * (x - m)) AS d2 FROM l JOIN c USING (cluster, i) GROUP BY 1, 2), s AS (SELECT cluster, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM d GROUP BY 1),
g AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM c a JOIN c b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY 1, 2), r AS (SELECT a, max((x.s + y.s) / gap) AS r FROM g JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY 1),
o AS (SELECT i, avg(x) AS m FROM l GROUP BY 1), bt AS (SELECT sum(n * (c.m - o.m) * (c.m - o.m)) AS b FROM c JOIN o USING (i)), k AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS w FROM s)
SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round(b / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz FROM bt, k""")
def spread_scores(spark, sf):
    return vectors.spread_scores(vecs(spark, sf)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"""WITH {VEC}, l AS (SELECT cluster, i, sum(v[i]) AS x FROM vec, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2), c AS (SELECT cluster, list(x ORDER BY i) AS c FROM l GROUP BY 1), s AS (SELECT id, c.cluster, list_cosine_similarity(v, c) AS s FROM vec, c)
SELECT id, arg_max(cluster, s) AS nearest, round(max(s), 6) AS similarity FROM s GROUP BY 1""")
def nearest_centroid(spark, sf):
    v = vecs(spark, sf)
    return vectors.nearest_centroid(v, vectors.cluster_sums(v)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {NAMES}, t AS (SELECT quantile_cont(total_reads, 0.7) AS t FROM names) SELECT s AS sequence, total_reads, total_reads >= t AS is_high FROM names, t")
def two_stage_split(spark, sf):
    return rounds.abundance_split(names(spark, sf), 0.3, "total_reads").select("sequence", "total_reads", "is_high")


_ORD = "o AS (SELECT o_orderpriority AS cluster_id, CAST(o_totalprice AS BIGINT) AS read_count FROM orders)"


def order_reads(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("cluster_id"), F.floor(F.col("o_totalprice")).cast("long").alias("read_count"), "o_orderkey")


@query("WITH o AS (SELECT o_orderpriority AS cluster_id, CAST(floor(o_totalprice) AS BIGINT) AS read_count FROM orders), g AS (SELECT avg(read_count) AS mu, var_pop(read_count) AS v FROM o) SELECT cluster_id, count(*) AS size, CAST(sum(read_count) AS BIGINT) AS reads, round((sum(read_count) - count(*) * any_value(mu)) / sqrt(count(*) * any_value(v)), 3) AS z FROM o, g GROUP BY 1")
def nb_abundance_z(spark, sf):
    return rounds.abundance_z(order_reads(spark, sf)).drop("nb_r")


# two-sided normal tail by the series of the error function whose terms are all positive
_TAIL = "CASE WHEN abs(z) > 8 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - z * z / 2 - lgamma(n + 1.5)))) END"


@query(f"""WITH o AS (SELECT o_orderpriority AS cluster_id, CAST(floor(o_totalprice) AS BIGINT) AS read_count FROM orders), g AS (SELECT avg(read_count) AS mu, var_pop(read_count) AS v FROM o),
x AS (SELECT cluster_id, count(*) AS size, CAST(sum(read_count) AS BIGINT) AS reads, round((sum(read_count) - count(*) * any_value(mu)) / sqrt(count(*) * any_value(v)), 3) AS z FROM o, g GROUP BY 1), t AS (SELECT *, {_TAIL} AS p FROM x)
SELECT cluster_id, size, reads, z, round(p, 4) AS p, CASE WHEN round(p, 4) < 0.001 THEN '***' WHEN round(p, 4) < 0.01 THEN '**' WHEN round(p, 4) < 0.05 THEN '*' ELSE 'ns' END AS stars FROM t""")
def nb_abundance_p(spark, sf):
    z = rounds.abundance_z(order_reads(spark, sf)).drop("nb_r")
    return z.withColumn("p", F.round(clustering.normal_p_column(F.col("z")), 4)).withColumn("stars", sq.stars(F.col("p")))


@query("WITH o AS (SELECT o_orderkey, floor(o_totalprice) AS r FROM orders) SELECT o_orderkey, round(greatest(r, 1) / avg(greatest(r, 1)) OVER (), 6) AS linear, round(sqrt(greatest(r, 1)) / avg(sqrt(greatest(r, 1))) OVER (), 6) AS sqrt, round(ln(1 + greatest(r, 1)) / avg(ln(1 + greatest(r, 1))) OVER (), 6) AS log1p FROM o")
def abundance_weights(spark, sf):
    out = order_reads(spark, sf)
    for scheme in ("linear", "sqrt", "log1p"):
        out = rounds.weights(out, scheme=scheme).withColumn(scheme, F.round("weight", 6)).drop("weight")
    return out.select("o_orderkey", "linear", "sqrt", "log1p")


@query("WITH r AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part), b AS (SELECT p_brand, min(x) AS mn, max(x) FILTER (i = floor(n * 0.25)) AS q1, (max(x) FILTER (i = (n - 1) // 2) + max(x) FILTER (i = n // 2)) / 2 AS med, max(x) FILTER (i = floor(n * 0.75)) AS q3, max(x) AS mx FROM r GROUP BY 1) SELECT p_brand, mn AS min, q1, round(med, 6) AS median, q3, mx AS max, round(q3 - q1, 6) AS iqr FROM b")
def box_stats(spark, sf):
    return rounds.box_stats(table(spark, sf, "part"), "p_brand", "p_retailprice").withColumn("iqr", F.round("iqr", 6)).withColumn("median", F.round("median", 6))


@query("SELECT s_suppkey, round(log10(CASE WHEN s_acctbal / 1000 > 1e10 THEN 100 WHEN s_acctbal <= 0 THEN 0.1 ELSE s_acctbal / 1000 END + 1), 6) AS x, round(3 + 21 * sqrt((s_nationkey + 1) / 25), 6) AS radius, round(least(s_nationkey / 20, 1), 6) AS heat, round(least(abs(s_acctbal / 5000) / 2, 1), 6) AS heat_h, round(least(s_nationkey / 24, 1), 6) AS heat_n, round(least(s_suppkey / 25, 1), 6) AS heat_e FROM supplier")
def bubble_points(spark, sf):
    fold = F.col("s_acctbal") / 1000
    heats = rounds.heat(F.col("s_nationkey"), F.col("s_acctbal") / 5000, F.col("s_nationkey") / 24, -F.col("s_suppkey"))
    h, *rest = (F.round(x, 6) for x in heats)
    rest = [x.alias(n) for x, n in zip(rest, ("heat_h", "heat_n", "heat_e"), strict=True)]
    return table(spark, sf, "supplier").select("s_suppkey", F.round(rounds.bubble_x(fold, F.lit(False)), 6).alias("x"), F.round(rounds.node_radius(F.col("s_nationkey") + 1, F.lit(25)), 6).alias("radius"), h.alias("heat"), *rest)


@query("WITH p AS (SELECT round(l_discount, 6) AS x, round(l_tax, 6) AS y, l_returnflag AS cluster_id, CAST(l_partkey AS VARCHAR) AS sequence FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY x, y, cluster_id ORDER BY sequence) AS i FROM p) SELECT x, y, cluster_id, count(*) AS n, string_agg(sequence, ',' ORDER BY sequence) FILTER (i <= 5) AS sample FROM r GROUP BY 1, 2, 3")
def point_dedup(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_returnflag").alias("cluster_id"), F.col("l_partkey").cast("string").alias("sequence"))
    return rounds.dedup_points(p).withColumn("sample", F.array_join("sample", ","))


@query(f"WITH {ROUNDS}, t AS (SELECT sequence, row_number() OVER (ORDER BY sum(read_count) DESC, sequence) AS k FROM rounds GROUP BY 1 QUALIFY k <= 10) SELECT round_number, " + ", ".join(f"round(coalesce(max(percent_read) FILTER (k = {k}), 0), 6) AS top{k}" for k in range(1, 11)) + " FROM rounds JOIN t USING (sequence) GROUP BY 1")
def enrichment_trajectory(spark, sf):
    r = rounds_view(spark, sf)
    top = r.groupBy("sequence").agg(F.sum("read_count").alias("t")).orderBy(F.col("t").desc(), "sequence").limit(10)
    top = top.select("sequence", F.row_number().over(Window.orderBy(F.col("t").desc(), "sequence")).alias("k"))
    each = [F.round(F.coalesce(F.max(F.when(F.col("k") == k, F.col("percent_read"))), F.lit(0.0)), 6).alias(f"top{k}") for k in range(1, 11)]
    return r.join(top, "sequence").groupBy("round_number").agg(*each)


@query("""WITH x AS (SELECT event_type AS method, CAST(user_id % 9 AS INT) AS k, round(avg(value), 6) AS s FROM events GROUP BY 1, 2), m AS (SELECT method, count(*) AS points, arg_max(k, (s, -k)) AS best_k, max(s) AS best_score FROM x GROUP BY 1)
SELECT *, points >= 6 AS full_scan, method = (SELECT arg_max(method, (best_score, -best_k, method)) FROM m) AS is_best FROM m""")
def best_algorithm(spark, sf):
    """Event types as methods, users by nines as numbers of clusters, mean values as scores."""
    x = table(spark, sf, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 9).cast("int").alias("k")).agg(F.round(F.avg("value"), 6).alias("silhouette"))
    return charts.best_setting(x)


@query("SELECT day(ts) AS round_number, user_id || ':' || event_type AS sequence, count(*) AS read_count FROM events GROUP BY ALL")
def event_rounds(spark, sf):
    return table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("round_number"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("sequence")).agg(F.count("*").alias("read_count"))


@query(f"""WITH {_SCORED}, t AS (SELECT (SELECT count(DISTINCT round_number) FROM rounds) AS rounds, CAST((SELECT sum(read_count) FROM rounds) AS BIGINT) AS total_reads, (SELECT count(*) FROM rounds) AS unique_rows)
SELECT t.*, (SELECT count(*) FROM per WHERE pb / pa >= 2) AS enriched, (SELECT count(*) FROM per WHERE coalesce(pa, 0) = 0 AND coalesce(pb, 0) > 0) AS n_new, (SELECT count(*) FROM scored WHERE cgcc / 10 >= 1) AS high,
  (SELECT count(*) FROM scored WHERE cgcc / 10 >= 0.5 AND cgcc / 10 < 1) AS medium, (SELECT count(*) FROM scored WHERE cgcc / 10 < 0.5) AS low, (SELECT count(*) FROM scored WHERE size % 2 = 0) AS gquads,
  (SELECT count(*) FROM scored WHERE avg_fold > 1) AS significant FROM t""")
def global_counters(spark, sf):
    r, (_, c) = rounds_view(spark, sf), scored_clusters(spark, sf)
    c = c.withColumn("g4_score", F.col("cgcc") / 10).withColumn("has_gquad", F.col("size") % 2 == 0).withColumn("significant", F.col("avg_fold") > 1)
    return rounds.counters(r, rounds.enrichment(r, top=None), c, c, c)


@query("SELECT doc_id, b, length(b) - length(replace(b, '(', '')) AS n_open, length(b) - length(replace(b, ')', '')) AS n_close, length(b) - length(replace(b, '.', '')) AS n_dot, length(b) - length(replace(b, '+', '')) AS n_g4 FROM (SELECT doc_id, translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'ACGT', '().+') AS b FROM documents)")
def bracket_counts(spark, sf):
    return structure.pair_counts(seqs(spark, sf).select("doc_id", F.translate("s", "ACGT", "().+").alias("b")), "b")


def turns(spark, sf):
    """The letters A, C, G, U of whole turns of conversations, as sequences with the number of turns as reads."""
    s = sq.rna(F.translate(F.upper("text"), "T", "U"))
    return table(spark, sf, "conversations").groupBy(s.alias("sequence")).agg(F.count("*").alias("total_reads")).filter("sequence != ''")


@query()
def fold_mfe(spark, sf):
    return structure.predict(turns(spark, sf))


@query()
def fold_compat(spark, sf):
    """Energies as the reference model computes them."""
    return structure.predict(turns(spark, sf), cap=500, compat=True)


@query()
def structure_profile(spark, sf):
    folded = fold_mfe(spark, sf)
    return folded.select("sequence", structure.profile_udf()("dot_bracket").alias("profile"), structure.flagged_profile_udf()("dot_bracket", "sequence", "has_gquad").alias("flagged"))


@query("""WITH t AS (SELECT DISTINCT upper(role) || ':' || turn AS sequence, -(turn % 7)::DOUBLE AS a, -(turn % 5)::DOUBLE / 2 AS b FROM conversations)
SELECT sequence, round(a - b, 2) + 0.0 AS delta_mfe, CASE WHEN round(a - b, 2) < 0 THEN 'g4' ELSE 'stem' END AS better FROM t""")
def fold_gain(spark, sf):
    t = table(spark, sf, "conversations").select(F.concat(F.upper("role"), F.lit(":"), F.col("turn").cast("string")).alias("sequence"), "turn").distinct()
    gain = structure.mfe_gain(t.select("sequence", (-(F.col("turn") % 7)).cast("double").alias("mfe")), t.select("sequence", (-(F.col("turn") % 5) / 2).alias("mfe")))
    return gain.withColumn("delta_mfe", F.col("delta_mfe") + 0.0)


@query()
def auto_clusters(spark, sf):
    """All vectors, all methods and numbers of clusters, with density clusters."""
    return clustering.auto_clusters(vecs(spark, sf).select("id", "v"), density=True)


@query()
def auto_scores(spark, sf):
    return clustering.auto_scores(vecs(spark, sf).select("id", "v"), density=True)


@query()
def kmeans_auto(spark, sf):
    return clustering.auto_clusters(vecs(spark, sf).select("id", "v"), methods=("kmeans",))


@query()
def dbscan(spark, sf):
    return clustering.density_clusters(vecs(spark, sf).select("id", "v"), "dbscan")


@query()
def hdbscan(spark, sf):
    return clustering.density_clusters(vecs(spark, sf).select("id", "v"), "hdbscan")


@query()
def pca2d(spark, sf):
    return clustering.embed(vecs(spark, sf).select("id", "v"), "pca")


@query()
def explained_variance(spark, sf):
    return clustering.explained_variance(vecs(spark, sf).select("id", "v"))


@query()
def tsne2d(spark, sf):
    return clustering.embed(vecs(spark, sf).select("id", "v"), "tsne")


@query()
def umap2d(spark, sf):
    return clustering.embed(vecs(spark, sf).select("id", "v"), "umap")


@query()
def mds_layout(spark, sf):
    return clustering.embed(vecs(spark, sf).select("id", "v"), "mds")


@query(f"""WITH {_UNIT}, c AS (SELECT cluster, count(*) AS size FROM u GROUP BY 1), o AS (SELECT a.cluster AS cluster, avg(list_dot_product(a.u, b.u)) AS observed FROM u a JOIN u b ON a.cluster = b.cluster GROUP BY 1),
k AS (SELECT r, u, row_number() OVER (PARTITION BY r ORDER BY md5(id || ':' || r || ':42')) AS k FROM u, unnest(range(0, 1000)) AS t(r)), l AS (SELECT r, k, i, u[i] AS x FROM k, unnest(range(1, 65)) AS t(i) WHERE k <= (SELECT max(size) FROM c)),
n AS (SELECT r, size, sum(s * s) / (size * size) AS v FROM (SELECT r, size, i, sum(x) AS s FROM l JOIN (SELECT DISTINCT size FROM c) ON k <= size GROUP BY ALL) GROUP BY 1, 2),
p AS (SELECT cluster, c.size, observed, (count(*) FILTER (v >= observed) + 1) / 1001 AS p FROM c JOIN o USING (cluster) JOIN n ON n.size = c.size GROUP BY ALL)
SELECT cluster, CAST(size AS INT) AS size, round(observed, 9) AS observed, round(p, 9) AS p, p < 0.05 AS significant FROM p""")
def permutation_p(spark, sf):
    out = clustering.permutation_test(vecs(spark, sf))
    return out.select("cluster", "size", F.round("observed", 9).alias("observed"), F.round("p", 9).alias("p"), "significant")


@query()
def force_layout(spark, sf):
    sample = vectors.balanced_sample(vecs(spark, sf).withColumn("reads", F.col("id")))
    return clustering.force_layout(vectors.cosine_edges(sample.select("id", "v"), 0.25).select("source", "target"))


@query("""WITH p AS (SELECT vec_id AS id, label AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT a.cluster, a.x, a.y FROM p a JOIN p b ON a.cluster = b.cluster AND a.id <> b.id JOIN p c ON c.cluster = a.cluster AND c.id <> a.id AND c.id <> b.id
  GROUP BY a.cluster, a.id, b.id, a.x, a.y HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0))
SELECT DISTINCT cluster, round(x, 6) AS x, round(y, 6) AS y FROM e""")
def cluster_hulls(spark, sf):
    """Corners in two dimensions of the vectors; SQL finds them as starts of edges with all other points on their left."""
    xy = vecs(spark, sf).select("id", "cluster", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return clustering.hulls(xy).select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_NEAREST = "SELECT a.id, arg_min(b.cluster, (round(1 - list_dot_product(a.u, b.u), 12), b.id)) AS cluster FROM m a JOIN m b ON a.cluster < 0 AND b.cluster >= 0 GROUP BY 1"


@query(f"WITH {_UNIT}, m AS (SELECT id, u, CASE WHEN id % 7 = 0 THEN -1 ELSE cluster END AS cluster FROM u) {_NEAREST} UNION ALL SELECT id, cluster FROM m WHERE cluster >= 0")
def noise_fill(spark, sf):
    """Every seventh vector as noise."""
    return clustering.noise_filled(vecs(spark, sf).withColumn("cluster", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("cluster"))))


@query(f"""WITH {VEC}, d AS (SELECT a.id, a.cluster, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.id <> b.id), n AS (SELECT count(*) AS n FROM vec),
c AS (SELECT id, cluster, d AS core FROM d, n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = least(10, greatest(2, n // 10), n - 1)), s AS (SELECT cluster, avg(core) AS m, sum(core) AS t, count(*) AS k FROM c GROUP BY 1),
g AS (SELECT sum(t) AS t, sum(k) AS k FROM s) SELECT round(avg(1 / (m + 1e-10) - 1 / ((g.t - s.t) / (g.k - s.k) + 1e-10)), 6) AS validity FROM s, g WHERE s.k > 1""")
def density_validity(spark, sf):
    return clustering.density_validity(vecs(spark, sf)).withColumn("validity", F.round("validity", 6))


@query(f"WITH {VEC}, f AS (SELECT cluster, min(id * 7919 % 10007) AS first FROM vec GROUP BY 1) SELECT cluster, row_number() OVER (ORDER BY first, cluster) AS place FROM f")
def first_seen_clusters(spark, sf):
    return vectors.first_seen(vecs(spark, sf).withColumn("at", F.col("id") * 7919 % 10007), "at")


@query(f"""WITH {_UNIT}, p AS (SELECT a.id, a.cluster, b.cluster AS other, sum(1 - list_dot_product(a.u, b.u)) FILTER (a.id <> b.id) AS t, count(*) AS n FROM u a, u b GROUP BY 1, 2, 3),
ab AS (SELECT id, cluster, max(t / (n - 1)) FILTER (other = cluster) AS a, min(t / n) FILTER (other <> cluster) AS b FROM p GROUP BY 1, 2), s AS (SELECT id, cluster, round((b - a) / greatest(a, b), 6) AS silhouette FROM ab)
SELECT id, cluster, silhouette, row_number() OVER (PARTITION BY cluster ORDER BY silhouette DESC, id) AS bar, CASE WHEN silhouette >= 0.5 THEN 'strong' WHEN silhouette >= 0.25 THEN 'moderate' ELSE 'weak' END AS quality FROM s""")
def silhouette_bars(spark, sf):
    bars = charts.silhouette_bars(vectors.cosine_silhouette(vecs(spark, sf)).withColumn("silhouette", F.round("silhouette", 6)))
    return bars.withColumn("quality", charts.quality_label(F.col("silhouette")))


_BRANDS = "b AS (SELECT p_brand AS cluster_id, count(*) AS size, max(p_size) % 4 AS passes, -min(p_size) / 2.0::DOUBLE AS mfe, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE sum(p_size) END AS z FROM part GROUP BY 1)"


def brands(spark, sf):
    out = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count("*").alias("size"), (F.max("p_size") % 4).alias("passes"), (-F.min("p_size") / 2.0).alias("mfe"), F.sum("p_size").alias("_z"))
    return out.withColumn("z", F.when(F.col("size") % 3 != 0, F.col("_z"))).drop("_z")


@query(f"WITH {_BRANDS} SELECT cluster_id, row_number() OVER (ORDER BY z DESC NULLS LAST, cluster_id) AS z_rank, size > 1 AS multi, passes >= 2 AS g4pos FROM b WHERE mfe <= -5 OR passes >= 2 OR size > 1")
def cluster_ranks(spark, sf):
    b = charts.z_ranked(brands(spark, sf))
    kept = charts.cluster_filter(b, "multi").unionByName(charts.cluster_filter(b, "g4pos")).unionByName(charts.cluster_filter(b, "stable")).distinct()
    return kept.select("cluster_id", F.col("z_rank").cast("long").alias("z_rank"), (F.col("size") > 1).alias("multi"), (F.col("passes") >= 2).alias("g4pos"))


@query(f"WITH {_BRANDS} SELECT cluster_id, z_rank FROM (SELECT cluster_id, row_number() OVER (ORDER BY z DESC NULLS LAST, cluster_id) AS z_rank FROM b) WHERE z_rank <= 10")
def visible_clusters(spark, sf):
    return charts.visible(charts.z_ranked(brands(spark, sf)), 10).select("cluster_id", F.col("z_rank").cast("long").alias("z_rank"))


@query(f"WITH {_BRANDS} SELECT size, CASE WHEN passes >= 2 THEN 'High' WHEN passes = 1 THEN 'Medium' ELSE 'Low' END AS risk, count(*) AS n FROM b GROUP BY 1, 2")
def size_distribution(spark, sf):
    return charts.size_distribution(brands(spark, sf))


@query(f"WITH {_BRANDS} SELECT 'Cluster ' || cluster_id || ' (' || size || ' members, ' || CASE WHEN passes >= 2 THEN 'High' WHEN passes = 1 THEN 'Medium' ELSE 'Low' END || ' G4' || CASE WHEN passes > 0 THEN ', GG' || passes || ' motif' ELSE '' END || ')' AS label FROM b")
def bubble_labels(spark, sf):
    motif = F.when(F.col("passes") > 0, F.concat(F.lit("GG"), F.col("passes").cast("string")))
    return brands(spark, sf).select(charts.bubble_label(F.col("cluster_id"), F.col("size"), g4.risk_by_passes(F.col("passes")), motif).alias("label"))


@query("SELECT p_partkey, CAST(floor(p_partkey / 5) % 5 AS INT) AS shape, CAST(p_partkey % 12 AS INT) AS colour, round((p_partkey * 137.508::DOUBLE) % 360, 1) AS hue, CASE WHEN p_retailprice / 2000 >= 0.7 THEN round(0.8 + least((p_retailprice / 2000 - 0.7) / 0.3, 1) * 1.5, 6) END AS width FROM part")
def chart_scales(spark, sf):
    """Part keys count from 0, cluster ids from 1."""
    k = F.col("p_partkey") + 1
    width = charts.edge_width(F.col("p_retailprice") / 2000)
    return table(spark, sf, "part").select("p_partkey", charts.shape_index(k).alias("shape"), charts.palette_index(k, 12).alias("colour"), charts.cluster_hue(F.col("p_partkey"))["hue"].alias("hue"), F.round(width, 6).alias("width"))


@query("WITH a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT id, len(list_filter(range(1, len(v) + 1), lambda i: (i - 1) % greatest(1, len(v) // 20) = 0)) AS n, round(list_sum([v[i] for i in range(1, len(v) + 1) if (i - 1) % greatest(1, len(v) // 20) = 0]), 6) AS total FROM a")
def null_thinning(spark, sf):
    t = vecs(spark, sf).select("id", charts.thinned(F.col("v"), 20).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH {VEC}, r AS (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n FROM vec),
k AS (SELECT id, cluster FROM r WHERE i % CASE WHEN n > 20 THEN n // 20 ELSE 1 END = 0 AND i < 20 * CASE WHEN n > 20 THEN n // 20 ELSE 1 END),
p AS (SELECT *, row_number() OVER (ORDER BY cluster, id) - 1 AS j, greatest(1, count(*) OVER () // 150) AS s, count(*) OVER () AS c FROM k) SELECT id, cluster FROM p WHERE c <= 150 OR (j % s = 0 AND j < 150 * s)""")
def strided_sample(spark, sf):
    return charts.strided_sample(vecs(spark, sf).select("id", "cluster"), 20, 150)


@query(f"""WITH {VEC}, r AS (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY id DESC) AS k FROM vec) SELECT id, cluster FROM r WHERE k <= 20 ORDER BY id DESC LIMIT 150""")
def balanced_sample(spark, sf):
    return vectors.balanced_sample(vecs(spark, sf).withColumn("reads", F.col("id")), 20, 150).select("id", "cluster")


@query(f"""WITH {SEQ}, r AS (SELECT doc_id, translate(s, 'T', 'U') AS s FROM seq), dims AS (SELECT a || b AS kmer FROM unnest(['A', 'C', 'G', 'U']) AS x(a), unnest(['A', 'C', 'G', 'U']) AS y(b)),
g AS (SELECT doc_id, kmer, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS kmer FROM r WHERE length(s) >= 2) GROUP BY ALL),
f AS (SELECT r.doc_id, dims.kmer, CASE WHEN length(s) >= 2 THEN coalesce(n, 0) / (length(s) - 1) ELSE 0 END AS f FROM r CROSS JOIN dims LEFT JOIN g ON g.doc_id = r.doc_id AND g.kmer = dims.kmer),
st AS (SELECT kmer, avg(f) AS m, stddev_pop(f) AS sd FROM f GROUP BY 1) SELECT doc_id, kmer, round((f - m) / sd, 5) + 0.0 AS z FROM f JOIN st USING (kmer) WHERE sd * sd > 1e-10""")
def dense_features(spark, sf):
    """The standardised matrix of 2-mers, zeros included, in long form (all 16 occur in any such table)."""
    rows = features.scaled(features.dense(seqs(spark, sf), "doc_id", "s", 2), "doc_id")
    names = F.array(*[F.lit(a + b) for a in "ACGU" for b in "ACGU"])
    return rows.select("doc_id", F.explode(F.arrays_zip(names.alias("kmer"), F.col("v").alias("z"))).alias("c")).select("doc_id", "c.kmer", (F.round("c.z", 5) + 0.0).alias("z"))


@query(f"""WITH {SEQ}, {_SIMPLE}, x AS (SELECT *, CASE WHEN length(s) >= 3 THEN round({_CGCC}, 4) ELSE 0 END AS cgcc, CASE WHEN length(s) >= 3 THEN round({_HUNT}, 4) ELSE 0 END AS g4hunter,
  CASE WHEN length(s) >= 3 THEN round(nn, 3) ELSE 0 END AS g4nn FROM nn)
SELECT doc_id, cgcc, g4hunter, g4nn, n_motifs, len(regexp_extract_all(s, 'G{{2,}}')) AS n_regions,
  round(least(2 * (0.2 * least(greatest(cgcc / 10, 0), 1) + 0.3 * least(abs(g4hunter) / 2, 1) + 0.3 * g4nn + 0.2 * least(coalesce(top, 0) / 10, 1)), 2), 3) AS g4_score FROM x""")
def g4_screen(spark, sf):
    out = screen(seqs(spark, sf), "s")
    return out.select("doc_id", "cgcc", "g4hunter", "g4nn", F.col("num_g4_motifs").cast("long").alias("n_motifs"), F.size("g_rich_regions").cast("long").alias("n_regions"), "g4_score")


_WINDOW = """l AS (SELECT doc_id, i, CASE WHEN substr(s, i, 1) = 'G' THEN 1 WHEN substr(s, i, 1) = 'C' THEN -1 ELSE 0 END AS b FROM seq, unnest(range(1, length(s) + 1)) AS t(i)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS run FROM l), sc AS (SELECT doc_id, i, b * least(count(*) OVER (PARTITION BY doc_id, b, run), 4) AS x FROM r),
w AS (SELECT doc_id, i, avg(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS m, count(*) OVER (PARTITION BY doc_id) AS n FROM sc),
wide AS (SELECT seq.doc_id, coalesce(max(abs(m)), 0) AS h FROM seq LEFT JOIN w ON w.doc_id = seq.doc_id AND i <= greatest(n - 24, 1) GROUP BY 1)"""
_OLD_CGCC = "CASE WHEN length(s) > 0 THEN (len(regexp_extract_all(s, 'G')) - len(regexp_extract_all(s, 'C'))) * (len(regexp_extract_all(s, 'G')) / length(s)) * (100 / length(s)) ELSE 0 END"


@query(f"""WITH {SEQ}, {_SIMPLE}, {_WINDOW} SELECT doc_id, round({_OLD_CGCC}, 3) + 0.0 AS cgcc, round(h, 3) AS g4hunter, round(nn, 3) AS g4nn, CAST(n_motifs AS INT) AS num_g4_motifs,
  round(least(2 * (0.2 * least(greatest({_OLD_CGCC} / 10, 0), 1) + 0.3 * least(h / 2, 1) + 0.3 * round(nn, 3) + 0.2 * least(coalesce(top, 0) / 10, 1)), 2), 3) AS g4_score FROM nn JOIN wide USING (doc_id)""")
def g4_fallback(spark, sf):
    return g4.fallback(seqs(spark, sf), "doc_id", "s").withColumn("cgcc", F.col("cgcc") + 0.0)


def small_network() -> Network:
    """Sixty-four shares, three sigmoids with bias, one sigmoid: weights by rule."""
    hidden = np.array([[(7 * t + 3 * h) % 11 - 5 for t in range(64)] for h in range(3)], dtype=float)
    links = [(0, 2, slice(0, 64), slice(0, 3), hidden), (1, 2, slice(0, 1), slice(0, 3), np.array([[0.5], [-0.25], [0.0]])), (2, 3, slice(0, 3), slice(0, 1), np.array([[2.0, -1.5, 1.0]]))]
    return Network([("LinearLayer", 64), ("BiasUnit", 1), ("SigmoidLayer", 3), ("SigmoidLayer", 1)], links)


_GRAM = " + ".join(f"{16 // 4**j} * (instr('ATCG', substr(gram, {j + 1}, 1)) - 1)" for j in range(3))


@query(f"""WITH {SEQ}, grams AS (SELECT doc_id, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram, length(s) - 2 AS n FROM seq WHERE length(s) >= 3),
t AS (SELECT doc_id, {_GRAM} AS t, count(*) / any_value(n) AS share FROM grams GROUP BY 1, 2),
h AS (SELECT doc_id, {', '.join(f'1 / (1 + exp(-({b} + sum(share * ((7 * t + 3 * {k}) % 11 - 5))))) AS h{k}' for k, b in enumerate((0.5, -0.25, 0.0)))} FROM t GROUP BY 1)
SELECT doc_id, round(CASE WHEN h0 IS NULL THEN 0 ELSE 1 / (1 + exp(-(2 * h0 - 1.5 * h1 + h2))) END, 4) AS g4nn FROM seq LEFT JOIN h USING (doc_id)""")
def g4_network(spark, sf):
    """Screening by a network, here a small one of weights by rule; trained ones come from a file (operators.screen.load_network)."""
    return screen(seqs(spark, sf), "s", small_network()).select("doc_id", "g4nn")


@query("WITH p AS (SELECT p_partkey, ['', p_brand] AS v, p_name AS s FROM part) SELECT p_partkey, substr(s, 4, greatest(length(s) - 5, 0)) AS trimmed, CASE WHEN length(s) > 10 THEN substr(s, 1, 10) || '...' ELSE s END AS shown FROM p")
def trim_and_shorten(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sq.trim(F.col("p_name"), F.lit(3), F.lit(2)).alias("trimmed"), sq.shorten(F.col("p_name"), 10).alias("shown"))


def _prepared(seq: str, spans: str, extra: str) -> str:
    """Long form of feature vectors: shares of k-mers of all letters, which ``spans`` name, with their weights, then z-scores of each dimension."""
    return f"""{seq}, sh AS ({spans}), {extra}
st AS (SELECT dim, sum(x) / any_value(n) AS m, sum(x * x) / any_value(n) AS q FROM sh, (SELECT count(*) AS n FROM rna) GROUP BY 1)
SELECT doc_id, dim, round((x - m) / sqrt(q - m * m), 4) + 0.0 AS z FROM sh JOIN st USING (dim) WHERE q - m * m > 1e-10 AND abs(x) > 0"""


_SHARES = "SELECT doc_id, '{tag}' || {gram} AS dim, {w} * count(*) / any_value(n) AS x FROM (SELECT doc_id, unnest(range(1, length(s) - {span} + 2)) AS i, s, length(s) - {span} + 1 AS n FROM rna WHERE length(s) >= {span}) GROUP BY doc_id, 2"
_LETTERS = [a + b + c for a in "ACGU" for b in "ACGU" for c in "ACGU"]


@query(_prepared(
    f"WITH {_PRIMERS}, cut AS (SELECT doc_id, CASE WHEN a < 4 THEN 0 ELSE a END AS a, CASE WHEN b < 4 THEN 0 ELSE b END AS b, s, {_HUNT} AS score FROM long, z), rna AS (SELECT doc_id, substr(translate(s, 'T', 'U'), a + 1, greatest(length(s) - a - b, 0)) AS s FROM cut)",
    _SHARES.format(tag="k", gram="substr(s, i, 4)", span=4, w="1.0") + " UNION ALL " + _SHARES.format(tag="g", gram="substr(s, i, 1) || substr(s, i + 2, 1) || substr(s, i + 4, 1)", span=5, w="0.5")
    + " UNION ALL SELECT doc_id, 'score', 0.3 * (score - (SELECT avg(score) FROM cut)) / (SELECT stddev_pop(score) FROM cut) FROM cut",
    "",
))
def hybrid_features(spark, sf):
    """The standardised hybrid vectors of whole pages without what they all begin and end with, in long form, but for the k-mers that a page lacks."""
    s = long_seqs(spark, sf).withColumn("score", g4.hunter(F.col("s")))
    raw = features.prepare(s, "doc_id", "s", mode="hybrid", scores=["score"], standardise=False)
    rows = raw.join(features.scaled(raw, "doc_id").withColumnRenamed("v", "z"), "doc_id")
    kept = raw.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.stddev_pop("x").alias("sd")).filter(F.col("sd") * F.col("sd") > 1e-10)
    kept = positions(kept, [], ["pos"], "place", "kept-dimensions").select((F.col("place") - 1).cast("int").alias("place"), "pos")
    names = ["k" + g + x for g in _LETTERS for x in "ACGU"] + ["g" + g for g in _LETTERS] + ["score"]
    long = rows.select("doc_id", "v", F.posexplode("z").alias("place", "z")).join(F.broadcast(kept), "place")  # one row a dimension
    dim = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    return long.filter(F.element_at("v", F.col("pos") + 1) != 0).select("doc_id", dim.alias("dim"), (F.round("z", 4) + 0.0).alias("z"))


@query()
def structure_clusters(spark, sf):
    folded = structure.predict(turns(spark, sf)).join(turns(spark, sf), "sequence")
    return clustering.structure_clusters(folded.select("sequence", "total_reads", F.col("dot_bracket").alias("bracket")))


@query()
def sequence_clusters(spark, sf):
    return whole.sequence_clusters(turns(spark, sf))


@query()
def optimal_clusters(spark, sf):
    """The 500 most frequent turns; a fifth are clustered by all methods, the rest joins the nearest centroid."""
    return whole.optimal_clusters(turns(spark, sf), threshold=0.8)


@query()
def cluster_annotation(spark, sf):
    found = whole.annotate(optimal_clusters(spark, sf))
    return found.select("cluster_id", "size", "reads", "sequence", "g4_score", "risk", "passes", "dot_bracket", "mfe", "dot_plain", "mfe_plain", "delta_mfe", "better")


@query("""WITH b AS (SELECT p_brand AS sequence, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)
SELECT sequence, CASE WHEN n % 9 >= 6 THEN 'High' WHEN n % 9 >= 3 THEN 'Medium' ELSE 'Low' END AS risk, CAST(CAST(n % 9 > 4.5 AS INT) + CAST(n % 2 > 0.9 AS INT) + CAST(n % 3 / 3 > 0.5 AS INT) AS INT) AS passes,
  CASE WHEN n % 4 > 0 THEN '(' || lo || ')' END AS dot_bracket, CASE WHEN n % 4 > 0 THEN -lo / 2.0::DOUBLE END AS mfe, CASE WHEN n % 5 > 0 THEN '.' || hi END AS dot_plain, CASE WHEN n % 5 > 0 THEN -hi / 4.0::DOUBLE END AS mfe_plain,
  CASE WHEN n % 4 > 0 AND n % 5 > 0 THEN round(-lo / 2.0 + hi / 4.0, 2) + 0.0::DOUBLE END AS delta_mfe, CASE WHEN n % 4 > 0 AND n % 5 > 0 THEN CASE WHEN round(-lo / 2.0 + hi / 4.0, 2) < 0 THEN 'g4' ELSE 'stem' END END AS better FROM b""")
def annotation_join(spark, sf):
    """Brands as representatives, with scores and folds made of their numbers; some lack a fold."""
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("sequence")).agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    scored = b.select("sequence", (F.col("n") % 9).alias("cgcc"), (F.col("n") % 2).alias("g4hunter"), (F.col("n") % 3 / 3).alias("g4nn"), (F.col("n") % 9 / 6).alias("g4_score"))
    folds = b.filter("n % 4 > 0").select("sequence", F.concat(F.lit("("), F.col("lo").cast("string"), F.lit(")")).alias("dot_bracket"), (-F.col("lo") / 2).alias("mfe"), F.lit(0).alias("num_base_pairs"), F.lit(False).alias("has_gquad"))
    plain = b.filter("n % 5 > 0").select("sequence", F.concat(F.lit("."), F.col("hi").cast("string")).alias("dot_bracket"), (-F.col("hi") / 4).alias("mfe"))
    found = whole.joined(scored, folds, plain)
    return found.select("sequence", "risk", "passes", "dot_bracket", "mfe", "dot_plain", "mfe_plain", (F.col("delta_mfe") + 0.0).alias("delta_mfe"), "better")


@query()
def cross_round_analysis(spark, sf):
    """Letters of turns by role as rounds, all methods and numbers of clusters."""
    s = sq.rna(F.translate(F.upper("text"), "T", "U"))
    rows = table(spark, sf, "conversations").groupBy(F.when(F.col("role") == "user", 1).otherwise(2).alias("round_number"), s.alias("sequence")).agg(F.count("*").alias("read_count"))
    return whole.enrich_analyse(rows.filter("sequence != ''"))[1]


@query()
def profile_clusters(spark, sf):
    """Structures of all turns by their profiles: five methods, weights by reads, 1,000 permutations."""
    folded = structure.predict(turns(spark, sf)).join(turns(spark, sf), "sequence")
    folded = positions(folded, [], ["sequence"], "id", "profile-ids").withColumn("read_count", F.col("total_reads"))
    labels, tested, abundance = whole.profile_clusters(folded, scheme="sqrt")
    return labels.join(tested.select(F.col("cluster").alias("cluster_id"), "observed", "p"), "cluster_id").join(abundance.select("cluster_id", "z"), "cluster_id")


# --- sources and sinks: files written from the tables and read again ---

_LETTERS_OF = "translate(c_custkey || '', '0123456789', 'ACGTUNRYKM')"
_RAW = f"CASE WHEN c_custkey % 11 = 0 THEN 'XX' WHEN c_custkey % 13 = 0 THEN '' ELSE 'acg' || {_LETTERS_OF} END"


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{_HEADER} AS header", f"{_RAW} AS raw")


def write_lines(spark, df, name, **options):
    """The strings of a column as text files; the folder."""
    path = shared_path(spark, name)
    df.write.options(**options).text(path)
    return path


def fasta_file(spark, sf):
    entry = F.concat(F.lit(">"), "header", F.lit("\r\n"), F.substring("raw", 1, 4), F.lit("\n\n"), F.expr("substr(raw, 5)"), F.lit("  "))
    return write_lines(spark, _customers(spark, sf).select(entry), "reads-fasta")


_COUNT = r"""CAST(coalesce(nullif(regexp_extract(header, '-(\d+)$', 1), ''), nullif(regexp_extract(header, '(?i)count[=:](\d+)', 1), ''), nullif(regexp_extract(header, '(?i)[x_](\d+)$', 1), ''),
  nullif(regexp_extract(header, '(?i)reads?[=:](\d+)', 1), ''), nullif(regexp_extract(header, '(?i)size[=:](\d+)', 1), ''), nullif(regexp_extract(header, '\s(\d+)$', 1), ''), '1') AS BIGINT)"""


@query(rf"SELECT header, upper(raw) AS sequence, {_COUNT} AS read_count FROM (SELECT {_HEADER} AS header, {_RAW} AS raw FROM customer) WHERE raw <> ''")
def fasta_entries(spark, sf):
    return reads.read_fasta(spark, fasta_file(spark, sf))


@query(rf"SELECT upper(raw) AS sequence, CAST(sum({_COUNT}) AS BIGINT) AS read_count FROM (SELECT {_HEADER} AS header, {_RAW} AS raw FROM customer) WHERE regexp_matches(upper(raw), '^[ACGTURYKMSWBDHVN]+$') GROUP BY 1")
def fasta_reads(spark, sf):
    """By the format that is found; one sequence in eleven is not valid."""
    return reads.read_reads(spark, fasta_file(spark, sf))


_QUALITY = "CASE WHEN c_custkey % 3 = 0 THEN '@' ELSE '+' END"


def fastq_file(spark, sf):
    text = f"concat('@', header, '\n', raw, '\n+', if(c_custkey % 5 = 0, header, ''), '\n', repeat({_QUALITY}, length(raw)))"
    return write_lines(spark, _customers(spark, sf).selectExpr(text), "reads-fastq")


@query(f"SELECT header, upper(raw) AS sequence, CAST(1 AS BIGINT) AS read_count FROM (SELECT {_HEADER} AS header, {_RAW} AS raw FROM customer) WHERE raw <> ''")
def fastq_records(spark, sf):
    """Quality lines of @ alone, and records without letters, among others."""
    return reads.read_fastq(spark, fastq_file(spark, sf))


_FIELD = "CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'abc' WHEN 2 THEN c_custkey || 'x' WHEN 3 THEN ' ' || c_custkey ELSE '' END"


def tsv_file(spark, sf):
    lines = _customers(spark, sf).selectExpr(f"concat_ws('\t', raw, {_FIELD}) AS value").unionAll(_customers(spark, sf).selectExpr("'no tab in this line'"))
    return write_lines(spark, lines, "reads-tsv")


@query(rf"""SELECT upper(raw) AS sequence, CAST(sum(coalesce(nullif(TRY_CAST(nullif(regexp_extract(field, '^\s*([+-]?\d+)', 1), '') AS BIGINT), 0), 1)) AS BIGINT) AS read_count
FROM (SELECT {_RAW} AS raw, {_FIELD} AS field FROM customer) WHERE regexp_matches(upper(raw), '^[ACGTURYKMSWBDHVN]+$') GROUP BY 1""")
def tsv_reads(spark, sf):
    return reads.read_reads(spark, tsv_file(spark, sf))


def line_file(spark, sf, name="reads-lines", **options):
    return write_lines(spark, _customers(spark, sf).selectExpr("concat(' ', raw, ' ') AS value").unionAll(_customers(spark, sf).selectExpr("upper(raw)")), name, **options)


_LINES = f"SELECT upper(raw) AS sequence, 2 * count(*) AS read_count FROM (SELECT {_RAW} AS raw FROM customer) WHERE regexp_matches(upper(raw), '^[ACGTURYKMSWBDHVN]+$') GROUP BY 1"


@query(_LINES)
def line_reads(spark, sf):
    return reads.read_reads(spark, line_file(spark, sf))


@query(f"WITH x AS ({_LINES}) SELECT 'suffix' AS told_by, * FROM x UNION ALL SELECT 'first bytes', * FROM x")
def gzip_reads(spark, sf):
    """Compressed files with their suffix, and the same files without it, beside a plain one."""
    path, bare = line_file(spark, sf, compression="gzip"), shared_path(spark, "reads-bare")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    fs.mkdirs(hadoop.Path(bare))
    for k, f in enumerate(fs.globStatus(hadoop.Path(f"{path}/*.gz"))):
        hadoop.FileUtil.copy(fs, f.getPath(), fs, hadoop.Path(f"{bare}/reads{k}"), False, conf)
    inflated = reads.inflate(spark, bare, shared_path(spark, "reads-inflated"))
    by = [reads.read_reads(spark, p, "lines").select(F.lit(how).alias("told_by"), "sequence", "read_count") for how, p in (("suffix", path), ("first bytes", inflated))]
    return by[0].unionAll(by[1])


@query("SELECT * FROM (VALUES ('fasta', 'fasta'), ('fastq', 'fastq'), ('tsv', 'tsv'), ('lines', 'lines')) AS t(file, found)")
def formats_found(spark, sf):
    files = {"fasta": fasta_file, "fastq": fastq_file, "tsv": tsv_file, "lines": line_file}
    return spark.createDataFrame([(name, reads.detect_format(spark.read.text(make(spark, sf)))) for name, make in files.items()], "file string, found string")


_KEPT = f"""{ROUNDS}, new AS (SELECT round_number, sequence, CASE WHEN round_number % 2 = 0 THEN 3 ELSE 1 END * read_count AS read_count FROM rounds WHERE round_number % 2 = 1 OR read_count % 2 = 0),
top AS (SELECT *, read_count / sum(read_count) OVER (PARTITION BY round_number) * 100 AS percent, CAST(sum(read_count) OVER (PARTITION BY round_number) AS BIGINT) AS total_reads,
  row_number() OVER (PARTITION BY round_number ORDER BY read_count DESC, sequence) AS rank FROM new)"""


def stored(spark, sf):
    """A store of two analyses: all rounds, of which the even ones are replaced; and one that is deleted."""
    store, r = Store(spark, shared_path(spark, "store"), 500), rounds_view(spark, sf).select("round_number", "sequence", "read_count")
    kept, gone = store.create("kept"), store.create("gone")
    store.put_rounds(kept, r, "all.tsv")
    store.put_round(gone, 1, r.filter("round_number = 1996").select("sequence", "read_count"))
    even = r.filter("round_number % 2 = 0 AND read_count % 2 = 0").withColumn("read_count", 3 * F.col("read_count"))
    store.put_rounds(kept, even, "even.tsv")
    store.delete(gone)
    return store, kept, gone


@query(f"WITH {_KEPT} SELECT CAST(round_number AS INT) AS round_number, CASE WHEN round_number % 2 = 0 THEN 'even.tsv' ELSE 'all.tsv' END AS file_name, total_reads, rank, sequence, CAST(read_count AS BIGINT) AS read_count, round(percent, 6) AS percent_read FROM top WHERE rank <= 200")
def stored_rounds(spark, sf):
    store, kept, _ = stored(spark, sf)
    out = store.detail(kept, 200)
    return out.select("round_number", "file_name", "total_reads", "rank", "sequence", "read_count", F.round("percent_read", 6).alias("percent_read"))


@query(f"WITH {_KEPT} SELECT 'kept' AS name, 'pending' AS status, CAST(count(DISTINCT round_number) AS INT) AS n_rounds, CAST(sum(total_reads) FILTER (rank = 1) AS BIGINT) AS total_reads, 0::BIGINT AS left_over FROM top")
def stored_list(spark, sf):
    store, _, gone = stored(spark, sf)
    left = store.sequences().filter(F.col("analysis_id") == gone).unionByName(store.rounds().filter(F.col("analysis_id") == gone), allowMissingColumns=True).count()
    total = F.aggregate("rounds", F.lit(0).cast("long"), lambda s, r: s + r["total_reads"])
    return store.list().select("name", "status", F.size("rounds").alias("n_rounds"), total.alias("total_reads"), F.lit(left).cast("long").alias("left_over"))


@query(r"""SELECT CASE WHEN n_nationkey % 3 = 0 THEN '"' || n_name || ', of ' || repeat('"', 2) || r_name || repeat('"', 3) ELSE n_name END || ',' || n_nationkey || ',' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE r_name END AS value FROM nation JOIN region ON r_regionkey = n_regionkey""")
def plain_csv(spark, sf):
    """Cells with commas and quotes, and empty ones."""
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    odd = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(', of "'), "r_name", F.lit('"'))).otherwise(F.col("n_name"))
    return lines_of(spark, both.select(odd.alias("name"), "n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("r_name")).alias("region")), "plain-csv")


_SIL = f"""{_UNIT}, pr AS (SELECT a.id, a.cluster, b.cluster AS other, sum(1 - list_dot_product(a.u, b.u)) FILTER (a.id <> b.id) AS t, count(*) AS n FROM u a, u b GROUP BY 1, 2, 3),
ab AS (SELECT id, cluster, max(t / (n - 1)) FILTER (other = cluster) AS a, min(t / n) FILTER (other <> cluster) AS b FROM pr GROUP BY 1, 2), sil AS (SELECT id, cluster, round((b - a) / greatest(a, b), 9) AS silhouette FROM ab),
dist AS (SELECT a.cluster AS a, b.cluster AS b, CASE WHEN a.cluster = b.cluster THEN coalesce(avg(1 - list_dot_product(a.u, b.u)) FILTER (a.id < b.id), 0) ELSE avg(1 - list_dot_product(a.u, b.u)) END AS d FROM u a JOIN u b ON true GROUP BY 1, 2, a.cluster = b.cluster)"""


@query(f"""WITH {_SIL}, sc AS (SELECT event_type AS method, CAST(user_id % 9 AS INT) AS k, round(avg(value), 6) AS s FROM events GROUP BY 1, 2), ov AS (SELECT p_brand AS c, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT 'distance_matrix' AS figure, a || ',' || (SELECT count(*) FROM vec WHERE cluster = a) || ',' || string_agg(printf('%.6f', d), ',' ORDER BY b) AS value FROM dist GROUP BY a
UNION ALL SELECT 'silhouette_scores', cluster || ',' || row_number() OVER (PARTITION BY cluster ORDER BY silhouette DESC, id) || ',' || printf('%.6f', silhouette) || ',' || count(*) OVER w || ',' || printf('%.6f', avg(silhouette) OVER w) FROM sil WINDOW w AS (PARTITION BY cluster)
UNION ALL SELECT 'pca_coordinates', printf('%.6f', CAST(embedding[1] AS DOUBLE)) || ',' || printf('%.6f', CAST(embedding[2] AS DOUBLE)) || ',' || label || ',s' || vec_id || ',' || CASE WHEN vec_id % 4 = 0 THEN 1 ELSE vec_id % 4 END FROM embeddings
UNION ALL SELECT 'algorithm_selection', method || ',' || k || ',' || printf('%.4f', s) FROM sc
UNION ALL SELECT 'permutation_test', n || ',' || CASE WHEN n % 2 = 0 THEN '1.250e-3' ELSE '1.000e+0' END || ',' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',' || printf('%.6f', n / 7.0::DOUBLE) || ',0.5;' || printf('%.1f', CAST(n AS DOUBLE)) FROM ov
UNION ALL SELECT 'cluster_overview', c || ',' || n || ',-,' || printf('%.2f', n / 7.0::DOUBLE) || ',' || printf('%.3f', n / -13.0::DOUBLE) || ',-,' || k FROM ov""")
def figure_csv(spark, sf):
    """The tables behind the figures, written as files and read again as lines."""
    v = vecs(spark, sf)
    sizes = v.groupBy(F.col("cluster").alias("a")).agg(F.count("*").alias("size"))
    distances = vectors.cluster_distances(v).join(sizes, "a")
    silhouettes = vectors.cosine_silhouette(v).withColumn("silhouette", F.round("silhouette", 9))
    points = v.select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("cluster").alias("cluster_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sequence"), (F.col("id") % 4).alias("n"))
    search = table(spark, sf, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 9).cast("int").alias("k")).agg(F.round(F.avg("value"), 6).alias("silhouette"))
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count("*").alias("size"), F.min("p_partkey").cast("string").alias("sequence"))
    even = F.col("size") % 2 == 0
    tested = b.select(F.col("size").alias("cluster"), F.when(even, 0.00125).otherwise(1.0).alias("p"), even.alias("significant"), (F.col("size") / 7.0).alias("observed"), F.array(F.lit(0.5), F.col("size").cast("double")).alias("null"))
    overview = b.withColumns({"avg_fold": F.lit(0.0), "cgcc": F.col("size") / 7.0, "g4hunter": F.col("size") / -13.0, "g4nn": F.lit(None).cast("double")})
    out = None
    for name, df in sinks.figure_tables(distances, silhouettes, {"pca": points}, search, tested, overview).items():
        lines = lines_of(spark, df, f"figure-{name}").select(F.lit(name).alias("figure"), "value")
        out = lines if out is None else out.unionAll(lines)
    return out


def sum_of_column(sheet, column: int) -> tuple[int, int]:
    """Rows of a sheet's XML after the first, and the sum of a column of whole numbers."""
    import re

    left, seen, total = b"", -1, 0
    while chunk := sheet.read(1 << 20):
        *whole, left = (left + chunk).split(b"</row>")
        for row in whole:
            seen += 1
            if seen:
                cell = re.findall(b"<c/>|<c.*?</c>", row, re.S)[column]
                total += int(re.sub(b"<[^>]*>", b"", cell) or 0)
    return seen, total


@query(f"""WITH {_SCORED}, f AS (SELECT * FROM per ORDER BY CASE WHEN coalesce(pa, 0) = 0 AND coalesce(pb, 0) > 0 THEN 1e15 ELSE coalesce(coalesce(pb, 0) / nullif(pa, 0), 0) END DESC, top DESC, sequence LIMIT 200)
SELECT 'Summary' AS sheet, count(*) + 1 AS n, CAST(sum(reads) AS BIGINT) AS reads FROM (SELECT round_number, sum(read_count) AS reads FROM rounds GROUP BY 1)
UNION ALL SELECT 'Round ' || round_number, count(*) + 1, CAST(sum(read_count) AS BIGINT) FROM rounds GROUP BY round_number
UNION ALL SELECT 'Enrichment', count(*) + 1, CAST(sum(coalesce(ra, 0)) AS BIGINT) FROM f
UNION ALL SELECT 'Clusters', count(*) + 1, CAST(sum(size) AS BIGINT) FROM scored""")
def workbook_sheets(spark, sf):
    """A workbook of the rounds, their enrichment and the clusters, read again row by row: rows of each table with its header, and the sum of one column."""
    import re
    import tempfile
    import zipfile

    r, (m, c) = rounds_view(spark, sf), scored_clusters(spark, sf)
    tables = sinks.sheets(r, rounds.enrichment(r), clusters=sinks.cluster_csv(c, m))
    numbers, rows = rounds.round_numbers(r), {}
    wanted = {"Summary": "reads", "Enrichment": f"R{numbers[0]} Count", "Clusters": "Cluster_Size"}
    with tempfile.TemporaryFile() as file:
        sinks.workbook(tables, file)
        with zipfile.ZipFile(file) as z:
            names = re.findall('<sheet name="([^"]+)"', z.read("xl/workbook.xml").decode())
            for k, sheet in enumerate(names, 1):
                name = re.sub(r" \(\d+\)$", "", sheet)  # sheets that go on with a table
                column = list(tables[name].columns).index(wanted.get(name, "read_count"))
                with z.open(f"xl/worksheets/sheet{k}.xml") as part:
                    n, total = sum_of_column(part, column)
                before = rows.get(name, (1, 0))
                rows[name] = before[0] + n, before[1] + total
    rows = [(name, *both) for name, both in rows.items()]
    return spark.createDataFrame(rows, "sheet string, n long, reads long")


@query(f"""WITH {ROUNDS}, {ENDS}, {PAIR.format("x AS (SELECT 1)")}, e AS (SELECT sequence, CASE WHEN coalesce(pa, 0) > 0 THEN coalesce(pb, 0) / pa END AS fold, coalesce(pa, 0) = 0 AND coalesce(pb, 0) > 0 AS is_new FROM per)
SELECT 'falling' AS how, sequence FROM (SELECT sequence FROM e ORDER BY CASE WHEN is_new THEN 1e15 ELSE coalesce(fold, '-Infinity'::DOUBLE) END DESC, sequence LIMIT 50)
UNION ALL SELECT 'rising', sequence FROM (SELECT sequence FROM e ORDER BY CASE WHEN is_new THEN 1e15 ELSE coalesce(fold, '-Infinity'::DOUBLE) END, sequence LIMIT 50)""")
def table_sort(spark, sf):
    """The first page of the table by fold, both ways."""
    e = rounds.enrichment(rounds_view(spark, sf), top=None)
    by = [rounds.sort_table(e, "fold", falling, "is_new").limit(50).select(F.lit(how).alias("how"), "sequence") for how, falling in (("falling", True), ("rising", False))]
    return by[0].unionAll(by[1])


@query(f"WITH {_BRANDS} SELECT cluster_id AS old_id, row_number() OVER (ORDER BY z DESC NULLS LAST, cluster_id) AS cluster_id, CASE WHEN size % 2 = 0 THEN mfe END AS p, z FROM b")
def zrank_remap(spark, sf):
    """Statistics of half the clusters follow them to their new ids."""
    b = brands(spark, sf)
    return charts.remapped(b.select("cluster_id", "z"), b.filter("size % 2 = 0").select("cluster_id", F.col("mfe").alias("p"))).select("old_id", "cluster_id", "p", "z")


@query(f"""SELECT p_partkey, round(CASE WHEN length(p_name) = length(p_type) THEN (CAST(substr(p_name, 1, 1) = substr(p_type, 1, 1) AS INT) + CAST(substr(p_name, 3, 1) = substr(p_type, 3, 1) AS INT) + CAST(substr(p_name, 6, 1) = substr(p_type, 6, 1) AS INT)) / 3
  ELSE {_EDIT.format(a='p_name', b='p_type')} END, 6) AS similarity FROM (SELECT p_partkey, lower(p_type) || CASE WHEN p_size % 2 = 0 THEN ' rinG' ELSE '' END AS p_type, p_name FROM part)""")
def position_pairs(spark, sf):
    """Names and types at places 0, 2 and 5 where their lengths agree."""
    kind = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, " rinG").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", F.round(sq.position_similarity(F.col("p_name"), kind, [0, 2, 5]), 6).alias("similarity"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'New' WHEN p_size % 7 = 0 THEN 'N/A' ELSE printf('%.2f', p_size / 8.0) || 'x' END AS fold, CASE WHEN p_size / 16000.0 < 0.001 THEN '< 0.001' ELSE printf('%.3f', p_size / 16000.0) END AS p,
  CASE WHEN p_size / 500.0 < 0.001 THEN '***' WHEN p_size / 500.0 < 0.01 THEN '**' WHEN p_size / 500.0 < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT p_partkey, CAST(p_size * 4 AS DOUBLE) AS p_size4, p_size FROM part)""")
def number_labels(spark, sf):
    n = F.col("p_size")
    fold = F.when(n % 7 != 0, n / 8.0)
    return table(spark, sf, "part").select("p_partkey", sq.fold_label(fold, n % 5 == 0).alias("fold"), sq.p_label(n / 16000.0).alias("p"), sq.stars(n / 500.0).alias("stars"))
