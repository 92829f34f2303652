"""G-quadruplex screening: scores of each sequence, by column expressions and a trained network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aptaforge.functions import g4
from aptaforge.functions.network import Network, read_network

#: Places of the letters A, T, C, G by their codes.
LETTER = np.zeros(256, dtype=np.int64)
LETTER[[ord(c) for c in "ATCG"]] = range(4)


def load_network(spark: SparkSession, path: str) -> Network:
    """The network in the file at ``path`` (any file system of Spark)."""
    return read_network(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def trimer_shares(seq: str) -> np.ndarray:
    """Shares of the 64 trimers of A, U (or T), C, G, in that order, of a sequence of these letters."""
    code = LETTER[np.frombuffer(seq.encode("ascii"), dtype=np.uint8)]
    if len(code) < 3:
        return np.zeros(64)
    return np.bincount(16 * code[:-2] + 4 * code[1:-1] + code[2:], minlength=64) / (len(code) - 2)


def network_udf(network: Network):
    """Probability of a quadruplex of sequences of A, C, G, T: the second output if there are two."""

    @F.pandas_udf("double")
    def run(seqs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in seqs:
            y = network.activate(np.stack([trimer_shares(s) for s in batch])) if len(batch) else np.zeros((0, 1))
            yield pd.Series(y[:, 1] if y.shape[1] > 1 else y[:, 0])

    return run


def screen(df: DataFrame, seq: str = "sequence", network: Network | None = None) -> DataFrame:
    """``df`` plus cgcc, g4hunter, g4nn, g4_motifs, num_g4_motifs, g_rich_regions and g4_score.

    Letters but A, C, G, T and U go; what is left with under three has scores of 0. g4nn comes from ``network``,
    or from the logistic score where none is given.
    """
    dna = F.regexp_replace(F.translate(F.upper(F.coalesce(F.col(seq), F.lit(""))), "U", "T"), "[^ACGT]", "")
    out = df.withColumn("_s", dna).withColumn("g4_motifs", g4.motifs(F.col("_s")))
    enough = F.length("_s") >= 3
    zero = lambda c: F.when(enough, c).otherwise(F.lit(0.0))
    nn: Column = g4.simple_nn(F.col("_s"), F.col("g4_motifs"))
    if network is not None:
        nn = network_udf(network)("_s")
    out = out.withColumns({
        "cgcc": g4.rounded(zero(g4.cgcc(F.col("_s"))), 4), "g4hunter": g4.rounded(zero(g4.hunter(F.col("_s"))), 4), "g4nn": nn,
        "num_g4_motifs": F.size("g4_motifs"), "g_rich_regions": g4.rich_regions(F.col("_s")),
    })
    out = out.withColumn("g4nn", g4.rounded(zero(F.col("g4nn")), 4))
    top = F.get("g4_motifs", F.lit(0))["score"]
    return out.withColumn("g4_score", g4.composite(F.col("cgcc"), F.col("g4hunter"), F.col("g4nn"), top)).drop("_s")
