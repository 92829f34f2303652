"""Operator 1: mixing sources to target weights (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import SPACE, WORD, join_on, let, materialize, positions, prefix_sums, spread

#: Source tables up to this many rows are broadcast; above, they are joined through salted slots.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def keys(seed: str) -> dict[str, Column]:
    """What orders the rows of a source: a hash-random key by doc_id, then doc_id, size and checksum."""
    return {
        "key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))),
        "doc_id": F.col("doc_id"), "size": word_count(), "crc": F.crc32(F.coalesce(F.col("text"), F.lit(""))),
    }


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """One row per source: source_size, weight, target. Sources by code point, null last, take ``weights`` in turn.

    ``share`` times all sizes is dealt out by weight; a target stops at ``cap`` times its
    source's size. With sources in order of cap/weight, those that stop form a prefix, and
    the first that does not gives the level that all later ones share. Both orders are ranges of
    sources, so their number is not bounded by a task; three totals reach the driver.
    """
    src = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    src = positions(src, [], ["source"], "_rank", "mix-ranked", written=True)
    w = F.array(*[F.lit(x) for x in weights])
    src = src.withColumn("weight", F.element_at(w, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    src = prefix_sums(src, [], ["_ratio", "_rank"], {"_full": F.col("_cap"), "_below": F.col("weight")}, "mix-levels")
    total, weight = src.agg(F.sum("source_size"), F.sum("weight")).first()
    src = src.withColumn("_level", (F.lit(share) * F.lit(total) - F.col("_full")) / (F.lit(weight) - F.col("_below")))
    first = src.filter("_ratio > _level").agg(F.min(F.struct("_ratio", "_rank", "_level"))).first()[0]
    target = F.col("_cap")
    if first:
        goes_on = F.struct("_ratio", "_rank") >= F.struct(F.lit(first["_ratio"]).alias("_ratio"), F.lit(first["_rank"]).cast("long").alias("_rank"))
        target = F.when(goes_on, F.col("weight") * F.lit(first["_level"])).otherwise(target)
    return src.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix-1") -> DataFrame:
    """How much of each document the mix takes.

    Rows get a hash-random key, are range-sorted by it within each source, and distributed
    prefix sums of word counts cut the source at its exact budget: ``epochs`` whole passes and
    then the first words up to the rest. Returns doc_id, size, source, source_size, target,
    taken, epochs, part (words of the pass that is cut).

    Null text counts as size 0; a null source is a source of its own; a null doc_id is an id
    like any other; repeated rows are taken each for itself. Extra columns are ignored. An
    empty table gives no rows.
    """
    sized = materialize(docs.select("source", *[c.alias(k) for k, c in keys(seed).items()]), "mix-sized")
    per_source = source_targets(sized, weights, share, cap)
    out = prefix_sums(sized, ["source"], ["key", "doc_id", "size", "crc"], {"before": F.col("size")}, "mix", per_source, few=0, written=True)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    out = out.withColumn("epochs", epochs.cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    out = out.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    return out.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", "key", "crc"
    )


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, with the columns of ``docs``.

    The plan's cut is one position in each source's order, so texts are never shuffled: each
    source's cut joins to the documents, which compare their own key with it. The document
    at the cut keeps its first words, joined by single spaces. Documents of no words pass
    once with each whole epoch. Of rows that repeat the key at the cut, as many are whole as the plan says and one is cut:
    those rows alone are numbered, by a hash of all their columns. Null text has no words and passes as null; null sources and ids are
    values like any other; extra columns pass through whatever their names; an empty table stays empty.
    """
    plan = materialize(mix_plan(docs, weights, share, cap, seed), "mix-plan")
    order = F.struct("key", "doc_id", "size", "crc")
    last = plan.groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(F.col("part") > 0, order)).alias("_last"))
    small = materialize(last, "mix-last")
    few = small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def to_sources(rows: DataFrame, per_source: DataFrame) -> DataFrame:
        return join_on(rows, F.broadcast(per_source), ["source"]) if few else spread(rows, per_source, ["source"], ["doc_id"])

    # how many rows repeat the last key that is taken, how many of them are whole, and what is left for the next
    ties = to_sources(plan.filter("part > 0"), small.select("source", "_last")).filter(order == F.col("_last"))
    ties = ties.groupBy("source").agg(F.count_if(F.col("part") == F.col("size")).alias("_whole"), F.max(F.when(F.col("part") < F.col("size"), F.col("part"))).alias("_cut"))
    cuts = materialize(join_on(small, ties, ["source"], "left"), "mix-cuts")
    repeats = to_sources(plan, small.select("source", "_last")).filter(order == F.col("_last")).groupBy("source").count().filter("count > 1").limit(1).count()

    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "source", F.struct(*[c.alias(k) for k, c in keys(seed).items()]).alias("_key"), "doc_id")
    rows = to_sources(keyed, cuts)
    at = F.coalesce(F.col("_key") == F.col("_last"), F.lit(False))
    place = F.when(at, F.lit(1))
    if repeats:
        here = rows.filter(at).withColumn("_order", F.xxhash64(F.to_json("doc")))
        rows = rows.filter(~at).withColumn("_at", F.lit(None).cast("long")).unionByName(positions(here, ["source"], ["_order"], "_at", "mix-repeats", few=0).drop("_order"))
        place = F.col("_at")
    n = F.col("_key.size")
    whole = F.when(place.isNotNull(), place <= F.col("_whole")).otherwise((n > 0) & F.col("_last").isNotNull() & (F.col("_key") < F.col("_last")))
    is_cut = F.coalesce(place == F.col("_whole") + 1, F.lit(False)) & F.col("_cut").isNotNull()
    copies = F.concat(F.array_repeat(F.lit(False), (F.col("_epochs") + F.coalesce(whole, F.lit(False)).cast("int")).cast("int")), F.when(is_cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = rows.select("doc", "_cut", F.explode(copies).alias("_is_cut"))
    words = let(F.filter(F.split(F.col("doc.text"), SPACE), lambda x: x != ""), lambda w: F.array_join(F.slice(w, F.lit(1), F.col("_cut").cast("int")), " "))
    text = F.when(F.col("_is_cut"), words).otherwise(F.col("doc.text"))
    return out.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
