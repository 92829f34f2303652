"""Operator 4: host-level quality rules (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import SPACE, WORD, join_on, let, materialize, spread

#: Hosts with a verdict of "reject" are broadcast up to this many; above, they join through salted slots.
BROADCAST_HOSTS = 100_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: sort (hash, position), keep the
    positions of equal neighbours, and add up what each adds to the one before it."""

    def positions(pairs: Column) -> Column:
        n = F.size(pairs)
        twins = F.zip_with(
            F.slice(pairs, F.lit(1), n - 1),
            F.slice(pairs, F.lit(2), n - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(twins)))

    def length(at: Column) -> Column:
        n = F.size(at)
        steps = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.when(n > 0, F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(F.lit(0))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(let(pairs, positions), length)


def _measures(words: Column) -> Column:
    n = F.size(words)
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))
    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)))
    return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))


def text_measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text that is not null.

    Windows are compared by 64-bit hashes within a document: in a text of a million words, two
    different windows share one with a probability below 1e-7.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _measures)
    return F.struct(
        words["n_words"].alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        counted["n"].alias("n_lines"),
        counted["dup"].alias("n_dup_lines"),
        words["n_repeat_words"].alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> Column:
    """What counts against a host: the base rule, words of odd mean length, many symbols, many repeated lines."""
    return (
        F.col("base_failed")
        | (F.col("word_chars") < 2 * F.col("n_words"))
        | (F.col("word_chars") > 15 * F.col("n_words"))
        | (5 * F.col("n_symbols") > F.col("n_words"))
        | (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))
    )


def host_verdicts(measured: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """One row per host: docs, fails, host_rate (posterior mean under the empirical beta prior), host_rejected.

    The prior's mean is the overall rate; its strength comes from the spread of the hosts' rates
    beyond what chance gives, by the method of moments. Its two numbers are the only thing that
    reaches the driver.
    """
    hosts = measured.groupBy(host).agg(F.count("*").alias("docs"), F.sum(rule_failed().cast("long")).alias("fails"))
    k, n, f, f2 = hosts.agg(F.count("*"), F.sum("docs"), F.sum("fails"), F.sum(F.col("fails") * F.col("fails") / F.col("docs"))).first()
    a, b = beta_prior(k or 0, n or 0, f or 0, f2 or 0.0)
    rate = (F.col("fails") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > most)


def beta_prior(hosts: int, docs: int, fails: int, squares: float) -> tuple[float, float]:
    """Method of moments from the sums over hosts of n, f and f*f/n."""
    if docs == 0:
        return 1.0, 1.0
    m = min(max(fails / docs, 0.5 / docs), 1 - 0.5 / docs)
    chance = m * (1 - m) * hosts / docs
    between = max(squares / docs - (fails / docs) ** 2 - chance, 1e-6)
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1000.0)
    return m * strength, (1 - m) * strength


def judge(docs: DataFrame, host: str = "source", most: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """(doc, quality): the columns of ``docs`` as a struct, so that no name of theirs can clash, and a struct of the measures,
    base_failed, host_rate, host_rejected and ``kept``. ``carry`` names the columns that ``doc`` holds, all by default.

    A document goes if it fails the base rule or if its host's shrunk failure rate exceeds
    ``most``. What ``doc`` carries is written once with the measures, so texts are read and split once, and without ``text`` in it no text is
    written. Null text has no words and so fails; a null host is a host of its own; repeated rows each count;
    an empty table gives no rows.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.struct(*(docs.columns if carry is None else carry)).alias("doc"), F.col(host).alias("host"), text_measures(F.coalesce(F.col("text"), F.lit(""))).alias("m"))
    measured = materialize(rows.select("doc", "host", *[F.col(f"m.{c}").alias(c) for c in measures]).withColumn("base_failed", base_failed()), "quality-measured")
    verdicts = materialize(host_verdicts(measured, "host", most), "quality-hosts").select("host", "host_rate", "host_rejected")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        out = join_on(measured, F.broadcast(verdicts), ["host"])
    else:
        out = spread(measured, verdicts, ["host"], ["n_words", "word_chars", "doc"])
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    return out.select("doc", F.struct(*measures, "base_failed", "host_rate", "host_rejected", kept.alias("kept")).alias("quality"))


def keep_good(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    return judge(docs, host, most).filter("quality.kept").select("doc.*")
