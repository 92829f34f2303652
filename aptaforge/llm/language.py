"""Operator 10: language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aptaforge.llm.common import join_on, materialize, spread, text_batches

#: Longest context, in bytes.
ORDER = 3
#: Labelled documents that a language's statistics are taken from, and what is left out of a tree: see fit().
TRAIN_DOCS = 400
#: Bytes that trees in memory may take; the languages of more are met in groups, one after another. The trees of a single language are always whole.
MOST_BYTES = 256 << 20
#: Language counts up to this many are broadcast; above, they join through salted slots.
BROADCAST_LANGS = 100_000
#: Bytes that are scored at once.
SLICE = 1 << 20


def counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the byte strings of 1 to order + 1 bytes, by language."""
        held: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                into = held.setdefault(lang, {})
                code = np.zeros(len(data), dtype=np.uint64)
                for k in range(order + 1):
                    if len(data) <= k:
                        break
                    code = (code[: len(data) - k] << np.uint64(8)) | data[k:]
                    values, n = np.unique(code, return_counts=True)
                    for v, c in zip(values.tolist(), n.tolist(), strict=True):
                        gram = v.to_bytes(k + 1, "big")
                        into[gram] = into.get(gram, 0) + c
        rows = [(lang, gram, n) for lang, grams in held.items() for gram, n in grams.items()]
        for at in range(0, len(rows), 100_000):
            part = list(zip(*rows[at : at + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.int64())], names=["lang", "gram", "n"])

    return count


class ContextTrees:
    """Byte context trees of several languages, joined in one trie with a code length for each language.

    In a context seen T times with q different next bytes, a byte seen c times has probability
    c / (T + q), and the escape to the context without its first byte q / (T + q); the empty
    context escapes to a uniform choice of 256 bytes. ``cost[node]`` holds, for each language, the bits of the node's
    last byte after the bytes before it, escapes included; ``escape[node]`` the bits of leaving the
    node as a context (none where a language has not seen it). The statistics are frozen.
    """

    @classmethod
    def of(cls, arrays: dict) -> ContextTrees:
        """Trees from their plain arrays: what a broadcast carries, as executors may lack this package."""
        self = cls.__new__(cls)
        vars(self).update(arrays)
        return self

    def __init__(self, counts: dict[str, dict[bytes, int]], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        grams = sorted({g for c in counts.values() for g in c}, key=lambda g: (len(g), g))
        n, m = len(grams) + 1, len(self.langs)
        number = {b"": 0} | {g: i + 1 for i, g in enumerate(grams)}
        used = sorted({g[0] for g in grams if len(g) == 1})
        self.symbol = np.full(257, len(used), dtype=np.int64)  # bytes never learnt share a last symbol
        for i, b in enumerate(used):
            self.symbol[b] = i
        self.width = len(used) + 1
        deep = sum(1 for g in grams if len(g) <= order) + 1
        self.child = np.full((deep, self.width), -1, dtype=np.int32)
        total, kinds = np.zeros((n, m)), np.zeros((n, m))
        freq = np.zeros((n, m))
        for k, lang in enumerate(self.langs):
            for g, c in counts[lang].items():
                freq[number[g], k] = c
        for g in grams:
            up = number[g[:-1]]
            self.child[up, self.symbol[g[-1]]] = number[g]
            total[up] += freq[number[g]]
            kinds[up] += freq[number[g]] > 0
        self.escape = np.zeros((n, m), dtype=np.float32)
        seen = total > 0
        self.escape[seen] = -np.log2(kinds[seen] / (total + kinds)[seen])
        self.cost = np.zeros((n, m), dtype=np.float32)
        uniform = 8.0
        for g in grams:  # shorter first
            i, up = number[g], number[g[:-1]]
            lower = self.cost[number[g[1:]]] if len(g) > 1 else np.full(m, uniform)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = -np.log2(freq[i] / (total[up] + kinds[up]))
            self.cost[i] = np.where(freq[i] > 0, direct, self.escape[up] + lower)
        self.unseen = (self.escape[0] + uniform).astype(np.float32)

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths in bits, one row per text and a column per language. ``data`` joins the texts, ``ends`` cuts them."""
        out = np.zeros((len(ends), len(self.langs)))
        start_of = np.r_[0, ends[:-1]]
        starts = start_of[ends > start_of]
        for at in range(0, len(data), SLICE):
            stop = min(len(data), at + SLICE)
            back = max(0, at - self.order)
            costs = self._costs(self.symbol[data[back:stop]], starts[(starts >= back) & (starts < stop)] - back)[at - back :]
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, stop - 1, side="right")
            cuts = np.maximum(start_of[first : last + 1], at) - at
            keep = ends[first : last + 1] > start_of[first : last + 1]
            out[np.arange(first, last + 1)[keep]] += np.add.reduceat(costs, cuts[keep], axis=0, dtype=np.float64)
        return out

    def _costs(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(s)
        left = np.arange(n)
        if len(starts):
            origin = np.zeros(n, dtype=np.int64)
            origin[starts] = starts
            left = left - np.maximum.accumulate(origin)
        # node[k][i]: the trie's node for the k bytes up to i, or -1
        nodes = [np.zeros(n, dtype=np.int32)]
        for k in range(1, self.order + 2):
            before = np.r_[np.int32(-1), nodes[-1][:-1]] if k > 1 else nodes[0]
            at = self.child[np.maximum(before, 0), s]
            nodes.append(np.where((before >= 0) & (left >= k - 1), at, np.int32(-1)))
        cost = np.empty((n, len(self.langs)), dtype=np.float32)
        todo = np.arange(n)
        extra = None
        for k in range(self.order + 1, 0, -1):
            node = nodes[k][todo]
            hit = node >= 0
            got = self.cost[node[hit]]
            cost[todo[hit]] = got if extra is None else got + extra[hit]
            todo = todo[~hit]
            if not len(todo):
                return cost
            extra = np.zeros((len(todo), len(self.langs)), dtype=np.float32) if extra is None else extra[~hit]
            if k > 1:
                context = np.where(todo > 0, nodes[k - 1][todo - 1], -1)
                context = np.where(left[todo] >= k - 1, context, -1)
                extra = extra + np.where((context >= 0)[:, None], self.escape[np.maximum(context, 0)], 0)
        cost[todo] = extra + self.unseen
        return cost

    def best(self, texts: list[str | None]) -> tuple[list[str | None], list[float | None], list[float | None]]:
        """The likeliest language of each text, its code length, and the likelihoods of all languages as a multiple of its own; None for texts without a letter."""
        body = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(b) for b in body]) if body else np.zeros(0, dtype=np.int64)
        bits = self.score(np.frombuffer(b"".join(body), dtype=np.uint8), ends)
        known = [bool(self.langs) and t is not None and any(c.isalpha() for c in t) for t in texts]
        low = bits.min(axis=1, initial=np.inf)
        total = np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
        at = bits.argmin(axis=1) if self.langs else [0] * len(texts)
        return [self.langs[i] if k else None for i, k in zip(at, known, strict=True)], [float(v) if k else None for v, k in zip(low, known, strict=True)], [float(v) if k else None for v, k in zip(total, known, strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language of each text and the share of its likelihood among all languages, given equal priors."""
        lang, _, total = self.best(texts)
        return [v or "und" for v in lang], [1 / v if v else 0.0 for v in total]


def learnt(labelled: DataFrame, train_docs: int, order: int, name: str) -> DataFrame:
    """(lang, gram, n): counts of byte strings of doc_id, text, lang. Each language's statistics come from the whole texts of ``train_docs``
    documents at most, first by a hash of doc_id: a few times as many are picked by the hash alone, so that no
    language is gathered in one task, and ranked. Rows of one doc_id are picked or left together. Counting runs on the executors."""
    ok = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    totals = materialize(ok.groupBy("lang").agg(F.count("*").alias("_n")), f"{name}-totals")
    rows = ok.select("doc_id", "lang", key.alias("_key"))
    if totals.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        rows = join_on(rows, F.broadcast(totals), ["lang"])
    else:
        rows = spread(rows, totals, ["lang"], ["doc_id"])
    # the hashes below this share hold the first train_docs but for a chance below 1e-100
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.filter(share * F.col("_n") < 4 * max(train_docs, 250))
    by = Window.partitionBy("lang").orderBy("_key", "doc_id")
    ids = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= train_docs).select("doc_id", "lang")
    ids = materialize(ids.distinct(), f"{name}-ids")
    small = ids.limit(1_000_001).count() <= 1_000_000
    sample = join_on(ok.select("doc_id", "lang", "text"), F.broadcast(ids) if small else ids, ["doc_id", "lang"])
    grams = sample.select("lang", "text").mapInArrow(counter(order), "lang string, gram binary, n long")
    return materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"{name}-grams")


def trees_of(grams: DataFrame, order: int) -> ContextTrees:
    counts: dict[str, dict[bytes, int]] = {}
    for batch in grams.filter(F.octet_length("gram") <= order + 1).toArrow().to_batches():
        for lang, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.setdefault(lang, {})[gram] = n
    return ContextTrees(counts, order)


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER, name: str = "language", most_bytes: int | None = None) -> ContextTrees:
    """Context trees of all languages at once; see learnt(). Where the caller bounds their bytes by ``most_bytes``, contexts get shorter until they keep it
    (ValueError if even single bytes exceed it)."""
    grams = learnt(labelled, train_docs, order, name)
    langs = grams.select("lang").distinct().count()
    sizes = grams.select("gram").distinct().groupBy(F.octet_length("gram").alias("k")).count().collect()  # one row a length

    def size(order: int) -> int:
        """Two numbers a language for each string, and a row of children for each that is a context."""
        return sum(r["count"] * (8 * langs + (1028 if r["k"] <= order else 0)) for r in sizes if r["k"] <= order + 1)

    while most_bytes is not None and order and size(order) > most_bytes:
        order -= 1
    if most_bytes is not None and size(order) > most_bytes:
        raise ValueError(f"trees of {langs} languages exceed {most_bytes} bytes")
    return trees_of(grams, order)


def in_groups(grams: DataFrame, order: int, most_bytes: int) -> Iterator[ContextTrees]:
    """Trees of groups of languages, by name, that take ``most_bytes`` at most (or hold one language). What a language's trees say of a text does not
    depend on the others, so the groups only bound what is in memory at once; contexts have ``order`` bytes whatever the size."""
    deep = F.count(F.when(F.octet_length("gram") <= order, 1))
    groups: list[list] = []
    for lang, n, contexts in sorted(tuple(r) for r in grams.groupBy("lang").agg(F.count("*"), deep).collect()):
        if groups:
            last = groups[-1]
            if (last[1] + n) * 8 * (len(last[0]) + 1) + 1028 * (last[2] + contexts) <= most_bytes:
                groups[-1] = [[*last[0], lang], last[1] + n, last[2] + contexts]
                continue
        groups.append([[lang], n, contexts])
    for names, _, _ in groups:
        wanted = grams.sparkSession.createDataFrame([(v,) for v in names], "lang string")
        yield trees_of(grams if len(groups) == 1 else grams.join(F.broadcast(wanted), "lang").select("lang", "gram", "n"), order)


def identify(docs: DataFrame, trees: ContextTrees) -> Column:
    """A struct column (lang, bits, total) over the column ``text`` of ``docs``; see ContextTrees.best."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))

    @F.pandas_udf("lang string, bits double, total double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = ContextTrees.of(shared.value)
        for batch in texts:
            got: tuple[list, list, list] = ([], [], [])
            rows, held = [], 0
            for t in [*batch, ...]:  # parts of a few million bytes, whatever the texts' lengths
                if t is ... or held > 4_000_000:
                    for into, part in zip(got, trees.best(rows), strict=True):
                        into += part
                    rows, held = [], 0
                if t is not ...:
                    rows.append(t)
                    held += len(t or "")
            yield pd.DataFrame({"lang": pd.Series(got[0], dtype=object), "bits": pd.Series(got[1], dtype=float), "total": pd.Series(got[2], dtype=float)})

    return predict("text")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def predict_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of documents that are not held out (a null doc_id is not), and
    predicts every whole text. Null text, or text without a letter, is ``und`` with score 0, and so is all text
    where nothing could be learnt. Ties go to the first language by name. Repeated rows
    are predicted each; extra columns are ignored. Languages whose trees exceed ``most_bytes`` are met in groups, with the same results.
    """
    text_batches(docs.sparkSession)
    grams = learnt(docs.filter(~held_out()), train_docs, order, "language")
    rows, first = docs.select("doc_id", held_out().alias("held_out"), "text"), True
    for trees in in_groups(grams, order, most_bytes):
        if first:
            rows, first = rows.select("*", identify(rows, trees).alias("p")), False
            continue
        rows = materialize(rows, "language-group")  # so that a task holds the trees of one group
        rows = rows.withColumn("q", identify(rows, trees))
        low = F.least("p.bits", "q.bits")
        share = lambda c: F.col(f"{c}.total") * F.pow(F.lit(2.0), F.greatest(low - F.col(f"{c}.bits"), F.lit(-1000.0)))
        lang = F.when(F.col("q.bits") < F.col("p.bits"), F.col("q.lang")).otherwise(F.col("p.lang"))
        rows = rows.select("doc_id", "held_out", "text", F.struct(lang.alias("lang"), low.alias("bits"), (share("p") + share("q")).alias("total")).alias("p"))
    if first:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.select("doc_id", "held_out", F.coalesce("p.lang", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("p.total"), F.lit(0.0)).alias("score"))
