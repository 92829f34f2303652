import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from aptaforge.llm import quality
from aptaforge.llm.common import WORD
from aptaforge.llm.mixing import word_count
from tests.llm.test_cases import brute_targets
from tests.llm.test_stages import about_the_limit, brute_near, words


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        counts.append(kept.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    total = kept.agg(F.sum(word_count())).first()[0]
    assert total > 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() >= counts[4]


def brute_quality(rows):
    """Rows (doc_id, text, source) that pass the base rule and whose host does."""
    fails, base = defaultdict(list), []
    for _, text, source in rows:
        t = text or ""
        w = re.findall(WORD, t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = len({i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)})
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
        bad = len(w) < 10 or 100 * repeated > 20 * len(w)
        odd = chars < 2 * len(w) or chars > 15 * len(w) or 5 * symbols > len(w) or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        base.append(bad)
        fails[source].append(bad or odd)
    n, f = len(rows), sum(map(sum, fails.values()))
    a, b = quality.beta_prior(len(fails), n, f, sum(sum(x) ** 2 / len(x) for x in fails.values()))
    rejected = {s for s, x in fails.items() if (sum(x) + a) / (len(x) + a + b) > 0.5}
    return [r for r, bad in zip(rows, base, strict=True) if not bad and r[2] not in rejected]


def brute_exact(rows):
    """The smallest id of each group of equal texts, nulls last, as (id, normalised text)."""
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((i is None, i or 0))
    return Counter((None if min(g)[0] else min(g)[1], t) for t, g in groups.items())


def brute_mix(rows):
    """(id, text) as often as the mix takes them, cut texts too."""
    sized = defaultdict(list)
    for i, text, source in rows:
        n = len(re.findall(WORD, text or ""))
        key = hashlib.md5(f"{'' if i is None else i}:mix-1".encode()).hexdigest()
        sized[source].append((key, i is None, i or 0, n, zlib.crc32((text or "").encode()), text))
    targets, out = brute_targets({s: sum(r[3] for r in x) for s, x in sized.items()}), Counter()
    for source, x in sized.items():
        budget, size = int(targets[source] + 1e-9), sum(r[3] for r in x)
        epochs = budget // size if size else 0
        rest = budget - epochs * size
        for _, none, i, n, _, text in sorted(x, key=lambda r: r[:5]):
            part = max(0, min(n, rest))
            rest -= part
            doc = None if none else i
            out[doc, text] += epochs + (part == n > 0)
            if 0 < part < n:
                out[doc, " ".join(re.findall(WORD, text)[:part])] += 1
    return +out


def test_each_stage_and_run_against_plain_python(spark, tmp_path):
    """Repeated rows, null and reused ids, clashing columns, and pairs on both sides of 0.8, through all stages."""
    rng = np.random.default_rng(31)
    rows = [(i, t, "ab"[i % 2]) for i, t, _ in about_the_limit(rng, 0, 25)]
    good = [" ".join(words(rng, 80, "g")) for _ in range(12)]
    rows += [(1000 + k, t, [None, "a", "c"][k % 3]) for k, t in enumerate(good)]
    rows += [(1000, good[0], None)] * 2 + [(2000, good[1].replace(" ", "\n\t", 3), "a"), (None, good[2], "c"), (None, " ".join(words(rng, 50)), "c"), (1003, " ".join(words(rng, 40)), "b")]
    rows += [(3000 + k, "bad words " * 20, "spam") for k in range(9)] + [(3100, " ".join(words(rng, 60)), "spam"), (3200, None, "a"), (3201, "", "b"), (3202, "too short", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, doc string, stays boolean"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "own", "own", "own", True) for i, t, s in rows], schema)
    stage = dict(corpus_pipeline.STAGES)

    def got(df):
        assert df.columns == docs.columns[: len(df.columns)]
        found = df.collect()
        assert all(r.kept == r.size == r.doc == "own" and r.stays for r in found)
        return [(r.doc_id, r.text, r.source) for r in found], df

    kept, df = got(stage["quality_rules"](spark, docs, ""))
    assert Counter(kept) == Counter(brute_quality(rows)) and not any(r[2] == "spam" for r in kept)
    once, df = got(stage["exact_dedup"](spark, df, ""))
    assert Counter((i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t, _ in once) == brute_exact(kept)
    few, df = got(stage["simhash_near_dedup"](spark, df, ""))
    assert Counter((i, t) for i, t, _ in few) == brute_near(once) and len(few) < len(once)
    mixed, df = got(stage["mix_sources"](spark, df, ""))
    assert Counter((i, t) for i, t, _ in mixed) == brute_mix(few)

    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t, _ in mixed:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            pieces[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1

    def check(df):
        found = df.collect()
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == pieces
        windows = defaultdict(list)
        for r in found:
            windows[r.sequence_id].append((r.offset, r.length))
        for w in windows.values():
            w.sort()
            assert [o for o, _ in w] == [0, *np.cumsum([n for _, n in w])[:-1].tolist()] and sum(n for _, n in w) <= 4096

    check(stage["pack_sequences"](spark, df, ""))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(corpus_pipeline.run(spark, str(tmp_path)))


def test_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
