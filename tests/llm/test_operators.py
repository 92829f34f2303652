import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from aptaforge.llm import exact_dedup, language, mixing, packing, pseudonyms, quality, revisits, sharding, simhash, token_counts
from aptaforge.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, kept string, node string, recipe string"
LOREM = "the quick brown fox jumps over the lazy dog and then it runs away from all of the other dogs in town "


def frame(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", None), (5, "one  two\nthree", "b"), (6, "one two three", "b"), (6, "one two three", "b"),
    (None, "ghost text with a few words", "b"), (7, LOREM * 3000, "a"), (8, LOREM.upper() * 3000, "a"), (9, "É" * 50 + " ẞ 日本 <|endoftext|> \x00", "c"),
]
EMPTY: list = []


@pytest.mark.parametrize("rows", [ODD, EMPTY])
def test_all_operators_take_odd_rows(spark, rows):
    docs, n = frame(spark, rows), len(rows)
    assert mixing.mix_plan(docs).count() == n
    assert sharding.shard_by_bytes(docs).count() == n
    assert quality.judge(docs).count() == n
    assert exact_dedup.group_copies(docs).count() == n
    assert simhash.near_groups(docs).count() == n
    assert pseudonyms.pseudonymise(docs, "k").count() == n
    assert language.predict_languages(docs).count() == n
    assert token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct().count() == len({r[0] for r in rows})
    mixing.mix_documents(docs).count()
    simhash.near_copies(docs).count()


def test_mix_reaches_each_target(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 90)), "abc"[min(i % 7, 2)]) for i in range(300)]
    docs = frame(spark, rows)
    plan = mixing.mix_plan(docs).toPandas()
    per = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (per.taken == np.floor(per.target)).all() and (per.target <= 2 * per["size"]).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 or (per.target == 2 * per["size"]).any()
    assert (plan.taken <= 2 * plan["size"]).all()
    mixed = mixing.mix_documents(docs).select("source", mixing.word_count().alias("n")).groupBy("source").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in mixed} == per.taken.to_dict()


def test_shards_are_contiguous_and_even(spark):
    rows = [(i * 3 % 1000, "x" * (i * 37 % 400), "a") for i in range(1000)]
    out = sharding.shard_by_bytes(frame(spark, rows), 7).toPandas().sort_values("doc_id")
    assert out.shard.is_monotonic_increasing
    total = out.groupby("shard")["size"].sum()
    assert len(total) == 7 and total.max() - total.min() <= 2 * out["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)
    text = dict((i, t) for i, t, _ in rows)
    assert all(zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and r.size == len(text[r.doc_id]) + 16 for r in out.itertuples())


def repeated_words(text):
    w = re.findall(WORD, text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abcdef"), int(rng.integers(0, 40)))) + "\n" + "a b\n" * int(rng.integers(0, 4)), "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, "word " * 50, "bad") for i in range(40)] + [(200, " ".join(f"w{i}" for i in range(60)), "bad")]
    out = {r.doc.doc_id: r.quality for r in quality.judge(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        assert out[i].n_repeat_words == repeated_words(t) and out[i].n_words == len(re.findall(WORD, t))
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert out[i].n_dup_lines == len(lines) - len(set(lines))
    assert not out[200].base_failed and out[200].host_rejected and not out[200].kept


def test_beta_prior_shrinks():
    a, b = quality.beta_prior(10, 1000, 100, 10.0)
    assert abs(a / (a + b) - 0.1) < 1e-9 and a + b <= 1000
    assert quality.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)


def brute_groups(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_exact_dedup(spark, id_bytes):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abc de\n"), 9000)) for _ in range(6)]
    rows = [(i, base[i % 6] + ("!" if i % 5 == 0 else ""), "a") for i in range(40)]
    rows += [(90, None, "a"), (91, "", "a"), (92, " ", "a"), (93, "\n\t", "a"), (94, base[0].replace(" ", "  "), "b")]
    out = {r.doc_id: r for r in exact_dedup.group_copies(frame(spark, rows), bits=7, id_bytes=id_bytes).collect()}
    for text, ids in brute_groups(rows).items():
        for i in ids:
            assert (out[i].keep_id, out[i].group_size, out[i].kept) == (min(ids), len(ids), i == min(ids))
            assert out[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    twice = exact_dedup.group_copies(frame(spark, [(1, "x", "a"), (1, "x", "a"), (2, "x", "a")])).collect()
    assert sum(r.kept for r in twice) == 1


def test_chunks_follow_content():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()

    def cut(d):
        ends = exact_dedup.boundaries(d)
        return [d[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    assert b"".join(cut(a)) == a
    assert len(set(cut(a)) & set(cut(b"inserted" + a))) > 0.8 * len(cut(a))
    assert max(map(len, cut(b"a" * 200_000))) <= 1 << 16


def test_fingerprint_by_definition(spark):
    import xxhash

    for text in ("", "a", "A b  C", "one two three four five six one two three four", LOREM * 20):
        words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize(("radius", "fill", "block"), [(4, 512, 1024), (4, 1, 16), (7, 512, 8)])
def test_bit_sliced_links_equal_brute_force(spark, radius, fill, block):
    rng = np.random.default_rng(radius + fill)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in fps[:20]:
        for _ in range(8):
            g = f
            for b in rng.choice(64, rng.integers(0, radius + 3), replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted({simhash.signed(f) for f in fps})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, fill, block)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    arr = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None]) <= radius
    label = simhash.forest(len(fps), *np.nonzero(near))
    assert [got.get(f, f) for f in fps] == [fps[k] for k in label]


def test_near_copies_of_the_pipeline(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    texts = [rng.choice(words, 300).tolist() for _ in range(30)]
    rows = [(i, " ".join(t), "a") for i, t in enumerate(texts)]
    for i in range(15):
        t = list(texts[i])
        for at in rng.choice(300, 3, replace=False):
            t[at] = "changed"
        rows.append((100 + i, " ".join(t), "a"))
    out = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert all(out[100 + i] == i for i in range(15)) and all(out[i] == i for i in range(30))


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = token_counts.CountingTransducer.from_model(path)
    texts = ["", " ", "  a", "a  ", " a  b ", "\n\n x", "▁", "a▁▁b", "<s> </s> <unk>", "日本語 テスト", "\U0001f600 ok", "a" * 300, " " * 100 + "x", "x" + " " * 40, "1234 5678", LOREM * 10]
    for chunk in (1, 2, 3, 7, 1 << 16):
        assert [machine.count(t, chunk) for t in texts] == [len(sp.encode(t)) for t in texts]


def test_packing_rebuilds_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [r for r in ODD if r[0] not in (None, 6)] + [(100 + i, LOREM * (i % 9), "a") for i in range(200)]
    out = packing.pack(frame(spark, rows), path).toPandas()
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert mine.start.iloc[0] == 0 and mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 4096


def test_best_fit_takes_the_tightest_window():
    windows, offsets, n = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert (windows.tolist(), offsets.tolist(), n) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8], 2)


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111, 4111111111111111; no 4111111111111112", "a"), (2, "4111-1111-1111-1111 and 10.1.2.3. not 300.1.1.1", "a"),
        (3, "2024-02-29 02/28/2023 2023-02-30 123-45-6789 000-45-6789", "a"), (4, "Ann.99@mail9.example.com +1 (743) 555-3824 743-555-3824", "a"), (5, "plain", "a"),
    ]
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(frame(spark, rows), "k").collect()}
    new = [re.sub(r"\D", "", p.pseudonym) for i in (1, 2) for p in out[i].pii if p.kind == "card" and p.token != p.pseudonym]
    assert len(new) == 3 and len(set(new)) == 1 and new[0] != "4111111111111111"
    digits = [int(c) for c in new[0]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert "4111111111111112" in out[1].text and "300.1.1.1" in out[2].text and "10.1.2.3" not in out[2].text
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d/\d\d/\d{4} 2023-02-30 \d{3}-\d\d-\d{4} 000-45-6789", out[3].text) and "2024-02-29" not in out[3].text
    assert re.fullmatch(r"[A-Za-z]{3}\.\d\d@mail9\.example\.com \+1 \(\d{3}\) \d{3}-\d{4} \d{3}-\d{3}-\d{4}", out[4].text)
    a, b = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", out[4].text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "7435553824"
    assert out[5].text == "plain"


def test_pseudonyms_are_a_permutation(spark):
    rows = spark.range(1000).select(F.format_string("%03d", "id").alias("t"))
    out = rows.select(pseudonyms.permute_text(F.col("t"), pseudonyms.DIGITS, F.lit("x"), "k").alias("p")).distinct()
    assert out.count() == 1000 and out.filter("p rlike '^[0-9]{3}$'").count() == 1000
    longs = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("t"))
    assert longs.select(pseudonyms.permute_text(F.col("t"), pseudonyms.HEX, F.lit("x"), "k").alias("p")).filter("length(p) = 64").distinct().count() == 200


def test_revisits(spark):
    schema = "record_id long, url string, warc_date long, record_type string, status int, etag string, last_modified string, payload_digest string, headers map<string,string>"
    full = {"content-type": "a", "content-length": "9", "x": "old"}
    rows = [
        (1, "http://www.A.com/p/?b=1&a=2&utm_x=3#f", 10, "response", 200, '"e"', "m", "d1", full), (2, "https://a.com/p?a=2&b=1", 20, "revisit", 304, 'W/"e"', None, None, {"x": "new", "content-length": "0"}),
        (3, "https://a.com/p?a=2&b=1", 5, "revisit", 304, '"e"', None, None, None), (4, "https://a.com/p?a=2&b=1", 30, "response", 500, None, None, "d2", None),
        (5, "https://a.com/p?a=2&b=1", 40, "revisit", 304, '"z"', "m", None, None), (6, "https://a.com/p?a=2&b=1", 40, "revisit", 304, None, None, None, None), (7, None, 1, "revisit", 304, None, None, None, None),
    ]
    out = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert [out[i].verdict for i in range(1, 8)] == ["full", "match", "missing", "full", "mismatch", "unverified", "missing"]
    assert out[2].merged_headers == {"content-type": "a", "content-length": "9", "x": "new"} and out[2].resolved_digest == "d1" and out[6].resolved_id == 1
    assert revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_as_of_join_over_many_slices(spark):
    """One URL holds all rows, so it spans every partition."""
    rows = spark.range(400).selectExpr(
        "id AS record_id", "'http://h/p' AS url", "id AS warc_date", "if(id % 50 = 0, 'response', 'revisit') AS record_type", "200 AS status", "cast(null AS string) AS etag",
        "cast(null AS string) AS last_modified", "'d' AS payload_digest", "cast(null AS map<string,string>) AS headers",
    )
    assert revisits.resolve_revisits(rows).filter("resolved_id != record_id - record_id % 50 OR resolved_id IS NULL").count() == 0


def brute_bits(counts, data, order):
    """Code length by walking the escapes byte by byte."""
    bits = 0.0
    for i in range(len(data)):
        for k in range(min(order, i), -1, -1):
            ctx = data[i - k : i]
            after = {g: c for g, c in counts.items() if len(g) == k + 1 and g[:k] == ctx}
            total, kinds = sum(after.values()), len(after)
            if not total:
                continue
            if data[i - k : i + 1] in after:
                bits -= np.log2(after[data[i - k : i + 1]] / (total + kinds))
                break
            bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(monkeypatch):
    train = {"x": b"abracadabra abra", "y": b"hocus pocus hocus cadabra"}
    counts = {k: dict(Counter(t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1))) for k, t in train.items()}
    trees = language.ContextTrees(counts, 3)
    texts = [b"abra", b"pocus!", b"zz", b"cad hocus", b"", b"q"]
    for size in (1 << 20, 5):
        monkeypatch.setattr(language, "SLICE", size)
        bits = trees.score(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]))
        for t, row in zip(texts, bits, strict=True):
            assert np.allclose(row, [brute_bits(counts[k], t, 3) for k in trees.langs], atol=1e-3)
    assert trees.predict(["abracadabra", "hocus pocus", None, "123 !"])[0] == ["x", "y", "und", "und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.predict_languages(docs).join(docs, "doc_id").filter("held_out").select((F.col("lang_pred") == F.col("lang")).alias("ok"))
    assert got.agg(F.avg(F.col("ok").cast("int"))).first()[0] > 0.9
