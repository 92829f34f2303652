"""Defined results for ties, clashing names, nulls and long texts, and whole operators against plain Python."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from aptaforge.llm import exact_dedup, language, mixing, packing, pseudonyms, quality, revisits, sharding, simhash, token_counts

REPO, SMALL = Path(__file__).resolve().parents[2], "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


# --- mixing ---


@pytest.mark.parametrize("rows", [
    [(1, "w " * 25, "a")] * 10, [(None, "w " * 7, None)] * 9 + [(None, "w " * 7, "b")] * 4 + [(2, "x y", "b")], [(1, None, "a"), (1, None, "a"), (2, "", "a"), (3, "one", "a")],
    [(i % 3, "w " * (5 + i % 2), "ab"[i % 2]) for i in range(40)],
])
def test_mixed_documents_follow_the_plan(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    plan, mixed = mixing.mix_plan(docs).collect(), mixing.mix_documents(docs).collect()
    want, got, passes = Counter(), Counter(), Counter()
    for r in plan:
        want[r.source] += r.taken
        passes[r.source] = r.epochs
    for r in mixed:
        got[r.source] += len((r.text or "").split())
    assert +got == +want
    # documents of no words pass once with each whole epoch; at most one row of a source is cut
    empty = Counter(s for _, t, s in rows if not (t or "").split())
    assert Counter(r.source for r in mixed if not (r.text or "").split()) == +Counter({s: n * passes[s] for s, n in empty.items()})
    whole = {(i, t) for i, t, _ in rows}
    assert all(n <= 1 for n in Counter(r.source for r in mixed if (r.doc_id, r.text) not in whole).values())


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Water filling: deal the rest by weight until nobody is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, rest = {s: weights[i % 3] for i, s in enumerate(names)}, {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in target]
        over = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) >= cap * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]


def test_targets_by_water_filling(spark):
    rng = np.random.default_rng(21)
    sizes = {f"s{i}": int(rng.integers(0, 400)) for i in range(11)} | {None: 50}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


# --- quality ---


def test_own_columns_pass_through_the_quality_stage(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "h", "mine", False, "q", None), (2, "short", "h", "mine", True, "q", 3), (None, good + " x", None, None, None, None, 4), (4, None, "h", "mine", True, "q", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, kept boolean, quality string, host int")
    got = quality.keep_good(docs, most=1.0)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter([rows[0], rows[2]])


# --- pseudonyms ---


def feistel(a, b, m, n, tweak, key):
    for r in range(8):
        other = b if r % 2 == 0 else a
        f = int(hashlib.sha256(f"{key}|{tweak}|{r}|{m}|{n}|{other}".encode()).hexdigest()[:15], 16)
        a, b = ((a + f % m) % m, b) if r % 2 == 0 else (a, (b + f % n) % n)
    return a, b


def permuted(text, alphabet, tweak, key):
    radix, half, out = len(alphabet), 1, []
    while radix ** (half + 1) < 1 << 60:
        half += 1
    for at in range(0, len(text), 2 * half):
        part = text[at : at + 2 * half]
        left = len(part) // 2
        num = lambda s: sum(alphabet.index(c) * radix**i for i, c in enumerate(reversed(s)))
        a, b = feistel(num(part[:left]), num(part[left:]), radix**left, radix ** (len(part) - left), tweak, key)
        for x, n in ((a, left), (b, len(part) - left)):
            out.append("".join(alphabet[x // radix**k % radix] for k in reversed(range(n))))
    return "".join(out)


def refilled(token, fresh, kind):
    it = iter(fresh)
    return "".join(next(it) if re.match(f"[{kind}]", c) else c for c in token)


def luhn_ok(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_pseudonym(token, key):
    digits = re.sub(r"\D", "", token)
    if "@" in token:
        local, domain = token.split("@", 1)
        letters, nums = re.sub("[^A-Za-z]", "", local).lower(), re.sub("[^0-9]", "", local)
        out = refilled(local, permuted(letters, pseudonyms.LETTERS, "email", key), "A-Za-z")
        return refilled(out, permuted(nums, pseudonyms.DIGITS, f"email|{letters}", key), "0-9") + "@" + domain
    if token.startswith("AKIA"):
        return "AKIA" + permuted(token[4:], pseudonyms.BASE32, "key", key)
    if re.fullmatch(r"\d+(\.\d+){3}", token):
        o = list(map(int, token.split(".")))
        if max(o) > 255:
            return token
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for shape, parts, form in ((r"(\d{4})-(\d\d)-(\d\d)", (0, 1, 2), "{:04d}-{:02d}-{:02d}"), (r"(\d\d)/(\d\d)/(\d{4})", (2, 0, 1), None)):
        m = re.fullmatch(shape, token)
        if m:
            g = list(map(int, m.groups()))
            try:
                day = date(*(g[k] for k in parts)).toordinal() - 1
            except ValueError:
                return token
            cycle, at = divmod(day, 146097)
            m_, n_ = (189, 773) if cycle < 24 else (93, 1567)
            a, b = feistel(at // n_, at % n_, m_, n_, "date", key)
            new = date.fromordinal(1) + timedelta(days=cycle * 146097 + a * n_ + b)
            return form.format(new.year, new.month, new.day) if form else f"{new.month:02d}/{new.day:02d}/{new.year:04d}"
    m = re.fullmatch(r"(\d{3})-(\d{2})-(\d{4})", token)
    if m:
        area, group, serial = map(int, m.groups())
        if not (0 < area < 900 and area != 666 and group and serial):
            return token
        a, b = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
        a += 1 + (a > 664)
        return f"{a:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if re.fullmatch(pseudonyms.PHONE, token):
        if len(digits) == 10 and token[0] != "+" or len(digits) == 11 and digits[0] == "1":
            area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
            if area < 200:
                a, b = feistel(area, exchange * 10000 + line, 200, 10_000_000, "phone", key)
            elif exchange < 200:
                a, b = feistel(area - 200, exchange * 10000 + line, 800, 2_000_000, "phone", key)
                a += 200
            else:
                a, b = feistel(area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000, "phone", key)
                a, b = a + 200, b + 2_000_000
            return refilled(token, digits[:-10] + f"{a:03d}{b:07d}", "0-9")
        return refilled(token, digits[:-10] + permuted(digits[-10:], pseudonyms.DIGITS, "phone", key), "0-9")
    if re.fullmatch(r"[\d -]+", token):
        if len(digits) > 19 or not luhn_ok(digits):
            return None  # runs that hold a number beside others: test_stages
        head = permuted(digits[:-1], pseudonyms.DIGITS, "card", key)
        return refilled(token, head + next(c for c in "0123456789" if luhn_ok(head + c)), "0-9")
    return permuted(token, pseudonyms.HEX, "hex", key)


def test_pseudonyms_against_plain_python(spark):
    """The registered query's operator over a whole table: each replaced value, and the text around it."""
    docs, key = spark.read.parquet(f"{SMALL}/documents.parquet"), "pseudonym-key:k"
    source, seen = {r.doc_id: r.text for r in docs.collect()}, Counter()
    for r in pseudonyms.pseudonymise(docs, "k").collect():
        text = source[r.doc_id]
        tokens = [m.group() for m in re.finditer(pseudonyms.ANY, text)] if text else []
        assert [p.token for p in r.pii] == tokens
        for p in r.pii:
            want = brute_pseudonym(p.token, key)
            seen[p.kind] += 1
            assert want is None or p.pseudonym == want, (p, want)
        gaps = re.split(pseudonyms.ANY, text) if text else []
        if text:
            assert r.text == "".join(g + n for g, n in zip(gaps, [*[p.pseudonym for p in r.pii], ""], strict=True))
    assert len(seen) >= 4


def test_formats_hold_at_their_bounds(spark):
    cases = ["0001-01-01", "0400-12-31", "9600-12-31", "9601-01-01", "9999-12-31", "2024-02-30", "12345678901234567890", "deadbeefdeadbeef", "(212) 555-0100", "012-345-6789", "+44 20 7946 0958", "212-055-0100"]
    out = {r.text0: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(t, t) for t in cases], "text0 string, text string"), "k").collect()}
    assert out["2024-02-30"] == "2024-02-30" and out["12345678901234567890"] == "12345678901234567890"
    for t in cases[:5]:
        assert re.fullmatch(r"\d{4}-\d\d-\d\d", out[t]) and date.fromisoformat(out[t]) and (int(out[t][:4]) > 9600) == (int(t[:4]) > 9600)
    assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", out["(212) 555-0100"]) and re.fullmatch(r"[01]\d\d-\d{3}-\d{4}", out["012-345-6789"])
    assert re.fullmatch(r"[2-9]\d\d-[01]\d\d-\d{4}", out["212-055-0100"]) and re.fullmatch(r"\+44 \d\d \d{4} \d{4}", out["+44 20 7946 0958"])
    assert all(out[t] == brute_pseudonym(t, "pseudonym-key:k") for t in cases if not re.fullmatch(r"\d{20}", t))
    days = spark.range(145731 - 3000, 145731).select(F.date_format(F.date_from_unix_date((F.col("id") + 24 * 146097 - 719162).cast("int")), "yyyy-MM-dd").alias("t"))
    moved = days.select(pseudonyms.date_pseudonym(F.col("t"), "yyyy-MM-dd", "k").alias("p")).filter("p rlike '^9[6-9][0-9]{2}-[0-9]{2}-[0-9]{2}$'")
    assert moved.distinct().count() == 3000


# --- packing, sharding ---


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_against_all_windows(seed):
    rng = np.random.default_rng(seed)
    lengths, cap = rng.integers(1, 65, 400), 64
    windows, offsets, n = packing.best_fit_decreasing(lengths, cap)
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [cap - u for u in used if cap - u >= lengths[i]]
        tightest = min(fits) if fits else cap
        assert cap - offsets[i] == tightest
        if not fits:
            used.append(0)
        assert used[windows[i]] == offsets[i]
        used[windows[i]] += lengths[i]
    assert n == len(used)


def test_shards_against_plain_python(spark):
    rng = np.random.default_rng(22)
    rows = [(int(rng.integers(0, 200)) or None, None if i % 17 == 0 else "é" * int(rng.integers(0, 90)), "a") for i in range(300)] + [(7, "same", "a")] * 5
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", shard string, size int")
    out = sharding.shard_by_bytes(docs, 9).collect()
    sized = sorted((i is None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in rows)
    total, start, want, slots = sum(s[3] for s in sized), 0, [], Counter()
    for none, i, crc, size in sized:
        shard = min((2 * start + size) * 9 // (2 * total), 8)
        want.append((None if none else i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        start += size
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == Counter(want)


# --- token counts ---


@pytest.mark.parametrize("long", [token_counts.LONG, 300])
def test_counts_of_a_whole_table_equal_the_library(spark, long):
    """All texts where they lie, and all texts of over 300 characters in pieces over several tasks."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, " a  b" * 500), (None, " a  b" * 500), (-1, "x" * 1000), (-2, None)], "doc_id long, text string"))
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(len(sp.encode(r.text or "")))
    got = defaultdict(list)
    for r in token_counts.count_tokens(docs, path, long=long).collect():
        got[r.doc_id].append(r.n_tokens)
        assert r.over_limit == (r.n_tokens > 4096)
    assert got == text


def test_state_maps_compose(spark):
    machine = token_counts.CountingTransducer.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    text = machine.marked("some words that go  on, and on   and on")
    for a, b in ((3, 9), (5, 17), (11, 12), (1, 30)):
        parts = [machine.chunk_map(x) for x in (text[:a], text[a:b], text[b:])]
        left = machine.compose(machine.compose(parts[0], parts[1]), parts[2])
        right = machine.compose(parts[0], machine.compose(parts[1], parts[2]))
        for entry in (machine.FIRST, machine.drive(machine.FIRST, "▁th")[0], machine.drive(machine.FIRST, "▁▁")[0]):
            assert machine.at(left, entry) == machine.at(right, entry) == machine.drive(entry, text)


# --- near duplicates ---


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(23)
    base = [rng.choice([f"w{i}" for i in range(300)], 120).tolist() for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(base[i % 25])
        for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[at] = "other"
        rows.append((1000 - i if i % 11 else None, " ".join(w), "x"))
    rows += [(5000, None, "x"), (4000, "", "x"), (4001, " ", "x")]
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    smallest = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    want = Counter((rows[i][0], simhash.signed(prints[i]), smallest[label[i]]) for i in range(len(rows)))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_exact_copies_of_null_ids(spark):
    rows = [(None, "a b", "x")] * 3 + [(3, "a  b", "x"), (2, "a b", "x"), (2, "a b", "x"), (None, "c", "x"), (None, "c", "x")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.group_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(None, 2, 6, False): 3, (3, 2, 6, False): 1, (2, 2, 6, True): 1, (2, 2, 6, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1})


# --- language ---


def test_contexts_shorten_to_fit(spark):
    docs = spark.createDataFrame([(i, "abc abd " * 20 if i % 2 else "xyz xyy " * 20, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert language.fit(docs).order == 3 and language.fit(docs, most_bytes=12_000).order < 3
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs, most_bytes=10)
    assert language.fit(docs, most_bytes=12_000).predict(["abc abd", "xyz"])[0] == ["b", "a"]


def test_workers_without_the_package(tmp_path):
    """From another folder, without PYTHONPATH, Python workers cannot import this package."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from aptaforge.llm import catalog
for name in ("op5_exact_dedup", "op6_pack_sequences", "op8_count_tokens", "op9_simhash_groups", "op10_identify_language"):
    assert catalog.QUERIES[name](spark, {SMALL!r}).count() >= 200, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


# --- revisits ---


def test_odd_records(spark):
    schema = "record_id long, url string, warc_date long, record_type string, status int, etag string, last_modified string, payload_digest string, headers map<string,string>, verdict string, _part int, _r string, doc int"
    own = ("mine", 7, "r", 3)
    rows = [
        (1, "http://a.com/", 10, "response", 200, '"e"', None, "d", None, *own), (1, "http://a.com/", 10, "response", 200, '"e"', None, "d", None, *own),
        (2, "http://a.com", 20, "revisit", 304, '"e"', None, None, None, *own), (2, "http://a.com", 20, "revisit", 304, '"e"', None, None, None, *own),
        (3, "http://a.com", None, "revisit", 304, None, None, "d", None, *own), (None, "http://a.com", 15, None, None, None, None, None, None, *own), (4, "", 5, "revisit", 304, None, None, None, None, *own),
        (5, None, 50, "revisit", 304, '"e"', None, None, None, *own), (6, "http://b.com/" + "x" * 100_000, 1, "response", 200, None, None, "long", {"a": "b"}, *own),
        (7, "https://www.b.com/" + "x" * 100_000 + "#y", 2, "revisit", 304, None, None, "long", {"a": "c"}, *own),
    ]
    out = revisits.resolve_revisits(spark.createDataFrame(rows, schema))
    assert out.columns == [c.split()[0] for c in schema.split(", ") if not c.startswith("verdict")] + ["canonical_url", "resolved_id", "resolved_digest", "verdict", "merged_headers"]
    got = Counter((r.record_id, r.verdict, r.resolved_id, r.resolved_digest) for r in out.collect())
    assert got == Counter({(1, "full", 1, "d"): 2, (2, "match", 1, "d"): 2, (3, "match", 1, "d"): 1, (None, "full", None, None): 1, (4, "missing", None, None): 1, (5, "missing", None, None): 1, (6, "full", 6, "long"): 1, (7, "match", 6, "long"): 1})
    assert all((r._part, r._r, r.doc) == own[1:] for r in out.collect()) and out.filter("record_id = 7").first().merged_headers == {"a": "c"}
    assert revisits.resolve_revisits(out.limit(0)).count() == 0


# --- odd rows, by value ---


def test_odd_texts_have_defined_results(spark):
    long = "long text " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "one two"), (None, "one two"), (4, long)]
    docs = spark.createDataFrame([(i, t, None, "pii", 1.5, "tok", True) for i, t in rows], "doc_id long, text string, lang string, pii string, n_tokens double, fp string, held_out boolean")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    counted = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert counted == Counter((i, len(t or ""), len(sp.encode(t or ""))) for i, t in rows)
    private = pseudonyms.pseudonymise(docs, "k")
    assert Counter((r.doc_id, r.text, len(r.pii), r.n_tokens) for r in private.collect()) == Counter((i, t, 0, 1.5) for i, t in rows)
    told = Counter((r.doc_id, r.lang_pred, r.score) for r in language.predict_languages(docs).collect())
    assert told == Counter((i, "und", 0.0) for i, _ in rows)  # nothing could be learnt
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(i for i, _ in rows) and sum(r.length for r in packed if r.doc_id == 4) == packed[[r.doc_id for r in packed].index(4)].doc_tokens
    prints = Counter((r.doc_id, r.fp) for r in simhash.near_groups(docs).collect())
    assert prints == Counter((i, simhash.signed(simhash.fingerprint(t))) for i, t in rows)
    empty = docs.limit(0)
    assert token_counts.count_tokens(empty, path).count() == pseudonyms.pseudonymise(empty, "k").count() == packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_languages_in_groups(spark):
    """Contexts stay as long, and predictions the same, however few languages' trees fit in memory at once."""
    words = {"a": "the house and the tree ", "b": "das haus und der baum ", "c": "la casa y el arbol ", "d": "talo ja puu ovat "}
    rows = [(i, words[lang] * (1 + i % 4) + str(i), lang) for i, lang in enumerate("abcd" * 20)] + [(900, None, "a"), (901, "12 3", None), (902, "der baum and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r.doc_id: r for r in language.predict_languages(docs).collect()}
    assert {r.lang_pred for r in want.values()} == {"a", "b", "c", "d", "und"}
    for most in (1, 200_000):
        got = {r.doc_id: r for r in language.predict_languages(docs, most_bytes=most).collect()}
        assert {k: r.lang_pred for k, r in got.items()} == {k: r.lang_pred for k, r in want.items()}
        assert all(abs(got[k].score - want[k].score) < 1e-4 for k in want)
    grams = language.learnt(docs, 400, 3, "groups")
    groups = list(language.in_groups(grams, 3, 1))
    assert [t.langs for t in groups] == [["a"], ["b"], ["c"], ["d"]] and {t.order for t in groups} == {3}
    assert [t.langs for t in language.in_groups(grams, 3, language.MOST_BYTES)] == [["a", "b", "c", "d"]]
