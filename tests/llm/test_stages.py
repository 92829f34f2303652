"""The pipeline's stages on repeated rows, reused ids, null ids and pairs about the limit, against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from aptaforge.llm import exact_dedup, pseudonyms, simhash

SCHEMA = "doc_id long, text string, source string"


def words(rng, n, tag="w"):
    return [f"{tag}{x}" for x in rng.integers(0, 1_000_000, n)]


def ids_and_texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, simhash.drop_near_copies])
def test_a_row_is_its_id_and_text(spark, stage):
    rng = np.random.default_rng(11)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (3, c, "y"), (4, d, "x"), (4, d.replace(" ", "  ", 1), "x")]
    got = stage(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "source"]
    assert Counter((i, re.sub(" +", " ", t)) for i, t in ids_and_texts(got).elements()) == Counter([(1, a), (2, b), (3, c), (4, d)])


def test_null_ids_of_exact_copies(spark):
    rows = [(1, "a text", "x"), (None, "a  text", "x"), (None, "other", "x"), (None, "other", "x"), (None, None, "x"), (5, " ", "x"), (5, "", "x")]
    got = ids_and_texts(exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA)))
    assert got == Counter([(1, "a text"), (None, "other"), (5, " "), (5, "")])


def test_repeated_words_do_not_part_near_copies(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(10):
        w = words(rng, 800)
        rows += [(i, " ".join(w + ["again"] * 5), "x"), (100 + i, " ".join(w + ["again"] * 100), "x")]
    got = ids_and_texts(simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA)))
    assert {i for i, _ in got} == set(range(10))


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute_near(rows):
    """What drop_near_copies keeps, by all pairs: (doc_id, text) of the smallest id of each group, nulls last."""
    texts = sorted({(i is None, i or 0, t) for i, t, _ in rows})
    sets, label = [shingles(t) for *_, t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return Counter((None if texts[k][0] else texts[k][1], texts[k][2]) for k in set(label))


def about_the_limit(rng, first, n=60):
    """Pairs alike by 0.70 to 0.90: a text, and it with its last words replaced."""
    rows = []
    for i in range(n):
        w = words(rng, 250)
        swap = int(rng.integers(13, 44))
        rows += [(first + 2 * i, " ".join(w), "x"), (first + 2 * i + 1, " ".join(w[:-swap] + words(rng, swap, "v")), "x")]
    return rows


def test_near_copies_on_both_sides_of_the_limit(spark):
    rows = about_the_limit(np.random.default_rng(13), 0)
    assert ids_and_texts(simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA))) == brute_near(rows)


def test_card_numbers_beside_other_numbers(spark):
    card, new = "4111 1111 1111 1111", r"(?!4111)\d{4} \d{4} \d{4} \d{4}"
    cases = [
        (f"{card} 123", rf"{new} 123"), ("4111-1111-1111-1111 12/27", r"(?!4111)\d{4}-\d{4}-\d{4}-\d{4} 12/27"), ("id 12 4111111111111111", r"id 12 (?!4111)\d{16}"),
        (f"1234 {card} 12/27", rf"1234 {new} 12/27"), (f"{card} {card} 123", rf"({new}) \1 123"), (f"{card} 123-45-6789", rf"{new} (?!123-45)\d{{3}}-\d\d-\d{{4}}"),
        (f"{card} 02/28/2023", rf"{new} (?!02/28/2023)\d\d/\d\d/\d{{4}}"), ("4111 1111 1111 1112 123", "4111 1111 1111 1112 123"), ("12345678901234567890", "12345678901234567890"), ("1234567890abcdef1234", r"(?!1234567890)[0-9a-f]{20}"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], SCHEMA)
    out = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "k").collect()}
    for i, (text, want) in enumerate(cases):
        assert re.fullmatch(want, out[i]), (text, out[i])


def test_near_copies_of_null_ids(spark):
    rng = np.random.default_rng(14)
    a, b, c = (words(rng, 200) for _ in range(3))
    rows = [(7, " ".join(a), "x"), (None, " ".join(a[:-4]), "x"), (None, " ".join(b), "x"), (None, " ".join(b[:-3]), "x"), (None, " ".join(c), "x"), (None, " ".join(c), "x"), (None, "", "x"), (None, "", "x")]
    got = Counter(r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).filter("text != ''").collect())
    assert got == {7: 1, None: 2}
