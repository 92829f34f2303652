"""Words of operator 6: ids equal the library's, and a text's known words are looked up without a loop in Python."""

import random
from array import array

import public_tokenizers

from aptaforge.llm.packing import WordTokenizer


def test_words_equal_the_library_and_are_made_once():
    tok = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), most=50)
    rng = random.Random(1)
    words = ["don't", "DON'", "x<|endoftext|>", "a'", "it's,", "café,", "word>", "w<", "1.", "ab1", "İstanbul", "''s", "_x_", "x_", "a,,", "End."]
    words += ["".join(rng.choices("aB1'.,<>|_-éß", k=rng.randint(1, 7))) for _ in range(2000)]
    for some in range(0, len(words), 40):
        text = " ".join(words[some : some + 40])
        assert tok.encode(text) == array("I", tok.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    made = []
    make = tok.young.make
    tok.young.make = lambda w: made.append(w) or make(w)
    tok.encode("fresh fresh fresh.")
    tok.encode("fresh. fresh")
    assert made == ["fresh", "fresh."]
