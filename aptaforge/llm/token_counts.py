"""Operator 8: token counts by a compiled finite-state transducer."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import materialize, shuffle_partitions, text_batches, worker_cache

SPACE_MARK = "▁"
#: Marks and the word after them.
HEAD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]*")
#: Texts of more characters are mapped in pieces of so many by several tasks.
LONG = 1 << 20
State = tuple[str, tuple[tuple[int, str, int], ...], bool]


@dataclass
class StateMap:
    """From any entry state: the run of ``head``, then ``rest``, a state and a count (None: the state after ``head``). ``table`` keeps values found."""

    head: str
    rest: tuple[State, int] | None
    table: dict[State, tuple[State, int]] = field(default_factory=dict)


class CountingTransducer:
    """A deterministic transducer, compiled from a sentence-piece BPE vocabulary, that emits token counts.

    No piece has a space mark after another character, so tokens never cross from a word into
    the marks before the next, and a text is a chain of *segments* (marks, then a word).

    Within a segment, the tokens of a prefix but for the last are the tokens of a shorter prefix, and a
    chain of tokens is right if each two neighbours stay apart when merged alone. The last token of a
    prefix is therefore the one token that ends there and may follow the last token of the prefix
    before it. A state is what later characters can ask for: for each suffix that begins some piece, the last
    token and the count of tokens at its start (relative to now). A transition by a character
    emits by how much the count changes; the emitted counts of a path add up to the tokens of what was
    read. States and transitions are compiled when first met, their number depends on the
    vocabulary and not on the texts; words kept are bounded by twice ``most``, transitions by four times.

    A mark after a word leads where it leads from the first state, as tokens never cross it. The **state map** of a chunk
    takes each state to the state after the chunk and the count emitted on the way. All entry states meet at the chunk's first
    mark after a word: up to there (``head``) a map's value is found by running the transitions from the state asked for, and kept in its table;
    from there on (``rest``) it is the same state and count for all. Maps compose associatively, so chunks are mapped apart, by any worker,
    and a tree of compositions joins them; states in maps are written out (not numbered), so they outlive resets and workers.
    """

    START, BYTES = "", "\0"
    #: Of a state: the suffix that later characters can extend, its points (back, last token, count), and whether a word has begun.
    FIRST: State = ("", ((0, "", 0),), False)

    def __init__(self, pieces: dict[str, float], dummy_prefix: bool = True, most: int = 200_000):
        self.pieces, self.dummy_prefix, self.most = pieces, dummy_prefix, most
        self.begins = {p[:k] for p in pieces for k in range(1, len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.delta: dict[int, int] = {}  # state and character to next state and count, each pair in one number
        self.states = [self.FIRST]
        self.number = {self.FIRST: 0}

    @classmethod
    def from_model(cls, path: str, most: int = 200_000) -> CountingTransducer:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback or model.trainer_spec.model_type != 2:
            raise ValueError("only byte-fallback BPE models with identity normalisation are compiled")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not compiled")
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("pieces that cross words are not compiled")
        return cls(pieces, spec.add_dummy_prefix, most)

    def merge(self, text: str) -> list[str]:
        """Parts of ``text`` after best-scored merges, leftmost first."""
        parts = list(text)
        score = self.pieces.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: str, token: str) -> bool:
        """Whether ``token`` may come after ``last``: merged alone, the two stay as they are."""
        if last == self.BYTES:
            last = self.START
        known = self.apart.get((last, token))
        if known is None:
            known = self.apart[last, token] = self.merge(last + token) == ([last, token] if last else [token])
        return known

    def step(self, state: int, char: str) -> int:
        """Compile the transition from ``state`` by ``char``."""
        suffix, points, in_word = self.states[state]
        if char == SPACE_MARK and in_word:
            found = self.delta[state << 21 | ord(char)] = self.delta.get(ord(char)) or self.step(0, char)
            return found
        suffix += char
        end, pieces, begins = len(suffix), self.pieces, self.begins
        if char not in pieces and char not in begins:
            emitted, token, points = len(char.encode("utf-8", "surrogatepass")), self.BYTES, ()
        else:
            for back, last, count in reversed(points):
                token = suffix[end - back - 1 :]
                if token in pieces and self.follows(last, token):
                    emitted = 1 - count
                    break
            else:  # a character that only begins pieces
                emitted, token = len(char.encode("utf-8", "surrogatepass")), self.BYTES
        kept = [(back + 1, last, count + emitted) for back, last, count in points if suffix[end - back - 1 :] in begins]
        to = self.numbered((suffix[end - kept[-1][0] :] if kept else "", ((0, token, 0), *kept), char != SPACE_MARK))
        found = self.delta[state << 21 | ord(char)] = to << 12 | emitted + 2048
        return found

    def numbered(self, state: State) -> int:
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def drive(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text`` from ``state``, and the count emitted."""
        if len(self.delta) > 4 * self.most:
            self.reset()
        if len(self.apart) > 2 * self.most:
            self.apart.clear()
        at, count, delta = self.numbered(state), 0, self.delta
        for char in text:
            found = delta.get(at << 21 | ord(char)) or self.step(at, char)
            at = found >> 12
            count += (found & 4095) - 2048
        return self.states[at], count

    def run(self, segment: str) -> int:
        """The count that the path of one segment from the first state emits; kept, as words recur."""
        count = self.young.get(segment)
        if count is None:
            count = self.old.get(segment)
            if count is None:
                count = self.drive(self.FIRST, segment)[1]
            if len(segment) <= 64:
                if len(self.young) > self.most:
                    self.young, self.old = {}, self.young
                self.young[segment] = count
        return count

    def chunk_map(self, chunk: str) -> StateMap:
        """The state map of a chunk of marked text."""
        end = HEAD.match(chunk).end()
        if end == len(chunk):
            return StateMap(chunk, None)
        *middle, tail = split_segments(chunk[end:])
        found = list(map(self.young.get, middle))
        count = sum([self.run(middle[i]) if n is None else n for i, n in enumerate(found)])
        state, last = self.drive(self.FIRST, tail)
        return StateMap(chunk[:end], (state, count + last))

    def at(self, chunk: StateMap, state: State) -> tuple[State, int]:
        """The map's value for one entry state."""
        found = chunk.table.get(state)
        if found is None and state == self.FIRST and chunk.rest:
            found = chunk.rest[0], self.run(chunk.head) + chunk.rest[1]
        if found is None:
            after, count = self.drive(state, chunk.head)
            found = chunk.table[state] = (after, count) if chunk.rest is None else (chunk.rest[0], count + chunk.rest[1])
        return found

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``."""
        if a.rest is None:
            out = StateMap(a.head + b.head, b.rest)
            for entry, (state, count) in a.table.items():
                after, more = self.at(b, state)
                out.table[entry] = after, count + more
            return out
        after, more = self.at(b, a.rest[0])
        return StateMap(a.head, (after, a.rest[1] + more))

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Composition of all maps, pairwise in a tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def marked(self, text: str, first: bool = True) -> str:
        return (SPACE_MARK if self.dummy_prefix and first else "") + text.replace(" ", SPACE_MARK)

    def count(self, text: str, chunk: int = 1 << 16) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        marked = self.marked(text)
        return self.at(self.scan([self.chunk_map(marked[i : i + chunk]) for i in range(0, len(marked), chunk)]), self.FIRST)[1]

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        return [self.count(t or "") for t in texts]


def split_segments(marked: str) -> list[str]:
    """Segments of marked text: each is a run of marks and the word after it; the first may lack marks, the last its word."""
    words = marked.split(SPACE_MARK)
    out, marks = [words[0]], 0
    for w in words[1:]:
        marks += 1
        if w:
            out.append(SPACE_MARK * marks + w)
            marks = 0
    if marks:
        out.append(SPACE_MARK * marks)
    if not out[0] and len(out) > 1:
        del out[0]
    return out


def transducer(model: str) -> CountingTransducer:
    """The worker's transducer, kept from task to task."""
    machine = worker_cache().setdefault(("transducer", model), None) or CountingTransducer.from_model(model)
    worker_cache()["transducer", model] = machine
    return machine


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, long: int = LONG) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens of the whole text, over_limit.

    ``model`` is the path of a sentence-piece model on every executor. A text of up to ``long`` characters is counted where it lies. A
    longer one is cut into pieces that are dealt over all tasks; each yields its state map, and a document's
    maps, a few numbers for each piece, are composed in order. Null text counts as
    empty; null ids are ids like any other; repeated rows are counted each; extra columns are ignored; an empty table gives no rows.
    """

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(model)
        for batch in texts:
            yield pd.Series(machine.counts(batch), dtype="int64")

    @F.pandas_udf("binary")
    def maps(pieces: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        machine = transducer(model)
        for at, texts in pieces:
            found = [machine.chunk_map(machine.marked(t, k == 0)) for k, t in zip(at, texts, strict=True)]
            yield pd.Series([pickle.dumps((m.head, m.rest)) for m in found])

    @F.pandas_udf("long")
    def composed(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(model)
        for batch in lists:
            chains = ([StateMap(*pickle.loads(m)) for m in maps_] for maps_ in batch)
            yield pd.Series([machine.at(machine.scan(chain), machine.FIRST)[1] for chain in chains], dtype="int64")

    spark = docs.sparkSession
    text_batches(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), "text")
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    counted = ["doc_id", "n_bytes", "n_tokens"]
    out = sized.filter(~is_long).withColumn("n_tokens", tokens("text")).select(*counted)
    if sized.filter(is_long).limit(1).count():
        rows = materialize(sized.filter(is_long).withColumn("row", F.monotonically_increasing_id()), "tokens-long")
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / long).cast("int")), lambda k: F.substring(F.col("text"), k * long + 1, F.lit(long)))
        pieces = rows.select("row", F.posexplode(cuts).alias("pos", "piece")).repartition(shuffle_partitions(spark), "row", "pos")
        mapped = pieces.select("row", "pos", maps("pos", "piece").alias("map")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "map"))).alias("m"))
        totals = mapped.select("row", composed(F.col("m.map")).alias("n_tokens"))
        out = out.unionByName(rows.join(totals, "row").select(*counted))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
