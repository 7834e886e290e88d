"""Token counts by a deterministic transducer compiled from the BPE vocabulary.

The machine reads a text character by character. A state is the kind of piece that is open, what of a contraction or a
special string has been seen, and for every place of the open piece at which a token may still begin the letters since,
the token before it and how many tokens there were. Each transition carries the number of tokens that it emits for
certain; transitions are compiled when they are first taken, states that agree are one. A long text is cut into chunks,
each is read from every state in which it may be entered, and the maps from entry state to (exit state, count) are
composed in the shape of a tree, as associative maps can be: a parallel prefix scan over rows.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.bpe import BEYOND, LETTERS, NUMBERS, SPACES, Memory, Vocabulary, spelled, vocabulary
from loamgrid.llm.common import text_of, without, written

OUTPUT = ["n_bytes", "n_tokens", "over_limit"]
LETTER, NUMBER, SPACE = re.compile(f"[{LETTERS}]"), re.compile(f"[{NUMBERS}]"), re.compile(f"[{SPACES}]")
WHITE = [chr(c) for c in range(0x250) if SPACE.match(chr(c))]
SPLIT = re.compile(f"[{SPACES}]+")
#: What str.split takes for white space and the pieces don't.
ODD = re.compile("[\\x1c-\\x1f]")
#: The contractions that are pieces of their own, by their beginnings.
CONTRACTIONS = {"'": ("'s", "'t", "'m", "'d"), "'r": ("'re",), "'v": ("'ve",), "'l": ("'ll",)}
#: One begin of a token may lie before the open piece: nothing read, no token before, none counted.
OPEN = (("", "", 0),)
#: Characters before a chunk that are read to learn in which states it may be entered.
CONTEXT = 160


class State(dict):
    """Character to (next state, tokens emitted), compiled on demand."""

    __slots__ = ("machine", "key")

    def __init__(self, machine: Transducer, key: tuple):
        super().__init__()
        self.machine, self.key = machine, key

    def __missing__(self, c: str) -> tuple[State, int]:
        key, n = self.machine.step(self.key, c)
        found = self[c] = (self.machine.state(key), n)
        return found


class Transducer:
    """A state's key is (piece, held, pending, live): the kind of the open piece ("" none, L letters, S signs), the part of a
    contraction held back, the part of a special string held back, and the begins of tokens that are still possible.

    The last token of what was read of a piece is the one among those ending there that may follow the token before
    it; exactly one may, as the encoding is unique. Two tokens may follow each other if undoing their merges from the
    latest on never shows a pair across the border that would have been merged first.
    """

    def __init__(self, v: Vocabulary, most_states: int = 120_000):
        self.v, self.most = v, most_states
        self.rank = {pair: k for k, pair in enumerate(v.merges)}
        self.split = {a + b: (k, a, b) for k, (a, b) in enumerate(v.merges)}
        self.ok: dict[tuple[str, str], bool] = {}
        self.token_ok: dict[str, bool] = {}
        bodies = [(t.removesuffix(v.suffix), t.endswith(v.suffix)) for t in v.ids]
        self.longest = max(len(b) for b, _ in bodies)
        #: What a token can go on from.
        self.begun = {b[:k] for b, _ in bodies for k in range(1, len(b))} | {b for b, ended in bodies if ended and b}
        self.specials = {s[:k] for s in v.special for k in range(1, len(s) + 1)}
        self.states: dict[tuple, State] = {}
        self.start = self.state(("", "", "", ()))
        self.pieces = Memory(self._piece, most=50_000)
        #: The maps of words between white space, where nothing is open: tokens emitted from the first state back to it.
        self.words = Memory(self._word, most=250_000)

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key)
        return found

    def tidy(self) -> None:
        """Forgets what was compiled if it has grown too large; to be called between texts."""
        if len(self.states) > self.most:
            self.states.clear()
            self.start = self.state(("", "", "", ()))

    def _border(self, a: str, b: str, limit: float, left_of_limit: bool = False) -> bool:
        """Whether no pair across the border of a and b merges before rank limit, at which a or b itself is used up (left_of_limit: it is b)."""
        while True:
            r = self.rank.get((a, b))
            if r is not None and (r < limit or (r == limit and left_of_limit)):
                return False
            ra, rb = self.split.get(a, (-1,)), self.split.get(b, (-1,))
            if ra[0] < 0 and rb[0] < 0:
                return True
            if ra[0] > rb[0]:
                limit, a, left_of_limit = ra[0], ra[2], False
            else:
                limit, b, left_of_limit = rb[0], rb[1], True

    def whole(self, token: str) -> bool:
        """Whether the letters of a token, on their own, are encoded as that token."""
        found = self.token_ok.get(token)
        if found is None:
            made = self.split.get(token)
            found = self.token_ok[token] = token in self.v.ids and (made is None or (self.whole(made[1]) and self.whole(made[2]) and self._inner(*made)))
        return found

    def _inner(self, rank: int, a: str, b: str) -> bool:
        """Whether a and b stay whole next to each other until their own merge."""
        ra, rb = self.split.get(a, (-1,)), self.split.get(b, (-1,))
        if ra[0] < 0 and rb[0] < 0:
            return True
        return self._border(ra[2], b, ra[0]) if ra[0] > rb[0] else self._border(a, rb[1], rb[0], True)

    def follows(self, a: str, b: str) -> bool:
        found = self.ok.get((a, b))
        if found is None:
            if len(self.ok) >= 1_000_000:
                self.ok.clear()
            found = self.ok[a, b] = self._border(a, b, float("inf"))
        return found

    def _letter(self, live: tuple, x: str) -> tuple[tuple, int]:
        """After one more letter of the byte alphabet: the live begins, counted from the least, and that least count, which is emitted."""
        grown = [(s + x, last, n) for s, last, n in live]
        t, n = next((s, n + 1) for s, last, n in grown if s in self.v.ids and self.whole(s) and (not last or self.follows(last, s)))
        kept = [g for g in grown if g[0] in self.begun] + [("", t, n)]
        least = min(n for *_, n in kept)
        return tuple((s, last, n - least) for s, last, n in kept), least

    def _grow(self, live: tuple, c: str) -> tuple[tuple, int]:
        total = 0
        for x in spelled(c):
            live, n = self._letter(live, x)
            total += n
        return live, total

    def _close(self, live: tuple) -> int:
        """Tokens that the end of the piece emits."""
        for s, last, n in live:
            t = s + self.v.suffix
            if s and t in self.v.ids and self.whole(t) and (not last or self.follows(last, t)):
                return n + 1
        raise ValueError(f"no token ends {live!r}")

    def _piece(self, piece: str) -> int:
        live, n = self._grow(OPEN, piece)
        return n + self._close(live)

    def _feed(self, piece: str, held: str, live: tuple, c: str) -> tuple[tuple, int]:
        """One character in lower case, special strings aside: (piece, held, live) after it, and the tokens emitted."""
        if held:
            if held + c in CONTRACTIONS[held]:
                return ("", "", ()), self.pieces[held + c]
            if held + c in CONTRACTIONS:
                return ("", held + c, ()), 0
            if held == "'":  # it begins a run of signs
                opened, n = self._grow(OPEN, held)
                after, m = self._feed("S", "", opened, c)
                return after, n + m
            opened, n = self._grow(OPEN, held[1])  # a sign alone, then a letter
            after, m = self._feed("L", "", opened, c)
            return after, self.pieces["'"] + n + m
        kind = "L" if LETTER.match(c) else "N" if NUMBER.match(c) else "" if SPACE.match(c) else "S"
        if piece:
            if kind == piece:
                grown, n = self._grow(live, c)
                return (piece, "", grown), n
            after, n = self._feed("", "", (), c)
            return after, self._close(live) + n
        if kind == "N":
            return ("", "", ()), self.pieces[c]
        if c == "'":
            return ("", c, ()), 0
        if not kind:
            return ("", "", ()), 0
        grown, n = self._grow(OPEN, c)
        return (kind, "", grown), n

    def _end(self, piece: str, held: str, live: tuple) -> int:
        if held:
            return self.pieces["'"] + (self.pieces[held[1:]] if held[1:] else 0)
        return self._close(live) if piece else 0

    def _replayed(self, key: tuple) -> tuple[tuple, int]:
        """A key without pending characters: they were no special string."""
        (piece, held, pending, live), total = key, 0
        for c in pending:
            (piece, held, live), n = self._feed(piece, held, live, c.lower())
            total += n
        return (piece, held, live), total

    def step(self, key: tuple, c: str) -> tuple[tuple, int]:
        piece, held, pending, live = key
        if pending + c in self.v.special:
            return ("", "", "", ()), self._end(piece, held, live) + 1
        if pending + c in self.specials:
            return (piece, held, pending + c, live), 0
        (piece, held, live), n = self._replayed(key)
        if c in self.specials:
            return (piece, held, c, live), n
        (piece, held, live), m = self._feed(piece, held, live, c.lower())
        return (piece, held, "", live), n + m

    def run(self, text: str, state: State) -> tuple[State, int]:
        """Character by character: the state after the text, and the tokens emitted."""
        total = 0
        for c in text:
            state, n = state[c]
            total += n
        return state, total

    def _word(self, word: str) -> int:
        state, n = self.run(word, self.start)
        return n + self.end(state)

    def whole_words(self, text: str) -> int:
        """Tokens of a text that begins and ends where nothing is open: the maps of its words, composed."""
        return sum(map(self.words.__getitem__, SPLIT.split(text) if ODD.search(text) else text.split()))

    def read(self, text: str, state: State) -> tuple[State, int]:
        """As run; between the first and the last white space by whole words."""
        first = SPACE.search(text)
        if not first:
            return self.run(text, state)
        state, n = self.run(text[: first.end()], state)
        last = max(text.rfind(c) for c in WHITE) + 1
        n += self.whole_words(text[first.end() : last]) if last > first.end() else 0
        state, m = self.run(text[last:], state)
        return state, n + m

    def end(self, state: State) -> int:
        """Tokens that the end of the text emits."""
        (piece, held, live), n = self._replayed(state.key)
        return n + self._end(piece, held, live)

    def wide(self, text: str) -> bool:
        """Whether the text has characters beyond the Latin ones, whose pieces only the library's own rules tell."""
        return not text.isascii() and BEYOND.search(text.lower()) is not None

    def count(self, text: str) -> int:
        self.tidy()
        if self.wide(text):
            return sum(1 if special is not None else sum(map(self.pieces.__getitem__, pieces)) for special, pieces in self.v.segments(text))
        return self.whole_words(text)

    def chunks(self, text: str, size: int) -> Iterator[tuple[str, str, bool, bool]]:
        """(context, part, wide, last) of a text; one with wide characters is cut at white space only, where nothing is open."""
        wide, at = self.wide(text), 0
        while at < len(text):
            to = min(len(text), at + size)
            if wide and to < len(text):
                gap = SPACE.search(text, to)
                to = gap.end() if gap else len(text)
            yield "" if wide else text[max(0, at - CONTEXT) : at], text[at:to], wide, to == len(text)
            at = to

    def entries(self, context: str) -> list[State]:
        """The states in which what follows the context may be entered: one after white space; else those from each begin of a token in the context."""
        gaps = [m.end() for m in SPACE.finditer(context)]
        begins = [gaps[-1]] if gaps else range(min(len(context), self.longest)) if context else [0]
        return list({id(s): s for s in (self.run(context[k:], self.start)[0] for k in begins)}.values())

    def chunk_map(self, context: str, part: str, wide: bool, last: bool) -> dict[str, tuple[str, int]]:
        """Entry state to (exit state, tokens emitted), states as text; after the last chunk the exit is empty and the end counted."""
        self.tidy()
        named = lambda s: json.dumps(s.key, ensure_ascii=False)
        if wide:
            return {named(self.start): ("" if last else named(self.start), self.count(part))}
        found = {}
        for s in self.entries(context):
            after, n = self.read(part, s)
            found[named(s)] = ("", n + self.end(after)) if last else (named(after), n)
        return found


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(vocabulary(path))


MAP = "map<string,struct<state:string,n:bigint>>"


def composed(a: Column, b: Column) -> Column:
    """First a, then b; what leaves a in a state that b doesn't know is left out."""
    then = F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, v["state"]), F.struct(F.try_element_at(b, v["state"])["state"].alias("state"), (v["n"] + F.try_element_at(b, v["state"])["n"]).alias("n"))))
    return F.map_filter(then, lambda k, v: v.isNotNull())


def scanned(maps: DataFrame, fan: int = 16) -> DataFrame:
    """(row, map): the composition of the maps of a row in order of `at`, by groups of `fan` neighbours round after round. maps: (row, at, map)."""
    last = maps.agg(F.max("at")).first()[0]
    rounds = math.ceil(math.log(last + 1, fan) - 1e-9) if last else 0
    for _ in range(max(1, rounds)):
        near = maps.groupBy("row", F.floor(F.col("at") / fan).cast("int").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", F.map_entries("map").alias("e")))).alias("own"))
        parts = F.transform("own", lambda x: F.map_from_entries(x["e"]))
        maps = near.withColumn("parts", parts).select("row", "at", F.aggregate(F.slice("parts", 2, fan), F.get("parts", 0), composed).alias("map"))
    return maps.select("row", "map")


def token_counts(docs: DataFrame, path: str, *, text: str = "text", carry: list[str] | None = None, limit: int = 2048, chunk: int = 16_384) -> DataFrame:
    """The rows of docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path: the vocabulary file, there on every machine. carry: the input columns to keep (all by default). Texts of more
    than chunk characters are cut into chunks that are read as rows of their own, wherever that cuts; a text in which
    a chunk is left in a state that the next one wasn't read from (the states are learnt from the CONTEXT characters
    before it) is read again as a whole. A null text counts as empty (0 tokens); special strings in a text count as one
    token each; rows with equal ids are counted one by one; input columns named as the results give way.
    """
    docs = without(docs, *OUTPUT)
    carry = [c for c in (carry or docs.columns)]
    kept = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]

    @F.pandas_udf("long")
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path)
        for batch in texts:
            yield batch.map(t.count)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for batch in batches:
            for row, body in zip(batch["row"], batch["body"], strict=True):
                for k, part in enumerate(t.chunks(body, chunk)):
                    yield pd.DataFrame([(row, k, *part)], columns=["row", "at", "context", "part", "wide", "last"])

    @F.pandas_udf(MAP)
    def mapped(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        t = transducer(path)
        for batch in parts:
            yield pd.Series([{k: {"state": s, "n": n} for k, (s, n) in t.chunk_map(*x).items()} for x in zip(*batch, strict=True)], dtype=object)

    n_bytes = F.octet_length(text_of(text)).cast("long").alias("n_bytes")
    long = F.length(text_of(text)) > chunk
    short = docs.filter(~long).select(*carry, n_bytes, whole(text_of(text)).alias("n_tokens"))
    rows = written(docs.filter(long).select(*kept, F.col(text).alias("body"), n_bytes).withColumn("row", F.monotonically_increasing_id()), "long")
    parts = rows.select("row", "body").mapInPandas(cut, "row long, at int, context string, part string, wide boolean, last boolean")
    maps = written(parts.repartition("row", "at").select("row", "at", mapped("context", "part", "wide", "last").alias("map")), "maps")
    start = json.dumps(("", "", "", ()))
    counted = written(scanned(maps).select("row", F.try_element_at("map", F.lit(start))["n"].alias("n")), "counted")
    known = rows.drop("body").join(counted.filter("n is not null"), "row").select(*names, "n_bytes", F.col("n").alias("n_tokens"))
    again = rows.join(counted.filter("n is null"), "row", "left_semi").select(*names, "n_bytes", whole("body").alias("n_tokens"))
    return short.unionByName(known).unionByName(again).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
