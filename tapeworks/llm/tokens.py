"""Token counts by a compiled finite-state tokenizer.

A byte-fallback BPE vocabulary becomes a deterministic transducer whose
transitions carry the change in the number of emitted tokens. The state after a
prefix keeps, for those of its positions from which a piece could still end
later (the longest suffix that starts some piece), the last token of the best
segmentation up to there and its token count, relative to the newest one. Two
tokens may stand side by side just if merging their joined text gives exactly
these two; so on each character the new last token is the longest piece ending
there whose left neighbour allows it. States and transitions are built when they
are first used and shared by all words of a worker.

No piece crosses from a word into the space mark that starts the next one, or
over a character outside the vocabulary (such as a line break), so the machine is
back in its start state there. Hence the state map of a chunk (from a state at its
start to the state and the tokens at its end) has a short form, ``Chunk``: up to
the first reset it depends on the state at the start, after it all states have
met. Maps compose associatively. A text of up to ``CHUNK`` characters is one map. A
longer one is cut into rows of ``CHUNK`` characters anywhere, the maps are made in
as many tasks, and a prefix scan composes them in rounds, ``FAN`` neighbours at a
time, so no task holds a whole text beyond the row that it came in.

Caches of a worker have fixed bounds (``KEPT_STEPS`` transitions with their
states, ``KEPT_WORDS`` word counts) that are kept inside a text, too.

Defined results
* null text: 0 bytes, 0 tokens; empty text likewise; repeated rows are counted
  each; null ids pass; special strings in texts are ordinary text, as the
  library has it by default; texts of any length are counted whole;
* equal scores in merging: the leftmost pair, as in the library; empty table: no
  rows; an input column with the name of the result gives way to it, other extra
  columns pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Characters in a chunk of a long text, and in a word whose count is kept.
CHUNK = 1 << 16
WORD = 48
#: Maps composed by a task at once.
FAN = 64
#: Transitions and word counts kept by a worker: about 400 MB together at most.
KEPT_STEPS = 1_500_000
KEPT_WORDS = 500_000
_SEGMENT = regex.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


#: A place of a state: the last token there or None, and its relative count.
Place = tuple[str | None, int] | None
State = tuple[str, tuple[Place, ...]]


@dataclass(frozen=True)
class Chunk:
    """The state map of a piece of marked text. Up to its first reset (``head``)
    it depends on the state at the start; then ``count`` tokens follow, and
    ``state`` at the end. Without a reset ``state`` is None and all is head."""
    head: str
    count: int = 0
    state: State | None = None


class Transducer:
    """Counts the tokens that a sentencepiece BPE model gives."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalization with a leading space is compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.score) or "\n" in self.score:
            raise ValueError("pieces that cross words aren't compiled")
        self.starts = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self.fits_seen: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        #: A state is (suffix, (place before each of its characters, newest place));
        #: a place is None where no piece can start.
        self.state_ids: dict[State, int] = {}
        self.states: list[State] = []
        #: By state and character: the next state, and the change in tokens.
        self.steps: dict[int, int] = {}
        self.start = self._state(("", ((None, 0),)))
        self.after_space: dict[str, int] = {}
        self.at_start: dict[str, int] = {}

    def _state(self, key: State) -> int:
        found = self.state_ids.get(key)
        if found is None:
            found = self.state_ids[key] = len(self.states)
            self.states.append(key)
        return found

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str | None, right: str) -> bool:
        found = self.fits_seen.get((left, right))
        if found is None:
            if len(self.fits_seen) > KEPT_STEPS:
                self.fits_seen.clear()
            want = [right] if left is None else [left, right]
            found = self.fits_seen[left, right] = self.merged("".join(want)) == want
        return found

    def _build(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state on a character of the vocabulary or not."""
        if char not in self.score:
            return self.start, len(char.encode("utf-8", "surrogatepass"))
        suffix, kept = self.states[state]
        suffix += char
        n, last, count = len(suffix), None, 0
        for size in range(n, 0, -1):
            if (place := kept[n - size]) is not None and (piece := suffix[n - size :]) in self.score and self.fits(place[0], piece):
                last, count = piece, place[1] + 1
                break
        # From a place whose following text starts no piece, none can end later.
        places = [kept[i] and (kept[i][0], kept[i][1] - count) if suffix[i:] in self.starts else None for i in range(n)]
        first = next((i for i, p in enumerate(places) if p is not None), n)
        return self._state((suffix[first:], (*places[first:], (last, 0)))), count

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State after ``text`` and the change in the number of tokens."""
        total, get = 0, self.steps.get
        for char in text:
            step = get(state << 21 | ord(char))
            if step is None:
                if len(self.steps) >= KEPT_STEPS:
                    key = self.states[state]
                    self.clear()
                    state, get = self._state(key), self.steps.get
                then, change = self._build(state, char)
                step = self.steps[state << 21 | ord(char)] = then << 8 | change + 128
            state = step >> 8
            total += (step & 255) - 128
        return state, total

    def word(self, text: str) -> int:
        return self.run(self.start, text)[1]

    def _keep(self, kept: dict[str, int], word: str, n: int) -> None:
        if len(word) <= WORD:
            if len(kept) >= KEPT_WORDS:
                kept.clear()
            kept[word] = n

    def line(self, line: str) -> int:
        """Tokens of a line in which spaces are already marked."""
        if SPACE * 2 in line:
            return sum(map(self.word, _SEGMENT.findall(line)))
        first, *rest = line.split(SPACE)
        kept, total = self.after_space, 0
        try:
            total = sum(map(kept.__getitem__, rest))
        except KeyError:
            total = 0
            for w in rest:
                n = kept.get(w)
                if n is None:
                    n = self.word(SPACE + w)
                    self._keep(kept, w, n)
                total += n
        if first:
            n = self.at_start.get(first)
            if n is None:
                n = self.word(first)
                self._keep(self.at_start, first, n)
            total += n
        return total

    def closed(self, body: str) -> int:
        """Tokens of text that starts and ends at resets."""
        lines = body.split("\n")
        return len(lines) - 1 + sum(map(self.line, lines))

    def chunk(self, text: str) -> Chunk:
        """The state map of a piece of marked text."""
        first = _RESET.search(text)
        if not first:
            return Chunk(text)
        end = max(text.rfind("\n"), text.rfind(SPACE))
        while text[end] == SPACE and end > first.start() and text[end - 1] == SPACE:
            end -= 1
        if text[end] == "\n":  # a token of its own, then the start
            end += 1
        body = self.closed(text[first.start() : end])
        state, n = self.run(self.start, text[end:])
        return Chunk(text[: first.start()], body + n, self.states[state])

    def after(self, state: State, chunk: Chunk) -> tuple[State, int]:
        """The map applied: the state at the end, and the tokens."""
        found, n = self.run(self._state(state), chunk.head)
        return (self.states[found], n) if chunk.state is None else (chunk.state, n + chunk.count)

    def compose(self, a: Chunk, b: Chunk) -> Chunk:
        """The map of a piece followed by another."""
        if a.state is None:
            return Chunk(a.head + b.head, b.count, b.state)
        state, n = self.after(a.state, b)
        return Chunk(a.head, a.count + n, state)

    def scan(self, maps: list[Chunk]) -> Chunk:
        """All maps in order composed, pairs of neighbours in each round."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def total(self, whole: Chunk) -> int:
        """Tokens of a whole text, from its start."""
        return self.after(("", ((None, 0),)), whole)[1]

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = marked(text)
        if len(text) <= chunk:
            return self.closed(text)
        return self.total(self.scan([self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)]))


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


#: Where a chunk's machine is surely in its start state: at a line break, and at
#: the first space mark after another character.
_RESET = regex.compile(f"\n|(?<=[^{SPACE}]){SPACE}")


@cache
def transducer(model_file: str) -> Transducer:
    return Transducer(model_file)


def counted(rows: DataFrame, model_file: str, text_col: str = "text", out_col: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the token count of each whole text appended."""
    rows, schema = common.with_columns(rows, {out_col: "long"})
    place = rows.columns.index(text_col)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            n = pa.array([machine.count(t) for t in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, out_col])

    long = F.coalesce(F.length(text_col) > chunk, F.lit(False))
    short = rows.where(~long).mapInArrow(count, schema)
    # Long texts are numbered once, so that their chunks find them again.
    others = [F.col(f"`{c}`") for c in rows.columns]
    kept = common.stored(rows.where(long).select(F.monotonically_increasing_id().alias("row"), F.struct(*others).alias("kept")))
    texts = kept.select("row", F.col(f"kept.`{text_col}`").alias("text"))
    most = texts.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return short
    found = _scanned(texts, most, model_file, chunk)
    counts = kept.join(found, "row").select(*(F.col(f"kept.`{c}`").alias(c) for c in rows.columns), F.col("n").alias(out_col))
    return short.unionByName(counts)


_MAP = "row long, at long, head string, count long, suffix string, places string"


def _arrow(rows: list[int], places: list[int], maps: list[Chunk]) -> pa.RecordBatch:
    ends = [(None, None) if m.state is None else (m.state[0], json.dumps(m.state[1])) for m in maps]
    columns = [rows, places, [m.head for m in maps], [m.count for m in maps], [e[0] for e in ends], [e[1] for e in ends]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "at", "head", "count", "suffix", "places"])


def _chunks(batch: pa.RecordBatch | pa.Table) -> list[Chunk]:
    def state(suffix: str | None, places: str | None) -> State | None:
        return None if suffix is None else (suffix, tuple(p and (p[0], p[1]) for p in json.loads(places)))

    return [Chunk(h, n, state(s, p)) for h, n, s, p in zip(*(batch.column(c).to_pylist() for c in ("head", "count", "suffix", "places")))]


def _scanned(texts: DataFrame, most: int, model_file: str, chunk: int) -> DataFrame:
    """(row, n) of long texts: maps of their chunks by as many tasks, then rounds
    in which ``FAN`` neighbours each become one map."""
    pieces = F.ceil((F.length("text") + 1) / F.lit(chunk)).cast("int")
    cut = texts.select("row", F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE))).alias("text"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("at"))
    cut = cut.select("row", F.col("at").cast("long"), F.substring("text", F.col("at") * chunk + 1, F.lit(chunk)).alias("text")).repartition("row", "at")

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            yield _arrow(batch.column(0), batch.column(1), [machine.chunk(t) for t in batch.column(2).to_pylist()])

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        machine = transducer(model_file)
        table = table.sort_by("at")
        return pa.Table.from_batches([_arrow([key[0].as_py()], [key[1].as_py()], [machine.scan(_chunks(table))])])

    maps, left = cut.mapInArrow(make, _MAP), -(-(most + 1) // chunk)
    while left > 1:
        maps = maps.groupBy("row", F.floor(F.col("at") / FAN).alias("at2")).applyInArrow(compose, _MAP)
        left = -(-left // FAN)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([machine.total(m) for m in _chunks(batch)], pa.int64())], names=["row", "n"])

    return maps.mapInArrow(total, "row long, n long")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_counts(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return counted(rows, tokenizer_file(model)).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
