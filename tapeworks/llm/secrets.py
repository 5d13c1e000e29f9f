"""Secret scans: fixed patterns, and a CRF that tags tokens.

Three patterns give the base spans. Beside them a linear-chain CRF tags tokens
as begin, inside or outside of a secret from their shape (digits, case changes,
length, character variety, prefixes), the words on both sides and features of the
whole text; Viterbi decoding gives its spans. It runs on windows: tokens with a
hint (a digit, ``LONG`` characters, a capital after a small letter, a key word, a
sign at the end) and the ``CONTEXT`` tokens on either side of them. Every token of a
window may be tagged, a plain word as well; the rest of a text is outside. The
method adds spans and takes none away: tokens that touch a base span are left to
it, and what else a tagged run holds stays a span, before or after it.

The CRF is fitted on ``SAMPLE_DOCS`` documents at most, those with the smallest
hash of id and text among the ones that hold a digit and up to ``SAMPLE_CHARS``
characters. The secrets of base spans in them are positive (of an assignment, its
value), other tokens are not (windows with an unmatched long mix of digits and
letters are left out), and invented secrets of further shapes, some of letters
alone, some side by side, are planted into copies of their lines, so that it learns
shapes that the patterns miss. Scanning is one pass without a shuffle.

Defined results
* null text: as empty, no spans; null ids pass; repeated rows are scanned each, and
  count once for fitting; texts of any length are scanned whole;
* no document to learn from: base spans only; empty table: no rows;
* equal scores in decoding go to outside, then begin;
* positions are code points, the end exclusive; spans are ordered by start, then
  kind in the order assign, access, hex, model;
* input columns with the names of the results give way to them, others pass.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, crf

#: Bound on the documents that the CRF is fitted on.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 200_000
LONG = 24
CONTEXT = 2
KINDS = ("assign", "access", "hex", "model")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: The base patterns (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Key words and prefixes that often stand before or at the start of secrets (fixed values).
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "pwd", "private")
PREFIXES = ("AKIA", "ghp_", "gho_", "sk_", "sk-", "pk_", "xox", "eyJ", "AIza", "glpat-")

_HINTS = [re.compile(r"[0-9]+"), re.compile(r"\S{%d,}" % LONG), re.compile(r"[a-z][A-Z]"), re.compile(r"[=:](?!\S)")]
_WORDS = re.compile("|".join(KEY_WORDS))
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`()[]{}<>,;!?&%$#*|"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in ("pass", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _hinted(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a hint, in order."""
    low = text.lower()
    found = [m.start() for hint in _HINTS for m in hint.finditer(text)]
    # Lower case of a few letters is longer; then places may be off, and all go.
    if any(k in low for k in KEY_WORDS):
        found += [m.start() for m in _WORDS.finditer(low)] if len(low) == len(text) else [m.start() for m in _TOKEN.finditer(text)]
    out, at = [], 0
    for start in sorted(found):
        if start >= at:
            while start > 0 and not text[start - 1].isspace():
                start -= 1
            at = _TOKEN.match(text, start).end()
            out.append((start, at))
    return out


def _before(text: str, at: int) -> list[tuple[int, int]]:
    """The last CONTEXT tokens that end before ``at``."""
    out: list[tuple[int, int]] = []
    while at > 0 and len(out) < CONTEXT:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        if end > at:
            out.append((at, end))
    return out[::-1]


def candidate_windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token spans: hinted tokens with CONTEXT tokens on either side."""
    out: list[list[tuple[int, int]]] = []
    for start, end in _hinted(text):
        around = [*_before(text, start), (start, end)]
        at = end
        for _ in range(CONTEXT):
            if m := _TOKEN.search(text, at):
                around.append(m.span())
                at = m.end()
        if out and out[-1][-1][0] >= around[0][0]:
            out[-1] += [s for s in around if s[0] > out[-1][-1][0]]
        else:
            out.append(around)
    return out


def _shape(token: str) -> list[float]:
    core = token.strip(_EDGE)
    n = max(1, len(core))
    digits = sum(c.isdigit() for c in core)
    lower = sum("a" <= c <= "z" for c in core)
    upper = sum("A" <= c <= "Z" for c in core)
    hexes = sum(c in "0123456789abcdef" for c in core)
    turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(core, core[1:]))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(core).values())
    mixed = (digits > 0) + (lower > 0) + (upper > 0)
    return [
        1.0, min(n, 64) / 16, n >= 16, n >= 24, n >= 32, digits / n, digits == len(core) and digits > 0, lower / n, upper / n,
        hexes == n, turns / n, turns >= 3, entropy / 4, entropy > 3.2, mixed / 3, mixed == 3, core.startswith(PREFIXES),
        "@" in core or "://" in core, "." in core, core.count("-") / n, "=" in core or ":" in core, (n - digits - lower - upper) / n,
    ]


N_SHAPE = 22


def window_features(tokens: list[str], dense: float, lines: float) -> np.ndarray:
    """[token, feature]; ``dense`` and ``lines`` describe the whole text."""
    shapes = np.array([_shape(t) for t in tokens], np.float64)
    low = [t.lower() for t in tokens]
    keyed = np.array([any(k in w for k in KEY_WORDS) for w in low], np.float64)
    signs = np.array([w.strip("\"'").endswith(("=", ":")) for w in low], np.float64)
    lag = lambda x, k: np.concatenate([np.zeros(min(k, len(x))), x[: max(0, len(x) - k)]])
    lead = lambda x, k: lag(x[::-1], k)[::-1]
    odd = np.array([unusual(t) for t in tokens], np.float64)
    return np.column_stack([
        shapes, odd, keyed, lag(keyed, 1), lag(keyed, 2), lead(keyed, 1), lead(keyed, 2), lag(signs, 1), lag(signs, 2), lag(odd, 1), lead(odd, 1),
        (lag(keyed, 1) + lag(keyed, 2)) * np.minimum(shapes[:, 1], 1), np.full(len(tokens), dense), np.full(len(tokens), lines),
    ])


def unusual(token: str) -> bool:
    return len(token) >= LONG or any(c in "0123456789" for c in token)


def doubtful(token: str) -> bool:
    """Long, of digits and letters both, and no address."""
    core = token.strip(_EDGE)
    return len(core) >= 16 and any(map(str.isdigit, core)) and any(map(str.isalpha, core)) and "@" not in core and "://" not in core


def text_features(text: str) -> tuple[float, float]:
    n = max(1, len(text))
    return min(1.0, 20 * sum(map(text.count, "=:;{}")) / n), min(1.0, 40 * text.count("\n") / n)


def invented(rng: np.random.Generator) -> str:
    """A secret of one of several shapes."""
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    draw = lambda n, a=letters: "".join(rng.choice(a, n))
    kind = rng.integers(8)
    if kind == 0:
        return draw(40, np.array(list("0123456789abcdef")))
    if kind == 1:
        return "AKIA" + draw(16, letters[[*range(26), *range(52, 62)]])
    if kind == 2:
        return str(rng.choice(PREFIXES[1:7])) + draw(int(rng.integers(20, 40)))
    if kind == 3:
        return draw(int(rng.integers(28, 44)), np.append(letters, ["+", "/"])) + "=" * int(rng.integers(0, 3))
    if kind == 4:
        return "eyJ" + draw(20) + "." + draw(30) + "." + draw(27)
    if kind == 5:
        return draw(int(rng.integers(12, 24)), letters[:52])
    if kind == 6:
        return draw(int(rng.integers(10, 18)), letters[26:52])
    return "-".join(draw(k, np.array(list("0123456789abcdef"))) for k in (8, 4, 4, 4, 12))


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Secrets of the base spans: of an assignment its value, else the span."""
    values = {m.start(): m.span(2) for m in ASSIGN.finditer(text)}
    return [values[s] if k == 0 else (s, e) for s, k, e in base_spans(text)]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> crf.Chain | None:
    # About four times as many rows as wanted, by a hash; then the smallest hashes.
    share = 4 * sample_docs / max(1, docs.count())
    at = F.xxhash64("doc_id", "text")
    some = docs.where((F.pmod(at, F.lit(1_000_003)) / 1_000_003 < share) & F.col("text").rlike("[0-9]") & (F.length("text") <= SAMPLE_CHARS))
    rows = some.groupBy(at.alias("at")).agg(F.first("text").alias("text")).orderBy("at").limit(sample_docs).toArrow().column(1).to_pylist()
    rng = np.random.default_rng(11)
    xs, ys = [], []

    def learn(text: str, truth: list[tuple[int, int]]) -> None:
        about = text_features(text)
        for window in candidate_windows(text):
            tokens, y, last = [text[a:b] for a, b in window], [], None
            if any(doubtful(text[a:b]) and not any(s < b and a < e for s, e in truth) for a, b in window):
                continue  # may be a secret that no pattern knows
            for a, b in window:
                hit = next((t for t in truth if t[0] < b and a < t[1]), None)
                y.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
                last = hit
            xs.append(window_features(tokens, *about))
            ys.append(np.array(y))

    for text in rows:
        learn(text, secret_parts(text))
        lines = text.split("\n")
        line = lines[int(rng.integers(len(lines)))].split(" ")
        at, several = int(rng.integers(len(line) + 1)), [invented(rng) for _ in range(1 + int(rng.random() < 0.25))]
        # Small letters alone are a secret by what stands before them only.
        plain = all(map(str.islower, several[0]))
        lead = str(rng.choice(["pwd: ", "key: ", "auth ", "Bearer ", "credential = "] if plain else ["", "key: ", "secret = ", "auth ", "Bearer "]))
        planted, truth = " ".join(line[:at]) + " " * (at > 0) + lead, []
        for secret in several:
            truth.append((len(planted), len(planted) + len(secret)))
            planted += secret + " "
        planted += " ".join(line[at:])
        learn(planted, [t for t in secret_parts(planted) if not any(a < t[1] and t[0] < b for a, b in truth)] + truth)
    return crf.fit(xs, ys, 3, epochs=8) if any(y.any() for y in ys) else None


def model_spans(chain: crf.Chain, batch: list[str], taken: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the CRF adds to the base spans of each text."""
    windows, scores, whose = [], [], []
    for i, text in enumerate(batch):
        about = None
        for window in candidate_windows(text):
            about = about or text_features(text)
            windows.append(window)
            whose.append(i)
            scores.append(window_features([text[a:b] for a, b in window], *about) @ chain.weights)
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    for i, window, tags in zip(whose, windows, crf.viterbi(chain, scores)):
        text, run = batch[i], []
        for (a, b), tag in [*zip(window, tags.tolist()), ((0, 0), OUTSIDE)]:
            base = tag != OUTSIDE and any(s < b and a < e for s, _, e in taken[i])
            if run and (tag != INSIDE or base):
                out[i].append(_trimmed(text, run[0], run[-1]))
                run = []
            if tag != OUTSIDE and not base:
                run = [run[0] if run else a, b]
    return [[span for span in spans if span[2] > span[0]] for spans in out]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int, int]:
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and (text[end - 1] in _EDGE or text[end - 1] == "."):
        end -= 1
    return start, 3, end


#: The columns of a scan, in order.
FOUND = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scanned(rows: DataFrame, chain: crf.Chain | None, text_col: str = "text") -> DataFrame:
    """``rows`` with the columns of ``FOUND`` appended."""
    rows, schema = common.with_columns(rows, FOUND)
    place = rows.columns.index(text_col)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = model_spans(chain, texts, base) if chain else [[] for _ in texts]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([joined(b + m) for b, m in zip(base, more)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, digests, spans], names=[*batch.schema.names, *FOUND])

    return rows.mapInArrow(scan, schema)


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanned(docs, fit(docs)).drop("text")
