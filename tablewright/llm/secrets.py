"""Secrets: fixed patterns, and two character Markov models compared by likelihood.

One model is trained on strings that the patterns mark as secrets, the other on
the ordinary identifiers of the same texts; both count transitions between
characters over all texts.  A run of token characters is a secret if the
log-likelihood ratio of the two models is high enough, in total and for each
character.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tablewright.llm.words import chunks

KINDS = ("assign", "access", "hex", "markov")
MIN_CHARS = 16  # of a run that the models judge
MIN_RATIO = 20.0  # nats in total
MIN_RATE = 0.6  # nats for each character
ORDINARY_CHARS = 6  # of a run that trains the ordinary model

_letters = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)  # noqa: E731  no other case folding
ASSIGN = re.compile(
    "(%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    % "|".join([*map(_letters, ("password", "passwd", "secret", "token")), _letters("api") + "_?" + _letters("key")])
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
#: What a text must hold for the pattern to find anything; may hold for more texts.
NEEDS = ("(?i)(password|passwd|secret|token|api_?key)", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # the last state is the start of a run
_SYMBOL = np.full(256, -1, np.int64)
_SYMBOL[[ord(c) for c in ALPHABET]] = range(SIZE - 1)


def base_spans(text, has=(True, True, True)):
    """``(start, kind, end, value)`` of the fixed patterns, by start, then kind; code points."""
    found = []
    if has[0]:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if has[1]:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if has[2]:
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _base_of(text):
    """Row to base spans, for the rows of a string array that have any."""
    text = pc.fill_null(text, "")
    has = [pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False) for p in NEEDS]
    rows = np.flatnonzero(has[0] | has[1] | has[2])
    found = {int(i): base_spans(text[int(i)].as_py(), [h[i] for h in has]) for i in rows}
    return {i: spans for i, spans in found.items() if spans}


def _runs(data, at, least):
    """Symbols of a chunk, and start and end of its runs of token characters."""
    symbol = _SYMBOL[data]
    inside = np.concatenate([[False], symbol >= 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    cut = np.unique(cut[(symbol[cut] >= 0) & (symbol[cut - 1] >= 0)]) if len(cut) else cut
    if len(cut):  # two texts that touch
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    long = end - start >= least
    return symbol, start[long], end[long]


def _steps(symbol, start, end):
    """Transition codes of all runs, run after run, and where each run's begin."""
    length = end - start
    offset = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(offset[-1]) - np.repeat(offset[:-1] - start, length)
    here = symbol[place]
    before = np.empty_like(here)
    if len(here):
        before[1:] = here[:-1]
        before[offset[:-1]] = SIZE - 1
    return before * SIZE + here, offset


def transitions(docs, text_col="text"):
    """``random, step, n``: transition counts of pattern values (1) and of all other runs (0), over all texts."""

    def run(batches):
        count = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            text = batch.column(0)
            for spans in _base_of(text).values():
                for *_, value in spans:
                    symbol = _SYMBOL[np.frombuffer(value.encode(), np.uint8)]
                    symbol = symbol[symbol >= 0]
                    codes, _ = _steps(symbol, np.array([0]), np.array([len(symbol)]))
                    count[1] += np.bincount(codes, minlength=SIZE * SIZE)
            for _, data, at in chunks(text):
                codes, _ = _steps(*_runs(data, at, ORDINARY_CHARS))
                count[0] += np.bincount(codes, minlength=SIZE * SIZE)
        for label in (0, 1):
            used = np.flatnonzero(count[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), label, np.int32)), pa.array(used, pa.int64()), pa.array(count[label][used])],
                ["random", "step", "n"],
            )

    own = docs.select(text_col).mapInArrow(run, "random int, step long, n long")
    return own.groupBy("random", "step").agg(F.sum("n").alias("n"))


def ratio_table(counts):
    """Log-likelihood ratio of each transition.

    Beforehand the random model takes all characters for alike, and firmly;
    the ordinary one rests on what it has seen.
    """
    seen = np.zeros((2, SIZE, SIZE))
    for random, step, n in counts:
        seen[random].flat[step] += n
    seen[0] = np.maximum(seen[0] - seen[1], 0)  # pattern values are not ordinary
    total = seen + np.array([0.05, 1.0])[:, None, None]
    share = total[:, :, : SIZE - 1] / total[:, :, : SIZE - 1].sum(axis=2, keepdims=True)
    ratio = np.zeros((SIZE, SIZE))
    ratio[:, : SIZE - 1] = np.log(share[1] / share[0])
    return ratio.ravel()


def train(docs, text_col="text"):
    """The ratio table of a corpus: at most 2 x 67^2 counts come to the driver, whatever its size."""
    return ratio_table([(r.random, r.step, r.n) for r in transitions(docs, text_col).collect()])


def find_secrets(docs, ratio, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_ratio=MIN_RATIO, min_rate=MIN_RATE):
    """``<id>, spans``: ``array<struct<kind, start, end, ratio>>`` by start, then kind, for each row.

    Start and end are code points of the whole text, end exclusive.  A span of
    the models that overlaps one of the patterns is left out.  NULL and empty
    texts have no spans; repeated rows are searched each.
    """

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            found = {i: [(s, k, e, None) for s, k, e, _ in spans] for i, spans in _base_of(text).items()}
            for first, data, at in chunks(text):
                symbol, start, end = _runs(data, at, min_chars)
                if not len(start):
                    continue
                codes, offset = _steps(symbol, start, end)
                score = np.add.reduceat(ratio[codes], offset[:-1])
                hit = np.flatnonzero((score >= min_ratio) & (score >= min_rate * (end - start)))
                row = np.searchsorted(at, start[hit], side="right") - 1
                for i, s, e, llr in zip(row.tolist(), start[hit], end[hit], score[hit].tolist()):
                    own = data[at[i] : s]
                    s = int(np.count_nonzero((own & 0xC0) != 0x80))
                    e = s + int(e) - int(at[i]) - len(own)
                    spans = found.setdefault(first + i, [])
                    if not any(s < b and a < e for a, k, b, _ in spans if k < 3):
                        spans.append((s, 3, e, llr))
            rows = [
                [{"kind": KINDS[k], "start": s, "end": e, "ratio": r} for s, k, e, r in sorted(found.get(i, ()), key=lambda x: x[:2])]
                for i in range(len(text))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPANS)], [id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,ratio:double>>"
    )


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))
