"""Toxic texts by a subsequence string kernel, Nyström landmarks and a linear SVM.

Two strings are similar if they share subsequences of three characters; each
occurrence counts ``DECAY`` to the power of the characters it spans, so inserted
characters and gaps lower the kernel but do not break it.  A sentence is the bag
of its units (words without punctuation, and runs of single letters read as one
word); it is as toxic as its most toxic unit.  The kernel with a few landmark
units, whitened by the landmarks' own kernel matrix, is the feature map; a
squared-hinge SVM is trained on units that mark toxic sentences against units of
clean ones, and the units that mark each toxic text are chosen anew with each
model; those among the landmarks count with a character inserted, too.  A text's score is the probability fitted to its highest decision value.

Training takes at most about ``MAX_DOCS`` labelled texts, chosen by the hash of
their id; scoring takes every word of every text.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tablewright.llm.words import chunks, mix, words

MAX_DOCS = 5_000  # labelled texts to train on
LANDMARKS = 64  # of toxic units, and as many of others
ROUNDS = 4
DECAY = 0.6
SPAN = 6  # characters of a subsequence, gaps included
FOLD = 5  # rows whose crc32 of the id is 0 modulo this are held out
UNIT = 24  # characters of a unit looked at together; longer ones in steps of half of it
KEPT = 1_000_000  # decision values that a task remembers
_CELLS = 1 << 18
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def units_of(words_):
    """Units of words: lower case, letters and digits only, long ones in overlapping parts."""
    for word in words_:
        unit = "".join(filter(str.isalnum, word.lower()))
        if len(unit) <= UNIT:
            yield unit
        else:
            for k in range(0, len(unit) - UNIT // 2, UNIT // 2):
                yield unit[k : k + UNIT]


def _features(units):
    """``(unit number, cell, weight)`` of the subsequences of each unit, weights with norm 1."""
    letters = np.array(units, dtype=f"U{max(3, max(map(len, units), default=0))}").view(np.uint32).reshape(len(units), -1)
    letters = letters.astype(np.uint64)
    rows, cells, weights = [], [], []
    for a, b in _STEPS:
        if b >= letters.shape[1]:
            continue
        x, y, z = letters[:, : letters.shape[1] - b], letters[:, a : letters.shape[1] - b + a], letters[:, b:]
        row, place = np.nonzero(z)
        code = (x[row, place] << np.uint64(42)) ^ (y[row, place] << np.uint64(21)) ^ z[row, place]
        rows.append(row)
        cells.append(mix(code) & np.uint64(_CELLS - 1))
        weights.append(np.full(len(row), DECAY ** (b + 1), np.float32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    row, weight = np.concatenate(rows), np.concatenate(weights)
    key = row * _CELLS + np.concatenate(cells).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.float32)
    row, cell = key[first] // _CELLS, key[first] % _CELLS
    norm = np.sqrt(np.bincount(row, total.astype(np.float64) ** 2, minlength=len(units)))
    return row, cell, (total / norm[row]).astype(np.float32)


def kernel(left, right):
    """Normalised subsequence kernel of two lists of units."""
    row, cell, weight = _features(right)
    used, place = np.unique(cell, return_inverse=True)
    table = np.zeros((len(used) + 1, len(right)), np.float32)
    table[place, row] = weight
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(left), 500):
        row, cell, weight = _features(left[k : k + 500])
        place = np.minimum(np.searchsorted(used, cell), max(len(used) - 1, 0))
        hit = used[place] == cell if len(used) else np.zeros(0, bool)
        row, place, weight = row[hit], place[hit], weight[hit]
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[k + row[first]] = np.add.reduceat(table[place] * weight[:, None], first, axis=0)
    return out


@dataclass
class Model:
    cells: np.ndarray  # decision value of each subsequence
    bias: float
    slope: float
    offset: float

    def decide(self, units):
        if not units:
            return np.zeros(0)
        out = np.zeros(len(units))
        size = np.array([len(u) for u in units])
        for low, high in ((0, 8), (8, 12), (12, UNIT)):
            own = np.flatnonzero((size > low) & (size <= high) if low else size <= high)
            for k in range(0, len(own), 10_000):
                some = own[k : k + 10_000]
                row, cell, weight = _features([units[i] for i in some])
                out[some] = np.bincount(row, self.cells[cell] * weight, minlength=len(some))
        return out + self.bias

    def score(self, value):
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -50, 50)))


def _svm(x, rows, y, weight, penalty=1e-3, steps=25, block=50_000):
    """Weights and bias of a squared-hinge SVM on ``rows`` of ``x``, by Newton's method; they are copied and summed in blocks."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        gradient, curve = ridge * w, np.diag(ridge)
        for k in range(0, len(rows), block):
            part, own, scale = x[rows[k : k + block]], y[k : k + block], weight[k : k + block]
            margin = 1 - own * (part @ w[:-1] + w[-1])
            on = margin > 0
            active = np.hstack([part[on], np.ones((on.sum(), 1))])
            gradient = gradient - active.T @ (scale[on] * own[on] * margin[on])
            curve = curve + (active.T * scale[on]) @ active
            del part, active  # one block at a time
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], w[-1]


def _logistic(value, y, steps=50):
    """Slope and offset of the probability of label 1, with a weak pull of the slope to 1."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -50, 50)))
        g = np.array([((p - y) * value).sum() + 0.1 * (a - 1), (p - y).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * value * value).sum() + 0.1, (q * value).sum()], [(q * value).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def _spread(candidates, most, close=0.8):
    """The first ``most`` candidates that are not too similar to an earlier one."""
    chosen = []
    for k in range(0, len(candidates), 200):
        block = candidates[k : k + 200]
        far = kernel(block, chosen).max(axis=1) < close if chosen else np.ones(len(block), bool)
        own = kernel(block, block)
        for i in np.flatnonzero(far):
            if all(own[i, j] < close for j in range(i) if far[j]):
                chosen.append(block[i])
                if len(chosen) == most:
                    return chosen
            else:
                far[i] = False
    return chosen


def altered(unit):
    """The unit with a letter doubled, and with a strange one put in, at each inner place."""
    places = range(1, len(unit))
    return [unit[:k] + unit[k - 1] + unit[k:] for k in places] + [unit[:k] + "x" + unit[k:] for k in places]


def fit(bags, labels, landmarks=LANDMARKS, rounds=ROUNDS):
    """Model of bags of units and their labels (0 or 1), on the driver; the caller bounds the bags, all units of them count."""
    bags = bags if isinstance(bags, pa.Array) else pa.array(bags, pa.list_(pa.string()))
    coded = bags.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names = coded.dictionary.take(order)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    place = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    bag_of = np.repeat(np.arange(len(bags)), pc.list_value_length(bags).to_numpy(zero_copy_only=False))
    said = lambda which: names.take(pa.array(which)).to_pylist()
    labels = np.asarray(labels, float)
    toxic = np.bincount(place, labels[bag_of], minlength=len(names))
    clean = np.bincount(place, 1 - labels[bag_of], minlength=len(names))
    t, c = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    share = (toxic + clean + 1) / (t + c + 2)
    z = (toxic / t - clean / c) / np.sqrt(share * (1 - share) * (1 / t + 1 / c))
    z[pc.utf8_length(names).to_numpy(zero_copy_only=False) < 3] = -np.inf
    marks = np.flatnonzero((z > 3) & (toxic / t > 4 * clean / c))
    marks = marks[np.argsort(-z[marks], kind="stable")]
    if not len(marks) or not (labels == 0).any():  # nothing tells toxic texts apart
        rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.01
        return Model(np.zeros(_CELLS, np.float32), -1.0, 1.0, float(np.log(rate / (1 - rate)) + 1.0))
    seen_clean = np.flatnonzero((clean > 0) & (z < 2) & np.isfinite(z))
    crc = np.array([zlib.crc32(u.encode()) for u in said(seen_clean)])
    seen_clean = seen_clean[np.argsort(crc, kind="stable")]
    anchors = _spread(said(marks), landmarks)
    strong = anchors[:]
    anchors += _spread(said(seen_clean), landmarks, 0.6)
    values, vectors = np.linalg.eigh(kernel(anchors, anchors).astype(np.float64))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))
    row, cell, weight = _features(anchors)
    mapped = lambda units: (kernel(units, anchors) @ root).astype(np.float32)
    usable = np.union1d(marks, seen_clean)
    place_of = {u: m for m, u in zip(marks, said(marks))}
    more = [(v, toxic[place_of[u]] / len(u)) for u in strong for v in altered(u)]
    changed, share_of = len(names) + np.arange(len(more)), [n for _, n in more]
    features = np.zeros((len(names) + len(more), len(anchors)), np.float32)  # altered units after the others
    for k in range(0, len(usable), 10_000):
        features[usable[k : k + 10_000]] = mapped(said(usable[k : k + 10_000]))
    features[len(names) :] = mapped([v for v, _ in more])
    leading, witness = np.array([place_of[u] for u in strong]), marks
    for _ in range(rounds):
        other = np.setdiff1d(seen_clean, witness)
        rows = np.concatenate([witness, other, changed])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(other)), np.ones(len(more))])
        # as heavy as the texts in which they stand
        heavy = np.concatenate([toxic[witness], np.maximum(clean[other], 1), share_of])
        w, b = _svm(features, rows, y, heavy / heavy.mean())
        cells = np.zeros(_CELLS, np.float32)
        np.add.at(cells, cell, weight * (root @ w)[row])
        model = Model(cells, float(b), 1.0, 0.0)
        value = np.concatenate([model.decide(names[k : k + 10_000].to_pylist()) for k in range(0, len(names), 10_000)])
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, bag_of, value[place])
        picked = np.zeros(len(names), bool)
        picked[place[(value[place] >= best[bag_of] - 1e-9) & (labels[bag_of] == 1) & (value[place] > 0)]] = True
        picked = np.flatnonzero(picked & (z > 0) & (clean / c <= toxic / t / 4))
        witness = np.union1d(leading, picked)
        missing = np.setdiff1d(picked, usable)
        if len(missing):
            features[missing], usable = mapped(said(missing)), np.union1d(usable, missing)
    best = np.where(np.isfinite(best), best, model.bias)
    model.slope, model.offset = _logistic(best, labels)
    return model


def _bags(df):
    """``id, toxic, units``: the distinct units of each text."""

    def run(batches):
        for batch in batches:
            bags = [None] * len(batch)
            for first, data, at in chunks(batch.column(2)):
                row, start, end, _ = words(data, at)
                raw, cuts = data.tobytes(), np.searchsorted(row, np.arange(len(at)))
                for i in range(len(at) - 1):
                    s, e = start[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]
                    said = [raw[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())]
                    said += [raw[s[a] : e[b - 1]].decode("utf-8", "replace") for a, b in _spelled(raw, s, e, np.zeros(len(s)))]
                    bags[first + i] = sorted(set(units_of(said)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.string()))], ["id", "toxic", "units"]
            )

    return df.mapInArrow(run, "id long, toxic int, units array<string>")


def _spelled(raw, start, end, row):
    """``(first word, end word)`` of runs of three or more single letters in a text."""
    data = np.frombuffer(raw, np.uint8)
    if not len(start):
        return []
    byte = data[start] | 0x20
    single = (end - start == 1) & (byte >= 97) & (byte <= 122)
    if not single.any():
        return []
    new = np.concatenate([[True], (single[1:] != single[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]])
    use = single[first] & (last - first >= 3)
    return list(zip(first[use].tolist(), last[use].tolist()))


def train(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", max_docs=MAX_DOCS, fold=FOLD):
    """Model from labelled rows outside the held-out fold.

    A text with several labels counts as toxic if one of them says so; NULL
    labels and ids are left out.  Without labelled texts the model scores all
    texts alike.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), fold))
    own = own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    n = own.count()
    share = min(1.0, max_docs / n) if n else 1.0
    own = own.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.join(F.broadcast(own), "id").select("id", "toxic", "text")  # about max_docs ids
    table = _bags(known).toArrow().sort_by("id").combine_chunks()
    bags = table.column("units").combine_chunks()
    return fit(bags, table.column("toxic").to_numpy())


def held_out(id_col, fold=FOLD):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(fold)) == 0


def _peaks(model):
    """A function of a string array: decision value, worst word and number of toxic words of each text."""
    cut = -model.offset / model.slope
    known, values = np.zeros(0, np.uint64), np.zeros(0)

    def peaks(text):
        nonlocal known, values
        n_all = len(text)
        best, worst, many = np.full(n_all, model.bias), [None] * n_all, np.zeros(n_all, np.int64)
        for first, data, at in chunks(text):
            row, start, end, code = words(data, at)
            if not len(row):
                continue
            raw = data.tobytes()
            some, one, back = np.unique(code, return_index=True, return_inverse=True)
            if len(known) > KEPT:
                known, values = known[:0], values[:0]
            place = np.minimum(np.searchsorted(known, some), max(len(known) - 1, 0))
            new = np.flatnonzero(known[place] != some) if len(known) else np.arange(len(some))
            if len(new):
                spans = zip(start[one[new]].tolist(), end[one[new]].tolist())
                found = _decide_words(model, [raw[a:b].decode("utf-8", "replace") for a, b in spans])
                known = np.concatenate([known, some[new]])
                values = np.concatenate([values, found])
                order = np.argsort(known, kind="stable")
                known, values = known[order], values[order]
                place = np.searchsorted(known, some)
            value = values[place][back]
            hits = np.bincount(row, value >= cut, minlength=len(at) - 1)
            many[first : first + len(at) - 1] += hits.astype(np.int64)
            top = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            stop = np.concatenate([top[1:], [len(row)]])
            peak = np.maximum.reduceat(value, top)
            for r, t, s, p in zip(row[top].tolist(), top.tolist(), stop.tolist(), peak.tolist()):
                k = t + int(np.argmax(value[t:s]))
                best[first + r], worst[first + r] = p, raw[start[k] : end[k]].decode("utf-8", "replace")
            for a, b in _spelled(raw, start, end, row):
                said = raw[start[a] : end[b - 1]].decode("utf-8", "replace")
                p, i = float(_decide_words(model, [said])[0]), first + int(row[a])
                many[i] += p >= cut
                if p > best[i]:
                    best[i], worst[i] = p, said
        return best, worst, many

    return peaks


def score_texts(docs, model, id_col="doc_id", text_col="text", fold=FOLD):
    """``<id>, held_out, score, predicted, n_toxic, worst`` for each row.

    ``worst`` is the word (or spelled word) with the highest decision value
    and ``n_toxic`` the number of words the model calls toxic by themselves.
    NULL and empty texts, and texts without words, get the score of a text in
    which nothing is toxic.  Repeated rows are scored each.
    """

    def run(batches):
        peaks = _peaks(model)
        for batch in batches:
            best, worst, many = peaks(batch.column(1))
            score = model.score(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(many),
                 pa.array(worst, pa.string())],
                [id_col, "score", "predicted", "n_toxic", "worst"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    found = rows.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_toxic long, worst string")
    return found.select(id_col, held_out(F.col(id_col), fold).alias("held_out"), "score", "predicted", "n_toxic", "worst")


def _decide_words(model, said):
    """Decision value of each word: the highest of its units."""
    units, of = [], []
    for i, word in enumerate(said):
        for unit in units_of([word]):
            units.append(unit)
            of.append(i)
    out = np.full(len(said), -np.inf)
    np.maximum.at(out, np.array(of, np.int64), model.decide(units))
    return out


def without_toxic(docs, model, text_col="text"):
    """``docs`` without the rows whose score is 0.5 or more; all columns and all clean rows are kept."""

    def run(batches):
        peaks = _peaks(model)
        for batch in batches:
            best, _, _ = peaks(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(model.score(best) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
