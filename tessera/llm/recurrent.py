"""LM scoring: a gated recurrent network over words with a class-factored softmax, in numpy.

Spark counts all words of all training documents. The M most frequent words form classes of S and are told apart inside
their class by a softmax on the state; all other words form classes by their ending, in which a word's share is its
count + 1 (a word that wasn't counted has one share, too). The network sees frequent words by name and others by class.

Training: truncated backpropagation goes through every window of STEPS tokens of every training document, whole, with the
state carried on; documents run side by side in lanes and the next one takes the place of one that ends. Each task trains
on its documents from the common parameters and Spark averages the results by tokens, ROUNDS times an epoch, each time over
another part of the documents. Scoring goes through whole documents in lanes, too. Counts of words outside the KNOWN most
frequent are joined, not broadcast. Texts reach Python in small pieces, so no buffer grows with a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, small_batches, utf8

END = b"\n"  # no word holds one
M, S, ENDINGS = 1024, 32, 32
KNOWN = 1 << 17
EMBED, HIDDEN = 16, 24
STEPS, ROUNDS, RATE = 32, 2, 0.02
#: Lanes of training: FIRST at the start, one more with each step, so that little data has many steps; lanes of scoring.
FIRST, BATCH, GROUP = 32, 256, 512
CHUNK = 2048  # rows of outputs at once, which the cache holds
BLOCKS = (8, 16, 32, 64, 128)  # rows of one class that are multiplied at once: more where there are more rows
_CLASSES = M // S + ENDINGS
_START = M + ENDINGS  # the input before the first word
_FLUSH = 1 << 17


def ending(word: bytes) -> int:
    return crc32(word[-2:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts, each with one END. A task holds about _FLUSH words at most."""
    end = END.decode()

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        waiting = 0
        for b in pieces(batches):
            words = pc.ascii_split_whitespace(pc.ascii_lower(b.column(0).fill_null(""))).flatten()
            counts = words.filter(pc.not_equal(words, "")).value_counts()
            found.append(pa.table({"word": pa.concat_arrays([counts.field(0), pa.array([end])]), "n": pa.concat_arrays([counts.field(1), pa.array([b.num_rows])])}))
            waiting += len(counts)
            if waiting > _FLUSH:
                found = [summed(found)]
                waiting = found[0].num_rows
                if waiting > _FLUSH // 2:
                    yield from found[0].to_batches()
                    found, waiting = [], 0
        if found:
            yield from summed(found).to_batches()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tokens_of(text: bytes | None) -> list[bytes]:
    """A text's tokens; Words.texts() numbers those of a whole column."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


@cache
def _endings() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words of one byte, and of all pairs of last bytes."""
    one = np.array([ending(bytes((b,))) for b in range(256)], np.int32)
    return one, np.array([ending(bytes((a, b))) for a in range(256) for b in range(256)], np.int32)


def endings_of(words: pa.Array) -> np.ndarray:
    """ending() of each word of a string column without nulls and empty words."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data, ends = np.frombuffer(data, np.uint8), at[1:]
    one, two = _endings()
    last = data[ends - 1]
    return np.where(np.diff(at) > 1, two[data[np.maximum(ends - 2, 0)].astype(np.int32) * 256 + last], one[last])


class Words:
    """Numbers of known words by rank; any other word has -1 - its ending's class."""

    def __init__(self, words: list[bytes], counts: np.ndarray, shares: np.ndarray):
        n = len(words)
        self.known = pa.array(words, pa.binary()).cast(pa.string())
        rank = np.arange(n)
        ends = np.fromiter(map(ending, words), np.int64, n)
        self.end = words.index(END) if END in words else -1 - ending(END)
        self.counts = counts
        self.log_count = np.log10(counts + 1.0)
        self.log_share = -np.log10(shares)
        self.kind = np.where(rank < M, rank // S, M // S + ends)  # class
        # of each number from -ENDINGS on
        other = np.arange(ENDINGS - 1, -1, -1)
        self._seen_as = np.concatenate((M + other, np.where(rank < M, rank, M + ends))).astype(np.int16)
        self._kind = np.concatenate((M // S + other, self.kind)).astype(np.int16)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of all texts' tokens and where each text's begin; the words that aren't known and where each text's begin."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
        found, cuts = split.flatten(), split.offsets.to_numpy()
        some = pc.not_equal(found, "")  # white space at the ends gives empty words
        kept = some.to_numpy(zero_copy_only=False)
        if not kept.all():
            cuts = np.concatenate(([0], np.cumsum(kept)))[cuts]
            found = found.filter(some)
        numbers = pc.index_in(found, value_set=self.known).fill_null(-1).to_numpy()
        other = np.flatnonzero(numbers < 0)
        rare = found.take(pa.array(other))
        rare_cuts = np.searchsorted(other, cuts)
        if len(other):
            numbers = numbers.copy()
            numbers[other] = -1 - endings_of(rare)
        if self.end < 0:  # the end of a text is a word, too
            ends = pa.array([END.decode()] * len(column), pa.string())
            at = np.argsort(np.concatenate((np.arange(len(rare)), rare_cuts[1:] - 0.5)), kind="stable")
            rare, rare_cuts = pa.concat_arrays([rare, ends]).take(pa.array(at)), rare_cuts + np.arange(len(cuts))
        return np.insert(numbers, cuts[1:], self.end), cuts + np.arange(len(cuts)), rare, rare_cuts

    def inputs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input and class of each number."""
        at = numbers + ENDINGS
        return self._seen_as.take(at), self._kind.take(at)


#: The largest output weights and biases: 24 states of at most 1 give logits of at most 24 * 2 + 30.
LIMITS = {"wc": 2.0, "bc": 30.0, "ww": 2.0, "bw": 30.0}
SHAPES = {"embed": (_START + 1, EMBED), "wx": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, _CLASSES), "bc": (_CLASSES,), "ww": (M, HIDDEN), "bw": (M,)}


def initial(words: Words) -> dict[str, np.ndarray]:
    """Small random weights; biases give the words' own shares."""
    rng = np.random.default_rng(5)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    n = np.zeros(M)
    n[: min(M, len(words.counts))] = words.counts[:M]
    of = np.bincount(words.kind, words.counts, _CLASSES) if len(words.counts) else np.zeros(_CLASSES)
    p["b"][:] = 0
    p["bw"] = (np.log(n + 1).reshape(-1, S) - np.log(n + 1).reshape(-1, S).max(1, keepdims=True)).ravel().astype(np.float32)
    p["bc"] = np.log(of / max(of.sum(), 1) + 1e-4).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    """Views of x where it is of single precision."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = x[at : at + n].reshape(s).astype(np.float32, copy=False), at + n
    return out


def by_gate(x: np.ndarray) -> np.ndarray:
    """Rows of three gates as one block for each gate, so that all arithmetic on a gate is on contiguous numbers."""
    return np.ascontiguousarray(x.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))


#: What the gates are multiplied by on the way in: the logistic function of -x is 1 / (1 + exp(x)), tanh that of twice x.
INTO = np.array([1, -1, -2], np.float32).reshape(3, 1, 1)
#: The same on the way back, where the candidate's derivative is taken as -2 times what it is.
BACK = np.array([1, -0.5, -1], np.float32).reshape(3, 1, 1)


def _closed(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place; where exp(x) is too large for a number, it is 0."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def advance(u: np.ndarray, gates: np.ndarray, h: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step. u, and the inputs' share of the gates, lie by gate and are multiplied by INTO; gates is overwritten. out: the
    new state. Share of the candidate, reset, candidate, the state's part of it, and the old state without the candidate."""
    own = np.matmul(h, u)
    both = gates[:2]
    both += own[:2]
    k, r = _closed(both)
    inner = own[2]
    n = r * inner
    n += gates[2]
    _closed(n)
    n += n
    n -= 1
    apart = h - n
    np.multiply(k, apart, out=out)
    np.subtract(h, out, out=out)
    return k, r, n, inner, apart


def step(p: dict[str, np.ndarray], gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step from plain parameters and gates as rows: the new state, and what advance() gives."""
    new = np.empty_like(h)
    return new, *advance(by_gate(p["u"]) * INTO, by_gate(gates) * INTO, h, new)


def _softmax(x: np.ndarray, places: np.ndarray, grads: bool) -> np.ndarray:
    """Log probabilities of the targets, whose places in all of x are given. In place with grads: all probabilities, less 1
    for the targets. States lie in -1 to 1 and weights within LIMITS, so no exponential overflows."""
    every = x.reshape(-1)
    chosen = every.take(places)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if grads:
        x *= np.reciprocal(total)[:, None]
        every[places] -= 1
    return chosen - np.log(total)


def outputs(
    p: dict[str, np.ndarray], h: np.ndarray, kind: np.ndarray, number: np.ndarray, grads: dict[str, np.ndarray] | None = None, valid: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target's class and, for a frequent word, of the word in it; 0 where not valid. With grads:
    these are added for the sum of losses, and the gradient by h is returned. Rows are put in order of their classes and
    CHUNK of them are worked on at a time."""
    kind = kind.astype(np.int16, copy=False)
    order = np.argsort(kind if valid is None else np.where(valid, kind, np.int16(_CLASSES)), kind="stable")
    if valid is not None:
        order = order[: np.count_nonzero(valid)]
    rows = len(order)
    place = np.full(len(h), rows)
    place[order] = np.arange(rows)
    h, kind = h.take(order, 0), kind.take(order)
    cuts = np.searchsorted(kind, np.arange(M // S + 1)).tolist()
    target = number.take(order[: cuts[-1]]).astype(np.intp) % S
    logs, dh = np.zeros(rows + 1), None if grads is None else np.zeros((rows + 1, HIDDEN), h.dtype)
    back, ones = np.ascontiguousarray(p["wc"].T), np.ones(CHUNK, h.dtype)
    begin, space = np.arange(CHUNK) * _CLASSES, np.empty((min(rows, CHUNK), _CLASSES), h.dtype)
    for lo in range(0, rows, CHUNK):
        at = slice(lo, min(rows, lo + CHUNK))
        part = h[at]
        x = np.matmul(part, p["wc"], out=space[: len(part)])
        x += p["bc"]
        logs[at] = _softmax(x, begin[: len(x)] + kind[at], grads is not None)
        if grads is not None:
            grads["wc"] += part.T @ x
            grads["bc"] += ones[: len(x)] @ x
            np.matmul(x, back, out=dh[at])
    # words of a class in blocks of equal height; a class's last block is filled up with a row that doesn't count
    tall = next((t for t in BLOCKS if t * M // S > cuts[-1]), BLOCKS[-1])
    sizes = np.diff(cuts)
    blocks = -(-sizes // tall)
    classes = np.repeat(np.arange(M // S), blocks)
    place_in = (np.arange(len(classes)) - np.repeat(np.cumsum(blocks) - blocks, blocks))[:, None] * tall + np.arange(tall)
    real = place_in < sizes[classes][:, None]
    rows_of = np.where(real, place_in, 0) + np.asarray(cuts)[classes][:, None]
    some, lo = CHUNK // tall, 0
    weights, bias, begin = p["ww"].reshape(-1, S, HIDDEN), p["bw"].reshape(-1, 1, S), np.arange(CHUNK) * S
    for b in range(0, len(classes), some):
        of, part_of = classes[b : b + some], rows_of[b : b + some]
        used = np.flatnonzero(real[b : b + some])
        at = slice(lo, lo + len(used))
        lo += len(used)
        part, own = h.take(part_of, 0), weights.take(of, 0)
        x = part @ own.transpose(0, 2, 1)
        x += bias.take(of, 0)
        flat_x = x.reshape(-1, S)
        logs[at] += _softmax(flat_x, begin[: len(flat_x)] + target.take(part_of).ravel(), grads is not None).take(used)
        if grads is not None:
            flat_x[np.flatnonzero(~real[b : b + some])] = 0
            first = np.flatnonzero(np.diff(of, prepend=-1))
            grads["ww"].reshape(-1, S, HIDDEN)[of[first]] += np.add.reduceat(x.transpose(0, 2, 1) @ part, first)
            grads["bw"].reshape(-1, S)[of[first]] += np.add.reduceat(ones[:tall] @ x, first)
            dh[at] += (x @ own).reshape(-1, HIDDEN).take(used, 0)
    return logs.take(place), None if grads is None else dh.take(place, 0)


def backpropagate(p: dict[str, np.ndarray], seen: np.ndarray, kind: np.ndarray, number: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """One window: arrays are steps x rows. Gradients of the mean loss, the state after it, the summed log probability."""
    steps, rows = seen.shape
    table, u = by_gate(p["embed"] @ p["wx"] + p["b"]) * INTO, by_gate(p["u"]) * INTO
    grads = {k: np.zeros(s, table.dtype) for k, s in SHAPES.items()}
    states = np.empty((steps + 1, rows, HIDDEN), table.dtype)
    states[0], inside = h, []
    with np.errstate(over="ignore"):
        for t in range(steps):
            inside.append(advance(u, table.take(seen[t], 1), states[t], states[t + 1]))
    logs, from_out = outputs(p, states[1:].reshape(-1, HIDDEN), kind.ravel(), number.ravel(), grads, valid.ravel())
    from_out = from_out.reshape(steps, rows, HIDDEN)
    back = np.zeros((rows, HIDDEN), table.dtype)
    # of the inputs' candidate; of all gates; of the state's candidate, which goes through the reset gate
    found = np.empty((4, steps, rows, HIDDEN), table.dtype)
    ut = (by_gate(p["u"]) * BACK).transpose(0, 2, 1).copy()
    own = np.empty((3, rows, HIDDEN), table.dtype)
    for t in range(steps - 1, -1, -1):
        k, r, n, inner, apart = inside[t]
        dn, dz, dr, dinner = found[:, t]
        back += from_out[t]
        open_ = back * k
        back -= open_
        np.multiply(back, k, out=dz)
        dz *= apart
        n *= n
        n -= 1
        np.multiply(open_, n, out=dn)
        np.multiply(dn, r, out=dinner)
        inner *= dinner
        np.multiply(inner, r, out=dr)
        dr -= inner
        np.matmul(found[1:, t], ut, out=own)
        for x in own:
            back += x
    found, inputs = found.reshape(4, -1, HIDDEN), seen.ravel()
    before, embedded = states[:-1].reshape(-1, HIDDEN).T, p["embed"].take(inputs, 0).T
    side = np.ones(len(inputs), table.dtype)
    by_input = np.zeros((len(inputs), EMBED), table.dtype)
    for k, (of_input, of_state) in enumerate(((1, 1), (2, 2), (0, 3))):
        at, factor = slice(k * HIDDEN, (k + 1) * HIDDEN), float(BACK[k, 0, 0])
        grads["u"][:, at] = before @ found[of_state] * factor
        grads["wx"][:, at] = embedded @ found[of_input] * factor
        grads["b"][at] = side @ found[of_input] * factor
        by_input += found[of_input] @ (p["wx"][:, at].T * factor)
    order = np.argsort(inputs.astype(np.int16), kind="stable")
    ordered = inputs.take(order)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    grads["embed"][ordered.take(first)] = np.add.reduceat(by_input.take(order, 0), first)
    total = max(1, int(np.count_nonzero(valid)))
    for g in grads.values():
        g /= total
    return grads, states[-1].copy(), float(logs.sum())


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.x, self.rate, self.t = flat(p), rate, 0
        self.p = unflat(self.x)
        self.m, self.v = np.zeros_like(self.x), np.zeros_like(self.x)

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        g = flat(grads)
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        square = g * g
        for old, new, part in ((self.m, g, 0.1), (self.v, square, 0.01)):
            new -= old
            new *= part
            old += new
        by = np.sqrt(self.v, out=square)
        by += 1e-6
        np.divide(self.m, by, out=by)
        by *= self.rate * float(np.sqrt(1 - 0.99**self.t)) / (1 - 0.9**self.t)
        self.x -= by
        for k, most in LIMITS.items():
            np.clip(self.p[k], -most, most, out=self.p[k])


class Lanes:
    """Documents' numbers side by side; each window takes the next STEPS of every one."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.state = np.zeros((0, HIDDEN), np.float32)
        self._new: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.docs) + len(self._new)

    def add(self, numbers: np.ndarray) -> None:
        self._new.append(numbers)

    def window(self, own: Words) -> tuple[np.ndarray, ...]:
        """Inputs, classes, numbers and which are valid, as steps x lanes. What is seen first is _START."""
        if self._new:
            n = len(self._new)
            self.docs += self._new
            self.at = np.concatenate((self.at, np.zeros(n, np.int64)))
            self.size = np.concatenate((self.size, np.fromiter(map(len, self._new), np.int64, n)))
            self.state = np.concatenate((self.state, np.zeros((n, HIDDEN), np.float32)))
            self._new = []
        left = self.size - self.at
        long = min(STEPS, int(left.max()))
        number = np.full((len(self.docs), long + 1), -1, np.int32)
        for row, d, at in zip(number, self.docs, self.at.tolist(), strict=True):
            if at:
                part = d[at - 1 : at + long]
                row[: len(part)] = part
            else:
                part = d[:long]
                row[1 : 1 + len(part)] = part
        number = np.ascontiguousarray(number.T)
        seen, kind = own.inputs(number)
        seen[0, self.at == 0] = _START
        return seen[:-1].astype(np.intp), kind[1:], number[1:], np.arange(long)[:, None] < left

    def moved(self, state: np.ndarray) -> np.ndarray:
        """Goes on by a window; returns which lanes have ended (these are gone)."""
        self.at += STEPS
        more = self.at < self.size
        self.docs = [d for d, go in zip(self.docs, more.tolist(), strict=True) if go]
        self.at, self.size, self.state = self.at[more], self.size[more], state[more]
        return np.flatnonzero(~more)


def train_round(docs: DataFrame, words, start, number_of_round: int) -> np.ndarray:
    """Parameters after one round: each task's own, averaged by its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Words = words.value
        model = Adam(unflat(start.value), RATE / (1 + 2 * number_of_round))
        tokens, lanes = 0, Lanes()

        def learn() -> None:
            nonlocal tokens
            seen, kind, number, valid = lanes.window(own)
            grads, state, _ = backpropagate(model.p, seen, kind, number, valid, lanes.state)
            model.update(grads)
            tokens += int(valid.sum())
            lanes.moved(state)

        for b in pieces(batches):
            numbers, cuts, _, _ = own.texts(b.column(0))
            for lo, hi in pairwise(cuts.tolist()):
                lanes.add(numbers[lo:hi].copy())  # a document of its own, which keeps no others
                while len(lanes) >= min(BATCH, FIRST + model.t):
                    learn()
        while len(lanes):
            learn()
        if tokens:
            x = np.append(flat(model.p).astype(np.float64), 1.0) * tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["i", "x"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    if not rows.num_rows:
        return start.value
    x = np.zeros(len(start.value) + 1)
    x[rows["i"].to_numpy()] = rows["x"].to_numpy()
    return x[:-1] / x[-1]


def scored(p: dict[str, np.ndarray], own: Words, docs: Iterator[tuple[object, np.ndarray]], group: int = 0) -> Iterator[tuple[object, float]]:
    """For each (key, numbers of a whole document) the key and the log10 probability by classes and frequent words, in the
    order in which documents end."""
    table, u = by_gate(p["embed"] @ p["wx"] + p["b"]) * INTO, by_gate(p["u"]) * INTO
    lanes, keys, total, group = Lanes(), [], np.zeros(0), group or GROUP

    def go() -> Iterator[tuple[object, float]]:
        nonlocal keys, total
        seen, kind, number, valid = lanes.window(own)
        total = np.concatenate((total, np.zeros(len(keys) - len(total))))
        h, states = lanes.state, np.empty((*seen.shape, HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(seen)):
                advance(u, table.take(seen[t], 1), h, states[t])
                h = states[t]
        logs, _ = outputs(p, states.reshape(-1, HIDDEN), kind.ravel(), number.ravel(), valid=valid.ravel())
        total += logs.reshape(seen.shape).sum(0)
        ended = lanes.moved(h)
        for k in ended.tolist():
            yield keys[k], float(total[k]) / np.log(10)
        gone = set(ended.tolist())
        keys, total = [x for k, x in enumerate(keys) if k not in gone], np.delete(total, ended)

    for key, numbers in docs:
        lanes.add(numbers)
        keys.append(key)
        while len(lanes) >= group:
            yield from go()
    while len(lanes):
        yield from go()


def scores(p: dict[str, np.ndarray], own: Words, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's whole run of numbers by classes and frequent words."""
    out = np.zeros(len(docs))
    for k, x in scored(p, own, iter(enumerate(docs))):
        out[k] = x
    return out


def score_documents(docs: DataFrame, fold: int = 7, held: int = 2, epochs: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Held out are documents whose crc32 of the id, as text, leaves `held` by `fold`; a null id trains. An epoch trains on
    every token of every other document once. A null text is empty: its one token is the end. Repeated rows are scored
    alike; an empty table gives none, one without training documents gives each token the share of a word that was never
    seen. Tokens of very long texts train and score in windows like all others."""
    spark = docs.sparkSession
    small_batches(spark)
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))
    rows = docs.select("doc_id", out_of.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts, _ = materialize(count_words(training), "word-counts")
    n_total, n_words = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()  # KNOWN rows at most
    known, known_counts = utf8(top["word"].combine_chunks()) if top.num_rows else [], top["n"].to_numpy().astype(np.float64)
    frequent = set(known[:M])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENDINGS)
        for b in batches:
            for w, n in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                if w not in frequent:
                    total[ending(w)] += n + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS, dtype=np.int32)), pa.array(total)], ["k", "n"])

    of = np.ones(ENDINGS)  # the share of a word that wasn't counted
    for r in counts.mapInArrow(shares, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        of[r["k"]] += r["n"]
    words = Words(known, known_counts, of)
    shared, x = spark.sparkContext.broadcast(words), flat(initial(words)).astype(np.float64)
    for k in range(ROUNDS * epochs):
        part = training.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k % ROUNDS)
        x = train_round(part, shared, spark.sparkContext.broadcast(x), k)
    model = spark.sparkContext.broadcast(x)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, p = shared.value, unflat(model.value)
        id_type: list[pa.DataType] = []

        def numbered() -> Iterator[tuple[list, np.ndarray]]:
            for b in pieces(batches):
                id_type[:] = [b.schema.field(0).type]
                numbers, cuts, rare, rare_cuts = own.texts(b.column(2))
                rare = utf8(rare)
                places = zip(pairwise(cuts.tolist()), pairwise(rare_cuts.tolist()), strict=True)
                for key, held_out, ((lo, hi), (s, e)) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), places, strict=True):
                    n = numbers[lo:hi].copy()
                    hit = n[n >= 0]
                    tail = hit[hit >= M]
                    rest = float((own.log_count[tail] + own.log_share[own.kind[tail] - M // S]).sum()) if len(tail) else 0.0
                    if len(hit) < len(n):
                        rest += float(own.log_share[-1 - n[n < 0]].sum())
                    base = float(own.log_count[hit].sum()) if len(hit) else 0.0
                    yield [key, held_out, len(n), len(hit), base, rest, rare[s:e]], n

        def batch(done: list[list]) -> pa.RecordBatch:
            kinds = (id_type[0], pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            columns = [pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.list_(pa.string()))], names)

        done = []
        for row, score in scored(p, own, numbered()):
            row[5] += score
            done.append(row)
            if len(done) >= 500:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    local, _ = materialize(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>").withColumn("_uid", F.monotonically_increasing_id()), "lm-local")
    rare = local.select("_uid", F.explode("rare").alias("w")).join(counts, F.col("w") == F.col("word"))
    more = rare.groupBy(F.col("_uid").alias("_u")).agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("_logs"))
    every = local.drop("rare").join(more, F.col("_uid") == F.col("_u"), "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return every.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(n_total + n_words + 1))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
