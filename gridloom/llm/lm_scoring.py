"""Log-likelihood of whole documents under a gated recurrent language model.

Words of the training documents are counted over the whole corpus. The commonest form a short list,
as long as the square root of the number of training tokens, in classes by frequency; all others
belong to a class by their last two bytes. The network says whether the next word is a listed one,
gives a softmax over the classes of that kind, and within a short-list class a softmax over its
words; within the other classes words have their corpus frequency, with one place for what was never
seen. So every text has a probability.

The network is a GRU. It is trained by backpropagation truncated to windows, with its state carried
across windows and set to zero only where a document begins. Training documents are dealt by hash
to shards, in an order by hash but for long ones, which come first. A round trains every shard from the same weights on the next, ever
larger share of its documents, until all are learnt; then the shards' changes are averaged. Scoring
carries the state from a document's first token to its end. Nothing of this depends on how the table
is partitioned, but for the rounding of sums.

Words are kept as 64-bit hashes. Null and empty texts are an end token only. Rows with equal or
null ids each give a row. Without training documents every text has its base score. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import FlatText, crc_mod, flat_chunks, hash_spans, scratch

#: Words whose counts go to the executors as a sorted array, or twice the short list if that is more; the counts of others are joined.
COMMON_WORDS = 1 << 19
TAIL_CLASSES = 96
HIDDEN, EMBED, WINDOW = 24, 24, 16
#: The share of a shard's documents that are learnt after each round, and the round's learning rate.
ROUNDS = ((1 / 64, 0.03), (1.0, 0.02))
#: The number of shards is the square root of the number of training tokens over this.
SHARD_ROOT = 700
#: Windows of one round in a shard, about: the number of documents read side by side follows from it, within these bounds.
UPDATES, LANES = 150, (16, 512)
#: The short list's output words step once in so many windows.
WORD_STEP = 2
#: Tokens whose classes are worked out at a time: what they take stays in the cache.
BLOCK = 2048
#: Windows whose outputs are worked out together in scoring.
POOL = 4
#: Tokens that a shard's lanes are filled with at a time, about, and of documents that come first, so that none of them is left over at the end.
FEED, LONG = 1 << 18, 2048
#: Numbers in one slice of the weights, which one task adds up over all shards.
SLICE = 1 << 16
_LN10 = float(np.log(10))


# --- the network --------------------------------------------------------------------------------


@dataclass
class Classes:
    """Symbols: short-list words by rank, tail classes, the end token. ``cuts``: ranks at which classes begin, and the list's length."""

    cuts: np.ndarray

    def __post_init__(self) -> None:
        self.short, self.n = int(self.cuts[-1]), len(self.cuts) - 1
        self.end = self.short + TAIL_CLASSES
        self.of = np.concatenate([np.repeat(np.arange(self.n), np.diff(self.cuts)), self.n + np.arange(TAIL_CLASSES + 1)])

    @classmethod
    def by_frequency(cls, counts: np.ndarray) -> Classes:
        """Classes of about equal sums of square roots of (descending) counts: common ones are small."""
        if not len(counts):
            return cls(np.zeros(1, np.int64))
        n = max(1, int(0.6 * np.sqrt(len(counts))))
        sums = np.cumsum(np.sqrt(counts))
        inner = np.searchsorted(sums, sums[-1] * np.arange(1, n) / n, "right")
        return cls(np.unique(np.concatenate([[0], inner, [len(counts)]])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def new_weights(classes: Classes, word_counts: np.ndarray, tail_counts: np.ndarray, ends: float, seed: int = 3) -> dict[str, np.ndarray]:
    """Starting weights; the biases (last of g, last row of c, last column of w) give frequencies of listed words, classes and words."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    words = np.maximum(word_counts, 1.0)
    by_class = np.add.reduceat(words, classes.cuts[:-1]) if classes.n else np.zeros(0)
    listed, other = by_class + 1.0, np.append(tail_counts, ends) + 1.0
    made = {
        "x": rng.normal(0, 0.3, (classes.end + 1, EMBED)),
        "p": rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 3 * h)),
        "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
        "b": np.concatenate([np.ones(h), np.zeros(2 * h)]),
        "g": np.append(rng.normal(0, 0.05, h), np.log(max(listed.sum(), 1.0) / other.sum())),
        "c": np.concatenate([rng.normal(0, 0.05, (h, len(listed) + len(other))), np.log(np.concatenate([listed / max(listed.sum(), 1.0), other / other.sum()]))[None, :]]),
        "w": np.concatenate([rng.normal(0, 0.05, (classes.short, h)), (np.log(words) - np.repeat(np.log(by_class), np.diff(classes.cuts)))[:, None]], axis=1),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


_kept_room: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
    """An unset array for the use called ``name``, which its next use overwrites. Fresh ones of some MB
    would be handed back to the system and faulted in again at every window, for a sixth of the time."""
    size, held = int(np.prod(shape)), _kept_room.get(name)
    if held is None or held.dtype != dtype or len(held) < size:
        held = _kept_room[name] = np.empty(size, dtype)
    return held[:size].reshape(shape)


def _steps(w: dict, h: np.ndarray, tokens: np.ndarray, fresh: np.ndarray, keep: bool = False):
    """Run the GRU over (time x lanes): the states before each token with a 1 behind, the last state, what backpropagation needs.

    Within, lanes are the last axis, so that every gate's numbers lie together. The next call overwrites all but the last state."""
    n, (long, wide) = HIDDEN, tokens.shape
    rows = _room("rows", (long, wide, EMBED), h.dtype)
    np.take(w["x"], tokens.reshape(-1), axis=0, out=rows.reshape(-1, EMBED), mode="clip")
    # gates are sigmoids, 0.5 + 0.5 tanh(x / 2): halved here, once for all steps
    halves = np.repeat(np.array([0.5, 1.0], h.dtype), [2 * n, n])
    gates = np.matmul((w["p"] * halves).T, rows.transpose(0, 2, 1), out=_room("gates", (long, 3 * n, wide), h.dtype))
    gates += (w["b"] * halves)[:, None]
    turn, some = np.ascontiguousarray((w["u"] * halves).T), fresh.any(axis=1).tolist()
    turned = _room("turned", (long if keep else 1, 3 * n, wide), h.dtype)
    states = _room("states", (long + 1, n, wide), h.dtype)
    states[0] = h.T
    for t in range(long):
        now, after, x, r = states[t], states[t + 1], gates[t], turned[t if keep else 0]
        if some[t]:
            now *= ~fresh[t]
        np.matmul(turn, now, out=r)
        both, new = x[: 2 * n], x[2 * n :]
        both += r[: 2 * n]
        np.tanh(both, out=both)
        both *= 0.5
        both += 0.5
        np.multiply(x[n : 2 * n], r[2 * n :], out=after)
        new += after
        np.tanh(new, out=new)
        np.subtract(now, new, out=after)
        after *= x[:n]
        after += new
    before = _room("before", (long, wide, n + 1), h.dtype)
    before[:, :, n] = 1
    before[:, :, :n] = states[:-1].transpose(0, 2, 1)
    return before, states[-1].T.copy(), (states, gates, turned, rows)


def _classes_bounded(w: dict, classes: Classes) -> bool:
    reach, bias = np.abs(w["c"][:-1]).sum(axis=0).max(), w["c"][-1]
    return bool(np.abs(w["g"]).sum() < 80 and all(reach + abs(part.max()) < 80 for part in (bias[: classes.n], bias[classes.n :]) if len(part)))


def _words_bounded(w: dict, classes: Classes) -> bool:
    if not classes.n:
        return True
    weights = w["w"]
    reach = (np.abs(weights) @ np.append(np.ones(HIDDEN, weights.dtype), weights.dtype.type(0))).max()
    return bool(reach + np.abs(np.maximum.reduceat(weights[:, -1], classes.cuts[:-1])).max() < 80)


def bounded(w: dict, classes: Classes) -> bool:
    """Whether no state, whose components lie between -1 and 1, takes a softmax out of the range of exp."""
    return _classes_bounded(w, classes) and _words_bounded(w, classes)


_ROWS = np.arange(BLOCK)


def _exponentials(own: np.ndarray, weights: np.ndarray, place: np.ndarray, total: np.ndarray, safe: bool, ones: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
    """Exponentials of the logits, whose rows' sums go to ``total`` and the logits of one place a row to ``chosen``."""
    x = own @ weights
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    if chosen is not None:
        chosen[:] = x[_ROWS[: len(x)], place]
    np.exp(x, out=x)
    np.matmul(x, ones[: x.shape[1]], out=total)
    return x


def _output(w: dict, classes: Classes, states: np.ndarray, tokens: np.ndarray, word_grads: np.ndarray | None = None, safe: bool = False):
    """Natural log-probability of each token's kind, class and short-list word; with ``word_grads``, which are added to, gradients instead.

    Tokens are put in the order of their classes once: listed ones come first, and a class's are a slice."""
    grad, n, dtype = word_grads is not None, len(tokens), states.dtype
    cls = classes.of[tokens]
    order = np.argsort(cls.astype(np.uint16) if classes.n + TAIL_CLASSES < 1 << 16 else cls, kind="stable")
    cls, tokens = cls[order], tokens[order]
    states = np.take(states, order, axis=0, out=_room("ordered", states.shape, dtype), mode="clip")
    ends = np.searchsorted(cls, np.arange(classes.n + 1)).tolist()
    m, sizes = ends[-1], np.diff(classes.cuts)  # m: listed tokens
    score, back, grads, chosen = None, None, None, None
    # sums of words' exponentials, 1 where a class has one word
    total, ones = np.ones(n, dtype), np.ones(max(classes.n, TAIL_CLASSES + 1, *sizes.tolist(), 1), dtype)
    if grad:
        back, grads = _room("back", (n, HIDDEN), dtype), {"c": np.empty_like(w["c"]), "g": np.zeros_like(w["g"])}
        grads["c"][:] = 0
    else:
        score, chosen = np.zeros(n, dtype), np.zeros(n, dtype)
    inside = tokens[:m] - classes.cuts[cls[:m]]
    for k, (a, b) in enumerate(zip(classes.cuts[:-1].tolist(), classes.cuts[1:].tolist(), strict=True)):
        if b - a == 1:  # nothing to tell apart
            if grad:
                back[ends[k] : ends[k + 1]] = 0
            continue
        weights = w["w"][a:b]
        for i in range(ends[k], ends[k + 1], BLOCK):
            j = min(ends[k + 1], i + BLOCK)
            own, place, sums = states[i:j], inside[i:j], total[i:j]
            x = _exponentials(own, weights.T, place, sums, safe, ones, None if grad else chosen[i:j])
            if grad:
                x[_ROWS[: j - i], place] -= sums
                np.divide(1, sums, out=sums)
                word_grads[a:b] += x.T @ (own * sums[:, None])
                np.matmul(x, weights[:, :-1], out=back[i:j])
    if grad:
        back[:m] *= total[:m, None]
        back[m:] = 0
    else:
        score += chosen - np.log(total)
    for begin, end, columns in ((0, m, slice(0, classes.n)), (m, n, slice(classes.n, None))):
        weights = w["c"][:, columns]
        for i in range(begin, end, BLOCK):
            j = min(end, i + BLOCK)
            own, place, sums = states[i:j], cls[i:j] - columns.start, total[i:j]
            x = _exponentials(own, weights, place, sums, safe, ones, None if grad else chosen[i:j])
            if grad:
                x[_ROWS[: j - i], place] -= sums
                np.divide(1, sums, out=sums)
                grads["c"][:, columns] += (own * sums[:, None]).T @ x
                more = x @ weights[:-1].T
                more *= sums[:, None]
                back[i:j] += more
    if classes.n:
        x = states @ w["g"]
        if grad:
            d = _sigmoid(x)
            d[:m] -= 1
            back += d[:, None] * w["g"][:-1]
            grads["g"] = states.T @ d
        else:
            np.negative(x[:m], out=x[:m])
            score -= np.logaddexp(0, x)
    back_to = np.empty_like(order)
    back_to[order] = np.arange(n)
    if grad:
        return None, grads, back.take(back_to, axis=0)
    score += chosen - np.log(total)
    return score[back_to], None, None


def _window_gradients(w: dict, classes: Classes, h: np.ndarray, tokens: np.ndarray, fresh: np.ndarray, live: np.ndarray, word_grads: np.ndarray, safe: bool = False):
    """The number of tokens, last state, dense gradients, and the input symbols' gradients as (symbols, rows)."""
    before, last, (states, gates, turned, rows) = _steps(w, h, tokens, fresh, keep=True)
    n, (long, wide) = HIDDEN, tokens.shape
    flat, whole = tokens.reshape(-1), bool(live.all())
    outputs = before.reshape(-1, n + 1)
    if whole:
        _, grads, back = _output(w, classes, outputs, flat, word_grads, safe)
    else:
        on = np.flatnonzero(live.reshape(-1))
        _, grads, back_on = _output(w, classes, outputs[on], flat[on], word_grads, safe)
        back = np.zeros((len(flat), n), h.dtype)
        back[on] = back_on
    turned_back = _room("turned back", (long, n, wide), h.dtype)
    turned_back[:] = back.reshape(long, wide, n).transpose(0, 2, 1)
    dh, du, some, u = np.zeros((n, wide), h.dtype), np.zeros_like(w["u"]), fresh.any(axis=1).tolist(), w["u"]
    dx, drec, spare = _room("dx", (long, 3 * n, wide), h.dtype), np.empty((3 * n, wide), h.dtype), np.empty((n, wide), h.dtype)
    for t in range(long - 1, -1, -1):
        x, own, rn = gates[t], states[t], turned[t, 2 * n :]
        z, reset, new = x[:n], x[n : 2 * n], x[2 * n :]
        dz, dreset, da = dx[t, :n], dx[t, n : 2 * n], dx[t, 2 * n :]
        # dz = dh (own - new) z (1 - z); da = dh (1 - z) (1 - new^2); dreset = da rn reset (1 - reset)
        np.multiply(dh, z, out=spare)
        dh -= spare
        np.subtract(own, new, out=dz)
        dz *= dh
        dz *= z
        np.multiply(new, new, out=da)
        np.subtract(1, da, out=da)
        da *= dh
        np.multiply(da, reset, out=drec[2 * n :])
        np.subtract(1, reset, out=dreset)
        dreset *= rn
        dreset *= drec[2 * n :]
        drec[: 2 * n] = dx[t, : 2 * n]
        du += own @ drec.T
        np.matmul(u, drec, out=dh)
        dh += spare
        dh += turned_back[t]
        if some[t]:
            dh *= ~fresh[t]
    if not whole:
        dx *= live[:, None, :]
    present = np.zeros(classes.end + 1, bool)
    present[flat] = True
    symbols = np.flatnonzero(present)
    spot = (np.cumsum(present) - 1)[flat]
    ones = np.ones(wide, h.dtype)
    grads |= {"u": du, "b": (dx @ ones).sum(axis=0), "p": np.matmul(rows.transpose(0, 2, 1), dx.transpose(0, 2, 1)).sum(axis=0)}
    moves = np.matmul(w["p"], dx, out=_room("moves", (long, EMBED, wide), h.dtype))
    sums = np.empty((len(symbols), EMBED), h.dtype)
    for k in range(EMBED):
        sums[:, k] = np.bincount(spot, moves[:, k].reshape(-1), len(symbols))
    return len(flat) if whole else len(on), last, grads, (symbols, sums)


class Adam:
    """Steps on one set of weights; input symbols step where a window has them, output words once in WORD_STEP windows."""

    def __init__(self, w: dict):
        self.w = w
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        self.words = np.zeros_like(w["w"])
        self.n = self.word_steps = self.gathered = 0

    def _dense(self, k: str, g: np.ndarray, rate: float, n: int) -> None:
        m, v, f = self.m[k], self.v[k], np.float32
        m *= f(0.9)
        m += f(0.1) * g
        g *= g
        g *= f(0.01)
        v *= f(0.99)
        v += g
        np.multiply(v, f(1 / (1 - 0.99**n)), out=g)
        np.sqrt(g, out=g)
        g += f(1e-7)
        np.divide(m, g, out=g)
        g *= f(rate / (1 - 0.9**n))
        self.w[k] -= g

    def step(self, grads: dict, symbols: np.ndarray, rows: np.ndarray, tokens: int, rate: float) -> None:
        f = np.float32
        self.n += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()) + float(np.vdot(rows, rows))) / tokens
        scale = f(min(1.0, 1.0 / max(norm, 1e-9)) / tokens)
        for k, g in grads.items():
            g *= scale
            self._dense(k, g, rate, self.n)
        rows *= scale
        m, v = self.m["x"][symbols] * f(0.9) + f(0.1) * rows, self.v["x"][symbols] * f(0.99) + f(0.01) * rows * rows
        self.m["x"][symbols], self.v["x"][symbols] = m, v
        self.w["x"][symbols] -= f(rate / (1 - 0.9**self.n)) * m / (np.sqrt(v * f(1 / (1 - 0.99**self.n))) + f(1e-7))
        self.gathered += tokens
        if self.n % WORD_STEP == 0:
            self.word_steps += 1
            self.words *= f(1.0 / self.gathered)
            self._dense("w", self.words, rate, self.word_steps)
            self.words[:] = 0
            self.gathered = 0


def lanes(lengths: np.ndarray, n_lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the lane that holds least; lanes come longest first."""
    heap = [(0, i) for i in range(min(n_lanes, max(1, len(lengths))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        dealt[i].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), i))
    size = {i: s for s, i in heap}
    return [dealt[i] for i in sorted(size, key=lambda i: -size[i]) if dealt[i]]


def token_scores(w: dict, classes: Classes, tokens: np.ndarray, at: np.ndarray, n_lanes: int = 512) -> np.ndarray:
    """log10 probability of each token's class and short-list word, documents each from a zero state."""
    out = np.zeros(len(tokens))
    if not len(tokens):
        return out
    columns = [np.concatenate([np.arange(at[d], at[d + 1]) for d in lane]) for lane in lanes(np.diff(at), n_lanes)]
    place = np.full((max(len(c) for c in columns), len(columns)), -1, np.int64)
    for i, c in enumerate(columns):
        place[: len(c), i] = c
    begin = np.zeros(len(tokens), bool)
    begin[at[:-1]] = True
    h, safe = np.zeros((place.shape[1], HIDDEN), np.float32), bounded(w, classes)
    # several windows' states go through the output together: its work by class has a fixed part
    states, spots, held = _room("pooled", (POOL * WINDOW * place.shape[1], HIDDEN + 1), h.dtype), [], 0
    for a in range(0, len(place), WINDOW):
        on = int((place[a] >= 0).sum())  # lanes end in order
        p = place[a : a + WINDOW, :on]
        at_p = np.maximum(p, 0)
        before, last, _ = _steps(w, h[:on], tokens[at_p], begin[at_p])
        h[:on] = last
        live = np.flatnonzero(p.reshape(-1) >= 0)
        np.take(before.reshape(-1, HIDDEN + 1), live, axis=0, out=states[held : held + len(live)], mode="clip")
        spots.append(p.reshape(-1)[live])
        held += len(live)
        if len(spots) == POOL or a + WINDOW >= len(place):
            pooled, held, spots = np.concatenate(spots), 0, []
            out[pooled] = _output(w, classes, states[: len(pooled)], tokens[pooled], safe=safe)[0]
    out /= _LN10
    return out


class Training:
    """One shard's pass over documents that arrive in batches. Lanes read documents side by side, each
    from its first token to its last; a lane takes the next document where one ends, so a long document
    holds up no other lane."""

    def __init__(self, w: dict, classes: Classes, n_lanes: int, rate: float, expected: float):
        self.w, self.classes, self.rate, self.expected = {k: v.copy() for k, v in w.items()}, classes, rate, max(expected, 1.0)
        self.adam = Adam(self.w)
        self.queues: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool))] * n_lanes
        self.h = np.zeros((n_lanes, HIDDEN), np.float32)
        self.counts = np.zeros(classes.end + 1, np.int64)
        self.done = 0
        self.words_bounded: tuple[int, bool] | None = None

    def feed(self, tokens: np.ndarray, at: np.ndarray) -> None:
        """Documents, each of one token or more."""
        self.counts += np.bincount(tokens, minlength=len(self.counts))
        heap = [(len(q), i) for i, (q, _) in enumerate(self.queues)]
        heapq.heapify(heap)
        dealt: list[list[int]] = [[] for _ in heap]
        lengths = np.diff(at)
        for d in np.argsort(-lengths, kind="stable").tolist():
            size, i = heapq.heappop(heap)
            dealt[i].append(d)
            heapq.heappush(heap, (size + int(lengths[d]), i))
        begin = np.zeros(len(tokens), bool)
        begin[at[:-1]] = True
        for i, docs in enumerate(dealt):
            if docs:
                q, f = self.queues[i]
                self.queues[i] = np.concatenate([q, *(tokens[at[d] : at[d + 1]] for d in docs)]), np.concatenate([f, *(begin[at[d] : at[d + 1]] for d in docs)])
        ready = min(len(q) for q, _ in self.queues) // WINDOW * WINDOW
        if ready:
            rows, fresh = (np.stack([pair[x][:ready] for pair in self.queues], axis=1) for x in (0, 1))
            for a in range(0, ready, WINDOW):
                part = slice(a, a + WINDOW)
                self.h = self._window(self.h, rows[part], fresh[part], np.ones_like(fresh[part]))
            self.queues = [(q[ready:], f[ready:]) for q, f in self.queues]

    def finish(self) -> None:
        """What lanes still hold, the fullest first."""
        order = sorted(range(len(self.queues)), key=lambda i: -len(self.queues[i][0]))
        queues, h, at = [self.queues[i] for i in order], self.h[order], 0
        sizes = np.array([len(q) for q, _ in queues])
        while (on := int((sizes > at).sum())):
            wide = min(WINDOW, int(sizes[0]) - at)
            rows, fresh, live = np.zeros((wide, on), np.int64), np.zeros((wide, on), bool), np.zeros((wide, on), bool)
            for i, (q, f) in enumerate(queues[:on]):
                part = q[at : at + wide]
                rows[: len(part), i], fresh[: len(part), i], live[: len(part), i] = part, f[at : at + wide], True
            h[:on] = self._window(h[:on], rows, fresh, live)
            at += wide
        self.queues = [(np.zeros(0, np.int64), np.zeros(0, bool))] * len(queues)

    def _window(self, h: np.ndarray, tokens: np.ndarray, fresh: np.ndarray, live: np.ndarray) -> np.ndarray:
        n, last, grads, sparse = _window_gradients(self.w, self.classes, h, tokens, fresh, live, self.adam.words, self._bounded())
        # towards a tenth of the rate at the end; windows of few lanes step less
        rate = self.rate * (1 - 0.9 * min(1.0, self.done / self.expected)) * min(1.0, 4 * n / (WINDOW * len(self.queues)))
        self.adam.step(grads, *sparse, n, rate)
        self.done += n
        return last

    def _bounded(self) -> bool:
        """As ``bounded``; the words' part is worked out again only where they have stepped."""
        if self.words_bounded is None or self.words_bounded[0] != self.adam.word_steps:
            self.words_bounded = self.adam.word_steps, _words_bounded(self.w, self.classes)
        return self.words_bounded[1] and _classes_bounded(self.w, self.classes)


# --- words ---------------------------------------------------------------------------------------


def _words(flat: FlatText) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their last two bytes as a number, offsets by document."""
    start, length, at = flat.words()
    end = start + length
    last = flat.buf[end - 1].astype(np.int64) if len(end) else np.zeros(0, np.int64)
    before = np.where(length > 1, flat.buf[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return hash_spans(flat.buf, start, length), before * 256 + last, at


@dataclass
class Vocabulary:
    """Counts of the common words by sorted hash, symbols of all, and each tail class's normaliser."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # of the common words: place in the short list, or -1
    suffix_class: np.ndarray
    tail_norm: np.ndarray  # log10(N_k + V_k + 1)
    classes: Classes
    total: int
    distinct: int
    ends: int

    @cached_property
    def _begins(self) -> tuple[np.ndarray, np.uint64]:
        """Where hashes with each value of the leading bits begin, and the shift that leaves these bits; made in each process."""
        bits = max(1, int(len(self.hashes)).bit_length())
        shift = np.uint64(64 - bits)
        return np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift), shift

    def _spots(self, h: np.ndarray) -> np.ndarray:
        """The first hash that isn't smaller, or the last one: a step or two from where the leading bits begin, instead of a search."""
        begins, shift = self._begins
        last = len(self.hashes) - 1
        spot = np.minimum(begins[(h >> shift).astype(np.int64)], last)
        late = np.flatnonzero(self.hashes[spot] < h)
        while len(late):
            late = late[spot[late] < last]
            spot[late] += 1
            late = late[self.hashes[spot[late]] < h[late]]
        return spot

    def look_up(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and its count or -1 if it isn't common."""
        tail = self.classes.short + self.suffix_class[suffix]
        if not len(self.hashes):
            return tail, np.full(len(h), -1, np.int64)
        spot = self._spots(h)
        hit = self.hashes[spot] == h
        symbol = np.where(hit, self.symbols[spot], -1)
        return np.where(symbol >= 0, symbol, tail), np.where(hit, self.counts[spot], -1)


def _with_ends(values: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(values, at[1:], end), at + np.arange(len(at))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, suffix, c over all texts; what a batch holds is summed before it is dealt out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_words(flat)[:2] for _, _, flat in flat_chunks(batch.column(0), lower=True)]
            if parts:
                h, suffix = (np.concatenate(x) for x in zip(*parts, strict=True))
                code, distinct = pd.factorize(h)
                ending = np.empty(len(distinct), np.int32)
                ending[code] = suffix
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(ending), pa.array(np.bincount(code, minlength=len(distinct)))], ["h", "suffix", "c"])

    return docs.select("text").mapInArrow(work, "h long, suffix int, c long").groupBy("h").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c"))


def build_vocabulary(counted: DataFrame, n_docs: int) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of its common words."""
    sizes = sorted(((r.c, r.n) for r in counted.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    words, tokens = sum(n for _, n in sizes), sum(c * n for c, n in sizes)
    short = min(words, int(np.sqrt(tokens + n_docs)))
    least, held = 1 << 62, 0
    for c, n in sizes:
        if held + n > max(COMMON_WORDS, 2 * short):
            break
        least, held = c, held + n
    table = counted.where(F.col("c") >= least).select("h", "suffix", "c").toArrow()
    h, suffix, c = (table.column(k).to_numpy() for k in ("h", "suffix", "c"))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, suffix, c = h[order], suffix[order], c[order]
    top = np.lexsort((h, -c))[:short]
    symbols = np.full(len(h), -1, np.int64)
    symbols[top] = np.arange(len(top))
    by_suffix = counted.groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tail_c, tail_n = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for r in by_suffix:
        tail_c[r.suffix], tail_n[r.suffix] = r.c, r.n
    np.subtract.at(tail_c, suffix[top], c[top])
    np.subtract.at(tail_n, suffix[top], 1)
    suffix_class = np.full(65536, TAIL_CLASSES - 1, np.int64)
    leading = np.lexsort((np.arange(65536), -tail_c))[: TAIL_CLASSES - 1]
    suffix_class[leading] = np.arange(TAIL_CLASSES - 1)
    norm = np.bincount(suffix_class, tail_c + tail_n, TAIL_CLASSES) + 1
    vocabulary = Vocabulary(h, c, symbols, suffix_class, np.log10(norm), Classes.by_frequency(c[top]), tokens + n_docs, words + (n_docs > 0), n_docs)
    return vocabulary, least


_CODED = "doc_id long, held_out boolean, shard int, u long, n_tokens long, n_known long, base double, tail double, rare array<long>, tokens array<int>"


def coded(docs: DataFrame, shared) -> DataFrame:
    """Per document its symbols, and what the vocabulary says of its words: tokens, known ones, sums of logs, words that aren't common."""

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        end_log = np.log10(known.ends + 1.0)
        for batch in batches:
            for a, b, flat in flat_chunks(batch.column(4), lower=True):
                h, suffix, at = _words(flat)
                symbol, count = known.look_up(h, suffix)
                doc, common = np.repeat(np.arange(flat.n), np.diff(at)), count >= 0
                logs = np.where(common, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                in_tail = np.where(symbol >= known.classes.short, logs - known.tail_norm[np.maximum(symbol - known.classes.short, 0)], 0.0)
                tokens, ends = _with_ends(symbol, at, known.classes.end)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for c in batch.columns[:4]),
                        pa.array(np.diff(ends)),
                        pa.array(np.bincount(doc, common & (count > 0), flat.n).astype(np.int64) + (known.ends > 0)),
                        pa.array(np.bincount(doc, logs, flat.n) + float(end_log)),
                        pa.array(np.bincount(doc, in_tail, flat.n).astype(float)),
                        lists(h[~common].view(np.int64), np.bincount(doc[~common], minlength=flat.n)),
                        lists(tokens.astype(np.int32), np.diff(ends)),
                    ],
                    [f.split()[0] for f in _CODED.split(", ")],
                )

    return docs.mapInArrow(work, _CODED)


def _token_lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All lists in one array, and their offsets in it."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy().astype(np.int64), at - at[0]


def _flatten(w: dict) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def shards_of(vocabulary: Vocabulary) -> int:
    return max(1, int(np.sqrt(vocabulary.total) / SHARD_ROOT))


def by_shard(texts: DataFrame, n_shards: int) -> DataFrame:
    """A partition for each shard, in the order of learning. Ranges of a sample would put two shards in one task now and then."""
    return texts.repartitionById(n_shards, "shard").sortWithinPartitions("shard", F.size("tokens") <= LONG, "u")


def fit_network(texts: DataFrame, vocabulary: Vocabulary) -> tuple[dict, int]:
    """The weights after all rounds, and the tokens that they learnt from. ``texts``: shard, u, tokens of all training documents."""
    spark, classes, n_shards = texts.sparkSession, vocabulary.classes, shards_of(vocabulary)
    listed = np.flatnonzero(vocabulary.symbols >= 0)
    word_c = np.zeros(classes.short)
    word_c[vocabulary.symbols[listed]] = vocabulary.counts[listed]
    w = new_weights(classes, word_c, 10.0**vocabulary.tail_norm, vocabulary.ends)
    learnt, begin = 0, 0.0
    for end, rate in ROUNDS:
        expected = vocabulary.total * (end - begin) / n_shards
        n_lanes = int(np.clip(expected / WINDOW / UPDATES, *LANES))
        sent = spark.sparkContext.broadcast(w)

        def trained(batches: Iterator[pa.RecordBatch], sent=sent, n_lanes=n_lanes, rate=rate, expected=expected) -> Iterator[pa.RecordBatch]:
            now, shard = None, -1

            def changes() -> Iterator[pa.RecordBatch]:
                # a symbol's row weighs as often as the shard has it, all else as the shard has tokens
                now.finish()
                n = int(now.counts.sum())
                moved = {k: (now.w[k] - sent.value[k]) * (now.counts[:, None] if k == "x" else n) for k in now.w}
                flat = np.concatenate([[n], now.counts, _flatten(moved)])
                parts = [flat[a : a + SLICE].astype(np.float32).tobytes() for a in range(0, len(flat), SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), shard, np.int32)), pa.array(parts, pa.binary())], ["slice", "shard", "part"])

            for batch in batches:
                of, (flat, ends) = batch.column(0).to_numpy(), _token_lists(batch.column(2))
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    if of[a] != shard:
                        if now is not None:
                            yield from changes()
                        now, shard = Training(sent.value, classes, n_lanes, rate, expected), int(of[a])
                    while a < b:
                        stop = min(b, max(a + 1, int(np.searchsorted(ends, ends[a] + FEED))))
                        now.feed(flat[ends[a] : ends[stop]], ends[a : stop + 1] - ends[a])
                        a = stop
            if now is not None:
                yield from changes()

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    part = np.frombuffer(raw.as_buffer(), np.float32)
                    total[k] = total[k] + part if k in total else part.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "part"])

        due = (F.col("u") >= int(begin * (1 << 40))) & (F.col("u") < int(end * (1 << 40)))
        begin = end
        mine = by_shard(texts.where(due), n_shards)
        parts = mine.mapInArrow(trained, "slice int, shard int, part binary").repartition(F.col("slice")).sortWithinPartitions("slice", "shard")
        sums = sorted(parts.mapInArrow(added, "slice int, part binary").collect(), key=lambda r: r["slice"])
        sent.unpersist()
        if not sums:
            continue
        flat = np.concatenate([np.frombuffer(r["part"]) for r in sums])
        tokens, counts, flat = int(flat[0]), np.maximum(flat[1 : classes.end + 2], 1), flat[classes.end + 2 :]
        learnt, at = learnt + tokens, 0
        for k in sorted(w):
            moved = flat[at : at + w[k].size].reshape(w[k].shape)
            at += w[k].size
            w[k] = (w[k] + moved / (counts[:, None] if k == "x" else max(tokens, 1))).astype(np.float32)
    return w, learnt


def score_documents(df: DataFrame, held_out: Column | None = None, folds: int = 7, fold: int = 2, seed: int = 9) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows not held out."""
    held_out = crc_mod("doc_id", folds) == fold if held_out is None else held_out
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    train_docs = docs.where(~F.col("held_out"))
    n_docs = train_docs.count()
    counted = scratch(word_counts(train_docs), "lm-counts")
    vocabulary, least = build_vocabulary(counted, n_docs)
    spark = df.sparkSession
    drawn = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.monotonically_increasing_id()), "text")
    shard = F.pmod(drawn, F.lit(shards_of(vocabulary))).cast("int")
    keyed = docs.select("doc_id", "held_out", shard.alias("shard"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), drawn), 24).alias("u"), "text")
    rows = scratch(coded(keyed, spark.sparkContext.broadcast(vocabulary)).withColumn("row", F.monotonically_increasing_id()), "lm-rows", "snappy")
    weights = spark.sparkContext.broadcast(fit_network(rows.where(~F.col("held_out")).select("shard", "u", "tokens"), vocabulary)[0])
    classes = vocabulary.classes
    log_all = float(np.log10(vocabulary.total + vocabulary.distinct + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at = _token_lists(batch.column(0))
            net = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), token_scores(weights.value, classes, tokens, at), len(at) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(net.astype(float))], [*batch.schema.names[1:], "net"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail"]
    scored = rows.select("tokens", *kept).mapInArrow(work, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, net double")
    asked = rows.select("row", F.explode("rare").alias("h"))
    found = asked.join(counted.where(F.col("c") < least).select("h", "c"), "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    joined = scored.join(found, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(log_all)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("net") + F.col("tail") + logs if n_docs else base).alias("score"),
    )
