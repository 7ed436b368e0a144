"""A gated recurrent language model with class-factored output, in numpy.

Symbols are the frequent words, in classes of neighbouring frequency; all other
words are one class of their own, and neighbouring classes form groups.  A word's
probability is that of its group given the state, times that of the class in the
group, times that of the word in the class.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

F32 = np.float32
#: Widths of the state and of a symbol's input.
HIDDEN, EMBED = 24, 16
#: Bound of a logit either way.
LIMIT = F32(60)


@dataclass(frozen=True)
class Classes:
    """Symbols 0..n-1 by falling count; class c holds symbols ``edges[c]`` to ``edges[c + 1]``.

    Symbol n stands for every rarer word and is the last class; n + 1 starts a text.
    """

    counts: np.ndarray
    rest: float
    edges: np.ndarray = field(init=False)
    of: np.ndarray = field(init=False)
    #: Group g holds classes ``groups[g]`` to ``groups[g + 1]``.
    groups: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.counts)
        share = np.cumsum(np.sqrt(self.counts))
        wanted = max(1, int(np.sqrt(n)))
        of = np.minimum((share / share[-1] * wanted).astype(int), wanted - 1) if n else np.empty(0, int)
        of = np.unique(of, return_inverse=True)[1] if n else of
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [n]]) if n else np.zeros(1, int)
        object.__setattr__(self, "edges", edges.astype(int))
        object.__setattr__(self, "of", np.concatenate([of, [len(edges) - 1]]).astype(int))
        object.__setattr__(self, "groups", np.linspace(0, len(edges), int(np.sqrt(len(edges))) + 1).astype(int))

    @property
    def n(self) -> int:
        return len(self.counts)


SHAPES = ("embed", "enter", "loop", "bias", "group_w", "group_b", "class_w", "class_b", "word_w", "word_b")


def initial(classes: Classes, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output biases start at the counted frequencies."""
    rng = np.random.default_rng(seed)
    n, kinds, groups = classes.n, len(classes.edges), len(classes.groups) - 1
    mass = np.add.reduceat(classes.counts, classes.edges[:-1]) if n else np.empty(0)
    mass = np.concatenate([mass, [classes.rest]]) + 0.1
    grouped = np.add.reduceat(mass, classes.groups[:-1])
    words = np.log((classes.counts + 0.1) / (mass[classes.of[:-1]] if n else 1))
    draw = lambda scale, *s: (rng.standard_normal(s) * scale).astype(F32)
    return {
        "embed": draw(0.3, n + 2, embed), "enter": draw(0.3, embed, 3 * hidden), "loop": draw(0.1, hidden, 3 * hidden),
        "bias": np.concatenate([np.full(hidden, 1.0), np.zeros(2 * hidden)]).astype(F32),
        "group_w": np.zeros((groups, hidden), F32), "group_b": np.log(grouped / grouped.sum()).astype(F32),
        "class_w": np.zeros((kinds, hidden), F32),
        "class_b": np.log(mass / np.repeat(grouped, np.diff(classes.groups))).astype(F32),
        "word_w": np.zeros((n, hidden), F32), "word_b": words.astype(F32),
    }


def _softmax(logits: np.ndarray, y: np.ndarray, slopes: bool) -> np.ndarray:
    """Log probability of each target; a column of ``logits`` is a token.

    ``logits`` become the slopes of the negative log probability, if asked for.
    They are held within ``LIMIT``, far above what the state can add to a bias, so
    that nothing overflows.
    """
    np.maximum(logits, -LIMIT, out=logits)
    np.minimum(logits, LIMIT, out=logits)
    flat, at = logits.reshape(-1), y * len(y) + np.arange(len(y))
    own = flat.take(at)
    np.exp(logits, out=logits)
    total = np.add.reduce(logits, 0)
    if slopes:
        logits *= 1 / total
        flat[at] -= 1
    return own - np.log(total)


def _step(w: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """State after one symbol, the two gates, the new part, and what the second gate lets through."""
    size = h.shape[1]
    inner = h @ w["loop"]
    inner += w["bias"]
    gates = x[:, : 2 * size] + inner[:, : 2 * size]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    keep, reset, past = gates[:, :size], gates[:, size:], inner[:, 2 * size :]
    new = reset * past
    new += x[:, 2 * size :]
    np.tanh(new, out=new)
    after = h - new
    after *= keep
    after += new
    return after, keep, reset, new, past


def _inside(
    w: dict, level: str, edges: np.ndarray, parents: np.ndarray, own: np.ndarray,
    h: np.ndarray, logp: np.ndarray, back: np.ndarray, grad: dict | None,
) -> None:
    """Add the log probability of each target within its parent; targets are in order of their parents."""
    weights, biases = w[f"{level}_w"], w[f"{level}_b"]
    cut = np.searchsorted(parents, np.arange(len(edges)))
    for c in range(len(edges) - 1):
        lo, hi, at, to = edges[c], edges[c + 1], cut[c], cut[c + 1]
        if hi - lo > 1 and to > at:
            d = weights[lo:hi] @ h[at:to].T
            d += biases[lo:hi, None]
            logp[at:to] += _softmax(d, own[at:to] - lo, grad is not None)
            if grad is not None:
                np.matmul(d, h[at:to], out=grad[f"{level}_w"][lo:hi])
                np.add.reduce(d, 1, out=grad[f"{level}_b"][lo:hi])
                back[at:to] += d.T @ weights[lo:hi]


def _output(w: dict, classes: Classes, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each target, and the gradient of its negative sum for the states if asked for."""
    kind = classes.of[y]
    order = np.argsort(kind.astype(np.int16), kind="stable")  # at most 65 classes: a radix sort
    h, y, kind = h.take(order, 0), y.take(order), kind.take(order)
    group = np.repeat(np.arange(len(classes.groups) - 1), np.diff(classes.groups))[kind]
    d = w["group_w"] @ h.T
    d += w["group_b"][:, None]
    logp = _softmax(d, group, grad is not None).astype(np.float64)
    back = h
    if grad is not None:
        grad["group_w"], grad["group_b"] = d @ h, d.sum(1)
        back = d.T @ w["group_w"]
    _inside(w, "class", classes.groups, group, kind, h, logp, back, grad)
    _inside(w, "word", classes.edges, kind, y, h, logp, back, grad)
    out, unsorted = np.empty_like(logp), np.empty_like(back)
    out[order], unsorted[order] = logp, back
    return out, unsorted


def _lockstep(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length, their lengths, and the symbols end to end with offsets."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    return order, sizes[order], np.concatenate([[0], np.cumsum(sizes[order])[:-1]])


def scores(w: dict, classes: Classes, texts: Sequence[np.ndarray], window: int = 1 << 14) -> np.ndarray:
    """Natural log probability of each whole text.

    Texts run side by side, each with its state from its first symbol to its
    last.  Outputs are computed for at least ``window`` symbols at a time, so the
    long texts that go on alone do so in long windows.
    """
    out = np.zeros(len(texts))
    order, sizes, offset = _lockstep(texts)
    if not len(texts) or not sizes.sum():
        return out
    flat = np.concatenate([texts[i] for i in order])
    h = np.zeros((len(texts), w["loop"].shape[0]), F32)
    last = np.full(len(texts), classes.n + 1)
    enters = w["embed"] @ w["enter"]
    # How many texts are longer than t.
    lives = len(texts) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), side="right")
    states, targets, owners, held = [], [], [], 0
    for t, live in enumerate(lives.tolist()):
        h = _step(w, enters.take(last[:live], 0), h[:live])[0]
        last = flat.take(offset[:live] + t)
        states.append(h)
        targets.append(last)
        owners.append(order[:live])
        held += live
        if held >= window or t + 1 == len(lives):
            logp = _output(w, classes, np.concatenate(states), np.concatenate(targets))[0]
            out += np.bincount(np.concatenate(owners), logp, minlength=len(texts))
            states, targets, owners, held = [], [], [], 0
    return out


def _rows_sum(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # symbols are few: a radix sort
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values.take(order, 0), first)


def _lanes(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to at most ``lanes`` lanes, the longest first and each to the shortest lane; lanes by falling length."""
    heap = [(0, k) for k in range(min(lanes, int((sizes > 0).sum())))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        if sizes[i]:
            n, k = heap[0]
            out[k].append(i)
            heapq.heapreplace(heap, (n + int(sizes[i]), k))
    return [out[k] for _, k in sorted(heap, key=lambda x: (-x[0], x[1]))]


def train(
    w: dict,
    classes: Classes,
    texts: Sequence[np.ndarray],
    squares: dict,
    window: int = 24,
    rate: float = 0.05,
    lanes: int = 1 << 30,
) -> int:
    """Truncated backpropagation through windows of all lanes side by side; Adagrad steps in place.

    A lane holds whole texts one after the other.  The state runs through a text
    from its first token to its last, and starts anew with the next text.
    Returns the number of tokens.  ``squares`` holds the summed squares of the gradients.
    """
    dealt = _lanes(np.array([len(t) for t in texts], np.int64), lanes)
    if not dealt:
        return 0
    flat = np.concatenate([texts[i] for own in dealt for i in own])
    inputs = np.concatenate([flat[:1], flat[:-1]])
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum([0] + [len(texts[i]) for own in dealt for i in own])[:-1]] = True
    inputs[begins] = classes.n + 1
    sizes = np.array([sum(len(texts[i]) for i in own) for own in dealt])
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    size = w["loop"].shape[0]
    h = np.zeros((len(dealt), size), w["loop"].dtype)
    for start in range(0, int(sizes[0]), window):
        lives = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(start, min(start + window, int(sizes[0])))]
        places = np.concatenate([offset[:n] + start + k for k, n in enumerate(lives)])
        symbols, y, fresh = inputs.take(places), flat.take(places), begins.take(places)
        shown = w["embed"].take(symbols, 0)
        x = shown @ w["enter"]
        edge = np.concatenate([[0], np.cumsum(lives)])
        tape = []
        for at, to in zip(edge[:-1], edge[1:], strict=True):
            new_text = np.flatnonzero(fresh[at:to])
            before = h[: to - at]
            if len(new_text):
                before = before.copy()
                before[new_text] = 0
            h, *rest = _step(w, x[at:to], before)
            tape.append((before, h, *rest))
        before, states, keep, reset, new, past = (np.concatenate(part) for part in zip(*tape, strict=True))
        grad = {k: np.zeros_like(w[k]) for k in ("class_w", "class_b", "word_w", "word_b")}
        _, slope = _output(w, classes, states, y, grad)
        # What a slope of the state becomes at the gates and at the new part, for the whole window.
        to_new = (1 - keep) * (1 - new * new)
        gain = np.empty((len(y), 3, size), keep.dtype)
        np.multiply((before - new) * keep, 1 - keep, out=gain[:, 0])
        np.multiply(to_new * past * reset, 1 - reset, out=gain[:, 1])
        np.multiply(to_new, reset, out=gain[:, 2])
        inside = np.empty_like(gain)
        flow, back_loop = np.zeros((0, size), keep.dtype), np.ascontiguousarray(w["loop"].T)
        for at, to in zip(edge[-2::-1], edge[:0:-1], strict=True):
            d = slope[at:to]
            d[: len(flow)] += flow
            np.multiply(d[:, None, :], gain[at:to], out=inside[at:to])
            flow = inside[at:to].reshape(to - at, 3 * size) @ back_loop
            flow += d * keep[at:to]
            flow[fresh[at:to]] = 0
        inner = inside.reshape(-1, 3 * size)
        grad["loop"], grad["bias"] = before.T @ inner, inner.sum(0)
        outer = inner.copy()
        np.multiply(slope, to_new, out=outer[:, 2 * size :])
        grad["enter"] = shown.T @ outer
        rows, values = _rows_sum(symbols, outer @ w["enter"].T)
        scale = F32(1 / max(np.sqrt(len(y)), 1))
        for k, g in grad.items():
            g *= scale
            below = g * g
            squares[k] += below
            np.sqrt(squares[k], out=below)
            below += 1e-6
            g *= rate
            g /= below
            w[k] -= g
        values *= scale
        squares["embed"][rows] += values * values
        w["embed"][rows] -= rate * values / (np.sqrt(squares["embed"][rows]) + 1e-6)
    return len(flat)


def pack(w: dict) -> bytes:
    return b"".join(np.ascontiguousarray(w[k], F32).tobytes() for k in SHAPES)


def unpack(blob: bytes, like: dict) -> dict:
    flat, at, out = np.frombuffer(blob, F32), 0, {}
    for k in SHAPES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def fresh_squares(w: dict) -> dict:
    return {k: np.full_like(v, 1e-3) for k, v in w.items()}


Scorer = Callable[[Sequence[np.ndarray]], np.ndarray]
