"""A gated recurrent network over word ids with a class-factored softmax, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """``words`` ids have words of their own, ``tails`` more ids stand for classes of rare words.

    ``group`` words make a class of the output; a rare-word class is a class without words.
    """

    words: int
    tails: int
    group: int = 64
    width: int = 32

    @property
    def groups(self) -> int:
        return -(-self.words // self.group)

    @property
    def classes(self) -> int:
        return self.groups + self.tails

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // self.group, ids - self.words + self.groups)

    def sizes(self) -> list[tuple[str, tuple[int, ...]]]:
        w = self.width
        return [
            ("embed", (self.words + self.tails, w)), ("enter", (w, 3 * w)), ("lean", (3 * w,)), ("turn", (w, 3 * w)),
            ("class", (w, self.classes)), ("class_lean", (self.classes,)), ("word", (self.words, w)), ("word_lean", (self.words,)),
        ]


Weights = dict[str, np.ndarray]


def fresh(shape: Shape, frequencies: np.ndarray, seed: int) -> Weights:
    """Small random weights; the biases start at the log frequencies of classes and words."""
    rng = np.random.default_rng(seed)
    weights = {name: (rng.standard_normal(size) * 0.1).astype(np.float32) for name, size in shape.sizes()}
    ids = np.arange(shape.words + shape.tails)
    totals = np.bincount(shape.classes_of(ids), weights=frequencies + 0.5, minlength=shape.classes)
    weights["lean"][:] = 0
    weights["class_lean"] = np.log(totals / totals.sum()).astype(np.float32)
    weights["word_lean"] = np.log((frequencies[: shape.words] + 0.5) / totals[ids[: shape.words] // shape.group]).astype(np.float32)
    return weights


def packed(weights: Weights, shape: Shape) -> bytes:
    return b"".join(weights[name].astype(np.float32).tobytes() for name, _ in shape.sizes())


def unpacked(raw: bytes, shape: Shape) -> Weights:
    flat, weights, at = np.frombuffer(raw, np.float32), {}, 0
    for name, size in shape.sizes():
        count = int(np.prod(size))
        weights[name] = flat[at : at + count].reshape(size).copy()
        at += count
    return weights


def blocks(matrix: np.ndarray) -> np.ndarray:
    """Columns of a gated unit as three matrices, one behind the other: what enters a gate lies together."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), 3, -1).transpose(1, 0, 2))


def gated(entered: np.ndarray, state: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit on blocks: the new state, and what the way back needs."""
    turned = state @ turn
    gates = entered[:2] + turned[:2]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    keep, reset = gates
    new = reset * turned[2]
    new += entered[2]
    np.tanh(new, out=new)
    after = state - new
    after *= keep
    after += new
    return after, keep, reset, new, turned[2]


def step(entered: np.ndarray, state: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """``gated`` on matrices with the gates' columns side by side."""
    return gated(blocks(entered), state, blocks(turn))


def bounded(weights: np.ndarray, lean: np.ndarray) -> bool:
    """Whether no state within 1 can make a logit that exp() overflows or loses."""
    return bool((np.abs(weights).sum(axis=0) + np.abs(lean)).max(initial=0) < 60)


def log_chances(states: np.ndarray, ids: np.ndarray, weights: Weights, shape: Shape, back: Weights | None = None, piece: int = 1024) -> tuple[np.ndarray, np.ndarray | None]:
    """ln P(id | state) for each row: of the class, and of the word in it where the class has words.

    With ``back``, gradients of minus their mean are added to it, and those of the states returned.
    Rows are put in the order of their classes, and ``piece`` of them at a time stay in the processor's cache.
    """
    rows = len(ids)
    kinds = shape.classes_of(ids)
    order = np.argsort(kinds.astype(np.int16), kind="stable")
    ids, kinds, states = ids[order], kinds[order], states[order]
    found = np.empty(rows, states.dtype)
    pull = None if back is None else np.empty_like(states)
    one = states.dtype.type(1)

    def softmax(low: int, high: int, matrix: np.ndarray, lean: np.ndarray, places: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray]:
        """ln of the shares of ``places``, and the gradients of the logits where they are wanted."""
        logits = states[low:high] @ matrix
        logits += lean
        if shift:
            logits -= logits.max(axis=1, keepdims=True)
        at = np.arange(high - low)
        picked = logits[at, places]
        np.exp(logits, out=logits)
        totals = logits @ np.ones(logits.shape[1], logits.dtype)
        if back is not None:
            logits *= (one / (totals * rows))[:, None]
            logits[at, places] -= one / rows
        return picked - np.log(totals), logits

    # States lie within 1, so a bound on the logits is known, and only large ones need a shift.
    shift, turned = not bounded(weights["class"], weights["class_lean"]), np.ascontiguousarray(weights["class"].T)
    for low in range(0, rows, piece):
        high = min(low + piece, rows)
        found[low:high], logits = softmax(low, high, weights["class"], weights["class_lean"], kinds[low:high], shift)
        if back is not None:
            back["class"] += states[low:high].T @ logits
            back["class_lean"] += np.ones(high - low, logits.dtype) @ logits
            np.matmul(logits, turned, out=pull[low:high])
    shift = not bounded(weights["word"].T, weights["word_lean"])
    ends = np.searchsorted(kinds, np.arange(shape.groups + 1))
    for group in range(shape.groups):
        first, last = group * shape.group, min((group + 1) * shape.group, shape.words)
        matrix, lean = weights["word"][first:last], weights["word_lean"][first:last]
        for low in range(ends[group], ends[group + 1], piece):
            high = min(low + piece, ends[group + 1])
            told, inner = softmax(low, high, matrix.T, lean, ids[low:high] - first, shift)
            found[low:high] += told
            if back is not None:
                back["word"][first:last] += inner.T @ states[low:high]
                back["word_lean"][first:last] += np.ones(high - low, inner.dtype) @ inner
                pull[low:high] += inner @ matrix
    given = np.empty_like(found)
    given[order] = found
    if pull is not None:
        pulls = np.empty_like(pull)
        pulls[order] = pull
        pull = pulls
    return given, pull


def score(texts: list[np.ndarray], start: int, weights: Weights, shape: Shape, buffer: int = 16_384, together: int = 512) -> np.ndarray:
    """ln P of each id sequence, whole; the state goes on from window to window to a sequence's end.

    ``together`` sequences of like length take a step together, the longest first, so those that have ended drop
    off the end.  States wait until there are enough of them for one pass through the softmax.
    """
    order = np.argsort([-len(text) for text in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    total = np.zeros(len(texts))
    entered, turn = blocks(weights["embed"] @ weights["enter"] + weights["lean"]), blocks(weights["turn"])
    states, wanted, owners, held = [], [], [], 0

    def flush() -> None:
        if held:
            found, _ = log_chances(np.concatenate(states), np.concatenate(wanted), weights, shape)
            total[:] += np.bincount(np.concatenate(owners), found, len(total))

    for first in range(0, int((lengths > 0).sum()), together):
        mine, sizes = order[first : first + together], lengths[first : first + together]
        flat = np.concatenate([texts[i] for i in mine])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        state = np.zeros((len(mine), shape.width), np.float32)
        before = np.full(len(mine), start)
        active = int((sizes > 0).sum())
        for at in range(int(sizes[0])):
            while sizes[active - 1] <= at:
                active -= 1
            state = gated(entered.take(before[:active], axis=1), state[:active], turn)[0]
            before = flat[starts[:active] + at]
            states.append(state)
            wanted.append(before)
            owners.append(mine[:active])
            held += active
            if held >= buffer:
                flush()
                states, wanted, owners, held = [], [], [], 0
    flush()
    return total


class Trainer:
    """Adam on truncated backpropagation through time."""

    def __init__(self, weights: Weights, shape: Shape, rate: float) -> None:
        self.weights, self.shape, self.rate, self.seen = weights, shape, rate, 0
        self.mean = {name: np.zeros_like(value) for name, value in weights.items()}
        self.spread = {name: np.zeros_like(value) for name, value in weights.items()}

    def update(self, back: Weights) -> None:
        self.seen += 1
        norm = float(np.sqrt(sum(float(np.vdot(value, value)) for value in back.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.98**self.seen) / (1 - 0.9**self.seen)
        for name, pull in back.items():
            # In place, so that nothing is written that is not read again at once.
            mean, spread = self.mean[name], self.spread[name]
            mean *= 0.9
            pull *= 0.1 * scale
            mean += pull
            np.multiply(pull, pull, out=pull)
            pull *= 0.02 / 0.1**2
            spread *= 0.98
            spread += pull
            np.sqrt(spread, out=pull)
            pull += 1e-8
            np.divide(mean, pull, out=pull)
            pull *= rate
            self.weights[name] -= pull

    def learn(self, ids: np.ndarray, start: int, window: int) -> float:
        """Steps over a matrix of sequences of one length, window by window; the state goes on, gradients stop.

        Gives the mean ln P of the ids before each step.
        """
        weights, shape = self.weights, self.shape
        width, rows = shape.width, len(ids)
        state = np.zeros((rows, width), np.float32)
        before, told = np.full(rows, start), 0.0
        # Time comes first, so that what a step reads lies together.
        ids = np.ascontiguousarray(ids.T)
        for low in range(0, len(ids), window):
            part = ids[low : low + window]
            inputs = np.concatenate([before[None], part[:-1]])
            turn, enter = blocks(weights["turn"]), blocks(weights["enter"])
            entered = (weights["embed"] @ enter + weights["lean"].reshape(3, 1, width)).take(inputs, axis=1)
            trace, states = [], [state]
            for at in range(len(part)):
                found = gated(entered[:, at], states[-1], turn)
                states.append(found[0])
                trace.append(found[1:])
            back = {name: np.zeros_like(value) for name, value in weights.items()}
            held = np.concatenate(states)
            chances, pull = log_chances(held[rows:], part.reshape(-1), weights, shape, back)
            told += float(chances.sum())
            pull = pull.reshape(len(part), rows, width)
            onward, turned_back = np.zeros((rows, width), np.float32), np.ascontiguousarray(turn.transpose(0, 2, 1))
            entering, turning = np.empty_like(entered), np.empty_like(pull)
            for at in reversed(range(len(part))):
                keep, reset, new, turned = trace[at]
                down, into, scaled = pull[at] + onward, entering[:, at], turning[at]
                onward = down * keep
                down -= onward
                np.multiply(down, keep, out=into[0])
                into[0] *= states[at] - new
                np.multiply(new, new, out=new)
                np.subtract(1, new, out=new)
                np.multiply(down, new, out=into[2])
                np.multiply(into[2], reset, out=scaled)
                np.multiply(scaled, turned, out=into[1])
                into[1] *= 1 - reset
                onward += into[0] @ turned_back[0]
                onward += into[1] @ turned_back[1]
                onward += scaled @ turned_back[2]
            flat, read = entering.reshape(3, -1, width), inputs.reshape(-1)
            earlier, embedded = held[:-rows].T, weights["embed"][read].T
            back["turn"] += np.concatenate([earlier @ flat[0], earlier @ flat[1], earlier @ turning.reshape(-1, width)], axis=1)
            back["enter"] += np.concatenate(list(embedded @ flat), axis=1)
            back["lean"] += (np.ones(len(read), flat.dtype) @ flat).reshape(-1)
            # Of the rows that read one id, gradients add up.
            pulled = enter[0] @ flat[0].T + enter[1] @ flat[1].T + enter[2] @ flat[2].T
            for place, column in enumerate(pulled):
                back["embed"][:, place] = np.bincount(read, column, len(back["embed"]))
            self.update(back)
            state, before = states[-1], part[-1]
        return told / ids.size
