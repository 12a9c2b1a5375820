"""A linear-chain conditional random field over hashed features: fitting by likelihood, decoding of one long chain by Viterbi in blocks."""

from __future__ import annotations

import numpy as np

#: Labels: outside, begin, inside.
O, B, I = 0, 1, 2
LABELS = 3
NEVER = -1e9
#: Steps of the chain that a block holds.
BLOCK = 64


class Model:
    """weights: a table (values, LABELS) for each group of features; step: from label to label; first: at the beginning of a sequence."""

    def __init__(self, sizes: list[int]) -> None:
        self.weights = [np.zeros((n, LABELS), np.float32) for n in sizes]
        self.step, self.first = np.zeros((LABELS, LABELS)), np.zeros(LABELS)
        self.step[O, I] = self.first[I] = NEVER

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        """The scores of each token's labels; features: for each group, the tokens' values."""
        out = np.zeros((len(features[0]), LABELS), np.float32)
        for table, values in zip(self.weights, features):
            out += table[values]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(emit: np.ndarray, step: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the log-likelihoods of windows, and its gradients by emit (windows, tokens, LABELS), step and first.

    labels: (windows, tokens), -1 for what lies outside the text: in front of a window's tokens or after them."""
    n, width, _ = emit.shape
    there = labels >= 0
    opens = there & ~np.concatenate([np.zeros((n, 1), bool), there[:, :-1]], axis=1)
    ahead, back = np.zeros((n, width, LABELS)), np.zeros((n, width, LABELS))
    for t in range(width):
        came = _logsum(ahead[:, t - 1, :, None] + step, 1) if t else np.zeros((n, LABELS))
        ahead[:, t] = np.where(opens[:, t, None], first, came) + emit[:, t]
        ahead[:, t] = np.where(there[:, t, None], ahead[:, t], 0.0)
    goes = there[:, 1:] & there[:, :-1]
    for t in range(width - 2, -1, -1):
        back[:, t] = np.where(goes[:, t, None], _logsum(step[None] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0.0)
    whole = ahead + back
    total = _logsum(whole, 2)
    prob = np.where(there[:, :, None], np.exp(whole - total[:, :, None]), 0.0)
    gold = np.eye(LABELS)[np.maximum(labels, 0)] * there[:, :, None]
    pair = ahead[:, :-1, :, None] + step + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, 1:, None, None]
    pair = np.where(goes[:, :, None, None], np.exp(np.minimum(pair, 0)), 0.0)
    met = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    used = (gold * emit).sum() + (met * step).sum() + (gold * opens[:, :, None] * first).sum()
    return used - total[opens].sum(), gold - prob, (met - pair).sum((0, 1)), ((gold - prob) * opens[:, :, None]).sum((0, 1))


def fit(features: np.ndarray, labels: np.ndarray, sizes: list[int], epochs: int = 12, batch: int = 256, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """A model of windows: features (windows, tokens, groups) and labels (windows, tokens; -1 outside the text), by adaptive gradient steps over batches
    in a fixed random order. The same windows give the same model."""
    model, rng = Model(sizes), np.random.default_rng(1)
    begins = np.cumsum([0, *sizes[:-1]])
    flat = np.zeros((sum(sizes), LABELS))
    speed, speed_step, speed_first = np.full_like(flat, 1e-2), np.full((LABELS, LABELS), 1e-2), np.full(LABELS, 1e-2)
    open_step, open_first = model.step > NEVER, model.first > NEVER
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            values = features[some] + begins
            _, g, g_step, g_first = likelihood(flat[values].sum(axis=2), model.step, model.first, labels[some])
            met, where = np.unique(values, return_inverse=True)
            rows = np.repeat(g.reshape(-1, LABELS), values.shape[2], axis=0)
            slope = np.stack([np.bincount(where.ravel(), rows[:, k], len(met)) for k in range(LABELS)], axis=1) - decay * len(some) * flat[met]
            for table, gain, to in ((flat, slope, met), (model.step, g_step * open_step, slice(None)), (model.first, g_first * open_first, slice(None))):
                pace = speed if table is flat else speed_step if table is model.step else speed_first
                pace[to] += gain * gain
                table[to] += rate * gain / np.sqrt(pace[to])
    model.weights = [flat[a : a + n].astype(np.float32) for a, n in zip(begins, sizes)]
    return model


class Chain:
    """Viterbi over sequences that follow one another, of any length: blocks of BLOCK tokens are solved at once for each label they may be entered with,
    and joined in order. add() takes the tokens piece by piece; of those nothing but back pointers is kept."""

    def __init__(self, model: Model) -> None:
        self.model, self.n = model, 0
        self.backs: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []

    def add(self, emit: np.ndarray, opens: np.ndarray) -> None:
        """Scores of the next tokens and whether a sequence begins there. All pieces but the last hold whole blocks."""
        if self.n % BLOCK:
            raise ValueError("a piece before the last one holds a part of a block")
        self.n += len(emit)
        count = -(-len(emit) // BLOCK)
        scores = np.zeros((count * BLOCK, LABELS), np.float32)
        scores[len(emit) :, 1:] = NEVER
        scores[: len(emit)] = emit
        begins = np.ones(count * BLOCK, bool)  # what fills the last block is a sequence of its own
        begins[: len(opens)] = opens
        scores, begins = scores.reshape(count, BLOCK, LABELS), begins.reshape(count, BLOCK)
        step, first = self.model.step.astype(np.float32), self.model.first.astype(np.float32)
        at = lambda t: np.where(begins[:, t, None, None], first, step)  # noqa: E731  by block, from label, to label
        now = at(0) + scores[:, 0, None, :]
        back = np.zeros((count, BLOCK, LABELS, LABELS), np.int8)
        for t in range(1, BLOCK):
            moves = now[:, :, :, None] + at(t)[:, None]
            best = moves.argmax(axis=2)
            back[:, t] = best
            now = np.take_along_axis(moves, best[:, :, None, :], axis=2)[:, :, 0] + scores[:, t, None, :]
        self.backs.append(back)
        self.blocks.append(now)

    def labels(self) -> np.ndarray:
        """The best labels of all tokens."""
        if not self.n:
            return np.zeros(0, np.int64)
        score, came = [0.0, NEVER, NEVER], []
        for block in np.concatenate(self.blocks).astype(np.float64).tolist():
            ways = [max((score[i] + block[i][j], -i) for i in range(LABELS)) for j in range(LABELS)]
            came.append([-w[1] for w in ways])
            top = max(w[0] for w in ways)
            score = [w[0] - top for w in ways]
        last = max(range(LABELS), key=lambda j: score[j])
        enter, leave = np.zeros(len(came), np.int64), np.zeros(len(came), np.int64)
        for b in range(len(came) - 1, -1, -1):
            leave[b], enter[b] = last, came[b][last]
            last = came[b][last]
        back, row = np.concatenate(self.backs), np.arange(len(came))
        out = np.zeros((len(came), BLOCK), np.int64)
        out[:, -1] = leave
        for t in range(BLOCK - 1, 0, -1):
            out[:, t - 1] = back[row, t, enter, out[:, t]]
        return out.ravel()[: self.n]
