"""A small gated recurrent language model in numpy, with a class-factored output.

A token is a word of the vocabulary (ids below ``words``) or the class of a rarer word (ids from
``words`` on). The output is P(class | state) and, for a word of the vocabulary, P(word | class, state).
Classes of vocabulary words are runs of ids of about equal mass; what follows within the class of a
rarer word doesn't depend on the state and is left to the caller.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
#: Output logits are worked out for so many tokens at a time, which a processor's cache holds.
BLOCK = 2048
#: States are worked out for so many lanes at a time.
ABREAST = 512
FLOAT = np.float32


class Shape:
    """Which ids belong to which class. edges: the first id of each vocabulary class, and the number of words."""

    def __init__(self, edges: np.ndarray, rare_classes: int):
        self.edges = np.asarray(edges, np.int64)
        self.words = int(self.edges[-1])
        self.word_classes = len(self.edges) - 1
        self.classes = self.word_classes + rare_classes
        self.ids = self.words + rare_classes
        self.class_of = np.concatenate(
            [np.repeat(np.arange(self.word_classes), np.diff(self.edges)), self.word_classes + np.arange(rare_classes)]
        )


def start(shape: Shape, mass: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters that give the unigram distribution of ``mass`` (by id) whatever the state is."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    by_class = np.bincount(shape.class_of, mass, shape.classes)
    within = np.log(mass[: shape.words] / by_class[shape.class_of[: shape.words]])
    return {
        "x": rng.normal(0, 0.2, (shape.ids, 3 * h)).astype(FLOAT),
        "u": rng.normal(0, 0.25, (h, 3 * h)).astype(FLOAT),
        "b": np.concatenate([np.zeros(h), -np.ones(h), np.zeros(h)]).astype(FLOAT),
        # the last row of c and the last column of w are biases, for a state that ends with a one
        "c": np.concatenate([np.zeros((h, shape.classes)), np.log(by_class / by_class.sum())[None, :]]).astype(FLOAT),
        "w": np.concatenate([np.zeros((shape.words, h)), within[:, None]], axis=1).astype(FLOAT),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(FLOAT)
        at += like[k].size
    return out


def run(p: dict, inputs: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, back: bool = False):
    """States after each input of [steps, lanes], from ``h``; keep: 0 where a lane's state is reset before a step.

    Returns (states [steps, lanes, hidden], what ``gradients`` needs or None).
    """
    n = HIDDEN
    steps, lanes = inputs.shape
    u_gates, u_new = -p["u"][:, : 2 * n], np.ascontiguousarray(p["u"][:, 2 * n :])
    table = p["x"] + p["b"]
    table[:, : 2 * n] *= -1
    states = np.empty((steps, lanes, n), FLOAT)
    before, resets, updates, new = (np.empty_like(states) for _ in range(4)) if back else (None,) * 4
    # so many lanes at a time as a processor's cache holds; an exp that overflows makes a gate of 0, as it should
    with np.errstate(over="ignore"):
        for at in range(0, lanes, ABREAST):
            part = slice(at, at + ABREAST)
            given = table[inputs[:, part]]
            now = h[part]
            for t in range(steps):
                if keep is not None:
                    now = now * keep[t, part][:, None]
                g = now @ u_gates
                g += given[t, :, : 2 * n]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                r, z = g[:, :n], g[:, n:]
                c = (r * now) @ u_new
                c += given[t, :, 2 * n :]
                np.tanh(c, out=c)
                if back:
                    before[t, part], resets[t, part], updates[t, part], new[t, part] = now, r, z, c
                c -= now
                c *= z
                now = np.add(now, c, out=states[t, part])
    return states, (before, resets, updates, new) if back else None


def log_probabilities(p: dict, shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log P(class) + log P(word | class) of each target; the second is 0 for rare classes."""
    return outputs(p, shape, states, targets, None)[0]


def exponentials(logits: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """(sums of exp of logits, which it leaves in place; what was taken off them before), by row.

    small: no logit can be too large for exp. They are log-probabilities and a small change, so it holds almost always.
    """
    top = 0.0
    if not small:
        top = logits.max(1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype), top


def stable_order(values: np.ndarray, most: int) -> np.ndarray:
    """The stable order of whole numbers below ``most``; short ones are sorted by their digits."""
    return np.argsort(values.astype(np.int16) if most < 1 << 15 else values, kind="stable")


def outputs(p: dict, shape: Shape, states: np.ndarray, targets: np.ndarray, grads: dict | None):
    """(log-probabilities, gradient for the states); sets in ``grads`` the gradients of the output parameters.

    Gradients are of the summed log-probability.
    """
    classes = shape.class_of[targets]
    order = stable_order(classes, shape.classes)  # from here on tokens of a class stand together
    classes, targets = classes[order], targets[order]
    rows = np.arange(min(len(targets), BLOCK))
    ended = np.ones((len(targets), HIDDEN + 1), FLOAT)
    ended[:, :HIDDEN] = states[order]
    found = np.empty(len(targets), FLOAT)
    d_states = None
    if grads is not None:
        grads["c"], grads["w"] = np.zeros_like(p["c"]), np.zeros_like(p["w"])
        d_states = np.empty_like(ended)
    # states are within -1 and 1
    small_c = (np.abs(p["c"][:-1]).sum(0) + p["c"][-1]).max() < 60
    small_w = len(p["w"]) == 0 or (np.abs(p["w"][:, :-1]).sum(1) + p["w"][:, -1]).max() < 60
    for at in range(0, len(targets), BLOCK):
        part = slice(at, at + BLOCK)
        h, k = ended[part], classes[part]
        here = rows[: len(k)]
        logits = h @ p["c"]
        picked = logits[here, k]
        total, top = exponentials(logits, small_c)
        found[part] = picked - np.log(total) - top
        if grads is not None:
            logits *= (-1 / total)[:, None]
            logits[here, k] += 1
            grads["c"] += h.T @ logits
            np.matmul(logits, p["c"].T, out=d_states[part])
    cuts = np.searchsorted(classes, np.arange(shape.word_classes + 1)).tolist()
    edges = shape.edges.tolist()
    within = targets[: cuts[-1]] - shape.edges[classes[: cuts[-1]]]
    every, sums = np.arange(cuts[-1]), np.ones(cuts[-1], FLOAT)
    for k in range(shape.word_classes):
        mine = slice(cuts[k], cuts[k + 1])
        a, b = edges[k], edges[k + 1]
        if cuts[k] == cuts[k + 1] or b - a == 1:
            continue
        h = ended[mine]
        w = p["w"][a:b]
        inner = h @ w.T
        at, here = within[mine], every[: len(h)]
        found[mine] += inner[here, at]
        total, top = exponentials(inner, small_w)
        sums[mine] = total
        if not small_w:
            found[mine] -= top
        if grads is not None:
            inner *= (-1 / total)[:, None]
            inner[here, at] += 1
            np.matmul(inner.T, h, out=grads["w"][a:b])
            d_states[mine] += inner @ w
    found[: cuts[-1]] -= np.log(sums)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return found[back], None if d_states is None else d_states[back, :HIDDEN]


def gradients(p: dict, shape: Shape, inputs, targets, h, keep) -> tuple[dict, np.ndarray, np.ndarray]:
    """(gradients of the summed log-probability, log-probabilities, last state): back-propagation within the window."""
    n = HIDDEN
    steps, lanes = inputs.shape
    states, (before, r_all, z_all, new) = run(p, inputs, h, keep, back=True)
    grads: dict = {}
    found, d_out = outputs(p, shape, states.reshape(-1, n), targets.ravel(), grads)
    d_out = d_out.reshape(steps, lanes, n)
    d_given = np.empty((steps, lanes, 3 * n), FLOAT)
    u_gates_t, u_new_t = np.ascontiguousarray(p["u"][:, : 2 * n].T), np.ascontiguousarray(p["u"][:, 2 * n :].T)
    slope_r, slope_z, slope_c = r_all * (1 - r_all) * before, z_all * (1 - z_all) * (new - before), z_all * (1 - new * new)
    stay = 1 - z_all
    d_h = np.zeros((lanes, n), FLOAT)
    for t in range(steps - 1, -1, -1):
        d_h += d_out[t]
        d = d_given[t]
        d_c = np.multiply(d_h, slope_c[t], out=d[:, 2 * n :])
        d_rh = d_c @ u_new_t
        np.multiply(d_rh, slope_r[t], out=d[:, :n])
        np.multiply(d_h, slope_z[t], out=d[:, n : 2 * n])
        d_h *= stay[t]
        d_h += np.multiply(d_rh, r_all[t], out=d_rh)
        d_h += d[:, : 2 * n] @ u_gates_t
        if keep is not None:
            d_h *= keep[t][:, None]
    flat_given = d_given.reshape(-1, 3 * n)
    grads["b"] = flat_given.sum(0)
    grads["u"] = np.concatenate(
        [
            before.reshape(-1, n).T @ flat_given[:, : 2 * n],
            (r_all * before).reshape(-1, n).T @ flat_given[:, 2 * n :],
        ],
        axis=1,
    )
    order = stable_order(inputs.ravel(), shape.ids)
    ids = inputs.ravel()[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    grads["x"] = (ids[first], np.add.reduceat(flat_given[order], first, axis=0))
    return grads, found, states[-1]


class Trainer:
    """Adagrad over windows of [STEPS, LANES] tokens; each lane is a stretch of the token stream with carried state."""

    LANES, STEPS, RATE = 512, 16, 0.15

    def __init__(self, p: dict, shape: Shape):
        self.p, self.shape = {k: v.copy() for k, v in p.items()}, shape
        self.sums = {k: np.full(v.shape, 0.1, FLOAT) for k, v in p.items()}
        self.tokens = 0

    def step(self, name: str, where, g: np.ndarray) -> None:
        g = np.clip(g, -5, 5)
        s = self.sums[name][where]
        s += g * g
        if not isinstance(where, slice):
            self.sums[name][where] = s
        g *= self.RATE
        g /= np.sqrt(s)
        self.p[name][where] += g

    def learn(self, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> float:
        """One pass over a token stream; starts: where a document begins. Returns the summed log-probability."""
        total = len(targets)
        lanes = max(1, min(self.LANES, total // self.STEPS))
        length = -(-total // lanes)
        pad = lanes * length - total
        # what pads the last lane repeats the stream's beginning
        grid = [np.concatenate([x, x[:pad]]).reshape(lanes, length).T for x in (inputs, targets, starts)]
        keep = (~grid[2]).astype(FLOAT)
        h = np.zeros((lanes, HIDDEN), FLOAT)
        score = 0.0
        for t in range(0, length, self.STEPS):
            part = slice(t, t + self.STEPS)
            g, found, h = gradients(self.p, self.shape, grid[0][part], grid[1][part], h, keep[part])
            scale = 64 / found.size
            for name in ("u", "b", "c"):
                self.step(name, slice(None), g[name] * scale)
            # all words of a class that occurred have a gradient
            seen = np.bincount(self.shape.class_of[grid[1][part]].ravel(), minlength=self.shape.classes) > 0
            words = self.shape.class_of[: self.shape.words]
            rows = slice(None) if seen[: self.shape.word_classes].all() else np.flatnonzero(seen[words])
            self.step("w", rows, g["w"][rows] * scale)
            self.step("x", g["x"][0], g["x"][1] * scale)
            score += float(found.sum())
        self.tokens += total
        return score


def score_documents(
    p: dict, shape: Shape, inputs: list[np.ndarray], targets: list[np.ndarray], steps: int = 16, rows: int = 32_768
) -> np.ndarray:
    """The summed log-probability of each document, its state carried from window to window to its end.

    Outputs are worked out for ``rows`` states at a time, however few documents are still going on.
    """
    order = sorted(range(len(inputs)), key=lambda k: -len(inputs[k]))
    lengths = np.array([len(inputs[k]) for k in order])
    scores = np.zeros(len(order))
    if not len(order):
        return scores
    all_inputs, all_targets = np.concatenate([inputs[k] for k in order]), np.concatenate([targets[k] for k in order])
    begins = np.cumsum(lengths) - lengths
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        states, wanted, of = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        for at in range(0, len(of), rows):
            part = slice(at, at + rows)
            found = log_probabilities(p, shape, states[part], wanted[part])
            scores[:] += np.bincount(of[part], found, len(order))

    h = np.zeros((len(order), HIDDEN), FLOAT)
    held = 0
    for t in range(0, int(lengths[0]), steps):
        lanes = int(np.searchsorted(-lengths, -t, side="left"))  # those longer than t
        left = lengths[:lanes] - t
        width = int(min(steps, left[0]))
        at = begins[:lanes] + t + np.minimum(np.arange(width)[:, None], left - 1)
        states, _ = run(p, all_inputs[at], h[:lanes])
        h = states[-1]
        inside = np.arange(width)[:, None] < left
        waiting.append((states[inside], all_targets[at[inside]], np.nonzero(inside)[1]))
        held += len(waiting[-1][2])
        if held >= rows:
            flush()
            held = 0
    if waiting:
        flush()
    out = np.empty(len(order))
    out[order] = scores
    return out
