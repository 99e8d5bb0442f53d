"""A gated recurrent word model in numpy: truncated backpropagation, and an output softmax factored into classes.

Token ids are by falling frequency, so that a class is a range of ids; 0 ends a document and 1 is any word outside the vocabulary.
"""

from __future__ import annotations

import heapq

import numpy as np

END, OUTSIDE = 0, 1
HIDDEN = 24
CLASSES = 48
#: Texts that run side by side, and tokens between truncations in learning.
LANES, LEARN_LANES, SPAN = 512, 128, 32
#: In learning, longer documents are learned from in stretches of so many tokens, each from a fresh state; scoring never cuts a document.
STRETCH = 4096
#: Tokens whose outputs are made at once in scoring.
OUTPUTS = SPAN * LANES


def class_starts(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """First id of each class, then the number of ids. END and OUTSIDE are classes of their own; the others share the square roots of the
    frequencies about equally."""
    n = len(counts)
    if n <= 2:
        return np.arange(n + 1)
    share = np.cumsum(np.sqrt(counts[2:].astype(float) + 1))
    of = np.minimum((classes - 2) * share / share[-1], classes - 2 - 1e-9).astype(int)
    return np.concatenate([[0, 1], 2 + np.flatnonzero(np.diff(of, prepend=-1)), [n]])


def stretches(of: np.ndarray, most: int = STRETCH) -> np.ndarray:
    """The offsets ``of``, with further ones so that nothing between two is longer than ``most``."""
    number = -(-np.diff(of) // most)
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return np.append(np.repeat(of[:-1], number) + within * most, of[-1])


class Lanes:
    """Documents dealt to lanes of about equal length: ``at`` (steps x lanes) has the place of each target in the end-to-end tokens, -1 after
    a lane's end; lanes are by falling length, so at each step the running ones are the first."""

    def __init__(self, of: np.ndarray, lanes: int):
        size = np.diff(of)
        order = np.argsort(-size, kind="stable")
        lanes = max(1, min(lanes, len(size)))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in order.tolist():
            n, k = heapq.heappop(heap)
            held[k].append(d)
            heapq.heappush(heap, (n + int(size[d]), k))
        total = np.array([int(size[x].sum()) for x in held])
        by = np.argsort(-total, kind="stable")
        self.length = total[by]
        self.at = np.full((int(total.max(initial=0)), lanes), -1, np.int64)
        for k, lane in enumerate(by):
            row = 0
            for d in held[lane]:
                self.at[row : row + size[d], k] = np.arange(of[d], of[d + 1])
                row += int(size[d])

    def running(self, step: int) -> int:
        return int(np.searchsorted(-self.length, -step, "left"))


class Model:
    """``counts``: occurrences of each id in the training corpus; the biases start from them, so that an untrained model is a unigram one."""

    NAMES = ("x", "u", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, counts: np.ndarray, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.starts = class_starts(counts)
        n, c = len(counts), len(self.starts) - 1
        self.of_class = np.repeat(np.arange(c), np.diff(self.starts))
        mass = counts.astype(float) + 0.5
        per_class = np.add.reduceat(mass, self.starts[:-1])
        self.x = rng.normal(0, 0.1, (n, 3 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.class_w = np.zeros((HIDDEN, c), np.float32)
        self.class_b = np.log(per_class / per_class.sum()).astype(np.float32)
        self.word_w = np.zeros((n, HIDDEN), np.float32)
        self.word_b = np.log(mass / per_class[self.of_class]).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, k) for k in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def run(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Hidden states (steps x lanes x HIDDEN) after each input; ``fresh`` marks inputs that begin a document, from a state of zeros.
        ``kept`` gets the states before each input, the gates, the candidates and the candidates' recurrent part, for learning."""
        out = np.empty((*inputs.shape, HIDDEN), self.u.dtype)
        if kept is not None:
            kept += [np.empty_like(out), np.empty((*inputs.shape, 2 * HIDDEN), out.dtype), np.empty_like(out), np.empty_like(out)]
        begins = fresh.any(axis=1)
        into = self.x[inputs]
        for t in range(len(inputs)):
            if begins[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            a, g = into[t], h @ self.u
            gates = a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]  # sigmoid(v) = (1 + tanh(v / 2)) / 2
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            m = r * g[:, 2 * HIDDEN :]
            m += a[:, 2 * HIDDEN :]
            np.tanh(m, out=m)
            if kept is not None:
                kept[0][t], kept[1][t], kept[2][t], kept[3][t] = h, gates, m, g[:, 2 * HIDDEN :]
            np.subtract(h, m, out=out[t])
            out[t] *= z
            out[t] += m
            h = out[t]
        return out

    @staticmethod
    def _softmax(logits: np.ndarray, targets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probabilities of the targets, exponentials in place of the logits, their sums)."""
        if logits.max() > 60 or logits.min() < -60:  # else neither the exponentials nor their sums leave the range of floats
            logits -= logits.max(axis=1, keepdims=True)
        own = logits[rows, targets]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        return own - np.log(total), logits, total

    def log_probability(self, h: np.ndarray, targets: np.ndarray, grads: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the targets after states ``h``; adds to ``grads`` of the cross-entropy, and gives that of ``h``."""
        if not len(h):
            return np.zeros(0, h.dtype), None if grads is None else np.zeros_like(h)
        cls = self.of_class[targets]
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # fewer than 65,536 classes; 16 bits are sorted by radix
        cls, h, targets = cls[order], h[order], targets[order]
        ends = np.searchsorted(cls, np.arange(len(self.starts)))
        rows = np.arange(len(h))
        lp, d, total = self._softmax(h @ self.class_w + self.class_b, cls, rows)
        back = None
        if grads is not None:
            d /= total[:, None]
            d[rows, cls] -= 1
            back = d @ self.class_w.T
            grads[2] += h.T @ d
            grads[3] += d.sum(axis=0)
        for c in np.flatnonzero((np.diff(self.starts) > 1) & (np.diff(ends) > 0)).tolist():
            a, b = self.starts[c], self.starts[c + 1]
            i, j = ends[c], ends[c + 1]
            own, weights = h[i:j], self.word_w[a:b]
            logits = own @ weights.T
            logits += self.word_b[a:b]
            k, at = rows[: j - i], targets[i:j] - a
            more, d, total = self._softmax(logits, at, k)
            lp[i:j] += more
            if grads is not None:
                d /= total[:, None]
                d[k, at] -= 1
                back[i:j] += d @ weights
                grads[4][a:b] += d.T @ own
                grads[5][a:b] += d.sum(axis=0)
        out = np.empty_like(lp)
        out[order] = lp
        if back is not None:
            sorted_back, back = back, np.empty_like(back)
            back[order] = sorted_back
        return out, back

    def _inputs(self, tokens: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input before each target (END before a document's first), and whether the target is a document's first."""
        fresh = first[at]
        return np.where(fresh, END, tokens[np.maximum(at - 1, 0)]), fresh

    def score(self, tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log-probability of each token; documents are end to end and ``of`` has their offsets. The state runs on through a whole document."""
        out = np.zeros(len(tokens))
        if not len(tokens):
            return out
        first = np.zeros(len(tokens), bool)
        first[of[:-1][np.diff(of) > 0]] = True
        lanes = Lanes(of, LANES)
        h = np.zeros((lanes.at.shape[1], HIDDEN), np.float32)
        step = 0
        while step < len(lanes.at):
            h = h[: lanes.running(step)]
            span = max(SPAN, OUTPUTS // len(h))  # the fewer lanes run, the more steps
            at = lanes.at[step : step + span, : len(h)]
            step += span
            done = at < 0
            safe = np.where(done, 0, at)
            inputs, fresh = self._inputs(tokens, first, safe)
            states = self.run(inputs, fresh | done, h)
            h = states[-1]
            go = ~done
            places = at[go]
            out[places] = self.log_probability(states[go], tokens[places])[0]
        return out

    @staticmethod
    def _descend(p: np.ndarray, squares: np.ndarray, g: np.ndarray, scale: np.float32, rate: np.float32) -> None:
        """A step against gradient ``g`` * ``scale``, in place; ``g`` is used up."""
        g *= scale
        root = g * g
        squares += root
        np.sqrt(squares, out=root)
        g /= root
        g *= rate
        p -= g

    def learn(self, tokens: np.ndarray, of: np.ndarray, rate: float, decay_to: float = 0.2) -> int:
        """One pass of truncated backpropagation over SPAN tokens, with per-parameter rates; returns the tokens learned from."""
        if not len(tokens):
            return 0
        of = stretches(of)
        first = np.zeros(len(tokens), bool)
        first[of[:-1][np.diff(of) > 0]] = True
        lanes = Lanes(of, LEARN_LANES)
        parameters = self.parameters()
        squares = [np.full_like(p, 1e-3) for p in parameters]
        h = np.zeros((lanes.at.shape[1], HIDDEN), np.float32)
        for step in range(0, len(lanes.at), SPAN):
            h = h[: lanes.running(step)]
            at = lanes.at[step : step + SPAN, : len(h)]
            done = at < 0
            safe = np.where(done, 0, at)
            inputs, fresh = self._inputs(tokens, first, safe)
            fresh = fresh | done
            kept: list = []
            states = self.run(inputs, fresh, h, kept)
            h = states[-1]
            go = ~done
            grads = [None, np.zeros_like(self.u), np.zeros_like(self.class_w), np.zeros_like(self.class_b), np.zeros_like(self.word_w), np.zeros_like(self.word_b)]
            _, back = self.log_probability(states[go], tokens[at[go]], grads)
            d_states = np.zeros_like(states)
            d_states[go] = back
            before, gates, m, gn = kept
            z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
            # What the loop multiplies by, for all steps at once.
            to_m, to_z, to_r = (1 - z) * (1 - m * m), (before - m) * z * (1 - z), gn * r * (1 - r)
            d = np.zeros_like(h)
            d_inputs = np.empty((*inputs.shape, 3 * HIDDEN), np.float32)
            into = np.empty_like(d_inputs)
            stays = (~fresh).astype(np.float32)[..., None]
            back_u = np.ascontiguousarray(self.u.T)
            for t in range(len(inputs) - 1, -1, -1):
                d += d_states[t]
                dm = d * to_m[t]
                np.multiply(d, to_z[t], out=into[t, :, :HIDDEN])
                np.multiply(dm, to_r[t], out=into[t, :, HIDDEN : 2 * HIDDEN])
                np.multiply(dm, r[t], out=into[t, :, 2 * HIDDEN :])
                d_inputs[t, :, 2 * HIDDEN :] = dm
                d *= z[t]
                d += into[t] @ back_u
                d *= stays[t]
            d_inputs[..., : 2 * HIDDEN] = into[..., : 2 * HIDDEN]
            grads[1] += before.reshape(-1, HIDDEN).T @ into.reshape(-1, 3 * HIDDEN)
            scale = np.float32(1 / max(1, len(h)))
            now = np.float32(rate * (1 - (1 - decay_to) * step / max(1, len(lanes.at))))
            for k in range(1, len(parameters)):
                self._descend(parameters[k], squares[k], grads[k], scale, now)
            used = inputs[go]
            order = np.argsort(used.astype(np.uint16) if len(self.x) <= 1 << 16 else used, kind="stable")
            used = used[order]
            starts = np.flatnonzero(np.diff(used, prepend=-1))
            ids = used[starts]
            g = np.add.reduceat(d_inputs[go][order], starts, axis=0)
            own, own_squares = self.x[ids], squares[0][ids]
            self._descend(own, own_squares, g, scale, now)
            self.x[ids], squares[0][ids] = own, own_squares
        return len(tokens)
