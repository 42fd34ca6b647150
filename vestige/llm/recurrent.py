"""A gated recurrent language model in numpy with a class-factored softmax.

A token is a slot: the first ``words`` slots are learned words, slot 0 the end of a document; each
slot after them is a whole class of rarer words.  P(token | state) = P(class | state) *
P(word | class, state).  Learned words lie in classes of ``width`` words with an own softmax; a
rarer word's share of its class comes from its count, outside this module.  With output weights
of zero the biases alone give the counts' shares, so learning starts at the unigram model.
"""

from __future__ import annotations

import numpy as np

END = 0
#: Lanes read side by side and steps of one window of truncated backpropagation.
LANES, STEPS = 256, 16
#: Lanes and steps of one scoring window.
SCORE_LANES, SCORE_STEPS = 512, 32
RATE = 0.004


def spread(states: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and those's sums by row.

    States lie between -1 and 1, so the weights bound the logits; where the bound is beyond what
    float32 can add up, logits are held within it.
    """
    logits = states @ out
    logits += bias
    if np.abs(out).sum(axis=0).max() + np.abs(bias).max() > 60:
        np.clip(logits, -60, 60, out=logits)
    share = np.exp(logits)
    return logits, share, share @ np.ones(share.shape[1], share.dtype)


class Net:
    """Weights by name: float32 arrays.  ``width`` words to a class of learned words."""

    def __init__(self, weights: dict[str, np.ndarray], width: int):
        self.w, self.width = weights, width
        self.words = len(weights["word_bias"])
        self.word_classes = -(-self.words // width)

    @staticmethod
    def fresh(words: int, slots: int, log_word: np.ndarray, log_class: np.ndarray, width: int, hidden: int, seed: int = 7) -> Net:
        """log_word: log share of each learned word in its class; log_class: log share of each class."""
        draw = np.random.default_rng(seed)
        normal = lambda rows, cols, size: (draw.standard_normal((rows, cols)) * size).astype(np.float32)
        bias = np.zeros(3 * hidden, np.float32)
        bias[:hidden] = 1.0
        return Net({
            "embed": normal(slots, hidden, 0.3), "into": normal(hidden, 3 * hidden, hidden**-0.5), "bias": bias,
            "again": normal(hidden, 3 * hidden, hidden**-0.5),
            "class_out": np.zeros((hidden, len(log_class)), np.float32), "class_bias": log_class.astype(np.float32),
            "word_out": np.zeros((words, hidden), np.float32), "word_bias": log_word.astype(np.float32),
        }, width)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def with_flat(self, values: np.ndarray) -> Net:
        out, at = {}, 0
        for name, a in self.w.items():
            out[name] = np.asarray(values[at : at + a.size], np.float32).reshape(a.shape)
            at += a.size
        return Net(out, self.width)

    def class_of(self, slots: np.ndarray) -> np.ndarray:
        return np.where(slots < self.words, slots // self.width, slots - self.words + self.word_classes)

    def gates(self, a, state):
        """One step: the new state and what backpropagation needs."""
        h = state.shape[1]
        u = state @ self.w["again"]
        zr = a[:, : 2 * h] + u[:, : 2 * h]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, un = zr[:, :h], zr[:, h:], u[:, 2 * h :]
        n = r * un
        n += a[:, 2 * h :]
        np.tanh(n, out=n)
        after = state - n
        after *= z
        after += n
        return after, z, r, un, n

    def outputs(self, states, targets, learn: bool = False):
        """Log probability of each target slot; with ``learn`` also the gradients of its negative sum.

        states (n, hidden), targets (n).  Targets are sorted by class, so that a class's words are
        one matrix product.
        """
        w = self.w
        logits, share, total = spread(states, w["class_out"], w["class_bias"])
        classes = self.class_of(targets)
        spots = np.arange(len(targets)) * logits.shape[1] + classes
        said = logits.ravel()[spots] - np.log(total)
        grads, back = {}, None
        if learn:
            share /= total[:, None]
            share.ravel()[spots] -= 1
            grads = {"class_out": states.T @ share, "class_bias": share.sum(axis=0), "word_out": np.zeros_like(w["word_out"]), "word_bias": np.zeros_like(w["word_bias"])}
            back = share @ w["class_out"].T
        order = np.argsort(classes.astype(np.int16), kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=self.word_classes)[: self.word_classes])])
        order = order[: ends[-1]]
        near, at, more = states[order], targets[order] % self.width, np.empty(len(order), np.float32)
        back_near = np.empty_like(near) if learn else None
        for c in np.flatnonzero(np.diff(ends)):
            own = slice(ends[c], ends[c + 1])
            low, high = c * self.width, min((c + 1) * self.width, self.words)
            inner, part, whole = spread(near[own], w["word_out"][low:high].T, w["word_bias"][low:high])
            spots = np.arange(len(inner)) * (high - low) + at[own]
            more[own] = inner.ravel()[spots] - np.log(whole)
            if learn:
                part /= whole[:, None]
                part.ravel()[spots] -= 1
                grads["word_out"][low:high] = part.T @ near[own]
                grads["word_bias"][low:high] = part.sum(axis=0)
                back_near[own] = part @ w["word_out"][low:high]
        said[order] += more
        if learn:
            back[order] += back_near
        return said, grads, back

    def window(self, read: np.ndarray, targets: np.ndarray, state: np.ndarray):
        """One window of truncated backpropagation: read, targets (steps, lanes).

        A lane's state is emptied where it reads the end of a document.  Gives the state after the
        window, the sum of log probabilities and the gradients of their negative sum.
        """
        w, (steps, lanes), h = self.w, read.shape, state.shape[1]
        x = w["embed"][read]
        a = x @ w["into"] + w["bias"]
        empty = [np.flatnonzero(row) for row in read == END]
        before, z, r, un, n, states = (np.empty((steps, lanes, h), a.dtype) for _ in range(6))
        for t in range(steps):
            before[t] = state
            before[t, empty[t]] = 0
            states[t], z[t], r[t], un[t], n[t] = self.gates(a[t], before[t])
            state = states[t]
        said, grads, back = self.outputs(states.reshape(-1, h), targets.ravel(), learn=True)
        back = back.reshape(steps, lanes, h)
        # What does not depend on later steps, for all steps at once.
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), un * r * (1 - r)
        da, du = np.empty_like(a), np.empty_like(a)
        carried = np.zeros((lanes, h), a.dtype)
        for t in range(steps - 1, -1, -1):
            d = back[t] + carried
            dn = d * by_n[t]
            da[t, :, :h], da[t, :, h : 2 * h], da[t, :, 2 * h :] = d * by_z[t], dn * by_r[t], dn
            du[t, :, : 2 * h], du[t, :, 2 * h :] = da[t, :, : 2 * h], dn * r[t]
            carried = d * z[t] + du[t] @ w["again"].T
            carried[empty[t]] = 0
        slots = read.ravel().astype(np.int16)
        order = np.argsort(slots, kind="stable")
        there, first = np.unique(slots[order], return_index=True)
        flat = da.reshape(-1, 3 * h)
        grads["again"], grads["bias"] = before.reshape(-1, h).T @ du.reshape(-1, 3 * h), flat.sum(axis=0)
        grads["into"] = x.reshape(-1, x.shape[2]).T @ flat
        grads["embed"] = np.zeros_like(w["embed"])
        grads["embed"][there] = np.add.reduceat((flat @ w["into"].T)[order], first, axis=0)
        return state, float(said.sum()), grads

    def learn(self, tokens: np.ndarray, rate: float = RATE) -> tuple[Net, float]:
        """A net that has read ``tokens`` (documents in a row, each with its end) once; the sum of log probabilities.

        The tokens are dealt over lanes; each lane carries its state from window to window.
        Steps are Adam's, from a fresh state.
        """
        net = Net({k: a.copy() for k, a in self.w.items()}, self.width)
        lanes = max(1, min(LANES, len(tokens) // (64 * STEPS)))
        length = -(-len(tokens) // lanes)
        starts = np.arange(lanes) * length
        state, total = np.zeros((lanes, self.w["again"].shape[0]), np.float32), 0.0
        first = {k: np.zeros_like(a) for k, a in net.w.items()}
        second = {k: np.zeros_like(a) for k, a in net.w.items()}
        for i, low in enumerate(range(0, length, STEPS)):
            # The last lane may end before the others: its last token is then read again.
            spots = np.minimum(starts + np.arange(low, min(low + STEPS, length))[:, None], len(tokens) - 1)
            read = np.where(spots > 0, tokens[spots - 1], END)
            state, said, grads = net.window(read.astype(np.int64), tokens[spots].astype(np.int64), state)
            total += said
            # Adam with a step that falls to a tenth over the tokens.
            pace = rate * (1 - 0.9 * low / length) * (1 - 0.99 ** (i + 1)) ** 0.5 / (1 - 0.9 ** (i + 1))
            for k, g in grads.items():
                g /= spots.size
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] -= pace * first[k] / (np.sqrt(second[k]) + 1e-6)
        return net, total

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document's slots (its end included), over the whole document.

        Documents are read side by side, the longest first; a lane that is done takes the next
        document, and the states of the others are carried on.
        """
        w, h = self.w, self.w["again"].shape[0]
        table = w["embed"] @ w["into"] + w["bias"]
        out = np.zeros(len(documents))
        waiting = sorted((i for i in range(len(documents)) if len(documents[i])), key=lambda i: len(documents[i]))
        lanes: list[list[int]] = []
        state = np.zeros((0, h), np.float32)
        while waiting or lanes:
            while waiting and len(lanes) < SCORE_LANES:
                lanes.append([waiting.pop(), 0])
            state = np.concatenate([state, np.zeros((len(lanes) - len(state), h), np.float32)])
            steps = min(SCORE_STEPS, max(len(documents[d]) - at for d, at in lanes))
            told = np.full((len(lanes), steps + 1), END, np.int64)
            sizes = np.empty(len(lanes), np.int64)
            for k, (d, at) in enumerate(lanes):
                own = documents[d][max(at - 1, 0) : at + steps]
                told[k, at == 0 : (at == 0) + len(own)] = own
                sizes[k] = len(own) - (at > 0)
            read, targets = told[:, :-1].T, told[:, 1:].T
            states = np.empty((steps, len(lanes), h), np.float32)
            for t in range(steps):
                state = self.gates(table[read[t]], state)[0]
                states[t] = state
            real = np.arange(steps)[:, None] < sizes[None, :]
            said, _, _ = self.outputs(states[real], targets[real])
            owner = np.broadcast_to(np.arange(len(lanes)), real.shape)[real]
            sums = np.bincount(owner, weights=said.astype(np.float64), minlength=len(lanes))
            stay = []
            for k, (d, at) in enumerate(lanes):
                out[d] += sums[k]
                if at + steps < len(documents[d]):
                    stay.append(k)
            state = state[stay]
            lanes = [[lanes[k][0], lanes[k][1] + steps] for k in stay]
        return out
