"""A causal self-attention model over subword ids, in numpy: its vocabulary, windows, training steps and scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: The unit of the end of a text; the unit of its start is Vocabulary.start.
END = 0


@dataclass
class Vocabulary:
    """Where each subword id has its output, by its place among all ids in order of mass.

    The first output layer chooses among heads (END and the ids of most mass) and groups; the ids behind the heads are dealt to
    the groups by turns. A group's own layer chooses among own ids and bins; a bin holds rarer ids, which share it by their
    masses. Heads, own ids and bins are the units, which are also the inputs. Every id of the tokenizer has a place, seen or not.
    """

    masses: np.ndarray  # of each id, above 0
    end: float  # of the end of a text
    heads: int = 32
    groups: int = 32
    own: int = 80
    bins: int = 16

    def __post_init__(self) -> None:
        n, wide = len(self.masses), self.own + self.bins
        rank = np.empty(n, np.int64)
        rank[np.argsort(-self.masses, kind="stable")] = np.arange(n)
        behind = rank - (self.heads - 1)
        group, place = behind % self.groups, behind // self.groups
        inside = np.where(place < self.own, place, self.own + (place - self.own) % self.bins)
        self.unit = np.where(behind < 0, 1 + rank, self.heads + group * wide + inside).astype(np.int32)
        self.start = self.heads + self.groups * wide
        whole = np.bincount(self.unit, self.masses, self.start)
        whole[END] = self.end
        self.weight = whole  # of each unit; 0 where no id is

    def layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the shares of heads and groups, and of the units in each group."""
        with np.errstate(divide="ignore"):
            inner = self.weight[self.heads :].reshape(self.groups, -1)
            outer = np.concatenate([self.weight[: self.heads], inner.sum(axis=1)])
            first = np.log(outer / outer.sum())
            second = np.log(inner / np.maximum(inner.sum(axis=1, keepdims=True), 1e-300))
        return np.maximum(first, -60), np.maximum(second, -60)


def windows(units: np.ndarray, sizes: np.ndarray, start: int, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping context windows over texts that lie one behind the other: inputs, wanted units, and each window's text.

    A text is start and its units; after each place the next unit is wanted, END after the last. Each next window begins step
    places later and counts in its last step places only (wanted is -1 in the others), so every unit is counted once, END
    included, after at least width - step places of context, or all there are.
    """
    ends = np.cumsum(sizes + 1)
    first = ends - sizes - 1
    before, after = np.empty(len(units) + len(sizes), np.int32), np.empty(len(units) + len(sizes), np.int32)
    inner = np.ones(len(before), bool)
    inner[first] = False
    before[first], before[inner] = start, units
    inner[:] = True
    inner[ends - 1] = False
    after[ends - 1], after[inner] = END, units
    n = 1 + np.maximum(0, -(-(sizes + 1 - width) // step))
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = (first[text] + k * step)[:, None] + np.arange(width)
    inside = at < ends[text][:, None]
    at = np.minimum(at, len(before) - 1)
    wanted = np.where(inside, after[at], -1)
    wanted[k > 0, : width - step] = -1
    return np.where(inside, before[at], END), wanted, text


def _rows(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x @ by as one product of all rows, not one for each window."""
    return (x.reshape(-1, x.shape[-1]) @ by).reshape(*x.shape[:-1], by.shape[-1])


class Attention:
    """One layer of causal self-attention over windows of width units, with a residual path, and outputs in two layers."""

    def __init__(self, words: Vocabulary, dim: int = 32, width: int = 32, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1 / math.sqrt(dim), s).astype(np.float32)
        first, second = words.layers()
        self.heads, self.wide, self.width, self.dim = words.heads, words.own + words.bins, width, dim
        self.p = {
            "emb": f(words.start + 1, dim), "pos": f(width, dim) * np.float32(0.3), "qkv": f(dim, 3 * dim), "o": f(dim, dim),
            "out": f(dim, len(first)) * np.float32(0.01), "bias": first.astype(np.float32),
            "out2": f(words.groups, dim, self.wide) * np.float32(0.01), "bias2": second.astype(np.float32),
        }
        self.before = np.tril(np.ones((width, width), np.float32))

    def _weights(self, q: np.ndarray, k: np.ndarray, lo: int = 0) -> np.ndarray:
        """How much each place from lo takes of those before it and itself."""
        s = q @ k.transpose(0, 2, 1)
        np.minimum(s, 40, out=s)
        np.exp(s, out=s)
        s *= self.before[lo:]
        s /= (s @ np.ones(s.shape[2], s.dtype))[..., None]
        return s

    @staticmethod
    def _chosen(h: np.ndarray, out: np.ndarray, bias: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the wanted outputs."""
        z = h @ out
        z += bias
        own = z[np.arange(len(z)), wanted].astype(np.float64)
        with np.errstate(over="ignore"):
            total = np.exp(z) @ np.ones(z.shape[1], np.float32)
        if not (total.min(initial=1.0) > 1e-30 and total.max(initial=1.0) < 1e30):  # out of the range of float32
            top = z.max(axis=1)
            return own - top - np.log(np.exp((z - top[:, None]).astype(np.float64)).sum(axis=1))
        return own - np.log(total.astype(np.float64))

    def _inner(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Outputs of the first layer; the places with a group, in order of groups; and (group, from, to) among these."""
        behind = wanted >= self.heads
        outer = np.where(behind, self.heads + (wanted - self.heads) // self.wide, wanted)
        at = np.flatnonzero(behind)
        at = at[np.argsort(outer[at], kind="stable")]
        found, begin = np.unique(outer[at], return_index=True)
        if not len(at):
            return outer, at, []
        ends = [*begin[1:].tolist(), len(at)]
        return outer, at, list(zip((found - self.heads).tolist(), begin.tolist(), ends, strict=True))

    def choice(self, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the wanted units after hidden states."""
        p = self.p
        outer, at, runs = self._inner(wanted)
        got = np.empty(len(h))
        for i in range(0, len(h), 4096):  # what the processor's cache holds
            got[i : i + 4096] = self._chosen(h[i : i + 4096], p["out"], p["bias"], outer[i : i + 4096])
        hs, ws = h[at], (wanted[at] - self.heads) % self.wide
        for g, a, b in runs:
            got[at[a:b]] += self._chosen(hs[a:b], p["out2"][g], p["bias2"][g], ws[a:b])
        return got

    def hidden(self, units: np.ndarray) -> tuple[np.ndarray, ...]:
        """units: windows x width. All windows at once; a place sees itself and those before it."""
        p, d = self.p, self.dim
        x = p["emb"].take(units, axis=0)
        x += p["pos"]
        qkv = _rows(x, p["qkv"])
        q, k, v = qkv[..., :d] * np.float32(1 / math.sqrt(d)), qkv[..., d : 2 * d], qkv[..., 2 * d :]
        s = self._weights(q, k)
        o = s @ v
        return x, q, k, v, s, o, x + _rows(o, p["o"])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each unit and each place add to a place's own vector, query, key and value, side by side."""
        p, d = self.p, self.dim
        scale = np.concatenate([np.full(d, 1 / math.sqrt(d), np.float32), np.ones(2 * d, np.float32)])
        both = [np.concatenate([x, (x @ p["qkv"]) * scale], axis=1) for x in (p["emb"], p["pos"])]
        return both[0], both[1]

    def score(self, units: np.ndarray, wanted: np.ndarray, tables: tuple[np.ndarray, np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of all places with wanted >= 0, in order, and the logarithms of their wanted units. Windows that count in
        their last step places only have queries there only; keys and values are of the whole window."""
        d, late, rows, states, next_ones = self.dim, self.width - step, [], [], []
        early = (wanted[:, :late] >= 0).any(axis=1)
        for which, lo in ((np.flatnonzero(early), 0), (np.flatnonzero(~early), late)):
            for i in range(0, len(which), 128):  # what the processor's cache holds
                some = which[i : i + 128]
                u, w = units[some], wanted[some, lo:]
                both = tables[0].take(u, axis=0)
                both += tables[1]
                s = self._weights(both[:, lo:, d : 2 * d], both[:, :, 2 * d : 3 * d], lo)
                o = s @ both[:, :, 3 * d :]
                r, c = np.nonzero(w >= 0)
                rows.append(some[r])
                next_ones.append(w[r, c])
                states.append(both[r, c + lo, :d] + o[r, c] @ self.p["o"])
        if not rows:
            return np.empty(0, np.int64), np.empty(0)
        rows, got = np.concatenate(rows), self.choice(np.concatenate(states), np.concatenate(next_ones))
        order = np.argsort(rows, kind="stable")
        return rows[order], got[order]

    @staticmethod
    def _slope(z: np.ndarray, wanted: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The gradient of the losses of places, each with its share, with regard to the outputs, which may be changed."""
        ones = np.ones(z.shape[1], z.dtype)
        with np.errstate(over="ignore"):
            e = np.exp(z)
            total = e @ ones
        if not (total.min(initial=1.0) > 1e-30 and total.max(initial=1.0) < 1e30):  # out of the range of float32
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e @ ones
        z = e
        z *= (share / total)[:, None]
        z[np.arange(len(z)), wanted] -= share
        return z

    def gradients(self, units: np.ndarray, wanted: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss over the places with wanted >= 0, each with its window's weight, for every parameter."""
        p, d = self.p, self.dim
        x, q, k, v, s, o, h = self.hidden(units)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        places = np.flatnonzero(wanted.ravel() >= 0)
        w = wanted.ravel()[places]
        share = np.ones(len(places)) if weight is None else np.repeat(weight, wanted.shape[1])[places].astype(np.float64)
        share = (share / share.sum()).astype(np.float32)
        hs = flat(h)[places]
        outer, at, runs = self._inner(w)
        z = hs @ p["out"]
        z += p["bias"]
        z = self._slope(z, outer, share)
        ones = np.ones(len(z), z.dtype)
        g = {"out": hs.T @ z, "bias": ones @ z, "out2": np.zeros_like(p["out2"]), "bias2": np.zeros_like(p["bias2"])}
        back = z @ p["out"].T
        h2, share2, w2 = hs[at], share[at], (w[at] - self.heads) % self.wide
        back2 = np.empty_like(h2)
        for i, a, b in runs:
            z = h2[a:b] @ p["out2"][i]
            z += p["bias2"][i]
            z = self._slope(z, w2[a:b], share2[a:b])
            g["out2"][i], g["bias2"][i] = h2[a:b].T @ z, ones[: b - a] @ z
            back2[a:b] = z @ p["out2"][i].T
        back[at] += back2
        dh = np.zeros_like(h)
        flat(dh)[places] = back
        g["o"] = flat(o).T @ flat(dh)
        do = _rows(dh, p["o"].T)
        ds = do @ v.transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", ds, s)[..., None]
        ds *= s
        dqkv = np.concatenate([(ds @ k) * np.float32(1 / math.sqrt(d)), ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ do], axis=2)
        g["qkv"] = flat(x).T @ flat(dqkv)
        dx = dh + _rows(dqkv, p["qkv"].T)
        g["pos"] = dx.sum(axis=0)
        ids = units.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(p["emb"]) < 1 << 16 else ids, kind="stable")  # small numbers are sorted by their digits
        found = ids[order]
        begin = np.flatnonzero(np.diff(found, prepend=-1))
        g["emb"] = np.zeros_like(p["emb"])
        g["emb"][found[begin]] = np.add.reduceat(flat(dx)[order], begin, axis=0)
        return g

    def fit(self, units: np.ndarray, wanted: np.ndarray, epochs: int, rate: float, batch: int, memory: dict | None = None, seed: int = 4, weight: np.ndarray | None = None) -> dict:
        """Adam over shuffled windows, which may have weights; places with wanted < 0 don't count. Returns its memory, for a further call.

        Without a memory the rate falls to 0 over all epochs; with one, which holds the steps of earlier calls, it stays.
        """
        p, rng, fading = self.p, np.random.default_rng(seed), memory is None
        memory = memory or {"step": 0, "m": {k: np.zeros_like(v) for k, v in p.items()}, "u": {k: np.zeros_like(v) for k, v in p.items()}}
        total = max(1, epochs * -(-len(units) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(units))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                if not (wanted[some] >= 0).any():
                    continue
                memory["step"] += 1
                step = memory["step"]
                lr = rate * ((1 - step / (total + 1)) if fading else 1.0) * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for key, d in self.gradients(units[some], wanted[some], None if weight is None else weight[some]).items():
                    m, u = memory["m"][key], memory["u"][key]
                    m += np.float32(0.1) * (d - m)
                    d *= d
                    u += np.float32(0.01) * (d - u)
                    p[key] -= np.float32(lr) * m / (np.sqrt(u) + np.float32(1e-8))
        return memory
