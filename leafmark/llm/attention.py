"""A small causal self-attention model in numpy: one head over two blocks of context.

Tokens come in blocks of 16. Each block's positions attend to themselves, to what
stands before them in the block, and to the whole block before (masked at the
start of a text): overlapping windows of 32, in which each token is scored once.
The class of a token is predicted in two steps, its group and then its place in the
group. Logits are the logarithms of how often each class followed the current token
(counted over all training tokens, smoothed by the classes' shares) plus the
attended values, which are learned by gradients.
"""

from __future__ import annotations

import numpy as np

BLOCK, WIDTH, GROUPS, MEMBERS, INPUTS = 16, 16, 24, 16, 1024
#: The first groups, which hold the ids that begin a word.
STARTS = 16
CLASSES = GROUPS * MEMBERS
#: Tokens that the classes' shares weigh in the counts after each token, and blocks of a step.
TRUST, BATCH = 64.0, 512
_NEVER, _LEAST = np.float32(-1e9), 1e-30


def causal_mask() -> np.ndarray:
    """0 where position t of a block may look, else -1e9; first the block before."""
    own = np.where(np.tril(np.ones((BLOCK, BLOCK))) > 0, 0, _NEVER)
    return np.concatenate([np.zeros((BLOCK, BLOCK)), own], 1).astype(np.float32)


def blocks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids padded with -1, shape (n, BLOCK); which text a block is of; its first blocks)."""
    sizes = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
    out = np.full((int(sizes.sum()), BLOCK), -1, np.int32)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, sizes, strict=True):
        flat[at : at + len(t)] = t
        at += n * BLOCK
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    return out, owner, first


def shifted(inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What stands before each position (INPUTS at a text's start), with a block of INPUTS
    ahead: block i of ``inputs`` sees the rows i and i + 1."""
    out = np.full((len(inputs) + 1, BLOCK), INPUTS, np.int32)
    out.reshape(-1)[BLOCK + 1 :] = inputs.reshape(-1)[:-1]
    out[1:][first, 0] = INPUTS
    return out


def _windows(rows: np.ndarray) -> np.ndarray:
    """(blocks, context, width): overlapping views of a block and the one before."""
    n = len(rows) // BLOCK - 1
    return np.lib.stride_tricks.as_strided(rows, (n, 2 * BLOCK, rows.shape[1]), (BLOCK * rows.strides[0], *rows.strides), writeable=False)


def tables(pairs: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities after each input: of each group, and of each class in its group."""
    p = (pairs.reshape(INPUTS + 1, CLASSES) + TRUST * share).reshape(INPUTS + 1, GROUPS, MEMBERS)
    p /= np.maximum(p.sum((1, 2), keepdims=True), _LEAST)
    top = np.log(np.maximum(p.sum(2), _LEAST))
    low = np.log(np.maximum(p, _LEAST)) - top[:, :, None]
    return top.astype(np.float32), low.astype(np.float32).reshape(-1, MEMBERS)


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before learning: no attended value has a say yet."""
    rng, unit = np.random.default_rng(seed), lambda *s: rng.normal(0, WIDTH**-0.5, s)
    made = {"embed": unit(INPUTS + 1, WIDTH), "wq": unit(WIDTH, WIDTH), "wk": unit(WIDTH, WIDTH), "wv": unit(WIDTH, WIDTH)}
    made |= {"out": np.zeros((WIDTH, GROUPS)), "inner": np.zeros((GROUPS, WIDTH, MEMBERS)), "place": np.zeros((BLOCK, 2 * BLOCK))}
    return {k: v.astype(np.float32) for k, v in made.items()}


class Attention:
    def __init__(self, params: dict[str, np.ndarray], counted: tuple[np.ndarray, np.ndarray]):
        self.p = params
        self.top, self.low = counted
        e, scale = params["embed"], np.float32(WIDTH**-0.5)
        # A last column of ones sums the weights in the product that mixes the values.
        self.q, self.k = e @ params["wq"] * scale, e @ params["wk"]
        v = e @ params["wv"]
        self.v = np.concatenate([v, np.ones((len(v), 1), v.dtype)], 1)
        self.bias = params["place"] + causal_mask()
        widest = max(np.linalg.norm(params["out"], axis=0).max(), np.linalg.norm(params["inner"], axis=1).max())
        self.small = bool(np.linalg.norm(v, axis=1).max() * widest < 40)  # logits that can't overflow need no shift

    def raw_weights(self, now: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Attention before it is normalised: (blocks, positions, context)."""
        s = self.q[now[1:]] @ _windows(self.k[now.reshape(-1)]).transpose(0, 2, 1)
        s += self.bias
        s[first, :, :BLOCK] = _NEVER
        return np.exp(s, out=s)

    def by_group(self, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of positions by group, and (group, first, after the last) of each."""
        order = np.argsort(group.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]

    def logits(self, mixed: np.ndarray, now: np.ndarray, group: np.ndarray, order: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of the groups; in the position's own group, in ``order``; mixed in that order)."""
        outer = mixed @ self.p["out"]
        outer += self.top[now]
        sorted_ = mixed[order]
        inner = self.low[(now * GROUPS + group)[order]]
        for g, a, b in parts:
            inner[a:b] += sorted_[a:b] @ self.p["inner"][g]
        if not self.small:
            outer -= outer.max(1, keepdims=True)
            inner -= inner.max(1, keepdims=True)
        return outer, inner, sorted_

    def log_shares(self, now: np.ndarray, first: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of ``classes`` at each position, and of all classes that begin
        a word; ``now`` has a block more ahead."""
        mixed = (self.raw_weights(now, first) @ _windows(self.v[now.reshape(-1)])).reshape(-1, WIDTH + 1)
        mixed = mixed[:, :WIDTH] / mixed[:, WIDTH:]
        flat = classes.reshape(-1)
        group, rows = flat // MEMBERS, np.arange(len(flat))
        order, parts = self.by_group(group)
        outer, inner, _ = self.logits(mixed, now[1:].reshape(-1), group, order, parts)
        out = outer[rows, group]
        whole = np.exp(outer, out=outer).sum(1)
        out -= np.log(whole)
        start = np.log(np.maximum(outer[:, :STARTS].sum(1) / whole, _LEAST))
        hit = inner[rows, (flat % MEMBERS)[order]]
        out[order] += hit - np.log(np.exp(inner, out=inner).sum(1))
        return out.reshape(classes.shape), start.reshape(classes.shape)


class Learner:
    """What a task learns from its share: how often classes follow inputs, by counting, and
    the attention's parameters by Adam over blocks as they come, from given parameters on."""

    def __init__(self, params: dict[str, np.ndarray], share: np.ndarray, rate: float = 0.02):
        self.p, self.rate, self.steps, self.seen = {k: v.copy() for k, v in params.items()}, rate, 0, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
        self.share, self.pairs, self.read = share, np.zeros((INPUTS + 1) * CLASSES, np.int64), -1
        self.counted = tables(self.pairs, share)

    def learn(self, inputs: np.ndarray, classes: np.ndarray, first: np.ndarray, batch: int = BATCH) -> None:
        """One step for each ``batch`` blocks, all of which are used."""
        now = shifted(inputs, first)
        if self.seen > self.read * 1.25:  # the counts before these blocks
            self.counted, self.read = tables(self.pairs, self.share), self.seen
        ends = np.linspace(0, len(inputs), -(-len(inputs) // batch) + 1).astype(int).tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            self.steps += 1
            grads = gradients(Attention(self.p, self.counted), now[a : b + 1], first[a:b], classes[a:b])
            pace = np.float32(self.rate * min(1.0, self.steps / 10) / (1 + self.steps / 100) ** 0.5 / (1 - 0.9**self.steps))
            late = np.float32(1 / (1 - 0.99**self.steps))
            for k, g in grads.items():
                self.m[k] += np.float32(0.1) * (g - self.m[k])
                self.s[k] += np.float32(0.01) * (g * g - self.s[k])
                self.p[k] -= pace * self.m[k] / (np.sqrt(self.s[k] * late) + np.float32(1e-6))
        live = classes >= 0
        self.pairs += np.bincount(now[1:][live].astype(np.int64) * CLASSES + classes[live], minlength=len(self.pairs))
        self.seen += int(live.sum())


def _summed(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sums of rows by key, one for each input."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    named = key[order]
    starts = np.concatenate([[0], np.flatnonzero(named[1:] != named[:-1]) + 1])
    out = np.zeros((INPUTS + 1, rows.shape[1]), rows.dtype)
    out[named[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def gradients(model: Attention, now: np.ndarray, first: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability of ``classes`` (-1 doesn't count) by each
    parameter; ``now`` has a block more ahead."""
    p, scale, every = model.p, np.float32(WIDTH**-0.5), now.reshape(-1)
    a = model.raw_weights(now, first)
    values = _windows(model.v[every])
    mixed = (a @ values).reshape(-1, WIDTH + 1)
    total = mixed[:, WIDTH:].copy()
    mixed = mixed[:, :WIDTH] / total
    flat, target = every[BLOCK:], classes.reshape(-1)
    known, rows = np.maximum(target, 0), np.arange(len(target))
    group = known // MEMBERS
    order, parts = model.by_group(group)
    outer, inner, sorted_ = model.logits(mixed, flat, group, order, parts)
    weigh = (target >= 0).astype(mixed.dtype)
    weigh /= max(1, int((target >= 0).sum()))
    outer, inner = np.exp(outer, out=outer), np.exp(inner, out=inner)
    outer *= (weigh / outer.sum(1))[:, None]
    inner *= (weigh[order] / inner.sum(1))[:, None]
    outer[rows, group] -= weigh
    inner[rows, (known % MEMBERS)[order]] -= weigh[order]
    g = {"out": mixed.T @ outer, "inner": np.zeros_like(p["inner"])}
    pulled = np.empty_like(mixed)
    for i, x, y in parts:
        g["inner"][i] = sorted_[x:y].T @ inner[x:y]
        pulled[x:y] = inner[x:y] @ p["inner"][i].T
    d_mixed = outer @ p["out"].T
    d_mixed[order] += pulled
    # Over the sum of the weights; the last column takes what all weights of a position share.
    d_raw = np.empty((len(d_mixed), WIDTH + 1), d_mixed.dtype)
    np.divide(d_mixed, total, out=d_raw[:, :WIDTH])
    d_raw[:, WIDTH] = -np.einsum("pw,pw->p", d_raw[:, :WIDTH], mixed)
    d_raw = d_raw.reshape(*classes.shape, WIDTH + 1)
    d_s = d_raw @ values.transpose(0, 2, 1)
    d_s *= a
    g["place"] = d_s.sum(0)
    d_q = (d_s @ _windows(model.k[every])).reshape(-1, WIDTH)
    # Each row is in the windows of its own block and of the next.
    d_both = np.zeros((len(now), BLOCK, 2 * WIDTH), d_s.dtype)
    for part, d in ((slice(0, WIDTH), d_s.transpose(0, 2, 1) @ model.q[now[1:]]), (slice(WIDTH, None), a.transpose(0, 2, 1) @ d_raw[:, :, :WIDTH])):
        d_both[1:, :, part] = d[:, BLOCK:]
        d_both[:-1, :, part] += d[:, :BLOCK]
    of_q = _summed(d_q, flat)
    of_q *= scale
    of_both = _summed(d_both.reshape(-1, 2 * WIDTH), every)
    of_k, of_v, e = of_both[:, :WIDTH], of_both[:, WIDTH:], p["embed"]
    g["wq"], g["wk"], g["wv"] = e.T @ of_q, e.T @ of_k, e.T @ of_v
    g["embed"] = of_q @ p["wq"].T + of_k @ p["wk"].T + of_v @ p["wv"].T
    return g
