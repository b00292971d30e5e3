"""A small causal self-attention model over subword ids, in numpy.

Ids are ranks of subwords by frequency in the corpus. The model reads a window, and each
of its last SCORED places attends to what is before it; a distance has its own bias. A
place's state g gives id y the weight uni[y] * ((w[y] . g)^2 + a), uni being the corpus
frequency. Such squares sum over the whole vocabulary by one small matrix, so every
probability is exact at a cost that does not depend on the vocabulary.

What words alone say of the next id, counted in the corpus, is mixed in: after id x, the
table of pairs has a share gate[x], and attention has the rest together with what the
table leaves open. Both sum to one over the vocabulary, so the mixture does. Attention
is trained on what the pairs do not explain.
"""

from __future__ import annotations

import numpy as np

WIDTH, BACK, SCORED = 8, 12, 20
WINDOW = BACK + SCORED
OWN = 2048  # ranks with vectors and pairs of their own; the others share one as input and go by frequency as output
_FAR, _MOST = np.float32(-1e9), np.float32(60)  # 60 is far from what training reaches; keeps exp finite without a shift
_ROOT = np.float32(np.sqrt(WIDTH))
_BLOCK = 256  # windows worked on at a time
_PLACES = np.arange(WINDOW)[None, :] - (BACK + np.arange(SCORED))[:, None]  # key place - query place
SHAPES = {
    "e": (OWN + 1, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "r": (WIDTH, WIDTH),
    "d": (WINDOW,), "w": (OWN, WIDTH + 1), "a": (1,), "gate": (OWN + 1,),
}


def started() -> dict[str, np.ndarray]:
    """Parameters from which training starts: near the frequencies of single ids."""
    rng = np.random.default_rng(11)
    p = {name: (rng.standard_normal(shape) / np.sqrt(WIDTH)).astype(np.float32) for name, shape in SHAPES.items()}
    p["e"] *= np.float32(2)
    p["d"] = (-0.5 * np.arange(WINDOW)).astype(np.float32)
    p["w"][:, -1] = 1
    p["a"] = np.zeros(1, np.float32)
    p["gate"] = np.full(OWN + 1, 2, np.float32)
    return p


def packed(p: dict) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in SHAPES]).astype(np.float32)


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def frequencies(counts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Frequency by rank, each id of the vocabulary counted once more; the last entry is that of an id never seen."""
    seen = np.append(np.asarray(counts, float) + 1, 1.0)
    return seen / (seen[:-1].sum() + max(1, vocabulary - len(counts)))


def pair_shares(before: np.ndarray, after: np.ndarray, counts: np.ndarray, discount: float = 0.75) -> np.ndarray:
    """Share of each next id after an id, from counts of neighbours in words, as (OWN + 1, OWN + 1).

    ``before`` is -1 where ``after`` begins a word, ``after`` is -1 where ``before`` ends one.
    A word's first id does not depend on the word before it. Rows sum to one at most: a pair
    is counted a little lower than it was seen, and ranks from OWN on are left out.
    """
    begins, ends, inside = before < 0, after < 0, (before >= 0) & (after >= 0)
    of = np.bincount(np.minimum(before[~begins], OWN), counts[~begins], OWN + 1)
    first = np.bincount(np.minimum(after[begins], OWN), counts[begins], OWN + 1)
    last = np.bincount(np.minimum(before[ends], OWN), counts[ends], OWN + 1)
    place = np.minimum(before[inside], OWN) * (OWN + 1) + np.minimum(after[inside], OWN)
    table = np.bincount(place, np.maximum(0, counts[inside] - discount), (OWN + 1) ** 2).reshape(OWN + 1, OWN + 1).astype(float)
    table += np.outer(last, first / max(1, first.sum()))
    table /= np.maximum(1, of)[:, None]
    table[OWN] = table[:, OWN] = 0
    return table.astype(np.float32)


def windows(docs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, starts, owner) of all windows of the documents; -1 fills up.

    A document is shifted by one: its first word is read from the end mark. Window w of it
    scores its places w * SCORED and on, and also sees the BACK places before them, so
    windows overlap and every place is scored once.
    """
    lengths = np.array([len(x) for x in docs], np.int64)
    sizes = -(-lengths // SCORED) * SCORED
    first = np.cumsum(np.concatenate([[0], sizes[:-1] + BACK]))
    total = int(first[-1] + BACK + sizes[-1])
    inputs, targets = np.full(total, -1, np.int32), np.full(total, -1, np.int32)
    flat = np.concatenate(docs)
    at = np.arange(len(flat)) + np.repeat(first + BACK - (np.cumsum(lengths) - lengths), lengths)
    targets[at] = flat
    inputs[at[1:]] = flat[:-1]
    inputs[first[lengths > 0] + BACK] = end
    each = sizes // SCORED
    owner = np.repeat(np.arange(len(docs)), each)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    return inputs, targets, first[owner] + inner * SCORED, owner


def _distance(p: dict) -> np.ndarray:
    return np.where(_PLACES > 0, _FAR, p["d"][np.clip(-_PLACES, 0, WINDOW - 1)]).astype(np.float32)


class Scorer:
    """Tables made from the parameters."""

    def __init__(self, p: dict, counts: np.ndarray, vocabulary: int, pairs: np.ndarray):
        uni = frequencies(counts, vocabulary)
        w = np.zeros((len(uni), WIDTH + 1))
        own = min(OWN, len(uni) - 1)
        w[:own] = p["w"][:own] * np.sqrt(uni[:own, None])
        self.a = float(np.exp(p["a"][0]))
        self.m = (w.T @ w).astype(np.float32)
        self.u, self.ua = np.ascontiguousarray(w.T, np.float32), (self.a * uni).astype(np.float32)
        self.q, self.k, self.v, self.r = _tables(p)
        self.bias, self.pairs = _distance(p), pairs
        self.low = _low(self.q, self.k, self.bias)
        self.share = 1 / (1 + np.exp(-p["gate"]))
        self.left = (1 - self.share * pairs.sum(1)).astype(np.float32)

    def score(self, docs: list[np.ndarray], end: int, chunk: int = _BLOCK) -> np.ndarray:
        """Natural log probability of each document (ranks, the end mark last)."""
        inputs, targets, starts, owner = windows(docs, end)
        shown = np.where(inputs < 0, OWN + 1, np.minimum(inputs, OWN)).astype(np.int32)
        out, steps = np.zeros(len(docs)), np.arange(WINDOW)
        for s in range(0, len(starts), chunk):
            place = starts[s : s + chunk, None] + steps
            x = shown.take(place)
            asked = np.ascontiguousarray(x[:, BACK:])
            a = np.matmul(self.q.take(asked, 0), self.k.take(x, 0).transpose(0, 2, 1))
            g = _attended(a, self.v.take(x, 0), self.bias, self.low)[2]
            g += self.r.take(asked, 0)
            g = np.ascontiguousarray(g.reshape(-1, WIDTH).T)  # a place is a column
            g /= 1 + np.abs(g)
            y = targets.take(place[:, BACK:]).ravel()
            known = np.where(y < 0, len(self.ua) - 1, np.minimum(y, len(self.ua) - 1))
            u = self.u.take(known, 1)
            own = np.einsum("dt,dt->t", u[:WIDTH], g) + u[WIDTH]
            turned = self.m[:WIDTH, :WIDTH] @ g
            turned += 2 * self.m[:WIDTH, WIDTH:]
            norm = np.einsum("dt,dt->t", turned, g) + (self.m[WIDTH, WIDTH] + np.float32(self.a))
            before = np.minimum(asked.ravel(), OWN)
            counted = self.pairs.take(before * (OWN + 1) + np.clip(y, 0, OWN))
            logp = np.log(self.left.take(before) * ((own * own + self.ua.take(known)) / norm) + self.share.take(before) * counted)
            logp[y < 0] = 0
            out += np.bincount(owner[s : s + chunk], logp.reshape(-1, SCORED).sum(1, dtype=np.float64), len(docs))
        return out


def _tables(p: dict) -> list[np.ndarray]:
    """Query, key, value and direct vectors of every input; the last row is for what fills up.

    Queries and keys have one more component, by which what fills up is never attended to;
    values have a one, by which weights are summed.
    """
    made = p["e"] @ np.concatenate([p["q"] / _ROOT, p["k"], p["v"], p["r"]], axis=1)
    made = np.concatenate([made, np.zeros((1, 4 * WIDTH), made.dtype)])
    q, k, v, r = (np.ascontiguousarray(made[:, i : i + WIDTH]) for i in range(0, 4 * WIDTH, WIDTH))
    far = np.zeros((len(k), 1), k.dtype)
    far[-1] = _FAR
    one = np.ones_like(far)
    return [np.concatenate([q, one], axis=1), np.concatenate([k, far], axis=1), np.concatenate([v, one], axis=1), r]


def _low(q: np.ndarray, k: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no query and key can come to more than _MOST together with a bias."""
    longest = [np.einsum("id,id->i", x[:, :WIDTH], x[:, :WIDTH]).max() for x in (q, k)]
    return bool(np.sqrt(longest[0] * longest[1]) + bias.max() <= _MOST)


def _attended(a: np.ndarray, v: np.ndarray, bias: np.ndarray, low: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights before they are divided by their sums, the sums, and what is seen by them."""
    a += bias
    if not low:
        np.minimum(a, _MOST.astype(a.dtype), out=a)
    np.exp(a, out=a)
    seen = np.matmul(a, v)
    total = np.maximum(seen[:, :, WIDTH:], a.dtype.type(1e-30))
    return a, total, seen[:, :, :WIDTH] / total


def _scattered(ids: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    """Sum by id of what stands in each column, as a row per id."""
    return np.stack([np.bincount(ids, c, size) for c in columns], axis=1).astype(columns.dtype)


def _room(space: dict, name: str, shape: tuple, kind) -> np.ndarray:
    """An array to write to, kept in ``space`` for the next step."""
    if name not in space or len(space[name]) < shape[0]:
        space[name] = np.empty(shape, kind)
    return space[name][: shape[0]]


def gradients(p: dict, x: np.ndarray, y: np.ndarray, uni: np.ndarray, pairs: np.ndarray, full: np.ndarray, space: dict | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the places of a batch and its gradients; x (B, WINDOW) and y (B, SCORED), -1 fills up.

    ``full`` is the sum of each row of ``pairs``, ``space`` keeps the largest arrays from step to step.
    """
    space = {} if space is None else space
    kind = p["e"].dtype
    q_of, k_of, v_of, r_of = _tables(p)
    bias = _distance(p).astype(kind)
    low = _low(q_of, k_of, bias)
    own = min(OWN, len(uni) - 1)
    root = np.sqrt(uni[:own, None]).astype(kind)
    w = np.zeros((WIDTH + 1, own + 1), kind)
    w[:, :own] = (p["w"][:own] * root).T
    m = w @ w.T
    alpha = np.exp(p["a"][0])
    share = (1 / (1 + np.exp(-p["gate"]))).astype(kind)

    ids = np.where(x < 0, OWN + 1, np.minimum(x, OWN))
    asked = np.ascontiguousarray(ids[:, BACK:])
    before = np.minimum(asked, OWN).ravel()
    real = y.ravel() >= 0
    t = np.where(real, np.minimum(y.ravel(), len(uni) - 1), len(uni) - 1)
    to, pair = np.minimum(t, own), before * (OWN + 1) + np.where(real, np.minimum(t, OWN), OWN)
    count, n = max(1, int(real.sum())), len(x)
    wide, narrow = _room(space, "wide", (_BLOCK, WINDOW, 2 * WIDTH), kind), _room(space, "narrow", (_BLOCK, SCORED, 2 * WIDTH), kind)
    de = _room(space, "e", (n, WINDOW, WIDTH), kind)
    for_targets, dgate = np.empty((WIDTH + 1, len(t)), kind), np.empty(len(t), kind)
    e = np.concatenate([p["e"], np.zeros((1, WIDTH), kind)])
    of_keys, of_queries = np.concatenate([p["k"], p["v"]], axis=1).T, np.concatenate([p["q"] / _ROOT, p["r"]], axis=1).T
    squares, by_place, for_keys, for_queries, da, loss = np.zeros_like(m), np.zeros_like(bias), 0, 0, 0.0, 0.0
    for at in range(0, n, _BLOCK):
        s, f = slice(at, at + _BLOCK), slice(at * SCORED, (at + _BLOCK) * SCORED)
        q, k, v = q_of.take(asked[s], 0), k_of.take(ids[s], 0), v_of.take(ids[s], 0)
        a, total, seen = _attended(np.matmul(q, k.transpose(0, 2, 1)), v, bias, low)
        q, k = q[:, :, :WIDTH], k[:, :, :WIDTH]
        # from here to dpre a place is a column
        pre = np.ascontiguousarray((seen + r_of.take(asked[s], 0)).reshape(-1, WIDTH).T)
        bend = 1 / (1 + np.abs(pre))
        g = np.ones((WIDTH + 1, pre.shape[1]), kind)
        np.multiply(pre, bend, out=g[:WIDTH])

        u = w.take(to[f], 1)
        often = uni.take(t[f]).astype(kind)
        dot = np.einsum("dt,dt->t", u, g)
        top = dot * dot + alpha * often
        turned = m @ g
        norm = np.einsum("dt,dt->t", turned, g) + alpha
        by_pair = pairs.take(pair[f]).astype(kind)
        given, mass = share.take(before[f]), full.take(before[f]).astype(kind)
        model, left = top / norm, 1 - given * mass
        mixed = left * model + given * by_pair
        known = real[f]
        loss -= float(np.log(mixed[known]).sum())
        each = known.astype(kind) / (count * mixed)
        dgate[f] = each * (mass * model - by_pair) * given * (1 - given)
        each *= left * model  # what is left for attention to explain

        ddot, dnorm = -2 * each * dot / top, each / norm
        squares += (g * dnorm) @ g.T
        np.multiply(ddot, g, out=for_targets[:, f])
        da += float((dnorm - each * often / top).sum())
        dpre = ddot * u[:WIDTH]
        turned = turned[:WIDTH]
        turned *= 2 * dnorm
        dpre += turned
        dpre *= bend
        dpre *= bend
        dpre = np.ascontiguousarray(dpre.T).reshape(seen.shape)
        dseen = np.empty((len(a), SCORED, WIDTH + 1), kind)
        np.divide(dpre, total, out=dseen[:, :, :WIDTH])
        np.negative(np.einsum("bsd,bsd->bs", dseen[:, :, :WIDTH], seen), out=dseen[:, :, WIDTH])
        ds = np.matmul(dseen, v.transpose(0, 2, 1))
        ds *= a
        by_place += ds.sum(0)
        wide, narrow = wide[: len(a)], narrow[: len(a)]
        np.matmul(ds.transpose(0, 2, 1), q, out=wide[:, :, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dseen[:, :, :WIDTH], out=wide[:, :, WIDTH:])
        np.matmul(ds, k, out=narrow[:, :, :WIDTH])
        narrow[:, :, WIDTH:] = dpre
        flat, asking = wide.reshape(-1, 2 * WIDTH), narrow.reshape(-1, 2 * WIDTH)
        for_keys = for_keys + e.take(ids[s].ravel(), 0).T @ flat
        for_queries = for_queries + e.take(asked[s].ravel(), 0).T @ asking
        np.matmul(flat, of_keys, out=de[s].reshape(-1, WIDTH))
        de[s, BACK:] += (asking @ of_queries).reshape(*dpre.shape)

    dw = 2 * w[:, :own].T @ squares
    dw += _scattered(to, for_targets, own + 1)[:own]
    out = {"w": np.zeros_like(p["w"]), "a": np.array([alpha * da], kind)}
    out["w"][:own] = dw * root
    out["gate"] = np.bincount(before, dgate, OWN + 1).astype(kind)
    out["d"] = np.bincount(np.clip(-_PLACES, 0, WINDOW - 1)[_PLACES <= 0], by_place[_PLACES <= 0], WINDOW).astype(kind)
    out["k"], out["v"] = for_keys[:, :WIDTH], for_keys[:, WIDTH:]
    out["q"], out["r"] = for_queries[:, :WIDTH] / _ROOT, for_queries[:, WIDTH:]
    out["e"] = _scattered(ids.ravel(), np.ascontiguousarray(de.reshape(-1, WIDTH).T), OWN + 2)[: OWN + 1]
    return loss / count, out


class Trainer:
    """Adam from given parameters, at a falling rate."""

    def __init__(self, p: dict, counts: np.ndarray, vocabulary: int, pairs: np.ndarray, rate: float = 0.04):
        self.p, self.rate, self.steps = {n: x.copy() for n, x in p.items()}, rate, 0
        self.pairs, self.full = pairs, pairs.sum(1)
        self.uni = frequencies(counts, vocabulary).astype(np.float32)
        self.m = {n: np.zeros_like(x) for n, x in p.items()}
        self.s = {n: np.zeros_like(x) for n, x in p.items()}
        self.space: dict = {}

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        loss, grads = gradients(self.p, x, y, self.uni, self.pairs, self.full, self.space)
        self.steps += 1
        rate = self.rate / (1 + self.steps / 100) ** 0.5
        for n, g in grads.items():
            self.m[n] += 0.1 * (g - self.m[n])
            self.s[n] += 0.01 * (g * g - self.s[n])
            m, s = self.m[n] / (1 - 0.9**self.steps), self.s[n] / (1 - 0.99**self.steps)
            self.p[n] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        return loss
