"""A causal self-attention network over ids of words, in numpy.

Streams of ids are cut into blocks of ``BLOCK``.  A place attends, with a
causal mask, to its own block and to the whole block before, so context windows
of two blocks overlap by one and every id is predicted exactly once.  One head
of attention, with a bias for each distance, is added to the place's own
embedding; the rectified sum leads to a softmax of two levels: a class of
units, then the unit in its class.  Frequent ids are units of their own; each
class has one unit for its share of the rest, in which ids follow their
frequency in the training texts.

Classes hold ids of one of two kinds, so the probability of a kind is known:
here words that a table holds and rare ones.

Training is plain Adam over batches of blocks.  Tasks train apart, each on its
own rows; their parameters, as vectors (:func:`pack`), are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 16
#: Width of embeddings and values, and of queries and keys.
DIM, KEY = 16, 8
#: Classes of ids of the first and of the second kind, and units in a class.
BEGIN_CLASSES, INNER_CLASSES, MEMBERS = 26, 6, 64
CLASSES = BEGIN_CLASSES + INNER_CLASSES
UNITS = CLASSES * MEMBERS
#: Blocks in a batch of training at most, and blocks that are scored at once.
BATCH, CHUNK = 512, 512
RATE, WARM_UP = 0.01, 20
#: Exponents are held below this, far above any that training reaches.
MOST_LOGIT = np.float32(60)
SHAPES = {
    "emb": (UNITS + 1, 2 * DIM),
    "keys": (DIM, 2 * KEY),
    "values": (DIM, DIM),
    "dist": (2 * BLOCK,),
    "hidden0": (DIM,),
    "top": (DIM, CLASSES),
    "top0": (CLASSES,),
    "low": (CLASSES, DIM, MEMBERS),
    "low0": (CLASSES, MEMBERS),
}
Params = dict[str, np.ndarray]


@dataclass
class Units:
    """``of``: unit of each id, class times ``MEMBERS`` plus member; ``log_share``: log p(id | unit); the first ``BEGIN_CLASSES`` classes are of the first kind."""

    of: np.ndarray
    log_share: np.ndarray
    mass: np.ndarray

    @classmethod
    def build(cls, counts: np.ndarray, begins: np.ndarray) -> Units:
        """Ids in order of frequency are dealt round the classes of their kind; those beyond the classes' room share the last units."""
        of = np.zeros(len(counts), dtype=np.int64)
        for kind, base, n in ((begins, 0, BEGIN_CLASSES), (~begins, BEGIN_CLASSES, INNER_CLASSES)):
            ids = np.flatnonzero(kind)
            ids = ids[np.lexsort((ids, -counts[ids]))]
            rank = np.arange(len(ids))
            of[ids] = (base + rank % n) * MEMBERS + np.minimum(rank // n, MEMBERS - 1)
        mass = counts + 0.05
        total = np.bincount(of, mass, minlength=UNITS)
        return cls(of, np.log(mass / total[of]).astype(np.float32), total)


def initial(units: Units, seed: int = 7) -> Params:
    """Small random weights; biases from the units' frequencies."""
    rng = np.random.default_rng(seed)
    scale = {"emb": 0.3, "keys": DIM**-0.5, "values": DIM**-0.5, "top": 0.05, "low": 0.05}
    p = {n: (rng.standard_normal(s) * scale.get(n, 0.0)).astype(np.float32) for n, s in SHAPES.items()}
    mass = units.mass.reshape(CLASSES, MEMBERS) + 1.0
    p["top0"] = np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32)
    p["low0"] = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def pack(p: Params) -> np.ndarray:
    """All parameters as one vector, which tasks send and Spark averages."""
    return np.concatenate([p[n].ravel() for n in SHAPES])


def unpack(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for n, s in SHAPES.items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s)
        at += size
    return out


@dataclass
class Blocks:
    """Blocks of one or more streams: units of the inputs (``UNITS`` is filling), ids to predict (-1 is filling), and whether a block continues the one before."""

    now: np.ndarray
    target: np.ndarray
    follows: np.ndarray
    place: np.ndarray  #: where each id of the streams lies

    @classmethod
    def cut(cls, streams: list[np.ndarray], units: Units, end_id: int) -> Blocks:
        sizes = np.array([len(s) for s in streams])
        padded = -(-sizes // BLOCK) * BLOCK
        begin = np.concatenate(([0], np.cumsum(padded)))
        place = np.repeat(begin[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        flat = np.concatenate(streams)
        target = np.full(begin[-1], -1, dtype=np.int64)
        target[place] = flat
        now = np.full(begin[-1], UNITS, dtype=np.int64)
        now[place[1:]] = units.of[flat[:-1]]
        now[begin[:-1]] = units.of[end_id]
        follows = np.ones(len(target) // BLOCK, dtype=bool)
        follows[begin[:-1] // BLOCK] = False
        return cls(now.reshape(-1, BLOCK), target.reshape(-1, BLOCK), follows, place)


_DISTANCE = np.maximum(0, np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :])
#: Added to attention: place i of a block sees the block before and its own places up to i.
_MASK = np.where(np.arange(2 * BLOCK)[None, :] > np.arange(BLOCK)[:, None] + BLOCK, np.float32(-1e9), np.float32(0))
_SCALE = np.float32(KEY**-0.5)


class _Pass:
    """The forward pass over blocks ``i`` to ``j``, with the block before as context; places with a target are in order of its class."""

    def __init__(self, p: Params, blocks: Blocks, units: Units, i: int, j: int) -> None:
        self.lead = int(i > 0)
        first = i - self.lead
        self.follows, target = blocks.follows[i:j], blocks.target[i:j].ravel()
        # an id's embedding, and what the id before it adds; nothing comes before a text's first id
        self.flat = blocks.now[first:j].ravel()
        # nearly always the id before is the row before; other heads are few
        self.heads = np.flatnonzero(~blocks.follows[first:j]) * BLOCK
        self.heads_before = np.full(len(self.heads), UNITS)
        if blocks.follows[first]:
            self.heads, self.heads_before = np.append(0, self.heads), np.append(blocks.now[first - 1, -1], self.heads_before)
        both = p["emb"].take(self.flat, axis=0)
        self.x = both[:, :DIM].copy()
        both[self.heads - 1, DIM:] = 0
        self.x[1:] += both[:-1, DIM:]
        self.x[self.heads] += p["emb"][self.heads_before, DIM:]
        keys = (self.x @ p["keys"]).reshape(-1, BLOCK, 2 * KEY)
        values = (self.x @ p["values"]).reshape(-1, BLOCK, DIM)
        self.q = keys[self.lead :, :, :KEY] * _SCALE
        self.k, self.v = self._pairs(keys[:, :, KEY:]), self._pairs(values)
        a = self.q @ self.k.transpose(0, 2, 1)
        a += p["dist"][_DISTANCE] + _MASK
        np.minimum(a, MOST_LOGIT, out=a)
        np.exp(a, out=a)
        a[~self.follows, :, :BLOCK] = 0
        a /= (a.reshape(-1, 2 * BLOCK) @ _ones(2 * BLOCK, a)).reshape(-1, BLOCK, 1)
        self.a = a
        y = (a @ self.v).reshape(-1, DIM)
        y += self.x[self.lead * BLOCK :]
        y += p["hidden0"]
        np.maximum(y, 0, out=y)
        real = np.flatnonzero(target >= 0)
        unit = units.of[target[real]]
        order = np.argsort((unit // MEMBERS).astype(np.uint8), kind="stable")
        self.at = real[order]
        self.ids = target[self.at]
        unit = unit[order]
        self.cls, self.member = unit // MEMBERS, unit % MEMBERS
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.cls, minlength=CLASSES))))
        self.y = y[self.at]
        z = self.y @ p["top"]
        z += p["top0"]
        np.minimum(z, MOST_LOGIT, out=z)
        self.rows = np.arange(len(z))
        self.logit = z[self.rows, self.cls]
        self.z = np.exp(z, out=z)

    def _pairs(self, own: np.ndarray) -> np.ndarray:
        """Each block behind the one before it; the first of all has none, its own stands in and is masked."""
        n = len(own) - self.lead
        out = np.empty((n, 2 * BLOCK, own.shape[2]), own.dtype)
        out[:, BLOCK:] = own[self.lead :]
        out[1 - self.lead :, :BLOCK] = own[: len(own) - 1]
        if not self.lead:
            out[0, :BLOCK] = own[0]
        return out

    def members(self, p: Params) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For each class that occurs: its places, exponents of its members, and the logit of the one that came."""
        for c in np.flatnonzero(np.diff(self.first)).tolist():
            part = slice(self.first[c], self.first[c + 1])
            w = self.y[part] @ p["low"][c]
            w += p["low0"][c]
            np.minimum(w, MOST_LOGIT, out=w)
            mine = w[self.rows[: len(w)], self.member[part]]
            yield c, part, np.exp(w, out=w), mine


def _ones(n: int, like: np.ndarray) -> np.ndarray:
    """Sums of rows or columns are products with these; numpy's own sums of short rows take several times as long."""
    return np.ones(n, like.dtype)


def gradients(p: Params, blocks: Blocks, units: Units, i: int, j: int) -> tuple[Params, float, int]:
    """Gradient of the mean cross-entropy of the units in blocks ``i`` to ``j``, its sum, and the number of targets."""
    f = _Pass(p, blocks, units, i, j)
    n = max(1, len(f.at))
    z, total = f.z, f.z @ _ones(CLASSES, f.z)
    loss = (np.log(total) - f.logit).sum(dtype=np.float64)
    z *= (np.float32(1 / n) / total)[:, None]
    z[f.rows, f.cls] -= np.float32(1 / n)
    dy = z @ p["top"].T
    g: Params = {"top": f.y.T @ z, "top0": _ones(len(z), z) @ z, "low": np.zeros_like(p["low"]), "low0": np.zeros_like(p["low0"])}
    for c, part, w, mine in f.members(p):
        total = w @ _ones(MEMBERS, w)
        loss += (np.log(total) - mine).sum(dtype=np.float64)
        w *= (np.float32(1 / n) / total)[:, None]
        w[f.rows[: len(w)], f.member[part]] -= np.float32(1 / n)
        dy[part] += w @ p["low"][c].T
        g["low"][c], g["low0"][c] = f.y[part].T @ w, _ones(len(w), w) @ w
    dy *= f.y > 0
    g["hidden0"] = dy.sum(axis=0)
    dh = np.zeros((len(f.a) * BLOCK, DIM), np.float32)
    dh[f.at] = dy
    dx = np.zeros((len(f.flat), DIM), np.float32)
    dx[f.lead * BLOCK :] = dh
    dh = dh.reshape(-1, BLOCK, DIM)
    da = dh @ f.v.transpose(0, 2, 1)
    da -= np.einsum("nij,nij->ni", da, f.a)[:, :, None]
    da *= f.a
    g["dist"] = np.bincount(_DISTANCE.ravel(), da.sum(axis=0).ravel(), minlength=2 * BLOCK).astype(np.float32)
    dk, dv = da.transpose(0, 2, 1) @ f.q, f.a.transpose(0, 2, 1) @ dh
    dkeys = np.zeros((len(f.flat) // BLOCK, BLOCK, 2 * KEY), np.float32)
    dkeys[f.lead :, :, :KEY] = da @ f.k * _SCALE
    dvalues = np.zeros((len(dkeys), BLOCK, DIM), np.float32)
    for d, pairs in ((dkeys[:, :, KEY:], dk), (dvalues, dv)):
        d[f.lead :] = pairs[:, BLOCK:]
        d[: len(d) - 1] += pairs[1 - f.lead :, :BLOCK]
    dkeys, dvalues = dkeys.reshape(-1, 2 * KEY), dvalues.reshape(-1, DIM)
    g["keys"], g["values"] = f.x.T @ dkeys, f.x.T @ dvalues
    dx += dkeys @ p["keys"].T
    dx += dvalues @ p["values"].T
    both = np.zeros((len(dx), 2 * DIM), np.float32)
    both[:, :DIM], both[:-1, DIM:] = dx, dx[1:]
    both[f.heads - 1, DIM:] = 0
    g["emb"] = _sum_by_unit(f.flat, both)
    np.add.at(g["emb"][:, DIM:], f.heads_before, dx[f.heads])
    return g, float(loss), len(f.at)


def _sum_by_unit(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    width = values.shape[1]
    out = np.zeros((UNITS + 1) * width, np.float32)
    np.add.at(out, (rows[:, None] * width + np.arange(width)).ravel(), values.ravel())
    return out.reshape(-1, width)


class Trainer:
    """Adam over batches of ``batch`` blocks."""

    def __init__(self, params: Params, units: Units, batch: int = BATCH, rate: float = RATE) -> None:
        self.params = {n: v.copy() for n, v in params.items()}
        self.units, self.batch, self.rate, self.steps, self.seen, self.loss = units, batch, rate, 0, 0, 0.0
        self.first = {n: np.zeros_like(v) for n, v in params.items()}
        self.second = {n: np.zeros_like(v) for n, v in params.items()}

    def learn(self, blocks: Blocks) -> None:
        """One pass over the blocks, in batches of about ``batch``."""
        n = len(blocks.now)
        cuts = np.linspace(0, n, max(1, round(n / self.batch)) + 1).astype(np.int64).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            g, loss, seen = gradients(self.params, blocks, self.units, i, j)
            self._step(g)
            self.loss += loss
            self.seen += seen

    def _step(self, g: Params) -> None:
        self.steps += 1
        t = self.steps
        rate = self.rate * min(1.0, t / WARM_UP)
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        for n, d in g.items():
            m, v = self.first[n], self.second[n]
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            d *= d
            v += np.float32(0.01) * d
            np.sqrt(v, out=d)
            d *= np.float32(c2**-0.5)
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= np.float32(rate / c1)
            self.params[n] -= d


def score(p: Params, units: Units, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """log p(id) and log p(the id begins a word), of every place, ``CHUNK`` blocks at a time."""
    own, begin = np.zeros(blocks.target.size, np.float32), np.zeros(blocks.target.size, np.float32)
    kinds = np.zeros((CLASSES, 2), np.float32)
    kinds[:BEGIN_CLASSES, 0] = kinds[BEGIN_CLASSES:, 1] = 1
    for i in range(0, len(blocks.now), CHUNK):
        f = _Pass(p, blocks, units, i, min(len(blocks.now), i + CHUNK))
        mass = f.z @ kinds
        total = np.log(mass[:, 0] + mass[:, 1])
        lp = f.logit - total
        for _, part, w, mine in f.members(p):
            lp[part] += mine - np.log(w @ _ones(MEMBERS, w))
        at = i * BLOCK + f.at
        own[at] = lp + units.log_share[f.ids]
        begin[at] = np.log(mass[:, 0]) - total
    return own, begin
