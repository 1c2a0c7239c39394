"""A small causal self-attention model over token classes, in numpy.

Each token belongs to a class: the most frequent tokens have one each, the others share
classes by frequency. The model gives the distribution of the next class from the classes of
the tokens before it, within a window; the share of a token in its class comes from counts of
the whole corpus. A window has ``2 * STEP`` inputs and scores its last ``STEP`` targets, the next
one begins ``STEP`` later: windows overlap, and every target is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 16
WIDTH = 32
OWN_CLASSES, SHARED_CLASSES = 128, 32
CLASSES = OWN_CLASSES + SHARED_CLASSES
#: Classes of a group: the next class is predicted as its group, then as one of the group.
GROUP = 16
GROUPS = CLASSES // GROUP
_HIDDEN = np.float32(-1e9)

#: Names and shapes of the weights.
SHAPES = {
    "embed": (CLASSES, WIDTH),
    "place": (2 * STEP, WIDTH),
    "query": (WIDTH, WIDTH),
    "key": (WIDTH, WIDTH),
    "value": (WIDTH, WIDTH),
    "group": (WIDTH, GROUPS),
    "group_bias": (GROUPS,),
    "out": (WIDTH, CLASSES),
    "bias": (CLASSES,),
}


@dataclass(frozen=True)
class Classes:
    """Class of each token, its log10 share there, and each class's share of word starts."""

    of: np.ndarray
    share: np.ndarray
    starts: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, is_start: np.ndarray) -> Classes:
        order = np.argsort(-counts, kind="stable")
        of = np.empty(len(counts), np.int16)
        # Word starts apart here too, so that one group at most holds both kinds.
        own = order[:OWN_CLASSES]
        of[own[np.argsort(is_start[own], kind="stable")]] = np.arange(len(own))
        rest = order[OWN_CLASSES:]
        # Classes double in size from the frequent tokens to the rare ones, word starts apart.
        half = SHARED_CLASSES // 2
        for start in (False, True):
            mine = rest[is_start[rest] == start]
            band = np.minimum(np.floor(np.log2(np.arange(len(mine)) / 8 + 1) * half / max(1.0, np.log2(len(mine) / 8 + 1))), half - 1)
            of[mine] = OWN_CLASSES + half * int(start) + band
        smoothed = counts + 1.0
        total = np.bincount(of, weights=smoothed, minlength=CLASSES)
        starts = np.bincount(of, weights=smoothed * is_start, minlength=CLASSES) / np.maximum(total, 1e-9)
        return cls(of, np.log10(smoothed / total[of]), starts.astype(np.float32))


def fresh_weights(seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    weights = {k: (draw.standard_normal(s) * (0.3 if k in ("embed", "place") else WIDTH**-0.5)).astype(np.float32) for k, s in SHAPES.items()}
    weights["bias"][:], weights["group_bias"][:] = 0, 0
    return weights


def flatten(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
    return {k: part.reshape(s).astype(np.float32, copy=False) for (k, s), part in zip(SHAPES.items(), np.split(flat, sizes), strict=True)}


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, seen, scored) of the windows over texts laid end to end.

    ``lengths``: inputs (and targets) of each text. A window's inputs end at ``first + scored - 1``
    and its targets begin at ``first``; ``seen`` inputs before ``first`` belong to the text.
    """
    count = -(-lengths // STEP)
    begin = np.cumsum(lengths) - lengths
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(begin, count) + inner * STEP
    left = np.repeat(begin + lengths, count) - first
    return first, np.minimum(inner * STEP, STEP), np.minimum(left, STEP)


def gather(classes: np.ndarray, first: np.ndarray, seen: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, is real) as matrices of ``2 * STEP`` columns."""
    place = np.arange(-STEP, STEP)[None, :]
    real = (place >= -seen[:, None]) & (place < scored[:, None])
    index = np.where(real, first[:, None] + place, 0)
    return classes[index], real


_ONES = np.ones(2 * STEP, np.float32)

#: Windows at a time: few enough for the cache, enough for one product per group of classes.
_TOGETHER = 256

#: By key, then by target.
_FUTURE = np.where(np.arange(2 * STEP)[:, None] <= STEP + np.arange(STEP), np.float32(0), _HIDDEN)


class _Room:
    """Work arrays that stay in place from one part to the next: fresh ones cost a page fault each 4 KB."""

    def __init__(self):
        self._arrays: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, *shape: int, kind: type = np.float32) -> np.ndarray:
        held = self._arrays.get(name)
        if held is None or len(held) < n or held.shape[1:] != shape:
            held = self._arrays[name] = np.empty((n, *shape), kind)
        return held[:n]


def _tables(w: dict[str, np.ndarray]) -> np.ndarray:
    """Keys beside values, as one product, and a column for ones; the keys take the queries' product along."""
    key = w["key"] @ w["query"].T * np.float32(WIDTH**-0.5)
    return np.concatenate([key, w["value"], np.zeros((WIDTH, 1), np.float32)], axis=1)


def _outputs(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the groups, and of the classes of each group, with the bias as the last row."""
    within = np.concatenate([w["out"], w["bias"][None]]).reshape(WIDTH + 1, GROUPS, GROUP)
    return np.concatenate([w["group"], w["group_bias"][None]]), within.transpose(1, 0, 2)


def _joint(group: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group its classes' outputs beside those of all groups, and the transpose without the bias."""
    forth = np.concatenate([np.broadcast_to(group, (GROUPS, *group.shape)), within], axis=2)
    return forth, np.ascontiguousarray(forth[:, :WIDTH].transpose(0, 2, 1))


def _by_group(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): the targets in order of their group, those of group g between edges g and g + 1."""
    group = (wanted // GROUP).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])
    return np.argsort(group, kind="stable"), edges.tolist()


def _power(z: np.ndarray) -> np.ndarray:
    """Powers of e in place, up to a factor for each row."""
    if z.size and z.max() > 40:  # rare; otherwise they fit as they are
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _joint_powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of e in place, of the groups and of the classes of one group."""
    top, within = z[:, :GROUPS], z[:, GROUPS:]
    if z.size and z.max() > 40:
        return _power(top), _power(within)
    np.exp(z, out=z)
    return top, within


def _shares(z: np.ndarray) -> np.ndarray:
    z = _power(z)
    return z / z.sum(axis=1, keepdims=True)


def _attended(kv: np.ndarray, x: np.ndarray, before: np.ndarray, room: _Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of the values by powers of e, one over the sums of these powers, the powers by key, then by target).

    The values' last column is one, which gives the sums of the powers. Products with the
    transpose of the right side are slow, so it is the targets that are turned.
    """
    n = len(kv)
    across = room("across", n, WIDTH + 1, STEP)[:, :WIDTH]
    np.copyto(across, x.transpose(0, 2, 1))
    a = np.matmul(kv[:, :, :WIDTH], across, out=room("a", n, 2 * STEP, STEP))
    a += _FUTURE
    # What follows a text's end is in the future of its targets anyway; what precedes it is not.
    short = np.flatnonzero(~before[:, 0])
    if len(short):
        a[short, :STEP] += np.where(before[short], np.float32(0), _HIDDEN)[:, :, None]
    _power(a)
    h = np.matmul(a.transpose(0, 2, 1), kv[:, :, WIDTH:], out=room("h", n, STEP, WIDTH + 1))
    return h, 1 / h[:, :, WIDTH:], a


class Scorer:
    """Weights in the form that scoring needs: with one layer, keys and values are tables of class and place."""

    def __init__(self, w: dict[str, np.ndarray]):
        x = w["embed"][:, None] + w["place"]
        pair = x @ _tables(w)
        pair[:, :, -1] = 1
        self._pair, self._last = pair.reshape(-1, 2 * WIDTH + 1), x[:, STEP:].reshape(-1, WIDTH)
        self._forth, _ = _joint(*_outputs(w))
        self._room = _Room()

    def next_class(self, inputs: np.ndarray, real: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the next class, in float32, and their sums weighted by ``of``.

        (windows, STEP, CLASSES) and (windows, STEP, columns of ``of``); the first of these is all ones.
        """
        h = self._states(inputs, real)
        z = np.repeat(_shares(h @ self._forth[0, :, :GROUPS]), GROUP, axis=1)
        for g in range(GROUPS):
            z[:, g * GROUP : (g + 1) * GROUP] *= _shares(h @ self._forth[g, :, GROUPS:])
        return z.reshape(-1, STEP, CLASSES), (z @ of).reshape(len(inputs), STEP, -1)

    def log_shares(self, inputs: np.ndarray, real: np.ndarray, wanted: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probabilities of the ``wanted`` classes, and of all classes weighted by ``of``, of each target.

        ``wanted`` counts at the real targets only, which come one after the other.
        """
        places = np.flatnonzero(real[:, STEP:])
        own, weighted = np.empty(len(places), np.float32), np.empty(len(places), np.float32)
        cuts = np.searchsorted(places, np.arange(0, len(inputs) + _TOGETHER, _TOGETHER) * STEP)
        of = of.reshape(GROUPS, GROUP).astype(np.float32)
        mixed = np.flatnonzero(of.min(axis=1) != of.max(axis=1))  # other groups count alike as a whole
        for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = slice(at * _TOGETHER, (at + 1) * _TOGETHER)
            order, edges = _by_group(wanted[a:b])
            here, n = wanted[a:b].take(order), b - a
            h = self._states(inputs[part], real[part])
            h = h.take(places[a:b].take(order) - at * _TOGETHER * STEP, axis=0, out=self._room("hs", n, WIDTH + 1), mode="clip")
            z = self._room("z", n, GROUPS + GROUP)
            for g in range(GROUPS):
                if edges[g] < edges[g + 1]:
                    np.matmul(h[edges[g] : edges[g + 1]], self._forth[g], out=z[edges[g] : edges[g + 1]])
            top, within = _joint_powers(z)
            over_top = 1 / (top @ _ONES[:GROUPS])
            sums = top @ of[:, 0]
            for g in mixed:
                inside = _power(np.matmul(h, self._forth[g, :, GROUPS:], out=self._room("inside", n, GROUP)))
                sums += top[:, g] * (inside @ of[g] / (inside @ _ONES[:GROUP]) - of[g, 0])
            flat, place = z.reshape(-1), np.arange(0, n * (GROUPS + GROUP), GROUPS + GROUP)
            chosen = flat.take(place + GROUPS + here % GROUP) / (within @ _ONES[:GROUP])
            own[a + order] = chosen * flat.take(place + here // GROUP) * over_top
            weighted[a + order] = sums * over_top
        return tuple(np.log10(np.maximum(x, 1e-37, out=x)).astype(np.float64) for x in (own, weighted))

    def _states(self, inputs: np.ndarray, real: np.ndarray) -> np.ndarray:
        """What the outputs see, and a one for the bias, a row for each target; they hold until the next call."""
        n, room = len(inputs), self._room
        index = inputs * (2 * STEP) + np.arange(2 * STEP)
        kv = self._pair.take(index, axis=0, out=room("kv", n, 2 * STEP, 2 * WIDTH + 1), mode="clip")
        x = self._last.take(inputs[:, STEP:] * STEP + np.arange(STEP), axis=0, out=room("x", n, STEP, WIDTH), mode="clip")
        h, over, _ = _attended(kv, x, real[:, :STEP], room)
        h[:, :, :WIDTH] *= over
        h[:, :, :WIDTH] += x
        h[:, :, WIDTH] = 1
        return h.reshape(-1, WIDTH + 1)


#: The outputs of a group's targets: those of all groups, then those of its classes.
_PARTS = np.repeat(np.eye(2, dtype=np.float32), [GROUPS, GROUP], axis=1)

#: Rows of a run in ``_by_class``.
_RUN = 16


def _by_class(classes: np.ndarray, rows: np.ndarray, room: _Room) -> np.ndarray:
    """Sums of the rows of each class: of runs of ``_RUN`` rows, one row of each run at a time, then one product a group with the runs' places in it."""
    classes, rows = classes.reshape(-1), rows.reshape(-1, rows.shape[-1])
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    count = np.bincount(classes, minlength=CLASSES)
    runs = -(-count // _RUN)
    bounds = np.concatenate([[0], np.cumsum(runs)])
    of_run = np.repeat(np.arange(CLASSES), runs)
    inner = (np.arange(len(of_run)) - bounds.take(of_run)) * _RUN
    size = np.minimum(count.take(of_run) - inner, _RUN)
    first = (np.cumsum(count) - count).take(of_run) + inner
    longest = np.argsort(-size, kind="stable")  # so that the runs with a next row come first
    first, enough = first.take(longest), len(size) - np.cumsum(np.bincount(size, minlength=_RUN + 1))
    width, n = rows.shape[1], len(of_run)
    sums = rows.take(order.take(first), axis=0, out=room(f"runs {width}", n, width), mode="clip")
    for j in range(1, _RUN):
        some = enough[j]
        sums[:some] += rows.take(order.take(first[:some] + j), axis=0, out=room(f"next {width}", some, width), mode="clip")
    ordered = room(f"next {width}", n, width)
    ordered[longest] = sums
    place = room("places", n, GROUP)
    place[:] = 0
    place.reshape(-1)[np.arange(n) * GROUP + of_run % GROUP] = 1
    sums = np.zeros((GROUPS, GROUP, width), np.float32)
    for g in range(GROUPS):
        span = slice(bounds[g * GROUP], bounds[(g + 1) * GROUP])
        np.matmul(place[span].T, ordered[span], out=sums[g])
    return sums.reshape(CLASSES, -1)


def gradient(
    w: dict[str, np.ndarray], inputs: np.ndarray, real: np.ndarray, targets: np.ndarray, room: _Room | None = None
) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss per target (natural log) and its gradient; targets below 0 do not count.

    Keys and values depend on a class and a place only, so they are tables, and what
    comes back to them is added up by class and by place before it meets the weights.
    Attention stays as powers of e, the sums go along with what comes back.
    """
    room = room or _Room()
    pair_of = _tables(w)
    pair, pair_place = w["embed"] @ pair_of, w["place"] @ pair_of
    pair[:, -1], pair_place[:, -1] = 1, 0
    forth, back = _joint(*_outputs(w))
    total, loss = max(1, int((targets >= 0).sum())), 0.0
    all_pair = room("d pair", len(inputs), 2 * STEP, 2 * WIDTH)
    all_last = room("d last", len(inputs), STEP, WIDTH)
    by_place = np.zeros((2 * STEP, 2 * WIDTH), np.float32)
    last_by_place = np.zeros((STEP, WIDTH), np.float32)
    of_joint = np.zeros((GROUPS, GROUPS + GROUP, WIDTH + 1), np.float32)
    for lo in range(0, len(inputs), _TOGETHER):
        part = inputs[lo : lo + _TOGETHER]
        n, last = len(part), np.ascontiguousarray(part[:, STEP:])
        kv = pair.take(part, axis=0, out=room("kv", n, 2 * STEP, 2 * WIDTH + 1), mode="clip")
        kv += pair_place
        x = w["embed"].take(last, axis=0, out=room("x", n, STEP, WIDTH), mode="clip")
        x += w["place"][STEP:]
        h, over, a = _attended(kv, x, real[lo : lo + _TOGETHER, :STEP], room)
        mixed = np.multiply(h[:, :, :WIDTH], over, out=room("mixed", n, STEP, WIDTH))
        np.add(mixed, x, out=h[:, :, :WIDTH])
        h[:, :, WIDTH] = 1
        # Each target asks for its group, and for its class among those of the group.
        wanted = targets[lo : lo + _TOGETHER].reshape(-1)
        counted = np.flatnonzero(wanted >= 0)
        order, edges = _by_group(wanted.take(counted))
        order = counted.take(order)
        wanted = wanted.take(order)
        m, hs = len(order), h.reshape(-1, WIDTH + 1).take(order, axis=0, out=room("hs", len(order), WIDTH + 1), mode="clip")
        z, dh = room("z", m, GROUPS + GROUP), room("dh", m + 1, WIDTH)
        spans = [(g, slice(edges[g], edges[g + 1])) for g in range(GROUPS) if edges[g] < edges[g + 1]]
        for g, span in spans:
            np.matmul(hs[span], forth[g], out=z[span])
        top, within = _joint_powers(z)
        over_top, over_within = 1 / (top @ _ONES[:GROUPS]), 1 / (within @ _ONES[:GROUP])
        flat, place = z.reshape(-1), np.arange(0, m * (GROUPS + GROUP), GROUPS + GROUP)
        place_top, place = place + wanted // GROUP, place + GROUPS + wanted % GROUP
        chosen = flat.take(place) * over_within * (flat.take(place_top) * over_top)
        loss -= float(np.log(np.maximum(chosen, 1e-30)).sum())
        share = np.float32(1 / total)
        z *= np.stack([over_top * share, over_within * share], axis=1) @ _PARTS
        flat[place] -= share
        flat[place_top] -= share
        for g, span in spans:
            of_joint[g] += z[span].T @ hs[span]
            np.matmul(z[span], back[g], out=dh[span])
        dh[m] = 0  # for what does not count
        back_to = np.full(n * STEP, m)
        back_to[order] = np.arange(m)
        dm = dh.take(back_to, axis=0, out=room("dm", n * STEP, WIDTH), mode="clip").reshape(n, STEP, WIDTH)
        d_last, d_pair = all_last[lo : lo + n], all_pair[lo : lo + n]
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        grown, across = room("grown", n, STEP, WIDTH), room("across", n, WIDTH + 1, STEP)
        np.multiply(dm, over, out=grown)
        np.copyto(across[:, :WIDTH], grown.transpose(0, 2, 1))
        np.negative(np.einsum("ijk,ijk->ij", grown, mixed), out=across[:, WIDTH])
        np.matmul(a, grown, out=d_pair[:, :, WIDTH:])
        a *= np.matmul(v, across, out=room("da", n, 2 * STEP, STEP))
        np.matmul(a, x, out=d_pair[:, :, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), k, out=d_last)
        d_last += dm
        by_place += d_pair.sum(axis=0)
        last_by_place += d_last.sum(axis=0)
    if not len(inputs):
        return 0.0, {name: np.zeros(shape, np.float32) for name, shape in SHAPES.items()}
    by_class, last_by_class = _by_class(inputs, all_pair, room), _by_class(inputs[:, STEP:], all_last, room)
    of_pair = w["embed"].T @ by_class + w["place"].T @ by_place
    of_key, scale = of_pair[:, :WIDTH], np.float32(WIDTH**-0.5)
    place = by_place @ pair_of[:, :-1].T
    place[STEP:] += last_by_place
    of_group = of_joint[:, :GROUPS].sum(axis=0)
    of_within = of_joint[:, GROUPS:].reshape(CLASSES, WIDTH + 1)
    return loss / total, {
        "embed": by_class @ pair_of[:, :-1].T + last_by_class,
        "place": place,
        "query": of_key.T @ w["key"] * scale,
        "key": of_key @ w["query"] * scale,
        "value": of_pair[:, WIDTH:],
        "group": of_group[:, :-1].T,
        "group_bias": of_group[:, -1],
        "out": of_within[:, :-1].T,
        "bias": of_within[:, -1],
    }


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self._flat = flatten(weights).astype(np.float32)
        self.weights = unflatten(self._flat)
        self.rate, self.steps, self._room = rate, 0, _Room()
        self._mean, self._square = np.zeros_like(self._flat), np.zeros_like(self._flat)

    def step(self, inputs: np.ndarray, real: np.ndarray, targets: np.ndarray) -> float:
        loss, g = gradient(self.weights, inputs, real, targets, self._room)
        self.steps += 1
        d = flatten(g)
        self._mean += 0.1 * (d - self._mean)
        self._square += 0.01 * (d * d - self._square)
        mean, square = self._mean / (1 - 0.9**self.steps), self._square / (1 - 0.99**self.steps)
        self._flat -= (self.rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
        return loss
