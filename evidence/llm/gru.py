"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state across windows.

Token ids below VOCABULARY are words of their own, MEMBERS to a class; the ids after those are the RARE classes, whose
words share one id (what a word's share of its class is, the caller knows). The input of a text's first token is START.
Texts are laid end to end in lanes; the state is zero where a text starts and is carried over everything else, so
windows bound memory, not what the model sees.
"""

from __future__ import annotations

import heapq

import numpy as np

VOCABULARY, MEMBERS, RARE = 1024, 32, 32
OWN = VOCABULARY // MEMBERS
CLASSES = OWN + RARE
START = VOCABULARY + RARE
EMBED, HIDDEN = 16, 16
#: Steps that training takes at least, where there are tokens for them: fewer lanes make more steps.
STEPS = 64
F32 = np.float32


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < VOCABULARY, ids // MEMBERS, ids - VOCABULARY + OWN)


def initial(counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """counts: of each token id below START. The biases say the unigram distribution, so training starts there."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(F32)
    c = counts.astype(np.float64) + 0.1
    in_class = c[:VOCABULARY].reshape(OWN, MEMBERS)
    of_class = np.concatenate([in_class.sum(1), c[VOCABULARY:]])
    return {
        "embed": normal(START + 1, EMBED, scale=0.3), "wx": normal(EMBED, 3 * HIDDEN, scale=EMBED**-0.5), "bx": np.zeros(3 * HIDDEN, F32),
        "u": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "wc": np.zeros((HIDDEN, CLASSES), F32), "bc": np.log(of_class / of_class.sum()).astype(F32),
        "ww": np.zeros((OWN, HIDDEN, MEMBERS), F32), "bw": np.log(in_class / in_class.sum(1, keepdims=True)).astype(F32),
    }


def to_bytes(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(F32).tobytes() for k in sorted(p))


def from_bytes(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.frombuffer(data, F32, n, at).reshape(like[k].shape).copy()
        at += 4 * n
    return out


class Lanes:
    """Texts (arrays of token ids, none empty) end to end in at most n lanes, the longest lane first."""

    def __init__(self, texts: list[np.ndarray], n: int):
        n = max(1, min(n, len(texts)))
        heap = [(0, i) for i in range(n)]
        dealt: list[list[int]] = [[] for _ in range(n)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            length, lane = heapq.heappop(heap)
            dealt[lane].append(i)
            heapq.heappush(heap, (length + len(texts[i]), lane))
        dealt.sort(key=lambda own: -sum(len(texts[i]) for i in own))
        self.lengths = np.array([sum(len(texts[i]) for i in own) for own in dealt])
        self.steps = int(self.lengths.max())
        self.x = np.full((self.steps, n), START, np.int32)
        self.y = np.full((self.steps, n), -1, np.int32)
        self.text = np.zeros((self.steps, n), np.int32)
        for lane, own in enumerate(dealt):
            at = 0
            for i in own:
                ids = texts[i]
                self.y[at : at + len(ids), lane] = ids
                self.x[at + 1 : at + len(ids), lane] = ids[:-1]
                self.text[at : at + len(ids), lane] = i
                at += len(ids)

    def windows(self, size: int):
        """Start, end, number of lanes that still have tokens."""
        for at in range(0, self.steps, size):
            yield at, min(at + size, self.steps), int((self.lengths > at).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after each step of a window. x: steps x lanes; h: lanes x HIDDEN. With keep, also what backward needs."""
    table = p["embed"] @ p["wx"] + p["bx"]
    steps, n = x.shape
    hs = np.empty((steps, n, HIDDEN), F32)
    kept = np.empty((5, steps, n, HIDDEN), F32) if keep else None
    u, two = p["u"], 2 * HIDDEN
    # The parts of the gates and of the candidate lie apart, so that a step works in place on whole arrays.
    into, cand = np.ascontiguousarray(table[:, :two]).take(x, 0), np.ascontiguousarray(table[:, two:]).take(x, 0)
    u_gates, u_cand = np.ascontiguousarray(u[:, :two]), np.ascontiguousarray(u[:, two:])
    gates, an, own = np.empty((n, two), F32), np.empty((n, HIDDEN), F32), np.empty((n, HIDDEN), F32)
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    starts = x == START
    any_start = starts.any(1)
    for t in range(steps):
        if any_start[t]:
            h = np.where(starts[t][:, None], F32(0), h)
        np.matmul(h, u_gates, out=gates)
        gates += into[t]
        _sigmoid(gates)
        np.matmul(h, u_cand, out=an)
        c = np.multiply(r, an, out=own)
        c += cand[t]
        np.tanh(c, out=c)
        if keep:
            kept[0, t], kept[1, t], kept[2, t], kept[3, t], kept[4, t] = h, z, r, an, c
        out = np.subtract(h, c, out=hs[t])
        out *= z
        out += c
        h = out
    return (hs, h, kept) if keep else (hs, h)


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit of any state can overflow: states are within -1 and 1."""
    return float((np.abs(weights).sum(-2) + np.abs(bias)).max()) < 80


def _picked(logits: np.ndarray, target: np.ndarray, tame: bool) -> np.ndarray:
    """The log softmax of one entry a row; logits is overwritten."""
    if not tame:
        logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(1))


def _slope(logits: np.ndarray, target: np.ndarray, total: int, tame: bool) -> tuple[np.ndarray, float]:
    """By logit, the derivative of the sum of the negative log softmax of one entry a row, over total; and that sum. logits is overwritten."""
    if not tame:
        logits -= logits.max(1, keepdims=True)
    at = np.arange(len(target))
    chosen = logits[at, target]
    np.exp(logits, out=logits)
    whole = logits.sum(1, keepdims=True)
    logits *= 1 / (whole * total)
    logits[at, target] -= 1 / total
    return logits, np.log(whole).sum() - chosen.sum()


def log_probabilities(p: dict[str, np.ndarray], hs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target id. hs: rows x HIDDEN."""
    cls = class_of(y)
    logits = hs @ p["wc"]
    logits += p["bc"]
    out = _picked(logits, cls, _tame(p["wc"], p["bc"]))
    tame = _tame(p["ww"], p["bw"])
    own = np.flatnonzero(y < VOCABULARY)
    order = own[np.argsort(cls[own], kind="stable")]
    ends = np.searchsorted(cls[order], np.arange(OWN + 1))
    for k in range(OWN):
        i = order[ends[k] : ends[k + 1]]
        if len(i):
            out[i] += _picked(hs[i] @ p["ww"][k] + p["bw"][k], y[i] % MEMBERS, tame)
    return out


def score(p: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of each text."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    laid = Lanes(texts, lanes)
    h = np.zeros((len(laid.lengths), HIDDEN), F32)
    for at, end, n in laid.windows(window):
        hs, h = run(p, laid.x[at:end, :n], h[:n])
        y = laid.y[at:end, :n].ravel()
        real = np.flatnonzero(y >= 0)
        out += np.bincount(laid.text[at:end, :n].ravel()[real], log_probabilities(p, hs.reshape(-1, HIDDEN)[real], y[real]), len(texts))
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean negative log probability over a window, the last state, and the loss."""
    hs, last, kept = run(p, x, h, keep=True)
    steps, n = x.shape
    rows = hs.reshape(-1, HIDDEN)
    flat = y.ravel()
    real = np.flatnonzero(flat >= 0)
    target = flat[real]
    total = max(len(real), 1)
    cls = class_of(target)
    hr = rows[real]
    d = {k: np.zeros_like(v) for k, v in p.items()}
    dl, loss = _slope(hr @ p["wc"] + p["bc"], cls, total, _tame(p["wc"], p["bc"]))
    tame = _tame(p["ww"], p["bw"])
    d["wc"], d["bc"] = hr.T @ dl, dl.sum(0)
    dr = dl @ p["wc"].T
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(OWN + 1))
    for k in range(OWN):
        i = order[ends[k] : ends[k + 1]]
        if not len(i):
            continue
        hk, member = hr[i], target[i] % MEMBERS
        dw, more = _slope(hk @ p["ww"][k] + p["bw"][k], member, total, tame)
        loss += more
        d["ww"][k], d["bw"][k] = hk.T @ dw, dw.sum(0)
        dr[i] += dw @ p["ww"][k].T
    dhs = np.zeros_like(rows)
    dhs[real] = dr
    dhs = dhs.reshape(steps, n, HIDDEN)
    h0, z, r, an, c = kept
    by_c, by_z, by_r = (1 - z) * (1 - c * c), (h0 - c) * z * (1 - z), an * r * (1 - r)
    starts = x == START
    any_start = starts.any(1)
    dh = np.zeros((n, HIDDEN), F32)
    # dg: of the gates' inputs; da: of the state's part in them.
    dg, da = np.empty((steps, n, 3 * HIDDEN), F32), np.empty((steps, n, 3 * HIDDEN), F32)
    back = np.ascontiguousarray(p["u"].T)
    for t in range(steps - 1, -1, -1):
        dh += dhs[t]
        dc = dh * by_c[t]
        da[t, :, :HIDDEN] = dh * by_z[t]
        da[t, :, HIDDEN : 2 * HIDDEN] = dc * by_r[t]
        da[t, :, 2 * HIDDEN :] = dc * r[t]
        dg[t, :, 2 * HIDDEN :] = dc
        dh *= z[t]
        dh += da[t] @ back
        if any_start[t]:
            dh[starts[t]] = 0
    dg[:, :, : 2 * HIDDEN] = da[:, :, : 2 * HIDDEN]
    d["u"] = h0.reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
    dt = dg.reshape(-1, 3 * HIDDEN)
    d["bx"] = dt.sum(0)
    order = np.argsort(x.ravel(), kind="stable")
    ids, first = np.unique(x.ravel()[order], return_index=True)
    summed = np.add.reduceat(dt[order], first, axis=0)
    d["embed"][ids] = summed @ p["wx"].T
    d["wx"] = p["embed"][ids].T @ summed
    return d, last, float(loss) / total


def train(p: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = 128, window: int = 32, rate: float = 0.01) -> tuple[dict[str, np.ndarray], int]:
    """One pass of Adam over the texts; the parameters after it and the tokens seen. The rate falls linearly to a tenth."""
    if not texts:
        return p, 0
    laid = Lanes(texts, max(1, min(lanes, sum(map(len, texts)) // (STEPS * window))))
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    h = np.zeros((len(laid.lengths), HIDDEN), F32)
    todo = list(laid.windows(window))
    for step, (at, end, n) in enumerate(todo, 1):
        d, h, _ = gradients(p, laid.x[at:end, :n], laid.y[at:end, :n], h[:n])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in d.values())))
        scale = min(1.0, 1.0 / (norm + 1e-6))
        lr = rate * (1 - 0.9 * step / len(todo)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, g in d.items():
            g *= F32(scale)
            m[k] += F32(0.1) * (g - m[k])
            v[k] += F32(0.01) * (g * g - v[k])
            p[k] -= F32(lr) * m[k] / (np.sqrt(v[k]) + F32(1e-6))
    return p, int((laid.y >= 0).sum())
