"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, tagging and storage."""

from __future__ import annotations

import multiprocessing
import time
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from quern.llm.shapes import KINDS

#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
CHARS = 3 + 95 + 2 * len(_CYRILLIC) + 8


def _code(c: int) -> int:
    """0 padding, 1 line break, 2 tab and spaces, printable ASCII, Cyrillic letters, classes of everything else."""
    ch = chr(c)
    if ch in "\n\r\x0b\x0c\x85\u2028\u2029":
        return 1
    if ch.isspace():
        return 2
    if 33 <= c < 127:
        return 3 + c - 33
    if ch.lower() in _CYRILLIC:
        return 98 + _CYRILLIC.index(ch.lower()) + (len(_CYRILLIC) if ch.isupper() else 0)
    base = unicodedata.normalize("NFKD", ch)[:1]
    if base and 33 <= ord(base) < 127:
        return 3 + ord(base) - 33
    rest = 98 + 2 * len(_CYRILLIC)
    if ch.isalpha():
        return rest + (0 if ch.isupper() else 1 if ch.islower() else 2)
    return rest + (3 if ch.isdigit() else 4 if unicodedata.category(ch)[0] == "P" else 5)


_TABLE = np.array([_code(c) for c in range(0x3000)], np.int16)


def encode(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(cp, 0x2FFF)]
    odd = np.flatnonzero(cp >= 0x3000)
    if len(odd):
        u, back = np.unique(cp[odd], return_inverse=True)
        out[odd] = np.array([_code(int(c)) if not 0xD800 <= c < 0xE000 else 2 for c in u], np.int16)[back]
    return out


@dataclass
class Tagger:
    """Weights by name: E (characters), and for each direction W (input), U (recurrent), b; V, c (output), T, S, Z (transitions, start, end)."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int = 32, chars: int = 16, seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        w = {"E": r.normal(0, 0.3, (CHARS, chars))}
        for d in "fr":
            w["W" + d] = r.normal(0, 1 / np.sqrt(chars), (chars, 4 * hidden))
            w["U" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w["b" + d] = np.zeros(4 * hidden)
            w["b" + d][hidden : 2 * hidden] = 1
        w |= {"V": r.normal(0, 0.2, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS), "Z": np.zeros(TAGS)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    # inference

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """Hidden states of one direction for codes x (time, batch). The sigmoids are taken as tanh of half the input, so one call serves all gates."""
        h4 = self.w["U" + d].shape[1]
        h = h4 // 4
        half = np.full(h4, 0.5, np.float32)
        half[2 * h : 3 * h] = 1
        table = (self.w["E"] @ self.w["W" + d] + self.w["b" + d]) * half
        u = np.ascontiguousarray(self.w["U" + d] * half)
        steps, batch = x.shape
        out = np.empty((steps, batch, h), np.float32)
        s, c = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = s @ u
            z += table[x[t]]
            np.tanh(z, out=z)
            g = z[:, 2 * h : 3 * h].copy()
            z += 1
            z *= 0.5
            c *= z[:, h : 2 * h]
            g *= z[:, :h]
            c += g
            np.tanh(c, out=s)
            s *= z[:, 3 * h :]
            out[t] = s
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, batch, tags) for codes (time, batch); padding is at the end and only fits O."""
        steps, batch = x.shape
        h = self.w["V"].shape[0] // 2
        score = self._states(x, "f").reshape(-1, h) @ self.w["V"][:h]
        score += self._states(x, "r").reshape(-1, h) @ self.w["V"][h:]
        score = (score + self.w["c"]).reshape(steps, batch, TAGS)
        score[x == 0, 1:] -= 1e4
        return score

    def blank(self, score: np.ndarray) -> np.ndarray:
        """Which sequences of the batch are O throughout, by a bound that is never wrong.

        The kinds are put together: a B and an I state take the best score and the best
        transition of all of theirs, so no path of the tagger gains more over O than the best path of these three states.
        """
        t, b, i = self.w["T"] - self.w["T"][0, 0], slice(1, None, 2), slice(2, None, 2)
        s, z = self.w["S"] - self.w["S"][0], self.w["Z"] - self.w["Z"][0]
        ob, oi, bb, bi, ib, ii, bo, io = (float(x.max()) for x in (t[0, b], t[0, i], t[b, b], t[b, i], t[i, b], t[i, i], t[b, 0], t[i, 0]))
        eb = score[:, :, b].max(2) - score[:, :, 0]
        ei = score[:, :, i].max(2) - score[:, :, 0]
        at_b, at_i, back = eb[0] + s[b].max(), ei[0] + s[i].max(), np.full(score.shape[1], -1e9, np.float32)
        for k in range(1, len(score)):
            out = np.maximum(back, 0)
            new_b = eb[k] + np.maximum(np.maximum(out + ob, at_b + bb), at_i + ib)
            new_i = ei[k] + np.maximum(np.maximum(out + oi, at_b + bi), at_i + ii)
            back = np.maximum(back, np.maximum(at_b + bo, at_i + io))
            at_b, at_i = new_b, new_i
        return np.maximum(back, np.maximum(at_b + z[b].max(), at_i + z[i].max())) < 0

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Best tag sequence (time, batch) under the transitions; the ways back are looked up only where they are taken."""
        steps, batch, _ = score.shape
        trans = self.w["T"]
        held = np.empty((steps, batch, TAGS), np.float32)
        held[0] = score[0] + self.w["S"]
        for t in range(1, steps):
            v = held[t - 1]
            m = v[:, 0, None] + trans[0]
            for k in range(1, TAGS):
                np.maximum(m, v[:, k, None] + trans[k], out=m)
            np.add(m, score[t], out=held[t])
        best = (held[-1] + self.w["Z"]).argmax(1)
        turned = np.ascontiguousarray(trans.T)
        out = np.empty((steps, batch), np.int8)
        out[-1] = best
        for t in range(steps - 1, 0, -1):
            best = (held[t - 1] + turned[best]).argmax(1)
            out[t - 1] = best
        return out

    def decode_pieces(self, pieces: Iterable[np.ndarray], length: int) -> np.ndarray:
        """Best tags of one sequence whose scores (time, tags) come in pieces; only the way back is held for all of it."""
        turned = np.ascontiguousarray(self.w["T"].T)
        back = np.empty((length, TAGS), np.int8)
        v, t = None, 0
        for piece in pieces:
            for row in piece:
                if v is None:
                    v = row + self.w["S"]
                else:
                    m = v + turned
                    back[t] = m.argmax(1)
                    v = m.max(1) + row
                t += 1
            v = v - v.max()
        out = np.empty(length, np.int8)
        out[-1] = best = int((v + self.w["Z"]).argmax())
        for t in range(length - 1, 0, -1):
            out[t - 1] = best = int(back[t, best])
        return out

    def tags(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence (time, batch) for codes (time, batch); padding is at the end."""
        score = self.emissions(x)
        out = np.zeros(x.shape, np.int8)
        some = np.flatnonzero(~self.blank(score))
        if len(some):
            out[:, some] = self.decode(score[:, some])
        return out

    # training

    def gradients(self, x: np.ndarray, y: np.ndarray, drop: float = 0.0, seed: int = 0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood over the batch and its gradients; x, y (time, batch), padding (code 0) at the end.

        drop: share of the states, alike at all characters of a sequence, left out.
        """
        w = self.w
        steps, batch = x.shape
        h = w["V"].shape[0] // 2
        mask = x != 0
        keep = {}
        emb = w["E"][x]
        for d in "fr":
            s, c = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
            pre = (emb.reshape(-1, emb.shape[-1]) @ w["W" + d] + w["b" + d]).reshape(steps, batch, -1)
            gates, cells, states = np.empty_like(pre), np.empty((steps, batch, h), np.float32), np.empty((steps, batch, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = pre[t] + s @ w["U" + d]
                i, f, o = (1 / (1 + np.exp(-z[:, k * h : (k + 1) * h])) for k in (0, 1, 3))
                g = np.tanh(z[:, 2 * h : 3 * h])
                c = f * c + i * g
                s = o * np.tanh(c)
                gates[t] = np.concatenate([i, f, g, o], 1)
                cells[t], states[t] = c, s
            keep[d] = gates, cells, states
        kept = ((np.random.default_rng(seed).random((batch, 2 * h)) >= drop) / (1 - drop)).astype(np.float32)
        both = np.concatenate([keep["f"][2], keep["r"][2]], 2) * kept
        score = both @ w["V"] + w["c"]

        # CRF: forward and backward over the masked sequences, in probabilities scaled at each step
        top = score.max(2, keepdims=True)
        es = np.exp(score - top)
        step = np.exp(w["T"])
        first, final = np.exp(w["S"]), np.exp(w["Z"])
        alpha, scale = np.empty_like(score), np.ones((steps, batch), np.float32)
        a = es[0] * first
        scale[0] = a.sum(1)
        alpha[0] = a / scale[0][:, None]
        for t in range(1, steps):
            a = (alpha[t - 1] @ step) * es[t]
            scale[t] = np.where(mask[t], a.sum(1), 1)
            alpha[t] = np.where(mask[t][:, None], a / scale[t][:, None], alpha[t - 1])
        last = (alpha[-1] * final).sum(1)
        log_z = np.where(mask, np.log(scale) + top[:, :, 0], 0).sum(0) + np.log(last)
        beta = np.empty_like(score)
        beta[-1] = final / last[:, None]
        come = np.zeros_like(score)
        for t in range(steps - 1, 0, -1):
            come[t] = np.where(mask[t][:, None], es[t] * beta[t] / scale[t][:, None], 0)
            beta[t - 1] = np.where(mask[t][:, None], come[t] @ step.T, beta[t])
        gT = step * (alpha[:-1].reshape(-1, TAGS).T @ come[1:].reshape(-1, TAGS))
        gscore = np.where(mask[:, :, None], alpha * beta, 0)
        gS = gscore[0].sum(0)
        length = mask.sum(0)
        row = np.arange(batch)
        end = y[length - 1, row]
        gZ = (alpha[-1] * beta[-1]).sum(0)
        gold = w["S"][y[0]] + w["Z"][end]
        tt, bb = np.nonzero(mask)
        gold = gold + np.bincount(bb, weights=score[tt, bb, y[tt, bb]], minlength=batch)
        np.subtract.at(gscore, (tt, bb, y[tt, bb]), 1)
        t2, b2 = np.nonzero(mask[1:])
        gold = gold + np.bincount(b2, weights=w["T"][y[t2, b2], y[t2 + 1, b2]], minlength=batch)
        np.subtract.at(gT, (y[t2, b2], y[t2 + 1, b2]), 1)
        np.subtract.at(gS, y[0], 1)
        np.subtract.at(gZ, end, 1)
        loss = float((log_z - gold).mean())
        grad = {"T": gT, "S": gS, "Z": gZ, "V": both.reshape(-1, 2 * h).T @ gscore.reshape(-1, TAGS), "c": gscore.sum((0, 1))}

        # back through time
        gboth = (gscore @ w["V"].T) * kept
        gemb = np.zeros_like(emb)
        for n, d in enumerate("fr"):
            gates, cells, states = keep[d]
            gh, gc = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
            gz_all = np.empty_like(gates)
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            step = -1 if d == "f" else 1
            gU = np.zeros_like(w["U" + d])
            for t in order:
                i, f, g, o = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
                p = t + step
                inside = 0 <= p < steps
                c_before = cells[p] if inside else 0
                tc = np.tanh(cells[t])
                gh = gh + gboth[t, :, n * h : (n + 1) * h]
                gc = gc + gh * o * (1 - tc * tc)
                gz = np.concatenate([gc * g * i * (1 - i), gc * c_before * f * (1 - f), gc * i * (1 - g * g), gh * tc * o * (1 - o)], 1)
                gz_all[t] = gz
                if inside:
                    gU += states[p].T @ gz
                gc = gc * f
                gh = gz @ w["U" + d].T
            flat = gz_all.reshape(-1, 4 * h)
            grad["W" + d], grad["U" + d], grad["b" + d] = emb.reshape(-1, emb.shape[-1]).T @ flat, gU, flat.sum(0)
            gemb += (flat @ w["W" + d].T).reshape(gemb.shape)
        gE = np.zeros_like(w["E"])
        np.add.at(gE, x.ravel(), gemb.reshape(-1, emb.shape[-1]))
        grad["E"] = gE
        return loss, {k: (v / batch).astype(np.float32) for k, v in grad.items()}

    def train(self, samples: list[tuple[np.ndarray, np.ndarray]], epochs: float = 4, batch: int = 64, rate: float = 4e-3, seed: int = 3, seconds: float = 1e9, workers: int = 1, drop: float = 0.25, tell=None) -> None:
        """Adam over batches of samples of like length; samples are (codes, tags). Each step takes one batch of each worker; ends after ``seconds`` if that comes first."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = sorted(range(len(samples)), key=lambda k: (len(samples[k][0]), k * 7919 % 10_007))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        if workers > 1:
            _SHARED.update(samples=samples, groups=groups)
        pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
        began, n, losses = time.time(), 0, []
        queue: list[int] = []
        total = max(1, int(epochs * len(groups) / workers))
        while n < total:
            progress = max(n / total, (time.time() - began) / seconds)
            if progress >= 1:
                break
            if len(queue) < workers:
                queue += r.permutation(len(groups)).tolist()
            some, queue = queue[:workers], queue[workers:]
            found = pool.map(_gradient_of, [(self.w, g, drop, n) for g in some], chunksize=1) if pool else [self._of_group(samples, groups[g], drop, n) for g in some]
            grad = {k: sum(q[k] for _, q in found) / len(found) for k in self.w}
            losses.append(float(np.mean([x for x, _ in found])))
            n += 1
            size = np.sqrt(sum(float((q * q).sum()) for q in grad.values()))
            clip = min(1.0, 5.0 / (size + 1e-9))
            lr = rate * min(1.0, n / 100) * (1 - 0.97 * progress)
            for k, q in grad.items():
                q = q * clip
                m[k] += 0.1 * (q - m[k])
                v2[k] += 0.002 * (q * q - v2[k])
                self.w[k] -= lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v2[k] / (1 - 0.998**n)) + 1e-8)
            if tell and n % 500 == 0:
                tell(n, float(np.mean(losses[-500:])))
        if pool:
            pool.terminate()

    def _of_group(self, samples: list[tuple[np.ndarray, np.ndarray]], group: list[int], drop: float = 0.0, seed: int = 0) -> tuple[float, dict[str, np.ndarray]]:
        some = [samples[k] for k in group]
        steps = max(len(x) for x, _ in some)
        x = np.zeros((steps, len(some)), np.int16)
        y = np.zeros((steps, len(some)), np.int64)
        for k, (a, b) in enumerate(some):
            x[: len(a), k], y[: len(a), k] = a, b
        return self.gradients(x, y, drop, seed * 100_003 + group[0])


#: Samples and batches of the training that runs, as its worker processes inherit them.
_SHARED: dict = {}


def _gradient_of(job: tuple[dict[str, np.ndarray], int, float, int]) -> tuple[float, dict[str, np.ndarray]]:
    w, g, drop, seed = job
    return Tagger(w)._of_group(_SHARED["samples"], _SHARED["groups"][g], drop, seed)


def tag_array(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
    return y
