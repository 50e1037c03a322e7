"""Pitch and resonances of many frames at once: candidates, best paths, linear prediction of whole matrices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np


@dataclass(frozen=True)
class Pitch:
    """How pitch is tracked. Costs are for steps of 10 ms."""

    low: float = 50.0
    high: float = 550.0
    step: float = 0.015
    candidates: int = 15
    silence: float = 0.03
    voicing: float = 0.45
    octave: float = 0.01
    jump: float = 0.35
    change: float = 0.14

    def window(self, rate: float) -> int:
        """Samples of a frame: three periods of the lowest pitch."""
        return int(3 * rate / self.low) // 2 * 2

    def hop(self, rate: float) -> int:
        return max(1, int(self.step * rate))


def grid(n: int, window: int, hop: int) -> tuple[int, int]:
    """How many frames fit in n samples, and where the first begins so that they are centred."""
    if n < window:
        return 0, 0
    count = (n - window) // hop + 1
    return count, (n - window - (count - 1) * hop) // 2


def framed(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """Frames of rows of samples: rows x frames x window, without a copy."""
    return np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, ::hop]


def pitch_candidates(x: np.ndarray, rate: float, peak: np.ndarray, how: Pitch) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and strengths of the candidates of every frame: rows x frames x candidates.

    Candidate 0 is "no voice" (frequency 0); others are the highest maxima of
    the autocorrelation, corrected for the window's, with a bonus for short
    periods. ``peak`` is the highest sample of each row's recording. Places
    without a candidate have strength -inf.
    """
    frames = framed(x, how.window(rate), how.hop(rate))
    shape = frames.shape[:2]
    f, s = frame_candidates(frames.reshape(-1, frames.shape[2]), rate, np.repeat(peak, shape[1]), how)
    return f.reshape(*shape, -1), s.reshape(*shape, -1)


def frame_candidates(frames: np.ndarray, rate: float, peak: np.ndarray, how: Pitch) -> tuple[np.ndarray, np.ndarray]:
    """The same of frames as rows, of any recordings: frames x candidates. ``peak`` is that of each frame's recording."""
    window = how.window(rate)
    frames = frames - frames.mean(axis=1, keepdims=True)
    loud = np.abs(frames).max(axis=1)
    shade = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(window) + 0.5) / window)
    size = 1 << (2 * window - 1).bit_length()
    last = min(int(rate / how.low) + 2, window - 1)
    own = np.fft.irfft(np.abs(np.fft.rfft(shade, size)) ** 2)[: last + 1]
    r = np.fft.irfft(np.abs(np.fft.rfft(frames * shade, size)) ** 2)[:, : last + 1]
    power = r[:, :1]
    r = np.divide(r, power, out=np.zeros_like(r), where=power > 0) / (own / own[0])
    a, b, c = r[:, :-2], r[:, 1:-1], r[:, 2:]
    top = (b > a) & (b >= c) & (b > 0.5 * how.voicing)
    bend = np.where(top, a - 2 * b + c, -1.0)
    shift = np.where(top, 0.5 * (a - c) / bend, 0.0)
    f = rate / (np.arange(1, last) + shift)
    height = np.minimum(b - 0.25 * (a - c) * shift, 1.0)
    top &= (f >= how.low) & (f <= how.high)
    strength = np.where(top, height - how.octave * np.log2(how.low / np.where(top, f, how.low)), -np.inf)
    many = min(how.candidates - 1, strength.shape[1])
    best = np.argsort(-strength, axis=1, kind="stable")[:, :many]
    s = np.full((len(frames), how.candidates), -np.inf)
    out = np.zeros((len(frames), how.candidates))
    s[:, 1 : many + 1] = np.take_along_axis(strength, best, axis=1)
    out[:, 1 : many + 1] = np.where(np.isfinite(s[:, 1 : many + 1]), np.take_along_axis(f, best, axis=1), 0.0)
    s[:, 0] = how.voicing + np.maximum(0, 2 - (loud / np.maximum(peak, 1e-300)) * (1 + how.voicing) / how.silence)
    return out, s


def step_cost(before: np.ndarray, after: np.ndarray, rate: float, how: Pitch) -> np.ndarray:
    """Cost of going from each candidate to each of the next frame: ... x before x after."""
    scale = 0.01 * rate / how.hop(rate)
    p, q = before[..., :, None], after[..., None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        jump = how.jump * np.abs(np.log2(p / q))
    return scale * np.where((p > 0) & (q > 0), jump, np.where((p > 0) != (q > 0), how.change, 0.0))


def through(f: np.ndarray, s: np.ndarray, rate: float, how: Pitch) -> np.ndarray:
    """For rows of frames, the best score from each candidate of the first frame to each of the last: rows x first x last."""
    k = f.shape[2]
    score = np.where(np.eye(k, dtype=bool), s[:, 0][:, :, None], -np.inf)
    for t in range(1, f.shape[1]):
        score = (score[:, :, :, None] - step_cost(f[:, t - 1], f[:, t], rate, how)[:, None]).max(axis=2) + s[:, t][:, None, :]
    return score


def between(f: np.ndarray, s: np.ndarray, entry: np.ndarray, leave: np.ndarray, rate: float, how: Pitch) -> np.ndarray:
    """For rows of frames, the best path from a candidate of the first frame to one of the last: rows x frames."""
    rows, n, k = f.shape
    score = np.where(np.arange(k) == entry[:, None], s[:, 0], -np.inf)
    back = np.zeros((n, rows, k), np.int64)
    for t in range(1, n):
        reach = score[:, :, None] - step_cost(f[:, t - 1], f[:, t], rate, how)
        back[t] = reach.argmax(axis=1)
        score = np.take_along_axis(reach, back[t][:, None], axis=1)[:, 0] + s[:, t]
    path = np.zeros((rows, n), np.int64)
    path[:, -1] = leave
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[t][np.arange(rows), path[:, t]]
    return path


def joined(first: list[np.ndarray], last: list[np.ndarray], whole: list[np.ndarray], rate: float, how: Pitch) -> list[tuple[int, int]]:
    """The candidates by which the best path enters and leaves each of the parts that follow one another.

    ``first`` and ``last`` are the parts' candidates at their ends, ``whole``
    the best scores between them (:func:`through`).
    """
    best: list[tuple[np.ndarray, np.ndarray]] = []
    score = None
    for i, inner in enumerate(whole):
        if score is None:
            came, reach = np.zeros(len(inner), np.int64), np.zeros(len(inner))
        else:
            step = score[:, None] - step_cost(last[i - 1], first[i], rate, how)
            came, reach = step.argmax(axis=0), step.max(axis=0)
        inner = reach[:, None] + inner
        best.append((came, inner.argmax(axis=0)))
        score = inner.max(axis=0)
    ends, leave = [], int(score.argmax())
    for came, entry in reversed(best):
        enter = int(entry[leave])
        ends.append((enter, leave))
        leave = int(came[enter])
    return ends[::-1]


def best_pitch(x: np.ndarray, rate: float, how: Pitch = Pitch()) -> tuple[np.ndarray, np.ndarray]:
    """Pitch (0 without voice) and strength of the frames of one whole signal."""
    if len(x) < how.window(rate):
        return np.zeros(0), np.zeros(0)
    count, start = grid(len(x), how.window(rate), how.hop(rate))
    x = x - x.mean()
    f, s = pitch_candidates(x[None, start:], rate, np.abs(x).max(keepdims=True), how)
    f, s = f[:, :count], s[:, :count]
    ((entry, leave),) = joined([f[0, 0]], [f[0, -1]], list(through(f, s, rate, how)), rate, how)
    path = between(f, s, np.array([entry]), np.array([leave]), rate, how)[0]
    at = np.arange(count)
    return f[0, at, path], s[0, at, path]


#: Frames whose candidates one numpy step finds, and frames of the signals whose paths are sought together.
STEP, TOGETHER = 256, 16_384


def best_pitches(signals: list[np.ndarray], rate: float, how: Pitch = Pitch()) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`best_pitch` of many whole signals of any lengths, whose paths are sought side by side."""
    out: list = [None] * len(signals)
    grids = [grid(len(x), how.window(rate), how.hop(rate)) for x in signals]
    order = sorted(range(len(signals)), key=lambda i: -grids[i][0])
    while order:
        most = max(1, TOGETHER // max(1, grids[order[0]][0]))
        some, order = order[:most], order[most:]
        for i, found in zip(some, _side_by_side([signals[i] for i in some], [grids[i] for i in some], rate, how), strict=True):
            out[i] = found
    return out


def _side_by_side(signals: list[np.ndarray], grids: list[tuple[int, int]], rate: float, how: Pitch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pitch and strength of signals in order of their frames, the longest first; only those that have a frame take part in its step."""
    window, hop, k = how.window(rate), how.hop(rate), how.candidates
    counts = np.array([n for n, _ in grids])
    rows, longest = len(signals), int(counts[0])
    if not longest:
        return [(np.zeros(0), np.zeros(0))] * rows
    f, s = np.zeros((longest, rows, k)), np.full((longest, rows, k), -np.inf)
    for row, (x, (n, start)) in enumerate(zip(signals, grids, strict=True)):
        if n:
            x = x - x.mean()
            frames, peak = framed(x[None, start:], window, hop)[0], np.abs(x).max()
            for i in range(0, n, STEP):
                part = frames[i : min(i + STEP, n)]
                f[i : i + len(part), row], s[i : i + len(part), row] = frame_candidates(part, rate, np.full(len(part), peak), how)
    back = np.zeros((longest, rows, k), np.min_scalar_type(k))
    score = s[0].copy()
    for t in range(1, longest):
        m = int(np.searchsorted(-counts, -t))  # rows with more than t frames
        reach = score[:m, :, None] - step_cost(f[t - 1, :m], f[t, :m], rate, how)
        at = reach.argmax(axis=1)
        back[t, :m] = at
        score[:m] = np.take_along_axis(reach, at[:, None], axis=1)[:, 0] + s[t, :m]
    place = score.argmax(axis=1)
    path = np.zeros((longest, rows), np.int64)
    for t in range(longest - 1, -1, -1):
        m = int(np.searchsorted(-counts, -t))
        path[t, :m] = place[:m]
        place[:m] = back[t, np.arange(m), place[:m]]
    pick = lambda v: np.take_along_axis(v, path[:, :, None], axis=2)[:, :, 0]
    f, s = pick(f), pick(s)
    return [(f[:n, row].copy(), s[:n, row].copy()) for row, n in enumerate(counts)]


def _filter(phase: int, up: int, down: int, taps: int) -> np.ndarray:
    """The windowed sinc that gives the samples of one phase."""
    offset = phase * down % up / up - np.arange(-taps, taps + 1)
    cut = min(1.0, up / down)
    return cut * np.sinc(cut * offset) * (0.5 + 0.5 * np.cos(np.pi * np.clip(offset / (taps + 1), -1, 1)))


@lru_cache(maxsize=32)
def _filters(up: int, down: int, taps: int) -> np.ndarray:
    """The filters of some rounds of all phases as columns, each where its samples are: samples x results."""
    many = up * max(1, 32 // up)
    out = np.zeros(((many - 1) * down // up + 2 * taps + 1, many))
    for i in range(many):
        out[i * down // up : i * down // up + 2 * taps + 1, i] = _filter(i % up, up, down, taps)
    return out


def resampled(x: np.ndarray, rate: int, target: int, taps: int = 32) -> np.ndarray:
    """Band-limited resampling of a signal, or of rows of them, by windowed sinc filters, one for each phase; rates with few phases as products of matrices."""
    if rate == target or not x.shape[-1]:
        return x
    divisor = gcd(rate, target)
    up, down = target // divisor, rate // divisor
    count = x.shape[-1] * target // rate
    if max(up, down) <= 64:
        filters = _filters(up, down, taps)
        step = filters.shape[1] // up * down
        blocks = -(-count // filters.shape[1])
        padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps, max(0, blocks * step + len(filters) - taps - x.shape[-1]))])
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(filters), axis=-1)[..., : blocks * step : step, :]
        return (np.ascontiguousarray(windows) @ filters).reshape(*x.shape[:-1], -1)[..., :count]
    out = np.zeros((*x.shape[:-1], count))
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps, taps + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps + 1, axis=-1)
    for phase in range(min(up, out.shape[-1])):
        part = out[..., phase::up]
        part[...] = windows[..., phase * down // up :: down, :][..., : part.shape[-1], :] @ _filter(phase, up, down, taps)
    return out


#: Rows whose predictor is sought together, so that their errors stay in the cache, and polynomials whose roots are.
PREDICTED, SOLVED = 256, 8192


def burg_rows(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients of each row that minimise forward and backward errors together (Burg).

    Errors are held without gaps and backward ones read ``step`` samples earlier,
    so that a step runs over whole arrays; a row's first ``step`` places then hold
    what belongs to the row before it, and count nowhere.
    """
    count, n = x.shape
    out = np.zeros((count, order + 1))
    out[:, 0] = 1
    held = np.zeros((4, order + min(count, PREDICTED) * n))
    for first in range(0, count, PREDICTED):
        part, a = x[first : first + PREDICTED], out[first : first + PREDICTED]
        place = lambda i, back=0, m=len(part): held[i, order - back : order - back + m * n].reshape(m, n)
        f, moved, more = place(0), place(2), place(3)
        f[...] = place(1)[...] = part
        for step in range(1, order + 1):
            b = place(1, step)
            u, v = f[:, step:], b[:, step:]
            power = np.vecdot(u, u) + np.vecdot(v, v)
            k = np.divide(-2 * np.vecdot(u, v), power, out=np.zeros(len(part)), where=power > 0)[:, None]
            a[:, 1 : step + 1] += k * a[:, :step][:, ::-1]
            if step < order:
                np.multiply(b, k, out=moved)
                np.multiply(f, k, out=more)
                f += moved
                b += more
    return out


def _laguerre(c: np.ndarray) -> np.ndarray:
    """One root of each monic polynomial (coefficients x polynomials), mostly that nearest to 0, to some ten digits."""
    degree = len(c) - 1
    z = np.zeros(c.shape[1], complex)
    going = np.arange(c.shape[1])
    for _ in range(25):
        w = z[going]
        p, d, e = np.ones_like(w), np.zeros_like(w), np.zeros_like(w)
        for x in c[1:]:
            e *= w
            e += d
            d *= w
            d += p
            p *= w
            p += x
        root = np.sqrt((degree - 1) * ((degree - 1) * d * d - 2 * degree * p * e))
        more, less = d + root, d - root
        below = np.where(np.abs(more) >= np.abs(less), more, less)
        step = np.divide(degree * p, below, out=np.zeros_like(p), where=below != 0)
        w -= step
        z[going] = w
        still = np.abs(step) > 1e-5 * np.abs(w)  # steps shrink to the third power
        if not still.any():
            break
        going, c = going[still], c[:, still]
    return z


def _divided(c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Polynomials without their root, if it is real, else without it and its conjugate; all of one kind."""
    pair = np.iscomplexobj(z)
    q = c[: -2 if pair else -1].copy()
    for j in range(1, len(q)):
        q[j] += 2 * z.real * q[j - 1] if pair else z * q[j - 1]
        if pair and j > 1:
            q[j] -= (z.real**2 + z.imag**2) * q[j - 2]
    return q


def _found_roots(a: np.ndarray) -> np.ndarray:
    """Roots of monic real polynomials (rows), found and divided off one by one, those of each remaining degree together."""
    n, whole = a.shape[1] - 1, np.ascontiguousarray(a.T)
    out = np.zeros((n, len(a)), complex)
    left: dict[int, list] = {n: [(np.arange(len(a)), whole)]}
    for degree in range(n, 0, -1):
        if degree not in left:
            continue
        rows, c = (np.concatenate(v, axis=-1) for v in zip(*left.pop(degree), strict=True))
        z = _laguerre(c)
        real = np.abs(z.imag) <= 1e-9 * np.abs(z)
        z.imag[real] = 0
        p, d = np.ones_like(z), np.zeros_like(z)
        for x in whole[1:, rows]:  # a step on the whole polynomial
            d *= z
            d += p
            p *= z
            p += x
        z -= np.divide(p, d, out=np.zeros_like(p), where=d != 0)
        out[n - degree, rows] = z
        for some, of, size in ((real, z.real, 1), (~real, z, 2)):
            if not some.any() or size > degree:
                continue
            if size == 2:
                out[n - degree + 1, rows[some]] = z[some].conj()
            if degree > size:
                left.setdefault(degree - size, []).append((rows[some], _divided(c[:, some], of[some])))
    return out.T


def roots(a: np.ndarray) -> np.ndarray:
    """Roots of monic real polynomials, coefficients in rows: rows x degree, in any order.

    Those whose roots, multiplied out, aren't the polynomial to ten digits of its
    greatest coefficient are solved as eigenvalues.
    """
    degree = a.shape[1] - 1
    out = np.empty((len(a), degree), complex)
    for first in range(0, len(a), SOLVED):
        part, found = a[first : first + SOLVED], out[first : first + SOLVED]
        with np.errstate(all="ignore"):
            found[...] = _found_roots(part)
            again = np.zeros((degree + 1, len(part)), complex)
            again[0] = 1
            for i, z in enumerate(found.T):
                again[1 : i + 2] -= z * again[: i + 1]
            good = np.abs(again - part.T).max(axis=0) <= 1e-10 * np.abs(part).max(axis=1)
        if not good.all():
            companion = np.zeros((int((~good).sum()), degree, degree))
            companion[:, np.arange(1, degree), np.arange(degree - 1)] = 1
            companion[:, 0] = -part[~good, 1:]
            found[~good] = np.linalg.eigvals(companion)
    return out


def poles(a: np.ndarray, rate: float, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The first frequencies of each row's poles between 50 Hz and half the rate less 50 Hz, and their widths; 0 where there are fewer."""
    z = roots(a)
    f, width = np.angle(z) * rate / (2 * np.pi), -np.log(np.maximum(np.abs(z), 1e-12)) * rate / np.pi
    f = np.where((z.imag > 0) & (f > 50) & (f < rate / 2 - 50), f, np.inf)
    at = np.argsort(f, axis=1)[:, :most]
    f, width = np.take_along_axis(f, at, axis=1), np.take_along_axis(width, at, axis=1)
    return np.where(np.isfinite(f), f, 0.0), np.where(np.isfinite(f), width, 0.0)


def track_score(f: np.ndarray, width: np.ndarray, ceiling: float) -> float:
    """Plausibility of one recording's resonances (frames x 4, 0 where there is none) under a ceiling, as :func:`sonoframe.operators.frames.track_score` has it."""
    if len(f) < 2:
        return 0.0
    there = f > 0
    score = 0.0
    for one, some in zip(f.T, there.T, strict=True):
        steps = np.abs(np.diff(one[some]))
        score += 1 - min(1.0, steps.mean() / (one[some].mean() * 0.1)) if len(steps) else 0.0
    whole = there.all(axis=1)
    ordered = (np.diff(f[whole], axis=1) > 0).all(axis=1).mean() if whole.any() else 0.0
    fine = ((width[:, :3] > 0) & (width[:, :3] < 500)).mean()
    ratio = f[there[:, 3], 3].mean() / ceiling if there[:, 3].any() else 0.0
    return float(score + 2 * ordered + fine - (~there).mean() - (min(1.0, (ratio - 0.85) / 0.10) if ratio > 0.85 else 0.0))


#: Seconds between frames of resonances, and seconds of one; poles of the predictor; where emphasis of high frequencies begins.
FORMANT_STEP, FORMANT_WINDOW, ORDER, EMPHASIS = 0.00625, 0.05, 10, 50.0


def formant_predictors(x: np.ndarray, rate: int, ceiling: int, centers: np.ndarray) -> np.ndarray:
    """Predictors of frames around given places of the rows, which are resampled to twice the ceiling: rows * frames x coefficients.

    ``centers`` are samples at twice the ceiling.
    """
    target = 2 * ceiling
    y = resampled(x, rate, target)
    y = np.concatenate([y[:, :1], y[:, 1:] - np.exp(-2 * np.pi * EMPHASIS / target) * y[:, :-1]], axis=1)
    n = int(FORMANT_WINDOW * target)
    y = np.pad(y, [(0, 0), (n, n)])
    at = np.arange(1, n + 1) - 0.5 * (n + 1)
    shade = (np.exp(-48 * (at / (n + 1)) ** 2) - np.exp(-12)) / (1 - np.exp(-12))
    rows = np.lib.stride_tricks.sliding_window_view(y, n, axis=1)[:, centers + n - n // 2]
    return burg_rows(rows.reshape(-1, n) * shade, ORDER)


def formant_frames(x: np.ndarray, rate: int, ceiling: int, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First four resonances below the ceiling and their widths, of the same frames: rows x frames x 4."""
    f, width = poles(formant_predictors(x, rate, ceiling, centers), 2 * ceiling)
    return f.reshape(len(x), -1, 4), width.reshape(len(x), -1, 4)
