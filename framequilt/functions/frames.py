"""Maps of video frames in numpy: where tissue, detail and motion are, and the window that holds them.

Frames are arrays of height x width x 3 bytes, blue first. A video is analysed from a few sampled frames, so one call
holds what one task can.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Hue bands (0 to 179) with their weight, and how saturation and brightness open the gate.
_HUES = ((0, 12, 1.0), (165, 179, 1.0), (145, 179, 0.7), (8, 22, 0.45))
_GATE = ((0.18, 0.35), (0.12, 0.35))
_WARM = (0.6, 0.35)
_TISSUE = (0.65, 0.35)
# Weights of tissue, saturation, detail and motion; how much the centre counts; widths of the blurs.
_WEIGHTS = {"tissue": 0.50, "saturation": 0.20, "detail": 0.18, "motion": 0.12}
_CENTRE = (0.65, 0.35, 0.40)
_BLUR = {"tissue": 3.0, "detail": 2.0, "motion": 2.0, "frame": 4.0, "mean": 6.0}
# Least threshold as a share of the maximum, sides of the closing (twice) and opening squares, least share of a component.
_LEAST_THRESHOLD, _CLOSE, _OPEN, _LEAST_AREA = 0.28, 11, 5, 0.03


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur; what lies beyond a border is mirrored at its outermost pixels."""
    reach = (int(round(sigma * 8 + 1)) | 1) // 2
    taps = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    taps /= taps.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > 1 else "edge")
        n = out.shape[axis]
        out = sum(t * np.take(wide, range(k, k + n), axis=axis) for k, t in enumerate(taps))
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Shrinks by the mean of the area that each pixel covers."""

    def cover(old: int, new: int) -> np.ndarray:
        edges = np.arange(new + 1) * old / new
        low, high = edges[:-1, None], edges[1:, None]
        share = np.clip(np.minimum(high, np.arange(1, old + 1)) - np.maximum(low, np.arange(old)), 0, None)
        return share / share.sum(axis=1, keepdims=True)

    rows, cols = cover(image.shape[0], height), cover(image.shape[1], width)
    return np.rint(np.einsum("ih,hwc,jw->ijc", rows, image.astype(np.float64), cols, optimize=True)).astype(np.uint8)


def hue_saturation_value(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue from 0 to 179 in whole steps, saturation and value from 0 to 1."""
    b, g, r = (frame[:, :, i].astype(np.float64) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(v > low, v - low, 1.0)
    h = np.where(v == r, (g - b) / span, np.where(v == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30
    h = np.rint(np.where(v > low, h % 180, 0)) % 180
    return h, np.rint(255 * (v - low) / np.where(v > 0, v, 1)) / 255, v / 255


def scaled_to_one(image: np.ndarray) -> np.ndarray:
    top = image.max(initial=0.0)
    return image / top if top > 1e-6 else image


def gray(frame: np.ndarray) -> np.ndarray:
    """Brightness as the eye weighs colours, in whole steps."""
    return np.rint(frame.astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def tissue_map(frame: np.ndarray) -> np.ndarray:
    """How much each pixel looks like tissue, 0 to 1: red and pink hues that are neither dull nor dark, and warm colours."""
    h, s, v = hue_saturation_value(frame)
    hue = np.zeros(h.shape)
    for low, high, w in _HUES:
        hue = np.maximum(hue, w * ((h >= low) & (h <= high)))
    gate = np.prod([np.clip((x - least) / width, 0, 1) for x, (least, width) in zip((s, v), _GATE, strict=True)], axis=0)
    b, g, r = (frame[:, :, i] / 255.0 for i in range(3))
    warm = np.clip(r - _WARM[0] * g - _WARM[1] * b, 0, 1)
    return scaled_to_one(blurred(_TISSUE[0] * hue * gate + _TISSUE[1] * warm, _BLUR["tissue"]))


def detail_map(light: np.ndarray) -> np.ndarray:
    """Strength of edges, 0 to 1."""
    wide = np.pad(light, 1, mode="reflect" if min(light.shape) > 1 else "edge")
    down = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    right = wide[:, :-2] + 2 * wide[:, 1:-1] + wide[:, 2:]
    return scaled_to_one(blurred(np.hypot(down[:, 2:] - down[:, :-2], right[2:] - right[:-2]), _BLUR["detail"]))


def motion_map(light: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Change since the frame before, 0 to 1; none for the first frame."""
    return np.zeros(light.shape) if before is None else scaled_to_one(blurred(np.abs(light - before), _BLUR["motion"]))


def centre_map(height: int, width: int) -> np.ndarray:
    """A bell over the middle, 1 at its top."""
    y = (np.arange(height) - (height - 1) / 2) / max(height / 2, 1.0)
    x = (np.arange(width) - (width - 1) / 2) / max(width / 2, 1.0)
    return scaled_to_one(np.exp(-(y[:, None] ** 2 + x[None, :] ** 2) / (2 * _CENTRE[2] ** 2)))


def saliency(frames: Sequence[np.ndarray], most: int = 640) -> tuple[np.ndarray, float]:
    """Mean saliency of a video's frames, 0 to 1, in the size of the first one after shrinking to ``most`` pixels, and the scale."""
    h, w = frames[0].shape[:2]
    scale = min(1.0, most / max(h, w))
    height, width = (round(h * scale), round(w * scale)) if scale < 1 else (h, w)
    total, before = np.zeros((height, width)), None
    weight = _CENTRE[0] + _CENTRE[1] * centre_map(height, width)
    for frame in frames:
        small = frame if frame.shape[:2] == (height, width) else resized(frame, height, width)
        light = gray(small) / 255
        maps = {"tissue": tissue_map(small), "saturation": hue_saturation_value(small)[1], "detail": detail_map(light), "motion": motion_map(light, before)}
        total += blurred(sum(_WEIGHTS[k] * m for k, m in maps.items()) * weight, _BLUR["frame"])
        before = light
    return scaled_to_one(blurred(total / len(frames), _BLUR["mean"])), scale


def _window_counts(mask: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Set pixels in the square around each pixel, and pixels of the square that lie in the image."""

    def sums(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (side // 2 + 1, side // 2)
            upto = np.cumsum(np.pad(a, pad), axis=axis)
            n = a.shape[axis]
            a = np.take(upto, range(side, side + n), axis=axis) - np.take(upto, range(n), axis=axis)
        return a

    return sums(mask.astype(np.int64)), sums(np.ones(mask.shape, dtype=np.int64))


def dilated(mask: np.ndarray, side: int) -> np.ndarray:
    return _window_counts(mask, side)[0] > 0


def eroded(mask: np.ndarray, side: int) -> np.ndarray:
    have, all_of = _window_counts(mask, side)
    return have == all_of


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Connected areas, diagonals included: x, y, width, height, pixels; in the order of their first pixel."""
    up: list[int] = []
    box: list[list[int]] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    last: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask.astype(bool)):
        turns = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8)))
        now = []
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            own = len(up)
            up.append(own)
            box.append([a, y, b, y + 1, b - a])
            for c, d, other in last:
                if c <= b and a <= d:
                    x, z = sorted((find(own), find(other)))
                    up[z] = x
            now.append((a, b, own))
        last = now
    out: dict[int, list[int]] = {}
    for i, (a, y, b, y1, n) in enumerate(box):
        o = out.setdefault(find(i), [a, y, b, y1, 0])
        o[:] = [min(o[0], a), min(o[1], y), max(o[2], b), max(o[3], y1), o[4] + n]
    return [(a, y, b - a, y1 - y, n) for a, y, b, y1, n in out.values()]


def bright_box(frame: np.ndarray, threshold: float) -> tuple[int, int, int, int]:
    """Box around all that isn't black: left, top, right, bottom; the whole frame where nothing is."""
    rows, cols = (np.flatnonzero((gray(frame) > threshold).any(axis=k)) for k in (1, 0))
    if not len(rows):
        return 0, 0, frame.shape[1], frame.shape[0]
    return int(cols[0]), int(rows[0]), int(cols[-1]) + 1, int(rows[-1]) + 1


def salient_mask(mean: np.ndarray, quantile: float = 0.78) -> np.ndarray:
    """What is salient enough, with small holes closed and specks removed."""
    mask = mean >= max(float(np.quantile(mean, quantile)), _LEAST_THRESHOLD * float(mean.max()))
    twice = 2 * (_CLOSE - 1) + 1  # closing twice with a square is closing once with a larger one
    mask = eroded(dilated(mask, twice), twice)
    return dilated(eroded(mask, _OPEN), _OPEN)


def least_area(height: int, width: int) -> int:
    return round(_LEAST_AREA * height * width)
