"""Image kernels for Arrow batches.

Every kernel maps a float array (images, height, width) with values in 0..1 to the same
shape.  Random parts come from a generator per image, seeded by the image's key, so the
result does not depend on how rows are batched.
"""

from __future__ import annotations

import numpy as np

# Parameters for severity 1..5, after the published common-corruptions benchmark.
NOISE_SIGMA = (0.08, 0.12, 0.18, 0.26, 0.38)
CONTRAST = (0.4, 0.3, 0.2, 0.1, 0.05)
BRIGHTNESS = (0.1, 0.2, 0.3, 0.4, 0.5)
DEFOCUS = ((3, 0.1), (4, 0.5), (6, 0.5), (8, 0.5), (10, 0.5))
MOTION = ((10, 3), (15, 5), (15, 8), (15, 12), (20, 15))
GLASS = ((0.7, 1, 2), (0.9, 2, 1), (1.0, 2, 3), (1.1, 3, 2), (1.5, 4, 2))
FOG = ((1.5, 2.0), (2.0, 2.0), (2.5, 1.7), (2.5, 1.5), (3.0, 1.4))
SNOW = ((0.1, 0.3, 0.5, 10, 4, 0.8), (0.2, 0.3, 0.5, 12, 4, 0.7), (0.55, 0.3, 0.9, 12, 8, 0.7),
        (0.55, 0.3, 0.85, 12, 8, 0.65), (0.55, 0.3, 0.85, 12, 12, 0.55))


def generators(bases: np.ndarray, streams: np.ndarray) -> list[np.random.Generator]:
    return [np.random.Generator(np.random.PCG64([int(b), int(s)])) for b, s in zip(bases, streams)]


def _gaussian_1d(sigma: float) -> np.ndarray:
    reach = max(1, int(4 * sigma + 0.5))
    x = np.arange(-reach, reach + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def convolve(images: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation of each image with a small kernel, mirrored at the border."""
    ph, pw = kernel.shape[0] // 2, kernel.shape[1] // 2
    n, h, w = images.shape
    rows, cols = _mirror(h, ph), _mirror(w, pw)
    padded = images[:, rows][:, :, cols]
    out = np.zeros_like(images)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * padded[:, i:i + h, j:j + w]
    return out


def _mirror(size: int, pad: int) -> np.ndarray:
    """Indices of a line extended by reflection, also when the pad exceeds the size."""
    if size == 1:
        return np.zeros(1 + 2 * pad, dtype=int)
    at = np.arange(-pad, size + pad) % (2 * size - 2)
    return np.where(at < size, at, 2 * size - 2 - at)


def blur(images: np.ndarray, sigma: float) -> np.ndarray:
    k = _gaussian_1d(sigma)
    return convolve(convolve(images, k[:, None]), k[None, :])


def defocus(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    """Disk kernel, its edge softened by a small blur."""
    radius, soft = DEFOCUS[severity - 1]
    reach = radius + 2
    y, x = np.mgrid[-reach:reach + 1, -reach:reach + 1]
    disk = (x * x + y * y <= radius * radius).astype(float)
    disk = blur(disk[None], soft)[0]
    return convolve(images, disk / disk.sum())


def _line_kernel(radius: float, sigma: float, angle: float) -> np.ndarray:
    """Half-gaussian weights along a line through the centre."""
    size = 2 * int(radius) + 1
    kernel = np.zeros((size, size))
    for step in range(int(radius) + 1):
        r = int(round(radius + step * np.sin(angle)))
        c = int(round(radius + step * np.cos(angle)))
        if 0 <= r < size and 0 <= c < size:
            kernel[r, c] += np.exp(-0.5 * (step / sigma) ** 2)
    return kernel / kernel.sum()


def motion(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    """Line kernel at a random angle within 45 degrees of horizontal."""
    radius, sigma = MOTION[severity - 1]
    return np.concatenate([
        convolve(image[None], _line_kernel(radius, sigma, np.deg2rad(rng.uniform(-45, 45))))
        for image, rng in zip(images, rngs)
    ])


def glass(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    """Blur, exchange of neighbouring pixels, blur."""
    sigma, reach, rounds = GLASS[severity - 1]
    out = blur(images, sigma)
    _, h, w = out.shape
    inner_h, inner_w = h - 2 * reach, w - 2 * reach
    for image, rng in zip(out, rngs):
        if inner_h <= 0 or inner_w <= 0:
            continue
        offsets = rng.integers(-reach, reach + 1, size=(rounds, inner_h, inner_w, 2))
        for moves in offsets:
            for r in range(h - reach - 1, reach - 1, -1):
                for c in range(w - reach - 1, reach - 1, -1):
                    dr, dc = moves[r - reach, c - reach]
                    image[r, c], image[r + dr, c + dc] = image[r + dr, c + dc], image[r, c]
    return blur(np.clip(out, 0, 1), sigma)


def _plasma(rng: np.random.Generator, height: int, width: int, decay: float) -> np.ndarray:
    """Cloud texture in 0..1: noise of doubling frequency and falling weight, added up."""
    total, weight, cells = np.zeros((height, width)), 1.0, 2
    while cells <= 2 * max(height, width):
        coarse = rng.random((cells + 1, cells + 1))
        total += weight * _stretch(coarse, height, width)
        weight, cells = weight / decay, cells * 2
    low, high = total.min(), total.max()
    return (total - low) / (high - low) if high > low else total


def _stretch(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear interpolation of a coarse grid to the image size."""
    r = np.linspace(0, grid.shape[0] - 1.0001, height)
    c = np.linspace(0, grid.shape[1] - 1.0001, width)
    r0, c0 = r.astype(int), c.astype(int)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    top = grid[r0][:, c0] * (1 - fc) + grid[r0][:, c0 + 1] * fc
    low = grid[r0 + 1][:, c0] * (1 - fc) + grid[r0 + 1][:, c0 + 1] * fc
    return top * (1 - fr) + low * fr


def fog(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    """Add a cloud texture and scale back to the brightest original pixel."""
    strength, decay = FOG[severity - 1]
    out = np.empty_like(images)
    for i, (image, rng) in enumerate(zip(images, rngs)):
        peak = image.max()
        hazy = image + strength * _plasma(rng, *image.shape, decay)
        out[i] = hazy * peak / (peak + strength)
    return out


def snow(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    """Thresholded noise smeared by a line kernel, over a whitened image."""
    mean, spread, threshold, radius, sigma, mix = SNOW[severity - 1]
    out = np.empty_like(images)
    for i, (image, rng) in enumerate(zip(images, rngs)):
        flakes = rng.normal(mean, spread, size=image.shape)
        flakes = np.where(flakes < threshold, 0.0, flakes)
        kernel = _line_kernel(radius, sigma, np.deg2rad(rng.uniform(-135, -45)))
        flakes = convolve(np.clip(flakes, 0, 1)[None], kernel)[0]
        white = np.maximum(image, image * 1.5 + 0.5)
        out[i] = mix * image + (1 - mix) * white + flakes + flakes[::-1, ::-1]
    return out


def noise(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    sigma = NOISE_SIGMA[severity - 1]
    return images + np.stack([rng.normal(0, sigma, size=images.shape[1:]) for rng in rngs])


def contrast(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    mean = images.mean(axis=(1, 2), keepdims=True)
    return (images - mean) * CONTRAST[severity - 1] + mean


def brightness(images: np.ndarray, severity: int, rngs: list) -> np.ndarray:
    return images + BRIGHTNESS[severity - 1]


KERNELS = {
    "gaussian_noise": noise, "glass_blur": glass, "snow": snow, "motion_blur": motion,
    "defocus_blur": defocus, "fog": fog, "contrast": contrast, "brightness": brightness,
}
