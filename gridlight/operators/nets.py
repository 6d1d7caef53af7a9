"""Small networks in NumPy: dense regressors, convolutional classifiers with explanations, segmentation.

Weights travel to executors with the scoring function, so scoring is one vectorised map without a shuffle; training reads its
rows from a table batch by batch (operators.training).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gridlight.operators import training
from gridlight.operators.pca import map_vectors

#: Hidden widths of the denoising read-out, and of the digit model (fixed values).
READOUT, DIGITS = (1024, 2048, 4096, 8192, 4096), (1024, 512, 784)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Dense:
    """ReLU layers with dropout, a sigmoid at the end."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    history: list[dict] = field(default_factory=list)

    @classmethod
    def create(cls, sizes: list[int], seed: int = 42) -> Dense:
        rng = np.random.default_rng(seed)
        limit = lambda a, b: (6 / (a + b)) ** 0.5
        return cls([rng.uniform(-limit(a, b), limit(a, b), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]])

    def forward(self, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = out[-1] @ w + b
            if k + 1 == len(self.weights):
                out.append(sigmoid(z))
            else:
                z = np.maximum(z, 0)
                out.append(z * (rng.random(z.shape) >= drop) / (1 - drop) if drop and rng is not None else z)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def gradients(self, x: np.ndarray, y: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[list[np.ndarray], list[np.ndarray], float]:
        """Of the mean squared error, by weights and by biases."""
        acts = self.forward(x, drop, rng)
        error = acts[-1] - y
        back = 2 * error / error.size * acts[-1] * (1 - acts[-1])
        gw, gb = [], []
        for k in range(len(self.weights) - 1, -1, -1):
            gw.insert(0, acts[k].T @ back)
            gb.insert(0, back.sum(0))
            if k:
                back = (back @ self.weights[k].T) * (acts[k] > 0) / (1 - drop if rng is not None else 1)
        return gw, gb, float((error**2).mean())

    drop: float = 0.0

    def params(self) -> list[np.ndarray]:
        return [*self.weights, *self.biases]

    def step(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], dict[str, float]]:
        gw, gb, loss = self.gradients(x, y, self.drop, rng)
        return [*gw, *gb], {"loss": loss}

    def measure(self, batches) -> dict[str, float]:
        total = n = 0.0
        for x, y in batches:
            total += float(((self.predict(x) - y) ** 2).sum())
            n += y.size
        return {"loss": total / max(n, 1)}

    def fit(self, x, y, xv, yv, rate: float = 1e-4, batch: int = 64, epochs: int = 500, patience: int = 20, drop: float = 0.3, seed: int = 42, on_epoch=None) -> Dense:
        """As fit_rows, on arrays."""
        return self.fit_rows(training.Arrays(x, y, batch, seed), training.Arrays(xv, yv, 4096), rate, epochs, patience, drop, on_epoch)

    def fit_rows(self, train, valid, rate: float = 1e-4, epochs: int = 500, patience: int = 20, drop: float = 0.3, on_epoch=None) -> Dense:
        """Adam on batches of training.Rows or training.Arrays; stops after ``patience`` epochs without a better validation loss and
        goes back to the best weights. ``on_epoch(epoch, model)`` may return more metrics for the history."""
        self.drop = drop
        return training.run(self, train, valid, training.Optimizer("adam", rate), epochs, patience=patience, on_epoch=on_epoch)

    def gradient_norms(self, x: np.ndarray, y: np.ndarray) -> list[tuple[str, str, float]]:
        """(layer, kind, L2 norm of the gradient)."""
        gw, gb, _ = self.gradients(x, y)
        return [(f"dense_{k}", kind, float(np.sqrt((g**2).sum()))) for k, pair in enumerate(zip(gw, gb, strict=True)) for kind, g in zip(("kernel", "bias"), pair, strict=True)]

    def parameters(self) -> int:
        return sum(w.size + b.size for w, b in zip(self.weights, self.biases, strict=True))

    def summary(self) -> list[tuple[str, int, int, int]]:
        """(layer, inputs, outputs, parameters)."""
        return [(f"dense_{k}", *w.shape, w.size + b.size) for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True))]

    def score(self, df: DataFrame, vector: str, out: str = "rebuilt") -> DataFrame:
        return map_vectors(df, vector, out, self.predict)


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3 x 3 convolution with zero borders; x is n, h, w, c."""
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0))), (3, 3), axis=(1, 2))
    return np.einsum("nhwcij,ijco->nhwo", view, w, optimize=True) + b


def pool(x: np.ndarray) -> np.ndarray:
    n, h, w, c = x.shape
    return x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2, c).max(axis=(2, 4))


@dataclass
class ConvNet:
    """Blocks of two convolutions and a pool, then dense layers and a softmax."""

    side: int
    kernels: list[tuple[np.ndarray, np.ndarray]]
    dense: list[tuple[np.ndarray, np.ndarray]]
    history: list[dict] = field(default_factory=list)

    @classmethod
    def create(cls, side: int = 64, filters: tuple[int, ...] = (32, 64, 128), hidden: int = 128, classes: int = 10, seed: int = 42) -> ConvNet:
        rng, kernels, c = np.random.default_rng(seed), [], 3
        for f in filters:
            for a in (c, f):
                kernels.append((rng.normal(0, (2 / (9 * a)) ** 0.5, (3, 3, a, f)), np.zeros(f)))
            c = f
        flat = (side // 2 ** len(filters)) ** 2 * c
        sizes = (flat, hidden, classes)
        return cls(side, kernels, [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """The output of every convolution."""
        out = []
        for k, (w, b) in enumerate(self.kernels):
            x = np.maximum(conv(x, w, b), 0)
            out.append(x)
            if k % 2:
                x = pool(x)
        return out

    def _head(self, last: np.ndarray) -> list[np.ndarray]:
        acts = [pool(last).reshape(len(last), -1)]
        for k, (w, b) in enumerate(self.dense):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k + 1 < len(self.dense) else z)
        return acts

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self._head(self.activations(x)[-1])[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def params(self) -> list[np.ndarray]:
        return [p for pair in (*self.kernels, *self.dense) for p in pair]

    def step(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], dict[str, float]]:
        """Gradients of the mean cross-entropy, and loss and accuracy; y is a column of classes."""
        del rng
        tape, h = training.Tape(), x.reshape(-1, self.side, self.side, 3)
        for k, (w, b) in enumerate(self.kernels):
            h = tape.relu(tape.conv(h, w, b))
            if k % 2:
                h = tape.pool(h)
        h = tape.flat(h)
        for k, (w, b) in enumerate(self.dense):
            h = tape.dense(h, w, b)
            if k + 1 < len(self.dense):
                h = tape.relu(h)
        p, at = training.softmax(h), (np.arange(len(x)), y[:, 0].astype(int))
        grad = p.copy()
        grad[at] -= 1
        tape.backward(h, grad / len(x))
        return [tape.grads[id(v)] for v in self.params()], {"loss": float(-np.log(np.maximum(p[at], 1e-7)).mean()), "accuracy": float((p.argmax(1) == at[1]).mean())}

    def measure(self, batches) -> dict[str, float]:
        loss = right = n = 0.0
        for x, y in batches:
            p, truth = self.predict(x.reshape(-1, self.side, self.side, 3)), y[:, 0].astype(int)
            loss -= float(np.log(np.maximum(p[np.arange(len(p)), truth], 1e-7)).sum())
            right += float((p.argmax(1) == truth).sum())
            n += len(p)
        return {"loss": loss / max(n, 1), "accuracy": right / max(n, 1)}

    def fit_rows(self, train, valid, epochs: int = 5, optimizer: str = "rmsprop", rate: float = 1e-3) -> ConvNet:
        """Cross-entropy on batches of training.Rows or training.Arrays, all epochs; the last weights stay."""
        return training.run(self, train, valid, training.Optimizer(optimizer, rate), epochs)

    def summary(self) -> list[tuple[str, int, int, int]]:
        """(layer, channels in, channels out, parameters)."""
        return [(f"conv_{k}", w.shape[2], w.shape[3], w.size + b.size) for k, (w, b) in enumerate(self.kernels)] + [(f"dense_{k}", *w.shape, w.size + b.size) for k, (w, b) in enumerate(self.dense)]

    def grad_cam(self, x: np.ndarray, cls_idx: int) -> np.ndarray:
        """Heat map per image: mean gradient of the class score per channel, times the last maps, positive part, 0..1."""
        last = self.activations(x)[-1]
        acts = self._head(last)
        p = self.predict(x)
        back = -p * p[:, [cls_idx]]
        back[:, cls_idx] += p[:, cls_idx]
        for k in range(len(self.dense) - 1, -1, -1):
            back = back @ self.dense[k][0].T
            if k:
                back = back * (acts[k] > 0)
        n, h, w, c = last.shape
        pooled = pool(last)
        grown = np.repeat(np.repeat(pooled, 2, 1), 2, 2)
        grad = np.zeros_like(last)
        top = np.repeat(np.repeat(back.reshape(pooled.shape), 2, 1), 2, 2)
        inner = last[:, : grown.shape[1], : grown.shape[2]]
        grad[:, : grown.shape[1], : grown.shape[2]] = np.where(inner == grown, top, 0)
        cam = np.maximum((grad.mean(axis=(1, 2))[:, None, None, :] * last).sum(-1), 0)
        low, high = cam.min(axis=(1, 2), keepdims=True), cam.max(axis=(1, 2), keepdims=True)
        return (cam - low) / np.where(high > low, high - low, 1)

    def parameters(self) -> int:
        return sum(w.size + b.size for w, b in [*self.kernels, *self.dense])

    def score(self, df: DataFrame, vector: str, out: str = "probs") -> DataFrame:
        """Class probabilities of flat interleaved RGB in 0..1."""
        return map_vectors(df, vector, out, lambda x: self.predict(x.reshape(-1, self.side, self.side, 3)))

    def score_maps(self, df: DataFrame, vector: str, layer: int = -1, out: str = "maps") -> DataFrame:
        return map_vectors(df, vector, out, lambda x: (a := self.activations(x.reshape(-1, self.side, self.side, 3))[layer]).reshape(len(a), -1))

    def score_cam(self, df: DataFrame, vector: str, cls_idx: int, out: str = "heat") -> DataFrame:
        return map_vectors(df, vector, out, lambda x: (a := self.grad_cam(x.reshape(-1, self.side, self.side, 3), cls_idx)).reshape(len(a), -1))


def ce_dice(p: np.ndarray, truth: np.ndarray, smooth: float = 1e-6) -> tuple[float, float, np.ndarray]:
    """Cross-entropy, Dice loss (1 - mean over images and classes), and the derivative of their sum by the probabilities.
    p is n, h, w, classes; truth is n, h, w."""
    hot = np.eye(p.shape[-1])[truth]
    floor = np.maximum(p, 1e-7)
    ce = float(-(hot * np.log(floor)).sum() / truth.size)
    inner, both = (hot * p).sum((1, 2)), (hot + p).sum((1, 2))
    dice = (2 * inner + smooth) / (both + smooth)
    by_dice = (2 * hot * (both + smooth)[:, None, None] - (2 * inner + smooth)[:, None, None]) / ((both + smooth) ** 2)[:, None, None]
    return ce, float(1 - dice.mean()), -hot / floor / truth.size - by_dice / dice.size


@dataclass
class SegNet:
    """Encoder and decoder with skip connections: two convolutions and a pool on each level down, bilinear growth, the skipped maps and
    two convolutions on each level up, a softmax per pixel. Scores and trains from the ground; there is no pretrained encoder."""

    side: int
    down: list[list[np.ndarray]]
    up: list[list[np.ndarray]]
    last: list[np.ndarray]
    drop: float = 0.3
    history: list[dict] = field(default_factory=list)

    @classmethod
    def create(cls, side: int = 256, filters: tuple[int, ...] = (16, 32, 64, 128), classes: int = 7, drop: float = 0.3, seed: int = 42) -> SegNet:
        if side % 2 ** (len(filters) - 1):
            raise ValueError(f"a side of {side} can't be halved {len(filters) - 1} times")
        rng = np.random.default_rng(seed)

        def pair(a: int, b: int) -> list[np.ndarray]:
            return [x for c in (a, b) for x in (rng.normal(0, (2 / (9 * c)) ** 0.5, (3, 3, c, b)), np.zeros(b))]

        down = [pair(a, b) for a, b in zip((3, *filters), filters, strict=False)]
        up = [pair(a + b, b) for a, b in zip(filters[::-1], filters[-2::-1], strict=False)]
        return cls(side, down, up, [rng.normal(0, (2 / filters[0]) ** 0.5, (1, 1, filters[0], classes)), np.zeros(classes)], drop)

    def params(self) -> list[np.ndarray]:
        return [p for block in (*self.down, *self.up) for p in block] + self.last

    def parameters(self) -> int:
        return sum(p.size for p in self.params())

    def _logits(self, tape: training.Tape, x: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
        block = lambda h, p: tape.relu(tape.conv(tape.relu(tape.conv(h, p[0], p[1])), p[2], p[3]))
        h, skips = x.reshape(-1, self.side, self.side, 3), []
        for k, p in enumerate(self.down):
            h = block(tape.pool(h) if k else h, p)
            skips.append(h)
        for p, skip in zip(self.up, skips[-2::-1], strict=True):
            h = tape.drop(block(tape.join(tape.grow(h), skip), p), self.drop, rng)
        return tape.conv(h, *self.last)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return training.softmax(self._logits(training.Tape(), x, None))

    def step(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], dict[str, float]]:
        """Gradients of cross-entropy plus Dice loss; x is flat RGB in 0..1, y the classes of its pixels."""
        tape = training.Tape()
        z = self._logits(tape, x, rng)
        p, truth = training.softmax(z), y.reshape(z.shape[:3]).astype(int)
        ce, dice, by_p = ce_dice(p, truth)
        tape.backward(z, p * (by_p - (by_p * p).sum(-1, keepdims=True)))
        return [tape.grads[id(v)] for v in self.params()], {"loss": ce + dice, "accuracy": float((p.argmax(-1) == truth).mean())}

    def measure(self, batches) -> dict[str, float]:
        """Loss, accuracy, mean IoU over the classes that occur, and IoU per class, over all pixels."""
        loss = n = 0.0
        classes = len(self.last[1])
        table = np.zeros((classes, classes))
        for x, y in batches:
            p = self.predict(x)
            truth = y.reshape(p.shape[:3]).astype(int)
            ce, dice, _ = ce_dice(p, truth)
            loss, n = loss + (ce + dice) * len(x), n + len(x)
            table += np.bincount((truth * classes + p.argmax(-1)).ravel(), minlength=classes**2).reshape(classes, classes)
        hit, seen = np.diag(table), table.sum(0) + table.sum(1)
        iou = np.divide(hit, seen - hit, out=np.zeros(classes), where=seen > 0)
        return {"loss": loss / max(n, 1), "accuracy": hit.sum() / max(table.sum(), 1), "miou": float(iou[seen > 0].mean()) if seen.any() else 0.0} | {f"iou_{k}": float(v) for k, v in enumerate(iou)}

    def fit_rows(self, train, valid, rate: float = 1e-4, epochs: int = 50, patience: int = 10, factor: float = 0.5, rate_patience: int = 5) -> SegNet:
        """Adam; the rate is cut on a plateau of the validation mean IoU, whose best weights are kept."""
        return training.run(self, train, valid, training.Optimizer("adam", rate), epochs, "val_miou", False, patience, training.Plateau(factor, rate_patience))


def overlay(image: np.ndarray, heat: np.ndarray, alpha: float = 0.4) -> np.ndarray:
    """Heat, stretched over the image by bilinear interpolation, blended in red over blue."""
    h, w = image.shape[:2]
    ys, xs = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, heat.shape[0]), (w, heat.shape[1])))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, heat.shape[0] - 1), np.minimum(x0 + 1, heat.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], xs - x0
    big = (heat[y0][:, x0] * (1 - fx) + heat[y0][:, x1] * fx) * (1 - fy) + (heat[y1][:, x0] * (1 - fx) + heat[y1][:, x1] * fx) * fy
    return np.clip((1 - alpha) * image + alpha * np.stack([big, np.zeros_like(big), 1 - big], axis=-1), 0, 1)
