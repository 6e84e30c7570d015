"""A small convolutional classifier in numpy: summed embeddings, filters of several widths, max pooling, softmax.

A position has one or more ids whose embeddings are added. Segments (windows or documents) lie one after another, each with
a tail of `max(widths) - 1` positions, of id 0 as a rule, whose embedding is zero and isn't trained. Filters begin at the
positions before the tail, so none reaches from one segment into the next; a segment of a tail alone responds with 0."""

from __future__ import annotations

from copy import copy

import numpy as np

from .shared import slices

#: Positions whose responses are held at a time while learning; longer segments are gone through in pieces.
PIECE = 1 << 16


class ConvNet:
    def __init__(self, vocabulary: int, dim: int, widths: tuple[int, ...], filters: int, classes: int, seed: int = 0, embed_scale: float = 0.3):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.weights = {
            "embed": rng.normal(0, embed_scale, (vocabulary, dim)).astype(np.float32),
            "bias": np.zeros(filters * len(widths), np.float32),
            "out": rng.normal(0, 0.3, (filters * len(widths), classes)).astype(np.float32),
            "prior": np.zeros(classes, np.float32),
        } | {f"conv{w}": rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters)).astype(np.float32) for w in widths}
        self.weights["embed"][0] = 0

    @property
    def padding(self) -> int:
        return max(self.widths) - 1

    def responses(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings, filter responses at each position); the last `padding` positions have to be padding."""
        embedded = self.weights["embed"][ids[:, 0]]
        for k in range(1, ids.shape[1]):
            embedded += self.weights["embed"][ids[:, k]]
        n = len(ids)
        out = np.zeros((n, self.filters * len(self.widths)), np.float32)
        for j, w in enumerate(self.widths):
            block = out[:, j * self.filters : (j + 1) * self.filters]
            for k in range(w):
                block[: n - k] += embedded[k:] @ self.weights[f"conv{w}"][k]
        return embedded, out

    def _inside(self, response: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Responses (changed in place) that can't win at the positions of tails."""
        if self.padding:
            bare = np.diff(edge) <= self.padding
            tail = (edge[1:] - self.padding)[:, None] + np.arange(self.padding)
            response[tail[~bare]] = -np.inf
            response[tail[bare]] = 0
        return response

    def pooled(self, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each segment ids[edge[i]:edge[i+1]], which ends with its tail."""
        return np.maximum.reduceat(self._inside(self.responses(ids)[1], edge), edge[:-1], axis=0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.weights["bias"], 0) @ self.weights["out"] + self.weights["prior"]

    def fit(self, ids: np.ndarray, edge: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0, use: np.ndarray | None = None) -> ConvNet:
        """Adam on the weighted cross entropy of the segments in `use`, or all; weight is of each class."""
        rng = np.random.default_rng(seed)
        adam = Adam(self)
        for epoch in range(epochs):
            self.sweep(ids, edge, labels, weight, rng.permutation(len(labels) if use is None else use), adam, rate * (1 - epoch / epochs), batch)
        return self

    def sweep(self, ids: np.ndarray, edge: np.ndarray, labels: np.ndarray, weight: np.ndarray, order: np.ndarray, adam: Adam, rate: float, batch: int = 64) -> None:
        """One pass over the segments in `order`."""
        for at in range(0, len(order), batch):
            adam.step(self._gradients(ids, edge, labels, weight, order[at : at + batch]), rate)

    def winners(self, ids: np.ndarray, edge: np.ndarray, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
        """(largest response of each filter in each segment, ids at the positions it was made of), the first of equals."""
        n, reach = len(edge) - 1, self.padding
        top = np.full((n, self.filters * len(self.widths)), -np.inf, np.float32)
        made_of = np.zeros((*top.shape, reach + 1, ids.shape[1]), ids.dtype)
        for a, b in slices(edge[:-1], edge[1:], limit):
            if edge[b] - edge[a] <= limit + reach:
                top[a:b], made_of[a:b] = self._winners(ids[edge[a] : edge[b]], edge[a : b + 1] - edge[a])
                continue
            for first in range(edge[a], edge[b] - reach, limit):  # one long segment; what follows a piece is its tail
                piece = ids[first : min(edge[b], first + limit + reach)]
                here, of = self._winners(piece, np.array([0, len(piece)]))
                better = here[0] > top[a]
                top[a][better], made_of[a][better] = here[0][better], of[0][better]
        return top, made_of

    def _winners(self, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        response = self._inside(self.responses(ids)[1], edge)
        top = np.maximum.reduceat(response, edge[:-1], axis=0)
        row, column = np.nonzero(response == np.repeat(top, np.diff(edge), axis=0))
        segment = np.searchsorted(edge, row, "right") - 1
        place = np.zeros(top.shape, np.int64)
        place[segment[::-1], column[::-1]] = row[::-1]  # the first of equal places
        return top, ids[np.minimum(place[:, :, None] + np.arange(self.padding + 1), edge[1:, None, None] - 1)]

    def _gradients(self, ids, edge, labels, weight, chosen) -> dict:
        size = (edge[1:] - edge[:-1])[chosen]
        own = np.append(0, np.cumsum(size))
        top, made_of = self.winners(ids[np.repeat(edge[:-1][chosen] - own[:-1], size) + np.arange(own[-1])], own)
        hidden = np.maximum(top + self.weights["bias"], 0)
        score = hidden @ self.weights["out"] + self.weights["prior"]
        score = np.exp(score - score.max(1, keepdims=True))
        score /= score.sum(1, keepdims=True)
        y = labels[chosen]
        score[np.arange(len(y)), y] -= 1
        score *= (weight[y] / len(y))[:, None]
        back = (score @ self.weights["out"].T) * (hidden > 0)
        grads = {"out": hidden.T @ score + 1e-4 * self.weights["out"], "prior": score.sum(0), "bias": back.sum(0)}
        touched, pushes = [], []
        for j, w in enumerate(self.widths):
            mine = slice(j * self.filters, (j + 1) * self.filters)
            at, g = made_of[:, mine], back[:, mine].astype(np.float32)
            conv = np.zeros_like(self.weights[f"conv{w}"])
            for k in range(w):
                embedded = self.weights["embed"][at[:, :, k, 0]]
                for feature in range(1, ids.shape[1]):
                    embedded += self.weights["embed"][at[:, :, k, feature]]
                conv[k] = np.einsum("bfd,bf->df", embedded, g)
                push = g[:, :, None] * self.weights[f"conv{w}"][k].T
                live = g != 0
                for feature in range(ids.shape[1]):
                    touched.append(at[:, :, k, feature][live])
                    pushes.append(push[live])
            grads[f"conv{w}"] = conv
        touched, pushes = np.concatenate(touched), np.concatenate(pushes)
        touched, pushes = touched[touched > 0], pushes[touched > 0]
        rows, where = np.unique(touched, return_inverse=True)
        embed = np.zeros((len(rows), pushes.shape[1]), np.float32)
        np.add.at(embed, where, pushes)
        return grads | {"embed": (rows, embed)}

    def copy(self) -> ConvNet:
        other = copy(self)
        other.weights = {k: v.copy() for k, v in self.weights.items()}
        return other

    def rest(self) -> np.ndarray:
        """All weights but the embeddings, one after another."""
        return np.concatenate([v.ravel() for k, v in self.weights.items() if k != "embed"])

    def move(self, rows: np.ndarray, embed: np.ndarray, rest: np.ndarray) -> None:
        """Add `embed` to the embeddings of `rows`, and `rest` to all other weights."""
        self.weights["embed"][rows] += embed.astype(np.float32)
        at = 0
        for k, v in self.weights.items():
            if k != "embed":
                v += rest[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size


class Adam:
    """Moments of a network's weights; of the embeddings only rows that were touched move. `touches` counts their steps."""

    def __init__(self, net: ConvNet):
        self.net, self.steps = net, 0
        self.mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.weights.items()}
        self.touches = np.zeros(len(net.weights["embed"]), np.int64)

    def step(self, grads: dict, rate: float) -> None:
        self.steps += 1
        now = rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        weights, mean, square = self.net.weights, self.mean, self.square
        rows, g = grads.pop("embed")
        self.touches[rows] += 1
        m = mean["embed"][rows] = mean["embed"][rows] + 0.1 * (g - mean["embed"][rows])
        v = square["embed"][rows] = square["embed"][rows] + 0.001 * (g * g - square["embed"][rows])
        weights["embed"][rows] -= (now * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            weights[k] -= (now * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
