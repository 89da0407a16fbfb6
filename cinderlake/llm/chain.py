"""Forward-backward over many sequences of any length at once, exactly, with numpy.

Sequences are cut into blocks. The product of a block's transfer matrices is the same whatever stands before it,
so all blocks are multiplied out side by side; a short pass over each sequence's blocks gives the state at the
blocks' borders, and a second pass inside all blocks gives every position. Vectors are scaled at each step, matrices
every few steps. Positions are put in order of their step in the block, so that a step's lie side by side."""

from __future__ import annotations

import numpy as np

LENGTH = 64


class Chain:
    """potential: n x K, positive; first: where each sequence starts, and n at the end; trans: K x K, positive."""

    def __init__(self, potential: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, length: int = LENGTH):
        self.a, self.start = trans.astype(potential.dtype), start.astype(potential.dtype)
        sizes = np.diff(first)
        self.n_seq = len(sizes)
        blocks = -(-sizes // length)
        self.seq = np.repeat(np.arange(self.n_seq), blocks)
        self.ordinal = np.arange(len(self.seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.at = first[:-1][self.seq] + self.ordinal * length
        self.size = np.minimum(length, first[1:][self.seq] - self.at)
        self.blocks, self.block_first = blocks, np.cumsum(blocks) - blocks
        # longest first: at step t only a head of the blocks is left
        self.order = np.argsort(-self.size, kind="stable")
        self.left = np.searchsorted(-self.size[self.order], -np.arange(1, length + 1), side="right")
        self.step = np.cumsum(self.left) - self.left
        head = self.at[self.order]
        self.place = np.concatenate([head[:left] + t for t, left in enumerate(self.left)]) if len(head) else np.zeros(0, np.int64)
        self.e = potential[self.place]
        self._borders()

    def _borders(self) -> None:
        nb, k = len(self.seq), len(self.a)
        m = np.broadcast_to(np.eye(k, dtype=self.e.dtype), (nb, k, k)).copy()
        scale = np.zeros(nb)
        flat = np.ones(k * k, self.e.dtype)
        every = 8 if self.e.itemsize == 8 else 2  # steps that can't underflow
        for t, left in enumerate(self.left):
            if not left:
                break
            new = (m[:left].reshape(-1, k) @ self.a).reshape(left, k, k)
            new *= self.e[self.step[t] : self.step[t] + left][:, None, :]
            if t % every == every - 1:
                top = new.reshape(left, -1) @ flat
                new /= top[:, None, None]
                scale[:left] += np.log(top)
            m[:left] = new
        self.m = np.empty_like(m)
        self.m[self.order] = m
        self.scale = np.empty(nb)
        self.scale[self.order] = scale
        self.before = np.empty((nb, k), self.e.dtype)
        self.after = np.empty((nb, k), self.e.dtype)
        self.log_z = np.zeros(self.n_seq)
        alpha = np.broadcast_to(self.start, (self.n_seq, k)).copy()
        beta = np.ones((self.n_seq, k), self.e.dtype)
        deep = np.argsort(-self.blocks, kind="stable")
        counts = self.blocks[deep]
        for j in range(int(self.blocks.max(initial=0))):
            s = deep[: np.searchsorted(-counts, -j, side="left")]
            b = self.block_first[s] + j
            self.before[b] = alpha[s]
            new = np.einsum("si,sij->sj", alpha[s], self.m[b])
            total = new.sum(1)
            alpha[s] = new / total[:, None]
            self.log_z[s] += np.log(total) + self.scale[b]
        for j in range(int(self.blocks.max(initial=0)) - 1, -1, -1):
            s = deep[: np.searchsorted(-counts, -j, side="left")]
            b = self.block_first[s] + j
            self.after[b] = beta[s]
            new = np.einsum("sij,sj->si", self.m[b], beta[s])
            beta[s] = new / new.sum(1)[:, None]

    def posteriors(self, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each state at each position; with pairs, the expected number of each transition too.

        The transition into a sequence's first position, from the start vector, counts as one."""
        k = len(self.a)
        ones = np.ones(k, self.e.dtype)
        alpha = np.empty_like(self.e)
        now = before = self.before[self.order]
        for t, left in enumerate(self.left):
            if not left:
                break
            here = slice(self.step[t], self.step[t] + left)
            new = now[:left] @ self.a
            new *= self.e[here]
            new /= (new @ ones)[:, None]
            now = alpha[here] = new
        sums = np.zeros((k, k))
        gamma = np.empty_like(self.e)
        back = self.after[self.order]
        for t in range(len(self.left) - 1, -1, -1):
            left = self.left[t]
            if not left:
                continue
            here = slice(self.step[t], self.step[t] + left)
            g = alpha[here] * back[:left]
            g /= (g @ ones)[:, None]
            gamma[here] = g
            carried = self.e[here] * back[:left]
            new = carried @ self.a.T
            if pairs:
                last = alpha[self.step[t - 1] : self.step[t - 1] + left] if t else before
                norm = (last * new) @ ones
                sums += (last / norm[:, None]).T @ carried * self.a
            new /= (new @ ones)[:, None]
            back[:left] = new
        out = np.empty_like(gamma)
        out[self.place] = gamma
        return out, sums
