"""Belief propagation over batches of trees: numpy, level by level, no loop over trees or nodes.

Generation runs from the leaves to the artificial root (head 0, without a state). Relations select the parameters:
initial by the leaf's, transition by the parent's, final by the root child's, emission by the node's relation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from latentia.operators.chain import project, width
from latentia.operators.params import Params

_FLOOR = -700.0


@dataclass
class Forest:
    """Nodes of many trees: parent (global index, -1 below the artificial root), word, relation, tree number."""

    parent: np.ndarray
    word: np.ndarray
    rel: np.ndarray
    tree: np.ndarray
    n_trees: int

    def __post_init__(self):
        n = len(self.parent)
        self.leaf = np.ones(n, bool)
        self.leaf[self.parent[self.parent >= 0]] = False
        depth, at, level = np.zeros(n, np.int64), self.parent.copy(), 0
        while (at >= 0).any():
            level += 1
            if level > n:
                raise ValueError("a tree has a cycle")
            depth[at >= 0] = level
            at = np.where(at >= 0, self.parent[at], -1)
        order = np.argsort(-depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts) if n else []  # deepest first: children before parents


def forest(heads: list[np.ndarray], words: list[np.ndarray], rels: list[np.ndarray] | None = None) -> Forest:
    """From 1-based head lists."""
    sizes = np.array([len(h) for h in heads], np.int64)
    offset = np.repeat(np.cumsum(sizes) - sizes, sizes)
    head = np.concatenate(heads).astype(np.int64) if len(heads) else np.zeros(0, np.int64)
    word = np.concatenate(words).astype(np.int64) if len(heads) else head
    rel = np.concatenate(rels).astype(np.int64) if rels is not None and len(rels) else np.zeros(len(head), np.int64)
    return Forest(np.where(head > 0, head - 1 + offset, -1), word, rel, np.repeat(np.arange(len(heads)), sizes), len(heads))


def _at(a: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """Rows of the relation axis, moved first; models without relations have one."""
    return np.moveaxis(a, -1, 0)[np.minimum(rel, a.shape[-1] - 1)]


def _logs(p: Params):
    with np.errstate(divide="ignore"):
        return tuple(np.maximum(np.log(a), _FLOOR) for a in (p.pi, p.T, p.f, p.E))


def _emission(E: np.ndarray, word: np.ndarray, rel: np.ndarray) -> np.ndarray:
    return E[word, :, np.minimum(rel, E.shape[2] - 1)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _projected(b: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return b
    m = b.max(-1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(project(np.exp(b - m), k)), _FLOOR) + m


class Beliefs:
    """Upward and downward passes; ``ll`` per tree (an unnormalized score where nodes have several children)."""

    def __init__(self, fo: Forest, p: Params, approx: bool = False, maximum: bool = False):
        self.fo, self.p = fo, p
        self.lpi, self.lT, self.lf, lE = _logs(p)
        n, N, k = len(fo.parent), p.n, width(p.n, approx)
        self.k = k
        self.e = _emission(lE, fo.word, fo.rel) if n else np.zeros((0, N))
        self.below = np.zeros((n, N))  # messages of all children
        self.up = np.zeros((n, N))
        self.belief = np.zeros((n, N))
        self.top = np.zeros(n)  # message into the artificial root
        self.back = np.zeros((n, N), np.int64)  # best own state for each state of the parent
        self.ll = np.zeros(fo.n_trees)
        for nodes in fo.levels:
            b = self.e[nodes] + np.where(fo.leaf[nodes][:, None], _at(self.lpi, fo.rel[nodes]), self.below[nodes])
            b = _projected(b, k)
            self.belief[nodes] = b
            par = fo.parent[nodes]
            low, root = nodes[par >= 0], nodes[par < 0]
            if len(low):
                s = self.belief[low][:, None, :] + _at(self.lT, fo.rel[fo.parent[low]])
                if maximum:
                    self.back[low] = s.argmax(2)
                self.up[low] = s.max(2) if maximum else _lse(s, 2)
                np.add.at(self.below, fo.parent[low], self.up[low])
            if len(root):
                s = self.belief[root] + _at(self.lf, fo.rel[root])
                self.top[root] = s.max(1) if maximum else _lse(s, 1)
                np.add.at(self.ll, fo.tree[root], self.top[root])

    def descend(self) -> np.ndarray:
        """Downward messages, and node posteriors[n,N]."""
        fo = self.fo
        self.down, self.outer = np.zeros_like(self.belief), np.zeros_like(self.belief)
        for nodes in reversed(fo.levels):
            par = fo.parent[nodes]
            low, root = nodes[par >= 0], nodes[par < 0]
            if len(root):
                self.down[root] = _at(self.lf, fo.rel[root]) + (self.ll[fo.tree[root]] - self.top[root])[:, None]
            if len(low):
                q = fo.parent[low]
                self.outer[low] = self.down[q] + self.below[q] - self.up[low] + self.e[q]
                s = _projected(self.outer[low], self.k)[:, :, None] + _at(self.lT, fo.rel[q])
                self.down[low] = _lse(s, 1)
        post = self.belief + self.down - self.ll[fo.tree][:, None]
        post = np.exp(post - post.max(1, keepdims=True)) if self.k else np.exp(post)
        return post / post.sum(1, keepdims=True) if len(post) else post

    def edge_counts(self) -> np.ndarray:
        """Summed edge posteriors[N,N,R]: parent state, child state, parent's relation."""
        fo, R = self.fo, self.p.T.shape[2]
        out = np.zeros((self.p.n, self.p.n, R))
        low = np.flatnonzero(fo.parent >= 0)
        if len(low):
            q = fo.parent[low]
            s = self.outer[low][:, :, None] + _at(self.lT, fo.rel[q]) + self.belief[low][:, None, :] - self.ll[fo.tree[low]][:, None, None]
            s = np.exp(s)
            if self.k:
                s /= s.sum((1, 2), keepdims=True)
            rel = np.minimum(fo.rel[q], R - 1)
            for r in np.unique(rel).tolist():
                out[:, :, r] = s[rel == r].sum(0)
        return out

    def best_states(self) -> np.ndarray:
        """Max-product states (after a maximum pass)."""
        fo = self.fo
        state = np.zeros(len(fo.parent), np.int64)
        for nodes in reversed(fo.levels):
            par = fo.parent[nodes]
            low, root = nodes[par >= 0], nodes[par < 0]
            if len(root):
                state[root] = (self.belief[root] + _at(self.lf, fo.rel[root])).argmax(1)
            if len(low):
                state[low] = self.back[low, state[fo.parent[low]]]
        return state
