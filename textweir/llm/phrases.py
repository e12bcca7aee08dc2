"""Repeated byte strings of a corpus, by prefix-free parsing.

A window of LENGTH bytes holds SPAN = LENGTH - KMER + 1 windows of KMER bytes; the one with the
smallest rolling hash (the leftmost of equals) is its trigger. Consecutive windows with the same
trigger make a phrase: the text from the first window's start to the last window's end. Triggers
depend on content only, so equal windows always fall in phrases with equal trigger strings, at equal
distances from the trigger: phrases overlap like those of a prefix-free parse and none is longer
than 2 * LENGTH bytes.
"""

from __future__ import annotations

import numpy as np

from . import bytehash as H

LENGTH, KMER = 100, 32
SPAN = LENGTH - KMER + 1


def parse(data: np.ndarray, off: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start of first window, windows, place of the trigger) of every phrase; places are in data."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - KMER + 1)
    x = (H.span(p, at, at + KMER) & ~H.U(0xFFFFFFFF)) | at.astype(H.U)
    width = 1
    while width * 2 <= SPAN:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    if width < SPAN:
        x = np.minimum(x[: len(x) - (SPAN - width)], x[SPAN - width :])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(x)]
    ok = np.flatnonzero(np.arange(len(x)) + LENGTH <= off[row + 1])
    if not len(ok):
        return (np.zeros(0, np.int64),) * 4
    a, row = (x[ok] & H.U(0xFFFFFFFF)).astype(np.int64), row[ok]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    return row[new], ok[new], np.diff(np.append(new, len(a))), a[new]
