"""A word lexicon as a minimal acyclic automaton with outputs, in one memory-mapped file.

Words go in sorted, and equal suffixes are one state (Daciuk et al., 2000).  A
transition's output is the number of words that sort before those behind it, so
the outputs along a path add up to the word's number, which tells its ids.
"""

from __future__ import annotations

import os

import numpy as np

from chronarch.llm.shipping import Mapped


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of the file: first transition and finality of each state, labels, targets and outputs, id offsets, ids."""
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    path: list[dict[int, object]] = [{}]
    final = [False]
    states: list[tuple] = []

    def close(depth: int, last: bytes) -> None:
        """Give numbers to the states of the last word below ``depth``, from its end."""
        while len(path) - 1 > depth:
            key = (final.pop(), tuple(path.pop().items()))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][last[len(path) - 1]] = register[key]

    last = b""
    for word in ordered:
        same = len(os.path.commonprefix([word, last]))
        close(same, last)
        for c in word[same:]:
            path[-1][c] = None
            path.append({})
            final.append(False)
        final[-1] = True
        last = word
    close(0, last)
    states.append((final[0], tuple(path[0].items())))

    behind = []  # words behind each state; targets have lower numbers
    first, label, target, output = [0], [], [], []
    for is_final, arcs in states:
        n = int(is_final)
        for c, to in arcs:
            label.append(c), target.append(to), output.append(n)
            n += behind[to]
        behind.append(n)
        first.append(len(label))
    ids = [x for w in ordered for x in words[w]]
    offsets = np.cumsum([0] + [len(words[w]) for w in ordered])
    told = {"first": first, "final": [int(s[0]) for s in states], "target": target, "output": output, "offsets": offsets, "ids": ids}
    return {"label": np.array(label, np.uint8)} | {k: np.array(x, np.int32) for k, x in told.items()}


class Lexicon:
    """Reads the mapped file of ``build`` in place."""

    def __init__(self, file: Mapped) -> None:
        view = memoryview(file.map)
        self.first, self.final, self.target, self.output, self.offsets, self.ids = (
            view[file.at[k] : file.at[k] + file[k].nbytes].cast("i") for k in ("first", "final", "target", "output", "offsets", "ids")
        )
        self.map, self.labels = file.map, file.at["label"]
        self.bytes = [bytes([c]) for c in range(256)]
        self.root = len(self.final) - 1

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        first, labels = self.first, self.labels
        for c in word:
            k = self.map.find(self.bytes[c], labels + first[state], labels + first[state + 1]) - labels
            if k < 0:
                return None
            number += self.output[k]
            state = self.target[k]
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if self.final[state] else None
