"""Plain versions of what the operators compute."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if min(n) <= 0:
        return [0, 0.5, 1, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))]


class KneserNey:
    """Interpolated modified Kneser-Ney over (context, symbol) counts; contexts are tuples, nearest symbol last.

    `fixed` leading parts of a context are never dropped."""

    def __init__(self, counts, order, floor, fixed=0):
        self.floor, self.fixed, self.levels = floor, fixed, {}
        for level in range(order, 0, -1):
            contexts = defaultdict(lambda: [0, 0, 0, 0])
            for (context, _), c in counts.items():
                contexts[context][0] += c
                contexts[context][min(c, 3)] += 1
            self.levels[level] = (counts, contexts, discounts(counts.values()))
            counts = Counter((self.shorter(context), s) for context, s in counts)

    def shorter(self, context):
        return context[:self.fixed] + context[self.fixed + 1:]

    def p(self, context, symbol, level=None):
        level = len(self.levels) if level is None else level
        if not level:
            return self.floor
        counts, contexts, taken = self.levels[level]
        lower = self.p(self.shorter(context), symbol, level - 1)
        if context not in contexts:
            return lower
        total, *n = contexts[context]
        c = counts.get((context, symbol), 0)
        return (max(c - taken[min(c, 3)], 0) + sum(t * k for t, k in zip(taken[1:], n)) * lower) / total


def word_pairs(texts):
    """Tokens of each text, with None for the end."""
    return [[*WORD.findall(lower(t or "")), None] for t in texts]


def log10(x):
    return math.log10(x)
