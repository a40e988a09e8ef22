"""Plain versions of what the operators compute, for comparison."""

import re


def shingles(text, k=3):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0
