"""Small example models for the scorer hooks (M1 c, N1 c, F10).

Factories live in an operator module so Python workers import only light
code when they unpickle them; each factory runs once per worker
(:func:`quill.operators.sentiment.cached_model`).
"""

from __future__ import annotations

import math
import re


def lexicon_model(weights):
    """Factory of a model mapping texts to (negative, neutral, positive) probabilities by lexicon votes."""
    table = dict(weights)

    def make():
        word = re.compile(r"\w+")

        def predict(texts):
            out = []
            for t in texts:
                sc = sum(table.get(w, 0.0) for w in word.findall(t.lower()))
                z = [math.exp(-sc / 100.0), 1.0, math.exp(sc / 100.0)]
                tot = sum(z)
                out.append([v / tot for v in z])
            return out
        return predict
    make.cache_key = ("lexicon_model", tuple(sorted(table.items())))
    return make


def email_model():
    """A tiny NER model: e-mail addresses as (text, label, start, end, score)."""
    pat = re.compile(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+")

    def predict(texts):
        return [[(m.group(), "EMAIL", m.start(), m.end(), 1.0) for m in pat.finditer(t)] for t in texts]
    return predict
