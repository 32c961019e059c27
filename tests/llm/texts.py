"""Texts for the operators' tests: invented, with the cases that break things."""

import random


def sentence(rng, n):
    syllables = ("ka", "lo", "mi", "tu", "re", "so", "ven", "dar", "pil", "ö", "né")
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=5, n=40):
    """Texts by id: fresh ones, exact copies, near copies in a chain, shared passages, and odd ones."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(60, 200)) for _ in range(n)]
    passage = sentence(rng, 80)
    texts += [f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}" for _ in range(6)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[3] + " "]
    chain = texts[2].split()
    for _ in range(8):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = sentence(rng, 1) + "x"
        texts.append(" ".join(chain))
    line = sentence(rng, 12)
    texts += ["\n".join([line] * 8), "one", "two words", "one", "", None, "   \n\t ", "ab " * 3000, "x" * 20000]
    texts += ["# * $ % & | < > " * 10, "a\x1cb c d\u00a0e f\u3000g"]
    return dict(enumerate(texts))
