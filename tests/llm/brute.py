"""Shared helpers: rows of a frame as plain tuples, and random texts with repeats."""

import random


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def texts(count, seed, vocabulary=6, longest=30):
    """Texts over few words, so that passages repeat; with nulls, blanks, odd spaces and exact copies."""
    draw = random.Random(seed)
    made = []
    for _ in range(count):
        kind = draw.random()
        if kind < 0.05:
            made.append(None)
        elif kind < 0.1:
            made.append(draw.choice(["", " ", "\n\t "]))
        elif kind < 0.25 and made:
            made.append(draw.choice(made))
        else:
            words = [f"w{draw.randrange(vocabulary)}é" for _ in range(draw.randrange(1, longest))]
            made.append("".join(w + draw.choice([" ", "\n", "  ", " x "]) for w in words))
    return made
