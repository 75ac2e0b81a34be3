"""Best windows by a plain sweep of one text, to hold the operator against."""

import regex

from gleaner.functions.text import SEPARATORS, TOKEN

SIZE = 400

_TOKEN, _PARTS = regex.compile(TOKEN), regex.compile(SEPARATORS)
_HUMPS = regex.compile(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")


def occurrences(text: str) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of each token, of its parts and of their humps."""
    out = []
    for m in _TOKEN.finditer(text):
        out.append((m.group().lower(), m.start(), m.end()))
        at = m.start()
        pieces = _PARTS.split(m.group())
        gaps = [len(x) for x in _PARTS.findall(m.group())] + [0]
        for piece, gap in zip(pieces, gaps):
            spans = [(at, at + len(piece))]
            cuts = [at, *[at + x.start() for x in _HUMPS.finditer(piece)], at + len(piece)]
            if len(cuts) > 2:
                spans += list(zip(cuts[:-1], cuts[1:]))
            if len(pieces) == 1:
                spans = spans[1:]
            out += [(text[a:b].lower(), a, b) for a, b in spans if b > a]
            at += len(piece) + gap
    return out


def best_window(text: str, weights: dict[str, float], size: int = SIZE) -> tuple[int, int]:
    """The window of ``size`` characters with the greatest weight of distinct terms, the first of equals.

    Only windows that end at the end of an occurrence, or begin at 0, need to be tried. They are
    gone through in order, occurrences coming in by their ends and going out by their starts.
    """
    size = min(size, len(text))
    last = len(text) - size
    found = {(t, a, b) for t, a, b in occurrences(text) if t in weights and b - a <= size}
    coming, going = sorted(found, key=lambda x: x[2]), sorted(found, key=lambda x: x[1])
    inside: dict[str, int] = {}
    best, best_score, score = 0, 0.0, 0.0
    n_in = n_out = 0
    for p in sorted({max(0, b - size) for _, _, b in found if max(0, b - size) <= last}):
        while n_in < len(coming) and coming[n_in][2] <= p + size:
            t, n_in = coming[n_in][0], n_in + 1
            inside[t] = inside.get(t, 0) + 1
            score += weights[t] if inside[t] == 1 else 0.0
        while n_out < len(going) and going[n_out][1] < p:
            t, n_out = going[n_out][0], n_out + 1
            inside[t] -= 1
            score -= weights[t] if inside[t] == 0 else 0.0
        if score > best_score + 1e-12:
            best, best_score = p, score
    return best, best + size
