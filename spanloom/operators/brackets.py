"""Bracket tests and repair of single strings, and of spans in their sentence."""

from __future__ import annotations

PAIRS = {")": "(", "]": "[", "}": "{"}
OPEN, CLOSE = frozenset(PAIRS.values()), frozenset(PAIRS)


def depth_profile(text: str) -> tuple[int, int]:
    """(final, least) depth when any closing bracket closes any opening one."""
    depth = least = 0
    for c in text:
        depth += (c in OPEN) - (c in CLOSE)
        least = min(least, depth)
    return depth, least


def balanced(text: str) -> bool:
    return depth_profile(text) == (0, 0)


def lacks_open(text: str) -> bool:
    return depth_profile(text)[1] < 0


def lacks_close(text: str) -> bool:
    depth, least = depth_profile(text)
    return depth > least


def wrapped(text: str) -> bool:
    """At least three characters within an outer pair, balanced inside."""
    return len(text) > 2 and PAIRS.get(text[-1]) == text[0] and balanced(text[1:-1])


def unmatched(text: str) -> list[int]:
    """Places of the brackets that are left when each closing one takes the bracket before it off the stack, if that is an
    opening one of its kind; else it stays on the stack itself, and nothing below it can be taken any more."""
    stack: list[int] = []
    for i, c in enumerate(text):
        if c in CLOSE and stack and text[stack[-1]] == PAIRS[c]:
            stack.pop()
        elif c in OPEN or c in CLOSE:
            stack.append(i)
    return stack


def typed_balanced(text: str) -> bool:
    return not unmatched(text)


def repair(text: str) -> str:
    """Unwrap a text whose outer pair encloses balanced text; of an unbalanced one, drop the outer brackets that make it
    so, where that helps."""
    if not text or not (OPEN | CLOSE) & set(text):
        return text
    paired = PAIRS.get(text[-1]) == text[0]
    if typed_balanced(text):
        return text[1:-1] if paired and typed_balanced(text[1:-1]) else text
    if paired:
        for other in (text[1:], text[:-1]):
            if typed_balanced(other):
                return other
        return text
    out = text
    if out[0] in OPEN:
        out = out[1:]
    if out and not typed_balanced(out) and out[-1] in CLOSE:
        out = out[:-1]
    return out if typed_balanced(out) else text
