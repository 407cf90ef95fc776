"""Edit distance of whole sequences: bit vectors of one column of the table at a time, in memory that is linear in their lengths."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and substitutions that turn a into b.

    The differences of neighbouring cells of a column are the bits of two numbers, so that a column takes some dozen
    operations on numbers of len(a) bits.
    """
    if len(a) < len(b):
        a, b = b, a
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    a, b = a[start:], b[start:]
    same = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(b))
    a, b = a[: len(a) - same], b[: len(b) - same]
    rest = iter(a)
    if all(x in rest for x in b):  # a holds all of b in its order
        return len(a) - len(b)
    held: dict[Hashable, bytearray] = {}
    for i, x in enumerate(a):
        if x not in held:
            held[x] = bytearray(len(a) // 8 + 1)
        held[x][i >> 3] |= 1 << (i & 7)
    places = {x: int.from_bytes(v, "little") for x, v in held.items()}
    every, last, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = every, 0  # cells that are one more, or one less, than the cell above
    for x in b:
        equal = places.get(x, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        score += (right >> last & 1) - (left >> last & 1)
        right = right << 1 | 1
        up = (left << 1 | ~(equal | down | right)) & every
        down = right & (equal | down) & every
    return score
