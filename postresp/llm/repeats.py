"""Maximal repeats in an enhanced suffix array: suffixes in order, the common
prefix of neighbours, and a scan with a stack that closes each common-prefix
interval.  A group of an interval's members whose left contexts differ, and
which is not inside one child, is a maximal repeat with all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:                  # a[:low] == b[:low], a[:n] != b[:n]
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def suffix_array(suffixes: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """(order of the suffixes, common prefix of each with the one before it)."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    lcp = [0] * len(order)
    for k in range(1, len(order)):
        lcp[k] = common_prefix(suffixes[order[k - 1]], suffixes[order[k]])
    return order, lcp


def intervals(lcp: Sequence[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, depth, depth of the parent) of every common-prefix interval
    of at least ``least``, children before parents: the common-prefix tree."""
    stack: list[tuple[int, int]] = []         # (depth, first) of the open intervals
    n = len(lcp)
    for k in range(1, n + 1):
        depth, first = lcp[k] if k < n else -1, k - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            parent = max(depth, stack[-1][0] if stack else -1)
            if top >= least:
                yield first, k - 1, top, max(parent, 0)
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def anchored_repeats(lefts: Sequence[bytes], rights: Sequence[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left length, right length, members) of all maximal repeats of ``least``
    bytes and more around one anchor.

    Member i reads ``lefts[i]`` backwards from the anchor and ``rights[i]``
    forwards.  For every interval of the right contexts, the members' left
    contexts have a common-prefix tree of their own; a node of it is left
    diverse by construction, and a maximal repeat unless all its members lie in
    one child of the right interval (then the child reports it, longer)."""
    n = len(rights)
    if n == 2:
        left, right = common_prefix(lefts[0], lefts[1]), common_prefix(rights[0], rights[1])
        if left + right >= least:
            yield left, right, [0, 1]
        return
    order, lcp = suffix_array(rights)
    most = max(map(len, lefts))
    by_left = sorted(range(n), key=lefts.__getitem__)
    left_rank = [0] * n
    for k, i in enumerate(by_left):
        left_rank[i] = k
    for first, last, right, _ in intervals(lcp, max(least - most, 0)):
        members = sorted(order[first:last + 1], key=left_rank.__getitem__)
        # where a child of the interval ends: neighbours that share no more than its depth
        child = {}
        number = 0
        for k in range(first, last + 1):
            if k > first and lcp[k] == right:
                number += 1
            child[order[k]] = number
        left_lcp = [0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for lo, hi, left, _ in intervals(left_lcp, max(least - right, 0)):
            group = members[lo:hi + 1]
            if any(child[i] != child[group[0]] for i in group):
                yield left, right, group
