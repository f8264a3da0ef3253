"""Suffix arrays by grouping, for many independent strings at once.

Suffixes are first put into groups by their first symbol. Groups are taken from the
greatest to the least; when one is taken, each of its suffixes points at the last suffix
before it that stands in a lower group (its previous smaller suffix), and the suffixes
pointed at move to new groups right behind their old ones, in order of how many pointers
they got. In the end a group holds the suffixes that start with one longest Lyndon word.
Then ranks are handed out from the least suffix up: the suffix before the one just
ranked, and whatever its pointers lead to, take the next place of their groups. Nothing
is renamed or sorted again, and every suffix is pointed at and placed once.

Strings do not meet; step k works on the k-th group, or the k-th rank, of all of them
together, so that a step is a few array operations for thousands of strings."""

from __future__ import annotations

import numpy as np


def spread(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of runs (first, first + 1, ... of ``length`` each), one run
    after the other, and the run of each."""
    run = np.repeat(np.arange(len(first)), length)
    skip = np.cumsum(length) - length
    return np.arange(len(run)) + (first - skip)[run], run


def _groups(text: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the first slot of its final group, and the suffix it points at
    (one before its string: none). Slot numbers go through all strings."""
    n = len(text)
    owner = np.repeat(np.arange(len(base) - 1), np.diff(base))
    key = owner * (int(text.max()) + 1) + text
    sa = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    head = np.flatnonzero(np.concatenate(([True], np.diff(key[sa]) != 0)))
    width = np.diff(np.append(head, n))
    # One cell more, so that index -1, before the first string, is a slot below all.
    group = np.full(n + 1, -1, np.int64)
    group[sa] = np.repeat(head, width)
    stop = np.empty(n, np.int64)
    stop[head] = head + width - 1
    back = np.full(n + 1, -1, np.int64)
    chosen = np.zeros(n, bool)
    right, low = base[1:] - 1, base[:-1]
    while len(right):
        left = group[sa[right]]
        slots, run = spread(left, right - left + 1)
        own = sa[slots]
        mine = left[run]
        to = own - 1
        live = np.flatnonzero(group[to] > mine)
        while len(live):
            to[live] = back[to[live]]
            live = live[group[to[live]] > mine[live]]
        back[own] = to
        live = np.flatnonzero(group[to] == mine)
        while len(live):  # runs of one word: pointers that double their reach
            back[own[live]] = back[back[own[live]]]
            live = live[group[back[own[live]]] == mine[live]]
        to = back[own]
        to = to[to >= low[run]]
        if len(to):
            to.sort()
            new = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            times = np.diff(np.append(new, len(to)))
            moved = to[new]
            old = group[moved]
            order = np.lexsort((times, old))
            moved, old, times = moved[order], old[order], times[order]
            fresh = np.concatenate(([True], old[1:] != old[:-1]))
            begin = np.flatnonzero(fresh)
            count = np.diff(np.append(begin, len(moved)))
            which = np.cumsum(fresh) - 1
            floor = (stop[old[begin]] - count + 1)[which]
            target = floor + np.arange(len(moved)) - begin[which]
            # Those that stood in the new places go where the moved ones came from.
            chosen[moved] = True
            held = sa[target]
            held = held[~chosen[held]]
            at = place[moved]
            free = at[at < floor]
            sa[free], place[held] = held, free
            sa[target], place[moved] = moved, target
            chosen[moved] = False
            stop[old[begin]] = floor[begin] - 1
            cut = np.flatnonzero(fresh | np.concatenate(([True], times[1:] != times[:-1])))
            size = np.diff(np.append(cut, len(moved)))
            group[moved] = np.repeat(target[cut], size)
            stop[target[cut]] = target[cut] + size - 1
        more = left > low
        right, low = left[more] - 1, low[more]
    return group[:n], back[:n]


def suffix_arrays(text: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``text`` holds one string after the other; string i is ``text[base[i]:base[i+1]]``
    and ends in a symbol that is its least and stands nowhere else in it. Returns all
    suffixes (by their positions in ``text``), string after string, each in order."""
    if not len(text):
        return np.empty(0, np.int64)
    group, back = _groups(text, base)
    order = np.argsort(base[:-1] - base[1:], kind="stable")  # longest first: those still at work are the first ones
    low, length = base[:-1][order], np.diff(base)[order]
    out = np.full(len(text), -1, np.int64)
    free = np.arange(len(text))  # by a group's first slot: its next free one
    placed = np.zeros(len(text) + 1, bool)
    out[low], placed[low + length - 1] = low + length - 1, True
    busy = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    for k, most in enumerate(busy.tolist()):
        floor = low[:most]
        at = out[floor + k] - 1
        keep = np.flatnonzero((at >= floor) & ~placed[at])
        at, floor = at[keep], floor[keep]
        while len(at):
            mine = group[at]
            slot = free[mine]
            out[slot] = at
            free[mine] = slot + 1
            placed[at] = True
            at = back[at]
            keep = np.flatnonzero((at >= floor) & ~placed[at])
            at, floor = at[keep], floor[keep]
    return out
