"""Small steps of record linkage inside a task: which pairs decide clusters, and which clusters settle within a block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Pairs that a task holds before it keeps the deciding ones only.
HELD_PAIRS = 1_000_000
NO_ID = np.iinfo(np.int64).min

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hash_pair(a: np.ndarray, b: np.ndarray, a_known: np.ndarray, b_known: np.ndarray) -> np.ndarray:
    """`xxhash64(a, b)` of two bigint columns as Spark computes it; an unknown value leaves the hash as it is."""
    value = np.full(len(a), 42, np.uint64)
    for ids, known in ((a, a_known), (b, b_known)):
        h = value + _P5 + np.uint64(8)
        h ^= _turn(ids.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = _turn(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        value = np.where(known, h ^ (h >> np.uint64(32)), value)
    return value.view(np.int64)


def _first_edge(x: np.ndarray, y: np.ndarray, nodes: int) -> np.ndarray:
    """Place of the first edge of each node; the number of edges where it has none."""
    places, first = np.arange(len(x)), np.full((2, nodes), len(x))
    for end, found in zip((x, y), first):
        found[end[::-1]] = places[::-1]
    return first.min(axis=0)


def _tops(up: np.ndarray) -> np.ndarray:
    while True:
        higher = up[up]
        if np.array_equal(higher, up):
            return up
        up = higher


def spanning_forest(x: np.ndarray, y: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the edges that join two trees when edges are taken one after the other."""
    tree, left, kept = np.arange(nodes), np.arange(len(x)), []
    while True:
        a, b = tree[x[left]], tree[y[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        first = _first_edge(a, b, nodes)
        roots = np.flatnonzero(first < len(left))
        chosen = first[roots]
        kept.append(left[chosen])
        up = np.arange(nodes)
        up[roots] = a[chosen] + b[chosen] - roots
        both = roots[(up[up[roots]] == roots) & (roots < up[roots])]
        up[both] = both
        tree = _tops(up)[tree]


def _ints(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table[name].combine_chunks().cast(pa.int64())
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _codes(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def deciding_pairs(scope: list[str], fields: list[str], widest: int, score: Callable) -> Callable:
    """A function of the reports of several blocks of time that gives the pairs which decide clusters.

    Pairs are taken in the order of `score`, distance and the hash of their ids. One whose reports are connected already
    by earlier pairs of the block joins no two clusters, whatever else there is, and is left out. The first pair of a
    report with copies stays, by its notes among equals, since its copies are lost on it.
    """

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*scope, "block", "us", "report_id")]).combine_chunks()
        n = table.num_rows
        us, (ids, known) = _ints(table, "us")[0], _ints(table, "report_id")
        album, has_album = _ints(table, "album_id")
        dur, has_dur = _ints(table, "dur")
        source, own = _codes(table, "source"), ~table["halo"].to_numpy()
        several = _ints(table, "copies")[0] > 1
        starts = np.zeros(n, bool)
        starts[:1] = True
        for name in (*scope, "block"):
            code = _codes(table, name)
            starts[1:] |= code[1:] != code[:-1]
        group = np.cumsum(starts)
        # The last row that is near, found among all blocks one after the other. Times count from the first of their block,
        # which keeps the sum small however many blocks and years there are.
        within = us - us[starts][group - 1]
        spaced = within + group * (within.max() + widest + 1)
        ends = np.searchsorted(spaced, spaced + widest, "right")

        def features(i, j):
            same_album = has_album[i] & has_album[j] & (album[i] == album[j])
            off, longer = np.abs(dur[i] - dur[j]), np.maximum(dur[i], dur[j])
            return us[j] - us[i], same_album, off, longer, has_dur[i] & has_dur[j]

        def kept(i, j):
            diff, same_album, *rest = features(i, j)
            points = score(diff, same_album, *rest)
            order = np.lexsort((ids[j], ids[i], hash_pair(ids[i], ids[j], known[i], known[j]), diff, -points))
            forest = order[spanning_forest(i[order], j[order], n)]
            copied = np.flatnonzero(several[i] | several[j])
            if len(copied):
                copied = copied[np.lexsort((same_album[copied], diff[copied], -points[copied]))]
                first = _first_edge(i[copied], j[copied], n)[several]
                forest = np.union1d(forest, copied[first[first < len(copied)]])
            return i[forest], j[forest]

        held, size, step, at = [], 0, 0, np.flatnonzero(own)
        while len(at):
            step += 1
            at = at[at + step < ends[at]]
            i, j = at, at + step
            here = (source[i] != source[j]) & ((us[i] < us[j]) | (known[i] & known[j] & (ids[i] < ids[j])))
            i, j = i[here], j[here]
            merged = score(*features(i, j)) > 0
            held.append((i[merged], j[merged]))
            size += int(merged.sum())
            if size > HELD_PAIRS:
                held = [kept(*(np.concatenate(side) for side in zip(*held)))]
                size = 0
        i, j = kept(*(np.concatenate(side) for side in zip(*held))) if held else (np.zeros(0, np.int64),) * 2
        columns = {c: table[c].take(pa.array(i)) for c in (*scope, "session_key")}
        columns.update({f"{end}_{c}": table[c].take(pa.array(side)) for end, side in (("a", i), ("b", j)) for c in fields})
        return pa.table({**columns, "diff_us": pa.array(us[j] - us[i])})

    return pairs


STANDING, ORDER = ["source", "duration", "us", "id"], ["score", "diff_us", "tie", "a", "b"]


def settle_blocks(table: pa.Table) -> pa.Table:
    """Rounds in which the clusters of a block look at their first edge and lose to a better leader there.

    Of the nodes that `a_in` and `b_in` name all edges are here. A cluster of such nodes that looks at another one may
    lose; what touches other nodes waits. `kind` 0 is a loss (a to b, in the end under top), 1 an edge between leaders,
    2 and 3 an edge of which only a or b was in the block.
    """
    m = table.num_rows
    block = _ints(table, "block")[0]
    ends = [np.concatenate([block, block])] + [
        np.concatenate([_ints(table, f"{end}_{f}")[0] for end in "ab"]) for f in STANDING]
    order = np.lexsort(ends[:0:-1] + ends[:1])
    new = np.zeros(2 * m, bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in ends], axis=0)
    node = np.empty(2 * m, np.int64)
    node[order] = np.cumsum(new)
    first = np.concatenate([[0], np.flatnonzero(new)])
    rows, nodes = order[first], len(first)
    inside = np.concatenate([table[f"{end}_in"].to_numpy() for end in "ab"])
    inner = inside[rows]
    taken = np.lexsort([_ints(table, f"w_{f}")[0] for f in ORDER[::-1]])
    x, y, left = node[:m][taken], node[m:][taken], taken
    top, losses = np.arange(nodes), []
    while True:
        x, y = top[x], top[y]
        apart = x != y
        x, y, left = x[apart], y[apart], left[apart]
        if not len(left):
            break
        least = _first_edge(x, y, nodes)
        looking = np.flatnonzero((least < len(left)) & inner)
        place = least[looking]
        other = x[place] + y[place] - looking
        lost = (other < looking) & inner[other]
        if not lost.any():
            break
        losses.append((looking[lost], other[lost], left[place[lost]]))
        up = np.arange(nodes)
        up[looking[lost]] = other[lost]
        up = _tops(up)
        top = up[top]
    me, other, edge = (np.concatenate(c) for c in zip(*losses)) if losses else (np.zeros(0, np.int64),) * 3
    both = table["a_in"].to_numpy()[left] & table["b_in"].to_numpy()[left]
    half = np.where(both, 1, np.where(table["a_in"].to_numpy()[left], 2, 3))
    a_end, b_end = node[:m][left], node[m:][left]
    parts = {
        "kind": np.concatenate([np.zeros(len(me), int), half]), "edge": np.concatenate([edge, left]),
        "a": np.concatenate([me, top[a_end]]), "b": np.concatenate([other, top[b_end]]),
        "top": np.concatenate([top[me], top[a_end]]),
    }
    out = {"kind": pa.array(parts["kind"], pa.int32())}
    source = pa.array(parts["edge"])
    out["edge"] = table["edge"].take(source)
    known = {f: pa.concat_arrays([table[f"{end}_{f}"].combine_chunks() for end in "ab"]) for f in STANDING}
    for name in ("a", "b", "top"):
        at = pa.array(rows[parts[name]])
        out.update({f"{name}_{f}": known[f].take(at) for f in STANDING})
    out.update({f"w_{f}": table[f"w_{f}"].take(source) for f in ORDER})
    out["reason"] = table["reason"].take(source)
    return pa.table(out)
