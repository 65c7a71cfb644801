import itertools

import pytest

from dawnscore.llm.near_dup import near_duplicates

from .cases import ODD, frame, prose, words


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = low.encode().split()
    if not found:
        return set()
    return {tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def group(first, seed, copies, edits):
    """A text and copies of it with so many words changed, each at its own places."""
    base = words(seed, 300)
    out = [(first, " ".join(base))]
    for k in range(1, copies):
        copy = list(base)
        for e in range(edits):
            copy[(37 * k + 61 * e) % 300] = f"e{k}_{e}"
        out.append((first + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("edits", [3, 7, 9])
def test_groups_equal_brute_force(spark, edits):
    rows = (group(0, 5, 60, edits) + group(1000, 6, 8, 2) + [(2000 + k, prose(50 + k)) for k in range(20)]
            + [(3000 + k, prose(77)) for k in range(30)] + [(i, t) for i, t in ODD])
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_shared_passage_does_not_link(spark):
    shared = prose(9, 60)
    rows = [(k, shared + " " + prose(100 + k, 200)) for k in range(80)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert all(r.kept for r in got)


def test_case_and_empty(spark):
    rows = [(7, "One two THREE four five six"), (3, "one TWO three Four five six"), (9, "ÄB c d e f"), (4, "äb c d e f")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == {7: (3, False), 3: (3, True), 9: (9, True), 4: (4, True)}
    assert near_duplicates(frame(spark, [])).count() == 0
