"""Line dedup by loops, from the same definitions."""

from __future__ import annotations

from collections import Counter, defaultdict

from colloquy.llm import line_templates as lt


def plain_dedup(rows, share=lt.SHARE, copies=None):
    """The cleaned texts of rows of (id, text)."""
    docs = {(i, t) for i, t in rows}
    at = [(doc, j, line, tuple(lt.masked(line))) for doc in docs for j, line in enumerate((doc[1] or "").split("\n")) if lt.masked(line)]
    have, leaves = defaultdict(set), defaultdict(set)
    for doc, _, _, w in at:
        have[w].add(doc)
        for k, (a, b) in enumerate(lt.runs(len(w))):
            leaves[len(w), k, w[a:b]].add(w)
    exact = {w: min(i for i, _ in its) for w, its in have.items() if len(its) > 1}
    ways = defaultdict(set)
    for w, first in exact.items():
        ways[w].add(first)
    for lines in leaves.values():
        template = []
        for column in zip(*lines, strict=True):
            (t, c), *others = Counter(column).most_common(2)
            template.append(t if not others or others[0][1] < c else None)
        members = [w for w in lines if sum(x == y for x, y in zip(w, template, strict=True)) >= share * len(w)] if len(lines) > 1 else []
        its = set().union(*(have[w] for w in members))
        if len(its) > 1:
            for w in members:
                ways[w].add(min(i for i, _ in its))
    gone, whole = defaultdict(list), defaultdict(int)
    for doc, j, line, w in at:
        whole[doc] += len(line)
        if any(first != doc[0] for first in ways[w]):
            gone[doc].append((j, len(line), exact.get(w, min(ways[w])), len(ways[w]) > 1))
    left = {doc: whole[doc] - sum(g[1] for g in gone[doc]) for doc in docs}
    stays = defaultdict(set)
    for doc, lines in gone.items() if copies is not None else ():
        by = Counter()
        for _, n, first, _ in lines:
            by[first] += n
        if not lines:
            continue
        shared, original = max((n, first) for first, n in by.items())
        rest, other = left[doc] + shared, max(left[d] for d in docs if d[0] == original)
        if shared >= copies * rest and shared >= copies * (rest + other - shared):
            stays[doc] = {j for j, _, first, several in lines if first == original and not several}
    out = []
    for i, t in rows:
        drop = {j for j, *_ in gone[i, t]} - stays[i, t]
        out.append(t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop))
    return out
