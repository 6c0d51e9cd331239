"""Codes and codebooks against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np

from gaugeworks.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, part int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(kept rows, (code, error) of each, codebooks) by comparing with every entry."""
    kept = [(i, [math.floor(scale * float(c)) for c in e], label) for i, e, label in rows
            if e and all(c is not None and math.isfinite(c) and abs(c) <= 32768 for c in e) and len(e) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], [], []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    step = width // parts
    cut = lambda x: [tuple(x[p * step:(p + 1) * step]) for p in range(parts)]
    first = {}
    for i, x, _ in kept:
        first.setdefault(i, x)
    books = [list(c) for c in zip(*(cut(x) for x in list(first.values())[:entries]))]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, x, _ in kept:
                groups.setdefault(nearest(cut(x)[p], book)[1], []).append(cut(x)[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*groups[k])) if k in groups else e
                        for k, e in enumerate(book)]
    found = []
    for _, x, _ in kept:
        best = [nearest(part, book) for part, book in zip(cut(x), books)]
        found.append(("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return kept, found, books


def vectors(n=300, width=16, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(width)], rng.choice([0, 1, None])) for i in range(3, n)]
    rows += [(900 + i, list(rows[5][1]), 1) for i in range(150)]  # copies
    rows += [(2, None, 0), (1, [0.5] * (width - 1) + [None], 0), (0, [math.nan] * width, 1), (-1, [], 1),
             (-2, [math.inf] + [0.0] * (width - 1), 1), (-3, [1e30] + [0.0] * (width - 1), 1), (-4, [0.25] * 3, 1),
             (7, rows[9][1], 1), (7, rows[9][1], 1), (None, rows[3][1], None), (2000, [0.5] * (2 * width), 0)]
    to_float = lambda e: None if e is None else [None if c is None else float(np.float32(c)) for c in e]
    return [(i, to_float(e), label) for i, e, label in rows]


def test_tree_assigns_as_all_comparisons_do():
    rng = np.random.default_rng(3)
    for points in (rng.integers(-900, 900, (3000, 6)), rng.integers(-3, 3, (500, 4)), np.zeros((40, 2), np.int64),
                   np.repeat(rng.integers(-9, 9, (20, 3)), 50, axis=0), rng.integers(0, 9, (1, 5))):
        for entries in (points[:16], points[rng.integers(0, len(points), 5)] + 1, points[:1]):
            entries = entries.astype(np.int64)
            tree = codes.Tree.build(points, leaf=4)
            apart = codes.distances(points, entries)
            entry, error = tree.assigned(entries)
            assert (entry == apart.argmin(1)).all() and (error == apart.min(1)).all()
            count, total = tree.totals(entries)
            for k in range(len(entries)):
                mine = points[entry == k]
                assert count[k] == len(mine) and (total[k] == mine.sum(0)).all()


def test_tree_covers_and_separates():
    points = np.random.default_rng(4).integers(-400, 400, (800, 3))
    tree = codes.Tree.build(points, leaf=1)
    for node in range(len(tree.center)):
        below = tree.points[tree.low[node]:tree.high[node]]
        center = tree.points[tree.center[node]][None].astype(np.int64)
        assert np.sqrt(codes.distances(below, center).max()) <= tree.radius[node] + 1e-9
        children = np.arange(tree.first[node], tree.last[node])
        if len(children):
            centers = tree.points[tree.center[children]].astype(np.int64)
            apart = np.sqrt(codes.distances(centers, centers)) + np.eye(len(children)) * 1e9
            assert apart.min() > tree.radius[node] / 2
            assert tree.low[children[0]] == tree.low[node] and tree.high[children[-1]] == tree.high[node]


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(5)
    centers = rng.integers(-100_000, 100_000, (16, 4))
    points = centers[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 4))
    nodes, _, singles, _ = codes.Tree.build(points).descend(centers.astype(np.int64))
    assert len(singles) == 0 and len(nodes) < 100


def test_codes(spark, folder):
    rows = vectors()
    frame = spark.createDataFrame([r + ("c", 1, 2) for r in rows], SCHEMA).repartition(3)
    kept, expected, books = plain(rows)
    got = codes.op11_vector_codes(spark, folder(embeddings=frame)).collect()
    by_label = {}
    for (_, _, label), (_, error) in zip(kept, expected):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    key = lambda r: tuple((c is None, c or 0) if not isinstance(c, str) else c for c in r)
    assert sorted(map(tuple, got), key=key) == sorted(
        ((i, code, error, by_label[label], sha) for (i, _, label), (code, error) in zip(kept, expected)), key=key)


def test_blocks_do_not_matter(spark):
    rows = vectors(80)
    frame = spark.createDataFrame([r + ("c", 1, 2) for r in rows], SCHEMA).coalesce(1)
    kept = codes.whole_numbers(frame)
    books = codes.first_codebooks(kept, 8, 16)
    for size in (1, 7, 10_000):
        made = codes.blocks(kept, 16, 8, rows=size).persist()
        assert [b.tolist() for b in codes.next_codebooks(made, books)] == [
            [list(e) for e in b] for b in plain(rows, rounds=1)[2]]


def test_few_and_none(spark):
    frame = spark.createDataFrame([r + ("c", 1, 2) for r in vectors()[:2]], SCHEMA)
    found, books = codes.compress(frame)
    assert len(books) == 8 and len(books[0]) == 2
    assert [(r["code"], r["error"]) for r in found.orderBy("vec_id").collect()] == [("00" * 8, 0), ("01" * 8, 0)]
    found, books = codes.compress(frame.limit(0))
    assert books == [] and found.count() == 0
