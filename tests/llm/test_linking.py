"""What the similarity joins send between tasks."""

import numpy as np

from assayline.llm import linking

P = linking.LinkParameters()


def found(spark, runs):
    """Rows of ``runs`` for (signature, [(fp, size), ...])."""
    sig, fps, sizes = ([np.array(x) for x in zip(*[(s, f, n) for s, held in runs for f, n in held], strict=True)][i] for i in range(3))
    packed = linking.pack([sig.astype(np.uint64)], [fps.astype(np.int64)], [linking.steps(sizes)], 1, linking.NO_HOT)
    dealt = spark.createDataFrame(packed.to_pandas(), "bucket int, packed binary")
    rows = linking.runs(dealt, linking.NO_HOT, P).collect()
    return {(r.a, r.b) for r in rows if r.run is None}, [(r.run, r.b) for r in rows if r.run is not None]


def test_runs_are_cut_where_sizes_lie_too_far_apart(spark):
    pairs, held = found(spark, [(1, [(1, 100), (2, 30)]), (2, [(3, 100), (4, 76), (5, 20), (6, 21)]), (3, [(1, 100), (7, 75)])])
    assert pairs == {(3, 4), (5, 6), (1, 7)} and not held


def test_no_sizes_that_can_link_are_too_far_apart():
    n = np.unique(np.geomspace(1, 1e7, 3_000).astype(np.int64))
    for percent in (75, 80):
        least = -(-n * percent // 100)
        assert (linking.steps(n).astype(int) - linking.steps(least) <= linking.most_steps(percent)).all()


def test_a_group_of_near_copies_is_held_once(spark):
    runs = [(s, [(f, 50) for f in range(200) if f == 0 or f % 40 != s]) for s in range(30)]
    pairs, held = found(spark, runs)
    assert pairs == {(0, f) for f in range(1, 200)}
    assert len(held) == 200 and len({run for run, _ in held}) == 1


def test_marks_pass_what_is_wanted(spark):
    rng = np.random.default_rng(2)
    wanted, other = rng.integers(-(1 << 63), 1 << 63, 5_000), rng.integers(-(1 << 63), 1 << 63, 5_000)
    got = linking.marks(spark.createDataFrame([(int(x),) for x in wanted], "fp long"), P)
    assert got.of(wanted).all() and got.of(other).mean() < 0.05
    none = linking.marks(spark.createDataFrame([], "fp long"), P)
    assert not none.of(wanted).any()


def test_bodies_are_fetched_for_pairs_that_bitmaps_allow(spark):
    sets = {1: np.arange(100), 2: np.arange(5, 105), 3: np.arange(500, 600)}
    sets = {k: (x.astype(np.uint64) << np.uint64(20)) for k, x in sets.items()}
    maps = linking.bitmaps(list(sets.values()), P.bits)
    sketches = linking.by_node(spark.createDataFrame([(k, len(x), m) for (k, x), m in zip(sets.items(), maps.to_pylist(), strict=True)], "fp long, n long, bitmap binary"), 300, P)
    asked = []

    def fetch(fps):
        asked.append({r.fp for r in fps.collect()})
        return spark.createDataFrame([(k, bytearray([k])) for k in (*asked[-1], *asked[-1])], "fp long, body binary")

    rows = spark.createDataFrame([(None, 1, 2), (None, 1, 3), (9, None, 1), (9, None, 2), (9, None, 3)], "run long, a long, b long")
    got = linking.linked(rows, sketches, fetch, lambda bodies: [sets[x[0]] for x in bodies], P).collect()
    assert {(r.node, r.root) for r in got} == {(1, 1), (2, 1)} and asked == [{1, 2}]


def test_bitmaps_of_large_sets_rule_out_pairs_that_share_little(spark):
    # at 1,024 bits half of them are odd in every set of thousands of tokens
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 48, 40_000, dtype=np.uint64))
    sets = [np.sort(rng.permutation(pool)[:n]) for n in (3_000, 2_600, 9_000, 9_000)] + [pool[:3_000], pool[:2_700], pool[100:3_000]]
    maps = linking.bitmaps(sets, P.bits).to_pylist()
    sketches = spark.createDataFrame([(i, len(x), m) for i, (x, m) in enumerate(zip(sets, maps, strict=True))], "fp long, n long, bitmap binary")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (4, 6)], "a long, b long")
    assert {(r.a, r.b) for r in linking.close(pairs, sketches, P).collect()} == {(4, 5), (4, 6)}


def test_bitmaps_bound_the_difference_at_every_size():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64))
    sets = [np.sort(rng.permutation(pool[: n + n // 4])[:n]) for n in rng.integers(1, 12_000, 60)]
    maps = linking.Bitmaps(linking.bitmaps(sets, P.bits).to_pylist())
    x, y = (i.ravel() for i in np.indices((60, 60)))
    differ = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    got = maps.differ(x, y)
    assert (got <= differ).all() and (got[x == y] == 0).all() and len(maps.held) > 3
