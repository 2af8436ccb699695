"""Best feasible paths and legacy chains against all paths of small videos."""

import itertools
import random

import pytest

from vidsift.operators import sequences, temporal

C = "event_id string, video_id string, candidate_id long, keyframe_id int, t double, local_score double, provenance int, frame_seconds double"


def rows(seed):
    rng = random.Random(seed)
    out, i = [], 0
    for v in range(25):
        for e in "abc":
            for _ in range(rng.randrange(5)):
                i += 1
                t = None if rng.random() < 0.1 else float(rng.randrange(20))
                out.append((e, f"V{v}", i, rng.randrange(4), t, rng.randrange(4) / 4, rng.randrange(3), None if t is None or rng.random() < 0.5 else t + rng.choice([0.0, 3.0])))
    return out


@pytest.mark.parametrize(("least", "most", "hard", "same"), [(0.0, None, True, False), (2.0, 6.0, True, False), (2.0, None, True, True), (0.0, 5.0, True, True), (2.0, 6.0, False, False)])
def test_witness_is_the_best_path(spark, least, most, hard, same):
    data = rows(1)
    got = {r.video_id: (r.path, round(r.total, 6)) for r in temporal.witnesses(spark.createDataFrame(data, C), list("abc"), least, most, hard, same).collect()}

    def ok(p, q):
        gap = q[4] - p[4]
        return (gap >= 0 if same else gap > 0) and (not hard or (gap >= least and (most is None or gap <= most)))

    want = {}
    for v in {r[1] for r in data}:
        own = [[r for r in data if r[1] == v and r[0] == e and r[4] is not None] for e in "abc"]
        paths = [p for p in itertools.product(*own) if ok(p[0], p[1]) and ok(p[1], p[2])]
        if paths:
            best = min(paths, key=lambda p: (-sum(x[5] for x in p), [str(x[2]) for x in p]))
            want[v] = (">".join(str(x[2]) for x in best), round(sum(x[5] for x in best), 6))
    assert got == want and want


@pytest.mark.parametrize(("hard", "optional"), [(False, ()), (True, ()), (False, ("b",))])
def test_legacy_chains_equal_all_paths(spark, hard, optional):
    data = [r for r in rows(2) if r[4] is not None]
    got = {}
    for r in sequences.legacy_chains(spark.createDataFrame(data, C), list("abc"), optional=optional, beam=10_000, least_gap=2.0, most_gap=6.0, hard=hard).orderBy("video_id", "rank").collect():
        got.setdefault(r.video_id, []).append((r.path, round(r.score, 6), r.gap_violations, r.mapping_mismatch))
    want = {}
    for v in {r[1] for r in data}:
        own = [[r for r in data if r[1] == v and r[0] == e] + ([None] if e in optional else []) for e in "abc"]
        out = []
        for p in itertools.product(*own):
            real = [x for x in p if x]
            gaps = [b[4] - a[4] for a, b in zip(real, real[1:])]
            bad = sum(g < 2.0 or g > 6.0 for g in gaps)
            if any(g <= 0 for g in gaps) or (hard and bad):
                continue
            frames = [x[3] for x in real]
            must = sum(e not in optional for e, x in zip("abc", p) if x)
            score = 2.0 * must + 0.5 * (len(real) - must) + sum(x[5] for x in real) + 0.03 * sum(x[6] for x in real) - 0.25 * bad - 0.15 * (len(p) - len(real)) - (len(frames) - len(set(frames)))
            out.append(([str(x[2]) if x else "~skip" for x in p], round(score, 6), bad, any(x[7] is not None and abs(x[7] - x[4]) > 1.0 for x in real)))
        if out:
            want[v] = [(">".join(p), *rest) for p, *rest in sorted(out, key=lambda o: (-o[1], o[0]))[:5]]
    assert got == want
