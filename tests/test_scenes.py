"""Clearest scenes: works of a tile and day share their windows."""

import datetime
import random

from tallyscope.operators import joins

FIRST = datetime.date(2024, 1, 1)


def test_windows_meet_scenes_and_works_look_them_up(spark):
    rng = random.Random(3)
    day = lambda n: FIRST + datetime.timedelta(n)
    scenes = [(rng.randrange(3), i, day(rng.randrange(200)), float(rng.randrange(60))) for i in range(400)] + [(None, 900, day(5), 1.0), (1, 901, None, 0.0)]
    # many works of few days; an id twice, an unknown tile and nulls
    works = [(i, rng.randrange(4), day(80 + i % 5), day(110 + i % 5)) for i in range(600)] + [(7, 1, day(20), day(50)), (8, None, day(80), day(110)), (601, 1, None, day(110))]
    got = joins.best_scenes(
        spark.createDataFrame(works, "work_id int, tile int, s date, e date"), spark.createDataFrame(scenes, "tile int, scene_id int, scene_day date, cloud double"), "tile", "work_id", "s", "e",
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_month" not in plan and "BroadcastHashJoin" in plan
    want = {}
    for w, tile, s, e in works:
        for phase, lo, hi in (("before", s and s - datetime.timedelta(60), s and s - datetime.timedelta(5)), ("after", e + datetime.timedelta(5), e + datetime.timedelta(60))):
            for t, i, d, cloud in scenes:
                if tile is not None and t == tile and lo and d and lo <= d <= hi and cloud <= 30:
                    want[w, phase] = min(want.get((w, phase), (99.0, d, i)), (cloud, d, i))
    assert {(r["work_id"], r["phase"]): (r["cloud"], r["scene_day"], r["scene_id"]) for r in got.collect()} == want
