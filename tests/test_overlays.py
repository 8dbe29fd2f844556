"""The log of imports and undos against a stack."""

from __future__ import annotations

import random

from quire.operators import overlays

LOG, PATCH, BASE = "scope string, at long, action string, sha string", "scope string, at long, item int, field string, place int, value string", "scope string, item int, field string, value string"


def played(log, patches, base):
    """Statuses by (scope, at) and the state, an entry at a time."""
    status, stacks, known = {}, {}, set()
    for scope, at, action, sha in sorted(log, key=lambda e: (e[0], e[1])):
        stack = stacks.setdefault(scope, [])
        if action == "undo":
            status[scope, at] = "undo" if stack else "nothing_to_undo"
            if stack:
                status[scope, stack.pop()] = "undone"
        elif (scope, sha) in known:
            status[scope, at] = "already_applied"
        else:
            known.add((scope, sha))
            stack.append(at)
            status[scope, at] = "applied"
    state = {tuple(b[:3]): b[3] for b in base}
    for scope, stack in stacks.items():
        for at in stack:
            for p in sorted(p for p in patches if p[0] == scope and p[1] == at):
                if (scope, *p[2:4]) in state:
                    state[(scope, *p[2:4])] = p[5]
    return status, state


def test_random_logs(spark):
    chance = random.Random(9)
    base = [(s, i, f, "base") for s in "ab" for i in range(4) for f in "xy"]
    log = [(s, at, chance.choice(["import", "import", "undo"]), f"h{chance.randrange(40)}") for s in "abc" for at in range(60)]
    patches = [(s, at, chance.randrange(6), chance.choice("xyz"), k, chance.choice(["1", "2", "3"])) for s, at, *_ in log for k in range(chance.randrange(3))]
    frames = spark.createDataFrame(base, BASE), spark.createDataFrame(log, LOG).repartition(3), spark.createDataFrame(patches, PATCH)
    for at in (0, 31, None):
        cut = [e for e in log if at is None or e[1] <= at]
        status, state = played(cut, patches, base)
        assert {(r.scope, r.item, r.field): r.value for r in overlays.state(*frames, at=at).collect()} == state
    assert {(r.scope, r.at): r.status for r in overlays.in_force(frames[1]).collect()} == status
    assert set(status.values()) >= {"applied", "undone", "undo", "already_applied"}


def test_importing_twice_is_importing_once_and_undo_restores(spark):
    base = spark.createDataFrame([("a", 1, "x", "old"), ("a", 2, "x", None)], BASE)
    patches = spark.createDataFrame([("a", at, 1, "x", 0, f"v{at}") for at in (1, 2, 3)] + [("a", 3, 2, "x", 0, "set"), ("a", 3, 9, "x", 0, "unknown")], PATCH)
    state = lambda entries: sorted((r.item, r.value) for r in overlays.state(base, spark.createDataFrame(entries, LOG), patches).select("item", "value").fillna("-").collect())
    once = [("a", 1, "import", "h")]
    assert state(once) == state(once + [("a", 2, "import", "h")]) == [(1, "v1"), (2, "-")]
    assert state(once + [("a", 3, "import", "k"), ("a", 4, "undo", None)]) == state(once)
    assert state(once + [("a", 4, "undo", None), ("a", 5, "undo", None)]) == [(1, "old"), (2, "-")]
    assert state(once + [("a", 3, "import", "k")]) == [(1, "v3"), (2, "set")]


def test_preview(spark):
    current = spark.createDataFrame([("a", 1, "x", "same"), ("a", 2, "x", None), ("a", 3, "x", "old")], BASE)
    patch = spark.createDataFrame([("a", 1, "x", 0, "same"), ("a", 2, "x", 0, None), ("a", 3, "x", 0, "mid"), ("a", 3, "x", 1, "new"), ("a", 4, "x", 0, "lost"), (None, 1, "x", 0, "q")], "scope string, item int, field string, place int, value string")
    got = sorted(map(tuple, overlays.preview(current, patch).collect()), key=repr)
    assert got == sorted([("a", 3, "x", "old", "new", "changed"), ("a", 4, "x", None, "lost", "unknown_item"), (None, 1, "x", None, "q", "unknown_item")], key=repr)


def test_no_entries(spark):
    base = spark.createDataFrame([("a", 1, "x", "old")], BASE)
    assert [tuple(r) for r in overlays.state(base, spark.createDataFrame([], LOG), spark.createDataFrame([], PATCH)).collect()] == [("a", 1, "x", "old")]


def test_patches_are_not_told_apart(spark, sf_dir):
    """Patches alike change no state; telling them apart took a table of all in each task's memory."""
    from quire.plans import regions

    plan = regions.overlay_tables(spark, sf_dir)[2]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    base, log = spark.createDataFrame([("a", 1, "x", "old")], BASE), spark.createDataFrame([("a", 1, "import", "h")], LOG)
    assert [r.value for r in overlays.state(base, log, spark.createDataFrame([("a", 1, 1, "x", 0, "v")] * 3, PATCH)).collect()] == ["v"]
