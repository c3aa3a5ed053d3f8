import random
from datetime import datetime, timedelta

import pytest
from loomgraph.streaming import consoles as S

BEGIN = datetime(2024, 1, 1)


def by_hand(rows, idle):
    """State of each graph in a loop."""
    out, state = [], {}
    for g, at, seq, kind, oper, entity, src, dst, console in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        held, number, last = state.get(g, (None, 0, None))
        if last is not None and (at - last).total_seconds() > idle:
            held, number = None, 0
        if kind == "console" and console is not None:
            held = console
        if kind in S.KINDS and oper == "ADD" and not (src is not None and src == dst) and held is not None:
            number += 1
            out.append((g, seq, held, number))
        state[g] = held, number, at
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    out, at = [], BEGIN
    for i in range(400):
        at += timedelta(seconds=random.choice([0, 1, 1, 2, 30]))
        kind = random.choice(["console", "knode", "knode", "kedge", "kedge", "other", None])
        src, dst = (random.randrange(3), random.choice([0, 1, 2, None])) if kind == "kedge" else (None, None)
        out.append((random.choice([1, 1, 1, 2, 3, None]), at, i, kind, random.choice(["ADD", "ADD", "DELETE", None]), i % 9, src, dst, random.choice([i, None]) if kind == "console" else None))
    return [*out, (1, None, 1000, "knode", "ADD", 1, None, None, None)]


def test_table_equals_a_loop(spark, rows):
    for idle in (5, 40, 10_000):
        got = S.console_messages(spark.createDataFrame(rows, S.FEED), idle).collect()
        assert sorted((r["kgraph_id"], r["seq"], r["console"], r["number"]) for r in got) == by_hand(rows, idle)
    assert S.console_messages(spark.createDataFrame([], S.FEED), 5).collect() == []


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_the_table(spark, rows, tmp_path, batches):
    """Whatever the micro-batches, and whether a timer or a row ends a graph's idle time; state that the timers cleared is gone."""
    feed = spark.createDataFrame(rows, S.FEED)
    got = S.replay(feed, str(tmp_path), 40, batches)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, S.console_messages(feed, 40).collect())))
