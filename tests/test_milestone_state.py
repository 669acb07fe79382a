"""R11a kept as state: equal to the recomputed milestones after any batches."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import milestone_state as S
from ledgerlens.plans import base as B
from ledgerlens.registry import QUERIES
from tests.star import TS, star

TABLES = ("document_status_history", "delivery_challans", "users")


def _history(seed, n=160):
    r = random.Random(seed)
    ch = [{"id": i, "related_invoice_voucher_id": r.choice([None, *range(1, 13)])} for i in range(1, 31)]
    users = [{"id": i, "full_name": None if i == 4 else f"U{i % 3}"} for i in range(1, 7)]
    ev = [{"document_id": r.choice([None, 99, *range(1, 31)]), "new_status": r.choice(["packed", "Shipped", "in_transit", "DELIVERED", "odd", None]),
           "changed_at": None if r.random() < 0.15 else TS(2024, 3, 1, r.randint(0, 5)), "changed_by": r.choice([None, 7, *range(1, 7)])} for _ in range(n)]
    return {"document_status_history": ev, "delivery_challans": ch, "users": users}


def _batches(data, seed, k):
    """The rows of all tables dealt at random over ``k`` batches, some without a table's rows."""
    r = random.Random(seed)
    out = [{t: [] for t in TABLES} for _ in range(k)]
    for t in TABLES:
        for row in data[t]:
            out[r.randrange(k)][t].append(row)
    return [{t: rows for t, rows in b.items() if rows} for b in out]


def _rows(df):
    return sorted(df.select("voucher_id", "packed_at", "shipped_at", "delivered_at", "delivered_by", "shipped_by", "delivery_person").collect(), key=str)


def _frames(spark, part):
    t = star(spark, **part)
    return {k: getattr(t, k) for k in part}


@pytest.fixture
def table(spark):
    made = []

    def name():
        made.append(f"milestones_{uuid.uuid4().hex[:8]}")
        return made[-1]

    yield name
    for m in made:
        spark.sql(f"DROP TABLE IF EXISTS {m}")


@pytest.mark.parametrize("seed", [1, 2])
def test_state_follows_every_batch(spark, table, tmp_path, seed):
    data = _history(seed)
    batches, name, so_far = _batches(data, seed, 4), table(), {t: [] for t in TABLES}
    S.create(star(spark, **so_far), name, str(tmp_path / "state"), buckets=3)
    for k, batch in enumerate(batches):
        so_far = {t: so_far[t] + batch.get(t, []) for t in TABLES}
        t = star(spark, **so_far)
        S.append(t, _frames(spark, batch), name, buckets=3)
        if k == 1:  # a batch that runs twice
            S.append(t, _frames(spark, batch), name, buckets=3)
        assert _rows(S.stored(spark, name)) == _rows(B.milestones(t))
    compacted = table()
    S.compact(spark, name, compacted, str(tmp_path / "compacted"), buckets=3)
    assert spark.table(compacted).count() == spark.table(compacted).select("voucher_id").distinct().count()
    assert _rows(S.stored(spark, compacted)) == _rows(B.milestones(star(spark, **data)))


def test_merge_needs_no_exchange(spark, table, tmp_path):
    data, name = _history(5), table()
    t = star(spark, **data)
    S.create(t, name, str(tmp_path / "state"), buckets=3)
    S.append(t, _frames(spark, {"users": data["users"][:1]}), name, buckets=3)
    plan = S.stored(spark, name)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_new_events_leave_the_history_unread(spark):
    data = _history(6)
    t, new = star(spark, **data), _frames(spark, {"document_status_history": data["document_status_history"][:3]})
    gone = t.document_status_history.withColumn("changed_at", F.raise_error(F.lit("read")).cast("timestamp"))
    t.document_status_history = gone
    S.state_of_added(t, new).collect()


def test_nothing_new(spark, table, tmp_path):
    t, name = star(spark, **_history(7)), table()
    S.create(t, name, str(tmp_path / "state"), buckets=2)
    n = spark.table(name).count()
    S.append(t, {}, name, buckets=2)
    S.append(t, {"document_status_history": t.document_status_history.limit(0)}, name, buckets=2)
    assert spark.table(name).count() == n
    with pytest.raises(ValueError, match="vouchers"):
        S.state_of_added(t, {"vouchers": t.vouchers})


def test_registered_query_equals_one_pass(spark):
    sf = "/root/testdata/sf0.001"
    assert _rows(QUERIES["r11a_milestones_by_year"](spark, sf)) == _rows(QUERIES["r11a_milestones"](spark, sf))


def test_batches_do_not_share_a_task(spark):
    """The states of all years lie alike; united partition by partition, one task would sort them all."""
    plan = QUERIES["r11a_milestones_by_year"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(voucher_id" in plan[:plan.index("Union")]
    assert "LeftSemi" not in plan  # and a batch's events meet the challans in one join
