"""Checkpoints, bucketed snapshots and streams against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from brightweir import state_queries
from brightweir.operators import buckets, checkpoints, versions
from brightweir.streaming import folder

EVENT = "source string, seq long, kind string, page int, ids array<string>, total long, has_next boolean, outcomes map<string,string>"


class Brute:
    """One source, one event after another."""

    def __init__(self):
        self.page, self.total, self.ended, self.found, self.captured, self.outcomes, self.fault = 1, None, False, {}, set(), {}, None

    def take(self, e):
        _, seq, kind, page, ids, total, has_next, outcomes = e
        ids, outcomes, has_next = ids or [], outcomes or {}, bool(has_next)
        new = [i for i in dict.fromkeys(ids) if i not in self.found]
        bad = not ids or len(ids) != len(set(ids)) or any(i == "" for i in ids)
        done = self.ended and len(self.outcomes) == len(self.found)
        if kind == "discover":
            if self.ended or page != self.page or bad:
                return "page"
            if has_next and not new:
                return "no_progress"
            if total is not None and total < len(self.found) + len(new):
                return "total_too_small"
            if None not in (total, self.total) and total != self.total:
                return "total_changed"
            known = self.total if total is None else total
            if not has_next and known is not None and known != len(self.found) + len(new):
                return "ended_before_total"
            self.total, self.page, self.ended = known, self.page + 1, not has_next
            self.found |= dict.fromkeys(new, seq)
        elif kind == "amend":
            if self.ended or page != self.page - 1 or not has_next or bad or not new or total != self.total:
                return "amendment"
            if self.total is not None and self.total < len(self.found) + len(new):
                return "total_too_small"
            self.found |= dict.fromkeys(new, seq)
        elif kind == "capture":
            if not ids or len(ids) != len(set(ids)) or set(ids) - set(self.found) or set(ids) & self.captured:
                return "capture"
            self.captured |= set(ids)
        elif kind in ("decide", "reclaim", "redecide"):
            if kind != "redecide" and not outcomes:
                return "no_outcomes"
            if kind == "decide" and (set(outcomes) - set(self.found) or set(outcomes) & set(self.outcomes)):
                return "identity"
            if kind == "reclaim" and any(i not in self.captured or self.outcomes.get(i) != "failed" for i in outcomes):
                return "identity"
            if kind == "redecide" and (not done or set(outcomes) != set(self.found)):
                return "incomplete"
            if set(outcomes.values()) - set(checkpoints.OUTCOMES) or (kind == "reclaim" and set(outcomes.values()) - {"review", "closed"}):
                return "outcome"
            if kind != "reclaim" and any(o != "failed" and i not in self.captured for i, o in outcomes.items()):
                return "not_captured"
            self.outcomes |= outcomes
        else:
            return "unknown_kind"
        return None


def random_events(seed):
    r, rows = random.Random(seed), []
    for s in range(60):
        state, seq = Brute(), 0
        fate = r.choice([None, None, 9, 12])
        total = r.choice([None, 12])
        while seq < 14 and state.fault is None:
            open_ids = [i for i in state.found if i not in state.captured]
            free = [i for i in state.found if i not in state.outcomes]
            lost = [i for i in state.captured if state.outcomes.get(i) == "failed"]
            some = lambda xs: r.sample(xs, r.randint(1, len(xs))) if xs else []
            kind = r.choice(["discover", "discover", "capture", "decide", "amend", "reclaim", "redecide"])
            last = len(state.found) >= 8
            fresh = [f"i{len(state.found) + j}" for j in range(4)]
            e = {
                "discover": (state.page, fresh + some(list(state.found))[:1], total, not (last and len(state.found) + 4 == 12), None),
                "amend": (state.page - 1, [*fresh[:1]], state.total, True, None),
                "capture": (None, some(open_ids), None, None, None),
                "decide": (None, None, None, None, {i: r.choice(checkpoints.OUTCOMES[:4]) if i in state.captured and r.random() < 0.7 else "failed" for i in some(free)}),
                "reclaim": (None, None, None, None, {i: r.choice(["review", "closed"]) for i in some(lost)}),
                "redecide": (None, None, None, None, {i: "failed" for i in state.found}),
            }[kind]
            if fate == seq:  # something that may well be wrong
                e = r.choice([(99, fresh, total, True, None), (state.page, [*fresh, fresh[0]], total, True, None), (state.page, [""], None, True, None), (state.page, list(state.found)[:2], total, True, None), (None, ["nobody"], None, None, {"nobody": "failed"}), (None, None, None, None, {i: "odd" for i in state.found})])
                kind = r.choice([kind, "other"])
            row = (f"s{s}", seq, kind, *e)
            refused = state.take(row)
            if refused and fate != seq and r.random() < 0.9:
                continue  # only some of the refused ones stay
            rows.append(row)
            seq += 1
            state.fault = refused
        rows += [(f"s{s}", seq + 5, "capture", None, ["i0"], None, None, None)] if state.fault else []
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_checkpoints_are_as_one_event_after_another(spark, seed):
    rows = random_events(seed)
    events = spark.createDataFrame(rows, EVENT).repartition(5)
    want, faults, ids = {}, set(), {}
    for row in sorted(rows, key=lambda x: (x[0], x[1])):
        state = want.setdefault(row[0], Brute())
        if state.fault is None:
            state.fault = state.take(row)
            faults.add(state.fault)
    got = {r.source: r for r in checkpoints.summary(events).collect()}
    for s, b in want.items():
        assert (got[s].fault, got[s].next_page, got[s].total, got[s].discovered) == (b.fault, b.page, b.total, b.ended), (s, b.fault)
        done = b.ended and len(b.outcomes) == len(b.found)
        assert (got[s].found, got[s].captured, got[s].decided, got[s].complete) == (len(b.found), len(b.captured), len(b.outcomes), done)
        ids |= {(s, i): (at, i in b.captured, b.outcomes.get(i)) for i, at in b.found.items()}
    assert {(r.source, r.id): (r.found_at, r.captured, r.outcome) for r in checkpoints.identities(events).collect()} == ids
    assert len(faults) >= 5 and any(r.complete for r in got.values()) and checkpoints.summary(events.limit(0)).count() == 0


def test_checkpoint_versions(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    events = spark.createDataFrame([("a", 0, "discover", 1, ["x", "y"], 2, False, None), ("a", 1, "capture", None, ["x"], None, None, None), ("a", 2, "decide", None, None, None, None, {"x": "accepted"})], EVENT)
    assert checkpoints.load(spark, root) is None
    assert (checkpoints.save(events.where("seq < 2"), root), checkpoints.save(events, root)) == (0, 1)
    assert {r.id: r.outcome for r in checkpoints.load(spark, root).collect()} == {"x": "accepted", "y": None}
    assert versions.publish(events, root, 1) is False and versions.latest(spark, root) == 1
    versions.publish(checkpoints.identities(events).withColumn("outcome", F.lit("good")), root, 2)
    with pytest.raises(ValueError, match="changed"):
        checkpoints.load(spark, root)


def test_buckets_rewrite_what_changed(spark, tmp_path):
    root, r = f"file://{tmp_path}/snapshot", random.Random(7)
    have, gone, at = {}, {}, {}
    for version in range(5):
        now = datetime.datetime(2026, 1, 1 + version)
        if version == 0:
            run = {i: f"v{i}" for i in range(300)}
        else:
            run = {i: v for i, v in (have | {x: f"back{x}" for x in list(gone)[:2]}).items() if i not in gone or r.random() < 0.3}
            for i in r.sample(sorted(run), 3):
                run[i] = f"{run[i]}!"
            for i in r.sample(sorted(run), 2):
                del run[i]
            run[1000 + version] = None
        rows = [(i, v) for i, v in run.items()] + [(None, "no key"), (next(iter(run)), run[next(iter(run))])]
        out = buckets.upsert(spark.createDataFrame(rows, "k long, v string"), root, version, "k", ["v"], F.lit(now))
        counts = {}
        for x in out.collect():
            counts[x.outcome] = counts.get(x.outcome, 0) + x.n
        new = {i for i in run if i not in have and i not in gone}
        back = {i for i in run if i in gone}
        changed = {i for i in run if i in have and have[i] != run[i]}
        lost = set(have) - set(run)
        assert (counts.get("inserted", 0), counts.get("reactivated", 0), counts.get("updated", 0), counts.get("inactive", 0)) == (len(new), len(back), len(changed), len(lost))
        gone = {i: v for i, v in (gone | {i: have[i] for i in lost}).items() if i not in run}
        have = run
        at |= dict.fromkeys(new | back | changed | lost, now)
        got = {x.k: x for x in buckets.read(spark, root, "k bigint, v string").collect()}
        assert {i: x.v for i, x in got.items() if x.inactive_at is None} == have and {i: x.v for i, x in got.items() if x.inactive_at} == gone
        assert {i: x.updated_at for i, x in got.items()} == {i: at[i] for i in got}
        held = [x.held for x in buckets.manifest(spark, root).collect()]
        assert version == 0 or 0 < sum(h == version for h in held) < len(held) / 2
    assert buckets.upsert(spark.createDataFrame([(1, "x")], "k long, v string"), root, 4, "k", ["v"], F.current_timestamp()).count() == 0
    same = spark.createDataFrame(list(have.items()), "k long, v string")
    assert buckets.upsert(same, root, 5, "k", ["v"], F.current_timestamp()).count() == 0  # no bucket differs


def test_a_followed_folder_that_dies_ends_in_the_same_table(spark, tmp_path):
    docs = [("s", str(i % 40), f"t{i}", "b" * (i % 5), datetime.datetime(2026, 1, 1, i % 24, i % 60)) for i in range(200)] + [(None, "x", "no", "", None)]
    tables = []
    for dies in (None, 1, 2):
        raw, root, state = (f"file://{tmp_path}/{n}{dies}" for n in ("raw", "snap", "state"))
        for part in range(4):
            spark.createDataFrame(docs[part::4], folder.DOCUMENT).coalesce(1).write.mode("append").json(raw)

        def each(batch, number, at, dies=dies):
            if number == dies:
                raise RuntimeError("lost before the batch")
            folder.apply(batch, number, at)
            if dies is not None and number == dies - 1:
                raise RuntimeError("lost after the batch, before it was noted")

        if dies is not None:
            with pytest.raises(Exception, match="lost"):
                folder.follow(spark, raw, root, state, files_a_batch=1, each=each)
        folder.follow(spark, raw, root, state, files_a_batch=1)
        folder.follow(spark, raw, root, state)
        tables.append(sorted(map(str, buckets.read(spark, root, folder.SNAPSHOT).select("identity", "title", "body", "collected_at").collect())))
    last = {}
    for s, i, t, b, at in docs[:-1]:
        last[i] = max(last.get(i, (datetime.datetime.min, "", "")), (at, t, b))
    assert len(tables[0]) == len(last) == 40 and tables[0] == tables[1] == tables[2]
    assert all(any(repr(t) in row for row in tables[0]) for _, t, _ in last.values())


def test_what_an_event_names_is_shuffled_once(spark):
    rows = [("a", 0, "discover", 1, ["x", "y", "x"], None, True, None), ("a", 1, "discover", 2, ["z"], None, False, None), (None, 0, "discover", 1, ["x"], None, False, None)]
    named = checkpoints._named(spark.createDataFrame(rows, EVENT))
    plan = named._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and sorted((r.id, r.found) for r in named.where("source = 'a'").collect()) == [("x", False), ("y", False), ("z", False)]
    got = {r.source: (r.next_page, r.found, r.discovered, r.fault, r.fault_at) for r in checkpoints.summary(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"a": (1, 0, False, "page", 0), None: (1, 0, False, None, None)}


def test_events_of_a_source_that_are_together_are_shuffled_no_more(spark):
    rows = random_events(4) + random_events(5) + [(None, 0, "discover", 1, ["x"], None, True, None), ("b", 0, "discover", 1, [None, "x"], None, True, None), ("d", 0, "discover", 1, ["x"], 1, False, None), ("d", 1, "redecide", None, None, None, None, None)]
    once = list({(r[0], r[1]): r for r in rows}.values())
    events = spark.createDataFrame(once, EVENT)
    told = lambda df: sorted(map(str, df.collect()))
    assert told(checkpoints.summary(events.repartition(5, "source"), together=True)) == told(checkpoints.summary(events))
    plan = checkpoints._judged_together(events.repartition(5, "source"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # before, a row for each identity was shuffled twice, and the events too


def test_checkpoint_fold_keeps_small_customers_together_and_others_apart(spark, monkeypatch):
    asked, whole = [], checkpoints.summary
    monkeypatch.setattr(checkpoints, "summary", lambda events, **how: asked.append(how) or whole(events, **how))
    rows = []
    for most in (state_queries.TOGETHER, 0):
        monkeypatch.setattr(state_queries, "TOGETHER", most)
        rows.append(sorted(map(str, state_queries.checkpoint_fold(spark, "/root/testdata/sf0.001").collect())))
    assert rows[0] == rows[1] and rows[0] and asked == [{"together": True}, {"together": False}]
