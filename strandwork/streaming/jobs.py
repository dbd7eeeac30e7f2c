"""Job life cycles and sibling-group jobs as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandwork.streaming.common import part_of

# The job states and what each event does to them; the last three absorb.
STATES = ("queued", "drafting", "stitching", "validating", "published", "failed", "cancelled")
NEXT = {"view": {"queued": "drafting", "drafting": "stitching", "stitching": "validating", "validating": "published"}}
ENDS = {"error": "failed", "click": "cancelled"}
TERMINAL = ("published", "failed", "cancelled")
JOB_OUT = "job long, seq long, state string, outcome string"


def advance(state: str, owner: int, kind: str, actor: int) -> tuple[str, str]:
    """(new state, outcome) of one job event."""
    if state in TERMINAL:
        return state, "absorbed"
    if actor != owner:
        return state, "not_owner"
    if kind in ENDS:
        return ENDS[kind], "moved"
    to = NEXT.get(kind, {}).get(state)
    return (to, "moved") if to else (state, "ignored")


def _events(held: tuple, rows) -> tuple[tuple, list]:
    """(state, owner) of a job after ``rows`` of (seq, kind, actor) in order, and (seq, state, outcome) of each."""
    at, owner = held
    out = []
    for seq, kind, actor in rows:
        owner = actor if owner < 0 else owner
        at, outcome = advance(at, owner, kind, actor)
        out.append((seq, at, outcome))
    return (at, owner), out


def _life(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("seq")
    held, out = _events(state.get if state.exists else ("queued", -1), zip(rows["seq"], rows["kind"], rows["actor"]))
    state.update((held[0], int(held[1])))
    yield pd.DataFrame([(key[0], *r) for r in out], columns=["job", "seq", "state", "outcome"])


def _life_part(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``_life`` for all jobs of a part."""
    known = json.loads(state.get[0]) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    new: dict[str | None, list] = {}
    for job, *event in zip(rows["job"], rows["seq"], rows["kind"], rows["actor"]):
        new.setdefault(job, []).append(event)
    out = []
    for job, events in new.items():
        held, told = _events(known.get(job or "", ("queued", -1)), events)
        known[job or ""] = (held[0], int(held[1]))
        out += [(int(job) if job else None, *r) for r in told]
    state.update((json.dumps(known),))
    yield pd.DataFrame(out, columns=["job", "seq", "state", "outcome"]).astype({"job": "Int64"})


def life_cycles(events: DataFrame) -> DataFrame:
    """``events(job, seq, kind, actor)`` to the state after each event; the first actor owns the job."""
    # Jobs as texts, so that a null job in a part does not turn the others into floats.
    rows = events.select(part_of("job"), F.col("job").cast("string").alias("job"), "seq", "kind", "actor")
    return rows.groupBy("part").applyInPandasWithState(_life_part, JOB_OUT, "jobs string", "append", GroupStateTimeout.NoTimeout)


GROUP_OUT = "parent long, seq long, outcome string, step int"


def _group(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    base, active, step = state.get if state.exists else (0, 0, 0)
    out = []
    for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
        if r.kind == "create":
            outcome = "stale_base" if r.base != base else "already_active" if active else "created"
            if outcome == "created":
                active, step = 1, 0
        elif not active:
            outcome = "no_active_job"
        elif r.index != step:
            outcome = "out_of_order"
        else:
            step, outcome = step + 1, "accepted"
            if step == r.size:
                base, active, outcome = base + 1, 0, "published"
        out.append((key[0], r.seq, outcome, step))
    state.update((base, active, step))
    yield pd.DataFrame(out, columns=["parent", "seq", "outcome", "step"])


def sibling_groups(events: DataFrame) -> DataFrame:
    """One active job per parent on the current base; drafts are taken in order and the last one publishes.

    ``events(parent, seq, kind, base, index, size)``; kind is create or accept.
    """
    return events.groupBy("parent").applyInPandasWithState(_group, GROUP_OUT, "base long, active int, step int", "append", GroupStateTimeout.NoTimeout)
