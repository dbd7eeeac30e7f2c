"""State machines see many keys in one call, with the results of one key a call."""

import pandas as pd

from strandwork.streaming import appends, jobs
from strandwork.streaming.common import drain
from tests.test_text_and_streams import HeldState

def each(rule, columns, rows):
    """What the rule for one key says, batch after batch."""
    states, out = {}, []
    for batch in rows:
        for key in dict.fromkeys(r[0] for r in batch):
            told = list(rule((key,), iter([pd.DataFrame([r for r in batch if r[0] == key], columns=columns)]), states.setdefault(key, HeldState())))
            out += [tuple(x if isinstance(x, str) else int(x) for x in r) for t in told for r in t.itertuples(index=False)]
    return sorted(map(str, out))

def together(rule, columns, rows):
    state, out = HeldState(), []
    for batch in rows:
        told = list(rule((0,), iter([pd.DataFrame([(str(r[0]), *r[1:]) for r in batch], columns=columns)]), state))
        out += [tuple(x if isinstance(x, str) else int(x) for x in r) for t in told for r in t.itertuples(index=False)]
    return sorted(map(str, out))

def test_files_of_a_part():
    cols = ["file", "chunk_index", "chunk_count"]
    batches = [[(1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2)], [(1, 2, 2), (3, 2, 2), (2, 1, 1), (4, 1, 3)], [(4, 2, 3), (4, 3, 2), (1, 3, 2)]]
    got = together(appends._gather_part, cols, batches)
    assert got == each(appends._gather, cols, batches) and len(got) == 4

def test_jobs_of_a_part():
    cols = ["job", "seq", "kind", "actor"]
    batches = [[(1, 3, "view", 5), (2, 1, "view", 6), (1, 2, "view", 5)], [(1, 4, "view", 6), (2, 5, "error", 6), (3, 6, "click", -2)], [(2, 7, "view", 6), (1, 8, "click", 5)]]
    got = together(jobs._life_part, cols, batches)
    assert got == each(jobs._life, cols, batches) and len(got) == 8

def test_streams_of_many_keys(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.range(400).selectExpr("id % 200 AS file", "id div 200 + 1 AS chunk_index", "IF(id % 200 < 5, NULL, 2L) AS chunk_count").unionByName(
        spark.sql("SELECT NULL AS file, 1L AS chunk_index, 1L AS chunk_count")).coalesce(1).write.parquet(inbox)

    rows = drain(appends.complete_files(spark.readStream.schema("file long, chunk_index long, chunk_count long").parquet(inbox)), "files").collect()
    assert sorted(str(r.file) for r in rows) == sorted([*map(str, range(5, 200)), "None"]) and {r.status for r in rows} == {"complete"}
