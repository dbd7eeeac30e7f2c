"""Outlines of documents in few passes."""

from strandwork.operators import materials as MT, order_stats as OS
from strandwork.plans import q_text


def test_outline_runs_along_one_order_once(spark, monkeypatch):
    runs, run = [], OS.running
    monkeypatch.setattr(MT, "running", lambda *a, **k: runs.append(a[1]) or run(*a, **k))
    text = ["\\section{A}", "\\begin{proof}", "in", "\\begin{lemma}", "\\end{lemma}", "\\end{proof}", "out", "\\subsection{B}", "x"]
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "root string, pos long, text string")
    got = [(x.pos, x.parent_pos, x.opened, x.environment) for x in MT.outline(rows).orderBy("pos").collect()]
    assert got == [(0, None, None, None), (1, 0, 1, "proof"), (2, 0, 1, "proof"), (3, 0, 3, "lemma"), (4, 0, 3, "lemma"), (5, 0, 1, "proof"),
                   (6, 0, None, None), (7, 0, None, None), (8, 7, None, None)]
    assert runs == [["root"], ["root", "depth"]]


def test_lines_of_repeated_documents(spark, tmp_path):
    """Texts are not shuffled; documents that repeat meet every source and all lines of their id."""
    docs = [(1, "a\n\nb", "s"), (1, "c\n \nd\ne", "t"), (10, "x", "s"), (2, None, "s"), (None, "q", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = q_text.tex_rows(spark, str(tmp_path))
    assert "line" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("line_no", "")
    got = [(x.root, x.pos >> 32, x.pos & 0xFFFFFFFF, x.text) for x in rows.collect()]
    first = ["\\section{S1} % note", "\\subsection*{L2}", "\\begin{theorem}\\label{t1}", "\\lean{W1, V4}"]
    want = [(root, 1, n, first[n - 1]) for root in "st" for length in (3, 4) for n in range(1, length + 1)] + [("s", 10, 1, "\\chapter{C10}")]
    assert sorted(got) == sorted(want)
