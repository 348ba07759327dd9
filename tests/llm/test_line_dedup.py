import duckdb
import pytest

from blockloom.llm.line_dedup import line_dedup
from blockloom.llm.queries import OP4_SQL


def brute(rows, ratio, least):
    hosts = {}
    for r in rows:
        if r.source is not None:
            hosts.setdefault(r.source, []).append({x.strip(" ") for x in (r.text or "").split("\n")} - {""})
    out = []
    for r in rows:
        pages = hosts.get(r.source, [])
        lines = r.text.split("\n") if r.text is not None else []
        n = [sum(x.strip(" ") in p for p in pages) for x in lines]
        kept = [x for x, k in zip(lines, n, strict=True) if not (k >= least and k > ratio * len(pages) and x.strip(" "))]
        out.append((r.doc_id, None if r.text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines", [0, 1000])
@pytest.mark.parametrize(("ratio", "least"), [(0.1, 1), (0.1, 2), (0.3, 1), (0.1, 100)])
def test_against_brute_force(spark, clashing, monkeypatch, lines, ratio, least):
    monkeypatch.setattr("blockloom.llm.line_dedup.BROADCAST_HOSTS", lines)
    got = line_dedup(clashing, ratio=ratio, min_pages=least, broadcast_lines=lines, counts=("before", "cut"))
    assert got.columns == [*clashing.columns, "before", "cut"]
    rows = [(r.doc_id, r.text, r.before, r.cut) for r in got.collect()]
    assert sorted(rows, key=str) == brute(clashing.collect(), ratio, least)


def test_empty_table(spark, empty):
    assert line_dedup(empty).collect() == [] and line_dedup(empty).columns == empty.columns


def test_no_python_in_the_plan(spark, docs):
    plan = line_dedup(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sql_form(spark):
    rows = [(i, f"own {i}\n shared \n\n", "h") for i in range(20)] + [(20, None, "h"), (21, "shared", None), (22, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text, r.a, r.b) for r in line_dedup(df, counts=("a", "b")).where("text is not null").collect())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    import hashlib

    want = sorted(con.execute(f"select doc_id, kept_md5, n_lines, n_dropped from ({OP4_SQL}) where kept_md5 is not null").fetchall())
    assert [(i, hashlib.md5(t.encode()).hexdigest(), a, b) for i, t, a, b in got] == want
    assert got[0][3] == 1
