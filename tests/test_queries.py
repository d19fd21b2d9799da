"""Every registered query against its SQL on the smallest data; those without SQL against brute force."""

import re
from difflib import SequenceMatcher

import pytest
from compare import connect, of_spark, of_sql

from ledgerloom.queries import oracle_sql, queries
from ledgerloom.sources.dimensions import aliases


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(name, spark, sf_dir, con):
    df = queries()[name](spark, sf_dir)
    got = of_spark(df)
    assert got == of_sql(con, oracle_sql()[name], df.columns)
    assert got


def packed(parts, limit):
    out = []
    for p in parts:
        if out and len(out[-1]) + len(p) <= limit:
            out[-1] += p
        else:
            out.append(p)
    return out


@pytest.mark.parametrize("name, line, boundary", [("note_chunks", "\nNote 7. ", r"(?=\n\s*Note\s+\d+)"), ("prose_chunks", "\n\n", r"(?=\n\n)")])
def test_chunks(name, line, boundary, spark, sf_dir, con):
    got = {}
    for r in queries()[name](spark, sf_dir).orderBy("pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for doc_id, text in con.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        full = text.replace("\n", line)
        want = [full] if len(full) <= 2000 else packed([p for p in re.split(boundary, full) if p], 2000)
        assert got[doc_id] == want
        assert "".join(got[doc_id]) == full


def test_fuzzy_matches_are_the_best_there_are(spark, sf_dir):
    known = aliases()
    exact = dict(known)
    rows = queries()["taxonomy_fuzzy"](spark, sf_dir).collect()
    assert {r.method for r in rows} == {"exact", "fuzzy", "none"}
    for r in rows:
        if r.label_key in exact:
            assert (r.canonical, r.method) == (exact[r.label_key], "exact")
            continue
        scores = [SequenceMatcher(None, r.label_key, a).ratio() for a, _ in known]
        best = max(scores)
        assert r.method == ("fuzzy" if best >= 0.85 else "none")
        if best >= 0.85:
            assert r.canonical == known[scores.index(best)][1]
            assert abs(r.confidence - best) < 1e-6


def test_rendered_facts(spark, sf_dir):
    long = {}
    for r in queries()["facts_statement"](spark, sf_dir).collect():
        long.setdefault((r.filer, r.statement), {}).setdefault(r.canonical, {})[r.period_end] = r.value
    for r in queries()["facts_markdown"](spark, sf_dir).collect():
        head, _, *body = r.markdown.split("\n")
        periods = head.strip("| ").split(" | ")
        items = long[r.filer, r.statement]
        assert periods == sorted({p for v in items.values() for p in v})
        assert len(body) == len(items)
        for line in body:
            name, *cells = line[2:-2].split(" | ")
            values = [items[name][p] for p in periods]
            assert cells == ["—" if v is None else f"{v:,.0f}" if v == int(v) else f"{v:,.2f}" for v in values]


def test_documents_of_all_reports(spark, sf_dir, con):
    rows = queries()["report_documents"](spark, sf_dir).collect()
    assert sorted(int(r.filing_id) for r in rows) == sorted(x for (x,) in con.execute("SELECT o_orderkey FROM orders").fetchall())
    bare = {x for (x,) in con.execute("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)").fetchall()}
    assert bare
    for r in rows:
        k = int(r.filing_id)
        if k % 9 == 0:
            assert r.content.startswith(f"# {r.filing_id}\n") and "## Consolidated Balance Sheet\n" in r.content
            continue
        assert r.content.startswith("---\ncompany: Holdings ")
        # an order without lines is a sheet of dashes: nothing to check, and no source
        assert ("## Validation\n\n| Check | Status | Detail |" in r.content) == (k not in bare)
        assert f"\n| balance_sheet | {'none' if k in bare else 'pdf'} | " in r.content
