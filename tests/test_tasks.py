"""What one task holds doesn't grow with the input."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tabulith.operators import cells, models, references, search, tasks
from tabulith.plans import extras, fragments, sources
from tabulith.queries import QUERIES
from tabulith.sources import html


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(100_000).select("id")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert [tasks.tasks_for(rows, each) for each in (size, size - 1, size // 10)] == [1, 2, 10]
    assert tasks.spread(rows, "id", each=size).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert tasks.spread(rows, "id", each=size // 50).rdd.getNumPartitions() == 50
    assert tasks.tasks_for(spark.createDataFrame(rows.rdd, "id long")) == 1


def test_files_of_records_have_as_many_parts_as_asked_for(spark, tmp_path):
    """each is an array of its own, and none is made in one piece."""
    rows = spark.range(5000).select(F.to_json(F.struct("id")).alias("line"))
    sources._as_files(rows, str(tmp_path / "files"), 40)
    files = [p.read_text() for p in (tmp_path / "files").rglob("*.txt")]
    assert len(files) == 40 and sorted(r["id"] for f in files for r in json.loads(f)) == list(range(5000))
    assert max(map(len, files)) < 2 * sum(map(len, files)) / 40


MIDDLE = "/root/testdata/sf0.1"


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _tables(seed: int, names: str, tagged: bool) -> list[tuple]:
    """Cells of small tables of two papers, of few values, so that contexts come again and values have several tags."""
    draw = random.Random(seed)
    tags = ["a", "b", None]
    return [(p, t, r, c, draw.choice(["x", "y", "z", None]), draw.choice(tags) if tagged else None) for p in (1, 2) for t in names for r in range(draw.randint(1, 4)) for c in range(draw.randint(1, 3))]


def _contexts(rows: list[tuple], table: tuple) -> dict[tuple, list]:
    """(row, col) to its contexts, box first."""
    at = {(r, c): v for p, t, r, c, v, _ in rows if (p, t) == table}
    lines = {r: sorted(c for q, c in at if q == r) for r, _ in at}
    columns = {c: sorted(r for r, q in at if q == c) for _, c in at}

    def beside(r, c):
        i = lines[r].index(c)
        return tuple(at[r, lines[r][k]] if 0 <= k < len(lines[r]) else "" for k in (i - 1, i, i + 1))

    def near(r, c, step):
        i = columns[c].index(r) + step
        return columns[c][i] if 0 <= i < len(columns[c]) else None

    out = {}
    for r, c in at:
        above, below = near(r, c, -1), near(r, c, 1)
        box = tuple(beside(q, c) if q is not None else ("", "", "") for q in (above, r, below))
        down = tuple(at[q, c] if q is not None else "" for q in (above, r, below))
        out[r, c] = [("box", box), ("row", beside(r, c)), ("col", down), ("own", at[r, c])]
    return out


def _single(old: list[tuple], table: tuple) -> dict:
    found = {}
    where = _contexts(old, table)
    for p, t, r, c, _, tag in old:
        if (p, t) == table:
            for context in where[r, c]:
                found.setdefault(context, set()).update([tag] if tag is not None else [])
    return {k: min(v) for k, v in found.items() if len(v) == 1}


CELLS = "paper_id int, table_name string, row int, col int, value string, tag string"


@pytest.mark.parametrize("seed", range(3))
def test_transfer_and_matches_by_brute_force(spark, seed):
    old, new = _tables(seed, "ABC", True), _tables(seed + 50, "ABC", False)
    a, b = spark.createDataFrame(old, CELLS), spark.createDataFrame(new, CELLS)
    wanted, pairs = {}, {}
    for table in {x[:2] for x in new}:
        asked, single = _contexts(new, table), _single(old, table)
        for (r, c), contexts in asked.items():
            wanted[(*table, r, c)] = next((single[k] for k in contexts if k in single), "reannotate")
        best = min((-sum(any(k in one for k in contexts) for contexts in asked.values()), o) for o in "ABC" for one in [_single(old, (table[0], o))])
        if -best[0] > len(asked) / 2:
            pairs[table] = (best[1], -best[0])
    assert {tuple(x)[:4]: x["tag"] for x in cells.transfer(a, b.drop("tag"), ["paper_id", "table_name"]).collect()} == wanted
    assert {(x["paper_id"], x["table_name"]): (x["old_name"], x["hits"]) for x in cells.match_tables(a, b.drop("tag")).collect()} == pairs


@pytest.mark.parametrize("name", ["tb27_transfer"])
def test_cells_of_a_table_move_once(spark, name):
    """no join by wide contexts; nothing moves but lines of orders."""
    plan = _plan(QUERIES[name](spark, MIDDLE))
    assert "Join" not in plan and plan.count("Exchange") == plan.count("Exchange hashpartitioning(l_orderkey")


def test_pairs_of_tables_are_counted_where_their_paper_is(spark):
    """no context is made for values of one tag, and pairs never move."""
    plan = _plan(QUERIES["tb28_match_tables"](spark, MIDDLE))
    assert "row_context" not in plan and plan.count("Exchange") == plan.count("Exchange hashpartitioning(paper_id")


def _shape(node) -> tuple | str:
    return node if isinstance(node, str) else (node.name, node.attrs, [_shape(c) for c in node.children])


@pytest.mark.parametrize("page", [fragments.FIXTURE, fragments.SECTIONS, extras._PAGE, "a<TD Class=x y>&lt;b</td ><p>c<p id='1'>d&e</q>", "<p>a < b<i>c</i>", "<p class=\x0bx>", "<br/>a<!-- b -->", "<script>1<p></script>d", '<p id="a>b">c', "a</p x>b", "", "&am"])
def test_plain_pages_are_read_as_others(page):
    """one pass over plain tags, with the same tree."""
    slow, fast = html._Tree(), html._Tree()
    slow.feed(page)
    slow.close()
    assert _shape(html.parse(page)) == _shape(slow.root)
    if html._plain(page, fast):
        assert _shape(fast.root) == _shape(slow.root)
    assert html._plain(fragments.FIXTURE, html._Tree())


PAGES = ["tb1_html_tables", "tb11_grid", "tx14_toc", "tb2_markup", "tx13_sections"]


@pytest.mark.parametrize("name", PAGES)
def test_papers_are_made_in_many_tasks(spark, name):
    """a file of orders is one split, but its papers are many tasks' work; cells of a paper move once."""
    plan = _plan(QUERIES[name](spark, MIDDLE))
    assert "Exchange hashpartitioning(o_orderkey" in plan
    assert plan.count("Exchange") == 1 + plan.count("Exchange hashpartitioning(paper_id") <= 2


RESULTS = ["ud6_explanations", "ud8_flagship"]


@pytest.mark.parametrize("name", RESULTS)
def test_proposals_stay_where_their_paper_is(spark, name):
    """only queries of different texts are linked, and nothing wide moves."""
    plan = _plan(QUERIES[name](spark, MIDDLE))
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(paper_id") == 2


@pytest.mark.parametrize("name, keys", [("rf4_lookup", {"ref_str", "uid"})])
def test_a_lead_that_all_strings_share_gathers_nowhere(spark, name, keys):
    """the known leads go to the strings."""
    plan = _plan(QUERIES[name](spark, MIDDLE))
    assert "SortMergeJoin" not in plan and set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == keys


def test_many_known_leads_are_shuffled_with_the_same_result(spark, monkeypatch):
    strings = spark.createDataFrame([("J. Doe. A very long title here. 3",), ("J. Doe. Word. 4",), ("nothing",), ("J. Doe. Word. 4",)], "ref_str string")
    known = spark.createDataFrame([("a-very-long-title",), ("a-very-long-title-here",), ("word",), ("doe",)], "uid string")
    few = sorted(map(tuple, references.lookup(strings, known).collect()))
    monkeypatch.setattr(references, "BROADCAST_CHARACTERS", 0)
    assert few == sorted(map(tuple, references.lookup(strings, known).collect())) == [("J. Doe. A very long title here. 3", "a-very-long-title-here"), ("J. Doe. Word. 4", "word")]


@pytest.mark.parametrize("name, key", [("rf2_tei", "p_partkey"), ("ag2_eval_axes", "paper"), ("j9_mention_join", "l_orderkey")])
def test_rows_are_spread_by_key(spark, name, key):
    """a file of one split is the work of many tasks, and what is together by key moves once."""
    plan = _plan(QUERIES[name](spark, MIDDLE))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan).count(key) == 1 and "REPARTITION_BY_NUM" in plan


def test_only_documents_that_are_asked_for_are_scored(spark):
    """the search within a paper; how frequent words are is still that of all documents."""
    docs = spark.createDataFrame([(i, f"word{i % 3} common common{i % 2}", f"s{i % 4}") for i in range(40)], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "common word1"), (2, "common1 word2 unknown")], "query_id long, text string")
    rounded = lambda rows: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in rows.collect())
    every = search.bm25(asked, docs).join(docs.where("source = 's1'"), "doc_id", "left_semi")
    assert rounded(search.bm25(asked, docs, within=F.col("source") == "s1")) == rounded(every) != []


def test_terms_are_hashed_once(spark):
    """a vector of all features is made for a term, not for a term of a text."""
    rows = spark.createDataFrame([(i, f"good{i % 4} same words", i % 2) for i in range(40)], "doc_id long, text string, label int")
    found = models.contributions(models.nbsvm(rows, features=64), rows, "doc_id")
    assert "array_position" not in _plan(found)
    assert {r["doc_id"] for r in found.collect()} == set(range(40))


GRIDS = ["w12_unique_model", "tb25_boxes", "w6_neighbourhood", "w9_preceding_annotations", "ml7_layout_features", "tb23_round_trip"]


@pytest.mark.parametrize("name", GRIDS)
def test_lines_of_a_table_come_together_once(spark, name):
    """in as many tasks as they need; all windows of a table are where its lines are."""
    plan = _plan(QUERIES[name](spark, MIDDLE))
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
