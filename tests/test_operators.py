"""Golden cases and invariants of the operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tabulith.config import Settings
from tabulith.functions import text as t
from tabulith.functions import values as v
from tabulith.operators import cells, dictionaries, evaluation, experiments, filters, linking, models, references, search, sets
from tabulith.sources import html

PLAIN = {"0-1": (0.21, 0.0021, 0.21, 0.21), "1-100": (21, 0.21, 21, 21), "abs": (0.21, 0.0021, 21, 0.21), "": (0.21, 0.21, 21, 21)}
TURNED = {"0-1": (0.79, 0.9979, 0.79, 0.79), "1-100": (79, 99.79, 79, 79), "": (0.79, 99.79, 79, 79)}
RAW = tuple(number + unit for number in ("0.21", "21") for unit in ("", "%"))


def test_metric_conversion(spark):
    cases = [(r, raw, flip, float(x)) for flip, table in ((False, PLAIN), (True, TURNED)) for r, row in table.items() for raw, x in zip(RAW, row)]
    rows = spark.createDataFrame(cases, "r string, raw string, flip boolean, want double")
    got = rows.withColumn("got", v.convert_metric(F.col("raw"), F.col("r"), F.col("flip")).cast("double"))
    assert len(cases) == 28
    assert got.where(F.abs(F.col("got") - F.col("want")) > 1e-9).count() == 0


@pytest.mark.parametrize(
    "raw, flip, want",
    [("12.3 ± 0.4", False, 12.3), ("12.3±0.4%", False, None), ("± 0.4", False, None), ("1,234.5", False, 1234.5), ("(93.1)", False, 93.1), ("0,21", False, 21.0), ("21 %", False, 21.0), ("1e-3", False, 0.001),
     ("-5%", False, -5.0), ("1", True, 0.0), ("0", True, 1.0), ("100", True, -99.0), ("150", True, -149.0), ("-", True, None)],
)
def test_metric_edges(spark, raw, flip, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(v.convert_metric(F.col("raw"), F.lit(""), flip).cast("double")).first()
    assert row[0] is None if want is None else row[0] == pytest.approx(want)


def test_format_patterns(spark):
    rows = spark.createDataFrame([("12.5 (3)", "{x} {}"), ("0.5", "{100*x}"), ("50", "{x/100}")], "raw string, f string")
    got = [rows.where(F.col("f") == f).select(v.extract_value(F.col("raw"), f).cast("double")).first()[0] for f in ("{x} {}", "{100*x}", "{x/100}")]
    assert got == pytest.approx([12.5, 50.0, 0.5])


def test_evaluation_golden(spark):
    columns = "paper string, task string, dataset string, metric string, score string"
    gold = spark.createDataFrame([("p1", "t", "d", "m", "90"), ("p1", "t", "d2", "m", "80"), ("p2", "t", "d", "m", "70")], columns)
    pred = spark.createDataFrame([("p1v2", "t", "d", "m", "90.0"), ("p2", "t", "d", "m", "71")], columns)
    got = {r["axis"]: r for r in evaluation.evaluate(pred, gold).collect()}
    want = {"TDMS": (0.5, 0.3333, 0.4, 0.5, 0.25, 0.3333), "TDM": (1, 0.6667, 0.8, 1, 0.75, 0.8333), "task": (1,) * 6, "dataset": (1, 0.6667, 0.8, 1, 0.75, 0.8333), "metric": (1,) * 6}
    for axis, values in want.items():
        r = got[axis]
        found = [r[f"{a}_{b}"] for a in ("micro", "macro") for b in ("precision", "recall", "f1")]
        assert found == pytest.approx(values, abs=5e-5), axis


def test_evaluation_counts(spark):
    random.seed(1)
    draw = lambda: [(f"p{random.randrange(4)}", f"t{random.randrange(3)}") for _ in range(30)]
    a, b = draw(), draw()
    kinds = evaluation.indicator(spark.createDataFrame(a, "paper string, task string"), spark.createDataFrame(b, "paper string, task string"), ["paper", "task"])
    n = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n.get("TP", 0) + n.get("FN", 0) == len(set(b)) and n.get("TP", 0) + n.get("FP", 0) == len(set(a))


def test_empty_evaluation(spark):
    none = spark.createDataFrame([], "paper string, task string")
    assert evaluation.scores(none, none, ["task"]).first()["micro_f1"] in (None, 0.0)


def _chain(spark, second: float):
    columns = "cell_ext_id string, task string, dataset string, metric string, confidence double, parsed double, model_type string, struct_model_type string, struct_dataset string"
    best = "model-best"
    rows = [("P/t1/1.1", 0.95, 90.0, best, best, "squad"), ("P/t1/2.1", second, 91.0, best, best, "squad"), ("P/t1/3.1", 0.79, 99.0, best, best, "squad"),
            ("P/t1/4.1", 0.99, 99.0, best, best, "squad dev"), ("P/t1/5.1", 0.99, 99.0, "", "", "squad"), ("P/t1/6.1", 0.99, 99.0, "model-competing", "model-competing", "squad")]
    df = spark.createDataFrame([(i, "t", "d", "Accuracy", c, p, m, s, d) for i, c, p, m, s, d in rows], columns)
    return {r["cell_ext_id"]: r["reason"] for r in filters.production_chain()(df).collect()}


def test_filter_chain(spark):
    assert _chain(spark, 0.9) == {
        "P/t1/1.1": "replaced by P/t1/2.1", "P/t1/2.1": None, "P/t1/3.1": "confidence 0.79 < 0.8", "P/t1/4.1": "dev-dataset",
        "P/t1/5.1": "empty-model-type", "P/t1/6.1": "model-competing",
    }
    lower = _chain(spark, 0.82)
    assert lower["P/t1/1.1"] == "replaced by P/t1/2.1" and lower["P/t1/2.1"] == "confidence 0.82 < 0.85"


def test_sweep_is_brute_force(spark):
    random.seed(5)
    levels = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    rows = [(random.choice(levels), random.choice(levels), *(random.random() < 0.5 for _ in range(3))) for _ in range(40)]
    df = spark.createDataFrame(rows, "lo double, hi double, e boolean, p boolean, g boolean")
    got = {(r["threshold1"], r["threshold2"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in evaluation.sweep(df, "lo", "hi", F.col("e"), F.col("p"), F.col("g")).collect()}
    valid = [r for r in rows if r[0] < r[1]]
    marks = sorted({x for r in valid for x in r[:2]})
    want = {}
    for t1 in marks[:-1]:
        for t2 in (x for x in marks if x >= t1):
            on = [r for r in valid if r[0] < t1 and r[1] >= t2]
            tp = sum(e and p and g for _, _, e, p, g in on)
            want[t1, t2] = (tp, sum(p and (not e or not g) for _, _, e, p, g in on), sum(e and not p and not g for _, _, e, p, g in on), sum(r[4] for r in rows) - tp)
    assert got == want


def test_find_names(spark):
    texts = spark.createDataFrame([(1, "we use image net and imagenet32 on squad"), (2, "a f1 score f1"), (3, "libri speech test clean"), (4, None), (5, "")], "text_id int, text string")
    names = spark.createDataFrame([("imagenet",), ("squad",), ("f1",), ("f1 score",), ("test",), ("test clean",)], "name string")
    got = sorted((r["text_id"], r["name"], r["n"]) for r in linking.find_names(texts, names).collect())
    assert got == [(1, "imagenet", 1), (1, "squad", 1), (2, "f1", 2), (2, "f1 score", 1), (3, "test", 1), (3, "test clean", 1)]


def test_find_names_of_any_length(spark):
    texts = ["on i m a g e n e t and imagenet", "a large scale data set of street view images", "in a large scale data set of street views"]
    names = ["imagenet", "large scale data set of street view", "large scale", "large scale data set of street views and more"]
    got = linking.find_names(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"))

    def automaton(text: str, name: str) -> int:
        """Matches in the text without spaces that begin where a word begins and end where one ends."""
        split, joined = text.split(), text.replace(" ", "")
        ends = [sum(map(len, split[: i + 1])) for i in range(len(split))]
        begins, key = {0, *ends}, name.replace(" ", "")
        return sum(joined.startswith(key, at) and at in begins and at + len(key) in ends for at in range(len(joined)))

    want = {(i, n, automaton(x, n)) for i, x in enumerate(texts) for n in names if automaton(x, n)}
    assert {(r["text_id"], r["name"], r["n"]) for r in got.collect()} == want
    assert (0, "imagenet", 2) in want and (1, "large scale data set of street view", 1) in want and len(want) == 4


def test_lookup_of_short_titles(spark):
    strings = ["J. Doe. Deep learning. Nature, 2015", "A. Bee. Attention. 2017, in Proc.", "C. Dee. Deep sea learning, 2015", "Deep learning of long titles, 2015"]
    known = spark.createDataFrame([("deep-learning",), ("attention",), ("deep-learning-of-long-titles",)], "uid string")
    got = references.lookup(spark.createDataFrame([(x,) for x in strings], "ref_str string"), known).collect()
    assert {r["ref_str"]: r["uid"] for r in got} == {strings[0]: "deep-learning", strings[1]: "attention", strings[3]: "deep-learning-of-long-titles"}


def test_bags(spark):
    bag = lambda x: spark.createDataFrame(x, "w string, n long")
    got = sets.bag_difference(bag([("f1", 2), ("squad", 1)]), bag([("f1", 1)]), ["w"], "n").collect()
    assert sorted(map(tuple, got)) == [("f1", 1), ("squad", 1)]
    assert sets.bag_difference(bag([("f1", 1)]), bag([("f1", 3)]), ["w"], "n").count() == 0


def test_softmax_sums_to_one(spark):
    rows = sets.softmax(spark.createDataFrame([("a", 1000.0), ("a", 1001.0), ("b", -5.0)], "k string, x double"), ["k"], "x", "p")
    assert all(r[0] == pytest.approx(1) for r in rows.groupBy("k").agg(F.sum("p")).select("sum(p)").collect())


def test_transfer_rules(spark):
    old = spark.createDataFrame([("p", 0, 0, "a", "x"), ("p", 0, 1, "b", "y"), ("p", 1, 0, "b", "z"), ("p", 1, 1, "c", "w")], "t string, row int, col int, value string, tag string")
    new = spark.createDataFrame([("p", 0, 0, "a"), ("p", 0, 1, "b"), ("p", 1, 0, "q")], "t string, row int, col int, value string")
    got = {(r["row"], r["col"]): r["tag"] for r in cells.transfer(old, new, ["t"]).collect()}
    assert got == {(0, 0): "x", (0, 1): "y", (1, 0): cells.REANNOTATE}


def test_table_spans(spark):
    page = '<table class="ltx_tabular"><tr><td rowspan="2" class="ltx_border_b ltx_border_t">r</td><td>1</td></tr><tr><td>2</td></tr></table>'
    built = cells.build(html.cells(spark.createDataFrame([("p", page)], "paper_id string, html string")), ["paper_id"])
    got = {(r["row"], r["col"]): (r["value"], r["layout"]) for r in built.collect()}
    assert got == {(0, 0): ("r", "border-t span-rb"), (0, 1): ("1", ""), (1, 0): ("r", "border-b span-re"), (1, 1): ("2", "")}


def test_colours():
    assert [html.colour_of(s) for s in ("color: #f00;", "color:#00ff00", "color: blue", "color:#777777", "")] == ["red", "green", "blue", None, None]


def test_floats_are_no_tables():
    inner = '<table class="ltx_tabular"><tr><td>x</td></tr></table>'
    assert not list(html.table_rows(f'<figure class="ltx_float">{inner}</figure>'))
    assert not list(html.table_rows(f'<div class="ltx_authors">{inner}</div>'))
    assert len(list(html.table_rows(f'<figure class="ltx_figure">{inner}</figure>'))) == 1


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([("a", None), ("b", ""), ("c", "<p>no article")], "paper_id string, html string")
    assert {(r["paper_id"], r["title"], r["text"]) for r in html.fragments(pages).collect()} == {(x, None, None) for x in "abc"}
    assert html.cells(pages).count() == 0


def test_phrase_slop(spark):
    frags = spark.createDataFrame([(1, "the deep net is here"), (2, "deep the net"), (3, "net deep"), (4, "")], "frag_id int, text string")
    asked = spark.createDataFrame([(1, "deep net")], "query_id int, text string")
    hits = lambda slop: sorted(r["frag_id"] for r in search.phrase_matches(asked, frags, slop).collect())
    assert hits(0) == [1] and hits(1) == [1, 2] and hits(2) == [1, 2, 3]


def test_stream_replay(spark, tmp_path):
    from tabulith.streaming import events as s

    source, path = "/root/testdata/sf0.001/events.parquet", str(tmp_path)
    spark.read.parquet(source).write.parquet(f"{path}/log")
    counted = s.windowed_counts(s.read_log(spark, f"{path}/log"), "1 day", "0 seconds")
    s.run_once(counted, f"{path}/out", f"{path}/state")
    n = spark.read.parquet(f"{path}/out").agg(F.sum("n")).first()[0]
    total = spark.read.parquet(source).count()
    assert 0 < n <= total  # the last windows stay open


def test_text_edges(spark):
    row = spark.createDataFrame([("Müller’s (x)–test",)], "s string")
    assert row.select(t.norm_dataset_ws(F.col("s"))).first()[0] == "muller s (x) test"
    assert row.select(t.limit_context(F.lit("a b c <b>x</b> d e f"), 2)).first()[0] == "b c <b>x</b> d e"


def test_phrases_are_brute_force(spark):
    random.seed(9)
    words = "abcd"
    texts = [(i, " ".join(random.choice(words) for _ in range(12))) for i in range(30)]
    asked = [(q, " ".join(random.choice(words) for _ in range(3))) for q in range(6)]
    got = {(r["query_id"], r["frag_id"]): r["score"] for r in search.phrase_matches(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(texts, "frag_id int, text string"), 1).collect()}
    want = {}
    df = {w: sum(t.split().count(w) for _, t in texts) for w in words}
    for q, phrase in asked:
        parts = phrase.split()
        lead = min(range(len(parts)), key=lambda i: (df[parts[i]], i))
        for f, text in texts:
            tokens = text.split()
            score = 0
            for pos in (i for i, w in enumerate(tokens) if w == parts[lead]):
                start, cost = pos - lead, 0
                for i, w in enumerate(parts):
                    near = [d for d in (0, 1) for at in (start + i + d, start + i - d) if 0 <= at < len(tokens) and tokens[at] == w]
                    cost += min(near, default=2)
                score += cost <= 1
            if score:
                want[q, f] = score
    assert got == want


def test_match_tables(spark):
    cell = lambda name, values, tag: [("p", name, i, 0, v, tag) for i, v in enumerate(values)]
    old = spark.createDataFrame(cell("a", ["x", "y", "z"], "t") + cell("b", ["k", "l", "m"], "u"), "paper_id string, table_name string, row int, col int, value string, tag string")
    new = spark.createDataFrame([r[:5] for r in cell("n1", ["k", "l", "q"], "") + cell("n2", ["new", "words", "only"], "")], "paper_id string, table_name string, row int, col int, value string")
    assert [(r["table_name"], r["old_name"], r["hits"]) for r in cells.match_tables(old, new).collect()] == [("n1", "b", 2)]


def test_contexts_subtract(spark):
    texts = spark.createDataFrame([(1, "parsing with f1 on squad squad"), (2, "f1 f1 score")], "text_id int, text string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "evidence string")
    got = {(r["text_id"], r["axis"], r["evidence"]): r["n"] for r in linking.context_counts(texts, {"task": names("parsing"), "dataset": names("squad", "f1"), "metric": names("f1", "f1 score")}).collect()}
    assert got == {(1, "task", "parsing"): 1, (1, "metric", "f1"): 1, (1, "dataset", "squad"): 2, (2, "metric", "f1"): 2, (2, "metric", "f1score"): 1}


def test_shingles_and_evidence(spark):
    assert spark.range(1).select(t.shingles(t.taxonomy_words(F.lit("WikiQA's Set2")), 1, 2)).first()[0] == ["wiki", "qa", "set", "2", "wiki qa", "qa set", "set 2"]
    frags = spark.createDataFrame([(1, "p", "h", "the big model wins"), (2, "q", "h", "a big model"), (3, "p", "h", "see xxref bib7 here")], "frag_id int, paper_id string, header string, text string")
    asked = spark.createDataFrame([("p/t/0/0", "p", "big model", ""), ("p/t/0/1", "p", "12", ""), ("p/t/0/2", "p", "unseen words", "bib7")], "ext_id string, paper_id string, cell_content string, cell_reference string")
    got = sorted((r["ext_id"], r["this_paper"], r["frag_id"] or 0) for r in search.evidences(asked, frags).collect())
    assert got == [("p/t/0/0", False, 2), ("p/t/0/0", True, 1), ("p/t/0/1", True, 0), ("p/t/0/2", True, 3)]


def test_flat_text_repeats_no_anchor(spark):
    texts = spark.createDataFrame([("xxanchor-a xxanchor-a text",), ("xxref-b xxref-b xxref-b",), (None,)], "s string")
    assert [r[0] for r in texts.select(t.flat_text(F.col("s"))).collect()] == ["xxanchor-a text", "xxref-b", None]


def test_elements(spark):
    tags = spark.createDataFrame([('<DIV id=x class="ltx_p  big">',), ("<td class=one>",), ("<p>",)], "s string")
    got = tags.select(html.element_name(F.col("s")).alias("n"), html.element_classes(F.col("s")).alias("c")).collect()
    assert [(r["n"], r["c"]) for r in got] == [("div", ["ltx_p", "big"]), ("td", ["one"]), ("p", [])]


def test_no_proposals(spark):
    row = linking.no_proposals(spark, "no model").first()
    assert row["reason"] == "no model" and row["cell_ext_id"] is None and len(row) == 13


def test_dictionaries(spark):
    metrics = dictionaries.manual_evidence(spark, "metric")
    assert metrics.select("name").distinct().count() == 37 and dictionaries.manual_evidence(spark, "dataset").select("name").distinct().count() == 81
    assert dictionaries.manual_evidence(spark, "task").count() == 0
    pairs = {r["metric"]: r["complement"] for r in dictionaries.complements(spark).collect()}
    assert pairs["accuracy"] == "Error" and pairs["top-5 error rate"] == "Top-5 Accuracy" and pairs["word error rate"] == "Word Accuracy" and len(pairs) == 28
    assert dictionaries.known_datasets(spark, spark.createDataFrame([("Our Set",)], "dataset string")).where("key = 'our set'").count() == 1


def test_settings(spark):
    spark.conf.set("spark.tabulith.own_evidences", "7")
    assert (Settings.of(spark).own_evidences, Settings.of(spark).corpus_evidences) == (7, 10)
    spark.conf.unset("spark.tabulith.own_evidences")


def test_schedule_of_experiments(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("good fine text " if i % 2 else "bad poor words ") + str(i % 7), i % 2, i % 5 == 0) for i in range(120)], "id int, text string, label int, is_valid boolean")
    runs = models.run_schedule(rows, experiments.experiments_grid(experiments.Experiment(), n_grams=[1, 2]))
    assert len(runs) == 2 and all(scores["accuracy"] > 0.95 for _, scores in runs)
    experiments.save_experiments(spark, runs, f"{tmp_path}/runs")
    assert experiments.load_experiments(spark, f"{tmp_path}/runs").count() == 2


def test_links_are_those_of_every_triple(spark):
    """link() looks at few triples; the softmax over all of them, crossed with every query, is the same."""
    random.seed(11)
    triples = sorted({(f"t{random.randrange(3)}", f"d{random.randrange(5)}", f"m{random.randrange(3)}") for _ in range(20)})
    gains = {a: {(q, f"{a[0]}{j}"): random.choice([0.0, 0.5, 3.0]) for q in range(4) for j in range(5) if random.random() < 0.4 and q and f"{a[0]}{j}" in {x[i] for x in triples}} for i, a in enumerate(linking.AXES)}
    frames = {a: spark.createDataFrame([(q, n, g) for (q, n), g in x.items()], "query int, name string, gain double") for a, x in gains.items()}
    taxonomy = spark.createDataFrame(triples, "task string, dataset string, metric string")
    got = linking.link(spark.range(4).selectExpr("int(id) AS query"), frames, taxonomy, 3).collect()
    for q in range(4):
        g = {x: sum(gains[a].get((q, n), 0.0) for a, n in zip(linking.AXES, x)) for x in triples}
        whole = sum(math.exp(v) for v in g.values())
        rows = [(-round(math.exp(v) / whole, 9), 0, x) for x, v in g.items()]
        alone = tuple(max({x[i] for x in triples}, key=lambda n, a=a: (gains[a].get((q, n), 0.0), n)) for i, a in enumerate(linking.AXES))
        want = sorted([*rows, (-0.79, 1, alone)])[:3]
        assert [(-round(r["confidence"], 9), (r["task"], r["dataset"], r["metric"])) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [(c, x) for c, _, x in want]


def test_names_of_a_large_dictionary(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "We use Image Net and imagenet32 on squad, squad"), (2, None)], "text_id int, text string")
    names = spark.createDataFrame([("image net", "d"), ("squad", "d"), ("squad", "t")], "name string, axis string")
    rows = lambda: sorted(map(tuple, linking.find_names(texts, names, ("axis",)).select("text_id", "axis", "name", "n").collect()))
    small = rows()
    monkeypatch.setattr(linking, "BROADCAST_CHARACTERS", -1)
    assert rows() == small == [(1, "d", "image net", 1), (1, "d", "squad", 2), (1, "t", "squad", 2)]
