"""Tables as long-format cells: (keys, row, col, ...) in place of matrices, so that width is data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions import text as t
from tabulith.operators.tasks import TASK_BYTES, spread

REANNOTATE = "reannotate"


def _without_blank(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells of rows and columns that aren't blank, with their new numbers as _r and _c.

    A row that stays has a column that stays, so rows are numbered before columns go. Windows
    follow each other in the order in which they can share a sort.
    """
    some, table = (F.trim(value) != "").cast("int"), W.partitionBy(*keys)
    rows = cells.withColumn("_some", F.max(some).over(W.partitionBy(*keys, "row"))).where("_some = 1").withColumn("_r", F.dense_rank().over(table.orderBy("row")) - 1)
    down = W.partitionBy(*keys, "col").orderBy("row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("_some", F.max(some).over(down)).where("_some = 1").drop("_some").withColumn("_c", F.dense_rank().over(table.orderBy("col")) - 1)


def _numbered(cells: DataFrame) -> DataFrame:
    return cells.withColumn("row", F.col("_r")).withColumn("col", F.col("_c")).drop("_r", "_c")


def drop_blank(cells: DataFrame, keys: list[str], value: str = "raw_value") -> DataFrame:
    """TB17, TB18: without blank rows, then without blank columns; the rest numbered anew. A table of blanks vanishes."""
    return _numbered(_without_blank(cells, keys, value))


def label_spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """TB14: the array span: which part of a wide (c) or tall (r) cell a place is: its begin, inside or end.

    Spans count anew along a row or column wherever the one before has ended; borders
    inside a cell go.
    """

    def place(size: str, along: str, across: str) -> Column:
        # the start of a run of one cell: each span covers as many places as its size says
        order = W.partitionBy(*keys, across).orderBy(along)
        ordered = F.collect_list(F.col(size)).over(order)
        # remaining places of the current span after each step, from the sizes so far
        left = F.aggregate(ordered, F.lit(0), lambda a, x: F.when(a <= 1, x).otherwise(a - 1))
        return left

    out = cells.withColumn("_tall", place("rowspan", "row", "col")).withColumn("_wide", place("colspan", "col", "row"))
    wide, tall = F.col("colspan") > 1, F.col("rowspan") > 1
    c = F.when(wide & (F.col("_wide") == 1), "ce").when(wide & (F.col("_wide") == F.col("colspan")), "cb").when(wide, "ci")
    r = F.when(tall & (F.col("_tall") == 1), "re").when(tall & (F.col("_tall") == F.col("rowspan")), "rb").when(tall, "ri")
    out = out.withColumn("span", F.array_compact(F.array(c, r)))

    def gone(code: str, names: list[str]) -> Column:
        return F.when(F.exists("span", lambda s: s.isin(*code.split())), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))

    inner = F.concat(gone("ce ci", ["l", "ll"]), gone("cb ci", ["r", "rr"]), gone("re ri", ["t", "tt"]), gone("rb ri", ["b", "bb"]))
    return out.withColumn("borders", F.array_except("borders", inner)).drop("_wide", "_tall")


def layout_text(borders: Column, align: Column, span: Column, header: Column) -> Column:
    """TB13: a layout as words in fixed order."""
    def words(prefix: str, values: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(values)), lambda x: F.concat(F.lit(prefix), x))

    head = F.when(header, F.array(F.lit("header"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(words("border-", borders), words("align-", align), words("span-", span), head), " ")


def parse_layout(encoded: Column) -> Column:
    """TB13, TB16: 'borders,align,header,colspan,rowspan' as a struct."""
    parts = F.split(encoded, ",")

    def words(x: Column) -> Column:
        return F.filter(F.split(x, " "), lambda w: w != "")

    def number(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(1))

    return F.struct(words(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).alias("borders"), words(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("align"),
                    (F.coalesce(F.get(parts, F.lit(2)), F.lit("")) == "True").alias("header"), number(3).alias("colspan"), number(4).alias("rowspan"))


def build(raw: DataFrame, keys: list[str]) -> DataFrame:
    """TB1 after parsing: cells of kept tables with table_name, value, refs and layout. The cells of a paper are in one task."""
    tables = [*keys, "table_index"]
    # spans need the order of rows and columns, not their numbers
    spanned = label_spans(_without_blank(spread(raw, *keys, each=TASK_BYTES // 2), tables, "raw_value"), tables)
    number = F.dense_rank().over(W.partitionBy(*keys).orderBy("table_index"))
    cleaned = t.clear_styles(F.col("raw_value"))
    return spanned.select(
        *keys, F.format_string("table_%02d", number).alias("table_name"), "caption", "figure_id", F.col("_r").alias("row"), F.col("_c").alias("col"), cleaned.alias("raw_value"),
        t.cell_value(cleaned).alias("value"), t.references_in(cleaned).alias("refs"), layout_text(F.col("borders"), F.col("align"), F.col("span"), F.col("header")).alias("layout"))


def matrix(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """TB23: the matrix (array of rows) of every table."""
    rows = cells.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", F.col(value).alias("v")))).alias("line"))
    lines = rows.withColumn("line", F.transform("line", lambda x: x["v"]))
    return lines.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("matrix"))


def from_matrix(tables: DataFrame, keys: list[str], column: str = "matrix") -> DataFrame:
    """TB23, TB33: a matrix as cells."""
    rows = tables.select(*keys, F.posexplode(column).alias("row", "_line"))
    return rows.select(*keys, "row", F.posexplode("_line").alias("col", "value"))


def neighbourhoods(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """TB25: box (3 x 3), row_context and col_context (3) and own of every cell, '' beyond the edge."""
    across, down = W.partitionBy(*keys, "row").orderBy("col"), W.partitionBy(*keys, "col").orderBy("row")

    def three(column: str, w) -> Column:
        return F.array(F.lag(column, 1, "").over(w), F.col(column), F.lead(column, 1, "").over(w))

    blank = F.array(*[F.lit("")] * 3)
    rows = cells.withColumn("row_context", three(value, across)).withColumn("col_context", three(value, down))
    before, after = F.lag("row_context", 1).over(down), F.lead("row_context", 1).over(down)
    box = F.concat(F.coalesce(before, blank), F.col("row_context"), F.coalesce(after, blank))
    return rows.withColumn("box", box).withColumn("own", F.array(value))


CONTEXTS = ("box", "row_context", "col_context", "own")


def _two_tags(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The (keys, value) of tagged cells that have several tags: only there a context can say more than the value does.

    Cells of equal contexts are of equal value. So where a value has one tag in a table each
    of its contexts has that tag or none, and a value that isn't there has no context either.
    """
    return rows.groupBy(*keys, "value").agg(F.min("tag").alias("_low"), F.max("tag").alias("_high")).where("_low <> _high").select(*keys, "value")


def _any(rows: DataFrame) -> bool:
    return rows.limit(1).count() > 0


def transfer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """TB26, TB27: the tags of ``old`` cells (value, tag) for ``new`` ones (value): of the contexts box, row,
    column and cell the first that has a single tag in the old table; else 'reannotate'.

    Both stand together in windows of one table. Contexts are only made if some value has several tags.
    """
    told, asked = old.select(*keys, "row", "col", "value", "tag"), new.select(*keys, "row", "col", "value", F.lit(None).cast(old.schema["tag"].dataType).alias("tag"))
    contexts = CONTEXTS if _any(_two_tags(told, keys)) else ("value",)
    if len(contexts) > 1:
        told, asked = neighbourhoods(told, keys), neighbourhoods(asked, keys)
    both = told.withColumn("_new", F.lit(False)).unionByName(asked.withColumn("_new", F.lit(True)))
    for c in contexts:
        among = W.partitionBy(*keys, c)
        low, high = F.min("tag").over(among), F.max("tag").over(among)
        both = both.withColumn(f"_{c}", F.when(low == high, low))
        # a context that has been asked goes no further
        both = both.drop(c) if c != "value" else both
    found = F.coalesce(*[F.col(f"_{c}") for c in contexts])
    return both.where("_new").select(*keys, "row", "col", "value", F.coalesce(found, F.lit(REANNOTATE)).alias("tag"), found.isNotNull().alias("matched"))


def match_tables(old: DataFrame, new: DataFrame, paper: str = "paper_id") -> DataFrame:
    """TB28: for every new table of a paper the old one that explains most of its cells, if more than half.

    Cells are matched by their contexts as in transfer(), for all pairs of tables of one
    paper at once; of equals the old table with the smaller name wins. Pairs are counted by
    the values that both tables have, and by contexts only for values of several tags in an old table.
    """
    keys, old_keys = [paper, "table_name"], [paper, "old_name"]
    known = old.select(paper, F.col("table_name").alias("old_name"), "row", "col", "value", "tag")
    # a null among values is one like others
    own = F.array("value").alias("own")
    told = known.groupBy(*old_keys, own).agg(F.min("tag").alias("_low"), F.max("tag").alias("_high")).where("_low = _high")
    held = told.groupBy(paper, "own").agg(F.collect_list("old_name").alias("names")).groupBy(paper).agg(F.map_from_entries(F.collect_list(F.struct("own", "names"))).alias("held"))
    counted = new.groupBy(*keys, own).agg(F.count(F.lit(1)).alias("n"))
    asked = counted.groupBy(*keys).agg(F.sum("n").alias("size"), F.collect_list(F.struct("own", "n")).alias("asked"))
    # both are where their paper is
    each = asked.join(held.hint("merge"), paper).select(*keys, "size", F.explode("asked").alias("a"), "held").select(*keys, "size", F.explode(F.try_element_at("held", F.col("a.own"))).alias("old_name"), F.col("a.n").alias("n"))
    several = _two_tags(known, old_keys)
    if _any(several):
        more = _context_hits(known, new, several, paper).groupBy(*keys, "old_name").agg(F.count(F.lit(1)).alias("n"))
        each = each.unionByName(more.join(asked.select(*keys, "size"), keys))
    hits = each.groupBy(*keys, "size", "old_name").agg(F.sum("n").alias("hits")).where(F.col("hits") > F.col("size") / 2)
    best = W.partitionBy(*keys).orderBy(F.desc("hits"), "old_name")
    return hits.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select(*keys, "old_name", "hits")


def _context_hits(known: DataFrame, new: DataFrame, several: DataFrame, paper: str) -> DataFrame:
    """(paper, table_name, old_name, row, col) of new cells with a context of a single tag in an old table where their value has several."""
    keys, old_keys = [paper, "table_name"], [paper, "old_name"]
    # the value is in the middle of the context of its row
    value = F.col("row_context")[1]
    told = neighbourhoods(known, old_keys).withColumn("_own", F.array(value)).join(several.select(*old_keys, F.array("value").alias("_own")), [*old_keys, "_own"], "left_semi")
    asked = neighbourhoods(new.select(*keys, "row", "col", "value"), keys)
    hits = []
    for c in CONTEXTS[:-1]:
        single = told.groupBy(*old_keys, c).agg(F.min("tag").alias("_low"), F.max("tag").alias("_high")).where("_low = _high").drop("_low", "_high")
        hits.append(asked.join(single, [paper, c]).select(*keys, "old_name", "row", "col"))
    return reduce(DataFrame.union, hits).distinct()


def match_by_caption(old: DataFrame, new: DataFrame, paper: str = "paper_id") -> DataFrame:
    """TB29: tables of a paper whose captions are the same, unique, and at least ten characters long."""
    def unique(tables: DataFrame, name: str) -> DataFrame:
        keyed = tables.select(paper, F.col("table_name").alias(name), t.match_key(F.coalesce("caption", F.lit(""))).alias("_key")).where(F.length("_key") >= 10)
        return keyed.groupBy(paper, "_key").agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")

    return unique(new, "table_name").join(unique(old, "old_name"), [paper, "_key"]).drop("_key")


def row_contexts(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The values of a cell's row and column joined by ' border '."""
    def joined(axis: str, along: str, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(along, F.col(value).alias("v"))))
        return cells.groupBy(*keys, axis).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), " border ").alias(name))

    return cells.join(joined("row", "col", "row_context"), [*keys, "row"]).join(joined("col", "row", "col_context"), [*keys, "col"])


def preceding_tags(cells: DataFrame, keys: list[str], *kinds: str) -> DataFrame:
    """For every cell and each of ``kinds`` the tagged values left of it in its row, then above it in its column.

    A tag counts if it contains the kind. Tables are bounded in size, and each window holds
    one row or column of one.
    """
    left = W.partitionBy(*keys, "row").orderBy("col").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(*keys, "col").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    found = {kind: F.collect_list(F.when(F.col("tag").contains(kind), F.struct("tag", "value"))) for kind in kinds}
    # one sort for all kinds
    across = cells.select("*", *[values.over(left).alias(f"_{kind}_left") for kind, values in found.items()])
    both = across.select("*", *[values.over(above).alias(f"_{kind}_above") for kind, values in found.items()])
    return both.select(*cells.columns, *[F.concat(f"_{kind}_left", f"_{kind}_above").alias(f"{kind}_values") for kind in kinds])


def unique_model(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The first model tag of a cell's column, else of its row (null if there is none)."""
    is_model = F.col("tag").startswith("model")
    col, row = W.partitionBy(*keys, "col"), W.partitionBy(*keys, "row")
    first_col = F.min_by(F.when(is_model, F.struct("tag", "value")), F.when(is_model, F.col("row"))).over(col)
    first_row = F.min_by(F.when(is_model, F.struct("tag", "value")), F.when(is_model, F.col("col"))).over(row)
    return cells.withColumn("model", F.coalesce(first_col, first_row))


def label_cells(cells: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with predicted tags; a paper's own model counts as its best, no tag is ''."""
    tag = F.when(F.col("predicted_tags") == "model-paper", "model-best").otherwise(F.coalesce("predicted_tags", F.lit("")))
    return cells.join(tags.select(*keys, "row", "col", "predicted_tags"), [*keys, "row", "col"], "left").withColumn("tag", tag).drop("predicted_tags")


def consume(cells: DataFrame, keys: list[str]) -> DataFrame:
    """TB33: cells as evidence needs them: content, first reference, layout, whether styled."""
    return cells.select(*keys, "row", "col", F.trim("value").alias("cell_content"), F.coalesce(F.get("refs", F.lit(0)), F.lit("")).alias("cell_reference"),
                        F.col("layout").alias("cell_layout"), F.col("raw_value").rlike("</?(red|green|blue|bold|italic)>").alias("cell_styles"))


def layout_features(cells: DataFrame, keys: list[str]) -> DataFrame:
    """ML7: sixteen features of 1 or -1: borders, reference, style, spans, place at an edge."""
    last_row, last_col = F.max("row").over(W.partitionBy(*keys)), F.max("col").over(W.partitionBy(*keys))
    tests = [F.col("cell_layout").contains(f"border-{x}") for x in "tblr"] + [F.col("cell_reference") != "", F.col("cell_styles")]
    tests += [F.col("cell_layout").contains(f"span-{x}") for x in (kind + part for kind in "cr" for part in "bie")]
    tests += [F.col("row") == 0, F.col("row") == last_row, F.col("col") == 0, F.col("col") == last_col]
    return cells.withColumn("features", F.array(*[F.when(x, 1.0).otherwise(-1.0) for x in tests]))


def table_html(cells: DataFrame, keys: list[str], value: str = "value", tag: str | None = None) -> DataFrame:
    """SK9: every table as HTML, cells classed by their tags."""
    css = F.concat(F.lit(' class="'), F.col(tag), F.lit('"')) if tag else F.lit("")
    cell = F.concat(F.lit("<td"), css, F.lit(">"), F.col(value), F.lit("</td>"))
    rows = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", cell.alias("h")))), lambda x: x["h"]), "").alias("h"))
    row = F.concat(F.lit("<tr>"), F.col("h"), F.lit("</tr>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", row.alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))
