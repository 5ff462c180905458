import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import interchange, layout, pageorder, trees


def glyphs(text, left, baseline, size, font=0):
    return [(c, left + i * size / 2, float(baseline), float(size), font) for i, c in enumerate(text) if c != " "]


def page(spark, *lines, doc="d", number=1):
    rows, i = [], 0
    for line in lines:
        for c, left, baseline, size, font in line:
            rows.append((doc, number, i, c, {"left": float(left), "bottom": baseline, "right": left + size / 2, "top": baseline + size}, float(size), font))
            i += 1
    return spark.createDataFrame(rows, "doc string, page int, idx int, ch string, rect struct<left:float,bottom:float,right:float,top:float>, size float, font smallint")


FACES = [(0, False, False), (1, True, False), (2, False, True)]


def faces(spark):
    return spark.createDataFrame(FACES, "font smallint, bold boolean, italic boolean")


def test_lines_band_by_height_and_blanks_by_gap():
    g = lambda ch, left, bottom, size: {"ch": ch, "left": left, "right": left + size / 2, "bottom": bottom, "top": bottom + size, "size": size, "bold": False, "italic": False}
    small = [g("x", 30, 104, 6)]  # raised, but within the band
    lines = layout.page_lines([g("b", 10, 100, 10), g("a", 0, 100, 10), *small, g("c", 0, 80, 10), g("\n", 5, 80, 10)])
    assert ["".join(r["text"] for r in x["runs"]) for x in lines] == ["a b x", "c"] and lines[0]["glyphs"] == 3
    assert layout.page_lines([]) == [] and layout.page_lines([g(" ", 0, 0, 10)]) == []


def test_modes_and_half_points():
    assert layout.mode_of([10, 12, 12, 10]) == 12 and layout.mode_of([12, 10]) == 10 and layout.mode_of([]) == 0
    assert layout.half_points(10.25) == 10.5 and layout.half_points(10.2) == 10.0


def test_blocks_and_markdown(spark):
    lines = [
        glyphs("Report", 0, 700, 24), glyphs("first line of a para-", 0, 650, 10), glyphs("graph that goes on", 0, 638, 10), glyphs("Bold", 0, 610, 10, 1), glyphs("- one", 0, 590, 10),
        glyphs("1. two", 0, 578, 10), glyphs("2) three", 0, 566, 10), glyphs("- four", 0, 554, 10), glyphs("1) five", 0, 542, 10), glyphs("#tag", 0, 500, 10),
    ]
    b = layout.blocks_of(layout.lines_of(page(spark, *lines).unionByName(page(spark, glyphs("1. next", 0, 700, 10), number=2)), faces(spark)))
    got = [(r.page, r.kind, r.level, r.text.strip()) for r in b.orderBy("page", "block").collect()]
    assert got == [
        (1, "heading", 1, "Report"), (1, "paragraph", None, "first line of a paragraph that goes on"), (1, "heading", 2, "Bold"), (1, "item", None, "one"), (1, "item", None, "two"), (1, "item", None, "three"),
        (1, "item", None, "four"), (1, "item", None, "five"), (1, "paragraph", None, "#tag"), (2, "item", None, "next"),
    ]
    pieces = [(r.piece, r.tight) for r in layout.markdown_of(b).orderBy("page", "block").collect()]
    assert pieces == [
        ("# Report", False), ("first line of a paragraph that goes on", False), ("## Bold", False), ("- one", False), ("1. two", True), ("2. three", True), ("- four", True), ("1. five", True), ("\\#tag", False), ("1. next", False),
    ]
    assert layout.lines_of(page(spark), faces(spark)).count() == 0


def test_numbers_go_on_over_pages(spark):
    block = lambda p, b, ordered: ("d", p, b, "item", None, ordered, "x", [("x", False, False)])
    rows = [block(1, 1, True), block(1, 2, True), block(2, 1, True), block(3, 1, True), block(3, 2, False), block(3, 3, True), block(4, 1, True), block(5, 1, True)]
    d = spark.createDataFrame(rows, "doc string, page int, block int, kind string, level int, ordered boolean, text string, runs array<struct<text string, bold boolean, italic boolean>>")
    assert [r.piece for r in layout.markdown_of(d).orderBy("page", "block").collect()] == ["1. x", "2. x", "3. x", "4. x", "- x", "1. x", "2. x", "3. x"]


def test_emphasis_and_escapes():
    run = lambda t, b=False, i=False: {"text": t, "bold": b, "italic": i}
    assert layout.emphasised([run("a "), run("b ", True), run("c", True, True), run(" ", False, True)]) == "a **b** ***c*** "
    assert [layout.escape_leading(x) for x in ("- a", "1. a", "1.a", "a", "")] == ["\\- a", "1\\. a", "1.a", "a", ""]


def pages(spark, **n):
    return spark.createDataFrame([(d, 100 + p, p) for d, k in n.items() for p in range(1, k + 1)] or [], "doc string, page int, pos int")


def order(df):
    out = {}
    for r in df.orderBy("doc", "pos").collect():
        out.setdefault(r.doc, []).append(r.page - 100)
    return out


def test_page_order(spark):
    p = pages(spark, a=4, b=1)
    assert order(pageorder.delete(p, F.col("pos") == 1)) == {"a": [2, 3, 4], "b": [1]}
    assert order(pageorder.duplicate(p, F.when(F.col("pos") == 2, 2))) == {"a": [1, 2, 2, 2, 3, 4], "b": [1]}
    assert order(pageorder.reorder(p, 5 - F.col("pos"))) == {"a": [4, 3, 2, 1], "b": [1]}
    assert order(p.withColumn("pos", pageorder.moved(F.col("pos"), F.lit(4), F.lit(2)))) == {"a": [1, 4, 2, 3], "b": [1]}
    assert order(pageorder.insert(p, p.where("pos = 1"), "1")) == {"a": [1, 1, 2, 3, 4], "b": [1, 1]}
    assert order(pageorder.insert(p, p.where("pos = 4"), "1", replace=True)) == {"a": [1, 4, 3, 4], "b": [1]}
    assert order(pageorder.delete(pages(spark), F.col("pos") == 1)) == {}


def test_trees(spark):
    deep = [("x", n, n - 1 if n > 1 else None, 0, 7 if n == 1 else None) for n in range(1, 200)]
    rows = deep + [("y", 1, None, 3, None), ("y", 2, 1, 1, 5), ("y", 3, 9, 0, 5), ("y", 4, 5, 0, 1), ("y", 5, 4, 0, 1)]  # a missing parent, a cycle
    w = trees.ways_to_top(spark.createDataFrame(rows, "doc string, node int, parent int, ord int, page int"), "doc", "node", "parent", "ord", "page")
    got = {(r.doc, r.node): (r.depth, r.inherited) for r in w.collect()}
    assert got == {**{("x", n): (n - 1, 7) for n in range(1, 200)}, ("y", 1): (0, None), ("y", 2): (1, 5)}
    below = {(r.doc, r.node): r.below for r in trees.subtree_counts(w, "doc", "node").collect()}
    assert below[("x", 1)] == 198 and below[("x", 199)] == 0 and below[("y", 1)] == 1


def test_forms_and_back(spark):
    f = spark.createDataFrame([(1, "d", 0, "a (1)", "x\\)&<\"y"), (2, "d", 1, "b", None), (3, "d", 2, "b", "last")], "field_id long, doc string, ord int, name string, value string")
    x = interchange.form_documents(f).collect()[0]
    assert interchange.fdf_fields(x.fdf) == [("a (1)", 'x\\)&<"y'), ("b", "last")]
    assert interchange.fdf_fields("/T (p (q) r) /V (s) /T (t)") == [("p (q) r", "s"), ("t", "")] and interchange.fdf_fields(None) == []
    back = spark.createDataFrame([(x.xfdf,)], "t string").select(interchange.parse_xfdf(F.col("t")).alias("f")).collect()[0].f
    assert [(r.name, r.value) for r in back] == [("a (1)", 'x\\)&<"y'), ("b", "last")]


@pytest.mark.parametrize(("row", "kept"), [("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96.5\tword", True), ("4\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96\tword", False), ("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t12\tword", False), ("5\t1\tx\t1\t1\t1\t0\t0\t9\t9\t96\tword", False), ("5\t1\t1", False), ("", False), (None, False)])
def test_recognition_rows(spark, row, kept):
    assert (interchange.parse_tsv(spark.createDataFrame([(row,)], "line string"), "line", 40.0).count() == 1) == kept


def test_links_by_kind(spark):
    urls = ["javascript:x", "file:///x", "http://a.example", "https://a.example", "http://10.0.0.1/", "https://xn--a.example", "mailto:a@b"]
    k = T.url_kind(F.col("u"))
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", T.url_severity(k).alias("s")).collect()
    assert {r.u: r.s for r in got} == dict(zip(urls, (3, 2, 0, 0, 1, 1, 0), strict=True))
