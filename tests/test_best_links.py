"""Each page's own links."""

import __spark_entry__


def test_own_links(spark, tmp_path):
    rows = [
        (1, "https://a.org/x/", '<a href="one.txt">1</a> <a class=k href=\'/two.xlsx\'>2</a> <a href=three.html>3</a>'),
        (2, "https://b.org/y", "<p>none</p>"),
        (3, "https://c.org/z/p.html", '<a href="q.xlsx?v=1">q</a>'),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    # .html is wanted before .xlsx
    got = {x.page_id: x.best for x in __spark_entry__.queries()["best_links"](spark, str(tmp_path)).collect()}
    assert got == {1: "https://a.org/x/three.html", 2: None, 3: "https://c.org/z/q.xlsx?v=1"}
