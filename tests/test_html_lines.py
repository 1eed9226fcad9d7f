"""Character references in the lines of web pages."""

from glossweave.sources import files


def test_references_without_a_semicolon(spark):
    """As the studied importer reads them: `&amp` at a cut counts, a name that isn't one stays."""
    pages = spark.createDataFrame([(1, "<title>a&amp;&amp</title><p>b &amp c</p>d &am"), (2, "&lt;b&gt &copy;")], "page_id long, html string")
    got = [tuple(r) for r in files.html_lines(pages, "page_id", "html").orderBy("file", "line").collect()]
    assert got == [("1", 0, "a&& b & c"), ("1", 1, "d &am"), ("2", 0, "<b> ©")]
