"""All messages as HTML, those with italics too."""

import hashlib
import html
import re

import __spark_entry__


def to_html(text):
    return re.sub(r"(?<!_)_([^_\n]+?)_(?!_)", r"<i>\1</i>", html.escape(text))


def test_every_message(spark, tmp_path):
    texts = ["plain", "an _italic & <b>_ word", "snake_case_name", "__no__ _a\nb_ _c_ _d_", "_", "it's \"_q_\"", "", None]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.turn: x.digest for x in __spark_entry__.queries()["message_html"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else hashlib.md5(to_html(t).encode()).hexdigest() for i, t in enumerate(texts)}
