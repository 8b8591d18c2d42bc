"""Files of a folder, and HTML that is safe."""

from pyspark.sql import functions as F

from stemforge.functions import html
from stemforge.sources import docx


def test_of_one_name_the_first_by_path_stays(spark, tmp_path):
    for folder, name, text in (("b", "x.md", "second"), ("a", "x.md", "first"), ("a", "y.PDF", "p")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = {r["name"]: (bytes(r["content"]).decode(), r["kind"]) for r in docx.read_files(spark, str(tmp_path)).collect()}
    assert got == {"x.md": ("first", "markdown"), "y.PDF": ("p", "pdf")}


def test_unsafe_html_goes(spark):
    given = '<p onclick="a()" title=ok>x<script>b()</script></p><a HREF=\'javascript:c()\' id=k>y</a><img src="data:image/png;base64,AA"><a href="data:text/html,z">w</a>'
    want = '<p title=ok>x</p><a id=k>y</a><img src="data:image/png;base64,AA"><a>w</a>'
    d = spark.createDataFrame([(given,), (None,)], "h string").select(html.sanitize(F.col("h")).alias("s"), html.to_text(F.col("h")).alias("t")).collect()
    assert (d[0]["s"], d[0]["t"]) == (want, "x y w") and d[1]["s"] is None
