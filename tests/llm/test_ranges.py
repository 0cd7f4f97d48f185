"""Extraction doesn't hang on how many ranges pages are dealt into."""
from graphmill.llm import html_extract


def test_any_number_of_ranges(spark):
    article = lambda k: "".join(f"<p>Line {k} {j} of an article that goes on.</p>" for j in range(4))
    rows = []
    for k in range(16):  # articles in triples, so that the neighbour that decides may be the second
        shared = f"<p>Seen on the pages around {k // 4}.</p>"
        rows.append((k, f"http://host/a/{k:03}", f"<html><body><article>{article(k // 3)}{shared}</article></body></html>"))
    rows += [(100, None, "<p>alone</p>"), (None, "http://host/a/004x", "<article><p>no id</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    take = lambda n: sorted((str(r.page_id), r.text) for r in html_extract.extract(df, n).collect())
    one = take(1)
    assert len(one) == 18 and all(take(n) == one for n in (2, 3, 5, 9, 1000))
