"""Lines that are on 8 to 9 % of the pages of each site."""

from tallybridge.llm import lines


def test_footer_on_a_twelfth_of_each_site(spark):
    rows = []
    for site, pages, holding in (("a", 100, 8), ("b", 300, 26), ("c", 500, 43)):
        rows += [(f"{site}{i}", site, f"page {site} {i}" + ("\nAll rights reserved" if i < holding else "")) for i in range(pages)]
        # Not boilerplate: on 4 % of the pages.
        rows += [(f"{site}x{i}", site, f"other {site} {i}\nSee also") for i in range(pages // 25)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    done = lines.deduplicated(docs)
    assert done.filter("text LIKE '%All rights%'").isEmpty()
    assert done.filter("text LIKE '%See also%'").count() == 4 + 12 + 20
