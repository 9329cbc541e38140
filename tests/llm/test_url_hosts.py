"""Hosts with odd characters."""

from millrace.llm import queries, urls


def test_a_host_runs_on_past_nul(spark):
    rows = [(1, "http://Example.com\x00.Evil.org/en/"), (2, "http://a\x00B.com/x"), (3, "http://example.com/en/\x00")]
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules)
    got = sorted(map(tuple, out.select("_llm_row.page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [
        (1, "example.com\x00.evil.org", "/en/", None, "allow"), (2, "a\x00b.com", "/x", "com/", "allow"),
        (3, "example.com", "/en/\x00", "example.com/en/", "block")]
