from harborline.llm import revisits


def test_revisits(spark):
    h = {"date": "new", "content-type": "x"}
    rows = [
        (1, "http://A.com:80", 1, "response", "t", "m", {"date": "old", "content-type": "html"}),
        (2, "http://a.com/#x", 2, "revisit", "t", None, h),
        (3, "http://a.com/", 0, "revisit", "t", None, h),
        (4, "http://a.com/", 3, "revisit", "u", "m", h),
        (5, "HTTP://a.com/", 4, "revisit", None, "n", h),
        (6, "http://a.com/", 5, "revisit", None, None, None),
        (7, None, 5, "revisit", "t", None, h),
        (8, "http://a.com/", 1, "revisit", "t", "m", h),
        (8, "http://a.com/", 1, "revisit", "t", "m", h),
        (9, "http://a.com/A", 9, "revisit", "t", None, h),
    ]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS status", "2 AS again")
    got = [(r.record_id, r.status, r.response_id, r.headers) for r in revisits.resolve_revisits(df).collect()]
    merged, plain = {"date": "new", "content-type": "html"}, {"date": "old", "content-type": "html"}
    want = [
        (2, "resolved", 1, merged), (3, "no_response", None, None), (4, "changed", None, None), (5, "changed", None, None),
        (6, "resolved", 1, plain), (7, "no_response", None, None), (8, "resolved", 1, merged), (8, "resolved", 1, merged),
        (9, "no_response", None, None),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert revisits.resolve_revisits(df.limit(0)).count() == 0
