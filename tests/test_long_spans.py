from sigloom.operators import joins as J


def test_spans_of_any_length_are_in_few_buckets(spark):
    """Buckets of 4,096 would be more than an array takes."""
    spans = spark.createDataFrame([("a", 0, 10**13), ("a", 5, 9 * 10**12), ("b", 10**12, 10**12 + 3), ("b", 7, 7)], "key string, start long, end long")
    samples = spark.createDataFrame([("a", 4), ("a", 5), ("a", 9 * 10**12), ("a", 10**13), ("b", 10**12 + 2), ("b", 10**12 + 3), ("b", 7)], "key string, at long")
    found = sorted(tuple(r) for r in J.interval_join(samples, spans, "key", "at", "start", "end").select("key", "at", "start").collect())
    assert found == [("a", 4, 0), ("a", 5, 0), ("a", 5, 5), ("a", 9 * 10**12, 0), ("b", 10**12 + 2, 10**12)]
    none = spans.filter("start > end")
    assert J.interval_join(samples, none, "key", "at", "start", "end").count() == 0
