import random

from termweave.llm import revisits

SCHEMA = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, part int, base string"


def record(i, url, ts, kind="revisit", status=304, etag=None, last=None, digest=None, **headers):
    return (i, url, ts, kind, status, etag, last, digest, {k.replace("_", "-"): v for k, v in headers.items()} or None, 0, "clash")


def run(spark, rows, parts=None):
    return {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA), parts).collect()}


def test_validators_and_headers(spark):
    rows = [
        record(1, "http://www.a.com/x/", 1, "response", 200, etag='"1"', last="mon", Content_Type="text/html", ETag='"1"', X="old"),
        record(2, "https://a.com/x?utm_source=z#f", 2, etag='W/"1"', content_type="none", x="new", Date="d"),
        record(3, "http://a.com/x", 3, etag='"2"', last="mon"),
        record(4, "http://a.com/x", 4, last="mon"),
        record(5, "http://a.com/x", 5),
        record(6, "http://a.com/x", 0, etag='"1"'),
        record(7, None, 9, etag='"1"'),
        record(8, "http://a.com/x", 6, "response", 404, etag='"1"'),
        record(9, "http://a.com/x", 7, "metadata", None),
    ]
    got = run(spark, rows)
    assert {k: v.outcome for k, v in got.items()} == {2: "resolved", 3: "mismatch", 4: "resolved", 5: "unverified", 6: "orphan", 7: "orphan"}
    assert got[2].headers == {"content-type": "text/html", "etag": '"1"', "x": "new", "date": "d"} and got[2].status == 200
    assert got[3].base_record_id is None and got[3].headers is None


def test_hot_url_against_brute_force(spark):
    draw = random.Random(2)
    rows = [record(i, draw.choice(["http://hot.com/"] * 6 + ["http://b.com/1", "http://c.com/2?x=1"]), draw.randint(0, 60), *(("response", 200) if draw.random() < 0.1 else ()), etag=str(draw.randint(0, 1))) for i in range(400)]
    got = run(spark, rows, parts=16)
    for r in rows:
        if r[3] == "revisit":
            before = [x for x in rows if x[3] == "response" and x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])]
            base = max(before, key=lambda x: (x[2], x[0]), default=None)
            want = "orphan" if base is None else "resolved" if base[5] == r[5] else "mismatch"
            assert (got[r[0]].outcome, got[r[0]].base_record_id) == (want, base[0] if want == "resolved" else None)


def test_empty_table_and_payload(spark):
    assert run(spark, []) == {}
    found = revisits.resolve(spark.createDataFrame([record(1, "http://a.com", 1, "response", 200, digest="d"), record(2, "http://a.com", 2, digest="d")], SCHEMA))
    bodies = spark.createDataFrame([(1, b"body")], "record_id long, payload binary")
    assert bytes(revisits.with_payload(found, bodies).first().payload) == b"body"


def test_query_has_every_outcome(spark, data):
    from termweave.llm import queries

    seen = {r.outcome: r["count"] for r in queries.op2_revisits(spark, data).groupBy("outcome").count().collect()}
    assert set(seen) == {"resolved", "mismatch", "unverified", "orphan"} and seen["resolved"] > 0.2 * sum(seen.values())


def test_headers_that_differ_in_case(spark):
    headers = "map<string,string>"
    rows = [(1, "http://a.b/", 1, "response", 200, "x", None, None, {"ETag": "x", "etag": "y", "Vary": None}), (2, "http://a.b:80", 2, "revisit", 304, "x", None, None, {"DATE": "1", "Date": "2"}), (3, "https://a.b:80/", 3, "revisit", 304, "x", None, None, None)]
    df = spark.createDataFrame(rows, f"record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers {headers}")
    found = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert found[2].headers == {"etag": "x, y", "date": "1, 2"} and found[3].outcome == "orphan"
