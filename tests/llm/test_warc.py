import hashlib
import os

from conceptloom.llm import common, warc


def pages(spark):
    rows = [(i, f"http://h{i % 3}/p {i}é", f"<p>{'same' if i % 4 == 0 else i}</p>") for i in range(50)]
    rows += [(60, None, None), (61, "u", ""), (None, "u", "<p>same</p>"), (None, "v", "<p>null id</p>"), (7, "dup", "<p>7</p>"), (3, "http://h0/p 3é", "<p>3</p>"), (9, "long", "ß" * 300_000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, shard int")


def want(rows, least):
    """(id, bytes, digest) to the types and targets that its rows may have."""
    groups = {}
    for r in rows:
        groups.setdefault(r["html"] or "", []).append(r["page_id"])
    out = []
    for r in rows:
        b = (r["html"] or "").encode()
        group = groups[r["html"] or ""]
        top = max((i for i in group if i is not None), default=None)
        out.append((r["page_id"], len(b), warc.digest(b), top if len(group) > 1 and len(b) >= least else "single"))
    return out


def check(spark, least):
    out = common.fresh_path(spark, "w")
    src = pages(spark)
    warc.write(src, out, min_payload=least, shard_rows=10, file_bytes=400)
    got = warc.read(spark, out).collect()
    rows = src.collect()
    expected = want(rows, least)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(i), n, d) for i, n, d, _ in expected)
    tops = {d: t for _, _, d, t in expected}
    for d, t in tops.items():
        own = [r for r in got if r["payload_digest"] == d]
        responses = [r for r in own if r["record_type"] == "response"]
        if t == "single":
            assert len(responses) == len(own) and all(r["refers_to"] is None for r in own)
        else:
            assert len(responses) == 1 and responses[0]["page_id"] == t
            assert all(r["refers_to"] == t for r in own if r["record_type"] == "revisit")
    html = {warc.digest((r["html"] or "").encode()): (r["html"] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == html[r["payload_digest"]] for r in got if r["record_type"] == "response")
    return out


def test_round_trip(spark):
    check(spark, 0)
    check(spark, 12)


def files(out):
    at = out.removeprefix("file://")
    return {n: hashlib.sha256(open(f"{at}/{n}", "rb").read()).hexdigest() for n in sorted(os.listdir(at)) if n.endswith(".gz")}


def test_the_same_rows_give_the_same_files(spark):
    a, b = common.fresh_path(spark, "w"), common.fresh_path(spark, "w")
    warc.write(pages(spark), a, shard_rows=10, file_bytes=400)
    warc.write(pages(spark).repartition(7), b, shard_rows=10, file_bytes=400)
    assert files(a) == files(b) and len(files(a)) > 6
    assert not os.path.exists(a.removeprefix("file://") + "/_temporary")


def test_empty(spark):
    out = common.fresh_path(spark, "w")
    warc.write(pages(spark).limit(0), out)
    assert warc.read(spark, out).count() == 0


def test_range_bounds_split_crowded_ranges(spark):
    ids = [*range(1000), *range(10**12, 10**12 + 1000), -5, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    bounds = warc.range_bounds(df, rows=100, grid=16)
    edges = [-(2**63), *bounds, 2**63]
    counts = [sum(a <= i < b for i in ids) for a, b in zip(edges, edges[1:], strict=False)]
    assert max(counts) <= 100 and sum(counts) == len(ids)


def test_ids_beyond_doubles_and_null_beside_empty_urls(spark):
    big = 2**53
    rows = [(big + 1, "a", "<p>x</p>"), (big + 3, "b", "<p>x</p>"), (None, "c", "<p>x</p>"), (2**63 - 1, "d", "<p>y</p>"), (-(2**63), "e", "<p>y</p>")]
    rows += [(5, None, "<p>z</p>"), (5, "", "<p>z</p>"), (None, None, "<p>w</p>"), (None, "", "<p>w</p>"), (6, "u", "<p>v</p>"), (6, "u", "<p>v</p>")]
    src = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    out = common.fresh_path(spark, "w")
    warc.write(src, out, shard_rows=2)
    got = warc.read(spark, out).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append(r)
    for html, top, n in (("<p>x</p>", big + 3, 3), ("<p>y</p>", 2**63 - 1, 2), ("<p>z</p>", 5, 2), ("<p>w</p>", None, 2), ("<p>v</p>", 6, 2)):
        own = by[warc.digest(html.encode())]
        response = [r for r in own if r["record_type"] == "response"]
        assert len(own) == n and [r["page_id"] for r in response] == [top]
        assert all(r["refers_to"] == top for r in own if r["record_type"] == "revisit")


def test_a_shard_is_a_task(spark):
    src = spark.range(2000).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id, '</p>') AS html")
    out = common.fresh_path(spark, "w")
    shards = {r["file"].split("-")[1]: r["records"] for r in warc.write(src, out, shard_rows=100).collect()}
    assert len(shards) >= 20 and max(shards.values()) <= 100
