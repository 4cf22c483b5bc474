import hashlib
import struct

import zstandard

from plumbline.llm import warc


def test_bundle_frames_are_independent_and_indexed(tmp_path):
    path = str(tmp_path / "x.warc.zst")
    w = warc.BundleWriter(path, frame_bytes=2000)
    places = {k: w.add(warc.make_record(k, f"http://x/{k}", b"p" * (100 * k), "0" * 40, None)) for k in range(30)}
    w.close()
    r = warc.BundleReader(path)
    assert len(r.frames) > 5 and max(p[0] for p in places.values()) == len(r.frames) - 1
    for k in (29, 0, 17):
        headers, block = r.record(*places[k])
        assert headers["WARC-Record-ID"] == f"<urn:page:{k}>" and block.endswith(b"p" * (100 * k)) and len(block) == len(warc._HTTP) + 100 * k
    raw = (tmp_path / "x.warc.zst").read_bytes()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (n, flags, magic) == (len(r.frames), 0, 0x8F92EAB1)
    # a plain decompressor skips the table and sees one WARC file
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(list(warc.parse_records(whole))) == 30


def test_headers_can_not_be_broken():
    rec = warc.make_record(None, "http://x/\r\nWARC-Type: evil\x00é", b"", "0" * 40, None)
    ((_, h, block),) = warc.parse_records(rec)
    assert h["WARC-Type"] == "response" and h["WARC-Target-URI"] == "http://x/%0D%0AWARC-Type:%20evil%00%C3%A9" and block == warc._HTTP


def plain(rows):
    best = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        refers = best.get(b) if len(b) >= 1000 and b in best and (i is None or i < best[b]) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_odd_tables(spark):
    big, edge = "é" * 500, "x" * 999
    rows = [(1, "u", big), (5, None, big), (3, "u\n", big), (3, "v", big), (5, "w", big), (7, "u", edge), (8, "u", edge), (9, None, None), (9, None, None), (None, "u", big), (2, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    _, index = warc.write_bundles(pages.repartition(3), frame_bytes=5000)
    got = warc.read_bundles(spark, index).select(warc.page_number("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("r"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    found = warc.lookup(spark, index, [7, None])
    assert [h["WARC-Record-ID"] for h, _ in found] == ["<urn:page:7>", "<urn:page:null>"] and found[0][1] == warc._HTTP + edge.encode()
    _, none = warc.write_bundles(pages.limit(0))
    assert warc.read_bundles(spark, none).count() == 0


def test_clashing_columns(spark):
    rows = [(k, "u", "x" * 1500 if k % 3 == 0 else f"page {k}") for k in range(30)]
    plain_pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    odd = plain_pages.selectExpr("1 AS payload", "2 AS d_digest", "'f' AS frame", "page_id", "3 AS first_id", "url", "html", "4 AS n", "5 AS refers_to", "6 AS offset")
    got = [sorted(map(repr, warc.read_bundles(spark, warc.write_bundles(p)[1]).collect())) for p in (plain_pages, odd)]
    assert got[0] == got[1] and len(got[0]) == 30


def test_oracle(spark, sf, duck, same):
    from plumbline.llm.queries import ORACLES, QUERIES

    same(QUERIES["op6_warc"](spark, sf), duck, ORACLES["op6_warc"])


def test_a_task_that_runs_twice_has_a_bundle_of_its_own(spark, tmp_path):
    """Rows of a second attempt may come in another order: the index that is kept still fits the bundles that it names."""
    from pyspark.sql import functions as F

    from plumbline.llm.common import materialize

    rows = [(k, f"http://x/{k}", f"page {k} " * (k % 50)) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.write_bundles(materialize(pages.repartition(3), "warc_a"), str(tmp_path))
    warc.write_bundles(materialize(pages.repartition(3, "url").sortWithinPartitions(F.rand(1)), "warc_b"), str(tmp_path))
    got = warc.read_bundles(spark, index)
    assert folder == str(tmp_path) and got.count() == 300 and got.select("record_id").distinct().count() == 300
