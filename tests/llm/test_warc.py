import hashlib
import io
import zipfile

import pytest

from ledgerline.llm import warc, zipfiles
from ledgerline.llm.common import Workspace

BIG = "<p>" + "x" * 200
PAGES = [(5, "u5", BIG), (3, "u3", BIG), (3, "u3", BIG), (9, None, BIG), (None, "n", BIG), (1, "a\r\nb", None), (2, "u2", ""), (4, "u4", "short"), (6, "u6", "short"),
         (7, "u7", "é" * 50), (8, "u8", "é" * 50), (10, "long", "word \r\n\r\n " * 300_000)]


class Bytes:
    def __init__(self, data):
        self.data, self.reads = data, []

    def read_at(self, n, at):
        self.reads.append(n)
        return self.data[at : at + n]


@pytest.mark.parametrize("made_by", ["package", "zipfile", "zipfile64"])
def test_directory(made_by):
    members = [("archive/a", b"one" * 1000), ("indexes/i", b""), ("x/é", b"two")]
    if made_by == "package":
        data = zipfiles.package([(n, [d]) for n, d in members])
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    else:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, d in members:
                with z.open(n, "w", force_zip64=made_by == "zipfile64") as f:
                    f.write(d)
            z.comment = b"a comment"
        data = out.getvalue()
    file = Bytes(data)
    found = zipfiles.directory(file, len(data))
    assert [(m.name, data[(at := zipfiles.data_offset(file, m)) : at + m.size]) for m in found] == members
    with pytest.raises(ValueError):
        zipfiles.directory(Bytes(b"no archive"), 10)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'z' as digest", "2 as first")
    got = warc.round_trip(spark, pages, with_payload=True).collect()
    assert len(got) == len(PAGES) and all(r["digest_ok"] for r in got)
    key = lambda t: tuple((x is None, x) for x in t)
    want = []
    for page_id, url, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if p is not None and (h or "").encode() == payload]
        again = len(payload) >= 100 and page_id != min(same)
        want.append((page_id, url and url.replace("\r\n", "%0D%0A"), len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else None, None if again else payload))
    assert sorted(((r["page_id"], r["target_uri"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_small_packages_and_ranges(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * 300) for i in range(200)], "page_id long, url string, html string")
    work = Workspace(spark, "warc-test")
    manifest = work.save(warc.write_packages(warc.plan_records(pages), work.folder("p"), 2000), "m")
    ranges = warc.read_ranges(manifest, 500)
    assert manifest.count() > 8 and ranges.agg({"records": "sum"}).first()[0] == 200 and ranges.count() > manifest.count()
    assert sorted(r["page_id"] for r in warc.read_records(ranges).collect()) == list(range(200))


def test_small_payloads_are_dealt_by_page(spark):
    """Many empty pages: all are responses, and the join deals them out by page, not by digest."""
    pages = spark.range(2000).selectExpr("id as page_id", "concat('u', id) as url", "if(id % 100 = 0, repeat('x', 100), if(id % 2 = 0, '', null)) as html")
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        rows = [p for p in warc.plan_records(pages).rdd.glom().collect() if p]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(map(len, rows)) < 1000
    assert all((r["kind"] == "revisit") == (r["page_id"] % 100 == 0 and r["page_id"] > 0) for p in rows for r in p)
    assert {r["refers_to"] for p in rows for r in p} == {None, 0}
