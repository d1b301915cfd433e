"""WARC archives: an exact round trip, digests and revisits."""

import gzip
import hashlib
import random

import pytest

from strandline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, kind int, shard string"


def pages():
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("<p>é中 \r\n") for _ in range(n))
    big, common = body(3000), body(1500)
    rows = [(i, f"http://x.org/{i}", rng.choice([body(rng.randint(0, 2500)), big, common, "short", "short"])) for i in range(120)]
    rows += [(500, None, big), (501, "http://a b/\n\ré", None), (502, "", ""), (None, "n", big), (None, "n", "short"), (3, "http://x.org/3", common), (3, "http://x.org/3", common), (4, "q", big)]
    return [(*r, "d", 7, "s") for r in rows]


def test_round_trip(spark, tmp_path):
    rows, folder = pages(), f"file://{tmp_path}/w"
    written = warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder, shards=3, roll_bytes=20_000)
    manifest = written.collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
    for m in manifest:
        data = (tmp_path / "w" / m.name).read_bytes()
        assert hashlib.sha1(data).hexdigest() == m.sha1 and len(data) == m.n_bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not list((tmp_path / "w").glob("_tmp*"))
    (tmp_path / "w" / "0000009-0000000.warc.gz").write_bytes((tmp_path / "w" / manifest[0].name).read_bytes())  # no manifest lists it
    got = warc.read_warc(folder, written).collect()
    raw = lambda r: (r[2] or "").encode()
    key = lambda r: (r[0] is not None, r[0] or 0)
    largest = {}
    for r in rows:
        if len(raw(r)) >= 1000:
            largest[raw(r)] = max(largest.get(raw(r), r), r, key=key)
    want, seen = [], set()
    for r in rows:
        top = largest.get(raw(r), r)[0]
        again = len(raw(r)) >= 1000 and (r[0], raw(r)) in seen
        seen.add((r[0], raw(r)))
        revisit = len(raw(r)) >= 1000 and (top != r[0] or again)
        want.append(str((r[0], len(raw(r)), hashlib.sha1(raw(r)).hexdigest(), "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(str((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to)) for g in got) == sorted(want)
    payloads = {raw(r) for r in rows}
    assert all(bytes(g.payload) in payloads for g in got if g.record_type == "response")


def test_reruns_write_the_same_files(spark, tmp_path):
    rows = pages()
    files = []
    for n in (1, 5):
        warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(n), f"file://{tmp_path}/{n}", shards=4, roll_bytes=30_000)
        files.append({p.name: p.read_bytes() for p in (tmp_path / str(n)).glob("*.warc.gz")})
    assert files[0] == files[1]


def test_damage_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(pages()[:5], SCHEMA), folder, shards=1)
    (path,) = (tmp_path / "w").glob("*.warc.gz")
    whole = path.read_bytes()
    path.write_bytes(whole[:-10] + bytes(10))
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_warc(folder, manifest).collect()
    changed = gzip.compress(gzip.decompress(whole).replace(b"<p", b"<q", 1))
    path.write_bytes(changed)
    as_written = manifest.selectExpr("name", f"{len(changed)}L AS n_bytes", f"'{hashlib.sha1(changed).hexdigest()}' AS sha1")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_warc(folder, as_written).collect()
    path.unlink()
    with pytest.raises(Exception, match="warc.gz"):
        warc.read_warc(folder, manifest).collect()


def test_no_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame([], SCHEMA), folder)
    assert manifest.count() == 0 and warc.read_warc(folder, manifest).count() == 0


def test_a_very_long_page(spark, tmp_path):
    folder, html = f"file://{tmp_path}/w", "<p>long é " * 800_000
    got = warc.read_warc(folder, warc.write_warc(spark.createDataFrame([(1, "u", html, "d", 1, "s"), (2, "u", html, "d", 1, "s")], SCHEMA), folder)).collect()
    assert {(g.page_id, g.payload_bytes, g.record_type, g.refers_to) for g in got} == {(1, len(html.encode()), "revisit", 2), (2, len(html.encode()), "response", None)}
    assert [bytes(g.payload).decode() for g in got if g.payload] == [html]
