"""The salvage reader reads each byte once, bounds what it inflates, and the query names what was lost."""

import gzip
import io
import time

import numpy as np
import pytest

from tracelake.llm import warc


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data

    def size(self):
        return len(self.getbuffer())


def members(n, size=1500):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        payload = rng.bytes(size)
        out.append(warc._member(str(i), "u", payload, warc.base32_sha1(payload), None, "d"))
    return out


@pytest.mark.parametrize("broken", [False, True])
def test_every_byte_is_read_once(broken):
    m = members(2000)
    if broken:
        m[500] = m[500][:600] + b"?" * 400 + m[500][1000:]
        m.insert(900, b"\x1f\x8b\x08" * 5000)
    source = Counting(b"".join(m))
    found = warc.Salvage(source)
    records = sum(1 for _ in found)
    assert records == 2000 - broken and len(found.gaps) == 2 * broken
    assert source.read_bytes <= 1.1 * source.size()


def test_a_member_that_inflates_without_end_is_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "HEAD", 100_000)
    m = members(2)
    bomb = gzip.compress(bytes(5_000_000))
    headers = gzip.compress(b"WARC/1.1\r\nX: " + b"a" * 5_000_000)
    long = gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\n" + b"y" * 5_000_000)
    found = warc.Salvage(Counting(m[0] + bomb + m[1] + headers + m[0] + long + m[1]))
    assert [r.headers["warc-page-id"] for r in found] == ["0", "1", "0", "1"]
    assert [g[2] for g in found.gaps] == ["no version line", "headers too long", "block length"]


@pytest.mark.parametrize("hold", [1 << 12, 1 << 26])
def test_records_longer_than_what_is_held(monkeypatch, hold):
    """Long records, gzipped or plain, are read piece by piece; after a long false one the search goes on behind its start."""
    monkeypatch.setattr(warc, "HOLD", hold)
    monkeypatch.setattr(warc, "CHUNK", 1 << 12)
    long = [np.random.default_rng(i).bytes(300_000) for i in range(3)]
    plain = gzip.decompress(warc._member("2", "u", long[2], warc.base32_sha1(long[2]), None, "d"))
    parts = [warc._member("0", "u", long[0], warc.base32_sha1(long[0]), None, "d"), plain, plain[:2000] + members(1)[0] + plain[2000:-9] + b"x" * 9, warc._member("1", "u", long[1], warc.base32_sha1(long[1]), None, "d")]
    parts.append(b"WARC/1.1\r\nContent-Length: 999999999\r\n\r\n" + b"z" * 50_000)
    source = Counting(b"".join(parts))
    salvage = warc.Salvage(source, keep=True)
    found, most = [], 0
    for r in salvage:
        found.append((r.headers["warc-page-id"], r.payload_bytes, r.payload_digest == warc.base32_sha1(r.payload), len(r.payload)))
        most = max(most, len(salvage.buffer))
    assert found == [("0", 300_000, True, 300_000), ("2", 300_000, True, 300_000), ("0", 1500, True, 1500), ("1", 300_000, True, 300_000)]
    assert most < hold + 50_000 and [g[2] for g in salvage.gaps] == ["block length", "no record starts here", "block length"]
    assert sum(b - a for a, b, _ in salvage.gaps) == len(source.getbuffer()) - sum(len(p) for p in (parts[0], parts[1], parts[3], members(1)[0]))


def test_false_starts_cost_no_rescan():
    """A damaged stretch of false magics: what is searched is looked at once."""
    false = b"\x1f\x8b\x08" * 200_000
    m = members(2)
    began = time.time()
    found = warc.Salvage(Counting(m[0] + false + m[1]))
    assert len(list(found)) == 2 and len(found.gaps) == 1 and time.time() - began < 30


@pytest.mark.parametrize(
    "rows",
    [[(1, "B"), (2, "A"), (2, "B")], [(3, "C"), (4, "D"), (5, "C"), (5, "D")], [(1, "A"), (1, "A"), (1, "B"), (0, "B"), (2, None), (2, ""), (2, "B"), (None, "B"), (None, None)]],
)
def test_ids_with_several_payloads(spark, tmp_path, rows):
    """A row per row, and every payload can be read."""
    pages = spark.createDataFrame([(i, "u", t, "x") for i, t in rows], "page_id long, url string, html string, sha string").repartition(2)
    records = warc.read_archives(spark, warc.write_archives(pages, f"file://{tmp_path}/w"), with_payload=True)
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = [(None if i is None else str(i), len(t or ""), warc.base32_sha1((t or "").encode()), "response" if i in (None, first[t or ""]) else "revisit", None if i in (None, first[t or ""]) else str(first[t or ""])) for i, t in rows]
    assert sorted(map(tuple, warc.resolve(records, pages).collect()), key=repr) == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in records.where("kind = 'response'").collect()} == {t or "" for _, t in rows}
    # without the responses every row is still there
    lost = warc.resolve(records.where("kind <> 'response'"), pages).where("page_id is not null").collect()
    assert sorted(r.page_id for r in lost) == sorted(str(i) for i, _ in rows if i is not None)


def test_lost_records_are_named(spark, tmp_path):
    pages = spark.createDataFrame([("a b", "u", "same"), (" lead\n", "u", "same"), ("", "u", "empty id"), ("gone", "u", "only here"), (None, "u", "x")], "page_id string, url string, html string")
    manifest = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    records = warc.read_archives(spark, manifest).where("page_id is null or page_id not in (' lead\n', 'gone')")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve(records, pages).collect()}
    assert got == {("a b", "revisit", " lead\n", None), (" lead\n", "lost", None, None), ("gone", "lost", None, None), ("", "response", None, 8), (None, "response", None, 1)}
