"""Kinds of evidence files by their first bytes, their hashes and place, and listings."""

from __future__ import annotations

import hashlib

import pytest

from tracelake.sources import evidence


def mbr(status=0x80, kind=7):
    head = bytearray(512)
    head[446], head[450], head[510], head[511] = status, kind, 0x55, 0xAA
    return bytes(head)


FILES = {
    "case/a.E01": (b"EVF\x09\x0d\x0a\xff\x00rest", "e01_image"), "case/b/micro.pcap": (b"\xd4\xc3\xb2\xa1", "pcap"), "case/b/nano.pcap": (b"\xa1\xb2\x3c\x4d..", "pcap"), "case/b/ng": (b"\n\r\r\n", "pcap"),
    "case/mbr.dd": (mbr(), "raw_disk_image"), "case/empty_table.dd": (mbr(kind=0), "other"), "case/boot_sector.dd": (mbr(status=0x33), "other"), "case/gpt.dd": (bytes(512) + b"EFI PART", "raw_disk_image"), "case/none": (b"", "other"), "case2/x.txt": (b"text", "other"),
}


@pytest.fixture
def folder(tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_import(spark, folder):
    found = {r.path.split(f"{folder.name}/")[1]: r for r in evidence.read_evidence(spark, str(folder), f"file://{folder}/case").collect()}
    assert {n: (r.kind, r.size, r.sha256, r.contained) for n, r in found.items()} == {n: (kind, len(data), hashlib.sha256(data).hexdigest(), n.startswith("case/")) for n, (data, kind) in FILES.items() if data}
    plan = evidence.read_evidence(spark, str(folder), str(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_listing(spark, folder):
    rows = [tuple(r) for r in evidence.list_folder(spark, f"file://{folder}/case").collect()]
    assert rows[0] == ("b", "dir", None) and [r[0] for r in rows[1:]] == sorted(n.split("/")[1] for n in FILES if n.startswith("case/") and n.count("/") == 1 and FILES[n][0])
    assert [r.name for r in evidence.list_folder(spark, f"file://{folder}/case", "b", most=2).collect()] == ["micro.pcap", "nano.pcap"]
    with pytest.raises(ValueError):
        evidence.list_folder(spark, str(folder), "case/../case2")
