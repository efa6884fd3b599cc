"""Rows and records of alignments: the same as before, in fewer steps and with bounded files."""

import pyarrow as pa
import pytest

from strandline.sources import packed

ROW = {
    "qname": "q1", "flag": 16, "chrom": "1", "pos": 8, "mapq": 30, "cigar": "8M3I9M", "rnext": "=", "pnext": 101, "tlen": 120, "seq": "ACGTNACGTTGCAACGTNA",
    "qual": "!I~" * 6 + "#", "tags": [("NH", "1"), ("RG", "g1")], "tag_types": [("NH", "i"), ("RG", "Z")],
}


def test_rows_of_a_slice_with_maps():
    rows = [ROW | {"qname": f"q{i}", "tags": [("NH", str(i))] * (i % 3 > 0)} for i in range(9)] + [ROW | {"tags": None}]
    batch = pa.RecordBatch.from_pylist(rows, packed.READS_ARROW)
    for part in (batch, batch.slice(4, 3), batch.slice(2, 0), batch.slice(8)):
        assert list(packed.rows_of(part)) == part.to_pylist()


def test_records_come_back_and_wrong_letters_do_not_pass():
    record = packed.alignment_record(ROW, {"1": 0, None: -1})
    assert packed.alignment(record[4:], ["1", None]) == ROW
    for wrong in ({"seq": "aCGT"}, {"seq": "0CGT"}, {"seq": "AC T"}, {"qual": "I I"}):
        with pytest.raises(ValueError):
            packed.alignment_record(ROW | wrong, {"1": 0, None: -1})


def test_a_partition_becomes_files_of_bounded_size():
    rows = [ROW | {"qname": f"q{i * 7919 % 10007}.{i}"} for i in range(6000)]
    files = list(packed.packed_files(iter(rows), ["1"], most=8_000))
    assert len(files) > 2 and max(map(len, files)) < 60_000
    assert [r["qname"] for f in files for r in packed.decode_alignments(f)] == [r["qname"] for r in rows]
    assert len(list(packed.packed_files(iter(rows), ["1"]))) == 1
    (empty,) = packed.packed_files(iter([]), ["1"])
    assert list(packed.decode_alignments(empty)) == []
