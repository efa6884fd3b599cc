from strandline.operators.reads import augmented, augmented_ops


def test_augmented(spark):
    assert augmented_ops("2S4M1I3M2D2M", "2A4^GT2", "NNACGTTCCCAA", "") == [
        (2, "S", "", "NN"), (2, "=", "AC", "AC"), (1, "X", "A", "G"), (1, "=", "T", "T"), (1, "I", "", "T"), (3, "=", "CCC", "CCC"), (2, "D", "GT", ""), (2, "=", "AA", "AA")
    ]
    rows = [("2S4M1I3M2D2M", "NNACGTTCCCAA", "I" * 12, {"MD": "2A4^GT2"}), ("4M", "ACGT", "II!I", {"MD": "2A1"}), ("3M", "ACG", "III", {})]
    df = spark.createDataFrame(rows, "cigar string, seq string, qual string, tags map<string,string>")
    assert sorted(r.mismatches for r in augmented(df).collect()) == [0, 0, 3]
