import pytest

from strandline.functions.filter_expr import apply_filters, compile_filter

SCHEMA = (
    "chrom string, pos int, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,string>, "
    "samples array<map<string,string>>"
)
ROWS = [
    ("1", 10, "rs1", "A", ["G"], 50.0, ["PASS"], {"DP": "100", "AF": "0.1,0.3"}, [{"GT": "0/1", "DP": "5", "GQ": "10"}, {"GT": "1/1", "DP": "30", "GQ": "99"}]),
    ("1", 20, None, "A", ["AT"], 10.0, ["LOW"], {"DP": "7"}, [{"GT": "0/0", "DP": "30", "GQ": "5"}, {"GT": "./.", "DP": ".", "GQ": "50"}]),
    ("2", 30, "rs3", "AC", ["GT", "A"], None, [], {}, [{"GT": "0/0", "DP": "8", "GQ": "60"}, {"GT": "0|2", "DP": "9", "GQ": "70"}]),
]


@pytest.mark.parametrize(
    "text, want",
    [
        ("QUAL > 20", [10]), ("QUAL = 10 || POS >= 30", [20, 30]), ('TYPE = "snp"', [10]), ('TYPE = "indel"', [20, 30]), ("INFO/DP > 50", [10]),
        ("AF > 0.2", [10, 30]), ("DP > 20 & GQ > 90", [10]), ("FMT/DP > 20 & FMT/GQ > 40", [10]), ("FMT/DP > 20 && FMT/GQ > 40", [10, 20]),
        ('GT = "het"', [10, 30]), ('GT = "mis"', [20]), ('GT = "aa"', [10]), ("N_MISSING = 1", [20]), ("MAX(FMT/DP) >= 30", [10, 20]), ("AVG(FMT/GQ) > 60", [30]),
        ("N_PASS(FMT/GQ > 40) = 2", [30]), ("F_PASS(FMT/GQ > 40) >= 0.5", [10, 20, 30]), ("N_ALT = 2", [30]), ('FILTER = "PASS"', [10]), ('ID ~ "^rs"', [10, 30]),
        ("%ILEN > 0", [20]), ("INFO/DP / 10 = 10", [10]), ("INFO/DP != 7", [10, 30]), ("BINOM(1, 1) = 1", [10, 20, 30]), ("INFO/AF[1] > 0.2", [10]), ("STRLEN(REF) = 2", [30]),
        ("MEDIAN(FMT/DP) = 8.5", [30]), ("ABS(QUAL - 50) < 1", [10]),
    ],
)
def test_filters(spark, text, want):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    # where a name is both an INFO and a FORMAT field the prefix decides
    column = compile_filter(text, {"AF0"}, {"DP", "GQ"})
    assert [r.pos for r in rows.filter(column).orderBy("pos").collect()] == want


@pytest.mark.parametrize("text", ["QUAL >", "QUAL", "(QUAL > 1", 'QUAL = "x"', "NOPE = 1", "QUAL ? 1", "FOO(QUAL) = 1"])
def test_malformed(text):
    with pytest.raises(ValueError):
        compile_filter(text)


def test_include_exclude(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.pos for r in apply_filters(rows, exclude="QUAL > 20").collect()] == [20, 30]
    with pytest.raises(ValueError):
        apply_filters(rows, "QUAL > 1", "QUAL > 2")
