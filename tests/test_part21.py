import random

import pytest
from pyspark.sql import functions as F
from refweave.functions import part21 as p21
from refweave.sources import binary, part21

TEXT = b"""ISO-10303-21;
HEADER;
ENDSEC;
DATA;
#40=MEMBER('semi;colon ''#41'' x',
 #55,#56);
#55=(LEFT(#40)RIGHT('y',/* not #77 */$));
#56=EDGE_LOOP('',(#40,#40,#55));
ENDSEC;
"""


def test_records():
    got = list(part21.records(TEXT, part21.data_start(TEXT)))
    assert [(r[1], r[2], r[5]) for r in got] == [(40, "MEMBER", [55, 56]), (55, "CPLX", [40]), (56, "EDGE_LOOP", [40, 40, 55])]
    assert got[0][4] == b"#40=MEMBER('semi;colon ''#41'' x',\n #55,#56);"
    for bad in (b"\nDATA;\n#1=A('x", b"\nDATA;\n#1=A(/* x", b"\nDATA;\n#1=A(#2)"):
        with pytest.raises(part21.Unterminated):
            list(part21.records(bad))


def test_source_splits_nowhere_matter(spark, tmp_path):
    rng = random.Random(1)
    lines = []
    for i in range(1, 400):
        refs = ",".join(f"#{rng.randrange(1, 400)}" + ("\n" if rng.random() < 0.2 else "") for _ in range(rng.randrange(5)))
        lines.append(f"#{i}=T{i % 7}('n;{i}''',({refs}));" + ("" if rng.random() < 0.1 else "\n"))
    body = "ISO-10303-21;\nDATA;\n" + "".join(lines) + "\nENDSEC;\n"
    (tmp_path / "a.stp").write_text(body)
    want = [(r[0], r[1], r[2], r[5]) for r in part21.records(body.encode(), part21.data_start(body.encode()))]
    assert len(want) == 399
    spark.dataSource.register(part21.Part21)
    for chunk in (100, 777, 1 << 20):
        rows = spark.read.format("part21").option("path", str(tmp_path / "*.stp")).option("chunk", chunk).load().orderBy("row").collect()
        assert [(r.row, r.id, r.type, r.refs) for r in rows] == want
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert part21.scan(files).count() == 399
    parts = part21.scan(files).withColumn("part", F.col("type")).select("part", "row", "text")
    told = {r.part: r for r in part21.part_text(parts, "DATA;\n", "\nENDSEC;").collect()}
    assert sum(r.entities for r in told.values()) == 399 and all(len(r.content.encode()) == r.bytes for r in told.values())
    assert [x[1] for x in part21.records(("\n" + told["T3"].content).encode())] == list(range(3, 400, 7))


def test_strings():
    assert p21.decode_string("don''t") == "don't" and p21.decode_string("\\X2\\03B103B2\\X0\\!") == "αβ!" and p21.decode_string("\\X\\DF") == "ß"
    assert p21.decode_string("\\X2\\03") == "\\X2\\03" and p21.first_string("'5'' pipe',.T.") == "5' pipe" and p21.first_string("$,'late'") is None
    for text in ("it's", "αβ ß x", "back\\slash", ""):
        assert p21.decode_string(p21.leading_string(p21.encode_string(text))).replace("\\\\", "\\") == text
    assert p21.numbers("'',(-7.5,4E1,.5,8.))", 3) == [-7.5, 40.0, 0.5] and p21.numbers("+ 3e 6", 9) == [6.0]
    assert p21.first_argument("\t.UNSPECIFIED. ,$") == ".UNSPECIFIED."


def test_lists_and_names():
    assert p21.reference_list("( #90,#7 , #7 ),$") == (15, [90, 7, 7]) and p21.reference_list("(#90,$)") is None
    assert p21.file_name("left plate", 31) == "left_plate-31.stp" and p21.file_name("??", 8) == "unnamed-8.stp"
    out = p21.wrapped_list(list(range(1000, 1040)))
    assert p21.reference_list(out)[1] == list(range(1000, 1040)) and max(map(len, out.split("\n"))) <= 74
    assert p21.remap("PAIR(#11,'#12 it''s',/*#13*/#14,#15)", {11: 1, 12: 2, 13: 3, 14: 4}) == "PAIR(#1,'#12 it''s',/*#13*/#4,#15)"


NUMBERS = ["7.0", "70.E-1", ".7e+1", "0.", "-0.0", "+0.0e5", "-3.50", "81000.", "0.00620", "1.", "10.0", "-.5E-3", "123456789012345678901234567890.125"]


def test_exact_numbers():
    assert {p21.decimal_key(x) for x in NUMBERS[:3]} == {"real:7e0"} and p21.decimal_key("7") == p21.decimal_key("+07") == "whole:7"
    assert [p21.decimal_key(x) for x in NUMBERS[3:9]] == ["real:0e0", "real:-0e0", "real:0e0", "real:-35e-1", "real:81e3", "real:62e-4"]
    assert p21.decimal_key(NUMBERS[-1]) == "real:123456789012345678901234567890125e-3"
    for bad in ("", "+", ".", "e5", "1e", "1 ", "1.2.3"):
        with pytest.raises(ValueError):
            p21.decimal_key(bad)
    assert p21.direction_key(["0.", "-3.", "1.5"]) == "0,-2,1" != p21.direction_key(["0.", "6.", "-3."])
    with pytest.raises(ValueError):
        p21.direction_key(["0.", "0."])


def test_exact_numbers_as_a_column(spark):
    got = spark.createDataFrame([(x,) for x in NUMBERS], "x string").select("x", p21.decimal_key_column(F.col("x")).alias("key")).collect()
    assert [r.key for r in got] == [p21.decimal_key(r.x) for r in got]


def test_operands_are_lossless():
    text = "ARC_2D( 'it''s #1 (no)',#61 ,(-0.25,+8,.COUNTER_CLOCKWISE.,.5E2),$,*,\"3A\",CIRCLE_3(4.))/* 9 */;"
    parts = p21.operands(text)
    assert p21.rebuilt(parts) == text and [k for k, _ in parts[0]] == ["text", "ref", "real", "whole", "name", "real", "blank", "star", "bits", "real"]
    assert p21.canonical("KNOT ( 'k''1' ,/* c */ #61, 2.50,\n.T., 'a b' )", {61: "<p>"}, exact=True) == "KNOT('',#<p>,real:25e-1,.T.,'a b')"
    assert p21.canonical("KNOT(#61,'k')", {61: "<p>"}) == "KNOT(#<p>,'k')" and p21.canonical("KNOT('k',3)", {}, blank_name=False) == "KNOT('k',3)"


@pytest.mark.parametrize("seed", range(5))
def test_tokens_leave_no_gap(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("'\"#.+-eE_A9 0$*/(,)\n") for _ in range(400))
    assert "".join(x for _, x in p21.tokens(text)) == text


def test_columns_match_functions(spark):
    rows = [("'5'' pipe',#8", "left plate", 3), ("#8,.B. , 'late'", "", 5), ("'',(4.,-.5E1,6,-+,2e))", "__x  y__", 7)]
    frame = spark.createDataFrame(rows, "args string, name string, n int")
    got = frame.select(p21.first_string_column(F.col("args")).alias("s"), p21.first_argument_column(F.col("args")).alias("a"), p21.numbers_column(F.col("args")).alias("n"), p21.file_name_column(F.col("name"), F.col("n")).alias("f"), p21.udf_of(p21.first_string, "string")(F.col("args")).alias("d")).collect()
    for (args, name, n), r in zip(rows, got):
        assert r.s == p21.leading_string(args) and r.a == p21.first_argument(args) and r.n == p21.numbers(args) and r.f == p21.file_name(name, n) and r.d == p21.first_string(args)


def test_binary_formats():
    import hashlib

    import numpy as np

    points = np.arange(12, dtype="<f4").reshape(4, 3)
    doc = {"accessors": [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}], "bufferViews": [{"buffer": 0, "byteLength": 48}]}
    data = binary.glb_bytes(doc, points.tobytes())
    back, blob = binary.glb_parts(data)
    assert back == doc and (binary.accessor(back, blob, 0) == points).all()
    for broken in (data[:-4], b"x" + data[1:], data + b"\0\0\0\0"):
        with pytest.raises(ValueError):
            binary.glb_parts(broken)
    doc["accessors"][0]["count"] = 5
    with pytest.raises(ValueError):
        binary.accessor(doc, blob, 0)
    soup = np.random.default_rng(1).normal(size=(5, 3, 3)).astype("<f4")
    assert (binary.stl_triangles(binary.stl_bytes(soup)) == soup).all()
    members = {"a/b.txt": b"1", "c": b"22"}
    package, sums = binary.pack(members), {k: hashlib.sha256(v).hexdigest() for k, v in members.items()}
    assert dict(binary.unpack(package, sums)) == members and binary.pack(members) == package
    for bad, want in ((package[:-1], sums), (package + b"x", sums), (package, {"a/b.txt": sums["a/b.txt"]}), (package, sums | {"d": "0"})):
        with pytest.raises(Exception):
            list(binary.unpack(bad, want))
