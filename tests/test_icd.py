import random
import tempfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from wirelens.operators import icd
from wirelens.sources.documents import read_icd_tables

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
HEAD = ["Field Name", "Byte Offset", "Data Type", "Length", "Resolution", "Description"]


def cell(text, extra=""):
    return f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def grid(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(cell(c) for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def para(text, inside=""):
    return f"<w:p>{inside}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(path, name, *parts):
    xml = f'<w:document xmlns:w="{NS}"><w:body>{"".join(parts)}</w:body></w:document>'
    with zipfile.ZipFile(f"{path}/{name}.docx", "w") as z:
        z.writestr("word/document.xml", xml)


def row(name, off, kind, length, res="1"):
    return [name, str(off), kind, str(length), res, "text"]


def corpus():
    path = tempfile.mkdtemp(prefix="wirelens-", dir="/tmp")
    track = [row("Sync", 1, "Uint16", 2), row("MessageID", 3, "Uint8", 1), row("TrackNumber", 4, "Uint16", 2), row("Latitude", 6, "Int32", 4, "0.0000001"),
             row("Longitude", 10, "Int32", 4, "0.0000001"), row("Altitude", 14, "Float32", 4), row("Speed", 18, "Uint16", 2, "0.01"), row("Status", 20, "Uint8", 1)]
    status = [row("Sync", 1, "Uint16", 2), row("MessageID", 3, "Uint8", 1), row("Mode", 4, "Uint8", 1), row("Temperature", 5, "Int16", 2, "0.1"), row("Voltage", 7, "Uint16", 2, "0.01")]
    docx(path, "radar", para("ICD"), para("Track Report Message"), grid([HEAD, *track]), para(""), para("System Status Message"), grid([HEAD, *status]))
    types = ["Uint8", "Int8", "Uint16", "Int16", "Uint32", "Int32", "Uint64", "Int64", "Float32", "Float64", "Bool", "String"]
    sizes, at, every = [1, 1, 2, 2, 4, 4, 8, 8, 4, 8, 1, 6], 1, []
    for t, n in zip(types, sizes):
        every.append(row(f"f_{t}", at, t, n))
        at += n
    docx(path, "types", para("AllTypes Message"), grid([HEAD, *every]))
    docx(path, "scaled", para("Sensor"), grid([HEAD, row("Pressure", 1, "Uint16", 2, "0.01"), row("Heading", 3, "Uint16", 2, "0.0055"), row("RateOfTurn", 5, "Int16", 2, "1/3"), row("Depth", 7, "Int32", 4, "0.001")]))
    docx(path, "lenient", para("Loose Message"), grid([HEAD, row("Alpha", 1, "Uint8", 1), row("", 2, "Uint8", 1), row("Beta", 3, "", 1), row("Alpha", 4, "Uint8", 1), row("Gamma", 5, "Uint8", 1)]))
    docx(path, "cont", para("Long Message"), grid([HEAD, row("Sync", 1, "Uint16", 2), row("Id", 3, "Uint8", 1), row("FieldA", 4, "Uint16", 2)]),
         para("Long Message (cont.)"), grid([HEAD, row("FieldB", 6, "Uint16", 2), row("FieldC", 8, "Uint32", 4), row("FieldD", 12, "Uint16", 2)]))
    docx(path, "restart", para("Same"), grid([HEAD, row("A", 1, "Uint16", 2), row("B", 3, "Uint16", 2)]), grid([HEAD, row("C", 1, "Uint32", 4), row("A", 5, "Uint8", 1)]),
         para("Same"), grid([HEAD, row("D", 1, "Uint8", 1)]))
    docx(path, "words", para("WordBlock"), grid([["Field Name", "Word Offset", "Data Type", "Length", "Resolution", "Description"], *[row(f"Word{c}", i, "Uint16", 2) for i, c in enumerate("ABCD", 1)]]))
    brk = '<w:r><w:br w:type="page"/></w:r>'
    nested = f"<w:tbl><w:tr><w:tc>{para('out ')}{grid([['in']])}{para(' side')}</w:tc>{cell('wide', '<w:gridSpan w:val=' + chr(34) + '3' + chr(34) + '/>')}</w:tr></w:tbl>"
    docx(path, "layout", para("One"), grid([["a"]]), grid([["b"]]), para("Two", brk), nested, para("", "<w:pPr><w:pageBreakBefore w:val='false'/></w:pPr>"), grid([["c"]]))
    docx(path, "none", para("only text"))
    with open(f"{path}/broken.docx", "wb") as f:
        f.write(b"not a zip")
    return path


def by_doc(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r.doc.rsplit("/", 1)[-1][:-5], []).append(key(r))
    return {k: sorted(v) for k, v in out.items()}


def test_documents_to_messages(spark):
    tables, errors = read_icd_tables(spark, corpus())
    tables = tables.persist()
    assert by_doc(errors.collect(), lambda r: r.error) == {"none": ["no tables"], "broken": ["not a readable document: BadZipFile"]}
    layout = tables.filter(F.col("doc").endswith("layout.docx"))
    got = [(r.table_idx, r.heading, r.page, r.table_on_page, r.cells) for r in layout.orderBy("table_idx").collect()]
    assert got == [(0, "One", 1, 1, ["a"]), (1, "", 1, 2, ["b"]), (2, "Two", 2, 1, ["out side", "wide", "", ""]), (3, "", 2, 2, ["c"])]
    docs = tables.filter(~F.col("doc").endswith("layout.docx"))
    messages = by_doc(icd.strict_messages(docs).collect(), lambda r: (r.message, r.payload_len, r.n_fields))
    assert messages == {
        "radar": [("System Status Message", 8, 5), ("Track Report Message", 20, 8)],
        "types": [("AllTypes Message", 49, 12)],
        "scaled": [("Sensor", 10, 4)],
        "lenient": [("Loose Message", 5, 3)],
        "cont": [("Long Message", 13, 6)],
        "restart": [("Same", 9, 4), ("Same_2", 1, 1)],
        "words": [("WordBlock", 5, 4)],
    }
    fields, warnings = icd.strict_fields(docs)
    rows = fields.collect()
    names = by_doc(rows, lambda r: (r.parent_idx, r.ord, r.name, r.off0))
    assert [n for _, _, n, _ in names["lenient"]] == ["Alpha", "Alpha_2", "Gamma"]
    assert names["restart"][:4] == [(0, 0, "A", 0), (0, 1, "B", 2), (0, 2, "C", 4), (0, 3, "A_2", 8)]
    scaled = {r.name: (r.resolution, r.type) for r in rows if "scaled" in r.doc}
    assert scaled["Pressure"] == (0.01, "Uint16") and scaled["RateOfTurn"][0] == 1.0
    assert by_doc(warnings.collect(), lambda r: r.warning) == {"lenient": ["unknown type; row skipped"], "scaled": ["resolution is not numeric; 1 used"]}
    types = [r.type for r in sorted((r for r in rows if "types" in r.doc), key=lambda r: r.ord)]
    assert types == ["Uint8", "Int8", "Uint16", "Int16", "Uint32", "Int32", "Uint64", "Int64", "Float32", "Float64", "Bool", "String"]
    lenient = docs.filter(F.col("doc").endswith("lenient.docx"))
    drafts, notes = icd.loose_fields(lenient)
    final = icd.finalise_fields(drafts).orderBy("row_no").collect()
    assert [(r.name, r.offset, r.type, r.len) for r in final] == [
        ("Alpha", 1, "Uint8", 1), ("field_2", 2, "Uint8", 1), ("Beta", 3, "RawUnsignedBE", 1), ("Alpha_2", 4, "Uint8", 1), ("Gamma", 5, "Uint8", 1)]
    assert [r.warning for r in notes.collect()] == ["name is empty"]
    tables.unpersist()


def cells(spark, rows, heading="H"):
    return spark.createDataFrame([("d", 0, heading, i, r) for i, r in enumerate(rows)], "doc string, table_idx int, heading string, row_idx int, cells array<string>")


def test_header_profile_and_roles(spark):
    rows = [["Table of fields"], ["Ofs", "Signal", "Format", "Size", "LSB", "Scaling formula"], ["0", "n1", "int", "4", "1", "x"], ["4", "n2", "float", "4", "2", "y"],
            ["", " ", "", "", "", ""], ["0x08", "n3", "Uint16", "2 bytes", "z", ""]]
    df = cells(spark, rows)
    head = icd.header_row(df).first()
    assert (head.header_row, head.n_cols) == (1, 6)
    stats = {r.col: r for r in icd.column_profile(df, chunk=2).collect()}
    assert (stats[0].non_empty, stats[0].numeric, stats[0].min_int, stats[0].max_int, stats[0].non_decreasing) == (3, 3, 0, 8, True)
    assert (stats[2].type_like, stats[3].numeric, stats[3].non_decreasing, stats[4].numeric, stats[5].non_empty) == (3, 3, False, 2, 2)
    roles = icd.column_roles(icd.column_profile(df)).first()
    assert (roles.name_col, roles.offset_col, roles.type_col, roles.length_col, roles.resolution_col, roles.expression_col, roles.offset_base) == (1, 0, 2, 3, 4, 5, 0)
    ints = spark.createDataFrame([(t,) for t in ("5", "0x0A", "Byte 5", "-3..2", "0xZZ 7", "99999999999", "", "x")], "t string").coalesce(1)
    assert [r[0] for r in ints.select(icd.leading_int(F.col("t"))).collect()] == [5, 10, 5, -3, 0, None, None, None]


def test_sizes_extents_and_repeated_headers(spark):
    rows = [["Name", "Offset", "Type", "Length"], ["a", "", "uint8", ""], ["b", "", "Unsigned Integer", "2"], ["Name", "Offset", "Type", "Length"], ["c", "", "float", "8"]]
    mapping = spark.createDataFrame([("d", 0, 0, 1, 2, 3, -1, -1, 1)], "doc string, table_idx int, name_col int, offset_col int, type_col int, length_col int, resolution_col int, expression_col int, offset_base int")
    drafts, notes = icd.loose_fields(cells(spark, rows), mapping, from_size=True, start_byte=5)
    got = [(r.name, r.offset, r.len, r.type, r.type_label) for r in drafts.orderBy("row_idx").collect()]
    assert got == [("a", None, None, "Uint8", "uchar"), ("b", 5, 2, "Uint32", "uint"), ("c", 7, 8, "Float32", "float")]
    assert [r.warning for r in notes.collect()] == ["size unknown; offset left empty"]


def free_names(rows, fold):
    """Names by their definition, in order."""
    used, out = {}, []
    for message, order, name in sorted(rows, key=lambda r: (r[0], r[1])):
        taken = used.setdefault(message, set())
        key = (lambda s: s.lower()) if fold else (lambda s: s)
        chosen = name if key(name) not in taken else next(f"{name}_{n}" for n in range(2, 1 << 30) if key(f"{name}_{n}") not in taken)
        taken.add(key(chosen))
        out.append((message, order, chosen))
    return out


@pytest.mark.parametrize("fold", [False, True])
def test_unique_names_of_random_families(spark, fold):
    rng = random.Random(9)
    rows = []
    for message in "xyz":
        for i in range(300):
            name = rng.choice("aAbéÉ") + "".join(f"_{rng.choice(['2', '3', '02', '10'])}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))
            rows.append((message, i * 7 % 300, name if rng.random() < 0.97 else "_2"))
    df = spark.createDataFrame([(*r, [1], "f") for r in rows], "message string, ord long, name string, list array<int>, `_x` string").repartition(5)
    got = icd.unique_names(df, ["message"], "ord", "name", fold)
    assert got.columns == df.columns
    assert sorted((r.message, r.ord, r.name) for r in got.collect()) == sorted(free_names(rows, fold))


def test_unique_names_of_ten_thousand_clashes(spark):
    """Every second name is a numbered form that is taken already: linear, not a search from 2 for each."""
    names = ["a" if i % 2 else f"a_{i}" for i in range(20_000)]
    df = spark.createDataFrame([("m", i, n) for i, n in enumerate(names)], "message string, ord long, name string")
    start = time.perf_counter()
    got = [r.name for r in icd.unique_names(df, ["message"], "ord", "name").orderBy("ord").collect()]
    assert time.perf_counter() - start < 20
    assert len(set(got)) == len(names)
    held = icd._FreeNames()
    start = time.perf_counter()
    assert [held.take(n, n) for n in names] == got and time.perf_counter() - start < 0.5


def test_unique_names_skip_taken_suffixes(spark):
    df = spark.createDataFrame([("m", i, n) for i, n in enumerate(["a", "a_2", "a", "A", "a"])], "message string, ord int, name string")
    assert [r.name for r in icd.unique_names(df, ["message"], "ord", "name").orderBy("ord").collect()] == ["a", "a_2", "a_3", "A", "a_4"]
    assert [r.name for r in icd.unique_names(df, ["message"], "ord", "name", True).orderBy("ord").collect()] == ["a", "a_2", "a_3", "A_4", "a_5"]


def test_enumerations_in_prose(spark):
    cases = {
        "0 = Off, 1 = On": ([0], {0: "Off,", 1: "On"}),
        "0x00: Idle 0x1F - Busy range 0-359 deg": ([0, 1, 2, 3, 4], {0: "Idle", 31: "Busy range"}),
        "1) one 2) two 2) again 300: more": ([0, 1], {1: "one", 2: "two"}),
        "0-359.9 deg": None,
        "1=one": None,
        "0=a" + "b" * 200 + " 4–four": ([0, 1, 2], {0: "a" + "b" * 116 + "...", 4: "four"}),
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", icd.enum_rules(F.col("t"), F.lit("")).alias("r"))
    got = {r.t: r.r and (r.r.positions, dict(r.r.meanings)) for r in df.collect()}
    assert got == cases
    assert df.filter("r is not null").first().r.label == "ENUM"


def test_mined_definitions_keep_resolution(spark):
    from wirelens.operators.decode import decode_fields
    from wirelens.plans.definitions import messages_from_icd

    fields = spark.createDataFrame(
        [("d", "m", "Pressure", 0, 2, "Uint16", 0.01, "1/100"), ("d", "m", "Plain", 2, 1, "Uint8", None, None)],
        "doc string, message string, name string, off0 int, len int, type string, resolution double, expression string",
    )
    messages = spark.createDataFrame([("d", "m", 3)], "doc string, message string, payload_len int")
    (found,) = messages_from_icd(messages, fields)
    assert [(f.resolution, f.expression) for f in found.fields] == [(0.01, "1/100"), (1.0, "1")]
    row = decode_fields(spark.createDataFrame([(bytearray(b"\x09\xc4\x07"),)], "payload binary"), found, values_only=True).first()
    assert abs(row.Pressure - 25.0) < 1e-9 and row.Plain == 7
    (bare,) = messages_from_icd(messages, fields.drop("resolution", "expression"))
    assert bare.fields[0].resolution == 1.0
