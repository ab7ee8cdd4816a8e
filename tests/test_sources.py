import codecs
import random

import pytest
from pyspark.sql import functions as F

from tillscope.sources import csv_text, sinks
from tillscope.sources.extracts import sample_customers


def write(tmp_path, data: bytes, name="f.csv"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def test_encodings(spark, tmp_path):
    assert csv_text.encoding_of(spark, write(tmp_path, "a,b\nü,1\n".encode(), "u8.csv")) == "UTF-8"
    assert csv_text.encoding_of(spark, write(tmp_path, codecs.BOM_UTF8 + b"a,b\n1,2\n", "bom.csv")) == "UTF-8"
    assert csv_text.encoding_of(spark, write(tmp_path, "a,b\nü,1\n".encode("latin-1"), "l1.csv")) == "ISO-8859-1"
    assert csv_text.encoding_of(spark, write(tmp_path, "a,b\n1,2\n".encode("utf-16"), "u16.csv")) == "UTF-16"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    text = "\n".join([sep.join(["id", "name", "qty"]), sep.join(["1", '"a,b;c"', "2"]), sep.join(["2", "x", "3"])]) + "\n"
    df = csv_text.read_text_csv(spark, write(tmp_path, text.encode(), "d.csv"))
    assert df.columns == ["line_no", "id", "name", "qty"]
    assert [tuple(r) for r in df.orderBy("line_no").collect()] == [(0, "1", "a,b;c", "2"), (1, "2", "x", "3")]


def test_only_the_tokens_are_missing(spark, tmp_path):
    df = csv_text.read_text_csv(spark, write(tmp_path, b"a,b\nNA,1\n  ,N/A\nnull,x\nnone,\n", "m.csv"))
    assert [tuple(r) for r in df.orderBy("line_no").select("a", "b").collect()] == [(None, "1"), ("  ", None), (None, "x"), ("none", None)]


def test_refusals(spark, tmp_path):
    with pytest.raises(csv_text.EmptyFile):
        csv_text.read_text_csv(spark, write(tmp_path, b"a,b\n", "h.csv"))
    with pytest.raises(csv_text.UnreadableFile):
        csv_text.read_text_csv(spark, write(tmp_path, b"a,b\n1,2,3\n4,5,6\n", "x.csv"))
    ok = csv_text.read_text_csv(spark, write(tmp_path, b"a,b\n1,2,\n4,5,\n", "t.csv"))
    assert ok.columns == ["line_no", "a", "b"] and ok.count() == 2


def test_longer_rows_never_lose_data(spark, tmp_path):
    for i, body in enumerate(("a,b\n1,2,,X\n", "a,b\n1,2\n3,4,,\n", "a,b\n1,2\n3,4,\"x\"\n")):
        with pytest.raises(csv_text.UnreadableFile):
            csv_text.read_text_csv(spark, write(tmp_path, body.encode(), f"long{i}.csv"))
    short = csv_text.read_text_csv(spark, write(tmp_path, b"a,b\n" + b"1,2\n" * 30 + b"3\n", "short.csv"))
    assert (short.count(), short.filter("b is null").count()) == (31, 1)


def test_files_of_a_folder_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "three"
    folder.mkdir()
    write(folder, b"a,b\n1,2\n", "f1.csv")
    write(folder, b"b;a\n20;10\n", "f2.csv")
    write(folder, "b|a\nü|é\n".encode("latin-1"), "f3.csv")
    write(folder, "a,b\n漢,字\n".encode("utf-16"), "f4.csv")
    df = csv_text.read_text_csv(spark, str(folder))
    assert {(r.a, r.b) for r in df.collect()} == {("1", "2"), ("10", "20"), ("é", "ü"), ("漢", "字")}
    assert sorted(r.line_no for r in df.collect()) == [0, 1, 2, 3]
    write(folder, b"a,c\n1,2\n", "f5.csv")
    with pytest.raises(csv_text.UnreadableFile):
        csv_text.read_text_csv(spark, str(folder))


def test_delimiter_told_late_and_utf16_in_many_tasks(spark, tmp_path):
    late = "a,b;c\n" + "1,2;3\n" * 300 + "1,2\n" * 100
    assert csv_text.read_text_csv(spark, write(tmp_path, late.encode(), "late.csv")).columns == ["line_no", "a", "b;c"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for kind in ("utf-16-le", "utf-16-be"):
            mark = codecs.BOM_UTF16_LE if kind.endswith("le") else codecs.BOM_UTF16_BE
            path = write(tmp_path, mark + ("n,x\r\n" + "".join(f"{i},é\r\n" for i in range(6000))).encode(kind), f"{kind}.csv")
            df = csv_text.read_text_csv(spark, path)
            assert df.count() == 6000 and df.filter("cast(n as bigint) <> line_no or x <> 'é'").count() == 0
            assert csv_text._lines(spark, path, "UTF-16LE" if kind.endswith("le") else "UTF-16BE").rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, b'a,b\n"x\ny",1\nz,2\n', "ml.csv")
    df = csv_text.read_text_csv(spark, path)
    assert [tuple(r) for r in df.orderBy("line_no").collect()] == [(0, "x\ny", "1"), (1, "z", "2")]
    with pytest.raises(csv_text.UnreadableFile):
        csv_text.read_text_csv(spark, write(tmp_path, b'a,b\n"x\ny",1,,,5\n', "ml2.csv"))
    with pytest.raises(csv_text.UnreadableFile):
        csv_text.read_text_csv(spark, write(tmp_path, b'a,b\n"x\ny,1\nz,2\n', "never.csv"))
    header = csv_text.read_text_csv(spark, write(tmp_path, b'"a\nb";c\r\n1;"2\r\n\r\n;3"\r\n\r\n4;5\r\n', "head.csv"))
    assert header.columns == ["line_no", "a\nb", "c"]
    assert [tuple(r) for r in header.orderBy("line_no").collect()] == [(0, "1", "2\r\n\r\n;3"), (1, "4", "5")]
    ten = b"id,note,n\n" + b"".join(b"%d,plain,%d\n" % (i, i) for i in range(40)) + b'40,"two\nlines",40\n'
    df = csv_text.read_text_csv(spark, write(tmp_path, ten, "one.csv"))
    assert df.count() == 41 and df.filter("id = '40'").first()["note"] == "two\nlines"
    old = csv_text.read_text_csv(spark, write(tmp_path, b'a,b\r1,"x\ry"\r2,z\r', "cr.csv"))
    assert [tuple(r) for r in old.orderBy("line_no").collect()] == [(0, "1", "x\ry"), (1, "2", "z")]


def test_quotes_that_are_letters(spark, tmp_path):
    body = b'size,n\n5" pipe,1\n6" pipe,2\n"a ""b"" c",3\n"",4\n"""",5\n7"",6\n"x"y"z,7\n'
    df = csv_text.read_text_csv(spark, write(tmp_path, body, "inch.csv"))
    assert [r["n"] for r in df.orderBy("line_no").collect()] == [str(i) for i in range(1, 8)]
    assert [r["size"] for r in df.orderBy("line_no").collect()][:6] == ['5" pipe', '6" pipe', 'a "b" c', None, '"', '7""']


def random_csv(rng, rows, newline):
    """(bytes, cells) of a file with plain, quoted and broken cells."""
    cells, lines = [], []
    for i in range(rows):
        note = "".join(rng.choice(["word ", "x", ",", ";", '"', newline, newline * 2, "é", "|"]) for _ in range(rng.choice([0, 1, 3, 8, 40])))
        note = "n" + note + "n" if rng.random() < 0.4 else "plain"
        quoted = any(c in note for c in ',;"|\n\r') or rng.random() < 0.2
        cells.append((i, str(i), note, str(rng.randrange(9))))
        lines.append(f'{i},"' + note.replace('"', '""') + f'",{cells[-1][3]}' if quoted else f"{i},{note},{cells[-1][3]}")
    return (newline.join(["id,note,k", *lines]) + newline).encode(), cells


def test_quoted_records_cross_many_blocks(spark, tmp_path):
    rng = random.Random(11)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for newline in ("\n", "\r\n"):
        data, cells = random_csv(rng, 500, newline)
        path = write(tmp_path, data, f"q{len(newline)}.csv")
        for size in ("400", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                found = sorted(tuple(r) for r in csv_text.read_text_csv(spark, path).collect())
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            assert found == cells


def test_a_long_quoted_cell_spans_blocks(spark, tmp_path):
    text = "\n".join(f"line {i}, and \"\"more\"\"" for i in range(1_000))
    path = write(tmp_path, f'a,b\n1,"{text}"\n2,z\n'.encode(), "span.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = csv_text.read_text_csv(spark, path).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in rows] == [(0, "1", text.replace('""', '"')), (1, "2", "z")]


def test_a_folder_of_plain_and_broken_files(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder, b"a,b\n1,2\n3,4\n", "f1.csv")
    write(folder, b'b;a\n"20\n21";10\n', "f2.csv")
    write(folder, 'a,b\n"\u6f22\n\u5b57",x\n'.encode("utf-16"), "f3.csv")
    df = csv_text.read_text_csv(spark, str(folder))
    assert {(r.a, r.b) for r in df.collect()} == {("1", "2"), ("3", "4"), ("10", "20\n21"), ("\u6f22\n\u5b57", "x")}
    assert sorted(r.line_no for r in df.collect()) == [0, 1, 2, 3]


def test_no_share_of_lines_may_contradict_the_delimiter(spark, tmp_path):
    for i, body in enumerate((b"a,b\n" + b"1,2\n" * 99 + b"1,2,3\n", b"a,b;c\n" + b"1;2\n" * 5 + b"1,2,3;4;5\n", b"a,b\n1;2\n3;4\n")):
        with pytest.raises(csv_text.UnreadableFile):
            csv_text.read_text_csv(spark, write(tmp_path, body, f"no{i}.csv"))


def test_line_numbers_follow_many_blocks(spark, tmp_path):
    body = "n\n" + "\n".join(str(i) for i in range(20000)) + "\n"
    path = write(tmp_path, body.encode(), "big.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = csv_text.read_text_csv(spark, path, sep=",", encoding="UTF-8")
        assert df.rdd.getNumPartitions() > 1
        assert df.filter("cast(n as bigint) <> line_no").count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_do_not_move_the_rows(spark, tmp_path):
    """A scan block's offset is told to the tasks that read it; no row meets its block in another task."""
    df = csv_text.read_text_csv(spark, write(tmp_path, b"n,m\n1,2\n3,4\n", "few.csv"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [(r.line_no, r.n) for r in df.orderBy("line_no").collect()] == [(0, "1"), (1, "3")]


def test_cleaned_csv_round_trip(spark, tmp_path):
    df = spark.sql("select * from values (0L, timestamp_ntz'2024-01-05 00:00:00', timestamp_ntz'2024-01-05 10:30:00', 'x'), (1L, null, null, 'y') as t(line_no, d, t, s)")
    assert sinks.date_patterns(df) == {"d": "yyyy-MM-dd", "t": "yyyy-MM-dd'T'HH:mm:ss"}
    sinks.write_cleaned_csv(df, str(tmp_path / "out"))
    back = csv_text.read_text_csv(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in back.orderBy("line_no").select("d", "t", "s").collect()] == [("2024-01-05", "2024-01-05T10:30:00", "x"), (None, None, "y")]


def test_samples_keep_whole_customers(spark):
    df = spark.createDataFrame([(f"c{i % 40}" if i % 7 else None, f"inv{i // 3}", i) for i in range(600)], "customer string, invoice string, i int")
    got = sample_customers(df, 0.3, "customer", "invoice", ["c39"], "customer", 5).collect()
    kept = {r.customer for r in got if r.customer}
    assert "c39" in kept and 3 < len(kept) < 30
    assert sum(r.customer in kept for r in df.collect() if r.customer) == sum(1 for r in got if r.customer)


def test_results_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "results")
    assert sinks.published(spark, folder) == {}
    with pytest.raises(ValueError, match="no published table"):
        sinks.read_results(spark, folder, "a")
    with pytest.raises(ValueError, match="needs a table"):
        sinks.write_results({}, folder)
    sinks.write_results({"a": spark.range(3), "b": spark.range(2)}, folder)
    bad = spark.range(5).withColumn("x", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_results({"a": spark.range(7), "b": bad}, folder)
    assert (sinks.read_results(spark, folder, "a").count(), sinks.read_results(spark, folder, "b").count()) == (3, 2)
    sinks.write_results({"a": spark.range(7)}, folder, "json")
    assert sinks.read_results(spark, folder, "a").count() == 7 and list(sinks.published(spark, folder)) == ["a"]


def test_only_quoted_lines_are_taken_apart(spark, tmp_path, monkeypatch):
    """Whether a quote stays open is asked of lines that hold one; the others are never split at quotes."""
    def opens(line, inside, seps):
        return F.when(F.contains(line, F.lit('"')), F.endswith(line, F.lit("open"))).otherwise(F.raise_error(line).cast("boolean"))

    monkeypatch.setattr(csv_text, "_opens", opens)
    plain, broken = write(tmp_path, b"n,m\n1,2\n", "plain.csv"), write(tmp_path, b'n,m\n1,"open\n2"\n', "broken.csv")
    assert [f.split("/")[-1] for f in csv_text._breaking(spark, [plain, broken], "UTF-8")] == ["broken.csv"]
