"""Files read by byte ranges give the rows of one reader over the whole file, wherever the ranges are cut."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.sources import readers, splits


@pytest.fixture
def small_ranges(spark):
    """Sets how many bytes a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield put
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def whole_csv(spark, path):
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return [tuple(v or "" for v in r) for r in df.collect()]


FIELDS = ["a", "", '""', '"x"', '"two\nlines"', '"a ""quoted"" word"', '"comma, inside"', 'mid"quote', '"\r\nCR"', "NA", "Hà Nội", '"\n"', '"a\n""\nb"', '"""start"', '"end"""', " lead", "tail ", '"long ' + "line\n" * 30 + '"', "😀"]


@pytest.mark.parametrize("seed", range(4))
def test_csv(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    end = {0: "\r\n", 3: "\r"}.get(seed, "\n")
    lines = ["one,two,three"] + [",".join(rng.choice(FIELDS) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(60)]
    if seed % 2:
        lines[10:10] = ["", ""]
    path = str(tmp_path / "f.csv")
    text = end.join(lines) + (end if seed % 2 else "")
    with open(path, "w", encoding="utf-8-sig" if seed == 2 else "utf-8", newline="") as f:
        f.write(text)
    small_ranges(10**9)
    want = whole_csv(spark, path)
    assert len(want) > 40
    for size in (10**9, 90):
        small_ranges(size)
        got = readers.read_csv(spark, path, "_index").orderBy("_index").collect()
        assert [r._index for r in got] == list(range(len(want)))
        assert [tuple(r)[:-1] for r in got] == want, size
    assert readers.read_csv(spark, path).columns == ["one", "two", "three"]


def test_csv_in_several_tasks(spark, tmp_path, small_ranges):
    path = str(tmp_path / "f.csv")
    with open(path, "w") as f:
        f.write("id,text\n" + "".join(f'{i},"text\nof {i}"\n' for i in range(2000)))
    small_ranges(2000)
    df = readers.read_csv(spark, path, "n")
    pieces = spark.read.option("lineSep", "\n").text(path)
    assert pieces.rdd.getNumPartitions() > 10
    assert df.where("id <> n or text <> concat('text\nof ', id)").count() == 0 and df.count() == 2000


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "o.csv").write_text('a,b\n1,"never closed\nx')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "o.csv")).collect()] == whole_csv(spark, str(tmp_path / "o.csv"))


def whole_json(spark, path, fields):
    kind = T.MapType(T.StringType(), T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("_index", "source_id", "r"))
    return [tuple(x) for x in rows.select("_index", "source_id", *[f"r.{f}" for f in fields]).orderBy("_index").collect()]


TEXTS = ["plain", "", "br}ace", "{", '"quoted"', "back\\slash", '\\"}', "Hà\nNội", "😀}", "a" * 300, "[", "}, {", '"}', "\\"]


@pytest.mark.parametrize("seed", range(3))
def test_json_records(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    records = {rng.choice(["", "k}", 'q"', "\\"]) + str(i): {"context": rng.choice(TEXTS), "claim": rng.choice([*TEXTS, None]), "other": {"deep": [{"x": "}"}, {}]}, **({"domain": "d"} if i % 3 else {})} for i in range(40)}
    (tmp_path / "a b é%").mkdir()
    path = str(tmp_path / "a b é%" / "f.json")
    text = json.dumps(records, ensure_ascii=bool(seed % 2), indent=None if seed % 3 else 2) + ("\n" if seed % 2 else "")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    want = whole_json(spark, path, ("context", "claim", "domain"))
    assert [(i, k) for i, k, *_ in want] == list(enumerate(records))
    for size in (10**9, 90):
        small_ranges(size)
        got = readers.read_json_records(spark, path, ("context", "claim", "domain")).orderBy("_index").collect()
        assert [tuple(r) for r in got] == want, size


@pytest.mark.parametrize("text", ["{}", ' {"a": {}} \n', '{"a": {"context": 5, "x": [{}, 1]}}', '{"a": null, "b": {"context": "x"}}\n'])
def test_json_at_its_edges(spark, tmp_path, small_ranges, text):
    (tmp_path / "f.json").write_text(text)
    want = whole_json(spark, str(tmp_path / "f.json"), ("context",))
    small_ranges(7)
    assert [tuple(r) for r in readers.read_json_records(spark, str(tmp_path / "f.json"), ("context",)).orderBy("_index").collect()] == want


@pytest.mark.parametrize("text", ['{"a": {"context": "x"}, "b": 5, "c": {"context": "y"}, "d": 6}', '{"a": 1}', "", " \n", "[1]", "5", '{"a": {"context": "x"}', '{"a": {"context": "x"} \n', '{"a": {"context": "x"}, ', '{"a": {"context": "x}}', '[{"a": {}}]', '{"a": {"context": "x"} "b": {"context": "y"}}', '{"a" {"context": "x"}}'])
def test_json_that_is_no_object_of_records(spark, tmp_path, small_ranges, text):
    (tmp_path / "f.json").write_text(text)
    small_ranges(5)
    with pytest.raises(Exception, match="not an object"):
        readers.read_json_records(spark, str(tmp_path / "f.json"), ("context",)).collect()


def test_folders(spark, tmp_path, small_ranges):
    """Files of a folder follow one another by name; each has its own header or braces."""
    small_ranges(40)
    (tmp_path / "c.csv").mkdir()
    (tmp_path / "j.json").mkdir()
    for k, name in enumerate(("part-0", "part-1", "part-2", "_SUCCESS")):
        rows = [(f"{k}{i}", f'"t\n{i}"') for i in range(6 * (k != 1))]
        if name[0] != "_":
            (tmp_path / "c.csv" / name).write_text("id,t\n" + "".join(f"{a},{b}\n" for a, b in rows))
            (tmp_path / "j.json" / name).write_text(json.dumps({a: {"t": "}" * 30} for a, _ in rows}) + "\n" * (k % 2))
        else:
            (tmp_path / "c.csv" / name).write_text("")
    ids = [f"0{i}" for i in range(6)] + [f"2{i}" for i in range(6)]
    got = readers.read_csv(spark, str(tmp_path / "c.csv"), "n").orderBy("n").collect()
    assert [(r.n, r.id) for r in got] == list(enumerate(ids)) and {r.t[:2] for r in got} == {"t\n"}
    got = readers.read_json_records(spark, str(tmp_path / "j.json"), ("t",)).orderBy("_index").collect()
    assert [(r._index, r.source_id) for r in got] == list(enumerate(ids)) and {r.t for r in got} == {"}" * 30}


def test_records_leave_a_task_in_small_batches():
    class Starts:
        value = {"b": splits.Start((False, 0), False)}

    lines = pa.RecordBatch.from_arrays([pa.array(["b"] * 3000), pa.array([f"r{i}" for i in range(3000)])], ["block", "value"])
    got = list(splits._cut(splits.CsvLines(), Starts, frozenset())([lines]))
    assert [t for b in got for t in b.column("text").to_pylist()] == [f"r{i}" for i in range(3000)] and max(map(len, got)) <= 256
