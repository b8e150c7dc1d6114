import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan import config
from quillspan.sources import paths, readers, sinks
from quillspan.streaming.runlog import append_table, stream_runs

EVIDENCE = "Hai ba."


def corpora(root):
    (root / "vihallu_train.csv").write_text('id,context,prompt,response,label\n1,"Thủ đô, Hà\nNội","thu do ""nao""",NA,no\n2,abc,def,,extrinsic\n'.replace(",NA,", ",NA,"), encoding="utf-8-sig")
    (root / "isedsc01_train.json").write_text(json.dumps({"7": {"context": f"Một. {EVIDENCE} Bốn.", "claim": "a", "verdict": "SUPPORTED", "evidence": EVIDENCE, "domain": "d"}, "3": {"context": "Một.", "claim": "b", "verdict": "NEI", "evidence": None, "domain": None}}, ensure_ascii=False), encoding="utf-8")
    for s in ("train", "dev", "test"):
        (root / f"viwikifc_{s}.csv").write_text(f'pairID,evidence,gold_label,link,context,sentenceID,claim,annotator_labels,title\np1,{EVIDENCE},Supports,l,Một. {EVIDENCE},0,c1,x,t\np1,khác,Refutes,l,Một. {EVIDENCE},0,c2,x,t\n', encoding="utf-8")
        pd.DataFrame({"Unnamed: 0": [0], "index": [0], "Statement": ["s"], "Context": [f"Một. {EVIDENCE}"], "Topic": ["t"], "labels": [2], "Evidence": [EVIDENCE]}).to_parquet(root / f"vifactcheck_{s}.parquet")
    return str(root)


def test_readers(spark, tmp_path):
    raw = corpora(tmp_path)
    v = readers.read_vihallu(spark, raw).orderBy("sample_id").collect()
    assert [r.sample_id for r in v] == ["vihallu_train_0", "vihallu_train_1"] and v[0].context == "Thủ đô, Hà\nNội" and v[0].response == "NA" and v[1].response == ""
    assert json.loads(v[0].meta)["prompt_type"] == "noisy" and json.loads(v[0].meta)["prompt_has_diacritics"] is False and v[0].evidence_start == -1
    i = readers.normalise(spark, "isedsc01", raw, published=False).orderBy("sample_id").collect()
    assert (i[0].evidence, i[0].evidence_start, i[0].label) == (EVIDENCE, 5, "no") and json.loads(i[0].meta)["source_id"] == "7"
    assert (i[1].evidence, i[1].evidence_start, i[1].label) == ("", -1, "extrinsic") and json.loads(i[1].meta)["evidence_given"] is False
    w = readers.normalise(spark, "viwikifc", raw, published=False)
    assert w.count() == 6 and w.select("sample_id").distinct().count() == 6
    f = readers.normalise(spark, "vifactcheck", raw, published=False).collect()
    assert {r.split for r in f} == {"train", "dev", "test"} and f[0].label_original == "2" and json.loads(f[0].meta)["url"] == ""
    assert readers.read_minimal(spark, raw, "vifactcheck").columns == ["context", "question", "response"]
    out = str(tmp_path / "interim")
    sinks.write_corpus(w, out)
    assert readers.load_dataset(spark, out, "viwikifc", "dev").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_corpus(w, out)
    assert sinks.retrieval_corpus(w).count() == 1


def test_published_counts(spark, tmp_path):
    raw = corpora(tmp_path)
    for name in ("isedsc01", "viwikifc", "vifactcheck"):
        with pytest.raises(ValueError, match="unexpected counts"):
            readers.normalise(spark, name, raw)
    rows = spark.createDataFrame([(s, lab, 0) for s, labels in readers.PUBLISHED["viwikifc"].items() for lab, n in labels.items() for _ in range(n)], "split string, label string, evidence_start int")
    readers.check_published(rows, "viwikifc")
    with pytest.raises(ValueError, match="without located evidence"):
        readers.check_published(rows.withColumn("evidence_start", F.lit(-1)), "viwikifc")


def test_row_numbers_follow_the_scan(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [(r.id, r._index) for r in readers.numbered(df).orderBy("id").collect()] == [(i, i) for i in range(1000)]


def test_reader_errors(spark, tmp_path):
    raw = corpora(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.read_vihallu(spark, str(tmp_path / "none"))
    (tmp_path / "vihallu_train.csv").write_text("id,context,prompt,response,label\n1,a,b,c,maybe\n")
    with pytest.raises(Exception, match="unknown label maybe in row 0"):
        readers.read_vihallu(spark, raw).collect()
    (tmp_path / "vihallu_train.csv").write_text("id,context\n1,a\n")
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_vihallu(spark, raw)
    (tmp_path / "isedsc01_train.json").write_text("[1]")
    with pytest.raises(Exception, match="not an object"):
        readers.read_isedsc01(spark, raw).collect()


def test_sheet_has_a_mark_and_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "stt int, t string")
    p = sinks.write_sheet(df, tmp_path / "s" / "a.csv")
    assert p.read_bytes().startswith(b"\xef\xbb\xbf") and readers.read_csv(spark, str(p)).collect()[0].stt == "1"
    with pytest.raises(FileExistsError):
        sinks.write_sheet(df, p)
    sinks.write_sheet(df, p, force=True)


def test_find_raw_dir(tmp_path, monkeypatch):
    marked = tmp_path / "m"
    marked.mkdir()
    (marked / paths.MARKER).touch()
    monkeypatch.setenv(paths.ENV, str(marked))
    assert paths.find_raw_dir() == marked and paths.find_raw_dir(tmp_path) == tmp_path
    with pytest.raises(FileNotFoundError):
        paths.find_raw_dir(tmp_path / "none")
    monkeypatch.setenv(paths.ENV, str(tmp_path / "none"))
    monkeypatch.chdir(tmp_path)
    with pytest.raises(FileNotFoundError):
        paths.find_raw_dir()


GOOD = {"run_name": "r", "dataset": {"name": "vihallu"}, "chunking": {"strategy": "token_window", "window_size": 128}, "extractor": {"model_name": "m"}, "features": {"groups": ["basic"]}, "detector": {}}


def test_config(tmp_path):
    c = config.Experiment(**GOOD)
    assert c.chunking.stride == 64 and c.hash() == config.Experiment(**GOOD | {"run_name": "other"}).hash()
    bad = [{"run_name": ""}, {"dataset": {"name": "vihallu", "split_seed": 1}}, {"chunking": {"strategy": "token_window"}}, {"chunking": {"strategy": "token_window", "window_size": 4, "stride": 5}}, {"extractor": {"model_name": "m", "max_context_tokens": 1}}, {"features": {"groups": []}}, {"features": {"groups": ["basic", "basic"]}}, {"features": {"groups": ["basic"], "head_aggregation": "topk_heads"}}, {"more": 1}]
    for change in bad:
        with pytest.raises(ValueError):
            config.Experiment(**GOOD | change)
    (tmp_path / "c.yaml").write_text(json.dumps(GOOD))
    assert config.load_config(tmp_path / "c.yaml") == c
    (tmp_path / "l.yaml").write_text("- 1")
    with pytest.raises(TypeError):
        config.load_config(tmp_path / "l.yaml")
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.yaml")


def test_run_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text('{"run_name":"r","metrics":{"macro_f1":0.5}}\n' * 2)
    schema = spark.read.json(str(tmp_path / "in")).schema
    append_table(stream_runs(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and "metrics__macro_f1" in out.columns


def test_guide_explains_every_answer(tmp_path):
    codes = {"ngoai_lai": "mang điều mới vào", "noi_tai": "dùng sai điều đã có", "khong": "không thêm, không sai", "khong_chac": "không quyết được"}
    path = sinks.write_guide(tmp_path / "g" / "guide.md", codes, 120, {"A": "sheet_a.csv", "B": "sheet_b.csv"}, report="make report")
    text = path.read_text(encoding="utf-8")
    assert all(f"| `{c}` | {m} |" in text for c, m in codes.items()) and all(text.count(f"`{c}`") >= 2 for c in codes)
    assert "120 dòng" in text and "`sheet_a.csv`" in text and "`nhan_dinh`" in text and "`ghi_chu`" in text and "make report" in text and "{" not in text
    with pytest.raises(FileExistsError):
        sinks.write_guide(path, codes, 120)
    assert "mỗi người" in sinks.audit_guide(codes, 3)
    with pytest.raises(ValueError):
        sinks.audit_guide({"a": "b"}, 3)
