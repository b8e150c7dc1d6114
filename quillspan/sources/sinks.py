"""Sinks: partitioned Parquet, JSON lines, spreadsheets with a byte-order mark."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import SLICE


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each dataset and split."""
    df.write.mode(mode).partitionBy("dataset", "split").parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("dataset").parquet(path)


def retrieval_corpus(df: DataFrame) -> DataFrame:
    """Distinct evidence sentences: ``evidence_id`` (hash of the text), ``text``, ``title``, ``link``."""
    meta = F.from_json("meta", "map<string,string>")
    rows = df.where("evidence <> ''").select(F.substring(F.sha2("evidence", 256), 1, 16).alias("evidence_id"), F.col("evidence").alias("text"), F.coalesce(meta["title"], F.lit("")).alias("title"), F.coalesce(meta["link"], F.lit("")).alias("link"))
    return rows.groupBy("evidence_id", "text").agg(F.min("title").alias("title"), F.min("link").alias("link"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with a header each, quoted as ``readers.read_csv`` reads them; blanks at a field's ends stay."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_records(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """A folder of files, each a JSON object of its rows by ``key``; an entry a line, nulls kept."""
    whole = F.to_json(F.create_map(F.col(key).cast("string"), F.struct(*[c for c in df.columns if c != key])), {"ignoreNullFields": "false"})
    entries = df.select(F.substring(whole, F.lit(2), F.length(whole) - 2).alias("value"))

    def braced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                lines = []
                for entry in batch.column(0).slice(i, SLICE).to_pylist():
                    lines.append(lead + entry)
                    lead = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if lead == "{" else "}"], pa.string())], ["value"])

    entries.mapInArrow(braced, "value string").write.mode(mode).text(path)


def write_sheet(df: DataFrame, path: str | Path, force: bool = False, most_rows: int = 100_000) -> Path:
    """A CSV for a spreadsheet, with a byte-order mark; an existing file stays unless ``force``. For sheets people fill in."""
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(path)
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows are no sheet")
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(rows)
    return path


_GUIDE = """# Hướng dẫn gán nhãn

## 1. Tệp và các cột

{files}

Tệp nào cũng có {n_rows} dòng. Với mỗi dòng, ghi một mã vào cột `{answer}`. Cột `{note}` được để trống; nếu dòng khó, ghi ngắn gọn vì sao khó để nhóm bàn lại trong báo cáo.

Hai người gán nhãn làm riêng. Chưa nộp đủ cả hai tệp thì không so đáp án và không hỏi ý nhau: mức đồng thuận chỉ có nghĩa khi hai lần đọc độc lập.

## 2. Câu hỏi cho mỗi dòng

Đọc ngữ cảnh trước, phát biểu sau, rồi trả lời: **trong phát biểu có điều gì mà ngữ cảnh không hề nhắc đến không?**

| Mã | Ý nghĩa |
|---|---|
{codes}

## 3. Chọn mã nào

Xét từng chi tiết của phát biểu (người, nơi, số liệu, sự việc) và tìm chỗ nó xuất hiện trong ngữ cảnh.

1. Có chi tiết không tìm thấy ở đâu: `{outside}`.
2. Chi tiết nào cũng tìm thấy nhưng quan hệ giữa chúng trái với ngữ cảnh (đảo ý, ghép nhầm, đổi số): `{inside}`.
3. Mọi chi tiết và quan hệ đều khớp, kể cả khi diễn đạt khác: `{none}`.
4. Đọc kỹ vẫn không chọn được: `{unsure}`. Mã này là câu trả lời hợp lệ; chọn bừa thì không.

Chỉ so với ngữ cảnh, không so với hiểu biết của mình. Điều đúng ngoài đời mà ngữ cảnh không nói vẫn là `{outside}`.

## 4. Thí dụ

Ngữ cảnh: *Sông Hương chảy qua thành phố Huế. Sông Hàn chảy qua thành phố Đà Nẵng.*

| Phát biểu | Mã | Lý do |
|---|---|---|
| Thành phố Huế có sông Hương chảy qua. | `{none}` | cùng một ý, đổi cách nói |
| Sông Hàn chảy qua thành phố Huế. | `{inside}` | hai tên đều có, ghép nhầm với nhau |
| Sông Hương dài khoảng 80 km. | `{outside}` | ngữ cảnh không nhắc đến chiều dài |

## 5. Khi đã điền xong

Giữ nguyên tên tệp, thứ tự dòng và các cột khác; lưu lại dạng CSV mã UTF-8. Khi có đủ các tệp, chạy:

```
{report}
```

Kết quả gồm tỷ lệ trùng khớp, hệ số kappa của Cohen và bảng đối chiếu đáp án.

## 6. Dòng kiểm soát

Một phần trong {n_rows} dòng mang nhãn khác với nhãn đang kiểm chứng. Chúng cho biết các dòng có được đọc thật hay không và được tách khỏi thống kê chính. Không cần đoán đó là dòng nào; mọi dòng được đọc như nhau.
"""


def audit_guide(codes: dict[str, str], n_rows: int, sheets: dict[str, str] | None = None, answer: str = "nhan_dinh", note: str = "ghi_chu", report: str = "quillspan.operators.audit.agreement(sheet_a, sheet_b)") -> str:
    """The annotators' instructions in Markdown: sheets, columns, question, answers and how to tell them apart, an example, what follows.

    ``codes``: the answers in the order outside, inside, neither, unsure, with their meaning; ``sheets``: each annotator's file.
    """
    if len(codes) != 4:
        raise ValueError("the guide explains four answers: outside, inside, neither, unsure")
    outside, inside, none, unsure = codes
    files = "\n".join(f"- {who}: `{file}`" for who, file in (sheets or {}).items()) or "- mỗi người một tệp riêng"
    table = "\n".join(f"| `{code}` | {meaning} |" for code, meaning in codes.items())
    return _GUIDE.format(files=files, codes=table, n_rows=n_rows, answer=answer, note=note, report=report, outside=outside, inside=inside, none=none, unsure=unsure)


def write_guide(path: str | Path, codes: dict[str, str], n_rows: int, sheets: dict[str, str] | None = None, force: bool = False, **words: str) -> Path:
    """The guide beside the sheets; an existing one stays unless ``force``."""
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(audit_guide(codes, n_rows, sheets, **words), encoding="utf-8")
    return path
