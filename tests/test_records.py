"""Records across line ends and splits, against readers that see whole files."""

import json
import random

import duckdb
import pytest

from ledgerwise.sources import readers, schemas

STRANGE = ['{"x": [1, "]}"]}', "}, {", '"', '\\', '\\"', "a\nb", "[", "é}ü", "", "\\}", "line\r\nend", '",\n"']


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def some_records(n, seed):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        text = "".join(draw.choices(STRANGE, k=draw.randint(0, 6))) * draw.choice([1, 1, 1, 40])
        out.append({"id": f"{seed}-{k}", "text": text, "more": {"list": [text, {"deep": [[text]]}]}})
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    expected = []
    for seed, form in enumerate(("array", "array", "objects", "empty", "blank")):
        own = some_records(60, seed) if form in ("array", "objects") else []
        expected += own
        text = json.dumps(own, indent=indent, ensure_ascii=seed == 0)
        if form == "objects":
            text = "\n".join(json.dumps(r, indent=indent) for r in own) + "\n"
        (tmp_path / f"{seed}.json").write_text("  \n" if form == "blank" else f" {text}\n", encoding="utf-8")
    schema = schemas.all_strings(("id", "text"))
    df = readers.read_json_records(spark, str(tmp_path), schema)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
    assert sorted((r.id, r.text) for r in df.collect()) == sorted((r["id"], r["text"]) for r in expected)


def test_broken_arrays_give_a_row_of_nulls(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"')
    rows = readers.read_json_records(spark, str(tmp_path), schemas.all_strings(("id",))).collect()
    assert sorted(str(r.id) for r in rows) == ["1", "None"]


def test_quoted_line_ends_equal_another_reader(spark, tmp_path, small_splits):
    draw = random.Random(4)
    fields = ["plain", "", 'a "quoted" word', "two\nlines", ";", '"', "x" * 300 + "\n" + "y" * 900, "é", "\n\n", '";\n"', "5 inch"]
    rows = [[str(k), *draw.choices(fields, k=2)] for k in range(400)]

    def written(value):
        return '"' + value.replace('"', '""') + '"' if any(c in value for c in '";\n') or draw.random() < 0.1 else value

    body = "\n".join(";".join(written(v) for v in r) for r in rows) + "\n"
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text('title with a " quote\nid;"one;two\n' + body, encoding="utf-8")
    df = readers.read_delimited(spark, str(tmp_path), schemas.all_strings(("id", "one", "two")))
    found = df.collect()
    assert all(r._overflow is None for r in found) and len({r.seq for r in found}) == 800
    assert sorted((str(r.id), str(r.one), str(r.two)) for r in found) == sorted(2 * [tuple(str(v or None) for v in r) for r in rows])
    # Another reader of quoted line ends sees the same records.
    (tmp_path / "plain.txt").write_text(body, encoding="utf-8")
    other = duckdb.sql(
        f"""SELECT * FROM read_csv('{tmp_path}/plain.txt', delim=';', quote='"', escape='"', header=false, auto_detect=false,
            columns={{'id': 'VARCHAR', 'one': 'VARCHAR', 'two': 'VARCHAR'}})"""
    ).fetchall()
    assert sorted(tuple(str(v or None) for v in r) for r in other) == sorted(tuple(str(v or None) for v in r) for r in rows)


def test_a_quote_inside_a_field_opens_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1;5" pipe;x\n2;b"c;"d\ne"\n3;;"open\nto the end\n')
    df = readers.read_delimited(spark, str(tmp_path), schemas.all_strings(("id", "one", "two")), skip_lines=0)
    found = {r.id: (r.one, r.two) for r in df.collect()}
    assert found["1"] == ('5" pipe', "x") and found["2"] == ('b"c', "d\ne") and len(found) == 3
