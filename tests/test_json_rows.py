"""JSON of unknown shape by example."""

import pytest

from fieldweave.operators import json_rows as J


def texts(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")


def test_rows_of_arrays_and_objects(spark):
    got = J.cells(J.json_rows(texts(spark, '[{"a": 1}, 2, {"b": {"c": [1]}}]', '{"rows": [{"x": null}], "y": 1}', "﻿ [{}]", '{"rows": 5}', '"text"', "{broken", None, "", '[{"a": 1, "a": 2}]'))).collect()
    assert {(r.doc_id, r.row, r.key, r.text, r.kind) for r in got} == {(0, 0, "a", "1", "BIGINT"), (0, 1, "b", '{"c":[1]}', "OBJECT"), (1, 0, "x", None, "VOID")}
    assert J.json_rows(texts(spark, "[{}]", "[]", "[1]")).count() == 1


@pytest.mark.parametrize("text,root,fields", [('{"items": [{"a": 1}, {"b": 2}]}', "array", ["a", "b"]), ('{" Data": []}', "array", []), ('{"items": [{"a": 1}, 2]}', "object", ["items"]), ('{"other": [{"a": 1}]}', "object", ["other"]), ('{"items": [{"a": 1}], "n": 1}', "object", ["items", "n"]), ("5", "other", []), ("x", "other", []), (None, "other", [])])
def test_wrapped_targets(spark, text, root, fields):
    r = J.target_rows(texts(spark, text)).first()
    assert (r.root, r.fields) == (root, fields)


@pytest.mark.parametrize("text,payload", [(' {"b": 1, "a": [2]} ', '{"a":[2],"b":1}'), ('Sure:\n```json\n{"a": 1}\n```\nand {"b": 2}', '{"a":1}'), ('x {no} then {"a": "}"} end', '{"a":"}"}'), ("[1, [2]] tail", "[1,[2]]"), ("{never", None), ("", None), (None, None), ("ё", None)])
def test_payloads_in_answers(spark, text, payload):
    assert J.payloads(texts(spark, text)).first().payload == payload


def test_parsed_files(spark):
    whole = '{"file_name": "", "file_type": "csv", "columns": ["a", 1], "rows": [{}, 2], "kv_pairs": [{"label": "l", "value": 0, "confidence": "sure"}, 5, {"label": null, "value": "0", "confidence": "low"}], "sheets": [{"name": null, "rows": [{"z": 1, "b": 2}]}, {"name": "s", "columns": ["c"]}]}'
    df = texts(spark, whole, "[1]", "{}", None)
    got = {r.doc_id: r for r in J.parsed_files(df).collect()}
    assert set(got) == {0, 2} and (got[0].file_name, got[0].file_type, got[0].columns, got[0].n_rows, got[0].n_kv_pairs, got[0].n_sheets) == ("uploaded_file", "csv", ["a", "1"], 1, 2, 2)
    assert (got[2].document_mode, got[2].columns, got[2].n_sections) == ("data_table_mode", [], 0)
    assert {(r.n, r.label, r.value, r.confidence) for r in J.file_pairs(df).collect()} == {(1, "l", "", "medium"), (3, "", "0", "low")}
    assert {(r.sheet, r.name, tuple(r.columns), tuple(r.rows)) for r in J.file_sheets(df).collect()} == {(1, "Sheet 1", (), ('{"b":2,"z":1}',)), (2, "s", ("c",), ())}
