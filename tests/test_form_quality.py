"""Signals of a form's reading by example."""

from fieldweave.operators import form_quality as Q


def test_routing(spark):
    files = spark.createDataFrame([(1, "pdf", 2, 3), (2, "PDF", 2, 3), (3, "pdf", 0, 3), (4, "docx", 2, 3), (5, "pdf", 2, 3), (6, "pdf", 1, 1)], "doc_id long, file_type string, columns int, rows int")
    zones = [(1, "table", 0.9), (1, "form", 0.8), (2, "table", 0.9), (2, "form", 0.86), (3, "table", 0.9), (4, "table", 0.9), (5, "form", 0.64), (5, "table", None), (6, "table", 0.7)]
    got = {r.doc_id: r for r in Q.routing(files, spark.createDataFrame(zones, "doc_id long, zone string, confidence double")).collect()}
    assert set(got) == {1, 2, 3, 5, 6} and {k for k, r in got.items() if r.prefer_table} == {1, 6}
    assert got[5].low_form and got[5].has_form and not got[5].has_table and not got[2].low_form


def test_flags(spark):
    forms = spark.createDataFrame([(1, "form_resolver", 3, 1), (2, "repair_model", 0, 0), (3, "legacy_fallback", 2, 0), (4, "repair_model", 3, 1)], "doc_id long, mode string, targets int, resolved int")
    fields = spark.createDataFrame([(1, "b", "ambiguous", "fallback_blocked", True), (1, "a", "not_found", "form_resolver", False), (1, "c", "weak_match", "repair_model", True)], "doc_id long, field string, status string, resolved_by string, critical boolean")
    groups = spark.createDataFrame([(1, "g", "single_choice", [(True,), (True,)]), (1, "h", "multi_choice", [(True,), (True,)])], "doc_id long, group_id string, group_type string, options array<struct<selected:boolean>>")
    routed = spark.createDataFrame([(2, True, True, True), (3, False, True, True)], "doc_id long, prefer_table boolean, has_form boolean, low_form boolean")
    got = {r.doc_id: r for r in Q.assessed(forms, fields, groups, routed).collect()}
    assert got[1].flags == ["critical_unresolved", "ambiguous_fields", "single_choice_multi_select", "low_field_coverage"] and (got[1].critical, got[1].blocked, got[1].repaired, got[1].unresolved, got[1].torn) == (["b"], ["b"], ["c"], ["a"], ["g"])
    assert got[2].flags == ["pdf_zone_prefers_table"] and got[2].needs_attention and not got[2].repair_recommended
    assert got[3].flags == ["legacy_fallback_used", "empty_normalized_row", "low_confidence_form_zones"] and got[3].repair_recommended and got[4].flags == ["low_field_coverage"]
