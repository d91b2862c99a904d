"""JSON texts of unknown depth as leaves."""

import json

from lodestar.operators.knowledge import flatten_json


def walk(obj, prefix=""):
    """The same by recursion."""
    if isinstance(obj, dict) and "value" in obj:
        yield prefix, obj["value"], [obj[k] for k in ("hyperlink_target", "hyperlink_location") if obj.get(k)]
    elif isinstance(obj, dict):
        for key, value in obj.items():
            if key != "_meta":
                yield from walk(value, f"{prefix}.{key}" if prefix else key)
    elif isinstance(obj, list):
        for i, value in enumerate(obj):
            yield from walk(value, f"{prefix}[{i}]")
    else:
        yield prefix, obj, []


NESTED = {"z": "last first", "a": [1, 2.5, True, None, "", {"b.c": "x", "_meta": {"n": 1}, "d": [[], {}, ["deep", {"e": {"f": "é \"q\" \\ \n😀"}}]]}],
          "cell": {"value": "shown", "hyperlink_target": "http://x", "hyperlink_location": ""}, "flag": {"value": False, "hyperlink_location": "s1"},
          "none": {"value": None}, "text": "{\"not\": \"opened\"}", "list text": "[1]", "nan": " NaN ", "pad": "  kept  ", "_meta": "gone", "n": 1e5, "big": 12345678901234567890}
TEXTS = [(1, json.dumps(NESTED)), (2, None), (3, ""), (4, "{broken"), (5, "[]"), (6, '"alone"'), (7, "7"), (8, json.dumps([NESTED, {"only": "x"}])), (9, "null"),
         (10, '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": "deep"}}}}}}}}'), (11, json.dumps({"long": "x" * 200_000})), (12, "true"), (13, '{"a": 1, "a": 2}')]


def test_equals_recursion(spark):
    got = flatten_json(spark.createDataFrame([(i, t, 0, "") for i, t in TEXTS], "id bigint, raw string, pos int, key string"), "id", "raw")
    want = []
    for i, raw in TEXTS:
        if raw and i not in (4, 13):
            for pos, (key, value, links) in enumerate(walk(json.loads(raw))):
                shown = "" if value is None else str(value).strip()
                if shown.lower() not in ("", "none", "null", "nan"):
                    want.append((i, pos, key, shown, links))
    assert [tuple(r) for r in got.orderBy("row_id", "pos").collect()] == want


def test_plan_is_native_and_tables_may_be_empty(spark):
    rows = spark.createDataFrame(TEXTS, "id bigint, raw string")
    assert "Python" not in flatten_json(rows, "id", "raw")._jdf.queryExecution().toString()
    assert flatten_json(rows.limit(0), "id", "raw").count() == 0
    held = flatten_json(spark.createDataFrame([(1, '{"k": {"value": [1, "a"]}}')], "id bigint, raw string"), "id", "raw")
    assert [(r["key"], r["value"]) for r in held.collect()] == [("k", '[1,"a"]')]


def test_strings_that_look_like_containers_stay_strings(spark):
    texts = [(1, r'{"a": "[1]", "b": "true", "c": "[x]", "d": true, "e": {"value": "true"}, "f": {"value": true}}'), (2, '["{}", {"k": ["true", false]}]'), (3, r'{"a": "\u005b1]"}')]
    got = flatten_json(spark.createDataFrame(texts, "id bigint, raw string"), "id", "raw").orderBy("row_id", "pos").collect()
    assert [(r["row_id"], r["key"], r["value"]) for r in got] == [
        (1, "a", "[1]"), (1, "b", "true"), (1, "c", "[x]"), (1, "d", "True"), (1, "e", "true"), (1, "f", "True"), (2, "[0]", "{}"), (2, "[1].k[0]", "true"), (2, "[1].k[1]", "False"), (3, "a", "[1]")]


def test_rows_with_equal_ids_count_as_one_text(spark):
    rows = spark.createDataFrame([(1, '{"a": "x", "b": "y"}'), (1, '{"c": "z"}'), (None, '["p"]'), (None, '["q", ""]'), (2, '["only"]')], "id bigint, raw string")
    got = flatten_json(rows, "id", "raw").collect()
    places = {}
    for r in got:
        places.setdefault(r["row_id"], []).append(r["pos"])
    assert {k: len(set(v)) for k, v in places.items()} == {1: 3, None: 2, 2: 1} and len(got) == 6 and sorted(places[1]) == [0, 1, 2]


def test_key_types_as_patterns_tell(spark):
    """Keys typed by plain searches, against the markers themselves."""
    from lodestar.functions.wordlists import BLOCKED_KEY_PARTS, KEY_SECTION_MARKERS
    from lodestar.operators.knowledge import raw_sections

    keys = [" Eligibility_criteria ", "How-to / apply", "Vendor note", "none", "", " \t", "Colour", "fund ", "Required  Documents\n", "Internal scope", "NOTES", "loan amount", "Subsidy "]
    flat = spark.createDataFrame([(i, 0, k, f"v{i}", []) for i, k in enumerate(keys)], "row_id bigint, pos bigint, key string, value string, links array<string>")
    want = {}
    for i, key in enumerate(keys):
        k = " ".join(x for x in key.strip(" \t\n").lower().replace("_", " ").replace("-", " ").replace("/", " ").split(" ") if x)
        kind = next((s for s, m in KEY_SECTION_MARKERS if any(x in k for x in m)), None)
        if k not in ("", "none") and kind and not any(x in k for x in BLOCKED_KEY_PARTS):
            want[i] = (kind, f"v{i}")
    assert {r["row_id"]: (r["section_type"], r["content"]) for r in raw_sections(flat).collect()} == want
