"""Readers of exports, on small files."""

from __future__ import annotations

import json

import pytest

from hippolake.sources import imports as I


def files(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "id long, content string")


def test_list_items(spark):
    text = "Saved info:\n- likes tea\n* ok\n\n2) lives in Rome\n• no\n" + "\n".join(f"{i}. item {i}" for i in range(25))
    rows = I.list_items(files(spark, text, "", None)).orderBy("item_no").collect()
    assert [r.text for r in rows][:3] == ["likes tea", "lives in Rome", "item 0"] and len(rows) == 27
    assert [r.chunk for r in rows] == [i // 20 for i in range(27)]


def test_activity_html(spark):
    html = '<div class="outer-cell">Prompted hello <b>you</b><br>3 de jan. de 2024, 10:00:05 UTC</div><div class="outer-cell">Searched x</div><div class="outer-cell">Prompted undated</div><div class="outer-cell">Prompted foo<br>14 juil. 2024, 01:02:03</div>'
    rows = I.activity_html(files(spark, html)).orderBy("cell_no").collect()
    assert [(r.prompt, r.at) for r in rows] == [("hello you", 1704276005), ("undated", None), ("foo", 1718326923)]


def test_activity_json(spark):
    data = [{"header": "Gemini Apps", "title": "Prompted what is up", "time": "2024-01-01T00:00:00Z", "safeHtmlItem": [{"html": "<p>hi there</p>"}]}, {"header": "Maps", "title": "Used maps"}, {"title": "Prompted x"}]
    rows = I.activity_json(files(spark, json.dumps(data), "not json")).collect()
    assert [(r.prompt, r.response, r.at) for r in rows] == [("what is up", "hi there", 1704067200)]


def test_memory_export(spark):
    m = [{"id": "a", "memory": "likes tea", "categories": ["odd", "LIKE"]}, {"id": "b", "memory": " x "}, {"id": "c", "memory": "ran far", "metadata": {"category": "event"}}]
    rows = I.memory_export(files(spark, json.dumps({"memories": m}), json.dumps({"results": m}), json.dumps(m), "[broken")).collect()
    assert sorted((r.id, r.memory_id, r.type) for r in rows) == sorted((i, k, t) for i in range(3) for k, t in (("a", "preference"), ("c", "episodic")))


def test_memory_graph(spark):
    lines = [
        {"type": "entity", "name": "John", "observations": ["old"]}, {"type": "entity", "name": "John", "observations": ["works at Acme", "He likes tea", "John runs", "Born in Rome"]},
        {"type": "entity", "name": "Acme", "observations": []}, {"type": "relation", "from": "John", "to": "Acme", "relationType": "MEMBER_OF"}, {"type": "relation", "from": "John", "to": "Nobody", "relationType": "knows"},
    ]
    rows = {r.text for r in I.graph_jsonl(files(spark, "\n".join(map(json.dumps, lines)) + "\nbroken")).collect()}
    assert rows == {"John works at Acme", "John likes tea", "John runs", "John: Born in Rome", "John is a member of Acme"}


def test_conversation_tree(spark):
    def node(parent, children, role=None, text=""):
        return {"parent": parent, "children": children, "message": {"author": {"role": role}, "content": {"parts": [text]}} if role else None}

    mapping = {"r": node(None, ["a"]), "a": node("r", ["b", "c"], "user", "first question"), "b": node("a", [], "assistant", "draft answer"), "c": node("a", ["d"], "assistant", "final answer"), "d": node("c", [], "system", "hidden")}
    seen = [(r.id, r.role, r.text) for r in I.conversation_tree(files(spark, json.dumps({"mapping": mapping, "current_node": "b"}), json.dumps({"mapping": mapping}), "{}", "x")).orderBy("id", "position").collect()]
    assert seen == [(0, "user", "first question"), (0, "assistant", "draft answer"), (1, "user", "first question"), (1, "assistant", "final answer")]


def test_json_log_and_registry(spark):
    rows = I.json_log(files(spark, '{"a": 1}\n\nbroken\n{"a": 2}'), "a int").orderBy("line_no").collect()
    assert [(r.line_no, r.broken, r.row.a if r.row else None) for r in rows] == [(1, False, 1), (3, True, None), (4, False, 2)]
    assert I.get_adapter("list") is I.list_items
    with pytest.raises(ValueError):
        I.get_adapter("none")
