"""Exported chats with threads of any length."""

from __future__ import annotations

import json

from hippolake.sources import imports as I


def test_long_threads_are_whole(spark):
    def node(i, n):
        return {"parent": f"n{i - 1}" if i else None, "children": [f"n{i + 1}"] if i < n - 1 else [], "message": {"author": {"role": "user"}, "content": {"parts": [f"turn {i}"]}}}

    n = 2600
    mapping = {f"n{i}": node(i, n) for i in range(n)} | {"side": node(0, 1)}
    loop = {"a": {"parent": "b", "children": ["b"], "message": node(0, 1)["message"]}, "b": {"parent": "a", "children": ["a", "c"], "message": node(1, 2)["message"]}, "c": {"parent": "b", "children": [], "message": node(2, 3)["message"]}}
    chats = [{"mapping": mapping, "current_node": f"n{n - 1}"}, {"mapping": mapping}, {"mapping": loop}, {"mapping": mapping, "current_node": "n3"}]
    files = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(chats)], "id long, content string")
    seen = {}
    for r in I.conversation_tree(files).orderBy("id", "position").collect():
        seen.setdefault(r.id, []).append((r.position, r.text))
    whole = [(i, f"turn {i}") for i in range(n)]
    assert seen == {0: whole, 1: whole, 2: [(0, "turn 0"), (1, "turn 1"), (2, "turn 2")], 3: whole[:4]}
