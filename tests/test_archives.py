"""Zipped and sharded exports."""

from __future__ import annotations

import json
import zipfile

from hippolake.sources import archives
from hippolake.sources import imports as I


def chat(*texts):
    mapping = {f"n{i}": {"parent": f"n{i - 1}" if i else None, "children": [f"n{i + 1}"] if i + 1 < len(texts) else [], "message": {"author": {"role": "user"}, "content": {"parts": [t]}}} for i, t in enumerate(texts)}
    return {"mapping": mapping, "current_node": f"n{len(texts) - 1}"}


def test_members_shards_and_errors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("export/conversations-001.json", json.dumps([chat("three", "four")]))
        out.writestr("export/conversations-000.json", json.dumps([chat("one"), chat("two {é}")]))
        out.writestr("conversations.json", b"\xff\xfe")
        out.writestr("conversations-7.json", "x" * 5000)  # too large for the budget
        out.writestr("user.json", "{}")
    content = (tmp_path / "a.zip").read_bytes()
    at = content.index(b"export/conversations-001.json") + len("export/conversations-001.json") + 4
    (tmp_path / "b.zip").write_bytes(content[:at] + bytes([content[at] ^ 0xFF]) + content[at + 1 :])
    (tmp_path / "c.zip").write_bytes(b"PK nothing")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as out:
        out.writestr("other.txt", "x")
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "conversations-000.json").write_text(json.dumps(chat("five")))
    (tmp_path / "folder" / "conversations-001.json").write_text("[broken")

    docs = archives.export_documents(spark, str(tmp_path), member_bytes=4000)
    rows = {(r.file.rsplit("/", 1)[1], r.member): r for r in docs.collect()}
    assert rows["a.zip", "conversations.json"].error.startswith("not UTF-8") and rows["a.zip", "conversations-7.json"].error == "more than 4000 bytes"
    assert rows["b.zip", "export/conversations-001.json"].error.startswith("broken member") and rows["b.zip", "export/conversations-000.json"].error is None
    assert rows["c.zip", None].error.startswith("broken archive") and rows["d.zip", None].error == "no documents in the archive"
    assert all((r.content is None) != (r.error is None) for r in rows.values()) and ("a.zip", "user.json") not in rows

    threads = I.conversation_tree(archives.conversations(docs.filter("file NOT LIKE '%b.zip'"))).collect()
    assert sorted(r.text for r in threads) == ["five", "four", "one", "three", "two {é}"]
    assert len({r.id for r in threads}) == 4


def test_an_archives_budget(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for i in range(4):
            out.writestr(f"conversations-{i}.json", "x" * 1000)
    import re

    found = list(archives.documents_of((tmp_path / "a.zip").read_bytes(), re.compile(archives.SHARDS), 1500, 2500))
    assert [(text is not None, error) for _, text, error in found] == [(True, None), (True, None), (False, "more than 500 bytes"), (False, "the archive has more than 2500 bytes")]
