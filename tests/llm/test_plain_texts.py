import re

from wardscope.llm import alignment


def test_plain_texts():
    old = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]|[ª²³¹º¼-¾İ]|\S{400}|\s{400}")
    edges = [chr(c) for c in range(0x260)] + ["x" * 399, "x" * 400, "a " + "é" * 400, " " * 399, " " * 400, "a" + "\n" * 400 + "b", ""]
    assert [alignment.is_plain(t) for t in edges] == [not old.search(t) for t in edges]
