import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_outside_imports_the_subpackage():
    for f in (ROOT / "quillfold").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "quillfold").parts:
            assert not re.search(r"quillfold\.llm|from \.+llm", f.read_text(encoding="utf-8")), f
