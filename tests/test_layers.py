"""Which module may import which, and that nothing but itself imports the llm subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "skyobs"
LAYERS = {"config": 0, "sensors": 1, "functions": 1, "operators": 2, "sources": 3, "streaming": 3, "plans": 4}


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module and node.module.startswith("skyobs"):
            yield node.module if node.module != "skyobs" else f"skyobs.{node.names[0].name}"
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names if a.name.startswith("skyobs"))


def test_layers():
    for path in ROOT.rglob("*.py"):
        part = path.relative_to(ROOT).with_suffix("").parts
        if part[0] in ("llm", "__init__"):
            continue
        for name in imports(path):
            target = name.split(".")[1]
            assert target != "llm", path
            if target in LAYERS:
                assert LAYERS[target] <= LAYERS[part[0]], (path, name)
