import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "shelfmark"


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module


def test_nothing_imports_the_llm_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(name.startswith("shelfmark.llm") for name in imports(path)), path


def test_the_query_layer_has_no_python_functions_on_rows():
    for name in ("snapshot", "stats", "trust", "diff", "sinks"):
        text = (ROOT / "operators" / f"{name}.py").read_text()
        assert not any(word in text for word in ("pandas_udf", "mapInPandas", "applyInPandas", "F.udf", ".rdd"))


def test_no_local_checkpoint():
    for path in ROOT.rglob("*.py"):
        assert "localCheckpoint" not in path.read_text()
