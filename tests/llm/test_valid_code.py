"""Problem 2: valid code of kinds that once were rejected."""

import ast
import sysconfig
from pathlib import Path

from corpusloom.llm import syntax


def test_python_of_the_standard_library():
    bad = []
    for f in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:60]:
        s = f.read_text(encoding="utf-8", errors="replace")
        if len(s) < 30_000:
            ast.parse(s)
            if not syntax.valid("python", s):
                bad.append(f.name)
    assert not bad


def test_underscore_is_a_name():
    for s in ("for _ in x: pass\n", "_, a = b\n", "import gettext as _\n", "match a:\n    case _:\n        pass\n"):
        assert syntax.valid("python", s), s
    for s in ("for ( in x: pass\n", "x = = 1\n", "print 'a'\n"):
        assert not syntax.valid("python", s), s


def test_javascript_line_ends_and_regular_expressions():
    for s in ("let e = 1\nwhile (e) {}\n", "if (a) b()\nelse c()\n", "do a()\nwhile (b)\n", "do {\n  a()\n}\nwhile (b)\n", "try {\n}\ncatch (e) {\n}\nfinally {\n}\n", "const f = (x) => /a/.test(x);\n", "typeof /a/;\n", "a && /b/.test(c);\n", "x = a / b / c;\n"):
        assert syntax.valid("javascript", s), s
    for s in ("let = = 1\n", "if (a\n", "x = (1;\n", "else b();\n"):
        assert not syntax.valid("javascript", s), s
