"""Problem 2: texts inside texts are parsed too."""

import subprocess

import pytest

from corpusloom.llm.syntax import valid

BASH = [
    "a=(x; y)\n", "a=(x y\n# z\n  \"q r\" $(date) [3]=v)\n", "[[ a == ]]\n", "[[ ]]\n", "[[ -f ]]\n", "[[ -f $x && ( $y == a* || ! -z $z ) ]] && echo\n", "cat <(if true)\n", "cat <(if true; then echo; fi)\n",
    "[[ $x =~ ^(a|b)[[:space:]]+$ ]]\n", "[[ a b ]]\n", "if [[ $x -gt 3 ]]; then echo; fi\n", "((a = b + 1))\n", "[[ $a < $b ]] && echo\n", "[[ -n $x\n  && $y ]]\n",
]
PYTHON = [
    "x = f'{a +}'\n", "x = f'{a + b!r:>{w}}'\n", "x = f'{}'\n", "x = f'a}'\n", "x = f'{{a +}}'\n", "x = f'{a[\"b\"]:%Y-%m} {c=}'\n", "x = f'{a != b} {d!x}'\n", "x = '{a +}'\n", "x = f'''{\n  a\n}'''\n", "x = f'{(lambda y: 1)(2)}'\n",
    "if a:\n        b = 1\n\tc = 2\n", "if a:\n\tb = 1\n\tc = 2\n", "if a:\n\tif b:\n\t\tc\n\td\n", "x = rf'\\d{n}'\n", "x = f'\\N{EM DASH} {a}'\n", "x = f'{a) + (b}'\n",
]


@pytest.mark.parametrize("text", BASH)
def test_bash(text):
    assert valid("bash", text) == (not subprocess.run(["bash", "-n"], input=text, text=True, capture_output=True, timeout=20).stderr)


@pytest.mark.parametrize("text", PYTHON)
def test_python(text):
    try:
        compile(text, "x", "exec")
        ok = True
    except SyntaxError:
        ok = False
    assert valid("python", text) == ok


@pytest.mark.parametrize("lang", ["javascript", "typescript"])
def test_templates(lang):
    assert all(valid(lang, f"const x = `{t}`;\n") for t in ("a", "${a}", "${a + `b ${c}`}", "${f({ a: 1 })}", "\\${a +}", "${a, b}"))
    assert not any(valid(lang, f"const x = `{t}`;\n") for t in ("${a +}", "${}", "${a) + (b}", "x ${ `${b +}` }"))


@pytest.mark.parametrize(
    "text",
    [
        "try:\n    a\nexcept A, e:\n    b\n", "try:\n    a\nexcept (A, B) as e:\n    b\n", "try:\n    a\nexcept:\n    b\n", "try:\n    a\nexcept *A as e:\n    b\n",
        "f(a=1, b)\n", "f(a, *b, c=1, *d, **e, g=2)\n", "f(**a, *b)\n", "f(a, b=1,)\n", "f(x for x in y)\n", "f(*a, b)\n", "f(a := 1, b)\n", "f()\n",
        "def f(a=1, b): pass\n", "def f(a, /, b=1, *c, d, e=2, **g): pass\n", "def f(a=1, /, b=2): pass\n", "def f(*, a, b=1): pass\n", "def f(**a, b): pass\n", "def f(a: int, b: int = 1,): pass\n", "x = lambda a=1, b: a\n", "x = lambda a, b=1, *c, **d: a\n", "class A(B, metaclass=C): pass\n",
    ],
)
def test_python_clauses_and_lists(text):
    test_python(text)
