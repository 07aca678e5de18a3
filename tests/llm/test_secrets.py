"""Added secrets against generated sources whose literals are known, and in linear time."""

import random
import re
import string
import time

import pytest

from textloom.llm import secrets

BASE = [re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", re.I), re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")]
SENSITIVE_NAMES = ["db_password", "client_secret", "authToken", "PRIVATE_KEY", "aws_secret_access_key", "apiKey"]
PLAIN_NAMES = ["title", "colour", "row_count", "homepage", "description", "build"]


def key(rng):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(20, 40)))


#: (template, whether it names its value): {n} the name, {v} the value.
SYNTAXES = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "export {n}={v}", 'config["{n}"] = "{v}"', 'set("{n}", "{v}")', "{n} := `{v}`", '{n} = """\n{v}\n"""', "{n} = '''{v}'''", "{n}: |\n  {v}", "{n}: >-\n    {v}", '<{n}>{v}</{n}>', '<add key="{n}" value="{v}"/>', '{n}: str = "{v}"', 'part_of = "{v}"\n{n} = part_of']


def source(rng, count=30):
    """A source file, and the spans of its sensitive literals."""
    text, spans = "", set()
    for k in range(count):
        sensitive = rng.random() < 0.5
        name, value = rng.choice(SENSITIVE_NAMES if sensitive else PLAIN_NAMES), key(rng)
        piece = rng.choice(SYNTAXES).replace("part_of", f"part{k}").format(n=name, v=value)
        if sensitive:
            at = len(text) + piece.index(value)
            spans.add((at, at + len(value)))
        text += piece + "\n"
    return text, spans


def test_added_spans_of_generated_sources():
    rng = random.Random(11)
    right = wanted = reported = 0
    for _ in range(200):
        text, spans = source(rng)
        covered = [m.span() for p in BASE for m in p.finditer(text)]
        new = lambda s, covered=covered: not any(a < s[1] and s[0] < b for a, b in covered)
        got = {s for s in secrets.sensitive_literals(text) if new(s)}
        spans = {s for s in spans if new(s)}
        right, wanted, reported = right + len(got & spans), wanted + len(spans), reported + len(got)
    assert wanted > 1000
    assert right >= 0.95 * wanted and right >= 0.95 * reported, (right, wanted, reported)


def test_blocks_and_three_quotes():
    value = "Zx9" * 8
    for text in (f"private_key: |\n  {value}\n  {value}x\nother: 1\n", f'private_key = """\n{value}\n{value}x\n"""\nother = 1\n'):
        first = text.index(value)
        second = text.index(value, first + 24)
        assert secrets.sensitive_literals(text) == [(first, first + 24), (second, second + 25)]
    assert secrets.sensitive_literals(f"steps: |\n  {value}\nprivate_key: no\n") == []
    assert secrets.sensitive_literals(f'private_key = """{value}') is not None  # never closed


@pytest.mark.parametrize("unit", ["a=", "k:", "a=<", "a=*b=", 'a="', "a='''", 'a="""b', "a: |\n b\n", "k: >\n", "a=b(", "x = '''y'''\n"])
@pytest.mark.parametrize("end", ["", "(", '"'])
def test_lexer_is_linear_on_chains(unit, end):
    took = []
    for size in (30_000, 120_000):
        start = time.time()
        secrets.sensitive_literals(unit * (size // len(unit)) + end)
        took.append(time.time() - start)
    assert took[1] < 10 and took[1] < 0.5 + 8 * took[0]
