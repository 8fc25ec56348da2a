import hashlib
import random

import pytest

from convlens.llm import chat
from convlens.llm.templates import Node, Output, TemplateError, compile_template, parse


def run(source, **env):
    out = Output()
    compile_template(source, chat.FILTERS)(env, out)
    return "".join(out.parts), out.spans


@pytest.mark.parametrize("source, want", [
    ("a{{ 'b' }}{# no #}c", "abc"),
    ("{{ 1 + 2 }}{{ 'x' ~ 1 }}{{ not true }}{{ none }}", "3x1false"),
    ("{% if x == 'y' %}1{% elif x %}2{% else %}3{% endif %}", "2"),
    ("{% for m in l %}{{ loop.index }}{{ m }}{% if not loop.last %},{% endif %}{% endfor %}{{ m }}", "1a,2b"),
    ("{{ d.k }}{{ d['k'] }}{{ l[1] }}{{ l[9] }}{{ nope }}", "vvb"),
    ("{% set q = 'z' %}{{ q | upper }}", "Z"),
    ("{{ 'a' in l and 'q' not in l }}{{ 'A' if false else 'B' }}{{ 7 % 4 }}", "trueB3"),
    ("{{ d.__class__ }}{{ l.append }}{{ x.__init__ }}", ""),
    ("{{ '\\n\\'' }}", "\n'"),
])
def test_language(source, want):
    assert run(source, x="v", l=["a", "b"], d={"k": "v"})[0] == want


@pytest.mark.parametrize("source", ["{% if x %}", "{% endfor %}", "{{ }}", "{{ f(x) }}", "{{ x | eval }}", "{{ 1 1 }}", "{% import os %}", "{% for 1 in x %}{% endfor %}", "{{ a; b }}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        parse(source, chat.FILTERS)


def test_constants_are_folded():
    assert parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 1 and not false %}c{% else %}{{ x }}{% endif %}d", chat.FILTERS) == [Node("text", "ab11cd")]


def test_generation_spans():
    text, spans = run("p{% generation %}{{ x }}{% endgeneration %}q", x="abc")
    assert (text, spans) == ("pabcq", [(1, 4)])


def test_escapes():
    r = random.Random(3)
    for _ in range(2000):
        t = "".join(r.choices(["#", "##", "###", "\\", "</turn>", "</", "turn>", "/", "<", "a", ":", "\n", "### Assistant: "], k=r.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and "###" not in e and "</turn>" not in e
        assert chat.parse_turns(f"### {chat.escape_role(t)}: {e}</turn>\n") == [(t, t)]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = []
    for c, turns in by.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        formatted = "".join(f"### {chat.escape_role(r)}: {chat.escape(t)}</turn>\n" for r, t in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "é ### </turn>"), (1, 2, "assistant", "\\"), (2, 0, None, None), (2, None, "assistant", ""), (2, 0, "a: b###", "x" * 5000),
    (None, 1, "assistant", "n"), (None, 0, "user", "m"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (-7, 0, "user", "\\### Assistant: </turn> ok"),
]


def test_digest(spark, rows):
    data = ROWS + [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]
    frame = rows([(*r, 0, "s") for r in data], "conv_id long, turn long, role string, text string, n long, piece string")
    assert sorted(map(tuple, chat.digest(chat.render(frame)).collect()), key=repr) == brute(data)
    assert chat.digest(chat.render(frame.limit(0))).count() == 0


def test_conversations_and_other_templates(spark, rows):
    frame = rows(ROWS, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversations(chat.render(frame)).collect()}
    assert got[1]["formatted"] == "### user: hi</turn>\n### assistant: é \\#\\#\\# <\\/turn></turn>\n### assistant: \\\\</turn>\n"
    assert [chat.unescape(got[1]["formatted"][s["begin"]:s["end"]]) for s in got[1]["spans"]] == ["é ### </turn>", "\\"]
    stream = "<{% for m in messages %}{{ loop.index }}{{ m.text }}{% if loop.last %}!{% endif %}{% endfor %}>"
    whole = "{{ messages[0].role }}" + stream
    for template, want in ((stream, "<1hi2é ### </turn>3\\!>"), (whole, "user<1hi2é ### </turn>3\\!>")):
        assert {r["conv_id"]: r["formatted"] for r in chat.conversations(chat.render(frame, template)).collect()}[1] == want
