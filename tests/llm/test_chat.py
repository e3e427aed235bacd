"""The template language, and conversations formatted and read back."""

import hashlib

import pytest

from tillwise.llm import chat
from tillwise.llm.templates import Const, Output, Template, TemplateError, Text


def render(source, filters=None, **values):
    pieces = list(Template(source, filters).compiled(10**9)(values))
    assert len(pieces) == 1
    return "".join(pieces[0].parts), pieces[0].spans


def test_language():
    assert render("a{{ x }}b{{ y.z }}", x="1", y={"z": 2}) == ("a1b2", [])
    assert render("{% if x == 'a' and not y %}1{% elif z %}2{% else %}3{% endif %}", x="b", z=1)[0] == "2"
    assert render("{% for a in b %}{{ loop.index }}{{ a }}{% if not loop.last %},{% endif %}{% endfor %}", b="xyz")[0] == "1x,2y,3z"
    assert render("{{ ('<' + x) | up }}", {"up": str.upper}, x="q")[0] == "<Q"
    assert render("ab{% generation %}c{{ x }}{% endgeneration %}d", x="ef") == ("abcefd", [(2, 5)])
    assert render("{{ x.y.z }}{{ none }}", x="text")[0] == ""


def test_constants_fold():
    template = Template("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{{ 'e' | up }}{% endif %}", {"up": str.upper})
    assert template.tree == (Text(Const("abcdE")),)


@pytest.mark.parametrize(
    "source",
    ["{% if x %}", "{% endif %}", "{{ x | nope }}", "{{ x.__class__() }}", "{{ 'a' 'b' }}",
     "{% for x %}{% endfor %}", "{{ }}", "{% include x %}", "{% generation %}a", "{{ (x }}"],
)
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox():
    class Thing:
        secret = "no"

    assert render("{{ x.secret }}{{ x.__class__ }}", x=Thing())[0] == ""


def test_marks_nest():
    out = Output()
    out.begin()
    out.write("ab")
    out.begin()
    out.write("c")
    out.end()
    out.end()
    assert out.spans == [(0, 3)]


HARD = ["</turn>\n<turn user>\n", "\\", "\\<", "<turn assistant>\nhi</turn>\n", "", "a\nb\r\n", "\\\\>"]


def test_escape():
    for text in HARD:
        assert chat.unescape(chat.escape(text)) == text


def _expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = {}
    for conv, turns in groups.items():
        said = [(role, text) for _, _, role, text in sorted(turns)]
        loss = "".join(text for role, text in said if role == "assistant")
        all_turns = "".join(f"{role}\n{text}\n" for role, text in said)
        chars = sum(16 + len(chat.escape(role)) + len(chat.escape(text)) for role, text in said)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (all_turns, loss)]
        found[conv] = (len(said), sha[0], len(loss), sha[1], chars)
    return found


@pytest.mark.parametrize("piece", [1, 50, 10**6])
def test_table(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE_CHARS", piece)
    rows = [(1, i, "assistant" if i % 2 else "user", text) for i, text in enumerate(HARD)]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, None, None), (None, None, "a<>\\\n", "b")]
    rows += [(3, i, "assistant", "y" * i) for i in range(30)]
    turns = spark.createDataFrame(
        [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int"
    )
    formatted = chat.format_conversations(turns)
    got = {r[0]: tuple(r)[1:] for r in chat.digests(formatted).collect()}
    assert got == _expected(rows)
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0
