import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from answerscope.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string"


def render(template, messages):
    return "".join(t or "" for t, _ in C.compile_template(template)(iter(messages)))


@given(st.lists(st.tuples(st.text(alphabet="ab\\n\n|<>im_startend", max_size=12), st.text(max_size=30) | st.just(C.CONTROL_CASE)), max_size=5))
def test_round_trip(turns):
    chunks = C.compile_template()({"role": r, "text": t} for r, t in turns)
    back = list(C.turns_of(C.pieces(chunks)))
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [learned for _, _, learned, _ in back] == [[t] if r == "assistant" else [] for r, t in turns]


def test_language():
    rows = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    t = "A{% for m in messages %}{% if m.role == 'user' and not m.text == '' %}[{{ m.text | trim | upper }}]{% elif m.role != 'x' %}{{ '(' + m.text + ')' }}{% else %}-{% endif %}{% endfor %}Z"
    assert render(t, rows) == "A[HI](yo)Z"


def test_constants_are_folded():
    tree = C.fold(C.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{% if 'y' %}e{% endif %}"))
    assert tree == (C.Put(C.Const("abCde")),)


@pytest.mark.parametrize("bad", ["{% for m in messages %}", "{{ m.__class__ }}", "{{ m | open }}", "{{ f(1) }}", "{% import os %}", "{{ 'a' 'b' }}", "{{ }}"])
def test_sandbox(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_cases(spark, tmp_path):
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, None, "a", "x"), (1, 2, "assistant", "b", "x"), (2, None, "assistant", None, "x"), (None, 1, "user", "q" * 100_000, "x"), (3, 1, "us\ner", C.CONTROL_CASE, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in C.op10_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -1}
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("\na\nassistant\nb\nassistant\nb\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("bb"))
    assert (got[2].loss_chars, got[2].turns_sha256) == (0, sha("assistant\n\n"))
    assert got[3].turns_sha256 == sha(f"us\ner\n{C.CONTROL_CASE}\n")
    assert got[None].formatted_chars == 100_000 + 28
    assert got[-1].loss_sha256 == sha(C.CONTROL_CASE)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in C.op10_chat_format(spark, str(tmp_path)).collect()] == [-1]
