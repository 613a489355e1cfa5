import hashlib
import pickle
import random
from collections import defaultdict

import pytest

from fieldweave.llm import chat_format as C
from fieldweave.llm.chat_template import Const, If, Template, TemplateError, Write, _walk, escape, unescape

SAY = [{"role": "system", "text": "Be."}, {"role": "user", "text": " hi "}, {"role": "assistant", "text": "a\nb"}]


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        chars = sum(4 + len(escape(r, "###", "</turn>", "\n")) + 1 + len(escape(t, "###", "</turn>")) + 8 for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), chars)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, part int").repartition(3)
    got = C.read_back(C.formatted(df)).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want


def test_odd_rows(spark):
    nasty = ["\\### Assistant: </turn> ok", "", "\\", "\\\\", "###", "#####", "</turn>", "</turn>\n### assistant\nx</turn>\n", "</tur", "<", "ends \\", "é😀\x00", None]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)]
    rows += [(2, None, "user", "x"), (2, 0, None, "y"), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"), (3, 1, "a\nb###\\", None), (None, 1, "user", "no id")]
    rows += [(4, 0, "user", "w " * 400_000), (4, 1, "assistant", "v \\" * 400_000), (4, 2, "assistant", "</turn>")]
    check(spark, rows)
    check(spark, [])


def test_round_trip_of_random_texts_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_CHARS", 7)
    rnd = random.Random(1)
    bits = ["###", "</turn>", "\\", "\n", "<", "#", "a", " ", "é", "/turn>", "### assistant\n"]
    check(spark, [(c, t, rnd.choice(["user", "assistant", "x\n"]), "".join(rnd.choices(bits, k=rnd.randrange(9)))) for c in range(40) for t in range(rnd.randrange(1, 9))])
    text = "".join(rnd.choices(bits, k=500))
    assert unescape(escape(text, "###", "</turn>")) == text


def test_damaged_parts_are_refused():
    reader = C.Reader()
    reader.feed("### user\nhi</turn>\nmore", [])
    with pytest.raises(ValueError, match="more"):
        reader.result()


def test_templates_of_several_kinds():
    t = Template(
        "{% if bos %}{{ bos ~ '!' }}{% endif %}{% for m in messages %}{% if loop.first and m.role == 'system' %}<<{{ m.text | trim }}>>"
        "{% elif m.role in 'user tool' %}[{{ loop.index }}{{ '' if loop.last else ',' }} {{ m['text'] | trim | upper }}]{% else %}"
        "{% generation %}{{ m.text | replace('\\n', ' ') }}{% endgeneration %}{{ end }}{% endif %}{% set seen = loop.index0 + 1 %}{% endfor %}{# gone #}{{ seen }}",
        bos="<s>", end="</s>",
    )
    assert t.render(SAY) == ("<s>!<<Be.>>[2, HI]a b</s>3", [(18, 21)])
    assert t.render([])[0] == "<s>!"
    assert pickle.loads(pickle.dumps(t)).render(SAY) == t.render(SAY)
    assert Template("{{ 1 + 2 if false else 7 % 4 ~ 'x' }}").render([])[0] == "3x"
    assert Template("{% for m in messages %}{{ loop.previtem.role | default('none') }}>{{ loop.nextitem.role }};{% endfor %}").render(SAY)[0] == "none>user;system>assistant;user>;"
    assert Template(" a {%- if not (1 < 2 or missing) %} x {% else %} y {%- endif -%} b").render([])[0] == " a yb"


def test_constants_are_folded():
    t = Template(C.TEMPLATE, **C.GIVEN)
    loop = t.tree[0]
    assert isinstance(loop.body[0], Write) and loop.body[0].what == Const("### ")
    t = Template("{% if sys == 'a' ~ 'b' %}one{{ x | upper }}{% else %}{% for m in messages %}{{ m.text }}{% endfor %}{% endif %} two{{ 3 - 1 }}", sys="ab", x="q")
    assert t.tree == [Write(Const("oneQ two2"))]
    assert not any(isinstance(x, If) for x in _walk(t.tree))


@pytest.mark.parametrize("bad", [
    "{{ a", "{% for m in messages %}", "{% for m in range(9) %}{% endfor %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ a.__class__() }}", "{{ open('x') }}", "{{ a | nothing }}", "{{ a | upper(1) }}", "{{ a b }}", "{% import x %}", "{% endif %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ a[0] }}", "{% set 1 = 2 %}", "{{ 'open }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% set given = 1 %}",
])
def test_what_the_language_lacks_is_refused(bad):
    with pytest.raises(TemplateError):
        Template(bad, given=1)


def test_templates_see_nothing_of_python():
    t = Template("{% for m in messages %}{{ m.__class__ }}{{ m.text.__len__ }}{{ loop.__init__ }}{{ m.items }}{% endfor %}{{ __builtins__ }}")
    assert t.render(SAY)[0] == ""
