"""PII: the base spans against plain regular expressions, and disguises mapped back to the source."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda x: [int(c) for c in x if c in "0123456789"]

    def card(d):
        return 16 <= len(d) <= 19 and sum(n if k % 2 == 0 else sum(divmod(2 * n, 10))
                                          for k, n in enumerate(d[::-1])) % 10 == 0
    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
            "card": [m.span() for m in CARD.finditer(text) if card(digits(m[0]))],
            "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- (0é4\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.detect(text) == plain(text)


@pytest.mark.parametrize("text", [
    "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "a@b.c@d.ee x@y @z.de .%+@q-.w", "+1 (212) 555-0147 +49.. +1+22222222"])
def test_base_cases(text):
    assert pii.detect(text) == plain(text)


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("write to jo.doe [at] mail [dot] org now", "email", "jo.doe [at] mail [dot] org"),
    ("write to jo at mail dot org", "email", "jo at mail dot org"),
    ("mail jо@mail.org please", "email", "jо@mail.org"),
    ("call plus four nine three zero one two three four five six", "phone",
     "plus four nine three zero one two three four five six"),
    ("host １０.0.0.１ is up", "ip", "１０.0.0.１"),
    ("host one zero dot two dot three dot four one", "ip", "one zero dot two dot three dot four one"),
    ("card four one one one 1111 1111 1111", "card", None),
    ("jo​@mail.org", "email", None)])
def test_disguises(text, kind, hidden):
    base = pii.detect(text)
    added = pii.revealed(text, base) if pii.disguised(text) else {}
    if hidden is None:
        return
    assert [text[a:b] for a, b in added[kind]] == [hidden]


@pytest.mark.parametrize("text", ["look at the dot on the map", "one or two of three", "Meet me at six.", "", "a.b.c",
                                  "Ελλάδα και Москва at noon", "nine men at one dot"])
def test_clean_texts_stay(text):
    assert not any(pii.revealed(text, pii.detect(text)).values())
    assert pii.redact(text) == text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" * 100_000, "1." * 150_000, "a@" * 100_000, "one " * 100_000):
        pii.detect(text)
        pii.normalise(text)


def test_query(spark):
    rows = [(1, "x@y.zz and 10.0.0.1", "k"), (2, None, None), (2, None, None), (3, "", "q"), (None, "a [at] b [dot] cc", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n_email` string")
    got = sorted((tuple(r) for r in pii.find_personal(df, ["doc_id"]).collect()), key=str)
    assert len(got) == 5 and sum(r[1] for r in got) == 1
    assert [r[-1] for r in got if r[0] == 1] == ["email:0:6,ip:11:19"]
    assert [(r[-2], r[-1]) for r in got if r[0] is None] == [(1, "email:0:17")]
    kept = pii.redacted(df.withColumnRenamed("n_email", "n_chars"), ["doc_id", "text", "n_chars"]).collect()
    assert {r["text"] for r in kept} == {"[EMAIL] and [IP]", None, "", "[EMAIL]"}


@pytest.mark.parametrize(("text", "hidden"), [
    ("host 10[.]0[.]0[.]1 is up", "10[.]0[.]0[.]1"), ("host 192.168.1[.]5", "192.168.1[.]5"), ("mail jo@mail(.)org", "jo@mail(.)org"),
    ("jo@mail {.} org", "jo@mail {.} org"), ("call plus 1 555 123 4567 now", "plus 1 555 123 4567"),
    ("call Plus 49 30 123 4567", "Plus 49 30 123 4567"), ("dot one.2.3.4", "one.2.3.4")])
def test_disguises_without_another_trace(text, hidden):
    assert pii.disguised(text)
    assert [text[a:b] for spans in pii.revealed(text, {}).values() for a, b in spans] == [hidden]
    assert hidden not in pii.redact(text)


PIECES = ["jo", "mail", "org", "@", " at ", "[at]", "( @ )", ".", "[.]", " ( . ) ", " dot ", "\ndot ", "(dot)", "plus ", "Plus\t", "+", "1",
          "10", "49 30 123 4567", "255", "one", " two ", "nine-", "oh ", " ", "  ", "\n", "\u0430", "\uff11", "\u200b", "\xad", "\xe9", "f\u0131ve ", "N\u0130NE", "s\u0130x"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_the_gate_holds_wherever_something_is_revealed(text):
    if any(pii.revealed(text, pii.detect(text)).values()):
        assert pii.disguised(text)
    if not pii.disguised(text):
        assert pii.normalise(text)[0] == text


def test_the_gate_takes_linear_time():
    for text in (" " * 300_000, "(" * 300_000, "a" + " \t" * 150_000, "plus " * 60_000, "at " * 100_000, "one,,,," * 40_000, "[ " * 150_000):
        pii.disguised(text)
        pii.normalise(text)


@pytest.mark.parametrize(("text", "base", "whole", "redacted"), [
    ("to j\u043ehn@mail.org now", {"email": ["hn@mail.org"]}, {"email": ["j\u043ehn@mail.org"]}, "to [EMAIL] now"),
    ("call +1 555 123 45\uff167!", {"phone": ["+1 555 123 45"]}, {"phone": ["+1 555 123 45\uff167"]}, "call [PHONE]!"),
    ("a@b.cc [dot] dd", {"email": ["a@b.cc"]}, {"email": ["a@b.cc [dot] dd"]}, "[EMAIL]"),
    ("a@b.cc, two dot one", {"email": ["a@b.cc"]}, {}, "[EMAIL], two dot one")])
def test_spans_beyond_a_base_span_are_added(text, base, whole, redacted):
    cut = lambda spans: {k: [text[a:b] for a, b in x] for k, x in spans.items() if x}
    assert cut(pii.detect(text)) == base
    assert cut(pii.revealed(text, pii.detect(text))) == whole
    assert pii.redact(text) == redacted


def test_spans_inside_a_base_span_are_dropped():
    text = "10\u200b.0.0.1"
    assert pii.revealed(text, {"ip": [(0, 9)]}) == {} and pii.revealed(text, {"ip": [(0, 5), (5, 9)]}) == {"ip": [(0, 9)]}
    assert pii.revealed(text, {"ip": [(0, 20), (1, 2)]}) == {}
