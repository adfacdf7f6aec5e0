"""Words of blocks against regular expressions, and the queries' SQL."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import words as W
from holdfast.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect, folder

PATTERNS = {W.PLAIN: (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True), W.RAW: (r"[^\x20\x09-\x0D]+", False), W.LOWER: (r"[^\x20\x09-\x0D]+", True)}


def split(text, kind):
    pattern, lower = PATTERNS[kind]
    text = text or ""
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbz9é. \n\t\x00\x85_İ", max_size=12)), min_size=1, max_size=6), st.sampled_from(list(PATTERNS)))
def test_words(texts, kind):
    w = W.Words(pa.array(texts, pa.string()), kind)
    want = [split(t, kind) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    seen = {}
    for x, h in zip((x for y in want for x in y), w.hash.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_segments_and_slices(monkeypatch):
    text = pa.array(["one two three four", None, "five six", "two"] * 3)
    whole = W.Words(text, W.RAW).hash
    monkeypatch.setattr(W, "SEGMENT", 5)
    assert (W.Words(text, W.RAW).hash == whole).all()
    batch = pa.RecordBatch.from_arrays([text], names=["text"])
    assert [b.num_rows for b in W.blocks(iter([batch]), limit=20)] and sum(b.num_rows for b in W.blocks(iter([batch]), limit=1)) == 12
    parts = [W.Words(b.column("text"), W.RAW).hash for b in W.blocks(iter([batch]), limit=20)]
    assert (np.concatenate(parts) == whole).all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    place = folder()
    assert compare(connect(place), QUERIES[name](spark, place), SQL[name]) is None
