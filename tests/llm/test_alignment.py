"""Alignment against plain loops over decoded bytes."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello, world!", "", None, "  two  spaces \n  lines\t\ttabs ", "L'été à Zürich: don't it's 12.5%", "你好 世界", "🙂🙂 naïve \U0001F600x",
         "a ▁ b", "▁", "word▁word x", "<0x0A> <s> </s> <|endoftext|> <unk>", "x\0y", "İstanbul ẞ ǅ ﬁn ²", "  a　 b\x1c c\x85 d", "é ​ z",
         "\n", " ", "a", "Hello, world!", "supercalifragilistic " * 40, "y" * 3000, "�  \U0010FFFF"]


class Plain:
    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PATHS[1])
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def tokens(self, text):
        """[(id, start, end)] of a and of b, or two empty lists."""
        out = []
        for ids, spell in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.spell_a), (self.b.encode(text), self.spell_b)) if text else ():
            at, found, joined = 0, [], b""
            for i in ids:
                piece = spell(i)
                found.append((i, at, at + len(piece)))
                at, joined = at + len(piece), joined + piece
            if joined != (" " + text).encode():
                return [], []
            out.append(found)
        return tuple(out) if out else ([], [])

    def spell_a(self, i):
        return bytes(self.byte[c] for c in self.a.id_to_token(i))

    def spell_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, a, b):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        shown, low = [], 0
        for end in ends:
            shown.append("|".join(",".join(str(i) for i, s, e in x if low < e <= end) for x in (a, b)))
            low = end
        return shown

    def links(self, a, b):
        return [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def rows(plain, docs):
    tokens = [plain.tokens(t) for _, t in docs]
    links = [plain.links(*x) for x in tokens]
    count = Counter(p for x in links for p in x)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (i, _), (a, b), pairs in zip(docs, tokens, links):
        groups = plain.groups(a, b)
        out.append((i, len(a), len(b), len(groups), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out)


def got(spark, docs, **options):
    df = spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, n_a int, row string").repartition(3)
    return sorted(tuple(r) for r in alignment.aligned(df, *PATHS, keep=["doc_id"], **options).collect())


def test_all(spark, plain):
    docs = list(enumerate(TEXTS)) + [(0, "Hello, world!"), (0, "Hello, world!")]
    want = rows(plain, docs)
    assert got(spark, docs) == want
    assert got(spark, docs, pairs=0) == want


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 9, "k")], "doc_id long, text string, n_links int, row string")
    out = alignment.aligned(df, *PATHS, keep=["doc_id", "row"]).collect()
    assert out[0]["row"] == "k" and out[0]["n_links"] == 2


def test_no_documents(spark):
    assert got(spark, []) == []


def test_a_long_text(spark, plain):
    docs = [(1, "lorem ipsum, dolor; sit amet 你好 é\n" * 300), (2, "lorem 你 x")]
    assert got(spark, docs) == rows(plain, docs)


def test_a_text_of_a_million_words(spark):
    out = got(spark, [(1, "ab cd " * 500_000)])[0]
    assert out[1] >= 1_000_000 and out[4] >= 1_000_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t▁'aé你🙂")), max_size=30), max_size=4))
def test_any_text(plain, texts):
    n_a, n_b, n_groups, shown, a, a_length, b, b_length = alignment.aligner(*PATHS).align(texts)
    tokens = [plain.tokens(t) for t in texts]
    assert a.tolist() == [i for x, _ in tokens for i, _, _ in x] and b.tolist() == [i for _, x in tokens for i, _, _ in x]
    assert a_length.tolist() == [e - s for x, _ in tokens for _, s, e in x] and b_length.tolist() == [e - s for _, x in tokens for _, s, e in x]
    assert shown == [";".join(plain.groups(*x)) for x in tokens]
    assert n_groups.tolist() == [len(plain.groups(*x)) for x in tokens]
    assert n_a.tolist() == [len(x) for x, _ in tokens] and n_b.tolist() == [len(x) for _, x in tokens]


def test_after_forgetting_and_without_cuts(plain, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 3)
    monkeypatch.setattr(alignment, "JOINED", 20)
    for cuts in (True, False):
        made = alignment.Aligner(*PATHS)
        assert made.cuts
        made.cuts = cuts
        for text in TEXTS * 2:
            assert made.align([text])[3] == [";".join(plain.groups(*plain.tokens(text)))]


def test_ends_come_from_offsets_and_spans(plain):
    made = alignment.aligner(*PATHS)
    for text in TEXTS:
        if plain.tokens(text)[0]:
            for tokenizer, want in zip((made.a, made.b), plain.tokens(text)):
                assert tokenizer.encode(" " + text).end.tolist() == [e for _, _, e in want]
