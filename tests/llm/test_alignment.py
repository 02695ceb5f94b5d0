import random

import brute
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelweave.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters = alignment.byte_level_bytes()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items() if t != "<|endoftext|>"}
    return (lambda t: first.encode(t, add_special_tokens=False).ids), second.encode, a_bytes, alignment.piece_bytes(second)


def odd_rows(n=150):
    rng = random.Random(11)
    signs = "abcdeABCDE      \n\t\r\x1c\x85\xa0 　éÉß漢字かな각̧'`.,!?0123456789²<>|\U0001f600​▁"
    words = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "it's", " the", "  ", "naïve", "internationalisation"]
    return [(1000 + i, "".join(rng.choice(words) if rng.random() < 0.3 else rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def test_equal_plain_alignment(corpus, awkward, libraries, monkeypatch):
    copies = [(4, "other text of id four"), (4, "other text of id four"), (None, "no id"), (None, "no id"), (None, None)]
    rows = [r for r in awkward if r[0] not in (12, 18)] + odd_rows() + copies
    expected = sorted(brute.alignment(rows, *libraries), key=str)
    assert sum(r[1] > 0 for r in expected) > 100 and sum(r[1] == 0 for r in expected) > 5
    for hot in (alignment.HOT, 30):
        found = alignment.align_documents(corpus(rows), BYTE, PIECE, hot=hot)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, found.collect()), key=str) == expected


def test_windows_forgotten_between_slices(libraries, monkeypatch):
    """The same answers from a process that starts afresh with every slice and remembers no window of two tokens."""
    with open(BYTE, encoding="utf-8") as a, open(PIECE, "rb") as b:
        windows = alignment.Windows(a.read(), b.read())
    texts = [t for _, t in odd_rows(60)]
    whole = windows.documents(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "SHORT", 2)
    windows.forget()
    apart = [r for t in texts for r in windows.documents([t])]
    assert [r[:5] + (list(r[5]), list(r[6])) for r in whole] == [r[:5] + (list(r[5]), list(r[6])) for r in apart]


def test_words_are_tokenised_once(libraries, monkeypatch):
    """Words apart give what whole texts give, odd signs between them too; a known word is not tokenised again."""
    with open(BYTE, encoding="utf-8") as a, open(PIECE, "rb") as b:
        definition, model = a.read(), b.read()
    apart, whole = alignment.Windows(definition, model), alignment.Windows(definition, model)
    assert apart.apart
    whole.apart = False
    ends = ["\n", "\n\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "'s", ".", "é", "\u0301", "x" * 80, "\x00", "▁", ""]
    texts = [f"one{e} two{e} {f}three {f}" for e in ends for f in ends] + [t for _, t in odd_rows(400)]
    plain = lambda rows: [r[:5] + (list(r[5]), list(r[6])) for r in rows]
    assert plain(apart.documents(texts)) == plain(whole.documents(texts))
    seen = []
    monkeypatch.setattr(apart, "tokenise", lambda each, f=apart.tokenise: seen.extend(each) or f(each))
    text = "one\n two\n three. one\n"
    assert apart.documents([text])[0][0] == len(libraries[0](" " + text))
    assert seen == ["three."]


def test_long_runs(libraries):
    with open(BYTE, encoding="utf-8") as a, open(PIECE, "rb") as b:
        windows = alignment.Windows(a.read(), b.read())
    texts = ["x" * 100_000, " " * 100_000, "1" * 100_000, "word " * 50_000]
    for text, row in zip(texts, windows.documents(texts)):
        assert row[0] == len(libraries[0](" " + text)) and row[1] == len(libraries[1](text)) and row[3] == sum(row[6])


def test_first_tokenizer_equals_its_library_on_every_sign(libraries):
    with open(BYTE, encoding="utf-8") as a, open(PIECE, "rb") as b:
        windows = alignment.Windows(a.read(), b.read())
    for low in range(0, 0x20000, 16):
        signs = "".join(chr(c) for c in range(low, low + 16) if not 0xD800 <= c < 0xE000)
        text = "".join(f"a{c}b 1{c}{c} {c} x{c}'s" for c in signs)
        assert windows.first.encode_ordinary(text) == libraries[0](text), hex(low)


def test_empty_table(corpus):
    assert alignment.align_documents(corpus([(1, "x")]).filter(F.lit(False)), BYTE, PIECE).collect() == []
    assert [tuple(r) for r in alignment.align_documents(corpus([(1, None)]), BYTE, PIECE).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
