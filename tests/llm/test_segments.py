"""Pieces, token files and edit-aware counts against direct encoding."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallylens.llm import tokencounts, tokenfiles
from tallylens.llm.segments import Pieces, cut

SHARED = Pieces(limit=60)  # forgets often
TEXT = st.text(st.sampled_from("ab Zé1\n\t.,'   -#"), max_size=60)


def direct(pieces, t):
    return pieces.tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=5))
def test_ids_equal_direct_encoding(texts):
    p = SHARED
    assert [x.tolist() for x in p.ids(texts)] == [direct(p, t or "") for t in texts]


def test_memory_that_starts_anew_gives_the_same_ids():
    p = Pieces(limit=2)
    for t in ("one two three four", "five six\nseven two one"):
        assert p.ids([t])[0].tolist() == direct(p, t)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), TEXT), max_size=4))
def test_edited_counts_equal_full_counts(text, edits):
    p = SHARED
    tree = tokencounts.trees([text], p)[0]
    assert tree.text == text and tree.n_tokens == len(direct(p, text))
    for start, n, new in edits:
        start = min(start, len(text))
        tree.edit(start, start + n, new, p)
        text = text[:start] + new + text[start + n :]
        assert tree.text == text and tree.n_chars == len(text)
        assert tree.n_tokens == len(direct(p, text))


def test_edits_of_a_long_text_touch_little():
    text = "some words of a long text. " * 3000
    tree = tokencounts.trees([text], SHARED)[0]
    for at in (0, 40_000, 80_999):
        tree.edit(at, at + 5, "XY z", SHARED)
        text = text[:at] + "XY z" + text[at + 5 :]
        assert tree.n_tokens == len(direct(SHARED, text))
    assert tree.reencoded < 300 and tree.text == text


@pytest.mark.parametrize("line", ["some words\r\n", "\tsome\twords\n", "some\xa0words here\n", "a\tb\r\n"])
def test_edits_of_a_text_with_rare_white_space_touch_little(line):
    text = line * 3000
    tree = tokencounts.trees([text], SHARED)[0]
    for at in (0, len(text) // 2, len(text) - 1):
        tree.edit(at, at + 5, "XY\tz", SHARED)
        text = text[:at] + "XY\tz" + text[at + 5 :]
        assert tree.n_tokens == len(direct(SHARED, text))
    assert tree.reencoded < 300 and tree.text == text


def test_a_tree_that_grows_and_shrinks_keeps_its_sums():
    rng, text = np.random.default_rng(4), "a few words. " * 40
    tree = tokencounts.trees([text], SHARED)[0]
    for k in range(60):
        start, n = int(rng.integers(0, len(text) + 1)), int(rng.integers(0, 400 if k % 3 else 5))
        new = "" if k % 3 else "more words here and there\n" * int(rng.integers(1, 120))
        tree.edit(start, start + n, new, SHARED)
        text = text[:start] + new + text[start + n :]
        assert tree.text == text and tree.n_chars == len(text) and tree.n_tokens == len(direct(SHARED, text))
        assert max(map(len, tree.chars)) <= 2 * tokencounts.FAN


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\n<|endoftext|>  z", "a b <|endof text|>"])
def test_special_tokens_are_those_of_the_plain_call(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.tokenizer_path())
    want = tok.encode(text, add_special_tokens=False).ids
    assert SHARED.ids([text])[0].tolist() == want
    tree = tokencounts.trees([text], SHARED)[0]
    assert tree.n_tokens == len(want)
    tree.edit(0, 0, "<|endof text|>", SHARED)
    tree.edit(7, 8, "", SHARED)
    assert tree.text == "<|endoftext|>" + text and tree.n_tokens == len(tok.encode(tree.text, add_special_tokens=False).ids)


def test_cut_is_lossless():
    assert "".join(cut("a  b\n\nc d\ne ")) == "a  b\n\nc d\ne "


@pytest.mark.parametrize("top", [1, 2, 255, 50257, 1 << 40, 1 << 61, 1 << 64])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 2, 59, 60, 61, 1023, 1024, 1025, 5000):
        ids = (rng.random(n) ** 4 * (top - 1)).astype("uint64")
        if n > 3 and top == 1 << 64:
            ids[3:] = rng.choice(np.array([(1 << 64) - 1, 1 << 62, 15 << 60, 3], dtype="uint64"), n - 3)
            ids[:3] = [(1 << 64) - 1, 1 << 60, (1 << 60) - 1]
        words, first = tokenfiles.encode_blocks(ids)
        assert (tokenfiles.decode_blocks(words, first, n) == ids).all()


def test_simple8b_is_compact():
    words, _ = tokenfiles.encode_blocks(np.full(1000, 50000))
    assert len(words) <= 340
    words, _ = tokenfiles.encode_blocks(np.ones(1020, dtype="int64"))
    assert len(words) == 17
