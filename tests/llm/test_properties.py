"""Properties of the pure parts: packing, choice of pieces, boundaries, carried wording."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import cutting, packing
from sievewright.llm.tokens import coder
from sievewright.llm.wording import carried, near_forms, words

ITEMS = st.lists(st.tuples(st.integers(1, 20), st.sampled_from("abc"), st.integers(0, 5)), max_size=60)
TEXT = st.text(alphabet=st.sampled_from(list("abc XY.!?\n\t'1239-é図。 ")), max_size=400)


@given(ITEMS)
@settings(max_examples=100, deadline=None)
def test_bins_are_within_capacity_and_free_of_conflicts(items):
    items = sorted(items, reverse=True)
    bins = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 20, apart=(("a", "b"),))
    inside = {}
    for item, b in zip(items, bins, strict=True):
        inside.setdefault(b, []).append(item)
    for content in inside.values():
        assert sum(i[0] for i in content) <= 20
        assert len({i[2] for i in content}) == len(content)
        assert not {"a", "b"} <= {i[1] for i in content}


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_boundaries_are_places_between_tokens_and_characters(text):
    code = coder()
    ends = cutting.token_ends(text, code)
    at, token, kind = cutting.boundaries(text, ends)
    data = text.encode()
    assert at[-1] == len(data) and token[-1] == len(ends) and kind[-1] == 5
    assert (np.diff(token) > 0).all() if len(ends) else len(token) == 1
    for a, t in zip(at[:-1], token[:-1], strict=True):
        assert ends[t - 1] == a
        data[:a].decode()


@given(st.lists(st.tuples(st.integers(1, 24), st.integers(0, 4)), min_size=1, max_size=80), st.sampled_from([(96, 0), (96, 24), (200, 32)]))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_without_gaps(steps, limit):
    most, overlap = limit
    token = np.cumsum([s for s, _ in steps])
    kind = np.array([k for _, k in steps[:-1]] + [5], np.int8)
    parts = cutting.choose(token, kind, most, overlap)
    if token[-1] <= most:
        assert parts == []
        return
    done = 0
    for n, (start, base, end, _) in enumerate(parts):
        assert token[end] - start <= most and token[end] > done
        assert start == (0 if n == 0 else max(done - overlap, parts[n - 1][0] + 1) if overlap else done)
        assert base < 0 or token[base] <= start
        done = int(token[end])
    assert done == token[-1]


@given(TEXT, st.integers(1, 300))
@settings(max_examples=150, deadline=None)
def test_neighbours_of_a_border_agree(text, border):
    data = text.encode()
    border = min(border, max(len(data) - 1, 0))
    whole = cutting.first_anew(data, border)
    lead = max(0, border - 8)
    assert lead + cutting.first_anew(data[lead:], border - lead) == whole or border == 0 or lead == 0
    data[:whole].decode()


@given(st.lists(st.integers(0, 30), min_size=5, max_size=40), st.integers(0, 20), st.integers(0, 20))
@settings(max_examples=100, deadline=None)
def test_a_text_carries_its_own_parts(word_ids, before, after):
    masks = {}
    for j, x in enumerate(word_ids):
        masks[x] = masks.get(x, 0) | 1 << j
    text = [-1] * before + word_ids + [-1] * after
    assert carried(text, masks, len(word_ids)).bit_count() == len(word_ids)
    assert carried([-1] * 50, masks, len(word_ids)) == 0


@given(st.text(alphabet="abcde", min_size=4, max_size=9), st.integers(0, 8))
@settings(max_examples=100, deadline=None)
def test_words_one_edit_apart_are_near(word, at):
    at = at % len(word)
    assert near_forms(word) & near_forms(word[:at] + word[at + 1 :])
    assert near_forms(word) & near_forms(word[:at] + "x" + word[at:])
    assert near_forms(word) & near_forms(word[:at] + "x" + word[at + 1 :])


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_words_never_fail(text):
    assert all(w.isascii() and w.isalnum() and w == w.lower() for w in words(text))
