"""Edit distances of one text to many, and what tells without a table, against the table of all prefixes."""

import random
import time

from ledgerlens.llm.lines import anchored_edits, edit_distance_within, edit_distances, edit_similar, similar_to


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_distances_to_many_texts():
    draw = random.Random(7)
    for _ in range(40):
        a, *others = ["".join(draw.choice("ab cé𝒳") for _ in range(draw.randrange(80))) for _ in range(9)]
        want = [plain(a, b) for b in others]
        assert edit_distances(a, others).tolist() == want
        assert similar_to(a, others) == [d <= int(0.2 * max(len(a), len(b)) + 1e-9) for b, d in zip(others, want, strict=True)]
        assert all(edit_distance_within(a, b, d) and not (d and edit_distance_within(a, b, d - 1)) for b, d in zip(others, want, strict=True))


def test_anchors_never_tell_too_few_edits():
    draw = random.Random(8)
    for _ in range(300):
        one = draw.choices("a b c dd eé fff ggg hh".split(), k=draw.randrange(1, 14))
        two = [w for w in one if draw.random() > 0.2] + draw.choices("ab", k=1)
        if draw.random() < 0.3:
            draw.shuffle(two)
        a, b = " ".join(one), " ".join(two)
        d = plain(a, b)
        assert anchored_edits(one, two) >= d
        assert edit_similar(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_lines_that_share_a_passage_cost_little_each():
    """Lines with one passage between parts of their own are no copies: each pair needs a table, of which many are made at once."""
    draw = random.Random(9)
    words = lambda n: " ".join("".join(draw.choices("aeinorst", k=draw.randrange(2, 8))) for _ in range(n))
    passage = words(60)
    texts = [f"{words(draw.randrange(20, 40))} {passage} {words(draw.randrange(20, 40))}" for _ in range(65)]
    most = [int(0.2 * max(len(texts[0]), len(t)) + 1e-9) for t in texts[1:]]
    began = time.process_time()
    one = [edit_distance_within(texts[0], t, k) for t, k in zip(texts[1:], most, strict=True)]
    singly, began = time.process_time() - began, time.process_time()
    many = [d <= k for d, k in zip(edit_distances(texts[0], texts[1:]).tolist(), most, strict=True)]
    assert many == one
    assert time.process_time() - began < singly / 2
