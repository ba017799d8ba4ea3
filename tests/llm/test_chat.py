"""Views of conversations: round trip, masks, long conversations."""

import random

from doctriage.llm import chat


def _views(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    out = {}
    for r in chat.rotate(df).collect():
        out.setdefault((r.conv_id, r.viewer), []).append(r)
    return {k: sorted(v, key=lambda r: r.position) for k, v in out.items()}


def test_three_speakers(spark):
    rows = [(1, 0, "system", "rules", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 3, "cy", "é!", "x"), (1, 4, "ann", "bye", "x")]
    views = _views(spark, rows)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "cy")}
    whole = "".join(r.rendered for r in views[1, "ann"])
    assert whole == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
        "<|im_start|>user name=cy\né!<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    )
    assert [whole[r.mask_start : r.mask_end] for r in views[1, "ann"] if r.role == "assistant"] == ["hi<|im_end|>", "bye<|im_end|>"]
    assert [r.mask_start is None for r in views[1, "bob"]] == [True, True, False, True, True]


def test_places_of_long_conversations(spark):
    rng = random.Random(1)
    rows = [(5, t, rng.choice("abc"), "word " * rng.randint(0, 9), None) for t in range(3000)]
    rows += [(c, t, rng.choice("ab"), f"t{t}", None) for c in range(6, 90) for t in range(4)]
    rows += [(None, None, None, None, None), (None, 1, "a", "q", None), (5, 7, "a", "again", None), (5, 7, "a", "again", None), (4, 0, "system", "alone", None)]
    rng.shuffle(rows)
    views = _views(spark, rows)
    assert (4, "system") not in views and not any(c == 4 for c, _ in views)
    assert set(v for c, v in views if c is None) == {"unknown", "a"}
    for (conv, viewer), turns in views.items():
        mine = sorted(((t is not None, t or 0), s or "unknown", x or "") for c, t, s, x, _ in rows if c == conv)
        assert [((r.turn is not None, r.turn or 0), r.name or "system") for r in turns] == [(t, s) for t, s, _ in mine]
        whole, at = "".join(r.rendered for r in turns), 0
        for i, (r, (_, speaker, text)) in enumerate(zip(turns, mine)):
            assert (r.position, r.start, r.end) == (i, at, at + len(r.rendered))
            at = r.end
            if speaker == viewer:
                assert r.role == "assistant" and whole[r.mask_start : r.mask_end] == text + "<|im_end|>"
            else:
                assert r.mask_start is None and r.mask_end is None


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(df).count() == 0
