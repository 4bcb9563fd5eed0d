"""Texts outside two-byte UTF-8 are encoded by the batches and trees too, not by the library's encode."""

from __future__ import annotations

import random

import pyarrow as pa

from mudline.llm import bpe

TEXTS = [
    "“Quoted” – it’s 5 €", "日本語の文章" * 400, "ไทย " * 50 + "ภาษาไทย" * 100, "हिन्दी में", "été plain", "👍🏽 ok 👨‍👩‍👧", "<|endoftext|>", "a<|startoftext|><|endoftext|>日 <|endoftext|", "plain words", "", "　wide space ",
    "İSTANBUL ẞ ǅ", "x" * 100 + "…", "we'LL don’t 'S 日's",
]


def test_odd_texts_without_the_librarys_encode():
    model = bpe.WordBpe(bpe.default_path())
    rng = random.Random(9)
    parts = ["日本", "’", "–", " ", "\n", "a", "the", "é", "é", "<|endoftext|>", "😀", "7", "½", "한글", "'s", "ß", "​"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    want = [model.library.encode(t, add_special_tokens=False).ids for t in texts]
    model.library = None
    for some in (texts, texts[:1], texts[6:7], texts[9:10], texts[::-1]):
        flat, counts = model.encode_texts(pa.array(some))
        end = 0
        for t, n in zip(some, counts.tolist(), strict=True):
            assert flat[end : end + n].tolist() == want[texts.index(t)], t
            end += n
        assert end == len(flat)
