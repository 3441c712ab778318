from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe, common
from gridloom.llm.common import flat_chunks, shingle_hashes


def test_words_and_hashes():
    texts = ["", " a  b\n", "A a ", None, "é\x0bé x" * 3, "w" * 2000 + " y", "  z\x1cq"]
    seen = {}
    for limit in (1, 10, 1 << 20):
        for a, b, flat in flat_chunks(pa.array(texts), lower=True, limit=limit):
            start, length, at = flat.words()
            h = common.hash_spans(flat.buf, start, length)
            for d in range(b - a):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[a + d] or "")
                want = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", low)]
                got = [flat.buf[s : s + n].tobytes() for s, n in zip(start[at[d] : at[d + 1]], length[at[d] : at[d + 1]], strict=True)]
                assert got == want
                for w, x in zip(want, h[at[d] : at[d + 1]].tolist(), strict=True):
                    assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=6), st.integers(1, 4))
def test_shingles(docs, k):
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    h, ends = shingle_hashes(np.array([x for d in docs for x in d], np.uint64) + np.uint64(5), at, k)
    want = [[tuple(d[i : i + k]) for i in range(len(d) - k + 1)] if len(d) >= k else ([tuple(d)] if d else []) for d in docs]
    assert np.diff(ends).tolist() == [len(w) for w in want]
    pairs = list(zip([x for w in want for x in w], h.tolist(), strict=True))
    assert len({p for p in pairs}) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_piece_ids_equal_the_tokenizer():
    rng = random.Random(1)
    parts = ["'", "'s", "'re", "'ll", "'x", " ", "  ", "\n", "\t", "a", "bc", "É", "1", "23", "½", "!", "?*", "日本", "😀", "<|endoftext|>", " ", " ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", "x" * 5000, " " * 300]
    made = bpe.tokenizer(bpe.default_path())
    ids, at = made.encode(pa.array([*texts, None]))
    for i, e in enumerate(made.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids
    assert at[-1] == at[-2]


def test_other_tokenizers_are_left_alone():
    import public_tokenizers

    made = bpe.tokenizer(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["Hello  World's end", "", "é日本", None, "x" * 300]
    ids, at = made.encode(pa.array(texts))
    assert not made.plain and bpe.tokenizer(bpe.default_path()).plain
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == made.tokenizer.encode(t or "", add_special_tokens=False).ids
